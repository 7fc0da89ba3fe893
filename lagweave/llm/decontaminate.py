"""Benchmark decontamination by winnowing.

Every k-word gram is hashed; of each run of `window - k + 1` successive grams the smallest hash is
kept (the last one, of equals). Two texts that share `window` words share all grams in them, hence a
kept gram: the fingerprints of documents and of benchmark items join on the hash, and each hit is
extended to the windows around it, which are compared by two independent 64-bit hashes. So every
shared window is found, and only windows near a hit are looked at.

A benchmark of at most `part_bytes` of text is sent to the executors, which look its fingerprints and
windows up. A larger one is met by joins: a bounded bitmap of its fingerprints picks the windows of
documents that may be its own, and these join its windows by their hashes. Windows and texts that
are frequent are dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm.shared import LETTERS_DIGITS, TWO, Sieve, Words, binary_array, gram_hashes, grams_at, named, paired, parted, saved, slices, windows

GRAM, SALTS, ROW_BYTES = 5, 16, 64
WINDOW = ["size", "one", "two"]


def kept_grams(hashes: np.ndarray, text: np.ndarray, run: int) -> np.ndarray:
    """Indices of the grams that winnowing keeps: of each `run` grams of one text the last smallest.

    A text of fewer grams than run keeps its smallest too.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, int)
    first = np.searchsorted(text, text)  # first gram of each gram's text
    at, best = np.arange(n), np.arange(n)
    for back in range(1, run):
        other = at - back
        valid = other >= first
        other = np.where(valid, other, at)
        best = np.where(hashes[other] < hashes[best], other, best)
    last = np.append(text[1:] != text[:-1], True)
    full = (at - first >= run - 1) | last
    return np.unique(best[full])


def fingerprints(w: Words, one: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place and text of the grams that winnowing keeps of the texts of a window or more."""
    start, text = windows(np.where(w.counts >= window, w.counts, 0), w.first, GRAM)
    grams = gram_hashes(one, GRAM)[start]
    kept = kept_grams(grams, text, window - GRAM + 1)
    return grams[kept], start[kept], text[kept]


def whole_windows(w: Words, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, starts, texts) of the windows of items: a text of fewer words than window is one."""
    yield window, *windows(np.where(w.counts >= window, w.counts, 0), w.first, window)
    for m in np.unique(w.counts[(w.counts > 0) & (w.counts < window)]).tolist():
        text = np.flatnonzero(w.counts == m)
        yield m, w.first[:-1][text], text


def near_windows(w: Words, one: np.ndarray, window: int, short: list[int], known: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, starts, texts) of the windows that may be an item's.

    known(0, hashes) tells which kept grams may be an item's, known(m, hashes) which m-word windows
    may be a short item; short: the numbers of words of short items.
    """
    grams, start, text = fingerprints(w, one, window)
    own = known(0, grams)
    start, text = start[own], text[own]
    around = (start[:, None] - np.arange(window - GRAM + 1)[None, :]).ravel()
    text = np.repeat(text, window - GRAM + 1)
    inside = (around >= w.first[text]) & (around + window <= w.first[text + 1])
    around, unique = np.unique(around[inside], return_index=True)
    yield window, around, text[inside][unique]
    for m in short:
        start, text = windows(np.where(w.counts >= m, w.counts, 0), w.first, m)
        near = known(m, gram_hashes(one, m)[start])
        yield m, start[near], text[near]


class Part:
    """A bounded benchmark, ready for lookups: sorted fingerprints and window hashes."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        w = Words(pa.array(texts, pa.large_string()), LETTERS_DIGITS)
        one, two = w.hashes(), w.hashes(TWO)
        self.ids, self.window = ids, window
        self.grams = np.unique(fingerprints(w, one, window)[0])
        self.tables = {m: self.table(one, two, start, m, text) for m, start, text in whole_windows(w, window)}
        self.short = [m for m in self.tables if m < window]

    @staticmethod
    def table(one: np.ndarray, two: np.ndarray, start: np.ndarray, length: int, text: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct (window, item) sorted by the first hash: both hashes and the item."""
        rows = np.unique(np.stack([grams_at(one, start, length), grams_at(two, start, length), text.astype(np.uint64)], 1), axis=0)
        return rows[:, 0].copy(), rows[:, 1].copy(), rows[:, 2].astype(np.int64)

    def known(self, m: int, hashes: np.ndarray) -> np.ndarray:
        return isin_sorted(hashes, self.tables[m][0] if m else self.grams)

    def found(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hit words (flags), and the distinct pairs (text, item) of occurring windows."""
        one, two = w.hashes(), None
        hit = np.zeros(len(one) + 1, np.int64)
        pairs = []
        for m, start, text in near_windows(w, one, self.window, self.short, self.known):
            if len(start):
                two = w.hashes(TWO) if two is None else two
                pairs.append(self.matches(self.tables[m], one, two, start, text, m, hit))
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=0)
        return np.cumsum(hit)[:-1] > 0, pairs[:, 0], pairs[:, 1]

    @staticmethod
    def matches(table: tuple[np.ndarray, ...], one: np.ndarray, two: np.ndarray, start: np.ndarray, text: np.ndarray, length: int, hit: np.ndarray) -> np.ndarray:
        first, second, item = table
        a, b = grams_at(one, start, length), grams_at(two, start, length)
        lo, hi = np.searchsorted(first, a), np.searchsorted(first, a, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(a)), n)
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]
        same = second[row] == b[which]
        which, row = which[same], row[same]
        at = start[np.unique(which)]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + length, -1)
        return np.unique(np.stack([text[which], item[row]], 1), axis=0)


def isin_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def marked(docs: DataFrame, benchmark: DataFrame, window: int = 8, part_bytes: int = 16 << 20, keep: bool = False) -> DataFrame:
    """docs (doc_id, text; others are dropped) with n_words, hits and items; with keep, the columns
    of docs follow as __0, __1 and so on.

    hits: bytes, a flag per word; items: the distinct ids (as strings) of benchmark items of which a
    window occurs. Words are runs of ASCII letters and digits and of all non-ASCII characters, after
    lower-casing A-Z. An item of fewer words than a window is one window; without words it is
    ignored, like items whose id or text is null. Items that share an id count once. A null text has
    no words. Rows are kept as they come: repeated rows give repeated results.
    """
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} words at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *[named(c).alias(f"__{i}") for i, c in enumerate(docs.columns) if keep])
    kinds = [f"__{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema) if keep]
    schema = ", ".join(["doc_id long, text string, n_words long, hits binary, items array<string>", *kinds])
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text <> ''")
    size = items.agg(F.sum(F.octet_length("item") + F.octet_length("text") + ROW_BYTES)).first()[0] or 0
    if size > part_bytes:
        return joined(rows, items, window).mapInArrow(flagged(window), schema)
    known = items.collect()
    part = docs.sparkSession.sparkContext.broadcast(Part([r.item for r in known], [r.text for r in known], window))
    return rows.mapInArrow(lambda batches: search(batches, part.value), schema)


def search(batches: Iterator[pa.RecordBatch], part: Part) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        w = Words(batch.column(1), LETTERS_DIGITS)
        hit, text, item = part.found(w)
        names = np.array(part.ids, object)[item]
        cuts = np.searchsorted(text, np.arange(w.n + 1))
        items = [sorted({*names[a:b]}) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield with_marks(batch.columns[:2], w, hit, pa.array(items, pa.list_(pa.string())), batch.columns[2:], batch.schema.names[2:])


def with_marks(head: list[pa.Array], w: Words, hit: np.ndarray, items: pa.Array, rest: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    hits = binary_array(hit.astype(np.uint8), w.first - w.first[0])
    return pa.RecordBatch.from_arrays([*head, pa.array(w.counts), hits, items, *rest], ["doc_id", "text", "n_words", "hits", "items", *names])


def joined(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """doc_id, text, spans, items and the other columns of rows, for a benchmark of any size.

    spans: place * (window + 1) + size of each window of an item. Equal texts are searched as one.
    """

    def item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(batch.column(1), LETTERS_DIGITS)
            one = w.hashes()
            keys = [tagged(0, fingerprints(w, one, window)[0])]
            keys += [tagged(m, grams_at(one, start, m)) for m, start, _ in whole_windows(w, window) if m < window]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], ["key"])

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(batch.column(1), LETTERS_DIGITS)
            one, two = w.hashes(), w.hashes(TWO)
            for m, start, text in whole_windows(w, window):
                yield hashed(one, two, m, start, [batch.column(0).take(pa.array(text))], ["item"])

    known = saved(items.mapInArrow(item_windows, "size int, one long, two long, item string").distinct(), "item_windows")
    sieve = Sieve(items.mapInArrow(item_grams, "key long").distinct(), "key")
    short = sorted(r.size for r in known.where(F.col("size") < window).select(F.col("size")).distinct().collect())

    def text_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(batch.column(2), LETTERS_DIGITS)
            one, two = w.hashes(), None
            for m, start, text in near_windows(w, one, window, short, lambda m, hashes: sieve(tagged(m, hashes))):
                if len(start):
                    two = w.hashes(TWO) if two is None else two
                    at = pa.array((start - w.first[text]) * (window + 1) + m)
                    yield hashed(one, two, m, start, [*(c.take(pa.array(text)) for c in batch.columns[:2]), at], ["t1", "t2", "at"])

    t1, t2 = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    texts = rows.where("text is not null").select(t1.alias("t1"), t2.alias("t2"), "text")
    near = saved(texts.mapInArrow(text_windows, "size int, one long, two long, t1 long, t2 long, at long").distinct(), "near_windows")
    known = saved(known.join(near.select(*WINDOW).distinct(), WINDOW, "left_semi"), "occurring")
    near = near.withColumn("salt", F.pmod("t1", F.lit(SALTS)).cast("int"))
    spans = near.join(salted(known.select(*WINDOW).distinct()), [*WINDOW, "salt"]).groupBy("t1", "t2").agg(F.collect_list("at").alias("spans"))
    pairs = near.drop("at").distinct().join(salted(known), [*WINDOW, "salt"]).select("t1", "t2", "item").distinct()
    found = saved(spans.join(pairs.groupBy("t1", "t2").agg(F.sort_array(F.collect_list("item")).alias("items")), ["t1", "t2"]), "found")

    some, none = parted(rows, t1, found, "t1")
    some = some.withColumns({"__t1": t1, "__t2": t2, "__salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")}).alias("d")
    same = F.expr("d.__t1 = f.t1 and d.__t2 = f.t2 and d.__salt = f.salt")
    some = some.join(salted(found).alias("f"), same, "left")
    rest = [c for c in rows.columns if c not in ("doc_id", "text")]
    some = some.select("d.doc_id", "d.text", "f.spans", "f.items", *[F.col(f"d.`{c}`") for c in rest])
    empty = [F.lit(None).cast("array<long>").alias("spans"), F.lit(None).cast("array<string>").alias("items")]
    return some.union(none.select("doc_id", "text", *empty, *rest))


def salted(df: DataFrame) -> DataFrame:
    """df once for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def tagged(m: int, hashes: np.ndarray) -> np.ndarray:
    """Hashes of kept grams (m = 0) and of m-word items, told apart."""
    return paired(hashes, np.full(len(hashes), m, np.uint64)).view(np.int64)


def hashed(one: np.ndarray, two: np.ndarray, m: int, start: np.ndarray, more: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    hashes = [pa.array(grams_at(x, start, m).view(np.int64)) for x in (one, two)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(start), m, np.int32)), *hashes, *more], [*WINDOW, *names])


def flagged(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From the rows of joined(), those of marked()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(batch.column(1), LETTERS_DIGITS)
            spans, items = batch.column(2), batch.column(3)
            n = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at, size = flat // (window + 1) + np.repeat(w.first[:-1], n), flat % (window + 1)
            hit = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(hit, at, 1)
            np.add.at(hit, at + size, -1)
            items = pa.array([x or [] for x in items.to_pylist()], pa.list_(pa.string()))
            yield with_marks(batch.columns[:2], w, np.cumsum(hit)[:-1] > 0, items, batch.columns[4:], batch.schema.names[4:])

    return run


def digest(rows: DataFrame, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of what marked() returns."""
    n_items = F.size("items")
    n_hit = F.length(F.translate(F.col("hits").cast("string"), "\0", ""))
    return rows.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), n_items.cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= least_items).alias("contaminated"))


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_items: int = 2) -> DataFrame:
    """The rows of docs, all columns, that are free of the benchmark: those with windows of
    least_items items or more go, and those in which `window` words in a row are hit. What is as
    short as to occur by chance, single windows of shorter items, lets a document stay."""
    rows = marked(docs, benchmark, window, keep=True)
    span = F.contains("hits", F.lit(b"\x01" * window))
    return rows.where(~span & (F.size("items") < least_items)).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
