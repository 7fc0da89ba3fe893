"""Substring deduplication: paragraph MinHash banding, verified, clustered, and cut.

A text is cut into paragraphs: lines of `least` words or more, and blocks, which are runs of shorter
lines up to a blank or a longer line, so that wrapped passages count too. Paragraphs get MinHash
signatures over their word shingles, in bands tuned for high recall; colliding ones are joined, the
exact Jaccard similarity verified, and similar paragraphs clustered by components. Of each cluster
the first document that has it (by doc_id) keeps it; other documents lose it.

What keeps to no bounds is found by word windows: of each window of a text's k-word grams the
smallest hash is a fingerprint, so that two texts with `least` words in a row in common share one. A
shared fingerprint belongs to the first document that has it. In the others its words go, and with
them the words around that equal those around it in the first one, which extends a hit word by word
to the passage's ends. In scripts without spaces each character is a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.llm.jaccard_join import listed
from lagweave.llm.shared import MASK, NOT_SPACE, U64, Sieve, Words, binary_array, distinct_per_text, gram_hashes, list_array, mix, named, parted, range_hashes, saved, slices, swept
from lagweave.llm.similar import resolve, sketches

ROWS, GAP = 3, 10


def bands(percent: int, recall: float = 0.9995, rows: int = ROWS) -> int:
    """The fewest bands of that many rows by which a pair of that similarity collides with the recall."""
    return ceil(log(1 - recall) / log(1 - (percent / 100) ** rows))


class Pieces:
    """Words and paragraphs (lines and blocks of lines, as ranges of words) of a run of texts."""

    def __init__(self, texts: pa.Array, least: int):
        self.w = w = Words(texts, NOT_SPACE)
        self.part_characters()
        n = len(w.starts)
        self.hash = w.hashes()
        newline = np.concatenate([[0], np.cumsum(w.data == 10)])
        line_end = np.ones(n, bool)
        line_end[:-1] = newline[w.starts[1:]] > newline[w.ends[:-1]]
        line_end[w.first[1:][w.counts > 0] - 1] = True
        block_end = line_end.copy()
        block_end[:-1] = newline[w.starts[1:]] > newline[w.ends[:-1]] + 1
        block_end[w.first[1:][w.counts > 0] - 1] = True
        begin, end = self.ranges(np.flatnonzero(line_end) + 1)
        alone = end - begin >= least
        block_end[end[alone] - 1] = True
        block_end[begin[alone & (begin > 0)] - 1] = True
        lines, blocks = (self.ranges(np.flatnonzero(x) + 1) for x in (line_end, block_end))
        several = ~np.isin(blocks[0] * (n + 1) + blocks[1], lines[0] * (n + 1) + lines[1])
        start, end = (np.concatenate([x, y[several]]) for x, y in zip(lines, blocks, strict=True))
        order = np.argsort(start, kind="stable")
        self.lines = start[order], end[order]

    def part_characters(self) -> None:
        """Makes each character of scripts without spaces a word (UTF-8 of three bytes)."""
        w = self.w
        lead = np.flatnonzero(w.data >= 0xE0)
        first, second = w.data[lead], w.data[np.minimum(lead + 1, len(w.data) - 1)]
        own = (first >= 0xE3) & (first <= 0xE9)  # kana, Chinese characters
        own |= (first == 0xE0) & (second >= 0xB8) & (second <= 0xBB)  # Thai, Lao
        own |= (first == 0xE1) & np.isin(second, (0x80, 0x81, 0x82, 0x9E, 0x9F))  # Burmese, Khmer
        if not own.any():
            return
        place = np.unique(np.concatenate([lead[own], lead[own] + 3]))
        word = np.searchsorted(w.starts, place, "right") - 1
        place = place[(place > w.starts[word]) & (place < w.ends[word])]
        w.starts, w.ends = np.sort(np.concatenate([w.starts, place])), np.sort(np.concatenate([w.ends, place]))
        w.first = np.searchsorted(w.starts, w.bounds)
        w.counts = np.diff(w.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, texts and hashes of all grams of k words."""
        n = np.maximum(self.w.counts - k + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        at = self.w.first[:-1][text] + np.arange(len(text)) - (np.cumsum(n) - n)[text]
        return at, text, gram_hashes(self.hash, k)[at]

    @staticmethod
    def fingerprints(text: np.ndarray, hashes: np.ndarray, window: int) -> np.ndarray:
        """Flags of the grams that are the smallest of a window of their text."""
        if len(text) < window:
            return np.zeros(len(text), bool)
        low = sliding(hashes, window, np.minimum)
        low[text[window - 1 :] != text[: len(low)]] = 0  # no window passes a text's end
        pad = np.zeros(window - 1, U64)
        return sliding(np.concatenate([pad, low, pad]), window, np.maximum) == hashes

    def contexts(self, at: np.ndarray, text: np.ndarray, k: int, reach: int) -> np.ndarray:
        """Marks of the `reach` words before (nearest first) and after grams of k words, 0 beyond a text's ends."""
        short = (self.hash >> U64(48)).astype(np.uint16) | np.uint16(1)
        step = np.arange(reach)
        place = np.concatenate([at[:, None] - 1 - step, at[:, None] + k + step], 1)
        inside = (place >= self.w.first[text][:, None]) & (place < self.w.first[text + 1][:, None])
        return np.where(inside, short[np.clip(place, 0, max(len(short) - 1, 0))] if len(short) else 0, 0).astype(np.uint16)

    @staticmethod
    def ranges(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]]), ends

    def nodes(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the paragraphs of at least so many words."""
        start, end = self.lines
        long = end - start >= least
        return start[long], end[long], range_hashes(self.hash, start[long], end[long]).view(np.int64)

    def sets(self, start: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct k-word shingles of ranges of k words or more, flat, with offsets."""
        n = end - start - k + 1
        who = np.repeat(np.arange(len(n)), n)
        at = start[who] + np.arange(int(n.sum())) - (np.cumsum(n) - n)[who]
        return distinct_per_text(gram_hashes(self.hash, k)[at], who, len(n))


def sliding(x: np.ndarray, window: int, f: np.ufunc) -> np.ndarray:
    """f over each window of x."""
    span = 1
    while 2 * span <= window:
        x, span = f(x[:-span], x[span:]), 2 * span
    rest = window - span
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def min_hashes(values: np.ndarray, offsets: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """Band keys of non-empty sets: an array of sets x bands."""
    out = np.zeros((len(offsets) - 1, n_bands), U64)
    if not len(values):
        return out
    high = values >> U64(32)
    for band in range(n_bands):
        key = np.full(len(offsets) - 1, band + 1, U64)
        for row in range(rows):
            i = 2 * (band * rows + row) + 1
            h = (values + high * U64(i)) * U64(i * 0x9E3779B97F4A7C15 & MASK) ^ (values >> U64(29))
            key = mix(key * U64(0xA24BAED4963EE407) + np.minimum.reduceat(h, offsets[:-1]))
        out[:, band] = key
    return out


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80, least: int = 30) -> DataFrame:
    """All rows and columns of docs (doc_id, text among them) with text cut, and n_removed (words).

    Runs of `least` words or more that are to go are cut; up to GAP words between two repeated pieces
    go with them, as what an edit changed. A document never loses what it repeats within itself. Rows
    with the same doc_id and text count as one document and are cut alike, so whole copies under
    another doc_id lose all pieces that take part. Where nothing is cut, the text stays as it is, a
    null too; elsewhere the pieces kept keep their white space. Null doc_ids come last in the order of
    keepers. Texts of any length are read whole; no rows give no rows. A column of docs that is named
    n_removed gives way to the new one; other names are free, dots included.
    """
    n_bands = bands(percent)
    k = (least + 1) // 2
    window = least - k + 1

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = Pieces(batch.column(2), max(least, shingle))
            begin, end, lines = p.nodes(max(least, shingle))
            places = np.searchsorted(begin, p.w.first)
            values, offsets = p.sets(begin, end, shingle)
            keys = min_hashes(values, offsets, n_bands, ROWS).view(np.int64)
            _, text, grams = p.grams(k)
            some = p.fingerprints(text, grams, window)
            prints, ranges = distinct_per_text(grams[some], text[some], p.w.n)
            bits = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), sketches(values, offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), list_array(lines, places, pa.int64()), list_array(keys.ravel(), places * n_bands, pa.int64()),
                 list_array(np.diff(offsets), places, pa.int64()), bits, list_array(prints.view(np.int64), ranges, pa.int64())],
                ["doc_id", "text_hash", "lines", "keys", "sizes", "sketches", "prints"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    table = saved(rows.mapInArrow(units, "doc_id long, text_hash long, lines array<long>, keys array<long>, sizes array<long>, sketches array<binary>, prints array<long>"), "units")
    # Clusters of paragraphs, and which document keeps each that two documents have.
    line = lambda *more: table.select("doc_id", "text_hash", F.explode(F.transform("lines", lambda x, i: F.struct(x.alias("node"), *[f(i).alias(c) for c, f in more]))).alias("x"))
    keyed = line(("n", lambda i: F.get("sizes", i)), ("keys", lambda i: F.slice("keys", i * n_bands + 1, n_bands))).select("x.*")
    lists = listed(keyed, percent)
    parts = line(("n", lambda i: F.get("sizes", i)), ("sketch", lambda i: F.get("sketches", i))).select("x.*")
    known = saved(parts.join(lists.select("node").distinct(), "node").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    homes = line().select("x.node", mark().alias("mark"))
    groups = resolve(lists, known, lambda wanted: paragraph_sets(rows, homes, wanted, shingle, max(least, shingle)), percent)
    document = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    lines = line().select(document.alias("d"), "x.node").join(groups, "node", "left").select("d", "node", F.coalesce("component", "node").alias("class"))
    # Keepers are written tables, so that rows of a frequent class can be dealt to several tasks.
    lost = lines.join(saved(keepers(lines.select("d", "class")), "keepers"), "class").where("d <> keeper").select("d", "node", F.lit(None).cast("binary").alias("around"))
    # Fingerprints of verbatim passages, likewise.
    swept(docs.sparkSession)
    prints = table.select(mark().alias("who"), F.explode("prints").alias("class"))
    prints = prints.groupBy("class").agg(F.min("who").alias("lo"), F.max("who").alias("hi")).where("lo < hi").select("class")
    found = saved(shared_prints(rows, saved(prints, "prints"), k, window), "passages").select(document.alias("d"), "class", "around")
    first = saved(keepers(found.select("d", "class", "around"), "around"), "keepers")
    lost = lost.union(found.select("d", "class").join(first, "class").where("d <> keeper").select("d", F.col("class").alias("node"), "around"))
    lost = lost.groupBy("d").agg(F.collect_list(F.struct("node", "around")).alias("pieces")).select("d.doc_id", "d.text_hash", "pieces")
    return cut(docs, saved(lost.withColumn("mark", mark()), "lost"), least)


def mark() -> Column:
    """A hash of a document, as two documents' rows are told apart."""
    return F.xxhash64("doc_id", "text_hash")


def keepers(rows: DataFrame, *more: str) -> DataFrame:
    """(class, keeper, more of the keeper) of the classes that two documents have; keeper is the first of these."""
    first = rows.groupBy("class").agg(F.min(F.struct("d", *more)).alias("keeper"), F.max("d").alias("other"))
    return first.where("keeper.d <> other").select("class", F.col("keeper.d").alias("keeper"), *[f"keeper.{c}" for c in more])


def shared_prints(rows: DataFrame, shared: DataFrame, k: int, window: int) -> DataFrame:
    """(doc_id, text_hash, class, around): each text's shared fingerprints, with the words around the first of each."""
    sieve = Sieve(shared, "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = Pieces(batch.column(2), k)
            at, text, grams = p.grams(k)
            hit = np.flatnonzero(p.fingerprints(text, grams, window))
            hit = hit[sieve(grams[hit].view(np.int64))]
            hit = hit[np.unique(np.stack([text[hit].astype(np.int64), grams[hit].view(np.int64)], 1), axis=0, return_index=True)[1]]
            around = p.contexts(at[hit], text[hit], k, window - 1)
            who = pa.array(text[hit])
            width = around.shape[1] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(who), batch.column(1).take(who), pa.array(grams[hit].view(np.int64)), binary_array(around.view(np.uint8).ravel(), np.arange(len(hit) + 1) * width)],
                ["doc_id", "text_hash", "class", "around"])

    found = rows.mapInArrow(run, "doc_id long, text_hash long, class long, around binary")
    return found.join(shared, "class", "left_semi").select("doc_id", "text_hash", "class", "around")


def paragraph_sets(rows: DataFrame, homes: DataFrame, wanted: DataFrame, shingle: int, least: int) -> DataFrame:
    """A written table (node, items) of the wanted paragraphs, from one text that has each, read again."""
    chosen = saved(homes.join(wanted, "node").groupBy("node").agg(F.min("mark").alias("mark")), "chosen")
    texts, nodes = Sieve(chosen.select("mark").distinct(), "mark"), Sieve(chosen, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(texts(batch.column(0).to_numpy())))
            for part in slices(iter([batch])):
                p = Pieces(part.column(1), least)
                start, end, node = p.nodes(least)
                _, first = np.unique(node, return_index=True)
                first = first[nodes(node[first])]
                values, offsets = p.sets(start[first], end[first], shingle)
                yield pa.RecordBatch.from_arrays([pa.array(node[first]), binary_array(values, offsets * 8)], ["node", "items"])

    found = rows.select(mark().alias("mark"), "text").mapInArrow(run, "node long, items binary")
    return saved(found.join(wanted, "node").groupBy("node").agg(F.first("items").alias("items")), "sets")


def cut(docs: DataFrame, lost: DataFrame, least: int) -> DataFrame:
    """docs without the lost pieces. lost: doc_id, text_hash, pieces (node, around), mark.

    Only documents that lose something are joined; a sieve lets the others by.
    """
    names = [c for c in docs.columns if c.lower() != "n_removed"]
    docs = docs.select(*[named(c).cast("string").alias(c) if c == "text" else named(c) for c in names])
    maybe, rest = parted(docs, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")), lost, "mark")
    kinds = [f.dataType.simpleString() for f in docs.schema]
    at = names.index("text")

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"__{at}"):
            texts, removed = trimmed(batch.column(at + 1), batch.column(0), least)
            arrays = [*batch.columns[1:], pa.array(removed, pa.int64())]
            arrays[at] = texts
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[1:], "n_removed"])

    id_, text = (F.col(f"__{names.index(c)}") for c in ("doc_id", "text"))
    maybe = maybe.select(*[named(c).alias(f"__{i}") for i, c in enumerate(names)]).withColumns({"__id": id_.cast("long"), "__hash": F.xxhash64(text)})
    hit = maybe.join(lost.select(F.col("doc_id").alias("__l"), F.col("text_hash").alias("__h"), F.col("pieces").alias("__pieces")), F.expr("__hash = __h and __id <=> __l"), "left")
    schema = ", ".join([f"__{i} {kind}" for i, kind in enumerate(kinds)] + ["n_removed long"])
    hit = hit.select("__pieces", *[f"__{i}" for i in range(len(names))]).mapInArrow(trim, schema)
    return rest.withColumn("n_removed", F.lit(0).cast("long")).union(hit)


def trimmed(texts: pa.Array, pieces: pa.Array, least: int) -> tuple[pa.Array, list[int]]:
    """The texts without their lost pieces (lists of node and around, or null), and the words cut from each."""
    p = Pieces(texts, least)
    w, n = p.w, len(p.w.starts)
    owner = np.repeat(np.arange(w.n), w.counts)
    k = (least + 1) // 2
    reach = least - k
    given = pieces.flatten()
    mine = np.repeat(np.arange(w.n), pc.fill_null(pc.list_value_length(pieces), 0).to_numpy())
    node, around = given.field(0).to_numpy(), given.field(1)
    keyed = lambda t, x: mix(x.view(U64) ^ mix(t.astype(U64)))
    known = keyed(mine, np.ascontiguousarray(node))
    print_ = pc.is_valid(around).to_numpy(zero_copy_only=False)
    flag = np.zeros(n + 1, np.int64)

    def flagged(start: np.ndarray, end: np.ndarray) -> None:
        np.add.at(flag, start, 1)
        np.add.at(flag, end, -1)

    start, end, node = p.nodes(least)
    lost = np.isin(keyed(owner[start], node), known[~print_])
    flagged(start[lost], end[lost])
    at, text, grams = p.grams(k)
    hit = np.flatnonzero(p.fingerprints(text, grams, reach + 1))
    key, order = keyed(text[hit], grams[hit]), np.argsort(known[print_], kind="stable")
    sorted_ = known[print_][order]
    place = np.searchsorted(sorted_, key)
    some = place < len(sorted_)
    some[some] = sorted_[place[some]] == key[some]
    if some.any():
        hit, place = hit[some], order[place[some]]
        theirs = np.frombuffer(b"".join(around.drop_null().to_pylist()), np.uint16).reshape(-1, 2 * reach)[place]
        own = p.contexts(at[hit], text[hit], k, reach)
        same = ((own == theirs) & (own > 0)).reshape(-1, 2, reach)
        grow = np.logical_and.accumulate(same, axis=2).sum(2)
        flagged(at[hit] - grow[:, 0], at[hit] + k + grow[:, 1])
    flag = np.cumsum(flag)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    runs: list[list[int]] = []
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        cuts = [s, *w.first[np.searchsorted(w.first, s, "right") : np.searchsorted(w.first, e)].tolist(), e]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if runs and a - runs[-1][1] <= GAP and owner[a] == owner[runs[-1][0]]:
                runs[-1][1] = b
            elif a < b:
                runs.append([a, b])
    runs = [r for r in runs if r[1] - r[0] >= least]
    removed, out = [0] * w.n, [None] * w.n
    drop: dict[int, list[tuple[int, int]]] = {}
    for a, b in runs:
        t = int(owner[a])
        removed[t] += b - a
        drop.setdefault(t, []).append((a, b))
    for t in range(w.n):
        if t not in drop:
            out[t] = texts[t].as_py()
            continue
        at, parts = int(w.bounds[t]), []
        for a, b in drop[t]:
            parts.append(w.raw[at : w.starts[a]].tobytes())
            at = int(w.starts[b]) if b < w.first[t + 1] else int(w.bounds[t + 1]) - 1
        parts.append(w.raw[at : w.bounds[t + 1] - 1].tobytes())
        out[t] = b"".join(parts).decode()
    return pa.array(out, pa.string()), removed
