"""What the operators of this subpackage share: work folders, byte-level word splitting, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK_BYTES, ARROW_BYTES = 1 << 18, "4m"
#: New words that a store has encoded at once.
ENCODED = 1 << 14


# --- folders every executor can reach -------------------------------------------------------


def bounded(spark: SparkSession) -> None:
    """Batches to and from workers are bounded by bytes, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, ARROW_BYTES)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a local one is set only where that is unset and
    Spark runs on this machine alone (tests)."""
    bounded(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lagweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Has executors collect their garbage: a heap that a step has filled shrinks before the next one,
    and buffers outside the heap go. Where reflection is forbidden, all stays as it is."""
    n = spark.sparkContext.defaultParallelism
    with suppress(PySparkException):
        spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


# --- hashing --------------------------------------------------------------------------------

GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (the public splitmix64 constants)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Places:
    """Growing table of one pseudo-random number for each place in a sequence."""

    def __init__(self, seed: int):
        self.seed, self.table = seed, np.zeros(0, U64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            self.table = mix(np.arange(1, max(n, 2 * len(self.table)) + 1, dtype=U64) * U64(GOLDEN) + U64(self.seed))
        return self.table


#: Two families of hashes that are independent of each other.
ONE, TWO = Places(0), Places(0xD6E8FEB86659FD93)


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices begin[i], begin[i] + 1, ... of all ranges."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(begin - (np.cumsum(size) - size), size)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: Places = ONE, lengths: np.ndarray | None = None) -> np.ndarray:
    """Order-sensitive hash of values[s:e] for each range; depends on the content alone.

    Each value is mixed with its place before the sum, so no pattern of values cancels out.
    lengths: told apart besides the content; by default the numbers of values.
    """
    size = ends - starts
    out, some = np.zeros(len(starts), U64), size > 0
    if some.any():
        at = ragged(np.zeros_like(size), size)
        terms = mix(values[at + np.repeat(starts, size)].astype(U64) ^ places.upto(int(size.max()))[at])
        out[some] = np.add.reduceat(terms, (np.cumsum(size) - size)[some])
    return mix(out + (size if lengths is None else lengths).astype(U64) * U64(0x2545F4914F6CDD1D))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of all k successive values along the last axis, by repeated doubling."""
    if values.shape[-1] < k:
        return np.zeros((*values.shape[:-1], 0), U64)
    out, span = values, 1
    for bit in bin(k)[3:]:
        out, span = paired(out[..., : out.shape[-1] - span], out[..., span:]), 2 * span
        if bit == "1":
            out, span = paired(out[..., :-1], values[..., span:]), span + 1
    return out


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(GOLDEN) + b * U64(0xC2B2AE3D27D4EB4F))


def grams_at(values: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """gram_hashes at some places only."""
    return gram_hashes(values[starts[:, None] + np.arange(k)], k)[:, 0]


TAILS = np.array([MASK >> (64 - 8 * n) if n else 0 for n in range(9)], U64)


def byte_chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each range as 64-bit numbers of eight bytes, zeros behind the last, flat with offsets."""
    size = (ends - starts + 7) >> 3
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(starts, size) + 8 * ragged(np.zeros_like(size), size)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    return eight[at] & TAILS[np.minimum(np.repeat(ends, size) - at, 8)], first


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: Places = ONE) -> np.ndarray:
    """Hashes of ranges of bytes."""
    chunks, first = byte_chunks(data, starts, ends)
    return range_hashes(chunks, first[:-1], first[1:], places, ends - starts)


# --- words ----------------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(is_word: Callable[[int], bool]) -> np.ndarray:
    return np.array([is_word(i) for i in range(256)])


#: Classes are stated after lower-casing A-Z; bytes of non-ASCII characters always belong to words.
LETTERS_DIGITS = byte_class(lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)
NOT_SPACE = byte_class(lambda c: not (c == 32 or 9 <= c <= 13))


class Words:
    """The words of a run of texts, as flat arrays.

    starts, ends: byte places in data (lower-cased, one space between texts); first: for text i
    its words are first[i]:first[i+1]; bounds: byte place where text i begins, and one more.
    """

    def __init__(self, texts: pa.Array, word_bytes: np.ndarray):
        offsets, raw = text_buffers(texts)
        n = len(texts)
        self.n, self.bounds = n, offsets + np.arange(n + 1)
        data = np.full(len(raw) + n + 1, 32, np.uint8)
        keep = np.ones(len(data), bool)
        keep[self.bounds[1:] - 1] = False
        keep[-1] = False
        data[keep] = raw
        self.raw, self.data = data, LOWER[data]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = word_bytes[self.data]
        inside[1:][~keep] = 0
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.first)

    def hashes(self, places: Places = ONE) -> np.ndarray:
        return byte_hashes(self.data, self.starts, self.ends, places)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice holds about `size` bytes of the column, and one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets, _ = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    released()


def released() -> None:
    """Gives memory that a worker has freed back to the system, where its library can: an idle worker
    of a stage would hold it beside those of the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def windows(counts: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all k-word windows that stay in one text, and the windows' texts.

    A text of fewer words than k, but not none, has one window: the whole of it (see window_ends).
    """
    n = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    text = np.repeat(np.arange(len(counts)), n)
    begin = np.cumsum(n) - n
    return first[:-1][text] + np.arange(n.sum()) - begin[text], text


def distinct_per_text(values: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, flat, and the offsets of the texts. text ascends."""
    values = values.copy()
    cuts = np.searchsorted(text, np.arange(n + 1)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(n + 1))


def shingle_sets(texts: pa.Array, k: int, word_bytes: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, Words]:
    """Sorted distinct k-word shingle hashes of each text, flat, with offsets."""
    w = Words(texts, word_bytes)
    start, text = windows(w.counts, w.first, k)
    words = w.hashes()
    values, short = np.zeros(len(start), U64), w.counts[text] < k
    values[~short] = gram_hashes(words, k)[start[~short]]
    values[short] = range_hashes(words, start[short], w.first[1:][text[short]])
    return *distinct_per_text(values, text, w.n), w


def set_hashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signed 64-bit hash of each set, 0 for an empty one."""
    h = range_hashes(values, offsets[:-1], offsets[1:])
    h[offsets[:-1] == offsets[1:]] = 0
    return h.view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary array of data[offsets[i]:offsets[i+1]], offsets counted in bytes."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    ).cast(pa.binary())


# --- sieves -----------------------------------------------------------------------------------


class Sieve:
    """A bitmap of fixed size, of hashes of some keys: lets all these keys through, and few others.

    It keeps rows without a partner out of a shuffle, and has no say in any result: what passes is
    joined. Its bits grow with the keys up to a bound (16 MB); beyond it more rows pass.
    """

    LEAST, MOST = 15, 27

    def __init__(self, keys: DataFrame, column: str):
        n = keys.count()
        self.bits = min(self.MOST, max(self.LEAST, int(16 * n + 1).bit_length()))
        slot = F.pmod(F.col(column), F.lit(1 << self.bits)) + 1  # buckets count from 1
        rows = keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()
        table = np.zeros(1 << (self.bits - 3), np.uint8)
        for b, m in rows:  # 4 KB each, at most 2**12 of them
            table[(b - 1) * 4096 : b * 4096] = np.frombuffer(bytes(m), np.uint8)
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.astype(np.int64) & ((1 << self.bits) - 1)
        return (self.table.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def named(name: str) -> Column:
    """The column of exactly that name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def parted(docs: DataFrame, mark: Column, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """docs in two: rows whose mark (a hash) may be among the keys, and rows whose mark is not."""
    sieve = Sieve(keys, column)
    marked = docs.select(mark.alias("__mark"), *[named(c).alias(f"__{i}") for i, c in enumerate(docs.columns)])
    schema = ", ".join(f"__{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.filter(pa.array(sieve(batch.column(0).to_numpy()) == wanted))
                yield pa.RecordBatch.from_arrays(rows.columns[1:], rows.schema.names[1:])

        return marked.mapInArrow(run, schema).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])

    return part(True), part(False)


# --- components -----------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (a, b) reaches.

    Alternates the large-star and the small-star step, both as minimum aggregates and joins, so no
    neighbourhood is ever gathered; each round is a written table. Rounds grow with the logarithm
    of the longest path. Empty edges give an empty result; null ends and loops are ignored.
    """
    e = saved(edges.where("a is not null and b is not null and a <> b")
              .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        deep = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
        if deep.isEmpty():  # every edge leads to the centre of a star
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = saved(small.where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b"), F.col("b")).distinct())


# --- results kept by word -------------------------------------------------------------------


class WordStore:
    """Ids of words, found by the words' 64-bit hashes in flat open-addressing arrays.

    A word found is compared byte by byte; one that only has the hash of another goes on to a hash of
    that hash. encode: gives the ids of new words, flat, and their numbers. Emptied when it holds
    `most` words or as many times four chunks of eight bytes, so memory is bounded; what it returns
    does not depend on what it holds.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.bits = 16
        self.keys, self.values = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -1, np.int32)
        self.words, self.used, self.flat = 0, 0, np.zeros(1 << 18, np.int32)
        self.ends, self.sizes = np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int64)
        self.chunk_ends, self.chunks = np.zeros(1 << 17, np.int64), np.zeros(1 << 18, U64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U64(GOLDEN) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot, mask = self.slots(keys), (1 << self.bits) - 1
        out = self.values[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & mask
            got = self.values[slot]
            out[todo] = got
            other = (got >= 0) & (self.keys[slot] != keys[todo])
            todo, slot = todo[other], slot[other]
        return out

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot, mask = self.slots(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.values[slot] < 0
            self.values[slot[free]] = values[free]  # of several for one slot, the last stays
            won = free & (self.values[slot] == values)
            self.keys[slot[won]] = keys[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & mask

    def begins(self, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(place > 0, ends[place - 1], 0)

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tidy: Callable[[str], str] = str) -> np.ndarray:
        """Numbers of the words (ranges of bytes, none empty) in the store."""
        chunks, first = byte_chunks(data, starts, ends)
        size, count = ends - starts, np.diff(first)
        keys = range_hashes(chunks, first[:-1], first[1:], ONE, size)
        place, todo = np.zeros(len(starts), np.int32), np.arange(len(starts))
        while len(todo):
            at = self.find(keys[todo])
            missing = todo[at < 0]
            if len(missing):
                new, one = np.unique(keys[missing], return_index=True)
                one = missing[one]
                full = self.words + len(new) > self.most or len(self.chunks) > 4 * self.most
                if full and self.words and len(todo) == len(place):
                    self.clear()
                    continue
                self.add(new, size[one], count[one], chunks[ragged(first[one], count[one])], [tidy(w) for w in spelled(data, starts[one], ends[one])])
                at = self.find(keys[todo])
            same = self.sizes[at] == size[todo]
            some = np.flatnonzero(same)
            if len(some):
                n = count[todo[some]]
                equal = chunks[ragged(first[todo[some]], n)] == self.chunks[ragged(self.begins(self.chunk_ends, at[some]), n)]
                same[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
            place[todo[same]] = at[same]
            todo = todo[~same]
            keys[todo] = mix(keys[todo] + U64(1))
        return place

    def add(self, keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray, chunks: np.ndarray, words: list[str]) -> None:
        """New words: their keys, sizes in bytes, numbers of chunks, and chunks."""
        parts = [self.encode(words[at : at + ENCODED]) for at in range(0, len(words), ENCODED)]
        ids, ids_each = (np.concatenate(x) for x in zip(*parts, strict=True))
        n, m, c = self.words + len(keys), self.used + len(ids), int(self.chunk_ends[self.words - 1]) if self.words else 0
        self.ends, self.sizes, self.chunk_ends = (grown(x, n) for x in (self.ends, self.sizes, self.chunk_ends))
        self.flat, self.chunks = grown(self.flat, m), grown(self.chunks, c + len(chunks))
        self.ends[self.words : n] = self.used + np.cumsum(ids_each)
        self.flat[self.used : m] = ids
        self.sizes[self.words : n] = sizes
        self.chunk_ends[self.words : n] = c + np.cumsum(counts)
        self.chunks[c : c + len(chunks)] = chunks
        if 2 * n > len(self.keys):
            old = self.values >= 0
            keys_, values_ = self.keys[old], self.values[old]
            self.bits = int(4 * n).bit_length()
            self.keys, self.values = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -1, np.int32)
            self.insert(keys_, values_)
        self.insert(keys, np.arange(self.words, n, dtype=np.int32))
        self.words, self.used = n, m

    def ids(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at the places, flat, and the number of each."""
        if not len(place):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        begin = self.begins(self.ends, place)
        size = self.ends[place] - begin
        return self.flat[ragged(begin, size)], size


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a longer copy by doubling, of n entries at least."""
    size = len(x)
    while size < n:
        size *= 2
    return x if size == len(x) else np.concatenate([x, np.zeros(size - len(x), x.dtype)])


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The strings at ranges of bytes."""
    size = ends - starts
    raw = data[ragged(starts, size)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).to_pylist()


def encoded_words(store: WordStore, data: np.ndarray, bounds: np.ndarray, begins: np.ndarray, tidy: Callable[[str], str] = str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts cut into words, flat, and where each text ends.

    data: bytes of all texts, text i from bounds[i] on; begins: flags of the bytes where words begin.
    """
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    ids, size = store.ids(store.places(data, starts, ends, tidy))
    return ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, bounds[1:])]
