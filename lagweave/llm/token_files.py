"""Token ids in binary files: Simple-8b, 64-bit words of a selector and as many ids as fit.

A block holds the ids of successive documents. Its bytes, all little-endian:

    magic b"S8B1", uint32 documents, uint32 words, uint32 escapes,
    int64 doc_id of each document (a null is NULL_ID), uint32 ids of each document,
    uint32 offset of each document's first word, uint64 words, uint64 escaped values.

A word has its selector in the top 4 bits and FIELDS[selector] = (count, bits) ids below, the first
one lowest. The last selector is an escape: one id too wide for a word, whose value is the next of
the escaped values. A document begins a new word, so each can be decoded on its own, and all words of
one selector are decoded at once.

Blocks are rows of a Parquet table (shard, block, documents, tokens, start, data): any shared store
holds it, and writing it survives lost executors. Shards and blocks ascend with doc_id; `start`
counts the ids of a shard before the block.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagweave.llm.shared import WordStore, byte_class, encoded_words, slices, text_buffers, work_dir

MAGIC = b"S8B1"
#: Ids a word and bits of each id, by selector.
FIELDS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = len(FIELDS)
COUNTS = np.array([n for n, _ in FIELDS] + [1])
BITS = np.array([b for _, b in FIELDS] + [0])
NULL_ID = -(1 << 63)
BLOCK_BYTES = 1 << 20
SPARE = COUNTS.max()


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    high = np.zeros(len(ids), np.int64)
    if len(ids) and ids.max() >= 1 << 32:
        high = np.frexp((ids.astype(np.uint64) >> np.uint64(32)).astype(np.float64))[1]
    low = np.frexp((ids.astype(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, high + 32, low)


def packed(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escaped values, and the index of each document's first word. ends: of documents in ids.

    The best selector is found for every place at once: the one that takes most ids, all of which
    fit its field and none of which is another document's. Following the steps gives the words.
    """
    counts = np.diff(ends, prepend=0)
    starts = ends - counts
    # Each document is followed by zeros, so that a word may run past its end.
    padded = starts + SPARE * np.arange(len(ends))
    bits = np.zeros(len(ids) + SPARE * len(ends), np.uint8)
    place = np.repeat(padded - starts, counts) + np.arange(len(ids))
    bits[place] = bit_lengths(ids)
    choice, largest, span = np.full(len(bits), ESCAPE, np.uint8), bits, 1
    for s in range(ESCAPE - 1, -1, -1):  # from the fewest ids to the most
        count, width = FIELDS[s]
        ahead = largest[count - span :]
        largest = np.concatenate([np.maximum(largest[: len(ahead)], ahead), largest[len(ahead) :]])
        span = count
        choice[largest <= width] = s
    choice = choice[place]
    step = np.minimum(COUNTS[choice], np.repeat(ends, counts) - np.arange(len(ids)))
    n = len(ids)
    places, at, steps = [], 0, step.tolist()
    while at < n:
        places.append(at)
        at += steps[at]
    places = np.array(places, np.int64)
    selector = choice[places]
    words = selector.astype(np.uint64) << np.uint64(60)
    size = step[places]
    for s, (_, width) in enumerate(FIELDS):
        mine = np.flatnonzero(selector == s)
        for k in range(int(size[mine].max(initial=0))):
            mine = mine[size[mine] > k]
            words[mine] |= ids[places[mine] + k].astype(np.uint64) << np.uint64(k * width)
    return words, ids[places[selector == ESCAPE]].astype(np.uint64), np.searchsorted(places, starts)


def unpacked(words: np.ndarray, escapes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of all documents: all words of a selector are decoded at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    size = COUNTS[selector]
    last = np.append(first[1:], len(words)) - 1
    full = np.concatenate([[0], np.cumsum(size)])
    some = counts > 0
    size[last[some]] -= (full[last[some] + 1] - full[first[some]]) - counts[some]
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    for s, (_, width) in enumerate(FIELDS):
        mine = np.flatnonzero(selector == s)
        for k in range(int(size[mine].max(initial=0))):
            mine = mine[size[mine] > k]
            out[begin[mine] + k] = (words[mine] >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
    out[begin[selector == ESCAPE]] = escapes
    return out


def block_bytes(doc_ids: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> bytes:
    words, escapes, first = packed(ids, ends)
    head = np.array([len(ends), len(words), len(escapes)], "<u4").tobytes()
    parts = [doc_ids.astype("<i8"), np.diff(ends, prepend=0).astype("<u4"), first.astype("<u4"), words.astype("<u8"), escapes.astype("<u8")]
    return MAGIC + head + b"".join(x.tobytes() for x in parts)


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, counts and ids (flat) of a block."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b block")
    n, words, escapes = np.frombuffer(data, "<u4", 3, 4).tolist()
    parts, at = [], 16
    for kind, count in (("<i8", n), ("<u4", n), ("<u4", n), ("<u8", words), ("<u8", escapes)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    doc_ids, counts, first, words, escapes = parts
    return doc_ids, counts.astype(np.int64), unpacked(words, escapes, first.astype(np.int64), counts.astype(np.int64))


# --- tokenising ---

LETTER, DIGIT, BLANK, OTHER = 1, 2, 3, 4
#: Classes of bytes in the byte-level pre-tokeniser's pattern, 0 for those that go to the library:
#: of UTF-8 the leads of U+00C0 to U+024F and their trails count, of which two are no letters.
KINDS = np.zeros(256, np.uint8)
KINDS[[c for c in range(128) if chr(c).isalpha()]] = LETTER
KINDS[0x80:0xC0] = KINDS[0xC3:0xCA] = LETTER
KINDS[48:58] = DIGIT
KINDS[[9, 10, 13, 32]] = BLANK
KINDS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = OTHER
TRAIL = byte_class(lambda c: 0x80 <= c < 0xC0)
LIBRARY_BATCH = 20_000


def pre_tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the bytes where pre-tokens begin, and of the texts for which these hold.

    Runs of letters, of digits and of others take one space before them. Of a run of blanks before
    something else, the last one stands apart from the others.
    """
    kind = KINDS[data]
    n = len(data)
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    front = np.zeros(n + 1, bool)
    front[bounds[:-1]] = True
    begins |= front[:n]
    after = np.flatnonzero(begins & (kind != BLANK) & ~front[:n])
    after = after[kind[after - 1] == BLANK]
    begins[after - 1] = True
    begins[after[data[after - 1] == 32]] = False
    odd = kind == 0
    lead, trail = (data >= 0xC3), TRAIL[data]
    lone = trail.copy()
    lone[1:] &= ~lead[:-1]
    odd |= lone  # a trail of another lead
    sign = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    odd[sign] = True
    count = np.concatenate([[0], np.cumsum(odd)])
    return begins, count[bounds[1:]] == count[bounds[:-1]]


class Encoder:
    """A tokenizer of the tokenizers library that is asked once for each distinct pre-token.

    Byte-level BPE never joins pre-tokens, so their ids are put together. Texts with characters that
    pre_tokens() does not know, texts that hold the content of an added token, which the library
    takes out before it pre-tokenises, and tokenizers with other pre-tokenisers go to it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        pre = str(self.library.pre_tokenizer)
        self.splits = pre.startswith("ByteLevel(") and "add_prefix_space=False" in pre and "use_regex=True" in pre and self.library.normalizer is None
        self.store = WordStore(self.asked, 1_200_000)

    def asked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts as the library gives them, flat, and their numbers."""
        ids, sizes = [], []
        for at in range(0, len(texts), LIBRARY_BATCH):
            got = [e.ids for e in self.library.encode_batch_fast(texts[at : at + LIBRARY_BATCH], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), np.int32, int(sizes[-1].sum())))
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (none null), flat, and where each ends."""
        bounds, data = text_buffers(texts)
        begins, known = pre_tokens(data, bounds)
        known &= self.splits
        for content in self.added:
            known &= ~pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if known.all():
            return encoded_words(self.store, data, bounds, begins)
        odd = np.flatnonzero(~known)
        own = np.repeat(known, np.diff(bounds))
        ids, ends = encoded_words(self.store, data[own], np.concatenate([[0], np.cumsum(np.where(known, np.diff(bounds), 0))]), begins[own])
        got, sizes = self.asked([texts[i].as_py() for i in odd.tolist()])
        count = np.diff(ends, prepend=0)
        count[odd] = sizes
        out = np.zeros(int(count.sum()), np.int32)
        from_library = np.repeat(~known, count)
        out[from_library], out[~from_library] = got, ids
        return out, np.cumsum(count)


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


# --- files ---


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Writes the ids of all texts, each followed by end_id, below path in ascending doc_id order.

    A null text counts as empty. Null doc_ids come first; documents with one doc_id follow each
    other by a hash of their text. Repeated rows are written each. No rows: an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start = encoder_of(tokenizer_path), TaskContext.get().partitionId(), 0
        for block, batch in enumerate(slices(batches, "text", BLOCK_BYTES)):
            ids, ends = encoder.encode(batch.column(1).fill_null(""))
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
            data = block_bytes(batch.column(0).fill_null(NULL_ID).to_numpy(), ids, ends)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": [block], "documents": [len(ends)], "tokens": [len(ids)], "start": [start], "data": [data]})
            start += len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    rows = rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").select("doc_id", "text")
    rows.mapInArrow(run, "shard int, block long, documents long, tokens long, start long, data binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """A row per document of files that write_tokens wrote: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                doc_ids, counts, ids = read_block(data)
                ends = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                arrays = [pa.array(np.full(len(ends), shard, np.int32)), pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    blocks = spark.read.schema("shard int, block long, documents long, tokens long, start long, data binary").parquet(path)
    rows = blocks.select("shard", "start", "data").mapInArrow(run, "shard int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    totals = blocks.groupBy("shard").agg(F.sum("tokens").alias("tokens"))  # a row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    out = rows.join(base, "shard").withColumn("start", F.col("base") + F.col("inside"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """read_tokens, without ids, of files written to the shared folder."""
    path = work_dir(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, end_id, path)
    return read_tokens(docs.sparkSession, path, with_ids=False)
