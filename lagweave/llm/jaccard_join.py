"""N-gram Jaccard join: size-aware, light sets by enumerated subsets, heavy sets by inverted lists.

Sets are the distinct word n-grams of a text. Two sets A, B with Jaccard similarity of at least p %
have sizes s <= t <= 100 s / p, and share a subset of ceil(p (s + t) / (100 + p)) items.

* Light sets (size up to a boundary): every subset of each size that such an overlap can have is
  enumerated and hashed; similar sets share one of these keys.
* Heavy sets: inverted lists of items are scanned. In one order of all items, similar sets share one
  of their first s - ceil(p s / 100) + 1 items, so only these enter lists. The order puts frequent
  items last, which keeps the lists short: a passage that many documents share is scanned only for
  sets that hold little else. Lists are cut by levels of sizes.
* The boundary is chosen by cost: the largest size up to which the subset keys of a set cost no more
  than its list entries, each of which counts SCAN_COST times. Sets near it are entered in both.

Any order gives the same result; its cost alone rests on which items count as frequent. These are
counted over all texts, and a bitmap of bounded size keeps them. Candidates are resolved exactly in
`similar.py`; equal sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm.shared import U64, Sieve, binary_array, list_array, mix, saved, set_hashes, shingle_sets, slices
from lagweave.llm.similar import resolve, sketches

SCAN_COST = 4
#: Items are frequent that OFTEN texts have; MOST of them are kept.
OFTEN, MOST = 48, 1 << 23
#: Items that a worker sums up at once, and bytes of text for each bucket of items.
HELD, BUCKET_BYTES = 1 << 19, 1 << 22


def smallest_partner(s: int, percent: int) -> int:
    return -(-percent * s // 100)


def subset_keys(s: int, percent: int) -> int:
    return sum(comb(s, k) for k in range(s - smallest_partner(s, percent) + 1))


def list_keys(s: int, percent: int) -> int:
    return s - smallest_partner(s, percent) + 1


@lru_cache(None)
def boundary(percent: int) -> int:
    return max(s for s in range(1, 65) if all(subset_keys(x, percent) <= SCAN_COST * list_keys(x, percent) for x in range(1, s + 1)))


def light(items: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the subsets of one small set."""
    s, mixed = len(items), mix(items)
    total, size = mixed.sum(keepdims=True), np.arange(s + 1, dtype=U64) * U64(0x632BE59BD9B4E019)
    out = []
    for k in range(s - smallest_partner(s, percent) + 1):
        gone = np.array(list(combinations(range(s), k)), int).reshape(comb(s, k), k)
        out.append(mix((total - mixed[gone].sum(1, dtype=U64)) + size[s - k : s - k + 1]))
    return np.concatenate(out)


def heavy(values: np.ndarray, offsets: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The items of each set that enter lists, and their owners. values ascend within a set; often:
    flags of frequent items, which come after all others."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rare = np.concatenate([[0], np.cumsum(~often)])
    before = rare[:-1] - rare[offsets[:-1]][owner]  # rare ones of the set before each place
    inside = np.arange(len(values)) - offsets[:-1][owner]
    rank = np.where(often, (rare[offsets[1:]] - rare[offsets[:-1]])[owner] + inside - before, before)
    kept = rank < (sizes + (-percent * sizes // 100) + 1)[owner]
    return mix(values[kept] ^ U64(0x9FB21C651E98DF25)), owner[kept]


def set_keys(values: np.ndarray, offsets: np.ndarray, percent: int, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate keys of all sets, flat, with offsets; values ascend within a set."""
    sizes = np.diff(offsets)
    edge = boundary(percent)
    high = 100 * sizes > percent * edge
    chosen = np.repeat(high, sizes)
    often = np.zeros(len(values), bool) if often is None else often
    k, o = heavy(values[chosen], np.concatenate([[0], np.cumsum(sizes[high])]), often[chosen], percent)
    keys, owners = [k], [np.flatnonzero(high)[o]]
    for i in np.flatnonzero((sizes > 0) & (sizes <= edge)):
        x = light(values[offsets[i] : offsets[i + 1]], percent)
        keys.append(x)
        owners.append(np.full(len(x), i))
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order], np.searchsorted(owners[order], np.arange(len(sizes) + 1))


def counted(rows: DataFrame, words: int) -> DataFrame:
    """A written table (item, n): items that OFTEN texts or more have, and how many have them.

    All texts are counted, one row of each; a sieve tells that row, which lets a few copies by besides.
    Workers sum up what they have read and deal it out by buckets, which grow in number with the texts.
    An item is known by its bucket and its lower 32 bits.
    """
    mark = F.xxhash64("doc_id", "text_hash")
    once = rows.select("text_hash", mark.alias("mark"), F.octet_length("text").cast("long").alias("size"))
    once = saved(once.groupBy("text_hash").agg(F.min("mark").alias("mark"), F.max("size").alias("size")), "once")
    sieve = Sieve(once, "mark")
    buckets = 1 << max(6, (once.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES).bit_length()

    def summed(sets: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(sets)
        values, n = np.unique((values >> U64(32) & U64(buckets - 1)) << U64(32) | values & U64(0xFFFFFFFF), return_counts=True)
        number, first = np.unique(values >> U64(32), return_index=True)
        at = np.append(first, len(values)) * 4
        return pa.RecordBatch.from_arrays([pa.array(number.view(np.int64)), binary_array(values.astype(np.uint32), at), binary_array(n.astype(np.uint32), at)], ["bucket", "items", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(iter([batch.filter(pa.array(sieve(batch.column(0).to_numpy())))])):
                held.append(shingle_sets(part.column(1), words)[0])
                if sum(map(len, held)) >= HELD:
                    yield summed(held)
                    held = []
        if held:
            yield summed(held)

    def total(part: pa.Table) -> pa.Table:
        items, n = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32) for c in (1, 2))
        order = np.argsort(items)
        items = items[order]
        first = np.flatnonzero(np.append(True, items[1:] != items[:-1]))
        n = np.add.reduceat(n[order].astype(np.int64), first)
        often = n >= OFTEN
        return pa.table({"item": items[first[often]].astype(np.int64) | part.column(0)[0].as_py() << 32, "n": n[often]})

    parts = rows.select(mark.alias("mark"), "text").mapInArrow(run, "bucket long, items binary, counts binary")
    return saved(parts.groupBy("bucket").applyInArrow(total, "item long, n long"), "frequent")


def frequent(rows: DataFrame, words: int) -> Sieve:
    """A sieve of frequent items; of more than MOST, those that most texts have."""
    items, least = counted(rows, words), OFTEN
    while items.where(F.col("n") >= least).count() > MOST:
        least *= 2
    return Sieve(items.where(F.col("n") >= least), "item")


def keyed(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """A written table with a row per document: doc_id, text_hash, n, node (0: empty set), keys, sketch."""
    sieve = frequent(rows, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, offsets, _ = shingle_sets(batch.column(2), words)
            keys, places = set_keys(values, offsets, percent, sieve(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(set_hashes(values, offsets)), list_array(keys.view(np.int64), places, pa.int64()), sketches(values, offsets)],
                ["doc_id", "text_hash", "n", "node", "keys", "sketch"])

    return saved(rows.mapInArrow(run, "doc_id long, text_hash long, n long, node long, keys array<long>, sketch binary"), "keyed")


@lru_cache(4)
def sizes_from(percent: int, upto: int) -> np.ndarray:
    """Smallest sizes of levels: similar sets are of one level or of two that follow each other."""
    out = [1]
    while out[-1] <= upto:
        out.append(100 * out[-1] // percent + 1)
    return np.array(out)


def listed(table: DataFrame, percent: int) -> DataFrame:
    """A written table (key, node), distinct: lists of two nodes or more that share a key and are of two
    successive levels of sizes. table: node, n (size), keys (array)."""
    rows = table.select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    sieve = Sieve(saved(shared, "shared"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = np.unique(batch.column(0).to_numpy(), return_index=True)[1]
            batch = batch.take(pa.array(one))
            size, keys = pc.list_value_length(batch.column(2)).to_numpy(), batch.column(2).flatten().to_numpy()
            kept, owner = sieve(keys), np.repeat(np.arange(len(one)), size)
            keys, owner, n = keys[kept].view(U64), owner[kept], batch.column(1).to_numpy()
            level = np.searchsorted(sizes_from(percent, 1 << int(n.max()).bit_length()), n, "right")[owner].astype(U64) if len(n) else np.zeros(0, U64)
            both = np.concatenate([mix(keys + (level + U64(i)) * U64(0xA0761D6478BD642F)) for i in range(2)])
            yield pa.RecordBatch.from_pydict({"key": both.view(np.int64), "node": np.tile(batch.column(0).to_numpy()[owner], 2)})

    near = saved(table.select("node", "n", "keys").mapInArrow(run, "key long, node long"), "near")
    shared = near.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    return saved(near.join(shared, "key").distinct(), "lists")


def sets_of(rows: DataFrame, table: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """A written table (node, items) of the wanted nodes, from one text of each, read again."""
    mark = F.xxhash64("doc_id", "text_hash")
    chosen = saved(table.select("node", mark.alias("mark")).join(wanted, "node").groupBy("node").agg(F.min("mark").alias("mark")), "chosen")
    sieve = Sieve(chosen, "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(sieve(batch.column(0).to_numpy())))
            for part in slices(iter([batch])):
                values, offsets, _ = shingle_sets(part.column(1), words)
                yield pa.RecordBatch.from_arrays([pa.array(set_hashes(values, offsets)), binary_array(values, offsets * 8)], ["node", "items"])

    found = rows.select(mark.alias("mark"), "text").mapInArrow(run, "node long, items binary")
    return saved(found.join(wanted, "node").groupBy("node").agg(F.first("items").alias("items")), "sets")


def joined(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """Joins documents whose sets of word n-grams have a Jaccard similarity of percent or more.

    Returns a row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by
    links, its own included), text_hash, class_id (equal sets have equal classes), group_id (equal
    in a component). A null text counts as empty; empty sets link with nothing and keep their own
    doc_id. Texts with fewer words than a shingle have one shingle; texts of any length are read
    whole. Rows with a null doc_id take part and are never a component's id; a component of such
    rows only has a null id. Repeated rows are alike. No rows give no rows. Other columns of docs are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    table = keyed(rows, words, percent)
    some = table.where("n > 0")
    lists = listed(some, percent)
    known = some.join(lists.select("node").distinct(), "node").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    groups = resolve(lists, saved(known, "sketches"), lambda wanted: sets_of(rows, some, wanted, words), percent)
    told = some.drop("keys", "sketch").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # A written table, so that rows of a large component can be dealt to several tasks.
    lowest = saved(told.groupBy("component").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "lowest")
    told = told.join(lowest, "component", "left").select("doc_id", "n", F.coalesce("lowest", "doc_id").alias("lowest"), "text_hash", "node", "component")
    alone = table.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("lowest"), "text_hash", "node", F.col("node").alias("component"))
    return told.union(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("lowest").alias("component_id"), "text_hash", F.col("node").alias("class_id"), F.col("component").alias("group_id"))
