"""Exact resolution of candidate lists: which sets in each list are at least as similar as asked for.

Lists hold (key, node): every pair of similar nodes shares at least one key. Nothing here emits all
pairs of a list as rows. First each list is a star around its smallest node; lists that this joins to
one component are done. In what is still open, the nodes outside a list's main component are compared
with all others, in blocks of bounded size, each pair of blocks in one task.

Whole sets are sent for few nodes only. Each node has a parity sketch: bit h(x) is flipped for each
item x, so two sketches differ in no more bits than the sets differ in items. Pairs whose sketches
differ in more bits than similar sets could are dropped before any set is read; all others are
compared item by item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm.shared import U64, binary_array, components, ragged, saved, swept

LEFT, RIGHT = 256, 1024
#: Pairs looked at once, and 64-bit words of their sketches.
PAIRS, PAIR_WORDS = 1 << 17, 1 << 19


def similar(both: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """percent: least similarity; the integers make the comparison exact."""
    return 100 * both >= percent * (a + b - both)


# --- sketches ---


def sketches(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Parity sketches of sets: a power of two of bits, as many as items at least."""
    n = np.diff(offsets)
    bits = np.left_shift(64, np.maximum(np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64) - 6, 0))
    begin = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(begin[:-1], n) + (values >> U64(11) & np.repeat(bits - 1, n).astype(U64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(begin[-1])) & 1
    return binary_array(np.packbits(odd.astype(np.uint8), bitorder="little"), begin >> 3)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the rows of a and b differ; the longer ones are folded."""
    while a.shape[-1] > b.shape[-1]:
        a = a[:, : a.shape[-1] // 2] ^ a[:, a.shape[-1] // 2 :]
    while b.shape[-1] > a.shape[-1]:
        b = b[:, : b.shape[-1] // 2] ^ b[:, b.shape[-1] // 2 :]
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def plausible(differ: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b whose sketches differ so may be similar."""
    return ((100 + percent) * differ <= (100 - percent) * (a + b)) & (percent * np.maximum(a, b) <= 100 * np.minimum(a, b))


def words_of(sketch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sketches as 64-bit words, flat, with where each begins and its number of words."""
    size = np.array([len(x) for x in sketch], np.int64) >> 3
    return np.frombuffer(b"".join(sketch), U64), np.cumsum(size) - size, size


def may_match(a: list[bytes], b: list[bytes], i: np.ndarray, j: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Flags of the pairs (a[i], b[j]) of sets of sizes na and nb whose sketches allow similarity."""
    (p, p_at, p_size), (q, q_at, q_size) = words_of(a), words_of(b)
    keep = percent * np.maximum(na, nb) <= 100 * np.minimum(na, nb)
    shape = p_size[i] << 32 | q_size[j]
    for s in np.unique(shape[keep]).tolist():
        wide, own = (s >> 32, s & 0xFFFFFFFF), np.flatnonzero(keep & (shape == s))
        for at in range(0, len(own), step := max(1, PAIR_WORDS // sum(wide))):
            x = own[at : at + step]
            bits = differing(p[p_at[i[x]][:, None] + np.arange(wide[0])], q[q_at[j[x]][:, None] + np.arange(wide[1])])
            keep[x] = plausible(bits, na[x], nb[x], percent)
    return keep


def plausible_pairs(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow similarity. known: node, n, sketch."""
    x, y = (known.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    both = pairs.join(y, "b").join(x, "a").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            at = np.arange(batch.num_rows)
            keep = may_match(batch.column(4).to_pylist(), batch.column(5).to_pylist(), at, at, na, nb, percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


# --- sets ---


def checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (node, items: sorted 64-bit hashes as bytes) are similar."""
    x = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                n = common(p, q)
                keep.append(bool(n) and bool(similar(n, len(p), len(q), percent)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def common(p: np.ndarray, q: np.ndarray) -> int:
    """Number of items that two ascending arrays share."""
    if len(p) < len(q):
        p, q = q, p
    return int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum()) if len(q) else 0


# --- lists ---


def open_lists(rows: DataFrame) -> DataFrame:
    """Rows (key, node, component) of the lists with several components, with main: whether the
    component is the list's main one, that of most of its nodes. Of lists of the same nodes one stays."""
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("content"))
    lists = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("m").alias("n"), F.sum("content").alias("content"), F.max(F.struct("m", "component")).alias("top"))
    lists = lists.where("parts > 1").groupBy("n", "content").agg(F.min(F.struct("key", "top.component")).alias("of")).select("of.key", F.col("of.component").alias("top"))
    return rows.join(lists, "key").select("key", "node", "component", (F.col("component") == F.col("top")).alias("main"))


def blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, node, component, main) once for each task (key, i, j) and side they take part in.

    Left are the nodes outside the main component, in blocks i of about LEFT; right are all, in
    blocks j of about RIGHT. A node's blocks follow from its hash.
    """
    count = rows.groupBy("key").agg(F.ceil(F.count_if(~F.col("main")) / LEFT).alias("lefts"), F.ceil(F.count("*") / RIGHT).alias("rights"))
    rows = rows.join(count.where("lefts > 0"), "key").withColumn("h", F.xxhash64("node"))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.where("not main").select("key", "node", "component", F.lit(True).alias("left"), F.pmod("h", "lefts").alias("i"), number("rights").alias("j"))
    right = rows.select("key", "node", "component", F.lit(False).alias("left"), number("lefts").alias("i"), F.pmod(F.shiftright("h", 20), "rights").alias("j"))
    return left.union(right)


def dealt(rows: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """The rows of blocks() with the columns of sets, in groups `task` of about `size` rows of whole blocks."""
    tasks = max(1, -(-rows.count() // size))
    return blocks(rows).join(sets, "node").withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks)))


def candidate_pairs(pdf: pd.DataFrame, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) in pdf of pairs of one block, of different components, whose sketches allow
    similarity; a bounded number of pairs is looked at once, by blocks in ascending order."""
    block = pd.MultiIndex.from_frame(pdf[["key", "i", "j"]]).factorize(sort=True)[0]
    side, part, n = (pdf[c].to_numpy() for c in ("left", "component", "n"))
    left, right = (np.flatnonzero(x)[np.argsort(block[x], kind="stable")] for x in (side, ~side))
    lo, hi = (np.searchsorted(block[right], block[left], s) for s in ("left", "right"))
    sketch, upto = pdf["sketch"].tolist(), np.cumsum(hi - lo)
    at = 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        a, b = np.repeat(left[at:end], (hi - lo)[at:end]), right[ragged(lo[at:end], (hi - lo)[at:end])]
        apart = part[a] != part[b]
        a, b = a[apart], b[apart]
        if len(a):
            keep = may_match(sketch, sketch, a, b, n[a], n[b], percent)
            yield a[keep], b[keep]
        at = end


def promising(rows: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(key, node), distinct: the nodes whose sketch allows a similar node of another component in their list."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(pdf), bool)
        for a, b in candidate_pairs(pdf, percent):
            hit[a] = hit[b] = True
        return pdf.loc[hit, ["key", "node"]].drop_duplicates()

    return dealt(rows, known, 8 * RIGHT).groupBy("task").applyInPandas(run, "key long, node long").distinct()


def compared(rows: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each list as all its similar pairs would.

    known: node, n, sketch, items. A pair that labels or links found before it join is not compared.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
        node, part, up, out = pdf["node"].tolist(), pdf["component"].tolist(), {}, []

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for a, b in candidate_pairs(pdf, percent):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                p, q = top(part[x]), top(part[y])
                if p != q and similar(common(items[x], items[y]), len(items[x]), len(items[y]), percent):
                    up[max(p, q)] = min(p, q)
                    out.append((node[x], node[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt(rows, known, 2 * RIGHT).groupBy("task").applyInPandas(run, "a long, b long")


def resolve(lists: DataFrame, known: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(node, component) of the nodes that a chain of similar pairs joins; others do not appear.

    lists: (key long, node long), distinct; known: (node, n items, sketch) of these nodes. Both
    written tables. sets_of: gives (node, items binary) of a written table (node) as a written table.
    """
    swept(lists.sparkSession)
    pivot = lists.groupBy("key").agg(F.min("node").alias("a"))
    pairs = lists.join(pivot, "key").where("node > a").select("a", F.col("node").alias("b")).distinct()
    pairs = saved(plausible_pairs(pairs, known, percent), "pairs")
    wanted = saved(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    links = saved(checked(pairs, sets_of(wanted), percent), "links")
    joined = saved(components(links), "joined")
    labelled = lists.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    rows = saved(open_lists(labelled), "open")
    rows = saved(rows.join(promising(rows, known, percent), ["key", "node"]), "promising")
    if rows.isEmpty():
        return joined
    # The main component of what is left of a list may be another.
    rows = saved(open_lists(rows.select("key", "node", "component")), "open")
    sets = sets_of(saved(rows.select("node").distinct(), "wanted"))
    more = saved(compared(rows, known.join(sets, "node"), percent), "links")
    return saved(components(links.union(more).union(joined.select("node", "component"))), "joined")
