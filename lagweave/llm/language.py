"""Language identification by inference of multilingual mixtures.

Each language has a smoothed distribution over hashed character n-grams. A document is a mixture: its
words come from languages with unknown proportions, which expectation-maximisation estimates from the
words' n-gram likelihoods. Of the nested sets of languages that the full mixture's proportions
order, the one with the largest penalised likelihood (half the logarithm of the number of words for
each language) is the document's; its largest proportion names the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.llm.shared import Words, byte_class, named, saved, slices

BUCKETS = 1 << 15
#: Words of letters: after lower-casing A-Z, the letters and all bytes of non-ASCII characters.
LETTERS = byte_class(lambda c: 97 <= c <= 122 or c >= 128)
UNKNOWN = "und"
#: A table with a row per language is broadcast up to so many.
FEW_LANGUAGES = 10_000


ORDERS = (2, 3, 4)


def grams(w: Words) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the byte n-grams that end at each place of the words, by n, and where words begin.

    A word's places are its bytes and the space on both sides; BUCKETS stands for a gram that would
    pass the word's front.
    """
    size = w.ends - w.starts + 2
    begin = np.cumsum(size) - size
    total = int(size.sum())
    front = np.repeat(w.starts - 1 - begin, size)
    place = np.arange(total) + front
    letter = w.data[np.clip(place, 0, len(w.data) - 1)].astype(np.uint32)
    letter[begin] = letter[begin + size - 1] = 32
    at = np.arange(total) - np.repeat(begin, size)
    out, key = [], letter
    for n in range(2, max(ORDERS) + 1):
        key = np.concatenate([np.zeros(min(1, total), np.uint32), key[:-1]]) * np.uint32(257) + letter
        if n in ORDERS:
            k = key * np.uint32(2654435761)
            out.append(np.where(at >= n - 1, (k ^ (k >> np.uint32(15))) % np.uint32(BUCKETS), np.uint32(BUCKETS)).astype(np.int64))
    return out, begin


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages: logarithms of probabilities

    def word_scores(self, w: Words) -> np.ndarray:
        """Sums of the log-likelihoods of each word's n-grams, by language, over the orders' number."""
        places, begin = grams(w)
        if not len(begin):
            return np.zeros((0, len(self.languages)), np.float32)
        table = np.concatenate([self.weights, np.zeros((1, len(self.languages)), np.float32)])
        out = table[places[0]]
        for p in places[1:]:
            out += table[p]
        return np.add.reduceat(out, begin, axis=0) / np.float32(len(ORDERS))


def fit(labelled: DataFrame, documents_a_language: int = 400, smoothing: float = 0.5) -> LanguageModel:
    """Learns from (text, lang) rows with non-null lang.

    A language counts with at most documents_a_language of its different texts, those of the smallest
    hashes; these are read whole. The sample is the bound of what is counted; rows
    are never collected, and what reaches the driver is a count per language and n-gram bucket.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    # A threshold takes about 1.5 times the documents wanted, so the exact choice sorts few rows.
    cut = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    cut = cut.select("lang", F.least(F.lit(1.0), F.lit(1.5 * documents_a_language) / F.col("n")).alias("share"))
    cut = saved(cut, "shares")
    near = rows.join(F.broadcast(cut) if cut.count() <= FEW_LANGUAGES else cut, "lang").where("(h / 9223372036854775807.0 + 1) / 2 <= share")
    near = near.groupBy("lang", "h").agg(F.first("text").alias("text"))  # copies count once
    chosen = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= documents_a_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = np.array(batch.column(0).to_pylist(), object)
            for lang in set(names):
                w = Words(batch.column(1).filter(pa.array(names == lang)), LETTERS)
                count = np.bincount(np.concatenate([np.zeros(0, np.int64), *grams(w)[0]]), minlength=BUCKETS + 1)[:BUCKETS]
                bucket = np.flatnonzero(count)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(bucket), "bucket": bucket, "n": count[bucket]})

    counted = chosen.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    languages = sorted(set(table["lang"])) if len(table) else []
    counts = np.full((BUCKETS, len(languages)), smoothing)
    number = {x: i for i, x in enumerate(languages)}
    counts[table["bucket"].to_numpy(int), [number[x] for x in table["lang"]]] += table["n"].to_numpy(float)
    return LanguageModel(languages, np.log(counts / counts.sum(0)).astype(np.float32))


def mixture(like: np.ndarray, text: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text's languages, and log-likelihoods.

    like: likelihood of each word by language; text: of each word, ascending, and every text has
    one; start: proportions to start from, 0 for languages that are not allowed.
    """
    new = np.searchsorted(text, np.arange(len(start)))
    words = np.diff(np.append(new, len(text)))[:, None].astype(like.dtype)
    share = (start / start.sum(1, keepdims=True)).astype(like.dtype)
    for _ in range(rounds):
        part = like * share[text]
        part /= np.einsum("ij->i", part)[:, None]
        share = np.add.reduceat(part, new, axis=0) / words
    fit = np.einsum("ij,ij->i", like, share[text])
    return share.astype(np.float64), np.add.reduceat(np.log(np.maximum(fit, 1e-30)).astype(np.float64), new)


def proportions(model: LanguageModel, texts: pa.Array, rounds: int = 5, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the chosen languages (others 0) by text, and flags of the texts with a letter."""
    n, k = len(texts), len(model.languages)
    w = Words(texts, LETTERS)
    lettered = w.counts > 0
    odd = np.flatnonzero(lettered)
    if len(odd):  # non-ASCII characters need not be letters
        ascii_ = pc.match_substring_regex(texts, "[A-Za-z]").fill_null(False).to_numpy(zero_copy_only=False)
        other = odd[~ascii_[odd]]
        for i in other.tolist():
            lettered[i] = any(c.isalpha() for c in texts[i].as_py())
    out = np.zeros((n, k))
    some = w.counts > 0
    if not k or not some.any():
        return out, lettered
    score = model.word_scores(w)
    like = np.maximum(np.exp(score - score.max(1, keepdims=True)), np.float32(floor))
    text = np.repeat(np.cumsum(some) - 1, w.counts)
    m, words = int(some.sum()), w.counts[some]
    full, _ = mixture(like, text, np.ones((m, k)), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    position, ranked = np.argsort(order, axis=1), np.take_along_axis(full, order, 1)
    best, value = np.zeros((m, k)), np.full(m, -np.inf)
    for size in range(1, k + 1):
        # A set is not tried where the last of its languages has less than one word.
        tried = ranked[:, size - 1] * words >= (1 if size > 1 else 0)
        if not tried.any():
            break
        mine = tried[text]
        start = np.where(position[tried] < size, np.maximum(full[tried], 1e-9), 0)
        share, total = mixture(like[mine], (np.cumsum(tried) - 1)[text[mine]], start, rounds if size > 1 else 0)
        total -= 0.5 * size * np.log(np.maximum(words[tried], 2))
        better = np.flatnonzero(tried)[total > value[tried]]
        best[better] = share[total > value[tried]]
        value[better] = total[total > value[tried]]
    out[some] = best
    return out, lettered


def predicted(docs: DataFrame, model: LanguageModel, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1: the proportion of that language), and languages with
    proportions; with keep, all columns of docs follow instead of doc_id alone.

    lang_pred is `und`, with score 0, where text is null or has no letter, or nothing was learned.
    Equal proportions go to the language first by name. Only text is looked at, whole. Every row gives
    one row, repeated ones too; no rows give none. Columns may have any names, dots included.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns if keep else ["doc_id"]
    rows = docs.select(F.col("text").cast("string").alias("__text"), *[named(c).alias(f"__{i}") for i, c in enumerate(columns)])
    places = rows.columns[1:]
    added = "__lang_pred string, __score double, __languages map<string, double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in slices(batches, "__text"):
            share, lettered = proportions(model, batch.column(0))
            share[~lettered] = 0
            best = share.argmax(1) if share.shape[1] else np.zeros(len(share), int)
            score = share.max(1, initial=0)
            best = np.where(score > 0, best, len(names) - 1)
            row, col = np.nonzero(share)
            offsets = np.searchsorted(row, np.arange(len(share) + 1)).astype(np.int32)
            maps = pa.MapArray.from_arrays(pa.array(offsets), pa.array(names[col], pa.string()), pa.array(share[row, col]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names[best], pa.string()), pa.array(np.minimum(score, 1.0)), maps], [*places, "__lang_pred", "__score", "__languages"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]] + [added])
    told = rows.mapInArrow(run, schema)
    return told.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(columns)], "__lang_pred", "__score", "__languages")


def held_out(docs: DataFrame) -> DataFrame:
    """docs with the flag held_out: crc32 of doc_id's decimal digits is divisible by 5. A null
    doc_id counts as the empty text."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted to the documents that are not held out."""
    rows = held_out(docs.select("doc_id", "text", "lang"))
    model = fit(rows.where("not held_out"))
    out = predicted(rows.select("doc_id", "held_out", "text"), model, keep=True)
    return out.select("doc_id", "held_out", F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"), F.col("__languages").alias("languages"))
