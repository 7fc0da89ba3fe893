"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text is normalised as the model asks (spaces become U+2581, one is put before), and cut into words
that no piece spans. All new words of a batch are laid out as one flat array of symbols. In each
round every word finds the smallest rank among its adjacent pairs; all leftmost, non-overlapping
pairs of that rank are merged at once, and the array is compacted. A word whose merge makes a pair of
a rank that is no larger merges its leftmost pair alone in that round, so the order of merges is that
of the sequential algorithm. Words are done when no pair of theirs is a piece. Results are kept by
word, so that a frequent word is encoded once per worker.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm.shared import WordStore, encoded_words, ragged, slices, text_buffers

SPACE = "▁"
NEVER = np.int64(1) << 60
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

codecs.register_error("each byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class PairTable:
    """Lookup of (left symbol, right symbol) by open addressing in flat arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(left) + 1))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        key = left.astype(np.int64) << 32 | right
        place, todo = self.place(key), np.arange(len(key))
        while len(todo):
            p = place[todo] & (size - 1)
            free = self.keys[p] == -1
            _, first = np.unique(p[free], return_index=True)
            won = todo[free][first]
            self.keys[place[won] & (size - 1)] = key[won]
            self.values[place[won] & (size - 1)] = value[won]
            todo = np.setdiff1d(todo, won)
            place[todo] += 1

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        key = left << 32 | right
        out, place, todo = np.full(len(key), -1, np.int64), self.place(key), np.arange(len(key))
        while len(todo):
            p = place[todo] & (len(self.keys) - 1)
            got = self.keys[p]
            same = got == key[todo]
            out[todo[same]] = self.values[p[same]]
            todo = todo[~same & (got != -1)]
            place[todo] += 1
        return out


class PieceModel:
    """A BPE model of the sentencepiece library, read from its file for its pieces alone."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1, np.int64)
        self.kind = np.full(n, NORMAL)
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.kind[i], self.byte[int(p[1:-1], 16)] = BYTE, i
            elif model.is_unknown(i):
                self.kind[i] = UNKNOWN
            elif model.is_control(i):
                self.kind[i] = CONTROL
        scores = np.array([model.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)  # equal scores share a rank
        self.ranks = np.append(self.rank, NEVER)  # ranks[-1]: no piece
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kind[i] == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or (self.byte < 0).any():
            raise ValueError("the model must keep spaces in front of pieces and have byte pieces")
        self.unknown = int(np.flatnonzero(self.kind == UNKNOWN)[0])
        # Symbols: ids of pieces, then numbers past them for single characters that are no piece.
        left, right, value = [], [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k], self.outside(p[:k])), self.ids.get(p[k:], self.outside(p[k:]))
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    value.append(i)
        self.pairs = PairTable(*(np.array(x, np.int64) for x in (left, right, value)))
        self.store = WordStore(self.merged)
        raw = [b"" if k == CONTROL else bytes([int(p[1:-1], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kind, strict=True)]
        self.raw, self.raw_ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])
        self.raw_sizes = np.array([len(x) for x in raw])
        decimal = [b"%d," % i for i in range(n)]
        self.decimal, self.decimal_sizes = np.frombuffer(b"".join(decimal), np.uint8), np.array([len(x) for x in decimal])
        self.decimal_ends = np.cumsum(self.decimal_sizes)

    @staticmethod
    def outside(text: str) -> int | None:
        return (1 << 24) + ord(text) if len(text) == 1 else None

    # -- merge rounds --

    def values(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the pairs that begin at `at`: the piece they make, -1 for none or across words."""
        out = np.full(len(at), -1, np.int64)
        ok = at + 1 < len(symbol)
        ok[ok] = word[at[ok]] == word[at[ok] + 1]
        out[ok] = self.pairs.get(symbol[at[ok]], symbol[at[ok] + 1])
        return out

    def compacted(self, symbol: np.ndarray, word: np.ndarray, value: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """Symbols, words and pair values after the merges; places of new pairs, and where each began before."""
        kept = np.ones(len(symbol), bool)
        kept[chosen + 1] = False
        after = symbol.copy()
        after[chosen] = value[chosen]
        before = np.flatnonzero(kept)
        place = np.cumsum(kept)[chosen] - 1
        symbol, word, value = after[before], word[before], value[before]
        touched = np.zeros(len(symbol), bool)
        touched[place] = touched[np.maximum(place - 1, 0)] = True
        near = np.flatnonzero(touched)
        value[near] = self.values(symbol, word, near)
        return symbol, word, value, near, before[near]

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, flat, and the number of ids of each."""
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        alphabet, at = np.unique(code, return_inverse=True)
        symbol = np.array([self.ids.get(chr(c), self.outside(chr(c))) for c in alphabet.tolist()], np.int64)[at]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbol, done_word = [], []
        value = self.values(symbol, word, np.arange(len(symbol)))
        while len(symbol):
            rank = self.ranks[value]
            new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(new, len(word)))
            best = np.minimum.reduceat(rank, new)
            live = np.repeat(best < NEVER, sizes)
            if not live.all():
                done_symbol.append(symbol[~live])
                done_word.append(word[~live])
                if not live.any():
                    break
                symbol, word, value, rank = symbol[live], word[live], value[live], rank[live]
            best = np.repeat(best[best < NEVER], sizes[best < NEVER])
            chosen = np.flatnonzero(rank == best)
            # Of a run of overlapping pairs, every other one from the left.
            breaks = np.concatenate([[True], np.diff(chosen) > 1])
            run = np.flatnonzero(breaks)[np.cumsum(breaks) - 1]
            chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            merged = self.compacted(symbol, word, value, chosen)
            # Words where a merge makes a pair of a rank no larger: the leftmost merge alone.
            early = self.ranks[merged[2][merged[3]]] <= best[merged[4]]
            if early.any():
                careful = np.isin(word[chosen], merged[1][merged[3][early]])
                first = np.concatenate([[True], word[chosen][1:] != word[chosen][:-1]])
                merged = self.compacted(symbol, word, value, chosen[~careful | first])
            symbol, word, value = merged[:3]
        symbol, word = np.concatenate(done_symbol or [symbol]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        symbol, word = symbol[order], word[order]
        other = symbol >= len(self.pieces)
        if other.any():  # characters without a piece: their bytes
            spelled = [[int(self.byte[x]) for x in chr(c - (1 << 24)).encode()] for c in symbol[other].tolist()]
            size = np.ones(len(symbol), int)
            size[other] = [len(x) for x in spelled]
            word, long = np.repeat(word, size), np.repeat(symbol, size)
            long[np.repeat(other, size)] = [x for y in spelled for x in y]
            symbol = long
        return symbol, np.bincount(word, minlength=len(words))

    # -- texts --

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the sentencepiece library gives them."""
        ids, ends = self.encode_flat(pa.array(texts, pa.large_string()))
        return np.split(ids, ends[:-1]) if texts else []

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and where each text ends."""
        if pc.any(pc.match_substring(texts, SPACE)).as_py():  # it counts as a space
            texts = pc.replace_substring(texts, SPACE, " ")
        offsets, raw = text_buffers(texts)
        some = np.diff(offsets) > 0
        bounds = offsets + np.concatenate([[0], np.cumsum(some)])
        front = np.zeros(int(bounds[-1]), bool)  # a space before each text that is not empty
        front[bounds[:-1][some]] = True
        data = np.full(len(front), 32, np.uint8)
        data[~front] = raw
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins |= front
        return encoded_words(self.store, data, bounds, begins, lambda w: w.replace(" ", SPACE))

    def decimals(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids of each text in decimal, joined by commas."""
        size = self.decimal_sizes[ids]
        data = self.decimal[ragged(self.decimal_ends[ids] - size, size)].tobytes()
        cuts = np.concatenate([[0], np.concatenate([[0], np.cumsum(size)])[ends]]).tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids: pieces put together, the space in front dropped, broken bytes replaced."""
        size = self.raw_sizes[ids]
        data = self.raw[ragged(self.raw_ends[ids] - size, size)].tobytes()
        out, at = [], 0
        first = np.concatenate([[0], ends[:-1]]).astype(int)
        for a, z, end in zip(first.tolist(), ends.tolist(), np.concatenate([[0], np.cumsum(size)])[ends].tolist(), strict=True):
            cut = data[at:end]
            while a < z and self.kind[ids[a]] == CONTROL:
                a += 1
            if a < z and self.kind[ids[a]] == NORMAL and cut[:1] == b" ":
                cut = cut[1:]
            out.append(cut.decode("utf-8", "each byte"))
            at = end
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_flat(np.asarray(ids, np.int64), np.array([len(ids)]))[0]


@lru_cache(2)
def model_of(path: str) -> PieceModel:
    return PieceModel(path)


def encoded(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (array, if with_ids), n_tokens, ids_sha256, decoded, decoded_sha256 of each row.

    A null text counts as empty and has no ids. The hashes are of the decimal ids joined by commas,
    and of the decoded text. Other columns of docs are dropped; rows keep their order and number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for batch in slices(batches):
            ids, ends = model.encode_flat(batch.column(1).fill_null(""))
            texts = model.decode_flat(ids, ends)
            arrays = [batch.column(0), pa.array(np.diff(ends, prepend=0)), pa.array([hashlib.sha256(x).hexdigest() for x in model.decimals(ids, ends)]),
                      pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(texts)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
