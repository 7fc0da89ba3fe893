"""Words on which a polynomial hash modulo a power of two collides, through every operator that hashes words."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lagweave.llm import decontaminate, jaccard_join, pieces, shared, substring_dedup, token_files

FLIP = str.maketrans("ab", "ba")


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n).translate(FLIP)) for n in (1024, 2048)]


def test_hashes_depend_on_content_alone():
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.randrange(2) for _ in range(3000)), np.uint8)
    starts = np.array([rng.randrange(2900) for _ in range(4000)])
    ends = np.array([rng.randrange(s, min(s + 40, 3000) + 1) for s in starts])
    got = {}
    for s, e, h in zip(starts, ends, shared.byte_hashes(data, starts, ends)):
        got.setdefault(data[s:e].tobytes(), set()).add(int(h))
    assert all(len(x) == 1 for x in got.values()) and len({min(x) for x in got.values()}) == len(got)
    values = shared.mix(data.astype(np.uint64))
    for k in (1, 2, 3, 5, 8, 15):
        grams = shared.gram_hashes(values, k)
        at = np.array([0, 7, 100, 3000 - k])
        assert len(grams) == 3001 - k and (shared.grams_at(values, at, k) == grams[at]).all()
        assert len(set(grams.tolist())) == len({data[i : i + k].tobytes() for i in range(3001 - k)})


def test_words_of_one_hash_are_told_apart(monkeypatch):
    plain = shared.range_hashes
    monkeypatch.setattr(shared, "range_hashes", lambda *a: plain(*a) & np.uint64(7))
    store = shared.WordStore(lambda ws: (np.array([int(w) for w in ws], np.int32), np.ones(len(ws), np.int64)), 50)
    rng = random.Random(1)
    for _ in range(30):
        words = [str(rng.randrange(90)) for _ in range(40)]
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        ids, _ = store.ids(store.places(raw, ends - [len(w) for w in words], ends))
        assert ids.tolist() == [int(w) for w in words]


@pytest.mark.parametrize("pair", PAIRS, ids=["1024", "2048"])
def test_patterned_words(spark, pair):
    a, b = pair
    both = pa.array([f"x {a} {b}", f"{b} {a}", b], pa.large_string())
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, ends = token_files.Encoder(path).encode(both)
    plain = Tokenizer.from_file(path)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in both.to_pylist()]
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [x.tolist() for x in pieces.PieceModel(path).encode(both.to_pylist())] == [library.encode(t) for t in both.to_pylist()]
    docs = spark.createDataFrame([(1, f"{a} one two three four five six seven"), (2, f"{b} one two three four five six seven")], "doc_id long, text string")
    items = spark.createDataFrame([(1, f"{a} one two three four five six seven"), (2, a)], "item_id long, text string")
    assert {r.doc_id: r.n_items for r in decontaminate.digest(decontaminate.marked(docs, items)).collect()} == {1: 2, 2: 0}
    same = spark.createDataFrame([(1, f"{a} y"), (2, f"{b} y"), (3, f"{a} y")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.joined(same).collect()} == {1: 1, 2: 2, 3: 1}
    line = lambda w: " ".join([w] * 40) + "."
    cut = substring_dedup.deduplicated(spark.createDataFrame([(1, line(a)), (2, line(b)), (3, line(a))], "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in cut.collect()} == {1: 0, 2: 0, 3: 40}
