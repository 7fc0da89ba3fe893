"""Search and URL operators, and the pipeline, against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest

import corpus_pipeline
from lagweave.llm import additive_search, shared, url_trust
from lagweave.llm.queries import ORACLE_SQL, QUERIES, URL_RULES
from lagweave.llm.shared import saved
from test_text_operators import brute_components, words4

SF = "/root/testdata/sf0.001"


def brute(rows, queries, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = []
    for i, q in usable:
        if i in queries:
            scored = sorted({(-float((x * q).sum()), j) for j, x in usable if j != i})
            seen, n = set(), 0
            for s, j in scored:
                if j not in seen and n < k:
                    seen.add(j)
                    n += 1
                    out.append((i, n, j, -s))
    return out


def test_search_recall(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = sorted(tuple(r) for r in additive_search.nearest(v, v.where("vec_id % 20 = 0")).collect())
    expected = sorted(brute([(r.vec_id, r.embedding) for r in v.collect()], {i for i in range(0, 500, 20)}, 20))
    same = len({(q, j) for q, _, j, _ in got} & {(q, j) for q, _, j, _ in expected}) / len(expected)
    assert same >= 0.9 and len(got) == len(expected)
    score = {(q, j): s for q, _, j, s in expected}
    assert all(abs(s - score[q, j]) < 1e-12 for q, _, j, s in got if (q, j) in score)


def test_search_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.5]), (8, [2.0, float("inf")]), (20, [0.5, 0.5]), (20, [0.5, 0.5])]
    v = spark.createDataFrame([(i, x, "s") for i, x in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in additive_search.nearest(v, v.where("vec_id % 20 = 0"), k=4).collect())
    assert [(q, n, j) for q, n, j, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (0, 4, 7), (20, 1, 0), (20, 2, 1), (20, 3, 2), (20, 4, 7)]
    assert additive_search.nearest(v.where("false"), v.where("false")).count() == 0


def test_search_keeps_lengths_apart(spark):
    rows = [(i, [float(i % 7 + 1), 1.0, float(i % 3)]) for i in range(40)] + [(100 + i, [float(i), 2.0]) for i in range(10)]
    got = sorted(tuple(r) for r in additive_search.nearest(*[spark.createDataFrame(rows, "vec_id long, embedding array<float>")] * 2, k=5).collect())
    short, long = ([(i, v) for i, v in rows if len(v) == d] for d in (2, 3))
    assert got == sorted(brute(short, {i for i, _ in short}, 5) + brute(long, {i for i, _ in long}, 5))


def test_search_blocks_do_not_follow_partitions(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    parted = v.repartition(90)
    tasks = 2 * spark.sparkContext.defaultParallelism
    rows = additive_search.usable(parted)
    assert additive_search.blocks(rows, 1024, None).count() == 1 and additive_search.blocks(rows, 1024, None, tasks).count() == tasks
    got = [additive_search.nearest(x, x.where("vec_id % 20 = 0")) for x in (v, parted)]
    assert got[0].rdd.getNumPartitions() <= tasks and sorted(map(tuple, got[0].collect())) == sorted(map(tuple, got[1].collect()))


def test_search_counts_ids_not_rows():
    r = np.random.default_rng(3)
    own = r.normal(size=(60, 8))
    x, ids = np.repeat(own, 20, axis=0), np.repeat(np.arange(60), 20)
    books = additive_search.fitted(x.astype(np.float32), 4, 16)
    codes, near = books.encode(x.astype(np.float32))
    for q, me in ((own[0], 0), (own[:20].mean(0), -1)):
        _, row, _, counted = additive_search.best_pairs(books, np.array([me]), q[None], ids, x, codes, additive_search.norms(x, near), 30, 0.1)
        assert ids[row].tolist() == [i for i in np.argsort(-(own @ q), kind="stable").tolist() if i != me][:30] and counted > 120


def test_search_by_estimates():
    """Whole vectors of sf0.1: the recall comes from a small share of exact scores."""
    t = pa.parquet.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x, ids = np.array(t["embedding"].to_pylist(), float), t["vec_id"].to_numpy()
    books = additive_search.fitted(x)
    codes, near = books.encode(x.astype(np.float32))
    at = np.flatnonzero(ids % 20 == 0)
    q, row, score, counted = additive_search.best_pairs(books, ids[at], x[at], ids, x, codes, additive_search.norms(x, near), 20, 0.03)
    exact = x[at] @ x.T
    exact[np.arange(len(at)), at] = -np.inf
    best = np.argsort(-exact, axis=1, kind="stable")[:, :20]
    hits = len({*zip(q.tolist(), row.tolist())} & {(i, j) for i, b in enumerate(best.tolist()) for j in b}) / best.size
    assert hits >= 0.9 and counted < 0.1 * len(at) * len(x), (hits, counted)
    np.testing.assert_allclose(score, (x[at][q] * x[row]).sum(1), atol=1e-12)


def test_beam_search_codes():
    x = np.random.default_rng(0).normal(size=(500, 8)).astype(np.float32)
    books = additive_search.fitted(x, 4, 16)
    codes, near = books.encode(x)
    np.testing.assert_allclose(near, sum(books.words[b][codes[:, b]] for b in range(4)), atol=1e-5)
    greedy = additive_search.Codebooks(books.words, beam=1).encode(x)[1]
    assert ((x - near) ** 2).sum() <= ((x - greedy) ** 2).sum()


def test_urls(spark):
    rules = [url_trust.Rule.read(r) for r in URL_RULES]
    rows = [
        (1, "http://A.net/x", '<a href="http://bad.com/de/1">x</a>'), (2, "http://bad.com/de/2", "<a href='//good.org/'>"), (3, "https://good.org/a", '<a class="q" href=http://c.net:80/p>'),
        (4, "http://c.net:80", None), (5, None, ""), (6, "nope", "<a href='http://x.y/'>"), (7, "x://Sub.Example.ORG/en/12?x", ""), (8, "http://org", ""), (8, "http://org", ""), (9, "http://notorg/a", ""), (10, "https://b.com/fr/#a", ""),
    ]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: tuple(r)[1:5] for r in url_trust.judged(pages, rules).collect()}
    assert got == {
        1: ("a.net", "/x", None, "block"), 2: ("bad.com", "/de/2", "com/de/", "block"), 3: ("good.org", "/a", "org/", "allow"), 4: ("c.net:80", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("sub.example.org", "/en/12", "example.org/en/1", "block"), 8: ("org", "", None, "allow"), 9: ("notorg", "/a", None, "allow"), 10: ("b.com", "/fr/", "com/fr/", "allow"),
    }
    assert url_trust.judged(pages, rules).count() == len(rows) and url_trust.judged(pages.where("false"), rules).count() == 0


def test_many_rules_equal_few(spark, monkeypatch):
    """Rules that are looked up judge as rules of the plan do: domains, ports, paths, ties and strangers."""
    rng = np.random.default_rng(8)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net:80", "a", "\u00e9.com", "nota.com"]
    paths = ["", "/", "/p", "/p/", "/p/q", "/p/q/r\u00fc", "/z"]
    rules = [url_trust.Rule(("allow", "block")[rng.integers(2)], hosts[rng.integers(6)], paths[rng.integers(6)]) for _ in range(30)]
    rules += [url_trust.Rule(v, "net", "/p") for v in ("allow", "block")]
    pages = [(i, f"http://{'y.' * (i % 2)}{h}{p}?q#f", None, 1) for i, (h, p) in enumerate((h, p) for h in hosts for p in paths for _ in range(2))] + [(None, None, "", 1), (3, "none", "", 1), (3, "none", "", 1)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string, rule int")
    few = sorted(map(str, url_trust.judged(pages, rules).collect()))
    monkeypatch.setattr(url_trust, "RULES_IN_PLAN", 0)
    assert sorted(map(str, url_trust.judged(pages, rules).collect())) == few
    many = [url_trust.Rule("block", f"h{i}.org", "/") for i in range(12_000)]
    got = {r.page_id: r.rule for r in url_trust.judged(spark.createDataFrame([(1, "x://s.h77.org/", None), (2, "x://h77.org", None)], "page_id long, url string, html string"), many).collect()}
    assert got == {1: "h77.org/", 2: None}


def test_spread_equals_plain_iteration(spark):
    rng = np.random.default_rng(2)
    edges = {(f"h{a}", f"h{b}"): float(rng.integers(1, 5)) for a, b in rng.integers(0, 12, (40, 2)) if a != b}
    seeds = {"h0": 0.5, "h3": 0.5}
    df = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "a string, b string, n double")
    got = {r.host: r.score for r in url_trust.spread(df, spark.createDataFrame(list(seeds.items()), "host string, weight double"), 0.85, 20).collect()}
    total = {}
    for (a, _), n in edges.items():
        total[a] = total.get(a, 0) + n
    score = {h: 0.15 * w for h, w in seeds.items()}
    for _ in range(20):
        new = {h: 0.15 * w for h, w in seeds.items()}
        for (a, b), n in edges.items():
            if a in score:
                new[b] = new.get(b, 0) + 0.85 * score[a] * n / total[a]
        score = new
    assert got.keys() == score.keys()
    for h, s in score.items():
        assert abs(got[h] - s) < 1e-12


def test_stages_begin_with_a_swept_heap(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory
    calls = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = calls()
    shared.swept(spark)
    assert calls() > before
    seen = []
    monkeypatch.setattr(corpus_pipeline, "swept", seen.append)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF)
        assert seen, name
        seen.clear()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), name)
        kept.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.8 * kept[0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_deduplication", "decontamination", "sentencepiece"]


def test_stages_equal_brute_force(spark):
    """Each deciding stage on its own input: which documents stay, by plain loops."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    groups = {}
    for (i, _), (_, n, c) in zip(rows, brute_components(rows, 5, 80), strict=True):
        groups.setdefault(c if n else ("alone", i), []).append(i)
    near = saved(corpus_pipeline.near_duplicates(spark, docs, SF), "near")
    assert sorted(r.doc_id for r in near.collect()) == sorted(min(g) for g in groups.values())

    items = [words4(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = [{tuple(w[j : j + 8]) for j in range(max(1, len(w) - 7))} for w in items if w]
    clean = []
    for i, t in rows:
        w = words4(t)
        grams = {n: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} for n in range(1, 9)}
        found = [x for x in windows if x & grams[len(next(iter(x)))]]
        if len(found) < 2 and not any(len(next(iter(x))) == 8 for x in found):
            clean.append(i)
    assert sorted(r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).collect()) == sorted(clean)

    kept = corpus_pipeline.language_id(spark, docs, SF).count()
    assert kept >= 0.98 * len(rows)


def test_pipeline_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x " * 40), (3, "x " * 40), (None, "Der Hund und die Katze " * 5), (4, "Der Hund und die Katze " * 5)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in near) == ["1", "2", "3", "4"]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()
        stage(spark, docs.where("false"), SF).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLE_SQL[name])
    order = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in cursor.fetchall())
