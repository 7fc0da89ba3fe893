"""The queries of this subpackage, each an operator over its whole table, and SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lagweave.llm import additive_search, decontaminate, html_text, jaccard_join, language, licence_scan, pieces, substring_dedup, token_files, url_trust
from lagweave.llm.shared import bounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op3_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return additive_search.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scanned(table(spark, sf_dir, "documents"))


URL_RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def op7_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judged(table(spark, sf_dir, "pages"), [url_trust.Rule.read(r) for r in URL_RULES]).drop("trust", "distrust")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_files, op2_html_text, op3_additive_search, op4_decontaminate, op5_jaccard_join, op6_licence_scan, op7_url_trust, op8_sentencepiece, op9_substring_dedup, op10_language)
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[j:j + m - 1], ' ') AS g
       FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS j FROM (SELECT item_id, w, least(len(w), 8) AS m FROM i WHERE len(w) > 0))),
dw AS (SELECT doc_id, m, j, array_to_string(w[j:j + m - 1], ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS j FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
hit AS (SELECT DISTINCT doc_id, m, j, item_id FROM dw JOIN iw USING (m, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(j, j + m)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(found.s, '')) AS items_sha256, coalesce(found.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def jaccard_ctes(source: str, words: int, percent: int) -> str:
    """CTEs sets (doc_id, n) and component (doc_id, component_id) of the documents in source."""
    return rf"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM {source}),
s AS (SELECT DISTINCT doc_id, array_to_string(w[j:j + {words - 1}], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) AS j FROM w WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT c.a, c.b FROM common c JOIN sets x ON x.doc_id = c.a JOIN sets y ON y.doc_id = c.b WHERE 100 * c.n >= {percent} * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
component AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
"""


OP5_SQL = f"""
WITH RECURSIVE {jaccard_ctes("documents", 3, 90)}
SELECT d.doc_id, CAST(coalesce(sets.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN component USING (doc_id)
"""



def case(value: str) -> str:
    """CASE over the URL rules, the longest first."""
    rules = sorted(map(url_trust.Rule.read, URL_RULES), key=lambda r: -len(r.text))
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}') THEN '{getattr(r, value)}'" for r in rules) + " END"


def ranks(name: str, a: str, b: str, seeds: str, rounds: int = 20) -> str:
    """CTEs of a personalised PageRank over links from column a to column b; the last is `name`."""
    out = [f"{name}_share AS MATERIALIZED (SELECT {a} AS a, {b} AS b, n / sum(n) OVER (PARTITION BY {a}) AS share FROM links)",
           f"{name}_0 AS MATERIALIZED (SELECT host, 0.15 / count(*) OVER () AS score FROM votes WHERE {seeds})"]
    for i in range(1, rounds + 1):
        last = f"{name}_{i - 1}"
        out.append(f"{name if i == rounds else f'{name}_{i}'} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT s.b AS host, 0.85 * r.score * s.share AS score FROM {name}_share s JOIN {last} r ON s.a = r.host UNION ALL SELECT * FROM {name}_0) GROUP BY host)")
    return ",\n".join(out)


OP7_SQL = rf"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS MATERIALIZED (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS MATERIALIZED (SELECT page_id, host, path, {case("text")} AS rule, {case("verdict")} AS verdict FROM p),
votes AS MATERIALIZED (SELECT host, sum(CASE verdict WHEN 'allow' THEN 1 ELSE -1 END) AS vote FROM k WHERE host <> '' AND verdict IS NOT NULL GROUP BY host),
found AS (SELECT host AS a, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1)) AS link FROM p WHERE host <> ''),
links AS MATERIALIZED (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM (SELECT a, translate(regexp_extract(link, '//([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS b FROM found) WHERE b <> '' AND a <> b GROUP BY a, b),
{ranks("trust", "a", "b", "vote > 0")},
{ranks("distrust", "b", "a", "vote <= 0")}
SELECT page_id, k.host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust.score, 0) - coalesce(trust.score, 0) >= 1e-12 THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN trust ON trust.host = k.host LEFT JOIN distrust ON distrust.host = k.host
"""

ORACLE_SQL: dict[str, str] = {"op4_decontaminate": OP4_SQL, "op5_jaccard_join": OP5_SQL, "op7_url_trust": OP7_SQL}
