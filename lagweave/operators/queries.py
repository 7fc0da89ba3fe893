"""The engine's own queries: each operator over a whole table or an analytic series, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.kernels.trajectory import circle
from lagweave.operators import relational as R
from lagweave.operators.model import SSA
from lagweave.sources import series as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def values(df: DataFrame, *names: str, digits: int = 6, value: str = "value") -> DataFrame:
    return df.select(*names, rounded(value, digits).alias(value))


# --- series in SQL ---

MONTHS = """m AS (SELECT 'orders' AS series_id, year(o_orderdate) * 12 + month(o_orderdate) AS q, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL),
s AS (SELECT series_id, CAST(q - (SELECT min(q) FROM m) + 1 AS BIGINT) AS t, value FROM m)"""
FLAGS = """m AS (SELECT l_returnflag AS series_id, year(l_shipdate) * 12 + month(l_shipdate) AS q, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY ALL),
s AS (SELECT series_id, CAST(q - (SELECT min(q) FROM m) + 1 AS BIGINT) AS t, value FROM m)"""
HOURS = """h AS (SELECT event_type AS series_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS q, count(*) AS c FROM events GROUP BY ALL),
o AS (SELECT series_id, q - (SELECT min(q) FROM h) + 1 AS t, c FROM h),
g AS (SELECT series_id, unnest(generate_series(a, b)) AS t FROM (SELECT series_id, min(t) AS a, max(t) AS b FROM o GROUP BY 1)),
s AS (SELECT g.series_id, g.t - (SELECT min(t) FROM g x WHERE x.series_id = g.series_id) + 1 AS t, CAST(c AS DOUBLE) AS value FROM g LEFT JOIN o USING (series_id, t))"""
N_OF = "n AS (SELECT series_id, max(t) AS n FROM s GROUP BY 1)"
WEIGHTS = "w AS (SELECT series_id, t, least(t, {L}, n - {L} + 1, n - t + 1) AS w FROM s JOIN n USING (series_id))"


def gapped_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly events of each type from 1, with nulls in hours without one."""
    rows = S.regular(S.hourly_events(spark, sf_dir, by_type=True))
    first = rows.groupBy("series_id").agg(F.min("t").alias("a"))
    return rows.join(first, "series_id").select("series_id", (F.col("t") - F.col("a") + 1).alias("t"), "value")


@query(f"WITH {MONTHS}, {N_OF} SELECT a.series_id, CAST(i AS BIGINT) AS i, a.t - i + 1 AS j, a.value AS x FROM s a JOIN n USING (series_id), (SELECT unnest(range(1, 13)) AS i) WHERE a.t - i + 1 BETWEEN 1 AND n - 11")
def embed_lag_vectors(spark, sf_dir):
    return R.embed(S.monthly_orders(spark, sf_dir), 12)


@query(f"WITH {FLAGS} SELECT series_id, t, value FROM s")
def hankelize_matrix(spark, sf_dir):
    return R.hankelize(R.embed(S.monthly_quantity(spark, sf_dir), 12))


RANK_ONE = f"""WITH {MONTHS}, u AS (SELECT t AS i, value AS x FROM s WHERE t <= 20), v AS (SELECT t AS j, value AS x FROM s WHERE t <= 61)
SELECT 'orders' AS series_id, i + j - 1 AS t, round(avg(u.x * v.x), 4) + 0.0 AS value FROM u, v GROUP BY ALL"""


@query(RANK_ONE)
def hankelize_rank1(spark, sf_dir):
    s = S.monthly_orders(spark, sf_dir)
    u = s.where("t <= 20").select("series_id", F.col("t").alias("i"), F.col("value").alias("x"))
    v = s.where("t <= 61").select("series_id", F.col("t").alias("j"), F.col("value").alias("x"))
    return values(R.rank_one(u, v), "series_id", "t", digits=4)


@query(f"WITH {MONTHS} SELECT a.series_id, a.t - b.t + 1 AS i, sum(a.value * b.value) AS value FROM s a JOIN s b ON b.t <= 69 AND a.t - b.t + 1 BETWEEN 1 AND 12 GROUP BY ALL")
def hankel_matvec(spark, sf_dir):
    s = S.monthly_orders(spark, sf_dir)
    return R.hankel_product(s, 12, s.where("t <= 69").select("series_id", F.col("t").alias("j"), F.col("value").alias("x")))


LAGS = "c AS (SELECT a.series_id, b.t - a.t AS k, sum(a.value * b.value) / (any_value(n) - (b.t - a.t)) AS value FROM s a JOIN s b ON a.series_id = b.series_id AND b.t - a.t BETWEEN 0 AND 23 JOIN n ON n.series_id = a.series_id GROUP BY 1, 2)"


@query(f"WITH {MONTHS}, {N_OF}, {LAGS} SELECT a.series_id, CAST(i AS BIGINT) AS i, round(sum(c.value * a.value), 4) + 0.0 AS value FROM s a, (SELECT unnest(range(1, 25)) AS i) JOIN c ON true WHERE a.t <= 24 AND c.k = abs(i - a.t) GROUP BY ALL")
def toeplitz_matvec(spark, sf_dir):
    s = S.monthly_orders(spark, sf_dir)
    v = s.where("t <= 24").select("series_id", F.col("t").alias("j"), F.col("value").alias("x"))
    return values(R.toeplitz_product(s, 24, v), "series_id", "i", digits=4)


@query(f"WITH {FLAGS}, {N_OF}, {LAGS} SELECT series_id, k, round(value, 6) + 0.0 AS value FROM c")
def lcor(spark, sf_dir):
    return values(R.lag_products(S.monthly_quantity(spark, sf_dir), 24), "series_id", "k")


@query(f"WITH {MONTHS}, {N_OF} SELECT a.series_id, CAST(k AS BIGINT) AS k, round(sum(a.value * b.value) / any_value(n), 6) + 0.0 AS value FROM s a JOIN n USING (series_id), (SELECT unnest(range(0, 24)) AS k) JOIN s b ON true WHERE b.t = (a.t - 1 + k) % n + 1 GROUP BY ALL")
def lcor_circular(spark, sf_dir):
    return values(R.lag_products(S.monthly_orders(spark, sf_dir), 24, circular=True), "series_id", "k")


@query(f"WITH {FLAGS}, {N_OF}, {WEIGHTS.format(L=30)} SELECT series_id, t, CAST(w AS BIGINT) AS w FROM w")
def hweights(spark, sf_dir):
    return R.hankel_weights(S.monthly_quantity(spark, sf_dir), 30)


WINDOWS = "f AS (SELECT a.series_id, a.t AS j FROM s a JOIN s b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + 5 WHERE b.value IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 6)"


@query(f"WITH {HOURS}, {WINDOWS} SELECT series_id, j FROM f")
def fmask_gaps(spark, sf_dir):
    return R.complete_windows(gapped_hours(spark, sf_dir), 6)


@query(f"WITH {HOURS}, {WINDOWS} SELECT s.series_id, s.t, count(j) AS w FROM s LEFT JOIN f ON f.series_id = s.series_id AND s.t BETWEEN f.j AND f.j + 5 GROUP BY 1, 2")
def field_weights(spark, sf_dir):
    return R.field_weights(gapped_hours(spark, sf_dir), 6)


@query(f"WITH {FLAGS}, {N_OF}, {WEIGHTS.format(L=40)} SELECT series_id, round(sqrt(sum(w * value * value)), 4) + 0.0 AS wnorm FROM s JOIN w USING (series_id, t) GROUP BY 1")
def wnorm(spark, sf_dir):
    return values(R.weighted_norm(S.monthly_quantity(spark, sf_dir), 40), "series_id", digits=4, value="wnorm")


@query(f"""WITH {FLAGS}, {N_OF}, {WEIGHTS.format(L=40)}, d AS (SELECT a.series_id AS g1, b.series_id AS g2, sum(w * a.value * b.value) AS s FROM s a JOIN s b USING (t) JOIN w ON w.series_id = a.series_id AND w.t = a.t GROUP BY 1, 2)
SELECT d.g1, d.g2, round(d.s / sqrt(x.s * y.s), 6) + 0.0 AS wcor FROM d JOIN d x ON x.g1 = d.g1 AND x.g2 = d.g1 JOIN d y ON y.g1 = d.g2 AND y.g2 = d.g2""")
def wcor_columns(spark, sf_dir):
    return values(R.weighted_correlations(S.monthly_quantity(spark, sf_dir), 40), "g1", "g2", value="wcor")


@query(f"""WITH {HOURS}, {N_OF}, k AS (SELECT series_id, t, L, CASE WHEN t - lag(t) OVER (PARTITION BY series_id, L ORDER BY t) <= L THEN 0 ELSE 1 END AS f FROM s, (VALUES (3), (12), (48)) v(L) WHERE value IS NULL),
c AS (SELECT series_id, t, L, sum(f) OVER (PARTITION BY series_id, L ORDER BY t) AS c FROM k), r AS (SELECT series_id, L, c, min(t) AS a, max(t) AS b, count(*) AS m FROM c GROUP BY 1, 2, 3)
SELECT series_id, CAST(L AS BIGINT) AS "L", a AS gap_left, b AS gap_right, CASE WHEN a < L THEN 'left' WHEN b >= n - L + 1 THEN 'right' ELSE 'internal' END AS pos, CASE WHEN m = b - a + 1 THEN 'dense' ELSE 'sparse' END AS kind FROM r JOIN n USING (series_id)""")
def gap_summary(spark, sf_dir):
    return R.gaps(gapped_hours(spark, sf_dir), [3, 12, 48])


@query(f"""WITH {HOURS}, {N_OF}, f AS (SELECT a.series_id, L, a.t FROM s a, (VALUES (2), (6), (12)) v(L) JOIN s b ON b.series_id = a.series_id AND b.t BETWEEN a.t AND a.t + L - 1 WHERE b.value IS NOT NULL GROUP BY ALL HAVING count(*) = L)
SELECT n.series_id AS series_id, CAST(v.L AS BIGINT) AS "L", round(100.0 * count(f.t) / (any_value(n) - any_value(v.L) + 1), 6) + 0.0 AS percent FROM n CROSS JOIN (VALUES (2), (6), (12)) v(L) JOIN f ON f.series_id = n.series_id AND f.L = v.L GROUP BY ALL""")
def complete_lag_pct(spark, sf_dir):
    return values(R.complete_share(gapped_hours(spark, sf_dir), [2, 6, 12]), "series_id", "L", value="percent").where("percent > 0")


POWER = """p AS (SELECT a.series_id, CAST(k AS BIGINT) AS k, k / any_value(n) AS frequency,
(power(sum(value * cos(2 * pi() * ((k * (t - 1)) % n) / n)), 2) + power(sum(value * sin(2 * pi() * ((k * (t - 1)) % n) / n)), 2)) / any_value(n) * CASE WHEN k > 0 AND 2 * k < any_value(n) THEN 2 ELSE 1 END AS power
FROM s a JOIN n USING (series_id), (SELECT unnest(range(0, 42)) AS k) WHERE k <= n // 2 GROUP BY a.series_id, k)"""


@query(f"WITH {MONTHS}, {N_OF}, {POWER} SELECT series_id, k, round(frequency, 8) AS frequency, round(power, 4) + 0.0 AS power FROM p")
def pgram(spark, sf_dir):
    return R.periodogram(S.monthly_orders(spark, sf_dir)).select("series_id", "k", F.round("frequency", 8).alias("frequency"), rounded("power", 4).alias("power"))


@query(f"WITH {FLAGS}, {N_OF}, {POWER} SELECT series_id, CASE WHEN frequency < 0.1 THEN 1 WHEN frequency < 0.25 THEN 2 ELSE 3 END AS bin, round(sum(power) / (SELECT sum(power) FROM p q WHERE q.series_id = p.series_id), 6) + 0.0 AS share FROM p WHERE frequency < 0.51 GROUP BY 1, 2")
def group_by_frequency(spark, sf_dir):
    return values(R.frequency_shares(S.monthly_quantity(spark, sf_dir), [0.1, 0.25, 0.51]), "series_id", "bin", value="share")


@query(f"""WITH RECURSIVE {MONTHS}, r AS (SELECT max(t) AS t, max_by(value, t) AS x, max_by(value, t) FILTER (WHERE t < (SELECT max(t) FROM s)) AS y FROM s
UNION ALL SELECT t + 1, 0.25 * y + 0.5 * x, x FROM r WHERE t < (SELECT max(t) FROM s) + 12) SELECT 'orders' AS series_id, t, round(x, 6) + 0.0 AS value FROM r WHERE t > (SELECT max(t) FROM s)""")
def lrr_apply(spark, sf_dir):
    return values(R.continued(S.monthly_orders(spark, sf_dir), [0.25, 0.5], 12), "series_id", "t")


FIELD = """h AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS q, count(*) AS c FROM events GROUP BY ALL), o AS (SELECT q - (SELECT min(q) FROM h) AS t, c FROM h),
f AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM (SELECT unnest(range(1, 25)) AS i), (SELECT unnest(range(1, (SELECT max(t) // 24 + 2 FROM o))) AS j))"""


@query(f"WITH {FIELD} SELECT 'events' AS field_id, i, j, least(i, 6, 24 - 6 + 1, 24 - i + 1) * least(j, 7, (SELECT max(j) FROM f) - 7 + 1, (SELECT max(j) FROM f) - j + 1) AS w FROM f")
def ssa2d_weights(spark, sf_dir):
    return R.field_cover(S.event_field(spark, sf_dir), 6, 7)


COVARIANCE = f"WITH {MONTHS}, {N_OF} SELECT a.series_id, CAST(p AS BIGINT) AS i, CAST(q AS BIGINT) AS j, sum(a.value * b.value) AS value FROM s a JOIN n USING (series_id), (SELECT unnest(range(1, 13)) AS p), (SELECT unnest(range(1, 13)) AS q) JOIN s b ON true WHERE b.t - q = a.t - p AND a.t - p + 1 BETWEEN 1 AND n - 11 GROUP BY ALL"


@query(COVARIANCE)
def lag_covariance(spark, sf_dir):
    return R.covariance(S.monthly_orders(spark, sf_dir), 12)


# --- decomposition of series from tables; identities and the closed form of two-cell windows ---

TWO = f"""{MONTHS}, g AS (SELECT sum(a.value * a.value) AS a, sum(a.value * b.value) AS b, sum(b.value * b.value) AS d FROM s a JOIN s b ON b.t = a.t + 1),
ev AS (SELECT 0.5 * atan2(2 * b, a - d) AS th, (a + d) / 2 AS m, sqrt(power((a - d) / 2, 2) + b * b) AS r FROM g)"""
TWO_REC = f"""{TWO}, v AS (SELECT x.t AS j, cos(th) * x.value + sin(th) * y.value AS p, th FROM s x JOIN s y ON y.t = x.t + 1 CROSS JOIN ev),
e AS (SELECT j AS t, cos(th) * p AS x FROM v UNION ALL SELECT j + 1, sin(th) * p FROM v), rec AS (SELECT t, avg(x) AS value FROM e GROUP BY t)"""


def orders(spark, sf_dir, **options) -> SSA:
    return SSA(S.monthly_orders(spark, sf_dir), **options)


@query(f"WITH {TWO} SELECT 'orders' AS series_id, 1 AS k, round(sqrt(m + r), 5) AS sigma FROM ev UNION ALL SELECT 'orders', 2, round(sqrt(m - r), 5) FROM ev")
def ssa_L2_sigma(spark, sf_dir):
    return values(orders(spark, sf_dir, window=2).decompose(vectors=False), "series_id", "k", digits=5, value="sigma")


@query(f"WITH {TWO_REC} SELECT 'orders' AS series_id, 'F1' AS grp, t, round(value, 6) + 0.0 AS value FROM rec")
def ssa_L2_reconstruct(spark, sf_dir):
    return values(orders(spark, sf_dir, window=2).reconstruct([[1]]), "series_id", "grp", "t")


@query(f"WITH {TWO} SELECT 'orders' AS series_id, 'F1' AS grp, round(tan(th), 8) AS coef FROM ev")
def ssa_L2_lrr(spark, sf_dir):
    return orders(spark, sf_dir, window=2).lrr([[1]]).select("series_id", "grp", F.round(F.col("coef")[0], 8).alias("coef"))


@query(f"WITH {TWO_REC}, l AS (SELECT max(t) AS t, max_by(value, t) AS x FROM rec) SELECT 'orders' AS series_id, 'F1' AS grp, l.t + k AS t, round(x * power(tan(th), k), 6) + 0.0 AS value FROM l, ev, (SELECT unnest(range(1, 13)) AS k)")
def ssa_L2_forecast(spark, sf_dir):
    return values(orders(spark, sf_dir, window=2).rforecast([[1]], 12), "series_id", "grp", "t")


@query(f"WITH {FLAGS}, {N_OF}, {WEIGHTS.format(L=40)} SELECT series_id, round(sum(w * (value / 1000) * (value / 1000)), 2) + 0.0 AS energy FROM s JOIN w USING (series_id, t) GROUP BY 1")
def sigma_energy(spark, sf_dir):
    s = S.monthly_quantity(spark, sf_dir).withColumn("value", F.col("value") / 1000)
    return SSA(s, window=40).decompose(vectors=False).groupBy("series_id").agg(rounded(F.sum(F.col("sigma") * F.col("sigma")), 2).alias("energy"))


@query(f"WITH {FLAGS} SELECT DISTINCT series_id, 1.0::DOUBLE AS total FROM s")
def contributions_total(spark, sf_dir):
    c = SSA(S.monthly_quantity(spark, sf_dir), window=40).contributions()
    return c.groupBy("series_id").agg(F.round(F.sum("contribution"), 9).alias("total"))


@query(f"WITH {FLAGS} SELECT series_id, 'all' AS grp, t, round(value, 4) + 0.0 AS value FROM s")
def reconstruct_all(spark, sf_dir):
    return values(SSA(S.monthly_quantity(spark, sf_dir), window=40).reconstruct({"all": range(1, 41)}), "series_id", "grp", "t", digits=4)


@query(f"WITH {FLAGS} SELECT series_id, t, 0.0::DOUBLE AS value FROM s")
def residuals_zero(spark, sf_dir):
    return values(SSA(S.monthly_quantity(spark, sf_dir), window=40).residuals({"a": range(1, 30), "b": range(10, 41)}), "series_id", "t", digits=4)


DFT = f"{MONTHS}, {N_OF}, f AS (SELECT k, any_value(n) AS n, power(sum(value * cos(2 * pi() * ((k * (t - 1)) % n) / n)), 2) + power(sum(value * sin(2 * pi() * ((k * (t - 1)) % n) / n)), 2) AS p FROM s JOIN n USING (series_id), (SELECT unnest(range(0, 80)) AS k) GROUP BY k)"


@query(f"WITH {DFT} SELECT 'orders' AS series_id, round(sqrt(p), 4) AS sigma FROM f")
def circular_sigma(spark, sf_dir):
    return orders(spark, sf_dir, window=80, circular=True, count=80).decompose(vectors=False).select("series_id", F.round("sigma", 4).alias("sigma"))


@query(f"WITH {DFT} SELECT 'orders' AS series_id, round(sqrt(p), 4) AS sigma FROM f")
def toeplitz_circular_sigma(spark, sf_dir):
    return orders(spark, sf_dir, kind="toeplitz", window=80, circular=True, count=80).decompose(vectors=False).select("series_id", F.round("sigma", 4).alias("sigma"))


@query(f"WITH {MONTHS} SELECT series_id, 'all' AS grp, t, round(value, 4) + 0.0 AS value FROM s")
def toeplitz_reconstruct_all(spark, sf_dir):
    return values(orders(spark, sf_dir, kind="toeplitz", window=24, count=24).reconstruct({"all": range(1, 25)}), "series_id", "grp", "t", digits=4)


CENTRE = f"""{MONTHS}, c AS (SELECT a.t AS j, avg(b.value) AS m FROM s a JOIN s b ON b.t BETWEEN a.t AND a.t + 23 WHERE a.t <= 57 GROUP BY 1)
SELECT 'orders' AS series_id, 'F1' AS grp, j + i AS t, round(avg(m), 6) + 0.0 AS value FROM c, (SELECT unnest(range(0, 24)) AS i) GROUP BY ALL"""


@query(f"WITH {CENTRE}")
def pssa_centering(spark, sf_dir):
    return values(orders(spark, sf_dir, window=24, column_projector="centering").reconstruct([[1]]), "series_id", "grp", "t")


@query(f"WITH {TWO_REC} SELECT 'orders' AS series_id, 'F1' AS grp, t, round(value, 6) + 0.0 AS value FROM rec")
def wossa_unit_weights(spark, sf_dir):
    return values(orders(spark, sf_dir, window=2, column_weight=[1.0, 1.0]).reconstruct([[1]]), "series_id", "grp", "t")


@query(f"WITH {MONTHS} SELECT series_id, 'all' AS grp, t, round(value, 4) + 0.0 AS value FROM s")
def wossa_reconstruct_all(spark, sf_dir):
    return values(orders(spark, sf_dir, window=12, column_weight=[1.0 + i / 12 for i in range(12)]).reconstruct({"all": range(1, 13)}), "series_id", "grp", "t", digits=4)


def flags_system(spark, sf_dir, **options) -> SSA:
    s = S.monthly_quantity(spark, sf_dir).select(F.lit("flags").alias("series_id"), F.col("series_id").alias("channel"), "t", "value")
    return SSA(s, kind="mssa", **options)


@query(f"WITH {FLAGS} SELECT 'flags' AS series_id, 'all' AS grp, series_id AS channel, t, round(value, 4) + 0.0 AS value FROM s")
def mssa_reconstruct(spark, sf_dir):
    return values(flags_system(spark, sf_dir, window=24, count=24).reconstruct({"all": range(1, 25)}), "series_id", "grp", "channel", "t", digits=4)


@query(f"WITH {FIELD} SELECT 'events' AS field_id, 'all' AS grp, i, j, coalesce(c, 0)::DOUBLE AS value FROM f LEFT JOIN o ON o.t = (j - 1) * 24 + i - 1")
def ssa2d_reconstruct(spark, sf_dir):
    m = SSA(S.event_field(spark, sf_dir), kind="nd", key="field_id", coords=("i", "j"), window=(4, 5), count=20)
    return values(m.reconstruct({"all": range(1, 21)}), "field_id", "grp", "i", "j")


@query(f"WITH {MONTHS} SELECT DISTINCT series_id, 'F' || a AS g1, 'F' || b AS g2, CASE WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE AS cor FROM s, (SELECT unnest(range(1, 6)) AS a), (SELECT unnest(range(1, 6)) AS b)")
def frobenius_identity(spark, sf_dir):
    return values(orders(spark, sf_dir, window=24, count=5).frobenius_cor(), "series_id", "g1", "g2", value="cor")


# --- analytic series whose answers are formulas ---

TREND_SINE = "exp(0.005 * t) + sin(2 * pi() * t / 7)"


def made(formula: str, a: int, b: int, head: str = "'x' AS series_id, 'F1' AS grp", digits: int = 6) -> str:
    return f"SELECT {head}, t, round({formula}, {digits}) + 0.0 AS value FROM (SELECT CAST(unnest(range({a}, {b} + 1)) AS BIGINT) AS t)"


def trend(spark, n: int = 150, **options) -> SSA:
    return SSA(S.analytic(spark, n, TREND_SINE), **({"window": 50} | options))


@query(made(TREND_SINE, 1, 150))
def finite_rank_reconstruct(spark, sf_dir):
    return values(trend(spark).reconstruct([[1, 2, 3]]), "series_id", "grp", "t")


@query(made(TREND_SINE, 151, 180))
def finite_rank_rforecast(spark, sf_dir):
    return values(trend(spark).rforecast([[1, 2, 3]], 30), "series_id", "grp", "t")


@query(made(TREND_SINE, -19, 0))
def finite_rank_rforecast_reverse(spark, sf_dir):
    return values(trend(spark).rforecast([[1, 2, 3]], 20, reverse=True), "series_id", "grp", "t")


@query(made(TREND_SINE, 151, 180))
def finite_rank_vforecast(spark, sf_dir):
    return values(trend(spark).vforecast([[1, 2, 3]], 30), "series_id", "grp", "t")


@query("SELECT * FROM (VALUES (round(exp(0.005), 6), 0.0::DOUBLE), (round(cos(2 * pi() / 7), 6), round(sin(2 * pi() / 7), 6)), (round(cos(2 * pi() / 7), 6), round(-sin(2 * pi() / 7), 6))) v(re, im)")
def esprit_roots(spark, sf_dir):
    return trend(spark).parestimate([[1, 2, 3]], solve="tls").select(rounded("root.re").alias("re"), rounded("root.im").alias("im"))


@query("SELECT 0 + 12.0::DOUBLE AS period")
def pairs_period(spark, sf_dir):
    m = SSA(S.analytic(spark, 120, "sin(2 * pi() * t / 12)"), window=60)
    return m.parestimate([[1, 2]], method="pairs").select(F.round("period", 6).alias("period"))


@query("SELECT round(exp(0.005), 6) AS re, 0.0::DOUBLE AS im, 1.005013::DOUBLE AS modulus")
def lrr_roots(spark, sf_dir):
    m = SSA(S.analytic(spark, 60, "exp(0.005 * t)"), window=2, count=1)
    return m.roots([[1]]).select(rounded("root.re").alias("re"), rounded("root.im").alias("im"), F.round("modulus", 6).alias("modulus"))


@query("SELECT 'x' AS series_id, * FROM (VALUES ('F1', [1]), ('F2', [2, 3])) v(grp, triples)")
def group_by_wcor(spark, sf_dir):
    return trend(spark).grouping_wcor([[1], [2], [3]], clusters=2)


@query("SELECT 'x' AS series_id, * FROM (VALUES ('F1', [1]), ('F2', [2, 3])) v(bin, triples)")
def group_by_pgram(spark, sf_dir):
    return trend(spark).grouping_pgram([[1], [2], [3]], bins=[0.1, 0.51]).drop("shares")


HOLES = "t between 60 and 66 or t in (90, 120)"


def holed(spark, window: int = 20) -> SSA:
    return SSA(S.analytic(spark, 150, TREND_SINE).withColumn("value", F.when(~F.expr(HOLES), F.col("value"))), window=window)


@query(made(TREND_SINE, 1, 150))
def gapfill_sequential(spark, sf_dir):
    return values(holed(spark).gapfill([[1, 2, 3]]), "series_id", "grp", "t")


@query(made(TREND_SINE, 1, 150))
def gapfill_simultaneous(spark, sf_dir):
    return values(holed(spark).gapfill([[1, 2, 3]], method="simultaneous"), "series_id", "grp", "t")


@query(made(TREND_SINE, 1, 150, digits=5))
def igapfill(spark, sf_dir):
    return values(holed(spark).igapfill([[1, 2, 3]], tolerance=1e-9), "series_id", "grp", "t", digits=5)


@query(made(TREND_SINE, 1, 150, "'x' AS series_id", 5))
def cadzow_fixed_point(spark, sf_dir):
    return values(trend(spark).cadzow(3), "series_id", "t", digits=5)


@query("SELECT 'x' AS series_id, 0.0::DOUBLE AS rate")
def high_rank_rate(spark, sf_dir):
    return values(trend(spark).high_rank_rate(3), "series_id", value="rate")


PARABOLA = "0.01 * t * t + 10 * sin(2 * pi() * t / 10)"


def parabola(spark) -> SSA:
    return SSA(S.analytic(spark, 100, PARABOLA), window=40, column_projector="centering", row_projector="centering")


@query(made(PARABOLA, 101, 120))
def pssa_rforecast(spark, sf_dir):
    return values(parabola(spark).rforecast([range(1, 6)], 20), "series_id", "grp", "t")


@query(made(PARABOLA, 101, 120))
def pssa_vforecast(spark, sf_dir):
    return values(parabola(spark).vforecast([range(1, 6)], 20), "series_id", "grp", "t")


@query(made("2 * t + 3", 1, 60))
def pssa_linear(spark, sf_dir):
    m = SSA(S.analytic(spark, 60, "cast(2 * t + 3 as double)"), window=20, column_projector="centering", row_projector="centering", count=2)
    return values(m.reconstruct([[1, 2]]), "series_id", "grp", "t")


WAVES = {"a": ("sin(2 * pi() * t / 11) * power(1.01, t)", 80), "b": ("cos(2 * pi() * t / 11) * power(1.01, t)", 70)}


def waves(spark, holes: str | None = None) -> SSA:
    parts = [S.analytic(spark, n, v).select("series_id", F.lit(c).alias("channel"), "t", "value") for c, (v, n) in WAVES.items()]
    df = parts[0].union(parts[1])
    return SSA(df if holes is None else df.withColumn("value", F.when(~F.expr(holes), F.col("value"))), kind="mssa", window=20 if holes else 30)


WAVES_NEXT = " UNION ALL ".join(f"({made(sql, n + 1, n + 15, f"'x' AS series_id, 'F1' AS grp, '{c}' AS channel")})" for c, (sql, n) in WAVES.items())
WAVES_ALL = " UNION ALL ".join(f"({made(sql, 1, n, f"'x' AS series_id, 'F1' AS grp, '{c}' AS channel", 5)})" for c, (sql, n) in WAVES.items())


def _wave_query(name: str, call: Callable[[SSA], DataFrame], sql: str, digits: int = 6) -> None:
    QUERIES[name] = lambda spark, sf_dir: values(call(waves(spark)), "series_id", "grp", "channel", "t", digits=digits)
    ORACLE_SQL[name] = sql


for _d in ("row", "column"):
    _wave_query(f"mssa_rforecast_{_d}", lambda m, d=_d: m.rforecast([[1, 2]], 15, direction=d), WAVES_NEXT)
    _wave_query(f"mssa_vforecast_{_d}", lambda m, d=_d: m.vforecast([[1, 2]], 15, direction=d), WAVES_NEXT)
_wave_query("mssa_predict", lambda m: m.predict([[1, 2]], 15), WAVES_NEXT)


@query(WAVES_ALL)
def mssa_gapfill(spark, sf_dir):
    return values(waves(spark, "t between 40 and 43").gapfill([[1, 2]]), "series_id", "grp", "channel", "t", digits=5)


@query(WAVES_ALL)
def mssa_igapfill(spark, sf_dir):
    return values(waves(spark, "t between 40 and 43").igapfill([[1, 2]], tolerance=1e-9), "series_id", "grp", "channel", "t", digits=5)


def signal(spark) -> SSA:
    value = "named_struct('re', cos(0.6 * t) + 0.5 * cos(1.7 * t), 'im', sin(0.6 * t) + 0.5 * sin(1.7 * t))"
    return SSA(S.analytic(spark, 60, value), kind="cssa", window=25)


CSSA_SQL = "SELECT 'x' AS series_id, 'F1' AS grp, t, round(cos(0.6 * t) + 0.5 * cos(1.7 * t), 6) + 0.0 AS re, round(sin(0.6 * t) + 0.5 * sin(1.7 * t), 6) + 0.0 AS im FROM (SELECT CAST(unnest(range({}, {})) AS BIGINT) AS t)"


def _parts(df: DataFrame) -> DataFrame:
    return df.select("series_id", "grp", "t", rounded("value.re").alias("re"), rounded("value.im").alias("im"))


@query(CSSA_SQL.format(1, 61))
def cssa_reconstruct(spark, sf_dir):
    return _parts(signal(spark).reconstruct([[1, 2]]))


@query(CSSA_SQL.format(61, 71))
def cssa_rforecast(spark, sf_dir):
    return _parts(signal(spark).rforecast([[1, 2]], 10))


@query("SELECT round(x, 6) AS frequency FROM (VALUES (0.6 / (2 * pi())), (1.7 / (2 * pi()))) v(x)")
def cssa_frequencies(spark, sf_dir):
    return signal(spark).parestimate([[1, 2]]).select(F.round("frequency", 6).alias("frequency"))


PLANE = "sin(2 * pi() * i / 5) * sin(2 * pi() * j / 8)"
GRID = "(SELECT CAST(unnest(range(1, {0} + 1)) AS BIGINT) AS i), (SELECT CAST(unnest(range(1, {1} + 1)) AS BIGINT) AS j)"


def unreached(rows: int, columns: int, window: np.ndarray) -> list[tuple[int, int]]:
    """Cells, from 1, of a field that no position of the window covers."""
    reached = np.zeros((rows, columns), bool)
    for a in range(rows - window.shape[0] + 1):
        for b in range(columns - window.shape[1] + 1):
            reached[a : a + window.shape[0], b : b + window.shape[1]] |= window
    return [(i + 1, j + 1) for i, j in np.argwhere(~reached).tolist()]


@query(f"SELECT 'f' AS field_id, 'F1' AS grp, i, j, round({PLANE}, 6) + 0.0 AS value FROM {GRID.format(30, 28)}")
def ssa2d_circle(spark, sf_dir):
    f = S.analytic_field(spark, 30, 28, PLANE)
    m = SSA(f, kind="nd", key="field_id", coords=("i", "j"), window=circle(6), count=6)
    cells = m.reconstruct([[1, 2, 3, 4]])
    # The SQL has all cells: only the corners that no circle reaches are filled by its formula, other nulls stay.
    corner = " or ".join(f"i = {i} and j = {j}" for i, j in unreached(30, 28, circle(6)))
    value = F.expr(f"case when value is null and ({corner}) then {PLANE} else value end")
    return cells.select("field_id", "grp", "i", "j", rounded(value).alias("value"))


@query("SELECT * FROM (VALUES ('1', 5.0::DOUBLE), ('1', 5.0), ('1', -5.0), ('1', -5.0), ('2', 8.0), ('2', 8.0), ('2', -8.0), ('2', -8.0)) v(dim, period)")
def ssa2d_periods(spark, sf_dir):
    f = S.analytic_field(spark, 30, 28, PLANE)
    m = SSA(f, kind="nd", key="field_id", coords=("i", "j"), window=(12, 11), count=6)
    return m.parestimate([[1, 2, 3, 4]]).select("dim", F.round("period", 5).alias("period"))


@query(f"SELECT 'f' AS field_id, 'F1' AS grp, i, j, k, round(sin(i + j + k), 6) + 0.0 AS value FROM {GRID.format(10, 9)}, (SELECT CAST(unnest(range(1, 9)) AS BIGINT) AS k)")
def ssa3d_reconstruct(spark, sf_dir):
    rows = spark.range(10 * 9 * 8).select(F.lit("f").alias("field_id"), (F.floor(F.col("id") / 72) + 1).alias("i"), (F.floor(F.col("id") / 8) % 9 + 1).alias("j"), (F.col("id") % 8 + 1).alias("k"))
    rows = rows.withColumn("value", F.sin((F.col("i") + F.col("j") + F.col("k")).cast("double")))
    m = SSA(rows, kind="nd", key="field_id", coords=("i", "j", "k"), window=(4, 4, 3), count=2)
    return values(m.reconstruct([[1, 2]]), "field_id", "grp", "i", "j", "k")


SINES = [(4, 0.05), (2, 0.06), (1, 0.07)]


@query(" UNION ALL ".join(f"({made(f'{a} * sin(2 * pi() * {f} * t)', 1, 150, f"'x' AS series_id, 'F{n}' AS grp", 4)})" for n, (a, f) in enumerate(SINES, 1)))
def iossa_separate(spark, sf_dir):
    m = SSA(S.analytic(spark, 150, " + ".join(f"{a} * sin(2 * pi() * {f} * t)" for a, f in SINES)), window=70, count=6)
    return values(m.iossa([[1, 2], [3, 4], [5, 6]], tolerance=1e-8, rounds=1000).reconstruct([[1, 2], [3, 4], [5, 6]]), "series_id", "grp", "t", digits=4)


def two_sines(spark) -> SSA:
    return SSA(S.analytic(spark, 150, "2 * sin(2 * pi() * t / 5) + 2 * sin(2 * pi() * t / 10)"), window=70, count=4)


@query(f"({made('2 * sin(2 * pi() * t / 5)', 1, 150)}) UNION ALL ({made('2 * sin(2 * pi() * t / 10)', 1, 150, "'x' AS series_id, 'F2' AS grp")})")
def fossa_separate(spark, sf_dir):
    return values(two_sines(spark).fossa([[1, 2, 3, 4]], normalize=False).reconstruct([[1, 2], [3, 4]]), "series_id", "grp", "t")


@query(f"({made('2 * sin(2 * pi() * t / 10)', 1, 150)}) UNION ALL ({made('2 * sin(2 * pi() * t / 5)', 1, 150, "'x' AS series_id, 'F2' AS grp")})")
def eossa_separate(spark, sf_dir):
    return values(two_sines(spark).eossa([[1, 2, 3, 4]]).reconstruct([[1, 2], [3, 4]]), "series_id", "grp", "t")


@query("SELECT 'x' AS series_id, a AS g1, b AS g2, CASE WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE AS owcor FROM (VALUES ('F1'), ('F2')) x(a), (VALUES ('F1'), ('F2')) y(b)")
def owcor_separated(spark, sf_dir):
    return values(two_sines(spark).fossa([[1, 2, 3, 4]], normalize=False).owcor([[1, 2], [3, 4]]), "series_id", "g1", "g2", value="owcor")


@query("SELECT 'x' AS series_id, CAST(b AS INTEGER) AS base_start, CAST(t AS INTEGER) AS test_start, 0.0::DOUBLE AS h FROM (SELECT unnest(range(1, 114)) AS b), (SELECT unnest(range(1, 114)) AS t)")
def hmatr_zero(spark, sf_dir):
    return values(trend(spark).hmatr(count=3), "series_id", "base_start", "test_start", value="h")


BOOT = f"SELECT 'x' AS series_id, 'F1' AS grp, t, round({TREND_SINE}, 5) + 0.0 AS mean, round({TREND_SINE}, 5) + 0.0 AS lower, round({TREND_SINE}, 5) + 0.0 AS upper FROM (SELECT CAST(unnest(range(151, 161)) AS BIGINT) AS t)"


@query(BOOT)
def bootstrap_zero_noise(spark, sf_dir):
    b = trend(spark, count=3).bforecast([[1, 2, 3]], 10, replicates=20)
    return b.select("series_id", "grp", "t", *[rounded(c, 5).alias(c) for c in ("mean", "lower", "upper")])


@query(f"SELECT 'x' AS series_id, 'F1' AS grp, t, CASE WHEN t > 150 THEN 'forecast' ELSE 'fitted' END AS part, round({TREND_SINE}, 6) + 0.0 AS mean FROM (SELECT CAST(unnest(range(1, 161)) AS BIGINT) AS t)")
def forecast_record(spark, sf_dir):
    return trend(spark).forecast([[1, 2, 3]], 10, method="vector").select("series_id", "grp", "t", "part", rounded("mean").alias("mean"))


@query()
def bootstrap_events(spark, sf_dir):
    """Intervals of hourly events, 100 replicates; random, so rows only."""
    m = SSA(S.regular(S.hourly_events(spark, sf_dir), 0.0), window=72, count=5)
    return m.bforecast([range(1, 6)], 24)


@query()
def trend_and_season(spark, sf_dir):
    """The flagship: trend and season of monthly orders."""
    return orders(spark, sf_dir, window=36).reconstruct({"trend": [1], "season": [2, 3]}, residual=True)


@query()
def event_types_trend(spark, sf_dir):
    """Many series at once, with gaps: trend of hourly events of each type."""
    return SSA(S.hourly_events(spark, sf_dir, by_type=True), window=24, count=6).reconstruct({"trend": [1]})


# --- long windows (iterative decompositions), kept fits, planned sizes, arithmetic ---


def long_trend(spark: SparkSession, **options) -> SSA:
    return SSA(S.analytic(spark, 1200, TREND_SINE.replace("0.005", "0.001")), window=600, **options)


LONG = f"SELECT 'x' AS series_id, 'F1' AS grp, t, round({TREND_SINE.replace('0.005', '0.001')}, 5) + 0.0 AS value FROM (SELECT CAST(unnest(range(1, 1201)) AS BIGINT) AS t)"


@query(LONG)
def lanczos_reconstruct(spark, sf_dir):
    return values(long_trend(spark, count=3).reconstruct([[1, 2, 3]]), "series_id", "grp", "t", digits=5)


@query(LONG)
def lanczos_weighted(spark, sf_dir):
    return values(long_trend(spark, count=3, column_weight=np.linspace(1, 2, 600)).reconstruct([[1, 2, 3]]), "series_id", "grp", "t", digits=5)


@query(LONG)
def lanczos_projected(spark, sf_dir):
    return values(long_trend(spark, count=4, column_projector="constant").reconstruct([range(1, 6)]), "series_id", "grp", "t", digits=5)


@query(LONG)
def kept_fit_reconstruct(spark, sf_dir):
    return values(long_trend(spark, count=3).precache().reconstruct([[1, 2, 3]]), "series_id", "grp", "t", digits=5)


@query(f"SELECT 'x' AS series_id, 'all' AS grp, t, round({TREND_SINE}, 5) + 0.0 AS value FROM (SELECT CAST(unnest(range(1, 151)) AS BIGINT) AS t)")
def planned_count_reconstruct(spark, sf_dir):
    return values(SSA(S.analytic(spark, 150, TREND_SINE), window=70).reconstruct({"all": range(1, 71)}), "series_id", "grp", "t", digits=5)


@query("SELECT 'x' AS series_id, 3 AS nu, 3 AS nv, 3 AS nsigma, 0 AS nspecial")
def triple_counts(spark, sf_dir):
    return trend(spark, count=3).counts()


@query(BOOT)
def prediction_zero_noise(spark, sf_dir):
    b = trend(spark, count=3).bforecast([[1, 2, 3]], 10, replicates=20, interval="prediction")
    return b.select("series_id", "grp", "t", *[rounded(c, 5).alias(c) for c in ("mean", "lower", "upper")])


@query(f"WITH {FLAGS} SELECT series_id, t, a.value - b.value AS value FROM s a FULL JOIN (SELECT series_id, t + 3 AS t, value FROM s) b USING (series_id, t)")
def series_difference(spark, sf_dir):
    s = S.monthly_quantity(spark, sf_dir)
    return R.arithmetic(s, s.withColumn("t", F.col("t") + 3), "-")


@query("SELECT 'x' AS series_id, true AS orthogonal")
def frobenius_orthogonal(spark, sf_dir):
    return trend(spark, count=3).frobenius_orthogonal([[1], [2, 3]]).select("series_id", "orthogonal")
