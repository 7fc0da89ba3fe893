"""The model's contract: errors before jobs, column pruning, table functions, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.functions.sql import parsed, register
from lagweave.operators.model import SSA, named
from lagweave.plans.capabilities import NotCapable
from lagweave.sources import series as S
from lagweave.streaming.sliding import sliding_trend

TREND = "exp(0.005 * t) + sin(2 * pi() * t / 7)"


def test_errors_come_before_jobs(spark):
    df = S.analytic(spark, 30, TREND)
    with pytest.raises(NotCapable):
        SSA(df, kind="mssa", circular=True)
    with pytest.raises(NotCapable):
        SSA(df, kind="cssa").iossa([[1]])
    with pytest.raises(NotCapable):
        SSA(df, kind="mssa").bforecast()
    with pytest.raises(NotCapable):
        SSA(df, kind="toeplitz", column_projector="centering")
    with pytest.raises(NotCapable):
        SSA(df).owcor()
    with pytest.raises(ValueError):
        SSA(df, method="no such")
    with pytest.raises(ValueError):
        SSA(df, kind="2d")


def test_group_names():
    assert named([[1], [2, 3]], 9) == {"F1": [1], "F2": [2, 3]}
    assert named(None, 2) == {"F1": [1], "F2": [2]}
    assert parsed("trend=1;2,3") == {"trend": [1], "F2": [2, 3]}


def test_only_named_columns_reach_the_kernel(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.lit("x").alias("series_id"), F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("value"), "o_orderdate")
    plan = SSA(df).reconstruct([[1]])._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" not in plan.split("ReadSchema")[-1]


def test_empty_table_and_extra_columns(spark):
    df = S.analytic(spark, 30, TREND).withColumn("k", F.lit(1)).withColumn("grp", F.lit("z"))
    assert SSA(df.where("false")).reconstruct([[1]]).count() == 0
    assert SSA(df, window=10).reconstruct([[1]]).columns == ["series_id", "grp", "t", "value"]


def test_empty_group_is_zero(spark):
    rows = SSA(S.analytic(spark, 30, TREND), window=10).reconstruct({"none": []}).collect()
    assert {r.value for r in rows} == {0.0}


def test_null_and_absent_are_gaps(spark):
    df = S.analytic(spark, 60, TREND)
    a = SSA(df.where("t <> 30"), window=10).reconstruct([[1, 2, 3]]).orderBy("t").collect()
    b = SSA(df.withColumn("value", F.expr("if(t = 30, null, value)")), window=10).reconstruct([[1, 2, 3]]).orderBy("t").collect()
    assert [(r.t, r.value) for r in a] == [(r.t, r.value) for r in b] and a[29].value is None


def test_save_and_read(spark, tmp_path):
    m = SSA(S.analytic(spark, 40, TREND), window=12, count=3)
    m.save(str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3
    assert m.clone(count=2).decompose().count() == 2
    for what in ("values", "vectors", "paired", "series", "wcor", "roots"):
        assert m.plot_data(what).count() > 0


def test_table_functions(spark):
    register(spark)
    S.analytic(spark, 60, TREND).createOrReplaceTempView("s")
    got = spark.sql("SELECT * FROM ssa_reconstruct(TABLE(s) PARTITION BY (series_id) ORDER BY (t), 20, 'all=1,2,3') ORDER BY t").collect()
    t = np.arange(1, 61)
    np.testing.assert_allclose([r.value for r in got], np.exp(0.005 * t) + np.sin(2 * np.pi * t / 7), atol=1e-9)
    ahead = spark.sql("SELECT * FROM ssa_forecast(TABLE(s) PARTITION BY (series_id) ORDER BY (t), 20, '1,2,3', 5) ORDER BY t").collect()
    t = np.arange(61, 66)
    np.testing.assert_allclose([r.value for r in ahead], np.exp(0.005 * t) + np.sin(2 * np.pi * t / 7), atol=1e-8)
    assert spark.sql("SELECT * FROM ssa_roots(TABLE(s) PARTITION BY (series_id) ORDER BY (t), 20, '1,2,3')").count() == 3


def test_stream(spark, tmp_path):
    S.analytic(spark, 80, TREND).select("series_id", "t", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, t long, value double").parquet(str(tmp_path / "in"))
    q = sliding_trend(stream, 20, 3, 60).writeStream.format("memory").queryName("trend").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("trend").collect()[-1]
    assert r.t == 80 and abs(r.forecast - (np.exp(0.005 * 81) + np.sin(2 * np.pi * 81 / 7))) < 1e-6


def test_stream_with_a_long_hole(spark, tmp_path):
    t = [*range(1, 41), *range(10**12, 10**12 + 50)]
    rows = [("s", i, 2 + float(np.sin(2 * np.pi * (i % 7) / 7))) for i in t]
    spark.createDataFrame(rows, "series_id string, t long, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, t long, value double").parquet(str(tmp_path / "in"))
    q = sliding_trend(stream, 15, 3, 90).writeStream.format("memory").queryName("holes").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("holes").collect()[-1]
    assert r.t == t[-1] and r.trend == pytest.approx(rows[-1][2], abs=1e-8) and (r.forecast is None or np.isnan(r.forecast))


def noisy(n=120, seed=3):
    r = np.random.default_rng(seed)
    t = np.arange(1, n + 1)
    return 5 * np.sin(2 * np.pi * t / 12) + r.normal(size=n)


def table(spark, x, key="s"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(x, 1)], "series_id string, t long, value double")


def test_prediction_interval_adds_residual_quantiles(spark):
    df = table(spark, noisy())
    m = SSA(df, window=40)
    options = {"groups": [[1, 2]], "length": 6, "replicates": 20, "level": 0.9}
    plain = {r.t: r for r in m.bforecast(**options).collect()}
    wide = {r.t: r for r in m.bforecast(interval="prediction", **options).collect()}
    rest = np.array([r.value for r in m.residuals([[1, 2]]).collect()])
    low, high = np.quantile(rest, [0.05, 0.95])
    assert sorted(plain) == sorted(wide) == list(range(121, 127))
    for t, r in wide.items():
        assert r.mean == pytest.approx(plain[t].mean) and r.lower == pytest.approx(plain[t].lower + low) and r.upper == pytest.approx(plain[t].upper + high)
    whole = m.bforecast(only_new=False, **options).orderBy("t").collect()
    assert [r.t for r in whole] == list(range(1, 127)) and whole[-1].mean == pytest.approx(plain[126].mean)


def test_groups_plan_the_number_of_triples(spark):
    df = table(spark, noisy(150))
    rows = SSA(df, window=70).reconstruct({"all": range(1, 71)}).orderBy("t").collect()
    np.testing.assert_allclose([r.value for r in rows], noisy(150), atol=1e-8)
    with pytest.raises(Exception, match="eigentriple"):
        SSA(df, window=70).reconstruct([[90]]).collect()


def test_kept_fits_equal_new_ones(spark, tmp_path):
    df = table(spark, noisy(60)).union(table(spark, noisy(50, 5), "u"))
    m = SSA(df, window=20, column_projector="centering")
    kept = m.precache()
    m.save(str(tmp_path / "m"))
    again = SSA.load(spark, str(tmp_path / "m"), df)
    assert again.window == 20 and again.column_projector == "centering"
    for call in (lambda x: x.reconstruct([[1, 2]]), lambda x: x.rforecast([[1, 2, 3]], 5), lambda x: x.wcor([[1], [2]]), lambda x: x.counts()):
        rows = [sorted(map(str, ([round(v, 8) if isinstance(v, float) else v for v in r] for r in call(x).collect()))) for x in (m, kept, again)]
        assert rows[0] == rows[1] == rows[2]
    assert "FlatMapCoGroupsInPandas" in kept.reconstruct([[1]])._jdf.queryExecution().executedPlan().toString()
    assert kept.cleanup().stored is None
    nested = SSA(df, window=20).iossa([[1, 2], [3, 4]])
    one, two = (sorted((r.series_id, r.grp, r.t, round(r.value, 6)) for r in x.reconstruct([[1, 2]]).collect()) for x in (nested, nested.precache()))
    assert one == two
    signal = spark.createDataFrame([("c", i, (float(np.cos(i)), float(np.sin(i)))) for i in range(30)], "series_id string, t long, value struct<re: double, im: double>")
    c = SSA(signal, window=10, count=3)
    assert c.kind == "cssa"
    assert [r.value.re for r in c.precache().reconstruct([[1]]).orderBy("t").collect()] == pytest.approx([r.value.re for r in c.reconstruct([[1]]).orderBy("t").collect()])


def test_kinds_and_columns_are_told_before_jobs(spark):
    df = table(spark, noisy(40))
    assert SSA(df).kind == "1d" and SSA(df.withColumn("c", F.lit("a")), channel="c").kind == "mssa"
    assert SSA(df.withColumn("j", F.col("t")), coords=("t", "j")).kind == "nd"
    for bad in ({"kind": "cssa"}, {"value": "series_id"}, {"key": "none"}, {"kind": "mssa"}):
        with pytest.raises(ValueError):
            SSA(df, **bad).reconstruct([[1]])
    nested = SSA(df, window=10).iossa([[1], [2]])
    with pytest.raises(NotCapable):
        nested.decompose()
    with pytest.warns(UserWarning, match="F-orthogonal"):
        nested.wcor([[1], [2]])
    assert {r.orthogonal for r in SSA(df, window=10).frobenius_orthogonal([[1], [2]]).collect()} == {True}
    assert nested.triples().count() == 10 and not nested.capabilities()["decompose"] and SSA(df).capabilities()["decompose"]
    with pytest.warns(DeprecationWarning):
        assert SSA(df, window=10)["lambda"].columns == ["series_id", "k", "sigma"]
    assert SSA(df, window=10)["sig"].count() == 10 and SSA(df, window=10)["win"] == 10
    with pytest.raises(KeyError):
        SSA(df)["no"]


def test_grouping_and_plot_rows(spark):
    df = table(spark, noisy(60))
    m = SSA(df, window=20, count=6)
    assert m.grouping_auto(bins=[0.1, 0.51]).collect() == m.grouping_pgram(bins=[0.1, 0.51]).collect()
    assert m.grouping_auto("wcor", clusters=3).count() == 3
    assert [len(r.first) + len(r.second) for r in m.plot_data("tree").orderBy("step").collect()][-1] == 6
    assert {r.k: round(r.s, 9) for r in m.plot_data("pgram").groupBy("k").agg(F.sum("share").alias("s")).collect()}.keys() == set(range(1, 7))
    assert m.plot_data("reconstruction", [[1, 2]]).groupBy("grp").count().count() == 3
    assert m.plot_data("gaps").count() == 20
    both = [sorted(round(r.modulus, 6) for r in m.roots([[1, 2]], x).collect()) for x in ("companion", "polyroot")]
    assert both[0] == both[1]
