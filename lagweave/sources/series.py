"""Series, systems and fields from tables, and analytic ones, in the long form that models take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_number(date: Column) -> Column:
    """Months since the year 0."""
    return (F.year(date) * 12 + F.month(date)).cast("long")


def counted(rows: DataFrame, when: Column, key: Column | str = "x", value: Column | None = None) -> DataFrame:
    """(series_id, t, value): a count, or an exact sum, by the integer `when`; t as it is."""
    key = F.lit(key) if isinstance(key, str) else key
    total = F.count("*") if value is None else F.sum(value)
    return rows.groupBy(key.alias("series_id"), when.alias("t")).agg(total.cast("double").alias("value"))


def from_one(series: DataFrame) -> DataFrame:
    """t counted from 1 at the earliest of all series."""
    first = series.agg(F.min("t").alias("__first"))
    return series.crossJoin(F.broadcast(first)).select(*[c for c in series.columns if c != "t"], (F.col("t") - F.col("__first") + 1).alias("t"))


def regular(series: DataFrame, fill: float | None = None) -> DataFrame:
    """A row for each t between a series' first and last, null or `fill` where there was none."""
    span = series.groupBy("series_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = span.select("series_id", F.explode(F.sequence("a", "b")).alias("t"))
    value = F.col("value") if fill is None else F.coalesce("value", F.lit(fill))
    return grid.join(series, ["series_id", "t"], "left").select("series_id", "t", value.alias("value"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_one(counted(table(spark, sf_dir, "orders"), month_number(F.col("o_orderdate")), "orders"))


def monthly_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each return flag; quantities are whole numbers, so sums are exact."""
    return from_one(counted(table(spark, sf_dir, "lineitem"), month_number(F.col("l_shipdate")), F.col("l_returnflag"), F.col("l_quantity")))


def hourly_events(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    hour = F.floor(F.unix_timestamp("ts") / 3600).cast("long")
    return from_one(counted(table(spark, sf_dir, "events"), hour, F.col("event_type") if by_type else "events"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_one(counted(table(spark, sf_dir, "orders"), F.unix_date(F.to_date("o_orderdate")).cast("long"), "orders"))


def event_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_id, i, j, value): events by hour of the day and day, 0 where there was none."""
    hour = hourly_events(spark, sf_dir)
    cells = hour.select((F.pmod(F.col("t") - 1, F.lit(24)) + 1).alias("i"), (F.floor((F.col("t") - 1) / 24) + 1).alias("j"), "value")
    last = cells.agg(F.max("j").alias("m"))
    grid = last.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("j")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(24).cast("long"))))
    return grid.join(cells, ["i", "j"], "left").select(F.lit("events").alias("field_id"), "i", "j", F.coalesce("value", F.lit(0.0)).alias("value"))


def analytic(spark: SparkSession, n: int, value: str, name: str = "x", start: int = 1) -> DataFrame:
    """(series_id, t, value) with value a SQL expression of t."""
    rows = spark.range(start, start + n).select(F.lit(name).alias("series_id"), F.col("id").alias("t"))
    return rows.withColumn("value", F.expr(value))


def analytic_field(spark: SparkSession, n: int, m: int, value: str) -> DataFrame:
    rows = spark.range(n * m).select(F.lit("f").alias("field_id"), (F.floor(F.col("id") / m) + 1).alias("i"), (F.col("id") % m + 1).alias("j"))
    return rows.withColumn("value", F.expr(value))


def timed(rows: DataFrame, start: str, unit: str) -> DataFrame:
    """rows with ts, the time of t: t = 1 is `start`, steps are months, days, hours, minutes or seconds.

    Forecasts carry on t, and backward ones go below 1, so their times follow."""
    at = F.to_timestamp(F.lit(start))
    if unit == "month":
        first = F.to_date(at)
        return rows.withColumn("ts", F.to_timestamp(F.add_months(first, (F.col("t") - 1).cast("int"))))
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]
    return rows.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(at) + (F.col("t") - 1) * seconds))
