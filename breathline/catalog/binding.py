"""Views of the driver's tables in the shape of the clinical relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Roles of the event types in the measurement series.
OXYGEN, INSPIRED, PRESSURE = "purchase", "view", "signup"
ORIGIN, MIDPOINT = "2024-01-01", "2024-01-16"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def minutes_since(ts: Column, origin: str) -> Column:
    """Whole minutes since midnight of a day, the same in every session time zone."""
    days = F.date_diff(F.to_date(ts), F.lit(origin).cast("date"))
    return (days * 1440 + F.hour(ts) * 60 + F.minute(ts)).cast("bigint")


def day_number(ts: Column) -> Column:
    return F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date"))


def events_long(spark: SparkSession, folder: str, origin: str = ORIGIN) -> DataFrame:
    """Events as (stay_id, offset_min, name, value)."""
    return read(spark, folder, "events").select(
        F.col("user_id").alias("stay_id"),
        minutes_since(F.col("ts"), origin).alias("offset_min"),
        F.col("event_type").alias("name"),
        "value",
    )


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    wanted = set(columns)
    return df.select(*[F.round(c, digits).alias(c) if c in wanted else F.col(c) for c in df.columns])


# --- the same views in SQL -------------------------------------------------


def sql_events(origin: str = ORIGIN, name: str = "m") -> str:
    return f"""{name} AS (SELECT user_id AS stay_id,
  CAST(date_diff('day', DATE '{origin}', CAST(ts AS DATE)) * 1440 + hour(ts) * 60 + minute(ts) AS BIGINT) AS offset_min,
  event_type AS name, value FROM events)"""


def sql_pairs(source: str = "m", prefix: str = "", a: str = OXYGEN, b: str = INSPIRED) -> str:
    """Pairing of two series: one window per stay over the whole table."""
    return f"""{prefix}mm AS (SELECT stay_id, offset_min, max(value) FILTER (name = '{a}') AS a,
  max(value) FILTER (name = '{b}') AS b FROM {source} WHERE name IN ('{a}', '{b}') GROUP BY 1, 2),
{prefix}mean AS (SELECT stay_id, avg(a) FILTER (a > 1e-6) AS ma, avg(b) FILTER (b > 1e-6) AS mb
  FROM {prefix}mm GROUP BY 1),
{prefix}held AS (SELECT stay_id, offset_min, a, b, last_value(a IGNORE NULLS) OVER w AS ah,
  last_value(b IGNORE NULLS) OVER w AS bh, max(offset_min) OVER (PARTITION BY stay_id) AS lm
  FROM {prefix}mm WINDOW w AS (PARTITION BY stay_id ORDER BY offset_min ROWS UNBOUNDED PRECEDING)),
{prefix}pairs AS (SELECT stay_id, offset_min, pao2, fio2, pao2 / fio2 AS pf FROM (
  SELECT h.stay_id, h.offset_min, h.ah AS pao2,
    CASE WHEN h.bh < 1e-6 THEN CASE WHEN mb > 1 THEN mb / 100 ELSE mb END
         WHEN h.bh > 1 THEN h.bh / 100 ELSE h.bh END AS fio2
  FROM {prefix}held h JOIN {prefix}mean USING (stay_id)
  WHERE ma IS NOT NULL AND mb IS NOT NULL AND ah IS NOT NULL AND bh IS NOT NULL
    AND NOT (h.offset_min = h.lm AND (h.a IS NULL OR h.b IS NULL))))"""


def sql_onset(threshold: float, sustain: int, prefix: str = "") -> str:
    return f"""{prefix}runs AS (SELECT *, sum(CASE WHEN pf > {threshold} THEN 1 ELSE 0 END)
    OVER (PARTITION BY stay_id ORDER BY offset_min) AS g,
  row_number() OVER (PARTITION BY stay_id ORDER BY offset_min DESC) AS rd,
  count(*) OVER (PARTITION BY stay_id) AS n FROM {prefix}pairs),
{prefix}starts AS (SELECT *, min(CASE WHEN pf <= {threshold} THEN offset_min END)
    OVER (PARTITION BY stay_id, g) AS st FROM {prefix}runs),
{prefix}onset AS (SELECT stay_id,
  CAST(min(CASE WHEN pf <= {threshold} AND (offset_min - st >= {sustain}
       OR (rd = 1 AND (st < offset_min OR n = 1))) THEN offset_min END) AS BIGINT) AS onset,
  min(pf) AS min_pf,
  CAST(CASE WHEN min(pf) <= 100 THEN 1 WHEN min(pf) <= 200 THEN 2 WHEN min(pf) <= 300 THEN 3 ELSE 4 END
       AS INTEGER) AS severity,
  count(*) AS n_pairs FROM {prefix}starts GROUP BY 1)"""


def sql_half_even(x: str, digits: int) -> str:
    """Half-even rounding of a non-negative value in whole millionths."""
    micro, unit = f"CAST(round(({x}) * 1000000) AS BIGINT)", 10 ** (6 - digits)
    up = f"{micro} % {unit} > {unit // 2} OR ({micro} % {unit} = {unit // 2} AND ({micro} // {unit}) % 2 = 1)"
    return f"CAST((({micro} // {unit}) + CASE WHEN {up} THEN 1 ELSE 0 END) AS DOUBLE) / {10 ** digits}"
