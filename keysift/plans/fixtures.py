"""Key tables, points, texts and logs derived from the given tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysift.operators.ordering import grouped_row_number

TABLES = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of a few large splits; inputs with enough splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *df.columns) if df.rdd.getNumPartitions() < cores else df


def key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spread(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey"))
    owner = (F.col("l_suppkey") % TABLES).cast("int")
    key = F.concat_ws(
        ":",
        F.substring(F.md5(F.col("l_orderkey").cast("string")), 1, 4),
        F.col("l_partkey").cast("string"),
        F.lower(F.hex("l_orderkey")),
    )
    return source.select(owner.alias("table_id"), key.alias("key"), "l_orderkey", "l_partkey")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key tables without row positions: (table_id, key)."""
    return key_rows(spark, sf_dir).select("table_id", "key")


def keys_with_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key tables with the 0-based row position inside each table."""
    rows = key_rows(spark, sf_dir)
    return grouped_row_number(rows, ["table_id"], ["l_orderkey", "l_partkey"]).select("table_id", "pos", "key")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep observations from all line items: one run per (nu, gamma, tol)."""
    rows = table(spark, sf_dir, "lineitem")
    axes = [F.col("l_discount").alias("nu"), F.col("l_tax").alias("gamma"), F.col("l_quantity").alias("tol")]
    errors = [F.count_if(F.col("l_linenumber") == t).alias(f"_e{t}") for t in range(1, 8)]
    grouped = rows.groupBy(*axes).agg(
        F.count_if(F.expr("l_linenumber < 3")).alias("falsepositive_c"),
        F.count_if(F.expr("l_linenumber >= 3 and l_linenumber < 5")).alias("falsepositive_bf"),
        F.count("*").alias("_n"),
        F.sum("l_partkey").alias("size"),
        F.sum("l_suppkey").alias("bfsize"),
        *errors,
    )
    error_train = F.create_map(*[c for t in range(1, 8) for c in (F.lit(t), F.col(f"_e{t}"))])
    fpr = (F.col("falsepositive_c") + F.col("falsepositive_bf")) / F.col("_n")
    return grouped.withColumn("fpr", fpr).withColumn("error_train", error_train).select(
        "nu", "gamma", "tol", "fpr", "falsepositive_c", "falsepositive_bf", "error_train", "size", "bfsize"
    )


G = """
G AS (
  SELECT l_discount AS nu, l_tax AS gamma, l_quantity AS tol,
         (count(*) FILTER (l_linenumber < 5))::DOUBLE / count(*) AS fpr,
         count(*) FILTER (l_linenumber < 3) AS falsepositive_c,
         count(*) FILTER (l_linenumber >= 3 AND l_linenumber < 5) AS falsepositive_bf,
         count(*) AS errors, CAST(sum(l_partkey) AS BIGINT) AS size, CAST(sum(l_suppkey) AS BIGINT) AS bfsize
  FROM lineitem GROUP BY l_discount, l_tax, l_quantity)
"""

# SQL twins.  K holds the key tables with positions.
K = """
K AS (
  SELECT CAST(l_suppkey % 24 AS INT) AS table_id,
         row_number() OVER (PARTITION BY l_suppkey % 24 ORDER BY l_orderkey, l_partkey) - 1 AS pos,
         substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 4) || ':' || l_partkey || ':' || lower(to_hex(l_orderkey)) AS key
  FROM lineitem)
"""

# P holds the numeric points of the keys.
P = K.rstrip() + """,
P AS (
  SELECT table_id, pos, key, CAST(split_part(key, ':', 2) AS DOUBLE) AS x0,
         CAST(CAST('0x' || split_part(key, ':', 3) AS BIGINT) AS DOUBLE) AS x1
  FROM K)
"""


# --- storage log ---------------------------------------------------------------------------------

# Planted faults: (cf, week) of compactions that name inputs which do not exist.
MISSING_TABLE = [("cf1", 202403), ("cf3", 202405)]
MISSING_FAMILY = [("cf2", 202404), ("cf3", 202405)]


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A storage log from ``events``: signups and purchases flush, clicks and views read.

    The first error of a family's ISO week compacts the day tables since its previous compaction,
    and that compaction's output, into a week table.
    """
    source = table(spark, sf_dir, "events").select(
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("t"),
        F.col("event_id").alias("line_no"),
        F.concat(F.lit("cf"), (F.col("user_id") % 5).cast("string")).alias("cf"),
        F.get_json_object("props", "$.k").alias("key"),
        F.to_date("ts").alias("day"),
        (F.extract(F.lit("YEAROFWEEK"), "ts") * 100 + F.weekofyear("ts")).cast("int").alias("week"),
        "event_type",
    )
    no_inputs = F.lit(None).cast("array<string>")
    day_table = F.concat("cf", F.lit("/day-"), F.col("day").cast("string"))
    flushes = source.where("event_type IN ('signup', 'purchase')").select(
        F.lit("flush").alias("kind"), "t", "line_no", "cf", day_table.alias("table"), "key", no_inputs.alias("inputs")
    )
    reads = source.where("event_type IN ('click', 'view')").select(
        F.lit("read").alias("kind"), "t", "line_no", "cf", F.lit(None).cast("string").alias("table"), "key", no_inputs.alias("inputs")
    )
    first = source.where("event_type = 'error'").groupBy("cf", "week").agg(F.min(F.struct("t", "line_no", "day")).alias("e"))
    weeks = Window.partitionBy("cf").orderBy("week")  # one row per family and week
    steps = first.select("cf", "week", "e.t", "e.line_no", "e.day", F.lag("e.day").over(weeks).alias("since"))
    days = source.where("event_type IN ('signup', 'purchase')").select("cf", "day").distinct()
    inputs = days.withColumnRenamed("day", "d").join(steps, "cf").where("d < day AND (since IS NULL OR d >= since)")
    grouped = inputs.groupBy("cf", "week", "t", "line_no").agg(
        F.array_sort(F.collect_set(F.concat("cf", F.lit("/day-"), F.col("d").cast("string")))).alias("days")
    )
    previous = F.lag("week").over(weeks)
    named = grouped.withColumn("_p", previous)
    old = F.when(F.col("_p").isNotNull(), F.array(F.concat("cf", F.lit("/week-"), F.col("_p").cast("string")))).otherwise(F.array().cast("array<string>"))
    planted = F.array().cast("array<string>")
    for faults, name in ((MISSING_TABLE, F.concat("cf", F.lit("/missing"))), (MISSING_FAMILY, F.lit("cfx/day-1"))):
        for cf, week in faults:
            planted = F.when((F.col("cf") == cf) & (F.col("week") == week), F.concat(planted, F.array(name))).otherwise(planted)
    compactions = named.select(
        F.lit("compaction").alias("kind"), "t", "line_no", "cf", F.concat("cf", F.lit("/week-"), F.col("week").cast("string")).alias("table"),
        F.lit(None).cast("string").alias("key"), F.concat(old, "days", planted).alias("inputs"),
    )
    return flushes.unionByName(reads).unionByName(compactions)


def _pairs(pairs) -> str:
    return "(" + ", ".join(f"('{cf}', {week})" for cf, week in pairs) + ")"


# SQL twin of the log: FL flushes, RD reads, CP compactions with their fault flags, ED their inputs.
L = f"""
EV AS (SELECT event_id AS line_no, epoch_us(ts) AS t, 'cf' || (user_id % 5) AS cf, event_type, json_extract_string(props, '$.k') AS key, CAST(ts AS DATE) AS d,
              CAST(isoyear(ts) * 100 + week(ts) AS INT) AS wk FROM events),
FL AS (SELECT line_no, t, cf, cf || '/day-' || d AS tbl, key, d FROM EV WHERE event_type IN ('signup', 'purchase')),
RD AS (SELECT line_no, t, cf, key FROM EV WHERE event_type IN ('click', 'view')),
CE AS (SELECT cf, wk, min(t) AS t, arg_min(line_no, t) AS line_no, arg_min(d, t) AS d FROM EV WHERE event_type = 'error' GROUP BY cf, wk),
CS AS (SELECT *, lag(d) OVER (PARTITION BY cf ORDER BY wk) AS since FROM CE),
DI AS (SELECT DISTINCT c.cf, c.wk, c.t, c.line_no, f.tbl FROM CS c JOIN FL f ON f.cf = c.cf AND f.d < c.d AND (since IS NULL OR f.d >= since)),
CQ AS (SELECT cf, wk, t, line_no, lag(wk) OVER (PARTITION BY cf ORDER BY wk) AS pw,
              (cf, wk) IN {_pairs(MISSING_TABLE)} AS no_table, (cf, wk) IN {_pairs(MISSING_FAMILY)} AS no_family FROM (SELECT DISTINCT cf, wk, t, line_no FROM DI)),
CP AS (SELECT *, cf || '/week-' || wk AS output, sum(CASE WHEN no_table OR no_family THEN 1 ELSE 0 END) OVER w AS bad,
              coalesce(sum(CASE WHEN no_table OR no_family THEN 1 ELSE 0 END) OVER (PARTITION BY cf ORDER BY wk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad_before
       FROM CQ WINDOW w AS (PARTITION BY cf ORDER BY wk)),
ED AS (SELECT cf, wk, t, line_no, tbl AS input FROM DI UNION ALL SELECT cf, wk, t, line_no, cf || '/week-' || pw FROM CP WHERE pw IS NOT NULL)
"""

# LT lifetimes, CT contents of all tables, HT resolved reads.
L_STATE = L.rstrip() + """,
LT AS (SELECT x.cf, x.tbl, x.created, (SELECT min(e.t) FROM ED e WHERE e.input = x.tbl AND e.t > x.created) AS dropped
       FROM (SELECT cf, tbl, min(t) AS created FROM FL GROUP BY cf, tbl UNION ALL SELECT cf, output, t FROM CP WHERE bad = 0) x),
CT AS (SELECT cf, tbl, key, t AS held_at, t FROM FL
       UNION ALL SELECT c.cf, c.output, f.key, c.t, f.t FROM CP c JOIN FL f ON f.cf = c.cf AND c.bad = 0
         WHERE f.tbl IN (SELECT input FROM ED e WHERE e.cf = c.cf AND e.wk <= c.wk)),
HX AS (SELECT r.line_no, l.tbl, l.created FROM RD r JOIN (SELECT cf, tbl, key, min(held_at) AS held_at FROM CT GROUP BY cf, tbl, key) c ON c.cf = r.cf AND c.key = r.key AND c.held_at < r.t
       JOIN LT l ON l.cf = c.cf AND l.tbl = c.tbl AND l.created < r.t AND (l.dropped IS NULL OR l.dropped > r.t)),
HT AS (SELECT r.line_no, r.t, r.cf, r.key, h.tbl, h.created FROM RD r LEFT JOIN
       (SELECT line_no, arg_max(tbl, created) AS tbl, max(created) AS created FROM HX GROUP BY line_no) h USING (line_no))
"""
