"""Key files, key parsing, reports, artifacts and generated clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from keysift.functions import text
from keysift.plans import fixtures
from keysift.plans.catalog import sql
from keysift.plans.catalog.base import query
from keysift.session import scratch_path
from keysift.sources import artifacts, generators, keyfiles

ROWS_PER_FILE = 5000


@query(
    "scan_key_files",
    sql.with_keys("""
SELECT count(*) AS keys, count(DISTINCT key) AS distinct_keys, min(key) AS first_key, max(key) AS last_key, true AS gapless FROM K"""),
)
def scan_key_files(spark, sf_dir):
    path = scratch_path(spark, "keys")
    fixtures.keys_with_pos(spark, sf_dir).repartitionByRange("table_id", "pos").sortWithinPartitions("table_id", "pos").select(
        F.concat("key", F.lit("  ")).alias("value")
    ).write.option("maxRecordsPerFile", ROWS_PER_FILE).text(path)
    keys = keyfiles.scan_key_files(spark, f"{path}/part-*")
    tables = keys.groupBy("table_id").agg(
        (F.max("pos") + 1 == F.count_distinct("pos")).alias("gapless"), F.count("*").alias("n")
    ).agg(F.bool_and("gapless").alias("_g"))
    totals = keys.agg(
        F.count("*").alias("keys"), F.count_distinct("key").alias("distinct_keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key")
    )
    return totals.withColumn("gapless", tables.scalar())


@query(
    "small_tables",
    """
WITH O AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) <= 10),
R AS (SELECT o_custkey, CAST(row_number() OVER (ORDER BY o_custkey) - 1 AS INT) AS table_id FROM O)
SELECT table_id, count(*) AS keys, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM orders JOIN R USING (o_custkey) GROUP BY table_id""",
)
def small_tables(spark, sf_dir):
    orders = fixtures.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("key"))
    kept = keyfiles.small_tables(orders, 10)
    return kept.groupBy("table_id").agg(F.count("*").alias("keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query(
    "parse_key",
    f"WITH {fixtures.P.strip()}" + """
SELECT table_id, count(x0) AS parsed, sum(x0) AS id_sum, min(x0) AS id_min, sum(x1) AS block_sum, max(x1) AS block_max FROM P GROUP BY table_id""",
)
def parse_key(spark, sf_dir):
    rows = fixtures.keys(spark, sf_dir).withColumn("x", text.parse_key(F.col("key")))
    a, b = F.col("x")[0], F.col("x")[1]
    return rows.groupBy("table_id").agg(
        F.count(a).alias("parsed"), F.sum(a).alias("id_sum"), F.min(a).alias("id_min"), F.sum(b).alias("block_sum"), F.max(b).alias("block_max")
    )


@query(
    "strip_prefix",
    sql.with_keys("""
SELECT table_id, min(s) AS first_text, max(s) AS last_text, CAST(sum(length(s)) AS BIGINT) AS length_sum, count(DISTINCT s) AS texts
FROM (SELECT table_id, array_to_string(string_split(key, ':')[2:], ':') AS s FROM K
      UNION ALL SELECT table_id, '' FROM K) GROUP BY table_id"""),
)
def strip_prefix(spark, sf_dir):
    keys = fixtures.keys(spark, sf_dir)
    without_colon = keys.withColumn("key", F.regexp_replace("key", ":", ""))
    stripped = keys.unionByName(without_colon).withColumn("s", text.strip_prefix(F.col("key")))
    return stripped.groupBy("table_id").agg(
        F.min("s").alias("first_text"), F.max("s").alias("last_text"), F.sum(F.length("s")).alias("length_sum"),
        F.count_distinct("s").alias("texts"),
    )


@query(
    "numeric_tables",
    """
WITH N AS (SELECT o_custkey AS table_id, CASE o_orderstatus WHEN 'P' THEN 'P' || o_orderkey WHEN 'F' THEN o_orderkey || '.5' ELSE o_orderkey::VARCHAR END AS key FROM orders),
T AS (SELECT table_id, bool_and(TRY_CAST(key AS DOUBLE) IS NOT NULL) AS all_numeric, count(*) AS n FROM N GROUP BY table_id)
SELECT all_numeric, all_numeric AND n <> 1 AS trainable, count(*) AS tables, CAST(sum(n) AS BIGINT) AS keys, min(table_id) AS first_table FROM T GROUP BY ALL""",
)
def numeric_tables(spark, sf_dir):
    orders, key = fixtures.table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    text_key = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("P"), key)).when(
        F.col("o_orderstatus") == "F", F.concat(key, F.lit(".5"))
    ).otherwise(key)
    tables = numeric_profile(orders.select(F.col("o_custkey").alias("table_id"), text_key.alias("key")))
    return tables.groupBy("all_numeric", "trainable").agg(
        F.count("*").alias("tables"), F.sum("n").alias("keys"), F.min("table_id").alias("first_table")
    )


def numeric_profile(keys):
    """Per table: whether all keys are numbers, and whether a numeric model may be fitted."""
    flags = keys.groupBy("table_id").agg(F.bool_and(text.is_number(F.col("key"))).alias("all_numeric"), F.count("*").alias("n"))
    return flags.withColumn("trainable", F.col("all_numeric") & (F.col("n") != 1))


@query(
    "probe_guard",
    """
WITH N AS (SELECT o_custkey AS table_id, CASE o_orderstatus WHEN 'P' THEN '' WHEN 'F' THEN o_orderkey || 'x' ELSE o_orderkey::VARCHAR END AS key, CASE WHEN o_totalprice > 100000 THEN 1 ELSE -1 END AS answer FROM orders),
T AS (SELECT table_id FROM N GROUP BY table_id HAVING count(*) > 5)
SELECT CASE WHEN key = '' OR TRY_CAST(key AS DOUBLE) IS NULL OR t.table_id IS NULL THEN 0 ELSE answer END AS prediction, count(*) AS probes, min(key) AS first_key
FROM N LEFT JOIN T t USING (table_id) GROUP BY ALL""",
)
def probe_guard(spark, sf_dir):
    """Empty and non-numeric probes, and tables without a model (here: those with few keys), answer 0."""
    orders, key = fixtures.table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    text_key = F.when(F.col("o_orderstatus") == "P", F.lit("")).when(F.col("o_orderstatus") == "F", F.concat(key, F.lit("x"))).otherwise(key)
    answer = F.when(F.col("o_totalprice") > 100000, 1).otherwise(-1)
    probes = orders.select(F.col("o_custkey").alias("table_id"), text_key.alias("key"), answer.alias("answer"))
    fitted = probes.groupBy("table_id").agg(F.count("*").alias("n")).where("n > 5").select("table_id", F.lit(True).alias("has_model"))
    asked = probes.join(fitted, "table_id", "left")
    prediction = text.guarded_prediction(F.col("key"), F.when(F.col("has_model"), F.col("answer")))
    return asked.groupBy(prediction.alias("prediction")).agg(F.count("*").alias("probes"), F.min("key").alias("first_key"))


RATIOS = """
SELECT 'cf/table-' || lpad(table_id::VARCHAR, 5, '0') AS name, round(count(DISTINCT key)::DOUBLE / count(*), 6) AS ratio FROM K GROUP BY table_id"""


@query(
    "ratio_report",
    sql.with_keys(f""", R AS ({RATIOS})
SELECT row_number() OVER (ORDER BY name) AS line, name, ratio, (SELECT count(*) FROM R) AS lines,
       (SELECT min(ratio) FROM R) AS ratio_min, (SELECT max(ratio) FROM R) AS ratio_max FROM R"""),
)
def ratio_report(spark, sf_dir):
    ratios = fixtures.keys(spark, sf_dir).groupBy("table_id").agg(
        F.round(F.count_distinct("key") / F.count("*"), 6).alias("ratio")
    )
    name = F.concat(F.lit("cf/table-"), F.lpad(F.col("table_id").cast("string"), 5, "0"))
    path = scratch_path(spark, "ratios")
    keyfiles.write_lines(ratios.select("table_id", F.concat_ws(" ", name, F.col("ratio").cast("string")).alias("value")), path, ["table_id"])
    report = keyfiles.read_ratio_report(spark, path)
    totals = report.agg(F.count("*").alias("lines"), F.min("ratio").alias("lo"), F.max("ratio").alias("hi"))
    return (
        report.withColumn("lines", totals.select("lines").scalar())
        .withColumn("ratio_min", totals.select("lo").scalar())
        .withColumn("ratio_max", totals.select("hi").scalar())
    )


RUN_TOTALS = """
SELECT count(*) AS runs, round(sum(nu), 6) AS nu_sum, round(sum(fpr), 6) AS fpr_sum, CAST(sum(falsepositive_c) AS BIGINT) AS fp_c,
       CAST(sum(falsepositive_bf) AS BIGINT) AS fp_bf, CAST(sum(bfsize) AS BIGINT) AS bfsize FROM G"""


def run_totals(runs):
    return runs.agg(
        F.count("*").alias("runs"), F.round(F.sum("nu"), 6).alias("nu_sum"), F.round(F.sum("fpr"), 6).alias("fpr_sum"),
        F.sum("falsepositive_c").alias("fp_c"), F.sum("falsepositive_bf").alias("fp_bf"), F.sum("bfsize").alias("bfsize"),
    )


@query("obs_json", f"WITH {fixtures.G.strip()}{RUN_TOTALS}")
def obs_json(spark, sf_dir):
    path, runs = scratch_path(spark, "observations"), fixtures.runs(spark, sf_dir)
    artifacts.write_observation_json(runs, path, ["nu", "gamma", "tol"])
    return run_totals(artifacts.read_observation_json(spark, path, runs.schema))


@query("obs_csv", f"WITH {fixtures.G.strip()}{RUN_TOTALS}")
def obs_csv(spark, sf_dir):
    path, runs = scratch_path(spark, "observations"), fixtures.runs(spark, sf_dir).drop("error_train")
    artifacts.write_csv(runs, path)
    return run_totals(spark.read.schema(runs.schema).option("header", True).csv(path))


@query(
    "artifact_roundtrip",
    f"WITH {fixtures.G.strip()} SELECT gamma, tol, round(fpr, 6) AS fpr, size, bfsize FROM G WHERE nu = 0.05",
)
def artifact_roundtrip(spark, sf_dir):
    path, runs = scratch_path(spark, "artifacts"), fixtures.runs(spark, sf_dir)
    run = F.concat(F.lit("nu="), F.col("nu").cast("string"))
    artifacts.save_artifact(runs, path, run, artifacts.params_text("nu", "gamma", "tol"))
    loaded = artifacts.load_artifact(spark, path, "nu=0.05")
    return loaded.select("gamma", "tol", F.round("fpr", 6).alias("fpr"), "size", "bfsize")


def customers(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")


@query("gen_gauss_1d", "SELECT c_nationkey AS cluster, count(*) AS points, true AS near_centre, true AS right_spread FROM customer GROUP BY 1")
def gen_gauss_1d(spark, sf_dir):
    drawn = generators.with_gauss(customers(spark, sf_dir), "c_nationkey", 0.5, 0.1, row_id="c_custkey")
    return drawn.groupBy(F.col("c_nationkey").alias("cluster")).agg(
        F.count("*").alias("points"),
        (F.abs(F.avg("value") - 0.5 * F.first("c_nationkey")) < 0.6 / F.sqrt(F.count("*"))).alias("near_centre"),
        (F.stddev_pop("value") < 0.2).alias("right_spread"),
    )


@query("gen_gauss_2d", "SELECT c_nationkey AS cluster, count(*) AS points, true AS near_x, true AS near_y FROM customer GROUP BY 1")
def gen_gauss_2d(spark, sf_dir):
    drawn = generators.with_gauss_2d(customers(spark, sf_dir), "c_nationkey", 1.0, ((0.1, 0.0), (0.0, 1.0)), row_id="c_custkey")
    root, centre = F.sqrt(F.count("*")), F.first("c_nationkey")
    return drawn.groupBy(F.col("c_nationkey").alias("cluster")).agg(
        F.count("*").alias("points"),
        (F.abs(F.avg("x") - centre) < 6 * 0.32 / root).alias("near_x"),
        (F.abs(F.avg("y") - centre) < 6 / root).alias("near_y"),
    )


@query(
    "deal_clusters",
    """
WITH C AS (SELECT c_custkey, CAST(ntile(7) OVER (ORDER BY md5(c_custkey::VARCHAR || ':42')) - 1 AS INT) AS table_id FROM (SELECT DISTINCT c_custkey FROM customer))
SELECT table_id, count(*) AS orders, count(DISTINCT o_custkey) AS clusters, min(o_custkey) AS first_cluster
FROM orders JOIN C ON o_custkey = c_custkey GROUP BY table_id""",
)
def deal_clusters(spark, sf_dir):
    dealt = generators.deal_clusters(customers(spark, sf_dir), "c_custkey", 7)
    orders = fixtures.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return orders.join(dealt, "c_custkey").groupBy("table_id").agg(
        F.count("*").alias("orders"), F.count_distinct("c_custkey").alias("clusters"), F.min("c_custkey").alias("first_cluster")
    )
