"""Storage logs: parsing, table lifetimes, compaction lineage and read resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from keysift.operators.occ import rp
from keysift.plans import fixtures, storage_log
from keysift.plans.catalog import sql
from keysift.plans.catalog.base import query
from keysift.plans.catalog.model_queries import intervals_sql
from keysift.session import materialize, scratch_path
from keysift.sources import logs

LOG = f"WITH {fixtures.L.strip()}"
STATE = f"WITH {fixtures.L_STATE.strip()}"


def events(spark, sf_dir):
    return fixtures.log_events(spark, sf_dir)


def registry(spark, sf_dir):
    return storage_log.resolve(events(spark, sf_dir))


def micros(moment: str):
    return F.col(f"{moment}.t")


# --- parsing ---------------------------------------------------------------------------------------


def clock():
    """Time of day of ``t`` as ``HH:MM:SS,mmm``, in the log's own clock."""
    parts = [F.expr(f"t div {unit} % {size}") for unit, size in ((3_600_000_000, 24), (60_000_000, 60), (1_000_000, 60), (1000, 1000))]
    return F.format_string("%02d:%02d:%02d,%03d", *parts)


CLOCK_SQL = "strftime(make_timestamp(t), '%H:%M:%S.%g')"


def written_lines(spark, rows, name: str):
    path = scratch_path(spark, name)
    rows.write.text(path)
    return spark.read.text(path)


@query("parse_flush_log", LOG + f" SELECT {CLOCK_SQL} AS time, cf, '/data/' || tbl AS \"table\", key, count(*) AS lines FROM FL GROUP BY ALL")
def parse_flush_log(spark, sf_dir):
    rows = events(spark, sf_dir).where("kind = 'flush'")
    line = logs.render_flush(clock(), F.col("key"), F.concat(F.lit("/data/"), F.col("table")), F.col("line_no") % 2 == 1)
    parsed = logs.parse_flush_log(written_lines(spark, rows.select(line.alias("value")), "flush-log"))
    return parsed.groupBy("time", "cf", "table", "key").agg(F.count("*").alias("lines"))


@query(
    "parse_read_log",
    LOG + f" SELECT {CLOCK_SQL} AS time, cf, key, false AS broken, count(*) AS lines FROM RD WHERE key <> '13' GROUP BY ALL UNION ALL SELECT NULL, NULL, NULL, true, count(*) FROM RD WHERE key = '13'",
)
def parse_read_log(spark, sf_dir):
    """Reads of one key are cut short on purpose: such lines are kept and flagged, nothing aborts."""
    rows = events(spark, sf_dir).where("kind = 'read'")
    line = logs.render_read(clock(), F.col("cf"), F.col("key"))
    cut = F.when(F.col("key") == "13", F.lit("'broken line'")).otherwise(line)
    parsed = logs.parse_read_log(written_lines(spark, rows.select(cut.alias("value")), "read-log"))
    return parsed.groupBy("time", "cf", "key", F.col("_corrupt").isNotNull().alias("broken")).agg(F.count("*").alias("lines"))


@query(
    "parse_compaction_log",
    LOG + f"""
SELECT {CLOCK_SQL} AS time, '/data/' || output AS "table", (SELECT count(*) FROM ED e WHERE e.line_no = c.line_no) + no_table::INT + no_family::INT AS inputs,
       (SELECT min('/data/' || input) FROM ED e WHERE e.line_no = c.line_no) AS first_input FROM CP c""",
)
def parse_compaction_log(spark, sf_dir):
    rows = events(spark, sf_dir).where("kind = 'compaction'")
    full = lambda p: F.concat(F.lit("/data/"), p)
    line = logs.render_compaction(clock(), F.transform("inputs", full), full(F.col("table")))
    parsed = logs.parse_compaction_log(written_lines(spark, rows.select(line.alias("value")), "compaction-log"))
    day_or_week = F.filter("inputs", lambda p: ~p.contains("missing") & ~p.contains("cfx"))
    return parsed.select("time", "table", F.size("inputs").cast("bigint").alias("inputs"), F.array_min(day_or_week).alias("first_input"))


# --- tables ------------------------------------------------------------------------------------------


@query(
    "merge_logs",
    LOG + """,
M AS (SELECT 'flush' AS kind, 0 AS k, t, line_no, cf FROM FL UNION ALL SELECT 'read', 1, t, line_no, cf FROM RD UNION ALL SELECT 'compaction', 2, t, line_no, cf FROM CP)
SELECT cf, kind, line_no, row_number() OVER (PARTITION BY cf ORDER BY t, k, line_no) - 1 AS seq FROM M""",
)
def merge_logs(spark, sf_dir):
    return storage_log.merge_logs(events(spark, sf_dir)).select("cf", "kind", "line_no", "seq")


@query(
    "flush_contents",
    LOG + " SELECT cf, tbl AS \"table\", min(t) AS created, count(*) AS keys, count(DISTINCT key) AS distinct_keys, arg_min(key, t) AS first_key, arg_max(key, t) AS last_key FROM FL GROUP BY cf, tbl",
)
def flush_contents(spark, sf_dir):
    rows = storage_log.flush_rows(events(spark, sf_dir))
    return rows.groupBy("cf", "table").agg(
        F.min("ord.t").alias("created"), F.count("*").alias("keys"), F.count_distinct("key").alias("distinct_keys"),
        F.min_by("key", "ord").alias("first_key"), F.max_by("key", "ord").alias("last_key"),
    )


@query("table_lifetimes", STATE + " SELECT cf, tbl AS \"table\", 0 AS incarnation, created, dropped FROM LT")
def table_lifetimes(spark, sf_dir):
    spans = registry(spark, sf_dir).lifetimes
    return spans.select("cf", "table", "incarnation", micros("created").alias("created"), micros("dropped").alias("dropped"))


@query(
    "compaction_contents",
    STATE + """
SELECT cf, tbl AS "table", count(*) AS keys, count(DISTINCT key) AS distinct_keys, arg_min(key, t) AS first_key, arg_max(key, t) AS last_key FROM CT WHERE tbl LIKE '%/week-%' GROUP BY cf, tbl""",
)
def compaction_contents(spark, sf_dir):
    rows = storage_log.compaction_contents(registry(spark, sf_dir))
    place = F.struct("path", "ord")
    return rows.groupBy("cf", "table").agg(
        F.count("*").alias("keys"), F.count_distinct("key").alias("distinct_keys"),
        F.min_by("key", place).alias("first_key"), F.max_by("key", place).alias("last_key"),
    )


@query(
    "compaction_outcomes",
    LOG + """
SELECT CASE WHEN bad = 0 THEN 'ok' WHEN no_family AND (no_table OR bad_before > 0) THEN 'missing_both' WHEN no_family THEN 'missing_cf' ELSE 'missing_table' END AS outcome,
       count(*) AS compactions FROM CP GROUP BY ALL""",
)
def compaction_outcomes(spark, sf_dir):
    return registry(spark, sf_dir).outcomes.groupBy("outcome").agg(F.count("*").alias("compactions"))


@query(
    "live_tables",
    STATE + """,
X AS (SELECT r.line_no, l.cf, l.tbl, row_number() OVER (PARTITION BY r.line_no ORDER BY l.created DESC) - 1 AS newest FROM RD r JOIN LT l ON l.cf = r.cf AND l.created < r.t AND (l.dropped IS NULL OR l.dropped > r.t))
SELECT cf, tbl AS "table", CAST(newest AS INT) AS newest, count(*) AS reads FROM X GROUP BY ALL""",
)
def live_tables(spark, sf_dir):
    return storage_log.live_tables(registry(spark, sf_dir)).groupBy("cf", "table", "newest").agg(F.count("*").alias("reads"))


@query("read_hits", STATE + " SELECT line_no, cf, key, tbl AS \"table\" FROM HT")
def read_hits(spark, sf_dir):
    return storage_log.read_hits(registry(spark, sf_dir)).select("line_no", "cf", "key", "table")


COUNTERS = """ SELECT cf, count(*) AS reads, count(*) FILTER (start < t) AS cf_known, count(tbl) AS found, count(*) FILTER (start < t AND tbl IS NULL) AS not_found,
count(*) FILTER (start IS NULL OR start >= t) AS cf_unknown FROM HT LEFT JOIN (SELECT cf, min(created) AS start FROM LT GROUP BY cf) USING (cf) GROUP BY cf"""


@query("read_counters", STATE + COUNTERS)
def read_counters(spark, sf_dir):
    state = registry(spark, sf_dir)
    return storage_log.read_counters(state, storage_log.read_hits(state), ["cf"])


@query(
    "distinct_hit_ratio",
    STATE + """
SELECT h.cf, h.tbl AS "table", count(*) AS hits, count(DISTINCT key) AS distinct_hits, any_value(size) AS size, round(count(DISTINCT key)::DOUBLE / any_value(size), 6) AS distinct_ratio, round(count(*)::DOUBLE / any_value(size), 6) AS hit_ratio
FROM HT h JOIN (SELECT tbl, count(*) AS size FROM CT GROUP BY tbl) s USING (tbl) GROUP BY h.cf, h.tbl""",
)
def distinct_hit_ratio(spark, sf_dir):
    state = registry(spark, sf_dir)
    ratios = storage_log.hit_ratios(state, storage_log.read_hits(state)).drop("incarnation")
    return ratios.withColumn("distinct_ratio", F.round("distinct_ratio", 6)).withColumn("hit_ratio", F.round("hit_ratio", 6))


# --- filters and models along the log -----------------------------------------------------------------

RATE, CAPACITY = 0.1, 50
SLICES = sql.slices(RATE)
FILTERS = STATE + f""",
FP AS (SELECT tbl, {sql.per_slice('n', RATE)} AS bps FROM (SELECT tbl, CASE WHEN tbl LIKE '%/week-%' THEN count(*) ELSE {CAPACITY} END AS n FROM CT GROUP BY tbl)),
FB AS (SELECT tbl, s * bps + spots[s + 1] AS bit, min(held_at) AS set_at FROM
        (SELECT c.tbl, c.held_at, p.bps, {sql.positions('c.key', RATE, 'p.bps')} AS spots FROM (SELECT tbl, key, min(held_at) AS held_at FROM CT GROUP BY tbl, key) c JOIN FP p USING (tbl)), range({SLICES}) r(s) GROUP BY ALL),
PR AS (SELECT h.line_no, h.t, h.cf, h.key, l.tbl, l.tbl = h.tbl AS is_hit FROM HT h JOIN LT l ON l.cf = h.cf AND l.created < h.t AND (l.dropped IS NULL OR l.dropped > h.t) AND l.created >= h.created),
YF AS (SELECT tbl, key, max(set_at) AS yes_from FROM
        (SELECT q.tbl, q.key, s * bps + spots[s + 1] AS bit FROM (SELECT DISTINCT p.tbl, p.key, f.bps, {sql.positions('p.key', RATE, 'f.bps')} AS spots FROM PR p JOIN FP f USING (tbl)) q, range({SLICES}) r(s)) q
        JOIN FB USING (tbl, bit) GROUP BY tbl, key HAVING count(*) = {SLICES}),
WR AS (SELECT cf, tbl, count(*) AS fp, max(t) AS last FROM PR JOIN YF USING (tbl, key) WHERE NOT is_hit AND yes_from < t GROUP BY cf, tbl)"""


@query("log_filter_fp", FILTERS + " SELECT w.cf, w.tbl AS \"table\", any_value(fp) AS fp, count(*) AS size FROM WR w JOIN CT c ON c.tbl = w.tbl AND c.held_at < w.last GROUP BY w.cf, w.tbl")
def log_filter_fp(spark, sf_dir):
    state = registry(spark, sf_dir)
    resolved = materialize(storage_log.read_hits(state))
    return storage_log.log_filter_fp(state, resolved, RATE, CAPACITY).drop("incarnation")


@query(
    "fp_tp_ratio",
    FILTERS + " SELECT cf, tbl AS \"table\", fp, tp, round(fp::DOUBLE / tp, 6) AS ratio FROM WR JOIN (SELECT tbl, count(*) AS tp FROM HT WHERE tbl IS NOT NULL GROUP BY tbl) USING (tbl)",
)
def fp_tp_ratio(spark, sf_dir):
    state = registry(spark, sf_dir)
    resolved = materialize(storage_log.read_hits(state))
    wrong = storage_log.log_filter_fp(state, resolved, RATE, CAPACITY)
    return storage_log.fp_tp_ratio(wrong, resolved).select("cf", "table", "fp", "tp", F.round("ratio", 6).alias("ratio"))


MODEL = rp.RPParams(D=2, epsilon=0.05, agg_thr=0.5, box_thr=0.2)
AXES = rp.unit_planes(2, 1).tolist()


@query(
    "log_model_outcomes",
    FILTERS + """,
J AS (""" + " UNION ALL ".join(f"SELECT tbl, {d} AS dim, CAST(key AS DOUBLE) * {w[0]!r}::DOUBLE AS v FROM CT" for d, w in enumerate(AXES)) + ")"
    + intervals_sql(MODEL, group="tbl, dim") + """,
QJ AS (""" + " UNION ALL ".join(f"SELECT DISTINCT tbl, key, {d} AS dim, CAST(key AS DOUBLE) * {w[0]!r}::DOUBLE AS v FROM PR" for d, w in enumerate(AXES)) + """),
QH AS (SELECT q.tbl, q.key, count(i.lo) > 1 AS accepted FROM QJ q LEFT JOIN I i ON i.tbl = q.tbl AND i.dim = q.dim AND i.lo < v AND v < i.hi GROUP BY q.tbl, q.key)
SELECT cf, p.tbl AS "table", count(*) FILTER (accepted AND NOT is_hit) AS fp, count(*) FILTER (NOT accepted AND yes_from < t) AS fn
FROM PR p JOIN QH q ON q.tbl = p.tbl AND q.key = p.key LEFT JOIN YF y ON y.tbl = p.tbl AND y.key = p.key GROUP BY cf, p.tbl""",
)
def log_model_outcomes(spark, sf_dir):
    state = registry(spark, sf_dir)
    resolved = materialize(storage_log.read_hits(state))
    return storage_log.log_model_outcomes(state, resolved, MODEL, RATE, CAPACITY).drop("incarnation")


@query(
    "normalize_table_name",
    "SELECT 'cf' || (user_id % 5) || '-ic-' || event_type AS name, count(*) AS tables FROM events GROUP BY ALL",
)
def normalize_table_name(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "events")
    name = F.concat(F.lit("cf"), (F.col("user_id") % 5).cast("string"), F.lit("-ic-tmp-"), F.col("event_type"))
    named = rows.select(name.alias("name"))
    return named.select(logs.normalize_table_name(F.col("name")).alias("name")).groupBy("name").agg(F.count("*").alias("tables"))


@query(
    "cf_policy",
    LOG + """ SELECT cf, cf = 'cf0' AS use_filter, cf IN ('cf0', 'cf1') AS use_model, count(*) AS tables, CAST(sum(n) AS BIGINT) AS keys FROM (SELECT cf, tbl, count(*) AS n FROM FL GROUP BY cf, tbl) GROUP BY cf""",
)
def cf_policy(spark, sf_dir):
    """Filters for one family, models for two; the others use neither."""
    rows = storage_log.flush_rows(events(spark, sf_dir))
    policy = rows.select("cf").distinct().where("cf IN ('cf0', 'cf1')").select(
        "cf", (F.col("cf") == "cf0").alias("use_filter"), F.lit(True).alias("use_model")
    )
    tables = rows.groupBy("cf", "table").agg(F.count("*").alias("n"))
    return storage_log.apply_policy(tables, policy).groupBy("cf", "use_filter", "use_model").agg(
        F.count("*").alias("tables"), F.sum("n").alias("keys")
    )
