"""Membership filters, exact membership and key overlap on the key tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.operators import bloom, overlap, scalable_bloom
from keysift.plans import evaluation, fixtures
from keysift.plans.catalog import sql
from keysift.plans.catalog.base import query
from keysift.session import scratch_path

RATE = 0.1
BY = ["table_id"]


def plain(spark: SparkSession, sf_dir: str, rate: float = RATE):
    keys = fixtures.keys(spark, sf_dir)
    return keys, bloom.plain_filters(keys, BY, rate)


def word_profile(filters: bloom.FilterSet) -> DataFrame:
    """Set bits and their sum per 64-bit word: a short fingerprint of the whole filter."""
    bits = bloom.words_to_bits(filters.words, BY)
    return bits.groupBy("table_id", F.expr("bit div 64").alias("word")).agg(
        F.count("*").alias("ones"), F.sum("bit").alias("bit_sum")
    )


WORD_PROFILE_SQL = """
SELECT table_id, bit // 64 AS word, count(*) AS ones, CAST(sum(bit) AS BIGINT) AS bit_sum FROM {bits} GROUP BY ALL"""

RATES = [0.1, 0.001, 0.0001]


@query(
    "bloom_size",
    sql.with_keys("""
SELECT table_id, error_rate, count(*) AS capacity, CAST(ceil(log2(1 / error_rate)) AS INT) AS num_slices,
       CAST(ceil(count(*) * abs(ln(error_rate)) / (ceil(log2(1 / error_rate)) * (ln(2.0) * ln(2.0)))) AS BIGINT) AS bits_per_slice,
       CAST(ceil(log2(1 / error_rate)) * ceil(count(*) * abs(ln(error_rate)) / (ceil(log2(1 / error_rate)) * (ln(2.0) * ln(2.0)))) AS BIGINT) AS num_bits
FROM K, (SELECT unnest([0.1::DOUBLE, 0.001::DOUBLE, 0.0001::DOUBLE]) AS error_rate) GROUP BY table_id, error_rate"""),
)
def bloom_size(spark, sf_dir):
    counts = fixtures.keys(spark, sf_dir).groupBy("table_id").agg(F.count("*").alias("capacity"))
    rated = counts.withColumn("error_rate", F.explode(F.array(*map(F.lit, RATES))))
    return bloom.with_filter_size(rated, F.col("capacity"), F.col("error_rate"))


def _positions_sql(rate: float) -> str:
    return f"""
SELECT table_id, {rate!r}::DOUBLE AS error_rate, s AS slice, count(*) AS keys, CAST(sum(spots[s + 1]) AS BIGINT) AS position_sum,
       max(spots[s + 1]) AS position_max
FROM (SELECT k.table_id, {sql.positions('k.key', rate, 'p.bps')} AS spots
      FROM K k JOIN (SELECT table_id, {sql.per_slice('count(*)', rate)} AS bps FROM K GROUP BY table_id) p USING (table_id)),
     range({sql.slices(rate)}) r(s) GROUP BY ALL"""


@query("bloom_positions", sql.with_keys(" UNION ALL ".join(_positions_sql(r) for r in RATES)))
def bloom_positions(spark, sf_dir):
    keys = fixtures.keys(spark, sf_dir)
    counts = keys.groupBy("table_id").agg(F.count("*").alias("capacity"))
    parts = []
    for rate in RATES:  # a fixed list of error rates: md5, sha1 and sha256 cases
        bits = bloom.key_bits(keys, bloom.size_filters(counts, BY, rate), BY, rate)
        parts.append(
            bits.groupBy("table_id", "slice")
            .agg(F.count("*").alias("keys"), F.sum("position").alias("position_sum"), F.max("position").alias("position_max"))
            .withColumn("error_rate", F.lit(rate))
            .withColumn("slice", F.col("slice").cast("bigint"))
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("bloom_build", sql.with_keys(sql.filter_ctes(RATE) + WORD_PROFILE_SQL.format(bits="FB")))
def bloom_build(spark, sf_dir):
    return word_profile(plain(spark, sf_dir)[1])


@query(
    "bloom_count",
    sql.with_keys(
        sql.filter_ctes(RATE)
        + f""",
S AS (SELECT table_id, bit, min(pos) AS pos FROM (
  SELECT table_id, pos, s * bps + spots[s + 1] AS bit
  FROM (SELECT k.table_id, k.pos, p.bps, {sql.positions('k.key', RATE, 'p.bps')} AS spots FROM K k JOIN FP p USING (table_id)),
       range({sql.slices(RATE)}) r(s)) GROUP BY table_id, bit)
SELECT table_id, n AS capacity, count(DISTINCT pos) AS count, count(DISTINCT pos) > n AS over_capacity
FROM S JOIN FP USING (table_id) GROUP BY table_id, n"""
    ),
)
def bloom_count(spark, sf_dir):
    keys = fixtures.keys_with_pos(spark, sf_dir)
    params = bloom.size_filters(keys.groupBy("table_id").agg(F.count("*").alias("capacity")), BY, RATE)
    return bloom.insert_counts(keys, params, BY, RATE)


EVERY_TABLE = """,
Q AS (SELECT t.table_id, d.key FROM (SELECT DISTINCT key FROM K) d, (SELECT DISTINCT table_id FROM K) t)"""


def all_hits(keys: DataFrame, filters: bloom.FilterSet) -> DataFrame:
    """Each distinct key asks every table; the pairs are streamed inside one stage, only hits leave it."""
    probes = bloom.with_digests(keys.select("key").distinct(), filters)
    tables = F.sequence(F.lit(0), F.lit(fixtures.TABLES - 1))
    return bloom.probe_hits(probes.withColumn("table_id", F.explode(tables)), filters)


@query(
    "bloom_probe",
    sql.with_keys(sql.filter_ctes(RATE) + EVERY_TABLE + sql.hits_cte("Q", RATE) + """
SELECT table_id, count(*) AS hits, min(key) AS first_key, max(key) AS last_key FROM HITS GROUP BY table_id"""),
)
def bloom_probe(spark, sf_dir):
    keys, filters = plain(spark, sf_dir)
    return all_hits(keys, filters).groupBy("table_id").agg(
        F.count("*").alias("hits"), F.min("key").alias("first_key"), F.max("key").alias("last_key")
    )


def halves(spark, sf_dir):
    """Two filter sets of equal dimensions, over keys whose hash part sorts below or above the middle."""
    keys = fixtures.keys(spark, sf_dir)
    params = bloom.size_filters(keys.groupBy("table_id").agg(F.count("*").alias("capacity")), BY, RATE)
    low = bloom.build_filters(keys.where("key < '8'"), params, BY, RATE)
    return low, bloom.build_filters(keys.where("key >= '8'"), params, BY, RATE), keys


HALVES_SQL = sql.filter_ctes(RATE) + "".join(
    f""",
FB{name} AS (SELECT DISTINCT table_id, s * bps + spots[s + 1] AS bit
  FROM (SELECT k.table_id, p.bps, {sql.positions('k.key', RATE, 'p.bps')} AS spots FROM K k JOIN FP p USING (table_id) WHERE key {test} '8'),
       range({sql.slices(RATE)}) r(s))"""
    for name, test in (("L", "<"), ("H", ">="))
)


@query(
    "bloom_union",
    sql.with_keys(HALVES_SQL + ", U AS (SELECT * FROM FBL UNION SELECT * FROM FBH)" + WORD_PROFILE_SQL.format(bits="U")),
)
def bloom_union(spark, sf_dir):
    low, high, _ = halves(spark, sf_dir)
    return word_profile(bloom.union_filters(low, high))


@query(
    "bloom_intersect",
    sql.with_keys(HALVES_SQL + ", U AS (SELECT * FROM FBL INTERSECT SELECT * FROM FBH)" + WORD_PROFILE_SQL.format(bits="U")),
)
def bloom_intersect(spark, sf_dir):
    low, high, _ = halves(spark, sf_dir)
    return word_profile(bloom.intersect_filters(low, high))


@query("bloom_append", sql.with_keys(sql.filter_ctes(RATE) + WORD_PROFILE_SQL.format(bits="FB")))
def bloom_append(spark, sf_dir):
    low, _, keys = halves(spark, sf_dir)
    return word_profile(bloom.append_keys(low, keys.where("key >= '8'")))


@query("bloom_table_roundtrip", sql.with_keys(sql.filter_ctes(RATE) + WORD_PROFILE_SQL.format(bits="FB")))
def bloom_table_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "filters")
    bloom.save_filters(plain(spark, sf_dir)[1], path)
    return word_profile(bloom.load_filters(spark, path, BY))


@query(
    "bloom_fill",
    sql.with_keys(sql.filter_ctes(RATE) + f"""
SELECT table_id, {sql.slices(RATE)} AS num_slices, bps AS bits_per_slice, count(*) AS ones, {sql.slices(RATE)} * bps - count(*) AS zeros,
       round(count(*)::DOUBLE / ({sql.slices(RATE)} * bps), 6) AS fill
FROM FB JOIN FP USING (table_id) GROUP BY table_id, bps"""),
)
def bloom_fill(spark, sf_dir):
    return bloom.fill_statistics(plain(spark, sf_dir)[1]).withColumn("fill", F.round("fill", 6))


@query(
    "bloom_fp_rate",
    sql.with_keys(sql.filter_ctes(RATE) + EVERY_TABLE + sql.hits_cte("Q", RATE) + """,
A AS (SELECT table_id, (SELECT count(DISTINCT key) FROM K) - count(DISTINCT key) AS absent FROM K GROUP BY table_id),
W AS (SELECT table_id, count(*) AS false_hits FROM HITS WHERE (table_id, key) NOT IN (SELECT table_id, key FROM K) GROUP BY table_id)
SELECT table_id, absent, false_hits, round(false_hits::DOUBLE / absent, 6) AS measured_rate, 0.1::DOUBLE AS requested_rate FROM A JOIN W USING (table_id)"""),
)
def bloom_fp_rate(spark, sf_dir):
    keys, filters = plain(spark, sf_dir)
    return measured_fp_rate(keys, filters)


def measured_fp_rate(keys: DataFrame, filters: bloom.FilterSet) -> DataFrame:
    """Share of the absent (key, table) pairs that a filter answers "maybe"."""
    held = keys.select("table_id", "key").distinct()
    false_hits = all_hits(keys, filters).join(held, ["table_id", "key"], "left_anti")
    hits = false_hits.groupBy("table_id").agg(F.count("*").alias("false_hits"))
    everything = keys.agg(F.count_distinct("key").alias("_all"))
    absent = held.groupBy("table_id").agg(F.count("*").alias("_held")).withColumn("_all", everything.scalar())
    rated = absent.withColumn("absent", F.col("_all") - F.col("_held")).join(hits, "table_id", "left").fillna(0, ["false_hits"])
    return rated.select(
        "table_id", "absent", "false_hits",
        F.round(F.col("false_hits") / F.col("absent"), 6).alias("measured_rate"),
        F.lit(filters.error_rate).alias("requested_rate"),
    )


@query(
    "bloom_fp_theory",
    sql.with_keys(sql.filter_ctes(RATE) + f"""
SELECT table_id, n AS keys, round(pow(1 - exp(-{sql.slices(RATE)} * (n + 0.5) / ({sql.slices(RATE)} * bps - 1)), {sql.slices(RATE)}), 6) AS projected_rate FROM FP"""),
)
def bloom_fp_theory(spark, sf_dir):
    _, filters = plain(spark, sf_dir)
    rate = bloom.projected_fp_rate(F.col("capacity"), F.col("num_slices"), F.col("num_bits"))
    return filters.params.select("table_id", F.col("capacity").alias("keys"), F.round(rate, 6).alias("projected_rate"))


@query(
    "bloom_bytes",
    sql.with_keys(sql.filter_ctes(RATE) + f" SELECT round(sum({sql.slices(RATE)} * bps) / 8, 6)::DOUBLE AS filter_bytes FROM FP"),
)
def bloom_bytes(spark, sf_dir):
    return bloom.total_filter_bytes(plain(spark, sf_dir)[1].params)


LAYER_START, LAYER_RATE, LAYERS = 1000, 0.001, 6


def _layers_sql() -> str:
    parts = [""",
D AS (SELECT table_id, key, row_number() OVER (PARTITION BY table_id ORDER BY min(pos)) - 1 AS r FROM K GROUP BY table_id, key)"""]
    start = 0
    for i in range(LAYERS):
        capacity = LAYER_START * 2**i
        parts.append(f", D{i} AS (SELECT table_id, key FROM D WHERE r >= {start} AND r < {start + capacity})")
        start += capacity
        parts.append(sql.filter_ctes(scalable_bloom.layer_error_rate(LAYER_RATE, i), f"D{i}", str(i), str(capacity)))
    return "".join(parts)


@query(
    "scalable_bloom_build",
    sql.with_keys(_layers_sql() + " UNION ALL ".join(
        f""" SELECT table_id, {i} AS layer, n::BIGINT AS capacity, {sql.slices(scalable_bloom.layer_error_rate(LAYER_RATE, i))} AS num_slices,
 bps AS bits_per_slice, round({scalable_bloom.layer_error_rate(LAYER_RATE, i)!r}::DOUBLE, 12) AS error_rate, count(*) AS ones
 FROM FB{i} JOIN FP{i} USING (table_id) GROUP BY table_id, n, bps"""
        for i in range(LAYERS)
    )),
)
def scalable_bloom_build(spark, sf_dir):
    layers = scalable_bloom.build_layers(fixtures.keys_with_pos(spark, sf_dir), BY, LAYER_RATE, LAYER_START)
    return scalable_bloom.layer_summary(layers, BY).withColumn("error_rate", F.round("error_rate", 12))


NEIGHBOURS = """,
Q AS (SELECT DISTINCT table_id, key FROM K UNION SELECT DISTINCT CAST((table_id + 1) % 24 AS INT), key FROM K)"""


def neighbour_probes(keys: DataFrame) -> DataFrame:
    """Every key asks its own table and the next one."""
    tables = F.array(F.col("table_id"), (F.col("table_id") + 1) % fixtures.TABLES)
    return keys.select(F.explode(tables).alias("table_id"), "key").distinct()


@query(
    "scalable_bloom_probe",
    sql.with_keys(
        _layers_sql() + NEIGHBOURS
        + "".join(sql.hits_cte("Q", scalable_bloom.layer_error_rate(LAYER_RATE, i), f"H{i}", str(i)) for i in range(LAYERS))
        + ", H AS (" + " UNION ".join(f"SELECT table_id, key FROM H{i}" for i in range(LAYERS)) + ")"
        + " SELECT table_id, count(*) AS hits, min(key) AS first_key FROM H GROUP BY table_id"
    ),
)
def scalable_bloom_probe(spark, sf_dir):
    keys = fixtures.keys_with_pos(spark, sf_dir)
    layers = scalable_bloom.build_layers(keys, BY, LAYER_RATE, LAYER_START)
    hits = scalable_bloom.probe_layers(neighbour_probes(fixtures.keys(spark, sf_dir)), layers)
    return hits.groupBy("table_id").agg(F.count("*").alias("hits"), F.min("key").alias("first_key"))


# --- exact membership and overlap ------------------------------------------------------------


def next_table(rows: DataFrame) -> DataFrame:
    return rows.withColumn("table_id", ((F.col("table_id") + 1) % fixtures.TABLES).cast("int"))


MEMBER_SQL = sql.with_keys(""",
X AS (SELECT table_id, {a} AS a, {b} AS b FROM K),
Y AS (SELECT CAST((table_id + 1) % 24 AS INT) AS table_id, a, b FROM X UNION ALL SELECT * FROM X)
SELECT y.table_id, CASE WHEN s.a IS NULL THEN -1 ELSE 1 END AS prediction, count(*) AS probes
FROM Y LEFT JOIN (SELECT DISTINCT * FROM X) s ON y.table_id = s.table_id AND y.a = s.a AND y.b = s.b GROUP BY ALL""")


def key_points(keys: DataFrame) -> DataFrame:
    from keysift.functions.text import parse_key

    return keys.withColumn("x", parse_key(F.col("key")))


@query(
    "dict_member",
    MEMBER_SQL.format(a="CAST(split_part(key, ':', 2) AS FLOAT)", b="CAST(CAST('0x' || split_part(key, ':', 3) AS BIGINT) AS FLOAT)"),
)
def dict_member(spark, sf_dir):
    rows = key_points(fixtures.keys(spark, sf_dir)).select("table_id", overlap.row_text(F.col("x")).alias("row"))
    probes = next_table(rows).unionByName(rows).groupBy("table_id", "row").agg(F.count("*").alias("n"))
    answered = overlap.exact_members(probes, rows, ["table_id", "row"])
    return answered.groupBy("table_id", "prediction").agg(F.sum("n").alias("probes"))


@query(
    "row_member",
    MEMBER_SQL.format(a="CAST(split_part(key, ':', 2) AS DOUBLE)", b="CAST(CAST('0x' || split_part(key, ':', 3) AS BIGINT) AS DOUBLE)"),
)
def row_member(spark, sf_dir):
    rows = key_points(fixtures.keys(spark, sf_dir)).select("table_id", "x")
    probes = next_table(rows).unionByName(rows).groupBy("table_id", "x").agg(F.count("*").alias("n"))
    answered = overlap.exact_members(probes, rows, ["table_id", "x"])
    return answered.groupBy("table_id", "prediction").agg(F.sum("n").alias("probes"))


@query(
    "truth_matrix",
    sql.with_keys("""
SELECT n_tables, first_table, count(*) AS keys, min(key) AS example
FROM (SELECT key, count(DISTINCT table_id) AS n_tables, min(table_id) AS first_table FROM K GROUP BY key) GROUP BY ALL"""),
)
def truth_matrix(spark, sf_dir):
    held = overlap.table_sets(fixtures.keys(spark, sf_dir))
    profile = held.select("key", F.size("held").cast("bigint").alias("n_tables"), F.col("held")[0]["table_id"].alias("first_table"))
    return profile.groupBy("n_tables", "first_table").agg(F.count("*").alias("keys"), F.min("key").alias("example"))


SHARED = """,
A AS (SELECT key, table_id, count(*) AS n FROM K GROUP BY ALL),
S AS (SELECT a.table_id AS table_a, b.table_id AS table_b, CAST(sum(a.n) AS BIGINT) AS shared_rows
      FROM A a JOIN A b ON a.key = b.key AND a.table_id <> b.table_id GROUP BY ALL)"""


@query("shared_keys", sql.with_keys(SHARED + " SELECT * FROM S"))
def shared_keys(spark, sf_dir):
    return overlap.shared_keys(fixtures.keys(spark, sf_dir))


@query(
    "shared_summary",
    sql.with_keys(SHARED + """ SELECT sum(shared_rows) / 2 AS shared,
round(sum(shared_rows) / 2 * 100 / (SELECT count(*) FROM K), 6) AS shared_percent FROM S"""),
)
def shared_summary(spark, sf_dir):
    return overlap.shared_summary(fixtures.keys(spark, sf_dir)).withColumn("shared_percent", F.round("shared_percent", 6))


@query(
    "duplicate_rate",
    sql.with_keys("""
SELECT count(*) AS total_keys, count(DISTINCT key) AS distinct_keys,
       round((count(*) - count(DISTINCT key)) * 100 / count(*), 6) AS duplicate_percent FROM K"""),
)
def duplicate_rate(spark, sf_dir):
    rate = overlap.duplicate_rate(fixtures.keys(spark, sf_dir))
    return rate.withColumn("duplicate_percent", F.round("duplicate_percent", 6))


# --- first-match evaluation of plain filters ---------------------------------------------------

EVAL = """,
ST AS ({stops}),
Q AS (SELECT DISTINCT CAST(t AS INT) AS table_id, key FROM ST, range(24) r(t) WHERE t <= stop)"""
EVAL_TAIL = """,
R AS (SELECT s.key, s.stop, s.n, h.table_id FROM ST s JOIN HITS h ON h.key = s.key AND h.table_id <= s.stop),
C AS (SELECT CAST(sum(CASE WHEN table_id = stop THEN n ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN table_id < stop THEN n ELSE 0 END) AS BIGINT) AS fp FROM R),
T AS (SELECT CAST(sum(n * stop) AS BIGINT) AS asked FROM ST)
SELECT round(fp::DOUBLE / asked, 6) AS fpr, 0::BIGINT AS truepositive_c, tp AS truepositive_bf, tp AS truepositive,
       0::BIGINT AS falsepositive_c, fp AS falsepositive_bf, fp AS falsepositive, asked - fp AS truenegative FROM C, T"""
STOPS = {
    "any": "SELECT key, min(table_id) AS stop, count(*) AS n FROM K GROUP BY key",
    "owner": "SELECT key, table_id AS stop, count(*) AS n FROM K GROUP BY key, table_id",
}


def plain_evaluation(truth: str):
    def run(spark, sf_dir):
        keys, filters = plain(spark, sf_dir)
        result = evaluation.evaluate(keys, evaluation.AlwaysNegative(), filters, truth)
        return result.withColumn("fpr", F.round("fpr", 6))

    return run


for _name, _truth in (("eval_first_match", "any"), ("eval_owner", "owner")):
    query(
        _name, sql.with_keys(sql.filter_ctes(RATE) + EVAL.format(stops=STOPS[_truth]) + sql.hits_cte("Q", RATE) + EVAL_TAIL)
    )(plain_evaluation(_truth))
