"""Backup filters, two-stage lookups, sweeps and cross-validation on the key tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keysift.operators import bloom
from keysift.operators.occ import rp
from keysift.operators.occ.registry import WIDTH, family, key_features, rp_axes
from keysift.plans import evaluation, fixtures, full_sweep, sweep
from keysift.plans.catalog import sql
from keysift.plans.catalog.base import query
from keysift.plans.catalog.membership import EVAL, RATE, STOPS, WORD_PROFILE_SQL, neighbour_probes, word_profile
from keysift.plans.catalog.model_queries import NEXT_HITS, PARAMS, PLANES, PROJECTED, intervals_sql, projected_sql

BY = ["table_id"]
RULE = "hits > 6 * 0.5"

# SQL twin: hits of every asked (table, key), the rejected own keys, their filters.
def rule_sql(params: rp.RPParams) -> str:
    return f"hits > {params.D * params.agg_thr!r}::DOUBLE"


def own_sql(params: rp.RPParams) -> str:
    return projected_sql(params.D) + intervals_sql(params) + NEXT_HITS + f""",
REJ AS (SELECT k.table_id, k.key, k.pos FROM K k JOIN H h ON h.side = 'own' AND h.table_id = k.table_id AND h.key = k.key WHERE NOT ({rule_sql(params)}))"""


OWN = own_sql(PARAMS)


def fitted(spark, sf_dir):
    keys = fixtures.keys(spark, sf_dir)
    return keys, rp.fit(keys, BY, PARAMS, key_features, WIDTH)


@query(
    "train_all",
    PROJECTED + intervals_sql(PARAMS) + """
SELECT 'epsilon' AS family, table_id, CAST((6 * 2 + 6 * count(*) FILTER (dim = 0)) * 64 AS BIGINT) AS bits, true AS timed FROM I GROUP BY table_id
UNION ALL SELECT 'dic', table_id, count(DISTINCT (x0, x1)), true FROM P GROUP BY table_id
UNION ALL SELECT 'np', table_id, count(DISTINCT (x0, x1)), true FROM P GROUP BY table_id
UNION ALL SELECT 'svmsimple', table_id, 33 * 64, true FROM P GROUP BY table_id""",
)
def train_all(spark, sf_dir):
    keys, parts = fixtures.keys(spark, sf_dir), []
    chosen = {
        "epsilon": {"D": 6, "epsilon": 1e-3, "agg_thr": 0.5, "box_thr": 2e-3}, "dic": {}, "np": {},
        "svmsimple": {"nu": 0.1, "gamma": 0.5, "tol": 1e-3},
    }
    for name, params in chosen.items():
        model, seconds = sweep.train_all(keys, name, params)
        sizes = family(name).size(model).select("table_id", F.col("bits").cast("bigint").alias("bits"))
        parts.append(sizes.withColumn("family", F.lit(name)).withColumn("timed", F.lit(seconds >= 0)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("backup_filter", OWN + sql.filter_ctes(RATE, "REJ") + WORD_PROFILE_SQL.format(bits="FB"))
def backup_filter(spark, sf_dir):
    keys, model = fitted(spark, sf_dir)
    return word_profile(evaluation.backup_filters(keys, model, BY, RATE)[0])


@query("backup_filter_overfull", OWN + sql.filter_ctes(RATE, "REJ", capacity="count(*) / 5.0") + WORD_PROFILE_SQL.format(bits="FB"))
def backup_filter_overfull(spark, sf_dir):
    """A fifth of the capacity the rejects would need."""
    keys, model = fitted(spark, sf_dir)
    return word_profile(evaluation.backup_filters(keys, model, BY, RATE, share=5)[0])


@query(
    "train_rejects",
    OWN + f"""
SELECT table_id, CAST(sum(CASE WHEN {RULE} THEN 0 ELSE n END) AS BIGINT) AS rejects, CAST(greatest(sum(CASE WHEN {RULE} THEN 0 ELSE n END), 1) AS BIGINT) AS rejects_floor
FROM H WHERE side = 'own' GROUP BY table_id""",
)
def train_rejects(spark, sf_dir):
    keys, model = fitted(spark, sf_dir)
    _, raw = evaluation.backup_filters(keys, model, BY, RATE)
    return raw.withColumn("rejects_floor", F.greatest("rejects", F.lit(1).cast("bigint")))


NEIGHBOURS_H = """,
Q AS (SELECT DISTINCT table_id, key FROM H)"""


@query(
    "two_stage_lookup",
    OWN + sql.filter_ctes(RATE, "REJ") + NEIGHBOURS_H + sql.hits_cte("Q", RATE) + f""",
AC AS (SELECT table_id, key, bool_or({RULE}) AS c FROM H GROUP BY table_id, key)
SELECT a.table_id, CASE WHEN c THEN 'c' WHEN h.key IS NOT NULL THEN 'bf' END AS source, count(*) AS probes
FROM AC a LEFT JOIN HITS h ON h.table_id = a.table_id AND h.key = a.key GROUP BY ALL""",
)
def two_stage_lookup(spark, sf_dir):
    keys, model = fitted(spark, sf_dir)
    filters, _ = evaluation.backup_filters(keys, model, BY, RATE)
    probes = bloom.with_digests(model.prepare(neighbour_probes(keys)), filters)
    yes = evaluation.two_stage(probes, model, filters)
    return yes.groupBy("table_id", "source").agg(F.count("*").alias("probes"))


@query(
    "sample_every_k",
    sql.with_keys(" SELECT table_id, count(*) AS keys, min(key) AS first_key, max(key) AS last_key, CAST(sum(pos) AS BIGINT) AS pos_sum FROM K WHERE pos % 50 = 0 GROUP BY table_id"),
)
def sample_every_k(spark, sf_dir):
    """Every 50th key of each table: the sampling operator itself."""
    sampled = fixtures.keys_with_pos(spark, sf_dir).where("pos % 50 = 0")
    return sampled.groupBy("table_id").agg(
        F.count("*").alias("keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.sum("pos").alias("pos_sum")
    )


def _model_eval_sql(truth: str, params: rp.RPParams = PARAMS) -> str:
    """All (key, table) pairs up to the stop, answered by the model first and its backup filter second."""
    dims = " UNION ALL ".join(
        f"SELECT table_id, key, x0 * {w[0]!r}::DOUBLE + x1 * {w[1]!r}::DOUBLE AS v, {d} AS dim FROM QX" for d, w in enumerate(PLANES[: params.D].tolist())
    )
    return (
        own_sql(params) + sql.filter_ctes(RATE, "REJ") + EVAL.format(stops=STOPS[truth]) + f""",
QX AS (SELECT q.table_id, q.key, CAST(split_part(key, ':', 2) AS DOUBLE) AS x0, CAST(CAST('0x' || split_part(key, ':', 3) AS BIGINT) AS DOUBLE) AS x1 FROM Q q),
QJ AS ({dims}),
QS AS (SELECT q.table_id, q.key, q.dim, q.v, i.hi FROM QJ q ASOF LEFT JOIN I i ON i.table_id = q.table_id AND i.dim = q.dim AND i.lo < q.v),
QH AS (SELECT table_id, key, count(*) FILTER (v < hi) AS hits FROM QS GROUP BY table_id, key)""" + sql.hits_cte("Q", RATE) + f""",
YES AS (SELECT q.table_id, q.key, CASE WHEN {rule_sql(params)} THEN 'c' WHEN h.key IS NOT NULL THEN 'bf' END AS source
        FROM QH q LEFT JOIN HITS h ON h.table_id = q.table_id AND h.key = q.key),
R AS (SELECT s.stop, s.n, y.table_id, y.source FROM ST s JOIN YES y ON y.key = s.key AND y.table_id <= s.stop),
C AS (SELECT coalesce(sum(n) FILTER (table_id = stop AND source = 'c'), 0) AS tp_c, coalesce(sum(n) FILTER (table_id = stop AND source = 'bf'), 0) AS tp_bf,
             coalesce(sum(n) FILTER (table_id < stop AND source = 'c'), 0) AS fp_c, coalesce(sum(n) FILTER (table_id < stop AND source = 'bf'), 0) AS fp_bf FROM R),
T AS (SELECT sum(n * stop) AS asked FROM ST)
SELECT round((fp_c + fp_bf)::DOUBLE / asked, 6) AS fpr, tp_c::BIGINT AS truepositive_c, tp_bf::BIGINT AS truepositive_bf, (tp_c + tp_bf)::BIGINT AS truepositive,
       fp_c::BIGINT AS falsepositive_c, fp_bf::BIGINT AS falsepositive_bf, (fp_c + fp_bf)::BIGINT AS falsepositive, (asked - fp_c - fp_bf)::BIGINT AS truenegative FROM C, T"""
    )


def model_evaluation(truth: str):
    def run(spark, sf_dir):
        counters, _ = full_sweep.single_run(fixtures.keys(spark, sf_dir), PARAMS, RATE, truth)
        return counters.select(F.round("fpr", 6).alias("fpr"), *evaluation.COUNTERS)

    return run


for _name, _truth in (("eval_first_match_model", "any"), ("eval_owner_model", "owner")):
    query(_name, _model_eval_sql(_truth))(model_evaluation(_truth))


@query("no_false_negatives", "SELECT 0 AS table_id, '' AS key FROM (SELECT 1) WHERE false")
def no_false_negatives(spark, sf_dir):
    keys, model = fitted(spark, sf_dir)
    filters, _ = evaluation.backup_filters(keys, model, BY, RATE)
    return evaluation.denied_keys(keys, model, filters)


FOLDS = 5
FOLDED = sql.with_keys(f""",
F AS (SELECT table_id, key, CAST(ntile({FOLDS}) OVER (PARTITION BY table_id ORDER BY md5(key || ':42')) - 1 AS INT) AS fold FROM K)""")


@query(
    "kfold",
    FOLDED + f"""
SELECT f.table_id, f.fold, count(*) AS held_out, any_value(n) - count(*) AS training, min(key) AS first_key, max(key) AS last_key
FROM F f JOIN (SELECT table_id, count(*) AS n FROM K GROUP BY table_id) USING (table_id) GROUP BY ALL""",
)
def kfold(spark, sf_dir):
    folded = sweep.kfold(fixtures.keys(spark, sf_dir), FOLDS)
    held = folded.groupBy("table_id", "fold").agg(F.count("*").alias("held_out"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    training = sweep.training_rows(folded, FOLDS).groupBy("table_id", "fold").agg(F.count("*").alias("training"))
    return held.join(training, ["table_id", "fold"])


@query(
    "validation_rejects",
    FOLDED + f""",
X AS (SELECT table_id, fold, CAST(split_part(key, ':', 2) AS DOUBLE) AS x0, CAST(CAST('0x' || split_part(key, ':', 3) AS BIGINT) AS DOUBLE) AS x1, row_number() OVER () AS id FROM F),
XJ AS (""" + " UNION ALL ".join(
        f"SELECT id, table_id, fold, {d} AS dim, x0 * {w[0]!r}::DOUBLE + x1 * {w[1]!r}::DOUBLE AS v FROM X" for d, w in enumerate(PLANES.tolist())
    ) + f"""),
J AS (SELECT CAST(g AS INT) AS fold, table_id, dim, v FROM XJ, range({FOLDS}) r(g) WHERE fold <> g)""" + intervals_sql(PARAMS, group="fold, table_id, dim") + f""",
H AS (SELECT x.fold, x.table_id, id, count(i.lo) AS hits FROM XJ x LEFT JOIN I i ON i.fold = x.fold AND i.table_id = x.table_id AND i.dim = x.dim AND i.lo < v AND v < i.hi GROUP BY ALL)
SELECT fold, table_id, count(*) AS held_out, count(*) FILTER (NOT ({RULE})) AS rejects FROM H GROUP BY fold, table_id""",
)
def validation_rejects(spark, sf_dir):
    return sweep.validation_rejects(fixtures.keys(spark, sf_dir), FOLDS, PARAMS)


@query(
    "run_record",
    _model_eval_sql("any").replace("SELECT round((fp_c", """,
RJ AS (SELECT CAST(sum(CASE WHEN """ + RULE + """ THEN 0 ELSE n END) AS BIGINT) AS rejects FROM H WHERE side = 'own')
SELECT 'epsilon' AS family, 6 AS "D", rejects AS error_total, true AS timed, round((fp_c""").replace("FROM C, T", "FROM C, T, RJ"),
)
def run_record(spark, sf_dir):
    params = {"D": 6, "epsilon": 1e-3, "agg_thr": 0.5, "box_thr": 2e-3}
    record = sweep.run(fixtures.keys(spark, sf_dir), "epsilon", params, RATE)
    errors = F.aggregate(F.map_values("error_train"), F.lit(0).cast("bigint"), lambda t, v: t + v)
    return record.select(
        "family", "D", errors.alias("error_total"), (F.col("elapsed") >= 0).alias("timed"), F.round("fpr", 6).alias("fpr"), *evaluation.COUNTERS
    )


@query(
    "param_grid",
    sql.with_keys("""
SELECT table_id, round(pow(10.0, -3 + v), 9) AS nu, round(pow(10.0, -1 + 2 * g), 9) AS gamma, round(pow(10.0, -3 + t), 9) AS tol, round(pow(10.0, -3 + v) * n, 6) AS expected_rejects
FROM (SELECT table_id, count(*) AS n FROM K GROUP BY table_id), range(4) q(v), range(3) r(g), range(4) s(t)"""),
)
def param_grid(spark, sf_dir):
    """The configurations every table is trained with, and the rejects its share of outliers promises."""
    sizes = fixtures.keys(spark, sf_dir).groupBy("table_id").agg(F.count("*").alias("n"))
    grid = sweep.with_grid(sizes, nu=sweep.logspace(-3, 0, 4), gamma=sweep.logspace(-1, 3, 3), tol=[0.001, 0.01, 0.1, 1.0])
    expected = F.round(F.col("nu") * F.col("n"), 6).alias("expected_rejects")
    return grid.select("table_id", *[F.round(c, 9).alias(c) for c in ("nu", "gamma", "tol")], expected)


EMPTY_BITS = 8  # bits of a filter of capacity one: four slices of two bits
SWEEP = full_sweep.Grid(dims=(4, 6), epsilons=(1e-3, 2e-3), aggs=(0.5, 0.8), boxes=(0, 2e-3))


def _sweep_sql() -> str:
    """One evaluation per configuration, glued together; a single shared key table."""
    parts = []
    for i, dims, epsilon, agg, box, *_ in SWEEP.configurations():
        params = rp.RPParams(dims, epsilon, agg, box)
        head, tail = _model_eval_sql("any", params).rsplit("SELECT round((fp_c", 1)
        text = (
            head + f""",
RJ AS (SELECT CAST(sum(CASE WHEN {rule_sql(params)} THEN 0 ELSE n END) AS BIGINT) AS rejects FROM H WHERE side = 'own'),
BS AS (SELECT sum({sql.slices(RATE)} * bps) + {EMPTY_BITS} * (24 - count(*)) AS bits FROM FP)
SELECT {i} AS config, {dims} AS "D", {epsilon!r}::DOUBLE AS epsilon, {agg!r}::DOUBLE AS agg_thr, {box!r}::DOUBLE AS box_thr, rejects, round(bits / 8, 6)::DOUBLE AS bfsize, round((fp_c"""
            + tail.replace("FROM C, T", "FROM C, T, RJ, BS")
        )
        parts.append(f"SELECT * FROM ({text})")
    return " UNION ALL ".join(parts)


@query("grid_sweep", _sweep_sql())
def grid_sweep(spark, sf_dir):
    result = full_sweep.full_sweep(fixtures.keys(spark, sf_dir), SWEEP, RATE)
    return result.withColumn("fpr", F.round("fpr", 6))


@query("grid_sweep_full")
def grid_sweep_full(spark, sf_dir):
    """All 3 000 configurations of the family's own grid, from one pass over the keys for all of them.

    No SQL twin: 2 560 intervals for each of the pairs of keys and tables take too long there.  ``grid_sweep`` runs
    the same code on a smaller grid beside its SQL, and a unit test compares with single runs.
    """
    return full_sweep.full_sweep(fixtures.keys(spark, sf_dir), full_sweep.Grid(**rp_axes()), RATE)


@query("fit_probe")
def fit_probe(spark, sf_dir):
    """Models on TF-IDF of 4-grams, one per table, asked about their own keys and the next table's."""
    from keysift.operators.membership import KeyModelEstimator

    keys = fixtures.keys(spark, sf_dir)
    model = KeyModelEstimator(epsilon=1e-2, agg_thr=0.5, box_thr=1e-3).fit(keys)
    probes = neighbour_probes(keys)
    answered = model.transform(probes)
    return answered.groupBy("table_id", "prediction").agg(F.count("*").alias("probes"))
