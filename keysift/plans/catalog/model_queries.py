"""One-class models fitted per table, and text classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from keysift.functions.text import parse_key
from keysift.operators import features, scaling
from keysift.operators.occ import gmm, gmm_vector, iforest, naive_bayes, rbf, rp
from keysift.operators.occ.registry import WIDTH, family, key_features
from keysift.plans import cross_validation, evaluation, fixtures
from keysift.plans.catalog.base import query
from keysift.plans.catalog.feature_queries import DOCS, PS, doc_features
from keysift.session import broadcast_if_small, materialize

BY = ["table_id"]
PARAMS = rp.RPParams(D=6, epsilon=1e-3, agg_thr=0.5, box_thr=2e-3)
PLANES = rp.unit_planes(PARAMS.D, WIDTH)


def points(spark, sf_dir):
    return fixtures.keys(spark, sf_dir).select("table_id", "key", parse_key(F.col("key")).alias("x"))


def long_points(spark, sf_dir):
    return points(spark, sf_dir).select("table_id", F.posexplode(rp.project(F.col("x"), PLANES)).alias("dim", "value"))


def neighbour_points(spark, sf_dir):
    """Every distinct point at its own table (side 'own') and at the next one, with its row count."""
    rows = points(spark, sf_dir).groupBy("table_id", "key").agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.lit("own").alias("side"), F.col("table_id").alias("asked")),
        F.struct(F.lit("next").alias("side"), ((F.col("table_id") + 1) % fixtures.TABLES).cast("int").alias("asked")),
    )
    spread = rows.select("key", "n", F.explode(sides).alias("s"))
    return spread.select("key", "n", F.col("s.side").alias("side"), F.col("s.asked").alias("table_id"))


# --- SQL twins of the random-projection model: the sequential gap rule, written with lag -------------

def projected_sql(dims: int) -> str:
    projections = (f"SELECT table_id, key, {d} AS dim, x0 * {w[0]!r}::DOUBLE + x1 * {w[1]!r}::DOUBLE AS v FROM P" for d, w in enumerate(PLANES[:dims].tolist()))
    return PS + ", J AS (" + " UNION ALL ".join(projections) + ")"


PROJECTED = projected_sql(PARAMS.D)


def intervals_sql(params: rp.RPParams, source: str = "J", name: str = "I", group: str = "table_id, dim") -> str:
    keep = ">=" if params.closed else ">"
    widen = 0.0 if params.closed else rp.WIDENING
    return f""",
{name}W AS (SELECT {group}, (max(v) - min(v)) * {params.epsilon!r}::DOUBLE AS w, count(*) AS n FROM {source} GROUP BY {group}),
{name}L AS (SELECT {group}, v, w, n, lag(v) OVER (PARTITION BY {group} ORDER BY v) AS p FROM {source} JOIN {name}W USING ({group})),
{name}G AS (SELECT *, sum(CASE WHEN p IS NULL OR NOT v < p + w THEN 1 ELSE 0 END) OVER (PARTITION BY {group} ORDER BY v ROWS UNBOUNDED PRECEDING) AS g FROM {name}L),
{name} AS (SELECT {group}, min(v) - {widen!r}::DOUBLE AS lo, max(v) + {widen!r}::DOUBLE AS hi, count(*) AS members FROM {name}G GROUP BY {group}, g, n
  HAVING count(*) - 1 {keep} n * {params.box_thr!r}::DOUBLE)"""


INTERVALS_OUT = " SELECT table_id, dim, round(lo, 6) AS lo, round(hi, 6) AS hi, members FROM I"


def intervals_out(intervals):
    return intervals.select("table_id", "dim", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "members")


@query(
    "rp_project",
    PROJECTED + " SELECT table_id, dim, round(sum(v), 3) AS total, round(min(v), 6) AS low, round(max(v), 6) AS high FROM J GROUP BY ALL",
)
def rp_project(spark, sf_dir):
    return long_points(spark, sf_dir).groupBy("table_id", "dim").agg(
        F.round(F.sum("value"), 3).alias("total"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high")
    )


@query("rp_intervals", PROJECTED + intervals_sql(PARAMS) + INTERVALS_OUT)
def rp_intervals(spark, sf_dir):
    return intervals_out(rp.fit_intervals(long_points(spark, sf_dir), BY, PARAMS))


CLOSED = rp.RPParams(D=6, epsilon=1e-3, agg_thr=0.5, box_thr=2e-3, closed=True)


@query("rp_intervals_closed", PROJECTED + intervals_sql(CLOSED) + INTERVALS_OUT)
def rp_intervals_closed(spark, sf_dir):
    return intervals_out(rp.fit_intervals(long_points(spark, sf_dir), BY, CLOSED))


NEXT_HITS = """,
A AS (SELECT 'own' AS side, table_id, key, dim, v FROM J UNION ALL SELECT 'next', CAST((table_id + 1) % 24 AS INT), key, dim, v FROM J),
D AS (SELECT side, table_id, key, dim, any_value(v) AS v, count(*) AS n FROM A GROUP BY side, table_id, key, dim),
H AS (SELECT side, d.table_id, key, any_value(n) AS n, count(i.lo) AS hits FROM D d LEFT JOIN I i ON i.table_id = d.table_id AND i.dim = d.dim AND i.lo < v AND v < i.hi GROUP BY side, d.table_id, key)"""


@query(
    "rp_score",
    PROJECTED + intervals_sql(PARAMS) + NEXT_HITS + " SELECT side, table_id, round(hits / 6, 6) AS score, CAST(sum(n) AS BIGINT) AS points FROM H GROUP BY ALL",
)
def rp_score(spark, sf_dir):
    """Scores through the equi-join on lookup cells, the form that needs no broadcast."""
    intervals = rp.fit_intervals(long_points(spark, sf_dir), BY, PARAMS)
    probes = neighbour_points(spark, sf_dir)
    probes = probes.withColumn("x", key_features())
    long = probes.select("table_id", "side", "key", "n", F.posexplode(rp.project(F.col("x"), PLANES)).alias("dim", "value"))
    scored = rp.score_long(long, intervals, BY, ["side", "key", "n"])
    return scored.groupBy("side", "table_id", F.round(rp.decision(F.col("hits"), PARAMS.D), 6).alias("score")).agg(
        F.sum("n").alias("points")
    )


def prediction_counts(spark, sf_dir, params: rp.RPParams):
    keys = fixtures.keys(spark, sf_dir)
    model = rp.fit(keys, BY, params, key_features, WIDTH)
    return model.accept(model.prepare(neighbour_points(spark, sf_dir))).withColumn("prediction", F.when(F.col("accepted"), 1).otherwise(-1))


def counted(answered):
    return answered.groupBy("side", "table_id", "prediction").agg(F.sum("n").alias("points"))


PREDICT_OUT = " SELECT side, table_id, CASE WHEN {rule} THEN 1 ELSE -1 END AS prediction, CAST(sum(n) AS BIGINT) AS points FROM H GROUP BY ALL"


@query("rp_predict", PROJECTED + intervals_sql(PARAMS) + NEXT_HITS + PREDICT_OUT.format(rule="hits > 6 * 0.5"))
def rp_predict(spark, sf_dir):
    return counted(prediction_counts(spark, sf_dir, PARAMS))


ABS = rp.RPParams(D=6, epsilon=1e-3, agg_thr=0.5, box_thr=2e-3, agg_abs=2)


@query("rp_predict_abs", PROJECTED + intervals_sql(ABS) + NEXT_HITS + PREDICT_OUT.format(rule="6 - hits < 2"))
def rp_predict_abs(spark, sf_dir):
    return counted(prediction_counts(spark, sf_dir, ABS))


@query(
    "accuracy",
    PROJECTED + intervals_sql(PARAMS) + NEXT_HITS + """
SELECT table_id, round(sum(CASE WHEN (hits > 3) = (side = 'own') THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS accuracy FROM H GROUP BY table_id""",
)
def accuracy(spark, sf_dir):
    answered = prediction_counts(spark, sf_dir, PARAMS)
    label = F.when(F.col("side") == "own", 1).otherwise(-1)
    right = F.sum(F.when(F.col("prediction") == label, F.col("n")).otherwise(0))
    return answered.groupBy("table_id").agg(F.round(right / F.sum("n"), 6).alias("accuracy"))


@query(
    "predict_consistency",
    "SELECT table_id, '' AS key, 0 AS prediction FROM (SELECT 1 AS table_id) WHERE false",
)
def predict_consistency(spark, sf_dir):
    """Rows whose prediction changes when rows are scored alone, through joins, instead of in a batch."""
    keys = materialize(fixtures.keys(spark, sf_dir).distinct())
    model = rp.fit(keys, BY, PARAMS, key_features, WIDTH)
    intervals = materialize(model.intervals)
    batch = rp.RPModel(BY, PARAMS, PLANES, intervals, key_features)
    alone = rp.RPModel(BY, PARAMS, PLANES, intervals, key_features, limit=-1)
    answer = F.when(F.col("accepted"), 1).otherwise(-1).alias("prediction")
    first = batch.accept(batch.prepare(keys)).select("table_id", "key", answer)
    second = alone.accept(alone.prepare(keys.repartition(13, "key"))).select("table_id", "key", answer)
    return differing(first, second)


def differing(first, second):
    """The rows that one side holds more often than the other, as often as that; both sides are computed and shuffled once."""
    both = first.withColumn("_n", F.lit(1)).unionByName(second.withColumn("_n", F.lit(-1)))
    counts = both.groupBy(*first.columns).agg(F.abs(F.sum("_n")).alias("_n")).where("_n > 0")
    return counts.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).drop("_n")


# --- kernel projections on the embeddings ------------------------------------------------------------

V_PLANES = rp.unit_planes(4, 64)
KERNEL = rp.RPParams(D=4, epsilon=2e-2, agg_thr=0.5, box_thr=2e-2, closed=True)


def kernel_sql(kernel: str) -> str:
    parts = []
    for d, w in enumerate(V_PLANES.tolist()):
        plane = "[" + ", ".join(repr(v) for v in w) + "]::DOUBLE[]"
        if kernel == "g":
            value = f"exp(-0.5 * list_sum(list_transform(list_zip(e, {plane}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
        else:
            value = f"pow(list_sum(list_transform(list_zip(e, {plane}), lambda z: z[1] * z[2])) + 1.0, 2)"
        parts.append(f"SELECT '{kernel}' AS kernel, label AS table_id, vec_id, {d} AS dim, {value} AS v FROM E")
    return " UNION ALL ".join(parts)


KERNEL_SQL = f"""
WITH E AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
J AS ({kernel_sql('g')} UNION ALL {kernel_sql('p')})""" + intervals_sql(KERNEL, group="kernel, table_id, dim") + """,
A AS (SELECT kernel, 'own' AS side, table_id, vec_id, dim, v FROM J UNION ALL SELECT kernel, 'next', (table_id + 1) % 10, vec_id, dim, v FROM J),
H AS (SELECT a.kernel, side, a.table_id, vec_id, count(i.lo) AS hits FROM A a LEFT JOIN I i ON i.kernel = a.kernel AND i.table_id = a.table_id AND i.dim = a.dim AND i.lo <= v AND v <= i.hi GROUP BY ALL)
SELECT kernel, side, table_id, CASE WHEN hits >= 4 * 0.5 THEN 1 ELSE -1 END AS prediction, count(*) AS points FROM H GROUP BY ALL"""


@query("rp_kernel_predict", KERNEL_SQL)
def rp_kernel_predict(spark, sf_dir):
    vectors = fixtures.table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("table_id"), "vec_id", F.col("embedding").cast("array<double>").alias("x")
    )
    parts = []
    for kernel, gamma in (("g", 0.5), ("p", 1.0)):
        values = rp.kernel_project(F.col("x"), V_PLANES, kernel, gamma)
        parts.append(vectors.select(F.lit(kernel).alias("kernel"), "table_id", "vec_id", F.posexplode(values).alias("dim", "value")))
    long = materialize(parts[0].unionByName(parts[1]))  # one set of values for fit and score: closed ends compare equal
    by = ["kernel", "table_id"]
    intervals = rp.fit_intervals(long, by, KERNEL)
    sides = F.array(
        F.struct(F.lit("own").alias("side"), F.col("table_id").alias("asked")),
        F.struct(F.lit("next").alias("side"), ((F.col("table_id") + 1) % 10).cast("int").alias("asked")),
    )
    asked = long.withColumn("s", F.explode(sides)).select("kernel", F.col("s.asked").alias("table_id"), "s.side", "vec_id", "dim", "value")
    scored = rp.score_long(asked, intervals, by, ["side", "vec_id"], closed=True)
    prediction = F.when(rp.accept_rule(F.col("hits"), KERNEL), 1).otherwise(-1)
    return scored.groupBy("kernel", "side", "table_id", prediction.alias("prediction")).agg(F.count("*").alias("points"))


@query(
    "model_bytes",
    PROJECTED + intervals_sql(PARAMS) + """,
M AS (SELECT table_id, (6 * 2 + 6 * count(*) FILTER (dim = 0)) * 64 AS bits, (6 * 2 + count(*)) * 64 AS true_bits FROM I GROUP BY table_id)
SELECT 'epsilon' AS family, CAST(sum(bits) AS BIGINT) AS bits, CAST(sum(true_bits) AS BIGINT) AS true_bits FROM M
UNION ALL SELECT 'dic', CAST(sum(n) AS BIGINT), CAST(sum(n) AS BIGINT) FROM (SELECT table_id, count(DISTINCT (x0, x1)) AS n FROM P GROUP BY table_id)
UNION ALL SELECT 'alwaysNegative', 0, 0""",
)
def model_bytes(spark, sf_dir):
    keys = fixtures.keys(spark, sf_dir)
    model = rp.fit(keys, BY, PARAMS, key_features, WIDTH)
    bits = rp.model_bits(model.intervals, BY, PARAMS.D, WIDTH).agg(F.sum("bits").alias("bits"), F.sum("true_bits").alias("true_bits"))
    exact = family("dic")
    entries = exact.size(exact.fit(keys, BY, {})).agg(F.sum("bits").alias("bits"), F.sum("bits").alias("true_bits"))
    none = keys.agg((F.count("*") * 0).alias("bits"), (F.count("*") * 0).alias("true_bits"))
    parts = [d.withColumn("family", F.lit(n)) for n, d in (("epsilon", bits), ("dic", entries), ("alwaysNegative", none))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("always_negative", PS + " SELECT table_id, -1 AS prediction, count(*) AS points FROM P GROUP BY table_id")
def always_negative(spark, sf_dir):
    answered = evaluation.own_predictions(fixtures.keys(spark, sf_dir), evaluation.AlwaysNegative())
    return answered.groupBy("table_id", F.when(F.col("accepted"), 1).otherwise(-1).alias("prediction")).agg(F.count("*").alias("points"))


# --- RBF model ------------------------------------------------------------------------------------

RBF = rbf.RBFParams(nu=0.1, gamma=0.5, features=16, margin=1e-3)


def rbf_sql() -> str:
    weights, phases = rbf.fourier_basis(RBF, WIDTH)
    scale = (2.0 / RBF.features) ** 0.5
    zs = ", ".join(
        f"cos({p!r}::DOUBLE + s0 * {w[0]!r}::DOUBLE + s1 * {w[1]!r}::DOUBLE) * {scale!r}::DOUBLE AS z{i}"
        for i, (w, p) in enumerate(zip(weights.tolist(), phases.tolist()))
    )
    return PS + f""",
C AS (SELECT table_id, avg(x0) AS m0, stddev_pop(x0) AS d0, avg(x1) AS m1, stddev_pop(x1) AS d1 FROM P GROUP BY table_id),
S AS (SELECT table_id, (x0 - m0) / d0 AS s0, (x1 - m1) / d1 AS s1 FROM P JOIN C USING (table_id)),
Z AS (SELECT table_id, {zs} FROM S),
M AS (SELECT table_id, {', '.join(f'avg(z{i}) AS a{i}' for i in range(RBF.features))} FROM Z GROUP BY table_id),
O AS (SELECT table_id, {' + '.join(f'z{i} * a{i}' for i in range(RBF.features))} AS score FROM Z JOIN M USING (table_id)),
R AS (SELECT table_id, score, row_number() OVER (PARTITION BY table_id ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY table_id) AS n FROM O),
T AS (SELECT table_id, score AS threshold FROM R WHERE r = floor({RBF.nu!r} * (n - 1))),
A AS (SELECT table_id, score, -threshold AS intercept FROM O JOIN T USING (table_id))"""


def rbf_scores(spark, sf_dir):
    """Training rows with the score and intercept of their own table's model."""
    rows = points(spark, sf_dir).select("table_id", "x")
    scaled = scaling.apply_scaler(rows, scaling.fit_standard(rows, BY), BY)
    return rbf.fit(scaled, BY, RBF, WIDTH).score(scaled)


@query(
    "rbf_fit_predict",
    rbf_sql() + """
SELECT table_id, round(any_value(intercept), 6) AS intercept, count(*) FILTER (score + intercept > 0) AS accepted, count(*) FILTER (score + intercept <= 0) AS rejected,
       abs(count(*) FILTER (score + intercept <= 0)::DOUBLE / count(*) - 0.1) < 0.01 AS near_nu FROM A GROUP BY table_id""",
)
def rbf_fit_predict(spark, sf_dir):
    answered = rbf_scores(spark, sf_dir).withColumn("yes", rbf.margin_prediction(F.col("score"), F.col("intercept"), 0.0) == 1)
    rejected = F.count_if(~F.col("yes"))
    return answered.groupBy("table_id").agg(
        F.round(F.first("intercept"), 6).alias("intercept"), F.count_if("yes").alias("accepted"), rejected.alias("rejected"),
        (F.abs(rejected / F.count("*") - RBF.nu) < 0.01).alias("near_nu"),
    )


@query(
    "margin_predict",
    rbf_sql() + " UNION ALL ".join(
        f" SELECT {t!r}::DOUBLE AS tolerance, table_id, count(*) FILTER (score + intercept > -{t!r}::DOUBLE) AS accepted FROM A GROUP BY table_id"
        for t in (1e-2, 1e-3, 1e-4, 1e4)
    ),
)
def margin_predict(spark, sf_dir):
    scored = rbf_scores(spark, sf_dir)
    tolerances = [1e-2, 1e-3, 1e-4, 1e4]
    yes = [F.count_if(rbf.margin_prediction(F.col("score"), F.col("intercept"), t) == 1) for t in tolerances]
    entries = F.array(*[F.struct(F.lit(t).alias("tolerance"), y.alias("accepted")) for t, y in zip(tolerances, yes)])
    return scored.groupBy("table_id").agg(entries.alias("_e")).select("table_id", F.explode("_e").alias("_r")).select("table_id", "_r.*")


@query(
    "support_ratio",
    rbf_sql() + " SELECT table_id, round(count(*) FILTER (score + intercept <= 0)::DOUBLE / count(*), 6) AS support_ratio FROM A GROUP BY table_id",
)
def support_ratio(spark, sf_dir):
    return rbf.support_ratio(rbf_scores(spark, sf_dir), BY).withColumn("support_ratio", F.round("support_ratio", 6))


# --- Gaussian mixtures -------------------------------------------------------------------------------


def unit_points(spark, sf_dir):
    """Points in two columns, min-max scaled per table."""
    rows = points(spark, sf_dir).select("table_id", "x")
    scaled = scaling.apply_scaler(rows, scaling.fit_minmax(rows, BY), BY)
    return scaled.select("table_id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


@query("gmm_fit")
def gmm_fit(spark, sf_dir):
    """Expectation maximisation over all tables until the likelihood settles, or a hundred rounds."""
    components, trace = gmm.fit(materialize(unit_points(spark, sf_dir)), BY)
    rising = all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))
    return components.select("table_id", "component", *[F.round(c, 6).alias(c) for c in ("weight", "m0", "m1", "c00", "c01", "c11")]).withColumn(
        "rising", F.lit(rising)
    )


@query(
    "gmm_components",
    """WITH C AS (SELECT 'supplier' AS grouping_key, l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY l_suppkey
UNION ALL SELECT 'customer', o_custkey, count(*) FROM orders GROUP BY o_custkey UNION ALL SELECT 'flag', ascii(l_returnflag), count(*) FROM lineitem GROUP BY l_returnflag)
SELECT grouping_key, CASE WHEN n > 10000 THEN 100 WHEN n < 60 THEN greatest(1, n // 10) ELSE 9 END::INT AS components, count(*) AS tables FROM C GROUP BY ALL""",
)
def gmm_components(spark, sf_dir):
    lines, orders = fixtures.table(spark, sf_dir, "lineitem"), fixtures.table(spark, sf_dir, "orders")
    sizes = [
        df.groupBy(c).agg(F.count("*").alias("n")).select(F.lit(k).alias("grouping_key"), "n")
        for k, df, c in (("supplier", lines, "l_suppkey"), ("customer", orders, "o_custkey"), ("flag", lines, "l_returnflag"))
    ]
    every = sizes[0].unionByName(sizes[1]).unionByName(sizes[2])
    return every.groupBy("grouping_key", gmm.component_count(F.col("n")).alias("components")).agg(F.count("*").alias("tables"))


def sliced_components(rows):
    """A mixture of three components, from slices of the first feature."""
    slices = F.least(F.floor(F.col("x0") * 3), F.lit(2)).cast("int")
    return gmm.estimate(rows.select("table_id", slices.alias("component"), F.lit(1.0).alias("r"), "x0", "x1", F.lit(0.0).alias("ll")), BY)


MIX = PS + """,
B AS (SELECT table_id, min(x0) AS a0, max(x0) - min(x0) AS b0, min(x1) AS a1, max(x1) - min(x1) AS b1 FROM P GROUP BY table_id),
U AS (SELECT table_id, key, pos, (x0 - a0) / b0 AS x0, (x1 - a1) / b1 AS x1 FROM P JOIN B USING (table_id)),
M AS (SELECT table_id, CAST(least(floor(x0 * 3), 2) AS INT) AS component, count(*)::DOUBLE / any_value(n) AS weight, avg(x0) AS m0, avg(x1) AS m1,
             var_pop(x0) + 1e-6 AS c00, covar_pop(x0, x1) AS c01, var_pop(x1) + 1e-6 AS c11
      FROM U JOIN (SELECT table_id, count(*) AS n FROM U GROUP BY table_id) USING (table_id) GROUP BY table_id, component),
L AS (SELECT u.table_id, u.pos, ln(sum(weight / (2 * pi() * sqrt(c00 * c11 - c01 * c01)) *
        exp(-0.5 * (c11 * (x0 - m0) * (x0 - m0) - 2 * c01 * (x0 - m0) * (x1 - m1) + c00 * (x1 - m1) * (x1 - m1)) / (c00 * c11 - c01 * c01)))) AS ll
      FROM U u JOIN M m USING (table_id) GROUP BY u.table_id, u.pos),
N AS (SELECT table_id, avg(ll) AS mean, stddev_pop(ll) AS sigma FROM L GROUP BY table_id)"""


@query(
    "gmm_band_predict",
    MIX + """ SELECT table_id, round(any_value(mean), 6) AS mean, round(any_value(sigma), 6) AS sigma,
count(*) FILTER (abs(ll - mean) < 2 * sigma) AS accepted, count(*) FILTER (abs(ll - mean) <= greatest(1.5 * sigma, 1e-12)) AS accepted_closed FROM L JOIN N USING (table_id) GROUP BY table_id""",
)
def gmm_band_predict(spark, sf_dir):
    rows = unit_points(spark, sf_dir)
    scored = materialize(gmm.with_log_likelihood(rows, sliced_components(rows), BY).select("table_id", "ll"))
    banded = scored.join(broadcast_if_small(gmm.likelihood_band(scored, BY)), "table_id")
    ll, mean, sigma = F.col("ll"), F.col("mean"), F.col("sigma")
    return banded.groupBy("table_id").agg(
        F.round(F.first("mean"), 6).alias("mean"), F.round(F.first("sigma"), 6).alias("sigma"),
        F.count_if(gmm.band_prediction(ll, mean, sigma, 2.0) == 1).alias("accepted"),
        F.count_if(gmm.band_prediction(ll, mean, sigma, 1.5, 1e-12) == 1).alias("accepted_closed"),
    )


@query(
    "gmm_sample",
    MIX + """ SELECT table_id, component, CAST(floor(weight * 10000) AS BIGINT) AS draws, true AS near_mean FROM M""",
)
def gmm_sample(spark, sf_dir):
    components = sliced_components(unit_points(spark, sf_dir))
    draws = gmm.resample(components, BY).groupBy("table_id", "component").agg(F.count("*").alias("draws"), F.avg("x0").alias("a0"), F.avg("x1").alias("a1"))
    joined = draws.join(components, ["table_id", "component"])
    near = (F.abs(F.col("a0") - F.col("m0")) < 6 * F.sqrt(F.col("c00") / F.col("draws"))) & (
        F.abs(F.col("a1") - F.col("m1")) < 6 * F.sqrt(F.col("c11") / F.col("draws"))
    )
    return joined.select("table_id", "component", "draws", near.alias("near_mean"))


@query("svm_primal")
def svm_primal_query(spark, sf_dir):
    """The one-class machine of every table: rejected share, how near its optimum it ended, and whether the objective fell throughout."""
    keys = fixtures.keys(spark, sf_dir)
    model = family("svmprimal").fit(keys, BY, {"nu": 0.1, "gamma": 0.5, "tol": 1e-2})
    answered = model.accept(model.prepare(keys)).groupBy("table_id").agg(F.count("*").alias("points"), (F.count_if(~F.col("accepted")) / F.count("*")).alias("share"))
    trace = model.model.trace
    falling = all(b <= a * (1 + 1e-9) for a, b in zip(trace, trace[1:]))
    joined = answered.join(broadcast_if_small(model.model.weights), "table_id")
    return joined.select(
        "table_id", "points", (F.abs(F.col("share") - 0.1) < 0.01).alias("share_near_nu"), (F.col("gap") < 0.2 * F.col("objective")).alias("near_optimum"), F.lit(falling).alias("falling"),
    )


# --- mixtures of the 64-dimensional embeddings ---------------------------------------------------------

DIMS = 64


def vectors(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "embeddings")
    return rows.select(F.col("label").alias("table_id"), "vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query(
    "gmm_vector_moments",
    """WITH E AS (SELECT label AS table_id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
X AS (SELECT table_id, CASE WHEN e[1] < 0 THEN 0 ELSE 1 END AS component, vec_id, d, e[d + 1] AS v FROM E, range(64) r(d)),
D AS (SELECT table_id, component, d, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM X GROUP BY ALL),
N AS (SELECT table_id, count(*) AS n FROM E GROUP BY table_id)
SELECT table_id, component, round(any_value(D.n)::DOUBLE / any_value(N.n), 6) AS weight, round(sum(m), 6) AS mean_sum, round(sqrt(sum(m * m)), 6) AS mean_norm,
       round(sum(s) + 64e-6, 6) AS variance FROM D JOIN N USING (table_id) GROUP BY table_id, component""",
)
def gmm_vector_moments(spark, sf_dir):
    """One estimate of full-covariance components over all rows, parted by the sign of the first feature."""
    rows = vectors(spark, sf_dir).withColumn("component", F.when(F.col("x")[0] < 0, 0).otherwise(1))
    total = lambda values, of: F.aggregate(values, F.lit(0.0), lambda t, v: t + of(v))
    return gmm_vector.of_parts(rows, BY, DIMS).select(
        "table_id", "component", F.round("weight", 6).alias("weight"), F.round(total("mean", lambda v: v), 6).alias("mean_sum"),
        F.round(F.sqrt(total("mean", lambda v: v * v)), 6).alias("mean_norm"), F.round(total("factor", lambda v: v * v), 6).alias("variance"),
    )


@query("gmm_vector_fit")
def gmm_vector_fit(spark, sf_dir):
    """Mixtures of all labels at once, until the likelihood settles; a unit test repeats them one by one in NumPy."""
    components, trace = gmm_vector.fit(vectors(spark, sf_dir), BY, DIMS)
    rising = all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))
    return components.select("table_id", "component", F.round("weight", 6).alias("weight"), F.lit(rising).alias("rising"))


@query("gmm_vector_band")
def gmm_vector_band(spark, sf_dir):
    """How many vectors of its own and of the next label lie within two deviations of a label's mean log-likelihood."""
    rows = vectors(spark, sf_dir)
    components, _ = gmm_vector.fit(rows, BY, DIMS)
    scored = materialize(gmm_vector.with_log_likelihood(rows, components, BY, DIMS))
    band = gmm.likelihood_band(scored, BY)
    foreign = rows.withColumn("table_id", (F.col("table_id") + 1) % 10)
    asked = scored.withColumn("side", F.lit("own")).unionByName(gmm_vector.with_log_likelihood(foreign, components, BY, DIMS).withColumn("side", F.lit("next")))
    inside = gmm.band_prediction(F.col("ll"), F.col("mean"), F.col("sigma"), 2.0) == 1
    return asked.join(broadcast_if_small(band), "table_id").groupBy("table_id", "side").agg(F.count_if(inside).alias("accepted"), F.count("*").alias("asked"))


@query("iforest_predict")
def iforest_predict(spark, sf_dir):
    """Accepted points and the mean score per table."""
    keys = fixtures.keys(spark, sf_dir)
    forest = family("isolationforest")
    model = forest.fit(keys, BY, forest.sample)
    rows = points(spark, sf_dir).groupBy("table_id", "x").agg(F.count("*").alias("n"))
    scored = iforest.score(rows, model.nodes, BY, model.trees, model.samples)
    return scored.groupBy("table_id").agg(
        F.sum(F.when(iforest.predict(F.col("score")) == 1, F.col("n")).otherwise(0)).alias("accepted"),
        F.sum("n").alias("points"), F.round(F.avg("score"), 6).alias("mean_score"),
    )


# --- text classes, grid search, surfaces ---------------------------------------------------------------


@query(
    "nb_classify",
    DOCS + """,
R AS (SELECT doc_id, term_id, n * idf AS w FROM TC JOIN V USING (term)),
Z AS (SELECT doc_id, sqrt(sum(w * w)) AS z FROM R GROUP BY doc_id),
X AS (SELECT doc_id, term_id, w / z AS w FROM R JOIN Z USING (doc_id)),
Y AS (SELECT DISTINCT l.doc_id, quality AS label FROM labels l JOIN X USING (doc_id)),
S AS (SELECT label, term_id, sum(w) AS s FROM X JOIN Y USING (doc_id) GROUP BY ALL),
C AS (SELECT label, ln(count(*) / (SELECT count(*) FROM Y)) AS prior FROM Y GROUP BY label),
T AS (SELECT label, sum(s) + (SELECT count(*) FROM V) AS total FROM S GROUP BY label),
J AS (SELECT x.doc_id, c.label, any_value(prior) + sum(x.w * (ln(coalesce(s, 0) + 1) - ln(total))) AS score
      FROM X x, C c JOIN T t USING (label) LEFT JOIN S s ON s.label = c.label AND s.term_id = x.term_id GROUP BY x.doc_id, c.label)
SELECT doc_id, arg_max(label, score) AS predicted, round(max(score), 6) AS score FROM J GROUP BY doc_id""",
)
def nb_classify(spark, sf_dir):
    counts, vocabulary = doc_features(spark, sf_dir)
    vocabulary = materialize(vocabulary)
    weights = materialize(features.tfidf(counts, vocabulary, ["doc_id"]))
    known = weights.select("doc_id").distinct()
    labels = fixtures.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).join(known, "doc_id", "left_semi")
    model = naive_bayes.fit(weights, labels, ["doc_id"], vocabulary.count())
    return naive_bayes.classify(weights, model, ["doc_id"]).withColumn("score", F.round("score", 6))


@query("cv_grid")
def cv_grid(spark, sf_dir):
    """Accuracy over five folds for both kernels, several widths and penalties; a unit test repeats it in NumPy."""
    rows = vectors(spark, sf_dir).withColumnRenamed("table_id", "label")
    width = cross_validation.scale_gamma(rows)
    kernels = [cross_validation.Kernel("linear"), *(cross_validation.Kernel("rbf", width * f) for f in (0.1, 1.0, 10.0))]
    found = cross_validation.grid_search(rows, "vec_id", kernels, [0.1, 1.0, 10.0, 100.0])
    return found.select("kernel", *[F.round(c, 6).alias(c) for c in ("gamma", "c", "mean_accuracy", "sd_accuracy")], "rank")


STEPS = 500


@query(
    "decision_grid",
    PROJECTED + intervals_sql(PARAMS) + f""",
B AS (SELECT table_id, min(x0) AS a0, max(x0) AS b0, min(x1) AS a1, max(x1) AS b1 FROM P GROUP BY table_id),
Q AS (SELECT table_id, i, j, a0 + i * ((b0 - a0) / {STEPS - 1}) AS x0, a1 + j * ((b1 - a1) / {STEPS - 1}) AS x1 FROM B, range({STEPS}) r(i), range({STEPS}) s(j)),
QJ AS (""" + " UNION ALL ".join(
        f"SELECT table_id, i, j, {d} AS dim, x0 * {w[0]!r}::DOUBLE + x1 * {w[1]!r}::DOUBLE AS v FROM Q" for d, w in enumerate(PLANES.tolist())
    ) + """),
H AS (SELECT q.table_id, i, j, count(v.lo) AS hits FROM QJ q LEFT JOIN I v ON v.table_id = q.table_id AND v.dim = q.dim AND v.lo < q.v AND q.v < v.hi GROUP BY ALL)
SELECT table_id, CAST(i AS INT) AS i, count(*) FILTER (hits > 3) AS accepted, CAST(sum(hits) AS BIGINT) AS hits FROM H GROUP BY ALL""",
)
def decision_grid(spark, sf_dir):
    rows = points(spark, sf_dir)
    intervals = rp.fit_intervals(long_points(spark, sf_dir), BY, PARAMS)
    surface = even_grid(rows, BY, STEPS)
    long = surface.select("table_id", "i", "j", F.posexplode(rp.project(F.array("x0", "x1"), PLANES)).alias("dim", "value"))
    scored = rp.score_long(long, intervals, BY, ["i", "j"])
    return scored.groupBy("table_id", "i").agg(
        F.count_if(rp.accept_rule(F.col("hits"), PARAMS)).alias("accepted"), F.sum("hits").alias("hits")
    )


def even_grid(rows, by: list[str], steps: int):
    """``steps`` x ``steps`` points over each table's range of both features."""
    a, b = F.col("x")[0], F.col("x")[1]
    ranges = rows.groupBy(*by).agg(F.min(a).alias("a0"), F.max(a).alias("b0"), F.min(b).alias("a1"), F.max(b).alias("b1"))
    axis = F.sequence(F.lit(0), F.lit(steps - 1))
    # A few ranges become many points: their rows are dealt out first, as what follows need not shuffle them.
    lines = ranges.withColumn("i", F.explode(axis)).repartition(rows.sparkSession.sparkContext.defaultParallelism, *by, "i")
    grid = lines.withColumn("j", F.explode(axis))
    place = lambda k, lo, hi: F.col(lo) + F.col(k) * ((F.col(hi) - F.col(lo)) / (steps - 1))
    return grid.select(*by, "i", "j", place("i", "a0", "b0").alias("x0"), place("j", "a1", "b1").alias("x1"))
