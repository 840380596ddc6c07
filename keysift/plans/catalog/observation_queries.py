"""Analytics over sweep observations: compile, rank, select, compare, pivot, margins."""

from __future__ import annotations

from pyspark.sql import functions as F

from keysift.functions.text import parse_key
from keysift.operators import observations, scaling
from keysift.operators.occ import rbf
from keysift.plans import fixtures
from keysift.plans.catalog.base import query
from keysift.plans.catalog.model_queries import RBF, WIDTH, rbf_scores, rbf_sql

PARAMS = ["nu", "gamma", "tol"]
G = f"WITH {fixtures.G.strip()}"


@query(
    "compile_obs",
    G + """,
R AS (SELECT * FROM G WHERE size % 7 <> 0),
X AS (SELECT nu, gamma, tol FROM (SELECT DISTINCT l_discount AS nu FROM lineitem), (SELECT DISTINCT l_tax AS gamma FROM lineitem), (SELECT DISTINCT l_quantity AS tol FROM lineitem))
SELECT x.nu, x.gamma, x.tol, g.nu IS NOT NULL AS ran, round(coalesce(fpr, 1), 6) AS fpr, coalesce(bfsize, 1000000)::DOUBLE AS bfsize, coalesce(size, 10000000000)::DOUBLE AS size,
       coalesce(falsepositive_c, -1) AS falsepositive_c, coalesce(falsepositive_bf, -1) AS falsepositive_bf, coalesce(errors, -1) AS error_train,
       (SELECT sum(errors) FROM R)::BIGINT AS points
FROM X x LEFT JOIN R g ON g.nu = x.nu AND g.gamma = x.gamma AND g.tol = x.tol""",
)
def compile_obs(spark, sf_dir):
    """Missing runs are the feature here: those whose size is divisible by seven did not end."""
    lines, runs = fixtures.table(spark, sf_dir, "lineitem"), fixtures.runs(spark, sf_dir).where("size % 7 <> 0")
    grid = observations.full_grid(lines, {"nu": "l_discount", "gamma": "l_tax", "tol": "l_quantity"})
    compiled = observations.compile_observations(grid, runs, PARAMS)
    points = runs.agg(F.sum(observations.error_total()))
    return compiled.withColumn("fpr", F.round("fpr", 6)).withColumn("points", points.scalar())


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


TOP = " SELECT nu, gamma, tol, round(fpr, 6) AS fpr, size FROM G{where} ORDER BY fpr, size, nu, gamma, tol LIMIT {n}"


@query("top_configs", G + TOP.format(where="", n=50))
def top_configs(spark, sf_dir):
    best = observations.top_configs(fixtures.runs(spark, sf_dir), 50, ["fpr", "size", *PARAMS])
    return rounded(best.select(*PARAMS, "fpr", "size"), "fpr")


@query(
    "configs_by_fpr",
    G + """
SELECT round(fpr, 6) AS fpr, count(*) AS configs, count(DISTINCT size) AS sizes, min(size) AS smallest,
       arg_min(nu || '_' || gamma || '_' || tol, (size, nu, gamma, tol)) AS smallest_config FROM G GROUP BY fpr""",
)
def configs_by_fpr(spark, sf_dir):
    return rounded(observations.smallest_by_fpr(fixtures.runs(spark, sf_dir), PARAMS), "fpr")


@query(
    "configs_by_fpr_size",
    G + """
SELECT round(fpr, 6) AS fpr, size, count(*) AS configs, arg_min(nu || '_' || gamma || '_' || tol, (nu, gamma, tol)) AS first_config FROM G GROUP BY fpr, size""",
)
def configs_by_fpr_size(spark, sf_dir):
    return rounded(observations.by_fpr_and_size(fixtures.runs(spark, sf_dir), PARAMS), "fpr")


WEIGHTED = """ SELECT round(sum(nu * w) / sum(w), 6) AS nu, round(sum(gamma * w) / sum(w), 6) AS gamma, round(sum(tol * w) / sum(w), 6) AS tol
FROM (SELECT *, CASE WHEN size * fpr <> 0 THEN 1.0 / (size * fpr) END AS w FROM {0})  WHERE w IS NOT NULL"""


@query("weighted_params", G + WEIGHTED.format("G"))
def weighted_params(spark, sf_dir):
    return rounded(observations.weighted_means(fixtures.runs(spark, sf_dir), PARAMS), *PARAMS)


@query("best_fpr", G + " SELECT nu, gamma, tol, round(fpr, 6) AS fpr FROM G WHERE fpr < 1 ORDER BY G.fpr, nu, gamma, tol LIMIT 1")
def best_fpr(spark, sf_dir):
    return rounded(observations.lowest_fpr(fixtures.runs(spark, sf_dir), PARAMS), "fpr")


BASE = G + """,
B AS (SELECT avg(fpr) AS base_fpr, avg(bfsize) AS base_bytes FROM G)"""


def baseline(runs):
    """The stand-in for the plain-filter run: mean rate and mean filter size of the sweep."""
    return runs.agg(F.avg("fpr").alias("fpr"), F.avg("bfsize").alias("bytes"))


@query(
    "best_constrained",
    BASE + """,
S AS (SELECT 'smallest' AS choice, nu || '_' || gamma || '_' || tol AS config, fpr, size + bfsize AS total FROM G WHERE fpr < 0.2 ORDER BY total, nu, gamma, tol LIMIT 1),
L AS (SELECT 'last_better' AS choice, nu || '_' || gamma || '_' || tol AS config, fpr, size + bfsize AS total FROM G, B WHERE fpr < base_fpr ORDER BY nu DESC, gamma DESC, tol DESC LIMIT 1)
SELECT choice, config, round(fpr, 6) AS fpr, total, round(fpr / base_fpr, 6) AS fpr_ratio, round(total / base_bytes, 6) AS bytes_ratio FROM (SELECT * FROM S UNION ALL SELECT * FROM L), B""",
)
def best_constrained(spark, sf_dir):
    runs = fixtures.runs(spark, sf_dir)
    return rounded(observations.constrained_best(runs, PARAMS, baseline(runs)), "fpr", "fpr_ratio", "bytes_ratio")


@query(
    "vs_baseline",
    BASE + """ SELECT nu, gamma, tol, round(fpr - base_fpr, 6) AS fpr_delta, round(size + bfsize - base_bytes, 6) AS bytes_delta, fpr < base_fpr AS better_fpr, size + bfsize < base_bytes AS better_bytes FROM G, B""",
)
def vs_baseline(spark, sf_dir):
    runs = fixtures.runs(spark, sf_dir)
    compared = observations.against_baseline(runs, baseline(runs))
    return rounded(compared.select(*PARAMS, "fpr_delta", "bytes_delta", "better_fpr", "better_bytes"), "fpr_delta", "bytes_delta")


@query(
    "cost_columns",
    G + """ SELECT nu, gamma, tol, size + bfsize AS total, size * bfsize AS size_product, round(pow(fpr, 3) * (size + bfsize), 6) AS fpr_cubed_total, round(fpr * bfsize, 6) AS fpr_bf FROM G""",
)
def cost_columns(spark, sf_dir):
    costs = observations.cost_columns(fixtures.runs(spark, sf_dir)).orderBy("size_product")
    return rounded(costs.select(*PARAMS, "total", "size_product", "fpr_cubed_total", "fpr_bf"), "fpr_cubed_total", "fpr_bf")


@query(
    "metric_pivot",
    G + " SELECT nu, " + ", ".join(f"round(min(fpr) FILTER (round(gamma * 100) = {i}), 6) AS g{i}" for i in range(9)) + " FROM G GROUP BY nu",
)
def metric_pivot(spark, sf_dir):
    runs = fixtures.runs(spark, sf_dir).withColumn("g", F.concat(F.lit("g"), F.round(F.col("gamma") * 100).cast("int").cast("string")))
    return observations.metric_matrix(runs, "nu", "g", [f"g{i}" for i in range(9)], F.round(F.min("fpr"), 6))


@query(
    "axis_index",
    " UNION ALL ".join(
        f"SELECT '{name}' AS axis, {column} AS value, CAST(row_number() OVER (ORDER BY {column}) - 1 AS INT) AS \"index\" FROM (SELECT DISTINCT {column} FROM lineitem)"
        for name, column in (("nu", "l_discount"), ("gamma", "l_tax"), ("tol", "l_quantity"))
    ),
)
def axis_index(spark, sf_dir):
    lines = fixtures.table(spark, sf_dir, "lineitem")
    parts = [
        observations.axis(lines, column, "value").withColumn("axis", F.lit(name))
        for name, column in (("nu", "l_discount"), ("gamma", "l_tax"), ("tol", "l_quantity"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "cap_configs",
    G + ", C AS (SELECT * FROM G WHERE fpr <= 0.31)" + WEIGHTED.format("C").replace(" SELECT", " SELECT (SELECT count(*) FROM C) AS kept, (SELECT min(size) FROM C) AS smallest,", 1),
)
def cap_configs(spark, sf_dir):
    kept = observations.capped(fixtures.runs(spark, sf_dir), 0.31)
    counts = kept.agg(F.count("*").alias("kept"), F.min("size").alias("smallest"))
    means = rounded(observations.weighted_means(kept, PARAMS), *PARAMS)
    return means.withColumn("kept", counts.select("kept").scalar()).withColumn("smallest", counts.select("smallest").scalar())


# --- rejects, accepts and margins of the RBF model -------------------------------------------------

NEXT_SCORES = rbf_sql() + f""",
NS AS (SELECT f.table_id, (x0 - m0) / d0 AS s0, (x1 - m1) / d1 AS s1 FROM P p JOIN C f ON f.table_id <> p.table_id),
NZ AS (SELECT table_id, """ + ", ".join(
    f"cos({p!r}::DOUBLE + s0 * {w[0]!r}::DOUBLE + s1 * {w[1]!r}::DOUBLE) * {(2.0 / RBF.features) ** 0.5!r}::DOUBLE AS z{i}"
    for i, (w, p) in enumerate(zip(*(a.tolist() for a in rbf.fourier_basis(RBF, WIDTH))))
) + f""" FROM NS),
NA AS (SELECT table_id, {' + '.join(f'z{i} * a{i}' for i in range(RBF.features))} - threshold AS margin FROM NZ JOIN M USING (table_id) JOIN T USING (table_id))"""


@query(
    "error_cases",
    NEXT_SCORES + """,
O1 AS (SELECT table_id, count(*) FILTER (score + intercept <= -0.001) AS train_rejects, count(*) AS n FROM A GROUP BY table_id),
O2 AS (SELECT table_id, count(*) FILTER (margin > -0.001) AS test_accepts, count(*) AS tested FROM NA GROUP BY table_id)
SELECT table_id, train_rejects, round(train_rejects::DOUBLE / n, 6) AS reject_rate, round(train_rejects::DOUBLE / n - 0.1, 6) AS nu_gap, test_accepts, tested FROM O1 JOIN O2 USING (table_id)""",
)
def error_cases(spark, sf_dir):
    """Own rows a table rejects, and rows of all other tables that it accepts."""
    rows = fixtures.keys(spark, sf_dir).select("table_id", parse_key(F.col("key")).alias("x"))
    scalers = scaling.fit_standard(rows, ["table_id"])
    model = rbf.fit(scaling.apply_scaler(rows, scalers, ["table_id"]), ["table_id"], RBF, WIDTH)
    own = model.predict(scaling.apply_scaler(rows, scalers, ["table_id"])).withColumn("side", F.lit("own"))
    # Every row asks every other table: the measure itself is that product, and it streams into the counters.
    others = F.filter(F.sequence(F.lit(0), F.lit(fixtures.TABLES - 1)), lambda t: t != F.col("table_id"))
    asked = rows.withColumn("table_id", F.explode(others))
    other = model.predict(scaling.apply_scaler(asked, scalers, ["table_id"])).withColumn("side", F.lit("other"))
    every = own.unionByName(other)
    mine = F.col("side") == "own"
    rejects, rows_own = F.count_if(mine & (F.col("prediction") == -1)), F.count_if(mine)
    return every.groupBy("table_id").agg(
        rejects.alias("train_rejects"), F.round(rejects / rows_own, 6).alias("reject_rate"), F.round(rejects / rows_own - RBF.nu, 6).alias("nu_gap"),
        F.count_if(~mine & (F.col("prediction") == 1)).alias("test_accepts"), F.count_if(~mine).alias("tested"),
    )


@query(
    "margin_distribution",
    rbf_sql() + """,
D AS (SELECT table_id, score + intercept AS margin FROM A WHERE score + intercept <= 0),
DL AS (SELECT 'bottom' AS part, round(margin, 6) AS margin FROM D ORDER BY D.margin LIMIT 20),
DT AS (SELECT 'top' AS part, round(margin, 6) AS margin FROM D ORDER BY D.margin DESC LIMIT 5)
SELECT * FROM DL UNION ALL SELECT * FROM DT UNION ALL SELECT 'least', round(min(margin), 6) FROM D GROUP BY table_id
UNION ALL SELECT 'rejects', count(*)::DOUBLE FROM D GROUP BY table_id""",
)
def margin_distribution(spark, sf_dir):
    """Lowest and highest margins of rejected rows, the least per table, and the number of rejects."""
    scored = rbf_scores(spark, sf_dir)
    margins = scored.select("table_id", (F.col("score") + F.col("intercept")).alias("margin")).where("margin <= 0")
    part = lambda df, name: df.select(F.lit(name).alias("part"), F.round("margin", 6).alias("margin"))
    low, high = margins.orderBy("margin").limit(20), margins.orderBy(F.desc("margin")).limit(5)
    by_table = margins.groupBy("table_id")
    least, counts = by_table.agg(F.min("margin").alias("margin")), by_table.agg(F.count("*").cast("double").alias("margin"))
    return part(low, "bottom").unionByName(part(high, "top")).unionByName(part(least, "least")).unionByName(part(counts, "rejects"))
