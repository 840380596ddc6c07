"""n-grams, bags of words, scalers, profiles and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from keysift.functions import text
from keysift.operators import features, scaling
from keysift.plans import fixtures
from keysift.plans.catalog import sql
from keysift.plans.catalog.base import query

BY = ["table_id"]


def stripped(spark, sf_dir):
    return fixtures.keys(spark, sf_dir).select("table_id", text.strip_prefix(F.col("key")).alias("s"))


def points(spark, sf_dir):
    return fixtures.keys(spark, sf_dir).select("table_id", "key", text.parse_key(F.col("key")).alias("x"))


S = sql.with_keys(""",
S AS (SELECT table_id, key, array_to_string(string_split(key, ':')[2:], ':') AS s FROM K),
W AS (SELECT max(length(s)) AS w FROM S)""")
PS = f"WITH {fixtures.P.strip()}"


def gram_profile(rows, grams):
    return rows.select(F.posexplode(grams).alias("place", "gram")).groupBy("place", "gram").agg(F.count("*").alias("n"))


def gram_profile_sql(grams: str, source: str = "S, W") -> str:
    return f"""
SELECT CAST(i - 1 AS INT) AS place, grams[i] AS gram, count(*) AS n
FROM (SELECT {grams} AS grams FROM {source}), range(1, 200) r(i) WHERE i <= len(grams) GROUP BY ALL"""


def pad(text_sql: str, width: str) -> str:
    return f"({text_sql} || repeat('0', CAST(greatest({width} - length({text_sql}), 0) AS BIGINT)))"


def slide(text_sql: str, size: int) -> str:
    return f"list_transform(range(1, length({text_sql}) - {size} + 2), lambda i: substr({text_sql}, i, {size}))"


@query(
    "max_key_len",
    PS + " SELECT max(length(key)) AS key_length, max(length(x0::VARCHAR)) AS number_length FROM P",
)
def max_key_len(spark, sf_dir):
    rows = points(spark, sf_dir)
    return rows.agg(
        F.max(F.length("key")).cast("bigint").alias("key_length"),
        F.length(text.float_text(F.max(F.col("x")[0]))).cast("bigint").alias("number_length"),
    )


@query("char_ngrams", S + gram_profile_sql(slide(pad("s", "w"), 4)))
def char_ngrams(spark, sf_dir):
    rows = stripped(spark, sf_dir)
    width = features.max_length(rows, "s")
    return gram_profile(rows, text.char_ngrams(F.col("s"), 4, F.lit(width)))


@query("char_ngrams_dim", S + gram_profile_sql(slide(pad("s", "8 + 4 - 1"), 4), "S"))
def char_ngrams_dim(spark, sf_dir):
    rows = stripped(spark, sf_dir)
    return gram_profile(rows, text.char_ngrams_dim(F.col("s"), 4, F.lit(8)))


@query("char_ngram_range", S + gram_profile_sql(f"{slide(pad('s', 'w'), 3)} || {slide(pad('s', 'w'), 4)}"))
def char_ngram_range(spark, sf_dir):
    rows = stripped(spark, sf_dir)
    width = features.max_length(rows, "s")
    return gram_profile(rows, text.char_ngram_range(F.col("s"), 3, 4, F.lit(width)))


NUMERIC = PS + """,
NW AS (SELECT max(length(x0::VARCHAR)) AS w0, max(length(x1::VARCHAR)) AS w1 FROM P),
E AS (SELECT table_id, [x0, x1] || list_transform({g0} || {g1}, lambda g: TRY_CAST(g AS DOUBLE)) AS x, [1, 1, w0 - 2, w1 - 2] AS widths FROM P, NW)
SELECT table_id, CAST(i - 1 AS INT) AS place, round(sum(x[i]), 6) AS total, count(x[i]) AS parsed, array_to_string(any_value(widths), ',') AS widths
FROM E, range(1, 100) r(i) WHERE i <= len(x) GROUP BY table_id, i"""


@query("numeric_ngrams", NUMERIC.format(g0=slide(pad("x0::VARCHAR", "w0"), 3), g1=slide(pad("x1::VARCHAR", "w1"), 3)))
def numeric_ngrams(spark, sf_dir):
    rows = points(spark, sf_dir)
    x, widths = numeric_expansion(rows, 3, 2)
    return rows.select("table_id", F.array_join(widths, ",").alias("widths"), F.posexplode(x).alias("place", "v")).groupBy(
        "table_id", "place"
    ).agg(F.round(F.sum("v"), 6).alias("total"), F.count("v").alias("parsed"), F.first("widths").alias("widths"))


def numeric_expansion(rows, size: int, columns: int):
    """``x`` with the numeric n-grams of every column's text appended, and what width came from where."""
    texts = [text.float_text(F.col("x")[i]) for i in range(columns)]
    longest = rows.agg(*[F.max(F.length(t)).alias(f"w{i}") for i, t in enumerate(texts)]).first()
    grams = [text.numbers(text.char_ngrams(t, size, F.lit(longest[i]))) for i, t in enumerate(texts)]
    widths = [1] * columns + [max(longest[i] - size + 1, 1) for i in range(columns)]
    return F.concat("x", *grams), F.array(*map(F.lit, widths))


@query(
    "gram_vector",
    f"""
WITH W AS (SELECT max(length(o_orderkey::VARCHAR)) AS w FROM orders),
V AS (SELECT o_custkey % 24 AS table_id, list_transform({slide(pad('o_orderkey::VARCHAR', 'w'), 3)}, lambda g: TRY_CAST(g AS DOUBLE)) AS x FROM orders, W)
SELECT table_id, CAST(i - 1 AS INT) AS place, sum(x[i]) AS total, CAST(any_value(len(x)) AS INT) AS dimension FROM V, range(1, 50) r(i) WHERE i <= len(x) GROUP BY table_id, i""",
)
def gram_vector(spark, sf_dir):
    orders = fixtures.table(spark, sf_dir, "orders")
    rows = orders.select((F.col("o_custkey") % 24).alias("table_id"), F.col("o_orderkey").cast("string").alias("s"))
    width = features.max_length(rows, "s")
    vector = text.numbers(text.char_ngrams(F.col("s"), 3, F.lit(width)))
    return rows.select("table_id", F.posexplode(vector).alias("place", "v")).groupBy("table_id", "place").agg(
        F.sum("v").alias("total"), F.lit(max(width - 2, 1)).alias("dimension")
    )


@query(
    "gram_sentence",
    S + f"""
SELECT table_id, min(t) AS first_sentence, max(t) AS last_sentence, CAST(sum(length(t)) AS BIGINT) AS length_sum
FROM (SELECT table_id, array_to_string({slide(pad('s', 'w'), 4)}, ' ') AS t FROM S, W) GROUP BY table_id""",
)
def gram_sentence(spark, sf_dir):
    rows = stripped(spark, sf_dir)
    width = features.max_length(rows, "s")
    sentence = text.gram_sentence(text.char_ngrams(F.col("s"), 4, F.lit(width)))
    return rows.select("table_id", sentence.alias("t")).groupBy("table_id").agg(
        F.min("t").alias("first_sentence"), F.max("t").alias("last_sentence"), F.sum(F.length("t")).alias("length_sum")
    )


TOKEN_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"
DOCS = f"""WITH TC AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({TOKEN_SQL.format('text')}) AS term FROM documents) GROUP BY ALL),
N AS (SELECT count(*) AS docs FROM documents),
V AS (SELECT term, row_number() OVER (ORDER BY encode(term)) - 1 AS term_id, count(*) AS df, ln((1.0 + any_value(docs)) / (1.0 + count(*))) + 1 AS idf FROM TC, N GROUP BY term)"""


def texts(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", "text")


def doc_features(spark, sf_dir):
    docs = texts(spark, sf_dir)
    counts = features.token_counts(docs, ["doc_id"], "text")
    return counts, features.with_idf(features.fit_vocabulary(counts), docs.count())


@query("vocab_fit", DOCS + " SELECT term, term_id, df FROM V")
def vocab_fit(spark, sf_dir):
    return doc_features(spark, sf_dir)[1].drop("idf")


@query(
    "vocab_fit_keys",
    S + f""",
TC AS (SELECT DISTINCT table_id, key, unnest({TOKEN_SQL.format("array_to_string(" + slide(pad('s', 'w'), 4) + ", ' ')")}) AS term FROM S, W)
SELECT term, row_number() OVER (ORDER BY encode(term)) - 1 AS term_id, count(*) AS df FROM TC GROUP BY term""",
)
def vocab_fit_keys(spark, sf_dir):
    keys = fixtures.keys(spark, sf_dir).distinct()
    return features.fit_gram_features(keys, ["table_id", "key"]).vocabulary.drop("idf")


@query(
    "term_counts",
    f"""WITH L AS (SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)),
TC AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({TOKEN_SQL.format('text')}) AS term FROM documents) GROUP BY ALL),
V AS (SELECT term, row_number() OVER (ORDER BY encode(term)) - 1 AS term_id FROM (SELECT DISTINCT term FROM TC SEMI JOIN L USING (doc_id)))
SELECT term_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM TC JOIN V USING (term) GROUP BY term_id""",
)
def term_counts(spark, sf_dir):
    """Counts of all English documents against the vocabulary of the labelled ones."""
    counts = features.token_counts(texts(spark, sf_dir), ["doc_id"], "text")
    labelled = fixtures.table(spark, sf_dir, "labels").select("doc_id").distinct()
    vocabulary = features.fit_vocabulary(counts.join(labelled, "doc_id", "left_semi")).drop("df")
    known = features.known_counts(counts, vocabulary)
    return known.groupBy("term_id").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query("idf_fit", DOCS + " SELECT term, df, round(idf, 6) AS idf FROM V")
def idf_fit(spark, sf_dir):
    return doc_features(spark, sf_dir)[1].select("term", "df", F.round("idf", 6).alias("idf"))


WEIGHTS = """,
R AS (SELECT doc_id, term_id, {w} AS w FROM TC JOIN V USING (term)),
Z AS (SELECT doc_id, sqrt(sum(w * w)) AS z FROM R GROUP BY doc_id)
SELECT doc_id, count(*) AS terms, round(sum(w / z), 6) AS weight_sum, round(max(w / z), 6) AS weight_max, round(sum(w / z * term_id), 3) AS weighted_ids FROM R JOIN Z USING (doc_id) GROUP BY doc_id"""


def weight_profile(weights):
    w = F.col("weight")
    return weights.groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.round(F.sum(w), 6).alias("weight_sum"), F.round(F.max(w), 6).alias("weight_max"),
        F.round(F.sum(w * F.col("term_id")), 3).alias("weighted_ids"),
    )


@query("tfidf", DOCS + WEIGHTS.format(w="n * idf"))
def tfidf(spark, sf_dir):
    return weight_profile(features.tfidf(*doc_features(spark, sf_dir), ["doc_id"]))


@query("tf_norm", DOCS + WEIGHTS.format(w="n::DOUBLE"))
def tf_norm(spark, sf_dir):
    return weight_profile(features.tfidf(*doc_features(spark, sf_dir), ["doc_id"], use_idf=False))


LONG = PS + """,
X AS (SELECT table_id, 0 AS dim, x0 AS v FROM P UNION ALL SELECT table_id, 1, x1 FROM P)"""
SCALED = LONG + """,
F AS (SELECT table_id, dim, {shift} AS shift, {scale} AS scale FROM X GROUP BY ALL),
Y AS (SELECT table_id, dim, 'own' AS scaler, (v - shift) / scale AS y, shift, scale FROM X JOIN F USING (table_id, dim)
      UNION ALL SELECT x.table_id, x.dim, 'next', (v - shift) / scale, shift, scale FROM X x JOIN F f ON f.table_id = (x.table_id + 1) % 24 AND f.dim = x.dim)
SELECT table_id, dim, scaler, round(any_value(shift), 6) AS shift, round(any_value(scale), 6) AS scale, round(min(y), 6) AS low, round(max(y), 6) AS high, round(sum(y * y), 4) AS squares FROM Y GROUP BY ALL"""


def scaled_profile(rows, scalers):
    """Rows under their own table's scaler and under the next table's."""
    parts = []
    for name, step in (("own", 0), ("next", 1)):
        shifted = rows.withColumn("s_id", ((F.col("table_id") + step) % fixtures.TABLES).cast("int"))
        scaled = scaling.apply_scaler(shifted, scalers, BY, ["s_id"])
        profile = scaling.long_form(scaled, ["table_id", "s_id"]).groupBy("table_id", "s_id", "dim").agg(
            F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"),
            F.round(F.sum(F.col("value") * F.col("value")), 4).alias("squares"),
        )
        used = scalers.select(
            F.col("table_id").alias("s_id"), "dim", F.round("shift", 6).alias("shift"), F.round("scale", 6).alias("scale")
        )
        parts.append(profile.join(used, ["s_id", "dim"]).drop("s_id").withColumn("scaler", F.lit(name)))
    return parts[0].unionByName(parts[1])


@query(
    "std_scale",
    SCALED.format(shift="avg(v)", scale="CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END"),
)
def std_scale(spark, sf_dir):
    rows = points(spark, sf_dir).select("table_id", "x")
    return scaled_profile(rows, scaling.fit_standard(rows, BY))


@query(
    "minmax_scale",
    SCALED.format(shift="min(v)", scale="CASE WHEN max(v) = min(v) THEN 1 ELSE max(v) - min(v) END"),
)
def minmax_scale(spark, sf_dir):
    rows = points(spark, sf_dir).select("table_id", "x")
    return scaled_profile(rows, scaling.fit_minmax(rows, BY))


@query(
    "column_profile",
    LONG + """
SELECT table_id, dim, round(avg(v), 6) AS mean, round(var_pop(v), 4) AS variance, round(stddev_pop(v), 6) AS deviation, min(v) AS low, max(v) AS high FROM X GROUP BY ALL""",
)
def column_profile(spark, sf_dir):
    profile = scaling.column_profile(points(spark, sf_dir), BY)
    return (
        profile.withColumn("mean", F.round("mean", 6)).withColumn("variance", F.round("variance", 4))
        .withColumn("deviation", F.round("deviation", 6))
    )


@query(
    "histogram",
    PS + """,
R AS (SELECT table_id, min(x0) AS low, (max(x0) - min(x0)) / 30 AS width, count(*) AS n FROM P GROUP BY table_id),
B AS (SELECT table_id, CAST(least(floor((x0 - low) / width), 29) AS INT) AS bin, count(*) AS c FROM P JOIN R USING (table_id) GROUP BY ALL)
SELECT r.table_id, CAST(i AS INT) AS bin, coalesce(c, 0) AS count, round(low + i * width, 6) AS edge, round(coalesce(c, 0) / (n * width), 6) AS density
FROM R r, range(30) g(i) LEFT JOIN B b ON b.table_id = r.table_id AND b.bin = i""",
)
def histogram(spark, sf_dir):
    rows = points(spark, sf_dir).select("table_id", F.col("x")[0].alias("v"))
    binned = scaling.histogram(rows, BY, "v", 30)
    return binned.withColumn("edge", F.round("edge", 6)).withColumn("density", F.round("density", 6))


@query("distinct_values", "SELECT DISTINCT l_extendedprice AS value FROM lineitem")
def distinct_values(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("value")).distinct().orderBy("value")
