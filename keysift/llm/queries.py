"""The registered queries of this subpackage and the SQL that some are compared with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm import (
    byte_bpe, contamination, exact_dedup, fertility, filter_audit, licenses, lm, near_dup, pii, repeats, resampling, token_cache, token_files,
)
from keysift.llm.tables import documents
from keysift.session import scratch_path

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENS = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), public_tokenizers.path(BYTE_RANKS))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    manifest = token_files.write_tokens(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENS), folder, end_id=2)
    return token_files.read_tokens(spark, manifest, folder)


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), size=3, percent=85).drop("n_links")


def op8_suffix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination.matches(documents(spark, sf_dir), items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated")


def op9_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.token_counts(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENS), scratch_path(spark, "token-cache"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(documents(spark, sf_dir), keep_first=False).drop("spans")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir, "doc_id", "text", "source"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir), keep="largest")


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scores, op2_byte_bpe, op3_licenses, op4_token_files, op5_fertility, op6_personal_data, op7_near_duplicates, op8_suffix_matches,
        op9_token_cache, op10_repeated_passages, op11_filter_audit, op12_importance_resampling, op13_exact_duplicates,
    )
}
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op7_near_duplicates": rf"""WITH RECURSIVE
D AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
S AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS shingle FROM D, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) t(i)),
N AS (SELECT doc_id, count(*) AS n FROM S GROUP BY doc_id),
P AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM S a JOIN S b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
L AS (SELECT u, v FROM P JOIN N a ON a.doc_id = u JOIN N b ON b.doc_id = v WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
E AS (SELECT u, v FROM L UNION ALL SELECT v, u FROM L),
C(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a, v FROM C JOIN E ON u = b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM C JOIN D ON doc_id = a LEFT JOIN N USING (doc_id) GROUP BY doc_id, n""",
    "op8_suffix_matches": rf"""WITH
D AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
B AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
W AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM B, unnest(range(1, len(w) - n + 2)) t(i)),
Z AS (SELECT DISTINCT n FROM W),
X AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM D CROSS JOIN Z, unnest(range(1, len(w) - n + 2)) t(i)),
H AS (SELECT doc_id, i, n, item_id FROM X JOIN W USING (n, win)),
C AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM H) GROUP BY doc_id),
I AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM H GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM D LEFT JOIN C USING (doc_id) LEFT JOIN I USING (doc_id)""",
    "op10_repeated_passages": """WITH
D AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
W AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM D, unnest(range(0, n - 199)) t(i)),
R AS (SELECT m FROM W GROUP BY m HAVING count(*) > 1),
P AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM W SEMI JOIN R USING (m)),
G AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM P),
S AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM G GROUP BY doc_id, g),
K AS (SELECT doc_id, s, e, substr(h, 2 * coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) + 1, 2 * (s - coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0))) AS piece FROM S JOIN D USING (doc_id)),
T AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(e - s) AS BIGINT) AS n_removed, max(e) AS e, string_agg(piece, '' ORDER BY s) AS pieces FROM K GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE pieces || substr(h, 2 * e + 1) END)) AS kept_sha256 FROM D LEFT JOIN T USING (doc_id)""",
    "op11_filter_audit": r"""WITH
D AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
L AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
E AS (SELECT t, min(doc_id) AS first FROM D GROUP BY t),
M AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e
      FROM D JOIN E USING (t) LEFT JOIN L USING (doc_id)),
F AS (SELECT part, good, bad, unnest([{'f': 'A', 'x': a}, {'f': 'B', 'x': b}, {'f': 'C', 'x': c}, {'f': 'D', 'x': d}, {'f': 'E', 'x': e}], recursive := true),
        (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM M),
S AS (SELECT part, f, fails, x, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad FROM F GROUP BY ALL),
X AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
O AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM X p, X q, X r, X s, X t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
P AS (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM O, range(1, 6) r(step)),
C AS (SELECT part, filter_order, step, f,
        sum(CASE WHEN NOT x AND NOT met THEN n ELSE 0 END) AS kept, sum(CASE WHEN x AND NOT met THEN n ELSE 0 END) AS removed, sum(CASE WHEN x AND met THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN x AND NOT met THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN x AND NOT met THEN n_bad ELSE 0 END) AS toxic_lost
      FROM (SELECT *, before <> '' AND regexp_matches(fails, '[' || before || '_]') AS met FROM S JOIN P USING (f)) GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM C""",
    "op13_exact_duplicates": f"""WITH D AS (SELECT doc_id, {LOWERED} AS t FROM documents),
G AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM D GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM D JOIN G USING (t)""",
}
