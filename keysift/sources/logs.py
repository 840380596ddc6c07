"""Flush, read and compaction log lines as typed rows; lines that do not fit are kept and flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token positions of the three layouts, and the key decoration of flush lines.
TIME_TOKEN = 3
FLUSH_KEY_TOKEN = 10
READ_CF_TOKEN = 28
READ_KEY_TOKEN = 29
DECORATION = "DecoratedKey("
TABLE_MARK = "SSTableReader"


def line_tokens(line: Column) -> Column:
    """The line without its first and last character, split on blanks."""
    return F.split(F.substring(line, F.lit(2), F.greatest(F.length(line) - 2, F.lit(0))), " ")


def token(tokens: Column, index: int) -> Column:
    return F.get(tokens, F.lit(index))


def drop_last(text: Column, count: int) -> Column:
    return F.substring(text, F.lit(1), F.greatest(F.length(text) - count, F.lit(0)))


def path_part(path: Column, from_end: int) -> Column:
    """The ``from_end``-th last part of a path; NULL where there is none."""
    parts = F.split(path, "/")
    return F.try_element_at(parts, F.lit(-from_end))


def normal_time(time: Column) -> Column:
    return F.replace(time, F.lit(","), F.lit("."))


def parse_flush_log(lines: DataFrame) -> DataFrame:
    t = lines.withColumn("_t", line_tokens(F.col("value")))
    raw = drop_last(token(F.col("_t"), FLUSH_KEY_TOKEN), 1)
    key = F.when(raw.startswith(DECORATION), F.substring(raw, F.lit(len(DECORATION) + 1), F.length(raw))).otherwise(raw)
    table = F.try_element_at(F.col("_t"), F.lit(-1))
    parsed = t.select(
        "value", normal_time(token(F.col("_t"), TIME_TOKEN)).alias("time"), path_part(table, 2).alias("cf"), table.alias("table"), key.alias("key")
    )
    return _flag(parsed, ["time", "cf", "table", "key"])


def parse_read_log(lines: DataFrame) -> DataFrame:
    t = lines.withColumn("_t", line_tokens(F.col("value")))
    key = token(F.split(drop_last(token(F.col("_t"), READ_KEY_TOKEN), 1), "="), 1)
    quoted = token(F.split(token(F.split(token(F.col("_t"), READ_CF_TOKEN), r"\("), 1), "="), 1)
    cf = F.substring(quoted, F.lit(2), F.greatest(F.length(quoted) - 3, F.lit(0)))
    parsed = t.select("value", normal_time(token(F.col("_t"), TIME_TOKEN)).alias("time"), cf.alias("cf"), key.alias("key"))
    return _flag(parsed, ["time", "cf", "key"])


def parse_compaction_log(lines: DataFrame) -> DataFrame:
    t = lines.withColumn("_t", line_tokens(F.col("value")))
    marked = F.filter("_t", lambda s: s.contains(TABLE_MARK))
    paths = F.transform(marked, lambda s: drop_last(F.substring(s, F.locate("/", s), F.length(s)), 2))
    parsed = t.select("value", normal_time(token(F.col("_t"), TIME_TOKEN)).alias("time"), paths.alias("_p"))
    parsed = parsed.select(
        "value", "time", F.try_element_at("_p", F.lit(-1)).alias("table"),
        F.slice("_p", F.lit(1), F.greatest(F.size("_p") - 1, F.lit(0))).alias("inputs"),
    )
    return _flag(parsed, ["time", "table"])


def _flag(parsed: DataFrame, needed: list[str]) -> DataFrame:
    """``_corrupt`` holds the raw line where a needed field is missing."""
    broken = F.lit(False)
    for c in needed:
        broken = broken | F.col(c).isNull()
    return parsed.withColumn("_corrupt", F.when(broken, F.col("value"))).drop("value")


def normalize_table_name(name: Column) -> Column:
    """Delete the four characters at the second hyphen (a temporary-table mark); names without one stay."""
    # The parts around the first two hyphens; a name with fewer has no third part.
    parts = F.split(name, "-", 3)
    tail = F.get(parts, F.lit(2))
    joined = F.concat(F.get(parts, F.lit(0)), F.lit("-"), F.get(parts, F.lit(1)), F.substring(tail, F.lit(4), F.length(tail)))
    return F.when(tail.isNotNull(), joined).otherwise(name)


# --- rendering, for logs that come from tables --------------------------------------------------


def render_flush(time: Column, key: Column, table: Column, decorated: Column) -> Column:
    shown = F.concat(F.when(decorated, F.lit(DECORATION)).otherwise(F.lit("")), key, F.lit(","))
    return F.concat(F.lit("'"), F.concat_ws(" ", F.lit("INFO [flush] 2024-01-01"), time, F.lit("writer (line 1) flushed one key"), shown, F.lit("to"), table), F.lit("'"))


def render_read(time: Column, cf: Column, key: Column) -> Column:
    filler = F.lit(" ".join(f"f{i}" for i in range(4, READ_CF_TOKEN)))
    name = F.concat(F.lit("Query(name='"), cf, F.lit("',"))
    return F.concat(F.lit("'"), F.concat_ws(" ", F.lit("INFO [read] 2024-01-01"), time, filler, name, F.concat(F.lit("key="), key, F.lit(",")), F.lit("end")), F.lit("'"))


def render_compaction(time: Column, inputs: Column, output: Column) -> Column:
    reader = lambda p: F.concat(F.lit(f"{TABLE_MARK}(path="), p, F.lit("),"))
    return F.concat(
        F.lit("'"), F.concat_ws(" ", F.lit("INFO [compact] 2024-01-01"), time, F.lit("compacted"), F.array_join(F.transform(inputs, reader), " "), F.lit("to"), reader(output), F.lit("end")), F.lit("'")
    )
