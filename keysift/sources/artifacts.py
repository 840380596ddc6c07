"""Run artifacts: observation reports as JSON and CSV, and partitioned tables of fitted state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from keysift.operators.ordering import grouped_row_number
from keysift.sources.keyfiles import write_lines


def params_text(*columns: str) -> Column:
    """A configuration's parameters as one text, used as its address."""
    return F.concat_ws("_", *[F.col(c).cast("string") for c in columns])


def write_observation_json(runs: DataFrame, path: str, order: list[str]) -> None:
    """One JSON document ``{"data": [...]}`` over the part files in name order; no row is collected."""
    numbered = grouped_row_number(runs, [], order, "_line")
    record = F.to_json(F.struct(*runs.columns))
    lead = F.when(F.col("_line") == 0, '{"data":[').otherwise(",")
    body = numbered.select("_line", F.concat(lead, record).alias("value"))
    empty = runs.limit(1).select(F.lit(1)).isEmpty()
    close = runs.sparkSession.range(1).select(
        F.lit((1 << 62)).alias("_line"), F.lit('{"data":[]}' if empty else "]}").alias("value")
    )
    write_lines(body.unionByName(close), path, ["_line"])


def read_observation_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The records of a written document; lines are read in parallel."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r'^(\{"data":\[|,)', "").alias("value"))
    # JSON object keys are text; maps are read with text keys and cast back.
    text_keys = StructType([
        StructField(f.name, MapType(StringType(), f.dataType.valueType) if isinstance(f.dataType, MapType) else f.dataType)
        for f in schema
    ])
    records = lines.where("value <> ']}'").select(F.from_json("value", text_keys).alias("r"))

    def field(f: StructField) -> Column:
        value = F.col(f"r.{f.name}")
        if isinstance(f.dataType, MapType):
            value = F.transform_keys(value, lambda k, _: k.cast(f.dataType.keyType))
        return value.alias(f.name)

    return records.select(*[field(f) for f in schema])


def write_csv(runs: DataFrame, path: str) -> None:
    runs.write.option("header", True).csv(path)


def save_artifact(df: DataFrame, path: str, run: Column, param_id: Column) -> None:
    """Append to a table partitioned by run name; ``param_id`` addresses a configuration inside it."""
    df.withColumn("run", run).withColumn("param_id", param_id).write.mode("append").partitionBy("run").parquet(path)


def load_artifact(spark: SparkSession, path: str, run: str, param_id: str | None = None) -> DataFrame:
    """Read one run back; only its partition is listed, and the parameter filter reaches the scan."""
    found = spark.read.parquet(path).where(F.col("run") == run)
    return found if param_id is None else found.where(F.col("param_id") == param_id)
