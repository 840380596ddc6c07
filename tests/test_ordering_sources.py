import json
import os

from pyspark.sql import functions as F

from keysift.operators import ordering
from keysift.session import scratch_path
from keysift.sources import artifacts, keyfiles, registry


def test_row_numbers_in_a_hot_group(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("int").alias("g"), (F.col("id") * 7919 % 4001).alias("v")
    )
    ranked = ordering.grouped_row_number(rows, ["g"], ["v"], "pos", with_size="size").collect()
    groups = {}
    for r in ranked:
        groups.setdefault(r["g"], []).append(r)
    for got in groups.values():
        got.sort(key=lambda r: r["v"])
        assert [r["pos"] for r in got] == list(range(len(got)))
        assert {r["size"] for r in got} == {len(got)}


def test_row_numbers_of_equal_keys_are_gapless(spark):
    rows = spark.range(3000).select(F.lit(1).alias("g"), F.lit("same").alias("v"))
    ranked = ordering.grouped_row_number(rows, ["g"], ["v"], "pos")
    assert sorted(r["pos"] for r in ranked.collect()) == list(range(3000))


def test_tiles_differ_by_at_most_one(spark):
    rows = spark.range(103).select((F.col("id") % 2).alias("g"), "id")
    sizes = ordering.grouped_ntile(rows, ["g"], ["id"], 5, "tile").groupBy("g", "tile").count().collect()
    for g, n in ((0, 52), (1, 51)):
        counts = [r["count"] for r in sorted(sizes, key=lambda r: r["tile"]) if r["g"] == g]
        assert counts == [n // 5 + (i < n % 5) for i in range(5)]


def test_quantiles_are_exact(spark):
    values = {g: [((i * 37) % 101) * 0.5 if g else 3.0 for i in range(80 + g)] for g in range(3)}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g int, v double")
    got = {r["g"]: r["q"] for r in ordering.grouped_order_statistics(rows, ["g"], "v", 0.3, "q", buckets=8).collect()}
    assert got == {g: sorted(vs)[int(0.3 * (len(vs) - 1))] for g, vs in values.items()}


def test_key_files_keep_order_rank_empty_files_and_trim(spark, tmp_path):
    for name, lines in (("b.db", ["k2  ", "k1\t"]), ("a.db", []), ("c.db", [f"r{i}" for i in range(50)])):
        (tmp_path / name).write_text("".join(line + "\n" for line in lines))
    keys = registry.read_keys(spark, "vdisk", f"{tmp_path}/*.db").orderBy("table_id", "pos").collect()
    assert [(r["table_id"], r["pos"], r["key"]) for r in keys][:2] == [(1, 0, "k2"), (1, 1, "k1")]
    assert [r["key"] for r in keys if r["table_id"] == 2] == [f"r{i}" for i in range(50)]
    raw = keyfiles.scan_key_files(spark, f"{tmp_path}/b.db", trim=False).orderBy("pos").collect()
    assert [r["key"] for r in raw] == ["k2  ", "k1\t"]


def test_observation_document_is_one_json_object(spark):
    runs = spark.createDataFrame([(i, {1: i, 2: 2 * i}) for i in range(40)], "nu int, error_train map<int,bigint>")
    path = scratch_path(spark, "test-json")
    artifacts.write_observation_json(runs, path, ["nu"])
    local = path.removeprefix("file:")
    parts = sorted(p for p in os.listdir(local) if p.startswith("part-"))
    document = json.loads("".join(open(f"{local}/{p}").read() for p in parts))
    assert [d["nu"] for d in document["data"]] == list(range(40))
    assert artifacts.read_observation_json(spark, path, runs.schema).where("error_train[2] = 2 * nu").count() == 40
