import hashlib
import random
import string
import struct

import pytest
from pyspark.sql import functions as F

from keysift.functions import hashing
from keysift.functions.hashing import HashScheme, word_width
from keysift.operators import bloom, scalable_bloom
from keysift.session import scratch_path

BY = ["table_id"]

# Fixed values: (num_slices, bits_per_slice) and the positions of the key 1:2:ff.
GOLDEN = [
    (4, 11982, [322, 6136, 9716, 778]),
    (4, 71888, [15224, 67588, 3197, 10548]),
    (2, 6265, [3847, 5040]),
    (10, 144, [87, 136, 34, 32, 23, 20, 7, 17, 37, 64]),
    (14, 137, [28, 46, 87, 114, 131, 116, 131, 105, 77, 19, 104, 27, 100, 79]),
    (4, 2147483659, [788711361, 1386590399, 1103978460, 780631382]),
    (10, 143776, [69889, 46994, 67595, 11613, 109541, 44441, 50561, 105467, 111492, 22935]),
    (17, 84575, [9876, 3805, 34242, 10950, 17563, 17394, 74345, 11378, 80612, 36064, 26954, 10671, 80267, 42718, 12065, 61541, 61474]),
]


@pytest.mark.parametrize("slices,size,expected", GOLDEN)
def test_golden_positions(spark, slices, size, expected):
    df, words = hashing.with_digests(spark.createDataFrame([("1:2:ff",)], "key string"), "key", HashScheme(slices, word_width(size)), "_d")
    got = df.select(F.posexplode(words).alias("i", "w")).select("i", (F.col("w") % size).cast("bigint").alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == expected


def key_rows(spark, tables):
    rows = [(t, i, k) for t, keys in tables.items() for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "table_id int, pos long, key string")


def capacity(spark, tables, n):
    return spark.createDataFrame([(t, n) for t in tables], "table_id int, capacity long")


def members(filters, probes):
    pairs = bloom.with_digests(probes, filters)
    return {(r["table_id"], r["key"]) for r in bloom.probe_hits(pairs, filters).collect()}


def letter_filters(spark, rate=0.001, n=100):
    first, second = string.ascii_lowercase[:13], string.ascii_lowercase[13:]
    params = bloom.size_filters(capacity(spark, [0], n), BY, rate)
    probes = key_rows(spark, {0: string.ascii_lowercase}).drop("pos")
    low = bloom.build_filters(key_rows(spark, {0: first}), params, BY, rate)
    high = bloom.build_filters(key_rows(spark, {0: second}), params, BY, rate)
    both = bloom.build_filters(probes, params, BY, rate)
    return low, high, both, probes


def test_union_holds_all_and_intersection_only_the_common(spark):
    low, high, both, probes = letter_filters(spark)
    every = {(0, c) for c in string.ascii_lowercase}
    assert members(bloom.union_filters(low, high), probes) == every
    assert members(bloom.intersect_filters(low, both), probes) == {(0, c) for c in string.ascii_lowercase[:13]}


def test_algebra_needs_equal_dimensions(spark):
    low, _, _, probes = letter_filters(spark)
    other = bloom.build_filters(probes, bloom.size_filters(capacity(spark, [0], 1000), BY, 0.001), BY, 0.001)
    with pytest.raises(ValueError):
        bloom.union_filters(low, other)
    looser = bloom.build_filters(probes, bloom.size_filters(capacity(spark, [0], 100), BY, 0.01), BY, 0.01)
    with pytest.raises(ValueError):
        bloom.intersect_filters(low, looser)


@pytest.mark.parametrize("rate", [0, 1, -0.5])
def test_error_rate_bounds(spark, rate):
    with pytest.raises(ValueError):
        bloom.size_filters(capacity(spark, [0], 10), BY, rate)


def test_capacity_must_be_positive(spark):
    sized = bloom.with_filter_size(capacity(spark, [0], 0), F.col("capacity"), F.lit(0.1))
    with pytest.raises(Exception, match="capacity must be positive"):
        sized.collect()


def test_round_trip(spark):
    rng = random.Random(3)
    keys = key_rows(spark, {t: [str(rng.randint(0, 10_000_100)) for _ in range(2000)] for t in (0, 1)})
    filters = bloom.plain_filters(keys, BY, 0.01)
    path = scratch_path(spark, "test-filters")
    bloom.save_filters(filters, path)
    loaded = bloom.load_filters(spark, path, BY)
    assert loaded.words.exceptAll(filters.words.select(*loaded.words.columns)).isEmpty()
    assert len(members(loaded, keys.drop("pos"))) == keys.select("table_id", "key").distinct().count()


def slow_filter(keys, slices, size):
    """Row by row, as a reference for the counts."""
    bits, count = set(), 0
    width = word_width(size)
    scheme = HashScheme(slices, width)
    code = {2: "H", 4: "I", 8: "Q"}[width]
    for key in keys:
        words = []
        for salt in scheme.salts:
            digest = hashlib.new(scheme.algorithm, salt + key.encode()).digest()
            words += struct.unpack("<" + code * (len(digest) // width), digest)
        mine = {i * size + w % size for i, w in enumerate(words[:slices])}
        count += not mine <= bits
        bits |= mine
    return bits, count


def test_counts_and_bits_match_row_by_row_insertion(spark):
    rng = random.Random(5)
    tables = {t: [str(rng.randint(0, 400)) for _ in range(500)] for t in range(3)}
    keys = key_rows(spark, tables)
    params = bloom.size_filters(capacity(spark, tables, 150), BY, 0.1)
    size = params.first()["bits_per_slice"]
    counts = {r["table_id"]: r for r in bloom.insert_counts(keys, params, BY, 0.1).collect()}
    filters = bloom.build_filters(keys, params, BY, 0.1)
    got = {}
    for r in bloom.words_to_bits(filters.words, BY).collect():
        got.setdefault(r["table_id"], set()).add(r["bit"])
    for t, rows in tables.items():
        bits, count = slow_filter(rows, 4, size)
        assert got[t] == bits
        assert counts[t]["count"] == count
        assert counts[t]["over_capacity"] == (count > 150)
    assert {r["count"] for r in bloom.insert_counts(keys, params, BY, 0.1, skip_check=True).collect()} == {500}


@pytest.mark.parametrize("sizes", [(100, 100), (20, 40_000)])
def test_joined_probing_equals_broadcast_probing(spark, monkeypatch, sizes):
    """The second case mixes filters with two- and four-byte words."""
    keys = key_rows(spark, {0: [f"a{i}" for i in range(300)], 1: [f"b{i}" for i in range(300)]})
    caps = spark.createDataFrame(list(enumerate(sizes)), "table_id int, capacity long")
    filters = bloom.build_filters(keys, bloom.size_filters(caps, BY, 0.2), BY, 0.2)
    probes = keys.select("key").distinct().withColumn("table_id", F.explode(F.array(F.lit(0), F.lit(1))))
    pairs = bloom.with_digests(probes, filters)
    key = lambda df: {(r["table_id"], r["key"]) for r in df.collect()}
    packed = key(bloom.probe_hits(pairs, filters))
    for limit in (150, 1):
        monkeypatch.setattr(bloom, "BROADCAST_BYTES", limit)
        assert packed == key(bloom.probe_hits(pairs, filters))
    assert {(0, f"a{i}") for i in range(300)} | {(1, f"b{i}") for i in range(300)} <= packed


def test_measured_rate_is_near_the_requested_one(spark):
    keys = key_rows(spark, {0: [str(i) for i in range(5000)]})
    filters = bloom.plain_filters(keys, BY, 0.1)
    absent = spark.range(5000, 15000).select(F.lit(0).alias("table_id"), F.col("id").cast("string").alias("key"))
    assert len(members(filters, absent)) / 10000 <= 0.15


def test_scalable_filter_grows_and_denies_nothing(spark):
    keys = key_rows(spark, {0: [str(i % 900) for i in range(1200)], 1: ["x"]})
    layers = scalable_bloom.build_layers(keys, BY, 0.01, initial=100, scale=scalable_bloom.LARGE_GROWTH)
    assert [r["capacity"] for r in scalable_bloom.layer_summary(layers, BY).where("table_id = 0").orderBy("layer").collect()] == [100, 400, 1600]
    probes = keys.select("table_id", "key").distinct()
    assert scalable_bloom.probe_layers(probes, layers).count() == probes.count()


@pytest.mark.parametrize("limit", [1 << 20, 700, 100])
def test_layers_asked_together_answer_as_layer_by_layer(spark, monkeypatch, limit):
    """In one lot, in several, and where one group's filters are too large for a lot."""
    keys = key_rows(spark, {0: [str(i) for i in range(900)], 1: ["x", "y"], 2: [f"k{i}" for i in range(300)]})
    layers = scalable_bloom.build_layers(keys, BY, 0.3, initial=50)
    rows = [(t, str(i)) for t in range(4) for i in range(800, 1500)] + [(t, k) for t in range(3) for k in ("x", "y", "k7", None)] + [(None, "x"), (0, "1"), (0, "1")]
    probes = spark.createDataFrame(rows, "table_id int, key string").repartition(3)
    each = [bloom.probe_hits(bloom.with_digests(probes, layer), layer).collect() for layer in layers]
    want = {(r["table_id"], r["key"]) for found in each for r in found}
    assert len(want) < len(set(rows))
    if limit < 1 << 20:
        monkeypatch.setattr(scalable_bloom, "LOT_BYTES", limit)
    monkeypatch.setattr(scalable_bloom, "ASK_ROWS", 500)
    lots, large = scalable_bloom._lots(layers, BY)
    assert len(lots) + bool(large) == {1 << 20: 1, 700: 2, 100: 1}[limit]
    got = scalable_bloom.probe_layers(probes, layers).collect()
    assert sorted(map(tuple, got)) == sorted(want)
