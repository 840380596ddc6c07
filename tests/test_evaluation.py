import hashlib
import random

import pytest
from pyspark.sql import functions as F

from keysift.operators import bloom
from keysift.operators.occ import registry, rp
from keysift.plans import evaluation, full_sweep, sweep

BY = ["table_id"]
SETTINGS = {"D": 4, "epsilon": 0.05, "agg_thr": 0.5, "box_thr": 0.02}


@pytest.fixture(scope="module")
def keys(spark):
    rng = random.Random(9)
    rows = []
    for t in range(4):
        for pos in range(90):
            rows.append((t, pos, f"h:{rng.randint(0, 25)}:{rng.randint(0, 12):x}"))
    return spark.createDataFrame(rows, "table_id int, pos long, key string")


def sequential(keys, answers, truth, skip):
    """Probe one key after another, one table after another."""
    rows = [(r["table_id"], r["pos"], r["key"]) for r in keys.collect()]
    holds = {(t, k) for t, _, k in rows}
    count = dict.fromkeys(evaluation.COUNTERS, 0)
    for owner, pos, key in rows:
        if pos % skip:
            continue
        for table in range(owner + 1):
            source = answers.get((table, key))
            if source is None:
                assert table != owner
                count["truenegative"] += 1
                continue
            right = table == owner or (truth == "any" and (table, key) in holds)
            kind = "truepositive" if right else "falsepositive"
            count[kind] += 1
            count[f"{kind}_{source}"] += 1
            if right:
                break
    return count


def all_answers(keys, model, filters):
    pairs = keys.select("key").distinct().withColumn("table_id", F.explode(F.array(*map(F.lit, range(4)))))
    pairs = bloom.with_digests(model.prepare(pairs), filters)
    return {(r["table_id"], r["key"]): r["source"] for r in evaluation.two_stage(pairs, model, filters).collect() if r["source"]}


@pytest.mark.parametrize("truth", ["any", "owner"])
@pytest.mark.parametrize("skip", [1, 7])
@pytest.mark.parametrize("family", ["epsilon", "alwaysNegative"])
def test_counters_match_sequential_probing(spark, keys, truth, skip, family):
    model = registry.family(family).fit(keys, BY, SETTINGS)
    filters, _ = evaluation.backup_filters(keys, model, BY, 0.3)
    got = evaluation.evaluate(keys, model, filters, truth, skip).first().asDict()
    want = sequential(keys, all_answers(keys, model, filters), truth, skip)
    assert {c: got[c] for c in want} == want
    assert got["fpr"] == pytest.approx(want["falsepositive"] / (want["falsepositive"] + want["truenegative"]))


@pytest.mark.parametrize("share", [0.6, 0.01])
def test_answers_beyond_the_broadcast_size(spark, keys, monkeypatch, share):
    """Whole rows, the unanswered ones too, agree whether filters travel together, in groups, or by their words."""
    model = registry.family("epsilon").fit(keys, BY, SETTINGS)
    filters, _ = evaluation.backup_filters(keys, model, BY, 0.3)
    pairs = keys.select("key").distinct().withColumn("table_id", F.explode(F.array(*map(F.lit, range(5)))))
    pairs = bloom.with_digests(model.prepare(pairs), filters)
    rows = lambda: sorted(map(tuple, evaluation.two_stage(pairs, model, filters).select("key", "table_id", "source").collect()), key=str)
    first, together = evaluation.evaluate(keys, model, filters).first(), rows()
    assert any(r[2] is None for r in together) and len(together) == pairs.count()
    monkeypatch.setattr(bloom, "BROADCAST_BYTES", filters.facts()["bytes"] * share)
    assert not bloom.fits_broadcast(filters)
    assert evaluation.evaluate(keys, model, filters).first() == first
    assert rows() == together


def test_a_table_without_intervals_follows_the_rule(spark):
    """Two far points leave no interval; with closed ends and no least share every key passes, on both paths."""
    keys = spark.createDataFrame([(0, "a:1:1"), (0, "a:900000:ffff")], "table_id int, key string")
    settings = rp.RPParams(D=4, epsilon=0.001, agg_thr=0.0, box_thr=0.9, closed=True)
    model = rp.fit(keys, BY, settings, registry.key_features, 2)
    rows = model.prepare(keys)
    answers = [sorted(map(tuple, way(rows).select("key", "accepted").collect())) for way in (model._accept_packed, model._accept_joined)]
    assert answers[0] == answers[1] == [("a:1:1", True), ("a:900000:ffff", True)]


def test_owner_never_denies_and_foreign_filters_raise(spark, keys):
    model = registry.family("alwaysNegative").fit(keys, BY, {})
    filters, rejects = evaluation.backup_filters(keys, model, BY, 0.1)
    assert evaluation.denied_keys(keys, model, filters).isEmpty()
    assert {r["rejects"] for r in rejects.collect()} == {90}
    fewer, _ = evaluation.backup_filters(keys.where("pos < 10"), model, BY, 0.01)
    with pytest.raises(Exception, match="denies its own key"):
        evaluation.evaluate(keys, model, fewer).collect()


def test_one_table_has_no_rate(spark, keys):
    only = keys.where("table_id = 0")
    model = registry.family("alwaysNegative").fit(only, BY, {})
    filters, _ = evaluation.backup_filters(only, model, BY, 0.1)
    assert evaluation.evaluate(only, model, filters).first()["fpr"] is None


GRIDS = [
    full_sweep.Grid(dims=(3, 4, 9), epsilons=(0.02, 0.05, 0.3), aggs=(0.5, 0.8, 1.0), boxes=(0, 0.02, 0.1)),
    full_sweep.Grid(dims=(4,), epsilons=(0.05,), aggs=(0.0, 0.5), boxes=(0.0, 0.02), closed=True),
]


@pytest.mark.parametrize(("grid", "truth", "skip", "block_rows", "fan"), [(GRIDS[0], "any", 1, 1000, 64), (GRIDS[0], "owner", 7, 16, 2), (GRIDS[1], "any", 1, 30, 64)])
def test_sweep_equals_single_runs(spark, keys, grid, truth, skip, block_rows, fan):
    """Every figure of sampled configurations, also where a table's rows lie in many blocks that are merged level by level."""
    swept = {r["config"]: r for r in full_sweep.full_sweep(keys, grid, 0.2, truth, skip, block_rows, fan).collect()}
    configurations = grid.configurations()
    assert sorted(swept) == list(range(len(configurations)))
    for i, dims, epsilon, agg, box, *_ in configurations[:: max(1, len(configurations) // 6)]:
        params = {"D": dims, "epsilon": epsilon, "agg_thr": agg, "box_thr": box, "closed": grid.closed}
        single = sweep.run(keys, "epsilon", params, 0.2, skip, truth).first()
        assert [swept[i][x] for x in ["D", "epsilon", "agg_thr", "box_thr", "fpr", *evaluation.COUNTERS]] == [dims, epsilon, agg, box, single["fpr"], *(single[x] for x in evaluation.COUNTERS)]
        assert swept[i]["bfsize"] == single["bfsize"]
        assert swept[i]["rejects"] == sum(single["error_train"].values())


@pytest.mark.parametrize("truth,skip", [("any", 1), ("owner", 7)])
def test_a_sweep_of_one_equals_asking_table_by_table(spark, keys, truth, skip):
    model = registry.family("epsilon").fit(keys, BY, SETTINGS)
    filters, rejects = evaluation.backup_filters(keys, model, BY, 0.2)
    want = evaluation.evaluate(keys, model, filters, truth, skip).first().asDict()
    record = sweep.run(keys, "epsilon", SETTINGS, 0.2, skip, truth).first()
    assert {c: record[c] for c in want} == want
    assert record["error_train"] == {r["table_id"]: r["rejects"] for r in rejects.collect()}
    assert record["bfsize"] == bloom.total_filter_bytes(filters.params).first()[0]


def test_a_sweep_sends_models_in_lots_and_moves_no_probes(spark, keys, monkeypatch):
    grid = full_sweep.Grid(dims=(2, 4), epsilons=(0.05, 0.2), aggs=(0.5,), boxes=(0.0, 0.02))
    rows = lambda: sorted(map(tuple, full_sweep.full_sweep(keys, grid, 0.2).collect()))
    together, dealt, plain = rows(), [], full_sweep.lots
    monkeypatch.setattr(full_sweep, "LOT_BYTES", 3000)
    monkeypatch.setattr(full_sweep, "FEW_TABLES", 2)
    monkeypatch.setattr(full_sweep, "lots", lambda facts: dealt.extend(plain(facts)) or dealt)
    assert rows() == together
    assert len(dealt) > 1 and sorted(p for lot in dealt for p in lot) == [(t, e) for t in range(4) for e in range(2)]
    monkeypatch.setattr(full_sweep, "LOT_BYTES", 1 << 20)
    dealt.clear()
    assert rows() == together and len(dealt) == 1


def test_digests_give_the_words_of_the_filters(spark):
    """Also where widths share a hash function, and where one of them needs several salts."""
    for slices in (4, 7, 17):
        digests = full_sweep.Digests.of([2, 4, 8], slices)
        row = spark.createDataFrame([("1:2:ff",), ("ü",)], "key string").select("key", *digests.columns()).toArrow()
        got = digests.words(lambda name: b"".join(row.column(name).to_pylist()), 2)
        for width in (2, 4, 8):
            for i, key in enumerate(row.column("key").to_pylist()):
                scheme = digests.schemes[width]
                raw = b"".join(d[: scheme.words_per_digest * width] for d in (hashlib.new(scheme.algorithm, salt + key.encode()).digest() for salt in scheme.salts))
                assert [int(w[i]) & ((1 << 8 * width) - 1) for w in got[width]] == [int.from_bytes(raw[width * s : width * (s + 1)], "little") for s in range(slices)]


def test_sweep_of_odd_tables(spark):
    """One row, equal rows, a key that is no pair of numbers, two far rows: tables without intervals still answer by their filters."""
    rows = [(0, "a:1:1"), *[(1, "a:5:5")] * 4, (2, "nonsense"), (2, "a:1:ff"), (3, "a:1:1"), (3, "a:900000:ffff")]
    keys = spark.createDataFrame(rows, "table_id int, key string")
    grid = full_sweep.Grid(dims=(2, 3), epsilons=(0.01,), aggs=(0.5,), boxes=(0.0, 0.1))
    for row in full_sweep.full_sweep(keys, grid, 0.1).collect():
        assert row["truepositive"] == len(rows) and row["rejects"] == len(rows)


def test_islands_in_any_order_and_overlapping_intervals():
    import numpy as np

    values = np.array([5.0, 1.0, 1.5, 9.0, 5.2])
    whole = full_sweep.merged_islands(values, values, np.ones(5, int), 1.0)
    parts = [full_sweep.merged_islands(v, v, np.ones(len(v), int), 1.0) for v in (values[:2], values[2:])]
    again = full_sweep.merged_islands(*(np.concatenate(c) for c in zip(*parts)), 1.0)
    assert [a.tolist() for a in whole] == [a.tolist() for a in again] == [[1.0, 5.0, 9.0], [1.5, 5.2, 9.0], [2, 2, 1]]
    ordered = np.sort(values)
    got = full_sweep.survived(ordered, np.argsort(values), np.array([0.0, 1.2]), np.array([2.0, 6.0]), np.array([2, 3], np.int16), False)
    assert got.tolist() == [3, 2, 3, 0, 3]
