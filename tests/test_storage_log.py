import random
import time

import pytest
from pyspark.sql import functions as F

from keysift.plans import storage_log
from keysift.session import scratch_path
from keysift.streaming import log_stream


def random_log(seed, n=260):
    """Flushes, reads and compactions with reused names, missing tables and unknown families."""
    rng, rows, made = random.Random(seed), [], []
    for i in range(n):
        cf = rng.choice(["a", "a", "b", "c"])
        kind = rng.choices(["flush", "read", "compaction"], [5, 5, 1])[0]
        t = i // 2  # equal times: the kind and the line decide
        if kind == "flush":
            rows.append((kind, t, i, cf, f"/d/{cf}/t{rng.randint(0, 3)}", str(rng.randint(0, 12)), None))
        elif kind == "read":
            rows.append((kind, t, i, rng.choice([cf, cf, cf, "unknown"]), None, str(rng.randint(0, 12)), None))
        else:
            names = [f"/d/{cf}/t{j}" for j in range(4)] + [m for m in made if f"/{cf}/" in m] + (["/d/zz/t0"] if rng.random() < 0.1 else [])
            out = f"/d/{cf}/c{i}"
            rows.append((kind, t, i, cf, out, None, rng.sample(names, min(len(names), rng.randint(1, 2)))))
            made.append(out)
    return rows


def replay(rows):
    """One event after another on plain dictionaries."""
    tables, known, reads, outcomes = {}, set(), {}, {}
    for kind, t, line, cf, table, key, inputs in sorted(rows, key=lambda r: (r[1], storage_log.KIND_RANK[r[0]], r[2])):
        if kind == "flush":
            known.add(cf)
            tables.setdefault(cf, {}).setdefault(table, []).append(key)
        elif kind == "read":
            hit = next((name for name in reversed(tables.get(cf, {})) if key in tables[cf][name]), None)
            reads[line] = (hit, cf in known)
        else:
            keys, no_cf, no_table = [], False, False
            for name in inputs:
                family = name.split("/")[-2]
                if family not in known:
                    no_cf = True
                elif name not in tables.get(family, {}):
                    no_table = True
                else:
                    keys += tables[family].pop(name)
            outcomes[line] = "missing_both" if no_cf and no_table else "missing_cf" if no_cf else "missing_table" if no_table else "ok"
            if outcomes[line] == "ok":
                known.add(cf)
                tables.setdefault(cf, {})[table] = keys
    return reads, outcomes, tables


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resolution_matches_a_sequential_replay(spark, seed):
    rows = random_log(seed)
    events = spark.createDataFrame(rows, log_stream.EVENT_SCHEMA).repartition(5)
    reads, outcomes, tables = replay(rows)
    registry = storage_log.resolve(events)
    assert {r["line_no"]: r["outcome"] for r in registry.outcomes.collect()} == outcomes
    resolved = storage_log.read_hits(registry)
    assert {r["line_no"]: r["table"] for r in resolved.collect()} == {line: hit for line, (hit, _) in reads.items()}
    alive = {(r["cf"], r["table"]) for r in registry.lifetimes.where("dropped IS NULL").collect()}
    assert alive == {(cf, name) for cf, names in tables.items() for name in names}
    final = storage_log.contents(registry).join(registry.lifetimes.where("dropped IS NULL"), ["cf", "table", "incarnation"])
    sizes = {(r["cf"], r["table"]): r["n"] for r in final.groupBy("cf", "table").agg(F.count("*").alias("n")).collect()}
    assert sizes == {(cf, name): len(keys) for cf, names in tables.items() for name, keys in names.items() if keys}
    counters = storage_log.read_counters(registry, resolved).first()
    assert counters["found"] == sum(hit is not None for hit, _ in reads.values())
    assert counters["cf_known"] == sum(known for _, known in reads.values())
    assert counters["reads"] == counters["cf_known"] + counters["cf_unknown"]


def test_late_events_are_counted_and_reads_wait_for_the_watermark(spark):
    source, work = scratch_path(spark, "test-log"), scratch_path(spark, "test-stream")
    at = 1000  # milliseconds
    flush = lambda t, line, key: ("flush", t * at, line, "a", "/d/a/t0", key, None)
    read = lambda t, line, key: ("read", t * at, line, "a", None, key, None)
    batches = [
        [flush(100, 1, "x"), read(110, 2, "y")],
        [flush(105, 3, "y"), flush(200, 4, "z")],  # out of order, but within the delay
        [flush(80, 5, "w"), flush(150, 7, "v"), read(210, 6, "w"), read(160, 8, "v")],  # 80 is behind what is settled: dropped
    ]
    for rows in batches:
        spark.createDataFrame(rows, log_stream.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
    log = log_stream.LogStream(spark, source, work, 20 * at, files_per_batch=1)
    log.end()
    assert {r["line_no"]: r["table"] for r in log.hits().collect()} == {2: "/d/a/t0", 6: None, 8: "/d/a/t0"}
    assert log.late().first()[0] == 1


def test_a_stream_stopped_and_continued_equals_the_replay(spark):
    """Files that arrive in two runs, the second from the checkpoint of the first: hits and counters are those of the whole log."""
    source, work = scratch_path(spark, "test-log"), scratch_path(spark, "test-stream")
    # Events of the epoch itself would be late: it is the first watermark.
    rows = [(k, (t + 1) * 1000, *rest) for k, t, *rest in random_log(4, 120)]
    reads, _, _ = replay(rows)
    log = log_stream.LogStream(spark, source, work, 5000, files_per_batch=1)
    for start, stop in ((0, 40), (40, 75), (75, 120)):
        spark.createDataFrame(rows[start:stop], log_stream.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if stop != 75:
            log.consume()
    log.end()
    assert {r["line_no"]: r["table"] for r in log.hits().collect()} == {line: hit for line, (hit, _) in reads.items()}
    counters = log.counters().agg(*[F.sum(c).alias(c) for c in ("reads", "cf_known", "found")]).first()
    assert tuple(counters) == (len(reads), sum(known for _, known in reads.values()), sum(hit is not None for hit, _ in reads.values()))
    assert {r["line_no"] for r in log.accepted().collect()} == {r[2] for r in rows}
    # A slice is told the flushes of the keys it reads, once for each, and no others.
    held = log._all("settled", log_stream.SETTLED).where("role = 'held'").collect()
    assert {(r["cf"], r["key"]) for r in held} <= {(r[3], r[5]) for r in rows if r[0] == "read"}


def test_a_chain_of_300_compactions(spark):
    """Every output names the one before it and one flushed table; the last holds the keys of all, in order."""
    rows = []
    for i in range(300):
        rows.append(("flush", 2 * i, 2 * i, "a", f"/d/a/t{i}", f"k{i}", None))
        rows.append(("compaction", 2 * i + 1, 2 * i + 1, "a", f"/d/a/c{i}", None, [*([f"/d/a/c{i - 1}"] if i else []), f"/d/a/t{i}"]))
    registry = storage_log.resolve(spark.createDataFrame(rows, log_stream.EVENT_SCHEMA))
    held = storage_log.compaction_contents(registry).where("table = '/d/a/c299'").orderBy("path", "ord").collect()
    assert [r["key"] for r in held] == [f"k{i}" for i in range(300)]
    lives = {r["table"]: r["dropped"] is None for r in registry.lifetimes.collect()}
    assert lives["/d/a/c299"] and sum(lives.values()) == 1
