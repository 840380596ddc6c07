"""Storage-log analytics: what tables exist when, what they hold, and how reads resolve.

Input rows are ``events(kind, t, line_no, cf, table, key, inputs)`` with kinds flush, read and
compaction.  Table state is interval data: creations, drops and compaction lineage are metadata
(one row per table or compaction) and travel as size-checked broadcasts; keys and reads meet in
equi-joins on (cf, key).  ``ord`` = (t, kind rank, line number) is the order of the merged log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.operators import bloom
from keysift.operators.ordering import grouped_row_number
from keysift.session import broadcast_if_small, is_small, materialize

KIND_RANK = {"flush": 0, "read": 1, "compaction": 2}  # fixed value: order of kinds at equal times


def kind_rank(kind: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, value in KIND_RANK.items():
        rank = F.when(kind == name, value).otherwise(rank)
    return rank


def with_order(events: DataFrame) -> DataFrame:
    return events.withColumn("ord", F.struct("t", kind_rank(F.col("kind")).alias("rank"), "line_no"))


def merge_logs(events: DataFrame) -> DataFrame:
    """The three logs in one order per column family; ``seq`` is the position in it."""
    return grouped_row_number(events, ["cf"], ["t", kind_rank(F.col("kind")), "line_no"], "seq")


def flush_rows(events: DataFrame) -> DataFrame:
    return with_order(events.where("kind = 'flush'")).select("cf", "table", "key", "ord")


def read_rows(events: DataFrame) -> DataFrame:
    return with_order(events.where("kind = 'read'")).select("line_no", "t", "cf", "key", "ord")


def compaction_edges(events: DataFrame) -> DataFrame:
    """One row per compaction input."""
    rows = with_order(events.where("kind = 'compaction'"))
    edges = rows.select("line_no", "ord", F.col("table").alias("output"), F.posexplode("inputs").alias("place", "input"))
    return edges.withColumn("input_cf", table_cf(F.col("input"))).withColumn("cf", table_cf(F.col("output")))


def table_cf(path: Column) -> Column:
    """The column family of a table path: its second last part."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


@dataclass
class Registry:
    """Resolved metadata of a log."""

    events: DataFrame
    edges: DataFrame  # inputs with their faults
    outcomes: DataFrame  # one row per compaction
    named: DataFrame  # per table, the ordered moments it was named as an input
    lifetimes: DataFrame  # (cf, table, incarnation, created, dropped)
    held: DataFrame | None = None  # contents, once they were asked for


def resolve(events: DataFrame) -> Registry:
    """Outcome of every compaction and lifetime of every table.

    A compaction succeeds when each input exists at its time: something created it after it was
    last named as an input.  Outputs of successful compactions are creations too, so the successes
    are settled in rounds; each round works on compaction metadata only and the number of rounds is
    the longest chain of compactions that depend on each other's failure.
    """
    edges = materialize(compaction_edges(events))
    small = is_small(edges)
    hint = F.broadcast if small else (lambda df: df)
    flushes = flush_rows(events)
    asked = hint(edges.select("line_no", "place", F.col("input").alias("table"), F.col("ord").alias("_at")))
    flushed = flushes.join(asked, "table").where("ord < _at").groupBy("line_no", "place").agg(F.max("ord").alias("_flushed"))
    cf_flush = flushes.groupBy("cf").agg(F.min("ord").alias("_cf_flushed"))
    # The naming before each one, by its number among the input's namings: linear however often a name is used.
    namings = grouped_row_number(edges.select("input", "ord").distinct(), ["input"], ["ord"], "turn")
    before = namings.select("input", (F.col("turn") + 1).alias("turn"), F.col("ord").alias("_named"))
    last_named = namings.join(before, ["input", "turn"]).select("input", "ord", "_named")
    known = edges.join(flushed, ["line_no", "place"], "left").join(last_named, ["input", "ord"], "left")
    known = materialize(known.join(broadcast_if_small(cf_flush).withColumnRenamed("cf", "input_cf"), "input_cf", "left"))

    # Failures only ever grow from round to round, so an unchanged number of them ends the search.
    succeeded, failures = edges.select("line_no").distinct(), 0
    while True:
        outputs = edges.select("line_no", "output", "cf", F.col("ord").alias("_made")).distinct().join(succeeded, "line_no", "left_semi")
        by_table = outputs.select(F.col("output").alias("input"), "_made")
        by_cf = outputs.groupBy(F.col("cf").alias("input_cf")).agg(F.min("_made").alias("_cf_made"))
        made = (
            edges.select("line_no", "place", "input", "ord").join(by_table, "input").where("_made < ord")
            .groupBy("line_no", "place").agg(F.max("_made").alias("_output"))
        )
        state = known.join(made, ["line_no", "place"], "left").join(by_cf, "input_cf", "left")
        created = F.greatest("_flushed", "_output")
        exists = created.isNotNull() & (F.col("_named").isNull() | (created > F.col("_named")))
        cf_known = F.least("_cf_flushed", "_cf_made") < F.col("ord")
        faults = F.when(~F.coalesce(cf_known, F.lit(False)), "cf").when(~exists, "table")
        flagged = materialize(state.select(*edges.columns, faults.alias("fault")))
        failed = flagged.where("fault IS NOT NULL").select("line_no").distinct()
        succeeded = edges.select("line_no").distinct().join(failed, "line_no", "left_anti")
        found = failed.count()
        if found == failures:
            break
        failures = found

    has = lambda kind: F.bool_or(F.coalesce(F.col("fault") == kind, F.lit(False)))
    outcomes = flagged.groupBy("line_no", "cf", "output", "ord").agg(has("cf").alias("missing_cf"), has("table").alias("missing_table"))
    outcome = F.when(F.col("missing_cf") & F.col("missing_table"), "missing_both").when(F.col("missing_cf"), "missing_cf")
    outcomes = outcomes.withColumn("outcome", outcome.when(F.col("missing_table"), "missing_table").otherwise("ok"))
    named = edges.groupBy(F.col("input").alias("table")).agg(F.array_sort(F.collect_set("ord")).alias("_named"))
    registry = Registry(events, flagged, materialize(outcomes), materialize(named), None)
    registry.lifetimes = materialize(_lifetimes(registry))
    return registry


def with_incarnation(rows: DataFrame, registry: Registry) -> DataFrame:
    """A table that is compacted away and written again is a new incarnation of its name."""
    joined = rows.join(broadcast_if_small(registry.named), "table", "left")
    times = F.size(F.filter("_named", lambda n: n < F.col("ord")))
    return joined.withColumn("incarnation", F.greatest(F.coalesce(times, F.lit(0)), F.lit(0)))


def _lifetimes(registry: Registry) -> DataFrame:
    outputs = registry.outcomes.where("outcome = 'ok'").select("cf", F.col("output").alias("table"), "ord")
    creations = flush_rows(registry.events).select("cf", "table", "ord").unionByName(outputs)
    grouped = with_incarnation(creations, registry).groupBy("cf", "table", "incarnation").agg(
        F.min("ord").alias("created"), F.first("_named").alias("_named")
    )
    dropped = F.get(F.filter("_named", lambda n: n > F.col("created")), F.lit(0))
    return grouped.select("cf", "table", "incarnation", "created", dropped.alias("dropped"))


def lineage(registry: Registry) -> DataFrame:
    """For every successful output, all tables its keys come from, with the order of concatenation."""
    good = registry.edges.join(registry.outcomes.where("outcome = 'ok'").select("line_no"), "line_no", "left_semi")
    children = with_incarnation(good.withColumnRenamed("input", "table"), registry).select(
        "line_no", "ord", "output", "place", F.col("table").alias("child"), F.col("incarnation").alias("child_inc")
    )
    parents = with_incarnation(children.withColumnRenamed("output", "table"), registry)
    steps = materialize(parents.select(F.col("table").alias("parent"), F.col("incarnation").alias("parent_inc"), "ord", "place", "child", "child_inc"))
    # Paths of one step, then of two, four, ...: the number of rounds is the logarithm of the longest chain.
    exact = steps.select(
        F.col("parent").alias("root"), F.col("parent_inc").alias("root_inc"), F.col("ord").alias("made"),
        F.col("child").alias("node"), F.col("child_inc").alias("node_inc"), F.lpad(F.col("place").cast("string"), 6, "0").alias("path"),
    )
    done = None
    while True:
        longer = exact if done is None else exact.unionByName(_chained(exact, done)).unionByName(done)
        done, doubled = materialize(longer), materialize(_chained(exact, exact))
        if doubled.isEmpty():
            return done
        exact = doubled


def _chained(first: DataFrame, then: DataFrame) -> DataFrame:
    """Paths of ``first`` continued by paths of ``then``."""
    then = then.select(
        F.col("root").alias("node"), F.col("root_inc").alias("node_inc"), F.col("node").alias("_to"), F.col("node_inc").alias("_to_inc"),
        F.col("path").alias("_path"),
    )
    joined = first.join(then, ["node", "node_inc"])
    return joined.select("root", "root_inc", "made", F.col("_to").alias("node"), F.col("_to_inc").alias("node_inc"), F.concat_ws("/", "path", "_path").alias("path"))


def compaction_contents(registry: Registry) -> DataFrame:
    """Keys of successful outputs, duplicates kept: (cf, table, incarnation, key, at, path, ord)."""
    flushes = with_incarnation(flush_rows(registry.events), registry).select(
        F.col("table").alias("node"), F.col("incarnation").alias("node_inc"), "key", "ord"
    )
    sources = broadcast_if_small(materialize(lineage(registry)))
    joined = flushes.join(sources, ["node", "node_inc"])
    return joined.select(
        table_cf(F.col("root")).alias("cf"), F.col("root").alias("table"), F.col("root_inc").alias("incarnation"), "key",
        F.col("made").alias("at"), "path", "ord",
    )


def contents(registry: Registry) -> DataFrame:
    """Every key of every table with the moment it got there; computed once for a registry."""
    if registry.held is None:
        flushed = with_incarnation(flush_rows(registry.events), registry)
        every = flushed.select("cf", "table", "incarnation", "key", F.col("ord").alias("at")).unionByName(
            compaction_contents(registry).select("cf", "table", "incarnation", "key", "at")
        )
        registry.held = materialize(every)
    return registry.held


def key_spans(registry: Registry) -> DataFrame:
    """One row per (table incarnation, key): first moment it is there, and the table's lifetime."""
    first = contents(registry).groupBy("cf", "table", "incarnation", "key").agg(F.min("at").alias("at"))
    return first.join(broadcast_if_small(registry.lifetimes), ["cf", "table", "incarnation"])


def alive(span: Column, moment: Column) -> Column:
    return (span["created"] < moment) & (span["dropped"].isNull() | (span["dropped"] > moment))


def live_tables(registry: Registry, reads: DataFrame | None = None) -> DataFrame:
    """Reads with the tables alive at that moment, newest first (``newest`` counts from zero)."""
    reads = read_rows(registry.events) if reads is None else reads
    spans = registry.lifetimes.groupBy("cf").agg(
        F.sort_array(F.collect_list(F.struct("created", "dropped", "table", "incarnation")), asc=False).alias("_spans")
    )
    joined = reads.join(broadcast_if_small(spans), "cf")
    now = F.filter("_spans", lambda s: alive(s, F.col("ord")))
    return joined.select(*reads.columns, F.posexplode(now).alias("newest", "_s")).select(
        *reads.columns, "newest", "_s.table", "_s.incarnation", "_s.created"
    )


def read_hits(registry: Registry, reads: DataFrame | None = None) -> DataFrame:
    """Every read with the newest live table that holds its key (NULL where none does)."""
    reads = read_rows(registry.events) if reads is None else reads
    # One row per (cf, key): its spans are bounded by the tables of the family, so a hot key stays one row.
    held = key_spans(registry).groupBy("cf", "key").agg(F.collect_list(F.struct("created", "dropped", "at", "table", "incarnation")).alias("_held"))
    joined = reads.join(held, ["cf", "key"], "left")
    now = F.filter("_held", lambda s: alive(s, F.col("ord")) & (s["at"] < F.col("ord")))
    best = F.array_max(F.transform(now, lambda s: F.struct(s["created"].alias("created"), s["table"].alias("table"), s["incarnation"].alias("incarnation"))))
    return joined.withColumn("_b", best).select(
        *reads.columns, F.col("_b.table").alias("table"), F.col("_b.incarnation").alias("incarnation"), F.col("_b.created").alias("created")
    )


def family_start(registry: Registry) -> DataFrame:
    return registry.lifetimes.groupBy("cf").agg(F.min("created").alias("_cf_start"))


def read_counters(registry: Registry, resolved: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Reads, reads of known families, found and not found among them, reads of unknown families."""
    joined = resolved.join(broadcast_if_small(family_start(registry)), "cf", "left")
    known = F.coalesce(F.col("_cf_start") < F.col("ord"), F.lit(False))
    found = F.col("table").isNotNull()
    return joined.groupBy(*(by or [])).agg(
        F.count("*").alias("reads"), F.count_if(known).alias("cf_known"), F.count_if(found).alias("found"),
        F.count_if(known & ~found).alias("not_found"), F.count_if(~known).alias("cf_unknown"),
    )


def table_sizes(registry: Registry) -> DataFrame:
    return contents(registry).groupBy("cf", "table", "incarnation").agg(F.count("*").alias("size"))


def hit_ratios(registry: Registry, resolved: DataFrame) -> DataFrame:
    """Distinct hit keys and all hits of a table, over its size."""
    hits = resolved.where("table IS NOT NULL").groupBy("cf", "table", "incarnation").agg(
        F.count("*").alias("hits"), F.count_distinct("key").alias("distinct_hits")
    )
    joined = hits.join(table_sizes(registry), ["cf", "table", "incarnation"])
    return joined.withColumn("distinct_ratio", F.col("distinct_hits") / F.col("size")).withColumn("hit_ratio", F.col("hits") / F.col("size"))


NODE = ["cf", "table", "incarnation"]


def filter_answers(registry: Registry, asked: DataFrame, error_rate: float, flush_capacity: int) -> DataFrame:
    """From when on a table's filter says yes to a key: ``asked`` (cf, table, incarnation, key).

    Filters grow with their tables, so each bit carries the moment it was first set; a filter says
    yes once the last of a key's bits is set.  Pairs without an answer never become yes.
    """
    held = contents(registry)
    made = registry.outcomes.where("outcome = 'ok'").select(F.col("cf"), F.col("output").alias("table")).distinct().withColumn("_made", F.lit(True))
    sizes = held.groupBy(*NODE).agg(F.count("*").alias("_n")).join(broadcast_if_small(made), ["cf", "table"], "left")
    capacity = F.when(F.col("_made"), F.greatest(F.col("_n"), F.lit(1))).otherwise(F.lit(flush_capacity).cast("bigint"))
    params = bloom.size_filters(sizes.withColumn("capacity", capacity), NODE, error_rate)
    moments = held.groupBy(*NODE, "key").agg(F.min("at").alias("at"))
    bits = bloom.key_bits(moments, params, NODE, error_rate).groupBy(*NODE, "bit").agg(F.min("at").alias("set_at"))
    spots = bloom.key_bits(asked.distinct(), params, NODE, error_rate).select(*NODE, "key", "bit")
    met = spots.join(bits, [*NODE, "bit"]).groupBy(*NODE, "key").agg(F.count("*").alias("_set"), F.max("set_at").alias("yes_from"))
    return met.where(F.col("_set") == bloom.slices_for(error_rate)).drop("_set")


def probed_tables(registry: Registry, resolved: DataFrame, with_hit: bool = False) -> DataFrame:
    """Live tables a found read passes before its hit (and the hit itself if asked for)."""
    found = resolved.where("table IS NOT NULL").select("line_no", "t", "cf", "key", "ord", F.col("created").alias("_hit"))
    passed = live_tables(registry, found)
    newer = F.col("created") > F.col("_hit")
    return passed.where(newer | (F.col("created") == F.col("_hit")) if with_hit else newer).withColumn("is_hit", F.col("created") == F.col("_hit"))


def log_filter_fp(registry: Registry, resolved: DataFrame, error_rate: float, flush_capacity: int) -> DataFrame:
    """False positives per table, with the table's size at the last of them."""
    probes = probed_tables(registry, resolved)
    answers = filter_answers(registry, probes.select(*NODE, "key"), error_rate, flush_capacity)
    wrong = probes.join(answers, [*NODE, "key"]).where(F.col("yes_from") < F.col("ord"))
    counted = materialize(wrong.groupBy(*NODE).agg(F.count("*").alias("fp"), F.max("ord").alias("_last")))
    sizes = contents(registry).join(broadcast_if_small(counted), NODE).where(F.col("at") < F.col("_last"))
    return sizes.groupBy(*NODE).agg(F.first("fp").alias("fp"), F.count("*").alias("size"))


def fp_tp_ratio(fp: DataFrame, resolved: DataFrame) -> DataFrame:
    hits = resolved.where("table IS NOT NULL").groupBy(*NODE).agg(F.count("*").alias("tp"))
    return fp.join(hits, NODE).withColumn("ratio", F.col("fp") / F.col("tp")).orderBy(F.desc("ratio"))


def log_model_outcomes(registry: Registry, resolved: DataFrame, params, error_rate: float, flush_capacity: int) -> DataFrame:
    """Model outcomes on the tables a found read asks, its hit included.

    ``fp``: the model accepts a key the table does not hold; ``fn``: the model rejects and the
    table's filter says yes.  Models are fitted on the keys of each table incarnation.
    """
    from keysift.operators.occ import rp

    features = lambda: F.array(F.col("key").try_cast("double"))
    probes = probed_tables(registry, resolved, with_hit=True)
    asked = probes.select(*NODE, "key").distinct()
    model = rp.fit(contents(registry).select(*NODE, "key"), NODE, params, features, 1)
    predicted = model.accept(model.prepare(asked)).select(*NODE, "key", "accepted")
    answers = filter_answers(registry, asked, error_rate, flush_capacity)
    joined = probes.join(predicted.join(answers, [*NODE, "key"], "left"), [*NODE, "key"])
    says_yes = F.coalesce(F.col("yes_from") < F.col("ord"), F.lit(False))
    return joined.groupBy(*NODE).agg(
        F.count_if(F.col("accepted") & ~F.col("is_hit")).alias("fp"),
        F.count_if(~F.col("accepted") & says_yes).alias("fn"),
    )


def apply_policy(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """Which families use a filter and a model; families without an entry use neither."""
    joined = rows.join(broadcast_if_small(policy), "cf", "left")
    return joined.fillna(False, ["use_filter", "use_model"])
