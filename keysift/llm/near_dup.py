"""Near duplicates by a multi-index Hamming join of minhash signatures, confirmed on full shingle sets.

A document's signature has SLOTS minhash values of 16 bits.  Two sets as alike as the threshold differ in
few slots; the most that are allowed lies five standard deviations above the mean, so fewer than one
such pair in a million is beyond it.  The slots are split into chunks so that, by the pigeonhole
principle, two signatures within that distance differ by at most ERRORS slots in some chunk; every way to
leave out that many slots of a chunk is a key, so each such pair shares a key for certain.

Documents of equal sets are one node.  Buckets of a key may be hot, so pairs are not formed at once: every
node is first compared with the most central node of its buckets (its leader: the one that shares its keys with
most others), which joins tight groups.  Leaders are always more central than those they lead, so the links to
them form trees whose roots name the components.  Nodes whose leaders have the same leader are a group; those of a
group that are still apart are then compared with each other where their sets are, block against block: pairs within
the signature distance are counted out on full sets in one product of matrices, and only a spanning forest of the
links leaves the task, so close copies that are not linked make no rows.  Pairs of different groups come from the
buckets that hold both, each from the first key that it shares; they are tested on a longer signature, in crowded
buckets on the spot, and confirmed on full sets.  Later rounds connect components, not nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.graph import components, tree_roots
from keysift.llm.tables import raw_texts, slices, text_only, written
from keysift.llm.words import Numbering, lower_words

SLOTS = 64
# Slots of the longer signature, of 8 bits, and members from which a bucket's pairs are tested on it at once.
FINE_SLOTS = 1024
CROWD = 50
# Slots in which two signatures may differ within one chunk.
ERRORS = 1
# Nodes of one block of a bucket or group, and shingles of one block of a group.
BLOCK = 1000
BLOCK_SHINGLES = 1 << 20
# Shingles whose holders are counted at one time.
COUNTED = 4096
PACKED = SLOTS // 4

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S29, _S32, _S48 = (np.uint64(x) for x in (29, 32, 48))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S29)) * _M2
    x = (x ^ (x >> _S32)) * _M3
    return x ^ (x >> _S29)


_SLOT = np.arange(1, SLOTS + FINE_SLOTS + 1, dtype=np.uint64)
_FACTORS, _SHIFTS = _mixed(_SLOT * _M1) | np.uint64(1), _mixed(_SLOT * _M3 + _M1)


def allowed_distance(similarity: float, slots: int = SLOTS) -> int:
    """Slots in which signatures may differ: five standard deviations above the mean of pairs at the threshold."""
    return min(slots - 1, math.ceil(slots * (1 - similarity) + 5 * math.sqrt(slots * similarity * (1 - similarity))))


def shingle_sets(raws: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``size`` words; a shorter text is one shingle."""
    numbering = Numbering()
    numbers = [numbering.of(lower_words(raw)) for raw in raws]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbering), np.uint64, len(numbering))
    out = []
    for own in numbers:
        n = min(size, len(own))
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        words = hashes[own]
        acc = np.full(len(own) - n + 1, n, np.uint64)
        for i in range(n):
            acc = _mixed(acc * _M1 + words[i : len(words) - n + 1 + i])
        out.append(np.unique(acc))
    return out


def _node(shingles: np.ndarray) -> int:
    """Number of a set; equal sets share it."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _signatures(sets: list[np.ndarray], slots: range = range(SLOTS)) -> np.ndarray:
    """One row of 16-bit values for each set, none of them empty."""
    out = np.zeros((len(sets), len(slots)), np.uint16)
    if sets:
        values = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        for j, slot in enumerate(slots):
            least = np.minimum.reduceat(values * _FACTORS[slot] + _SHIFTS[slot], starts)
            out[:, j] = (_mixed(least) >> _S48).astype(np.uint16)
    return out


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``n`` shingles, ``node`` and the packed signature ``s0``.. of every document; 0 for empty ones."""
    names = ["doc_id", "n", "node", *(f"s{i}" for i in range(PACKED))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(raw_texts(part), size)
            counts = np.array([len(s) for s in sets], np.int64)
            nodes = np.array([_node(s) if len(s) else 0 for s in sets], np.int64)
            packed = np.zeros((len(sets), PACKED), np.int64)
            packed[counts > 0] = _signatures([s for s in sets if len(s)]).view(np.int64)
            columns = [part.column("doc_id"), pa.array(counts), pa.array(nodes), *(pa.array(packed[:, i].copy()) for i in range(PACKED))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return text_only(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names[1:]))


def _unpacked(batch: pa.RecordBatch) -> np.ndarray:
    columns = np.stack([batch.column(f"s{i}").to_numpy() for i in range(PACKED)], axis=1) if batch.num_rows else np.zeros((0, PACKED), np.int64)
    return np.ascontiguousarray(columns).view(np.uint16)


def _variants(distance: int) -> list[list[int]]:
    """The slots that each key is made of: all chunks, every way to leave ERRORS slots out."""
    chunks = np.array_split(np.arange(SLOTS), distance // (ERRORS + 1) + 1)
    return [list(rest) for chunk in chunks for rest in combinations(chunk.tolist(), max(len(chunk) - ERRORS, 1))]


def bucket_keys(nodes: DataFrame, distance: int) -> DataFrame:
    """``key``, its number ``variant`` and ``node``: signatures within ``distance`` share a key for certain."""
    left = _variants(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                values = _unpacked(part).astype(np.uint64)
                keys = np.empty((len(left), part.num_rows), np.uint64)
                for row, slots in enumerate(left):
                    acc = np.full(part.num_rows, row + 1, np.uint64)
                    for slot in slots:
                        acc = _mixed(acc * _M1 + values[:, slot])
                    keys[row] = acc
                owners = np.tile(part.column("node").to_numpy(), len(left))
                variants = np.repeat(np.arange(len(left), dtype=np.int32), part.num_rows)
                columns = [pa.array(keys.reshape(-1).view(np.int64)), pa.array(variants), pa.array(owners)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "variant", "node"])

    return nodes.mapInArrow(run, "key long, variant int, node long")


def _across(members: DataFrame, distance: int, similarity: float) -> DataFrame:
    """Pairs of nodes of one bucket, of different components and groups, whose signatures are within ``distance``.

    ``members`` are sorted runs of (``bucket``, ``one``, ``other``): the blocks of a bucket that meet.  A pair
    that shares several keys comes from the first of them only.
    """
    left, fine_distance = _variants(distance), allowed_distance(similarity, FINE_SLOTS)

    def pairs(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        values = _unpacked(batch)
        group = np.stack([batch.column(c).to_numpy() for c in ("bucket", "one", "other")], axis=1)
        run = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).any(axis=1)]))
        component, led, size, block, node, variant = (batch.column(c).to_numpy() for c in ("component", "group", "n", "block", "node", "variant"))
        crossing = batch.column("one").to_numpy() != batch.column("other").to_numpy()
        has_fine = batch.column("fine").is_valid().to_numpy(zero_copy_only=False)
        fine = np.zeros((len(run), FINE_SLOTS if has_fine.any() else 0), np.uint8)
        if has_fine.any():
            fine[has_fine] = np.frombuffer(b"".join(batch.column("fine").drop_null().to_pylist()), np.uint8).reshape(-1, FINE_SLOTS)
        found = []
        for step in range(1, len(run)):
            i = np.flatnonzero(run[step:] == run[:-step])
            if not len(i):
                break
            j = i + step
            fits = (component[i] != component[j]) & (led[i] != led[j]) & ((block[i] != block[j]) | ~crossing[i])
            fits &= np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
            i, j = i[fits], j[fits]
            differs = values[i] != values[j]
            near = differs.sum(axis=1) <= distance
            i, j, differs = i[near], j[near], differs[near]
            shared = np.stack([~differs[:, slots].any(axis=1) for slots in left], axis=1)
            fresh = shared.argmax(axis=1) == variant[i]
            i, j = i[fresh], j[fresh]
            # Members of one bucket all have the longer signature or all have none.
            near = ~has_fine[i]
            near[~near] = (fine[i[~near]] != fine[j[~near]]).sum(axis=1) <= fine_distance
            found.append(np.stack([node[i[near]], node[j[near]]]))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            buckets = np.stack([batch.column(c).to_numpy() for c in ("bucket", "one", "other")], axis=1)
            if not len(buckets):
                continue
            # All but the batch's last run are whole.
            cut = int(np.flatnonzero((buckets != buckets[-1]).any(axis=1))[-1]) + 1 if (buckets != buckets[-1]).any() else 0
            if cut:
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("bucket", "one", "other")):
                yield pairs(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return members.mapInArrow(run, "a long, b long")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share, by products of incidence matrices over bounded ranges of elements."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[element] > 1
    owner, element = owner[common], (np.cumsum(times > 1) - 1)[element[common]]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(element[-1]) + 1 if len(element) else 0, COUNTED):
        low, high = np.searchsorted(element, [first, first + COUNTED])
        held = np.zeros((len(sets), COUNTED), np.float32)
        held[owner[low:high], element[low:high] - first] = 1
        shared += held @ held.T
    # A sum of ones stays exact in these numbers up to 2^24 elements of one set.
    return shared.astype(np.int64)


def forest(linked: np.ndarray, component: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all links and the known components connect, without those inside a component."""
    reach = linked | (component[:, None] == component[None, :])
    out, free = [], np.ones(len(reach), bool)
    for root in range(len(reach)):
        if not free[root]:
            continue
        free[root] = False
        pending = [root]
        while pending:
            at = pending.pop()
            fresh = np.flatnonzero(reach[at] & free)
            free[fresh] = False
            out.extend((at, int(x)) for x in fresh[component[fresh] != component[at]])
            pending.extend(fresh.tolist())
    return out


def _of_one_group(members: DataFrame, distance: int, percent: int) -> DataFrame:
    """Links ``a``, ``b`` that connect the linked nodes of different components within a group, confirmed on full sets.

    ``members`` are sorted runs of (``group``, ``one``, ``other``): the blocks of a group that meet.
    """
    names = ("group", "one", "other")

    def links(run: pa.Table) -> pa.RecordBatch | None:
        batch = run.combine_chunks().to_batches()[0]
        component, node, size, block = (batch.column(c).to_numpy() for c in ("component", "node", "n", "block"))
        if len(node) < 2 or (component == component[0]).all():
            return None
        values = _unpacked(batch)
        apart = np.zeros((len(node), len(node)), np.uint8)
        for slot in range(SLOTS):
            apart += values[:, None, slot] != values[None, :, slot]
        near = apart <= distance
        near &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
        near &= component[:, None] != component[None, :]
        if batch.column("one")[0] != batch.column("other")[0]:
            near &= block[:, None] != block[None, :]
        asked = np.flatnonzero(near.any(axis=1))
        if not len(asked):
            return None
        shared = shared_counts([np.frombuffer(batch.column("shingles")[i].as_buffer(), np.uint64) for i in asked.tolist()])
        union = size[asked][:, None] + size[asked][None, :] - shared
        found = forest(near[np.ix_(asked, asked)] & (100 * shared >= percent * union), component[asked])
        ends = np.array(found, np.int64).reshape(-1, 2)
        a, b = node[asked][ends[:, 0]], node[asked][ends[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                piece = batch.slice(start, stop - start)
                if held and any(held[-1].column(c)[0] != piece.column(c)[0] for c in names):
                    found = links(pa.Table.from_batches(held))
                    held = []
                    if found is not None:
                        yield found
                held.append(piece)
        if held and (found := links(pa.Table.from_batches(held))) is not None:
            yield found

    return members.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node``, packed ``shingles`` and longer signature ``fine`` of the nodes in ``wanted`` (``node``, ``least`` document)."""
    texts = text_only(docs).join(wanted.withColumnRenamed("node", "wanted"), F.col("doc_id").eqNullSafe(F.col("least")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(raw_texts(part), size)
            kept = [(node, s) for node, s in zip(part.column("wanted").to_pylist(), sets) if len(s) and _node(s) == node]
            fine = _signatures([s for _, s in kept], range(SLOTS, SLOTS + FINE_SLOTS)).astype(np.uint8)
            columns = [[node for node, _ in kept], [s.tobytes() for _, s in kept], [row.tobytes() for row in fine]]
            kinds = [pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "shingles", "fine"])

    return texts.select("wanted", "text").mapInArrow(run, "node long, shingles binary, fine binary")


def _beside(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col(column).alias("of_a"))
    other = sets.select(F.col("node").alias("b"), F.col(column).alias("of_b"))
    return pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "of_a", "of_b")


def _near_enough(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose longer signatures are within the distance that belongs to the threshold."""
    distance = allowed_distance(similarity, FINE_SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_a, of_b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FINE_SLOTS) for c in ("of_a", "of_b"))
            yield batch.select(["a", "b"]).filter(pa.array((of_a != of_b).sum(axis=1) <= distance))

    return _beside(pairs, sets, "fine").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets share at least ``percent`` of their union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                first, second = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.sort(np.concatenate([first, second]))
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return _beside(pairs, sets, "shingles").mapInArrow(run, "a long, b long")


def _meeting(members: DataFrame) -> DataFrame:
    """Every member once for each block of its group, its own included: blocks ``one`` and ``other`` meet."""
    spread = members.withColumn("against", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return spread.withColumns({"one": F.least("block", "against"), "other": F.greatest("block", "against")})


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``node``, ``component``) after ``links`` between nodes have connected their components."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("x")), "a")
    ends = ends.join(labels.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
    merged = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    labels = labels.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return written(labels, "labels")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents connected by links of at least ``percent`` similarity of their sets of ``size``-word shingles.

    One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (least ``doc_id`` reachable),
    ``kept`` (it is that document) and ``n_links`` (confirmed links of its set to other sets among those
    that hold the class together; links inside what is already connected are not looked for).

    Texts with fewer words are one shingle; null, empty and blank texts have none, are linked with nothing
    and are kept.  Rows that share an id are judged by their texts, and stay together where those are alike.
    A document without id is kept if nothing in its class has one.  Other columns are not read.
    """
    similarity = percent / 100
    distance = allowed_distance(similarity)
    sketched = written(sketches(docs, size), "sketches")
    packed = [f"s{i}" for i in range(PACKED)]
    # All rows of a node agree in everything but the id.
    alike = [F.max(c).alias(c) for c in ("n", *packed)]
    nodes = written(sketched.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), *alike), "nodes")

    keys = written(bucket_keys(nodes, distance), "bucket-keys")
    buckets = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    crowded = written(keys.join(buckets, "key"), "crowded-buckets")

    # First round: every node and the most central node that it meets, by the sizes of their buckets.
    central = written(crowded.groupBy("node").agg(F.sum("members").alias("weight")), "central")
    leaders = crowded.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("leader"))
    met = crowded.join(leaders, "key").where("node != leader.node").groupBy("node", "leader").agg(F.count("*").alias("times"))
    # Both count: a hub that is met often gathers its whole group, one that is met by chance does not.
    pull = (F.col("times") * F.col("leader.weight")).alias("pull")
    best = met.groupBy("node").agg(F.max(F.struct(pull, F.col("leader.node").alias("leader"))).alias("best"))
    best = written(best.select("node", "best.leader"), "leaders")
    candidates = central.select("node").join(nodes.select("node", "least"), "node")
    sets = written(_sets(docs, candidates, size).dropDuplicates(["node"]), "shingle-sets")
    first = best.select(F.col("node").alias("a"), F.col("leader").alias("b"))
    led = written(_confirmed(first, sets, percent), "first-links")

    # A node that none leads is its own group; so is one that shares no key, which the rounds below never meet.
    above = best.select(F.col("node").alias("leader"), F.col("leader").alias("group"))
    grouped = central.select("node").join(best, "node", "left").join(above, "leader", "left")
    grouped = grouped.select("node", F.coalesce("group", "leader", "node").alias("group"))
    tops = tree_roots(led.select(F.col("a").alias("node"), F.col("b").alias("up")))
    labels = grouped.join(tops, "node", "left").select("node", "group", F.coalesce("up", "node").alias("component"))
    known = written(labels.join(nodes.drop("least"), "node"), "led-nodes")

    # Second round: nodes of one group that are still apart, each sent once for each block that it meets.
    apart = known.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks")
    apart = apart.where("low != high").select("group", blocks)
    group = known.join(apart, "group").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).join(sets.select("node", "shingles"), "node")
    group = _meeting(group).select("group", "one", "other", "block", "component", "node", "n", "shingles", *packed)
    group = group.repartition("group", "one", "other").sortWithinPartitions("group", "one", "other")
    within = written(_of_one_group(group, distance, percent), "group-links")
    labels = _relabelled(known.select("node", "component"), within)

    # Third round: pairs of different groups and components in the buckets that still hold such.
    members = crowded.select("key", "variant", "node").join(known.select("node", "group").join(labels, "node"), "node")
    ends = [f(c).alias(f"{name}_{c}") for c in ("component", "group") for f, name in ((F.min, "low"), (F.max, "high"))]
    mixed = members.groupBy("key").agg(*ends, F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("long").alias("blocks")
    mixed = mixed.where("low_component != high_component and low_group != high_group").select("key", blocks, (F.col("members") > CROWD).alias("crowd"))
    members = members.join(mixed, "key").join(nodes.drop("least"), "node").join(sets.select("node", "fine"), "node")
    members = members.withColumn("fine", F.when(F.col("crowd"), F.col("fine")))
    members = _meeting(members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))).select(
        F.col("key").alias("bucket"), "one", "other", "block", "component", "group", "node", "variant", "n", "fine", *packed,
    )
    members = members.repartition("bucket", "one", "other").sortWithinPartitions("bucket", "one", "other")
    met = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    third = written(_near_enough(_across(members, distance, similarity).join(met, ["a", "b"], "left_anti"), sets, similarity), "third-pairs")
    across = written(_confirmed(third, sets, percent), "across-links")

    joined, links = _relabelled(labels, across), led.union(within).union(across)
    degrees = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    classes = nodes.select("node", "least").join(joined, "node", "left").join(degrees, "node", "left")
    classes = classes.withColumn("component", F.coalesce("component", "node"))
    roots = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    verdicts = classes.join(roots, "component").select("node", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sketched.select("doc_id", "n", "node").join(verdicts, "node", "left")
    component_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns.

    Rows that share an id go together if one of them goes; documents without id can't be named and stay.
    """
    gone = near_duplicates(docs, size, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
