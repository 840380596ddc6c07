"""Scalable Bloom filters: a sequence of layers of growing capacity and shrinking error rate.

The distinct keys of a group fill the layers in order of first appearance.  A key that an earlier
layer answers by accident is inserted all the same, so a layer holds exactly its capacity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.functions import hashing
from keysift.functions.hashing import HashScheme
from keysift.operators import bloom
from keysift.operators.bloom import FilterSet
from keysift.operators.ordering import grouped_row_number
from keysift.session import BROADCAST_BYTES, materialize

# Growth factors and the ratio by which each layer tightens the error rate.
SMALL_GROWTH = 2
LARGE_GROWTH = 4
TIGHTENING = 0.9

# Probes that a task asks together, and bytes of filters that are sent to all tasks at a time.
ASK_ROWS = 1 << 18
LOT_BYTES = BROADCAST_BYTES


def layer_error_rate(error_rate: float, layer: int) -> float:
    return error_rate * (1.0 - TIGHTENING) * TIGHTENING**layer


def assign_layers(keys: DataFrame, by: list[str], initial: int, scale: int, key: str = "key", pos: str = "pos") -> DataFrame:
    """Distinct keys with the layer they fill."""
    first = keys.groupBy(*by, key).agg(F.min(pos).alias("_first"))
    ranked = grouped_row_number(first, by, ["_first"], "_rank")
    starts, start, capacity = [], 0, initial
    while start < 1 << 50:
        start += capacity
        capacity *= scale
        starts.append(start)
    layer = reduce(lambda total, edge: total + (F.col("_rank") >= F.lit(edge).cast("bigint")).cast("int"), starts, F.lit(0))
    return ranked.withColumn("layer", layer).drop("_first", "_rank")


def build_layers(
    keys: DataFrame, by: list[str], error_rate: float, initial: int = 100, scale: int = SMALL_GROWTH, key: str = "key"
) -> list[FilterSet]:
    """One filter set per layer; the number of layers grows with the logarithm of the largest group."""
    layered = materialize(assign_layers(keys, by, initial, scale, key))
    depth = layered.agg(F.max("layer")).first()[0]
    layers = []
    for layer in range(0 if depth is None else depth + 1):
        rows = layered.where(F.col("layer") == layer)
        capacities = rows.select(*by).distinct().withColumn("capacity", F.lit(initial * scale**layer).cast("bigint"))
        rate = layer_error_rate(error_rate, layer)
        layers.append(bloom.build_filters(rows, bloom.size_filters(capacities, by, rate), by, rate, key))
    return layers


def layer_summary(layers: list[FilterSet], by: list[str]) -> DataFrame:
    parts = []
    for number, layer in enumerate(layers):
        stats = bloom.fill_statistics(layer).drop("num_slices", "bits_per_slice")
        parts.append(layer.params.join(stats, by).withColumn("layer", F.lit(number)))
    return reduce(DataFrame.unionByName, parts).select(
        *by, "layer", "capacity", "num_slices", "bits_per_slice", "error_rate", "ones"
    )


def schemes_of(layers: list[FilterSet]) -> dict[str, HashScheme]:
    """For each hash function that some layer uses, the scheme with the most salts; the others use the first of them."""
    out: dict[str, HashScheme] = {}
    for layer in layers:
        for scheme in (HashScheme(layer.num_slices, width) for width in layer.widths()):
            old = out.get(scheme.algorithm)
            out[scheme.algorithm] = scheme if old is None or len(old.salts) < len(scheme.salts) else old
    return out


def _lots(layers: list[FilterSet], by: list[str]) -> tuple[list[list[tuple]], list[tuple]]:
    """Addresses in lots whose filters, all layers, take at most ``LOT_BYTES``, and addresses that are larger alone."""
    sizes = reduce(DataFrame.unionByName, [layer.params.select(*by, "num_bits") for layer in layers])
    # One row per address.
    found = sizes.groupBy(*by).agg((F.sum("num_bits") / 8 + 64).alias("b")).orderBy(*by).collect()
    lots, held, large = [], LOT_BYTES + 1, []
    for *address, size in found:
        if size > LOT_BYTES:
            large.append(tuple(address))
            continue
        if held + size > LOT_BYTES:
            lots.append([])
            held = 0
        lots[-1].append(tuple(address))
        held += size
    return lots, large


def _asked(probes: DataFrame, layers: list[FilterSet], by: list[str], key: str) -> DataFrame:
    """The probes that some layer answers "maybe"; the filters they ask fit a broadcast, and no probe is shuffled."""
    spark, columns, schemes = probes.sparkSession, probes.columns, schemes_of(layers)
    kept = [layer.packed().select(*by, F.lit(i).alias("_layer"), F.col("bits_per_slice").alias("_bps"), "_packed") for i, layer in enumerate(layers)]
    held = reduce(DataFrame.unionByName, kept).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema) as out:
        out.write_table(held)
    sent, slices = spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), [layer.num_slices for layer in layers]
    salts = {name: len(scheme.salts) for name, scheme in schemes.items()}
    digests = [F.unhex(F.concat(*hashing.digest_texts(F.col(key), scheme))).alias(f"_{name}") for name, scheme in schemes.items()]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(sent.value).read_all()
        places, filters = list(zip(*(table.column(c).to_pylist() for c in by))), {}
        packed, numbers, widths = table.column("_packed"), table.column("_layer").to_pylist(), table.column("_bps").to_pylist()
        for i, address in enumerate(places):
            filters.setdefault(address, []).append((numbers[i], widths[i], packed[i].values.to_numpy().view(np.uint8)))

        def answer(rows: pa.Table) -> pa.Table:
            maybe = np.zeros(rows.num_rows, bool)
            raw = {name: np.frombuffer(b"".join(rows.column(f"_{name}").to_pylist()), np.uint8).reshape(rows.num_rows, salts[name], -1) for name in schemes}
            groups = rows.select(by).append_column("_at", pa.array(np.arange(rows.num_rows))).group_by(by, use_threads=False).aggregate([("_at", "list")])
            for g, address in enumerate(zip(*(groups.column(c).to_pylist() for c in by))):
                left = groups.column("_at_list")[g].values.to_numpy()
                # The last layers hold most keys; a probe that one of them answers asks no other.
                for number, bps, bits in sorted(filters.get(address, ()), key=lambda f: -f[0]):
                    scheme = HashScheme(slices[number], hashing.word_width(bps))
                    each = raw[scheme.algorithm][left][:, : len(scheme.salts), : scheme.words_per_digest * scheme.width]
                    words = np.ascontiguousarray(each).reshape(len(left), -1).view(f"<u{scheme.width}")
                    alive = np.arange(len(left))
                    for i in range(scheme.num_slices):
                        at = (words[alive, i].astype(np.uint64) % np.uint64(bps)).astype(np.int64) + i * bps
                        alive = alive[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                    maybe[left[alive]] = True
                    left = np.delete(left, alive)
            return rows.select(columns).filter(pa.array(maybe))

        rows, size = [], 0
        for batch in batches:
            rows, size = [*rows, batch], size + batch.num_rows
            if size >= ASK_ROWS:
                yield from answer(pa.Table.from_batches(rows)).to_batches()
                rows, size = [], 0
        if size:
            yield from answer(pa.Table.from_batches(rows)).to_batches()

    known = probes.where(F.col(key).isNotNull())
    return known.select(*columns, *digests).mapInArrow(ask, probes.schema)


def probe_layers(probes: DataFrame, layers: list[FilterSet], key: str = "key") -> DataFrame:
    """The probes any layer of their group answers "maybe", once each.

    A probe is hashed once for each hash function and asks the layers one after another.  Filters are dealt into
    lots of groups; only groups whose filters are too large alone are asked layer by layer.
    """
    by, columns = layers[0].by, probes.columns
    lots, large = _lots(layers, by)
    if len(lots) + bool(large) > 1:
        probes = materialize(probes.distinct())

    def within(df: DataFrame, addresses: list[tuple]) -> DataFrame:
        chosen = df.sparkSession.createDataFrame(addresses, df.select(*by).schema)
        return df.join(F.broadcast(chosen), by, "left_semi")

    def chosen(addresses: list[tuple]) -> list[FilterSet]:
        if len(lots) + bool(large) == 1:
            return layers
        return [FilterSet(by, layer.error_rate, within(layer.params, addresses), within(layer.words, addresses), layer.facts()) for layer in layers]

    parts = [_asked(within(probes, lot).distinct(), chosen(lot), by, key) for lot in lots]
    if large:
        asked = within(probes, large)
        parts += [bloom.probe_hits(bloom.with_digests(asked, layer, key), layer).select(*columns) for layer in chosen(large)]
    return reduce(DataFrame.unionByName, parts).distinct() if large else reduce(DataFrame.unionByName, parts)
