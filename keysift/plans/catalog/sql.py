"""SQL text for the comparison engine: hash words, positions and filters over the key tables."""

from __future__ import annotations

import math

from keysift.functions.hashing import HashScheme
from keysift.plans.fixtures import K


def blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


def word(digest: str, width: int, index: int) -> str:
    first = 2 * width * index
    pairs = " || ".join(f"substr({digest}, {first + 2 * b + 1}, 2)" for b in reversed(range(width)))
    return f"CAST('0x' || {pairs} AS BIGINT)"


def words_list(key: str, slices: int, width: int) -> str:
    scheme = HashScheme(slices, width)
    items = []
    for salt in scheme.salts:
        digest = f"{scheme.algorithm}({blob(salt)} || encode({key}))"
        items += [word(digest, width, i) for i in range(scheme.words_per_digest)]
    return "[" + ", ".join(items[:slices]) + "]"


def slices(rate: float) -> int:
    return math.ceil(math.log(1 / rate, 2))


def per_slice(capacity: str, rate: float) -> str:
    return f"CAST(ceil({capacity} * abs(ln({rate!r})) / ({slices(rate)} * (ln(2.0) * ln(2.0)))) AS BIGINT)"


def positions(key: str, rate: float, bps: str = "bps") -> str:
    """A list of positions, one per slice, for 2- and 4-byte words."""
    k = slices(rate)
    text = f"CASE WHEN {bps} < 32768 THEN list_transform({words_list(key, k, 2)}, lambda w: w % {bps}) "
    if HashScheme(k, 4).algorithm not in ("sha384", "sha512"):  # the comparison engine has neither
        text += f"ELSE list_transform({words_list(key, k, 4)}, lambda w: w % {bps}) "
    return text + "END"


def filter_ctes(rate: float, source: str = "K", name: str = "", capacity: str = "count(*)") -> str:
    """FP (parameters) and FB (set bits) of the filters over ``source``; starts with a comma."""
    return f""",
FP{name} AS (SELECT table_id, greatest({capacity}, 1) AS n, {per_slice(f'greatest({capacity}, 1)', rate)} AS bps FROM {source} GROUP BY table_id),
FB{name} AS (
  SELECT DISTINCT table_id, s * bps + spots[s + 1] AS bit
  FROM (SELECT k.table_id, p.bps, {positions('k.key', rate, 'p.bps')} AS spots
        FROM {source} k JOIN FP{name} p USING (table_id)), range({slices(rate)}) r(s))"""


def hits_cte(probes: str, rate: float, name: str = "HITS", filters: str = "") -> str:
    """Rows of ``probes`` (table_id, key, ...) whose filter has all bits set; starts with a comma."""
    k = slices(rate)
    return f""",
{name}_S AS (SELECT q.table_id, q.key, s * p.bps + spots[s + 1] AS bit
  FROM (SELECT DISTINCT q.table_id, q.key, p.bps, {positions('q.key', rate, 'p.bps')} AS spots
        FROM {probes} q JOIN FP{filters} p USING (table_id)) q JOIN FP{filters} p USING (table_id), range({k}) r(s)),
{name} AS (SELECT q.table_id, q.key FROM {name}_S q JOIN FB{filters} b USING (table_id, bit) GROUP BY q.table_id, q.key HAVING count(*) = {k})"""


def with_keys(body: str) -> str:
    return f"WITH {K.strip()}{body}"
