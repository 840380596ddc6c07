"""The filter audit, importance resampling and exact duplicates against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from cases import alnum, no_documents, odd_documents, odd_rows, prose

from keysift.llm import exact_dedup, filter_audit, queries, resampling

SF = "/root/testdata/sf0.001"


def table(spark, docs, kind="doc_id long, text string"):
    return spark.createDataFrame(docs, kind)


# Filter audit

def plain_audit(docs, labels):
    """Every order walked document by document; docs are (doc_id, text, part)."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    rows = defaultdict(list)
    for d, t, part in docs:
        t = t or ""
        words = t.encode().split()
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if d is not None and first[t] < d else set()
        rows[part or ""].append((d, fails))
    out = Counter()
    for part, members in rows.items():
        shapley, found = Counter(), []
        for order in permutations("ABCDE"):
            alive = list(members)
            for step, f in enumerate(order, 1):
                gone = [m for m in alive if f in m[1]]
                alive = [m for m in alive if f not in m[1]]
                shapley[f] += len(gone)
                failing = sum(f in m[1] for m in members)
                found.append((part, "".join(order), step, len(alive), len(gone), failing - len(gone), sum(m[1] == {f} for m in members),
                              sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone), f))
        out.update((*r[:-1], shapley[r[-1]]) for r in found)
    return out


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(docs, labels, **rest):
    return Counter(tuple(r) for r in filter_audit.audit(docs, labels, **rest).select(*AUDIT).collect())


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


ODD_LABELS = [(3, 1, 1), (3, 0, 0), (4, 1, 0), (None, 1, 1), (5, None, 1), (99, 1, 1), (8, 1, None)]


def test_audit_on_odd_rows(spark):
    docs = odd_documents(spark)
    want = plain_audit([(r[0], r[1], r[3]) for r in odd_rows()], ODD_LABELS)
    assert audited(docs, labels_of(spark, ODD_LABELS)) == want
    # A sketch far too small for the table clears nothing and changes nothing.
    assert audited(docs, labels_of(spark, ODD_LABELS), limit=1) == want


def test_audit_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plain = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    want = plain_audit(plain, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert Counter(tuple(r) for r in queries.op11_filter_audit(spark, SF).select(*AUDIT).collect()) == want


def test_audit_of_empty_tables(spark):
    assert not audited(no_documents(spark), labels_of(spark, ODD_LABELS))
    assert len(audited(odd_documents(spark), labels_of(spark, []))) == 600 * 2
    assert filter_audit.passing(no_documents(spark)).count() == 0


def test_hot_text_and_large_groups(spark):
    copies = [(i, prose(60), "s") for i in range(400)] + [(1000 + i, prose(60, i), "t") for i in range(300)]
    random.Random(4).shuffle(copies)
    got = filter_audit.masks(table(spark, copies, "doc_id long, text string, source string").repartition(7), "source")
    late = {r.doc_id for r in got.where(f"mask & {filter_audit.COPY} != 0").collect()}
    first = {}
    for d, t, _ in sorted(copies):
        first.setdefault(t, d)
    assert late == {d for d, t, _ in copies if first[t] != d}


def test_sketch_clears_most_unique_texts_and_no_repeat(spark):
    rows = [(i, f"text {i}") for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(500)]
    marks = filter_audit.marked(table(spark, [(d, t, "") for d, t in rows], "doc_id long, text string, part string").select("doc_id", "part", "text"))
    shape = filter_audit.Shape(len(rows))
    found = filter_audit.with_repeats(marks, filter_audit.merged_sketch(marks, shape), shape).where("maybe").collect()
    maybe = {r.doc_id for r in found}
    repeated = set(range(500)) | set(range(5000, 5500))
    assert repeated <= maybe
    assert len(maybe - repeated) < 0.05 * 2500


def test_orders_cover_every_step_once():
    steps = filter_audit.orders()
    assert len(steps) == 600 and len({s[0] for s in steps}) == 120
    assert all(not bit & before and bin(before).count("1") == step - 1 for _, step, bit, before in steps)


# Importance resampling

def plain_draw(docs, target, longest=1, percent=10, min_words=20):
    def features(t):
        w = alnum(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = np.zeros(10000), np.zeros(10000)
    for _, text in docs:
        np.add.at(s, features(text), 1)
    for text in target:
        np.add.at(t, features(text), 1)
    gain = [math.floor(1000 * math.log((y + 1) * (s.sum() + 10000) / ((x + 1) * (t.sum() + 10000)))) for x, y in zip(s.tolist(), t.tolist())]
    rows = []
    for d, text in docs:
        f = features(text)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(alnum(text)) >= min_words))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    out = Counter((*r[:4], i if i <= drawn else None) for i, r in enumerate(able, 1))
    return out + Counter((*r[:4], None) for r in rows if not r[4])


def drawn(got):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect())


def test_draw_on_the_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert drawn(queries.op12_importance_resampling(spark, SF)) == plain_draw(docs, target)


@pytest.mark.parametrize(("longest", "percent", "run_rows", "segments"), [(1, 10, 4, 3), (2, 50, 3, 5), (3, 100, 2, 9), (1, 0, 100, None)])
def test_draw_on_odd_rows(spark, longest, percent, run_rows, segments):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(100 + i, prose(30 + i, i)) for i in range(40)] + [(None, prose(50, 7))] * 25 + [(200, prose(50, 8))] * 9
    docs = odd_documents(spark).select("doc_id", "text", "n", "kept", "row").unionByName(table(spark, rows[len(odd_rows()) :]), allowMissingColumns=True)
    target = [None, "", prose(200, 9), prose(10, 7)]
    got = resampling.resampled(docs.repartition(3), table(spark, [(1, t) for t in target]), percent, longest=longest, run_rows=run_rows, segments=segments)
    assert drawn(got) == plain_draw(rows, target, longest, percent)


def test_draw_from_and_towards_empty_tables(spark):
    nothing = table(spark, [], "doc_id long, text string")
    assert resampling.resampled(no_documents(spark), nothing).count() == 0
    rows = [(i, prose(30, i)) for i in range(20)]
    assert drawn(resampling.resampled(table(spark, rows), nothing)) == plain_draw(rows, [])
    assert resampling.drawn(table(spark, rows), nothing, 25).count() == 5


def test_cuts_part_equal_rows():
    scores, ids = np.array([5, 5, 5, 5]), np.array([1, 1, 1, 2])
    assert resampling.cuts(scores, ids, 7, [(-5, 1, 7, 2)]).tolist() == [0, 2, 4]
    assert resampling.cuts(scores, ids, 6, [(-5, 1, 7, 2)]).tolist() == [0, 3, 4]
    assert resampling.cuts(scores, ids, 8, [(-5, 1, 7, 2)]).tolist() == [0, 0, 4]


# Exact duplicates

def plain_exact(docs, smallest=False):
    groups = defaultdict(list)
    normal = lambda t: (t or "").encode().lower()
    for d, t in docs:
        groups[normal(t)].append(d)
    out = Counter()
    for d, t in docs:
        known = [x for x in groups[normal(t)] if x is not None]
        keep = (min(known) if smallest else max(known)) if known else None
        out[d, keep, len(groups[normal(t)]), d == keep, hashlib.sha256(normal(t)).hexdigest()] += 1
    return out


def exact(docs, *args, **rest):
    return Counter(tuple(r) for r in exact_dedup.exact_duplicates(docs, *args, **rest).collect())


def test_exact_on_the_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in queries.op13_exact_duplicates(spark, SF).collect()) == plain_exact(docs)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_on_odd_rows(spark, keep):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert exact(odd_documents(spark), keep) == plain_exact(rows, keep == "smallest")


def test_exact_of_an_empty_table(spark):
    assert not exact(no_documents(spark))
    with pytest.raises(ValueError, match="largest or smallest"):
        exact_dedup.exact_duplicates(no_documents(spark), "first")


def test_levels_of_a_hot_text_and_spilled_subtrees(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 5)
    rows = [(i, "Hot " * 300) for i in range(200)] + [(1000 + i, prose(40, i % 60)) for i in range(150)] + [(5000, "x" * 40000), (5001, "X" * 40000)]
    random.Random(1).shuffle(rows)
    docs = table(spark, rows).repartition(12)
    assert exact(docs, fan=4, part_bytes=4000, trie_bytes=8000) == plain_exact(rows)
    assert exact(docs, fan=4, part_bytes=1 << 20, trie_bytes=3000) == plain_exact(rows)


def test_deduplicated_keeps_columns(spark):
    docs = odd_documents(spark)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    texts = {(r[1] or "").lower() for r in odd_rows()}
    assert {(r.text or "").lower() for r in kept.collect()} == texts


def test_trie_against_a_dictionary():
    draw = random.Random(3)
    trie, plain = exact_dedup.Patricia(smallest=True), {}
    for i in range(4000):
        key = bytes(draw.choice(b"ab") for _ in range(draw.randrange(9)))
        assert trie.insert(key, i % 97 or None, 1, (i, 0, len(key), 0))
        old = plain.get(key)
        plain[key] = (exact_dedup.better(old[0], i % 97 or None, True) if old else i % 97 or None, (old[1] if old else 0) + 1)
    assert {k: (n.owner, n.n) for k, n in trie.terminals(trie.root, b"")} == plain
    assert trie.strings == len(plain)


def test_subtrees_given_up_are_whole():
    draw = random.Random(5)
    trie, inside, outside = exact_dedup.Patricia(smallest=False), Counter(), Counter()
    keys = [bytes(draw.choice(b"abc") for _ in range(draw.randrange(12))) for _ in range(3000)]
    for i, key in enumerate(keys):
        if not trie.insert(key, i, 1, (i, 0, len(key), 0)):
            outside[key] += 1
        if i in (500, 900, 1500):
            before = trie.held
            outside.update(k for k, n in trie.give_up() for _ in n.entries)
            assert trie.held < before
    inside.update(k for k, n in trie.terminals(trie.root, b"") for _ in n.entries)
    assert inside + outside == Counter(keys)
    assert not set(inside) & set(outside)


def test_shared_prefix():
    for a, b, n in [(b"", b"x", 0), (b"abc", b"abd", 2), (b"abc", b"abcde", 3), (b"xbc", b"abc", 0), (b"a" * 1000 + b"b", b"a" * 1001, 1000)]:
        assert exact_dedup.shared_prefix(a, b) == n
