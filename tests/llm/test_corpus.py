"""Near duplicates, repeated passages, language-model scores and the pipeline against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import lowered_words, no_documents, odd_documents, odd_rows, prose
from pyarrow import fs

import corpus_pipeline
from keysift.llm import elias_fano, lm, near_dup, queries, repeats
from keysift.llm.graph import components, tree_roots

SF = "/root/testdata/sf0.001"


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# Components

def plain_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(9, 3), (3, 7), (20, 21), (21, 20), (-5, 21)],
])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain_components([e for e in edges if e[0] != e[1]])


# Near duplicates

def plain_classes(docs, size, percent):
    sets = []
    for _, t in docs:
        w = lowered_words(t)
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    group = plain_components(links)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[group.get(i, i)] = min(d, least.get(group.get(i, i), d))
    return Counter((d, len(s), d if not s else least.get(group.get(i, i))) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def classes(got):
    rows = got.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def edited(text, changes, seed):
    draw, words = random.Random(seed), text.split()
    for i in draw.sample(range(len(words)), changes):
        words[i] = f"new{draw.randint(0, 99999)}"
    return " ".join(words)


def test_tree_roots(spark):
    up = {1: 2, 2: 3, 3: 4, 4: 9, 5: 9, 6: 7, 10: 6}
    got = tree_roots(spark.createDataFrame(list(up.items()), "node long, up long")).collect()
    assert {r.node: r.up for r in got} == {1: 9, 2: 9, 3: 9, 4: 9, 5: 9, 6: 7, 10: 7} and len(got) == len(up)
    assert tree_roots(spark.createDataFrame([], "node long, up long")).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    docs = [(i, t) for i, t, *_ in odd_rows()]
    assert classes(near_dup.near_duplicates(odd_documents(spark), 3, 85)) == plain_classes(docs, 3, 85)
    assert near_dup.near_duplicates(no_documents(spark)).count() == 0


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_of_edited_texts(spark, size, percent):
    """Chains of edits around the threshold: links between copies, not only to one leader."""
    docs = []
    for g in range(6):
        text = prose(120, g)
        for k in range(12):
            docs.append((1000 - 13 * len(docs) % 997, text))
            text = edited(text, 1 + (g + k) % 4, 100 * g + k)
    docs += [(5000 + i, prose(120, 50) + " " + prose(10 + i, 60 + i)) for i in range(20)]
    assert classes(near_dup.near_duplicates(table(spark, docs), size, percent)) == plain_classes(docs, size, percent)


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    docs = [(i, prose(100, 7) + " " + prose(12 + i % 5, 90 + i)) for i in range(25)]
    assert classes(near_dup.near_duplicates(table(spark, docs), 3, 85)) == plain_classes(docs, 3, 85)


def test_signatures_within_the_distance_share_a_key(spark):
    distance, draw = near_dup.allowed_distance(0.85), np.random.default_rng(1)
    rows = []
    for pair in range(60):
        a = draw.integers(0, 1 << 16, near_dup.SLOTS).astype(np.uint16)
        b = a.copy()
        b[draw.choice(near_dup.SLOTS, distance, replace=False)] ^= np.uint16(1)
        rows += [(2 * pair + k, *map(int, x.view(np.int64))) for k, x in enumerate((a, b))]
    schema = "node long, " + ", ".join(f"s{i} long" for i in range(near_dup.PACKED))
    keys = defaultdict(set)
    for r in near_dup.bucket_keys(spark.createDataFrame(rows, schema), distance).collect():
        keys[r.node].add(r.key)
    assert all(keys[2 * p] & keys[2 * p + 1] for p in range(60))


def test_near_duplicate_query_equals_brute_force(spark):
    assert classes(queries.op7_near_duplicates(spark, SF)) == plain_classes(documents(spark), 3, 85)


def test_deduplicated_keeps_one_of_each_class(spark):
    docs = odd_documents(spark)
    kept = near_dup.deduplicated(docs, 3, 85)
    assert kept.schema.names == docs.schema.names
    gone = {r.doc_id for r in near_dup.near_duplicates(docs, 3, 85).collect() if not r.kept and r.doc_id is not None}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_ in odd_rows() if i not in gone) and gone


# Repeated passages

def plain_repeats(docs, least, keep_first):
    places = defaultdict(list)
    raws = [(t or "").encode() for _, t in docs]
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i))
    for i in order:
        for j in range(len(raws[i]) - least + 1):
            places[raws[i][j : j + least]].append((i, j))
    change = [np.zeros(len(r) + 1, np.int64) for r in raws]
    for found in places.values():
        for i, j in found[1 if keep_first else 0 :] if len(found) > 1 else []:
            change[i][j] += 1
            change[i][j + least] -= 1
    out = []
    for (d, _), raw, c in zip(docs, raws, change):
        covered = np.cumsum(c[:-1]) > 0
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
        out.append((d, len(raw), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def removed(got):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())


def passages():
    draw, shared = random.Random(5), [prose(60, 70 + i) for i in range(4)]
    docs = []
    for i in range(60):
        parts = [prose(draw.randint(0, 60), 200 + i)]
        for _ in range(draw.randint(0, 3)):
            text = draw.choice(shared)
            low = draw.randint(0, 150)
            parts += [text[low : low + draw.randint(150, 400)], prose(draw.randint(0, 8), draw.randint(0, 999))]
        docs.append((i, "".join(parts)))
    return [*docs, (100, "ab" * 2000), (101, "ab" * 150), (102, "z" * 199), (103, "z" * 199), (104, "y" * 200), (105, "y" * 201)]


@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats_of_planted_passages(spark, keep_first):
    docs = passages()
    assert removed(repeats.repeated_spans(table(spark, docs).repartition(5), 200, keep_first)) == plain_repeats(docs, 200, keep_first)


@pytest.mark.parametrize(("least", "shard_bytes"), [(100, 1 << 21), (200, 500), (333, 1 << 21)])
def test_repeats_with_hot_keys_and_other_lengths(spark, monkeypatch, least, shard_bytes):
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard_bytes)
    docs = passages()
    for keep_first in (False, True):
        assert removed(repeats.repeated_spans(table(spark, docs).repartition(4), least, keep_first)) == plain_repeats(docs, least, keep_first)


def test_repeats_of_odd_rows(spark):
    docs = [(i, t if i != 13 else prose(700, 3)) for i, t, *_ in odd_rows()]
    assert removed(repeats.repeated_spans(table(spark, docs), 200, False)) == plain_repeats(docs, 200, False)
    assert repeats.repeated_spans(odd_documents(spark)).count() == len(odd_rows())
    assert repeats.repeated_spans(no_documents(spark)).count() == 0


def test_previous_factors_equal_brute_force():
    draw = np.random.default_rng(3)
    for _ in range(20):
        text = draw.integers(97, 99, 300).astype(np.uint8)
        starts = np.sort(draw.choice(200, 60, replace=False))
        position, ends = draw.permutation(60), np.full(60, 300)
        raw = text.tobytes()
        want = []
        for i in range(60):
            best = 0
            for j in range(60):
                if position[j] < position[i]:
                    k = 0
                    while k < 70 and raw[starts[i] + k] == raw[starts[j] + k]:
                        k += 1
                    best = max(best, k)
            want.append(best)
        assert repeats.previous_factors(text, starts, position, 70, ends).tolist() == want


def test_repeat_query_equals_brute_force(spark):
    docs = documents(spark)
    assert removed(queries.op10_repeated_passages(spark, SF)) == plain_repeats(docs, 200, False)


# Language model

def test_elias_fano_and_trie():
    draw = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 5), (10, 10), (100, 100000), (1000, 50), (3000, 1 << 44), (64, 64)):
        values = np.sort(draw.integers(0, top, n).astype(np.uint64))
        sequence = elias_fano.EliasFano.build(values)
        assert sequence.access(np.arange(n)).tolist() == values.tolist()
        wanted = draw.integers(0, top + top // 2 + 5, 500).astype(np.uint64)
        assert sequence.successor(wanted).tolist() == np.searchsorted(values, wanted).tolist()


def test_trie_file_round_trip(tmp_path):
    draw = np.random.default_rng(2)
    keys = np.unique(draw.integers(0, 40 * 500, 3000))
    codes = draw.integers(1, 256, len(keys)).astype(np.uint8)
    elias_fano.BigramTrie.build(keys // 500, keys % 500, codes).save(fs.LocalFileSystem(), str(tmp_path / "trie"))
    trie = elias_fano.BigramTrie.load(fs.LocalFileSystem(), str(tmp_path / "trie"))
    asked = np.arange(45 * 500)
    known = dict(zip(keys.tolist(), codes.tolist()))
    assert trie.lookup(asked // 500, asked % 500).tolist() == [known.get(k, 0) for k in asked.tolist()]


@pytest.mark.parametrize("top", [100, 80_000, 6_000_000])
def test_codes_of_a_context_add_up_to_one(top):
    """Contexts met about 5 * 10^2, 10^6 and 10^8 times, the r-th of their pairs ``top / r`` times."""
    counts = (top // np.arange(1, top + 1)).astype(np.uint64)
    context = np.full(len(counts), counts.sum())
    parts = lm._parts(lm._codes(counts, context, lm.PRIOR), context, lm.PRIOR)
    exact = counts / (context + lm.PRIOR)
    assert parts.sum() + lm.PRIOR / (context[0] + lm.PRIOR) == pytest.approx(1, abs=0.01)
    step = max(lm.STEP, math.log10(context[0] + lm.PRIOR) / 254)
    assert step < 0.033 and (np.abs(np.log10(parts / exact)) <= step / 2 + 1e-9).all()
    if top > 10**6:
        assert parts[-1] == pytest.approx(exact[-1])


def plain_scores(docs, train, prior=lm.PRIOR):
    tokens = [[*lowered_words(t), b""] for _, t in docs]
    words, pairs = Counter(), Counter()
    for own, used in zip(tokens, train):
        if used:
            words.update(own)
            pairs.update(zip(own, own[1:]))
    n, v = sum(words.values()), len(words)
    out = defaultdict(list)
    for (d, _), own, used in zip(docs, tokens, train):
        base = sum(math.log10((words[w] + 1) / (n + (v + 1))) for w in own)
        score, before = 0.0, None
        for w in own:
            single = (words[w] + 1) / (n + v + 1)
            score += math.log10(single if before is None else (pairs[before, w] + prior * single) / (words[before] + prior))
            before = w
        out[d].append((not used, len(own), sum(words[w] > 0 for w in own), n, base, score))
    return out


def assert_scores(got, docs, train):
    want = plain_scores(docs, train)
    seen = defaultdict(list)
    for r in got.collect():
        seen[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert {d: len(x) for d, x in seen.items()} == {d: len(x) for d, x in want.items()}
    for d in want:
        for a, b in zip(sorted(seen[d]), sorted(want[d])):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-6)
            # Half a step of the quantised logarithm for each token.
            assert abs(a[5] - b[5]) <= b[1] * lm.STEP / 2 + 1e-6


def by_rule(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def test_scores_of_odd_rows(spark):
    docs = [(i, t) for i, t, *_ in odd_rows()]
    assert_scores(lm.scores(odd_documents(spark).drop("train")), docs, [by_rule(i) for i, _ in docs])
    assert lm.scores(no_documents(spark)).count() == 0


def test_scores_without_training(spark):
    from pyspark.sql import functions as F

    rows = lm.scores(table(spark, [(1, "a b"), (2, None)]), train=F.lit(False)).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0.0 for r in rows)


def test_score_query_equals_brute_force(spark):
    docs = documents(spark)
    assert_scores(queries.op1_lm_scores(spark, SF), docs, [by_rule(i) for i, _ in docs])


def test_held_out_text_is_likelier_than_by_unigrams(spark):
    """Held-out accuracy: a model of ordered text prefers that order."""
    docs = [(i, " ".join(["alpha beta gamma delta"] * (5 + i % 7))) for i in range(200)]
    rows = [r for r in lm.scores(table(spark, docs)).collect() if r.held_out]
    assert rows and all(r.score > r.base_score / 2 for r in rows)


# Pipeline

def test_pipeline_stages_take_effect(spark):
    """Each stage's decisions by its own plain rule, on the rows that the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]
    from test_rules import plain_counts, plain_matches, plain_spans

    steps = dict(corpus_pipeline.STAGES)
    kept = steps["quality"](spark, docs, SF)
    assert kept.columns == docs.columns
    fine = {d for d, t in documents(spark) if not plain_counts(t)[-1]}
    assert {r.doc_id for r in kept.collect()} <= fine and kept.count() > 0.9 * len(fine)

    texts = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    single = steps["near_duplicates"](spark, kept, SF)
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {c for d, _, c in plain_classes(texts, 5, 80) if d == c}

    texts = [tuple(r) for r in single.select("doc_id", "text").collect()]
    clean = steps["decontamination"](spark, single, SF)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r.doc_id for r in clean.collect()} == {x[0] for x in plain_matches(texts, items) if not x[-1]}

    hidden = steps["personal_data"](spark, clean, SF)
    assert hidden.columns == docs.columns
    rows = hidden.select("doc_id", "text").collect()
    assert len(rows) == clean.count() and not any(plain_spans(r.text) for r in rows)

    final = corpus_pipeline.run(spark, SF)
    by_id = {r.doc_id: r for r in final.collect()}
    assert {d: r.decoded_sha256 for d, r in by_id.items()} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in rows}


def test_pipeline_is_registered():
    import __spark_entry__

    assert {"pipeline", *queries.QUERIES} <= set(__spark_entry__.queries())
    assert [n for n in range(1, 11) if not any(name.startswith(f"op{n}_") for name in queries.QUERIES)] == []


def test_crowded_buckets_use_the_longer_signature(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CROWD", 2)
    docs = [(i, edited(prose(150, 7), 1 + i % 14, 300 + i)) for i in range(70)]
    assert classes(near_dup.near_duplicates(table(spark, docs), 3, 85)) == plain_classes(docs, 3, 85)


# Groups of near copies

def near_copies(count, changes, seed, words=400):
    """Copies of one text, each with so many words replaced at random: close to each other, but mostly not linked."""
    draw, base = random.Random(seed), [f"w{i}" for i in range(words)]
    out = []
    for i in range(count):
        own = list(base)
        for at in draw.sample(range(words), changes):
            own[at] = f"x{i}-{at}"
        out.append(" ".join(own))
    return out


def test_large_group_of_copies_that_are_not_linked(spark, monkeypatch):
    """2 000 copies whose similarity lies around the threshold: the classes are those of brute force, from few rows."""
    monkeypatch.setattr(near_dup, "BLOCK", 700)
    texts = near_copies(1500, 11, 5) + near_copies(400, 7, 6) + near_copies(100, 2, 7)
    docs = list(enumerate(texts))
    sets = [frozenset(zip(*(t.split()[k:] for k in range(3)))) for t in texts]
    held = near_dup.shared_counts(near_dup.shingle_sets([t.encode() for t in texts], 3))
    size = np.array([len(s) for s in sets])
    linked = 100 * held >= 85 * (size[:, None] + size[None, :] - held)
    group = plain_components([(int(i), int(j)) for i, j in near_dup.forest(linked, np.arange(len(texts)))])
    got = near_dup.near_duplicates(table(spark, docs).repartition(8), size=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: group.get(i, i) for i in range(len(texts))}


def test_shared_counts_and_forests():
    draw = random.Random(2)
    sets = [np.unique(np.array([draw.randrange(300) for _ in range(draw.randrange(1, 200))], np.uint64)) for _ in range(40)]
    got = near_dup.shared_counts(sets)
    assert all(got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(40) for j in range(40) if i != j)
    linked = np.array([[draw.random() < 0.05 for _ in range(60)] for _ in range(60)])
    linked |= linked.T
    component = np.array([i // 3 for i in range(60)])
    edges = near_dup.forest(linked, component)
    assert all(linked[a, b] and component[a] != component[b] for a, b in edges)
    inside = [(3 * c, 3 * c + k) for c in range(20) for k in (1, 2)]
    every = [(int(a), int(b)) for a, b in zip(*np.nonzero(linked))]
    assert plain_components(inside + edges) == plain_components(inside + [e for e in every if e[0] != e[1]])
    assert len(edges) < 60


def test_recall_just_above_the_threshold(spark):
    """Pairs of 0.85 to 0.87: none may be lost."""
    draw, docs, wanted = random.Random(8), [], []
    for i in range(300):
        base = [f"p{i}w{k}" for k in range(300)]
        own = list(base)
        for at in draw.sample(range(0, 300, 4), 7):
            own[at] = "changed"
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(own))]
        a, b = (frozenset(zip(t, t[1:], t[2:])) for t in (base, own))
        wanted.append(100 * len(a & b) >= 85 * len(a | b))
    assert sum(wanted) > 250
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(table(spark, docs), size=3, percent=85).collect()}
    assert all((got[2 * i + 1] == 2 * i) == linked for i, linked in enumerate(wanted))
