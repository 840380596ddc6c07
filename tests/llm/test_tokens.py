"""Byte-level BPE, token files and the token cache against the libraries whose results they must give."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cases import no_documents, odd_documents, odd_rows
from tokenizers import Tokenizer

from keysift.llm import byte_bpe, queries, token_cache, token_files, vocab
from keysift.llm.vocab import WordEncoder
from keysift.session import scratch_path

RANKS = public_tokenizers.path(queries.BYTE_RANKS)
WORDS = public_tokenizers.path(queries.WORD_TOKENS)
SF = "/root/testdata/sf0.001"
MIX = [
    "'", "s", "t", "'re", "'ll", "'s", "'VE", "x", "é", "中", "1", "٣", "!", " ", "  ", "\n", "\t", " ", "😀", "é", "-", ".", "the", "İ", "ﬁ",
    "<|endoftext|>", "<|ENDOFTEXT|>", "\x00", "\u0085", "한", "ᄒ", "ᅡ", "ß",
]


def mixed_texts(count, seed=5):
    draw = random.Random(seed)
    return ["".join(draw.choice(MIX) for _ in range(draw.randint(0, 40))) for _ in range(count)]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(open(RANKS, "rb").read(), byte_bpe.character_classes())


def test_scan_finds_the_patterns_matches(codec, reference):
    texts = mixed_texts(3000) + ["", "a" * 3000 + "'s" * 500 + " " * 700 + "b"]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == reference.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_scan_does_not_depend_on_blocks():
    """Prefix compositions agree with a plain left-to-right run of the automaton."""
    draw = np.random.default_rng(2)
    generators, table, functions, _ = byte_bpe._monoid()
    for n in (1, 63, 64, 65, 4097, 10000):
        symbols = draw.integers(0, 2 * byte_bpe.SYMBOLS, n)
        state, wanted = byte_bpe.T_FRESH, []
        for s in symbols.tolist():
            state = byte_bpe._step(byte_bpe.T_FRESH if s >= byte_bpe.SYMBOLS else state, s % byte_bpe.SYMBOLS)[0]
            wanted.append(state)
        got = functions[byte_bpe._scan(generators[symbols], table), byte_bpe.T_FRESH]
        assert got.tolist() == wanted


def test_merge_short_and_long_agree(codec):
    draw = random.Random(4)
    for _ in range(300):
        piece = bytes(draw.choice(b"aabbclothe \xc3\xa9") for _ in range(draw.randint(1, byte_bpe.SHORT)))
        short = byte_bpe.merge(piece, codec.ranks)
        limit, byte_bpe.SHORT = byte_bpe.SHORT, 0
        try:
            assert byte_bpe.merge(piece, codec.ranks) == short
        finally:
            byte_bpe.SHORT = limit


def expected_digests(text, reference):
    ids = reference.encode_ordinary(text or "")
    joined = ",".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_digests_of_odd_rows(spark, reference):
    got = sorted(tuple(r) for r in byte_bpe.digests(odd_documents(spark), RANKS).collect() if r.doc_id is not None)
    want = sorted((i, *expected_digests(t, reference)) for i, t, *_ in odd_rows() if i is not None)
    assert got == want
    assert byte_bpe.digests(no_documents(spark), RANKS).count() == 0


def test_query_equals_library(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op2_byte_bpe(spark, SF).collect()}
    assert got == {d: expected_digests(t, reference) for d, t in docs}


def test_encode_keeps_offsets_and_decodes_parts(spark):
    rows = [(i, t) for i, t in enumerate(mixed_texts(50))] + [(99, None)]
    encoded = byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), RANKS)
    for row in encoded.collect():
        raw = (rows[row.doc_id][1] if row.doc_id < 99 else "" or "").encode()
        assert row.offsets[-1] == len(raw) and len(row.offsets) == len(row.ids) + 1
    whole = {r.doc_id: r.text for r in byte_bpe.decode(encoded, RANKS).collect()}
    assert whole == {i: t or "" for i, t in rows}
    part = encoded.selectExpr("doc_id", "ids", "offsets", "1 as start", "3 as stop")
    for row, text in zip(part.collect(), byte_bpe.decode(part, RANKS).collect()):
        raw = (rows[row.doc_id][1] if row.doc_id < 99 else "" or "").encode()
        low, high = row.offsets[min(1, len(row.ids))], row.offsets[min(3, len(row.ids))]
        assert text.text == raw[low:high].decode(errors="replace")


def test_word_encoder_equals_library(library):
    encoder = WordEncoder(open(WORDS, "rb").read())
    texts = mixed_texts(3000, 6) + ["Hello, world. don't STOP", "y" * 200 + " z", ""]
    texts += ["Straße!!! ÀÉþ*** a<|b <|endoftext|> x<|endoftext|>y it's, its', o'clock... (a) a.b,c; é\u0301! e\u0301? ---", "İstanbul ǅ ﬁne K Ω Ⅳ."]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert not any(len(w) > 64 for w in encoder.words)


def test_word_encoder_starts_anew(library, monkeypatch):
    """Small caches give the ids of large ones, word for word and count for count."""
    monkeypatch.setattr(vocab, "CACHED_WORDS", 50)
    monkeypatch.setattr(vocab, "CACHED_STEMS", 20)
    encoder = WordEncoder(open(WORDS, "rb").read())
    texts = mixed_texts(400, 11)
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    raws = [t.encode() for t in texts]
    got = [ids.tolist() for i in range(0, 400, 7) for ids in encoder.encode(raws[i : i + 7])]
    assert got == wanted
    assert [n for i in range(0, 400, 9) for n in encoder.counts(raws[i : i + 9])] == list(map(len, wanted))
    assert encoder.encode([]) == [] and encoder.counts([b"", b" "]) == [0, 0]


def expected_run(rows, library):
    """Start, count and check sum of each document in ascending order of id, null first, ties in table order."""
    start, out = 0, []
    for _, (i, t, *_) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_of_odd_rows(spark, library):
    folder = scratch_path(spark, "test-token-files")
    manifest = token_files.write_tokens(odd_documents(spark).repartition(1), WORDS, folder, end_id=2, length=64)
    got = [tuple(r) for r in token_files.read_tokens(spark, manifest, folder).collect()]
    assert sum(n for _, _, n, _ in got) == sum(r.n_tokens for r in manifest.collect())
    starts = sorted((s, n) for _, s, n, _ in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    plain = {(i, n, c) for i, _, n, c in got}
    assert plain == {(i, n, c) for i, _, n, c in expected_run(odd_rows(), library)}

    ids, mask = token_files.read_sequences(manifest, folder, [0], 64)[0]
    assert len(ids) == len(mask) == 64 and all(mask)
    empty = token_files.write_tokens(no_documents(spark), WORDS, scratch_path(spark, "test-no-files"), end_id=2)
    assert empty.count() == 0 and token_files.read_tokens(spark, empty, folder).count() == 0


def test_token_file_query_equals_library(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op4_token_files(spark, SF).collect()) == sorted(expected_run(docs, library))


def test_sequences_and_masks_hold_all_ids(spark, library):
    docs = [(i, t) for i, t in enumerate(mixed_texts(40, 8))]
    folder = scratch_path(spark, "test-sequences")
    manifest = token_files.write_tokens(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), WORDS, folder, end_id=2, length=16)
    n_rows = sum(-(-r.n_tokens // 16) for r in manifest.collect())
    got = [x for ids, mask in token_files.read_sequences(manifest, folder, list(range(n_rows)), 16) for x, m in zip(ids, mask) if m]
    assert got == [x for _, t in docs for x in [*library.encode(t, add_special_tokens=False).ids, 2]]


def test_token_cache_counts_and_reuses(spark, library):
    cache = scratch_path(spark, "test-token-cache")
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in odd_rows() if i is not None)
    for _ in range(2):
        got = token_cache.token_counts(odd_documents(spark), WORDS, cache).collect()
        assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
        assert len(got) == len(odd_rows())
    rows = spark.read.parquet(cache)
    distinct = {b" ".join((t or "").encode().split()) for _, t, *_ in odd_rows()}
    assert rows.count() == rows.select("content").distinct().count() == len(distinct)
    assert token_cache.token_counts(no_documents(spark), WORDS, cache).count() == 0


def test_token_cache_encodes_only_misses(spark):
    """A stored count is believed, another tokenizer's is not."""
    cache, docs = scratch_path(spark, "test-believed"), spark.createDataFrame([(1, "a b"), (2, "a  b "), (3, "c")], "doc_id long, text string")
    content = hashlib.sha256(b"a b").hexdigest()
    stored = [(content, token_cache.digest(WORDS), 77), (hashlib.sha256(b"c").hexdigest(), "another", 55)]
    spark.createDataFrame(stored, token_cache.CACHE_SCHEMA).write.parquet(cache)
    got = {r.doc_id: r.n_tokens for r in token_cache.token_counts(docs, WORDS, cache).collect()}
    assert got == {1: 77, 2: 77, 3: 1}


def test_token_cache_query_equals_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op9_token_cache(spark, SF).collect()}
    counts = {d: len(library.encode(t or "", add_special_tokens=False).ids) for d, t in docs}
    assert got == {d: (len((t or "").encode()), counts[d], counts[d] > 2048) for d, t in docs}
