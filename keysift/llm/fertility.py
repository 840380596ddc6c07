"""Quality rules: plain counts, and how well the vocabularies of two public tokenizers fit a text.

Words are encoded one by one by a sentencepiece model with byte fallback.  Characters per token,
the share of byte tokens and the entropy of the tokens (as a part of the most that many tokens could
have) are held against bands of the text's script, and so are the characters per token of a byte-level
vocabulary for many languages.  Texts outside, full of signs or with few letters are rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysift.llm.tables import slices, text_only
from keysift.llm.vocab import CACHE_ENTRIES, CACHED_BYTES, byte_ranks, shipped
from keysift.llm.words import Numbering

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
ASCII_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

# First code points of ranges and the script that each belongs to.  Only letters and their marks count:
# those of scripts without a name here and single Korean letters, which come as bytes, as other, those that no script owns (None) not at all.
RANGES = [
    (0x0000, "latin"), (0x02B0, None), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0860, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x1AB0, None), (0x1B00, "other"), (0x1C80, "cyrillic"), (0x1C90, "other"), (0x1CD0, "indic"),
    (0x1D00, "latin"), (0x1DC0, None), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, None), (0x2C00, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, None), (0x3005, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"),
    (0x3190, "han"), (0x31F0, "kana"), (0x3200, None), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"),
    (0xA700, "latin"), (0xA800, "other"), (0xA8E0, "indic"), (0xA900, "other"), (0xA960, "other"), (0xAB30, "latin"),
    (0xAB70, "other"), (0xAC00, "hangul"), (0xD800, None), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, None), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF65, "kana"), (0xFFA0, "hangul"), (0xFFE0, None),
    (0x10000, "other"), (0x1AFF0, "kana"), (0x1B170, "other"), (0x1D000, None), (0x1DF00, "latin"), (0x1E000, "other"), (0x1F000, None),
    (0x20000, "han"), (0x32000, None),
]
SCRIPTS = ["other", *dict.fromkeys(script for _, script in RANGES if script not in ("other", None))]

# Rejection bands by script: least and most characters per token, most byte tokens, least part of the possible entropy.
# They lie outside what clean prose gives (in 60 languages, some with marks apart) and, where the vocabulary has the script's letters, short
# of random letters, which mostly come as bytes.  Latin reaches down to Yoruba (0.99) and Vietnamese (1.14, byte share 0.22 where marks
# stand apart).  Odia and Ethiopic, in "indic" and "other", are spelled out in bytes (0.94) even when clean: no byte share is too high there.
BANDS = {
    "latin": (0.8, 8.0, 0.3, 0.4), "greek": (0.62, 8.0, 0.4, 0.25), "cyrillic": (0.8, 8.0, 0.35, 0.25), "hebrew": (0.65, 8.0, 0.4, 0.25),
    "arabic": (0.6, 8.0, 0.45, 0.25), "devanagari": (0.55, 8.0, 0.4, 0.2), "bengali": (0.55, 8.0, 0.45, 0.2), "tamil": (0.55, 8.0, 0.45, 0.2),
    "telugu": (0.4, 8.0, 0.75, 0.2), "kannada": (0.45, 8.0, 0.65, 0.2), "indic": (0.25, 8.0, 1.0, 0.2), "thai": (0.7, 8.0, 0.3, 0.2),
    "hangul": (0.4, 4.0, 0.7, 0.2), "kana": (0.5, 4.0, 0.6, 0.2), "han": (0.45, 4.0, 0.75, 0.2), "other": (0.2, 2.5, 1.0, 0.2),
    # Rejected whatever their tokens.
    "signs": (np.inf, np.inf, 0.0, 1.0),
}
# Least and most characters per token of the second vocabulary.  Among Latin texts those of ASCII letters alone, more or less, are apart:
# prose has 1.8 and more, random letters, hexadecimal and base64 at most 1.5.  With other letters it goes down to Fon (0.91) and Yoruba (1.04);
# other scripts' bytes read as Latin have at most 0.75.
RANK_BANDS = {
    "ascii": (1.6, 8.0), "latin": (0.8, 8.0), "greek": (0.75, 8.0), "cyrillic": (0.9, 8.0), "hebrew": (0.62, 8.0), "arabic": (0.7, 8.0),
    "devanagari": (0.3, 8.0), "bengali": (0.3, 8.0), "tamil": (0.6, 8.0), "telugu": (0.3, 8.0), "kannada": (0.3, 8.0), "indic": (0.25, 8.0),
    "thai": (0.8, 8.0), "hangul": (0.65, 4.0), "kana": (0.8, 4.0), "han": (0.6, 4.0), "other": (0.2, 4.0), "signs": (np.inf, np.inf),
}
# Most characters beyond ASCII, as a part of the ASCII letters, of texts in the band "ascii".
MOST_BEYOND = 0.05
# Most tokens of SYMBOLS alone (dense Markdown has 0.11, words with signs stuck to them or between bars 0.13 and more), and least part of
# letters in words (prose full of figures has 0.65, hexadecimal 0.37).
MOST_SIGNS = 0.12
LEAST_LETTERS = 0.4

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, "
    "n_tokens long, chars_per_token double, byte_share double, entropy_part double, n_rank_tokens long, chars_per_rank_token double, "
    "sign_share double, letter_share double, kept boolean"
)


@lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    """Script of every code point; ``len(SCRIPTS)`` for what is no letter or belongs to none."""
    table = np.zeros(0x110000, np.uint8)
    for start, script in RANGES:
        table[start:] = len(SCRIPTS) if script is None else SCRIPTS.index(script)
    table[[unicodedata.category(chr(point))[0] not in "LM" for point in range(0x110000)]] = len(SCRIPTS)
    return table


class WordPieces:
    """Packed ids of words by a sentencepiece model, kept for words met before."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=content)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        pieces = [self.model.id_to_piece(i).lstrip("\u2581").encode() for i in range(self.size)]
        self.is_sign = np.array([bool(p) and not p.translate(None, SYMBOLS) for p in pieces])
        self.dtype = np.dtype("<u2" if self.size <= 65536 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.passing: list[bytes] = []

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        for raw in self.passing:
            self.known.pop(raw, None)
        missing = [w for w in words if w not in self.known]
        if len(self.known) + len(missing) > CACHE_ENTRIES:
            self.known, missing = {}, list(words)
        self.passing = [w for w in missing if len(w) > CACHED_BYTES]
        ids = self.model.encode([w.decode() for w in missing], num_threads=1) if missing else []
        self.known.update((w, np.asarray(x, self.dtype).tobytes()) for w, x in zip(missing, ids))
        return self.known


class WordCounts:
    """Numbers of tokens of words by a rank file, kept for words met before.

    White space beyond ASCII parts a word further, as the library gives up on runs of a million; a space is put before each part.
    """

    def __init__(self, content: bytes):
        from tiktoken import Encoding

        self.encoding = Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_ranks(content), special_tokens={})
        self.known: dict[bytes, int] = {}

    def of(self, words: Iterable[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        counts = []
        for raw in words:
            if (count := self.known.get(raw)) is None:
                count = sum(len(self.encoding.encode_ordinary(" " + part)) for part in raw.decode().split())
                if len(raw) <= CACHED_BYTES:
                    self.known[raw] = count
            counts.append(count)
        return np.array(counts, np.int64)


@lru_cache(maxsize=2)
def _pieces(content: bytes) -> WordPieces:
    return WordPieces(content)


@lru_cache(maxsize=2)
def _counts(content: bytes) -> WordCounts:
    return WordCounts(content)


def repeated_words(numbers: np.ndarray) -> int:
    """Words inside windows of three that occur twice or more, all occurrences counted."""
    n = len(numbers) - 2
    if n < 2:
        return 0
    size = int(numbers.max()) + 1
    if size < 1 << 21:
        windows = (numbers[:-2] * size + numbers[1:-1]) * size + numbers[2:]
    else:
        _, pairs = np.unique(numbers[:-1] * size + numbers[1:], return_inverse=True)
        windows = pairs[:-1] * size + numbers[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(windows, twice)
    covered = np.zeros(len(numbers), bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def _measure(texts: list[str], pieces: WordPieces, counts: WordCounts) -> tuple[list[list], list[str]]:
    """Columns of COLUMNS but for the verdict, for a slice of texts; and the keys of their bands of the second vocabulary."""
    raws = [t.encode() for t in texts]
    split = [raw.split() for raw in raws]
    numbering = Numbering()
    numbers = [numbering.of(words) for words in split]
    known = pieces.learn(set(numbering))
    n_words = np.array([len(words) for words in split], np.int64)
    spaces = np.array([len(raw) - len(raw.translate(None, WHITE)) for raw in raws], np.int64)
    word_chars = np.array([len(t) for t in texts], np.int64) - spaces
    n_symbols = [len(raw) - len(raw.translate(None, SYMBOLS)) for raw in raws]
    n_dup_lines = []
    for raw in raws:
        lines = [line for line in raw.split(b"\n") if line.strip()]
        n_dup_lines.append(len(lines) - len(set(lines)))
    n_repeat = np.array([repeated_words(x) for x in numbers], np.int64)

    packed = [b"".join(map(known.__getitem__, words)) for words in split]
    n_tokens = np.array([len(p) for p in packed], np.int64) // pieces.dtype.itemsize
    ids = np.frombuffer(b"".join(packed), pieces.dtype).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), n_tokens)
    n_bytes = np.bincount(rows, pieces.is_byte[ids], len(texts))
    keys, met = np.unique(rows * pieces.size + ids, return_counts=True)
    owner, token = np.divmod(keys, pieces.size)
    n_signs = np.bincount(owner, met * pieces.is_sign[token], len(texts))
    part = met / np.maximum(n_tokens, 1)[owner]
    entropy = np.bincount(owner, -part * np.log2(part), len(texts))
    most = np.log2(np.maximum(np.minimum(n_tokens, pieces.size), 2))

    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    where = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    classes = len(SCRIPTS) + 1
    by_script = np.bincount(where * classes + _script_table()[points], minlength=len(texts) * classes).reshape(len(texts), -1)
    n_letters = by_script[:, :-1].sum(axis=1)
    n_ascii = np.array([len(raw) - len(raw.translate(None, ASCII_LETTERS)) for raw in raws])
    n_beyond = np.bincount(where[points >= 0x80], minlength=len(texts))
    tokens = np.maximum(n_tokens, 1)
    signs = n_signs / tokens
    script = ["signs" if sign > MOST_SIGNS else SCRIPTS[i] for i, sign in zip(by_script[:, :-1].argmax(axis=1).tolist(), signs.tolist())]
    plain = (n_beyond <= MOST_BEYOND * n_ascii).tolist()
    rank_keys = ["ascii" if name == "latin" and few else name for name, few in zip(script, plain)]
    by_word = counts.of(numbering)
    n_ranks = np.array([by_word[x].sum() for x in numbers], np.int64)
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    return [
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed, script, n_tokens, word_chars / tokens, n_bytes / tokens,
        np.minimum(entropy / most, 1.0), n_ranks, word_chars / np.maximum(n_ranks, 1), signs, n_letters / np.maximum(word_chars, 1),
    ], rank_keys


def _kept(
    columns: list[list], rank_keys: list[str], bands: dict[str, tuple[float, float, float, float]], rank_bands: dict[str, tuple[float, float]],
) -> np.ndarray:
    """Verdicts on what ``_measure`` gives."""
    failed, script, fertility, share, entropy, second, letters = (columns[i] for i in (5, 6, 8, 9, 10, 12, 14))
    least, most, byte_share, entropy_part = np.array([bands[name] for name in script]).reshape(-1, 4).T
    fits = (least <= fertility) & (fertility <= most) & (share <= byte_share) & (entropy >= entropy_part)
    least, most = np.array([rank_bands[name] for name in rank_keys]).reshape(-1, 2).T
    return ~failed & fits & (least <= second) & (second <= most) & (letters >= LEAST_LETTERS)


def _measured(
    docs: DataFrame, path: str, bands: dict[str, tuple[float, float, float, float]], ranks: str, rank_bands: dict[str, tuple[float, float]],
) -> DataFrame:
    """The columns of ``docs`` other than ``text``, and COLUMNS."""
    model, second = shipped(docs.sparkSession, path), shipped(docs.sparkSession, ranks)
    bands, rank_bands = BANDS | bands, RANK_BANDS | rank_bands
    carried = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*carried, *T._parse_datatype_string(COLUMNS).fields])
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.int64(), *[pa.float64()] * 3, pa.int64(), *[pa.float64()] * 3, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, counts = _pieces(model.value), _counts(second.value)
        for part in slices(batches):
            columns, rank_keys = _measure(part.column("text").to_pylist(), pieces, counts)
            columns.append(_kept(columns, rank_keys, bands, rank_bands))
            arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in carried), *arrays], names=schema.names)

    return docs.mapInArrow(run, schema)


def quality(
    docs: DataFrame, path: str, bands: dict[str, tuple[float, float, float, float]] = BANDS,
    ranks: str = RANKS, rank_bands: dict[str, tuple[float, float]] = RANK_BANDS,
) -> DataFrame:
    """Counts, fertility by two tokenizers and verdict of every document: the sentencepiece model ``path`` and the rank file ``ranks``.

    One row per document: ``doc_id`` and COLUMNS.  ``script`` is the one most letters belong to,
    ``other`` for those without a name in RANGES and for texts without letters, ``signs`` where more than
    MOST_SIGNS of the first tokenizer's tokens are SYMBOLS alone.  Bands given replace those of their scripts.  A
    null or empty text, or one without words, has zero counts and fails (fewer than 50 words).
    Repeated rows give repeated results; other columns are not read.
    """
    return _measured(text_only(docs), path, bands, ranks, rank_bands)


def filtered(
    docs: DataFrame, path: str, bands: dict[str, tuple[float, float, float, float]] = BANDS,
    ranks: str = RANKS, rank_bands: dict[str, tuple[float, float]] = RANK_BANDS,
) -> DataFrame:
    """The documents that ``quality`` keeps, with all their columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return _measured(docs.select(F.struct("*").alias("row"), text), path, bands, ranks, rank_bands).where("kept").select("row.*")
