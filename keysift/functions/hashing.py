"""Bloom-filter hash positions as column expressions over Spark's md5 / sha1 / sha2."""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word width in bytes by slice width in bits.
NARROW_LIMIT = 1 << 15  # below: 2-byte words
MEDIUM_LIMIT = 1 << 31  # below: 4-byte words, from here on: 8-byte words

# Hash function by the number of hash bits one key needs.
HASH_BY_BITS = [(128, "md5"), (160, "sha1"), (256, "sha256"), (384, "sha384")]
WIDEST_HASH = "sha512"

_SPARK_DIGEST = {
    "md5": F.md5,
    "sha1": F.sha1,
    "sha256": lambda c: F.sha2(c, 256),
    "sha384": lambda c: F.sha2(c, 384),
    "sha512": lambda c: F.sha2(c, 512),
}


def word_width(bits_per_slice: int) -> int:
    return 2 if bits_per_slice < NARROW_LIMIT else 4 if bits_per_slice < MEDIUM_LIMIT else 8


@dataclass(frozen=True)
class HashScheme:
    """Which digest, cut into which words, serves ``num_slices`` slices."""

    num_slices: int
    width: int

    @property
    def algorithm(self) -> str:
        need = 8 * self.num_slices * self.width
        return next((name for limit, name in HASH_BY_BITS if need <= limit), WIDEST_HASH)

    @property
    def words_per_digest(self) -> int:
        return hashlib.new(self.algorithm).digest_size // self.width

    @property
    def salts(self) -> list[bytes]:
        count = math.ceil(self.num_slices / self.words_per_digest)
        return [hashlib.new(self.algorithm, struct.pack("I", i)).digest() for i in range(count)]


def digest_texts(key: Column, scheme: HashScheme) -> list[Column]:
    """The salted digests of ``key`` as hexadecimal text."""
    digest, raw = _SPARK_DIGEST[scheme.algorithm], F.encode(key, "UTF-8")
    return [digest(F.concat(F.lit(bytearray(salt)), raw)) for salt in scheme.salts]


def text_words(texts: list[Column], scheme: HashScheme) -> Column:
    """The first ``num_slices`` little-endian unsigned words of the digests."""
    words = []
    for text in texts:
        for i in range(scheme.words_per_digest):
            first = 2 * scheme.width * i
            pairs = [F.substring(text, first + 2 * b + 1, 2) for b in reversed(range(scheme.width))]
            number = F.conv(F.concat(*pairs), 16, 10)
            words.append(number.cast("decimal(20,0)" if scheme.width == 8 else "bigint"))
    return F.array(*words[: scheme.num_slices])


def with_digests(df: DataFrame, key: str, scheme: HashScheme, name: str, where: Column | None = None) -> tuple[DataFrame, Column]:
    """Add the digests of ``key`` as columns of their own, so they are computed once; returns their words."""
    columns = []
    for i, text in enumerate(digest_texts(F.col(key), scheme)):
        columns.append(f"{name}h{i}")
        df = df.withColumn(columns[-1], text if where is None else F.when(where, text))
    return df, text_words([F.col(c) for c in columns], scheme)
