"""Small document tables with the odd cases that every operator must survive, and plain-Python rules to compare with."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use inside.
CLASHES = ["row", "n", "n_words", "kept", "spans", "marks", "items", "key", "node", "block", "digest", "train", "script", "place", "id", "gone"]

PROSE = "the quick brown fox jumps over the lazy dog while seven green birds watch from a tall old tree and count every step it makes"


def prose(words: int, seed: int = 1) -> str:
    draw = random.Random(seed)
    stock = [f"{a}{b}" for a in ("lo", "mir", "tan", "ve", "sul", "Ora", "kép") for b in ("na", "dis", "ter", "um", "é", "ka.")]
    return " ".join(draw.choice(stock) for _ in range(words))


def odd_rows() -> list[tuple]:
    """Null and empty texts and ids, ties, repeated rows, rows that share an id, a very long text and a long word."""
    texts = [
        None, "", "   \n\t", PROSE, PROSE, PROSE + " again", "one", "two words", prose(300), prose(300) + " end", prose(80, 2) + "\n" + prose(80, 2),
        "x" * 5000, "1" * 300 + " " + "a@" * 50, prose(40000, 3), "Ünï çødé 漢字 ١٢٣ 😀 \u0000   é", "mail bob@example.com or +1 (988) 555-2485, 10.0.0.1",
    ]
    rows = [(i, t, "en", "src", None) for i, t in enumerate(texts)]
    return [*rows, (None, prose(300), None, None, 5), (None, None, None, None, None), (3, "other text under a known id", "en", None, 1), rows[8], rows[8]]


def odd_documents(spark):
    """The odd rows with columns whose names clash."""
    return spark.createDataFrame(odd_rows(), SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit("own") for c in CLASHES})


def alnum(text: str | None) -> list[str]:
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def lowered_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()
