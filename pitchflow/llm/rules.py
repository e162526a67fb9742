"""Quality rules with cross-document line frequency.

Each text is measured on its own (the base rules). Its lines are hashed in normal form, the documents of the same host
that hold a line are counted, lines that stand in several of the host's documents are removed as boilerplate, and documents
that have too little left are rejected. The number is absolute, so a verdict does not depend on the size of the host.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_function, stored, texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # percent
#: A line is boilerplate if at least LINE_DOCS documents of its host hold it.
LINE_DOCS = 5
#: A document is depleted if fewer than MIN_WORDS words or LEFT_PERCENT percent of its words are left.
LEFT_PERCENT = 30


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows found at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = (mixed ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, back, times = np.unique(mixed, return_inverse=True, return_counts=True)
    steps = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(times[back] > 1)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def measure(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and of each distinct line with a word: hash, words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    seen: set[bytes] = set()
    dup = 0
    lines: dict[int, int] = {}
    for line in data.split(b"\n"):
        tokens = line.split()
        if not tokens:
            continue
        dup += line in seen
        seen.add(line)
        digest = hashlib.blake2b(b" ".join(tokens).lower(), digest_size=8).digest()
        key = int.from_bytes(digest, "little", signed=True)
        lines[key] = lines.get(key, 0) + len(tokens)
    symbols = sum(text.count(c) for c in SYMBOLS)
    return len(words), chars, symbols, dup, repeated_words(words), list(lines), list(lines.values())


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@column_function(", ".join(f"{c} long" for c in COLUMNS) + ", keys array<long>, sizes array<long>")
def _measured(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame([measure(x) for x in part], columns=[*COLUMNS, "keys", "sizes"])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept of each row.

    The host is the column source. A line is counted by the distinct doc_ids of the host that hold it; rows without doc_id
    are not counted, but lose their lines like any other. Empty and null texts have no words and fail the base rules; a
    text of any length is worked through whole. Rows without source are one host. Equal rows get equal rows. Extra columns
    are ignored; an empty table gives an empty table.
    """
    base = stored(
        texts(docs, "source")
        .select("doc_id", "source", _measured("text").alias("m"))
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "m.*"),
        "measured",
    )
    lines = base.select("row", "doc_id", "source", F.inline(F.arrays_zip("keys", "sizes"))).toDF(
        "row", "doc_id", "source", "line", "words"
    )
    counts = lines.groupBy(F.col("source").alias("of"), F.col("line").alias("key")).agg(F.count_distinct("doc_id").alias("docs"))
    # a table of its own, so that Spark can split the join at a hot line
    common = stored(counts.where(F.col("docs") >= LINE_DOCS).select("of", "key"), "common-lines")
    removed = (
        lines.join(common, (F.col("line") == F.col("key")) & F.col("source").eqNullSafe(F.col("of")))
        .groupBy(F.col("row").alias("at"))
        .agg(F.sum("words").alias("gone"))
    )
    left = F.col("n_words") - F.col("n_removed_words")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return (
        base.join(removed, base.row == removed.at, "left")
        .withColumn("n_removed_words", F.coalesce("gone", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn(
            "kept", ~failed & (left >= MIN_WORDS) & (left * 100 >= F.col("n_words") * LEFT_PERCENT)
        )
        .select("doc_id", *COLUMNS, "base_failed", "n_removed_words", "kept")
    )
