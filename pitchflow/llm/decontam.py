"""Benchmark decontamination: size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with it, so a sketch of the document misses it. Here items
are partitioned by their number of shingles, and an item's sketch is its ``k`` shingles of least MinHash value, with ``k``
set for its partition: one more than the shingles that an item of the partition may lack at the containment asked for. A
document that contains enough of an item therefore holds at least one shingle of its sketch; none is missed. A document
streams once past the sketches, and what is found is verified by exact containment of the item's shingles, word by word.

A benchmark of at most ``BLOCK`` shingles goes to the executors as a whole. A larger one stays a table: documents stream
past a bitmap of its sketches, of fixed size, and what passes is joined to the sketches and to the items.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_function, stored, texts

WORDS = 5
CONTAINMENT = Fraction(4, 5)
#: Benchmarks of at most this many shingles and characters (of items with words) are broadcast.
BLOCK, BLOCK_CHARS = 1 << 20, 1 << 26
WORD = re.compile(r"\w+")
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a shingle that number its place in the bitmap.
BITMAP = 24


class _Words(dict):
    """Word to 64-bit hash; emptied when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 1)
        return out


def word_hashes(text: str, seen: dict) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, WORD.findall(text.lower())), np.uint64)


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the runs of ``width`` words; none if there are fewer."""
    if len(hashes) < width or not width:
        return hashes[:0]
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + len(out)]) * ODD
        out ^= out >> np.uint64(29)
    return out


def shingles(text: str, seen: dict | None = None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the runs of ``words`` lower-cased words; of the whole text if it has fewer; none if it has none."""
    hashes = word_hashes(text, _Words() if seen is None else seen)
    return grams(hashes, min(words, len(hashes)))


def partition_of(n: int) -> int:
    """Items with 2**p to 2**(p+1) - 1 shingles are partition p."""
    return n.bit_length() - 1


def sketch(item: np.ndarray, containment: Fraction = CONTAINMENT) -> np.ndarray:
    """The shingles of least MinHash value that a document must meet in one place at least."""
    largest = (2 << partition_of(len(item))) - 1
    k = int((1 - containment) * largest) + 1
    rank = (item ^ ODD) * np.uint64(0xC2B2AE3D27D4EB4F)
    return item[np.argsort(rank ^ (rank >> np.uint64(32)), kind="stable")[:k]]


def exact(text: str, words: int) -> set[tuple[str, ...]]:
    """The runs of ``words`` words themselves."""
    tokens = WORD.findall(text.lower())
    return {tuple(tokens[k : k + words]) for k in range(len(tokens) - words + 1)}


def shared(item: str, text: str) -> tuple[int, int]:
    """(an item's distinct shingles, those in the text), by the words themselves."""
    words = min(WORDS, len(WORD.findall(item.lower())))
    want = exact(item, words)
    return len(want), len(want & exact(text, words))


class Sketches:
    """The items of a benchmark, ready for lookups."""

    def __init__(self, items: list[tuple[int, str]], containment: Fraction):
        self.containment, seen = containment, _Words()
        self.items = [(name, text, np.unique(shingles(text, seen))) for name, text in items]
        self.widths = sorted({min(WORDS, len(WORD.findall(text.lower()))) for _, text in items} - {0, WORDS})
        self.held: dict[int, list[int]] = defaultdict(list)
        for k, (_, _, item) in enumerate(self.items):
            for x in sketch(item, containment).tolist() if len(item) else []:
                self.held[x].append(k)
        self.values = np.array(sorted(self.held), np.uint64)
        self.bits = np.zeros(1 << BITMAP, bool)
        self.bits[self.values >> np.uint64(64 - BITMAP)] = True

    def search(self, text: str, seen: dict) -> list[tuple[int, int, int]]:
        """(item, its shingles, those in the text) of each item that the text contains."""
        hashes = word_hashes(text, seen)
        found = grams(hashes, WORDS)
        if self.widths:  # shorter items are looked up by runs of their own length
            found = np.concatenate([found, *[grams(hashes, n) for n in self.widths]])
        some = found[self.bits[found >> np.uint64(64 - BITMAP)]]
        some = np.unique(some[np.isin(some, self.values)])
        if not len(some):
            return []
        found, out = np.unique(found), []
        for k in sorted({k for x in some.tolist() for k in self.held[x]}):
            name, words, item = self.items[k]
            if int(np.isin(item, found, assume_unique=True).sum()) >= self.containment * len(item):
                n, both = shared(words, text)
                if both >= self.containment * n:
                    out.append((name, n, both))
        return out


NAMES = ("item_id", "n_shingles", "n_shared")
FOUND = "array<struct<item_id:bigint,n_shingles:bigint,n_shared:bigint>>"


def _sent(docs: DataFrame, items: DataFrame, containment: Fraction) -> DataFrame:
    """The search with all items on every executor."""
    chosen = [(r.item_id, r.text) for r in items.orderBy("item_id", "text").select("item_id", "text").collect()]
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    @F.pandas_udf(FOUND)
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready, seen = Sketches(sent.value, containment), _Words()
        for part in parts:
            yield pd.Series([[dict(zip(NAMES, x, strict=True)) for x in ready.search(t, seen)] for t in part])

    return texts(docs).select("doc_id", F.inline(search("text")))


@column_function("int")
def _width_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([min(WORDS, len(WORD.findall(x.lower()))) for x in part], dtype="int32")


@column_function("n_shingles long, n_shared long")
def _shared(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for item, text in parts:
        yield pd.DataFrame([shared(a, b) for a, b in zip(item, text, strict=True)], columns=["n_shingles", "n_shared"])


def _joined(docs: DataFrame, items: DataFrame, containment: Fraction) -> DataFrame:
    """The search with the items in a table. Every step is a join by hash; a pair of document and item meets only if they
    share a shingle of the item's sketch."""
    spark = docs.sparkSession

    @F.pandas_udf("all array<long>, some array<long>")
    def sketched(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen = _Words()
        for part in parts:
            every = [np.unique(shingles(x, seen)) for x in part]
            yield pd.DataFrame({"all": [x.view(np.int64) for x in every], "some": [sketch(x, containment).view(np.int64) for x in every]})

    made = stored(items.withColumn("item", F.monotonically_increasing_id()).withColumn("s", sketched("text")).select("item", "item_id", "text", "width", "s.*"), "items")
    sketches = stored(made.select("item", F.explode("some").alias("hash")), "sketches")
    place = F.shiftrightunsigned("hash", 64 - BITMAP)
    cells = sketches.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITMAP}) & 63 as int))")).alias("bits"))
    bitmap = np.zeros(1 << BITMAP - 6, np.int64)  # at most as many rows come to the driver
    for r in cells.collect():
        bitmap[r["at"]] = r.bits
    widths = [r.width for r in made.select("width").distinct().collect()]  # 1 to WORDS
    sent = spark.sparkContext.broadcast((bitmap, sorted(widths)))

    def hashes_of(text: str, seen: dict, widths: list[int]) -> np.ndarray:
        hashes = word_hashes(text, seen)
        return np.unique(np.concatenate([grams(hashes, n) for n in widths]))

    @F.pandas_udf("array<long>")
    def passing(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen, (cells, widths) = _Words(), sent.value
        bits = np.unpackbits(cells.view(np.uint8), bitorder="little").view(bool)
        for part in parts:
            every = [hashes_of(x, seen, widths) for x in part]
            yield pd.Series([x[bits[x >> np.uint64(64 - BITMAP)]].view(np.int64) for x in every])

    @F.pandas_udf("array<long>")
    def whole(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen, (_, widths) = _Words(), sent.value
        for part in parts:
            yield pd.Series([hashes_of(x, seen, widths).view(np.int64) for x in part])

    named = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    row = ["doc_id", "text_hash"]
    hits = named.dropDuplicates(row).select(*row, F.explode(passing("text")).alias("hash"))
    pairs = stored(hits.join(sketches, "hash").select(*row, "item").distinct(), "pairs")
    of = pairs.select(*[F.col(c).alias(f"of_{c}") for c in row], "item")
    mine = named.doc_id.eqNullSafe(F.col("of_doc_id")) & (named.text_hash == F.col("of_text_hash"))
    able = stored(named.dropDuplicates(row).join(of, mine, "left_semi"), "able")
    held = able.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), "text_hash", F.explode(whole("text")).alias("hash"))
    wanted = pairs.join(made.select("item", F.explode("all").alias("hash")), "item").withColumn("d", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    counts = wanted.join(held, ["d", "text_hash", "hash"]).groupBy(*row, "item").count()
    enough = F.col("count") * containment.denominator >= containment.numerator * F.size("all")
    likely = counts.join(made.select("item", "item_id", F.col("text").alias("item_text"), "all"), "item").where(enough).select(
        *[F.col(c).alias(f"of_{c}") for c in row], "item_id", "item_text"
    )
    likely = stored(likely, "likely")
    match = able.doc_id.eqNullSafe(F.col("of_doc_id")) & (able.text_hash == F.col("of_text_hash"))
    sure = able.join(likely, match).select(*row, "item_id", _shared("item_text", "text").alias("s")).select(*row, "item_id", "s.*")
    sure = stored(sure.where(F.col("n_shared") * containment.denominator >= containment.numerator * F.col("n_shingles")), "sure")
    found = sure.toDF("of_doc_id", "of_text_hash", *NAMES)
    again = named.drop("text")  # repeated rows each have their pairs
    match = again.doc_id.eqNullSafe(F.col("of_doc_id")) & (again.text_hash == F.col("of_text_hash"))
    return again.join(found, match).select("doc_id", *NAMES)


def contained(docs: DataFrame, benchmark: DataFrame, containment: Fraction = CONTAINMENT, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment for each item with at least that share of its distinct
    five-word shingles in the document.

    Words are runs of letters, digits and underscores in lower case. An item of under five words is one shingle of its
    words and is found wherever they stand together. Empty or null items are in no document; empty or null texts hold no
    item; texts of any length are worked through whole. Repeated rows each give their pairs. Extra columns of either table
    are ignored; empty tables give an empty one. A benchmark of over ``block`` shingles is joined as a table, with the same
    result.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    items = stored(items.withColumn("width", _width_of("text")).where("width > 0"), "benchmark")
    size, n = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    few = size + n <= min(BLOCK_CHARS, 2 * block)  # a shingle takes two characters at least, but for an item's last one
    out = _sent(docs, items, containment) if few else _joined(docs, items, containment)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id holds no item. Rows without doc_id stay only if no such row holds one."""
    gone = stored(contained(docs, benchmark).select(F.col("doc_id").alias("__gone")).distinct(), "leaks")
    return docs.join(gone, docs.doc_id.eqNullSafe(F.col("__gone")), "left_anti")
