"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

The index is a set of tables in the shared folder, each a log of what every insertion or deletion added. ``postings`` has a
row for each document and long line key in it (the exact references); ``deleted`` the documents taken out; ``counts`` has
for each key the number of documents that hold it and the largest of them, the newest row of a key being the one in force.
A cuckoo filter a shard holds the keys that too many documents share. A change of the index writes the rows of its own
documents and keys alone; keys that thereby become common or rare are put into or taken out of the filters of their shards,
and other filters stay. The filters answer most lookups ("this line is rare") without touching the counts, and what they
let pass is checked against them, so their errors never show.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

MIN_CHARS = 40
MIN_DOCS = 5
#: Common keys that a shard is laid out for; the number of shards grows with the keys.
SHARD_KEYS = 1 << 16
#: Filters go to the executors in blocks of shards of at most this size together (or one shard), one block after the other.
FILTER_BYTES = 64 << 20
#: After so many changes the logs are written anew as one table each.
LOG = 8
SLOTS = 4
SPACE = b" \t\n\v\f\r"


class CuckooFilter:
    """16-bit fingerprints of 64-bit keys in buckets of four, with vectorised insert, delete and lookup."""

    def __init__(self, keys: int = 0, table: np.ndarray | None = None):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.7))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first bucket, fingerprint; never 0)."""
        keys = keys.astype(np.uint64)
        tag = (keys >> np.uint64(48)).astype(np.uint16)
        return (keys & np.uint64(len(self.table) - 1)).astype(np.int64), np.where(tag == 0, 1, tag).astype(np.uint16)

    def _other(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        mixed = (tag.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(20)
        return bucket ^ (mixed & np.uint64(len(self.table) - 1)).astype(np.int64)

    def __contains__(self, key: int) -> bool:
        return bool(self.lookup(np.array([key], np.uint64))[0])

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        bucket, tag = self._places(keys)
        here = (self.table[bucket] == tag[:, None]).any(axis=1)
        return here | (self.table[self._other(bucket, tag)] == tag[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray, rounds: int = 500) -> bool:
        """False if the filter is too full: then make a larger one from the exact table."""
        bucket, tag = self._places(keys)
        for turn in range(rounds):
            order = np.argsort(bucket, kind="stable")
            bucket, tag = bucket[order], tag[order]
            begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else bucket
            rank = np.arange(len(bucket)) - np.repeat(begin, np.diff(np.append(begin, len(bucket))))
            rows = self.table[bucket]
            free = np.argsort(rows != 0, axis=1, kind="stable")  # the free slots first
            fits = rank < (rows == 0).sum(axis=1)
            self.table[bucket[fits], free[fits, rank[fits]]] = tag[fits]
            bucket, tag = bucket[~fits], tag[~fits]
            if not len(bucket):
                return True
            if turn % 2:  # both buckets are full: one entry of each bucket makes room
                _, one = np.unique(bucket, return_index=True)
                slot = (turn // 2 + bucket[one]) % SLOTS
                out = self.table[bucket[one], slot].copy()
                self.table[bucket[one], slot] = tag[one]
                tag = tag.copy()
                tag[one] = out
            bucket = self._other(bucket, tag)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out one fingerprint for each key that is in."""
        bucket, tag = self._places(keys)
        for _ in range(2):  # the first bucket, then the other one
            missed = []
            while len(bucket):  # one key of each bucket at a time
                one = np.unique(bucket, return_index=True)[1]
                same = self.table[bucket[one]] == tag[one, None]
                hit = same.any(axis=1)
                self.table[bucket[one][hit], same[hit].argmax(axis=1)] = 0
                missed.append(np.stack([bucket[one[~hit]], tag[one[~hit]].astype(np.int64)]))
                rest = np.ones(len(bucket), bool)
                rest[one] = False
                bucket, tag = bucket[rest], tag[rest]
            if not missed:
                return
            bucket, tag = np.concatenate(missed, axis=1)
            tag = tag.astype(np.uint16)
            bucket = self._other(bucket, tag)


def filter_of(keys: np.ndarray) -> CuckooFilter:
    n = len(keys)
    while True:
        made = CuckooFilter(n)
        if made.insert(keys):
            return made
        n *= 2


def line_keys(text: str, min_chars: int) -> list[tuple[int, int] | None]:
    """Of each line the 128-bit key of its normal form; None for a short one."""
    out: list[tuple[int, int] | None] = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(SPACE)
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
            out.append(None)
            continue
        digest = hashlib.blake2b(key.lower(), digest_size=16).digest()
        out.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
    return out


def keys_of(text: Column, min_chars: int) -> Column:
    """The distinct long keys of a text, as array<struct<k1, k2>>."""

    @F.pandas_udf("array<struct<k1:long,k2:long>>")
    def keys(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(
                [[{"k1": a, "k2": b} for a, b in dict.fromkeys(k for k in line_keys(x, min_chars) if k)] for x in part]
            )

    return keys(text)


KEY = ["k1", "k2"]


def postings_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, doc_id, row) for each row of ``docs`` and distinct long key in it. ``row`` tells the texts of rows without
    doc_id apart, and is null elsewhere. A null text is empty."""
    row = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    found = texts(docs).select("doc_id", row.alias("row"), F.inline(keys_of(F.col("text"), min_chars)))
    return found.select(*KEY, "doc_id", "row")


def _counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("refs"), F.max("doc_id").alias("last_doc"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass
class LineIndex:
    """An immutable version of the index; ``insert`` and ``delete`` return the next one, which shares the older tables."""

    postings: list[DataFrame]  # k1, k2, doc_id, row, version
    deleted: list[DataFrame]  # doc_id, version
    counts: list[DataFrame]  # k1, k2, refs, last_doc, version
    filters: DataFrame | None = None  # shard, data
    shards: int = 1
    version: int = 0
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @classmethod
    def build(cls, docs: DataFrame, **params) -> LineIndex:
        made = cls([], [], [], **params)
        postings = stored(postings_of(docs, made.min_chars), "postings")
        made.postings = [postings.withColumn("version", F.lit(0))]
        made.counts = [stored(_counts(postings), "counts").withColumn("version", F.lit(0))]
        return made._filtered()

    def alive(self) -> DataFrame:
        """(k1, k2, doc_id, row) of the documents that are in."""
        every = _union(self.postings)
        if self.deleted:
            last = _union(self.deleted).groupBy(F.col("doc_id").alias("of")).agg(F.max("version").alias("until"))
            every = every.join(last, every.doc_id == last.of, "left").where("until is null or version > until")
        return every.select(*KEY, "doc_id", "row")

    def current(self) -> DataFrame:
        """(k1, k2, refs, last_doc) of every key, some with no documents any more."""
        if len(self.counts) == 1:
            return self.counts[0].drop("version")
        newest = _union(self.counts).groupBy(*KEY).agg(F.max_by(F.struct("refs", "last_doc"), "version").alias("c"))
        return newest.select(*KEY, "c.*")

    def common(self) -> DataFrame:
        """(k1, k2, last_doc) of the keys that at least ``min_docs`` documents hold."""
        return self.current().where(F.col("refs") >= self.min_docs).select(*KEY, "last_doc")

    def _shard(self) -> Column:
        return F.pmod("k2", F.lit(self.shards))

    def _built(self, keys: DataFrame) -> DataFrame:
        """(shard, data) from the common keys of each shard."""

        def build(part: pd.DataFrame) -> pd.DataFrame:
            data = filter_of(part["k1"].to_numpy().view(np.uint64)).dumps()
            return pd.DataFrame({"shard": [part["shard"].iloc[0]], "data": [data]})

        return keys.select(self._shard().alias("shard"), "k1").groupBy("shard").applyInPandas(build, "shard long, data binary")

    def _filtered(self) -> LineIndex:
        """With all filters made from the counts, in as many shards as the common keys ask for."""
        shards = max(1, -(-self.common().count() // SHARD_KEYS))
        out = replace(self, shards=shards)
        return replace(out, filters=stored(out._built(out.common()), "filters"))

    def _changed(self, after: LineIndex, new: DataFrame) -> LineIndex:
        """``after`` with the new counts (k1, k2, refs, last_doc) of the keys that change, and filters that follow them."""
        old = self.current().join(new.select(*KEY), KEY, "left_semi").select(*KEY, F.col("refs").alias("before"))
        after.counts = [*self.counts, new.withColumn("version", F.lit(after.version))]
        was, now = F.coalesce("before", F.lit(0)) >= self.min_docs, F.col("refs") >= self.min_docs
        moved = new.join(old, KEY, "left").where(was != now).select(self._shard().alias("shard"), "k1", now.alias("add"))
        moved = stored(moved, "moved")
        if after.common().count() > 2 * self.shards * SHARD_KEYS:
            return after._filtered()

        def change(filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter.loads(filters["data"].iloc[0]) if len(filters) else CuckooFilter(len(keys))
            k1 = keys["k1"].to_numpy().view(np.uint64)
            made.delete(k1[~keys["add"].to_numpy()])
            full = not made.insert(k1[keys["add"].to_numpy()])
            return pd.DataFrame({"shard": [keys["shard"].iloc[0]], "data": [None if full else made.dumps()]})

        touched = moved.select("shard").distinct()
        mine = self.filters.join(touched, "shard", "left_semi")
        changed = stored(
            mine.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(change, "shard long, data binary"), "changed"
        )
        full = changed.where("data is null").select("shard")  # these are made anew, larger
        anew = after._built(after.common().withColumn("shard", self._shard()).join(full, "shard", "left_semi"))
        kept = self.filters.join(touched, "shard", "left_anti").unionByName(changed.where("data is not null"))
        after.filters = stored(kept.unionByName(anew), "filters")
        return after if len(after.counts) <= LOG else after.compacted()

    def compacted(self) -> LineIndex:
        """The same index with logs of one table each."""
        postings = stored(self.alive(), "postings").withColumn("version", F.lit(self.version))
        counts = stored(self.current().where("refs > 0 or last_doc is not null"), "counts")
        return replace(self, postings=[postings], deleted=[], counts=[counts.withColumn("version", F.lit(self.version))])

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the rows of ``docs`` added. Lines that a document already has in the index count once."""
        batch = stored(postings_of(docs, self.min_chars), "batch")
        known = self.alive().join(batch.select(*KEY, "doc_id").distinct(), [*KEY, "doc_id"], "left_semi").select(*KEY, "doc_id")
        fresh = stored(batch.join(known.distinct(), [*KEY, "doc_id"], "left_anti").select(*KEY, "doc_id", "row"), "inserted")
        added = _counts(fresh)
        old = self.current().join(added.select(*KEY), KEY, "left_semi")
        both = old.unionByName(added).groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.max("last_doc").alias("last_doc"))
        version = self.version + 1
        after = replace(self, version=version, postings=[*self.postings, fresh.withColumn("version", F.lit(version))])
        return self._changed(after, stored(both, "counts"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of ``doc_ids`` (a column doc_id); ids that are not in change nothing, nor do nulls."""
        ids = stored(doc_ids.select("doc_id").where("doc_id is not null").distinct(), "deleted")
        touched = stored(self.alive().join(ids, "doc_id", "left_semi").select(*KEY).distinct(), "touched")
        version = self.version + 1
        after = replace(self, version=version, deleted=[*self.deleted, ids.withColumn("version", F.lit(version))])
        left = _counts(after.alive().join(touched, KEY, "left_semi"))
        new = touched.join(left, KEY, "left").select(*KEY, F.coalesce("refs", F.lit(0)).alias("refs"), "last_doc")
        return self._changed(after, stored(new, "counts"))

    def candidates(self) -> DataFrame:
        """The postings that the filters do not rule out. ``alive`` is read once for each block of filters."""
        sizes = self.filters.select("shard", F.length("data").alias("n")).orderBy("shard").toLocalIterator()
        blocks: list[list[int]] = [[]]
        size = 0
        for r in sizes:
            if blocks[-1] and size + r.n > FILTER_BYTES:
                blocks.append([])
                size = 0
            blocks[-1].append(r.shard)
            size += r.n
        if len(blocks) == 1:
            return self._passed(blocks[0])
        return _union([stored(self._passed(b), "candidates") for b in blocks])

    def _passed(self, block: list[int]) -> DataFrame:
        low, high = (min(block), max(block)) if block else (0, -1)
        rows = self.filters.where(F.col("shard").between(low, high)).collect()
        alive, shards = self.alive(), self.shards
        sent = alive.sparkSession.sparkContext.broadcast({r.shard: bytes(r.data) for r in rows})

        @F.pandas_udf("boolean")
        def maybe(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            ready = {k: CuckooFilter.loads(v) for k, v in sent.value.items()}
            for k1, k2 in parts:
                shard = k2.to_numpy() % shards
                out = np.zeros(len(k1), bool)
                for s in np.unique(shard):
                    if s in ready:
                        at = shard == s
                        out[at] = ready[s].lookup(k1.to_numpy()[at].view(np.uint64))
                yield pd.Series(out)

        return alive.where(maybe(*KEY))

    def surplus(self) -> DataFrame:
        """(doc_id, row, drop): of each document the keys it loses, as a set of structs."""
        common = stored(self.common(), "common")  # a table of its own, so that Spark can split the join's hot keys
        held = self.candidates().join(common, KEY).where("doc_id is null or doc_id <> last_doc")
        return held.groupBy("doc_id", "row").agg(F.collect_set(F.struct(*KEY)).alias("drop"))


def _without(min_chars: int):
    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, drop in parts:
            rows = []
            for x, gone in zip(text, drop, strict=True):
                x = x or ""
                if gone is None or not len(gone):
                    rows.append((x, x.count("\n") + 1, 0))
                    continue
                out = {(g["k1"], g["k2"]) for g in gone}
                lines = x.split("\n")
                kept = [a for a, k in zip(lines, line_keys(x, min_chars), strict=True) if k not in out]
                rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
            yield pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    return cut


def dedup_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """The rows of ``docs`` with ``text`` less its surplus lines, and n_lines (before) and n_dropped.

    A line whose key (ends stripped of ASCII white space, A-Z in lower case) has at least ``min_chars`` code points and is
    in at least ``min_docs`` documents stays only in the largest doc_id that holds it. A null or empty text is one empty
    line; a text of any length is worked through whole. Rows with equal doc_id are one document and share a verdict; rows
    without doc_id are not counted and never the largest, so they lose every line that others share. Other columns pass
    through; n_lines and n_dropped replace columns of these names. An empty table gives an empty table.
    """
    index = index or LineIndex.build(docs)
    lost = index.surplus().select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("drop").alias("__drop"))
    row = F.when(docs.doc_id.isNull(), F.xxhash64(F.coalesce(docs.text, F.lit(""))))
    joined = docs.join(lost, docs.doc_id.eqNullSafe(F.col("__id")) & row.eqNullSafe(F.col("__row")), "left")
    cut = joined.withColumn("__cut", _without(index.min_chars)("text", "__drop"))
    return cut.withColumns(
        {"text": F.col("__cut.text"), "n_lines": F.col("__cut.n_lines"), "n_dropped": F.col("__cut.n_dropped")}
    ).drop("__id", "__row", "__drop", "__cut")
