"""SimHash near-duplicates, found with a Gray-order hierarchical index.

The top nodes of the index are masked bit patterns: the 64 bits are cut into ``bits + m`` blocks, and every choice of m of
them is a table whose nodes share the bits of these blocks. Two fingerprints that differ in at most ``bits`` bits agree on
at least m blocks, so no link is lost. As many bits are taken as the number of fingerprints asks for, so that such a node
holds about ``NODE`` of them. Below it the fingerprints are sorted by Gray rank; every ``FAN`` neighbours form a node with
the bits that all of them share, and nodes form higher nodes in the same way. A pair of nodes is dropped, with all below
it, once their shared bits differ in too many places, or once all below them is linked already. A top node emits the
lightest links that hold its classes together, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_function, stored, texts
from .components import components

WORDS, BITS = 3, 2
#: The pipeline's stage: five-word shingles, several fingerprints at a wider radius, links verified on the shingles.
NEAR = {"words": 5, "bits": 7, "prints": 4, "similarity": 0.8}
FAN = 8
NODE = 1024
#: A top node of more fingerprints is cut into finer ones, which share more blocks.
HOT = 1 << 17
PART = 1 << 16
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Of each byte value its bits, one in each byte of a word.
LANES = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), PART):
        part = hashes[k : k + PART]
        sums = np.add.reduceat(LANES[part.view(np.uint8)].reshape(-1, 8), np.arange(0, len(part), 255), axis=0)
        ones += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingles(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, repeats included; of the whole sequence if it is shorter."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    joined = b" ".join(tokens)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)] if n else [], np.uint64)
    lengths = np.fromiter(map(len, tokens), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: n - words + 1].tolist(), ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)), np.uint64, len(first))


def fingerprint(text: str, words: int = WORDS, prints: int = 1) -> list[int]:
    """SimHashes of a text: the first from the shingles' own hashes, the others from hashes of these; 0 without words."""
    hashes = shingles(text, words)
    if not len(hashes):
        return [0] * prints
    out = [majority(hashes)]
    for _ in range(1, prints):
        hashes = (hashes ^ (hashes >> np.uint64(31))) * ODD
        hashes ^= hashes >> np.uint64(29)
        out.append(majority(hashes))
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, prints: int = 1) -> DataFrame:
    """doc_id, fps (the fingerprints as signed longs) and the text's hash of every row."""

    @F.pandas_udf("array<long>")
    def print_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            every = np.array([fingerprint(x, words, prints) for x in part], np.uint64).reshape(-1, prints)
            yield pd.Series(list(every.view(np.int64)))

    return texts(docs).select("doc_id", print_of("text").alias("fps"), F.xxhash64("text").alias("text_hash"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def masks(n: int, bits: int, finer: int = 0) -> list[int]:
    """The masks of the top nodes for n codes: the bits of each choice of m of bits + m blocks, with m as small as gives
    nodes of about NODE codes. ``finer``: so many blocks more, and all their bits."""
    m = next(m for m in range(1, 65) if n <= NODE << (64 * m // (bits + m)) or bits + m == 64) + finer
    starts = np.linspace(0, 64, bits + m + 1).astype(int)
    need = 64 if finer else ceil(max(0.0, log2(max(1, n) / NODE)) / m)
    blocks = [((1 << min(need, int(b - a))) - 1) << int(a) for a, b in zip(starts, starts[1:], strict=False)]
    return [sum(x) for x in combinations(blocks, m)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position in each position's class."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def forest(root: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the lightest links that join the classes of ``root`` which the links connect, the new roots)."""
    picked = [np.zeros(0, np.int64)]
    at = np.flatnonzero(root[a] != root[b])
    while len(at):
        names, ends = np.unique(np.concatenate([root[a[at]], root[b[at]]]), return_inverse=True)
        x, y = ends[: len(at)], ends[len(at) :]
        order = np.lexsort((at, weight[at]))
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at))
        best = np.full(len(names), len(at))
        np.minimum.at(best, x, rank)
        np.minimum.at(best, y, rank)
        chosen = order[np.unique(best)]
        picked.append(at[chosen])
        move = np.arange(len(root))
        move[names] = names[_roots(len(names), x[chosen], y[chosen])]
        root = move[root]
        at = at[root[a[at]] != root[b[at]]]
    return np.concatenate(picked), root


class GrayTree:
    """Codes in Gray order under nodes of FAN children each; a node keeps the bits that all codes below it share."""

    def __init__(self, codes: np.ndarray):
        """``codes`` are sorted by Gray rank."""
        self.levels = [(np.full(len(codes), ~np.uint64(0)), codes)]
        while len(self.levels[-1][0]) > 1:
            mask, value = self.levels[-1]
            at = np.arange(0, len(mask), FAN)
            first = np.repeat(value[at], FAN)[: len(value)]
            shared = np.bitwise_and.reduceat(mask & ~(value ^ first), at)
            self.levels.append((shared, value[at] & shared))
        self.visited = self.compared = 0

    def _spread(self, root: np.ndarray) -> list[np.ndarray]:
        """Of each node of each level the root of all its codes; -1 if they have several."""
        out = [root]
        for mask, _ in self.levels[1:]:
            below = out[-1]
            at = np.arange(0, len(below), FAN)
            low, high = np.minimum.reduceat(below, at), np.maximum.reduceat(below, at)
            out.append(np.where(low == high, low, -1)[: len(mask)])
        return out

    def links(self, bits: int, weigh=None) -> tuple[np.ndarray, np.ndarray]:
        """Positions (a, b) of links between codes at most ``bits`` apart that span the same classes as all such links.

        ``weigh(a, b)`` gives the links' weights; one of -1 is no link. Children of a node are compared before its
        siblings, so that what is linked already is skipped as a whole.
        """
        n = len(self.levels[0][1])
        root = np.arange(n)
        out = [np.zeros((2, 0), np.int64)]
        i, j = np.triu_indices(FAN, 1)
        for level in range(len(self.levels) - 1):
            one = self._spread(root)
            base = np.arange(0, len(self.levels[level][0]), FAN)[:, None]
            a, b = (base + i).ravel(), (base + j).ravel()
            keep = b < len(self.levels[level][0])
            work = [(level, a[keep], b[keep])]
            while work:
                at, a, b = work.pop()
                if len(a) > PART:
                    work += [(at, a[k : k + PART], b[k : k + PART]) for k in range(0, len(a), PART)]
                    continue
                mask, value = self.levels[at]
                self.visited += len(a) if at else 0
                self.compared += 0 if at else len(a)
                apart = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b])
                near = (apart <= bits) & ((one[at][a] != one[at][b]) | (one[at][a] < 0))
                a, b = a[near], b[near]
                if at:
                    size = len(self.levels[at - 1][0])
                    x = (a[:, None, None] * FAN + np.arange(FAN)[None, :, None]).repeat(FAN, 2).ravel()
                    y = (b[:, None, None] * FAN + np.arange(FAN)[None, None, :]).repeat(FAN, 1).ravel()
                    keep = (x < size) & (y < size)
                    work.append((at - 1, x[keep], y[keep]))
                elif len(a):
                    weight = apart[near].astype(np.int64) if weigh is None else weigh(a, b)
                    keep = weight >= 0
                    a, b, weight = a[keep], b[keep], weight[keep]
                    picked, root = forest(root, a, b, weight)
                    if len(picked):
                        out.append(np.stack([a[picked], b[picked]]))
                        one = self._spread(root)
        a, b = np.concatenate(out, axis=1)
        return a, b


KEYS = ["t", "key", "t2", "key2"]
FOUND = pa.schema([(c, pa.int64()) for c in ("a", "a_text", "b", "b_text")])


def _search(bits: int, prints: int, most: int):
    """Links of each run of rows with equal keys. ``most``: over all fingerprints a link's bits differ in at most so many."""

    def run_links(keys: np.ndarray, rows: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        begin = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        for s, e in zip(begin, np.append(begin[1:], keys.shape[1]), strict=True):
            if e - s < 2:
                continue
            code = rows[0, s:e].view(np.uint64)
            order = np.argsort(gray_rank(code), kind="stable")
            mine = fps[s:e][order]

            def weigh(a: np.ndarray, b: np.ndarray, mine: np.ndarray = mine) -> np.ndarray:
                far = np.bitwise_count(mine[a] ^ mine[b]).sum(axis=1, dtype=np.int64)
                return np.where(far <= most, far, -1)

            a, b = GrayTree(code[order]).links(bits, weigh if prints > 1 else None)
            left.append(order[a] + s)
            right.append(order[b] + s)
        a, b = np.concatenate(left), np.concatenate(right)
        ends = [rows[1, a], rows[2, a], rows[1, b], rows[2, b]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, rows = (
                np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in names])
                for names in (KEYS, ("code", "rep", "text_hash"))
            )
            fps = batch.column("fps").flatten().to_numpy().view(np.uint64).reshape(-1, prints)
            if held and (keys == held[-1][0][:, -1:]).all():
                held.append((keys, rows, fps))  # the open run goes on
                continue
            held.append((keys, rows, fps))
            keys, rows, fps = (np.concatenate(x, axis=-1 if k < 2 else 0) for k, x in enumerate(zip(*held, strict=True)))
            cut = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))[-1]
            if cut:
                yield run_links(keys[:, :cut], rows[:, :cut], fps[:cut])
            held = [(keys[:, cut:], rows[:, cut:], fps[cut:])]
        if held:
            yield run_links(*(np.concatenate(x, axis=-1 if k < 2 else 0) for k, x in enumerate(zip(*held, strict=True))))

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(rows: DataFrame, chosen: list[int], prints: int) -> DataFrame:
    """``rows`` once for each fingerprint and mask: the number of the two (t), the masked bits (key), the fingerprint (code)."""
    keys = [
        F.struct(
            F.lit(p * len(chosen) + k).alias("t"),
            F.col("fps")[p].bitwiseAND(F.lit(_signed(m))).alias("key"),
            F.col("fps")[p].alias("code"),
        )
        for p in range(prints)
        for k, m in enumerate(chosen)
    ]
    return rows.select("*", F.inline(F.array(*keys)))


def links(nodes: DataFrame, bits: int = BITS, prints: int = 1, similarity: float | None = None) -> DataFrame:
    """(a, a_text, b, b_text): links between rows of (fps, rep, text_hash), rows distinct, that span the same classes as all
    links of at most ``bits`` bits in some fingerprint do. With ``similarity`` (a Jaccard similarity of shingle sets),
    links whose fingerprints as a whole are too far apart for it (by over three standard deviations) are left out."""
    most = 64 * prints
    if similarity is not None:
        rate = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
        most = ceil(64 * prints * rate + 3 * (64 * prints * rate * (1 - rate)) ** 0.5)
    some = nodes.where("rep is not null").select("fps", "rep", "text_hash")
    n = some.count()
    dealt = _dealt(some, masks(n, bits), prints)
    hot = stored(dealt.groupBy("t", "key").count().where(F.col("count") > HOT).select("t", "key"), "hot-nodes")
    columns = ["t", "key", F.lit(0).alias("t2"), F.lit(0).cast("long").alias("key2"), "code", "rep", "text_hash", "fps"]
    if not hot.limit(1).count():
        dealt = dealt.select(*columns)
    else:  # cut the crowded nodes finer
        cold = dealt.join(hot, ["t", "key"], "left_anti").select(*columns)
        finer = [
            F.struct(F.lit(k).alias("t2"), F.col("code").bitwiseAND(F.lit(_signed(m))).alias("key2"))
            for k, m in enumerate(masks(n, bits, 3), 1)
        ]
        split = dealt.join(hot, ["t", "key"], "left_semi").select("*", F.inline(F.array(*finer)))
        dealt = cold.unionByName(split.select(*cold.columns))
    found = dealt.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(
        _search(bits, prints, most), "a long, a_text long, b long, b_text long"
    )
    return stored(found.distinct(), "links")


@column_function("array<long>")
def _set_of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, words in parts:
        yield pd.Series([np.unique(shingles(x, w)).view(np.int64) for x, w in zip(text, words, strict=True)])


def verified(found: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links whose texts have at least that Jaccard similarity of their sets of shingles (two empty sets have 1)."""
    ends = found.select(F.col("a").alias("id"), F.col("a_text").alias("th")).unionByName(
        found.select(F.col("b").alias("id"), F.col("b_text").alias("th"))
    ).distinct()
    whole = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    mine = (whole.doc_id == ends.id) & (whole.text_hash == ends.th)
    sets = stored(
        whole.join(ends, mine, "left_semi").dropDuplicates(["doc_id", "text_hash"])
        .select("doc_id", "text_hash", _set_of("text", F.lit(words)).alias("set")),
        "shingle-sets",
    )
    joined = found
    for end in "ab":
        joined = joined.join(sets.toDF(end, f"{end}_text", f"{end}_set"), [end, f"{end}_text"])
    shared = F.size(F.array_intersect("a_set", "b_set"))
    enough = shared * (1 + similarity) >= similarity * (F.size("a_set") + F.size("b_set")) - 1e-9
    return joined.where(enough).select("a", "b")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, bits: int = BITS, prints: int = 1, similarity: float | None = None
) -> DataFrame:
    """doc_id, fps (the text's fingerprints), component_id (the smallest doc_id reachable by links) of every row.

    Texts are linked if a fingerprint of theirs differs in at most ``bits`` bits; with ``similarity`` only if the Jaccard
    similarity of their sets of shingles is at least that. Null and empty texts have fingerprint 0 and link like any other;
    a text of any length is worked through whole. Rows with equal doc_id are one document: each gets a row, and their
    texts are linked. A null doc_id gets the class of its text (without ``similarity``: its fingerprint), null if no row
    with an id has it. Extra columns are ignored; an empty table gives an empty table.
    """
    every = fingerprints(docs, words, prints)
    if similarity is None:
        every = every.withColumn("text_hash", F.lit(0).cast("long"))
    every = stored(every, "fingerprints")
    nodes = stored(every.groupBy("fps", "text_hash").agg(F.min("doc_id").alias("rep")), "nodes")
    found = links(nodes, bits, prints, similarity)
    tied = components(found if similarity is None else verified(found, docs, words, similarity))
    named = nodes.join(tied, nodes.rep == tied.node, "left").select(
        F.col("fps").alias("of"), F.col("text_hash").alias("of_text"), F.coalesce("root", "rep").alias("component_id")
    )
    named = stored(named, "named")  # a table of its own, so that Spark can split the join's hot fingerprints
    mine = (every.fps == named.of) & (every.text_hash == named.of_text)
    return every.join(named, mine).select("doc_id", "fps", "component_id")


def keep_first(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that have the smallest doc_id of their class, all of them if it is repeated, and those without
    doc_id. ``params`` as of ``near_duplicates``, by default ``NEAR``."""
    every = near_duplicates(docs, **(params or NEAR))
    gone = every.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs.doc_id == F.col("__gone"), "left_anti")
