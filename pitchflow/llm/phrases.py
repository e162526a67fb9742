"""Phrase collocation mining by best-first branch and bound over growing phrases.

Phrases grow word by word. A level is one pass over the texts, which counts the phrases of that length whose parts can still
matter; tasks count whole chunks of text with sorted integer codes before anything is shuffled. Words come first, then pairs
of frequent words. With the counts of a pair p = (v, w) the score of any longer phrase is bounded: one that begins with p
scores at most f(p) / f(v) millionths, one that ends with p at most f(p) / f(w). So pairs are nodes of a frontier, and a wave
expands the best of them: a triple is counted only if its first pair's bound and its last pair's bound both reach the wave's
level (else it cannot score that much), or if one of its pairs scores that much itself (the triple may then push it out).
All scores from the level up are then known for good. A language is settled when as many phrases as asked for survive at or
above the level; for the others the next wave goes deeper, in the end to the whole frontier.

What a pass may skip it learns from bitmaps of hashed phrases, of bounded size, which are broadcast. A clash of two hashes
lets a phrase be counted that need not be; it changes no count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MIN_COUNT, TOP, LONGEST = 10, 2000, 3
#: A pair is dropped for a triple that covers this share (percent) of its occurrences.
COVERED = 50
#: Bits of a bitmap: at least so many for each phrase in it, up to 2**27 (16 MB, the most that is broadcast of one).
SPARSE, MOST_BITS = 16, 27
#: A task counts so many words at a time, and takes them in parts of a text of so many.
CHUNK, PART = 1 << 20, 1 << 18
#: The first wave goes to the level that so many times TOP pairs reach; each later one so many times deeper.
FIRST, DEEPER = 2, 8
UNIT = 1_000_000
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_SPLIT = bytes.maketrans(SEPARATORS + b"\t", b"\n" * len(SEPARATORS) + b" ")
_BREAK, _BLANK = b"\n", b""


def tokens(text: bytes) -> list[bytes]:
    """The words of a text in order, A-Z in lower case, with b"\\n" between pieces (and b"" here and there)."""
    return text.lower().translate(_SPLIT).replace(b"\n", b" \n ").split(b" ")


class Codes(dict):
    """A number for each word, in the order they come; pieces end at 0 and blanks are 1."""

    def __init__(self):
        super().__init__({_BREAK: 0, _BLANK: 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """One hash of two."""
    h = first * _A ^ (then * _B + _C)
    return (h ^ (h >> np.uint64(29))) * _B


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _lang(lang: str) -> np.ndarray:
    return hashes([lang.encode("utf-8", "surrogatepass")])


def bits_for(n: int) -> int:
    return min(MOST_BITS, max(16, (SPARSE * max(1, n) - 1).bit_length()))


def bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """The slots of the hashed phrases (lang, phrase) of one or two words as a bitmap of 2**bits."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [x.split(b" ") for x in b.column(1).cast(pa.binary()).to_pylist()]
            langs = b.column(0).to_pylist()
            known = {x: _lang(x)[0] for x in set(langs)}
            h = mixed(hashes([w[0] for w in words]), np.array([known[x] for x in langs], np.uint64))
            pairs = np.array([len(w) > 1 for w in words], bool)
            h[pairs] = mixed(h[pairs], hashes([w[1] for w in words if len(w) > 1]))
            slot = np.unique(h >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 16), pa.array(slot & 0xFFFF)], ["block", "bit"])

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << 16, bool)
        held[group["bit"].to_numpy()] = True
        return pd.DataFrame({"block": group["block"].iloc[:1], "data": [np.packbits(held, bitorder="little").tobytes()]})

    found = phrases.select("lang", "phrase").mapInArrow(slots, "block long, bit long").distinct()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in found.groupBy("block").applyInPandas(packed, "block long, data binary").toLocalIterator():
        out[r.block << 13 : (r.block + 1) << 13] = np.frombuffer(r.data, np.uint8)
    return out


def _in(bitmap_: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - (len(bitmap_) * 8 - 1).bit_length())
    return (bitmap_[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def counted(docs: DataFrame, size: int, marks: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(lang, phrase, a): how often each phrase of ``size`` words (1 to 3) occurs. ``docs``: lang, text.

    Pairs are counted if both words are in ``marks["word"]``; triples by ``forward``, ``backward`` and ``score``, as the
    module says.
    """
    sent = docs.sparkSession.sparkContext.broadcast(marks or {})

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        codes, held, n = Codes(), {}, 0

        def of(lang: str, seq: np.ndarray, names: np.ndarray, word: np.ndarray) -> Iterator[pa.RecordBatch]:
            seq = seq[seq != 1]
            if size == 1:
                picked, columns = seq > 0, [seq]
            else:
                one = mixed(word, _lang(lang))
                able = (np.arange(len(names)) > 1) & _in(marks["word"], one)
                a, b = seq[:-1], seq[1:]
                both = able[a] & able[b]
                picked, columns = both, [a, b]
                if size == 3:
                    h = np.zeros(len(a), np.uint64)
                    h[both] = mixed(one[a[both]], word[b[both]])
                    flag = {k: both & _in(marks[k], h) for k in ("forward", "backward", "score")}
                    picked = flag["forward"][:-1] & flag["backward"][1:] | flag["score"][:-1] | flag["score"][1:]
                    picked &= both[:-1] & both[1:]
                    columns = [seq[:-2], seq[1:-1], seq[2:]]
            code = np.zeros(int(picked.sum()), np.int64)
            for c in columns:
                code = code << 21 | c[picked]
            code, times = np.unique(code, return_counts=True)
            for k in range(0, len(code), 1 << 16):
                some = code[k : k + (1 << 16)]
                text = names[some & 0x1FFFFF]
                for _ in columns[1:]:
                    some = some >> 21
                    text = names[some & 0x1FFFFF] + b" " + text
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(text), pa.string()), pa.array(text, pa.binary()), pa.array(times[k : k + (1 << 16)])], ["lang", "phrase", "a"]
                )

        def flushed() -> Iterator[pa.RecordBatch]:
            names = np.empty(len(codes), object)
            names[:] = list(codes)
            word = hashes(list(codes))
            for lang, parts in held.items():
                yield from of(lang, np.concatenate(parts), names, word)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text)
                for k in range(0, len(words), PART):  # a text of any length; parts overlap in the words of a phrase
                    before, j = [], k
                    while j and len(before) < size - 1:
                        j -= 1
                        before = [words[j], *before] if words[j] else before
                    some = before + words[k : k + PART]
                    seq = np.fromiter(map(codes.__getitem__, some), np.int64, len(some))
                    held.setdefault(lang, []).append(np.append(seq, 0))
                    n += len(seq)
                    if n >= CHUNK or len(codes) >= 1 << 19:
                        yield from flushed()
                        codes, held, n = Codes(), {}, 0
        yield from flushed()

    rows = docs.mapInArrow(part, "lang string, phrase binary, a long")
    return rows.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("a").alias("a"))


SCORE = f"cast((cast(a as decimal(38,0)) * a * {UNIT}) div (cast(l as decimal(38,0)) * r) as long)"


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``phrases`` (lang, phrase, a) with l, r and score of the cut that scores lowest (ties: the earliest). ``counts``:
    (lang, phrase, a) of everything shorter that is frequent."""
    first = "substring_index(phrase, ' ', k)"
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, size(split(phrase, ' ')) - 1)"))).select(
        "lang", "phrase", "a", "k", F.expr(first).alias("first"), F.expr(f"substring(phrase, length({first}) + 2)").alias("rest")
    )
    left, right = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", F.expr(SCORE))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return both.groupBy("lang", "phrase", "a").agg(best.alias("c")).select("lang", "phrase", "a", "c.*")


def levels(nodes: DataFrame, want: int) -> DataFrame:
    """(lang, low): of each language a score that at least ``want`` pairs reach, and 0 where there are fewer pairs."""
    steps = nodes.groupBy("lang", F.expr("score div 500").alias("step")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    reached = steps.withColumn("above", above).groupBy("lang").agg(F.max(F.when(F.col("above") >= want, F.col("step"))).alias("step"))
    return reached.select("lang", F.coalesce(F.col("step") * 500, F.lit(0)).alias("low"))


def triples(docs: DataFrame, nodes: DataFrame, word: np.ndarray, low: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a) of the frequent triples that matter at or above each language's level."""
    live = nodes.join(low, "lang")
    kinds = {"forward": F.col("forward") >= F.col("low"), "backward": F.col("backward") >= F.col("low"), "score": F.col("score") >= F.col("low")}
    sizes = live.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()]).first()
    marks = {k: bitmap(live.where(c), bits_for(sizes[k])) for k, c in kinds.items()}
    return counted(docs.join(low.select("lang"), "lang", "left_semi"), 3, marks | {"word": word}).where(F.col("a") >= least)


def mine(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, score, n): each language's best phrases of two and three words.

    a is the number of occurrences, l and r those of the two parts at the cut that scores lowest, n that of all words of the
    language. A pair is left out if its words stand inside a frequent triple that covers half of its occurrences. Rows are
    ranked by score, then a, both descending, then by the phrase's bytes; there are ``top`` at most. A null text is empty; a
    null lang is ``und``; doc_id and other columns are not looked at, so repeated rows count again. Languages without such
    phrases, and empty tables, give no rows.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    every = stored(counted(docs, 1), "words")
    n = every.groupBy("lang").agg(F.sum("a").alias("n"))
    words = every.where(F.col("a") >= least)
    word = bitmap(words, bits_for(words.count()))
    pairs = stored(counted(docs, 2, {"word": word}).where(F.col("a") >= least), "pairs")
    share = lambda c: F.expr(f"cast((cast(a as decimal(38,0)) * {UNIT}) div {c} as long)")
    nodes = stored(scored(pairs, words).withColumns({"forward": share("l"), "backward": share("r")}), "nodes")
    found, open_, want = None, n.select("lang"), FIRST * top
    while True:
        own = nodes.join(open_, "lang", "left_semi")
        low = stored(levels(own, want), "levels")
        three = stored(triples(docs, own, word, low, least), "triples")
        inside = F.explode(F.array(F.expr("substring_index(phrase, ' ', 2)"), F.expr("substring_index(phrase, ' ', -2)"))).alias("phrase")
        most = three.select("lang", inside, "a").groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
        here = own.join(low, "lang").where("score >= low")
        alone = here.join(most, ["lang", "phrase"], "left").where(f"inside is null or 100 * inside < {COVERED} * a")
        longer = scored(three, words.unionByName(pairs)).join(low, "lang").where("score >= low")
        columns = ["lang", "phrase", "a", "l", "r", "score"]
        alive = stored(alone.select(*columns).unionByName(longer.select(*columns)), "survivors")
        tally = alive.groupBy("lang").count()
        state = low.join(tally, "lang", "left")
        done = state.where(f"low = 0 or count >= {top}").select("lang")
        alive = alive.join(done, "lang", "left_semi")
        found = alive if found is None else found.unionByName(alive)
        open_ = stored(state.where(f"low > 0 and coalesce(count, 0) < {top}").select("lang"), "open")
        if open_.isEmpty():
            break
        want *= DEEPER
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
