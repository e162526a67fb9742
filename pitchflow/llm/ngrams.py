"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a trie of word n-grams with interpolated absolute discounting: P(w | context) = discounted share of w after the
context + the mass the discounts leave over * P(w | shorter context), down to smoothed single words. Level 1 has every
word of the corpus with its exact count; an n-gram of two or more words is in its level if it occurs twice (what rarer ones
weigh stays with the shorter context, so everything adds up to at most one).

A level is made by one pass over the texts, in which tasks look up the level before, count their own chunk of text and emit
(context node, word, count) rows, packed by shard; a shard gathers them and writes itself as one file of compact arrays into
the shared folder: its contexts and, by monotone pointers, each context's run of successors, both as Elias-Fano sequences
(runs made monotone by adding the end of the run before), and a byte a successor and a context for the smoothed values.
Executors map these files into memory and never hold the model as objects; it grows with the corpus and is nowhere
broadcast, only the names and sizes of its shards are. A lookup finds the context in its shard, and then the word among
the successors of that context. A context with many successors is spread over several shards by the word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import made, remainder, shared_folder
from .elias import Sequence, opened, quantised, write

ORDER = 3
#: Weight of single words' smoothing, as in the base score; discount of longer n-grams; how often these must occur.
PLUS, DISCOUNT, LEAST = 0.1, 0.75, 2
#: A shard is for so many tokens of the corpus; a task works on so many tokens at a time.
SHARD_TOKENS, CHUNK = 1 << 22, 1 << 20
BYTES_A_TOKEN = 6
#: A context that stands for more than this part of a shard is spread.
HOT = 1 / 8
#: Texts are taken apart so many bytes at a time.
BUFFER = 1 << 18
_SPACE = re.compile(rb"[ \t-\r]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_MIX = tuple(np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 29, 32))
#: The hash of the end of a text, which is a token as words are.
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    return tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(n, base, np.uint64))) for base in (_BASE, _BACK))


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of the words of a text, A-Z in lower case.

    The hash is a polynomial in the bytes, from running sums over the text, so whole texts are hashed in a few array
    operations; words longer than BUFFER have another hash.
    """
    data = _LOWER[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(~_IS_SPACE[data], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if len(data) > 2 * BUFFER:  # it holds a giant word: word by word
        one = lambda w: np.uint64(xxhash.xxh3_64_intdigest(w)) if len(w) > BUFFER else hashed(w)[1][0]
        return start, np.array([one(data[i:j].tobytes()) for i, j in zip(start, end, strict=True)], np.uint64)
    up, down = _powers(2 * BUFFER)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MIX[1]
    h = (h ^ h >> _MIX[3]) * _MIX[0]
    return start, h ^ h >> _MIX[2]


def _hash(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


@dataclass
class Level:
    """What the driver keeps of a level: shard files, first node of each shard, contexts that are spread over shards."""

    names: list[str | None]
    first: np.ndarray  # shards + 1 numbers
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # nodes of this level, in order
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # over how many shards each is spread
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # how often each occurs
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0))  # the mass left over by each, NaN without successors


@dataclass
class Model:
    folder: str
    shards: int
    levels: list[Level]
    tokens: int
    words: int

    _maps = {}  # of this process: the files of the model that it used last

    def shard(self, level: int, k: int) -> dict[str, np.ndarray]:
        if Model._maps.get("folder") != self.folder:
            Model._maps.clear()
            Model._maps["folder"] = self.folder
        if (level, k) not in Model._maps:
            name = self.levels[level].names[k]
            arrays = opened(self.folder, name) if name else {}
            kept = {x[:-4]: Sequence.named(arrays, x[:-4]) for x in arrays if x.endswith(".low")}
            Model._maps[level, k] = kept | {x: a for x, a in arrays.items() if "." not in x}
        return Model._maps[level, k]

    def _by_shard(self, level: int, of: np.ndarray) -> Iterator[tuple[dict, np.ndarray, int]]:
        """(shard, places of ``of`` in it, its first node); shards without a file are left out."""
        order = np.argsort(of.astype(np.min_scalar_type(self.shards)), kind="stable")  # a radix sort, where shards are few
        ends = np.searchsorted(of[order], np.arange(self.shards + 1))
        for k in np.flatnonzero(np.diff(ends)):
            if self.levels[level].names[k]:
                yield self.shard(level, k), order[ends[k] : ends[k + 1]], int(self.levels[level].first[k])

    def find_words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, count) of words by hash; -1 and 0 of unknown ones."""
        node, count = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        for s, at, first in self._by_shard(0, (hashes % np.uint64(self.shards)).astype(np.int64)):
            i = s["keys"].find(hashes[at])
            node[at[i >= 0]] = first + i[i >= 0]
        known = np.flatnonzero(node >= 0)
        count[known] = self.counts(0, node[known])
        return node, count

    def counts(self, level: int, node: np.ndarray) -> np.ndarray:
        """How often n-grams occur in the corpus."""
        out = np.zeros(len(node), np.int64)
        for s, at, first in self._by_shard(level, np.searchsorted(self.levels[level].first, node, "right") - 1):
            lo, hi = s["sums"].both(node[at] - first)
            out[at] = (hi - lo).astype(np.int64)
        return out

    def route(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The shard of n-grams of ``level``, given their context's nodes in the level before and their last words."""
        above = self.levels[level - 1]
        at = np.minimum(np.searchsorted(above.hot, context), max(0, len(above.hot) - 1))
        parts = np.where(above.hot[at] == context, above.parts[at], 1) if len(above.hot) else np.ones(len(context), np.int64)
        return ((_hash(context) + _hash(word + 1) % parts.astype(np.uint64)) % np.uint64(self.shards)).astype(np.int64)

    def find(self, level: int, context: np.ndarray, word: np.ndarray, values: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, discounted share, rest) of the n-grams of ``level`` with these contexts (nodes of the level before) and last
        words: -1 and 0 of those that are not in it, such as all of word -1. ``rest`` is the mass that the context leaves to
        shorter ones: 1 for one without successors."""
        node, share, rest = np.full(len(context), -1), np.zeros(len(context)), np.ones(len(context))
        for s, at, first in self._by_shard(level, self.route(level, context, word)):
            if level == 1:  # words come often
                of, back = np.unique(context[at], return_inverse=True)
                p = s["contexts"].find(of)[back]
            else:
                p = s["contexts"].find(context[at])
            at, p = at[p >= 0], p[p >= 0]
            if values:
                rest[at] = s["rest_levels"][s["rest"][p]]
            at, p = at[word[at] >= 0], p[word[at] >= 0]
            if not len(p):
                continue
            lo, hi = (x.astype(np.int64) for x in s["pointers"].both(p))
            before = np.where(lo > 0, s["words"][np.maximum(lo - 1, 0)], np.uint64(0))
            i = s["words"].find(before + (word[at] + 1).astype(np.uint64), hi)
            at, i = at[i >= 0], i[i >= 0]
            node[at] = first + i
            if values:
                share[at] = s["share_levels"][s["share"][i]]
        above = self.levels[level - 1]
        if values and len(above.hot):  # a spread context is in several shards
            k = np.minimum(np.searchsorted(above.hot, context), len(above.hot) - 1)
            hot = above.hot[k] == context
            own = above.rest[k[hot]]
            rest[hot] = np.where(np.isnan(own), 1.0, own)
        return node, share, rest


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about BUFFER bytes, cut at white space."""
    at = 0
    while len(text) - at > BUFFER and (cut := _SPACE.search(text, at + BUFFER)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def _buffers(texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, bool, bool]]:
    """(hashes of the tokens of some texts, how many of each, whether the first is the last of the buffer before, whether the
    last goes on). Small texts go together, large ones in parts."""
    some: list[bytes] = []

    def joined() -> tuple[np.ndarray, np.ndarray, bool, bool]:
        ends = np.cumsum([len(x) + 1 for x in some])
        start, h = hashed(b"\n".join(some))
        of = np.searchsorted(ends, start, "right")
        out = np.full(len(h) + len(some), END)
        out[np.arange(len(h)) + of] = h
        return out, np.bincount(of, minlength=len(some)) + 1, False, False

    size = 0
    for text in texts:
        if some and size + len(text) > BUFFER:
            yield joined()
            some, size = [], 0
        if len(text) <= BUFFER:
            some.append(text)
            size += len(text) + 1
            continue
        parts = list(_parts(text))
        for k, part in enumerate(parts):
            h, on = hashed(part)[1], k < len(parts) - 1
            h = h if on else np.append(h, END)
            yield h, np.array([len(h)]), k > 0, on
    if some:
        yield joined()


def _chunks(batches: Iterator[pa.RecordBatch], column: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list, bool]]:
    """(hashes of the words, code of each token, number of the row of each token, first values of the rows, whether the last
    row goes on) for runs of rows of at least ``chunk`` tokens (or the last ones). A run that begins inside a text has the
    ORDER - 1 tokens before in front, with the row number -1; the text is row 0 there."""
    ids: list = []

    def texts() -> Iterator[bytes]:
        for b in batches:
            for k, text in zip(b.column(0), b.column(column), strict=True):
                ids.append(k.as_py() if column else None)
                yield text.as_py()

    hashes, sizes, n, before = [], [], 0, np.zeros(0, np.uint64)

    def run(on: bool) -> tuple:
        nonlocal hashes, sizes, n, before
        h, size = np.concatenate([before, *hashes]), np.concatenate(sizes)
        seq, words = pd.factorize(h)
        row = np.append(np.full(len(before), -1), np.repeat(np.arange(len(size)), size))
        out = words, seq, row, ids[: len(size)], on
        del ids[: len(size) - on]
        before = h[-ORDER + 1 :] if on else before[:0]
        hashes, sizes, n = [], [], 0
        return out

    for h, size, goes_on, on in _buffers(texts()):
        if goes_on and sizes:
            sizes[-1][-1] += size[0]
            size = size[1:]
        hashes.append(h)
        sizes.append(size)
        if not len(size):
            sizes.pop()
        n += len(h)
        if n >= chunk:
            yield run(on)
    if hashes:
        yield run(False)


def _pairs(first: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of codes below 2**31: (first, then, place of each given pair among them, times)."""
    code, back, times = np.unique(first << 31 | then, return_inverse=True, return_counts=True)
    return code >> 31, code & 0x7FFFFFFF, back, times


def _joined(row: np.ndarray) -> np.ndarray:
    """Whether a token and the next one are of one text."""
    own = np.maximum(row, 0)
    return own[1:] == own[:-1]


def _emitted(model: Model, level: int, words: np.ndarray, seq: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context node, word's node, count) of the n-grams of ``level`` in a run of texts that can occur LEAST times."""
    node, count = model.find_words(words)
    able = count >= LEAST
    now = np.flatnonzero(_joined(row) & able[seq[:-1]] & able[seq[1:]])  # pairs by the place of their first word
    if level == 1:
        now = now[row[now + 1] >= 0]
        a, b, _, n = _pairs(seq[now], seq[now + 1])
        return node[a], node[b], n
    a, b, back, _ = _pairs(seq[now], seq[now + 1])
    found = model.find(1, node[a], node[b], values=False)[0]
    pair = np.full(len(seq), -1)
    pair[now] = np.where(found[back] >= 0, back, -1)
    whole = np.flatnonzero((pair[:-2] >= 0) & (pair[1:-1] >= 0)) if len(seq) > 2 else np.zeros(0, np.int64)
    whole = whole[row[whole + 2] >= 0]
    p, c, _, n = _pairs(pair[whole], seq[whole + 2])
    return found[p], node[c], n


ROW = "shard long, data binary"


def _packed(shard: np.ndarray, context: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row a shard with its n-grams: contexts as steps, all columns in the narrowest type, compressed."""
    order = np.lexsort((context, shard))
    shard, context, word, n = (np.asarray(x)[order] for x in (shard, context, word, n))
    ends = np.append(np.flatnonzero(np.diff(shard)) + 1, len(shard)) if len(shard) else np.zeros(0, np.int64)
    squeeze, rows = zstandard.ZstdCompressor(level=1), []
    for lo, hi in zip(np.append(0, ends)[:-1], ends, strict=True):
        columns = [np.diff(context[lo:hi], prepend=0), word[lo:hi], n[lo:hi]]
        columns = [c.astype(np.min_scalar_type(c.max())) for c in columns]
        head = np.array([hi - lo, *[c.itemsize for c in columns]], np.int64)
        rows.append(squeeze.compress(b"".join(c.tobytes() for c in (head, *columns))))
    first = np.append(0, ends)[:-1]
    return pa.RecordBatch.from_arrays([pa.array(shard[first].astype(np.int64)), pa.array(rows, pa.binary())], ["shard", "data"])


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, count) of the rows of a shard; a word is an unsigned number."""
    parts: list[list[np.ndarray]] = [[], [], []]
    for blob in blobs:
        data = zstandard.ZstdDecompressor().decompress(blob)
        size, *widths = np.frombuffer(data, np.int64, 4).tolist()
        at = 32
        for k, width in enumerate(widths):
            column = np.frombuffer(data, f"u{width}", size, at)
            parts[k].append(np.cumsum(column.astype(np.int64)) if k == 0 else column.astype(np.uint64 if k == 1 else np.int64))
            at += width * size
    return tuple(np.concatenate(p) for p in parts)


def _built(rows: DataFrame, model: Model, level: int, last: bool) -> Level:
    """Write the shards of a level from its rows and return what to keep of them. Contexts that are spread send what their
    successors take, one number for each shard, to be added up here."""
    limit = HOT * SHARD_TOKENS

    def build(part: pd.DataFrame) -> pd.DataFrame:
        shard = int(part["shard"].iloc[0])
        context, word, n = _unpacked(part["data"].tolist())
        order = np.lexsort((word, context))
        context, word, n = context[order], word[order], n[order]
        new = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])))
        n, context, word = np.add.reduceat(n, new), context[new], word[new]
        kept = n >= (LEAST if level else 1)
        context, word, n = context[kept], word[kept], n[kept]
        sums = np.append(0, np.cumsum(n))
        spread: tuple = (np.zeros(0, np.int64), np.zeros(0))
        if level == 0:
            arrays = Sequence.of(word).arrays("keys")
        else:
            word = word.astype(np.int64)
            begin = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
            of, ends = context[begin], np.append(begin, len(context))
            total = model.counts(level - 1, of)
            share, levels = quantised((n - DISCOUNT) / np.repeat(total, np.diff(ends)))
            taken = np.add.reduceat(n - DISCOUNT, begin) if len(begin) else np.zeros(0)
            rest, rest_levels = quantised(np.maximum(0.0, 1 - taken / total))
            tops = np.cumsum((word[ends[1:] - 1] + 1)) if len(begin) else np.zeros(0, np.int64)
            runs = word + 1 + np.repeat(np.append(0, tops)[:-1], np.diff(ends)) if len(begin) else word
            arrays = Sequence.of(of).arrays("contexts") | Sequence.of(ends if len(begin) else np.zeros(1, np.int64)).arrays("pointers") | Sequence.of(runs).arrays("words")
            arrays |= {"share": share, "share_levels": levels, "rest": rest, "rest_levels": rest_levels}
            hot = np.isin(of, model.levels[level - 1].hot)
            spread = (of[hot], taken[hot])
        if not last:
            arrays |= Sequence.of(sums).arrays("sums")
        name = write(model.folder, f"level{level}-{shard}", arrays)
        many = np.flatnonzero(n > limit)
        return pd.DataFrame({"shard": [shard], "name": [name], "size": [len(n)], "total": [int(n.sum())], "many": [many.tolist()], "times": [n[many].tolist()], "spread": [spread[0].tolist()], "taken": [spread[1].tolist()]})

    kind = "shard long, name string, size long, total long, many array<long>, times array<long>, spread array<long>, taken array<double>"
    made_ = rows.groupBy("shard").applyInPandas(build, kind).collect()  # a row a shard
    names: list[str | None] = [None] * model.shards
    sizes = np.zeros(model.shards, np.int64)
    for r in made_:
        names[r.shard], sizes[r.shard] = r.name, r.size
    first = np.append(0, np.cumsum(sizes))
    hot = sorted((int(first[r.shard]) + i, n) for r in made_ for i, n in zip(r.many, r.times, strict=True))
    if level:
        above = model.levels[level - 1]
        taken = np.zeros(len(above.hot))
        for r in made_:
            np.add.at(taken, np.searchsorted(above.hot, r.spread), r.taken)
        above.rest = np.where(taken > 0, np.maximum(0.0, 1 - taken / np.maximum(above.times, 1)), np.nan)
    else:
        model.tokens, model.words = sum(r.total for r in made_), int(sizes.sum())
    node, times = (np.array([x[k] for x in hot], np.int64) for k in (0, 1))
    return Level(names, first, node, np.ceil(times / limit).astype(np.int64), times)


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """The model of all texts of ``docs`` (null: empty), of n-grams of two or three words at most."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    model = Model(_uri(spark, made(shared_folder(spark))), max(1, -(-size // (BYTES_A_TOKEN * SHARD_TOKENS))), [], 0, 0)
    for level in range(order):

        def part(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for words, seq, row, *_ in _chunks(batches, 0, CHUNK):
                if level == 0:
                    n = np.bincount(seq[row >= 0], minlength=len(words))
                    h, n = words[n > 0], n[n > 0]
                    yield _packed(h % np.uint64(model.shards), np.zeros(len(h), np.int64), h, n)
                else:
                    context, word, n = _emitted(model, level, words, seq, row)
                    yield _packed(model.route(level, context, word), context, word, n)

        model.levels.append(_built(rows.mapInArrow(part, ROW), model, level, level == order - 1))
    return model


def _uri(spark: SparkSession, folder: str) -> str:
    """The folder's full address, made if need be."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    full = store.makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def _logs(model: Model, words: np.ndarray, seq: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its count, log10 of its base probability, log10 of the model's."""
    node, count = model.find_words(words)
    single = (count + PLUS) / (model.tokens + PLUS * (model.words + 1))
    p = single[seq]
    if len(model.levels) > 1 and len(seq) > 1:
        now = np.flatnonzero(_joined(row) & (node[seq[:-1]] >= 0))
        a, b, back, _ = _pairs(seq[now], seq[now + 1])
        found, share, rest = model.find(1, node[a], node[b])
        two = share + rest * single[b]
        p[now + 1] = two[back]
        if len(model.levels) > 2 and len(seq) > 2:
            pair = np.full(len(seq), -1)
            pair[now] = np.where(found[back] >= 0, back, -1)
            whole = np.flatnonzero((pair[:-2] >= 0) & _joined(row)[1:])
            x, c, again, _ = _pairs(pair[whole], seq[whole + 2])
            _, share, rest = model.find(2, found[x], node[c])
            p[whole + 2] = share[again] + rest[again] * p[whole + 2]
    return count[seq], np.log10(single)[seq], np.log10(p)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (sums of log10 probabilities of a text's words and its end) a row."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None  # the row that went on in the next run of texts
        for words, seq, row, ids, on in _chunks(batches, 1, CHUNK):
            count, base, own = _logs(model, words, seq, row)
            ok = row >= 0
            at = row[ok]
            sums = np.stack([np.bincount(at, minlength=len(ids)), *[np.bincount(at, x[ok], len(ids)) for x in (count > 0, base, own)]])
            if open_ is not None:
                sums[:, 0] += open_
            open_, done = (sums[:, -1] if on else None), len(ids) - on
            yield pa.RecordBatch.from_arrays([pa.array(ids[:done], pa.string()), *[pa.array(x[:done].astype(t)) for x, t in zip(sums, ("int64", "int64", "float64", "float64"), strict=True)]], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    out = rows.mapInArrow(part, "doc_id string, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def perplexities(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    The model learns from the rows whose crc32(doc_id as text) mod 10 is not 0 (a null doc_id counts as the empty text). Null
    and empty texts are one token, the end; texts of any length are scored whole. Equal texts get equal scores; rows with
    equal doc_id are scored each, and learnt from each. Without texts to learn from every probability is one. doc_id may be of
    any type that its text gives back. Extra columns are ignored; an empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text")
    held = remainder("doc_id", 10) == 0
    model = train(docs.where(~held))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
