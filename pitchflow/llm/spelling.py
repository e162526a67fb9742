"""Spelling variants by a bit-sliced position index.

Two words are near if one insertion, deletion or replacement of a code point turns one into the other. The index of a group
of words has a bitset for each position and letter: bit k says that word k has that letter there. A query runs through its
letters once, with four sets of words as bitsets: those matched without error so far, and those matched with one replaced,
one more or one less letter, whose next letters stand at the same, the next or the previous position. All words of a group
and all queries of one length go through together, as rows of machine words.

Groups are small because of where an error can be. A pair of words of lengths s and s or s + 1 is cut into windows of the
shorter one, of at most ``WINDOW`` letters; outside the window that holds the error, both are equal. So a word goes into one
group for each window, by the hash of what stands before and after the window, and the index is over the window alone: the
start set of a query is the words of its group. Groups are packed into bins of bounded size, a bin is one index, and one
bin is one call. A group of more than ``SPLIT`` words is split: each of its words is indexed in one part and asked in all.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_LETTERS, MIN_COUNT = 6, 5
#: A near word is taken as the form if it is so many times as frequent.
TIMES = 5
#: One in so many (word, document) pairs is misspelt on purpose.
TYPOS = 199
WINDOW, BIN, SPLIT = 8, 4096, 1 << 15
FLUSH = 400_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Machine words of one set of queries that are worked on together.
CELLS = 1 << 18


def spelt(doc_id: str | None, text: bytes) -> Counter:
    """How often each word stands in a text, after the planted misspellings."""
    out: Counter = Counter()
    seed = zlib.crc32(f"{doc_id or ''}:".encode())
    for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
        h = zlib.crc32(run.encode(), seed)
        if h % TYPOS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of at least MIN_LETTERS letters that occur MIN_COUNT times in all."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            kept = [(w, n) for w, n in total.items() if len(w) >= MIN_LETTERS]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.update(spelt(doc_id, text))
                if len(total) > FLUSH:
                    yield flushed()
                    total.clear()
        yield flushed()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(part, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def windows(word: str) -> Iterator[tuple[bool, bytes, str]]:
    """(whether the word is the longer of the pairs looked for, key of what stands outside the window, window)."""
    size, data = len(word), word.encode("utf-32-le")
    for short in (size, size - 1):
        parts = max(2, -(-short // WINDOW))
        cuts = [short * k // parts for k in range(parts + 1)]
        head, tails = xxhash.xxh3_128(), []
        tail = xxhash.xxh3_128()
        for k in range(parts, 0, -1):  # what follows window k - 1, hashed from the end
            tails.append(tail.digest())
            at = size - (short - cuts[k - 1])
            tail.update(data[4 * at : 4 * (size - (short - cuts[k]))])
        for k in range(parts):
            lo, hi = cuts[k], size - (short - cuts[k + 1])
            key = xxhash.xxh3_128(head.digest() + tails[parts - 1 - k] + f"{short} {k}".encode()).digest()
            yield size > short, key, word[lo:hi]
            head.update(data[4 * lo : 4 * cuts[k + 1]])


def near_pairs(key: np.ndarray, window: list[str], longer: np.ndarray, indexed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (query, target) of equal key whose windows are one error apart; of two rows that are ``longer`` none. Targets
    are the ``indexed`` rows."""
    target = np.flatnonzero(indexed)
    width = -(-len(target) // 64)
    if not width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([len(w) for w in window])
    letters = np.zeros((len(window), size.max() + 2), np.uint32)
    flat = np.frombuffer("".join(window).encode("utf-32-le"), np.uint32)
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(window)), size)
    letters[row, np.arange(len(flat)) - begin[row]] = flat
    kinds, codes = np.unique(letters, return_inverse=True)  # code 0: no letter
    codes = codes.reshape(letters.shape)
    if kinds[0]:
        codes += 1

    def bitset(rows: np.ndarray) -> np.ndarray:
        """Bits of boolean rows over the targets."""
        bits = np.packbits(rows, axis=-1, bitorder="little")
        return np.pad(bits, [(0, 0)] * (rows.ndim - 1) + [(0, width * 8 - bits.shape[-1])]).view(np.uint64)

    positions, alphabet = letters.shape[1], int(codes.max()) + 1
    index = np.zeros((positions + 1, alphabet, width), np.uint64)  # the last position has no letters: for position -1
    mine = codes[target]
    for p in range(positions):
        for c in np.unique(mine[:, p]):
            if c:
                index[p, c] = bitset(mine[:, p] == c)
    by_key, of_key = np.unique(key, return_inverse=True)
    start = np.zeros((len(by_key), width), np.uint64)
    order = np.argsort(of_key[target], kind="stable")
    np.bitwise_or.at(start, (of_key[target][order], order // 64), np.uint64(1) << (order % 64).astype(np.uint64))
    short, long = bitset(~longer[target]), bitset(longer[target])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    per = max(1, CELLS // width)
    for late in (False, True):
        for m in np.unique(size[longer == late]):
            asked = np.flatnonzero((longer == late) & (size == m))
            for k in range(0, len(asked), per):
                q = asked[k : k + per]
                none = start[of_key[q]]
                swapped = more = less = np.zeros_like(none)
                for i in range(m):
                    c = codes[q, i]
                    here = index[i, c]
                    if late:
                        less = less & index[i - 1, c] | none
                    else:
                        swapped = swapped & here | none & ~here
                        more = (more | none) & index[i + 1, c]
                    none = none & here
                found = less & short if late else swapped & short | (more | none) & long
                near, word = np.nonzero(found)
                bits = np.unpackbits(found[near, word][:, None].view(np.uint8), axis=1, bitorder="little")
                at, bit = np.nonzero(bits)
                out.append((q[near[at]], target[word[at] * 64 + bit]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def neighbours(words: DataFrame, bin_rows: int = BIN, split: int = SPLIT) -> DataFrame:
    """(id, near) for every ordered pair of near words. ``words``: id (unique), word."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, longer, key, w) for i, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for longer, key, w in windows(word)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.binary(), pa.string()), strict=True)], ["id", "longer", "key", "part"])

    rows = stored(words.select("id", "word").mapInArrow(dealt, "id long, longer boolean, key binary, part string"), "windows")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = rows.join(sizes, "key")  # a word alone in its group has no partner there
    shards = F.ceil(F.col("size") / split)
    dealt_out = shared.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)))
    bins = max(1, -(-rows.count() // bin_rows))
    dealt_out = dealt_out.select(
        "id", "longer", "key", "part", (F.pmod(F.xxhash64("id"), shards) == F.col("shard")).alias("indexed"), F.pmod(F.xxhash64("key", "shard"), F.lit(bins)).alias("bin")
    )

    def look(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["id"].to_numpy()
        key = np.array(rows["key"].tolist(), "S16")
        q, t = near_pairs(key, rows["part"].tolist(), rows["longer"].to_numpy(bool), rows["indexed"].to_numpy(bool))
        return pd.DataFrame({"id": ids[q], "near": ids[t]})

    return dealt_out.groupBy("bin").applyInPandas(look, "id long, near long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): the last of the chain of forms, by doubling its steps. A form is more frequent than its
    word, so chains are short and have no circles."""
    steps = stored(forms.select("id", F.col("form").alias("root")), "chains")
    while True:
        ahead = steps.select(F.col("id").alias("root"), F.col("root").alias("further"))
        longer = stored(steps.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "chains")
        steps = longer.select("id", "root")
        if longer.where("moved").isEmpty():
            return steps


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least six letters that occurs five times.

    Words are runs of letters with A-Z in lower case, one in ``TYPOS`` of a document misspelt by a rule on purpose.
    ``n_near`` counts the words one insertion, deletion or replacement away; ``form`` is the most frequent of them (ties: the
    first in code-point order) if it occurs at least five times as often; ``root`` is the last of the chain of forms, or the
    word. A null text has no words, a null doc_id is empty; doc_id may be of any type. Rows with equal doc_id count each.
    Words and texts may have any length. Extra columns are ignored; an empty table gives no rows.
    """
    # ids follow the code-point order of the words: UTF-8 bytes sort as code points do
    words = stored(vocabulary(docs).orderBy("word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    pairs = stored(neighbours(words), "pairs")
    counts = words.select(F.col("id").alias("near"), F.col("n").alias("near_n"))
    best = pairs.join(counts, "near").groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    able = -F.col("top.less") >= TIMES * F.col("n")
    told = stored(
        words.join(best, "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(able, F.col("top.near")).alias("form_id"), F.when(able, -F.col("top.less")).alias("form_n")
        ),
        "forms",
    )
    last = roots(told.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    name = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    top = words.select(F.col("id").alias("root_id"), F.col("word").alias("root_word"))
    named = told.where("form_id is not null").join(name, "form_id").join(last.select("id", F.col("root").alias("root_id")), "id").join(top, "root_id")
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    plain = told.where("form_id is null").withColumns({"form": F.lit(None).cast("string"), "root": F.col("word")})
    return named.withColumnRenamed("root_word", "root").select(*columns).unionByName(plain.select(*columns))
