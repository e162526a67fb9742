"""Substring dedup over sliding sentence spans.

A text is cut into sentences; the shortest run of at least ``MIN_SENTENCES`` sentences with at least ``MIN_WORDS`` words is
hashed from each sentence on (the run of its start) and back from each sentence (a tail, where it is no run of a start). A
run depends on its own words alone, so copies of a passage give the same hashes wherever they stand. The hashes are joined
over the whole corpus, and the sentences of every run that is not the first of its hash (by doc_id, then place) are removed.

That removes the sentences of every repeated run of that size, of whatever length: one whose run of the start leaves the
passage lies in the tail that ends with it. A tail is looked up only if the run of its start, which lies in it, is repeated.
A text without such a run is one run as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_function, stored, texts

MIN_SENTENCES = 2
MIN_WORDS = 25
#: A longer sentence (text without punctuation) is cut after words chosen by their hash, one in eight. The cuts depend on
#: the sentence's own words, so that copies of it are cut alike.
LONG_SENTENCE = 32
END = re.compile(r"(?<=[.!?])[ \t\r\f\v]+|\n+")
WORD = re.compile(r"\S+")


def sentences(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normal form) of each sentence with a word; the spans are disjoint and in order."""
    out = []
    at = 0
    for stop, after in [(m.start(), m.end()) for m in END.finditer(text)] + [(len(text), len(text))]:
        piece = text[at:stop]
        plain = piece.split()
        if len(plain) > LONG_SENTENCE:
            words = list(WORD.finditer(text, at, stop))
            begin = 0
            for k, w in enumerate(words[:-1]):
                if not xxhash.xxh32_intdigest(w[0].lower().encode("utf-8", "surrogatepass")) & 7:
                    out.append(_sentence(words[begin : k + 1]))
                    begin = k + 1
            out.append(_sentence(words[begin:]))
        elif plain:
            begin = stop - len(piece.lstrip())
            out.append((begin, at + len(piece.rstrip()), len(plain), " ".join(plain).lower()))
        at = after
    return out


def _sentence(words: list[re.Match]) -> tuple[int, int, int, str]:
    return words[0].start(), words[-1].end(), len(words), " ".join(w[0] for w in words).lower()


def spans(text: str) -> tuple[list[int], list[int], list[int], list[int], list[list[int]]]:
    """Of the run of each start: first sentence, number of sentences, 128-bit hash as two signed longs, and the 64-bit
    hashes of the tails with that start, which are one, two, ... sentences longer."""
    parts = sentences(text)
    texts = [p[3].encode("utf-8", "surrogatepass") for p in parts]
    first, size, h1, h2, tails = [], [], [], [], []
    stop, words = 0, 0
    for k in range(len(parts)):
        while stop < len(parts) and (words < MIN_WORDS or stop - k < MIN_SENTENCES):
            words += parts[stop][2]
            stop += 1
        if (words < MIN_WORDS or stop - k < MIN_SENTENCES) and k:
            break
        digest = xxhash.xxh3_128_digest(b"\n".join(texts[k:stop]))
        first.append(k)
        size.append(stop - k)
        h1.append(int.from_bytes(digest[:8], "little", signed=True))
        h2.append(int.from_bytes(digest[8:], "little", signed=True))
        tails.append(more := [])
        words -= parts[k][2]
        end, short = stop, words  # words of the run without its first sentence
        while end < len(parts) and (short < MIN_WORDS or end - k - 1 < MIN_SENTENCES):
            short += parts[end][2]
            end += 1
            if short < MIN_WORDS or end - k - 1 < MIN_SENTENCES:
                digest = xxhash.xxh3_64_digest(b"\n".join(texts[k:end]))
                more.append(int.from_bytes(digest, "little", signed=True))
    return first, size, h1, h2, tails


RUNS = ["first", "size", "h1", "h2", "tails"]


@column_function("first array<int>, size array<int>, h1 array<long>, h2 array<long>, tails array<array<long>>")
def spans_of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame([spans(x) for x in part], columns=RUNS)


#: A place is a row's doc_id (null: after all others), the hash of its text, and the sentence where the run begins.
PLACE = ["doc_id", "text_hash", "first"]


def _with_heads(runs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The runs whose hash has several rows, with of_doc, of_text and of_sentence, the first place of the hash."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), *PLACE)
    heads = stored(  # a table of its own, so that Spark can split the join's hot hashes
        runs.groupBy(*keys)
        .agg(F.min(place).alias("head"), F.count("*").alias("n"))
        .where("n > 1")
        .select(*keys, *[F.col(f"head.{c}").alias(n) for c, n in zip(PLACE, ("of_doc", "of_text", "of_sentence"), strict=True)]),
        name,
    )
    return runs.join(heads, keys)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, first (sentence), size, of_doc, of_text, of_sentence: each run that an earlier place holds as
    well, with that place.

    Places are in order of doc_id, then text hash, then sentence. Equal rows are one place. Rows without doc_id come after
    all others.
    """
    runs = (
        texts(docs)
        .select("doc_id", F.xxhash64("text").alias("text_hash"), spans_of("text").alias("s"))
        .select("doc_id", "text_hash", F.inline(F.arrays_zip(*[f"s.{c}" for c in RUNS])))
        .toDF("doc_id", "text_hash", *RUNS)
    )
    starts = stored(_with_heads(stored(runs, "runs"), ["h1", "h2"], "heads"), "repeated")
    tails = starts.select(*PLACE, "size", "h1", "h2", F.posexplode("tails").alias("k", "tail")).select(
        *PLACE, (F.col("size") + F.col("k") + 1).alias("size"), "h1", "h2", "tail"
    )
    found = _with_heads(stored(tails, "tails"), ["h1", "h2", "tail"], "tail-heads")
    columns = [*PLACE, "size", "of_doc", "of_text", "of_sentence"]
    return (
        starts.select(*columns)
        .unionByName(found.select(*columns))
        .where("not (doc_id <=> of_doc and text_hash = of_text and first = of_sentence)")
    )


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans: array of (first, last, of_doc), the sentences to remove; of_doc holds an earlier copy of
    the first run there. Overlapping and adjoining runs are one span. Only texts that lose something have a row."""
    runs = repeats(docs).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("first", "size", "of_doc"))).alias("runs")
    )
    kind = "array<struct<first:int,last:int,of_doc:bigint>>"
    merged = F.expr(
        f"""aggregate(runs, cast(array() as {kind}), (done, r) ->
            if(size(done) > 0 and r.first <= done[size(done) - 1].last + 1,
               concat(slice(done, 1, size(done) - 1), array(named_struct(
                   'first', done[size(done) - 1].first,
                   'last', greatest(done[size(done) - 1].last, r.first + r.size - 1),
                   'of_doc', done[size(done) - 1].of_doc))),
               concat(done, array(named_struct('first', r.first, 'last', r.first + r.size - 1, 'of_doc', r.of_doc)))))"""
    )
    return runs.select("doc_id", "text_hash", merged.alias("spans"))


@column_function("text string, n_sentences int, n_removed int, n_words long")
def _cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, gone in parts:
        rows = []
        for x, out in zip(text, gone, strict=True):
            x, out = x or "", [] if out is None else out
            units = sentences(x)
            at, kept, n, words = 0, [], 0, 0
            for s in out:
                kept.append(x[at : units[s["first"]][0]])
                at = units[s["last"]][1]
                n += s["last"] - s["first"] + 1
                words += sum(u[2] for u in units[s["first"] : s["last"] + 1])
            kept.append(x[at:])
            rows.append(("".join(kept), len(units), n, words))
        yield pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed", "n_words"])


def dedup_substrings(docs: DataFrame, changed_only: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``text`` less the sentences of repeated runs, and n_sentences (before), n_removed,
    n_words (removed), and spans as of ``removed``; with ``changed_only`` the rows that lose something.

    The text between and round the removed sentences stays as it is. A null text becomes empty; an empty text has no
    sentence and loses nothing; a text of any length is worked through whole. Other columns pass through, but for those
    with the names of the new ones. Documents keep their row even if nothing is left. Of rows with equal doc_id the texts
    are told apart by their hash; equal rows lose the same sentences. Rows without doc_id come last, so they lose what any
    other row holds. An empty table gives an empty table.
    """
    gone = removed(docs).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"), F.col("spans").alias("__spans")
    )
    mine = docs.doc_id.eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs.text, F.lit(""))) == F.col("__text"))
    cut = docs.join(gone, mine, "inner" if changed_only else "left").withColumn("__cut", _cut("text", "__spans"))
    return cut.withColumns(
        {k: F.col(f"__cut.{k}") for k in ("text", "n_sentences", "n_removed", "n_words")} | {"spans": F.col("__spans")}
    ).drop("__id", "__text", "__spans", "__cut")
