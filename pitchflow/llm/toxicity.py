"""Toxicity by weak supervision.

Dozens of voters say yes or no to every document: for each kind of entry (whole words, beginnings and endings of several
lengths) a lexicon drawn from a bounded sample of labelled rows votes on hits, several hits, dense hits and weak hits, and
fixed patterns vote on insults, shouting, signs and repetition. A generative label model explains the votes of all documents
by a latent class: within a class each voter depends on one other voter (the tree of most mutual information, so copies of
one voter do not count twice), with a yes rate for either vote of that one. EM fits it to counts of vote patterns over the
whole corpus. A linear classifier over the votes, words and beginnings then learns the posterior
labels of a bounded sample, and scores every document; it sees words that no voter knows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_function, remainder, stored, texts
from .quality import labelled_sample

#: The lexicons are drawn from at most FIT_DOCS labelled rows; the classifier learns from about LEARN_DOCS documents.
FIT_DOCS, LEARN_DOCS = 8000, 4000
#: What a lexicon entry must show: the log likelihood ratio of its toxic rows against the number that chance would give.
EVIDENCE = 11
STRONG, WEAK = 10, 3
BEGINNINGS, ENDINGS = (3, 4, 5, 6, 7), (4,)
KINDS = ("w", *(f"^{k}" for k in BEGINNINGS), *(f"${k}" for k in ENDINGS))
VOTES = ("hit", "several", "dense", "weak")
PATTERNS = ("insult", "insults", "shouted", "capitals", "signs", "exclaims", "repeats", "short")
VOTERS = (*(f"{kind} {vote}" for kind in KINDS for vote in VOTES), *PATTERNS)
WORD = re.compile(r"[^\W\d_]+")
#: Common English insults: fixed values, voters that need no labels.
INSULTS = frozenset(("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown"))
SIGNS = "#$%&*"
ROUNDS = 8
#: Features of the classifier: words and their beginnings of some lengths; how many sample documents must hold one; and the
#: weight of their squares in the fit. The votes are features as well.
PARTS = (3, 5)
FEATURE_DOCS = 8
#: Words that a task remembers at a time.
MOST_KNOWN = 150_000
PENALTY = 2e-4


def entries(word: str) -> list[str]:
    """The entry of each kind in a lower-cased word; a beginning or an ending is shorter than the word."""
    return [f"w{word}", *[f"^{k}{word[:k]}" for k in BEGINNINGS if len(word) > k], *[f"${k}{word[-k:]}" for k in ENDINGS if len(word) > k]]


@column_function("array<string>")
def _entries(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([list({e for w in set(WORD.findall(x.lower())) for e in entries(w)}) for x in part])


def lexicon(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> tuple[dict[str, bool], float]:
    """({entry: strong}, rate of label 1 in the sample). Strong: ``STRONG`` times likelier in toxic texts of the sample; the
    others: ``WEAK`` times. All need ``EVIDENCE``. The sample bounds their number."""
    sample = stored(labelled_sample(docs, labels, "toxic", 0, 5, most), "sample")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not toxic or toxic == n:
        return {}, 0.1
    counts = sample.select("label", F.explode(_entries("text")).alias("entry")).groupBy("entry").agg(
        F.sum("label").alias("yes"), F.count("*").alias("all")
    )
    lift = ((F.col("yes") + 0.1) / toxic) / ((F.col("all") - F.col("yes") + 0.1 * (n - toxic) / toxic) / (n - toxic))
    chance = F.col("all") * (toxic / n)
    evidence = F.col("yes") * F.ln(F.col("yes") / chance) - (F.col("yes") - chance)
    found = counts.where("yes > 0").where((lift >= WEAK) & (evidence >= EVIDENCE)).select("entry", (lift >= STRONG).alias("strong"))
    return {r.entry: r.strong for r in found.collect()}, toxic / n


def pieces(word: str) -> list[tuple[int, str]]:
    """(kind, piece) of each entry of a lower-cased word, as ``entries`` spells them."""
    n = len(word)
    return [(0, word), *[(k + 1, word[:m]) for k, m in enumerate(BEGINNINGS) if n > m], *[(len(BEGINNINGS) + 1 + k, word[-m:]) for k, m in enumerate(ENDINGS) if n > m]]


class Known(dict):
    """Of each word as written: its lexicon entries (kind, strong), whether it is an insult, whether it is in capitals,
    whether any of this holds, and the sum and number of its features; emptied when it gets large."""

    def __init__(self, names: dict[str, bool], weights: dict[str, float] | None = None):
        super().__init__()
        self.lexicons: list[dict[str, bool]] = [{} for _ in KINDS]
        for e, strong in names.items():
            kind = "w" if e[0] == "w" else e[:2]
            self.lexicons[KINDS.index(kind)][e[len(kind) :]] = strong
        self.weights = weights

    def __missing__(self, written: str) -> tuple:
        if len(self) > MOST_KNOWN:
            self.clear()
        word, lexicons = written.lower(), self.lexicons
        held = [(kind, lexicons[kind][piece]) for kind, piece in pieces(word) if piece in lexicons[kind]] or ()
        insult, capitals = word in INSULTS, len(word) > 2 and written.isupper()
        total, own = 0.0, 0
        if self.weights is not None:
            for f in features(word):
                total += self.weights.get(f, 0.0)
                own += 1
        out = self[written] = (held, insult, capitals, bool(held) or capitals or insult, total, own)
        return out


def vote(text: str, known: Known) -> tuple[int, float, int]:
    """The votes on a text as bits, in the order of ``VOTERS``, and the sum and number of its distinct words' features."""
    words = WORD.findall(text)
    n = len(words)
    strong, weak, times = [0] * len(KINDS), [0] * len(KINDS), [0] * len(KINDS)
    insults, shouted, capitals, total, size = set(), False, 0, 0.0, 0
    for written, k in Counter(words).items():
        held, insult, loud, any_, value, own = known[written]
        total += value
        size += own
        if not any_:
            continue
        for kind, sure in held:
            if sure:
                strong[kind] += 1
                times[kind] += k
            else:
                weak[kind] += 1
        if insult:
            insults.add(written.lower())
            shouted = shouted or loud
        capitals += loud * k
    bits = []
    for s, w, t in zip(strong, weak, times, strict=True):
        bits += [s > 0, s > 1, t > 1 and t * 200 >= n, w + s > 1 + math.log1p(n) / 2]
    same = bytes(map(eq, words, words[1:]))  # four equal words in a row are three ones
    bits += [
        bool(insults), len(insults) > 1, shouted, capitals * 2 > n > 0,
        sum(map(text.count, SIGNS)) * 5 > n > 0, text.count("!") * 5 > n > 0, b"\1\1\1" in same, n < 20,
    ]
    return sum(b << k for k, b in enumerate(bits)), total, size


def _voting(spark: SparkSession, names: dict[str, bool]):
    """The votes (bits) of a column of texts."""
    sent = spark.sparkContext.broadcast(names)

    @F.pandas_udf("long")
    def look(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Known(sent.value)
        for part in parts:
            yield pd.Series([vote(x, known)[0] for x in part], dtype="int64")

    return look


def votes(docs: DataFrame, names: dict[str, bool]) -> DataFrame:
    """doc_id, votes (bits) of every row."""
    return stored(texts(docs).select("doc_id", _voting(docs.sparkSession, names)("text").alias("votes")), "votes")


def unpacked(patterns: np.ndarray, m: int) -> np.ndarray:
    return ((np.asarray(patterns, np.int64)[:, None] >> np.arange(m)) & 1).astype(float)


@dataclass
class LabelModel:
    """P(class) and, of each voter, the voter it depends on (-1: none) and P(yes | class, vote of that one)."""

    prior: float
    parent: np.ndarray
    rates: np.ndarray  # class, voter, vote of the parent
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # mean within the classes

    def joint(self, v: np.ndarray) -> np.ndarray:
        """log P(votes, class) of rows of votes."""
        before = np.where(self.parent >= 0, v[:, self.parent], 0).astype(int)
        out = np.empty((len(v), 2))
        for c in (0, 1):
            yes = np.where(before == 1, self.rates[c, :, 1], self.rates[c, :, 0])
            out[:, c] = np.log(np.where(v == 1, yes, 1 - yes)).sum(axis=1) + math.log(self.prior if c else 1 - self.prior)
        return out

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(toxic) of vote patterns (bits)."""
        two = self.joint(unpacked(patterns, len(self.parent)))
        return 1 / (1 + np.exp(np.clip(two[:, 0] - two[:, 1], -30, 30)))


def moments(v: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each class (column of ``weights``) the weighted counts of pairs of yes votes; the last row and column is of a vote
    that is always yes, so it holds the single votes and the total."""
    one = np.hstack([v, np.ones((len(v), 1))])
    return np.stack([(one * weights[:, [c]]).T @ one for c in (0, 1)])


def fitted(counts: np.ndarray, smooth: float = 1.0) -> LabelModel:
    """The model of most likelihood for ``moments``: its tree joins the voters of most mutual information in the classes."""
    m = counts.shape[1] - 1
    total = counts[:, -1, -1] + 2 * smooth
    single = (counts[:, :m, -1] + smooth) / total[:, None]
    information, correlation = np.zeros((m, m)), np.zeros((m, m))
    for c in (0, 1):
        p, both = single[c], (counts[c, :m, :m] + 2 * smooth * np.outer(single[c], single[c])) / total[c]
        share = total[c] / total.sum()
        cells = ((both, np.outer(p, p)), (p[:, None] - both, np.outer(p, 1 - p)), (p[None] - both, np.outer(1 - p, p)), (1 - p[:, None] - p[None] + both, np.outer(1 - p, 1 - p)))
        for seen, free in cells:
            seen = np.maximum(seen, 1e-12)
            information += share * seen * np.log(seen / free)
        spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
        correlation += share * (both - np.outer(p, p)) / spread
    parent, inside = np.full(m, -1), np.zeros(m, bool)
    best, by = np.full(m, -np.inf), np.full(m, -1)
    for _ in range(m):  # Prim's tree
        k = int(np.argmax(np.where(inside, -np.inf, np.where(np.isinf(best), -1e9, best))))
        inside[k], parent[k] = True, by[k]
        nearer = ~inside & (information[k] > best)
        best[nearer], by[nearer] = information[k][nearer], k
    rates = np.empty((2, m, 2))
    for c in (0, 1):
        for k in range(m):
            j = parent[k]
            yes, both = (0.0, 0.0) if j < 0 else (counts[c, j, -1], counts[c, j, k])
            rates[c, k, 0] = (counts[c, k, -1] - both + smooth * single[c, k]) / (counts[c, -1, -1] - yes + smooth)
            rates[c, k, 1] = (both + smooth * single[c, k]) / (yes + smooth)
    return LabelModel(float(total[1] / total.sum()), parent, np.clip(rates, 1e-5, 1 - 1e-5), correlation)


def label_model(patterns: DataFrame, rounds: int = ROUNDS, m: int = len(VOTERS)) -> LabelModel:
    """EM over a table of (votes, n, clean, toxic): rows with the pattern, and those among them labelled 0 and 1.

    It starts from the labelled rows. Rows without a label count by their posterior, together as much as the labelled ones
    at most, so that the latent class stays the one that the labels mean, however large the corpus. Without labelled rows of
    both kinds it starts from the insult voters instead. A round is one job, which returns the moments alone.
    """
    known, every = patterns.agg(F.sum("clean") + F.sum("toxic"), F.sum("n")).first()
    known, free = int(known or 0), int(every or 0) - int(known or 0)
    share = min(1.0, known / free) if known and free else 1.0
    first = VOTERS.index("insult")

    def gathered(model: LabelModel | None) -> np.ndarray:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, m + 1, m + 1))
            for b in batches:
                weights = b[["clean", "toxic"]].to_numpy(float)
                rest = (b["n"].to_numpy(float) - weights.sum(axis=1)) * share
                if model is not None:
                    p = model.posterior(b["votes"].to_numpy())
                elif known:
                    p = rest = np.zeros(len(b))
                else:
                    p = np.where(b["votes"].to_numpy() >> first & 1, 0.9, 0.05)
                total += moments(unpacked(b["votes"].to_numpy(), m), weights + np.stack([rest * (1 - p), rest * p], axis=1))
            yield pd.DataFrame({"cell": np.arange(total.size), "x": total.ravel()})

        cells = patterns.mapInPandas(part, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(2 * (m + 1) ** 2)
        for r in cells:
            out[r.cell] = r.x
        return out.reshape(2, m + 1, m + 1)

    model = None
    for _ in range(rounds + 1):
        model = fitted(gathered(model))
    return model


def features(word: str) -> list[str]:
    """The features of a lower-cased word: itself and its beginnings."""
    n = len(word)
    return [word, *["^" + word[:k] for k in PARTS if n > k]]


@column_function("array<string>")
def _features(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([[f for w in dict.fromkeys(WORD.findall(x)) for f in features(w.lower())] for x in part])


def scale_of(n):
    """What a text's features count, with n of them: less in long texts."""
    return np.maximum(n, 1.0) ** -0.5


@dataclass
class Linear:
    """Weights of the words and beginnings, of the votes, and the bias."""

    words: dict[str, float]
    votes: np.ndarray
    bias: float


def fit_linear(rows: list[np.ndarray], names: dict[int, str], sizes: np.ndarray, v: np.ndarray, target: np.ndarray, steps: int = 150) -> Linear:
    """A logistic fit by Adam. A row has features (keys of ``names``, with repeats), their number before any was left out,
    and votes."""
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    used, of = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]), return_inverse=True)
    of = of.astype(np.int32)
    value = scale_of(sizes)[at]
    k = len(used)
    w = np.zeros(k + v.shape[1] + 1)
    w[-1] = -2.0
    penalty = np.append(np.full(k, PENALTY), np.full(v.shape[1] + 1, 1e-5))
    m, s = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        odds = np.bincount(at, w[of] * value, len(rows)) + v @ w[k:-1] + w[-1]
        d = target - 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        g = np.concatenate([np.bincount(of, d[at] * value, k), v.T @ d, [d.sum()]]) / max(1, len(rows)) - penalty * w
        m = 0.9 * m + 0.1 * g
        s = 0.99 * s + 0.01 * g * g
        w += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Linear({names[f]: x for f, x in zip(used.tolist(), w[:k].tolist(), strict=True)}, w[k:-1], float(w[-1]))


@column_function("binary")
def _bytes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([np.sort(np.array([] if x is None else x, np.int64)).tobytes() for x in part])


def train(docs: DataFrame, rows: int, names: dict[str, bool], model: LabelModel, most: int = LEARN_DOCS) -> Linear:
    """The classifier, from the posterior labels of about ``most`` documents outside the held-out fold, taken by a threshold
    on the hash of their ids; ``rows`` is the number of rows of ``docs``. Of several texts of one doc_id the first in order
    counts, so that repeated rows do not break the bound. Features of fewer than ``FEATURE_DOCS`` of them are left out."""
    able = F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0)
    taken = able & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.25 * most / max(1, rows))))
    chosen = texts(docs).where(taken).groupBy("doc_id").agg(F.min("text").alias("text"))
    sample = chosen.select(_voting(docs.sparkSession, names)("text").alias("votes"), _features("text").alias("all"))
    sample = stored(sample.withColumn("row", F.monotonically_increasing_id()), "features")
    one = sample.select("row", F.explode("all").alias("f"))
    often = one.distinct().groupBy("f").count().where(F.col("count") >= FEATURE_DOCS)
    often = stored(often.select("f", F.xxhash64("f").alias("key")), "kept-features")
    kept = one.join(often, "f").groupBy("row").agg(F.collect_list("key").alias("kept"))
    flat = sample.select("row", "votes", F.size("all").alias("n")).join(kept, "row", "left").select("row", "votes", "n", _bytes("kept").alias("kept"))
    learnt = flat.orderBy("row").collect()  # eight bytes a feature come to the driver
    held = [np.frombuffer(r.kept, np.int64) for r in learnt]
    patterns = np.array([r.votes for r in learnt], np.int64)
    sizes = np.array([r.n for r in learnt], float)
    return fit_linear(held, {r.key: r.f for r in often.collect()}, sizes, unpacked(patterns, len(VOTERS)), model.posterior(patterns))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> DataFrame:
    """doc_id, score (P(toxic)), votes, weak_label (the label model's posterior) of every row.

    Labels of rows whose crc32(doc_id as text) mod 5 is 0 are not used. Null and empty texts have no words and get the score
    of the bias alone; a text of any length is worked through whole. Equal texts get equal scores, whatever their doc_id;
    without usable labels the fixed voters alone speak. Extra columns are ignored; an empty table gives an empty table.
    """
    names, _ = lexicon(docs, labels, most)
    seen = votes(docs, names)
    learnt = labels.where((remainder("doc_id", 5) != 0) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("label")
    )
    label = F.col("label")
    patterns = seen.join(learnt, "doc_id", "left").groupBy("votes").agg(
        F.count("*").alias("n"), F.count_if(label == 0).alias("clean"), F.count_if(label == 1).alias("toxic")
    )
    model = label_model(stored(patterns, "patterns"))
    sent = docs.sparkSession.sparkContext.broadcast((train(docs, seen.count(), names, model), model, names))

    @F.pandas_udf("score double, votes long, weak_label double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        linear, told, lexicons = sent.value
        known = Known(lexicons, linear.words)
        for part in parts:
            rows = [vote(x, known) for x in part]
            bits = np.array([r[0] for r in rows], np.int64)
            odds = np.array([r[1] for r in rows]) * scale_of(np.array([r[2] for r in rows], float))
            odds = odds + unpacked(bits, len(VOTERS)) @ linear.votes + linear.bias
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(odds, -30, 30))), "votes": bits, "weak_label": told.posterior(bits)})

    return texts(docs).select("doc_id", score("text").alias("s")).select("doc_id", "s.*")
