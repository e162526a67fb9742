"""A quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad. Its features are its own and those of the lines next to it; the chain ties neighbouring labels.
Forward-backward gives each line's marginal, and the marginals, weighted by line length, make the document's score, which
two numbers calibrate. Labels are known for documents alone, so lines begin with their document's label and are labelled
anew once by the first model (a bad document may hold good lines).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_function, remainder, texts

#: The model is fitted on at most this many labelled rows, those of least hash.
FIT_DOCS = 4000
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>@^~=_+{}[]\\"
STEPS = 150


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line that has a word, its length in words)."""
    rows, sizes = [], []
    before: set[bytes] = set()
    lines: set[bytes] = set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        upper = size - len(line.translate(None, UPPER))
        lower = size - len(line.translate(None, LOWER))
        symbols = (size - len(line.translate(None, SYMBOLS))) / n
        shouts, pipes = line.count(b"!") / n, line.count(b"|") / n
        digits = (size - len(line.translate(None, DIGITS))) / size
        own = set(words)
        same = sum(map(eq, words, words[1:])) / n
        capital = upper / (upper + lower + 1)
        fresh = len(own) / n
        known = len(own & before) / len(own)
        rows.append(
            (
                math.log1p(n),
                min(symbols, 3.0),
                min(shouts, 2.0),
                min(pipes, 2.0),
                digits,
                capital,
                fresh,
                math.log1p(n) * (1 - fresh),
                same,
                known,
                min(size / n, 30.0) / 10,
                float(line in lines),
                float(line.rstrip()[-1:] in (b".", b"!", b"?")),
                float(n < 5),
                float(symbols > 0.3),
                float(shouts > 0.3),
                float(pipes > 0.3),
                float(capital > 0.5),
                float(same > 0.2),
                float(fresh < 0.5 and n > 10),
                float(known > 0.8 and n > 10),
            )
        )
        sizes.append(n)
        before |= own
        lines.add(line)
    width = 21
    return np.array(rows, np.float32).reshape(-1, width), np.array(sizes, np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after it, and whether there are such lines."""
    none = np.zeros((1, x.shape[1]), x.dtype)
    edge = np.zeros((len(x), 3), x.dtype)
    edge[:1, 0] = edge[-1:, 1] = edge[:, 2] = 1
    return np.hstack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none]), edge])


def marginals(node: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chains side by side, node (chains, lines) scores of label 1 (NaN past a chain's end; chains begin at 0):
    (P(label 1) of each line, summed P of each pair of neighbouring labels)."""
    chains, length = node.shape
    real = ~np.isnan(node)
    psi = np.ones((chains, length, 2))
    psi[..., 1] = np.where(real, np.exp(np.clip(node, -30, 30)), 1)
    move = np.exp(trans)
    ahead, back = np.empty_like(psi), np.ones_like(psi)
    ahead[:, 0] = psi[:, 0] / psi[:, 0].sum(1, keepdims=True)
    for k in range(1, length):
        a = (ahead[:, k - 1] @ move) * psi[:, k]
        ahead[:, k] = a / a.sum(1, keepdims=True)
    for k in range(length - 2, -1, -1):
        b = (psi[:, k + 1] * back[:, k + 1]) @ move.T
        back[:, k] = np.where(real[:, k + 1, None], b / b.sum(1, keepdims=True), 1)
    both = ahead * back
    one = both[..., 1] / both.sum(2)
    pairs = ahead[:, :-1, :, None] * move * (psi * back)[:, 1:, None, :]
    pairs /= pairs.sum((2, 3), keepdims=True)
    return one, (pairs * real[:, 1:, None, None]).sum((0, 1))


def _batches(lengths: np.ndarray, cells: int = 1 << 18) -> Iterator[np.ndarray]:
    """Chains of like length together, at most ``cells`` padded lines at a time (or one chain)."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    for k in range(1, len(order) + 1):
        if k == len(order) or (k + 1 - start) * lengths[order[k]] > cells or lengths[order[k]] > 2 * lengths[order[start]] + 8:
            yield order[start:k]
            start = k


def _padded(score: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = starts[chosen, None] + np.arange(lengths[chosen].max())
    real = np.arange(at.shape[1]) < lengths[chosen, None]
    return np.where(real, score[np.where(real, at, 0)], np.nan), at[real]


@dataclass
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    calibration: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.5

    def _score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def lines(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(good) of each line of chains of ``lengths`` (none empty) that stand one after the other in ``x``."""
        score, starts = self._score(x), np.cumsum(lengths) - lengths
        out = np.empty(len(x))
        for chosen in _batches(lengths):
            node, at = _padded(score, starts, lengths, chosen)
            out[at] = marginals(node, self.trans)[0][~np.isnan(node)]
        return out

    def documents(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The uncalibrated log odds of each document; NaN without lines."""
        out = np.full(len(parts), np.nan)
        some = [k for k, (x, _) in enumerate(parts) if len(x)]
        if some:
            lengths = np.array([len(parts[k][0]) for k in some])
            p = self.lines(np.vstack([with_neighbours(parts[k][0]) for k in some]), lengths)
            size = np.concatenate([parts[k][1] for k in some])
            starts = np.cumsum(lengths) - lengths
            mean = np.add.reduceat(p * size, starts) / np.add.reduceat(size, starts)
            out[some] = np.log((mean + 1e-4) / (1 - mean + 1e-4))
        return out

    def scores(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        a, b = self.calibration
        odds = self.documents(parts)
        return np.where(np.isnan(odds), self.prior, 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30))))


def fit(parts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Crf | None:
    """None without labelled rows of both kinds.

    The node weights climb the likelihood of the lines' labels weighted so that both kinds of documents, and all documents
    of a kind, count alike; the four transition weights climb that of unweighted pairs of neighbouring labels, at a fifth of
    the step. The two are not the likelihood of one field; the weights are what tells documents apart best. It runs on the
    driver, over at most ``FIT_DOCS`` documents.
    """
    bare = labels[[not len(x) for x, _ in parts]] if len(labels) else labels
    keep = [k for k, (x, _) in enumerate(parts) if len(x)]
    docs = [parts[k] for k in keep]
    y = labels[keep] if keep else labels[:0]
    if not len(y) or y.min() == y.max():
        return None
    lengths = np.array([len(x) for x, _ in docs])
    x = np.vstack([with_neighbours(x) for x, _ in docs]).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    scale = x.std(0)
    mean = np.where(scale > 1e-6, x.mean(0), 0.0)
    model = Crf(mean, np.where(scale > 1e-6, scale, 1.0), np.zeros(x.shape[1]), np.zeros((2, 2)))
    model.prior = float((bare.sum() + 0.1) / (len(bare) + 1.0)) if len(bare) else 0.1
    z = (x - model.mean) / model.scale
    own = np.repeat(y, lengths).astype(np.float64)
    weight = np.repeat(np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) / lengths, lengths)
    target = own.copy()
    inner = np.ones(len(x), bool)
    inner[starts] = False
    for turn in range(2):
        moments = np.zeros((2, x.shape[1] + 4))
        for step in range(1, STEPS + 1):
            score = z @ model.weights
            p, pairs = np.empty(len(x)), np.zeros((2, 2))
            for chosen in _batches(lengths):
                node, at = _padded(score, starts, lengths, chosen)
                one, two = marginals(node, model.trans)
                p[at] = one[~np.isnan(node)]
                pairs += two
            here = np.flatnonzero(inner)
            t0, t1 = target[here - 1], target[here]
            seen = np.array([[((1 - t0) * (1 - t1)).sum(), ((1 - t0) * t1).sum()], [(t0 * (1 - t1)).sum(), (t0 * t1).sum()]])
            slope = np.append(z.T @ (weight * (target - p)), ((seen - pairs) / max(1, len(here))).ravel() * 0.2)
            slope -= 1e-3 * np.append(model.weights, model.trans.ravel())
            moments[0] = 0.9 * moments[0] + 0.1 * slope
            moments[1] = 0.99 * moments[1] + 0.01 * slope**2
            go = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
            model.weights += go[:-4]
            model.trans = np.clip(model.trans + go[-4:].reshape(2, 2), -2, 2)
        if not turn:
            p = model.lines(x, lengths)
            target = np.where((own == 0) & (p > 0.9), p, own)
    odds = model.documents(docs)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit with two numbers
        q = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        h = q * (1 - q) + 1e-6
        g = np.array([((y - q) * odds).sum() - 0.01 * (a - 1), (y - q).sum()])
        m = np.array([[(h * odds * odds).sum() + 0.01, (h * odds).sum()], [(h * odds).sum(), h.sum()]])
        da, db = np.linalg.solve(m, g)
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    model.calibration = (float(a), float(b))
    return model


@column_function("lines binary")
def _packed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for x in part:
            f, size = line_features(x)
            rows.append(np.hstack([f, size[:, None].astype(np.float32)]).astype(np.float32).tobytes())
        yield pd.DataFrame({"lines": rows})


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, fold: int, mod: int, most: int) -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled rows outside the held-out fold (crc32 of the id mod ``mod``). Of
    several texts of one doc_id the first in order counts, so that repeated rows do not break the bound."""
    chosen = (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", mod) != fold))
        .groupBy("doc_id")
        .agg(F.max(column).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    picked = chosen.select(F.col("doc_id").alias("__id"), "label")
    rows = texts(docs).join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> Crf | None:
    """Fit on the labelled rows whose crc32(doc_id as text) mod 3 is not 1."""
    sample = labelled_sample(docs, labels, "quality", 1, 3, most)
    rows = sample.select("doc_id", "label", _packed("text").alias("p")).select("doc_id", "label", "p.lines").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.lines)))
    flat = [np.frombuffer(r.lines, np.float32).reshape(-1, 22) for r in rows]
    return fit([(x[:, :-1], x[:, -1].astype(np.float64)) for x in flat], np.array([r.label for r in rows], np.int64))


def scored(docs: DataFrame, model: Crf | None, name: str = "score") -> DataFrame:
    """``docs`` with a column of that name: P(quality 1) of the whole text (null: empty).

    Texts without words get the rate of label 1 among such texts in the fit (0.1 if there was none); everything gets 0.5
    if there was nothing to fit. Rows are scored one by one, whatever their doc_id, texts of any length whole; other columns
    pass through, but for one with that name. An empty table gives an empty table.
    """
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = np.empty(len(part))
            for k in range(0, len(part), 500):
                out[k : k + 500] = sent.value.scores([line_features(x) for x in part[k : k + 500]])
            yield pd.Series(out)

    return docs.withColumn(name, score.asNondeterministic()(F.coalesce(F.col("text"), F.lit(""))))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``; repeated rows stay or go together, and so do rows without
    doc_id, by their texts."""
    return scored(docs, train(docs, labels), "__quality").where(F.col("__quality") >= least).drop("__quality")
