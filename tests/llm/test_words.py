"""Phrases, spelling variants and the language model against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow.llm import common, elias, ngrams, phrases, spelling

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["a", "l", "phrase", "word", "n", "id", "near", "key", "score", "shard", "held_out"]


def table(spark, rows):
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in EXTRA}).repartition(5)


def plain_phrases(rows, least, top):
    counts = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                for k in range(len(w) - size + 1):
                    counts[lang or "und"][tuple(w[k : k + size])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        able = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in able.items():
            if len(p) == 2 and any(p in (q[:2], q[1:]) and 2 * b >= a for q, b in able.items() if len(q) == 3):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


@pytest.mark.parametrize("top,first", [(5, 1), (40, 2), (100_000, 2)])
def test_phrases_equal_the_plain_count(spark, monkeypatch, top, first):
    monkeypatch.setattr(phrases, "FIRST", first)  # several waves
    monkeypatch.setattr(phrases, "CHUNK", 500)
    monkeypatch.setattr(phrases, "PART", 50)
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(12)] + ["É", "ß", "x'"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(n))
    rows = [(k, text(rng.randrange(200)) + "Red hot chili " * (k % 4), rng.choice(["en", "de", None, "und"]), "s", 0) for k in range(60)]
    rows += [(1, rows[0][1], "en", None, None), (None, None, None, None, None), (7, "", "fr", "s", 0), (8, " ... \n", "es", "s", 0), (9, text(3000), "en", "s", 0), (9, " " * 300 + "a b" * 50, "en", "s", 0)]
    got = phrases.mine(table(spark, rows), least=4, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 4, top)


def test_phrases_of_an_empty_table(spark):
    assert phrases.mine(table(spark, []).limit(0)).count() == 0


def one_error(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_error(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


@pytest.mark.parametrize("split,bin_rows", [(1 << 15, 4096), (3, 5)])
def test_variants_equal_the_plain_search(spark, monkeypatch, split, bin_rows):
    monkeypatch.setattr(spelling.neighbours, "__defaults__", (bin_rows, split))
    monkeypatch.setattr(spelling, "FLUSH", 50)
    monkeypatch.setattr(spelling, "CELLS", 7)
    rng = random.Random(4)
    made = ["".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 8, 9, 17, 25, 70]))) for _ in range(25)]
    made += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "a" * 300, "a" * 301, "b" + "a" * 300]
    for w in list(made):
        for _ in range(4):
            k = rng.randrange(len(w))
            made.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿ") + w[k:], w[:k] + rng.choice("abÿ") + w[k + 1 :]]))
    rows = []
    for k in range(60):
        words = [w.upper() if rng.random() < 0.1 else w for w in made for _ in range(rng.choice([0, 1, 1]) * (30 if made.index(w) % 7 == 0 else 1))]
        rng.shuffle(words)
        rows.append((k, rng.choice([" ", "-", "\n"]).join(words), "en", "s", 0))
    rows += [(None, "aaaaaa " * 9, None, None, None), (3, None, None, None, None), (4, "", "en", "s", 0), rows[5]]
    got = spelling.variants(table(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    out = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got.collect())
    assert out == plain_variants(rows)
    assert sum(r[1] != "" for r in out) > 20 and any(r[1] and r[1] != r[2] for r in out)


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(table(spark, []).limit(0)).count() == 0


def test_a_group_of_equal_surroundings(spark):
    """All words of one group, more than one word of bits, against every pair."""
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.choice([5, 6]))) for _ in range(300)})
    key, longer = np.array([b"k" * 16] * len(words), "S16"), np.array([len(w) == 6 for w in words])
    q, t = spelling.near_pairs(key, words, longer, np.ones(len(words), bool))
    want = {(a, b) for a in range(len(words)) for b in range(len(words)) if one_error(words[a], words[b]) and not (longer[a] and longer[b])}
    assert set(zip(q.tolist(), t.tolist(), strict=True)) == want


def test_shared_folder_needs_a_shared_place(spark):
    class Context:
        def __init__(self, folder):
            self.getCheckpointDir = lambda: folder

    class Session:
        def __init__(self, folder, conf):
            self.sparkContext = Context(folder)
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, other=None: conf or other)})

    assert common.shared_folder(Session("hdfs://n/ck/1", None)).startswith("hdfs://n/ck/1/corpus-")
    assert common.shared_folder(Session(None, "s3a://b/ck/")).startswith("s3a://b/ck/corpus-")
    assert common.shared_folder(Session("hdfs://set", "s3a://conf")).startswith("hdfs://set/corpus-")
    with pytest.raises(RuntimeError, match="setCheckpointDir"):
        common.shared_folder(Session(None, None))


def test_sequences():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 2**63), (5, 10), (1000, 2000), (3000, 2**64 - 1), (64, 64), (50_000, 2**40)):
        v = np.unique(rng.integers(0, top, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
        s = elias.Sequence.of(v)
        assert (s[np.arange(len(v))] == v).all()
        q = np.concatenate([v, v + np.uint64(1), rng.integers(0, top, 500, dtype=np.uint64)])
        place = {int(x): k for k, x in enumerate(v)}
        assert s.find(q).tolist() == [place.get(int(x), -1) for x in q]
        again = np.sort(np.repeat(v // np.uint64(3), 2))
        assert (elias.Sequence.of(again)[np.arange(len(again))] == again).all()
    codes, levels = elias.quantised(np.linspace(0.1, 1, 5000))
    assert (levels[codes] <= np.linspace(0.1, 1, 5000)).all() and (levels[codes] > np.linspace(0.1, 1, 5000) - 0.01).all()


def plain_scores(rows, order, least, discount):
    """{row: (n_tokens, n_known, N, base, score)} of interpolated absolute discounting, without quantisation."""
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10 == 0 for r in rows]
    text = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")), None] for r in rows]
    f = [Counter() for _ in range(order)]
    for w, h in zip(text, held):
        for size in range(1, order + 1):
            if not h:
                f[size - 1].update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    seen = [f[0], *[{p: n for p, n in f[size].items() if n >= least} for size in range(1, order)]]
    after = defaultdict(list)
    for size in range(1, order):
        for p in seen[size]:
            after[p[:-1]].append(p)
    n, v = sum(f[0].values()), len(f[0])

    def probability(context, w):
        if not context:
            return (f[0][w,] + 0.1) / (n + 0.1 * (v + 1))
        short = probability(context[1:], w)
        if not after[context]:
            return short
        total = f[len(context) - 1][context]
        own = max(0.0, seen[len(context)].get((*context, w), 0) - discount) / total
        return own + (1 - sum(seen[len(context)][p] - discount for p in after[context]) / total) * short

    out = []
    for w in text:
        base = sum(math.log10(probability((), x)) for x in w)
        score = sum(math.log10(probability(tuple(w[max(0, k - order + 1) : k]), x)) for k, x in enumerate(w))
        out.append((len(w), sum(f[0][x,] > 0 for x in w), n, base, score))
    return held, out


@pytest.mark.parametrize("order,shard,chunk", [(3, 1 << 22, 1 << 21), (3, 60, 40), (2, 200, 1000)])
def test_scores_equal_the_plain_model(spark, monkeypatch, order, shard, chunk):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(vocab[min(29, int(rng.expovariate(0.2)))] for _ in range(n))
    rows = [(k, text(rng.randrange(1, 60)) + " The End\tof it " * (k % 3), "en", "s", 0) for k in range(80)]
    rows += [(k, rows[5][1], "en", None, 0) for k in range(100, 105)]
    rows += [(None, None, None, None, None), (None, "a b", None, None, None), (3, "", "en", "s", 0), (4, text(300), "en", "s", 0), (10**9, "new words É alone", "en", "s", 0), rows[7]]

    def run(ngrams):  # the functions that Spark sends take these along
        saved = {k: getattr(ngrams, k) for k in ("SHARD_TOKENS", "CHUNK", "BYTES_A_TOKEN")}
        ngrams.SHARD_TOKENS, ngrams.CHUNK, ngrams.BYTES_A_TOKEN = shard, chunk, 4
        try:
            docs = table(spark, rows)
            held = common.remainder("doc_id", 10) == 0
            model = ngrams.train(docs.where(~held), order)
            return model, ngrams.scored(docs, model).collect()
        finally:
            for k, x in saved.items():
                setattr(ngrams, k, x)

    model, got = run(ngrams)
    _, want = plain_scores(rows, order, ngrams.LEAST, ngrams.DISCOUNT)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], round(r[3], 6))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    want = sorted(((r[0], *w[:2], *w[3:]) for r, w in zip(rows, want)), key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-9)
    assert np.allclose([r[4] for r in got], [r[4] for r in want], rtol=0.004)
    assert all(a[4] <= b[4] + 1e-6 for a, b in zip(got, want))  # quantised downwards
    assert sum(r[4] > r[3] for r in got) > 0.8 * len(got)


def test_scores_of_odd_tables(spark):
    out = ngrams.perplexities(table(spark, [(1, "a b", "en", "s", 0), (1, "a b", "en", "s", 0), (None, None, None, None, None)]))
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = out.collect()
    assert len(rows) == 3 and len({r.score for r in rows if r.doc_id == 1}) == 1 and {r.train_tokens for r in rows} == {6}
    assert ngrams.perplexities(table(spark, []).limit(0)).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    alone = ngrams.perplexities(table(spark, [(held, "a b", "en", "s", 0)])).first()
    assert (alone.train_tokens, alone.n_known, alone.base_score, alone.score) == (0, 0, 0.0, 0.0)
