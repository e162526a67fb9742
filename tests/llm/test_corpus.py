import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_helpers import fingerprint, shingle_set, words

from pitchflow.llm import chat, components, decontam, lines, mixing, quality, rules, simhash, substring, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = []
    shared = [words(rng, 12) for _ in range(4)]
    for k in range(120):
        parts = [words(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 6))]
        if k % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), shared[k % 4].upper() if k % 2 else f"  {shared[k % 4]}\t")
        rows.append((k, "\n".join(parts), "en", f"s{k % 3}", 0))
    rows += [(200 + k, rows[k][1], "en", "s0", 0) for k in range(10)]
    rows += [(300 + k, rows[k][1] + " w1", "en", None, 0) for k in range(10)]
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, "\n \n", "en", "s1", 0), (403, words(rng, 30000), "en", "s1", 0), (404, "one two", "en", "s2", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    extra = ["key", "fp", "n", "slot", "h1", "line", "score", "label", "gone", "file"]
    return spark.createDataFrame(corpus, DOC).withColumns({c: F.lit("x") for c in extra}).repartition(5).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column and repeated rows."""
    rows = [(None, None, None, None, None), (None, "a b c d e f", None, None, None), (1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1)]
    return spark.createDataFrame(rows, DOC)


def classes(ids, linked):
    """The smallest id that each id is tied to."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(ids), 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_brute_force(docs, corpus):
    fp = {r[0]: fingerprint(r[1]) for r in corpus}
    root = classes(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fps[0] % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fp[i], root[i]) for i in fp}
    assert {r.doc_id for r in simhash.keep_first(docs, words=3, bits=2).collect()} == {i for i in fp if root[i] == i}


def test_simhash_similarity(spark):
    rng = random.Random(21)
    rows = []
    for k in range(60):
        base = words(rng, rng.randrange(1, 200), 5000).split()
        for _ in range(4):
            text = [w if rng.random() > 0.01 else "x" for w in base]
            rows.append((len(rows), " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, rows[5][1]), (None, rows[9][1])]
    sets = {i: {tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} if (t := (x or "").split()) else set() for i, x in rows if i is not None}
    alike = lambda a, b: len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])
    root = classes(sets, alike)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.NEAR).collect()}
    assert got.pop(None) == got[9]
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if alike(a, b)]
    assert all(root[i] == root[c] for i, c in got.items())  # no class holds texts that are not alike
    assert sum(got[a] == got[b] for a, b in pairs) > 0.6 * len(pairs) > 60
    assert got[1001] == got[1002] == 1000 and got[1003] == got[5]


def test_gray_tree_and_links(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    one = lambda: np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [base[:40] ^ one() ^ one() for _ in range(12)]))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
    for bits in (2, 6):
        tree = simhash.GrayTree(codes)
        a, b = tree.links(bits)
        i, j = np.nonzero(np.triu(apart <= bits, 1))
        roots = simhash._roots(len(codes), i, j)
        assert (apart[a, b] <= bits).all() and (simhash._roots(len(codes), a, b) == roots).all()
        assert len(a) == len(codes) - len(set(roots.tolist()))  # a forest
        assert tree.visited > 1000  # nodes carry the search
        if bits == 2:
            assert tree.compared < 0.5 * len(codes) ** 2 / 2
        rows = [([int(c.astype(np.int64))], k, 0) for k, c in enumerate(codes)]
        fps = spark.createDataFrame(rows, "fps array<long>, rep long, text_hash long")
        found = {r.node: r.root for r in components.components(simhash.links(fps, bits)).collect()}
        assert found == {k: r for k, r in enumerate(roots.tolist()) if r != k}


def test_hot_node_is_cut_finer(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**20, 300, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))]))
    rows = [([int(c.astype(np.int64))], k, 0) for k, c in enumerate(codes)]
    found = simhash.links(spark.createDataFrame(rows, "fps array<long>, rep long, text_hash long"))
    i, j = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2, 1))
    want = simhash._roots(len(codes), i, j).tolist()
    assert {r.node: r.root for r in components.components(found).collect()} == {k: r for k, r in enumerate(want) if r != k}


def test_line_dedup_brute_force(docs, corpus):
    strip = " \t\n\v\f\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(low)
    holders = defaultdict(set)
    for i, text, *_ in corpus:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    want = {}
    for i, text, *_ in corpus:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        want[i] = ("\n".join(kept), len(all_lines), len(all_lines) - len(kept))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(docs).collect()}
    assert got == want
    assert sum(w[2] for w in want.values()) > 20


def _held(index):
    rows = index.current().where("refs > 0").collect()
    return sorted((r.k1, r.k2, r.refs, r.last_doc) for r in rows)


def _passes(index):
    """The keys that the filters let pass."""
    return {(r.k1, r.k2) for r in index.candidates().collect()}


def test_line_index_is_reversible(docs, monkeypatch):
    monkeypatch.setattr(lines, "LOG", 3)
    monkeypatch.setattr(lines, "SHARD_KEYS", 16)
    first, second = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    one = lines.LineIndex.build(first)
    both, whole = one.insert(second), lines.LineIndex.build(docs)
    assert _held(both) == _held(whole) and len(both.counts) == 2 and len(both.postings) == 2
    assert _held(both.insert(second)) == _held(both)  # a document twice counts once
    common = {(r.k1, r.k2) for r in whole.common().collect()}
    assert common and common <= _passes(both) and len(_passes(both)) < 2 * len(common) + 10
    back = both.delete(second.select("doc_id"))
    assert _held(back) == _held(one) and {(r.k1, r.k2) for r in one.common().collect()} <= _passes(back)
    assert len(_passes(back)) < 2 * one.common().count() + 10
    again = back.insert(second)
    assert len(again.counts) == 1 and _held(again) == _held(whole)  # the logs were written anew
    want = sorted((r.doc_id, r.text) for r in lines.dedup_lines(docs).collect())
    assert sorted((r.doc_id, r.text) for r in lines.dedup_lines(docs, again).collect()) == want


def test_line_filters_change_by_shard(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 8)
    monkeypatch.setattr(lines, "FILTER_BYTES", 100)  # several blocks
    line = lambda k: f"line {k} " + "x" * 40
    rows = [(d, "\n".join(line(k) for k in range(40))) for d in range(5)]
    index = lines.LineIndex.build(spark.createDataFrame(rows, "doc_id long, text string"))
    assert index.shards == 5 and len(_passes(index)) == 40
    more = index.insert(spark.createDataFrame([(d, line(99)) for d in range(10, 15)], "doc_id long, text string"))
    before, after = ({r.shard: bytes(r.data) for r in x.filters.collect()} for x in (index, more))
    assert sum(before[s] != after[s] for s in before) == 1 and len(_passes(more)) == 41
    less = more.delete(spark.createDataFrame([(0,), (None,)], "doc_id long"))
    assert len(_passes(less)) == 1 and less.common().count() == 1


def test_line_dedup_repeated_and_null_ids(spark):
    line = "a line that is long enough to be counted as one"
    rows = [(1, line)] * 4 + [(9, line), (None, line), (None, f"{line}\nmore"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x"))
    assert all(r.n_dropped == 0 for r in lines.dedup_lines(df).collect())  # two documents
    more = df.unionByName(spark.createDataFrame([(k, line, "") for k in (2, 3, 4)], "doc_id long, text string, n_lines string"))
    out = lines.dedup_lines(more).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in out) == [(0, 0), (0, 1), (0, 1)] + [(1, 1)] * 4 + [(2, 1), (3, 1), (4, 1), (9, 0)]
    assert {r.text for r in out} == {"", "more", line}


def test_cuckoo_filter():
    keys = np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    f = lines.filter_of(keys)
    assert f.lookup(keys).all()
    f.delete(keys[:2500])
    assert f.lookup(keys[2500:]).all()
    assert f.lookup(keys[:2500]).mean() < 0.05
    assert lines.CuckooFilter.loads(f.dumps()).lookup(keys[2500:]).all()


def test_containment_brute_force(spark, docs, corpus):
    rng = random.Random(9)
    items = []
    for k in range(40):
        source = (corpus[k][1] if k % 4 else corpus[-2][1]).split()
        n = rng.randrange(6, 40)
        part = source[:n]
        if k % 3 == 0 and len(part) > 12:
            part[0] = "changed"
        items.append((k, " ".join(part)))
    items += [(90, None), (91, ""), (92, "one two"), (93, " ".join(corpus[7][1].split()[:3])), (94, corpus[2][1].split()[1]), (95, "w1 w2 w3 w4")]
    want = {}
    for k, text in items:
        tokens = (text or "").lower().split()
        n = min(5, len(tokens))
        s = {tuple(tokens[j : j + n]) for j in range(len(tokens) - n + 1)} if n else set()
        for i, body, *_ in corpus:
            d = (body or "").lower().split()
            both = s & {tuple(d[j : j + n]) for j in range(len(d) - n + 1)}
            if s and len(both) * 5 >= 4 * len(s):
                want[i, k] = (len(s), len(both))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("width", "item", "hash", "doc_id")})
    for block in (decontam.BLOCK, 10):  # broadcast, and as a table
        got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in decontam.contained(docs, bench, block=block).collect()}
        assert got == want
    assert len(want) > 30


def test_substring_passages(spark):
    rng = random.Random(4)
    sentence = lambda: words(rng, rng.randrange(6, 14), 3000).capitalize() + "."
    passage = " ".join(sentence() for _ in range(7))
    rows = [(k, " ".join(sentence() for _ in range(5)) + "\n" + (passage + " " if k in (3, 5, 8) else "") + " ".join(sentence() for _ in range(4))) for k in range(10)]
    out = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in out.items() if r.n_removed} == {5, 8}
    texts = dict(rows)
    for i, r in out.items():
        if i in (5, 8):
            assert [s.of_doc for s in r.spans] == [3]
            assert passage[:60] not in r.text and r.n_removed >= 5
            assert r.text.split("\n")[0] == texts[i].split("\n")[0]
        else:
            assert r.text == texts[i]


def test_substring_brute_force(spark):
    rng = random.Random(8)
    sentence = lambda n: words(rng, n, 5000).capitalize() + "."
    pool = [[sentence(n) for n in lengths] for lengths in ((20, 6, 6, 6), (6, 6, 6, 20), (24, 1, 1, 1, 1, 30), (10, 9), (30, 4, 4), (8, 8, 8, 8, 8, 8, 8))]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            passage = rng.choice(pool)
            parts += passage[rng.randrange(2) : len(passage) - rng.randrange(2)]
            parts += [sentence(rng.randrange(1, 16)) for _ in range(rng.randrange(3))]
        rows.append((k, " ".join(parts)))
    rows += [(100, "One two."), (101, "One two."), (102, "One two. Three."), (103, ""), (104, None), (105, None), (106, sentence(30)[:-1]), (107, rows[0][1] + " " + rows[0][1])]
    units = {i: substring.sentences(x or "") for i, x in rows}
    big = lambda u, a, b: b - a >= 2 and sum(p[2] for p in u[a:b]) >= 25
    first, runs = {}, []
    for i, u in sorted(units.items()):
        found = [(a, b) for a in range(len(u)) for b in range(a + 1, len(u) + 1) if big(u, a, b)]
        for a, b in found or ([(0, len(u))] if u else []):
            key = tuple(p[3] for p in u[a:b])
            runs.append((i, a, b, first.setdefault(key, (i, a))))
    want = {i: {s for j, a, b, head in runs if j == i and head != (i, a) for s in range(a, b)} for i, _ in rows}
    out = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    got = {r.doc_id: {s for x in r.spans or [] for s in range(x["first"], x["last"] + 1)} for r in out}
    assert got == want
    assert got[101] == {0} and not got[102] and sum(map(len, want.values())) > 200


def test_substring_whole_passage(spark):
    rng = random.Random(4)
    sentence = lambda n: words(rng, n, 3000).capitalize() + "."
    passage = " ".join(sentence(n) for n in (6, 6, 9, 20, 6, 6, 6))
    rows = [(k, f"{sentence(9)} {sentence(12)} {passage} {sentence(11)} {sentence(8)}") for k in range(3)]
    out = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[k].n_removed for k in range(3)] == [0, 7, 7]
    assert all(passage.split(". ")[-1] not in out[k].text for k in (1, 2))


def test_substring_repeated_ids_and_edges(spark):
    rng = random.Random(14)
    sentence = lambda n: words(rng, n, 3000).capitalize() + "."
    passage = " ".join(sentence(n) for n in (9, 8, 7, 10))
    long = " ".join(sentence(12) for _ in range(6000))
    rows = [
        (1, sentence(9) + " " + passage), (1, passage), (1, "Short one."), (2, f"{sentence(7)} {passage}"), (None, passage), (None, None),
        (2**63 - 1, "Short one."), (3, ""), (4, long), (5, f"{long} {sentence(5)}"), (6, long), (6, long),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("spans", "n_words", "first", "of_doc", "text_hash")})
    out = substring.dedup_substrings(df).collect()
    assert len(out) == len(rows)
    kept = Counter((r.doc_id, r.n_removed) for r in out)
    first = substring.dedup_substrings(df.where("doc_id = 1")).collect()
    assert sum(r.n_removed for r in first) == 4  # one of the two texts of document 1 keeps the passage
    assert kept[2, 4] == 1 and kept[None, 4] == 1 and kept[None, 0] == 1 and kept[3, 0] == 1
    assert kept[2**63 - 1, 1] == 1 and kept[4, 0] == 1 and kept[5, 6000] == 1 and kept[6, 6000] == 2
    assert sorted(r.doc_id or 0 for r in substring.dedup_substrings(df, changed_only=True).collect()) == sorted(i or 0 for (i, n), k in kept.items() if n for _ in range(k))
    assert all(r.first == "x" for r in out)


def base_rules(text):
    data = text or ""
    tokens = data.encode().split()
    windows = Counter(tuple(tokens[k : k + 5]) for k in range(len(tokens) - 4))
    hit = {k + j for k in range(len(tokens) - 4) if windows[tuple(tokens[k : k + 5])] > 1 for j in range(5)}
    rows = [x for x in data.split("\n") if x.encode().split()]
    return len(tokens), sum(len(t.decode()) for t in tokens), sum(data.count(c) for c in "#*$%&|<>"), len(rows) - len(set(rows)), len(hit)


def test_quality_rules(spark, docs, corpus):
    got = {r.doc_id: (tuple(r[c] for c in rules.COLUMNS), r.base_failed, r.kept) for r in rules.judge(docs).collect()}
    for i, text, *_ in corpus:
        want = base_rules(text)
        assert got[i][0] == want
        assert got[i][1] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    rng = random.Random(3)
    banner = words(rng, 20)
    rows = [(k, f"{banner}\n{words(rng, 4)}" if k < 8 else f"{banner}\n{words(rng, 60)}", "en", "h", 0) for k in range(30)]
    rows += [(99, f"{banner}\n{words(rng, 4)}", "en", "other", 0)]
    got = {r.doc_id: r.kept for r in rules.judge(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {k: k >= 8 for k in [*range(30), 99]}


def test_quality_rules_hot_host(spark):
    rng = random.Random(13)
    banner = words(rng, 20)
    texts = [f"{banner}\n{words(rng, 4)}" if k < 8 else words(rng, 60, 5000) for k in range(1200)]
    rows = [(k, t, "en", "hot", 0) for k, t in enumerate(texts)] + [(2000 + k, t, "en", "small", 0) for k, t in enumerate(texts[:30])]
    rows += [(3000 + k, texts[0], "en", f"rare{k % 2}", 0) for k in range(8)]
    got = {r.doc_id: r.kept for r in rules.judge(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {i: i % 1000 >= 8 or i >= 3000 for i, *_ in rows if i < 1000 or i >= 2000} | {i: True for i in range(1000, 1200)}


def test_quality_rules_count_documents(spark):
    rng = random.Random(17)
    banner = words(rng, 20)
    text = f"{banner}\n{words(rng, 2)}"
    rows = [(1, text, "en", "h", 0)] * 7 + [(2, text, "en", "h", 0), (None, text, "en", "h", 0), (None, None, None, None, None)]
    got = rules.judge(spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("row", "line", "of", "kept")})).collect()
    assert len(got) == 10 and all(r.kept for r in got if r.n_words)  # two documents hold the line
    rows += [(k, text, "en", "h", 0) for k in (3, 4, 5)]
    assert not any(r.kept for r in rules.judge(spark.createDataFrame(rows, DOC)).collect())
    long = rules.judge(spark.createDataFrame([(1, words(rng, 200000, 10**6), "en", "h", 0)], DOC)).first()
    assert long.n_words == 200000 and long.kept


def test_mixing_deviation(spark):
    rows = [(k, "t", "en", "a" if k % 10 else "b" if k % 20 else None, 0) for k in range(4000)]
    weights = spark.createDataFrame([("a", 5), ("b", 3), (None, 2)], "source string, w long")
    out = mixing.mix(spark.createDataFrame(rows, DOC).withColumn("slot", F.lit(1)), weights, block=4)
    assert "slot" in out.columns
    got = sorted((r.mix_slot, r.source) for r in out.select("mix_slot", "source").distinct().collect())
    assert out.count() == 4000 and out.select("mix_position").distinct().count() == 4000
    seen, share = Counter(), {"a": 0.5, "b": 0.3, None: 0.2}
    for t, (slot, source) in enumerate(got[:100], 1):
        assert slot == t - 1
        seen[source] += 1
        assert all(abs(seen[s] - w * t) < 1 for s, w in share.items())


def test_mixing_edges(spark):
    rows = [("x", "a", "t"), ("x", "a", "t"), (None, "a", "u"), (None, None, None), ("y", "b", ""), ("z", "c", "v" * 100000)]
    df = spark.createDataFrame(rows, "doc_id string, source string, text string").withColumns({c: F.lit("x") for c in ("w", "mix_slot")})
    weights = spark.createDataFrame([("a", 1), ("a", 2), ("b", 0), (None, 1), ("c", None), ("d", 3)], "source string, w long")
    out = mixing.mix(df, weights, block=1).collect()
    assert len(out) == 6 and {r.source for r in out if r.mix_position is None} == {"b", "c"}
    assert {(r.source, r.mix_weight, r.mix_period) for r in out if r.mix_position is not None} == {("a", 3, 7), (None, 1, 7)}
    places = [r.mix_position for r in out if r.mix_position is not None]
    assert len(set(places)) == 4
    assert mixing.mix(df.where("false"), weights).count() == 0 and mixing.mix(df, weights.where("false")).count() == 6
    large = mixing.mix(df, spark.createDataFrame([("a", 10**9), (None, 10**9 - 1)], "source string, w long"), block=1)
    assert sorted(r.mix_position for r in large.collect() if r.mix_position is not None) == [0, 1, 2, 4]


def pfair(weights, slots):
    """[(source, nth)] by the rule itself, one source after the other."""
    order = sorted(weights, key=lambda s: (-weights[s], s))
    period, done, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(slots):
        able = [s for s in order if done[s] < weights[s] and done[s] * period // weights[s] <= t]
        best = min(able, key=lambda s: (-(-(done[s] + 1) * period // weights[s]), order.index(s)))
        out.append((best, done[best]))
        done[best] += 1
    return out


def test_schedule_equals_the_rule(spark, monkeypatch):
    rng = random.Random(2)
    for piece in (1 << 13, 7):
        monkeypatch.setattr(mixing, "PIECE", piece)
        weights = {f"s{k:02d}": rng.choice([1, 1, 2, 3, 5, 5, 9, 13]) for k in range(20)}
        got = mixing.schedule(spark.createDataFrame(list(weights.items()), "source string, w long")).collect()
        want = pfair(weights, sum(weights.values()))
        assert [(r.source, r.nth) for r in sorted(got, key=lambda r: r.slot)] == want
        seen, period = Counter(), sum(weights.values())
        for t, (s, _) in enumerate(want, 1):
            seen[s] += 1
            assert all(abs(seen[x] * period - w * t) < period for x, w in weights.items())


def test_mixing_of_many_sources_and_of_ids_in_step(spark):
    rows = spark.range(140_000).selectExpr("id * 1024 as doc_id", "cast(id % 70000 as string) as source", "'t' as text")
    out = mixing.mix(rows)
    r = out.agg(F.count("mix_position"), F.count_distinct("mix_position"), F.max("mix_period"), F.count_distinct("source")).first()
    assert tuple(r) == (140_000, 140_000, 70_000, 70_000)
    buckets = rows.groupBy(mixing.bucket_of().alias("b")).count().agg(F.count("*"), F.max("count")).first()
    assert buckets[0] > 16_000 and buckets[1] < 40


def test_a_hot_id_brings_one_row_to_the_toxicity_fit(spark, monkeypatch):
    """However many rows an id has, the classifier takes one text of it."""
    rng, seen = random.Random(1), []
    rows = [(7, words(rng, 30), "en", "s", 0) for _ in range(600)] + [(k, words(rng, 30) + (" idiot" if k % 5 == 0 else ""), "en", "s", 0) for k in range(100, 300)]
    df = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(100, 300)], "doc_id long, quality int, toxic int")
    fit = toxicity.fit_linear
    monkeypatch.setattr(toxicity, "fit_linear", lambda rows_, *more: seen.append(len(rows_)) or fit(rows_, *more))
    assert toxicity.toxicity(df, labels).count() == 800
    assert seen == [len({r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5})]


def test_chat_round_trip(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "\\", "a\\|b<|", "", None, "x\ny", "<\\|", "é😀"]
    rows = [(k // 3, k % 3, ("user", "assistant", "user\n<|")[k % 3], t) for k, t in enumerate(hard * 2)] + [(None, 0, None, "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"said": F.lit(1), "part": F.lit(2)})
    got = {r.conv_id: r for r in chat.read_back(chat.segments(df)).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t, role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert not got[c].valid
    good = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.segments(good)).first().valid


def test_warc_round_trip(spark):
    rng = random.Random(8)
    big = [words(rng, 300) for _ in range(5)]
    rows = [(k, f"http://h/{k}", big[k % 5] if k % 3 else words(rng, 200 + k) if k % 2 else "small") for k in range(100)] + [(200, None, None), (None, "http://n", "x"), (7, "http://h/7", big[2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(0))
    folders = [warc.write_archives(p, roll_bytes=4000) for p in (pages.repartition(3), pages.repartition(7))]
    sums = [[hashlib.sha256(bytes(r.content)).hexdigest() for r in spark.read.format("binaryFile").load(f"{f}/archives").orderBy("file").collect()] for f in folders]
    assert sums[0] == sums[1] and len(sums[0]) > 3
    got = sorted((r.page_id if r.page_id is not None else -1, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in warc.digests(warc.read_archives(spark, folders[0])).collect())
    heads = {}
    for k, _, html in rows:
        if len(html or "") >= 1000:
            heads[html] = max(heads.get(html, -1), k)
    want = []
    for k, _, html in rows:
        data = (html or "").encode()
        to = heads.get(html) if heads.get(html) != k else None
        want.append((k if k is not None else -1, hashlib.sha1(data).hexdigest(), len(data), "revisit" if to is not None else "response", to))
    assert got == sorted(want)


def test_crf_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    node, trans = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    node[1, 3:] = np.nan
    one, pairs = quality.marginals(node, trans)
    total = np.zeros((2, 2))
    for c in range(3):
        n = int((~np.isnan(node[c])).sum())
        w = {y: np.exp(sum(node[c, k] * y[k] for k in range(n)) + sum(trans[y[k - 1], y[k]] for k in range(1, n))) for y in itertools.product((0, 1), repeat=n)}
        z = sum(w.values())
        assert np.allclose(one[c, :n], [sum(v for y, v in w.items() if y[k]) / z for k in range(n)])
        for k in range(1, n):
            for y, v in w.items():
                total[y[k - 1], y[k]] += v / z
    assert np.allclose(pairs, total)


def test_label_model_by_enumeration():
    rng = np.random.default_rng(4)
    m, every = 5, np.arange(32)
    v = toxicity.unpacked(every, m)
    rates = rng.uniform(0.05, 0.95, (2, m, 2))
    model = toxicity.LabelModel(0.3, np.array([-1, 0, 0, 1, 3]), rates)
    joint = np.exp(model.joint(v))
    assert np.isclose(joint.sum(), 1)
    for k in (0, 7, 21, 30):
        p = [1.0, 1.0]
        for c in (0, 1):
            p[c] *= (0.7, 0.3)[c]
            for i, j in enumerate(model.parent):
                yes = rates[c, i, int(v[k, j]) if j >= 0 else 0]
                p[c] *= yes if v[k, i] else 1 - yes
        assert np.isclose(model.posterior(np.array([k]))[0], p[1] / sum(p))
    # the most likely tree model of the model's own distribution is the model
    learnt = toxicity.fitted(toxicity.moments(v, joint * 1e7))
    assert np.allclose(np.exp(learnt.joint(v)), joint, atol=1e-4)


def test_label_model_recovers_accuracies(spark):
    rng = np.random.default_rng(5)
    n, names = 40000, toxicity.VOTERS
    truth = rng.random(n) < 0.2
    votes = np.zeros((n, len(names)), bool)
    votes[:, 0] = np.where(truth, rng.random(n) < 0.8, rng.random(n) < 0.05)
    votes[:, 1] = np.where(rng.random(n) < 0.98, votes[:, 0], ~votes[:, 0])  # a copy of the first voter
    for k in range(2, 7):
        votes[:, k] = np.where(truth, rng.random(n) < 0.6, rng.random(n) < 0.1)
    bits = (votes.astype(np.int64) << np.arange(len(names))).sum(axis=1)
    gold = np.arange(n) < 4000
    rows = defaultdict(lambda: [0, 0, 0])
    for b, t, g in zip(bits.tolist(), truth.tolist(), gold.tolist()):
        rows[b][0] += 1
        rows[b][1 + t] += g
    table = spark.createDataFrame([(b, *x) for b, x in rows.items()], "votes long, n long, clean long, toxic long").repartition(3)
    model = toxicity.label_model(table)
    assert abs(model.prior - 0.2) < 0.03
    assert model.correlation[0, 1] > 0.8 and abs(model.correlation[2, 3]) < 0.1
    assert 1 in (model.parent[0], *np.flatnonzero(model.parent == 0))  # the copy depends on its twin
    p = model.posterior(bits)
    twice = votes[:, 0] & votes[:, 1] & ~votes[:, 2:].any(axis=1)
    want = truth[twice].mean()
    assert abs(p[twice].mean() - want) < 0.05  # two copies of one voter count once
    blind = toxicity.label_model(table.withColumns({"clean": F.lit(0), "toxic": F.lit(0)}))
    assert 0 <= blind.prior <= 1 and np.isfinite(blind.posterior(bits)).all()


def test_toxicity_edges(spark):
    rows = [(1, None), (1, ""), (None, "IDIOT idiot"), (2, "w " * 200000 + "moron"), (3, "moron scum trash"), (3, "moron scum trash")]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(3)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("votes", "label", "score", "row", "n")})
    for truth in (labels, labels.where("false")):
        out = toxicity.toxicity(docs, truth).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id == 3}) == 1 == len({r.score for r in out if r.doc_id == 1})
        assert next(r for r in out if r.doc_id is None).votes >> toxicity.VOTERS.index("insult") & 1
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_classifiers_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        bad, mean = k % 5 == 0, k % 7 == 0
        body = [words(rng, 12) for _ in range(4)]
        if mean:
            body[2] += " moron scum"
        rows.append((k, "\n".join(x.upper().replace(" ", "!! ") if bad else x for x in body)))
        labels.append((k, int(not bad), int(mean)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = {r.doc_id: r.score for r in quality.scored(docs, quality.train(docs, truth)).collect()}
    toxic = {r.doc_id: r.score for r in toxicity.toxicity(docs, truth).collect()}
    assert np.mean([(good[k] >= 0.5) == q for k, q, _ in labels]) > 0.97
    assert np.mean([(toxic[k] >= 0.5) == t for k, _, t in labels]) > 0.97
    assert all(0 <= x <= 1 for x in [*good.values(), *toxic.values()])


def test_odd_and_empty_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    none = odd.where("false")
    for df, n in ((odd, 4), (none, 0)):
        assert rules.judge(df).count() == n
        assert quality.scored(df, quality.train(df, labels)).count() == n
        assert simhash.near_duplicates(df).count() == n
        assert lines.dedup_lines(df).count() == n
        assert substring.dedup_substrings(df).count() == n
        assert mixing.mix(df).count() == n
        assert decontam.contained(df, bench).count() == (3 if n else 0)
        assert decontam.contained(df, bench, block=-1).count() == (3 if n else 0)
        assert decontam.contained(df, bench.where("false")).count() == 0
        assert decontam.decontaminate(df, bench).count() == 0
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.segments(talk)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(pages)).count() == 0
    assert len(decontam.sketch(np.arange(16, dtype=np.uint64))) == 7


def test_warc_copies_roll_and_long_pages(spark):
    rng = random.Random(31)
    same, long = words(rng, 400, 5000), words(rng, 300000, 10**6)
    rows = [(None, None, None)] * 300 + [(5, "http://a", same)] * 200 + [(6, "http://b", same)] * 50 + [(7, None, long), (8, "http://c", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("file", "n", "digest", "copies")})
    folder = warc.write_archives(pages.repartition(4), roll_bytes=5000)
    files = {r.file: r.length for r in spark.read.format("binaryFile").load(f"{folder}/archives").select("file", "length").collect()}
    largest = len(warc.record(7, None, long.encode(), hashlib.sha1(long.encode()).hexdigest()))
    assert len(files) > 50 and sorted(files.values())[-2] < 8000 and max(files.values()) < largest + 8000
    told = spark.read.json(f"{folder}/manifest").agg(F.sum("n_records"), F.count("*")).first()
    assert tuple(told) == (len(rows), len(files))
    read = warc.digests(warc.read_archives(spark, folder))
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in read.collect())
    want = Counter({(None, 0, "response", None): 300, (5, len(same), "revisit", 6): 200, (6, len(same), "response", None): 50, (7, len(long), "response", None): 1, (8, 0, "response", None): 1})
    assert got == want


def test_warc_revisit_of_page_with_two_payloads(spark):
    one, two = "<p>" + "a" * 3000, "<p>" + "b" * 2000
    rows = [(9, "http://x/9a", one), (9, "http://x/9b", two), (1, "http://x/1", one), (2, "http://x/2", two)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = warc.digests(warc.read_archives(spark, warc.write_archives(pages))).collect()
    want = sorted((u, len(h), hashlib.sha1(h.encode()).hexdigest()) for _, u, h in rows)
    assert sorted((r.url, r.payload_bytes, r.payload_digest) for r in read) == want
    assert {r.url: r.refers_to for r in read if r.record_type == "revisit"} == {"http://x/1": 9, "http://x/2": 9}
