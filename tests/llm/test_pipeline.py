import itertools
import random
from collections import defaultdict

import corpus_pipeline
from pitchflow.llm import quality

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_run_against_brute_force(spark, tmp_path):
    from tests_llm_helpers import shingle_set, words

    rng = random.Random(11)
    shared = words(rng, 14)
    items = [(k, words(rng, 20)) for k in range(5)]
    rows, labels = [], []
    for k in range(300):
        bad = k % 6 == 0
        body = [words(rng, rng.randrange(8, 20)) for _ in range(3)]
        if k % 10 == 3:
            body.insert(1, shared)
        if k % 25 == 7:
            body.append(items[k % 5][1])
        text = "\n".join(x.upper().replace(" ", "!! ") if bad else x for x in body)
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
        labels.append((k, int(not bad), 0))
    rows += [(1000 + k, rows[k][1], "en", "s1", rows[k][4]) for k in range(20)]
    for name, data, kind in (("documents", rows, DOC), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = quality.scored(docs, quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()
    texts = {r.doc_id: r.text for r in scores if r.score >= 0.5}
    assert len(texts) < len(rows) * 0.9
    holders = defaultdict(set)
    for i, t in texts.items():
        for x in t.split("\n"):
            if len(x.strip()) >= 40:
                holders[x.strip().lower()].add(i)
    gone = lambda i, x: len(holders[x.strip().lower()]) >= 5 and max(holders[x.strip().lower()]) != i
    texts = {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in texts.items()}
    root = {i: i for i in texts}
    for _ in range(3):
        for a, b in itertools.combinations(sorted(texts), 2):
            if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    wanted = [shingle_set(t) for _, t in items]
    keep = {i: t for i, t in texts.items() if root[i] == i and not any(5 * len(s & shingle_set(t)) >= 4 * len(s) for s in wanted)}
    assert {r.doc_id: r.text for r in got} == keep
    assert all(r.n_chars == len(r.text) for r in got)
    places = [r.mix_position for r in got]
    assert places == sorted(places) and len(set(places)) == len(places)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns, and no rows at all."""
    from tests_llm_helpers import words

    rng = random.Random(3)
    text, long = words(rng, 40), words(rng, 100000, 10**6)
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, text, None, None, None), (3, None, None, "b", 0), (4, "", "en", "b", 0), (5, long, "en", "b", 0), (None, text, "en", "a", 1), (None, None, None, None, None)]
    for name, data, kind in (("labels", [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), ("benchmark", [(1, None), (2, "zz yy xx ww vv uu")], "item_id long, text string")):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    odd = spark.createDataFrame(rows, DOC)
    clash = ["n_lines", "score", "fps", "component_id", "text_hash", "row", "item_id", "hash", "w", "root", "shard"]
    from pyspark.sql import functions as F

    for extra in ([], clash):
        docs = odd.withColumns({c: F.lit("x") for c in extra}) if extra else odd
        left = {}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            kept = [r.asDict() for r in out.collect()]
            assert out.columns[: len(docs.columns)] == docs.columns, name
            assert all(k[c] == "x" for k in kept for c in extra), name
            left[name] = sorted(str(k["doc_id"]) for k in kept)
            assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        every = sorted(str(r[0]) for r in rows)
        assert left["quality classifier"] == every  # nothing to learn from
        assert left["line dedup"] == every and left["benchmark decontamination"] == every and left["mixing sources to target weights"] == every
        assert left["SimHash near-dedup"] == sorted(["1", "1", "3", "5", "None", "None"])
