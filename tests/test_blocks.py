"""Ordered operators that work in blocks and rounds, against plain loops over the whole."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow import config
from pitchflow.operators import identity, manual, series, timejoin

AFFINE = ("a", "b", "tx", "c", "d", "ty")


@pytest.mark.parametrize("block", [2, 5, 1000])
def test_products_over_blocks(spark, block):
    rng, rows, want = random.Random(1), [], {}
    for take, n in ((0, 1), (1, 37), (2, 130)):
        now = np.eye(3)
        for k in range(n):
            step = None if k % 11 == 5 else [1 + rng.uniform(-0.05, 0.05), rng.uniform(-0.05, 0.05), rng.uniform(-3, 3), rng.uniform(-0.05, 0.05), 1.0, rng.uniform(-3, 3)]
            rows.append((1, take, k / 10, *(step or [None, 0.0, 0.0, 0.0, 1.0, 0.0])))
            now = np.vstack([np.reshape(step, (2, 3)), [0, 0, 1]]) @ now if step else now
            want[take, k] = now[:2].ravel()
    df = spark.createDataFrame(rows, "video_id long, take_id long, t double, " + ", ".join(f"{c} double" for c in AFFINE)).repartition(4)
    got = {(r.take_id, round(r.t * 10)): [r[c] for c in AFFINE] for r in series.cumulative_motion(df, block).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def plain_plausible(rows, width, speed=10.0, need=5):
    def near(a, b):
        if b[0] <= a[0]:
            return a[1:] == b[1:]
        return float(np.hypot(b[1] - a[1], b[2] - a[2])) / (b[0] - a[0]) / width <= speed

    keep, last, kept, firm, doubt = {0}, 0, 1, False, []
    for k in range(1, len(rows)):
        if near(rows[last], rows[k]):
            keep.add(k)
            last, kept, firm, doubt = k, kept + 1, True, []
            continue
        doubt = [*doubt, k] if doubt and near(rows[doubt[-1]], rows[k]) else [k]
        if len(doubt) >= need:
            if not firm and kept == 1:
                keep.discard(last)
            keep.update(doubt)
            last, kept, firm, doubt = k, kept + len(doubt), True, []
    return keep


@pytest.mark.parametrize("block", [1, 8, 10_000])
def test_ball_jumps_over_pieces(spark, block):
    rng, rows, want = random.Random(7), [], set()
    for video in range(12):
        x, t, own = rng.uniform(0, 1000), 0.0, []
        for k in range(rng.choice([1, 6, 150, 300])):
            t += rng.choice([0.04, 0.04, 0.04, 0.0, 0.5])
            place = rng.random()
            x = rng.uniform(0, 1000) if place < 0.05 else x + rng.uniform(-2, 2)
            seen = rng.uniform(0, 1000) if place > 0.8 else x
            own.append((round(t, 2), seen, 50.0))
            rows.append((video, 0, k, round(t, 2), seen - 5, 45.0, seen + 5, 55.0, 0.5))
        own = [(t, (x - 5 + x + 5) / 2, y) for t, x, y in own]
        want |= {(video, k) for k in plain_plausible(own, 100.0)}
    df = spark.createDataFrame(rows, "video_id long, take_id long, frame_index long, t double, x1 double, y1 double, x2 double, y2 double, conf double").repartition(4)
    got = {(r.video_id, r.frame_index) for r in series.plausible_balls(df, 100.0, config.BALL, block).collect()}
    assert got == want and len(want) < len(rows)


def test_two_means_find_the_best_split(spark):
    """Against the best of all splits of each key; repeated points and keys with one point among them."""
    rng, rows = random.Random(3), []
    for take in range(6):
        n = [1, 2, 5, 9, 9, 9][take]
        rows += [(0, take, k, [rng.gauss(40 * (k % 2), 3), rng.gauss(0, 3), float(take)]) for k in range(n)]
    rows += [(0, 9, k, [1.0, 1.0, 1.0]) for k in range(4)]
    got = {(r.take_id, r.id): r for r in identity.two_means(spark.createDataFrame(rows, "video_id long, take_id long, id long, x array<double>")).collect()}
    assert {k for k, _ in got} == {1, 2, 3, 4, 5, 9}
    for take in range(1, 6):
        x = np.array([r[3] for r in rows if r[1] == take])
        spread = lambda part: sum(((x[list(p)] - x[list(p)].mean(axis=0)) ** 2).sum() for p in part if len(p))  # noqa: B023, E731
        ids = range(len(x))
        best = min(([tuple(c), tuple(k for k in ids if k not in c)] for m in range(len(x) // 2 + 1) for c in itertools.combinations(ids, m)), key=spread)
        own = [tuple(k for k in ids if got[take, k].label == side) for side in (0, 1)]
        assert spread(own) == pytest.approx(spread(best))
        centres = [x[list(p)].mean(axis=0) for p in own]
        assert tuple(centres[0]) <= tuple(centres[1])
        assert all(got[take, k].own == pytest.approx(np.linalg.norm(x[k] - centres[got[take, k].label]), abs=1e-6) for k in ids)
    assert all(got[9, k].label == 0 and got[9, k].own == got[9, k].other == 0 for k in range(4))


def test_chains_of_cut_takes(spark):
    """A take with pauses is chained as each of its parts on its own."""
    rng, rows = random.Random(5), []
    for k in range(80):
        part = k // 10
        start = part * 20.0 + rng.uniform(0, 8)
        x = rng.uniform(0, 300)
        rows.append((0, part, k, start, start + rng.uniform(0.2, 2), 0.8, (x, 0.0, 100.0), (x + rng.uniform(-50, 50), 0.0, 100.0)))
    at = "struct<x:double,y:double,h:double>"
    kind = f"video_id long, take_id long, track_id long, t_start double, t_end double, mean_conf double, first {at}, last {at}"
    apart = spark.createDataFrame(rows, kind)
    find = lambda df: {r.track_id: (r.identity, round(r.confidence, 9)) for r in identity.stitch_identities(df).collect()}
    whole = find(apart.withColumn("take_id", F.lit(0).cast("long")))
    assert whole == find(apart) and len({i for i, _ in whole.values()}) < 80


def test_boxes_on_a_grid_of_living_tracks(spark):
    boxes = [(0, 0, tr, k, tr * 100 + k / 5, 1.0 * k, 0.0, 1.0 * k + 10, 10.0, 0.5) for tr in range(5) for k in range(20)]
    df = spark.createDataFrame(boxes, "video_id long, take_id long, track_id long, frame_index long, t double, x1 double, y1 double, x2 double, y2 double, conf double")
    grid = spark.range(0, 6000).selectExpr("0L as video_id", "0L as take_id", "id / 10D as t")
    out = series.resample_boxes(grid, df, 0.5, 0.3)
    rows = {(r.track_id, round(r.t, 1)): r for r in out.collect()}
    assert {k for k in rows} == {(tr, round(t / 10, 1)) for tr in range(5) for t in range(6000) if tr * 100 - 0.3 - 1e-9 <= t / 10 <= tr * 100 + 3.8 + 0.3 + 1e-9}
    assert rows[1, 100.1].interpolated and rows[1, 100.1].x1 == pytest.approx(0.5) and not rows[1, 99.8].interpolated


def test_target_windows(spark):
    """Two tracks of a player as one; windows that its own events explain go, those of others do not count."""
    box = lambda tr, k, x: (0, 0, tr, k, k / 10, x, 0.0, x + 40, 100.0, 0.8)
    x, boxes = 0.0, []
    for k in range(120):
        x += 15.0 if k % 40 in range(10, 18) else 0.0
        boxes.append(box(1 if k < 60 else 2, k, x))
        boxes.append(box(3, k, 5.0 * k))
    df = spark.createDataFrame(boxes, "video_id long, take_id long, track_id long, frame_index long, t double, x1 double, y1 double, x2 double, y2 double, conf double")
    own = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 0, 99)], "video_id long, take_id long, track_id long")
    kind = "video_id long, take_id long, type string, player_track_id long, t_start double, t_end double, acting_ids array<long>"
    events = spark.createDataFrame([(0, 0, "dribble", 2, 5.0, 6.0, [2]), (0, 0, "possession", 3, 1.0, 2.0, [3]), (0, 0, "touch", 1, 1.0, 2.0, [1])], kind)
    got = manual.target_windows(df, own, events).orderBy("t_start").collect()
    assert [(r.track_id, round(r.t_start), round(r.t_end)) for r in got] == [(1, 1, 2), (1, 9, 10)] and [r.rank for r in got] == [1, 2]


def test_settled_tables_go_when_they_are_done_with(spark):
    rows = timejoin.settled(spark.range(5).withColumn("v", F.to_variant_object(F.struct("id"))))
    (folder,) = {f.rsplit("/", 1)[0] for f in rows.inputFiles()}
    assert rows.select(F.variant_get("v", "$.id", "long").alias("x")).agg(F.sum("x")).first()[0] == 10
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert store.exists(path)
    timejoin.unsettle(spark)
    assert not store.exists(path)
