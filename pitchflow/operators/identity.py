"""Tracks, votes and identities."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.geometry import cx, cy, height, iou
from .timejoin import TAKE, of_tracks, settled


def assemble_tracks(detections: DataFrame) -> DataFrame:
    """Track headers of detections with tracker ids: class by majority (ties: seen first), span, size, mean confidence."""
    rows = detections.where("tracker_id is not null").withColumnRenamed("tracker_id", "track_id")
    votes = rows.groupBy(*TAKE, "track_id", "cls").agg(F.count("*").alias("n"), F.min("frame_index").alias("seen"))
    best = votes.groupBy(*TAKE, "track_id").agg(F.max_by("cls", F.struct("n", -F.col("seen"))).alias("dominant_class"))
    at = F.struct(cx().alias("x"), cy().alias("y"), height().alias("h"))
    spans = rows.groupBy(*TAKE, "track_id").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n_boxes"), F.avg("conf").alias("mean_conf"), F.min_by(at, "frame_index").alias("first"), F.max_by(at, "frame_index").alias("last"))
    return spans.join(best, [*TAKE, "track_id"])


def stitch_identities(tracks: DataFrame, p: dict = config.STITCH) -> DataFrame:
    """Greedy forward chains of the track headers of a take in order of (t_start, id): identity (the chain's first id)
    and confidence of each track. The nearest follower wins, among equals one of the same sure team (where ``tracks`` has
    team and team_confidence), then the lowest id. Boxes stay where they are: only track headers are read, and a take is cut
    wherever a whole gap passes without any track, as no chain reaches over it; the pieces are chained apart."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t_start", "track_id"], ignore_index=True)
        start, end, ids, mean_conf = (pdf[c].to_numpy() for c in ("t_start", "t_end", "track_id", "mean_conf"))
        fx, fy, fh, lx, ly, lh = (pdf[f"{side}_{c}"].to_numpy(float) for side in ("first", "last") for c in "xyh")
        team, sure = pdf["team"].to_numpy(float, na_value=np.nan), pdf["team_confidence"].fillna(0).to_numpy(float)
        free = np.ones(len(pdf), bool)
        identity, conf = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
        for k in range(len(pdf)):
            if not free[k]:
                continue
            members, free[k], tail = [k], False, k
            while True:
                lo, hi = np.searchsorted(start, (end[tail], end[tail] + p["gap"]), side="right")
                j = lo + np.flatnonzero(free[lo:hi])
                gap, mean = start[j] - end[tail], (lh[tail] + fh[j]) / 2
                jump = np.where(mean > 0, np.hypot(fx[j] - lx[tail], fy[j] - ly[tail]) / np.where(mean > 0, mean, 1), np.inf)
                j = j[(gap > 0) & (gap < p["gap"]) & (jump < p["jump"]) & (jump / np.where(gap > 0, gap, 1) < p["speed"])]
                if not len(j):
                    break
                jump = np.hypot(fx[j] - lx[tail], fy[j] - ly[tail]) / ((lh[tail] + fh[j]) / 2)
                alike = (np.minimum(sure[tail], sure[j]) >= p["team"]) & (team[tail] == team[j])
                tail = j[np.lexsort((ids[j], ~alike, jump))[0]]
                free[tail] = False
                members.append(tail)
            identity[members] = ids[k]
            conf[members] = p["decay"] ** (len(members) - 1) * mean_conf[members].mean()
        return pdf[[*TAKE, "track_id"]].assign(identity=identity, confidence=conf)

    sides = [F.col(c) if c in tracks.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("team", "int"), ("team_confidence", "double"))]
    flat = tracks.select(*TAKE, "track_id", "t_start", "t_end", "mean_conf", *sides, *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("first", "last") for c in "xyh"])
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.select(*TAKE, "track_id").schema)
    w = Window.partitionBy(*TAKE).orderBy("t_start", "track_id")
    over = F.max("t_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    alone = F.coalesce((F.col("t_start") - over >= p["gap"]).cast("int"), F.lit(0))
    cut = flat.withColumn("__new", alone).withColumn("__piece", F.sum("__new").over(w)).drop("__new")
    return cut.groupBy(*TAKE, "__piece").applyInPandas(chain, f"{kind}, identity long, confidence double")


def digit_votes(reads: DataFrame, keys: Sequence[str], p: dict = config.VOTE) -> DataFrame:
    """The number of each key: a strict winner with enough reads, enough agreement over all reads and confidence."""
    votes = reads.where("digits is not null").groupBy(*keys, "digits").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"))
    w = Window.partitionBy(*keys)
    ranked = votes.withColumn("all", F.sum("n").over(w)).withColumn("rank", F.rank().over(w.orderBy(F.desc("n")))).withColumn("ties", F.count_if(F.col("rank") == 1).over(w))
    top = ranked.where("rank = 1").groupBy(*keys).agg(F.min("digits").alias("digits"), F.max("n").alias("n_reads"), F.max("all").alias("all"), F.max("ties").alias("ties"), F.min_by("mean", "digits").alias("mean"))
    agreement = F.col("n_reads") / F.col("all")
    conf = 0.5 * agreement + 0.5 * F.col("mean")
    good = (F.col("ties") == 1) & (F.col("n_reads") >= p["reads"]) & (F.col("all") > 0) & (agreement >= p["agreement"]) & (conf >= p["confidence"])
    return top.select(*keys, F.when(good, F.col("digits")).alias("jersey_number"), F.when(good, "verified").otherwise("unverified").alias("status"), agreement.alias("agreement"), F.when(good, conf).otherwise(0.0).alias("confidence"), "n_reads")


def confirmed_votes(votes: DataFrame, reads: DataFrame, confirmed: DataFrame, keys: Sequence[str], p: dict = config.VOTE) -> DataFrame:
    """``votes`` as of ``digit_votes`` with numbers that a person confirmed (``confirmed``: keys, number): one read of such a
    number verifies it, whatever the others say. ``note`` tells of it: accepted, contradicted (another number has more reads)
    or no_reads (the vote stands). Keys that are in one table alone have a row, unverified without reads."""
    seen = reads.where("digits is not null").groupBy(*keys, "digits").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"))
    asked = confirmed.select(*keys, F.col("number").cast("string").alias("wanted"))
    told = asked.join(seen, list(keys), "left").groupBy(*keys, "wanted").agg(
        F.max(F.when(F.col("digits") == F.col("wanted"), F.struct("n", "mean"))).alias("own"), F.max(F.when(F.col("digits") != F.col("wanted"), F.col("n"))).alias("rival")
    )
    rows, sure = votes.join(told, list(keys), "full"), F.col("own").isNotNull()
    note = F.when(sure & (F.col("rival") > F.col("own.n")), "contradicted").when(sure, "accepted").when(F.col("wanted").isNotNull(), "no_reads")
    return rows.select(
        *keys, F.when(sure, F.col("wanted")).otherwise(F.col("jersey_number")).alias("jersey_number"), F.when(sure, "verified").otherwise(F.coalesce("status", F.lit("unverified"))).alias("status"),
        F.when(sure, F.least(F.lit(1.0), F.greatest(F.lit(p["confidence"]), F.col("own.mean")))).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), note.alias("note"),
    )


def tracks_per_take(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy(*TAKE).agg(F.count("*").alias("n_tracks"))


def coverage_seconds(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Length of the union of [t_start, t_end] spans; touching ones merge."""
    w = Window.partitionBy(*keys).orderBy("t_start", "t_end")
    before = F.max("t_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("__new", F.when(F.col("t_start") <= before, 0).otherwise(1)).withColumn("__i", F.sum("__new").over(w))
    return islands.groupBy(*keys, "__i").agg((F.max("t_end") - F.min("t_start")).alias("s")).groupBy(*keys).agg(F.sum("s").alias("coverage"))


def kit_median(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median colour of each key, by channel."""
    return samples.groupBy(*keys).agg(*[F.percentile(c, 0.5).alias(c) for c in ("l", "a", "b")])


def balance_cap(tracks: DataFrame, share: float = 0.25, cap: float = 0.3) -> DataFrame:
    """Team confidences of a take capped where its smaller team has under ``share`` of the tracks."""
    w = Window.partitionBy(*TAKE)
    least = F.least(F.count_if(F.col("team") == 0).over(w), F.count_if(F.col("team") == 1).over(w)) / F.count("team").over(w)
    return tracks.withColumn("team_confidence", F.when(least < share, F.least("team_confidence", F.lit(cap))).otherwise(F.col("team_confidence")))


def active_windows(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy(*TAKE, "track_id").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"))


def two_means(points: DataFrame, keys: Sequence[str] = TAKE, p: dict = config.TEAMS, rounds: int = 100) -> DataFrame:
    """(keys, id, label, own, other): the two clusters of the points of each key, with every point's distances to its own
    centre and to the other one. ``points``: keys, id, x (array of doubles, as long for all). Keys with one point have none.

    Several starts run side by side: the first centre is the point of least hash (another hash each time), the second the
    point farthest from it. A round is one job of grouped sums: points meet the centres of their key by a join, and partial
    sums meet, so nothing gathers the points of a key however many there are. Rounds end when no centre moves. The start of
    least spread counts (ties: the first); label 0 is the cluster of the smaller centre.
    """
    keys = list(keys)
    pts = settled(points.select(*keys, "id", "x"))
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    drawn = pts.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(p["restarts"] - 1))))
    one = drawn.groupBy(*keys, "r").agg(F.min_by("x", F.struct(F.xxhash64("id", F.col("r") + p["seed"]), "id")).alias("c0"), F.count("*").alias("n")).where("n > 1").drop("n")
    far = pts.join(one, keys).groupBy(*keys, "r").agg(F.max_by("x", F.struct(F.round(apart(F.col("x"), F.col("c0")), 9), -F.xxhash64("id"))).alias("c1"))
    centres = settled(one.join(far, [*keys, "r"]))
    d0, d1 = apart(F.col("x"), F.col("c0")), apart(F.col("x"), F.col("c1"))
    label = F.when(d0 <= d1, 0).otherwise(1)
    for _ in range(rounds):
        told = pts.join(centres, keys).withColumn("__in", label)
        mean = told.groupBy(*keys, "r", "__in").agg(F.transform(vector_to_array(Summarizer.mean(array_to_vector("x"))), lambda v: F.round(v, 9)).alias("m"))
        sums = mean.groupBy(*keys, "r").agg(*[F.max(F.when(F.col("__in") == k, F.col("m"))).alias(f"m{k}") for k in (0, 1)])
        after = centres.join(sums, [*keys, "r"])
        new = [F.coalesce(f"m{k}", f"c{k}") for k in (0, 1)]  # a cluster without points keeps its centre
        moved = after.select(*keys, "r", new[0].alias("c0"), new[1].alias("c1"), ((new[0] != F.col("c0")) | (new[1] != F.col("c1"))).alias("moved"))
        moved = settled(moved)
        centres = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    spread = pts.join(centres, keys).groupBy(*keys, "r").agg(F.round(F.sum(F.least(d0, d1)), 6).alias("spread"))
    best = spread.groupBy(*keys).agg(F.min_by("r", F.struct("spread", "r")).alias("r"))
    chosen = centres.join(best, [*keys, "r"])
    less = F.col("c0") <= F.col("c1")
    chosen = chosen.select(*keys, F.when(less, F.col("c0")).otherwise(F.col("c1")).alias("c0"), F.when(less, F.col("c1")).otherwise(F.col("c0")).alias("c1"))
    out = pts.join(chosen, keys).withColumns({"__a": F.sqrt(d0), "__b": F.sqrt(d1)})
    return out.select(*keys, "id", F.when(F.col("__a") <= F.col("__b"), 0).otherwise(1).alias("label"), F.least("__a", "__b").alias("own"), F.greatest("__a", "__b").alias("other"))


def assign_teams(colours: DataFrame, p: dict = config.TEAMS) -> DataFrame:
    """Two clusters of the tracks of each take by colour (l, a, b): team and team_confidence, 0.5 half way between the
    clusters. Team 0 is the darker one. With fewer than two usable tracks there is no team."""
    lab = F.array(*[F.col(c).cast("double") for c in "lab"])
    usable = colours.select(*TAKE, F.col("track_id").alias("id"), lab.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    told = two_means(usable, TAKE, p)
    total = F.col("own") + F.col("other")
    teams = told.select(*TAKE, F.col("id").alias("track_id"), F.col("label").cast("int").alias("team"), F.when(total > 0, F.col("other") / total).otherwise(0.5).alias("team_confidence"))
    every = colours.select(*TAKE, "track_id").join(teams, [*TAKE, "track_id"], "left")
    return every.withColumn("team_confidence", F.coalesce("team_confidence", F.lit(0.0)))


def teams_by_embedding(crops: DataFrame, p: dict = config.TEAMS) -> DataFrame:
    """Team and share of each track by the vectors of its crops (video_id, take_id, track_id, crop, vector).

    Vectors are scaled to length one (zero ones stay) and the crops of a take fall into two clusters; a track gets the label
    of most of its crops. Team 0 is the cluster of the smaller centre. Crops without a vector do not count; a track without
    a usable crop, or in a take with one, has no team and share 0.
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    usable = crops.where(F.size("vector") > 0).withColumn("__n", norm)
    unit = F.transform("vector", lambda v: F.when(F.col("__n") > 0, v.cast("double") / F.col("__n")).otherwise(0.0))
    told = two_means(usable.select(*TAKE, F.struct("track_id", "crop").alias("id"), unit.alias("x")), TAKE, p)
    teams = majority_teams(told.select(*TAKE, "id.track_id", "id.crop", F.col("label").cast("int").alias("label")))
    every = crops.select(*TAKE, "track_id").distinct().join(teams, [*TAKE, "track_id"], "left")
    return every.withColumn("team_confidence", F.coalesce("team_confidence", F.lit(0.0)))


def majority_teams(crops: DataFrame) -> DataFrame:
    """Team of each track by its crops' labels (ties: the label seen first), with its share."""
    votes = crops.where("label is not null").groupBy(*TAKE, "track_id", "label").agg(F.count("*").alias("n"), F.min("crop").alias("seen"))
    out = votes.groupBy(*TAKE, "track_id").agg(F.max_by("label", F.struct("n", -F.col("seen"))).alias("team"), (F.max("n") / F.sum("n")).alias("team_confidence"))
    return out


def confident_reads(reads: DataFrame, keys: Sequence[str], least: float = 0.4) -> DataFrame:
    """The number of each crop: certain if only one number of one or two digits is read with enough confidence, else the
    surest read."""
    ok = reads.where(F.col("digits").rlike("^[0-9]{1,2}$"))
    sure = F.when(F.col("confidence") >= least, F.col("digits"))
    out = ok.groupBy(*keys).agg(F.count_distinct(sure).alias("n"), F.max_by("digits", F.struct("confidence", "digits")).alias("digits"), F.max("confidence").alias("confidence"))
    return out.select(*keys, "digits", "confidence", (F.col("n") == 1).alias("confident"))


def prune_chain(chain: DataFrame, numbers: DataFrame) -> DataFrame:
    """Members (video_id, take_id, seed, track_id) whose number is not another than their seed's; unread ones stay."""
    read = numbers.select(*TAKE, F.col("track_id").alias("id_"), "digits")
    own = chain.join(read.withColumnRenamed("id_", "track_id").withColumnRenamed("digits", "own"), [*TAKE, "track_id"], "left")
    both = own.join(read.withColumnRenamed("id_", "seed").withColumnRenamed("digits", "wanted"), [*TAKE, "seed"], "left")
    return both.where(F.coalesce(F.col("own") == F.col("wanted"), F.lit(True))).select(*chain.columns)


def claimed_track(votes: DataFrame, keys: Sequence[str], margin: float = 0.2) -> DataFrame:
    """Of the tracks verified for a claimed number the only one, or the one that leads the next in agreement by ``margin``."""
    w = Window.partitionBy(*keys).orderBy(F.desc("agreement"), "track_id")
    ranked = votes.withColumn("lead_", F.col("agreement") - F.lead("agreement").over(w)).withColumn("__n", F.row_number().over(w))
    return ranked.where((F.col("__n") == 1) & (F.col("lead_").isNull() | (F.round("lead_", 9) >= margin))).drop("__n", "lead_")


def merge_fragments(boxes: DataFrame, targets: DataFrame) -> DataFrame:
    """Boxes of a target's tracks as one track of each take, with the smallest of their ids; of equal instants one box."""
    rows = of_tracks(boxes, targets.select(*TAKE, "track_id").distinct())
    rest = [c for c in boxes.columns if c not in (*TAKE, "track_id", "t")]
    one = rows.groupBy(*TAKE, "t").agg(F.min_by(F.struct(*rest), "track_id").alias("b"))
    ids = rows.groupBy(*TAKE).agg(F.min("track_id").alias("track_id"))
    return one.join(ids, list(TAKE)).select(*TAKE, "track_id", "t", "b.*").select(*boxes.columns)


def structure_votes(candidates: DataFrame, least: float = 0.3, need: int = 2) -> DataFrame:
    """A goal box a take: the median box of the candidates that overlap the median of all enough, if there are enough
    (n_inliers, of n_sampled). ``representative`` is the one real candidate nearest to it, whole, with its posts or whatever
    columns it has: largest overlap with the box, of equal ones the earliest. No more than medians and one row a take are
    gathered."""
    box = ("x1", "y1", "x2", "y2")
    middle = lambda df, p, n: df.groupBy(*TAKE).agg(*[F.percentile(c, 0.5).alias(f"{p}{c}") for c in box], F.count("*").alias(n))
    rest = [c for c in candidates.columns if c not in TAKE]
    near = candidates.join(middle(candidates, "m_", "n_sampled"), list(TAKE)).where(iou("", "m_") >= least)
    near = settled(near.select(*candidates.columns, "n_sampled"))
    final = middle(near, "f_", "n_inliers").where(F.col("n_inliers") >= need)
    timed = "t" in candidates.columns
    order = F.struct(F.round(iou("", "f_"), 9), -F.col("t") if timed else F.lit(0))
    one = near.join(final, list(TAKE)).groupBy(*TAKE).agg(F.max_by(F.struct(*rest), order).alias("representative"), F.first("n_sampled").alias("n_sampled"))
    return final.join(one, list(TAKE)).select(*TAKE, *[F.col(f"f_{c}").alias(c) for c in box], "n_inliers", "n_sampled", *([F.col("representative.t").alias("t_anchor")] if timed else []), "representative")


def extend_chains(chain: DataFrame, tracks: DataFrame, least: float = config.TARGET["height"]) -> DataFrame:
    """``chain`` (video_id, take_id, seed, track_id) with the other tracks of the take that may be its seed's player.

    ``tracks``: track_id, t_start, t_end, team, height, digits. A track of another team or number or of a very different
    height is not; what is unknown does not count. In order of (t_start, id), one that overlaps an accepted one in time is
    left out. ``added`` tells the new rows.
    """
    who = ("team", "height", "digits")
    seed = tracks.select(*TAKE, F.col("track_id").alias("seed"), *[F.col(c).alias(f"s_{c}") for c in who])
    spans = chain.join(tracks.select(*TAKE, "track_id", "t_start", "t_end"), [*TAKE, "track_id"])
    held = spans.groupBy(*TAKE, "seed").agg(F.collect_list(F.struct("t_start", "t_end", "track_id")).alias("held"))
    rows = held.select(*TAKE, "seed").join(seed, [*TAKE, "seed"]).join(tracks, list(TAKE)).join(chain, [*TAKE, "seed", "track_id"], "left_anti")
    both = (F.col("height") > 0) & (F.col("s_height") > 0)
    ratio = F.when(both, F.least("height", "s_height") / F.greatest("height", "s_height"))
    fit = rows
    for unlike in (F.col("team") != F.col("s_team"), ratio < least, F.col("digits") != F.col("s_digits")):
        fit = fit.where(~F.coalesce(unlike, F.lit(False)))
    more = fit.groupBy(*TAKE, "seed").agg(F.array_sort(F.collect_list(F.struct("t_start", "track_id", "t_end"))).alias("more"))
    scan = F.expr(
        """aggregate(more, held, (acc, c) -> if(exists(acc, k -> c.t_start < k.t_end and k.t_start < c.t_end), acc,
            concat(acc, array(named_struct('t_start', c.t_start, 't_end', c.t_end, 'track_id', c.track_id)))))"""
    )
    grown = more.join(held, [*TAKE, "seed"]).select(*TAKE, "seed", F.explode(scan).alias("m")).select(*TAKE, "seed", F.col("m.track_id").alias("track_id"))
    new = grown.join(chain, [*TAKE, "seed", "track_id"], "left_anti").withColumn("added", F.lit(True))
    return chain.select(*TAKE, "seed", "track_id").withColumn("added", F.lit(False)).unionByName(new)
