"""The player that a video follows: which tracks may be that player, and where it is at each instant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.geometry import area, cx, cy
from ..functions.text import colour_reference
from .timejoin import TAKE, bracket, nearest_in_time

BOX = ("x1", "y1", "x2", "y2")


def _same_colour(a: str, b: str, p: dict = config.KIT) -> Column:
    """Whether two Lab colours are alike: null in between or without one."""
    d = F.sqrt(sum((F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) ** 2 for k in "lab"))
    return F.when(d <= p["same"], True).when(d >= p["different"], False)


def same_kit(a: str, b: str) -> Column:
    """Torso colours decide where they can; else shorts and socks, unless these disagree; null when undecided."""
    torso, shorts, socks = (_same_colour(f"{a}.{band}", f"{b}.{band}") for band in ("torso", "shorts", "socks"))
    rest = F.when(shorts == socks, shorts).when(shorts.isNull(), socks).when(socks.isNull(), shorts)
    return F.coalesce(torso, rest)


def verify_candidates(candidates: DataFrame, profiles: DataFrame, p: dict = config.TARGET) -> DataFrame:
    """``candidates`` with decision, score and reject.

    Both tables have video_id, kit (struct of torso, shorts and socks colours), jersey and height (null: not known);
    candidates have first, profiles last (struct x, y, h). Another kit, another number or another height rejects; otherwise
    the weighted mean of the signals that are there decides. Without any the score is 0.
    """
    own = profiles.select(F.col("video_id").alias("v_"), F.struct("kit", "jersey", "height", "last").alias("goal"))
    rows = candidates.withColumn("cand", F.struct("kit", "jersey", "height", "first")).join(own, F.col("video_id") == F.col("v_")).drop("v_")
    kit, number = same_kit("goal.kit", "cand.kit"), F.col("goal.jersey") == F.col("cand.jersey")
    tall, small = F.greatest("goal.height", "cand.height"), F.least("goal.height", "cand.height")
    both = (F.col("goal.height") > 0) & (F.col("cand.height") > 0)
    ratio = F.when(both, small / tall)
    mean = F.when((F.col("goal.last.h") > 0) & (F.col("cand.first.h") > 0), (F.col("goal.last.h") + F.col("cand.first.h")) / 2)
    way = F.greatest(F.lit(0.0), 1 - F.hypot(F.col("goal.last.x") - F.col("cand.first.x"), F.col("goal.last.y") - F.col("cand.first.y")) / mean / p["reach"])
    signals = {"kit": F.when(kit, 1.0), "jersey": F.when(number, 1.0), "height": ratio, "trajectory": F.when(mean.isNotNull(), way)}
    weight = {k: F.when(c.isNotNull(), p["weights"][k]).otherwise(0.0) for k, c in signals.items()}
    total = reduce(Column.__add__, weight.values())
    blend = reduce(Column.__add__, [weight[k] * F.coalesce(c, F.lit(0.0)) for k, c in signals.items()])
    hard = F.when(~kit, "wrong_kit_colour").when(~number, "wrong_jersey_number").when(ratio < p["height"], "height_mismatch")
    score = F.when(hard.isNotNull() | (total <= 0), 0.0).otherwise(F.round(blend / total, 9))
    out = rows.withColumn("hard", hard).withColumn("score", score)
    soft = F.when(F.col("score") >= p["strong"], "accept").when(F.col("score") >= p["uncertain"], "uncertain").otherwise("reject")
    decided = out.withColumn("decision", F.when(F.col("hard").isNotNull(), "reject").otherwise(soft))
    reject = F.when(F.col("decision") == "reject", F.coalesce("hard", F.lit("low_score")))
    return decided.select(*candidates.columns, "decision", "score", reject.alias("reject"))


def without_contradicted(chain: DataFrame, profiles: DataFrame) -> DataFrame:
    """Chain members whose kit and number do not speak against the profile; unknown ones stay."""
    own = profiles.select(F.col("video_id").alias("v_"), F.struct("kit", "jersey").alias("goal"))
    rows = chain.withColumn("cand", F.struct("kit", "jersey")).join(own, F.col("video_id") == F.col("v_"))
    against = F.coalesce(~same_kit("goal.kit", "cand.kit"), F.lit(False)) | F.coalesce(F.col("goal.jersey") != F.col("cand.jersey"), F.lit(False))
    return rows.where(~against).select(*chain.columns)


def target_timeline(boxes: DataFrame, accepted: DataFrame, p: dict = config.TIMELINE) -> DataFrame:
    """A state for every instant with a box of the take. ``accepted``: video_id, take_id, track_id of the target's tracks.

    The target's box is a sample or lies between two samples at most ``age`` apart, and is never carried on. Without a box
    the target is occluded (another box covers its last place), searching (gone for ``grace`` or never seen) or lost. For
    ``hold`` seconds after a gap that reached searching it is reconnected.
    """
    ids = accepted.select(*TAKE, "track_id").distinct().withColumn("__own", F.lit(True))
    rows = boxes.join(ids, [*TAKE, "track_id"], "left").withColumn("__own", F.coalesce("__own", F.lit(False)))
    at = F.struct("track_id", *BOX)
    own = rows.where("__own").groupBy(*TAKE, "t").agg(F.min_by(at, "track_id").alias("b"))
    marked = bracket(rows.select(*TAKE, "t").distinct(), own, ("b",))
    gap = F.round(F.col("after.t") - F.col("before.t"), 9)
    share = F.col("fraction")
    between = F.struct(F.col("after.b.track_id").alias("track_id"), *[(F.col(f"before.b.{c}") + share * (F.col(f"after.b.{c}") - F.col(f"before.b.{c}"))).alias(c) for c in BOX])
    w = Window.partitionBy(*TAKE).orderBy("t")
    seen = marked.select(*TAKE, "t", F.when(gap <= p["age"], between).alias("box")).withColumn("ref", F.last("box", ignorenulls=True).over(w))
    seen = seen.withColumn("t_seen", F.last(F.when(F.col("box").isNotNull(), F.col("t")), ignorenulls=True).over(w))
    others = rows.where("not __own").select(*TAKE, "t", *[F.col(c).alias(f"o_{c}") for c in BOX])
    side = lambda f, c, d: f(F.col(f"o_{c}"), F.col(f"ref.{d}"))
    both = F.greatest(side(F.least, "x2", "x2") - side(F.greatest, "x1", "x1"), F.lit(0.0)) * F.greatest(side(F.least, "y2", "y2") - side(F.greatest, "y1", "y1"), F.lit(0.0))
    union = area("o_") + area("ref.") - both
    covered = seen.where("ref is not null").join(others, [*TAKE, "t"]).groupBy(*TAKE, "t").agg(F.max(F.when(union > 0, both / union)).alias("overlap"))
    full = seen.join(covered, [*TAKE, "t"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    gone = F.coalesce(F.round(F.col("t") - F.col("t_seen"), 9), F.lit(float("inf")))
    absent = F.when(F.col("overlap") >= p["occlusion"], "occluded").when(gone >= p["grace"], "searching").otherwise("lost")
    full = full.withColumn("absent", F.when(F.col("box").isNull(), absent))
    full = full.withColumn("__s", F.sum(F.when(F.col("absent") == "searching", 1).otherwise(0)).over(w))
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last(F.when(F.col("box").isNotNull(), F.col("__s")), ignorenulls=True).over(earlier), F.lit(0))
    full = full.withColumn("__back", F.when(F.col("box").isNotNull() & (F.col("__s") > before), F.col("t")))
    since = F.round(F.col("t") - F.last("__back", ignorenulls=True).over(w), 9)
    present = F.when(since <= p["hold"], "reconnected").when(F.col("overlap") >= p["partial"], "partially_occluded").otherwise("visible")
    return full.select(*TAKE, "t", F.coalesce("absent", present).alias("state"), "box.*")


def _match(hints: DataFrame, boxes: DataFrame, tolerance: float, most: float, tie: str = "later") -> DataFrame:
    """``hints`` (with x, y) with track_id and dist: the track (ties: lowest id) whose box nearest in time holds the point,
    at distance 0, else the one with the nearest centre at most ``most`` away."""
    near = nearest_in_time(hints, boxes, tolerance, by=("track_id",), tie=tie)
    held = F.col("x").between(F.col("near.x1"), F.col("near.x2")) & F.col("y").between(F.col("near.y1"), F.col("near.y2"))
    dist = F.when(held, 0.0).otherwise(F.hypot(cx("near.") - F.col("x"), cy("near.") - F.col("y")))
    order = F.struct((~held).alias("outside"), dist.alias("dist"), F.col("near.track_id").alias("track_id"))
    best = near.groupBy(*hints.columns).agg(F.min(order).alias("m")).where(~F.col("m.outside") | (F.col("m.dist") <= most))
    return best.select(*hints.columns, F.col("m.track_id").alias("track_id"), F.col("m.dist").alias("dist"))


def vote_seed_tracks(hints: DataFrame, boxes: DataFrame, p: dict = config.SELECTION) -> DataFrame:
    """Votes of arrow tips (video_id, take_id, frame_index, t, x, y) for tracks."""
    return _match(hints, boxes, p["tolerance"], p["tip"]).groupBy(*TAKE, "track_id").agg(F.count("*").alias("n_votes"))


def match_clicks(clicks: DataFrame, boxes: DataFrame, frame_w: float, frame_h: float, window: float = 2.0, reach: float = 0.15) -> DataFrame:
    """Tracks under clicks (x and y up to 1 are shares of the frame)."""
    share = (F.col("x") <= 1) & (F.col("y") <= 1)
    rows = clicks.withColumns({"x": F.when(share, F.col("x") * frame_w).otherwise(F.col("x")), "y": F.when(share, F.col("y") * frame_h).otherwise(F.col("y"))})
    return _match(rows, boxes, window, reach * frame_h, tie="earlier")


def fallback_seeds(boxes: DataFrame, tracks: DataFrame, frame_w: float, frame_h: float, p: dict = config.SELECTION) -> DataFrame:
    """The track of each take that is longest, surest and nearest the centre, each scaled over the take's candidates."""
    able = tracks.where(~F.col("dominant_class").eqNullSafe("referee")).select(*TAKE, "track_id")
    far = F.hypot(cx() - frame_w / 2, cy() - frame_h / 2)
    known = boxes.join(able, [*TAKE, "track_id"]).groupBy(*TAKE, "track_id").agg((F.max("t") - F.min("t")).alias("a"), F.avg("conf").alias("b"), F.min(far).alias("far"))
    rows = known.where(F.round("a", 9) >= p["duration"]).withColumn("c", -F.col("far"))
    w = Window.partitionBy(*TAKE)

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high - low > 1e-9, (F.col(c) - low) / (high - low)).otherwise(1.0)

    score = F.round(sum(k * scaled(c) for k, c in zip(p["weights"], "abc", strict=True)), 9)
    best = rows.withColumn("score", score).withColumn("__n", F.row_number().over(w.orderBy(F.desc("score"), "track_id")))
    return best.where("__n = 1").select(*TAKE, "track_id", "score")


def select_targets(takes: DataFrame, manual: DataFrame, votes: DataFrame, fallback: DataFrame, p: dict = config.SELECTION, stitched: DataFrame | None = None) -> DataFrame:
    """The seed track of each take and how it was found: a manual choice, else arrow votes with enough of them for one track,
    else the fallback with a capped confidence, else none. ``stitched`` (video_id, take_id, track_id, confidence: of the chain
    from that seed) lowers the confidence of arrow votes."""
    w = Window.partitionBy(*TAKE)
    share = F.col("n_votes") / F.sum("n_votes").over(w)
    top = votes.withColumn("share", share).withColumn("__n", F.row_number().over(w.orderBy(F.desc("n_votes"), "track_id"))).where((F.col("__n") == 1) & (F.col("share") >= p["share"]))
    if stitched is not None:
        top = top.join(stitched.select(*TAKE, "track_id", F.col("confidence").alias("__chain")), [*TAKE, "track_id"], "left").withColumn("share", F.col("share") * F.coalesce("__chain", F.lit(1.0)))
    by = lambda df, name, conf: df.groupBy(*TAKE).agg(F.min_by(F.struct(F.lit(name).alias("method"), F.col("track_id"), conf.alias("confidence")), "track_id").alias(name))
    out = takes.select(*TAKE)
    for part in (by(manual, "manual", F.lit(1.0)), by(top, "arrow_vote", F.col("share")), by(fallback, "fallback", F.least(F.col("score"), F.lit(p["fallback"])))):
        out = out.join(part, list(TAKE), "left")
    none = F.struct(F.lit("none").alias("method"), F.lit(None).cast("long").alias("track_id"), F.lit(0.0).alias("confidence"))
    return out.withColumn("s", F.coalesce("manual", "arrow_vote", "fallback", none)).select(*TAKE, "s.*")


def overall_selection(selected: DataFrame) -> DataFrame:
    """Of each video the mean confidence of the takes with a target (0 without any), and whether a person should confirm it:
    unless every target was chosen by hand."""
    usable = F.col("track_id").isNotNull()
    return selected.groupBy("video_id").agg(
        F.coalesce(F.avg(F.when(usable, F.col("confidence"))), F.lit(0.0)).alias("confidence"), F.count_if(usable).alias("n_usable"), (F.count_if(usable & (F.col("method") != "manual")) + F.when(F.count_if(usable) == 0, 1).otherwise(0) > 0).alias("needs_confirmation")
    )


def nearest_colour(colours: DataFrame, asked: DataFrame, most: float = config.COLOUR_DISTANCE) -> DataFrame:
    """``asked`` (video_id, take_id, colour l, a, b as ``ref``, or its name as ``colour``) with the track of nearest colour,
    null beyond ``most``, and its distance either way; neither for a name that is not known or a take without colours."""
    if "ref" not in asked.columns:
        asked = asked.withColumn("ref", colour_reference(F.col("colour")))
    lab = colours.select(*TAKE, "track_id", F.struct("l", "a", "b").alias("lab")).where("lab.l is not null and lab.a is not null and lab.b is not null")
    d = F.round(F.sqrt(sum((F.col(f"lab.{k}") - F.col(f"ref.{k}")) ** 2 for k in "lab")), 9)
    best = asked.join(lab, list(TAKE), "left").withColumn("__d", d).groupBy(*asked.columns).agg(F.min(F.when(F.col("__d").isNotNull(), F.struct(F.col("__d").alias("dist"), "track_id"))).alias("m"))
    return best.select(*asked.columns, F.when(F.col("m.dist") <= most, F.col("m.track_id")).alias("track_id"), F.col("m.dist").alias("dist"))


def combined(colour: Column, hint: Column, candidates: Column) -> Column:
    """struct<track_id, how>: what a colour and an arrow say together; the colour wins where they differ."""
    how = (
        F.when(F.coalesce(candidates, F.lit(0)) == 0, "no_candidates").when(colour == hint, "corroborated").when(colour.isNotNull() & hint.isNotNull(), "disagreement")
        .when(colour.isNotNull(), "colour_only").when(hint.isNotNull(), "arrow_fallback").otherwise("no_confident_signal")
    )
    return F.struct(F.when(how != "no_candidates", F.coalesce(colour, hint)).alias("track_id"), how.alias("how"))
