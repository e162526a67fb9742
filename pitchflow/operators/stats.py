"""Attribution, ranking, clips and stat cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.geometry import cx, cy, height
from .series import TRACK, track_speed
from .timejoin import TAKE, nearest_in_time

PLAYER = ("video_id", "player_track_id")


def attribute(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Events whose acting ids (array ``acting_ids``) hold a target track of their take."""
    ids = targets.select(F.col("video_id").alias("v_"), F.col("take_id").alias("k_"), F.col("track_id").alias("i_"))
    same = (F.col("video_id") == F.col("v_")) & (F.col("take_id") == F.col("k_")) & F.array_contains("acting_ids", F.col("i_"))
    return events.join(ids, same, "left_semi")


def player_stats(events: DataFrame, keys: Sequence[str] = PLAYER) -> DataFrame:
    """Number and mean confidence of each player's events of a type, and their ids where ``events`` has ``event_id``."""
    ids = [F.sort_array(F.collect_list("event_id")).alias("event_ids")] if "event_id" in events.columns else []
    return events.groupBy(*keys, "type").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), *ids)


def sprint_stats(sprints: DataFrame, keys: Sequence[str] = PLAYER) -> DataFrame:
    return sprints.groupBy(*keys).agg(F.count("*").alias("n_sprints"), F.sum(F.col("mean_speed") * (F.col("t_end") - F.col("t_start"))).alias("sprint_distance"), F.max("peak_speed").alias("peak_speed"), F.avg("confidence").alias("mean_confidence"))


def distance_covered(boxes: DataFrame, window: int = config.SPRINT["window"]) -> DataFrame:
    """Heights covered and samples of each track."""
    return track_speed(boxes, window).groupBy(*TRACK).agg(F.sum(F.col("speed") * F.col("dt")).alias("distance"), F.count("*").alias("n_samples"))


def player_distance(boxes: DataFrame, members: DataFrame, window: int = config.SPRINT["window"]) -> DataFrame:
    """Heights covered by each player over its tracks and takes, with samples and fragments. ``members``: video_id, take_id,
    track_id, player_track_id; tracks without boxes count as fragments alone."""
    own = members.select(*TRACK, "player_track_id").distinct()
    rows = own.join(distance_covered(boxes.join(own, list(TRACK), "left_semi"), window), list(TRACK), "left")
    return rows.groupBy(*PLAYER).agg(F.coalesce(F.sum("distance"), F.lit(0.0)).alias("distance"), F.coalesce(F.sum("n_samples"), F.lit(0)).alias("n_samples"), F.count("*").alias("n_fragments"))


def stat_card(events: DataFrame, kinds: Sequence[str], keys: Sequence[str] = PLAYER) -> DataFrame:
    """A row a player with a count of each kind."""
    return events.groupBy(*keys).agg(*[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds], F.sum(F.when(F.col("type") == "possession", F.col("t_end") - F.col("t_start")).otherwise(0.0)).alias("possession_s"))


def rank_events(events: DataFrame, weights: dict[str, float] = config.RANK, keys: Sequence[str] = PLAYER) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    score = F.coalesce(table[F.col("type")], F.lit(0.0)) * (1 + 0.5 * F.col("confidence"))
    w = Window.partitionBy(*keys).orderBy(F.desc("rank_score"), "t_start", "type")
    return events.withColumn("rank_score", score).withColumn("rank", F.row_number().over(w))


def clip_ranges(events: DataFrame, takes: DataFrame, p: dict = config.CLIP) -> DataFrame:
    t = takes.select("video_id", "take_id", F.col("t_start").alias("__s"), F.col("t_end").alias("__e"))
    out = events.join(t, ["video_id", "take_id"]).withColumn("clip_start", F.greatest(F.col("t_start") - p["before"], F.col("__s"))).withColumn("clip_end", F.least(F.col("t_end") + p["after"], F.col("__e")))
    return out.where("clip_end > clip_start").drop("__s", "__e")


def dedupe_clips(clips: DataFrame, keys: Sequence[str] = PLAYER, p: dict = config.CLIP) -> DataFrame:
    """Best first; a clip goes when its time overlap (over the union) with a kept one exceeds ``iou``. Clips that no chain of
    overlaps ties together cannot meet, so each such group is folded on its own."""
    rest = [c for c in clips.columns if c not in (*keys, "rank")]
    w = Window.partitionBy(*keys).orderBy("clip_start", "clip_end", "rank")
    over = F.max("clip_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    tied = clips.withColumn("__new", F.when(F.col("clip_start") < over, 0).otherwise(1)).withColumn("__group", F.sum("__new").over(w))
    held = tied.groupBy(*keys, "__group").agg(F.array_sort(F.collect_list(F.struct("rank", *rest))).alias("__all"))
    both = "greatest(least(k.clip_end, r.clip_end) - greatest(k.clip_start, r.clip_start), 0D)"
    hit = f"{both} > {p['iou']} * ((k.clip_end - k.clip_start) + (r.clip_end - r.clip_start) - {both})"
    kept = F.expr(f"aggregate(__all, slice(__all, 1, 0), (acc, r) -> if(exists(acc, k -> {hit}), acc, concat(acc, array(r))))")
    return held.select(*keys, F.inline(kept)).select(*clips.columns)


def select_export(clips: DataFrame, keys: Sequence[str] = PLAYER, top: int = config.CLIP["top"], budget: float | None = None) -> DataFrame:
    """The best clips, up to the first that would exceed the budget; always one."""
    w = Window.partitionBy(*keys).orderBy("rank")
    out = clips.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top)
    if budget is not None:
        out = out.withColumn("__s", F.sum(F.col("clip_end") - F.col("clip_start")).over(w)).where((F.col("__s") <= budget) | (F.col("__n") == 1)).drop("__s")
    return out.drop("__n")


def video_profile(takes: DataFrame, videos: DataFrame, motion: DataFrame) -> DataFrame:
    """Cuts, cuts a minute and median motion of each video."""
    cuts = takes.groupBy("video_id").agg((F.count("*") - 1).alias("n_cuts"))
    score = motion.groupBy("video_id").agg(F.round(F.percentile(F.hypot("tx", "ty"), 0.5), 4).alias("motion_score"))
    out = videos.join(cuts, "video_id", "left").join(score, "video_id", "left").withColumn("n_cuts", F.coalesce("n_cuts", F.lit(0)))
    rate = F.when(F.col("duration") > 0, F.round(F.col("n_cuts") * 60 / F.col("duration"), 4)).otherwise(0.0)
    return out.withColumn("cuts_per_min", rate).withColumn("motion_score", F.coalesce("motion_score", F.lit(0.0)))


def attribute_shots(shots: DataFrame, boxes: DataFrame, balls: DataFrame, targets: DataFrame, p: dict = config.ATTRIBUTION) -> DataFrame:
    """Shots that began near one of the target's tracks: its box and the ball nearest in time, at most ``gap`` away, lie
    within ``heights`` box heights."""
    own = boxes.join(targets.select(*TAKE, "track_id"), [*TAKE, "track_id"], "left_semi")
    at = shots.select(*TAKE, F.col("t_start").alias("t")).distinct()
    near = nearest_in_time(at, own, p["gap"], by=("track_id",))
    gap = F.round(F.abs(F.col("near.t") - F.col("t")), 9)
    body = near.groupBy(*TAKE, "t").agg(F.min_by("near", F.struct(gap, -F.col("near.track_id"))).alias("near")).select(*TAKE, "t", F.col("near.track_id").alias("player_track_id"), cx("near.").alias("px"), cy("near.").alias("py"), height("near.").alias("ph"))
    ball = nearest_in_time(at, balls, p["gap"], tie="earlier").select(*TAKE, "t", cx("near.").alias("bx"), cy("near.").alias("by"))
    dist = F.hypot(F.col("px") - F.col("bx"), F.col("py") - F.col("by")) / F.col("ph")
    hit = body.join(ball, [*TAKE, "t"]).where((F.col("ph") > 0) & (dist <= p["heights"])).select(*TAKE, F.col("t").alias("t_start"), "player_track_id")
    return shots.drop("player_track_id").join(hit, [*TAKE, "t_start"])


def category_clips(events: DataFrame, takes: DataFrame, categories: dict[str, str] = config.CATEGORIES, keys: Sequence[str] = PLAYER) -> DataFrame:
    """Clips of each player and category, surest first, without near repeats."""
    names = F.create_map(*[F.lit(x) for name, kind in categories.items() for x in (kind, name)])
    rows = events.withColumn("category", names[F.col("type")]).where("category is not null")
    w = Window.partitionBy(*keys, "category").orderBy(F.desc("confidence"), "t_start", "take_id")
    ranked = clip_ranges(rows.withColumn("rank", F.row_number().over(w)), takes)
    return dedupe_clips(ranked, keys=(*keys, "category"))


def timeline(events: DataFrame, text: str | None = None, labels: dict[str, str] = config.LABELS) -> DataFrame:
    """Labelled events; possession has no row, and a key moment whose ``text`` column speaks of celebrating is a celebration."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    glad = F.lower(F.coalesce(F.col(text), F.lit(""))).contains("celebrat") if text else F.lit(False)
    label = F.when(F.col("type") == "key_moment", F.when(glad, "Celebration").otherwise("Other Key Moment")).otherwise(names[F.col("type")])
    return events.withColumn("label", label).where("label is not null")


def identity_report(verified: DataFrame) -> DataFrame:
    """Takes and verified takes of each video and the distinct verified numbers."""
    sure = F.col("status") == "verified"
    return verified.groupBy("video_id").agg(F.count("*").alias("n_takes"), F.count_if(sure).alias("n_verified"), F.sort_array(F.collect_set(F.when(sure, F.col("jersey_number")))).alias("numbers"))


def read_counters(reads: DataFrame) -> DataFrame:
    """Of each take: crops that were too small, considered, legible, and confident reads by source. ``reads``: a row a crop
    with usable, legible, confident and source."""
    seen = F.col("usable")
    return reads.groupBy(*TAKE).agg(
        F.count_if(~seen).alias("n_too_small"), F.count_if(seen).alias("n_considered"), F.count_if(seen & F.col("legible")).alias("n_legible"),
        *[F.count_if(seen & F.col("confident") & (F.col("source") == name)).alias(f"n_{name}") for name in ("parseq", "ocr", "vlm")],
    )


def event_table(events: DataFrame, clips: DataFrame) -> DataFrame:
    """Events (with event_id) with rank_score and clip of their clip, and ``place``: best first, those without a clip last in
    order of time."""
    cut = clips.select("video_id", "event_id", "rank_score", F.struct("clip_start", "clip_end").alias("clip"))
    w = Window.partitionBy("video_id").orderBy(F.desc(F.coalesce("rank_score", F.lit(-1.0))), "t_start", "event_id")
    return events.drop("rank_score").join(cut, ["video_id", "event_id"], "left").withColumn("place", F.row_number().over(w))


def annotation_report(lines: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Counts of parsed, faulty and unassigned lines of each video. ``lines``: skipped, parsed and take_id (null: none)."""
    parsed, skipped = F.coalesce("parsed", F.lit(False)), F.coalesce("skipped", F.lit(False))
    return lines.groupBy(*keys).agg(F.count_if(parsed & ~skipped).alias("n_parsed"), F.count_if(~parsed & ~skipped).alias("n_problems"), F.count_if(parsed & ~skipped & F.col("take_id").isNull()).alias("n_unassigned"))


def players_at(points: DataFrame, boxes: DataFrame, tracks: DataFrame, frame_w: float, frame_h: float, tol: float = 0.3) -> DataFrame:
    """Every player near each instant of ``points`` (referees left out): its track, chain (``identity``, else the track), box
    in shares of the frame, team and height. The box nearest in time counts, of equals the earlier."""
    near = nearest_in_time(points, boxes, tol, by=("track_id",), tie="earlier").withColumn("track_id", F.col("near.track_id"))
    chain = F.coalesce("identity", "track_id") if "identity" in tracks.columns else F.col("track_id")
    who = tracks.where(~F.col("dominant_class").eqNullSafe("referee")).select(*TAKE, "track_id", chain.alias("chain"), "team", "team_confidence")
    sides = [(F.col(f"near.{c}") / size).alias(c) for c, size in (("x1", frame_w), ("y1", frame_h), ("x2", frame_w), ("y2", frame_h))]
    return near.join(who, [*TAKE, "track_id"]).select(*points.columns, "track_id", "chain", *sides, height("near.").alias("height"), "team", "team_confidence")
