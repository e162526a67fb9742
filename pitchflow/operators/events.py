"""Detectors over speed segments, score readings and goal lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.geometry import ninth
from ..functions.text import verdict
from .possession import accepted, clamp, first_reject
from .series import TRACK, ball_speed, threshold_segments, track_speed
from .timejoin import TAKE, overlaps


def sprint_candidates(boxes: DataFrame, fps: float, params: dict = config.SPRINT) -> DataFrame:
    """Fast segments of tracks with enough boxes, and a row for each track with fewer; with ``reject``. The confidence is
    half continuity, half detector confidence, times the penalty."""
    # every window below has the order of the first, but the last, where rows come in that order anyway; no box is looked at twice
    w = Window.partitionBy(*TRACK).orderBy("t")
    whole = Window.partitionBy(*TRACK).orderBy("t", "frame_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = boxes.withColumn("__size", F.count("*").over(whole))
    moving = track_speed(sized.where(F.col("__size") >= params["boxes"]), params["window"]).withColumn("__hot", F.col("speed") >= params["threshold"])
    was = F.last(F.when(F.col("__hot"), F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("__hot") & ~F.lag("__hot").over(w) & (ninth(F.col("t") - was) >= params["merge"])
    cut = moving.select(*TRACK, "t", "speed", F.col("conf").alias("c"), "__hot", apart.alias("__apart"))
    cut = cut.withColumn("__run", F.when(F.col("__hot"), F.sum(F.when(F.col("__apart"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    # segments of a track do not overlap, so the one that a sample is in is the last that began, if it has not ended
    began = F.expr("max(__run) over (partition by video_id, take_id, track_id order by t range between unbounded preceding and 1e-9D following)")
    held = cut.withColumn("__in", began).where("__in is not null").dropna(subset=list(TRACK))
    span, hot = Window.partitionBy(*TRACK, "__in"), F.when(F.col("__hot") & (F.col("__run") == F.col("__in")), F.col("t"))
    held = held.withColumns({"t_start": F.min(hot).over(span), "t_end": F.max(hot).over(span)})
    placed = held.where((ninth(F.col("t_end") - F.col("t_start")) >= params["duration"]) & (F.col("t") <= F.col("t_end") + 1e-9))
    inside = placed.groupBy(*TRACK, "t_start", "t_end").agg(F.count("*").alias("n"), F.avg("c").alias("det"), F.avg("speed").alias("mean_speed"), F.max("speed").alias("peak_speed"))
    expected = F.greatest(F.lit(1.0), F.bround((F.col("t_end") - F.col("t_start")) * fps)) + 1
    conf = (0.5 * F.least(F.lit(1.0), F.col("n") / expected) + 0.5 * F.col("det")) * params["penalty"]
    reject = first_reject((conf < config.MIN_EMIT, "sprint_below_min_emit_confidence"))
    out = inside.select(*TAKE, F.lit("sprint").alias("type"), F.col("track_id").alias("player_track_id"), "t_start", "t_end", "n", "mean_speed", "peak_speed", conf.alias("confidence"), "det", reject.alias("reject"))
    few = boxes.groupBy(*TRACK).agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n")).where(F.col("n") < params["boxes"])
    short = few.select(*TAKE, F.lit("sprint").alias("type"), F.col("track_id").alias("player_track_id"), "t_start", "t_end", "n", F.lit("sprint_track_too_short").alias("reject"))
    return out.unionByName(short, allowMissingColumns=True)


def detect_sprints(boxes: DataFrame, fps: float, params: dict = config.SPRINT) -> DataFrame:
    """Fast segments of tracks with enough boxes."""
    return accepted(sprint_candidates(boxes, fps, params)).drop("det")


def fast_ball(balls: DataFrame, frame_width: float, params: dict = config.SHOT) -> DataFrame:
    """Segments of a fast ball with the share of dx that has the sign of their sum."""
    moving = ball_speed(balls, params["window"], frame_width, params["conf"])
    more = [F.sum("dx").alias("dx"), F.count_if(F.col("dx") > 0).alias("right"), F.count_if(F.col("dx") < 0).alias("left")]
    out = threshold_segments(moving, "speed", params["threshold"], params["duration"], params["merge"], TAKE, more)
    moved = F.col("right") + F.col("left")
    share = F.when(moved > 0, F.when(F.col("dx") >= 0, F.col("right")).otherwise(F.col("left")) / moved).otherwise(0.0)
    return out.withColumn("direction", share).drop("dx", "right", "left")


def shot_candidates(balls: DataFrame, frame_width: float, params: dict = config.SHOT) -> DataFrame:
    """Segments of a fast ball with what a shot event says, and ``reject``."""
    conf = clamp(params["min"] + 0.1 * (F.col("peak") - params["threshold"]), params)
    reject = first_reject((F.col("direction") < params["direction"], "shot_direction_inconsistent"), (conf < config.MIN_EMIT, "shot_below_min_emit_confidence"))
    return fast_ball(balls, frame_width, params).select(*TAKE, F.lit("shot").alias("type"), "t_start", "t_end", "n", F.col("peak").alias("peak_speed"), "direction", conf.alias("confidence"), reject.alias("reject"))


def detect_shots(balls: DataFrame, frame_width: float, params: dict = config.SHOT) -> DataFrame:
    return accepted(shot_candidates(balls, frame_width, params))


def score_increments(readings: DataFrame, need: int = 2) -> DataFrame:
    """Steps of +1 of a stable score: (video_id, take_id, t_before, t_after, score). ``readings``: t, score.

    The first sample is the base; another value counts once ``need`` samples in a row show it, from the first of them on. A
    stable change by anything but 1 becomes the new base without a step. Samples without a score are left out first.
    """
    w = Window.partitionBy(*TAKE).orderBy("t")
    same = F.when(F.col("score") == F.lag("score").over(w), 0).otherwise(1)
    seen = readings.where("score is not null")
    runs = seen.withColumn("__run", F.sum(same).over(w))
    stable = runs.groupBy(*TAKE, "__run", "score").agg(F.count("*").alias("n"), F.min("t").alias("t_first")).where((F.col("n") >= need) | (F.col("__run") == 1))
    order = Window.partitionBy(*TAKE).orderBy("__run")
    changed = stable.withColumn("prior", F.lag("score").over(order))
    firm = changed.where("prior is null or prior <> score").withColumn("from", F.lag("t_first").over(order)).withColumn("was", F.lag("score").over(order))
    return firm.where("score = was + 1").select(*TAKE, F.col("from").alias("t_before"), F.col("t_first").alias("t_after"), "score")


def candidate_windows(boxes: DataFrame, taken: DataFrame, params: dict = config.KEY_MOMENT) -> DataFrame:
    """Fast segments of each track that overlap none of its ``taken`` spans (player_track_id, t_start, t_end); of each take
    and track those of highest peak."""
    moving = track_speed(boxes, params["window"])
    found = threshold_segments(moving, "speed", params["threshold"], params["duration"], params["merge"], TRACK).select(*TRACK, "t_start", "t_end", "peak")
    spans = taken.select(*TAKE, F.col("player_track_id").alias("track_id"), "t_start", "t_end")
    free = overlaps(found, spans, keys=TRACK, how="left_anti")
    w = Window.partitionBy(*TRACK).orderBy(F.desc("peak"), "t_start")
    return free.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= params["top"])


def key_moments(candidates: DataFrame, answers: DataFrame, params: dict = config.KEY_MOMENT) -> DataFrame:
    """Candidates whose answer (``answers``: video_id, take_id, track_id, t_start, text) is a YES; anything else is a no."""
    said = candidates.join(answers, [*TRACK, "t_start"]).where(verdict(F.col("text")) & F.lit(params["yes"] >= params["min"]))
    return said.select(*TAKE, F.lit("key_moment").alias("type"), F.col("track_id").alias("player_track_id"), "t_start", "t_end", F.lit(params["yes"]).alias("confidence"), "text")


COLUMNS = (*TAKE, "type", "player_track_id", "t_start", "t_end", "confidence")


def all_events(*parts: DataFrame) -> DataFrame:
    """One table of the detectors' common columns, with ``acting_ids``: the tracks that did it (null where unknown), and
    ``evidence`` (a VARIANT, null where a detector gives none)."""
    rows = []
    for p in parts:
        acting = F.col("acting_ids") if "acting_ids" in p.columns else F.lit(None).cast("array<bigint>")
        told = F.col("evidence") if "evidence" in p.columns else F.lit(None).cast("variant")
        rows.append(p.select(*[F.col(c) if c in p.columns else F.lit(None).cast("long").alias(c) for c in COLUMNS], acting.alias("acting_ids"), told.alias("evidence")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def basic_events(boxes: DataFrame, balls: DataFrame, frame_width: float, fps: float = 30.0) -> DataFrame:
    """Sprints and shots alone."""
    own = F.array("player_track_id")
    return all_events(detect_sprints(boxes, fps).withColumn("acting_ids", own), detect_shots(balls, frame_width))
