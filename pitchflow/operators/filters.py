"""Row-wise filters and classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.geometry import cx, cy, own_overlap

TRACKED = ("player", "goalkeeper", "referee", "ball")


def filter_classes(detections: DataFrame, keep: tuple[str, ...] = TRACKED) -> DataFrame:
    return detections.where(F.col("cls").isin(*keep))


def dropped_classes(detections: DataFrame, keep: tuple[str, ...] = TRACKED) -> DataFrame:
    """(cls, n) of the detections that ``filter_classes`` leaves out; those without a class count as well."""
    return detections.where(~F.coalesce(F.col("cls").isin(*keep), F.lit(False))).groupBy("cls").agg(F.count("*").alias("n"))


def filter_overlap(detections: DataFrame, hints: DataFrame, most: float = 0.3) -> DataFrame:
    """Detections that an arrow of their frame does not cover by more than ``most``."""
    arrows = hints.select(F.col("video_id").alias("v_"), F.col("frame_index").alias("f_"), *[F.col(c).alias(f"h_{c}") for c in ("x1", "y1", "x2", "y2")])
    same = (F.col("video_id") == F.col("v_")) & (F.col("frame_index") == F.col("f_")) & (own_overlap("", "h_") > most)
    return detections.join(arrows, same, "left_anti")


def filter_roi(detections: DataFrame, roi: tuple[float, float, float, float], w: float, h: float) -> DataFrame:
    """Detections whose centre is outside a relative region."""
    inside = (cx() / w).between(roi[0], roi[2]) & (cy() / h).between(roi[1], roi[3])
    return detections.where(~inside)


def eligible(tracks: DataFrame, what: str = "ball") -> DataFrame:
    """Tracks for ball operators, for contests and selection (unknown classes stay), or goalkeepers."""
    cls = F.col("dominant_class")
    return tracks.where({"ball": cls.isin("player", "goalkeeper"), "contest": ~cls.eqNullSafe("referee"), "save": cls == "goalkeeper"}[what])


def source_profile(p: dict = config.PROFILE) -> tuple[Column, Column, Column]:
    """(profile, quality_flag, notes) of rows with n_cuts, cuts_per_min, motion_score, width and height."""
    motion = F.col("motion_score")
    near = F.when(motion - p["static"] <= p["panning"] - motion, "single-static").otherwise("single-panning")
    single = F.when(motion < p["static"], "single-static").when(motion > p["panning"], "single-panning").otherwise(near)
    broadcast = F.col("cuts_per_min") >= p["cuts_per_min"]
    notes = F.array_compact(F.array(F.when(~broadcast & motion.between(p["static"], p["panning"]), "ambiguous motion"), F.when(~broadcast & (F.col("n_cuts") > 0), "cuts in a single-camera video")))
    quality = F.when(F.least("width", "height") < p["low_res"], "low_res").otherwise("ok")
    return F.when(broadcast, "broadcast").otherwise(single), quality, notes


def overrides(text: Column) -> Column:
    """'take:track,track' as array<struct<take_id, track_id>> without repeats, in order; a bare id is of take 0."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^(\d+:)?\d+$"))
    pair = lambda x: F.struct(F.when(x.contains(":"), F.split(x, ":")[0]).otherwise("0").cast("int").alias("take_id"), F.regexp_extract(x, r"(\d+)$", 1).cast("int").alias("track_id"))
    return F.array_distinct(F.transform(parts, pair))


def best_ball_per_frame(candidates: DataFrame) -> DataFrame:
    """The most confident ball of each frame out of tile-local boxes shifted by tile_x and tile_y; ties: the leftmost."""
    box = F.struct((F.col("x1") + F.col("tile_x")).alias("x1"), (F.col("y1") + F.col("tile_y")).alias("y1"), (F.col("x2") + F.col("tile_x")).alias("x2"), (F.col("y2") + F.col("tile_y")).alias("y2"), "conf")
    best = candidates.withColumn("__box", box).groupBy("video_id", "frame_index", "t").agg(F.max_by("__box", F.struct("conf", -F.col("__box.x1"), -F.col("__box.y1"))).alias("b"))
    return best.select("video_id", "frame_index", "t", "b.*")


def suppress_overlaps(detections: DataFrame, most: float = 0.5, by_class: bool = True) -> DataFrame:
    """Of each frame (and class), best confidence first, the boxes whose IoU with every kept one is at most ``most``."""
    keys = ["video_id", "frame_index", *(["cls"] if by_class else [])]
    rest = [c for c in detections.columns if c not in (*keys, "conf")]
    held = detections.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("conf", *rest)), asc=False).alias("__all"))
    both = "greatest(least(k.x2, r.x2) - greatest(k.x1, r.x1), 0D) * greatest(least(k.y2, r.y2) - greatest(k.y1, r.y1), 0D)"
    area = "greatest({0}.x2 - {0}.x1, 0D) * greatest({0}.y2 - {0}.y1, 0D)"
    hit = f"{both} > {most} * ({area.format('k')} + {area.format('r')} - {both})"
    kept = F.expr(f"aggregate(__all, slice(__all, 1, 0), (acc, r) -> if(exists(acc, k -> {hit}), acc, concat(acc, array(r))))")
    return held.select(*keys, F.inline(kept)).select(*detections.columns)
