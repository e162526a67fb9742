"""Typed evidence of events in one semi-structured column.

The detectors' tables have columns of their own; in the one table of all events what an event rests on is a VARIANT. What a
type's evidence holds, and of which kind, is written down once, in ``EVIDENCE``; ``pack`` makes the column by it and ``typed``
reads it back into columns, so a later step (attribution, suppression, scorers) works from the one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timejoin import TAKE

#: The fields of each type's evidence and their kinds.
EVIDENCE: dict[str, dict[str, str]] = {
    "sprint": {"track_id": "bigint", "peak_speed": "double", "mean_speed": "double", "mean_detection_confidence": "double", "n_boxes_in_window": "bigint"},
    "shot": {"peak_speed": "double", "direction_consistency": "double"},
    "touch": {"raw_track_id": "bigint", "distance_px": "double", "ball_confidence": "double", "ball_velocity_delta": "double"},
    "possession": {"raw_track_ids": "array<bigint>", "n_ball_samples": "bigint", "mean_distance_px": "double"},
    "pass": {
        "passer_identity": "bigint", "receiver_identity": "bigint", "passer_raw_track_id": "bigint", "receiver_raw_track_id": "bigint",
        "ball_travel_px": "double", "gap_s": "double", "kick_verified": "boolean",
    },
    "turnover": {
        "losing_identity": "bigint", "receiving_identity": "bigint", "losing_raw_track_id": "bigint", "receiving_raw_track_id": "bigint",
        "losing_team": "int", "receiving_team": "int", "ball_travel_px": "double", "gap_s": "double",
    },
    "dribble": {"travel_bbox_heights": "double", "contested": "boolean", "raw_track_ids": "array<bigint>"},
    "tackle": {
        "tackler_identity": "bigint", "tackled_identity": "bigint", "tackler_raw_track_id": "bigint", "tackled_raw_track_id": "bigint",
        "closing_speed": "double", "gap_s": "double",
    },
    "save": {"goalkeeper_track_id": "bigint", "peak_speed_before": "double", "peak_speed_after": "double", "decelerated": "boolean", "reversed_direction": "boolean"},
}
#: How each type's events were found, and the unit of their distances or speeds.
SOURCES = {
    "sprint": ("speed_heuristic_normalized_pixel", "bbox_heights_per_second"), "shot": ("heuristic_ball_motion", "frame_widths_per_second"),
    "touch": ("ball_proximity_and_velocity_change_heuristic", "pixels_at_detect_stage_resolution"),
    "possession": ("ball_proximity_possession_heuristic", "pixels_at_detect_stage_resolution"),
    "pass": ("possession_change_teammate_heuristic", "pixels_at_detect_stage_resolution"),
    "turnover": ("possession_change_opposing_colour", "pixels_at_detect_stage_resolution"),
    "dribble": ("possession_contested_travel_heuristic", "bbox_heights"),
    "tackle": ("possession_change_closing_speed_heuristic", "bbox_heights_per_second"),
    "save": ("ball_deceleration_near_goalkeeper_heuristic", "frame_widths_per_second"),
}
#: Where an event's evidence names the tracks that did it; sprints and saves name a track as the player.
ACTING = {"pass": "passer_raw_track_id", "turnover": "losing_raw_track_id", "touch": "raw_track_id", "tackle": "tackler_raw_track_id"}
ACTING_LISTS = ("possession", "dribble")


def pack(kind: str, **columns: Column | str) -> Column:
    """The evidence of a type out of its columns, one for each of its fields."""
    fields = EVIDENCE[kind]
    if set(columns) != set(fields):
        raise ValueError(f"evidence of {kind} has {sorted(fields)}, not {sorted(columns)}")
    given = [(F.col(c) if isinstance(c, str) else c).cast(fields[name]).alias(name) for name, c in columns.items()]
    return F.to_variant_object(F.struct(*given))


def field(kind: str, name: str) -> Column:
    """One field of the evidence of events of a type; null in events of other types."""
    return F.when(F.col("type") == kind, F.variant_get("evidence", f"$.{name}", EVIDENCE[kind][name]))


def typed(events: DataFrame, kind: str) -> DataFrame:
    """The events of one type with its evidence as columns."""
    rest = [c for c in events.columns if c != "evidence"]
    return events.where(F.col("type") == kind).select(*rest, *[F.variant_get("evidence", f"$.{name}", of).alias(name) for name, of in EVIDENCE[kind].items()])


def acting_ids(events: DataFrame) -> Column:
    """array<bigint> of the tracks that did an event, as its evidence names them; else the player of a sprint or save."""
    one = [F.array(F.when(F.col("type") == kind, field(kind, name))) for kind, name in ACTING.items()]
    found = F.coalesce(*[F.when(F.col("type") == kind, c) for (kind, _), c in zip(ACTING.items(), one, strict=True)], *[field(kind, "raw_track_ids") for kind in ACTING_LISTS])
    own = F.when(F.col("type").isin("sprint", "save"), F.array("player_track_id"))
    return F.coalesce(found, own)


def described(events: DataFrame) -> DataFrame:
    """``events`` with source, unit and calibrated of their types."""
    of = lambda k: F.create_map(*[F.lit(x) for kind, two in SOURCES.items() for x in (kind, two[k])])[F.col("type")]
    return events.withColumns({"source": of(0), "unit": of(1), "calibrated": F.lit(False)})


def turnovers_without_tackles(events: DataFrame, window: float) -> DataFrame:
    """``events`` with ``covered``: whether a tackle between the same two tracks, ending at most ``window`` seconds apart, says
    the same as a turnover. Read from the evidence of both."""
    tackles = typed(events, "tackle").select(
        F.col("video_id").alias("v_"), F.col("take_id").alias("k_"), F.col("tackler_raw_track_id").alias("by_"), F.col("tackled_raw_track_id").alias("of_"), F.col("t_end").alias("e_")
    )
    same = (F.col("video_id") == F.col("v_")) & (F.col("take_id") == F.col("k_")) & (field("turnover", "receiving_raw_track_id") == F.col("by_")) & (field("turnover", "losing_raw_track_id") == F.col("of_"))
    near = F.abs(F.col("t_end") - F.col("e_")) <= window
    lost = events.where("type = 'turnover'")
    hits = lost.join(tackles, same & near, "left_semi").withColumn("covered", F.lit(True))
    free = lost.join(tackles, same & near, "left_anti").withColumn("covered", F.lit(False))
    return events.where("type <> 'turnover'").withColumn("covered", F.lit(False)).unionByName(hits).unionByName(free)


def possession_of(events: DataFrame) -> DataFrame:
    """The table of possession that scorers are found in, out of all events."""
    return typed(events, "possession").select(*TAKE, "player_track_id", "t_start", "t_end", "raw_track_ids", "confidence")


def passes_of(events: DataFrame) -> DataFrame:
    """The table of passes that assists are found in, out of all events."""
    own = typed(events, "pass")
    return own.select(*TAKE, "type", F.col("passer_identity").alias("passer"), F.col("receiver_identity").alias("receiver"), "t_start", "t_end", "confidence")
