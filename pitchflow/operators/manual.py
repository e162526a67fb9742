"""Events that people typed, and the tracks and players that they mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from .events import candidate_windows
from .identity import merge_fragments
from .stats import attribute
from .target import _match
from .timejoin import TAKE, drop_near, nearest_in_time

#: Types of events that leave no room for a key moment.
TAKEN = ("sprint", "dribble", "possession")
EVENT = ("type", "player_track_id", "t_start", "t_end", "confidence", "source")


def _instants(rows: DataFrame, kind, source: str, params: dict) -> DataFrame:
    end = F.col("t") + params["window"]
    made = {"type": kind, "player_track_id": F.lit(None).cast("long"), "t_start": F.col("t"), "t_end": end, "confidence": F.lit(params["confidence"]), "source": F.lit(source)}
    return rows.withColumns(made).drop("t", "event_type")


def manual_touches(times: DataFrame, params: dict = config.MANUAL) -> DataFrame:
    """Touches of no certain player at typed instants ``t``; other columns pass through."""
    return _instants(times.where("t is not null"), F.lit("touch"), "manual_touch", params)


def annotation_events(annotations: DataFrame, params: dict = config.MANUAL) -> DataFrame:
    """Events of no certain player from annotations with ``t`` and ``event_type``; what was written passes through."""
    return _instants(annotations.where("t is not null"), F.col("event_type"), "manual_annotation", params)


def merge_touches(events: DataFrame, manual: DataFrame, params: dict = config.MANUAL, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """``events`` and the typed touches, with ``suppressed``: true for the automatic touches that are within ``merge``
    seconds of a typed one. Only rows that are not suppressed are events; the others are there to be counted."""
    touch = events.where("type = 'touch'")
    times = manual.select(*keys, F.col("t_start").alias("t"))
    rest = events.where("type is distinct from 'touch'")
    gone = drop_near(touch, times, params["merge"], keys, how="left_semi")
    kept = drop_near(touch, times, params["merge"], keys)
    parts = [(rest, False), (kept, False), (gone, True), (manual, False)]
    rows = [df.withColumn("suppressed", F.lit(flag)) for df, flag in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def candidate_tracks(points: DataFrame, boxes: DataFrame, tol: float) -> DataFrame:
    """``points`` with each track_id of the take that has a box at most ``tol`` seconds away."""
    near = nearest_in_time(points, boxes.select(*TAKE, "track_id", "t"), tol, by=("track_id",))
    return near.select(*points.columns, F.col("near.track_id").alias("track_id"))


def hinted_tracks(points: DataFrame, hints: DataFrame, boxes: DataFrame, window: float = 1.0, p: dict = config.SELECTION) -> DataFrame:
    """``points`` with the track (and its distance) that the arrow nearest in time, at most ``window`` seconds away, points
    at; ``hints``: video_id, take_id, t, x, y of the tips. Points without such an arrow or track are left out."""
    near = nearest_in_time(points, hints.select(*TAKE, "t", "x", "y"), window, tie="earlier")
    tips = near.select(*[F.col(c).alias("asked" if c == "t" else c) for c in points.columns], F.col("near.t").alias("t"), F.col("near.x").alias("x"), F.col("near.y").alias("y"))
    found = _match(tips, boxes, p["tolerance"], p["tip"])
    return found.select(*[F.col("asked").alias("t") if c == "t" else F.col(c) for c in points.columns], "track_id", "dist")


def target_identity(identities: DataFrame, targets: DataFrame) -> DataFrame:
    """The identity of most of a target's tracks in each take; of equals the one whose first listed track (``place``, else
    track_id) comes first. Takes without a known track have no row."""
    place = "place" if "place" in targets.columns else "track_id"
    known = targets.join(identities.select(*TAKE, "track_id", "identity"), [*TAKE, "track_id"])
    votes = known.groupBy(*TAKE, "identity").agg(F.count("*").alias("n"), F.min(place).alias("__first"))
    return votes.groupBy(*TAKE).agg(F.max_by(F.struct("identity", "n"), F.struct("n", -F.col("__first"))).alias("m")).select(*TAKE, "m.identity", F.col("m.n").alias("n_tracks"))


def union_chains(chains: DataFrame, tracks: DataFrame) -> DataFrame:
    """Every track of a take's chains once, with ``place`` in order of first box; tracks that are unknown come last."""
    ids = chains.select(*TAKE, "track_id").distinct().join(tracks.select(*TAKE, "track_id", "t_start"), [*TAKE, "track_id"], "left")
    w = Window.partitionBy(*TAKE).orderBy(F.asc_nulls_last("t_start"), "track_id")
    return ids.withColumn("place", F.row_number().over(w)).select(*TAKE, "track_id", "place")


def target_windows(boxes: DataFrame, targets: DataFrame, events: DataFrame, params: dict = config.KEY_MOMENT) -> DataFrame:
    """Where a target may have had a key moment: fast windows of its tracks merged into one, less those that its sprints,
    dribbles and possession overlap; of each take those of highest peak. ``targets``: video_id, take_id, track_id of one
    player; ``events`` with ``acting_ids``."""
    own = merge_fragments(boxes, targets)
    name = targets.select(*TAKE, "track_id").join(boxes.select(*TAKE, "track_id").distinct(), [*TAKE, "track_id"], "left_semi").groupBy(*TAKE).agg(F.min("track_id").alias("player_track_id"))
    taken = attribute(events.where(F.col("type").isin(*TAKEN)), targets).drop("player_track_id")
    return candidate_windows(own, taken.join(name, list(TAKE)).select(*TAKE, "player_track_id", "t_start", "t_end"), params)
