"""Domain tables derived from the test tables by integer arithmetic, so that they grow with the input.

A video is 1500 rows of ``events`` at 25 frames a second, a take 250 frames; twelve tracks move in triangle waves and lose
some boxes, and one ball goes from track to track.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timejoin import deal_for, dealt

FPS = 25.0
WIDTH = 1280.0
TRACKS = 12


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a frame. Rows are dealt to tasks by take here, while they are few and narrow: what is derived from them stays
    where it is, so windows, groups and joins by take or track move no box again. Files tell how many frames there are."""
    events = _read(spark, sf_dir, "events")
    deal_for(spark, events.count())
    rows = events.selectExpr("event_id", "cast(floor(event_id / 1500) as bigint) as video_id", "cast(floor((event_id % 1500) / 250) as bigint) as take_id")
    return dealt(rows).selectExpr("event_id", "video_id", "event_id % 1500 as frame_index", "take_id", "(event_id % 1500) / 25D as t")


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy("video_id", "take_id").agg(F.min("t").alias("t_start")).withColumn("t_end", F.col("t_start") + 10.0)


def _wave(n: str, p: int) -> str:
    return f"abs(({n}) % {2 * p} - {p})"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).withColumn("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TRACKS - 1).cast("long"))))
    return rows.where("(frame_index + 7 * track_id) % 53 <> 0").selectExpr(
        "video_id", "take_id", "track_id", "frame_index", "t",
        f"cast(100 + 80 * track_id + {_wave('frame_index * (track_id % 6 + 1)', 300)} as double) as x1",
        "cast(200 + 40 * (track_id % 5) as double) as y1",
        f"cast(140 + 80 * track_id + {_wave('frame_index * (track_id % 6 + 1)', 300)} as double) as x2",
        "cast(300 + 40 * (track_id % 5) as double) as y2",
        "(5 + track_id % 5) / 10D as conf",
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).groupBy("video_id", "take_id", "track_id").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n_boxes")).selectExpr(
        "*", "cast(track_id % 2 as int) as team", "if(track_id = 9, 0.3D, 0.8D) as team_confidence",
        "case when track_id in (0, 6) then 'goalkeeper' when track_id = 11 then 'referee' else 'player' end as dominant_class",
        "named_struct('l', 50D, 'a', if(track_id % 4 = 3, cast(null as double), 15D * (track_id % 3)), 'b', 0D) as kit",
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track 10 goes on as track 9; identities are sure to different degrees."""
    return tracks(spark, sf_dir).selectExpr(
        "video_id", "take_id", "track_id", "if(track_id = 10, 9, track_id) as identity", "(8 + if(track_id = 10, 9, track_id) % 3) / 10D as confidence"
    )


def balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    holder = f"cast(floor(frame_index / 20) as bigint) % {TRACKS}"  # the referee, track 11, is passed as well
    x = f"100 + 80 * ({holder}) + {_wave(f'frame_index * (({holder}) % 6 + 1)', 300)} + (frame_index * 7) % 60 - 10"
    y = f"250 + 40 * (({holder}) % 5) + case when frame_index % 20 >= 12 then 300 else 0 end"  # in flight
    return frames(spark, sf_dir).where("event_id % 11 <> 0").selectExpr(
        "video_id", "take_id", "frame_index", "t", f"cast({x} - 5 as double) as x1", f"cast({y} - 5 as double) as y1",
        f"cast({x} + 5 as double) as x2", f"cast({y} + 5 as double) as y2", "(2 + event_id % 8) / 10D as conf",
    )


def digit_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey as bigint) as take_id", "cast(l_partkey % 4 as bigint) as track_id",
        "case when l_linenumber = 7 then null else cast(l_linenumber % 5 as string) end as digits",
        "cast(l_linenumber as double) / 10D as confidence",
    )


def annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parsable line of every third event; texts of documents as junk."""
    ev = _read(spark, sf_dir, "events").selectExpr(
        "event_id as line_no",
        """case when event_id % 3 = 0 then concat('Min ', cast(event_id % 90 as string), ':', lpad(cast(event_id % 60 as string), 2, '0'),
             ' player #', cast(event_id % 30 as string), case when event_id % 2 = 0 then ' in white' else '' end, ' makes a ', event_type)
           when event_id % 3 = 1 then concat('# ', event_type) else concat(event_type, ' without a time') end as line""",
    )
    return ev
