"""Readers and writers of record tables, sidecar texts and video listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENSIONS = ("mp4", "mov", "mkv", "avi", "m4v")


def conformed(value: Column, has: T.DataType, wanted: T.DataType) -> Column:
    """A value as ``wanted``, at every depth: NaN that stands for a missing integer becomes null, structs get the fields of
    the schema in its order (null where the file has none), other fields are left out."""
    if isinstance(wanted, T.ArrayType) and isinstance(has, T.ArrayType):
        return F.transform(value, lambda x: conformed(x, has.elementType, wanted.elementType))
    if isinstance(wanted, T.StructType) and isinstance(has, T.StructType):
        held = {f.name: f.dataType for f in has}
        fields = [(conformed(value[f.name], held[f.name], f.dataType) if f.name in held else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(wanted, T.IntegralType) and isinstance(has, T.DoubleType | T.FloatType):
        return F.when(~F.isnan(value), value).cast(wanted)
    return value.cast(wanted)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet record table with the columns of ``schema`` in their types, nested ones too (see ``conformed``), after any
    others of the file; a column that the file lacks is an error. A nested box becomes columns."""
    df = spark.read.parquet(path)
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    df = df.withColumns({f.name: conformed(F.col(f.name), df.schema[f.name].dataType, f.dataType) for f in schema})
    return df.select("*", "bbox.*").drop("bbox") if "bbox" in df.columns else df


def track_boxes(tracks: DataFrame) -> DataFrame:
    """One row a box out of track records that hold their boxes as an array: the track's video_id, take_id and id (as
    track_id), and frame_index, t, x1, y1, x2, y2, conf. Tracks without boxes give none."""
    flat = tracks.select("video_id", "take_id", F.col("id").alias("track_id"), F.explode("boxes").alias("b"))
    return flat.select("video_id", "take_id", "track_id", "b.frame_index", "b.t", "b.bbox.*", "b.conf")


def write_records(df: DataFrame, path: str) -> None:
    df.write.partitionBy("video_id").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """video_id (the file's stem), line_no from 1, line.

    Lines are read as a stream, a large file in several tasks, and numbered by file, block and order in the block; no file is
    held whole. An end of line at the end of a file does not begin another line."""
    # files that are read in one task get numbers that grow along it, so order by block first and by number inside
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn("__n", F.monotonically_increasing_id())
    w = Window.partitionBy("file_path").orderBy("file_block_start", "__n")
    stem = F.regexp_extract(F.url_decode("file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return lines.select(stem.alias("video_id"), F.row_number().over(w).alias("line_no"), F.col("value").alias("line"))


def discover_videos(listing: DataFrame) -> DataFrame:
    """Listed video files with clip_index and target_jersey from names like 'clip2 77', and their order."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem, ext = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    number = lambda k: F.nullif(F.regexp_extract(stem, r"^clip(\d+) (\d+)$", k), F.lit("")).cast("int")
    out = listing.where(ext.isin(*EXTENSIONS)).withColumn("clip_index", number(1)).withColumn("target_jersey", number(2))
    return out.orderBy(F.col("clip_index").isNull(), "clip_index", "path")


def frame_manifest(videos: DataFrame, fps: float, chunk_s: float) -> DataFrame:
    """video_id, chunk_id, index, t of every sampled frame; the index runs on over chunks."""
    n = F.ceil(F.col("duration") / chunk_s)
    chunks = videos.where("duration > 0").select("video_id", "duration", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk_id"))
    start = F.col("chunk_id") * chunk_s
    size = lambda c: F.bround(F.least(F.lit(chunk_s), F.col("duration") - c * chunk_s) * fps).cast("long")
    full = F.bround(F.lit(chunk_s * fps)).cast("long")
    rows = chunks.withColumn("n", size(F.col("chunk_id"))).where("n > 0").select("video_id", "chunk_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return rows.select("video_id", "chunk_id", (F.col("chunk_id") * full + F.col("i")).alias("index"), (start + F.col("i") / fps).alias("t"))


def write_player_tree(cards: DataFrame, timeline: DataFrame, clips: DataFrame, path: str) -> None:
    """Cards, timeline rows and clip lists under ``path``, each in folders by video_id and player (see ``text.player_key``).
    Rows of one player are sorted and lie together, so that a player's folder holds few files. Folders of
    other players stay."""
    for name, df, order in (("cards", cards, ()), ("timeline", timeline, ("t_start",)), ("clips", clips, ("category", "rank"))):
        df.repartition("video_id", "player").sortWithinPartitions("video_id", "player", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id", "player").parquet(f"{path}/{name}")
