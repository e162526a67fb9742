"""Joins of tables by time inside a take. Every join is an equi-join on the take and a time bucket as wide as the
tolerance, so one long take spreads over many tasks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import ninth, point_to_box

TAKE = ("video_id", "take_id")
#: Buckets are a little wider than the tolerance, so that rounding never parts two rows a whole tolerance apart.
BROADER = 1.001
#: Frames that a task is dealt at most on average, and the session's setting for how many tasks that makes.
FRAMES = 20_000
TASKS = "pitchflow.dealt.tasks"
#: More tasks than any table has.
MANY = 2**30


#: Folders of the tables that ``settled`` has written in this process.
_SETTLED: list[str] = []


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table in the session's checkpoint folder, where it has one, so that what reads it several times reads rows
    and not its plan, a lost executor costs no more than the step after it, and readers take the columns they need. Without a
    folder as it is, and a settled table as it is. The table stays until ``unsettle``. Rows with a take are dealt to tasks by it,
    as in ``dealt``."""
    if "_is_settled" in df.__dict__:
        return df
    folder = df.sparkSession.sparkContext.getCheckpointDir()
    if folder is None:
        return df
    _SETTLED.append(f"{folder}/settled-{uuid.uuid4().hex}")
    df.write.parquet(_SETTLED[-1])
    table = df.sparkSession.read.schema(df.schema).parquet(_SETTLED[-1])
    out = dealt(table) if set(TAKE) <= set(table.columns) else table
    out._is_settled = True
    return out


def deal_for(spark: SparkSession, frames: int) -> None:
    """Have tables dealt to as many tasks as leave ``FRAMES`` to each, so that a task needs no more memory for more videos. All
    tables of a job must be dealt alike to meet, whatever their own rows, so the session holds the number."""
    spark.conf.set(TASKS, -(-frames // FRAMES))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` with its rows dealt to tasks by take, to as many as the session's shuffles have, or as ``deal_for`` says if these
    are more. Tables dealt so meet one another in windows, groups and joins whose keys hold the take without moving again."""
    conf = df.sparkSession.conf
    return df.repartition(max(int(conf.get("spark.sql.shuffle.partitions")), int(conf.get(TASKS, "0"))), *TAKE)


def apart(df: DataFrame) -> DataFrame:
    """``df`` in tasks of its own. A union takes tables that are dealt alike into the same tasks, one after the other, and a task
    keeps the memory of every sort until it ends. Coalescing to more tasks than there are moves no row, but a union does not join such tasks."""
    return df.coalesce(MANY)


def of_tracks(boxes: DataFrame, tracks: DataFrame, *more: str, key: str = "track_id", keep: bool = False) -> DataFrame:
    """``boxes`` of the tracks in ``tracks``; with the columns ``more`` of these, if named (then once a row of ``tracks``). They
    meet by take alone and the list of its tracks: dealt tables do so in place, but a join by take and track would move every
    box. ``key`` names the column of ``boxes`` with the track; with ``keep`` rows of other tracks stay, with nulls for ``more``."""
    named = tracks.where(F.col("track_id").isNotNull())
    if not more and not keep:
        known = named.groupBy(*TAKE).agg(F.collect_set("track_id").alias("__known"))
        return boxes.join(known.hint("shuffle_hash"), list(TAKE)).where(F.array_contains("__known", F.col(key))).select(*boxes.columns)
    held = named.groupBy(*TAKE).agg(F.collect_list(F.struct(F.col("track_id").alias("__id"), *more)).alias("__known"))
    both = boxes.join(held.hint("shuffle_hash"), list(TAKE), "left" if keep else "inner")
    hits = F.filter("__known", lambda k: k["__id"] == F.col(key))
    return both.select(*boxes.columns, (F.explode_outer if keep else F.explode)(hits).alias("__hit")).select(*boxes.columns, *[F.col(f"__hit.{c}") for c in more])


def unsettle(spark: SparkSession) -> None:
    """Delete the tables of ``settled``, once the results that read them are written."""
    while _SETTLED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SETTLED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def assign_take(points: DataFrame, takes: DataFrame) -> DataFrame:
    """``points`` with take_id: the take with t_start <= t < t_end, else the first whose closed span holds t; points
    outside every take have none. Takes are matched as of time, so each point is looked at once."""
    marks = takes.select("video_id", F.col("t_start").alias("t"), F.struct("take_id", "t_start", "t_end").alias("take"))
    cols = points.columns
    rows = points.select(*cols, F.lit(None).cast(marks.schema["take"].dataType).alias("take"), F.lit(1).alias("__late"))
    starts = marks.select(*[(F.col(c) if c in ("video_id", "t") else F.lit(None).cast(points.schema[c].dataType)).alias(c) for c in cols], "take", F.lit(0).alias("__late"))
    order = Window.partitionBy("video_id").orderBy("t", "__late")
    now = F.last("take", ignorenulls=True).over(order)
    prior = F.last(F.when(F.col("take").isNotNull(), F.col("take")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = rows.unionByName(starts).withColumn("__now", now).withColumn("__prior", prior)
    t = F.col("t")
    hit = F.when((t >= F.col("__now.t_start")) & (t <= F.col("__now.t_end")), F.col("__now.take_id")).when(t <= F.col("__prior.t_end"), F.col("__prior.take_id"))
    return both.withColumn("take_id", hit).where("__late = 1").select(*[c for c in cols if c != "take_id"], "take_id")


def nearest_in_time(
    left: DataFrame, right: DataFrame, tol: float, by: Sequence[str] = (), tie: str = "later", keys: Sequence[str] = TAKE, keep: bool = False
) -> DataFrame:
    """For each row of ``left`` and value of ``by``, the row of ``right`` (struct ``near``) least far in time and at most
    ``tol`` away. Equal distances: the ``later`` or ``earlier`` row. Rows without one are left out, or with ``keep`` have
    nulls (one row for each value of ``by`` about).

    Both sides are sorted together by time inside their keys and a time bucket, and each row looks at its neighbours before
    and after; rows near a bucket's edge stand in both buckets. With ``by`` a row goes once to each value in its bucket.
    """
    wide, cols = tol * BROADER, left.columns
    width = max(16 * wide, 4.0)
    group = [f"__k_{c}" for c in (*keys, *by)] + ["__b"]
    spread = F.explode(F.sequence(F.floor((F.col("t") - wide) / width), F.floor((F.col("t") + wide) / width)))
    marks = right.select(*[F.col(c).alias(f"__k_{c}") for c in (*keys, *by)], spread.alias("__b"), F.col("t").alias("__t"), F.struct(*right.columns).alias("__near"))
    rest = [c for c in cols if c not in keys]  # keys stand in a row once, so that dealt tables are seen to be dealt alike
    points = left.select(*rest, *[F.col(c).alias(f"__k_{c}") for c in keys], F.floor(F.col("t") / width).alias("__b"))
    if by:
        # a window and no join: its keys hold more than the take, so a join would deal both sides anew, and then all boxes
        place = [f"__k_{c}" for c in (*keys,)] + ["__b"]
        there = marks.select(*group).dropna(subset=place).distinct().select(*place, F.struct(*[f"__k_{c}" for c in by]).alias("__who"))
        both = points.withColumn("__who", F.lit(None).cast(there.schema["__who"].dataType)).withColumn("__p", F.lit(1))
        both = both.unionByName(there.withColumn("__p", F.lit(0)), allowMissingColumns=True)
        asked = both.withColumn("__who", F.collect_set("__who").over(Window.partitionBy(*place))).where("__p = 1")
        points = asked.select(*rest, *place, (F.explode_outer if keep else F.explode)("__who").alias("__who")).select(*rest, *place, "__who.*")
    kind = marks.schema["__near"].dataType
    rows = points.select(*group, F.col("t").alias("__t"), F.lit(None).cast(kind).alias("__near"), F.lit(1).alias("__p"), *rest)
    none = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest]
    both = rows.unionByName(marks.select(*group, "__t", "__near", F.lit(0).alias("__p"), *none))
    w = Window.partitionBy(*group)
    last = lambda *order: F.last("__near", ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__before", last("__t", "__p")).withColumn("__after", last(F.desc("__t"), "__p")).where("__p = 1")
    back, on = ninth(F.col("__t") - F.col("__before.t")), ninth(F.col("__after.t") - F.col("__t"))
    ahead = back.isNull() | (on < back) | ((on == back) if tie == "later" else F.lit(False))
    chosen = F.when(on.isNotNull() & ahead, F.when(on <= tol, F.col("__after"))).otherwise(F.when(back <= tol, F.col("__before")))
    out = found.select(*[F.col(f"__k_{c}").alias(c) if c in keys else F.col(c) for c in cols], chosen.alias("near"))
    return out if keep else out.where("near is not null")


def near_boxes(points: DataFrame, boxes: DataFrame, tol: float, as_set: bool = False) -> DataFrame:
    """``points`` with ``near``: of each track of their take the box nearest in time (struct of the columns of ``boxes`` but the
    take; ties: the later), at most ``tol`` away; an empty array where there is none. With ``as_set`` equal points are one.

    A box can be the nearest one from half way to the box of its track before it to half way to the next. It goes to the cells
    of the take, as long as the tolerance, that this span reaches into, one or two of them, so a point looks at the boxes of
    its own cell alone, and most of these are told off by two comparisons. What goes into a group is a cell."""
    wide = tol * BROADER
    rest, sides = [c for c in points.columns if c not in TAKE], [c for c in boxes.columns if c not in (*TAKE, "track_id", "t")]
    kind = lambda df, c: df.select(c.alias("c")).schema["c"].dataType
    box, point = F.struct("track_id", "t", *sides), F.struct(*rest)
    marks = boxes.dropna(subset=[*TAKE, "track_id", "t"]).select(*TAKE, "track_id", "t", box.alias("b"), F.lit(None).cast(kind(points, point)).alias("__point"))
    none = F.lit(None).cast(boxes.schema["track_id"].dataType).alias("track_id")
    both = marks.unionByName(points.select(*TAKE, none, "t", F.lit(None).cast(kind(boxes, box)).alias("b"), point.alias("__point")))
    # boxes within two nanoseconds may be equally near to a point, so they end no span of each other's
    over = "over (partition by video_id, take_id, track_id order by t)"
    lo = F.expr(f"if(b is null, t, greatest(t - {wide!r}D, if(t - lag(t) {over} > 2e-9D, (t + lag(t) {over}) / 2 - 1e-8D, null)))")
    hi = F.expr(f"if(b is null, t, least(t + {wide!r}D, if(lead(t) {over} - t > 2e-9D, (t + lead(t) {over}) / 2 + 1e-8D, null)))")
    owned = both.select(*TAKE, "b", "__point", lo.alias("lo"), hi.alias("hi"))
    spread = owned.withColumn("__c", F.explode_outer(F.sequence(F.floor(F.col("lo") / wide), F.floor(F.col("hi") / wide))))
    held = F.collect_list(F.when(F.col("b").isNotNull(), F.struct("lo", "hi", "b")))
    cells = spread.groupBy(*TAKE, "__c").agg(held.alias("__boxes"), (F.collect_set if as_set else F.collect_list)("__point").alias("__points")).where(F.size("__points") > 0)
    off = "rint(abs({p}.t - q.t) * 1e9)"  # whole nanoseconds; rounding a double to digits goes through decimals, at a hundred times the cost
    nearer = f"o.track_id = p.track_id and ({off.format(p='o')} < {off.format(p='p')} or {off.format(p='o')} = {off.format(p='p')} and o > p)"
    alone = f"if(size(c) = size(array_distinct(transform(c, p -> p.track_id))), c, transform(array(array_distinct(c)), d -> filter(d, p -> not exists(d, o -> {nearer})))[0])"
    there = f"transform(filter(__boxes, p -> p.lo <= q.t and q.t <= p.hi and {off.format(p='p.b')} <= {round(tol * 1e9)}), p -> p.b)"
    held = ", ".join(f"'{c}', q.{c}" for c in rest)
    found = F.expr(f"transform(__points, q -> named_struct({held}, 'near', transform(array({there}), c -> {alone})[0]))")
    return cells.select(*TAKE, F.inline(found)).select(*points.columns, "near")


def nearest_player(balls: DataFrame, boxes: DataFrame, tol: float) -> DataFrame:
    """``balls`` (with x, y) with track_id and dist of the nearest box: of each track the box nearest in time (ties: the
    later), of the tracks the least distance (ties: the lowest id). Balls without a box in reach keep nulls; equal balls
    are one."""
    far = "sqrt(pow(greatest(p.x1 - x, x - p.x2, 0D), 2) + pow(greatest(p.y1 - y, y - p.y2, 0D), 2))"
    best = F.expr(f"array_min(transform(near, p -> named_struct('dist', {far}, 'track_id', p.track_id)))")
    found = near_boxes(balls, boxes.select(*TAKE, "track_id", "t", "x1", "y1", "x2", "y2"), tol, as_set=True)
    return found.select(*balls.columns, best.alias("__best")).select(*balls.columns, "__best.track_id", "__best.dist")


def bracket(points: DataFrame, samples: DataFrame, value: Sequence[str], keys: Sequence[str] = TAKE) -> DataFrame:
    """``points`` with ``before`` and ``after`` (structs of t and ``value``): the samples round t, and ``fraction``."""
    cols = points.columns
    kind = F.struct("t", *value)
    rows = points.withColumn("__s", F.lit(None).cast(samples.select(kind.alias("s")).schema["s"].dataType)).withColumn("__p", F.lit(1))
    marks = samples.select(*[(F.col(c) if c in (*keys, "t") else F.lit(None).cast(points.schema[c].dataType)).alias(c) for c in cols], kind.alias("__s"), F.lit(0).alias("__p"))
    both = rows.unionByName(marks)
    w = Window.partitionBy(*keys)
    before = F.last("__s", ignorenulls=True).over(w.orderBy("t", "__p"))
    after = F.last("__s", ignorenulls=True).over(w.orderBy(F.desc("t"), "__p"))
    out = both.withColumn("before", before).withColumn("after", after).where("__p = 1")
    span = F.col("after.t") - F.col("before.t")
    return out.select(*cols, "before", "after", F.when(span > 0, (F.col("t") - F.col("before.t")) / span).when(span == 0, 0.0).alias("fraction"))


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str] = TAKE, how: str = "inner", closed: bool = False, width: float = 10.0) -> DataFrame:
    """Rows of a and b (its columns prefixed b_) whose [t_start, t_end] spans overlap: open, or closed. ``how`` may be
    left_semi or left_anti. Spans are dealt to buckets of ``width`` seconds; a pair counts in its first common one."""
    ids = a.withColumn("__b", F.explode(F.sequence(F.floor(F.col("t_start") / width), F.floor(F.col("t_end") / width))))
    other = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]).withColumn("__rb", F.explode(F.sequence(F.floor(F.col("b_t_start") / width), F.floor(F.col("b_t_end") / width))))
    cut = (F.col("t_end") >= F.col("b_t_start")) & (F.col("t_start") <= F.col("b_t_end")) if closed else (F.col("t_end") > F.col("b_t_start")) & (F.col("t_start") < F.col("b_t_end"))
    match = (F.col("__b") == F.col("__rb")) & cut
    for c in keys:
        match = match & (F.col(c) == F.col(f"b_{c}"))
    first = F.greatest(F.floor(F.col("t_start") / width), F.floor(F.col("b_t_start") / width))
    pairs = ids.join(other, match).where(F.col("__b") == first).drop("__b", "__rb")
    if how == "inner":
        return pairs
    hits = pairs.select(*[F.col(c).alias(f"__h_{c}") for c in a.columns]).distinct()
    same = None
    for c in a.columns:
        one = F.col(c).eqNullSafe(F.col(f"__h_{c}"))
        same = one if same is None else same & one
    return a.join(hits, same, how)


def asof_backward(left: DataFrame, ends: DataFrame, tol: float, keys: Sequence[str] = TAKE) -> DataFrame:
    """``left`` with t_before: the latest ``ends.t`` at or before t and at most ``tol`` earlier, else null."""
    cols = left.columns
    rows = left.withColumn("__e", F.lit(None).cast("double")).withColumn("__p", F.lit(1))
    marks = ends.select(*[(F.col(c) if c in (*keys, "t") else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in cols], F.col("t").alias("__e"), F.lit(0).alias("__p"))
    last = F.last("__e", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("t", "__p"))
    out = rows.unionByName(marks).withColumn("__last", last).where("__p = 1")
    return out.select(*cols, F.when(F.col("t") - F.col("__last") <= tol, F.col("__last")).alias("t_before"))


def drop_near(rows: DataFrame, times: DataFrame, tol: float, keys: Sequence[str] = ("video_id",), how: str = "left_anti") -> DataFrame:
    """``rows`` with no time of ``times`` within ``tol`` seconds (inclusive) of t_start: automatic touches that no manual
    one replaces; with ``how`` left_semi those with one."""
    wide = tol * BROADER
    spread = times.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("t").alias("__t"), F.explode(F.sequence(F.floor(F.col("t") / wide) - 1, F.floor(F.col("t") / wide) + 1)).alias("__rb"))
    match = (F.floor(F.col("t_start") / wide) == F.col("__rb")) & (F.abs(F.col("t_start") - F.col("__t")) <= tol)
    for c in keys:
        match = match & (F.col(c) == F.col(f"__{c}"))
    return rows.join(spread, match, how)


def active_events(grid: DataFrame, events: DataFrame, keys: Sequence[str] = ("video_id",), width: float = 5.0) -> DataFrame:
    """``grid`` rows with each event (columns prefixed e_) whose closed span holds t, and ``elapsed``: the share of the
    span that is over (1 for an empty span). Spans are dealt to buckets of ``width`` seconds."""
    spread = events.select(*[F.col(c).alias(f"e_{c}") for c in events.columns]).withColumn("__b", F.explode(F.sequence(F.floor(F.col("e_t_start") / width), F.floor(F.col("e_t_end") / width))))
    match = (F.floor(F.col("t") / width) == F.col("__b")) & F.col("t").between(F.col("e_t_start"), F.col("e_t_end"))
    for c in keys:
        match = match & (F.col(c) == F.col(f"e_{c}"))
    span = F.col("e_t_end") - F.col("e_t_start")
    return grid.join(spread, match).drop("__b").withColumn("elapsed", F.when(span > 0, (F.col("t") - F.col("e_t_start")) / span).otherwise(1.0))
