"""Ordered operators over samples of a take or track."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.geometry import cx, cy, height, in_heights, ninth
from .timejoin import TAKE, active_events, bracket, nearest_in_time, settled

TRACK = (*TAKE, "track_id")


def moving_average(column: Column, n: int, keys: Sequence[str], order: Sequence[str] = ("t", "frame_index")) -> Column:
    """Trailing mean of up to n rows, in the order that the other windows of a series have, so that they share its sort."""
    if n <= 1:
        return column
    return F.avg(column).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0))


def track_speed(boxes: DataFrame, n: int) -> DataFrame:
    """``boxes`` with speed in box heights a second, 0 for the first box of a track."""
    w = Window.partitionBy(*TRACK).orderBy("t", "frame_index")
    smooth = boxes.withColumn("__x", moving_average(cx(), n, TRACK)).withColumn("__y", moving_average(cy(), n, TRACK)).withColumn("__h", height())
    dt = F.col("t") - F.lag("t").over(w)
    mean = (F.col("__h") + F.lag("__h").over(w)) / 2
    dist = F.hypot(F.col("__x") - F.lag("__x").over(w), F.col("__y") - F.lag("__y").over(w))
    ok = (dt > 0) & (mean > 0)
    return smooth.withColumn("dt", F.coalesce(dt, F.lit(0.0))).withColumn("speed", F.when(ok, ninth(dist / dt / mean)).otherwise(0.0)).drop("__x", "__y", "__h")


def ball_speed(balls: DataFrame, n: int, frame_width: float, conf: float) -> DataFrame:
    """Balls of enough confidence with speed (frame widths a second) and dx."""
    w = Window.partitionBy(*TAKE).orderBy("t", "frame_index")
    smooth = balls.where(F.col("conf") >= conf).withColumn("__x", moving_average(cx(), n, TAKE)).withColumn("__y", moving_average(cy(), n, TAKE))
    dt, dx = F.col("t") - F.lag("t").over(w), F.col("__x") - F.lag("__x").over(w)
    dist = F.hypot(dx, F.col("__y") - F.lag("__y").over(w))
    return smooth.withColumn("speed", F.when(dt > 0, ninth(dist / dt / frame_width)).otherwise(0.0)).withColumn("dx", F.coalesce(dx, F.lit(0.0))).drop("__x", "__y")


def threshold_segments(rows: DataFrame, value: str, threshold: float, min_dur: float, merge: float, keys: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    """Runs of rows with value >= threshold, merged over gaps under ``merge`` and kept from ``min_dur`` seconds on:
    keys, t_start, t_end, n, peak, mean of the qualifying rows, and ``more`` aggregates."""
    w = Window.partitionBy(*keys).orderBy("t")
    hot = rows.withColumn("__n", F.row_number().over(w)).where(F.col(value) >= threshold)
    apart = (F.col("__n") - F.lag("__n").over(w) > 1) & (ninth(F.col("t") - F.lag("t").over(w)) >= merge)
    runs = hot.withColumn("__run", F.sum(F.when(apart, 1).otherwise(0)).over(w))
    out = runs.groupBy(*keys, "__run").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n"), F.max(value).alias("peak"), F.avg(value).alias("mean"), *more)
    return out.where(ninth(F.col("t_end") - F.col("t_start")) >= min_dur).drop("__run")


def reference_height(boxes: DataFrame) -> DataFrame:
    """The median height of the boxes of each take."""
    return boxes.groupBy(*TAKE).agg(F.coalesce(F.percentile(F.when(height() > 0, height()), 0.5), F.lit(0.0)).alias("ref_height"))


def ball_states(balls: DataFrame, boxes: DataFrame, params: dict = config.BALL_STATE, motion: DataFrame | None = None) -> DataFrame:
    """Smoothed ball positions with velocity in reference heights a second; ``known`` is false after a gap. With ``motion``
    as of ``to_reference`` positions are those in the take's first frame, where the camera's way is known."""
    w = Window.partitionBy(*TAKE).orderBy("t", "frame_index")
    rows = balls.where(F.col("conf") >= params["conf"]).withColumns({"x": cx(), "y": cy()})
    if motion is not None:
        rows = to_reference(rows, motion).withColumns({"x": F.coalesce("ref_x", "x"), "y": F.coalesce("ref_y", "y")})
    smooth = rows.withColumns({c: moving_average(F.col(c), params["window"], TAKE) for c in ("x", "y")})
    dt = F.col("t") - F.lag("t").over(w)
    unknown = F.coalesce((dt <= 0) | (dt > params["max_gap"]), F.lit(False))
    v = lambda c: F.when(unknown | dt.isNull() | (F.col("ref_height") <= 0), 0.0).otherwise((F.col(c) - F.lag(c).over(w)) / dt / F.col("ref_height"))
    out = smooth.join(reference_height(boxes), list(TAKE), "left").withColumn("ref_height", F.coalesce("ref_height", F.lit(0.0)))
    out = out.withColumn("vx", v("x")).withColumn("vy", v("y")).withColumn("known", ~unknown)
    speed = F.hypot("vx", "vy")
    return out.select(*TAKE, "frame_index", "t", "x", "y", "vx", "vy", speed.alias("speed"), F.when(speed > 1e-6, F.degrees(F.atan2("vy", "vx"))).alias("direction_deg"), F.col("conf").alias("confidence"), "known")


def debounced(rows: DataFrame, gap: float, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Greedy keep-first: of the rows in order of t, those at least ``gap`` after the last one kept (``strict``: more than).

    A row that far after the row before it is always kept, so a key's rows are cut there, and only the pieces are folded.
    """
    sign = ">" if strict else ">="
    w = Window.partitionBy(*keys).orderBy("t")
    fresh = F.when(F.expr(f"__step {sign} {gap}"), 1).otherwise(0)
    cut = rows.withColumn("__step", ninth(F.col("t") - F.lag("t").over(w))).withColumn("__piece", F.sum(fresh).over(w)).drop("__step")
    held = cut.groupBy(*keys, "__piece").agg(F.array_sort(F.collect_list(F.struct("t", *[c for c in rows.columns if c not in (*keys, "t")]))).alias("__all"))
    kept = F.expr(f"aggregate(__all, slice(__all, 1, 0), (acc, r) -> if(size(acc) = 0 or rint((r.t - acc[size(acc) - 1].t) * 1e9D) / 1e9D {sign} {gap}, concat(acc, array(r)), acc))")
    return held.select(*keys, F.inline(kept)).select(*rows.columns)


def takes_from_cuts(cuts: DataFrame, videos: DataFrame) -> DataFrame:
    """Gapless takes of each video between its distinct cut frames; none for a video without frames."""
    frames = cuts.join(videos, "video_id").where("frame > 0 and frame < nb_frames").select("video_id", "frame")
    starts = frames.union(videos.where("nb_frames > 0").select("video_id", F.lit(0).cast("int"))).distinct()
    w = Window.partitionBy("video_id").orderBy("frame")
    out = starts.join(videos.select("video_id", "nb_frames", "fps"), "video_id").withColumn("take_id", F.row_number().over(w) - 1)
    out = out.withColumn("frame_end", F.coalesce(F.lead("frame").over(w), F.col("nb_frames")))
    return out.select("video_id", "take_id", (F.col("frame") / F.col("fps")).alias("t_start"), (F.col("frame_end") / F.col("fps")).alias("t_end"), F.col("frame").alias("frame_start"), "frame_end")


def interpolate_ball(frames: DataFrame, balls: DataFrame, params: dict = config.BALL) -> DataFrame:
    """A ball for every sampled frame between two observations at most ``gap_frames`` apart; its box is linear, its
    confidence half the mean. Of repeated frame numbers the one of greatest t counts."""
    box = ["x1", "y1", "x2", "y2", "conf"]
    seen = balls.groupBy("video_id", "frame_index").agg(F.max_by(F.struct(*box), "t").alias("s"))
    w = Window.partitionBy("video_id")
    rows = frames.join(seen, ["video_id", "frame_index"], "left").withColumn("at", F.when(F.col("s").isNotNull(), F.struct("frame_index", "s")))
    rows = rows.withColumn("a", F.last("at", ignorenulls=True).over(w.orderBy("frame_index"))).withColumn("b", F.last("at", ignorenulls=True).over(w.orderBy(F.desc("frame_index"))))
    gap = F.col("b.frame_index") - F.col("a.frame_index")
    share = (F.col("frame_index") - F.col("a.frame_index")) / gap
    value = lambda c: F.when(gap == 0, F.col(f"a.s.{c}")).otherwise(F.col(f"a.s.{c}") + share * (F.col(f"b.s.{c}") - F.col(f"a.s.{c}")))
    conf = F.when(gap == 0, F.col("a.s.conf")).otherwise((F.col("a.s.conf") + F.col("b.s.conf")) / 2 * params["penalty"])
    return rows.where(gap <= params["gap_frames"]).select("video_id", "frame_index", "t", *[value(c).alias(c) for c in box[:4]], conf.alias("conf"), (gap > 0).alias("interpolated"))


def running_counts(grid: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each grid row the events of its keys with t_start <= t."""
    rows = grid.select(*keys, "t", F.lit(1).alias("__g")).union(events.select(*keys, F.col("t_start"), F.lit(0)))
    w = Window.partitionBy(*keys).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("n", F.sum(1 - F.col("__g")).over(w)).where("__g = 1").drop("__g")


def plausible_balls(balls: DataFrame, frame_width: float, params: dict = config.BALL, block: int = 256) -> DataFrame:
    """``balls`` of each video without jumps faster than ``speed`` frame widths a second from the last accepted one. As many
    rejected samples in a row as ``reseed`` that agree with one another are accepted after all; they replace a first sample
    that nothing has confirmed.

    The scan over a video is cut where every way it may have gone comes to the same state: at the last sample of ``reseed``
    + 1 in a row that agree with one another. Whatever was accepted before, the first of them is either accepted, and
    then all are, or it opens a doubt that all of them strengthen and that is accepted at the ``reseed``-th. Either way the
    last one is accepted and confirmed, so the pieces between such samples are scanned apart, many in a task. Only the samples
    of one piece are held together; a ball that never agrees with itself so long gives a long piece.
    """
    if frame_width <= 0:
        return balls
    rows = settled(balls.select("video_id", "frame_index", "t", cx().alias("__x"), cy().alias("__y")).distinct())
    w = Window.partitionBy("video_id").orderBy("t", "frame_index")
    dt = F.col("t") - F.lag("t").over(w)
    far = F.hypot(F.col("__x") - F.lag("__x").over(w), F.col("__y") - F.lag("__y").over(w))
    agrees = F.when(dt > 0, far / dt / frame_width <= params["speed"]).otherwise((F.col("__x") == F.lag("__x").over(w)) & (F.col("__y") == F.lag("__y").over(w)))
    seen = rows.withColumn("__agrees", F.coalesce(agrees, F.lit(False)))
    recent = F.min(F.col("__agrees").cast("int")).over(w.rowsBetween(-params["reseed"] + 1, 0))
    place = F.row_number().over(w)
    firm = seen.withColumn("__firm", (recent == 1) & (place > params["reseed"]))
    # a piece begins with the firm sample that the one before it ends with; cuts stand at least ``block`` samples apart
    cut = firm.withColumns({"__n": place}).withColumn("__mark", F.when(F.col("__firm"), F.floor(F.col("__n") / block)))
    fresh = F.col("__firm") & ~F.col("__mark").eqNullSafe(F.max("__mark").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    cut = cut.withColumn("__cut", fresh.cast("int"))
    piece = F.sum("__cut").over(w)
    cut = cut.withColumn("__piece", piece)
    both = cut.select("video_id", "frame_index", "t", "__x", "__y", "__piece", F.col("__cut").alias("__head")).unionByName(
        cut.where("__cut = 1").select("video_id", "frame_index", "t", "__x", "__y", (F.col("__piece") - 1).alias("__piece"), F.lit(0).alias("__head"))
    )
    item = F.struct("t", "frame_index", F.struct("t", "frame_index").alias("__id"), F.col("__x").alias("x"), F.col("__y").alias("y"), "__head")
    pieces = both.groupBy("video_id", "__piece").agg(F.array_sort(F.collect_list(item)).alias("all"))
    near = lambda a, b: f"if({b}.t > {a}.t, sqrt(pow({b}.x - {a}.x, 2) + pow({b}.y - {a}.y, 2)) / ({b}.t - {a}.t) / {frame_width} <= {params['speed']}, {a}.x = {b}.x and {a}.y = {b}.y)"
    ids = f"cast(array() as array<struct<t:{rows.schema['t'].dataType.simpleString()},frame_index:{rows.schema['frame_index'].dataType.simpleString()}>>)"
    state = f"named_struct('last', all[0], 'kept', array(all[0].__id), 'firm', all[0].__head = 1, 'doubt', {ids}, 'end', all[0])"
    scan = f"""aggregate(slice(all, 2, size(all)), {state}, (s, b) -> if({near("s.last", "b")},
            named_struct('last', b, 'kept', s.kept || array(b.__id), 'firm', true, 'doubt', {ids}, 'end', b),
            transform(array(if(size(s.doubt) > 0 and {near("s.end", "b")}, s.doubt || array(b.__id), array(b.__id))), d -> if(size(d) >= {params["reseed"]},
                named_struct('last', b, 'kept', if(not s.firm and size(s.kept) = 1, d, s.kept || d), 'firm', true, 'doubt', {ids}, 'end', b),
                named_struct('last', s.last, 'kept', s.kept, 'firm', s.firm, 'doubt', d, 'end', b)))[0]), s -> s.kept)"""
    good = pieces.select("video_id", F.explode(F.expr(scan)).alias("__id")).select("video_id", "__id.*").distinct()
    return balls.join(good, ["video_id", "frame_index", "t"], "left_semi")


#: Rows of a block in ``cumulative_motion`` and balls of a piece in ``plausible_balls``.
BLOCK = 256
_ONE = "named_struct('a', 1D, 'b', 0D, 'tx', 0D, 'c', 0D, 'd', 1D, 'ty', 0D)"


def _after(step: str, now: str) -> str:
    """SQL of one affine map after another."""
    linear = {"a": ("a", "a", "b", "c"), "b": ("a", "b", "b", "d"), "c": ("c", "a", "d", "c"), "d": ("c", "b", "d", "d")}
    parts = [f"'{k}', {step}.{p} * {now}.{q} + {step}.{r} * {now}.{s}" for k, (p, q, r, s) in linear.items()]
    parts += [f"'{t}', {step}.{p} * {now}.tx + {step}.{q} * {now}.ty + {step}.{t}" for t, p, q in (("tx", "a", "b"), ("ty", "c", "d"))]
    order = {"a": 0, "b": 1, "tx": 2, "c": 3, "d": 4, "ty": 5}
    return "named_struct(" + ", ".join(sorted(parts, key=lambda x: order[x.split("'")[1]])) + ")"


def _products(rows: str, start: str = _ONE) -> str:
    """SQL of the running products of an array of maps (null: none), as an array of the same length."""
    kind = "array<struct<a:double,b:double,tx:double,c:double,d:double,ty:double>>"
    step = _after("m", "acc.now")
    return f"""aggregate({rows}, named_struct('now', {start}, 'out', cast(array() as {kind})),
        (acc, m) -> transform(array(if(m.a is null or m.b is null or m.tx is null or m.c is null or m.d is null or m.ty is null, acc.now, {step})),
            p -> named_struct('now', p, 'out', acc.out || array(p)))[0], acc -> acc.out)"""


def cumulative_motion(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The affine map from the first instant of each take to every other: the product of the frame-to-frame maps a, b, tx,
    c, d, ty in order of t. An instant whose map is null keeps the one before.

    Products are taken in blocks of a take's instants; the products of whole blocks, of which there are ``block`` times
    fewer, are multiplied up the same way, level over level, and each block starts from the product of those before it. So no
    task holds more than a block, however long the take. Joins say that they merge: a settled table is far smaller as a file
    than its rows are, so Spark would take it for one to send to every task."""
    names = ["a", "b", "tx", "c", "d", "ty"]
    rows = pairs.select(*TAKE, "t", *[F.col(c).cast("double").alias(c) for c in names])
    place = F.row_number().over(Window.partitionBy(*TAKE).orderBy("t")) - 1
    level = settled(rows.withColumn("__at", place.cast("long")).select(*TAKE, "__at", F.struct("t", *names).alias("m")))
    out = _multiplied(level, block)
    back = level.select(*TAKE, "__at", "m.t").join(out.hint("merge"), [*TAKE, "__at"])
    return back.select(*TAKE, "t", *[F.col(f"p.{c}").alias(c) for c in names])


def _multiplied(level: DataFrame, block: int) -> DataFrame:
    """(__at, p): the product of the maps (``m``) of each take up to place __at."""
    blocks = level.groupBy(*TAKE, F.floor(F.col("__at") / block).alias("__block")).agg(F.array_sort(F.collect_list(F.struct("__at", "m"))).alias("__rows"))
    inner = settled(blocks.select(*TAKE, "__block", F.expr("__rows[0].__at").alias("__first"), F.expr(_products("transform(__rows, r -> r.m)")).alias("__p")))
    if inner.where("__block > 0").isEmpty():
        return inner.select(*TAKE, "__first", F.posexplode("__p").alias("__k", "p")).select(*TAKE, (F.col("__first") + F.col("__k")).alias("__at"), "p")
    whole = inner.select(*TAKE, F.col("__block").alias("__at"), F.element_at("__p", -1).alias("m"))
    before = _multiplied(whole, block).select(*TAKE, (F.col("__at") + 1).alias("__block"), F.col("p").alias("__start"))
    led = inner.join(before.hint("merge"), [*TAKE, "__block"], "left").withColumn("__start", F.coalesce("__start", F.expr(_ONE)))
    flat = led.select(*TAKE, "__first", "__start", F.posexplode("__p").alias("__k", "__m"))
    return flat.select(*TAKE, (F.col("__first") + F.col("__k")).alias("__at"), F.expr(_after("__m", "__start")).alias("p"))


def to_reference(points: DataFrame, motion: DataFrame) -> DataFrame:
    """``points`` (x, y, t) with ref_x, ref_y in the take's first frame, by the motion nearest in time; null when that is
    farther than two sampling periods or has no inverse."""
    w = Window.partitionBy(*TAKE).orderBy("t")
    period = motion.select(*TAKE, (F.lead("t").over(w) - F.col("t")).alias("p"), F.row_number().over(w).alias("n")).where("n = 1").select(*TAKE, F.greatest(F.coalesce(F.col("p") * 2, F.lit(1e9)), F.lit(0.1)).alias("__most"))
    flat = motion.select(*TAKE, "t", "a", "b", "tx", "c", "d", "ty")
    near = nearest_in_time(points.select(*TAKE, "t").distinct(), flat, 1.0, tie="earlier").select(*TAKE, "t", F.col("near").alias("__m"))
    rows = points.join(near.hint("merge"), [*TAKE, "t"], "left").join(period.hint("merge"), list(TAKE), "left")
    det = F.col("__m.a") * F.col("__m.d") - F.col("__m.b") * F.col("__m.c")
    u, v = F.col("x") - F.col("__m.tx"), F.col("y") - F.col("__m.ty")
    ok = (F.round(F.abs(F.col("__m.t") - F.col("t")), 9) <= F.col("__most")) & (det != 0)
    out = rows.withColumn("ref_x", F.when(ok, (F.col("__m.d") * u - F.col("__m.b") * v) / det)).withColumn("ref_y", F.when(ok, (F.col("__m.a") * v - F.col("__m.c") * u) / det))
    return out.select(*points.columns, "ref_x", "ref_y")


def compensated_jump(a: str, b: str) -> Column:
    """struct<jump, compensated> between two places (structs x, y, h, ref_x, ref_y): their distance in mean heights, in the
    take's first frame where both have a place in it, else in the image; infinite without a height."""
    known = F.col(f"{a}.ref_x").isNotNull() & F.col(f"{b}.ref_x").isNotNull()
    far = lambda p: F.hypot(F.col(f"{b}.{p}x") - F.col(f"{a}.{p}x"), F.col(f"{b}.{p}y") - F.col(f"{a}.{p}y"))
    tall = (F.col(f"{a}.h") + F.col(f"{b}.h")) > 0
    return F.struct(in_heights(F.when(known, far("ref_")).otherwise(far("")), F.col(f"{a}.h"), F.col(f"{b}.h")).alias("jump"), (known & tall).alias("compensated"))


def resample_boxes(grid: DataFrame, boxes: DataFrame, gap: float, tolerance: float) -> DataFrame:
    """A box of each track at every grid instant: between two samples at most ``gap`` apart, else the nearest (ties: the
    earlier) within ``tolerance``. ``grid``: video_id, take_id, t. An instant meets the tracks alive then (their boxes' first
    to last instant, and the tolerance on either side), by buckets of time, not all tracks of its take."""
    sides = ("x1", "y1", "x2", "y2")
    edge = tolerance * 1.001  # rounding never parts an instant from a track a whole tolerance away
    lives = boxes.groupBy(*TRACK).agg((F.min("t") - edge).alias("t_start"), (F.max("t") + edge).alias("t_end"))
    asked = active_events(grid.select(*TAKE, "t").distinct(), lives, keys=TAKE).select(*TAKE, F.col("e_track_id").alias("track_id"), "t")
    held = bracket(asked, boxes.select(*TRACK, "t", *sides), sides, keys=TRACK)
    before, after = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    span = F.round(F.col("after.t") - F.col("before.t"), 9)
    near = F.when(after.isNull() | (before <= after), F.struct(before.alias("d"), F.col("before").alias("b"))).otherwise(F.struct(after.alias("d"), F.col("after").alias("b")))
    rows = held.withColumn("__n", near).withColumn("__in", F.coalesce((span > 0) & (span <= gap), F.lit(False)))
    value = lambda c: F.when(F.col("__in"), F.col(f"before.{c}") + F.col("fraction") * (F.col(f"after.{c}") - F.col(f"before.{c}"))).otherwise(F.col(f"__n.b.{c}")).alias(c)
    return rows.where(F.col("__in") | (F.round("__n.d", 9) <= tolerance)).select(*TRACK, "t", *[value(c) for c in sides], F.col("__in").alias("interpolated"))


def evenly_sampled(rows: DataFrame, k: int, keys: Sequence[str] = TRACK) -> DataFrame:
    """All rows of a key with up to k, else its rows number floor(i n / k) for i below k."""
    w = Window.partitionBy(*keys)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("t")) - 1
    marked = rows.withColumn("__n", n).withColumn("__i", i)
    nth = F.ceil(F.col("__i") * k / F.col("__n"))
    return marked.where((F.col("__n") <= k) | ((nth < k) & (F.floor(nth * F.col("__n") / k) == F.col("__i")))).drop("__n", "__i")


def midpoints(start: Column, end: Column, k: Column) -> Column:
    """The middles of k equal parts of a span; its start alone where the span is empty."""
    spread = F.transform(F.sequence(F.lit(0), F.greatest(k.cast("int"), F.lit(1)) - 1), lambda i: start + (end - start) * (i + 0.5) / F.greatest(k, F.lit(1)))
    return F.when(end > start, spread).otherwise(F.array(start))


def sample_times(first: Column, last: Column, t: Column, take: tuple[Column, Column], window: float, k: int, most: float | None = None) -> Column:
    """Up to k instants over a track's life, which is widened to ``window`` round t, held inside the take and cut to ``most``
    seconds round t; t alone for one instant or an empty span."""
    lo, hi = F.greatest(F.least(first, t - window), take[0]), F.least(F.greatest(last, t + window), take[1])
    if most:
        lo, hi = F.greatest(lo, t - most / 2), F.least(hi, t + most / 2)
    return F.when((hi > lo) & F.lit(k > 1), midpoints(lo, hi, F.lit(k))).otherwise(F.array(t))


def anchor_times(t_start: Column, t_end: Column, motion: Column, p: dict = config.ANCHORS) -> Column:
    """Instants at which a take's goal is looked for: more of them where the camera moves."""
    span = F.greatest(t_end - t_start, F.lit(1e-3))
    every = F.when(motion > p["motion"], p["moving"]).otherwise(p["still"])
    return midpoints(t_start, t_start + span, F.least(F.greatest(F.ceil(F.round(span / every, 9)), F.lit(1)), F.lit(p["most"])))
