"""When a goal fell, who scored and who gave the pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LINE, MIN_EMIT, REGION, SCOREBOARD
from ..functions.geometry import crossing, cx, cy, in_polygon
from .events import score_increments
from .series import debounced
from .timejoin import TAKE, asof_backward, overlaps

GOAL = {"lookback": 8.0, "scorer": 0.8, "unknown": 0.5, "min": 0.1, "max": 0.8, "occurrence": 0.75}
ASSIST = {"lookback": 15.0, "factor": 0.6, "team": 0.5, "min": 0.1, "max": 0.35}


def attribute_goals(goals: DataFrame, possession: DataFrame, tracks: DataFrame, p: dict = GOAL) -> DataFrame:
    """``goals`` (video_id, take_id, t_after, confidence) with team and scorer.

    Runs of possession that touch the seconds before the goal vote with their whole length for the team of their largest
    raw track id; the team with most (ties: seen first) scored, by its run that ends last. Without a team the scorer is
    unknown and the confidence lower.
    """
    window = goals.select(*TAKE, "t_after", (F.col("t_after") - p["lookback"]).alias("t_start"), F.col("t_after").alias("t_end"))
    teams = tracks.select(*TAKE, F.col("track_id").alias("raw"), F.col("team").alias("team"))
    runs = possession.select(*TAKE, "player_track_id", "t_start", "t_end", F.array_max("raw_track_ids").alias("raw")).join(teams, [*TAKE, "raw"], "left").where("team is not null")
    near = overlaps(window, runs.select(*TAKE, "player_track_id", "t_start", "t_end", "team"), closed=True)
    votes = near.groupBy(*TAKE, "t_after", F.col("b_team").alias("team")).agg(
        F.sum(F.col("b_t_end") - F.col("b_t_start")).alias("held"), F.min("b_t_start").alias("seen"), F.max_by("b_player_track_id", "b_t_end").alias("scorer")
    )
    best = Window.partitionBy(*TAKE, "t_after").orderBy(F.desc("held"), "seen")
    top = votes.withColumn("rank", F.row_number().over(best)).where("rank = 1").select(*TAKE, "t_after", "team", "scorer")
    known = F.when(F.col("team").isNotNull(), p["scorer"]).otherwise(p["unknown"])
    conf = F.least(F.greatest(F.col("confidence") * known, F.lit(p["min"])), F.lit(p["max"]))
    return goals.join(top, [*TAKE, "t_after"], "left").withColumn("confidence", conf).where(F.col("confidence") >= MIN_EMIT)


def detect_assists(goals: DataFrame, passes: DataFrame, tracks: DataFrame, p: dict = ASSIST) -> DataFrame:
    """The last pass to each scorer that ends in the seconds before the goal, if both are surely of one team cluster."""
    team = tracks.select(*TAKE, F.col("track_id").alias("id"), F.struct("team", F.col("team_confidence").alias("sure")).alias("kit"))
    given = passes.where("type = 'pass'").select(*TAKE, F.col("receiver").alias("scorer"), "passer", F.col("t_start").alias("pass_start"), F.col("t_end").alias("pass_end"), F.col("confidence").alias("pass_confidence"))
    pairs = goals.where("scorer is not null").select(*TAKE, "t_after", "scorer").join(given, [*TAKE, "scorer"]).where(F.col("pass_end").between(F.col("t_after") - p["lookback"], F.col("t_after")))
    last = pairs.groupBy(*TAKE, "t_after", "scorer").agg(F.max_by(F.struct("passer", "pass_start", "pass_end", "pass_confidence"), "pass_end").alias("p"))
    for name, of in (("a", F.col("p.passer")), ("b", F.col("scorer"))):
        side = team.toDF("v_", "k_", f"id_{name}", f"kit_{name}")
        last = last.join(side, (F.col("video_id") == F.col("v_")) & (F.col("take_id") == F.col("k_")) & (of == F.col(f"id_{name}"))).drop("v_", "k_")
    sure = (F.col("kit_a.sure") >= p["team"]) & (F.col("kit_b.sure") >= p["team"]) & (F.col("kit_a.team") == F.col("kit_b.team"))
    conf = F.least(F.greatest(F.col("p.pass_confidence") * p["factor"], F.lit(p["min"])), F.lit(p["max"]))
    out = last.where(sure).select(*TAKE, F.lit("assist").alias("type"), F.col("p.passer").alias("player_track_id"), "scorer", F.col("p.pass_start").alias("t_start"), F.col("p.pass_end").alias("t_end"), "t_after", conf.alias("confidence"))
    return out.where(F.col("confidence") >= MIN_EMIT)


def region_goals(balls: DataFrame, regions: DataFrame, fast: DataFrame, p: dict = REGION) -> DataFrame:
    """Balls inside a marked region (``regions``: video_id, polygon) soon after a fast ball (``fast``: spans) ended; once a
    ``window``."""
    marked = regions.groupBy("video_id").agg(F.collect_list("polygon").alias("polygons"))
    rows = balls.select(*TAKE, "t", cx().alias("x"), cy().alias("y")).join(marked, "video_id")
    inside = rows.where(F.exists("polygons", lambda area: in_polygon(F.col("x"), F.col("y"), area))).select(*TAKE, "t", "x", "y")
    led = asof_backward(inside, fast.select(*TAKE, F.col("t_end").alias("t")), p["window"]).where("t_before is not null")
    once = debounced(led, p["window"], list(TAKE), strict=True)
    return once.select(*TAKE, F.lit("goal").alias("type"), F.col("t_before").alias("t_start"), F.col("t").alias("t_end"), F.col("t").alias("t_after"), F.lit(p["confidence"]).alias("confidence"), F.lit("goal_region").alias("source"))


def line_goals(balls: DataFrame, lines: DataFrame, p: dict = LINE) -> DataFrame:
    """Neighbouring sure balls whose way crosses the goal line nearest in time (``lines``: t, left, right; ties: the first).
    A take has few lines, which ride along as an array."""
    held = lines.groupBy(*TAKE).agg(F.array_sort(F.collect_list(F.struct("t", "left", "right"))).alias("lines"))
    w = Window.partitionBy(*TAKE).orderBy("t", "frame_index")
    now = F.struct("t", cx().alias("x"), cy().alias("y"), "conf")
    pairs = balls.select(*TAKE, F.lag(now).over(w).alias("a"), now.alias("b"))
    sure = (F.col("a.conf") >= p["conf"]) & (F.col("b.conf") >= p["conf"]) & (F.round(F.col("b.t") - F.col("a.t"), 9) <= p["gap"])
    rows = pairs.where(sure).join(held, list(TAKE))
    mid = (F.col("a.t") + F.col("b.t")) / 2
    near = F.array_min(F.transform("lines", lambda x: F.struct(F.abs(x["t"] - mid).alias("far"), x["t"].alias("t"), x["left"].alias("left"), x["right"].alias("right"))))
    at = rows.withColumn("line", near)
    hit = crossing(*[F.col(c) for c in ("a.x", "a.y", "b.x", "b.y", "line.left.x", "line.left.y", "line.right.x", "line.right.y")])
    out = at.withColumn("crossing", hit).where("crossing is not null")
    return out.select(*TAKE, F.lit("goal").alias("type"), F.col("a.t").alias("t_start"), F.col("b.t").alias("t_end"), F.col("b.t").alias("t_after"), F.lit(p["conf"]).alias("confidence"), F.lit("goal_line_crossing").alias("source"))


def scoreboard_goals(readings: DataFrame, p: dict = SCOREBOARD) -> DataFrame:
    """Goals of the first listed region whose early samples agree on a score. ``readings``: region (its place in the list),
    t, home, away; a sample without a score has nulls."""
    keys = [*TAKE, "region"]
    early = readings.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("t"))).where(F.col("__n") <= p["frames"])
    agreed = early.where("home is not null and away is not null").groupBy(*keys, "home", "away").agg(F.count("*").alias("n")).where(F.col("n") >= p["stable"])
    active = agreed.groupBy(*TAKE).agg(F.min("region").alias("region"))
    series = readings.join(active, keys, "left_semi").withColumn("score", F.col("home") + F.col("away"))
    steps = score_increments(series, p["debounce"])
    return steps.select(*TAKE, F.lit("goal").alias("type"), F.col("t_before").alias("t_start"), F.col("t_after").alias("t_end"), "t_after", F.lit(p["confidence"]).alias("confidence"), F.lit("scoreboard").alias("source"))


def goal_occurrences(scoreboard: DataFrame, crossed: DataFrame, in_region: DataFrame, lines: DataFrame) -> DataFrame:
    """Scoreboard goals always; of the others, line crossings in takes that have lines and marked regions elsewhere."""
    return scoreboard.unionByName(crossed).unionByName(in_region.join(lines.select(*TAKE).distinct(), list(TAKE), "left_anti"))


def goal_availability(videos: DataFrame, takes: DataFrame, activated: DataFrame, goals: DataFrame, assists: DataFrame) -> DataFrame:
    """Per video whether goals can be told and why: not attempted without takes, else by what was found; ``activated``
    (video_id) lists videos with a scoreboard."""
    kinds = goals.groupBy("video_id").agg(F.count("*").alias("n_goals"), F.count_if(F.col("source") == "scoreboard").alias("n_scoreboard"), F.count_if(F.col("source") == "goal_region").alias("n_region"))
    given = assists.groupBy("video_id").agg(F.count("*").alias("n_assists"))
    cut = takes.select("video_id", F.lit(True).alias("cut")).distinct()
    out = videos.select("video_id").join(cut, "video_id", "left").join(activated.select("video_id", F.lit(True).alias("board")).distinct(), "video_id", "left").join(kinds, "video_id", "left").join(given, "video_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    other = count(F.col("n_goals")) - count(F.col("n_scoreboard")) - count(F.col("n_region"))
    status = F.when(F.col("cut").isNull(), "not_attempted").when(count(F.col("n_goals")) > 0, "available").when(F.col("board"), "no_increment").otherwise("no_scoreboard")
    reason = F.when(status == "available", F.format_string("%d by scoreboard, %d in marked regions, %d unspecified", count(F.col("n_scoreboard")), count(F.col("n_region")), other))
    return out.select("video_id", status.alias("status"), reason.alias("reason"), count(F.col("n_goals")).alias("n_goals"), count(F.col("n_assists")).alias("n_assists"))
