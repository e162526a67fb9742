"""What is known of a player from earlier in the video: the followed player over takes, and the numbers that annotations
lock to one player of a take."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from .timejoin import TAKE

BANDS = ("torso", "shorts", "socks")
KIT_COLUMNS = [f"kit_{band}_{c}" for band in BANDS for c in "lab"]
MEMBER = ["first_x", "first_y", "first_h", "last_x", "last_y", "last_h"]


def successors(tracks: DataFrame, p: dict = config.STITCH) -> DataFrame:
    """``tracks`` with ``next_id``: the track of the take that follows each one best, null without one.

    A follower starts after the track's end and within ``gap``, near and slow enough; the nearest wins, among equals one of
    the same sure team, then the lowest id. Tracks meet only those of neighbouring time buckets as wide as the gap. A chain
    from any one seed is made of these steps, since a follower depends on the last member alone.
    """
    bucket = lambda c: F.floor(F.col(c) / p["gap"])
    a = tracks.select(*TAKE, F.struct("track_id", "t_end", "last", "team", "team_confidence").alias("a"), F.explode(F.sequence(bucket("t_end"), bucket("t_end") + 1)).alias("__b"))
    b = tracks.select(*TAKE, F.struct("track_id", "t_start", "first", "team", "team_confidence").alias("b"), bucket("t_start").alias("__b"))
    gap = F.round(F.col("b.t_start") - F.col("a.t_end"), 9)
    mean = (F.col("a.last.h") + F.col("b.first.h")) / 2
    jump = F.round(F.when(mean > 0, F.hypot(F.col("b.first.x") - F.col("a.last.x"), F.col("b.first.y") - F.col("a.last.y")) / mean), 9)
    sure = (F.col("a.team_confidence") >= p["team"]) & (F.col("b.team_confidence") >= p["team"]) & (F.col("a.team") == F.col("b.team"))
    near = a.join(b, [*TAKE, "__b"]).where((gap > 0) & (gap < p["gap"]) & (F.col("a.track_id") != F.col("b.track_id"))).withColumn("jump", jump)
    near = near.where((F.col("jump") < p["jump"]) & (F.round(F.col("jump") / gap, 9) < p["speed"]))
    order = F.struct("jump", (~F.coalesce(sure, F.lit(False))).alias("other"), F.col("b.track_id").alias("id"))
    best = near.groupBy(*TAKE, F.col("a.track_id").alias("track_id")).agg(F.min(order)["id"].alias("next_id"))
    return tracks.join(best, [*TAKE, "track_id"], "left")


def _kits_alike(own: np.ndarray, kits: np.ndarray, p: dict = config.KIT) -> np.ndarray:
    """1 same, 0 different, NaN undecided, of kits of nine numbers: the torso decides where it can, else shorts and socks
    unless they disagree."""
    far = np.sqrt(((kits - own).reshape(-1, 3, 3) ** 2).sum(axis=2))
    says = np.where(far <= p["same"], 1.0, np.where(far >= p["different"], 0.0, np.nan))
    torso, shorts, socks = says.T
    rest = np.where(np.isnan(shorts), socks, np.where(np.isnan(socks) | (shorts == socks), shorts, np.nan))
    return np.where(np.isnan(torso), rest, torso)


def _scores(own: np.ndarray, last: np.ndarray | None, rows: pd.DataFrame, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score and acceptance of each track as the player, and whether kit or number speak against it."""
    kit, number, ratio = _kits_alike(own, rows[KIT_COLUMNS].to_numpy(float)), rows["number"].to_numpy(float), rows["ratio"].to_numpy(float)
    way = np.full(len(rows), np.nan)
    if last is not None:
        x, y, h = rows[MEMBER[:3]].to_numpy(float).T
        both = (h > 0) & (last[2] > 0)
        way[both] = np.maximum(0, 1 - np.hypot(last[0] - x, last[1] - y)[both] / ((last[2] + h[both]) / 2) / p["reach"])
    parts = np.stack([np.where(kit == 1, 1, np.nan), np.where(number == 1, 1, np.nan), ratio, way])
    weight = np.array([[p["weights"][k]] for k in ("kit", "jersey", "height", "trajectory")]) * ~np.isnan(parts)
    total = weight.sum(axis=0)
    against = (kit == 0) | (number == 0)
    bad = against | (ratio < p["height"]) | (total <= 0)
    score = np.where(bad, 0, np.nansum(weight * parts, axis=0) / np.where(total > 0, total, 1))
    return np.round(score, 9), ~bad & (np.round(score, 9) >= p["strong"]), against


def _follow(p: dict):
    """The scan over the takes of one video. Its rows are the headers of the video's tracks."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        bank, last, out = [pdf[[f"own_{c}" for c in KIT_COLUMNS]].iloc[0].to_numpy(float)], None, []
        for take_id, rows in pdf.sort_values(["take_id", "t_start", "track_id"]).groupby("take_id", sort=True):
            asked = bool(rows["asked"].iloc[0])
            rows = rows[rows["track_id"].notna()].set_index("track_id", drop=False)
            rows.index = rows.index.astype("int64")
            with np.errstate(all="ignore"):
                kits = np.stack(bank)
                own = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else np.nan for c in kits.T])
                score, good, against = _scores(own, last, rows, p)
            anchor = rows["anchor"].to_numpy(bool)
            score = {i: float(v) for i, v in zip(rows.index, np.where(anchor & asked, 1.0, score), strict=True)}
            good = pd.Series(good | (anchor & asked), rows.index)
            if asked:
                mine = rows[rows["place"].notna()].sort_values("place").index
                accepted = [i for i in mine if good[i]]
                heads, conf = accepted, np.mean([score[i] for i in accepted]) if accepted else 0.0
            else:
                accepted = [i for i in rows.index if good[i] and rows["able"][i]]
                top = max((round(score[i], 4) for i in accepted), default=0.0)
                heads = [i for i in accepted if round(score[i], 4) == top]
                heads, conf = (heads, top) if len(heads) == 1 else ([], 0.0)
            chain = set()
            for i in heads:
                while i is not None and i not in chain:
                    chain.add(i)
                    after = rows["next_id"][i]
                    i = None if pd.isna(after) else int(after)
            ids = [i for i in rows.index if i in chain]
            wrong = dict(zip(rows.index, against, strict=True))
            sure = [i for i in rows.index if heads and (i in accepted or (i in chain and not wrong[i]))]
            out.append((rows["video_id"].iloc[0] if len(rows) else pdf["video_id"].iloc[0], take_id, ("manual_override" if asked else "target_reidentified") if heads else "target_lost", heads[0] if heads else None, ids, sure, float(conf)))
            last = None
            if heads:
                end = rows.loc[ids].sort_values("t_end").iloc[-1]
                last = end[MEMBER[3:]].to_numpy(float)
                seen = rows.loc[heads[0], KIT_COLUMNS].to_numpy(float)
                if conf >= p["learn"] and not np.isnan(seen).all():
                    bank = [*bank, seen][-p["bank"] :]
        return pd.DataFrame(out, columns=["video_id", "take_id", "method", "seed_track_id", "track_ids", "verified_ids", "confidence"]).astype({"seed_track_id": "Int64"})

    return scan


def resolve_target(takes: DataFrame, tracks: DataFrame, profiles: DataFrame, seeds: DataFrame, p: dict = config.TARGET) -> DataFrame:
    """The followed player in every take of the videos with a profile, take after take: method, seed_track_id, track_ids
    (its chain), verified_ids (members that neither kit nor number contradicts) and confidence.

    ``tracks``: headers with dominant_class, team, team_confidence, t_start, t_end, first, last (x, y, h), kit (torso, shorts,
    socks), jersey, height. ``profiles``: video_id, kit, jersey, height, and take_id and track_id of the track that it was
    made from, which is accepted unseen. ``seeds``: video_id, take_id, track_id, place: a take with seeds takes the accepted
    ones of them alone, any other its one best accepted track; two equal ones are as good as none. Colours of sure links are
    learnt, the last ``bank`` of them; a lost take ends the trajectory. Chains, numbers and heights are settled in Spark; a
    video's headers then go through one scan. Repeated seeds count once. A take without tracks is lost.
    """
    nine = lambda kit, names: [F.col(f"{kit}.{band}.{c}").alias(f"{names}{band}_{c}") for band in BANDS for c in "lab"]
    goal = profiles.select("video_id", F.col("take_id").alias("__k"), F.col("track_id").alias("__i"), F.col("jersey").alias("__jersey"), F.col("height").alias("__height"), *nine("kit", "own_kit_"))
    rows = successors(tracks).select(*TAKE, "track_id", "t_start", "t_end", "next_id", "jersey", "height", "dominant_class", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("first", "last") for c in "xyh"], *nine("kit", "kit_"))
    place = seeds.groupBy(*TAKE, "track_id").agg(F.min("place").alias("place"))
    asked = seeds.select(*TAKE).distinct().withColumn("asked", F.lit(True))
    full = takes.select(*TAKE).join(goal, "video_id").join(asked, list(TAKE), "left").join(rows, list(TAKE), "left").join(place, [*TAKE, "track_id"], "left")
    both = (F.col("height") > 0) & (F.col("__height") > 0)
    flat = full.select(
        *TAKE, "track_id", "t_start", "t_end", "next_id", "place", F.coalesce("asked", F.lit(False)).alias("asked"), *MEMBER, *KIT_COLUMNS, *[f"own_{c}" for c in KIT_COLUMNS],
        (F.col("jersey") == F.col("__jersey")).cast("double").alias("number"), F.when(both, F.least("height", "__height") / F.greatest("height", "__height")).alias("ratio"),
        F.coalesce((F.col("take_id") == F.col("__k")) & (F.col("track_id") == F.col("__i")), F.lit(False)).alias("anchor"),
        F.coalesce(~F.col("dominant_class").eqNullSafe("referee") & (F.round(F.col("t_end") - F.col("t_start"), 9) >= config.SELECTION["duration"]), F.lit(False)).alias("able"),
    )
    kind = ", ".join(f"{c} {flat.schema[c].dataType.simpleString()}" for c in TAKE)
    return flat.groupBy("video_id").applyInPandas(_follow(p), f"{kind}, method string, seed_track_id long, track_ids array<long>, verified_ids array<long>, confidence double")


def lock_annotations(annotations: DataFrame, candidates: DataFrame, confirmed: bool = False, p: dict = config.LOCK) -> DataFrame:
    """``annotations`` (video_id, take_id, jersey_number, t) with track_id, signal and the identity that the number is locked to.

    ``candidates``: a row a track near an annotation's instant: video_id, take_id, jersey_number, t, track_id, identity,
    colour_dist and arrow_dist (null: neither reference nor arrow), agreement (of reads that verify the claimed number; null:
    not verified) and source. A verified number wins over colour, and colour over an arrow; the first annotation of a number
    that finds a track locks the number to that track's identity. Later ones may only find that identity again, or another
    track by a verified number. With ``confirmed`` only a verified number starts a lock. Repeated annotations count once.
    """
    key = [*TAKE, "jersey_number", "t"]
    who = (F.col("track_id"), F.col("identity"))
    least = lambda d, ok: F.min(F.when(ok, F.struct(d.alias("d"), *who)))
    colour = least(F.round("colour_dist", 9), F.col("colour_dist").isNotNull())
    arrow = least(F.round("arrow_dist", 9), F.col("arrow_dist").isNotNull())
    within = lambda c: F.when(F.col(f"{c}.d") <= p["colour"], F.col(c))
    chosen = F.coalesce(within("colour"), F.col("arrow"))
    inside = candidates.groupBy(*key, "identity").agg(colour.alias("colour"), arrow.alias("arrow")).select(*key, F.struct("identity", chosen["track_id"].alias("track_id")).alias("pick")).where("pick.track_id is not null")
    picks = inside.groupBy(*key).agg(F.array_sort(F.collect_list("pick")).alias("picks"))
    # The two largest agreements of an instant tell whether one leads by the margin.
    read = F.when(F.col("agreement").isNotNull(), F.struct("agreement", (-F.col("track_id")).alias("n"), "source", *who))
    top = F.slice(F.sort_array(F.collect_list(read), asc=False), 1, 2)
    free = candidates.groupBy(*key).agg(colour.alias("colour"), arrow.alias("arrow"), top.alias("top"))
    lead = (F.size("top") == 1) | (F.round(F.get("top", F.lit(0))["agreement"] - F.get("top", F.lit(1))["agreement"], 9) >= p["margin"])
    free = free.select(*key, chosen.alias("free"), F.when((F.size("top") > 0) & lead, F.get("top", F.lit(0))).alias("number"))
    rows = annotations.select(*key).distinct().join(free, key, "left").join(picks, key, "left")
    item = F.struct("t", F.struct("free.track_id", "free.identity").alias("free"), F.struct("number.track_id", "number.identity", "number.source").alias("number"), "picks")
    held = rows.groupBy(*key[:-1]).agg(F.array_sort(F.collect_list(item)).alias("all"))
    again = "get(filter(r.picks, k -> k.identity = s.lock), 0).track_id"
    first = "r.number.track_id is not null" if confirmed else "coalesce(r.number.track_id, r.free.track_id) is not null"
    found = "if(r.number.track_id is not null, r.number, named_struct('track_id', r.free.track_id, 'identity', r.free.identity, 'source', cast(null as string)))"
    none = "'jersey_unverified'" if confirmed else "'none'"
    scan = F.expr(
        f"""aggregate(all, named_struct('lock', cast(null as bigint), 'out', cast(array() as array<struct<t: double, track_id: bigint, signal: string, locked: bigint>>)),
            (s, r) -> case
                when s.lock is null and {first} then named_struct('lock', {found}.identity, 'out', concat(s.out, array(named_struct('t', r.t, 'track_id', {found}.track_id,
                    'signal', if(r.number.track_id is not null, concat('jersey_', r.number.source), 'colour'), 'locked', {found}.identity))))
                when s.lock is null then named_struct('lock', s.lock, 'out', concat(s.out, array(named_struct('t', r.t, 'track_id', cast(null as bigint), 'signal', {none}, 'locked', s.lock))))
                else named_struct('lock', s.lock, 'out', concat(s.out, array(named_struct('t', r.t, 'track_id', coalesce({again}, r.number.track_id),
                    'signal', case when {again} is not null then 'locked_chain' when r.number.track_id is not null then concat('jersey_', r.number.source, '_reacquired')
                        else 'locked_identity_absent_at_instant' end, 'locked', s.lock)))) end,
            s -> s.out)"""
    )
    return held.select(*key[:-1], F.inline(scan)).select(*key, "track_id", "signal", "locked")


def annotated_takes(locked: DataFrame, p: dict = config.CLIP) -> DataFrame:
    """Of each take with a track for an annotation: the smallest claimed number, the tracks with their number and the times
    at which they count, and whether a read number confirms any."""
    own = F.col("track_id").isNotNull()
    spans = locked.where(own).groupBy(*TAKE, "track_id").agg(
        F.max_by("jersey_number", F.struct("t", "jersey_number")).alias("jersey_number"), F.array_sort(F.collect_list(F.struct((F.col("t") - p["before"]).alias("t_start"), (F.col("t") + p["after"]).alias("t_end")))).alias("windows")
    )
    people = spans.groupBy(*TAKE).agg(F.array_sort(F.collect_list(F.struct("track_id", "jersey_number", "windows"))).alias("tracks"))
    takes = locked.groupBy(*TAKE).agg(F.min("jersey_number").alias("jersey_number"), F.max(own & F.col("signal").startswith("jersey_")).alias("confirmed"))
    return takes.join(people, list(TAKE))


def active_at(t: Column, windows: Column) -> Column:
    """Whether a track counts at ``t``: always without windows, else inside one."""
    return (F.coalesce(F.size(windows), F.lit(0)) <= 0) | F.exists(windows, lambda w: (t >= w["t_start"]) & (t <= w["t_end"]))


def render_tier(method: Column, status: Column) -> Column:
    """How sure a take's followed player is shown: none, lost, amber (a vote or a guess) or red."""
    sure = F.coalesce(status == "verified", F.lit(False))
    shown = F.when(method.isin("arrow_vote", "fallback"), "amber").otherwise("red")
    return F.when(status.isNull(), "none").when(sure, shown).when(method == "target_lost", "lost").otherwise("none")
