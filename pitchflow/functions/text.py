"""Column expressions over names, annotation lines and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CARD_COUNTS, COLOURS, PHRASES


def slug(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit("video")).otherwise(out)


def seconds(text: Column) -> Column:
    """[H:]M:SS as seconds; null otherwise."""
    part = lambda k: F.regexp_extract(text, r"^\s*(?:(\d+):)?(\d+):([0-5]\d)\s*$", k)
    ok = text.rlike(r"^\s*(?:\d+:)?\d+:[0-5]\d\s*$")
    hours = F.coalesce(F.expr("0") + F.nullif(part(1), F.lit("")).cast("int"), F.lit(0))
    return F.when(ok, (hours * 3600 + part(2).cast("int") * 60 + part(3).cast("int")).cast("double"))


def touch_times(text: Column) -> Column:
    """array<struct<t, problem>> of a list of times split by commas or lines: an entry that is no time has a null t and
    stands in ``problem`` as it is."""
    entries = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,\n]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(entries, lambda x: F.struct(seconds(x).alias("t"), F.when(seconds(x).isNull(), x).alias("problem")))


def event_type(phrase: Column) -> Column:
    """The first listed phrase found in the text; key_moment otherwise."""
    out = None
    for key, kind in PHRASES:
        hit = F.lower(phrase).contains(key)
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out.otherwise(F.lit("key_moment"))


def annotation(line: Column) -> Column:
    """struct<t, jersey_number, team_colour, action_phrase, event_type>, null for a line that does not parse.

    A time comes first, after "Min " if that is there, then a dash or colon and the word player, if there. A colour (with "in"
    before it or not) and the number after # may stand anywhere; the phrase is what is left. Only time and number must be there.
    """
    start = r"(?s)^(?:Min )?((?:\d{1,2}:)?\d{1,2}:\d{2})(.*)$"
    text = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    clock = F.split(F.regexp_extract(text, start, 1), ":")
    t = F.aggregate(clock, F.lit(0), lambda acc, x: acc * 60 + F.coalesce(x.try_cast("int"), F.lit(0))).cast("double")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, start, 2), r"^\s*(?:[—:-]\s*)?", ""), r"(?i)^\s*player\b\s*", "")
    coloured = rf"(?is)^(.*?)\b(?:in\s+)?({'|'.join(sorted(COLOURS, key=len, reverse=True))})\b(.*)$"
    named = F.regexp_extract(rest, coloured, 2)
    plain = F.regexp_replace(rest, coloured, "$1$3")
    numbered = r"(?s)^(.*?)#\s*(\d+)(.*)$"
    phrase = F.trim(F.regexp_replace(F.regexp_replace(plain, numbered, "$1$3"), r"\s+", " "))
    return F.when(
        ~skipped(line) & text.rlike(start) & plain.rlike(numbered),
        F.struct(
            t.alias("t"),
            F.regexp_extract(plain, numbered, 2).try_cast("int").alias("jersey_number"),
            F.when(named == "", F.lit("unspecified")).otherwise(F.lower(named)).alias("team_colour"),
            phrase.alias("action_phrase"),
            event_type(phrase).alias("event_type"),
        ),
    )


def skipped(line: Column) -> Column:
    """Blank, comment and address lines."""
    return line.rlike(r"^\s*$|^\s*#|^\s*https?://")


def colour_reference(name: Column) -> Column:
    """struct<l, a, b>: what a named colour looks like; null for a name that is not known."""
    table = F.create_map(*[x for word, lab in COLOURS.items() for x in (F.lit(word), F.struct(*[F.lit(v).alias(k) for k, v in zip("lab", lab, strict=True)]))])
    return table[F.lower(name)]


def verdict(text: Column) -> Column:
    return F.upper(F.coalesce(F.regexp_extract(text, r"(?i)VERDICT\s*=\s*(YES|NO)", 1), F.lit(""))) == "YES"


def score(text: Column) -> Column:
    """struct<home, away> of the first d-d or d:d in a text; null without."""
    form = r"(?<!\d)(\d{1,2})\s*[-:]\s*(\d{1,2})(?!\d)"
    return F.when(
        text.rlike(form),
        F.struct(F.regexp_extract(text, form, 1).cast("int").alias("home"), F.regexp_extract(text, form, 2).cast("int").alias("away")),
    )


def clock(t: Column) -> Column:
    """M:SS.s; ties go to the even digit."""
    return F.format_string("%d:%04.1f", F.floor(t / 60).cast("int"), F.bround(t - F.floor(t / 60) * 60, 1))


def caption_clock(t: Column) -> Column:
    """M:SS, cut to whole seconds."""
    return F.format_string("%d:%02d", F.floor(t / 60).cast("int"), F.floor(t - F.floor(t / 60) * 60).cast("int"))


def padded_clock(t: Column) -> Column:
    """MM:SS.s; ties go to the even digit."""
    return F.format_string("%02d:%04.1f", F.floor(t / 60).cast("int"), F.bround(t - F.floor(t / 60) * 60, 1))


def joined_tokens(tokens: Column) -> Column:
    """The texts of tokens (array of x and text) from left to right, by spaces."""
    return F.array_join(F.transform(F.array_sort(F.transform(tokens, lambda k: F.struct(k["x"].alias("x"), k["text"].alias("text")))), lambda k: k["text"]), " ")


def evidence(*columns: str) -> Column:
    """What an event rests on, as JSON: the columns by name, without nulls."""
    return F.to_json(F.struct(*columns))


def probed(average: Column, declared: Column, stream_s: Column, format_s: Column, frames: Column) -> Column:
    """struct<fps, duration, nb_frames> of a video's metadata texts: the average rate or the declared one, the length of the
    stream or of the file (0 if neither is told), and the frames as told or by length and rate (null without both)."""
    told = lambda c: F.when(~F.coalesce(c, F.lit("")).isin("", "N/A"), c)
    fps = frame_rate(F.coalesce(F.nullif(average, F.lit("")), F.nullif(declared, F.lit("")), F.lit("0/1")))
    length = F.coalesce(told(F.coalesce(F.nullif(stream_s, F.lit("")), F.nullif(format_s, F.lit("")))).cast("double"), F.lit(0.0))
    made = F.when((length > 0) & (fps > 0), F.bround(length * fps).cast("long"))
    return F.struct(fps.alias("fps"), length.alias("duration"), F.coalesce(told(frames).cast("long"), made).alias("nb_frames"))


def frame_rate(text: Column) -> Column:
    """'n/d' or a decimal; 0 for a zero divisor."""
    parts = F.split(text, "/")
    n, d = parts[0].cast("double"), F.coalesce(F.try_element_at(parts, F.lit(2)).cast("double"), F.lit(1.0))
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def number_answer(text: Column) -> Column:
    """struct<digits, confidence> of a NUMBER answer: a read, an honest UNKNOWN, or nothing usable."""
    got = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)NUMBER\s*=\s*(UNKNOWN|\d{1,2})", 1)
    digits = F.when(got.rlike(r"^\d+$"), got)
    conf = F.when(digits.isNotNull(), 0.75).when(F.upper(got) == "UNKNOWN", 0.15).otherwise(0.0)
    return F.struct(digits.alias("digits"), conf.alias("confidence"))


def goal_box_answer(text: Column) -> Column:
    """struct<x1, y1, x2, y2> in shares of the frame of a GOAL answer in thousandths; null unless in order."""
    form = r"(?i)GOAL\s*=\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
    side = [F.regexp_extract(text, form, k).cast("double") / 1000 for k in (1, 2, 3, 4)]
    ordered = text.rlike(form) & (side[0] < side[2]) & (side[1] < side[3])
    return F.when(ordered, F.struct(*[c.alias(n) for c, n in zip(side, ("x1", "y1", "x2", "y2"), strict=True)]))


def stat_card(text: Column) -> Column:
    """The counts, texts and timeline rows of an archived card: a count that is no number is 0, a missing status Unknown, a
    confidence that is no number 0.9."""
    value = lambda label: F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?im)^\s*\*\*{label}:\*\*[ \t]*([^\r\n]*)$", 1)), F.lit(""))
    counts = [F.coalesce(F.regexp_extract(value("sprints/runs" if name == "sprints" else name), r"^(-?\d+)(?:\s|$)", 1).try_cast("int"), F.lit(0)).alias(name) for name in CARD_COUNTS]
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    table = F.filter(lines, lambda x: x.startswith("|") & ~x.startswith("| Time") & ~x.startswith("|---"))
    cells = F.transform(table, lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda c: F.trim(c)), lambda c: c != ""))
    row = lambda c: F.struct(c[0].alias("time"), c[1].alias("event"), F.coalesce(c[2].try_cast("double"), F.lit(0.9)).alias("confidence"))
    return F.struct(
        F.coalesce(value("Identity Status"), F.lit("Unknown")).alias("identity_status"), *counts,
        F.coalesce(value("Possession Time"), F.lit("uncertain")).alias("possession_time"), F.coalesce(value("Distance Covered"), F.lit("uncertain")).alias("distance_covered"),
        F.transform(F.filter(cells, lambda c: F.size(c) >= 3), row).alias("events"),
    )


def stat_card_text(number: Column, counts: dict[str, Column], possession: Column, distance: Column, rows: Column, reason: Column, identity: Column) -> Column:
    """A card that ``stat_card`` reads. ``counts``: by the names in CARD_COUNTS; ``rows``: array of t_start, label and
    confidence in order of time. Goals and assists of 0 show the reason why they are unknown, where there is one; a null
    possession or distance is uncertain."""
    line = lambda label, value: F.concat(F.lit(f"**{label}:** "), value)
    count = lambda name: F.coalesce(counts.get(name, F.lit(0)), F.lit(0))
    known = lambda name: F.when((count(name) > 0) | reason.isNull(), count(name).cast("string")).otherwise(reason)
    labels = {"Touches": "touches", "Passes": "passes", "Turnovers": "turnovers", "Sprints/Runs": "sprints", "Goals": "goals", "Assists": "assists", "Shots": "shots", "Tackles": "tackles", "Saves": "saves", "Dribbles": "dribbles"}
    shown = [line(label, known(name) if name in ("goals", "assists") else count(name).cast("string")) for label, name in labels.items()]
    table = F.transform(rows, lambda r: F.concat(F.lit("| "), clock(r["t_start"]), F.lit(" | "), r["label"], F.lit(" | "), F.format_string("%.2f", F.bround(r["confidence"], 2)), F.lit(" |")))
    empty = F.array(F.lit("| _(no events attributed to this player)_ | | |"))
    who = F.coalesce(F.concat(F.lit("## Player #"), number.cast("string")), F.lit("## Target player (jersey number not readable)"))
    uncertain = F.lit("uncertain")
    head = [F.lit("# Player Statistics"), F.lit(""), who, F.lit(""), line("Identity Status", identity), F.lit(""), *shown]
    head += [line("Possession Time", F.when(possession.isNotNull(), F.format_string("%.1fs", F.bround(possession, 1))).otherwise(uncertain))]
    head += [line("Distance Covered", F.when(distance.isNotNull(), F.format_string("%.2f bbox_heights (uncalibrated)", F.bround(distance, 2))).otherwise(uncertain))]
    head += [F.lit(""), F.lit("## Event Timeline"), F.lit(""), F.lit("| Time | Event | Confidence |"), F.lit("|------|-------|------------|")]
    return F.concat(F.array_join(F.concat(F.array(*head), F.when(F.size(rows) > 0, table).otherwise(empty)), "\n"), F.lit("\n"))


def annotation_template(video: Column, takes: Column) -> Column:
    """Text to fill in for a video: an example line under every take of ``takes`` (array of take_id, status, confidence) whose
    player is not verified."""
    open_ = F.filter(takes, lambda k: ~k["status"].eqNullSafe("verified"))
    example = "# 00:00 player #0 in white makes a pass"
    block = lambda k: F.format_string(f"#\n# Take %d: %s, confidence %.2f\n{example}", k["take_id"], F.coalesce(k["status"], F.lit("unknown")), F.coalesce(k["confidence"], F.lit(0.0)))
    head = F.concat(F.lit("# Annotations of "), video.cast("string"), F.lit("\n# One event a line: MM:SS player #<number> in <colour> <what happens>"))
    return F.concat(head, F.lit("\n"), F.when(F.size(open_) > 0, F.array_join(F.transform(open_, block), "\n")).otherwise(F.lit("#\n# Every take is verified.")), F.lit("\n"))


def player_key(number: Column, target: Column) -> Column:
    """Name of a player's folder: by number, else by the target's id, else unknown."""
    return F.coalesce(F.concat(F.lit("player_"), number.cast("string")), F.nullif(F.lower(target), F.lit("")), F.lit("player_unknown"))


def touch_player(typed: Column, produced: Column) -> Column:
    """struct<number, how>: the number that typed touches belong to, the typed one or the only one that has events."""
    numbers = F.array_compact(F.array_distinct(produced))
    only = F.when(F.size(numbers) == 1, F.get(numbers, F.lit(0)))
    how = F.when(typed.isNotNull(), "typed").when(only.isNotNull(), "single_jersey_inferred").otherwise("ambiguous_not_attached")
    return F.struct(F.coalesce(typed, only).alias("number"), how.alias("how"))
