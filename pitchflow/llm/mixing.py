"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions alone.

A source's documents are cut into blocks. With weight w of W slots, block k (from 0) of a source has release time
floor(k * W / w) and deadline ceil((k + 1) * W / w), as in Pfair scheduling of one processor. In each slot the released
block with the earliest deadline goes next (ties: the source of larger weight, then the first by name), so after any number
of slots every source is less than one block off its share. The sequence repeats after W slots. Sources of equal weight have
equal windows and take turns, so the state of the schedule is a number for each distinct weight (W slots have less than
sqrt(2 W) of them). It is folded in pieces of ``PIECE`` slots, each of which is a table, so a period may be of any length;
blocks take their slots from it by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Documents in a block; slots in a period (sources are at most as many; beyond, W is the number of sources).
BLOCK = 16
SLOTS = 400
#: A source's documents are put in order by bucket, a hash of the id, then id; a task sorts a bucket of a source.
BUCKETS = 1 << 14
#: Slots that one fold goes through.
PIECE = 1 << 13
#: A schedule of so many slots, and weights of as many sources, are broadcast (tens of bytes each); larger ones are joined.
MAX_SENT = 1 << 16


def square_root_weights(counts: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(source, w): integer weights in proportion to the square root of each source's n documents (temperature 2), at
    least 1, whose sum is the period."""
    root = F.floor(F.sqrt(F.col("n").cast("double")) * 16).cast("long")
    return counts.withColumn("root", root).select(
        "source", F.greatest(F.lit(1), F.expr(f"{slots} * root div sum(root) over ()")).cast("long").alias("w")
    )


def _folded(state: DataFrame, first: int, last: int) -> DataFrame:
    """(done, out) after the slots from first to last: blocks placed so far of each distinct weight, and of each slot the
    weight's place and the number of its block. ``state``: s (w, m: a weight and how many sources have it), period, done."""
    return state.selectExpr(
        "s",
        "period",
        f"""aggregate(sequence({first}L, {last}L), named_struct('done', done, 'out', cast(array() as array<struct<c:int,j:bigint>>)),
            (acc, t) -> transform(array(array_min(filter(transform(s, (x, i) -> named_struct(
                    'late', if(acc.done[i] div x.m < x.w and (acc.done[i] div x.m) * period div x.w <= t,
                               ((acc.done[i] div x.m + 1) * period + x.w - 1) div x.w, null), 'i', i)), y -> y.late is not null)).i),
                p -> named_struct('done', transform(acc.done, (d, i) -> if(i = p, d + 1, d)),
                                  'out', acc.out || array(named_struct('c', p, 'j', acc.done[p]))))[0]) as f""",
    ).select("s", "period", "f.*")


def schedule(weights: DataFrame, needed: int | None = None) -> DataFrame:
    """(source, w, period, nth, slot) for one period, or its first ``needed`` slots: the slot of the source's nth block in
    it. One row a slot. ``weights``: (source, w) with distinct sources and positive integers.
    """
    by_name = Window.partitionBy("w").orderBy(F.coalesce("source", F.lit("")), F.col("source").isNotNull())
    members = weights.select("source", "w", (F.row_number().over(by_name) - 1).cast("long").alias("member"))
    classes = weights.groupBy("w").agg(F.count("*").alias("m"))
    given = classes.groupBy().agg(F.reverse(F.array_sort(F.collect_list(F.struct("w", "m")))).alias("s"), F.sum(F.col("w") * F.col("m")).alias("period"))
    period = given.first().period or 0
    slots_ = period if needed is None else min(period, needed)
    state, slots = given.selectExpr("s", "period", "transform(s, x -> 0L) as done"), None
    for first in range(0, max(1, slots_), PIECE):
        folded = _folded(state.where("period > 0"), first, max(1, min(slots_, first + PIECE)) - 1)
        if slots_ > PIECE:
            folded = stored(folded, "slots")
        piece = folded.select("s", "period", F.posexplode("out").alias("at", "o"))
        part = piece.select(F.expr("s[o.c].w").alias("__w"), "period", F.expr("o.j % s[o.c].m").alias("__member"), F.expr("o.j div s[o.c].m").alias("nth"), (F.col("at") + first).cast("long").alias("slot"))
        slots = part if slots is None else slots.unionByName(part)
        state = folded.select("s", "period", "done")
    mine = (members.w == slots["__w"]) & (members.member == slots["__member"])
    return slots.join(members, mine).select("source", "w", "period", "nth", "slot")


def bucket_of() -> Column:
    """The bucket of a row, by the MD5 of its id as text; of a row without id below 0, by its text."""
    spread = lambda c: F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), F.lit(BUCKETS))
    nameless = -1 - spread(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.coalesce(spread(F.col("doc_id").cast("string").cast("binary")), nameless).cast("int")


def blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with __block and __at: the block of its source that a row is in and its place there.

    Ranks come from counts of the (source, bucket) pairs, so no task sorts a whole source. A row's bucket follows from the row
    alone, so adding rows moves the others by as many places and no more.
    """
    put = docs.withColumn("__bucket", bucket_of())
    counts = put.groupBy(F.col("source").alias("__source"), F.col("__bucket").alias("__b")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("__source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__source", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("source", "__bucket").orderBy("doc_id", F.xxhash64("text"))
    ranked = put.withColumn("__in", F.row_number().over(inside) - 1).join(
        base, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__b"))
    )
    rank = F.col("__base") + F.col("__in")
    return ranked.select(
        *[docs[c] for c in docs.columns], F.floor(rank / block).alias("__block"), F.pmod(rank, F.lit(block)).alias("__at")
    )


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """``docs`` with mix_weight, mix_period, mix_block, mix_slot and mix_position.

    Ordered by mix_position, the rows are the mixture. While no source has run out, after any number of slots every source
    has had its share to less than one block; later the others go on in the slots they have. No row is dropped or
    repeated. ``weights``: (source, w), default square roots of the sources' sizes; the weights of a source listed several
    times add up, and sources that it lacks or gives no positive weight get no place (null columns). A null source is a source of its own; rows with equal or no doc_id go by
    their texts. Ids may be of any type. Columns with the names of the new ones are replaced; empty tables give empty ones.
    """
    given = weights if weights is not None else square_root_weights(docs.groupBy("source").agg(F.count("*").alias("n")), slots)
    given = given.groupBy("source").agg(F.sum(F.col("w").cast("long")).alias("w")).where("w > 0")
    given = stored(given, "weights")
    held = docs.groupBy(F.col("source").alias("__of")).agg(F.ceil(F.count("*") / block).alias("n"))
    # the last slot in use: a source's last block is due by then
    due = F.expr("ceil(least(n, w) * (sum(w) over ()) / w)")
    sources, needed = given.join(held, F.col("source").eqNullSafe(F.col("__of")), "left").select(due.alias("due")).agg(F.count("*"), F.coalesce(F.max("due"), F.lit(0))).first()
    send = F.broadcast if max(sources, needed) <= MAX_SENT else (lambda df: df)
    plan = schedule(given, needed + 1).toDF("__for", "__w", "__period", "__nth", "__slot")
    sizes = given.toDF("__s", "__weight")
    new = ["mix_weight", "mix_period", "mix_block", "mix_slot", "mix_position"]
    placed = blocks(docs.drop(*new), block).join(send(sizes), F.col("source").eqNullSafe(F.col("__s")), "left")
    mine = F.col("source").eqNullSafe(F.col("__for")) & (F.expr("__block % __weight") == F.col("__nth"))
    out = placed.join(send(plan), mine, "left")
    slot = F.expr("__block div __w * __period + __slot")
    return out.select(
        *[c for c in docs.columns if c not in new],
        F.col("__w").alias("mix_weight"),
        F.col("__period").alias("mix_period"),
        F.col("__block").alias("mix_block"),
        slot.alias("mix_slot"),
        (slot * block + F.col("__at")).alias("mix_position"),
    )
