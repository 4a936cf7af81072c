"""Mixing sources to target weights along a curriculum that changes over training time, with DataFrame functions only.

Every source follows a weight schedule over training time 0 to 1, straight between its knots. The schedule's integral is the
source's weight: it sets how many words the mix takes from it. A target stops at ``cap`` times the source's size, and the excess
goes to the others by weight. Inside a source, documents stand in a fixed pseudo-random order and repeat in epochs; a copy whose
first word is word ``o`` of the source's demand belongs where the integrated schedule reaches ``o``. Inverting the integral gives
that position; sorting by it by ranges gives the training order. The last copy taken from a source may be cut, so the words
taken meet the target to the word.

Defined results: a null text has no words; a null source is a source of its own, last in order; sources without words get target
0; documents without words are taken 0 times. Order depends on id and text only, so reruns agree; rows that repeat both are
interchangeable and are laid out one after the other. Empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import with_rank
from .staging import small_side, stored

Schedule = Sequence[tuple[float, float]]
#: Knots (time, weight) of the sources in code-point order, repeating. Their integrals are 5, 2 and 1.
SCHEDULES: tuple[Schedule, ...] = (((0, 6), (1, 4)), ((0, 2), (0.5, 3), (1, 0)), ((0, 0), (1, 2)))
WORDS = r"[^\x20\x09-\x0D]++"
#: Rows of one source that are summed up in one task.
CHUNK_ROWS = 8192
_KEY_BITS = 60


def segments(schedule: Schedule) -> list[tuple[Fraction, Fraction, Fraction, Fraction, Fraction]]:
    """(from, to, weight at from, weight at to, area before) of each straight piece; times start at 0 and end at 1."""
    knots = [(Fraction(t), Fraction(w)) for t, w in schedule]
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots) or any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)):
        raise ValueError("a schedule needs rising times from 0 to 1 and weights of 0 or more")
    out, area = [], Fraction(0)
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        out.append((t0, t1, a, b, area))
        area += (a + b) / 2 * (t1 - t0)
    return out


def weights(schedules: Sequence[Schedule]) -> list[int]:
    """The schedules' integrals as whole numbers in the same proportion."""
    areas = [sum(((a + b) / 2 * (t1 - t0) for t0, t1, a, b, _ in segments(s)), Fraction(0)) for s in schedules]
    if min(areas) <= 0:
        raise ValueError("a schedule must take something")
    scale = lcm(*[x.denominator for x in areas])
    return [int(x * scale) for x in areas]


def position(schedule: Schedule, share: Column) -> Column:
    """The time at which ``schedule`` has taken ``share`` (0 to 1) of its whole area."""
    pieces = segments(schedule)
    t0, t1, a, b, before = pieces[-1]
    total = before + (a + b) / 2 * (t1 - t0)
    found = None
    for k in reversed(range(len(pieces))):
        t0, t1, a, b, before = pieces[k]
        left = F.greatest(share * float(total) - float(before), F.lit(0.0))
        # a u + (b - a) / (2 h) u^2 = left, solved without cancellation.
        root = F.sqrt(F.greatest(float(a * a) + float(2 * (b - a) / (t1 - t0)) * left, F.lit(0.0)))
        here = float(t0) + F.when(left <= 0, F.lit(0.0)).otherwise(F.least(2 * left / (float(a) + root), F.lit(float(t1 - t0))))
        found = here if found is None else F.when(share * float(total) < float(pieces[k + 1][4]), here).otherwise(found)
    return found


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, source, size, key``: words per row and the 60-bit key that orders the rows of a source."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    key = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return docs.select(
        ident.alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(key, 1, _KEY_BITS // 4), 16, 10).cast("long").alias("key"),
    )


def _big(number: int) -> Column:
    return F.lit(str(number)).cast("decimal(38,0)")


def targets(sizes: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, cap: int = 3) -> DataFrame:
    """``source, source_size, schedule, target, take`` per source; ``take`` is the target rounded to words.

    ``target = min(cap * size, level * weight)``. The level rises until the targets share all words: each round sums sources
    that are at their cap and the weights of the others, in whole numbers; only those two sums reach the driver.
    """
    own = weights(schedules)
    totals = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = with_rank(totals, [F.col("source").asc_nulls_last()], "rank", "source-ranks")
    picked = F.pmod("rank", F.lit(len(own))).cast("int")
    weight = F.element_at(F.array(*[F.lit(w) for w in own]), picked + 1).cast("decimal(10,0)")
    table = stored(ranked.select("source", "source_size", picked.alias("schedule"), weight.alias("weight"), (F.col("source_size") * cap).alias("most")), "weights")
    sums = table.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("w")).first()
    words, level = int(sums["all"] or 0), (int(sums["all"] or 0), int(sums["w"] or 1))
    full = lambda: F.col("most").cast("decimal(20,0)") * _big(level[1]) <= F.col("weight") * _big(level[0])
    done = -1
    while True:
        now = table.agg(F.count(F.when(full(), 1)).alias("n"), F.sum(F.when(full(), F.col("most"))).alias("capped"), F.sum(F.when(~full(), F.col("weight"))).alias("w")).first()
        if now["n"] == done or now["w"] is None:
            break
        done, level = now["n"], (words - int(now["capped"] or 0), int(now["w"]))
    shared = F.col("weight") * _big(level[0])
    target = F.when(full(), F.col("most").cast("double")).otherwise(shared.cast("double") / F.lit(float(level[1])))
    doubled = F.when(full(), F.col("most").cast("decimal(20,0)") * _big(2 * level[1])).otherwise(shared * F.lit(2)) + _big(level[1])
    nearest = F.expr(f"CAST(__doubled div CAST('{2 * level[1]}' AS DECIMAL(38,0)) AS BIGINT)")
    found = table.withColumn("target", target).withColumn("__doubled", doubled).withColumn("take", nearest)
    return found.select("source", "source_size", "schedule", "target", "take")


def mix(
    docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, cap: int = 3,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``id, source, size, source_size, target, taken, copies`` per document; ``copies`` lists (position, words) of each copy taken.

    Running sums work inside chunks of the key, about ``chunk_rows`` rows each; one row per chunk is summed up per source.
    Rows equal in key, id and size are first counted, and their sums come from the count.
    """
    sizes = stored(words_of(docs, id_col, text_col, source_col), "sizes")
    per_source = targets(sizes, schedules, cap)
    bits = max(0, (-(-sizes.count() // chunk_rows) - 1).bit_length())
    rows = sizes.select(
        F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"),
        F.shiftright("key", _KEY_BITS - bits).alias("chunk"), "key", "id", "size",
    )
    place = ["none", "name", "chunk"]
    alike = stored(rows.groupBy(*place, "key", "id", "size").agg(F.count("*").alias("alike")), "alike")
    sums = alike.groupBy(*place).agg(F.sum(F.col("size") * F.col("alike")).alias("__words"))
    before = Window.partitionBy("none", "name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("__words").over(before), F.lit(0))).drop("__words")
    stats = per_source.select(
        F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "schedule", "target", "take"
    )
    chunks = sums.join(small_side(stored(stats, "targets")), ["none", "name"])
    inside = Window.partitionBy(*place).orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = alike.withColumn("__inside", F.coalesce(F.sum(F.col("size") * F.col("alike")).over(inside), F.lit(0)))
    found = summed.join(chunks, place).withColumn("__nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1)))
    found = found.withColumn("__offset", F.col("start") + F.col("__inside") + F.col("__nth") * F.col("size"))
    # Copy k starts at word offset + k * source_size of the source's demand, if that is less than what the mix takes.
    numbers = F.sequence(F.lit(0), F.lit(cap - 1))

    def copy_at(k):
        start = F.col("__offset") + k * F.col("source_size")
        return F.struct(start.alias("start"), F.least(F.col("size"), F.col("take") - start).alias("words"))

    starts = F.filter(F.transform(numbers, copy_at), lambda c: c["words"] > 0)
    found = found.withColumn("__starts", starts)
    taken = F.aggregate("__starts", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    copies = F.transform("__starts", lambda c: F.struct(_position(schedules, c["start"] / F.col("take")).alias("position"), c["words"].alias("words")))
    source = F.when(~F.col("none"), F.col("name"))
    return found.select("id", source.alias("source"), "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"))


def _position(schedules: Sequence[Schedule], share: Column) -> Column:
    """The time of ``share`` under the row's ``schedule``."""
    found = F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        found = F.when(F.col("schedule") == k, position(schedule, share)).otherwise(found)
    return found


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy taken, ``position, id, source, copy, words``, range-sorted by position."""
    rows = mixed.select("id", "source", F.posexplode("copies").alias("copy", "c"))
    return rows.select("c.position", "id", "source", "copy", "c.words").orderBy("position", "id", "copy")
