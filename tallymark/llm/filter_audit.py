"""What each text filter removes in every order of filters, and what it removes alone.

Four filters read one document (short, repetitive, capitals, symbols); the fifth asks whether the same text stands at a smaller id.
That one is an existential self-join: a left-semi join on the text's hash, the text itself and a smaller id. Its ids are united
with the other failures and folded to one bit set per document; from then on only counts per (part, bit set) travel.

Defined results: a null text is empty (it fails the word count, and repeats of it are copies); a null part is the empty string; a
null id is never smaller or larger than another, so such rows are neither copies nor originals; rows that repeat an id and a text
are counted each, and none is a copy of the other; labels that repeat an id count if any row says 1; labels of other values or of
unknown ids say nothing. Empty tables give no rows. Other columns are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import small_side, stored

LETTERS = "ABCDE"
WORDS = r"[^\x20\x09-\x0D]++"
#: A text with more than one in so many rows is dealt over several tasks; so there are fewer such texts than this.
HOT = 1000


def text_failures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    min_words: int = 100, min_distinct: int = 80, max_capitals: int = 10, symbols: str = "#$%&*|",
) -> DataFrame:
    """``id, part, hash, failed`` per row. Bits of ``failed``: 1 under ``min_words`` words, 2 distinct words under
    ``min_distinct`` percent, 4 capitals over ``max_capitals`` percent of the characters, 8 any of ``symbols``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), part.alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    checks = [
        F.size("words") < min_words,
        100 * F.size(F.array_distinct("words")) < min_distinct * F.size("words"),
        100 * F.length(F.regexp_replace("text", "[^A-Z]++", "")) > max_capitals * F.length("text"),
        F.length(F.translate("text", symbols, "")) < F.length("text"),
    ]
    failed = sum((F.when(check, 1 << k).otherwise(0) for k, check in enumerate(checks)), F.lit(0))
    return rows.select("id", "part", F.sha2("text", 256).alias("hash"), failed.alias("failed"))


def later_copies(docs: DataFrame, hashes: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id, part, hash`` of the rows whose text also stands at a smaller id; ``hashes`` holds ``id, hash`` of all rows.

    Only texts whose hash stands at two ids are moved. Copies of one text are dealt over several tasks by their id, and the
    first place of each text, found by a map-side minimum, is sent to each of these.
    """
    groups = hashes.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    groups = stored(groups.where("low < high").select("hash", "n"), "repeated")
    total = hashes.count()
    # Fewer than HOT hashes can hold more than a thousandth of all rows each.
    hot = F.broadcast(groups.where(F.col("n") * HOT > total).select("hash", F.ceil(F.col("n") * HOT / total).cast("int").alias("deals")))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), part.alias("part"), text.alias("text"), F.sha2(text, 256).alias("hash"))
    moved = stored(rows.join(small_side(groups.select("hash")), "hash", "left_semi"), "copies")
    firsts = moved.groupBy("hash", "text").agg(F.min("id").alias("first")).join(hot, "hash", "left")
    firsts = firsts.withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)))
    later = moved.join(hot, "hash", "left").withColumn("deal", F.pmod(F.xxhash64("id"), F.coalesce("deals", F.lit(1))).cast("int"))
    a, b = later.alias("a"), firsts.alias("b")
    same = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.deal") == F.col("b.deal")) & (F.col("a.text") == F.col("b.text"))
    return a.join(b, same & (F.col("b.first") < F.col("a.id")), "left_semi").select("id", "part", "hash")


def bit_counts(failures: DataFrame, copies: DataFrame, labels: DataFrame, id_col: str = "doc_id", copy_bit: int = 16) -> DataFrame:
    """``part, failed, good, toxic, n``: documents by the set of filters they fail and by their labels."""
    keys = ["id", "hash", "part"]
    rows = failures.select(*keys, "failed", F.lit(1).alias("n")).union(copies.select(*keys, F.lit(copy_bit), F.lit(0)))
    folded = rows.groupBy(*keys).agg(F.bit_or("failed").alias("failed"), F.sum("n").alias("n"))
    said = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    found = folded.join(said, "id", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return found.groupBy("part", "failed", *flags).agg(F.sum("n").alias("n"))


def every_order(letters: str = LETTERS) -> list[tuple[str, int, str, int, int]]:
    """(order, step from 1, letter, its bit, the bits before it) of all orders of the filters."""
    bit = {c: 1 << k for k, c in enumerate(letters)}
    return [
        ("".join(order), k + 1, c, bit[c], sum(bit[x] for x in order[:k])) for order in permutations(letters) for k, c in enumerate(order)
    ]


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step from the counts of ``bit_counts``.

    Each count is laid out once per (filter, set of filters before it), which are few; orders are attached after summing.
    """
    bits = [1 << k for k in range(len(letters))]
    settings = [(own, sum(before)) for own in bits for k in range(len(bits)) for before in combinations([b for b in bits if b != own], k)]
    setting = F.explode(F.array(*[F.struct(F.lit(own).alias("own"), F.lit(before).alias("before")) for own, before in settings]))
    rows = counts.select("*", setting.alias("s")).select("*", "s.own", "s.before")
    fails, gone = F.col("failed").bitwiseAND(F.col("own")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(F.lit(0).cast("long")))
    sums = rows.groupBy("part", "own", "before").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"),
        count(F.col("failed") == F.col("own")).alias("unique_fails"),
        count(fails & ~gone & F.col("good")).alias("good_lost"), count(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    orders = counts.sparkSession.createDataFrame(every_order(letters), "filter_order string, step int, letter string, own int, before int")
    steps = sums.join(F.broadcast(orders), ["own", "before"])  # n! * n rows, whatever the tables hold
    shapley = F.sum("removed").over(Window.partitionBy("part", "own"))
    return steps.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"), "letter"
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", **limits) -> DataFrame:
    """All orders of the five filters over ``docs``; ``limits`` go to ``text_failures``."""
    failures = stored(text_failures(docs, id_col, text_col, part_col, **limits), "failures")
    copies = later_copies(docs, failures.select("id", "hash"), id_col, text_col, part_col)
    return interactions(bit_counts(failures, copies, labels, id_col))
