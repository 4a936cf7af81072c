"""Line dedup: a line goes if an equal line, or one within one edit, stands earlier in the corpus.

Equal lines meet by two 64-bit hashes; texts of lines are not shuffled. Lines of any length are then
compared within one edit by a deletion-neighbourhood join (``max_edits=0`` leaves that out). Two such lines share a half (of the shorter one's length), so
halves that no other line has drop nearly all lines first; likewise lines without one of ``BLOCKS`` blocks, which also
tells where an edit can be. The rest emit hashed keys: every one-deletion variant within those blocks together with the
place of the deletion (equal keys: one substitution apart), every variant alone and the line itself (equal keys of
one and the other: one deletion apart). Groups of equal keys hold distinct lines, so they are bounded by the alphabet; each
member is paired with the earliest only. Pairs are verified by edit distance; the earliest line stays.

Earliest means the smallest document id, then the smallest line number. Removal looks at what stands in the input: a line
that is itself removed still removes later ones. Defined results: blank lines always stay and count nowhere; null and empty
texts have no lines and stay as they are; null ids come before all others; rows that repeat an id and a text stand at the
same place, so what one keeps all keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .ship import ship
from .staging import small_side, stored

#: Parts of a line; an edit lies in one of them.
BLOCKS = 8
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _sums(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each prefix of a line, under the k-th function."""
    value = tb.mix(codes.astype(np.uint64) + np.uint64(k << 32 | 1))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * tb._power(_BASES[k], len(codes)), dtype=np.uint64)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line without one of ``BLOCKS`` blocks in turn, for its own length and one less: (key, line, block from, to)."""
    for batch in batches:
        rows = []
        for line, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes = _codes(text)
            n, sums = len(codes), _sums(codes, 0)
            for m in (n, max(1, n - 1)):  # no line is empty
                front = np.arange(0, m, -(-m // BLOCKS))
                back = np.maximum(0, m - front - -(-m // BLOCKS))
                rest = (sums[-1] - sums[n - back]) * tb._power(pow(_BASES[0], -1, 2**64), n + 1)[n - back]
                keys = tb.mix(tb.mix(sums[front] + np.uint64(m)) + tb.mix(rest + front.astype(np.uint64)))
                rows += zip(keys.view(np.int64).tolist(), [line] * len(keys), front.tolist(), (n - back).tolist(), strict=True)
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "line", "low", "high"])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of (line, text, blocks): role 0 the line, 1 a variant, 2 a variant with its place; of places within the blocks."""
    for batch in batches:
        for line, text, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes = _codes(text)
            inside = np.zeros(len(codes), bool)
            for block in blocks:
                inside[block["low"] : block["high"]] = True
            place = np.flatnonzero(inside)
            one, two = (
                tb.mix(s[place] + (s[-1] - s[place + 1]) * np.uint64(pow(base, -1, 2**64))) for s, base in ((_sums(codes, k), b) for k, b in enumerate(_BASES))
            )
            whole = tb.mix(np.array([_sums(codes, k)[-1] for k in range(2)], np.uint64))
            alone = np.unique(one, return_index=True)[1]
            spot = tb.mix(place.astype(np.uint64) + np.uint64(1))
            v1 = np.concatenate((whole[:1], one[alone], tb.mix(one + spot)))
            v2 = np.concatenate((whole[1:], two[alone], tb.mix(two ^ spot)))
            role = np.concatenate((np.zeros(1, np.int32), np.ones(len(alone), np.int32), np.full(len(place), 2, np.int32)))
            for at in range(0, len(v1), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v1[part].view(np.int64)), pa.array(v2[part].view(np.int64)), pa.array(role[part]), pa.array(np.full(len(role[part]), line))],
                    ["v1", "v2", "role", "line"],
                )


def _halves(line: Column, n: Column) -> Column:
    """Hashes of the halves that a line one edit away has too: of its own length and of one less."""
    found = []
    for size in (n, n - 1):
        front = F.floor(size / 2).cast("int")
        found += [F.xxhash64(size, F.lit("p"), F.substring(line, F.lit(1), front)), F.xxhash64(size, F.lit("s"), F.right(line, size - front))]
    return F.array(*found)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (..., text, kept line numbers) to the counts and the text that stays."""
    for batch in batches:
        counts, removed, texts = [], [], []
        for text, kept in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if text is None:
                counts.append(0), removed.append(0), texts.append(None)
                continue
            lines, stays = text.split("\n"), set(kept or ())
            full = [bool(line.strip(" ")) for line in lines]
            rest = [line for k, line in enumerate(lines) if not full[k] or k in stays]
            counts.append(sum(full))
            removed.append(len(lines) - len(rest))
            texts.append("\n".join(rest))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-2], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
            schema=pa.schema([*list(batch.schema)[:-2], ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]),
        )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1) -> DataFrame:
    """``docs`` (all columns) with ``n_lines`` (not blank), ``n_removed`` and ``kept_text``; columns of those names are replaced.

    ``max_edits``: 1, or 0 for equal lines only; other bounds raise.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    ship(docs.sparkSession)
    names = ("n_lines", "n_removed", "kept_text")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    marked = kept.withColumns({"__doc": F.col(f"`{id_col}`"), "__text": F.col(f"`{text_col}`").cast("string")}).withColumn("__sig", F.xxhash64("__text"))
    texts = marked.select("__doc", "__sig", "__text")
    lines = texts.select("__doc", "__sig", F.posexplode(F.split("__text", "\n")).alias("__pos", "__line")).where(F.trim("__line") != "")
    lines = lines.withColumn("__n", F.length("__line"))
    halves = _halves(F.col("__line"), F.col("__n")) if max_edits else F.lit(None).cast("array<long>")
    place = F.struct(F.col("__doc").alias("doc"), F.col("__pos").alias("pos"), F.col("__sig").alias("sig"))
    hashed = lines.select(F.xxhash64("__line").alias("h1"), F.xxhash64(F.lit(7), "__line").alias("h2"), place.alias("at"), halves.alias("halves"))
    firsts = hashed.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("halves").alias("halves")).select("at", "halves")
    firsts = stored(firsts, "lines").withColumn("number", F.monotonically_increasing_id())

    spread = firsts.where("halves is not null").select("number", F.explode("halves").alias("half"))
    common = stored(spread.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half"), "halves")
    near = stored(spread.join(small_side(common), "half", "left_semi").select("number").distinct(), "near")
    near = firsts.join(small_side(near), "number", "left_semi").select("at.*")
    wanted = small_side(stored(near.groupBy("doc", "sig").agg(F.collect_list("pos").alias("places")), "wanted"))
    same = lambda left: (left["__doc"].eqNullSafe(F.col("doc"))) & (left["__sig"] == F.col("sig"))
    found = texts.join(wanted, same(texts)).select("doc", "sig", F.split("__text", "\n").alias("all"), F.explode("places").alias("pos"))
    # Few lines are left here. They are numbered in the order of their places.
    near = found.select("doc", "pos", "sig", F.expr("all[pos]").alias("text")).dropDuplicates(["doc", "pos", "sig"])
    near = stored(near.repartitionByRange("doc", "pos", "sig").sortWithinPartitions("doc", "pos", "sig").withColumn("line", F.monotonically_increasing_id()), "near")
    blocks = near.select("line", "text").mapInArrow(_blocks, "key long, line long, low long, high long")
    common = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    touched = blocks.join(common, "key", "left_semi").groupBy("line").agg(F.collect_set(F.struct("low", "high")).alias("blocks"))
    keys = near.select("line", "text").join(touched, "line").select("line", "text", "blocks").mapInArrow(_emit, "v1 long, v2 long, role int, line long")
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("line"))).alias(f"m{role}")
    groups = keys.groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("n"), least(0), least(1), least(2)).where("n > 1")
    pairs = keys.join(groups, ["v1", "v2"]).withColumn("other", F.expr("case role when 2 then m2 when 1 then m0 else m1 end"))
    pairs = pairs.where("other < line").select("line", "other").distinct()
    right = near.select(F.col("line").alias("other"), F.col("text").alias("other_text"))
    gone = pairs.join(near, "line").join(right, "other").where(F.levenshtein("text", "other_text", 1) >= 0)
    gone = small_side(stored(gone.select(F.col("doc").alias("g_doc"), F.col("pos").alias("g_pos"), F.col("sig").alias("g_sig")).distinct(), "gone"))

    stays = firsts.select("at.*").join(gone, F.col("doc").eqNullSafe(F.col("g_doc")) & (F.col("pos") == F.col("g_pos")) & (F.col("sig") == F.col("g_sig")), "left_anti")
    stays = stays.groupBy("doc", "sig").agg(F.collect_list("pos").alias("stays"))
    joined = marked.join(stays, same(marked), "left").select(*[F.col(f"`{c}`") for c in kept.columns], "__text", "stays")
    fields = kept.schema.fields + [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    return joined.mapInArrow(_keep, T.StructType(fields))
