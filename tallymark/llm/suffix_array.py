"""Suffix-array dedup: removal of every byte covered by a ``size``-byte string that also starts earlier.

The corpus is split so that equal strings meet: the least hash of the ``gram``-byte strings inside a ``size``-byte string
(its anchor) depends on the string alone. Tasks emit, for each anchor, its hash, the hash of the stretch whose strings it
anchors, and its place. Anchors seen once drop out. Stretches that equal an earlier one go whole. What is left, distinct
stretches around one anchor, is gathered into blocks of bounded size, and a suffix array of each block finds equal strings:
suffixes are grouped by their longest Lyndon prefix, groups are processed in descending order with previous-smaller
pointers, and each group's order is emitted in one ascending pass without recursive renaming. Anchors with more distinct
stretches than a block holds are halved first: strings that start further before the anchor and those that start nearer
share more bytes than the anchor, and equal strings agree in them, so each half meets under these longer bytes. Halves that
equal an earlier one go whole, and those that still meet in too many kinds are halved again, down to single strings.

Defined results: null and empty texts have no bytes; matches never cross documents; null ids come first; rows that repeat
an id and a text stand at the same place, so none of them makes the other go.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import textbytes as tb
from .ship import ship
from .staging import small_side, stored

_PLACE_BITS = 20
_MASK = np.uint64((1 << _PLACE_BITS) - 1)


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of integers over 0; a 0 is put at the end and left out of the result."""
    text = [*text, 0]
    n = len(text)
    count = [0] * (max(text) + 2)
    for c in text:
        count[c + 1] += 1
    for c in range(1, len(count)):
        count[c] += count[c - 1]
    # A group is named by the first slot of its range in the result; members may be outdated, ``group`` decides.
    group = [count[c] for c in text]
    members: dict[int, list[int]] = {}
    for i, g in enumerate(group):
        members.setdefault(g, []).append(i)
    end = {g: g + len(m) - 1 for g, m in members.items()}
    ending = {e: g for g, e in end.items()}
    previous = [-1] * n
    last = n - 1
    while last >= 0:
        own = ending[last]
        times: dict[int, int] = {}
        for s in sorted(i for i in members.pop(own) if group[i] == own):
            j = s - 1
            while j >= 0 and group[j] >= own:
                j = previous[j]
            previous[s] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        # Those followed by more copies of this group's word come after those followed by fewer.
        by_times: dict[int, dict[int, list[int]]] = {}
        for j, k in times.items():
            by_times.setdefault(k, {}).setdefault(group[j], []).append(j)
        for k in sorted(by_times, reverse=True):
            for low, moved in by_times[k].items():
                high = end[low]
                fresh = high - len(moved) + 1
                if fresh == low:
                    continue
                for j in moved:
                    group[j] = fresh
                members[fresh] = moved
                end[fresh], end[low] = high, fresh - 1
                ending[high], ending[fresh - 1] = fresh, low
        last = own - 1
    out, free, placed = [0] * n, list(range(n)), bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return out[1:]


def _anchors(data: np.ndarray, size: int, gram: int, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, place, first and last string start of each anchor, and the hash of its stretch; ``cuts``: ends of rows."""
    hashes = tb.windows(data, gram)
    places = np.arange(len(hashes), dtype=np.uint64)
    low = (hashes & ~_MASK) | places
    width, want = 1, size - gram + 1
    while width * 2 <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if want > width:
        low = np.minimum(low[: -(want - width)], low[want - width :])
    starts = np.arange(len(low))
    row_end = cuts[np.searchsorted(cuts, starts, side="right")]
    good = starts + size <= row_end
    starts, anchor = starts[good], (low[good] & _MASK).astype(np.int64)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    fresh = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
    first, last, place = starts[fresh], starts[np.append(fresh[1:], len(starts)) - 1], anchor[fresh]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tb._VALUE[data] * tb._power(tb._BASE, len(data)), dtype=np.uint64)))
    stretch = (sums[last + size] - sums[first]) * tb._power(tb._INVERSE, len(data) + 1)[first]
    stretch = tb.mix(tb.mix(stretch) + ((last - first) * 128 + (place - first)).astype(np.uint64))
    return tb.mix(hashes[place]), place, first, last, stretch


def _pieces(bounds: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Rows from, to, bytes from, to: runs of rows, or overlapping parts of a long one."""
    for low, high in tb.chunks(bounds):
        a, b = int(bounds[low]), int(bounds[high])
        if b - a <= tb.PIECE:
            yield low, high, a, b
            continue
        for at in range(a, max(a + 1, b - size + 1), tb.PIECE):
            yield low, high, at, min(b, at + tb.PIECE + size - 1)


def _emit(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, stretch, doc, place); place packs the first start, the run of starts, and 16 bits of the text's hash."""
    for batch in batches:
        data, bounds = tb.raw(batch.column(2))
        sig = batch.column(1).to_numpy() & 0xFFFF
        for low, high, a, b in _pieces(bounds, size):
            own = bounds[low : high + 1]
            anchor, _, first, last, stretch = _anchors(data[a:b], size, gram, np.minimum(own[1:], b) - a)
            row = low + np.searchsorted(own, first + a, side="right") - 1
            place = (first + a - bounds[row]) << 24 | (last - first) << 16 | sig[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(stretch.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(place, pa.int64())],
                ["anchor", "stretch", "doc", "place"],
            )


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """From (doc, text, [(place, block)]) to rows with the stretch's bytes."""
    for batch in batches:
        data, bounds = tb.raw(batch.column(1))
        for r, (doc, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            body = data[bounds[r] : bounds[r + 1]].tobytes()
            rows = []
            for x in wanted:
                first = x["place"] >> 24
                rows.append({"block": x["block"], "doc": doc, "place": x["place"], "body": body[first : first + (x["place"] >> 16 & 0xFF) + size]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("block", pa.int64()), ("doc", batch.schema.field(0).type), ("place", pa.int64()), ("body", pa.binary())]))


def _digest(*parts: bytes) -> int:
    return int.from_bytes(blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _halves(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[pa.RecordBatch]:
    """From (doc, place, low, high, at, body) to the halves of each stretch, with ``key`` (hash of what its strings share) and ``name`` (of its bytes).

    The strings of a stretch start ``low`` to ``high`` bytes before their anchor, which is ``at`` bytes into the body (null: to
    be found). Those that start a to b bytes before it share the bytes from a before it to ``size`` - b after it.
    """
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            body, at, low, high = x["body"], x["at"], x["low"], x["high"]
            if at is None:
                at = int(np.argmin(tb.windows(np.frombuffer(body[:size], np.uint8), gram) & ~_MASK))
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                first, last = max(0, at - b), min(len(body) - size, at - a)
                if a > b or first > last:
                    continue
                own = body[first : last + size]
                place = ((x["place"] >> 24) + first) << 24 | (last - first) << 16 | x["place"] & 0xFFFF
                key = _digest(bytes((a, b)), body[at - a : at - b + size])
                rows.append({"key": key, "name": _digest(own), "doc": x["doc"], "place": place, "low": a, "high": b, "at": at - first, "body": own})
        kinds = [("low", pa.int32()), ("high", pa.int32()), ("at", pa.int32()), ("body", pa.binary())]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.int64()), ("name", pa.int64()), ("doc", batch.schema.field(0).type), ("place", pa.int64()), *kinds]))


def _repeated(bodies: list[bytes], size: int) -> list[tuple[int, int, bytes]]:
    """Parts (stretch, from, bytes) of the stretches whose strings' hashes occur twice in the block; only those can be equal."""
    joined = np.frombuffer(b"".join(bodies), np.uint8)
    hashes = tb.windows(joined, size)
    ends = np.cumsum([len(b) for b in bodies])
    row = np.searchsorted(ends, np.arange(len(hashes)), side="right")
    inside = np.arange(len(hashes)) + size <= ends[row]
    _, which, counts = np.unique(hashes[inside], return_inverse=True, return_counts=True)
    begin = ends - [len(b) for b in bodies]
    at = np.flatnonzero(inside)[counts[which] > 1]
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]]))))
    last = np.append(first[1:], len(at)) - 1
    return [(int(row[p]), int(p - begin[row[p]]), joined[p : q + size].tobytes()) for p, q in zip(at[first].tolist(), at[last].tolist(), strict=True)]


def _compare(table: pa.Table, size: int) -> pa.Table:
    """Equal strings of one block: runs of later ones as (doc, place, start, last)."""
    docs, places, bodies = (table.column(c).to_pylist() for c in ("doc", "place", "body"))
    found: list[tuple] = []
    # Parts that equal an earlier one go whole, as stretches do; each distinct part is sorted once.
    same: dict[bytes, list[tuple]] = {}
    for k, at, body in _repeated(bodies, size):
        same.setdefault(body, []).append(((docs[k] is not None, docs[k]), (places[k] >> 24) + at, k, at))
    parts = []
    for body, stand in same.items():
        stand.sort()
        for where in stand:
            if where[:2] == stand[0][:2]:
                parts.append((where[2], where[3], body))
            else:
                found.append((docs[where[2]], places[where[2]], where[1], where[1] + len(body) - size))
    text: list[int] = []
    owner: list[int] = []
    begin = []
    for k, (_, _, body) in enumerate(parts):
        begin.append(len(text))
        text += [c + 2 for c in body]
        text.append(1)
        owner += [k] * (len(body) + 1)
    joined = b"\0".join(x[2] for x in parts) + b"\0"
    later: dict[int, list[int]] = {}
    run: list[int] = []

    def close() -> None:
        if len(run) < 2:
            return
        stand = []
        for p in run:
            k, at, _ = parts[owner[p]]
            stand.append(((docs[k] is not None, docs[k]), (places[k] >> 24) + at + p - begin[owner[p]], k))
        stand.sort()
        least = stand[0][:2]
        for where in stand:
            if where[:2] != least:
                later.setdefault(where[2], []).append(where[1])

    before = b""
    for p in suffix_array(text) if text else ():
        if p - begin[owner[p]] + size > len(parts[owner[p]][2]):
            continue
        now = joined[p : p + size]
        if now != before:
            close()
            run, before = [], now
        run.append(p)
    close()
    for k, starts in later.items():
        starts.sort()
        low = high = starts[0]
        for start in [*starts[1:], None]:
            if start is not None and start <= high + 1:
                high = start
                continue
            found.append((docs[k], places[k], low, high))
            low = high = start
    columns = list(zip(*found, strict=True)) or [()] * 4
    kinds = (table.schema.field("doc").type, pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc", "place", "start", "last"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (..., text, [(from, to)]) to the counts and the bytes that stay."""
    for batch in batches:
        data, bounds = tb.raw(batch.column(batch.num_columns - 2))
        sizes, removed, runs, spans, kept = [], [], [], [], []
        for r, own in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            body = data[bounds[r] : bounds[r + 1]].tobytes()
            merged: list[list[int]] = []
            for a, b in sorted((x["a"], x["b"]) for x in own or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            parts, at = [], 0
            for a, b in merged:
                parts.append(body[at:a])
                at = b
            parts.append(body[at:])
            sizes.append(len(body))
            removed.append(sum(b - a for a, b in merged))
            runs.append(len(merged))
            spans.append([x for pair in merged for x in pair])
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-2], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
            schema=pa.schema([*list(batch.schema)[:-2], ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())]),
        )


def _refined(stretches: DataFrame, size: int, gram: int, block_stretches: int, kind: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stretches (doc, place, body) of anchors that have too many, halved until at most ``block_stretches`` kinds meet under a key:
    what is left to compare (block, doc, place, body), and what goes whole (doc, place, start, last).

    Of each level only halves that straddle an end of a shared passage go on, so rows grow with the stretches, not their strings.
    """
    schema = f"key long, name long, doc {kind}, place long, low int, high int, at int, body binary"
    blocks, whole = [], []
    left = stretches.select("doc", "place", F.lit(0).alias("low"), F.lit(size - gram).alias("high"), F.lit(None).cast("int").alias("at"), "body")
    while True:
        halves = stored(left.mapInArrow(partial(_halves, size=size, gram=gram), schema), "halves")
        at = F.struct("doc", F.expr("place >> 24").alias("start"))
        firsts = halves.groupBy("key", "name").agg(F.min(at).alias("first"))
        kinds = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        known = halves.join(firsts, ["key", "name"])
        whole.append(known.where(~at.eqNullSafe(F.col("first"))).selectExpr("doc", "place", "place >> 24 as start", "(place >> 24) + ((place >> 16) & 255) as last"))
        kept = stored(known.where(at.eqNullSafe(F.col("first"))).join(kinds, "key").select(*halves.columns, "k"), "kept")
        many = (F.col("k") > block_stretches) & (F.col("low") < F.col("high"))
        blocks.append(kept.where(~many).select(F.col("key").alias("block"), "doc", "place", "body"))
        left = kept.where(many).select("doc", "place", "low", "high", "at", "body")
        if left.isEmpty():
            return blocks, whole


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100, gram: int = 20, block_stretches: int = 512,
) -> DataFrame:
    """``docs`` (all columns) with ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (from, to, ...) and ``kept`` (bytes); such columns are replaced."""
    if not gram < size <= 228:
        raise ValueError("size must be over gram and at most 228")
    ship(docs.sparkSession)
    names = ("n_bytes", "n_removed", "n_spans", "spans", "kept")
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    marked = rest.withColumns({"__doc": F.col(f"`{id_col}`"), "__text": F.col(f"`{text_col}`").cast("string")}).withColumn("__sig", F.coalesce(F.xxhash64("__text"), F.lit(0)))
    kind = docs.schema[id_col].dataType.simpleString()
    places = marked.select("__doc", "__sig", "__text").mapInArrow(partial(_emit, size=size, gram=gram), f"anchor long, stretch long, doc {kind}, place long")
    often = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    shared = stored(places.join(often, "anchor", "left_semi"), "anchors")

    at = F.struct("doc", "place")
    firsts = shared.groupBy("anchor", "stretch").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    again = shared.join(firsts.where("n > 1").select("anchor", "stretch", "first"), ["anchor", "stretch"]).where(~at.eqNullSafe(F.col("first")))
    spans = again.select("doc", F.expr("place & 65535").alias("sig"), F.expr("place >> 24").alias("a"), F.expr(f"(place >> 24) + ((place >> 16) & 255) + {size}").alias("b"))

    many = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    total = cut_lineage(firsts.join(many, "anchor").select("first.doc", "first.place", (F.col("k") > block_stretches).alias("hot"), F.xxhash64("anchor").alias("block")))
    match = F.col("__doc").eqNullSafe(F.col("doc")) & ((F.col("__sig").bitwiseAND(0xFFFF)) == F.col("sig"))
    texts = marked.select("__doc", "__sig", "__text")

    def bodies(stretches: DataFrame) -> DataFrame:
        wanted = stretches.groupBy("doc", F.expr("place & 65535").alias("sig")).agg(F.collect_list(F.struct("place", "block")).alias("wanted"))
        wanted = small_side(stored(wanted, "wanted"))
        cut = texts.join(wanted, match).select("__doc", "__text", "wanted")
        return cut.mapInArrow(partial(_cut, size=size), f"block long, doc {kind}, place long, body binary")

    hot, cool = total.where("hot"), total.where("not hot")
    blocks, whole, n_blocks = [bodies(cool)], [], cool.count()
    if not hot.isEmpty():
        refined, whole = _refined(bodies(hot).drop("block"), size, gram, block_stretches, kind)
        blocks += refined
        n_blocks += sum(x.count() for x in refined)
    # Blocks of few stretches are put together, so that one call sorts some ten thousand bytes.
    shares = max(1, n_blocks // 256)
    blocks = reduce(DataFrame.union, blocks).withColumn("block", F.pmod("block", F.lit(shares)))

    def compare(block: pa.Table) -> pa.Table:
        return _compare(block, size)

    judged = stored(blocks.groupBy("block").applyInArrow(compare, f"doc {kind}, place long, start long, last long"), "strings")
    gone = reduce(DataFrame.union, whole, judged)
    spans = spans.union(gone.select("doc", F.expr("place & 65535").alias("sig"), F.col("start").alias("a"), (F.col("last") + size).alias("b")))

    by_doc = spans.groupBy("doc", "sig").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = marked.join(by_doc, match, "left").select(*[F.col(f"`{c}`") for c in rest.columns], F.coalesce("__text", F.lit("")).alias("__text"), by_doc["spans"].alias("__spans"))
    fields = rest.schema.fields + [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType()),
    ]
    return joined.mapInArrow(_remove, T.StructType(fields))
