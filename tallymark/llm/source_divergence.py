"""How far the term frequencies of sources lie apart, language by language.

The terms kept of a language (those in enough of its documents) are sorted in byte order and dealt by ranges; each range is built
into a minimal acyclic transducer whose outputs, plus the range's start, are the terms' lexicographic ordinals. Texts are streamed
through the transducers, and from then on counts, comparisons and ties use ordinals only; terms come back in the last join.

Defined results: null texts, languages and sources are empty strings; rows that repeat an id are documents of their own; a group
without terms has count 0 for each kept term; a language without kept terms has pairs of value 0 and no terms. Empty tables give no
rows. Only the named columns are read. Arithmetic is in whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .ranks import range_parts
from .ship import ship
from .staging import small_side, stored
from .term_transducer import Transducer

#: Letters a-z (after lowering A-Z) and everything beyond ASCII.
TERM_BYTES = tb.byte_class((0x61, 0x7A), (0x80, 0xFF))
_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: A long text is cut at the first byte outside terms after this many.
_PIECE = 1 << 20
#: Entries, and bytes of text behind them, that a task holds before it hands them on.
_HELD, _HELD_BYTES = 200_000, 128 << 20
#: Cells (sources x terms) of a block that one task compares.
_CELLS = 500_000


def _pieces(text: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(text):
        stop = start + _PIECE
        while stop < len(text) and TERM_BYTES[text[stop]]:
            stop += 1
        yield text[start:stop]
        start = stop


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, term, documents), summed up inside the task as far as ``_HELD`` allows."""
    held: dict[str, Counter] = {}
    size = volume = 0

    def out():
        names = [lang for lang, c in held.items() for _ in c]
        terms = pa.array([t for c in held.values() for t in c], pa.large_binary()).cast(pa.large_string())
        counts = [n for c in held.values() for n in c.values()]
        for low in range(0, len(names), 50_000):
            part = slice(low, low + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(names[part], pa.string()), terms[part].cast(pa.string()), pa.array(counts[part], pa.int64())], ["lang", "term", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            found: set[bytes] = set()
            for piece in _pieces(text.as_py().lower()):
                found.update(_TERM.findall(piece))
            own = held.setdefault(lang, Counter())
            size -= len(own)
            own.update(found)
            size += len(own)
            volume += len(text.as_py())
            if size > _HELD or volume > _HELD_BYTES:
                yield from out()
                held, size, volume = {}, 0, 0
    yield from out()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (lang, term, __part) -> one packed transducer per language of the range."""
    def rows():
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True)

    def packed(lang, part, terms):
        made = Transducer.build(terms)
        data = made.pack()
        return pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), pa.array([part], pa.int32()), pa.array([made.words], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())],
            ["lang", "part", "terms", "bytes", "packed"],
        )

    now, terms = None, []
    for lang, term, part in rows():
        if (lang, part) != now and now is not None:
            yield packed(*now, terms)
            terms = []
        now = (lang, part)
        terms.append(term)
    if now is not None:
        yield packed(*now, terms)


def _word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each term in lowered bytes whose rows start at ``bounds``."""
    inside = TERM_BYTES[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begin[inner] |= inside[inner]
    stop[inner - 1] |= inside[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def _recount(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, ordinal, n) by streaming the texts through the transducers."""
    machines: dict[str, list] = {}
    for lang, start, data in shared.value:
        machines.setdefault(lang, []).append((start, Transducer.unpack(data)))
    groups: dict[tuple[str, str], int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        group, ordinal, n = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.lexsort((ordinal, group))
        group, ordinal, n = group[order], ordinal[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (ordinal[1:] != ordinal[:-1]))))
        return group[first], ordinal[first], np.add.reduceat(n, first)

    def out():
        if held and sum(len(h[0]) for h in held):
            group, ordinal, n = merged()
            names = list(groups)
            for low in range(0, len(group), 50_000):
                part = slice(low, low + 50_000)
                lang, source = ([names[g][k] for g in group[part].tolist()] for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(ordinal[part], pa.int64()), pa.array(n[part], pa.int64())],
                    ["lang", "source", "ordinal", "n"],
                )

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        data, bounds = tb.raw(batch.column(2))
        data = tb.LOWER[data]
        starts, ends, row = _word_bounds(data, bounds)
        own = np.array([groups.setdefault(pair, len(groups)) for pair in zip(langs, sources, strict=True)], np.int64)
        for lang in set(langs) & set(machines):
            here = np.array([x == lang for x in langs], bool)[row]
            at, stop, group = starts[here], ends[here], own[row[here]]
            for start, machine in machines[lang]:
                place = machine.places(data, at, stop)
                hit = place >= 0
                code, n = np.unique(group[hit] * machine.words + place[hit], return_counts=True)
                held.append((code // machine.words, code % machine.words + start, n))
                size += len(code)
        if size > _HELD:
            held = [merged()]
            size = len(held[0][0])
            if size > _HELD // 2:
                yield from out()
                held, size, groups = [], 0, {}
    yield from out()


def _distances(key, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums of absolute differences of all pairs of a language's sources over one block of terms."""
    groups = groups.sort_values("source")
    names, width = groups["source"].to_numpy(), int(groups["width"].iloc[0])
    table = np.repeat(groups["zero"].to_numpy(np.int64)[:, None], width, axis=1)
    if width and len(cells):
        row = pd.Index(names).get_indexer(cells["source"])
        table[row, cells["column"].to_numpy(np.int64)] = cells["p"].to_numpy(np.int64)
    a, b = np.triu_indices(len(names), 1)
    sums = [np.abs(table[k + 1 :] - table[k]).sum(axis=1) for k in range(len(names) - 1)]
    value = np.concatenate(sums) if sums else np.zeros(0, np.int64)
    return pd.DataFrame({"lang": key[0], "a": names[a], "b": names[b], "value": value})


class Divergence:
    """Vocabulary, counts and comparisons of one corpus; every step is a stored table."""

    def __init__(
        self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
        min_docs: int = 30, smoothing: int = 5, scale: int = 10**9, part_terms: int = 250_000, pack_bytes: int = 64 << 20,
    ):
        spark = docs.sparkSession
        ship(spark)
        self.smoothing, self.scale = smoothing, scale
        clean = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
        rows = docs.select(clean(lang_col, "lang"), clean(source_col, "source"), clean(text_col, "text"))

        found = rows.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long")
        kept = stored(found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term"), "kept-terms")
        dealt = range_parts(kept, [F.col("lang"), F.col("term")], "term-ranges", part_terms)
        # Each stored range goes to one task again, in order.
        ordered = dealt.repartition(F.col("__part")).sortWithinPartitions("__part", "lang", "term")
        machines = stored(ordered.mapInArrow(_build, "lang string, part int, terms long, bytes long, packed binary"), "transducers")
        before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = machines.select("lang", "part", "terms", "bytes", F.coalesce(F.sum("terms").over(before), F.lit(0)).alias("start"))
        inside = F.row_number().over(Window.partitionBy("__part", "lang").orderBy("term")) - 1
        self.terms = dealt.withColumn("__at", inside).join(starts.withColumnRenamed("part", "__part"), ["lang", "__part"])
        self.terms = self.terms.select("lang", "term", (F.col("start") + F.col("__at")).alias("ordinal"))

        # One row per range of some 250 000 terms reaches the driver; transducers are sent in packs of bounded size.
        packs: list[list] = [[]]
        size = 0
        for r in starts.orderBy("lang", "part").collect():
            if size and size + r["bytes"] > pack_bytes:
                packs.append([])
                size = 0
            packs[-1].append((r["lang"], r["part"], r["start"]))
            size += r["bytes"]
        counts = []
        for pack in packs:
            chosen = {(lang, part): start for lang, part, start in pack}
            keys = spark.createDataFrame([(lang, part) for lang, part, _ in pack], "lang string, part int")
            data = [(r["lang"], chosen[r["lang"], r["part"]], bytes(r["packed"])) for r in machines.join(F.broadcast(keys), ["lang", "part"]).collect()]
            shared = spark.sparkContext.broadcast(data)
            part = rows.mapInArrow(partial(_recount, shared=shared), "lang string, source string, ordinal long, n long")
            counts.append(stored(part.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "counts"))
            shared.destroy()
        self.counts = reduce(DataFrame.union, counts)

        sizes = machines.groupBy("lang").agg(F.sum("terms").alias("v"))
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(small_side(sizes), "lang", "left")
        self.groups = stored(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "groups")

    def _share(self, count: Column | str, total: str, v: str) -> Column:
        text = f"{count} + {self.smoothing}"
        return F.expr(f"1 + CAST((CAST({text} AS DECIMAL(20,0)) * CAST({self.scale} AS DECIMAL(18,0))) div (CAST({total} AS DECIMAL(20,0)) + {self.smoothing} * CAST({v} AS DECIMAL(19,0))) AS BIGINT)")

    def cells(self) -> DataFrame:
        """``lang, source, ordinal, n, p``: scaled, smoothed shares of the terms that occur in a group."""
        return self.counts.join(small_side(self.groups), ["lang", "source"]).withColumn("p", self._share("n", "total", "v"))

    def pairs(self) -> DataFrame:
        """``lang, source, item, value, rank``: the distance of each source to each other source of its language."""
        width = F.greatest(F.lit(1), F.least(F.lit(4096), F.floor(F.lit(_CELLS) / F.col("sources")))).cast("long")
        langs = self.groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("v").alias("v")).select("lang", "v", width.alias("block_width"))
        langs = small_side(stored(langs, "languages"))
        blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("greatest(v - 1, 0) div block_width")))
        zero = F.when(F.col("v") > 0, self._share("0", "total", "v")).otherwise(F.lit(0).cast("long"))
        side = self.groups.withColumn("zero", zero).drop("v").join(langs, "lang").withColumn("block", blocks)
        side = side.select("lang", "block", "source", "zero", F.least(F.col("block_width"), F.col("v") - F.col("block") * F.col("block_width")).alias("width"))
        cells = self.cells().select("lang", "source", "ordinal", "p").join(langs, "lang")
        cells = cells.select("lang", F.expr("ordinal div block_width").alias("block"), "source", F.pmod("ordinal", "block_width").alias("column"), "p")
        sums = cells.groupBy("lang", "block").cogroup(side.groupBy("lang", "block")).applyInPandas(_distances, "lang string, a string, b string, value long")
        sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
        both = both.union(sums.select("lang", F.col("b"), F.col("a"), "value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return both.withColumn("rank", F.row_number().over(order))

    def terms_above(self, top: int = 50) -> DataFrame:
        """``lang, source, item, value, rank``: the terms a group uses more than its language, the ``top`` furthest; ties by ordinal."""
        of_lang = Window.partitionBy("lang", "ordinal")
        totals = self.groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
        cells = self.cells().withColumn("lang_n", F.sum("n").over(of_lang)).join(small_side(stored(totals, "language-totals")), "lang")
        above = cells.withColumn("value", F.col("p") - self._share("lang_n", "lang_total", "v")).where("value > 0")
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
        best = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return best.join(self.terms, ["lang", "ordinal"]).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def audit(docs: DataFrame, top: int = 50, **how) -> DataFrame:
    """``lang, source, part ('pair' or 'term'), item, value, rank``."""
    found = Divergence(docs, **how)
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(found.pairs(), "pair").union(shape(found.terms_above(top), "term"))
