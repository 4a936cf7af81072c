"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item window is a run of ``window`` words (a shorter item is one window). Its short shingles are ordered by rarity over
all documents; containment needs every shingle, so the rarest alone is the necessary prefix token. Documents look it up,
the window's place must fit between the document's first and last word (positional and length bounds), and the whole
window is compared word by word. Items come in blocks of at most ``block_windows`` distinct windows, each broadcast as one
bounded table; more items mean more passes over the documents, and no shuffle of texts at any size.

Defined results: null or wordless texts have no words and no hits; wordless items have no window; an item that is listed
twice counts once; a null item_id counts as the string 'null'. Document columns named as a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .ship import ship

#: Bits of the first, inexact lookup.
_BITS = 20


def _word_list(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    low = tb.LOWER[data]
    return b" ".join(low[s:e].tobytes() for s, e in zip(starts, ends, strict=True))


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found = batch.column(0).to_pylist(), []
        data, bounds = tb.raw(batch.column(1))
        starts, ends, _, first = tb.words(data, bounds, tb.ALNUM_WORDS)
        for row, item in enumerate(ids):
            n = first[row + 1] - first[row]
            for at in range(first[row], first[row + 1] - min(n, window) + 1) if n else ():
                stop = at + min(n, window)
                found.append({"item": item, "words": _word_list(data, starts[at:stop], ends[at:stop])})
                if len(found) >= 20_000:
                    yield pa.RecordBatch.from_pylist(found, pa.schema([("item", pa.string()), ("words", pa.binary())]))
                    found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, pa.schema([("item", pa.string()), ("words", pa.binary())]))


class _Lookup:
    """Sorted hashes with a bit table in front."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``x`` that hold a known hash, and which."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(x >> np.uint64(64 - _BITS)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.hashes, x[at]), len(self.hashes) - 1)
        same = self.hashes[which] == x[at]
        return at[same], which[same]


def _row_of(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, at, side="right") - 1


def _count(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    tables = {q: _Lookup(h) for q, h in shared.value.items()}
    sums = {q: np.zeros(len(t.hashes), np.int64) for q, t in tables.items()}
    for batch in batches:
        data, bounds = tb.raw(batch.column(0))
        for low, high in tb.chunks(bounds):
            own = bounds[low : high + 1]
            _, _, hashes, _ = tb.words(data[own[0] : own[-1]], own - own[0], tb.ALNUM_WORDS)
            for q, table in tables.items():
                _, which = table.find(tb.shingles(hashes, q))
                sums[q] += np.bincount(which, minlength=len(sums[q]))
    for q, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q, np.int32)), pa.array(at), pa.array(n[at])], ["q", "which", "n"])


def _match(batches: Iterator[pa.RecordBatch], shared, last: bool) -> Iterator[pa.RecordBatch]:
    """Adds this block's hits to the columns ``hit_spans`` (word from, word to, ...) and ``items``."""
    tables, windows, sizes, owners = (shared.value[k] for k in ("tables", "windows", "sizes", "owners"))
    lookups = {q: _Lookup(t["hashes"]) for q, t in tables.items()}
    for batch in batches:
        text, spans, items = batch.columns[-3:]
        data, bounds = tb.raw(text)
        n_words, n_hit, new_spans, new_items = [], [], [], []
        for low, high in tb.chunks(bounds):
            own = bounds[low : high + 1]
            part = data[own[0] : own[-1]]
            starts, ends, hashes, first = tb.words(part, own - own[0], tb.ALNUM_WORDS)
            found: dict[int, tuple[list, set]] = {}
            for q, t in tables.items():
                at, which = lookups[q].find(tb.shingles(hashes, q))
                for k in range(t["most"]):
                    entry = t["begin"][which] + k
                    here = entry < t["begin"][which + 1]
                    entry = entry[here]
                    begin = at[here] - t["offset"][entry]
                    window = t["window"][entry]
                    row = _row_of(first, at[here])
                    fits = (begin >= first[row]) & (begin + sizes[window] <= first[row + 1])
                    for b, w, r in zip(begin[fits].tolist(), window[fits].tolist(), row[fits].tolist(), strict=True):
                        stop = b + int(sizes[w])
                        if _word_list(part, starts[b:stop], ends[b:stop]) == windows[w]:
                            hits = found.setdefault(r, ([], set()))
                            hits[0].append((b - int(first[r]), stop - int(first[r])))
                            hits[1].update(owners[w])
            for r in range(high - low):
                pairs, names = found.get(r, ((), ()))
                old = spans[low + r].as_py() or []
                merged: list[list[int]] = []
                for a, b in sorted([*pairs, *zip(old[::2], old[1::2], strict=True)]):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                new_spans.append([x for pair in merged for x in pair])
                new_items.append(sorted({*(items[low + r].as_py() or []), *names}))
                n_words.append(int(first[r + 1] - first[r]))
                n_hit.append(sum(b - a for a, b in merged))
        out = [*batch.columns[:-2], pa.array(new_spans, pa.list_(pa.int64())), pa.array(new_items, pa.list_(pa.string()))]
        schema = pa.schema([*list(batch.schema)[:-2], ("hit_spans", out[-2].type), ("items", out[-1].type)])
        if last:
            out = [*out[:-3], *out[-2:], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())]
            schema = pa.schema([*list(schema)[:-3], *list(schema)[-2:], ("n_words", pa.int64()), ("n_hit", pa.int64())])
        yield pa.RecordBatch.from_arrays(out, schema=schema)


def _tables(windows: list[bytes], sizes: np.ndarray, shingle: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By shingle length: the shingles' hashes, windows and offsets."""
    found: dict[int, list] = {}
    for w, text in enumerate(windows):
        data = np.frombuffer(text, np.uint8)
        _, _, hashes, _ = tb.words(data, np.array([0, len(data)]), tb.ALNUM_WORDS)
        q = int(min(shingle, sizes[w]))
        found.setdefault(q, []).append((tb.shingles(hashes, q), w))
    return {
        q: (np.concatenate([h for h, _ in x]), np.concatenate([np.full(len(h), w) for h, w in x]), np.concatenate([np.arange(len(h)) for h, _ in x]))
        for q, x in found.items()
    }


def find_contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = 10, shingle: int = 4, block_windows: int = 200_000,
) -> DataFrame:
    """``docs`` (all columns) with ``hit_spans`` (word from, word to, ... from 0, merged), ``items`` (sorted), ``n_words``, ``n_hit``."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    names = ("hit_spans", "items", "n_words", "n_hit")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    text = F.col(f"`{text_col}`").cast("string")
    listed = items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")), F.col(f"`{item_text}`").cast("string"))
    pairs = listed.mapInArrow(partial(_item_windows, window=window), "item string, words binary").distinct()
    n_blocks = max(1, -(-pairs.select("words").distinct().count() // block_windows))
    state = kept.withColumns({"__text": text, "__spans": F.lit(None).cast("array<long>"), "__items": F.lit(None).cast("array<string>")})
    for block in range(n_blocks):
        # At most about block_windows windows, each a few words long.
        rows = pairs.where(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == block).orderBy("words", "item").collect()
        owners: dict[bytes, list[str]] = {}
        for r in rows:
            owners.setdefault(bytes(r["words"]), []).append(r["item"])
        windows = list(owners)
        sizes = np.array([w.count(b" ") + 1 for w in windows], np.int64)
        tables = _tables(windows, sizes, shingle)
        known = {q: np.unique(h) for q, (h, _, _) in tables.items()}
        counts = {q: np.zeros(len(h), np.int64) for q, h in known.items()}
        if windows:
            shared = spark.sparkContext.broadcast(known)
            for r in docs.select(text).mapInArrow(partial(_count, shared=shared), "q int, which long, n long").groupBy("q", "which").agg(F.sum("n").alias("n")).collect():
                counts[r["q"]][r["which"]] = r["n"]
        index = {}
        for q, (hashes, owner, offset) in tables.items():
            place = np.searchsorted(known[q], hashes)
            order = np.lexsort((offset, known[q][place], counts[q][place], owner))
            chosen = order[np.concatenate(([True], owner[order][1:] != owner[order][:-1]))]  # each window's rarest shingle
            chosen = chosen[np.argsort(hashes[chosen], kind="stable")]
            tokens, begin = np.unique(hashes[chosen], return_index=True)
            begin = np.append(begin, len(chosen))
            index[q] = {"hashes": tokens, "begin": begin, "window": owner[chosen], "offset": offset[chosen], "most": int(np.diff(begin).max(initial=0))}
        shared = spark.sparkContext.broadcast({"tables": index, "windows": windows, "sizes": sizes, "owners": list(owners.values())})
        last = block == n_blocks - 1
        fields = kept.schema.fields + ([] if last else [T.StructField("__text", T.StringType())])
        fields += [T.StructField("hit_spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
        fields += [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType())] if last else []
        state = state.mapInArrow(partial(_match, shared=shared, last=last), T.StructType(fields))
    return state
