"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts cover every labelled training document, whole: tasks count into one array per language and send sparse sums, which
Spark adds up. The table of log-probabilities (languages x buckets) is bounded by ``buckets`` and ``max_languages`` and is
broadcast; batches are scored with one gather per language and a segmented sum.

Defined results: null or letterless text -> ``und`` with score 0; no training rows -> ``und``; equal scores -> the
smallest language name; rows without a language never train. The score is the posterior of the chosen language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ship import ship

#: Characters handled at once.
_CHUNK = 1 << 17
_FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Rows and their code points, each row between blanks and closed by a 0; long rows come in overlapping pieces."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        text = f" {text.lower()} ".replace("\0", " ")
        for at in range(0, max(1, len(text) - 2), _CHUNK):
            part = text[at : at + _CHUNK + 2]
            rows.append(row)
            parts.append(part)
            size += len(part) + 1
            if size >= _CHUNK:
                yield rows, np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le", "replace"), np.uint32)
                rows, parts, size = [], [], 0
    if rows:
        yield rows, np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le", "replace"), np.uint32)


def _features(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the bigram and trigram at each place; ``buckets`` where a text ends within it."""
    after = np.concatenate((codes[1:], np.zeros(2, np.uint32)))
    two = codes * _FACTORS[0] ^ after[:-1] * _FACTORS[1]
    three = two * np.uint32(5) ^ after[1:] * _FACTORS[2]
    shift = np.uint32(32 - buckets.bit_length() + 1)
    found = []
    for value, gone in ((two, (codes == 0) | (after[:-1] == 0)), (three, (codes == 0) | (after[:-1] == 0) | (after[1:] == 0))):
        value = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append(np.where(gone, buckets, value >> shift))
    return np.stack(found)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 15, max_languages: int = 1000) -> dict:
    """Fit on all rows with a language. More than ``max_languages`` names raise, because the table is broadcast."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(names)):
                own = [t or "" for t, x in zip(texts, names, strict=True) if x == name]
                total = totals.setdefault(name, np.zeros(buckets + 1, np.int64))
                n_docs[name] = n_docs.get(name, 0) + len(own)
                for _, codes in _pieces(own):
                    total += np.bincount(_features(codes, buckets).ravel(), minlength=buckets + 1)
        for name, total in totals.items():
            at = np.flatnonzero(total[:buckets])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(total[at], n_docs[name]))],
                ["lang", "bucket", "n"],
            )

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One row per language: its buckets, at most `buckets` of them.
    table = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).orderBy("lang").limit(max_languages + 1).toArrow()
    if table.num_rows > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    names = table.column("lang").to_pylist()
    counts = np.zeros((len(names), buckets + 1))
    for k, cells in enumerate(table.column("cells").to_pylist()):
        for cell in cells:
            counts[k, cell["bucket"]] = cell["n"]
    prior = counts[:, buckets].copy() if names else np.zeros(0)  # index -1 held the document counts
    counts[:, buckets] = 0
    if not names:
        return {"names": [], "prior": prior, "weights": counts, "buckets": buckets}
    smooth = 0.5
    weights = np.log((counts + smooth) / (counts[:, :buckets].sum(1, keepdims=True) + smooth * buckets))
    weights[:, buckets] = 0
    return {"names": names, "prior": np.log(prior / prior.sum()), "weights": weights, "buckets": buckets}


def predict(docs: DataFrame, model: dict, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with a language and its posterior; columns of these names are replaced."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang string, score double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, prior, weights, buckets = (shared.value[k] for k in ("names", "prior", "weights", "buckets"))
        for texts in batches:
            if not names:
                yield pd.DataFrame({"lang": ["und"] * len(texts), "score": np.zeros(len(texts))})
                continue
            total = np.tile(prior, (len(texts), 1))
            for rows, codes in _pieces([t or "" for t in texts]):
                features = _features(codes, buckets)
                starts = np.concatenate(([0], np.flatnonzero(codes == 0)[:-1] + 1))
                for k in range(len(names)):
                    w = weights[k]
                    np.add.at(total[:, k], rows, np.add.reduceat(w[features[0]] + w[features[1]], starts))
            best = total.argmax(1)
            part = np.exp(total - total.max(1, keepdims=True))
            yield pd.DataFrame({"lang": np.array(names, object)[best], "score": 1.0 / part.sum(1)})

    text = F.col(text_col).cast("string")
    letters: Column = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    spare = "__language_id"
    kept = [c for c in docs.columns if c.lower() not in (pred_col.lower(), score_col.lower())]
    out = docs.withColumn(spare, score(F.when(letters, text).otherwise("")))
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        F.when(letters, F.col(f"{spare}.lang")).otherwise("und").alias(pred_col),
        F.when(letters, F.col(f"{spare}.score")).otherwise(0.0).alias(score_col),
    )
