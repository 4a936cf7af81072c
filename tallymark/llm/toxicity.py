"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give document scores and offsets.

Fitting uses a bounded sample: of each label the ``max_docs`` documents with the least hash of their id. Labels are given for
documents; token labels follow from them: features (a word, or a word's first 4 to 6 characters) that are much more frequent
in toxic documents are evidence, and a token of a toxic document that holds evidence is labelled toxic, every other one is
not. The field has one weight per kept feature, a bias and transitions, and is fitted on ``max_windows`` stretches of tokens by
forward-backward gradients. Features in fewer than 5 documents of the sample, and those beyond the ``max_features`` that
separate the labels best, have no weight. A logistic curve over (largest marginal, expected number of toxic tokens, length) turns
marginals into a document's probability, weighted back to the labels' real frequencies.

Scoring covers every token of every text: forward and backward recursions on the ratio of the two states.

Defined results: null and empty texts score as texts without a toxic token; without toxic or without other labels all
scores are 0; of a document's several labels the largest counts; null labels are ignored, and so are labels of a null id. Words are
compared in lower case; offsets of spans count characters of the text as it stands.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import ship

_WORD = re.compile(r"\w+")
_PREFIXES = (4, 5, 6)
_SPAN = 40
_CACHE = 1 << 18


def features(word: str) -> list[str]:
    return ["=" + word, *(f"{k}{word[:k]}" for k in _PREFIXES if len(word) >= k)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by label."""
    for batch in batches:
        found: Counter = Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.update({(f, label) for w in set(_WORD.findall((text or "").lower())) for f in features(w)})
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())], ["feature", "label", "n"])


def _windows(batches: Iterator[pa.RecordBatch], index: dict[str, int], evidence: set[int]) -> Iterator[pa.RecordBatch]:
    """Stretches of ``_SPAN`` tokens: up to four feature numbers and a label for each; 0 is no feature, label -1 no token."""
    for batch in batches:
        rows, labels, keys, places = [], [], [], []
        for text, label, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tokens = _WORD.findall((text or "").lower())
            known = [[index[f] for f in features(w) if f in index] for w in tokens]
            marks = [int(label == 1 and any(k in evidence for k in own)) for own in known]
            for at in range(0, len(tokens), _SPAN):
                part, mark = known[at : at + _SPAN], marks[at : at + _SPAN]
                if label == 1 and not any(mark):  # not told what is toxic here
                    continue
                grid = np.zeros((_SPAN, 4), np.int32)
                for k, own in enumerate(part):
                    grid[k, : len(own)] = own
                rows.append(grid.tobytes())
                labels.append(np.array(mark + [-1] * (_SPAN - len(mark)), np.int8).tobytes())
                keys.append(doc)
                places.append(at)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int64()), pa.array(rows, pa.binary()), pa.array(labels, pa.binary())], ["doc", "at", "grid", "labels"])


def _fit_field(grids: np.ndarray, labels: np.ndarray, n_features: int, rounds: int = 80, rate: float = 0.15, decay: float = 1e-4) -> dict:
    """Weights of state 1 over state 0, and transitions, by gradient steps on the mean log-likelihood."""
    theta = {"w": np.zeros(n_features + 1), "b": np.array(-3.0), "t": np.zeros((2, 2))}
    mean = {k: np.zeros_like(v) for k, v in theta.items()}
    square = {k: np.zeros_like(v) for k, v in theta.items()}
    here = labels >= 0
    n, span = labels.shape
    gold = np.where(here, labels, 0)
    for step in range(1, rounds + 1):
        emit = theta["w"][grids].sum(2) + theta["b"]
        emit[~here] = -30.0
        t = np.exp(theta["t"])
        scale = np.exp(emit)
        forward = np.zeros((n, span, 2))
        backward = np.ones((n, span, 2))
        now = np.stack([np.ones(n), scale[:, 0]], 1)
        forward[:, 0] = now / now.sum(1, keepdims=True)
        for k in range(1, span):
            now = forward[:, k - 1] @ t
            now[:, 1] *= scale[:, k]
            forward[:, k] = now / now.sum(1, keepdims=True)
        for k in range(span - 2, -1, -1):
            ahead = backward[:, k + 1].copy()
            ahead[:, 1] *= scale[:, k + 1]
            now = ahead @ t.T
            backward[:, k] = now / now.sum(1, keepdims=True)
        post = forward * backward
        post /= post.sum(2, keepdims=True)
        error = np.where(here, gold - post[:, :, 1], 0.0)
        pair = forward[:, :-1, :, None] * t[None, None] * backward[:, 1:, None, :]
        pair[..., 1] *= scale[:, 1:, None]
        pair /= pair.sum((2, 3), keepdims=True)
        both = here[:, :-1] & here[:, 1:]
        seen = np.zeros((2, 2))
        for a in range(2):
            for b in range(2):
                seen[a, b] = ((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum()
        grad = {
            "w": np.bincount(grids.reshape(-1), np.repeat(error.reshape(-1), grids.shape[2]), n_features + 1) / n - decay * theta["w"],
            "b": np.array(error.sum() / n), "t": (seen - (pair * both[:, :, None, None]).sum((0, 1))) / n - decay * theta["t"],
        }
        grad["w"][0] = 0
        for k in theta:
            mean[k] = 0.9 * mean[k] + 0.1 * grad[k]
            square[k] = 0.99 * square[k] + 0.01 * grad[k] ** 2
            theta[k] = theta[k] + rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return {"w": theta["w"], "b": float(theta["b"]), "t": theta["t"]}


class Tagger:
    """Marginals of a fitted field over the tokens of a text."""

    def __init__(self, model: dict):
        self.weights, self.bias = model["weights"], model["field"]["b"]
        self.t = np.exp(model["field"]["t"]).tolist()
        self.cache: dict[str, float] = {}

    def odds(self, word: str) -> float:
        if (known := self.cache.get(word)) is None:
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            total = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
            known = self.cache[word] = float(np.exp(min(30.0, max(-30.0, total))))
        return known

    def marginals(self, tokens: list[str]) -> list[float]:
        (t00, t01), (t10, t11) = self.t
        odds = list(map(self.odds, tokens))
        ahead, r = [], None
        for e in odds:
            r = e if r is None else e * (t01 + r * t11) / (t00 + r * t10)
            ahead.append(r)
        out, s = [0.0] * len(odds), 1.0
        for k in range(len(odds) - 1, -1, -1):
            x = ahead[k] * s
            out[k] = x / (1.0 + x)
            z = odds[k] * s
            s = (t10 + t11 * z) / (t00 + t01 * z)
        return out

    def summary(self, text: str | None) -> tuple[list[float], list[int]]:
        """Largest marginal as log-odds, log of the expected count, log of the length; offsets (from, to, ...) of toxic spans."""
        low = text.lower() if text else ""
        p = self.marginals(_WORD.findall(low))
        if not p:
            return [-10.0, 0.0, 0.0], []
        top = min(1 - 1e-6, max(max(p), 1e-6))
        spans: list[int] = []
        if top >= 0.5:
            # A character may have more than one in lower case: offsets go back to where it stands.
            back = range(len(text)) if len(low) == len(text) else [k for k, c in enumerate(text) for _ in c.lower()]
            near = False
            for m, x in zip(_WORD.finditer(low), p, strict=True):
                if x >= 0.5:
                    end = back[m.end() - 1] + 1
                    if near:
                        spans[-1] = end
                    else:
                        spans += [back[m.start()], end]
                near = x >= 0.5
        return [float(np.log(top / (1 - top))), float(np.log1p(sum(x for x in p if x >= 0.05))), float(np.log1p(len(p)))], spans


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Weighted logistic regression by Newton steps with a little ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        beta = beta + np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 1e-2 * beta)
    return beta.tolist()


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_docs: int = 8000, max_features: int = 4000, max_windows: int = 12000,
) -> dict | None:
    """Fit on at most ``max_docs`` documents of each label; None if one label is missing. Everything sent to the driver is bounded by the parameters."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    told = labels.where(f"`{id_col}` is not null and `{label_col}` in (0, 1)").groupBy(F.col(f"`{id_col}`").alias("doc")).agg(F.max(label_col).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return None
    chosen = [told.where(F.col("label") == k).orderBy(F.xxhash64("doc"), "doc").limit(max_docs) for k in (0, 1)]
    chosen = spark.createDataFrame(chosen[0].union(chosen[1]).toArrow())  # at most 2 * max_docs pairs of numbers
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc").select("text", "label", "doc")
    counts = sample.select("text", "label").mapInArrow(_counts, "feature string, label int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean")
    ).where("toxic + clean >= 5")
    size = [min(max_docs, totals[0]), min(max_docs, totals[1])]
    rate, other = (F.col("toxic") + 0.5) / (size[1] + 1), (F.col("clean") + 0.5) / (size[0] + 1)
    best = counts.withColumn("lift", F.log(rate / other)).withColumn("power", F.abs(F.col("lift")) * F.greatest("toxic", "clean"))
    rows = best.orderBy(F.desc("power"), "feature").limit(max_features).collect()
    index = {r["feature"]: k + 1 for k, r in enumerate(rows)}
    evidence = {index[r["feature"]] for r in rows if r["toxic"] >= 5 and r["lift"] >= np.log(12)}
    tokens = sample.select("text", "label", F.col("doc").cast("string"))
    windows = tokens.mapInArrow(lambda batches: _windows(batches, index, evidence), "doc string, at long, grid binary, labels binary")
    windows = windows.orderBy(F.xxhash64("doc", "at"), "doc", "at").limit(max_windows).select("grid", "labels").toArrow()
    if not windows.num_rows:
        return None
    grids = np.frombuffer(b"".join(windows.column("grid").to_pylist()), np.int32).reshape(-1, _SPAN, 4).astype(np.int64)
    marks = np.frombuffer(b"".join(windows.column("labels").to_pylist()), np.int8).reshape(-1, _SPAN)
    field = _fit_field(grids, marks, len(index))
    model = {"weights": {f: float(field["w"][k]) for f, k in index.items() if abs(field["w"][k]) > 1e-3}, "field": {"b": field["b"], "t": field["t"]}}

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            found = [tagger.summary(t)[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.float64()) for k in range(3)] + [batch.column(1)], ["a", "b", "c", "label"])

    seen = sample.select("text", "label").mapInArrow(summaries, "a double, b double, c double, label int").toArrow()
    y = seen.column("label").to_numpy()
    weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    model["curve"] = _fit_curve(np.column_stack([seen.column(c).to_numpy() for c in "abc"]), y, weight / weight.mean())
    return model


def score(docs: DataFrame, model: dict | None, text_col: str = "text", score_col: str = "score", spans_col: str = "toxic_spans") -> DataFrame:
    """``docs`` (all columns) with a score from 0 to 1 and the toxic spans' offsets; columns of those names are replaced."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in (score_col.lower(), spans_col.lower())]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.0).alias(score_col), F.array().cast("array<int>").alias(spans_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score double, spans array<int>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger, curve = Tagger(shared.value), shared.value["curve"]
        for texts in batches:
            scores, spans = [], []
            for text in texts:
                x, where = tagger.summary(text)
                z = curve[3] + sum(a * b for a, b in zip(curve, x, strict=False))
                scores.append(1 / (1 + float(np.exp(-min(30.0, max(-30.0, z))))))
                spans.append(where)
            yield pd.DataFrame({"score": scores, "spans": spans})

    out = docs.withColumn("__toxic", judge(F.col(f"`{text_col}`").cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("__toxic.score").alias(score_col), F.col("__toxic.spans").alias(spans_col))
