"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

Equal vectors form one class, so copies meet once. Trees are fitted on at most ``sample`` classes (those with the least
hash): every node splits on a random projection, and both children take what is within ``spill`` of the cut by rank or, by
distance, as near as linked vectors lie on a projection. Cuts are laid where few vectors are; a node that no cut thins out,
as a group of near copies, is not split. There are ``trees`` trees or more, until test pairs at the threshold and linked pairs
of the sample meet. All classes go down all trees; classes in one leaf are compared by exact cosine in double precision. A leaf of more than
``leaf_rows`` classes is compared block by block, so its work is spread and nothing is left out. Pairs are united over trees;
components follow from the links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors
of different lengths or rows without an id; these rows are their own component. Repeated ids with equal vectors count each
other as links. Classes are named by a 64-bit hash of the vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import connected_components
from .ship import ship
from .staging import stored

#: Random directions tried for a node, and the quantiles at which each is cut.
DIRECTIONS = 4
CUTS = np.linspace(0.2, 0.8, 13)
#: The share of a node's pairs that a split has to spare.
SPARED = 0.15
#: Pairs of either kind that measure a forest, and the share of them it may miss.
PROBES = 2000
MISSED = 0.001


def _unit(column: pa.Array) -> list[np.ndarray]:
    found = []
    for x in column:
        v = np.array(x.as_py(), np.float64)
        v = v / np.abs(v).max()
        found.append(v / np.sqrt(v @ v))
    return found


def _grow(vectors: np.ndarray, least: float, spill: float, margin: float, rng: np.random.Generator) -> list | None:
    """(direction, low, high, left, right); points up to ``high`` go left, from ``low`` on right. A leaf is None.

    Of some random directions and cuts, the one that leaves the fewest pairs to compare is taken; a node that none of them
    spares ``SPARED`` of its pairs, as one of near copies, is a leaf.
    """
    count = len(vectors)
    if count < 8 or count <= least:
        return None
    best = ((1 - SPARED) * count * count,)
    for _ in range(DIRECTIONS):
        direction = rng.standard_normal(vectors.shape[1])
        direction /= np.sqrt(direction @ direction)
        at = vectors @ direction
        line = np.sort(at)
        middle = np.quantile(line, CUTS)
        low = np.minimum(np.quantile(line, CUTS - spill), middle - margin / 2)
        high = np.maximum(np.quantile(line, CUTS + spill), middle + margin / 2)
        pairs = np.searchsorted(line, high, "right").astype(float) ** 2 + (count - np.searchsorted(line, low)).astype(float) ** 2
        k = int(pairs.argmin())
        if pairs[k] < best[0]:
            best = (pairs[k], direction, float(low[k]), float(high[k]), at)
    if len(best) == 1:
        return None
    _, direction, low, high, at = best
    left, right = (_grow(vectors[m], least, spill, margin, rng) for m in (at <= high, at >= low))
    return [direction, low, high, left, right]


def _meet(node: list | None, one: np.ndarray, two: np.ndarray, rows: np.ndarray, met: np.ndarray) -> None:
    """Marks the rows whose two vectors come to a common leaf."""
    if node is None or not len(rows):
        met[rows] = True
        return
    a, b = one[rows] @ node[0], two[rows] @ node[0]
    _meet(node[3], one, two, rows[(a <= node[2]) & (b <= node[2])], met)
    _meet(node[4], one, two, rows[(a >= node[1]) & (b >= node[1])], met)


def _probes(vectors: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs to measure trees by: vectors with a made neighbour at the threshold, and some linked pairs of the sample."""
    own = vectors[rng.permutation(len(vectors))[:PROBES]]
    aside = rng.standard_normal(own.shape)
    aside -= (aside * own).sum(1)[:, None] * own
    aside /= np.maximum(np.sqrt((aside * aside).sum(1)), 1e-300)[:, None]
    made = threshold * own + max(0.0, 1 - threshold * threshold) ** 0.5 * aside
    i, j = np.nonzero(own @ vectors.T >= threshold)
    some = rng.permutation(len(i))[:PROBES]
    return np.vstack([own, own[i[some]]]), np.vstack([made, vectors[j[some]]])


def _forest(vectors: np.ndarray, least: float, trees: int, spill: float, threshold: float, rng: np.random.Generator) -> list:
    """At least ``trees`` trees, and more until all but ``MISSED`` of the probes meet in one of them.

    The margin is the spread of a just linked pair along a random direction. Further trees double it: what has no cut then
    is one leaf, so they end.
    """
    margin = (max(0.0, 2 - 2 * threshold) / vectors.shape[1]) ** 0.5
    one, two = _probes(vectors, threshold, rng)
    met, grown = np.zeros(len(one), bool), []
    while len(grown) < trees or (~met).sum() > MISSED * len(met):
        if grown and len(grown) % trees == 0:
            margin *= 2
        grown.append(_grow(vectors, least, spill, margin, rng))
        if grown[-1] is None:
            return [None]
        _meet(grown[-1], one, two, np.flatnonzero(~met), met)
    return grown


def _descend(node: list | None, vectors: np.ndarray, rows: np.ndarray, path: int, out: list) -> None:
    if node is None or not len(rows):
        out.append((path, rows))
        return
    at = vectors[rows] @ node[0]
    _descend(node[3], vectors, rows[at <= node[2]], path * 2, out)
    _descend(node[4], vectors, rows[at >= node[1]], path * 2 + 1, out)


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
    trees: int = 10, leaf: int = 256, spill: float = 0.05, sample: int = 20_000, leaf_rows: int = 2048, seed: int = 11,
) -> DataFrame:
    """One row per vector: ``id``, ``n_links``, ``component``."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.transform(v, lambda x: x + 0.0).alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    named = rows.select("id", "v", F.when(F.col("good") & F.col("id").isNotNull(), F.xxhash64("v")).alias("name"))
    classes = stored(named.where("name is not null").groupBy("name").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")), "vectors")
    n = classes.count()
    fitted = classes.select("v").orderBy("name").limit(sample).toArrow().column("v")  # names are hashes; bounded by `sample`
    units: dict[int, list[np.ndarray]] = {}
    for u in _unit(fitted):
        units.setdefault(len(u), []).append(u)
    rng = np.random.default_rng(seed)
    least = leaf * min(1.0, sample / max(1, n))  # the sample's share of a leaf
    forest = {d: _forest(np.array(x), least, trees, spill, threshold, rng) for d, x in units.items()}
    shared = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _unit(batch.column(1))
            lengths = np.array([len(u) for u in own])
            for d in np.unique(lengths):
                which = np.flatnonzero(lengths == d)
                block = np.array([own[k] for k in which])
                names = batch.column(0).take(pa.array(which))
                for t, root in enumerate(shared.value.get(int(d), [None])):
                    leaves: list = []
                    _descend(root, block, np.arange(len(block)), 1, leaves)
                    for path, members in leaves:
                        if len(members):
                            yield pa.RecordBatch.from_arrays(
                                [names.take(pa.array(members)), pa.array([f"{d}.{t}.{path}"] * len(members)), pa.array([block[k].tobytes() for k in members], pa.binary())],
                                ["name", "leaf", "unit"],
                            )

    placed = stored(classes.select("name", "v").mapInArrow(place, "name long, leaf string, unit binary"), "leaves")
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    dealt = placed.join(sizes, "leaf").withColumn("parts", F.ceil(F.col("k") / leaf_rows).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("name", "leaf"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("name", "unit", "part", "leaf", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))

    def compare(block: pa.Table) -> pa.Table:
        names, part = block.column("name").to_numpy(), block.column("part").to_numpy()
        units = np.frombuffer(b"".join(block.column("unit").to_pylist()), np.float64).reshape(len(names), -1)
        low, high = block.column("p")[0].as_py(), block.column("q")[0].as_py()
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        a, b = [], []
        for at in range(0, len(left), 512):
            rows_, columns = np.nonzero(units[left[at : at + 512]] @ units[right].T >= threshold)
            one, two = names[left[at + rows_]], names[right[columns]]
            keep = one < two if low == high else one != two
            a.append(np.minimum(one, two)[keep])
            b.append(np.maximum(one, two)[keep])
        none = np.zeros(0, np.int64)
        return pa.table([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

    links = cut_lineage(dealt.groupBy("leaf", "p", "q").applyInArrow(compare, "a long, b long").distinct())
    both = links.union(links.select("b", "a"))
    copies = classes.select(F.col("name").alias("b"), F.col("copies").alias("m"))
    degree = both.join(copies, "b").groupBy("a").agg(F.sum("m").alias("others")).withColumnRenamed("a", "name")
    roots = connected_components(links).withColumnRenamed("id", "name")
    known = classes.select("name", "copies", "least").join(degree, "name", "left").join(roots, "name", "left")
    known = known.withColumn("root", F.coalesce("root", "name"))
    heads = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(heads, "root").select("name", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component")
    out = named.select("id", "name").join(known, "name", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
