"""MinHash near-duplicates by chosen-path trees.

Documents become sets of word shingles (hashed in 64 bits); equal sets form one class, so copies meet once. Each class has
a vector of minwise tokens. Independent trees branch it recursively: in a node, each coordinate is chosen with probability
1 / (threshold * coordinates), decided by a hash of the node's path, and a child gathers the classes that agree on it.
Two sets at the threshold keep together in one path on average at every level. In nodes of more than ``small`` classes, which
mostly hold near copies of each other, members are compared with the node's first, and what is linked so counts as one part,
within which nothing is left to find. Nodes of at most ``2 * BLOCK`` classes then compare all their members, on one byte of each
minwise token first. Larger ones that still hold several parts branch on, as deep as ``depth``; what is larger even then is dealt
into blocks, and every block is compared with itself and each other. In every cell (a node, or a pair of blocks) each class is
first tried with the one that agrees most, on full shingle sets, and links are united, twice; then the pairs of cells that still
hold several parts are tested on full sets inside a cell. Before that, cells that share classes are dealt anew into pairs of
blocks where a set goes to fewer places so. Links that connect what is connected already are left out, so rows grow with
classes, not with their pairs.

The recall of a pair at the threshold is about 1 - 0.63 ** trees at three levels, more above it.

Defined results: null or wordless texts have no shingles and link with nothing; a text of fewer words than a shingle is
one shingle; equal sets always link; repeated doc_ids give one row each; a component is named by its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import connected_components
from .ship import ship
from .staging import small_side, stored

_SEEDS = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_EMPTY = 0
#: Levels that every class branches down before nodes are looked at.
LEVELS = 3
#: Classes of a block, where nodes are compared by pairs of blocks; two blocks' worth is compared whole.
BLOCK = 1024
#: Bytes of the sets that a block holds when pairs are confirmed; a longer set is a block of its own.
BLOCK_BYTES = 2 << 20
#: Rows of cells that are compared in one call, as far as no cell has more.
CELL_ROWS = 4096
#: Links that one task holds while components are found.
LINKS_PER_TASK = 100_000
#: Rounds in which each class is tried with its likeliest partner, before cells that are still apart are tested whole.
ROUNDS = 2


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, sorted."""
    for low, high in tb.chunks(bounds):
        own = bounds[low : high + 1]
        _, _, hashes, first = tb.words(data[own[0] : own[-1]], own - own[0], tb.SPACED_WORDS)
        every = tb.shingles(hashes, n)
        for r in range(high - low):
            a, b = int(first[r]), int(first[r + 1])
            if b - a >= n:
                yield np.unique(every[a : b - n + 1])
            elif b > a:
                yield tb.mix(np.array([tb.sequence_hash(hashes[a:b])], np.uint64) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def set_name(tokens: np.ndarray) -> int:
    """64-bit name of a set; 0 for the empty one."""
    if not len(tokens):
        return _EMPTY
    spread = tb.mix(tokens)
    total = np.array([np.sum(spread, dtype=np.uint64)], np.uint64)
    folded = np.array([np.bitwise_xor.reduce(tb.mix(spread))], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(_signed(tb.mix((total ^ folded) + np.uint64(len(tokens))))[0]) or 1


def minwise(tokens: np.ndarray, size: int) -> np.ndarray:
    """The least hash under each of ``size`` functions, as 16 bits."""
    low = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 2048):
        h = tokens[at : at + 2048, None] * _SEEDS[None, :size]
        low = np.minimum(low, (h ^ (h >> np.uint64(29))).min(axis=0))
    return (tb.mix(low) >> np.uint64(48)).astype(np.uint16)


def _signatures(batches: Iterator[pa.RecordBatch], n: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = tb.raw(batch.column(1))
        names, counts, marks, codes = [], [], [], []
        for tokens in shingle_sets(data, bounds, n):
            names.append(set_name(tokens))
            counts.append(len(tokens))
            least = minwise(tokens, size) if len(tokens) else None
            marks.append(None if least is None else least.tobytes())
            codes.append(None if least is None else least.astype(np.uint8).tobytes())
        columns = [pa.array(names, pa.int64()), pa.array(counts, pa.int64()), pa.array(marks, pa.binary()), pa.array(codes, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc", "name", "n", "marks", "codes"])


def _branch(batches: Iterator[pa.RecordBatch], levels: int, threshold: float, trees: int, size: int) -> Iterator[pa.RecordBatch]:
    """From (name, n, marks, tree, path) to the children ``levels`` deeper; a null path starts all trees, by 16 bits of each
    token, later levels by 8: sets that agree by chance cost a comparison, none is lost."""
    limit = np.uint64(int(2**64 / (threshold * size)))
    step = 128
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            tree, path = part.column(3), part.column(4)
            kind = np.uint16 if path.null_count else np.uint8
            marks = np.frombuffer(b"".join(part.column(2).to_pylist()), kind).reshape(part.num_rows, size).astype(np.uint64)
            if path.null_count:
                tree = np.tile(np.arange(trees, dtype=np.int32), part.num_rows)
                row, node = np.repeat(np.arange(part.num_rows), trees), tb.mix(tree.astype(np.uint64) + np.uint64(1))
            else:
                row, node, tree = np.arange(part.num_rows), path.to_numpy().view(np.uint64), tree.to_numpy()
            for _ in range(levels):
                chosen = tb.mix(node[:, None] + _SEEDS[None, :size]) < limit
                which, c = np.nonzero(chosen)
                row, tree, node = row[which], tree[which], tb.mix(node[which] * np.uint64(3) + _SEEDS[c] * (marks[row[which], c] + np.uint64(1)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(tree), pa.array(_signed(node))],
                ["name", "n", "tree", "path"],
            )


def _agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal columns per row. Eight flags are added at a time, one in each byte of a word; a byte counts up to 255."""
    equal = left == right
    if equal.shape[1] % 8 or equal.shape[1] > 255:
        return equal.sum(1)
    lanes = np.ascontiguousarray(equal).view(np.uint64).sum(axis=1, dtype=np.uint64)
    return ((lanes * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def _agreement(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """From (a, b, codes of a, codes of b) to the number of equal minwise tokens."""
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, size) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_agreeing(left, right), pa.int64())], ["a", "b", "same"])


def _pairs_of_groups(ends: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within groups that stand one after another, by the first place; ``ends``: where each place's group ends.
    Some ``most`` pairs at once, or those of one place."""
    later = ends - np.arange(len(ends)) - 1
    until = np.cumsum(later)
    at = 0
    while at < len(ends):
        done = until[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(until, done + most, side="right")))
        some = later[at:stop]
        i = np.repeat(np.arange(at, stop), some)
        j = i + 1 + np.arange(len(i)) - np.repeat(until[at:stop] - some - done, some)
        yield i, j
        at = stop


def _candidates(table: pa.Table, size: int, least: float, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of classes in one cell, but for those of one part, that may reach the threshold, and how many tokens
    agree; in a cell of two blocks, the pairs across. Rows of a cell (``path``) stand together."""
    path, part, n, block = (table.column(c).to_numpy() for c in ("path", "part", "n", "block"))
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(-1, size)
    first = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
    rows = np.diff(np.append(first, len(path)))
    across = np.repeat(np.minimum.reduceat(block, first) < np.maximum.reduceat(block, first), rows)
    # Pairs that agree in too few of the first columns cannot reach ``least`` with all the others.
    half = size // 16 * 8
    front, back = np.ascontiguousarray(codes[:, :half]), np.ascontiguousarray(codes[:, half:])
    found = []
    for i, j in _pairs_of_groups(np.repeat(first + rows, rows), max(1, (1 << 22) // size)):
        fits = (part[i] != part[j]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))
        fits &= ~across[i] | (block[i] != block[j])
        i, j = i[fits], j[fits]
        same = _agreeing(front[i], front[j])
        close = same >= least - (size - half)
        i, j, same = i[close], j[close], same[close]
        same = same + _agreeing(back[i], back[j])
        close = same >= least
        found.append((i[close], j[close], same[close]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _best_pairs(table: pa.Table, size: int, least: float, threshold: float) -> pa.Table:
    """In each cell, each class with the one of another part that agrees most, where any may reach the threshold: no more rows than classes."""
    table = table.sort_by("path")
    name, path = table.column("name").to_numpy(), table.column("path").to_numpy()
    i, j, same = _candidates(table, size, least, threshold)
    one, other, agree = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((same, same))
    order = np.lexsort((name[other], -agree, one))
    one, other = one[order], other[order]
    first = np.concatenate((np.ones(min(1, len(one)), bool), one[1:] != one[:-1]))
    one, other = one[first], other[first]
    at, one, other = path[one], name[one], name[other]
    return pa.table([pa.array(x) for x in (np.minimum(one, other), np.maximum(one, other), at)], ["a", "b", "path"])


def _members(table: pa.Table, size: int, least: float, threshold: float) -> pa.Table:
    """The classes of each cell that are in a pair of two parts which may reach the threshold."""
    table = table.sort_by("path")
    i, j, _ = _candidates(table, size, least, threshold)
    return table.take(pa.array(np.unique(np.concatenate((i, j))))).select(["path", "name", "part", "n", "block"])


def _links_of_node(table: pa.Table, size: int, least: float, threshold: float) -> pa.Table:
    """Links that hold on the full sets (``tokens``) of a node's classes; pairs that parts and earlier links connect are left out."""
    i, j, _ = _candidates(table, size, least, threshold)
    name, percent = table.column("name").to_numpy(), round(threshold * 100)
    root = np.unique(table.column("part").to_numpy(), return_inverse=True)[1]
    sets = [np.frombuffer(body.as_buffer(), np.uint64) for body in table.column("tokens")]
    n = np.array([len(own) for own in sets], np.int64)
    first = np.cumsum(n) - n
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    seen, links = np.zeros(len(ids), bool), []
    turn = np.searchsorted(i, np.arange(len(n) + 1))  # pairs come in the order of their first member
    for x in np.unique(i).tolist():
        seen[ids[first[x] : first[x] + n[x]]] = True
        others = j[turn[x] : turn[x + 1]]
        for at in range(0, len(others), 256):
            y = others[at : at + 256]
            y = y[root[y] != root[x]]
            if not len(y):
                continue
            begin = np.cumsum(n[y]) - n[y]
            tokens = ids[np.arange(n[y].sum()) + np.repeat(first[y] - begin, n[y])]
            shared = np.add.reduceat(seen[tokens], begin, dtype=np.int64)
            for z in y[100 * shared >= percent * (n[x] + n[y] - shared)].tolist():
                if root[z] != root[x]:
                    root[root == root[z]] = root[x]
                    links.append((name[x], name[z]))
        seen[ids[first[x] : first[x] + n[x]]] = False
    return pa.table([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])


class _Parts:
    """Classes joined so far."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.above[self.root(x)] = self.root(y)


def _similar(own: np.ndarray, other: np.ndarray, threshold: float) -> bool:
    """Whether two sets of sorted tokens reach the threshold."""
    percent = round(threshold * 100)
    if 100 * min(len(own), len(other)) < percent * max(len(own), len(other)):
        return False
    shared = len(np.intersect1d(own, other, assume_unique=True))
    return 100 * shared >= percent * (len(own) + len(other) - shared)


def _shared(nodes: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Nodes (name, n, tree, path) that hold more than one part, with ``part`` and their number of classes ``k``."""
    if parts is None:
        return _mixed(nodes.withColumn("part", F.col("name")))
    # Stored, as both sides of the join on paths need the parts.
    return _mixed(stored(nodes.join(small_side(parts), "name", "left").withColumn("part", F.coalesce("part", "name")), "known"))


def _mixed(nodes: DataFrame) -> DataFrame:
    """Nodes (path, part, ...) that hold more than one part, with their number of classes ``k``."""
    sums = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("k"), F.min("part").alias("low"), F.max("part").alias("high"))
    return stored(nodes.join(sums.where("low <> high").select("path", "k"), "path"), "nodes")


def _links(texts: DataFrame, classes: DataFrame, words: int, threshold: float, trees: int, size: int, small: int, depth: int) -> DataFrame:
    """Confirmed links (a, b) of classes."""
    schema = "name long, n long, tree int, path long"  # of nodes
    branch = partial(_branch, threshold=threshold, trees=trees, size=size)
    spread = (threshold * (1 - threshold) * size) ** 0.5
    least = threshold * size - 3.5 * spread
    codes = classes.select("name", "codes")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return stored(_confirmed(texts, classes, pairs, words, threshold), "links")

    def starred(nodes: DataFrame) -> DataFrame:
        """Every member with its node's first, as far as sizes and minwise tokens allow."""
        heads = nodes.groupBy("path").agg(F.min(F.struct("name", "n", "part")).alias("h"))
        stars = nodes.join(heads, "path").where(f"part <> h.part and least(n, h.n) >= {threshold} * greatest(n, h.n)")
        stars = stars.select(F.col("h.name").alias("a"), F.col("name").alias("b")).distinct()
        both = stars.join(codes.toDF("a", "codes_a"), "a").join(codes.toDF("b", "codes_b"), "b").select("a", "b", "codes_a", "codes_b")
        return both.mapInArrow(partial(_agreement, size=size), "a long, b long, same long").where(F.col("same") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "same")

    def compared(cells: DataFrame, compare, schema: str, more: DataFrame | None = None) -> DataFrame:
        def task(table: pa.Table) -> pa.Table:
            return compare(table, size, least, threshold)

        together = F.col("path")
        if more is None:  # many small cells in one call; with full sets, a cell by itself
            together = F.pmod("path", F.lit(max(1, cells.count() // CELL_ROWS)))
        cells = cells.join(codes, "name").select("path", "name", "part", "n", "block", "codes")
        return (cells if more is None else cells.join(more, "name")).groupBy(together.alias("together")).applyInArrow(task, schema)

    start = classes.select("name", "n", "marks", F.lit(None).cast("int").alias("tree"), F.lit(None).cast("long").alias("path"))
    nodes = _shared(start.mapInArrow(partial(branch, levels=LEVELS), schema), None)
    links, parts, found = [], None, []

    def united() -> DataFrame:
        roots = connected_components(reduce(DataFrame.union, links), LINKS_PER_TASK)
        return stored(roots.select(F.col("id").alias("name"), F.col("root").alias("part")), "parts")

    # Large nodes: what is linked with a node's first class is one part already, and is not compared within. A third of the trees first: they unite most.
    for use in (trees // 3 + 1, trees):
        large = nodes.where((F.col("k") > small) & (F.col("tree") < use))
        if large.isEmpty():
            continue
        reps = large.groupBy("path", "part").agg(F.min(F.struct("name", "n")).alias("r")).select("path", "part", "r.*")
        links.append(confirmed(starred(reps)))
        parts = united()
        nodes = _shared(nodes.drop("part", "k"), parts)
    level = LEVELS
    while True:
        found.append(nodes.where(F.col("k") <= 2 * BLOCK).select("path", "name", "n", "part", F.lit(0).alias("block")))
        nodes = nodes.where(F.col("k") > 2 * BLOCK)
        if level >= depth or nodes.isEmpty():
            break
        more = nodes.select("name", "tree", "path").join(classes, "name").select("name", "n", "codes", "tree", "path")
        nodes = _shared(more.mapInArrow(partial(branch, levels=1), schema).distinct(), parts)
        level += 1
    # Still large: all pairs of blocks.
    found.append(_dealt(nodes, "path").select("path", "name", "n", "part", "block"))
    cells = _mixed(reduce(DataFrame.union, found))

    def apart(cells: DataFrame) -> DataFrame:
        """Cells that hold more than one part after further links."""
        return _shared(cells.drop("part", "k"), united())

    # Each class with its likeliest partner of another part, in rounds: the rows follow the classes, not their pairs, and a group
    # of many links is one part soon. Only cells that found a pair are looked at again.
    for turn in range(ROUNDS):
        cells = apart(cells) if turn else cells
        best = stored(compared(cells, _best_pairs, "a long, b long, path long"), "best")
        if best.isEmpty():
            return reduce(DataFrame.union, links) if links else best.select("a", "b")
        links.append(confirmed(best))
        cells = cells.join(small_side(stored(best.select("path").distinct(), "paths")), "path", "left_semi")
    # What is still apart is tested on full sets inside its cell, and only links leave it.
    cells = stored(compared(apart(cells), _members, "path long, name long, part long, n long, block int"), "members")
    if not cells.isEmpty():
        cells = stored(_regrouped(cells), "regrouped")
        sets = _sets_of(texts, classes, cells.select("name").distinct(), words)
        links.append(stored(compared(cells, _links_of_node, "a long, b long", sets), "links"))
    return reduce(DataFrame.union, links)


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Groups of rows with a ``name`` and ``n`` as cells (``path``), each a pair of blocks that are bounded in classes and in bytes of their sets."""
    sums = rows.groupBy(key).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = rows.join(sums, key).withColumn("block", F.pmod(F.xxhash64("name", key), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("path", F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other")))


def _regrouped(cells: DataFrame) -> DataFrame:
    """Cells (path, name, part, n, block) in which every pair meets that met before, with fewer copies of a class where cells overlap much.

    Classes that cells connect are a group. A group is dealt into pairs of blocks if it has no more blocks than its classes
    have cells on average; its cells are kept otherwise, in blocks if their sets are many bytes.
    """
    lows = cells.groupBy("path").agg(F.min("name").alias("low"))
    edges = cells.join(lows, "path").where("name <> low").select(F.col("low").alias("a"), F.col("name").alias("b")).distinct()
    roots = stored(connected_components(edges, LINKS_PER_TASK).select(F.col("id").alias("name"), F.col("root").alias("group")), "groups")
    once = cells.groupBy("name").agg(F.first("part").alias("part"), F.first("n").alias("n"), F.count(F.lit(1)).alias("places")).join(roots, "name")
    sums = once.groupBy("group").agg((F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES) <= F.avg("places")).alias("anew"))
    sums = stored(sums, "sums")
    columns = ["path", "name", "part", "n", "block"]
    anew = _dealt(once.join(sums.where("anew"), "group").select("group", "name", "part", "n"), "group").select(*columns)
    kept = cells.join(roots, "name").join(sums.where("not anew"), "group").select(*columns)
    large = kept.groupBy("path").agg(F.sum("n").alias("tokens")).where(F.col("tokens") * 8 > 2 * BLOCK_BYTES).select("path")
    split = _dealt(kept.join(large, "path", "left_semi").drop("block"), "path").select(*columns)
    return anew.union(kept.join(large, "path", "left_anti")).union(split)


def _sets_of(texts: DataFrame, classes: DataFrame, names: DataFrame, words: int) -> DataFrame:
    """``name, tokens``: the full sets of some classes, read from the text of each class's first document."""
    known = stored(classes.select("name", "doc").join(names, "name"), "needed")
    needed = small_side(stored(known.select("doc").distinct(), "documents"))
    read = texts.join(needed, "doc", "left_semi").join(known, "doc").select("name", "text")
    return read.mapInArrow(partial(_sets, n=words), "name long, tokens binary").dropDuplicates(["name"])


def _confirmed(texts: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, threshold: float) -> DataFrame:
    """Links (a, b) that join the same classes as all pairs whose full sets reach the threshold.

    Pairs are tested in blocks. Classes that many pairs connect take the same label, the least name two steps around; the sets of
    a label are dealt into blocks of about ``BLOCK_BYTES``, and a set goes once to each pair of blocks that it is needed in,
    however many pairs it has there. A task leaves out pairs that its own links join already, so what it returns is a forest.
    """
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    ends = pairs.union(pairs.select("b", "a"))
    near = ends.groupBy("a").agg(F.min("b").alias("near")).select("a", F.least("a", "near").alias("near"))
    far = ends.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("near").alias("label"))
    known = stored(far.withColumnRenamed("a", "name").join(classes.select("name", "doc", "n"), "name"), "ends")
    blocks = known.groupBy("label").agg(F.ceil(F.sum("n") * 8 / BLOCK_BYTES).alias("blocks"))
    known = stored(known.join(blocks, "label").select("name", "doc", F.xxhash64("label", F.pmod(F.xxhash64("name"), "blocks")).alias("block")), "blocks")
    block_of = known.select("name", "block")
    keyed = pairs.join(block_of.toDF("a", "block_a"), "a").join(block_of.toDF("b", "block_b"), "b")
    keyed = stored(keyed.select(F.least("block_a", "block_b").alias("low"), F.greatest("block_a", "block_b").alias("high"), "a", "b"), "keyed")
    wanted = keyed.select("low", "high", F.col("a").alias("name")).union(keyed.select("low", "high", "b")).distinct()
    sets = _sets_of(texts, classes, known.select("name"), words)
    sent = wanted.join(sets, "name").select(F.col("low").alias("first"), F.col("high").alias("second"), "name", "tokens")

    def confirm(tests: pa.Table, sets: pa.Table) -> pa.Table:
        return _confirm(tests, sets, threshold)

    return keyed.groupBy("low", "high").cogroup(sent.groupBy("first", "second")).applyInArrow(confirm, "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """From (name, text) to the whole set of each text that bears this name."""
    for batch in batches:
        data, bounds = tb.raw(batch.column(1))
        names, bodies, size = [], [], 0
        for name, tokens in zip(batch.column(0).to_pylist(), shingle_sets(data, bounds, n), strict=True):
            if set_name(tokens) != name:  # another text under the same doc_id
                continue
            names.append(name)
            bodies.append(tokens.tobytes())
            size += len(bodies[-1])
            if size > 1 << 22:
                yield _set_rows(names, bodies)
                names, bodies, size = [], [], 0
        yield _set_rows(names, bodies)


def _set_rows(names: list[int], bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bodies, pa.binary())], ["name", "tokens"])


def _confirm(tests: pa.Table, sets: pa.Table, threshold: float) -> pa.Table:
    """Of the pairs of one pair of blocks, links that hold, short of those between classes that earlier ones connect."""
    tokens = {name: np.frombuffer(body.as_buffer(), np.uint64) for name, body in zip(sets.column("name").to_pylist(), sets.column("tokens"), strict=True)}
    joined, links = _Parts(), []
    for a, b in zip(tests.column("a").to_pylist(), tests.column("b").to_pylist(), strict=True):
        if joined.root(a) != joined.root(b) and a in tokens and b in tokens and _similar(tokens[a], tokens[b], threshold):
            joined.join(a, b)
            links.append((a, b))
    return pa.table([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.75,
    trees: int = 20, size: int = 128, small: int = 64, depth: int = 8,
) -> DataFrame:
    """One row per document: ``doc``, ``n`` (shingles), ``component`` (smallest doc of the component; the own one if alone)."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    marked = stored(texts.mapInArrow(partial(_signatures, n=words, size=size), f"doc {docs.schema[id_col].dataType.simpleString()}, name long, n long, marks binary, codes binary"), "marks")
    classes = marked.where(F.col("n") > 0).groupBy("name").agg(F.first("n").alias("n"), F.first("marks").alias("marks"), F.first("codes").alias("codes"), F.min("doc").alias("doc"))
    links = _links(texts, stored(classes, "classes"), words, threshold, trees, size, small, depth)
    roots = connected_components(links, LINKS_PER_TASK)
    named = marked.where(F.col("n") > 0).select("name", "doc").groupBy("name").agg(F.min("doc").alias("doc"))
    named = named.join(roots.withColumnRenamed("id", "name"), "name", "left").select("name", "doc", F.coalesce("root", "name").alias("root"))
    heads = named.groupBy("root").agg(F.min("doc").alias("component"))
    members = named.join(heads, "root").select("name", "component")
    out = marked.select("doc", "n", "name").join(members, "name", "left")
    return out.select("doc", "n", F.coalesce("component", "doc").alias("component"))
