"""Walks over edge tables: neighbourhoods, reachability, shortest paths, cycles.

Edges stay distributed. Every step joins the edge table with the frontier,
folds per node before and after the shuffle, and checkpoints, so a long walk
neither grows its plan nor loses work with an executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import INVALID_FILTER_VALUE, MetricError
from ..session import BROADCAST_ROWS, cut_lineage, discard, in_slice, slices_for, small_side, stored, stored_slices
from .joins import missing

SEPARATOR = " -> "


def graph_nodes(entities: DataFrame, dimensions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Typed node rows (id, label, type). ``entities``: name; ``dimensions``: entity, name; ``metrics``: name."""
    node = lambda ident, label, kind: [ident.alias("id"), label.alias("label"), F.lit(kind).alias("type")]
    parts = [
        entities.select(*node(F.concat(F.lit("entity."), "name"), F.col("name"), "entity")),
        dimensions.select(*node(F.concat(F.lit("dimension."), "entity", F.lit("."), "name"), F.col("name"), "dimension")),
        metrics.select(*node(F.concat(F.lit("metric."), "name"), F.col("name"), "metric")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def graph_edges(relationships: DataFrame, dimensions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Typed edge rows (src, dst, type). ``relationships``: parent, child; ``metrics``: name, entity."""
    edge = lambda src, dst, kind: [src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type")]
    entity = lambda c: F.concat(F.lit("entity."), c)
    parts = [
        relationships.select(*edge(entity("parent"), entity("child"), "join")),
        dimensions.select(*edge(entity("entity"), F.concat(F.lit("dimension."), "entity", F.lit("."), "name"), "dimension")),
        metrics.filter("entity IS NOT NULL").select(*edge(entity("entity"), F.concat(F.lit("metric."), "name"), "metric_dep")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def bucket_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("node_count"))


def neighbors(edges: DataFrame, seed: DataFrame, depth: int = 1) -> DataFrame:
    """Nodes within ``depth`` (1..3) undirected hops of the ``seed`` nodes (column node), with their distance.

    Each hop is a semi join and a distinct: a node with very many edges only
    adds the nodes it leads to, never pairs.
    """
    if not 1 <= depth <= 3:
        raise MetricError(INVALID_FILTER_VALUE, f"depth {depth} is not in 1..3")
    # One walk reads the edges once per hop; more than one is worth keeping them.
    ends = edges.select("src", "dst")
    both = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))
    links = ends.select(F.inline(both))
    if depth > 1:
        links = cut_lineage(links)
    frontier = seed.select("node").distinct()
    seen = frontier.withColumn("distance", F.lit(0))
    for hop in range(1, depth + 1):
        step = links.join(frontier, "node", "left_semi").select(F.col("other").alias("node")).distinct()
        frontier = missing(step, seen, ["node"])
        if hop < depth:
            frontier = cut_lineage(frontier)
        seen = seen.unionByName(frontier.withColumn("distance", F.lit(hop)))
    return seen


def subgraph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are in ``nodes`` (column node)."""
    ends = nodes.select("node").distinct()
    inside = edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi")
    return inside.join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def reachable(edges: DataFrame, starts: DataFrame, max_hops: int | None = None, least_shared: int = 1000) -> DataFrame:
    """Everything each start reaches over child -> parent edges.

    ``edges``: child, parent and optionally provenance, fk, pk. ``starts``: column start.
    Gives start, node, hops, path (the smallest text among the shortest),
    path_count, all_explicit, join_keys. Only shortest paths are followed and one
    row is kept per (start, node), so cycles end and rows stay linear. The walk ends when
    nothing new is found; with ``max_hops`` it ends there, and raises if more would follow.
    ``path_count`` stays at the largest bigint instead of overflowing.

    ``least_shared`` starts or more share the walks of the nodes their first edges lead to: those are walked once, and
    each start takes over what its first nodes reach, in one shuffle of its first edges and without a table per hop. Where
    that would make more than ``_SHARED_ROWS`` rows per first edge, every start walks by itself.
    """
    has = set(edges.columns)
    provenance = F.col("provenance") if "provenance" in has else F.lit("explicit")
    keyed = (F.col("fk") != "") & (F.col("pk") != "") if {"fk", "pk"} <= has else F.lit(False)
    key_text = (
        F.concat("child", F.lit("."), "fk", F.lit("="), "parent", F.lit("."), "pk") if {"fk", "pk"} <= has else F.lit("")
    )
    rows = edges.filter("child IS NOT NULL AND parent IS NOT NULL AND child <> parent").select(
        "child", "parent", (provenance == "explicit").alias("explicit"), F.when(keyed, key_text).alias("key")
    )
    begin = stored(starts.select("start").distinct(), "starts")
    if len(begin.take(least_shared)) == least_shared:
        dealt = _dealt(rows, begin)
        links = dealt.select(*_LINK)
        shared = _shared_walks(dealt, begin, max_hops)
        if shared is not None:
            if max_hops is not None and not shared.filter(F.col("hops") > max_hops).isEmpty():
                raise MetricError(INVALID_FILTER_VALUE, f"the walk goes on after {max_hops} hops")
            return shared
    else:
        links = stored(_folded(rows), "links")
    found, hops = _walk(links, begin, None if max_hops is None else max_hops + 1)
    if max_hops is not None and hops > max_hops:
        raise MetricError(INVALID_FILTER_VALUE, f"the walk goes on after {max_hops} hops")
    return found


#: Rows per first edge up to which starts take over walks of the nodes their first edges lead to.
_SHARED_ROWS = 8
#: Rows of a walk that are kept together as one list.
_CHUNK = 64
_LINK = ["child", "parent", "explicit", "key"]
_WALKED = ["start", "node", "hops", "path", "path_count", "all_explicit", "join_keys"]


def _folded(rows: DataFrame) -> DataFrame:
    """Parallel edges fold to one; an explicit one outranks an inferred one."""
    return rows.groupBy("child", "parent").agg(F.max("explicit").alias("explicit"), F.min("key").alias("key"))


def _dealt(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Edges folded to one per (child, parent), with ``first``: they leave a start, and ``inner``: walks can come upon them."""
    rows = stored(rows, "rows")
    n = slices_for(rows.count())

    def dealt(k: int) -> DataFrame:
        inner = rows.filter(in_slice("parent", k, n)).select(F.col("parent").alias("child")).distinct().withColumn("inner", F.lit(True))
        outer = starts.filter(in_slice("start", k, n)).select(F.col("start").alias("child")).withColumn("first", F.lit(True))
        # Folding and both joins share one shuffle of the edges.
        folded = _folded(rows.filter(in_slice("child", k, n)).repartition("child"))
        return folded.join(inner.hint("merge"), "child", "left").join(outer.hint("merge"), "child", "left")

    found = stored_slices(dealt, "dealt", n)
    discard(rows)
    return found


def _at_start(starts: DataFrame) -> DataFrame:
    """Each start as reached by no hop."""
    return starts.select(
        "start", F.col("start").alias("node"), F.lit(0).alias("hops"), F.col("start").cast("string").alias("path"),
        F.lit(1).cast("bigint").alias("path_count"), F.lit(True).alias("all_explicit"), F.lit("").alias("join_keys"),
    )


def _count_paths() -> Column:
    return F.coalesce(F.try_sum("path_count"), F.lit(2**63 - 1)).alias("path_count")


def _walk(links: DataFrame, starts: DataFrame, last: int | None = None, goes_on=None) -> tuple[DataFrame, int] | None:
    """Shortest walks of each start, a hop a round, ``last`` hops at most: the rows and the largest number of hops.

    None as soon as ``goes_on`` refuses the rows of a hop.
    """
    seen = frontier = stored(_at_start(starts), "walk")
    hop = 0
    while hop != last:
        rows = frontier.count()
        if goes_on is not None and not goes_on(frontier):
            return None
        step = small_side(frontier, rows).join(links, F.col("node") == F.col("child"))
        # One struct per (start, node): the smallest path brings its own flags along.
        candidate = F.struct(
            F.concat("path", F.lit(SEPARATOR), "parent").alias("path"),
            (F.col("all_explicit") & F.col("explicit")).alias("all_explicit"),
            F.concat_ws(";", F.when(F.col("join_keys") != "", F.col("join_keys")), "key").alias("join_keys"),
        )
        found = (
            step.groupBy("start", F.col("parent").alias("node"))
            .agg(F.min(candidate).alias("best"), _count_paths())
            .select("start", "node", F.lit(hop + 1).alias("hops"), "best.path", "path_count", "best.all_explicit", "best.join_keys")
        )
        frontier = stored(missing(found, seen.hint("merge"), ["start", "node"]).select(*_WALKED), "walk")
        if frontier.isEmpty():
            break
        hop += 1
        seen = seen.unionByName(frontier)
        if hop % 16 == 0:
            seen = stored(seen, "walk")
    return seen, hop


def _walk_lists(walked: DataFrame) -> tuple[DataFrame, int]:
    """What each start of ``walked`` reaches beyond itself as lists (start, chunk, items) of ``_CHUNK`` rows at most, and the number of rows.

    Texts are kept without the start's name in front, so starts that go on alike have equal lists.
    """
    name = F.col("start").cast("string")
    beyond = lambda column: F.substr(F.col(column), F.char_length(name) + 1)
    named = (F.col("join_keys") != "") & F.startswith(F.col("join_keys"), name)
    item = F.struct(
        "node", (F.col("hops") + 1).alias("hops"), beyond("path").alias("tail"), "path_count", "all_explicit", named.alias("named"),
        F.when(named, beyond("join_keys")).when(F.col("join_keys") != "", F.col("join_keys")).alias("keys"),
    )
    numbered = walked.filter("hops > 0").select(
        "start", item.alias("item"), F.floor((F.row_number().over(Window.partitionBy("start").orderBy("node")) - 1) / _CHUNK).alias("chunk")
    )
    lists = stored(numbered.groupBy("start", "chunk").agg(F.sort_array(F.collect_list("item")).alias("items")), "lists")
    return lists, lists.agg(F.sum(F.size("items"))).first()[0] or 0


def _shared_walks(dealt: DataFrame, starts: DataFrame, max_hops: int | None) -> DataFrame | None:
    """``reachable`` by walks of the nodes that first edges lead to; None if those reach too much to be worth it.

    ``dealt`` is deleted where the result does not read it. First edges take the walk of their parent as lists, or, where few
    lists differ, as the number of a list, and are shuffled to their starts as they are; lists unfold there.
    """
    first = dealt.filter("first").select(*_LINK)
    onward = stored(dealt.filter("inner").select(*_LINK), "onward")
    heads = stored(onward.select(F.col("child").alias("parent")).distinct(), "heads")
    n_first = first.count()
    # Nodes that lead nowhere reach themselves only, one row per first edge: they need no walk.
    fan = first.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).join(small_side(heads), "parent", "left_semi")
    fan = stored(fan.select(F.col("parent").alias("start"), "n"), "fan")
    left = (_SHARED_ROWS - 1) * n_first + (fan.agg(F.sum("n")).first()[0] or 0)
    by_fan = small_side(fan)

    def goes_on(frontier: DataFrame) -> bool:
        nonlocal left
        left -= frontier.join(by_fan, "start").agg(F.sum("n")).first()[0] or 0
        return left >= 0

    walked = _walk(onward, fan.select("start"), max_hops, goes_on)
    if walked is None:
        return None
    taken, size = _walk_lists(walked[0])
    taken = taken.withColumnRenamed("start", "parent")
    kinds = taken.select("items").distinct()
    few = len(kinds.take(BROADCAST_ROWS // _CHUNK + 1)) <= BROADCAST_ROWS // _CHUNK
    if few:
        kinds = stored(kinds.withColumn("kind", F.monotonically_increasing_id()), "kinds")
        taken = stored(taken.join(F.broadcast(kinds), "items").select("parent", "chunk", "kind"), "taken")
        size = taken.count()
    if size <= BROADCAST_ROWS:
        met = first.join(F.broadcast(taken), "parent", "left")
    else:
        n = slices_for(n_first)
        mine = lambda df, k: df.filter(in_slice("parent", k, n))
        met = stored_slices(lambda k: mine(first, k).hint("merge").join(mine(taken, k).hint("merge"), "parent", "left"), "met", n)
        discard(dealt)
    met = met.repartition("child")
    if few:
        met = met.join(F.broadcast(kinds), "kind", "left")
    itself = F.struct(
        F.col("parent").alias("node"), F.lit(1).alias("hops"), F.lit("").alias("tail"), F.lit(1).cast("bigint").alias("path_count"),
        F.lit(True).alias("all_explicit"), F.lit(False).alias("named"), F.lit(None).cast("string").alias("keys"),
    )
    items = F.concat(F.when(F.coalesce("chunk", F.lit(0)) == 0, F.array(itself)).otherwise(F.array().cast(met.schema["items"].dataType)), F.coalesce("items", F.array()))
    offers = met.select(*_LINK, F.inline(items)).filter("child <> node")
    best = F.min(F.struct(
        F.concat("parent", "tail").alias("onward"), (F.col("all_explicit") & F.col("explicit")).alias("all_explicit"), "key",
        F.when(F.col("named"), F.concat("parent", "keys")).otherwise(F.col("keys")).alias("onward_keys"),
    ))
    # The shuffle by start serves both groupings: the paths of each length, then the shortest length.
    lengths = offers.groupBy("child", "node", "hops").agg(best.alias("best"), _count_paths())
    least = lengths.groupBy("child", "node").agg(F.min(F.struct("hops", "best", "path_count")).alias("least"))
    found = least.select(
        F.col("child").alias("start"), "node", "least.hops", F.concat("child", F.lit(SEPARATOR), "least.best.onward").alias("path"),
        "least.path_count", "least.best.all_explicit", F.concat_ws(";", "least.best.key", "least.best.onward_keys").alias("join_keys"),
    )
    return _at_start(starts).unionByName(found)


def shortest_path(edges: DataFrame, start: str, target: str | Sequence[str], max_hops: int | None = None) -> DataFrame:
    """The shortest join path to a node (or to each of several), its keys, and whether it is the only one."""
    spark = edges.sparkSession
    starts = spark.range(1).select(F.lit(start).alias("start"))
    targets = [target] if isinstance(target, str) else list(target)
    return (
        reachable(edges, starts, max_hops)
        .filter(F.col("node").isin(targets))
        .select("start", "node", "hops", "path", "join_keys", "path_count", (F.col("path_count") == 1).alias("is_unique"))
    )


def joinable(edges: DataFrame, base: str, max_hops: int | None = None) -> DataFrame:
    """Tables that can be joined from ``base`` many-to-one, with the keys of every hop; edges without keys are dropped."""
    keyed = edges.filter("fk IS NOT NULL AND fk <> '' AND pk IS NOT NULL AND pk <> ''")
    starts = edges.sparkSession.range(1).select(F.lit(base).alias("start"))
    return reachable(keyed, starts, max_hops).filter("hops > 0").select("node", "hops", "path", "join_keys")


def lineage(edges: DataFrame, node: str, direction: str = "upstream") -> DataFrame:
    """Direct upstream (what ``node`` depends on) or downstream (what depends on it). ``edges``: child, parent."""
    if direction == "upstream":
        return edges.filter(F.col("child") == node).select(F.col("parent").alias("node")).distinct()
    if direction == "downstream":
        return edges.filter(F.col("parent") == node).select(F.col("child").alias("node")).distinct()
    raise ValueError("direction is 'upstream' or 'downstream'")


def metric_refs(df: DataFrame, name: str = "name", expression: str = "expression") -> DataFrame:
    """(src, dst) rows: each metric and the metrics its expression names in braces, once each."""
    found = F.regexp_extract_all(F.col(expression), F.lit(r"\{([^{}]+)\}"), F.lit(1))
    names = F.array_distinct(F.transform(found, lambda v: F.trim(v)))
    return df.select(F.col(name).alias("src"), F.explode(names).alias("dst"))


def _spread(labels: DataFrame, edges: DataFrame, frm: str, to: str) -> DataFrame:
    """Push the largest label along edges until nothing changes. ``labels``: node, label, and nodes only gain."""
    links = edges.select(F.col(frm).alias("a"), F.col(to).alias("b"))
    active = labels
    while not active.isEmpty():
        offers = (
            active.join(links, active["node"] == links["a"])
            .groupBy(F.col("b").alias("node")).agg(F.max("label").alias("offer"))
        )
        merged = cut_lineage(
            labels.join(offers, "node", "left").select(
                "node", F.greatest("label", "offer").alias("label"), (F.col("offer") > F.col("label")).alias("grew")
            )
        )
        labels = merged.select("node", "label")
        active = merged.filter("grew").select("node", "label")
    return labels


def _compress(edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """Replace every run of nodes with one edge in and one out by a single edge; None where fewer than ``least`` nodes stand in runs.

    Gives the edges left, the inner nodes (node, src, dst: the ends of their run), the nodes whose run leads back to
    them, and the rings (node, cycle_id) that consist of inner nodes only. Each inner node points at its successor while
    that is an inner node too; pointers are followed twice as far in each round, so a run of n nodes takes log2(n) rounds.
    """
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("next"), F.lit(None).alias("prev")),
        F.struct(F.col("dst").alias("node"), F.lit(None).alias("next"), F.col("src").alias("prev")),
    )
    inner = cut_lineage(
        edges.select(F.inline(ends)).groupBy("node")
        .agg(F.count("next").alias("n_out"), F.count("prev").alias("n_in"), F.max("next").alias("next"), F.max("prev").alias("prev"))
        .filter("n_out = 1 AND n_in = 1").select("node", "next", "prev")
    )
    if len(inner.take(least)) < least:
        return None
    known = inner.select(F.col("node").alias("at"), F.lit(True).alias("there"))
    followed = inner.join(known, inner["next"] == known["at"], "left")
    last = F.col("there").isNull()
    steps = cut_lineage(
        followed.select("node", F.when(last, F.col("node")).otherwise(F.col("next")).alias("to"), F.col("node").alias("low"), last.alias("ended"))
    )
    open_before = None
    while True:
        ahead = steps.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("low").alias("low_ahead"), F.col("ended").alias("ended_ahead"))
        going = steps.filter("NOT ended").join(ahead, "to").select(
            "node", F.col("further").alias("to"), F.least("low", "low_ahead").alias("low"), F.col("ended_ahead").alias("ended"),
            (F.col("low_ahead") < F.col("low")).alias("sank"),
        )
        moved = cut_lineage(steps.filter("ended").withColumn("sank", F.lit(False)).unionByName(going))
        still = moved.filter("NOT ended").agg(F.count("*").alias("n"), F.coalesce(F.bool_or("sank"), F.lit(False)).alias("sank")).first()
        steps = moved.drop("sank")
        # Every open run ends for some more nodes in each round; where none does, only rings are open.
        if still["n"] == 0 or (still["n"] == open_before and not still["sank"]):
            break
        open_before = still["n"]
    rings = steps.filter("NOT ended").select("node", F.col("low").alias("cycle_id"))
    runs = steps.filter("ended").select("node", F.col("to").alias("tail")).join(inner, "node")
    outside = runs.join(known, runs["prev"] == known["at"], "left")
    # A run has one first node (its predecessor is no inner node) and one last node (its own tail).
    spans = outside.groupBy("tail").agg(
        F.max(F.when(F.col("there").isNull(), F.col("prev"))).alias("src"), F.max(F.when(F.col("node") == F.col("tail"), F.col("next"))).alias("dst")
    )
    spans = cut_lineage(spans)
    members = cut_lineage(runs.select("node", "tail").join(spans, "tail").select("node", "src", "dst"))
    rest = missing(missing(edges, inner, ["src"], ["node"]), inner, ["dst"], ["node"])
    left = cut_lineage(rest.unionByName(spans.filter("src <> dst").select("src", "dst")).distinct())
    closed = spans.filter("src = dst").select(F.col("src").alias("node")).distinct()
    return left, members, closed, cut_lineage(rings)


def _carried(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``carried``: the largest ``column`` in the chunks before their own; one row per chunk is carried over."""
    tops = rows.groupBy("chunk").agg(F.max(column).alias("top"))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(tops.select("chunk", F.max("top").over(earlier).alias("carried"))), "chunk")


def _within_spans(edges: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle as far as the order of their nodes tells, for edges without loops.

    A cycle with nodes below and above some place in the order returns over that place by an edge from a larger to a smaller
    node. Nodes are cut into spans where no such edge passes; edges between spans are on no cycle. One sweep over the sorted
    nodes, in chunks, finds the spans: a node starts one if no node before it is the end of an edge from it or from beyond.
    """
    ends = F.array(
        F.struct(F.col("dst").alias("node"), F.when(F.col("src") > F.col("dst"), F.col("src")).alias("back")),
        F.struct(F.col("src").alias("node"), F.lit(None).alias("back")),
    )
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.max("back").alias("back"))
    nodes = stored(nodes.repartitionByRange("node").withColumn("chunk", F.spark_partition_id()), "nodes")
    chunk = Window.partitionBy("chunk").orderBy("node")
    passed = F.greatest("carried", F.max("back").over(chunk.rowsBetween(Window.unboundedPreceding, -1)))
    first = F.when(F.coalesce(passed < F.col("node"), F.lit(True)), F.col("node"))
    marks = stored(_carried(nodes, "back").select("node", "chunk", first.alias("first")), "marks")
    span = F.greatest("carried", F.max("first").over(chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = stored(_carried(marks, "first").select("node", span.alias("span")), "spans")
    wide = spans.groupBy("span").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    spans = stored(spans.join(wide, "span", "left_semi").select("node", "span"), "spans")
    known = small_side(spans)
    inside = edges.join(known.toDF("src", "src_span"), "src").join(known.toDF("dst", "dst_span"), "dst")
    return cut_lineage(inside.filter("src_span = dst_span").select("src", "dst"))


def _groups_by_colour(edges: DataFrame) -> DataFrame | None:
    """Groups (node, cycle_id) of nodes that all reach each other, for edges without loops; None if there are none.

    Every node takes the largest node that reaches it as its colour; the part of a colour that also reaches back to its
    root is one group. What is left is coloured again.
    """
    groups = None
    while not edges.isEmpty():
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        colour = _spread(cut_lineage(nodes.withColumn("label", F.col("node"))), edges, "src", "dst")
        ends = colour.withColumnRenamed("label", "colour")
        inner = cut_lineage(
            edges.join(ends.withColumnRenamed("node", "src").withColumnRenamed("colour", "src_colour"), "src")
            .join(ends.withColumnRenamed("node", "dst").withColumnRenamed("colour", "dst_colour"), "dst")
            .filter("src_colour = dst_colour").select("src", "dst")
        )
        # Backwards from each root, inside its colour.
        marks = cut_lineage(ends.select("node", F.when(F.col("node") == F.col("colour"), 1).otherwise(0).alias("label")))
        hit = _spread_from_marked(marks, inner).filter("label = 1").select("node")
        found = cut_lineage(ends.join(hit, "node", "left_semi"))
        sized = found.groupBy("colour").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("cycle_id")).filter("n > 1")
        members = cut_lineage(found.join(sized, "colour").select("node", "cycle_id"))
        groups = members if groups is None else groups.unionByName(members)
        edges = cut_lineage(present_both_ways(missing(missing(edges, found, ["src"], ["node"]), found, ["dst"], ["node"])))
    return groups


def find_cycles(refs: DataFrame, least_folded: int = 16) -> DataFrame:
    """Nodes that lie on a cycle of ``refs`` (src, dst), with the smallest node of their cycle group as cycle_id.

    Edges between nodes that the order of the nodes already keeps apart go at once, so where references mostly point one way
    in that order, the rounds do not follow their depth. The rest shrinks in rounds: nodes no cycle can use (nothing in, or nothing out) are peeled off, and runs of nodes with one
    edge in and one out become one edge. A chain of n nodes takes log2(n) rounds of jumps, not n. What no round shrinks is
    split by colours; then the runs are unfolded again, the last first: their nodes belong to the group that holds both ends.
    Work per round is linear in the edges left; no closure is built. Null ends are no edges. Fewer than ``least_folded``
    nodes in runs stay as they are: walking them takes no more rounds than folding them; the groups are the same.
    """
    every = stored(refs.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "edges")
    loops = every.filter("src = dst").select(F.col("src").alias("node"))
    edges = every.filter("src <> dst")
    kept = edges.limit(0).select(F.col("src").alias("node"), F.col("src").alias("cycle_id"))
    folded = []
    size = edges.count()
    if size:
        edges = _within_spans(edges)
        size = edges.count()
    spanned = size
    while size:
        edges = cut_lineage(present_both_ways(edges))
        before, size = size, edges.count()
        # While peeling takes an eighth of the edges or more, its rounds are few by themselves.
        if size <= before - before // 8 - 1:
            continue
        # Fewer edges may leave narrower spans; looked at again each time half of the edges have gone.
        if size and size <= spanned // 2:
            edges = _within_spans(edges)
            size = spanned = edges.count()
            continue
        shorter = _compress(edges, least_folded) if size else None
        if shorter is not None:
            edges, *unfold = shorter
            folded.append(unfold)
            size = edges.count()
        elif size == before:
            break
    core = _groups_by_colour(edges) if size else None
    groups = kept if core is None else core
    for members, closed, rings in reversed(folded):
        alone = missing(closed, groups, ["node"]).select("node", F.col("node").alias("cycle_id"))
        groups = groups.unionByName(alone)
        first = groups.select(F.col("node").alias("src"), "cycle_id")
        second = groups.select(F.col("node").alias("dst"), F.col("cycle_id").alias("other"))
        between = members.join(first, "src").join(second, "dst").filter("cycle_id = other").select("node", "cycle_id")
        groups = cut_lineage(groups.unionByName(between).unionByName(rings))
    # Unfolded nodes may be smaller than the node that named their group.
    least = groups.groupBy("cycle_id").agg(F.min("node").alias("least"))
    groups = cut_lineage(groups.join(least, "cycle_id").select("node", F.col("least").alias("cycle_id")))
    return groups.unionByName(missing(loops, groups, ["node"]).select("node", F.col("node").alias("cycle_id")))


def _spread_from_marked(marks: DataFrame, edges: DataFrame) -> DataFrame:
    """Mark every node from which a marked node is reached over ``edges``."""
    links = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    active = cut_lineage(marks.filter("label = 1").select("node"))
    done = active
    while not active.isEmpty():
        step = links.join(active, links["a"] == active["node"], "left_semi").select(F.col("b").alias("node")).distinct()
        active = cut_lineage(missing(step, done, ["node"]))
        done = done.unionByName(active)
    return done.select("node", F.lit(1).alias("label"))


def present_both_ways(edges: DataFrame) -> DataFrame:
    """Edges whose source is also a target and whose target is also a source."""
    sources = edges.select(F.col("src").alias("node")).distinct()
    targets = edges.select(F.col("dst").alias("node")).distinct()
    inside = edges.join(targets.withColumnRenamed("node", "src"), "src", "left_semi")
    return inside.join(sources.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


# ---- visibility built on reachability ---------------------------------------


def dimension_matrix(metrics: DataFrame, models: DataFrame, dimensions: DataFrame, edges: DataFrame) -> DataFrame:
    """For every given metric, each dimension: visible, or excluded with the reason.

    ``metrics``: metric, model, grain; ``models``: model, grain; ``dimensions``: model, dimension;
    ``edges``: child, parent, .... Reasons in order: no_relationship_path,
    metric_grain_unknown, grain_incompatible. Rows are one per (metric, reachable
    dimension); unreachable dimensions are listed per metric by anti join, so
    pass the metrics a user is looking at rather than all of them.
    """
    from .checks import grain_relation

    reach = reachable(edges, metrics.select(F.col("model").alias("start")))
    base = metrics.select("metric", F.col("model").alias("start"), F.col("grain").alias("metric_grain"))
    reached = (
        base.join(reach.select("start", F.col("node").alias("model"), "hops", "path", "all_explicit"), "start")
        .join(models.select("model", F.col("grain").alias("dim_grain")), "model", "left")
        .join(dimensions, "model")
    )
    relation = grain_relation(F.col("dim_grain"), F.col("metric_grain"))
    known = F.coalesce(F.size("metric_grain"), F.lit(0)) > 0
    open_grain = F.coalesce(F.size("dim_grain"), F.lit(0)) <= 0
    reason = F.when(~known, "metric_grain_unknown").when(~open_grain & (relation == "grain_incompatible"), "grain_incompatible")
    return reached.select(
        "metric", "dimension", "model", "hops", "path", reason.isNull().alias("visible"), reason.alias("reason"),
        F.when(F.col("all_explicit"), "explicit").otherwise("inferred").alias("relationship_type"),
    )


def unreached_dimensions(matrix: DataFrame, dimensions: DataFrame, metric: str) -> DataFrame:
    """Dimensions no path leads to from ``metric``."""
    seen = matrix.filter(F.col("metric") == metric).select("dimension").distinct()
    return missing(dimensions.select("dimension").distinct(), seen, ["dimension"]).select(
        F.lit(metric).alias("metric"), "dimension", F.lit("no_relationship_path").alias("reason")
    )


def metric_matrix(metrics: DataFrame, base_grain: Column) -> DataFrame:
    """How each metric goes with a base metric of grain ``base_grain``: one pass over the metrics."""
    from .checks import grain_relation

    return metrics.select("metric", "model", grain_relation(F.col("grain"), base_grain).alias("relation"))


def joint_groups(metrics: DataFrame) -> DataFrame:
    """Metrics that may be queried together share the same set of grain columns: one row per set."""
    key = F.array_join(F.array_sort("grain"), ",")
    return (
        metrics.filter("size(grain) > 0").groupBy(key.alias("grain")).agg(F.count(F.lit(1)).alias("metric_count"))
    )


def rollup_pairs(metrics: DataFrame) -> DataFrame:
    """Which grains roll up to which: grain, base_grain, relation, metric_count, base_metric_count.

    ``metrics``: metric, grain. One row per pair of distinct grains where the first is within the second
    (``rollup_safe``) or both are the same (``shared_grain``). Metrics without a grain, or with an empty one, have no row;
    repeated and null columns of a grain do not count. Grains meet as a containment join: a grain is looked up under its
    rarest column only, and every base that holds this column is compared in full; no metrics are paired.
    """
    clean = F.array_sort(F.array_distinct(F.array_compact("grain")))
    grains = cut_lineage(
        metrics.select(clean.alias("grain")).filter("size(grain) > 0").groupBy("grain").agg(F.count(F.lit(1)).alias("metric_count"))
    )
    columns = grains.select("grain", "metric_count", F.explode("grain").alias("column"))
    frequency = columns.groupBy("column").agg(F.count(F.lit(1)).alias("n_grains"))
    rarest = (
        columns.join(frequency, "column").groupBy("grain", "metric_count")
        .agg(F.min(F.struct("n_grains", "column"))["column"].alias("column"))
    )
    bases = columns.select("column", F.col("grain").alias("base_grain"), F.col("metric_count").alias("base_metric_count"))
    inside = (F.size("grain") <= F.size("base_grain")) & (F.size(F.array_except("grain", "base_grain")) == 0)
    relation = F.when(F.size("grain") == F.size("base_grain"), "shared_grain").otherwise("rollup_safe")
    return rarest.join(bases, "column").filter(inside).select("grain", "base_grain", relation.alias("relation"), "metric_count", "base_metric_count")
