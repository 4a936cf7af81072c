"""An index that answers "does a lead to b" for many pairs at once, without a row per (start, reachable node)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, discard, in_slice, slices_for, small_side, stored, stored_slices
from .graph import find_cycles
from .joins import missing

_KEY = ["way", "hub", "node"]


def _named(rows: DataFrame, groups: DataFrame | None, end: str, to: str) -> DataFrame:
    """``rows`` with column ``to``: the group that node ``end`` belongs to, or the node itself."""
    if groups is None:
        return rows.withColumn(to, F.col(end))
    own = groups.select(F.col("node").alias(end), F.col("cycle_id").alias("own_group"))
    return rows.join(own, end, "left").withColumn(to, F.coalesce("own_group", end)).drop("own_group")


def _sides(groups: DataFrame) -> DataFrame | None:
    """Groups as one side of joins; None if there are none, so that nothing is shuffled for them."""
    return None if groups.isEmpty() else small_side(groups)


def _walked_labels(links: DataFrame, weights: DataFrame) -> DataFrame:
    """Labels (way, hub, node) of ``links`` (src, dst) without cycles, short of each node's own; ``weights``: node, weight."""
    side = lambda end: weights.select(F.col("node").alias(end), F.col("weight").alias(f"{end}_weight"))
    ranked = links.join(side("src").hint("merge"), "src").join(side("dst").hint("merge"), "dst")
    both = F.array(
        F.struct(F.lit("from").alias("way"), F.col("src").alias("at"), F.col("src_weight").alias("at_weight"), F.col("dst").alias("next"), F.col("dst_weight").alias("next_weight")),
        F.struct(F.lit("to").alias("way"), F.col("dst").alias("at"), F.col("dst_weight").alias("at_weight"), F.col("src").alias("next"), F.col("src_weight").alias("next_weight")),
    )
    lower = F.struct(F.col("next_weight"), F.col("next")) < F.struct(F.col("hub_weight"), F.col("hub"))
    steps = stored(ranked.select(F.inline(both)), "steps")
    frontier = stored(
        steps.withColumn("hub", F.col("at")).withColumn("hub_weight", F.col("at_weight")).filter(lower)
        .select("way", "hub", F.col("next").alias("node"), "hub_weight"), "labels"
    )
    labels = frontier
    hops = 1
    while rows := frontier.count():
        onward = steps.select("way", F.col("at").alias("node"), "next", "next_weight")
        found = small_side(frontier, rows).join(onward, ["way", "node"]).filter(lower).select("way", "hub", F.col("next").alias("node"), "hub_weight")
        frontier = stored(missing(found.dropDuplicates(_KEY), labels.hint("merge"), _KEY), "labels")
        labels = labels.unionByName(frontier)
        hops += 1
        if hops % 16 == 0:
            labels = stored(labels, "labels")
    labels = stored(labels.select(*_KEY), "labels")
    # A hub that has a higher one between itself and the labelled node adds nothing.
    opposite = F.when(F.col("way") == "to", "from").otherwise("to")
    above = labels.select(opposite.alias("way"), F.col("node").alias("hub"), F.col("hub").alias("higher"))
    between = labels.join(above.hint("merge"), ["way", "hub"]).join(
        labels.select("way", F.col("hub").alias("higher"), "node").hint("merge"), ["way", "higher", "node"], "left_semi"
    )
    return stored(missing(labels, between.hint("merge"), _KEY), "labels")


def _dealt(rows: DataFrame) -> DataFrame:
    """Distinct links (src, dst) with ``n_in``: how many ``rows`` lead to src, null if none does."""
    rows = stored(rows, "rows")
    n = slices_for(rows.count())

    def dealt(k: int) -> DataFrame:
        into = rows.filter(in_slice("dst", k, n)).groupBy(F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("n_in"))
        # Folding and the join share one shuffle of the links.
        links = rows.filter(in_slice("src", k, n)).repartition("src").distinct()
        return links.join(into.hint("merge"), "src", "left")

    found = stored_slices(dealt, "dealt", n)
    discard(rows)
    return found


def reach_index(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (way, hub, node) and groups (node, cycle_id) of child -> parent edges.

    Cycles are folded to one node first. Nodes are ranked by (edges in + 1) * (edges out + 1), parallel edges in counted as
    often as they are given, equal ones by name. Each node with edges both in and out is a hub that walks both ways through
    such nodes of lower rank only and labels them: ``to`` where the node leads to the hub, ``from`` where the hub leads to it.
    The highest node of any path labels both its ends, so a pair is connected exactly if its labels share a hub, each node
    also being a hub of its own without a label. All hubs walk at once, a hop a round; a label is dropped again if a higher
    hub stands between its two ends. Nodes that nothing leads to, or that lead to nothing, stand on no path between others:
    they take the labels of the nodes next to them, where the index is read, and only their edges are kept; one such label
    may come up more than once. Null ends and edges from a node to itself are no edges.
    """
    dealt = _dealt(edges.filter("child <> parent").select(F.col("child").alias("src"), F.col("parent").alias("dst")))
    outer = dealt.filter("n_in IS NULL").select("src", "dst")
    onward = stored(dealt.filter("n_in IS NOT NULL"), "onward")
    nodes = stored(onward.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.max("n_in").alias("n_in")), "nodes")
    ends = nodes.select(F.col("node").alias("dst"), F.lit(True).alias("middle"))
    onward = stored(onward.select("src", "dst").join(small_side(ends), "dst", "left"), "onward")
    inner = onward.filter("middle").select("src", "dst")
    last = onward.filter("middle IS NULL").select("src", "dst")
    groups = stored(find_cycles(inner), "groups")
    side = _sides(groups)
    if side is not None:
        inner = stored(
            _named(_named(inner, side, "src", "a"), side, "dst", "b").select(F.col("a").alias("src"), F.col("b").alias("dst")).filter("src <> dst").distinct(), "inner"
        )
        n = slices_for(dealt.count())
        renamed = lambda k: _named(outer.filter(in_slice("dst", k, n)), side, "dst", "b").select("src", F.col("b").alias("dst"))
        outer = stored_slices(renamed, "outer", n)
        discard(dealt)
        last = stored(_named(last, side, "src", "a").select(F.col("a").alias("src"), "dst"), "last")
        nodes = stored(
            _named(nodes, side, "node", "own").groupBy(F.col("own").alias("node")).agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in")), "nodes"
        )
    weights = nodes.select("node", ((F.col("n_out") + 1).cast("double") * (F.col("n_in") + 1)).alias("weight"))
    walked = _walked_labels(inner, weights)
    ahead = walked.filter("way = 'to'").select("hub", F.col("node").alias("dst"))
    behind = walked.filter("way = 'from'").select("hub", F.col("node").alias("src"))
    taken = [
        outer.select(F.lit("to").alias("way"), F.col("dst").alias("hub"), F.col("src").alias("node")),
        outer.join(small_side(ahead), "dst").select(F.lit("to").alias("way"), "hub", F.col("src").alias("node")),
        last.select(F.lit("from").alias("way"), F.col("src").alias("hub"), F.col("dst").alias("node")),
        last.join(small_side(behind), "src").select(F.lit("from").alias("way"), "hub", F.col("dst").alias("node")),
    ]
    return reduce(DataFrame.unionByName, [walked, *taken]), groups


def leads_to(pairs: DataFrame, index: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``pairs`` (start, target, ...) with ``reaches``: whether any path leads from start to target.

    A node reaches itself, also one without edges; a null reaches nothing. Each pair is spread over the hubs of the end that
    has fewer of them in the index, and looked up among the labels of the other: two joins on labels, whatever the paths'
    length. Pairs are looked up, and then answered, in slices of that end, one slice on disk at a time, and the answers stored.
    """
    labels, groups = index
    side = _sides(groups)
    asked = stored(pairs if side is None else _named(pairs, side, "start", "_a"), "pairs")
    if side is None:
        mapped = asked.withColumns({"_a": F.col("start"), "_b": F.col("target")})
    else:
        first, mapped = asked, stored(_named(asked, side, "target", "_b"), "pairs")
        discard(first)
        asked = mapped
    others = {way: labels.filter(F.col("way") == way).select("hub", "node") for way in ("from", "to")}
    few = next((way for way in others if others[way].limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS), None)
    spread = few or min(others, key=lambda way: others[way].count())
    near, far = ("_b", "_a") if spread == "from" else ("_a", "_b")
    hubs = others[spread].select("hub", F.col("node").alias(near))
    opposite = others["to" if spread == "from" else "from"].select("hub", F.col("node").alias(far))
    n = slices_for(asked.count())

    def hit(k: int) -> DataFrame:
        mine = mapped.filter(in_slice(far, k, n)).select(far, near)
        met = mine.join(F.broadcast(hubs) if few else hubs.hint("merge"), near).select(far, near, "hub")
        # Each end is a hub of its own: the near one is looked up like the others, the far one equals a hub.
        looked_up = mine.withColumn("hub", F.col(near)).unionByName(met)
        found = looked_up.join(opposite.filter(in_slice(far, k, n)).hint("merge"), [far, "hub"], "left_semi")
        return found.select(far, near).unionByName(met.filter(F.col("hub") == F.col(far)).select(far, near)).distinct()

    hits = stored_slices(hit, "hits", n)

    def answered(k: int) -> DataFrame:
        known = hits.filter(in_slice(far, k, n)).select(F.col("_a").alias("hit_a"), F.col("_b").alias("hit_b")).hint("merge")
        found = mapped.filter(in_slice(far, k, n)).join(known, (F.col("_a") == F.col("hit_a")) & (F.col("_b") == F.col("hit_b")), "left")
        reaches = F.col("hit_a").isNotNull() | F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
        return found.select(*[F.col(f"`{c}`") for c in pairs.columns], reaches.alias("reaches"))

    found = stored_slices(answered, "answers", n)
    discard(asked)
    discard(hits)
    return found
