"""Cycles in few rounds, the reachability index and grains within grains against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import graph as G
from tallymark.operators.reach_index import leads_to, reach_index


def closure(edges):
    """All (a, b) with a path of at least one edge."""
    reach = {a: set() for e in edges for a in e}
    for a, b in edges:
        reach[a].add(b)
    for _ in reach:
        for a in reach:
            reach[a] = reach[a].union(*[reach[b] for b in reach[a]])
    return reach


def cycle_groups(edges):
    reach = closure(edges)
    return {(a, min(b for b in reach[a] if a in reach[b])) for a in reach if a in reach[a]}


def shapes():
    ring = [(i, (i + 1) % 7) for i in range(7)]
    return {
        "ring": ring,
        "two rings that share a node": ring + [(3, 11), (11, 12), (12, 3)],
        "ring with a chord": ring + [(2, 5)],
        "runs between two nodes": [(10, 1), (1, 2), (2, 20), (10, 3), (3, 20), (20, 5), (5, 6), (6, 10), (20, 30), (30, 31)],
        "run within a run": [(9, 1), (1, 2), (2, 9), (9, 4), (4, 8), (8, 3), (3, 4), (8, 9)],
        "own loops": [(1, 1), (1, 2), (2, 3), (3, 3), (4, 5), (5, 4), (5, 5)],
        "no cycle": [(1, 2), (2, 3), (1, 3), (3, 4)],
        "none": [],
    }


@pytest.mark.parametrize("name", list(shapes()))
def test_cycles_of_shapes(spark, name):
    edges = shapes()[name]
    got = G.find_cycles(spark.createDataFrame([*edges, *edges[:1], (None, 1), (1, None)], "src int, dst int"), least_folded=1)
    assert sorted(tuple(r) for r in got.select("node", "cycle_id").collect()) == sorted(cycle_groups(edges))


@pytest.mark.parametrize("seed", range(4))
def test_cycles_of_sparse_graphs(spark, seed):
    pick = random.Random(seed)
    edges = [(pick.randrange(30), pick.randrange(30)) for _ in range(36)]
    for least in (1, 16):
        got = G.find_cycles(spark.createDataFrame(edges, "src int, dst int"), least)
        assert {tuple(r) for r in got.select("node", "cycle_id").collect()} == cycle_groups(edges)


def test_long_chain_and_long_ring_take_few_rounds(spark, monkeypatch):
    n = 4096
    names = list(range(2 * n))
    random.Random(5).shuffle(names)
    chain = [(names[i], names[i + 1]) for i in range(n - 1)]
    ring = [(names[n + i], names[n + (i + 1) % n]) for i in range(n)]
    cuts = []
    plain = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: cuts.append(1) or plain(df))
    got = G.find_cycles(spark.createDataFrame(chain + ring, "src int, dst int")).groupBy("cycle_id").agg(F.count("*").alias("n")).collect()
    assert [tuple(r) for r in got] == [(min(names[n:]), n)]
    # log2(4096) = 12 rounds of jumps; the rest is a fixed number of steps around them.
    assert len(cuts) <= 30


def test_deep_references_in_order_take_few_rounds(spark, monkeypatch):
    n = 400  # peeled from both ends, 400 nodes deep, it took some hundred rounds
    forward = [(f"n{i:04}", f"n{i + step:04}") for i in range(n) for step in (1, 2, 3)]
    ring = [("n0100", "n0098"), ("n0103", "n0100"), ("n0300", "n0299")]
    cuts = []
    plain = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: cuts.append(1) or plain(df))
    got = G.find_cycles(spark.createDataFrame(forward + ring, "src string, dst string")).collect()
    assert {tuple(r) for r in got} == {(f"n{i:04}", "n0098") for i in range(98, 104)} | {("n0299", "n0299"), ("n0300", "n0299")}
    assert len(cuts) <= 30


@pytest.mark.parametrize("seed", range(4))
def test_spans_keep_every_cycle(spark, seed):
    pick = random.Random(seed)
    edges = {(a, a + pick.randrange(1, 9)) for a in (pick.randrange(60) for _ in range(70))}
    edges |= {(a, a - pick.randrange(1, 6)) for a in (pick.randrange(6, 60) for _ in range(9))}
    left = [tuple(r) for r in G._within_spans(spark.createDataFrame(sorted(edges), "src int, dst int")).collect()]
    passed = {k for a, b in edges if b < a for k in range(b, a)}  # places between k and k + 1 that an edge returns over
    assert sorted(left) == sorted((a, b) for a, b in edges if passed.issuperset(range(min(a, b), max(a, b))))
    assert cycle_groups(left) == cycle_groups(sorted(edges))


@pytest.mark.parametrize("seed", range(3))
def test_index_answers_every_pair(spark, seed):
    pick = random.Random(seed)
    edges = [(f"n{pick.randrange(24)}", f"n{pick.randrange(24)}") for _ in range(30)]
    # A hub that a third of all nodes lead to.
    edges += [(f"n{i}", "top") for i in range(0, 24, 3)] + [("top", "end")]
    reach = closure(edges)
    nodes = [*sorted(reach), "alone"]
    pairs = [(a, b, "x") for a in nodes for b in nodes]
    frame = spark.createDataFrame([*pairs, pairs[0], (None, "n1", "y"), ("n1", None, "y"), (None, None, "y")], "start string, target string, hub string")
    index = reach_index(spark.createDataFrame([*edges, (None, "n1"), ("n1", None), ("n2", "n2")], "child string, parent string"))
    got = leads_to(frame, index).collect()
    assert len(got) == len(pairs) + 4
    wanted = lambda a, b: a is not None and b is not None and (a == b or b in reach.get(a, ()))
    assert [r for r in got if r["reaches"] != wanted(r["start"], r["target"])] == []
    assert {r["hub"] for r in got} == {"x", "y"}


def test_index_stays_small_on_a_chain_of_hubs(spark):
    """Orders that lead to one hub and on: a label per order, not one per (order, node beyond the hub)."""
    edges = [(f"o{i}", "hub") for i in range(200)] + [("hub", "b0")] + [(f"b{i}", f"b{i + 1}") for i in range(20)]
    labels, _ = reach_index(spark.createDataFrame(edges, "child string, parent string"))
    assert labels.filter("node LIKE 'o%' AND hub <> node").count() == 200


def test_index_of_no_edges(spark):
    index = reach_index(spark.createDataFrame([], "child string, parent string"))
    pairs = spark.createDataFrame([("a", "a"), ("a", "b")], "start string, target string")
    assert {tuple(r) for r in leads_to(pairs, index).collect()} == {("a", "a", True), ("a", "b", False)}


def test_rollup_pairs_match_all_pairs(spark):
    pick = random.Random(3)
    grains = [pick.sample("abcdefg", pick.randrange(1, 6)) for _ in range(60)]
    rows = [(f"m{i}", g + ([g[0], None] if i % 7 == 0 else [])) for i, g in enumerate(grains)]
    frame = spark.createDataFrame([*rows, ("none", []), ("null", None), ("nulls", [None])], "metric string, grain array<string>")
    count = {}
    for g in grains:
        count[frozenset(g)] = count.get(frozenset(g), 0) + 1
    wanted = {
        (tuple(sorted(a)), tuple(sorted(b)), "shared_grain" if a == b else "rollup_safe", count[a], count[b]) for a in count for b in count if a <= b
    }
    got = [(tuple(r["grain"]), tuple(r["base_grain"]), r["relation"], r["metric_count"], r["base_metric_count"]) for r in G.rollup_pairs(frame).collect()]
    assert len(got) == len(wanted) and set(got) == wanted
