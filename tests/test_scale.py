"""Shapes of plans and of intermediate tables that must not grow faster than the input."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallymark import MetricError, session
from tallymark.operators import constraints as K
from tallymark.operators import graph as G
from tallymark.operators import reach_index as R
from tallymark.operators.reach_index import leads_to, reach_index
from tallymark.session import shared_folder


def executed(df):
    """The rows, and the plan they were made by."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_inferred_keys_are_not_broadcast(spark):
    """Similar names pack so well that a whole catalog passes for a small side; the driver must not gather it."""
    rows = [(f"t{i}", c) for i in range(300) for c in ("id", f"t{i + 1}_id")]
    catalog = spark.createDataFrame(rows, "table_name string, column_name string").repartition(4)
    known = spark.createDataFrame([("t0", "t1_id")], "table_name string, column_name string").repartition(2)
    got, plan = executed(K.infer_fks(catalog, known))
    assert {(r["model_name"], r["to_table"]) for r in got} == {(f"t{i}", f"t{i + 1}") for i in range(1, 299)}
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def folder_bytes(spark):
    root = Path(shared_folder(spark).removeprefix("file://").removeprefix("file:"))
    return sum(p.stat().st_size for p in root.rglob("*") if p.is_file())


def test_many_starts_leave_no_table_per_hop(spark):
    """Starts that share what they lead to: less is kept on disk than a few bytes for each row of the result."""
    edges = [(f"o{i}", f"c{(i * 7 + k) % 40}") for i in range(4000) for k in range(3)] + [(f"c{i}", f"n{i % 5}") for i in range(40)] + [(f"n{i}", "r") for i in range(5)]
    frame = spark.createDataFrame(edges, "child string, parent string")
    starts = spark.createDataFrame([(f"o{i}",) for i in range(4000)], "start string")
    before = folder_bytes(spark)
    got = G.reachable(frame, starts)
    rows = got.count()
    assert rows == 4000 * (1 + 3 + 3 + 1)
    assert folder_bytes(spark) - before < 30 * rows


def shuffle_bytes(spark):
    """Bytes of the shuffles that stand on disk."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(p.stat().st_size for d in folders for p in Path(d.getPath()).rglob("shuffle_*.data"))


def test_stored_tables_leave_no_shuffle(spark):
    frame = spark.range(200_000).select((F.col("id") * 7919 % 100_003).alias("a"), F.col("id").cast("string").alias("b"))
    before = shuffle_bytes(spark)
    table = session.stored(frame.groupBy("a").agg(F.max("b").alias("b")), "table")
    for _ in range(100):  # they are taken away in the background
        if shuffle_bytes(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_bytes(spark) <= before
    assert table.count() == 100_003
    session.discard(table)
    assert not any(Path(f.removeprefix("file://")).exists() for f in table.inputFiles())


def test_starts_are_shuffled_by_edge_not_by_reached_node(spark, monkeypatch):
    """First edges lead to nodes that reach five more: what stands on disk follows the edges, not the rows of the result."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 30)
    monkeypatch.setattr(session, "SLICES", 2, raising=False)
    monkeypatch.setattr(G, "BROADCAST_ROWS", 64 * 60, raising=False)
    n = 20_000
    edges = [(f"o{i}", f"c{(i * 7 + k) % 40}") for i in range(n) for k in range(2)] + [(f"c{i}", "a") for i in range(40)] + list(zip("abcd", "bcde"))
    frame = spark.createDataFrame(edges, "child string, parent string").repartition(4)
    starts = spark.createDataFrame([(f"o{i}",) for i in range(n)], "start string")
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(1)
    before = folder_bytes(spark) + shuffle_bytes(spark)
    got = G.reachable(frame, starts)
    got.write.format("noop").mode("overwrite").save()
    assert folder_bytes(spark) + shuffle_bytes(spark) - before < 30 * len(edges)
    assert got.agg(F.count("*"), F.sum("path_count"), F.max("hops")).first()[:] == (n * (1 + 2 + 5), n * (1 + 2 + 5 * 2), 6)


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("seed", range(2))
def test_walks_met_in_slices_equal_walks_of_each_start(spark, monkeypatch, seed, few):
    """Nothing is broadcast by size, steps are made in slices, walks are kept in several lists."""
    pick = random.Random(seed)
    edges = [(f"n{pick.randrange(9, 24)}", f"n{pick.randrange(18)}", pick.choice(["explicit", "guess"]), pick.choice(["", "a", "b"]), "id") for _ in range(60)]
    edges += edges[:9] + [("n9", "", "explicit", "a", "id"), ("", "n2", "explicit", "b", "id"), ("n11", "n1", "guess", None, "id")]
    frame = spark.createDataFrame(edges, "child string, parent string, provenance string, fk string, pk string")
    starts = spark.createDataFrame([(f"n{i}",) for i in range(22)] + [(None,)], "start string")
    plain = G.reachable(frame, starts, least_shared=10**6).collect()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(session, "SLICES", 2)
    monkeypatch.setattr(G, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(G, "_SHARED_ROWS", 100)
    monkeypatch.setattr(G, "_CHUNK", 2)
    if few:
        monkeypatch.setattr(G, "BROADCAST_ROWS", 500)
    shared = G.reachable(frame, starts, least_shared=1).collect()
    assert sorted(map(str, shared)) == sorted(map(str, plain))


@pytest.mark.parametrize("seed", range(3))
def test_shared_walks_equal_walks_of_each_start(spark, seed):
    pick = random.Random(seed)
    edges = [(f"n{pick.randrange(20)}", f"n{pick.randrange(20)}", pick.choice(["explicit", "guess"]), pick.choice(["", "a", "b"]), "id") for _ in range(34)]
    edges += [(None, "n1", "explicit", "a", "id"), ("n1", None, "explicit", "a", "id")]
    frame = spark.createDataFrame(edges, "child string, parent string, provenance string, fk string, pk string")
    starts = spark.createDataFrame([(f"n{i}",) for i in range(22)] + [(None,)], "start string")
    plain = G.reachable(frame, starts, least_shared=10**6)
    deep = plain.agg(F.max("hops")).first()[0]
    for hops in (None, deep):
        shared = G.reachable(frame, starts, hops, least_shared=1)
        assert sorted(map(str, shared.collect())) == sorted(map(str, plain.collect()))
    with pytest.raises(MetricError):
        G.reachable(frame, starts, deep - 1, least_shared=1)


def test_starts_that_reach_too_much_walk_by_themselves(spark):
    """Every node of a chain leads to all later ones: nothing to share, the same rows."""
    frame = spark.createDataFrame([(i, i + 1) for i in range(30)], "child int, parent int")
    starts = spark.createDataFrame([(i,) for i in range(30)], "start int")
    got = {(r["start"], r["node"], r["hops"]) for r in G.reachable(frame, starts, least_shared=1).collect()}
    assert got == {(a, b, b - a) for a in range(30) for b in range(a, 31)}


def test_index_keeps_little_for_nodes_that_nothing_leads_to(spark):
    """Outer nodes keep their edges only; their labels are taken from their neighbours when the index is read."""
    edges = [(f"o{i}", f"c{(i * 7 + k) % 40}") for i in range(4000) for k in range(3)] + [(f"c{i}", f"n{i % 5}") for i in range(40)] + [(f"n{i}", "r") for i in range(5)]
    frame = spark.createDataFrame(edges, "child string, parent string")
    before = folder_bytes(spark)
    labels, groups = reach_index(frame)
    assert folder_bytes(spark) - before < 60 * len(edges)
    pairs = [(f"o{i}", end) for i in range(0, 4000, 400) for end in ("r", "n1", "c7", f"o{i}", f"o{i + 1}")]
    got = {(r["start"], r["target"]) for r in leads_to(spark.createDataFrame(pairs, "start string, target string"), (labels, groups)).filter("reaches").collect()}
    next_to = {f"o{i}": {f"c{(i * 7 + k) % 40}" for k in range(3)} for i in range(4000)}
    holds = lambda a, b: a == b or b == "r" or b in next_to[a] or any(f"n{int(c[1:]) % 5}" == b for c in next_to[a])
    assert got == {p for p in pairs if holds(*p)}


@pytest.mark.parametrize("few", [0, 500])
def test_pairs_answered_in_slices(spark, monkeypatch, few):
    """Nothing is broadcast by size, steps are made in slices, and no shuffle is left: pairs and edges stand on disk once or twice."""
    n = 8000
    edges = [(f"o{i}", f"c{(i * 7 + k) % 40}") for i in range(n) for k in range(3)] + [(f"c{i}", f"n{i % 5}") for i in range(40)] + [(f"n{i}", "r") for i in range(5)]
    edges += [("n1", "c3"), ("r", "end"), ("r", "r"), (None, "r"), ("c1", None)] + edges[:50]  # n1, c1, c3 and others on a cycle
    pairs = [(f"o{i}", end, i) for i in range(n) for end in ("r", "n1", f"c{i % 40}", "end")] + [("c3", "n1", 1), ("n1", "c3", 1), ("c2", "c3", 2), ("end", "r", 3), ("x", "x", 4)]
    pairs += [*pairs[:3], (None, "r", 5), ("r", None, 5)]
    frame = spark.createDataFrame(edges, "child string, parent string").repartition(4)
    asked = spark.createDataFrame(pairs, "start string, target string, payload int").repartition(4)
    monkeypatch.setattr(session, "BROADCAST_ROWS", few)
    monkeypatch.setattr(session, "SLICES", 2, raising=False)
    monkeypatch.setattr(R, "BROADCAST_ROWS", few)
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(1)
    before = folder_bytes(spark) + shuffle_bytes(spark)
    answers = leads_to(asked, reach_index(frame))
    answers.write.format("noop").mode("overwrite").save()
    assert folder_bytes(spark) + shuffle_bytes(spark) - before < 20 * (len(edges) + len(pairs))
    next_to = {}
    for a, b in edges:
        next_to.setdefault(a, set()).add(b)
    reach = {}
    for a in {a for a, _, _ in pairs}:
        reach[a], todo = {a}, [a]
        while todo:
            new = next_to.get(todo.pop(), set()) - reach[a] - {None}
            reach[a] |= new
            todo += new
    wanted = [(a, b, x, a is not None and b is not None and b in reach[a]) for a, b, x in pairs]
    assert sorted(map(str, map(tuple, answers.collect()))) == sorted(map(str, wanted))
