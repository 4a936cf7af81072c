"""Graph, window, glossary, state and streaming jobs against brute force on small inputs."""

from __future__ import annotations

import difflib
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallymark.operators import glossary as C
from tallymark.operators import graph as G
from tallymark.operators import snapshots as S
from tallymark.operators import windows as W
from tallymark.operators.aggregates import profile
from tallymark.operators.usage import daily_usage, match_usage, usage_daily
from tallymark.functions.text import sql_fingerprint
from tallymark.session import broadcast_limit, scratch_path, shared_folder
from tallymark.sources import corpus, documents, state
from tallymark.streaming.usage import read_usage, usage_stream


def random_edges(seed, nodes=14, count=22):
    pick = random.Random(seed)
    return [(pick.randrange(nodes), pick.randrange(nodes)) for _ in range(count)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles_match_closure(spark, seed):
    edges = random_edges(seed)
    reach = {a: {b for x, b in edges if x == a} for a in range(14)}
    for _ in range(14):
        for a in reach:
            reach[a] |= {c for b in list(reach[a]) for c in reach[b]}
    expected = {(a, min(b for b in reach[a] if a in reach[b])) for a in reach if a in reach[a]}
    got = G.find_cycles(spark.createDataFrame(edges, "src int, dst int"))
    assert {tuple(r) for r in got.select("node", "cycle_id").collect()} == expected


def test_no_cycles(spark):
    assert G.find_cycles(spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src int, dst int")).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_reachable_matches_breadth_first(spark, seed):
    edges = [(f"n{a}", f"n{b}") for a, b in random_edges(seed)]
    frontier, seen, hops = {"n0"}, {"n0": 0}, 0
    while frontier:
        hops += 1
        frontier = {b for a, b in edges if a in frontier and b not in seen}
        seen.update({n: hops for n in frontier})
    starts = spark.createDataFrame([("n0",)], "start string")
    got = G.reachable(spark.createDataFrame(edges, "child string, parent string"), starts).collect()
    assert {r["node"]: r["hops"] for r in got} == seen
    assert all(r["path"].split(" -> ")[-1] == r["node"] for r in got)


def test_explicit_edge_outranks_inferred(spark):
    edges = spark.createDataFrame(
        [("a", "b", "depends_on", "", ""), ("a", "b", "explicit", "b_id", "id"), ("b", "c", "depends_on", "", "")],
        "child string, parent string, provenance string, fk string, pk string")
    got = {r["node"]: r for r in G.reachable(edges, spark.createDataFrame([("a",)], "start string")).collect()}
    assert got["b"]["all_explicit"] and got["b"]["join_keys"] == "a.b_id=b.id"
    assert not got["c"]["all_explicit"]
    assert [r["node"] for r in G.joinable(edges, "a").collect()] == ["b"]


def test_tied_paths_are_not_unique(spark):
    edges = spark.createDataFrame([("a", "x"), ("a", "y"), ("x", "z"), ("y", "z")], "child string, parent string")
    row = G.shortest_path(edges, "a", "z").first()
    assert (row["path"], row["path_count"], row["is_unique"]) == ("a -> x -> z", 2, False)


def test_chunked_windows_equal_one_window(spark):
    """One key holds most rows; chunks must not change the answer."""
    pick = random.Random(7)
    data = [(1 if pick.random() < 0.8 else pick.randrange(5), i, pick.choice([None, pick.randrange(100)])) for i in range(400)]
    df = spark.createDataFrame(data, "k int, t int, v int")
    got = {(r["t"], r["out"]) for r in W.last_value(df, "v", ["k"], ["t"], F.floor(F.col("t") / 9), "out").collect()}
    before = {(r["t"], r["prev"]["t"] if r["prev"] else None) for r in W.with_previous_row(df, ["t"], ["k"], ["t"], F.floor(F.col("t") / 9)).collect()}
    held, last, expected, steps = {}, {}, set(), set()
    for k, t, v in data:
        held[k] = v if v is not None else held.get(k)
        expected.add((t, held[k]))
        steps.add((t, last.get(k)))
        last[k] = t
    assert got == expected and before == steps


def test_latest_filters_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = W.latest(df, ["k"], ["v"])
    assert sorted(r["v"] for r in out.collect()) == [97, 98, 99]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


NAMES = ["Net Revenue", "net_revenue", "gross-margin", "customer churn", "Customers", "zzz", "", "active users"]
TERMS = [("Net Revenue", ["revenue, net"]), ("Churn", ["customer churn rate"]), ("Active User", []), ("Margin", ["gross margin"])]


def plain_align(name, terms, taken):
    """The maximum over all pairs of the name and a term's wording; the first term in order where several reach it."""
    squash = lambda s: " ".join(re.split(r"[\s_.-]+", s.lower())).strip()
    pairs = [(difflib.SequenceMatcher(None, squash(name), squash(w)).ratio(), term) for term, others in terms for w in [term, *others]]
    top = max((score for score, _ in pairs), default=0.0)
    if top < 0.5:
        return (name, "no_match", round(top, 2), None)
    term = min(t for score, t in pairs if score == top)
    clash = term.lower() != name.lower() and squash(name) in map(squash, taken)
    return (name, "conflict" if clash else "possible_duplicate" if top < 0.9 else "match", round(top, 2), term)


@pytest.mark.parametrize("block", [1, 3, 2000])
def test_align_matches_brute_force(spark, block):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    terms = spark.createDataFrame(TERMS, "term string, synonyms array<string>")
    taken = ["customer-churn", "Net Revenue"]
    got = C.align(names, terms, spark.createDataFrame([(t,) for t in taken], "name string"), block_terms=block)
    expected = {plain_align(n, TERMS, taken) for n in NAMES}
    assert {(r["name"], r["result"], r["confidence"], r["term"]) for r in got.collect()} == expected


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        above, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
    return row[-1]


def plain_align_by_distance(name, terms, taken):
    clean = lambda s: re.sub(r"\s+", " ", re.sub(r"[_\-.]+", " ", s.lower().strip()))
    pairs = [(1 - plain_distance(clean(name), clean(via)) / max(len(clean(name)), len(clean(via))), term, p, via)
             for term, synonyms in terms for p, via in enumerate([term, *synonyms]) if clean(via) and clean(name)]
    score, term, _, via = min(pairs, key=lambda r: (-r[0], *r[1:]), default=(0.0, None, 0, None))
    if score < 0.5:
        return (name, "no_match", 0.0, None, None)
    clash = clean(name) in {clean(t) for t in taken} and term.lower() != name.lower()
    return (name, "conflict" if clash else "match" if score >= 0.9 else "possible_duplicate", score, term, via)


def test_align_by_distance_matches_all_pairs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))) for _ in range(90)]
    terms = sorted({(w, tuple(rng.sample(words, rng.randint(0, 2)))) for w in words[:45]} | {("gross margin", ("margin",)), ("日本語 売上", ()), ("aaaa", ("aaab",))})
    terms = [(t, list(s)) for t, s in {t: s for t, s in terms}.items()]
    names = []
    for w in [*words, "gross_margin", "日本語-売", "aa", "aaaaaaaa", "", "zzzz"]:
        k = rng.randrange(len(w) + 1)
        names += [w, w[:k] + rng.choice("abxyz") + w[k:], w[:k] + w[k + 1 :], w[: len(w) // 2]]
    names = sorted(set(names))
    taken = names[::5]
    got = C.align_by_distance(
        spark.createDataFrame([(n,) for n in names] + [(names[3],)], "name string"), spark.createDataFrame(terms, "term string, synonyms array<string>"),
        spark.createDataFrame([(t,) for t in taken], "name string"))
    found = [(r["name"], r["result"], r["confidence"], r["term"], r["via"]) for r in got.collect()]
    assert len(found) == len(names) + 1 and set(found) == {plain_align_by_distance(n, terms, taken) for n in names}


def test_align_on_part_names(spark, tables):
    names = tables.part.select(F.concat("p_name", F.lit("_"), F.lower("p_type")).alias("name")).distinct()
    terms = tables.part.filter("p_size > 45").groupBy(F.col("p_name").alias("term")).agg(F.array(F.min("p_brand")).alias("synonyms"))
    known = [(r["term"], list(r["synonyms"])) for r in terms.collect()]
    expected = {plain_align(r["name"], known, []) for r in names.collect()}
    assert {(r["name"], r["result"], r["confidence"], r["term"]) for r in C.align(names, terms).collect()} == expected


def test_profile_modes_agree_on_small_data(tables):
    columns = ["c_custkey", "c_mktsegment"]
    exact = {tuple(r) for r in profile(tables.customer, columns).collect()}
    rough = {r["column_name"]: r for r in profile(tables.customer, columns, approximate=True).collect()}
    assert {r[0]: r[3] for r in exact} == {c: r["null_count"] for c, r in rough.items()}
    assert rough["c_mktsegment"]["cardinality"] == 5


def test_breaking_change_reasons(spark):
    schema = "name string, expression string, grain array<string>, dimensions array<string>, aggregation string, model string"
    old = spark.createDataFrame([("m", "sum(a)", ["x", "y"], ["d"], "sum", "t"), ("same", " a", ["y", "x"], None, "sum", "t")], schema)
    new = spark.createDataFrame([("m", "sum(b)", ["x"], ["d"], "avg", "t"), ("same", "a", ["x", " y"], [], "sum", "t")], schema)
    got = {r["name"]: (r["is_breaking"], r["reasons"]) for r in S.breaking_changes(old, new).collect()}
    assert got == {"m": (True, "expression changed; grain changed; aggregation changed"), "same": (False, "")}


def test_reconcile_force_replaces_changed_views(spark):
    desired = spark.createDataFrame([("v", "m", "1.0", "active", "SELECT 2", None)], "view_name string, metric_name string, metric_version string, status string, definition string, replacement string")
    deployed = desired.select("view_name", "metric_name", "metric_version", F.lit(False).alias("deprecated"), S.definition_hash(F.lit("SELECT 1")).alias("definition_hash"))
    assert [r["action"] for r in S.reconcile(desired, deployed).collect()] == ["conflict"]
    assert [r["action"] for r in S.reconcile(desired, deployed, force=True).collect()] == ["replace"]
    assert [r["action"] for r in S.reconcile(desired, deployed, replace=False).collect()] == ["create"]


def test_model_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"model": "orders", "metrics": [{"name": "n", "expression": "count(*)"}, {"name": "s", "version": "2.0"}],'
                                     ' "dimensions": ["status", ""], "entity": {"name": "orders", "pk": "id", "columns": ["id", "status"]}}')
    (tmp_path / "b.json").write_text('{"model": "orders2",\n "metrics": [{"name": "n", "status": "deprecated"}],\n "dimensions": ["status"],'
                                     ' "entity": {"name": "e2", "pk": ["a", "b"], "columns": [{"name": "status", "data_type": "CHAR", "is_pk": true}]}}')
    tables = documents.index_models(spark, str(tmp_path))
    metrics = {r["name"]: (r["model"], r["version"], r["status"]) for r in tables["metrics"].collect()}
    assert metrics == {"n": ("orders2", "1.0", "deprecated"), "s": ("orders", "2.0", "active")}
    entities = {r["name"]: (r["primary_key"], [c["name"] for c in r["columns"]]) for r in tables["entities"].collect()}
    assert entities == {"orders": (["id"], ["id", "status"]), "e2": (["a", "b"], ["status"])}
    linked = documents.dimension_catalog(
        tables["models"], tables["entities"], tables["metrics"].withColumn("dimensions", F.lit(None).cast("array<string>")))
    assert [(r["name"], r["entity_name"], r["data_type"]) for r in linked["dimensions"].collect()] == [("status", "orders", "TEXT")]


def test_sql_tree(spark, tmp_path):
    for name, text in {"m/a.sql": "-- metric: true\nselect 1", "m/b.sql": "delete", "tests/c.sql": "select 1", "m/test_d.sql": "select 1",
                       "m/e.sql": "{{ config(materialized='ephemeral') }} select 1", "m/f.txt": "select 1", "sp ace/g.sql": "SELECT 2"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    found = corpus.scan_corpus(corpus.read_tree(spark, str(tmp_path)))
    assert {(r["path"], tuple(r["tags"])) for r in found.collect()} == {("m/a.sql", ("metric",)), ("sp ace/g.sql", ())}


def test_state_is_idempotent(spark):
    path = scratch_path(spark, "state-test")
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 2}')], "version int, payload string")
    for _ in range(2):
        state.append_state(rows, path, "metric")
    assert state.read_state(spark, path).count() == 2
    assert state.read_state(spark, path + "-none") is None


@pytest.fixture()
def log(spark):
    rows = [(i, f"SELECT a FROM t WHERE d = '{i}' -- {i}" if i % 3 else "SELECT other", f"2024-01-{1 + i % 9:02d} 10:00:00") for i in range(60)]
    return spark.createDataFrame(rows + [(99, "  ", "2024-01-01 00:00:00")], "query_id long, query_text string, start_time string")


@pytest.fixture()
def registered(spark):
    return spark.createDataFrame([("SELECT a FROM t WHERE d = 'x'", "m", "1.0", True)], "q string, metric_name string, metric_version string, deprecated boolean").select(
        sql_fingerprint(F.col("q")).alias("fingerprint"), "metric_name", "metric_version", "deprecated")


def test_both_matching_ways_agree(spark, log, registered):
    direct = {tuple(r) for r in usage_daily(match_usage(log, registered, F.lit("2024-02-01"))).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = {tuple(r) for r in daily_usage(log, registered, F.lit("2024-02-01")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert direct == counted and sum(r[3] for r in direct) == 40 == sum(r[4] for r in direct)


def test_stream_counts_overlap_and_replays_once(spark, log, registered):
    root = scratch_path(spark, "stream-test")
    stamped = log.withColumn("start_time", F.col("start_time").cast("timestamp"))
    stamped.filter("query_id < 40").coalesce(1).write.parquet(f"{root}/in/p=1")
    registered.write.parquet(f"{root}/registry")
    known = spark.read.parquet(f"{root}/registry")

    def run(checkpoint):
        source = spark.readStream.schema(stamped.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/p=*")
        usage_stream(source, known, f"{root}/usage", f"{root}/{checkpoint}", overlap="30 days").awaitTermination()

    run("ck")
    stamped.filter("query_id >= 20").coalesce(1).write.parquet(f"{root}/in/p=2")
    run("ck")
    batch = {tuple(r) for r in daily_usage(log, registered, F.lit("2024-02-01")).collect()}
    assert {tuple(r) for r in read_usage(spark, f"{root}/usage").collect()} == batch
    # A driver lost before its last commit runs that batch again, into the same folder: nothing is added twice.
    commits = Path(root) / "ck" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)
    run("ck")
    assert (commits / str(last)).exists()
    assert {tuple(r) for r in read_usage(spark, f"{root}/usage").collect()} == batch


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert broadcast_limit(spark) == 10 * 1024 * 1024
