"""Operators 11 to 13 against plain loops: nulls, empty and long texts, ties, repeated rows, hot groups, empty tables, clashing names."""

from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallymark.llm import curriculum, filter_audit, source_divergence
from tallymark.llm.ranks import with_rank
from tallymark.llm.term_transducer import Transducer

SCHEMA = "doc_id long, text string, lang string, source string, size long, rank int, failed int, target string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 7, 1, 3, "x") for r in rows], SCHEMA).repartition(3)


def some_rows():
    rng = random.Random(11)
    words = ["alpha", "Beta", "gämma", "delta", "EPS", "日本", "x$", "zeta", "a|b", "mu"]
    rows = []
    for k in range(160):
        n = rng.choice([0, 3, 60, 120, 200])
        pool = words if k % 3 else [w + str(j) for w in words for j in range(30)]
        text = " ".join(rng.choice(pool) for _ in range(n))
        rows.append((k, text, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "ß", None])))
    hot = " ".join(f"w{k}" for k in range(130))
    rows += [(1000 + k, hot, "en", "s1") for k in range(120)]
    rows += [(None, hot, "en", "s1"), (None, None, None, None), (5, rows[5][1], "en", "s2"), (5, rows[5][1], rows[5][2], "s2"), (6, "Other text", "de", "s1")]
    rows += [(2000, None, "en", None), (2001, "", "en", None), (2002, "word " * 30_000, "de", "s1"), (2003, "日" * 20_000, "de", "s1")]
    return rows


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, lang, _ in rows:
        text, words = text or "", spaced(text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and text in first and first[text] < i,
        }
        docs.append((lang or "", {c for c, f in fails.items() if f}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            for step, c in enumerate(order):
                before = set(order[:step])
                here = [d for d in own if c in d[1] and not d[1] & before]
                total[c] += len(here)
                out[part, "".join(order), step + 1] = [
                    sum(not d[1] & (before | {c}) for d in own), len(here), sum(c in d[1] and bool(d[1] & before) for d in own),
                    sum(d[1] == {c} for d in own), sum(d[2] for d in here), sum(d[3] for d in here), c,
                ]
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = total[row[6]] if isinstance(row[6], str) else row[6]
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_equals_plain_counts(spark):
    rows = some_rows()
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 160, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (99_999, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(documents(spark, rows), table).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got}
    assert len(got) == len(found) and found == plain_audit(rows, labels)


def test_hot_copies_are_dealt_over_tasks(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"), F.lit("x").alias("lang"))
    marked = filter_audit.text_failures(docs)
    copies = filter_audit.later_copies(docs, marked.select("id", "hash"))
    assert copies.count() == 9_999 and copies.where("id = 0 or id % 3 <> 0").isEmpty()


@pytest.mark.parametrize("words", [[], ["a"], ["", "a", "ab", "abc", "b", "bc", "c", "cb"], None])
def test_transducer_orders_and_rejects(words):
    if words is None:
        rng = random.Random(2)
        words = ["".join(rng.choice("abcé日") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    words = sorted({w.encode() for w in words})
    machine = Transducer.unpack(Transducer.build(words).pack())
    asked = [w for w in words if w] + [b"zz", b"abcd", "日é".encode() * 9]
    import numpy as np

    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(w) for w in asked])
    starts = ends - [len(w) for w in asked]
    place = {w: k for k, w in enumerate(words)}
    assert machine.places(data, starts, ends).tolist() == [place.get(w, -1) for w in asked]
    assert machine.words == len(words)


def test_transducer_is_minimal():
    machine = Transducer.build(sorted(a + b for a in (b"ka", b"lo", b"mi") for b in (b"rest", b"resting", b"rests")))
    assert len(machine.final) == 1 + 3 + 8  # root, one state per first letter, then one shared right part


def test_ranks_match_the_sorted_order(spark):
    names = [f"n{k * 7919 % 1000:03d}" for k in range(1000)] + [None]
    got = with_rank(spark.createDataFrame([(n,) for n in names], "name string"), [F.col("name").asc_nulls_last()], "place", "test", rows_per_part=90)
    want = {n: k for k, n in enumerate(sorted(names[:-1]) + [None])}
    assert {r["name"]: r["place"] for r in got.collect()} == want


def plain_divergence(rows, min_docs, top):
    lowered = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = {}
    for lang in {r[0] for r in lowered}:
        own = [r for r in lowered if r[0] == lang]
        seen = Counter(t for r in own for t in set(r[2]))
        kept = [t for t, n in seen.items() if n >= min_docs]
        counts = {s: Counter(t for r in own if r[1] == s for t in r[2]) for s in {r[1] for r in own}}
        whole = Counter(t for r in own for t in r[2])

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out[lang, s, part, item] = (value, k + 1)
    return out


@pytest.mark.parametrize("how", [{"min_docs": 20}, {"min_docs": 8, "part_terms": 5, "pack_bytes": 300}, {"min_docs": 10_000}])
def test_source_divergence_equals_plain_counts(spark, how):
    rows = some_rows()
    got = source_divergence.audit(documents(spark, rows), top=7, **how).collect()
    found = {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in got}
    assert len(got) == len(found) and found == plain_divergence(rows, how["min_docs"], 7)


def plain_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, words = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return {s: Fraction(cap * sizes[s]) for s in names}
        level = Fraction(words - sum(cap * sizes[s] for s in full), sum(weight[s] for s in free))
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            return {s: Fraction(cap * sizes[s]) if s in full else weight[s] * level for s in names}
        full |= over


def test_mix_meets_the_targets(spark):
    rows = some_rows() + [(3000 + k, f"only {k}", "en", f"tiny{k}") for k in range(9)] + [(4000, "", "en", "wordless")]
    mixed = curriculum.mix(documents(spark, rows), chunk_rows=16)
    got = mixed.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(spaced(text))
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]))
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"])
        assert all(0 <= c["position"] <= 1 for c in r["copies"])
    assert all(abs(taken[s] - want[s]) <= Fraction(1, 2) for s in sizes)
    key = lambda r: (r["id"] is None, r["id"], r["source"] or "", r["taken"], str(r["copies"]))
    again = curriculum.mix(documents(spark, rows[::-1]), chunk_rows=16).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_curriculum_follows_the_schedules(spark):
    """Up to any time, each source has delivered the share of its words that its integrated schedule says."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    rows = curriculum.training_order(curriculum.mix(docs, chunk_rows=500)).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    total, done = Counter(), Counter()
    for r in rows:
        total[r["source"]] += r["words"]
    areas = [lambda t: (6 * t - t * t) / 5, lambda t: (2 * t + t * t) / 2 if t < 0.5 else (1.25 + 3 * (t - 0.5) - 3 * (t - 0.5) ** 2) / 2, lambda t: t * t]
    for r in rows:
        for k in range(3):
            assert done[f"s{k}"] / total[f"s{k}"] == pytest.approx(areas[k](r["position"]), abs=0.002)
        done[r["source"]] += r["words"]


def test_bad_schedules_are_refused():
    for bad in ([(0, 1), (0.9, 1)], [(0, 1), (1, -1)], [(0, 0), (1, 0)], [(0, 1), (0, 2), (1, 1)]):
        with pytest.raises(ValueError):
            curriculum.weights([bad])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).isEmpty()
    assert source_divergence.audit(empty).isEmpty()
    assert curriculum.mix(empty).isEmpty()
