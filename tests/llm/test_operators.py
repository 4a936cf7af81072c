"""The operators on small tables, against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymark.llm import bpe, decontaminate, language_id, line_dedup, minhash, projection_forest, suffix_array, toxicity, url_filter, warc
from tallymark.llm.queries import tokenizer_path
from tallymark.session import scratch_path

LOWER = {k: k + 32 for k in range(65, 91)}


def documents(spark, texts):
    rows = [(k, t, k, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words long, score string")


def sentences(seed, n, words=12):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(words)) for _ in range(n)]


def test_bpe_equals_the_library(spark):
    own = Tokenizer.from_file(tokenizer_path())
    texts = [None, "", "Hello  world\n\n x", "a<|endoftext|>b", "x" * 400, " " * 90 + "y", "né " * 60, "ab1!" * 90]
    got = bpe.encode_texts(documents(spark, texts), tokenizer_path(), block=16).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        ids = own.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        assert row["decoded"] == (text or "") and row["n_words"] == row["doc_id"]


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_line_dedup_against_all_pairs(spark):
    base = sentences(3, 12)
    rng = random.Random(5)
    lines = list(base)
    for line in base * 2:
        k = rng.randrange(len(line))
        lines.append(rng.choice([line, line[:k] + line[k + 1 :], line[:k] + "Z" + line[k:], line[:k] + "Q" + line[k + 1 :], "short", "shor", "a", "b", "ab", "xyz", ""]))
    texts = ["\n".join(lines[k : k + 4]) for k in range(0, len(lines), 4)] + [None, "", "\n\n"]
    seen, want = [], []
    for text in texts:
        kept = []
        for line in (text or "").split("\n"):
            gone = line.strip(" ") and any(distance_one(line, old) for old in seen)
            if line.strip(" "):
                seen.append(line)
            if not gone:
                kept.append(line)
        want.append(None if text is None else "\n".join(kept))
    got = [r["kept_text"] for r in line_dedup.dedup_lines(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got == want
    equal = line_dedup.dedup_lines(documents(spark, ["ab\nab\nac", "ac"]), max_edits=0).orderBy("doc_id").collect()
    assert [r["kept_text"] for r in equal] == ["ab\nac", ""]


def test_suffix_array_and_repeats(spark):
    rng = random.Random(1)
    for _ in range(200):
        text = [rng.randint(1, 3) for _ in range(rng.randint(1, 40))]
        assert suffix_array.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    base = [" ".join(s) for s in zip(sentences(8, 10, 40), sentences(9, 10, 40), strict=True)]
    texts = base + [base[0], base[1][50:] + base[2][:150], None, "", "ab" * 200] + [base[3][20:180] + s for s in sentences(10, 9)]
    for block in (512, 4):
        got = suffix_array.remove_repeats(documents(spark, texts), block_stretches=block).orderBy("doc_id").collect()
        seen = set()
        for row, text in zip(got, texts, strict=True):
            body = (text or "").encode()
            gone = bytearray(len(body))
            for p in range(len(body) - 99):
                if body[p : p + 100] in seen:
                    gone[p : p + 100] = b"\1" * 100
                seen.add(body[p : p + 100])
            assert bytes(row["kept"]) == bytes(c for c, g in zip(body, gone, strict=True) if not g)


def test_repeats_around_a_common_passage(spark, monkeypatch):
    tables, stored = {}, suffix_array.stored

    def kept(df, label):
        tables[label] = stored(df, label)
        return tables[label]

    monkeypatch.setattr(suffix_array, "stored", kept)
    short, long, longer = sentences(31, 1, 8)[0].encode()[:30].decode("utf-8", "ignore"), sentences(32, 1, 80)[0][:130], sentences(33, 1, 60)[0][:90]
    left, right = sentences(34, 60, 30), sentences(35, 60, 30)
    texts = [left[k] + (short, long, right[k % 3][:40] + longer)[k % 3] + right[k] for k in range(60)] + [None, left[0] + short, left[2][-60:] + longer]
    got = suffix_array.remove_repeats(documents(spark, texts), block_stretches=4).orderBy("doc_id").collect()
    seen = set()
    for row, text in zip(got, texts, strict=True):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - 99):
            if body[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(body[p : p + 100])
        assert bytes(row["kept"]) == bytes(c for c, g in zip(body, gone, strict=True) if not g)
    # Strings around passages that stand in more contexts than a block holds are not sent one by one.
    assert tables["strings"].count() < 2 * len(texts)


def test_decontamination_in_any_number_of_blocks(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, None), (None, "...")], "item_id long, text string")
    texts = ["a one TWO three, four five six seven eight nine ten z", "short; item short", "one two three", None, "", "two three four five six seven eight nine ten eleven " * 300]
    want = [(11 if k == 0 else None, h, i) for k, (h, i) in enumerate([(10, ["1"]), (2, ["2"]), (0, []), (0, []), (0, []), (3000, ["1"])])]
    for size in (200_000, 1):
        got = decontaminate.find_contamination(documents(spark, texts), items, block_windows=size).orderBy("doc_id").collect()
        assert [(r["n_hit"], r["items"]) for r in got] == [x[1:] for x in want]
    assert decontaminate.find_contamination(documents(spark, texts), items.limit(0)).where("n_hit > 0").count() == 0


def test_minhash_components_against_all_pairs(spark):
    rng = random.Random(2)
    texts = [None, "", "few words", "Few Words"]
    for text in sentences(4, 12, 60):
        words = text.split(" ")
        texts.append(text)
        for _ in range(3):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "new"
            texts.append(" ".join(copy))
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = minhash.near_duplicates(documents(spark, texts), small=4).orderBy("doc").collect()
    assert [(r["n"], r["component"]) for r in got] == [(len(s), find(k)) for k, s in enumerate(sets)]
    assert minhash.near_duplicates(documents(spark, texts).limit(0)).count() == 0


def test_minhash_compares_many_cells_in_one_call():
    rng = np.random.default_rng(4)
    rows = []
    for path, names in ((7, [1, 2, 3]), (5, [1, 2]), (9, [4, 5, 6, 8])):
        own = rng.integers(0, 256, 128).astype(np.uint8)
        for k, name in enumerate(names):
            codes = own.copy()
            codes[: 4 * k] ^= 1
            rows.append({"path": path, "name": name, "part": 1 if path == 5 else name, "n": 100, "block": int(path == 9 and k % 2), "codes": codes.tobytes()})
    order = rng.permutation(len(rows))
    table = pa.Table.from_pylist([rows[k] for k in order])
    got = minhash._best_pairs(table, 128, 80, 0.75).to_pylist()
    # Cell 5 is one part already; of cell 9 only pairs across its two blocks count.
    assert sorted((x["path"], x["a"], x["b"]) for x in got) == [(7, 1, 2), (7, 1, 2), (7, 2, 3), (9, 4, 5), (9, 4, 5), (9, 5, 6), (9, 6, 8)]
    assert sorted((x["path"], x["name"]) for x in minhash._members(table, 128, 80, 0.75).to_pylist()) == [(7, 1), (7, 2), (7, 3), (9, 4), (9, 5), (9, 6), (9, 8)]


def test_minhash_pairs_within_a_template(spark):
    names = iter(range(10**6))
    fresh = lambda n: [f"w{next(names)}" for _ in range(n)]
    common, texts = fresh(364), []
    for _ in range(100):  # 0.72 with every other, 0.755 with the twin
        twin = fresh(10)
        texts += [" ".join(common + twin + fresh(60)) for _ in range(2)]
    got = minhash.near_duplicates(documents(spark, texts), small=8, depth=3).collect()
    assert {r["doc"]: r["component"] for r in got} == {k: k // 2 * 2 for k in range(200)}


def test_minhash_joins_parts_only_after_new_links(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(w if k != 2 * i else f"x{i}" for k, w in enumerate(words)) for i in range(12)]
    labels, plain = [], minhash.stored
    monkeypatch.setattr(minhash, "stored", lambda df, label: labels.append(label) or plain(df, label))
    got = minhash.near_duplicates(documents(spark, texts), small=4).collect()
    assert len({r["component"] for r in got}) == 1
    steps = [x for x in labels if x in ("links", "parts", "known")]
    assert "parts" in steps
    for k, x in enumerate(steps):  # one table of parts per set of new links, joined with the nodes once
        if x == "parts":
            assert steps[k - 1] == "links" and steps[k + 1] == "known"


def test_minhash_links_beside_a_central_class(spark):
    words = [f"w{k}" for k in range(204)]
    texts = [" ".join(words[:150]), *(" ".join([*words, f"x{k}"]) for k in range(3))]
    marks = np.tile(np.arange(128, dtype=np.uint16), (4, 1))
    for k in (1, 2, 3):  # estimates that are sure of the links to the first, which do not hold
        marks[k, 8 * k : 8 * k + 8] += np.uint16(1000 * k)
    data = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, data)])
    sets = list(minhash.shingle_sets(np.frombuffer(b"".join(data), np.uint8), bounds, 5))
    rows = [(minhash.set_name(s), len(s), bytearray(m.tobytes()), bytearray(m.astype(np.uint8).tobytes()), k) for k, (s, m) in enumerate(zip(sets, marks, strict=True))]
    classes = spark.createDataFrame([(a, 200, m, c, k) for a, _, m, c, k in rows], "name long, n long, marks binary, codes binary, doc long")
    pairs = documents(spark, texts).select(F.col("doc_id").alias("doc"), "text")
    links = {(r["a"], r["b"]) for r in minhash._links(pairs, classes, 5, 0.75, 20, 128, 64, 8).collect()}
    own = sorted(r[0] for r in rows[1:])
    assert {x for link in links for x in link} == set(own)


def test_forest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 16))
    near = base[:120] + 0.05 * rng.standard_normal((120, 16))
    vectors = [v.tolist() for v in np.vstack([base, near, base[:20]])] + [None, [0.0] * 16, [float("nan")] * 16, [1.0, None], []]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r["id"]: r for r in projection_forest.near_vectors(df, leaf=32).collect()}
    full = np.array(vectors[:440])
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    found = np.array([got[k]["n_links"] for k in range(440)])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    assert all(got[k]["n_links"] == 0 and got[k]["component"] == k for k in range(440, 445))


def test_forest_finds_the_links_of_a_dense_group(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3000, 64))
    vectors[:1000] = vectors[0] + 0.2 * rng.standard_normal((1000, 64))
    vectors[1000:1200] = vectors[1200:1400] + 0.2 * rng.standard_normal((200, 64))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rng.shuffle(unit)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(unit)], "vec_id long, embedding array<double>")
    got = {r["id"]: r["n_links"] for r in projection_forest.near_vectors(df).where("id % 50 = 0").collect()}
    links = (unit[::50] @ unit.T >= 0.95).sum(1) - 1
    found = np.array([got[k] for k in range(0, 3000, 50)])
    assert links.sum() > 10_000 and (found <= links).all() and found.sum() >= 0.999 * links.sum()


def test_url_rules(spark):
    rules = url_filter.rule_table(spark, [url_filter.place_rule("net/", "block"), url_filter.place_rule("example.net/en", "allow"), url_filter.word_rule("casino")])
    urls = [None, "no scheme", "http://A.Example.NET/en/1", "http://x.net/a", "http://x.net", "https://casino-x.org/", "https://mycasino.org/", "http://Example.net/english?x", "a://b.com/p://casino"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).orderBy("page_id").collect()]
    assert got == [(None, "allow"), (None, "allow"), ("example.net/en", "allow"), ("net/", "block"), (None, "allow"), ("casino", "block"), (None, "allow"), ("example.net/en", "allow"), ("casino", "block")]


def test_warc_round_trip_with_records_inside_payloads(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["<p>é</p>", None, "", inner, "x" + inner + inner, "WARC/1.1\r\n", "<p>é</p>", "a\r\n\r\nb"]
    pages = spark.createDataFrame([(k, f"http://x/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    got = {int(r["page"]): r for r in warc.archive_pages(pages).collect()}
    assert sorted(got) == list(range(len(html)))
    assert [got[k]["payload_bytes"] for k in range(len(html))] == [len((h or "").encode()) for h in html]
    assert {k: int(r["refers_to"]) for k, r in got.items() if r["record_type"] == "revisit"} == {2: 1, 6: 0}
    path = scratch_path(spark, "warc")
    warc.write_archive(pages.limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def test_warc_ids_of_any_text_and_gzip(spark):
    ids = ["null", None, "a\nb", "é %+> <", "", "0"]
    pages = spark.createDataFrame([(k, None, "same" if k != "0" else "other") for k in ids], "page_id string, url string, html string")
    got = warc.archive_pages(pages).collect()
    assert {(r["page"], r["record_type"], r["refers_to"]) for r in got} == {
        ("", "response", None), ("0", "response", None), *((k, "revisit", "") for k in ids if k not in ("", "0"))
    } and len(got) == len(ids)
    path = scratch_path(spark, "warc")
    warc.write_archive(pages.repartition(2), path, compression="gzip")
    assert warc.read_archive(spark, path).where("record_type = 'response'").select("payload_bytes").orderBy("payload_bytes").collect() == [(4,), (5,)]


def test_language_and_toxicity_learn(spark):
    rng = random.Random(1)
    make = lambda alphabet: " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(30))
    rows = [(k, make("abcde" if k % 2 else "vwxyz") + (" moron" if k % 5 == 0 else ""), "l1" if k % 2 else "l2") for k in range(200)]
    docs = spark.createDataFrame([*rows, (200, None, None), (201, "123 ...", "l1"), (202, "", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs.where("doc_id % 3 <> 0"))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    assert all(found[k][0] == ("l1" if k % 2 else "l2") for k in range(200)) and [found[k] for k in (200, 201, 202)] == [("und", 0.0)] * 3
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.train(docs.limit(0))).collect()} == {"und"}
    labels = docs.where("doc_id < 150").select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    fitted = toxicity.train(docs, labels)
    scores = {r["doc_id"]: r for r in toxicity.score(docs, fitted).collect()}
    assert all((scores[k]["score"] >= 0.3) == (k % 5 == 0) for k in range(200)) and 0 <= scores[200]["score"] < 0.3
    a, b = scores[195]["toxic_spans"]
    assert rows[195][1][a:b] == "moron"
    assert toxicity.train(docs, labels.limit(0)) is None
    named = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    again = toxicity.train(named(docs), named(labels))
    odd = spark.createDataFrame([("İİİ İ vwxyz moron vwxyz",), (None,)], "text string")
    text, row = "İİİ İ vwxyz moron vwxyz", toxicity.score(odd, again).first()
    assert text[slice(*row["toxic_spans"])] == "moron"
    far = lambda df: df.withColumn("doc_id", F.col("doc_id") + F.lit(2**63 - 1000))
    assert toxicity.train(far(docs), far(labels)) is not None


def test_marginals_against_all_taggings():
    rng = random.Random(2)
    for n in (1, 2, 5):
        model = {"weights": {f"={w}": rng.uniform(-2, 3) for w in "abcd"}, "field": {"b": -0.5, "t": np.array([[0.2, -0.4], [-0.3, 0.9]])}}
        tagger, words = toxicity.Tagger(model), [rng.choice("abcde") for _ in range(n)]
        total, on = 0.0, [0.0] * n
        for tags in itertools.product((0, 1), repeat=n):
            energy = sum(model["field"]["b"] + model["weights"].get(f"={w}", 0.0) for w, t in zip(words, tags, strict=True) if t)
            energy += sum(model["field"]["t"][a, b] for a, b in itertools.pairwise(tags))
            total += np.exp(energy)
            on = [x + np.exp(energy) * t for x, t in zip(on, tags, strict=True)]
        assert np.allclose(tagger.marginals(words), [x / total for x in on])


def test_language_posterior_against_plain_bayes(spark):
    texts = [("en", "the cat"), ("en", "a hat"), ("de", "die katze"), ("de", "der hut"), (None, "the hut"), (None, "katze a")]
    docs = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")

    def grams(text):
        text = f" {text} "
        return [text[k : k + m] for m in (2, 3) for k in range(len(text) - m + 1)]

    def bucket(gram):
        at = language_id._features(np.array([*map(ord, gram), 0], np.uint32), 1 << 15)
        return int(at[len(gram) - 2][0])

    counts = {lang: Counter(bucket(g) for x, t in texts if x == lang for g in grams(t)) for lang in ("de", "en")}
    logs = lambda lang, text: np.log(0.5) + sum(np.log((counts[lang][bucket(g)] + 0.5) / (sum(counts[lang].values()) + 0.5 * 2**15)) for g in grams(text))
    for row in language_id.predict(docs, language_id.train(docs)).collect():
        z = {lang: logs(lang, row["text"]) for lang in counts}
        best = max(sorted(z), key=z.get)
        assert row["lang_pred"] == best and np.isclose(row["score"], 1 / sum(np.exp(x - z[best]) for x in z.values()))


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    docs = documents(spark, ["one line of text that is long"]).limit(n)
    assert line_dedup.dedup_lines(docs).count() == n
    assert suffix_array.remove_repeats(docs).count() == n
    assert bpe.encode_texts(docs, tokenizer_path()).count() == n


def plain_pipeline(docs, items):
    """All five stages, row by row: (doc_id, ids) of what stays."""
    live = [(k, t) for k, t in docs if t is not None and any(c.isalpha() for c in t)]
    seen, fresh = [], []
    for k, text in live:
        lines, kept = text.split("\n"), []
        for line in lines:
            full = bool(line.strip(" "))
            if not (full and any(distance_one(line, old) for old in seen)):
                kept.append(line)
            if full:
                seen.append(line)
        if any(x.strip(" ") for x in kept):
            fresh.append((k, "\n".join(kept)))
    sets, root = {}, {}
    for k, text in fresh:
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        sets[k], root[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}, k
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    bad = set()
    for text in items:
        words = cut(text or "")
        n = min(10, len(words))
        bad |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    clean = []
    for k, text in fresh:
        words = cut(text)
        if root[k] == k and not any(tuple(words[i : i + n]) in bad for n in {len(b) for b in bad} for i in range(len(words) - n + 1)):
            clean.append((k, text))
    own = Tokenizer.from_file(tokenizer_path())
    return [(k, own.encode(text, add_special_tokens=False).ids) for k, text in clean]


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline

    rng = random.Random(6)
    base = sentences(21, 16, 60)
    texts = [None, "", "123 ...", *base]
    for text in base[:6]:
        words = text.split(" ")
        words[rng.randrange(60)] = "replaced"
        texts.append(" ".join(words))
    texts += [base[6], base[7] + "\n" + base[8][:-1] + "\nown line " + base[9][:90], base[10][:-1] + "Z", "short\n\nshort"]
    passage = base[11] + " tail"
    items = [passage, None, "...", "Tiny item", " ".join(sentences(22, 1, 14))]
    texts += ["before it a TINY, item and more words after", items[4] + " x" * 3, " ".join(items[4].split(" ")[:9]) + " y z"]
    folder = scratch_path(spark, "pipeline")
    rows = [(k, t, "l1" if k % 2 else "l2", "s", len(t or ""), k) for k, t in enumerate(texts)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, n_words long"
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in corpus_pipeline.run(spark, folder).orderBy("doc_id").collect()]
    want = plain_pipeline(list(enumerate(texts)), items)
    assert 15 < len(want) < len(texts) - 8 and got == want
