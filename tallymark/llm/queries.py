"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, curriculum, decontaminate, filter_audit, language_id, line_dedup, minhash, projection_forest, source_divergence, suffix_array, toxicity, url_filter, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bucket(n: int):
    """The remainder that splits rows into learning and held-out ones."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def bpe_encode(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe.encode_texts(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path())
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def line_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_array.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    found = decontaminate.find_contamination(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("doc").eqNullSafe(F.col("component")).alias("kept"),
    )


def language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(bucket(5) != 0))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (bucket(5) == 0).alias("held_out"), "lang_pred", "score")


def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(bucket(4) != 2)
    found = toxicity.score(docs, toxicity.train(docs, labels))
    return found.select("doc_id", (bucket(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = projection_forest.near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def url_rules() -> list[url_filter.Rule]:
    # The rules of the query.
    placed = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
    return [url_filter.place_rule(*r) for r in placed] + list(url_filter.DEFAULT_RULES)


def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    found = url_filter.judge_urls(pages, url_filter.rule_table(spark, url_rules()))
    return found.select("page_id", "host", "path", F.when(F.col("level") == 1, F.col("rule")).alias("rule"), "verdict")


def warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    found = warc.archive_pages(pages)
    return found.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def filter_interaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = filter_audit.audit(docs, table(spark, folder, "labels").select("doc_id", "quality", "toxic"))
    return found.drop("letter")


def source_divergence_audit(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.audit(table(spark, folder, "documents").select("lang", "source", "text"))


def mixing_to_weights(spark: SparkSession, folder: str) -> DataFrame:
    mixed = curriculum.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    first = F.when(F.size("copies") > 0, F.element_at("copies", 1)["position"])
    found = mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", first.alias("position"))
    return found.orderBy(F.col("position").asc_nulls_last(), "doc_id")


QUERIES = {
    "op1_bpe_encode_decode": bpe_encode,
    "op2_line_dedup": line_dedup_query,
    "op3_suffix_array_dedup": suffix_array_dedup,
    "op4_benchmark_decontamination": decontamination,
    "op5_toxicity": toxic_documents,
    "op6_embedding_near_dedup": embedding_near_dedup,
    "op7_url_filters": url_filters,
    "op8_warc": warc_archive,
    "op9_minhash_near_dedup": minhash_near_dedup,
    "op10_language_id": language,
    "op11_filter_interaction_audit": filter_interaction_audit,
    "op12_source_divergence_audit": source_divergence_audit,
    "op13_mixing_to_weights": mixing_to_weights,
}

_SITE_TEST = " OR ".join(
    "regexp_matches(host || path, '{}')".format(url_filter.word_rule(*w).pattern) for w in url_filter.SITE_WORDS
)
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _position_sql(schedule: curriculum.Schedule, share: str) -> str:
    """``curriculum.position`` as SQL text."""
    pieces = curriculum.segments(schedule)
    t0, t1, a, b, before = pieces[-1]
    total, found = float(before + (a + b) / 2 * (t1 - t0)), ""
    for k, (t0, t1, a, b, before) in reversed(list(enumerate(pieces))):
        left = f"greatest({share} * {total}::DOUBLE - {float(before)}::DOUBLE, 0::DOUBLE)"
        root = f"sqrt(greatest({float(a * a)}::DOUBLE + {float(2 * (b - a) / (t1 - t0))}::DOUBLE * {left}, 0::DOUBLE))"
        here = f"{float(t0)}::DOUBLE + CASE WHEN {left} <= 0 THEN 0 ELSE least(2 * {left} / ({float(a)}::DOUBLE + {root}), {float(t1 - t0)}::DOUBLE) END"
        found = f"CASE WHEN {share} * {total}::DOUBLE < {float(pieces[k + 1][4])}::DOUBLE THEN {here} ELSE {found} END" if found else here
    return found


_POSITIONS = " ".join(f"WHEN {k} THEN {_position_sql(s, '(CAST(c AS DOUBLE) / take)')}" for k, s in enumerate(curriculum.SCHEDULES))

SQL = {
    "op2_line_dedup": """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
o AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k FROM l WHERE trim(line, ' ') <> ''),
f AS (SELECT doc_id, pos, line, length(line) AS n FROM o WHERE k = 1),
h AS (SELECT *, unnest([n, n - 1]) AS m FROM f),
e AS (SELECT doc_id, pos, line, n, m, 'p' AS side, left(line, m // 2) AS half FROM h UNION ALL SELECT doc_id, pos, line, n, m, 's', right(line, m - m // 2) FROM h),
c AS (SELECT DISTINCT a.doc_id, a.pos, a.line, b.line AS other FROM e a JOIN e b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND (b.doc_id, b.pos) < (a.doc_id, a.pos)),
s AS (SELECT *, CASE WHEN length(line) >= length(other) THEN line ELSE other END AS x, CASE WHEN length(line) >= length(other) THEN other ELSE line END AS y FROM c),
g AS (SELECT DISTINCT doc_id, pos FROM s WHERE len(list_filter(range(1, length(x) + 1), lambda i: left(x, i - 1) = left(y, i - 1)
      AND substr(x, i + 1) = substr(y, CASE WHEN length(x) = length(y) THEN i + 1 ELSE i END))) > 0),
k AS (SELECT doc_id, pos FROM f EXCEPT SELECT doc_id, pos FROM g),
r AS (SELECT l.doc_id, l.pos, l.line, trim(l.line, ' ') <> '' AS full_line, k.pos IS NOT NULL AS stays FROM l LEFT JOIN k ON l.doc_id = k.doc_id AND l.pos = k.pos)
SELECT doc_id, CAST(count(*) FILTER (full_line) AS BIGINT) AS n_lines, CAST(count(*) FILTER (full_line AND NOT stays) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays OR NOT full_line), '')) AS kept_sha256
FROM r GROUP BY doc_id
""",
    "op4_benchmark_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS t FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT r, i, dw.m, item FROM dw JOIN iw ON dw.t = iw.t AND dw.m = iw.m),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM h) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
""",
    "op7_url_filters": rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                     WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                     WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN {_SITE_TEST} THEN 'block' ELSE 'allow' END AS verdict FROM r
""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
e AS (SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS low FROM d),
v AS (SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(h, CAST(1 + 5 * k AS INTEGER), 5) AS BIGINT)) AS g FROM e)
SELECT page_id, payload_bytes, array_to_string(list_transform(g, lambda x: array_to_string(list_transform([15, 10, 5, 0],
       lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((x >> s) & 31) AS INTEGER), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to FROM v
""",
    "op11_filter_interaction_audit": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER)
      + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
      + 16 * CAST(coalesce(low < w.doc_id, false) AS INTEGER) AS bits FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
c AS (SELECT part, bits, good, bad, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
k AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
s AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, CAST(step AS INTEGER), 1)) - 65) AS own,
      CAST(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, CAST(i AS INTEGER), 1)) - 65))) AS INTEGER) AS before FROM k),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, sum(n) FILTER (bits & (own | coalesce(before, 0)) = 0) AS kept,
      sum(n) FILTER (bits & own <> 0 AND bits & coalesce(before, 0) = 0) AS removed, sum(n) FILTER (bits & own <> 0 AND bits & coalesce(before, 0) <> 0) AS redundant,
      sum(n) FILTER (bits = own) AS unique_fails, sum(n) FILTER (bits & own <> 0 AND bits & coalesce(before, 0) = 0 AND good = 1) AS good_lost,
      sum(n) FILTER (bits & own <> 0 AND bits & coalesce(before, 0) = 0 AND bad = 1) AS toxic_lost FROM c CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
""",
    "op12_source_divergence_audit": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
e AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT e.*, v, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(n) OVER (PARTITION BY lang) AS lang_total FROM e JOIN v USING (lang)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q FROM s),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x
QUALIFY part = 'pair' OR rank <= 50
""",
    "op13_mixing_to_weights": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 15) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS HUGEINT) AS most, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) AS kind FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + kind] AS w, sum(source_size) OVER () AS words FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY most * (10 // w), source) AS ord FROM w),
p AS (SELECT *, words - coalesce(sum(most) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
             sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS den FROM o),
l AS (SELECT min(ord) AS ord FROM p WHERE most * den > w * num),
f AS (SELECT p.source, p.source_size, p.kind, CASE WHEN coalesce(p.ord < l.ord, true) THEN CAST(p.most AS DOUBLE) ELSE CAST(p.w * x.num AS DOUBLE) / CAST(x.den AS DOUBLE) END AS target,
             CASE WHEN coalesce(p.ord < l.ord, true) THEN p.most ELSE (2 * p.w * x.num + x.den) // (2 * x.den) END AS take FROM p CROSS JOIN l LEFT JOIN p x ON x.ord = l.ord),
r AS (SELECT d.*, f.* EXCLUDE (source), coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, take - c)) + greatest(0, least(size, take - c - source_size)) + greatest(0, least(size, take - c - 2 * source_size)) AS BIGINT) AS taken,
       CASE WHEN size > 0 AND c < take THEN CASE kind {_POSITIONS} END END AS position FROM r
""",
}
