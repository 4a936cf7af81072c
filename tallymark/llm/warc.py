"""WARC archives: written as plain text parts, read back by boundary-chain verification.

Reading: tasks split the files at the magic line and emit, for each fragment, a candidate record with its offset and the
offset its header gives for the successor. Within a file block, chains are followed locally to the first offset beyond the
block; pointer jumping over those (a number of rounds that grows with the logarithm of the blocks) marks what a file's
start reaches. Only reachable records are kept, so magic lines and whole records inside payloads are rejected. Payloads
that hold the magic line are put together again from their fragments, in a second scan.

Defined results: null html is an empty payload; a null url leaves out the target header; page_ids of any
text are percent-encoded in record ids and come back as they were, a null one as null;
rows with equal page_id and equal payload are all responses if that page_id is the smallest. A file that does not start with
a record, or the part after a broken record, yields no records.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .ship import ship
from .staging import small_side, stored

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MAGIC_BYTES = len(MAGIC)


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, from the hexadecimal digest, 20 bits at a time."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows (page, digest, refers_to) of (page, digest, size) whose payload a smaller page has."""
    first = pages.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1 and refers_to is not null")
    return pages.join(first, "digest").where(~F.col("page").eqNullSafe(F.col("refers_to"))).select("page", "digest", "refers_to").distinct()


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "none",
) -> None:
    """One record per row: ``response`` with the payload, or ``revisit`` without it where a smaller page has the same.

    ``compression="gzip"`` writes gzip files; those are read whole by one task each.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"),
    )
    bodies = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload"))
    again = small_side(stored(revisits(bodies.select("page", "digest", "size"), min_bytes), "revisits")).alias("r")
    same = F.col("b.page").eqNullSafe(F.col("r.page")) & (F.col("b.digest") == F.col("r.digest"))
    name = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">")), F.lit("<urn:page>"))

    def record(kind: str, more: list[Column], body: Column) -> Column:
        url = F.regexp_replace("url", r"[\x00-\x20]", "%20")
        lines = [
            F.lit(f"WARC-Type: {kind}\r\nWARC-Record-ID: "), name(F.col("page")), F.lit(f"\r\nWARC-Date: {date}\r\n"),
            F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
            F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), *more, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
        ]
        return F.concat(F.lit(MAGIC), *lines).alias("value")

    fresh = bodies.alias("b").join(again, same, "left_anti")
    full = fresh.select(record("response", [F.lit("\r\nContent-Type: application/http; msgtype=response")], F.concat(F.lit(HTTP), F.col("payload"))))
    known = bodies.select("page", "url", "digest", "size").alias("b").join(again, same).select("b.page", "url", "b.digest", "size", "refers_to")
    short = known.select(record("revisit", [F.lit("\r\nWARC-Refers-To: "), name(F.col("refers_to")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], F.lit("")))
    full.union(short).write.option("lineSep", END).option("compression", compression).text(path)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic lines; ``place`` orders the fragments of one block of a file."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(
        F.col("value").cast("binary").alias("body"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
    )


def _exits(chain: pd.DataFrame) -> pd.DataFrame:
    """Each candidate's first successor beyond the block's candidates."""
    chain = chain.sort_values("start", ascending=False)
    known: dict[int, int] = {}
    for start, after in zip(chain["start"], chain["after"], strict=True):
        known[start] = known.get(after, after) if after > start else -1
    return chain.assign(leaves=[known[s] for s in chain["start"]])[["file", "block", "start", "after", "leaves"]]


def _walk(chain: pd.DataFrame) -> pd.DataFrame:
    """Marks what the block's entries reach within it."""
    chain = chain.sort_values("start")
    reached = set(chain.loc[chain["entry"], "start"])
    for start, after in zip(chain["start"], chain["after"], strict=True):
        if start in reached:
            reached.add(after)
    return chain.loc[chain["start"].isin(reached), ["file", "start"]]


def _reachable(candidates: DataFrame) -> DataFrame:
    """(file, start) of the candidates (file, block, start, after) on the chain from their file's offset 0."""
    chain = cut_lineage(candidates.groupBy("file", "block").applyInPandas(_exits, "file string, block long, start long, after long, leaves long"))
    entries = chain.where("start = 0").select("file", "start")
    # Only offsets at which a chain enters a block can be jumped to.
    gates = chain.select("file", F.col("leaves").alias("start")).distinct().union(entries).distinct()
    jumps = cut_lineage(chain.join(gates, ["file", "start"]).select("file", "start", "leaves"))
    entries = cut_lineage(entries)
    while True:
        ahead = entries.join(jumps, ["file", "start"]).select("file", F.col("leaves").alias("start"))
        fresh = cut_lineage(ahead.join(jumps.select("file", "start"), ["file", "start"], "left_semi").join(entries, ["file", "start"], "left_anti").distinct())
        if fresh.isEmpty():
            break
        entries = cut_lineage(entries.union(fresh))
        onward = jumps.select("file", F.col("start").alias("leaves"), F.col("leaves").alias("further"))
        jumps = cut_lineage(jumps.join(onward, ["file", "leaves"], "left").select("file", "start", F.coalesce("further", "leaves").alias("leaves")))
    marked = chain.join(entries.withColumn("entry", F.lit(True)), ["file", "start"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.select("file", "block", "start", "after", "entry").groupBy("file", "block").applyInPandas(_walk, "file string, start long")


def _header(body: Column) -> Column:
    return F.substring_index(body.cast("string"), END, 1)


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, record_type, refers_to, digest`` (as declared), ``payload_digest`` and ``payload_bytes`` (as read; null for revisits)."""
    ship(spark)
    parts = _fragments(spark, path)
    head = _header(F.col("body"))
    known = parts.select(
        "file", "block", "place", F.octet_length("body").alias("size"), "body", F.octet_length(head).alias("head_size"),
        _field(head, "Content-Length").cast("long").alias("length"), _field(head, "WARC-Record-ID").alias("record_id"),
        _field(head, "WARC-Type").alias("record_type"), _field(head, "WARC-Refers-To").alias("refers_to"), _field(head, "WARC-Payload-Digest").alias("digest"),
    )
    known = known.withColumn("whole", F.col("length").isNotNull() & (F.col("head_size") + 4 + F.col("length") <= F.col("size")))
    known = known.withColumn("block_bytes", F.expr("if(whole, substring(body, head_size + 5, cast(length as int)), null)"))
    payload = F.expr("substring(block_bytes, octet_length(substring_index(cast(block_bytes as string), '\\r\\n\\r\\n', 1)) + 5)")
    known = known.withColumn("payload", F.when(F.col("record_type") == "response", payload))
    facts = known.select(
        "file", "block", "place", "size", "head_size", "length", "record_id", "record_type", "refers_to", "digest", "whole",
        base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    # Offsets: sums within blocks of a file, then over its blocks. Every fragment but the file's last is followed by a magic line.
    facts = cut_lineage(facts)
    order = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    blocks = facts.groupBy("file", "block").agg(F.sum(F.col("size") + _MAGIC_BYTES).alias("total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    placed = facts.withColumn("inner", F.coalesce(F.sum(F.col("size") + _MAGIC_BYTES).over(order), F.lit(0))).join(blocks, ["file", "block"])
    placed = placed.withColumn("start", F.col("before") + F.col("inner") - _MAGIC_BYTES).where("start >= 0")
    placed = cut_lineage(placed.withColumn("after", F.col("start") + _MAGIC_BYTES + F.col("head_size") + 8 + F.col("length")))
    real = _reachable(placed.where("length is not null").select("file", "block", "start", "after"))
    records = cut_lineage(placed.join(real, ["file", "start"], "left_semi"))
    columns = ["record_id", "record_type", "refers_to", "digest", "payload_digest", "payload_bytes"]
    done = records.where("whole").select(*columns)
    if records.where("not whole").isEmpty():
        return done
    # The rest: every fragment up to the successor belongs to the record.
    owner = Window.partitionBy("file").orderBy("start")
    owned = placed.select("file", "block", "place", "start").join(
        records.where("not whole").select("file", "start", F.struct("start", "after", "head_size", "length", *columns[:4]).alias("own")), ["file", "start"], "left"
    ).withColumn("own", F.last("own", ignorenulls=True).over(owner)).where("start < own.after")
    pieces = _fragments(spark, path).join(owned, ["file", "block", "place"]).select("file", "own", "start", "body")
    joined = pieces.groupBy("file", "own.start").agg(F.first("own").alias("own"), F.sort_array(F.collect_list(F.struct("start", "body"))).alias("p"))
    body = F.expr(f"aggregate(slice(p, 2, size(p)), p[0].body, (s, x) -> concat(s, cast('{MAGIC[:-2]}\\r\\n' as binary), x.body))")
    joined = joined.withColumn("body", body).withColumn("block_bytes", F.expr("substring(body, own.head_size + 5, cast(own.length as int))"))
    joined = joined.withColumn("payload", F.when(F.col("own.record_type") == "response", payload))
    return done.union(joined.select(*[f"own.{c}" for c in columns[:4]], base32_sha1(F.col("payload")), F.octet_length("payload").cast("long")))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes the rows as archives in the shared folder and reads them back: ``page`` (text), size, digest, type, reference."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path, id_col, url_col, payload_col, min_bytes)
    found = read_archive(spark, path)
    page = lambda c: F.when(c.startswith("<urn:page:"), F.url_decode(F.regexp_extract(c, "^<urn:page:(.*)>$", 1)))
    found = found.select(
        page(F.col("record_id")).alias("page"), "record_type", page(F.col("refers_to")).alias("refers_to"),
        F.regexp_replace("digest", "^sha1:", "").alias("digest"), "payload_digest", "payload_bytes",
    )
    sizes = found.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("digest")).agg(F.min("payload_bytes").alias("size"))
    known = found.where("record_type <> 'response'").join(sizes, "digest").select("page", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return found.where("record_type = 'response'").select("page", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("string").alias("refers_to")).union(known)
