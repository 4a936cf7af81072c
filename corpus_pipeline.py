"""From raw documents to tokens: language, repeated lines, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Rows
without text go in the first stage; empty tables give empty results; extra columns ride along unless a stage names its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import bpe, decontaminate, language_id, line_dedup, minhash
from tallymark.llm.queries import table, tokenizer_path
from tallymark.llm.staging import small_side, stored

#: Some stages have no SQL form (classifier, path trees, BPE); the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (``und``); a missing language becomes the predicted one. With no language in the
    whole table nothing can be learned: texts with a letter stay, and their language stays null."""
    model = language_id.train(docs)
    if not model["names"]:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    found = language_id.predict(docs, model, pred_col="__lang", score_col="__score")
    found = found.where("__lang <> 'und'").withColumn("lang", F.coalesce("lang", "__lang"))
    return found.select(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that stand earlier in the corpus, up to one edit; a document that loses every line goes."""
    found = line_dedup.dedup_lines(docs).where("n_lines = 0 or n_removed < n_lines")
    found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.col("kept_text"))
    return found.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (3 of 4 shingles of five words shared), the document with the smallest id of each group stays."""
    groups = minhash.near_duplicates(docs)
    gone = stored(groups.where("doc <> component").select(F.col("doc").alias("doc_id")).distinct(), "copies")
    return docs.join(small_side(gone), "doc_id", "left_anti").select(*docs.columns)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item in a row, or a whole shorter item, go."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's tokens (unsigned 32-bit, little-endian), their digest and the digest of the decoded text."""
    found = bpe.encode_texts(docs, tokenizer_path())
    digests = [F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]
    return found.select("doc_id", "lang", "source", "n_tokens", *digests, "ids")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", fresh_lines),
    ("minhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", clean_of_benchmarks),
    ("bpe_encode_decode", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
