"""From raw documents to token ids: quality rules, near-dedup, repeated passages, benchmark decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame. All but the last
return the columns of documents. A stage may be given extra columns of any name; they are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerloom.llm import bpe, fmindex, rules, simhash, suffixes
from fingerloom.llm.queries import byte_bpe, table
from fingerloom.session import discard, materialized


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or that a learned rule rejects go."""
    return rules.quality(docs, table(spark, sf_dir, "labels"), keep=docs.columns).where("kept").select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; of its repeated rows, one.

    A document is known by its id and its text's hash, so texts are shuffled once, when the others leave.
    """
    text_hash = F.xxhash64("text")
    narrow = docs.select("doc_id", "text", text_hash.alias("hash"))
    found = simhash.near_duplicates(narrow, keep=["doc_id", "hash"])
    first = found.groupBy("root").agg(F.min(F.struct(F.col("row.doc_id").isNull().alias("no_id"), "row.doc_id", "row.hash")).alias("k"))
    known_by = lambda doc_id, hash_: F.concat_ws("/", doc_id.cast("string"), F.hex(hash_)).alias("known_by")
    stays = first.select(known_by(F.col("k.doc_id"), F.col("k.hash")))
    rows = docs.select(F.struct("*").alias("row"), known_by(F.col("doc_id"), text_hash))
    return rows.join(stays, "known_by", "left_semi").dropDuplicates(["known_by"]).select("row.*")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that stand elsewhere as well are cut out, in whole characters; every document stays."""
    rest = [c for c in docs.columns if c != "text"]
    found = suffixes.without_repeats(docs, keep=rest, whole_characters=True).select("row.*", F.col("kept").cast("string").alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated go."""
    found = fmindex.contamination(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return found.where(~fmindex.contaminated()).select("row.*")


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to."""
    found = bpe.encode_and_check(docs, *byte_bpe(), keep=docs.columns, with_ids=True)
    # The operator's columns go last and replace extra columns of the same name.
    own = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    return found.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in own], *own)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_level_bpe),
]

#: Learned rules and token ids can't be said in SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialized(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        discard(before)  # what the stage was given is done with, once what it kept is written
    return STAGES[-1][1](spark, docs, sf_dir)
