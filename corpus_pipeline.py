"""A corpus from documents: toxicity, near duplicates, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the
columns of documents, the last one packed pieces. A stage's result is written and read again as
the next one's docs; only then are the tables dropped that the earlier stage had stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm import common, ngram, packing, pii, suffix, toxicity

_before: list[str] = []


def _stage(f: Callable) -> Callable:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop_stored(spark, [p for p in _before if p in common.written()])
        _before.clear()
        old = set(common.written())
        out = f(spark, docs, sf_dir)
        _before.extend(p for p in common.written() if p not in old)
        return out

    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold; labels with remainder 1 are held out."""
    labels = common.table(spark, sf_dir, "labels").filter(common.crc32_mod("doc_id", 3) != 1)
    names = common.veiled(docs)
    plain = docs.select("doc_id", "text", *[common.quoted(c).alias(x) for c, x in names.items()])
    scored = toxicity.scored(plain, toxicity.fit(docs, labels), "text", *names.values()).filter(F.col("score") < toxicity.THRESHOLD)
    return scored.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the row with the smallest id (null: last; ties by a hash of the text), once; all distinct rows without a word."""
    rows = ngram.grouped(docs, 5, 80, 100)
    named = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    kept = rows.groupBy(F.coalesce("root", F.xxhash64("doc_id", "text_hash")), F.col("root").isNull()).agg(F.min(named).alias("kept")).select("kept.kept_id", "kept.kept_hash")
    mark = max(docs.columns, key=len) + "_hash"  # longer than any name of docs
    hashed = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = hashed["doc_id"].eqNullSafe(kept["kept_id"]) & (hashed[mark] == kept["kept_hash"])
    return hashed.join(kept, same, "left_semi").dropDuplicates(["doc_id", mark]).select(*docs.columns)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 400-byte strings and the passages of over 50 words that occur more than once."""
    return suffix.deduplicated(docs, words=50)


@_stage
def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it masked."""
    return pii.sanitised(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, as pieces with their place in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("pii", mask_personal), ("packing", pack)]

#: SQL expresses none of the stages in reasonable time; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
