"""From raw documents to token ids: quality, near-duplicates, benchmark leaks, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps;
the last gives their token digests.  Between stages tables are written to the
shared folder and read again.

Every stage takes whole texts of any length, null and empty ones, null and
repeated ids, and further columns, which it hands on; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import byte_bpe, decontaminate, minhash, quality
from evalweave.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on all agreeing labels, doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def text_key(docs: DataFrame) -> Column:
    """What a row's text is known by; null for a null text."""
    return F.md5(docs["text"].cast("string").cast("binary"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates on five-word shingles.

    A row is known by its id and text together, so rows of one id with other texts
    are decided on their own.  Of rows equal in both, that with the smallest other
    columns stays.  Rows with null ids, and with texts without words, all stay.
    """
    groups = written(minhash.near_duplicates(docs, width=5, percent=80), "groups").where("doc_id is not null and n_shingles > 0")
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("doc_id"), text_key(docs).alias("text_key"))
    # merge joins at every size: the rows that go are as many as the corpus makes them
    dropped = groups.where("not kept").select("doc_id", "text_key").distinct().hint("merge")
    left = keyed.join(dropped, ["doc_id", "text_key"], "left_anti")
    repeated = written(groups.where("kept").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "repeated")
    if not repeated.isEmpty():
        one = left.join(repeated.hint("merge"), ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(F.min("row").alias("row"))
        left = left.join(repeated.hint("merge"), ["doc_id", "text_key"], "left_anti").select("row").unionByName(one.select("row"))
    return left.select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no passage of the benchmark, whatever their ids; null and empty texts stay."""
    texts = docs.select(text_key(docs).alias("doc_id"), docs["text"].alias("text"))
    found = decontaminate.leaks(texts, table(spark, sf_dir, "benchmark"), id_type="string").select("doc_id").distinct()
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), text_key(docs).alias("doc_id"))
    return keyed.join(found, "doc_id", "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the bytes decoded from them."""
    return byte_bpe.digests(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: No stage can be said in SQL; tests/llm compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
