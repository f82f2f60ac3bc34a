"""A corpus pipeline of five stages over `documents`, each written as Parquet and read again by the next one.

1. language: documents in which no language is recognised go (no text, no letters, or no language that holds 30 % of
   the letters).
2. near_duplicates: of each group of documents linked by 5-word shingles at a Jaccard similarity of 0.8, one stays, the
   one with the smallest id unless others share that id; documents without an id have no group and stay. Unlike texts
   of one id are documents of their own; of rows equal in id and text one stays.
3. decontamination: documents with a window of 10 words of a benchmark item go.
4. personal_data: spans of personal data become tags; n_chars follows the new text.
5. packing: one row for each piece of at most 2048 tokens, with its place in a sequence.

All but the last stage return the columns of their input, whatever further ones it has, of whatever type and however
they are named. Texts are read whole, whatever their length. An empty input gives an empty output of the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perennial.llm import decontaminate, jaccard, language_id, packing, pii
from perennial.llm.shared import stored, table


def _carried(docs: DataFrame) -> DataFrame:
    """The text, and all other columns as one struct `row`, so that no name of theirs meets one of an operator's."""
    return docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def _unpacked(found: DataFrame, docs: DataFrame, row: str = "row", **changed: Column) -> DataFrame:
    """The columns of docs again, some of them changed."""
    return found.select(*(changed.get(c, F.col("text") if c == "text" else F.col(row)[c]).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs)
    found = language_id.identify(_carried(docs), model)
    return _unpacked(found.where("lang_pred <> 'und' and lang_score >= 0.3"), docs)


def _own_keys(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows, those of ids that several rows share with a key of their own for each text: of rows equal in id and text
    one stays, the one whose other columns sort first as JSON."""
    texts = rows.join(shared, F.col("key") == F.col("id")).groupBy("id", "text").agg(F.min_by("row", F.to_json("row")).alias("row"))
    least, most = rows.agg(F.min("key"), F.max("key")).first()
    number = F.monotonically_increasing_id()
    key = F.lit(most + 1) + number if most < 1 << 62 else F.lit(least - 1) - number
    others = rows.join(shared, F.col("key") == F.col("id"), "left_anti")
    return others.unionByName(stored(texts.select("text", "row", key.alias("key"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _carried(docs).withColumn("key", F.col("row.doc_id").cast("long"))
    shared = stored(rows.where("key is not null").groupBy(F.col("key").alias("id")).count().where("count > 1").select("id"))
    if not shared.isEmpty():
        rows = stored(_own_keys(rows, shared))
    gone = stored(jaccard.link(rows, "key")).where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    # Only rows that a filter of bounded size takes for a copy are moved to be compared; all others stay where they are.
    maybe = jaccard.in_filter(jaccard.id_filter(gone))(F.col("key"))
    kept = rows.where(~maybe).unionByName(rows.where(maybe).join(gone, F.col("key") == F.col("id"), "left_anti"))
    return _unpacked(kept, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _carried(docs).withColumn("doc_id", F.col("row.doc_id"))
    found = decontaminate.find(rows, table(spark, sf_dir, "benchmark"), carry="row").where(~decontaminate.is_contaminated())
    return _unpacked(found, docs, "carried")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.find(_carried(docs), pii.fit(docs))
    return _unpacked(found, docs, text=F.col("pii_redacted"), n_chars=F.length("pii_redacted").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.pieces_of(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


#: Language models, boosted trees and packing are not SQL: tests/llm tests the stages, near duplicates and decontamination against
#: brute force.
ORACLE_SQL = None
