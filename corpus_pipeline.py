"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs; all but the last return the columns of documents.

Every stage keeps rows whose id, text, language or source is null, as far as its rules do not
reject them, and whatever further columns there are, by whatever names. Texts are worked on
whole. Repeated rows are decided alike (near-dedup keeps one of them); an empty table gives
an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import langid, neardup, pack, pii, quality
from strata.llm.sieve import passing
from strata.session import removed, written


def whole(docs: DataFrame) -> Column:
    """All columns of a row in one, so that no name of theirs can meet another."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def unfolded(rows: DataFrame, docs: DataFrame, **changes: Column) -> DataFrame:
    """The columns of docs from rows that hold them whole, some of them changed."""
    return rows.select(*[changes.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def digest(docs: DataFrame, *columns: str) -> Column:
    """A hash of columns that tells nulls from other values, and one column's from the next one's."""
    return F.xxhash64(*[x for c in columns for x in (docs[c].isNull(), docs[c])])


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows (doc, key) but for those whose key is in keys.

    Only rows that may be among the keys take part in the join, so most texts do not move.
    """
    gone = written(keys.select(F.col("key").alias("gone")).distinct(), "gone")
    may = passing(gone, "gone", gone.count())("key")
    told = rows.where(may).join(gone, F.col("key").eqNullSafe(F.col("gone")), "left_anti")
    return rows.where(~may).unionByName(told)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and from the others the lines that many documents of their host have.

    A null or empty text has too few words and is rejected. Repeated rows are copies of one
    text and stay or go together.
    """
    return quality.filtered(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go; lang becomes the language found.

    A row's key holds all that its decision depends on, so rows of one key have one decision.
    A null or empty text is kept if its declaration or host says enough.
    """
    key = F.struct(docs["doc_id"], digest(docs, "text", "lang", "source").alias("h"))
    rows = docs.select(whole(docs), key.alias("key"))
    told = docs.select(key.alias("doc_id"), "text", "lang", "source")
    found = langid.identified(langid.of_documents(told), langid.fitted(docs))
    found = written(found.withColumnRenamed("doc_id", "key"), "languages")
    kept = without(rows, found.where(~F.col("kept")))
    renamed = found.where(F.col("kept") & ~F.col("lang").eqNullSafe(F.col("declared"))).groupBy(F.col("key").alias("of")).agg(F.min("lang").alias("found"))
    both = kept.join(written(renamed, "renamed"), F.col("key").eqNullSafe(F.col("of")), "left")
    return unfolded(both, docs, lang=F.coalesce(F.col("found"), F.col("doc")["lang"]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id. Rows that repeat it go too.

    Keys are ordered as ids, null last, then by a hash of the text where texts share an id.
    Texts without words are no copies of each other, and all stay but repeated rows.
    """
    key = F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"], digest(docs, "text").alias("h"))
    rows = docs.select(whole(docs), key.alias("key"))
    found = neardup.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    found = written(found.withColumnRenamed("doc_id", "key"), "groups")
    repeated = written(found.where("kept").groupBy("key").count().where("count > 1").select("key"), "repeated")
    dropped = found.where(~F.col("kept")).select("key")
    if not repeated.limit(1).count():
        return unfolded(without(rows, dropped), docs)
    again = rows.join(repeated, "key", "left_semi").groupBy(F.col("doc")["doc_id"], F.col("doc")["text"]).agg(F.first("doc").alias("doc"))
    return unfolded(without(rows, dropped.unionByName(repeated)), docs).unionByName(unfolded(again, docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes [KIND]; n_chars follows. A null text stays null. Each row stays, repeated ones too."""
    clean = docs.select(whole(docs), pii.redacted(docs["text"]).alias("clean"))
    n = F.coalesce(F.length("clean").cast(docs.schema["n_chars"].dataType), F.col("doc")["n_chars"])
    return unfolded(clean, docs, text=F.col("clean"), n_chars=n)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 2048 ids; a null or empty text is one id."""
    return pack.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("MinHash near-dedup", near_dedup), ("PII", personal_data), ("best-fit packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            removed(before)
    return docs
