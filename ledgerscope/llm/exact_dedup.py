"""Exact deduplication by skew-safe combining; DataFrame functions only.

Texts are equal when they are identical after each run of white space became
one space; null counts as empty.  Per row the digest (SHA-256 of the
normalised text) is computed once.  Rows whose digest nobody shares are
finished.  The others are combined in three stages, each comparing the whole
normalised text and not the digest alone: inside every map task (partial
aggregation), then in groups salted by the document, then the salts' winners
globally.  A group that holds a third of all rows thus reaches the last stage
as a few rows.

Defined results: null or empty text is a text like any other; a null
``doc_id`` loses against any other; of rows that repeat a ``doc_id`` and a
text one is kept; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import SPACE, keep

SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _first(doc_id: str = "doc_id") -> Column:
    """Orders rows by doc_id, null last."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"))


def classes_of(texts: DataFrame, salts: int = SALTS) -> DataFrame:
    """(text_sha256, norm, keep_id, group_size): one row per distinct text of
    ``texts`` (doc_id, text_sha256, norm), in salted and global stages."""
    salted = (texts.groupBy("text_sha256", "norm", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
              .agg(F.min(_first()).alias("winner"), F.count("*").alias("n")))
    return (salted.groupBy("text_sha256", "norm")
            .agg(F.min("winner").alias("winner"), F.sum("n").alias("group_size"))
            .select("text_sha256", "norm", F.col("winner.doc_id").alias("keep_id"), "group_size"))


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    digests = keep(texts.select("doc_id", F.sha2("norm", 256).alias("text_sha256"))
                   .withColumn("row", F.monotonically_increasing_id()), "digests")
    shared = (digests.groupBy("text_sha256")
              .agg(F.count("*").alias("n"), F.min(F.struct(_first().alias("f"), F.col("row"))).alias("first"))
              .where("n > 1").select("text_sha256", F.col("first.row").alias("first_row")))
    ids = digests.join(shared, "text_sha256", "left_semi").select("doc_id").distinct()
    content = (texts.join(ids.hint("shuffle_hash"), texts.doc_id.eqNullSafe(ids.doc_id), "left_semi")
               .withColumn("text_sha256", F.sha2("norm", 256)))
    combined = keep(classes_of(content, salts)
                    .withColumn("only", F.count("*").over(Window.partitionBy("text_sha256")) == 1)
                    .select("text_sha256", F.when(~F.col("only"), F.col("norm")).alias("norm"), "keep_id",
                            "group_size", "only"), "classes")
    one = combined.where("only").select("text_sha256", "keep_id", "group_size").join(shared, "text_sha256")
    mine = digests.join(one, "text_sha256", "left")
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    result = mine.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                         size.alias("group_size"),
                         (F.col("first_row").isNull() | (F.col("first_row") == F.col("row"))).alias("kept"), "text_sha256")
    different = combined.where("not only")
    if different.isEmpty():
        return result
    # texts that differ under one digest: told apart by the text itself
    apart = (texts.withColumn("text_sha256", F.sha2("norm", 256))
             .join(different.select("text_sha256", "norm", "keep_id", "group_size"), ["text_sha256", "norm"]))
    nth = F.row_number().over(Window.partitionBy("text_sha256", "norm").orderBy(F.col("doc_id").asc_nulls_last()))
    return (result.join(different.select("text_sha256").distinct(), "text_sha256", "left_anti").select(result.columns)
            .unionByName(apart.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                                      (nth == 1).alias("kept"), "text_sha256")))


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` whose text no smaller doc_id has, all columns."""
    groups = (exact_groups(docs, salts).where("kept")
              .select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct())
    keyed = docs.withColumn("__key", F.sha2(normalised(F.col("text")), 256))
    kept = keyed.join(groups, keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__sha")), "left_semi")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # repeated rows
        kept = kept.dropDuplicates(["doc_id", "__key"])
    return kept.drop("__key")


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
