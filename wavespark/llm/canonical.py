"""Canonical exact digests (native: DataFrame functions only).

Canonical form: NFKC, full case folding, NFKC again, each run of white space one space, no white
space at the ends. The fingerprint is a 128-bit xxhash of it: XXH64 under two seeds. Documents are
grouped by fingerprint and, inside a fingerprint, by the bytes of the canonical form, so that two
forms with one fingerprint are two classes. A map-side step reduces copies before they move. An
exact digest knows no degrees: its likeness is 1 if equal, else 0.

ICU, which Spark ships, does the Unicode work through the SQL function java_method.

Defined results: a null text is empty; a null doc_id comes after all others by descending order;
repeated rows each get a row, ordered by text where doc_ids are equal; the next document of a lone
document is itself; an empty table gives no rows. doc_id is taken to be a key: rows of one doc_id
are ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cuts, documents, free_shuffles, range_of, text_of, written

def _nfkc(text: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(_nfkc(folded), r"(?U)\s+", " "))


def wide_digest(form: Column) -> Column:
    """32 hex digits: XXH64 of the bytes under seed 42, and under a second seed, that of a word."""
    halves = (F.xxhash64(form), F.xxhash64(F.lit("wide"), form))
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves)))


def fingerprint(text: Column) -> Column:
    """The digest of a text's canonical form; equal texts have equal digests."""
    return wide_digest(canonical(text))


def likeness(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(0.0)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per canonical form: fingerprint, form_sha256, class_id (least doc_id), class_size."""
    forms = docs.select(F.col(id_col).alias("doc_id"), canonical(text_of(text_col)).alias("form"))
    forms = forms.groupBy(wide_digest(F.col("form")).alias("fingerprint"), "form").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")
    )
    return forms.select("fingerprint", F.sha2("form", 256).alias("form_sha256"), "class_id", "class_size")


def with_next(docs: DataFrame, key: str, value: str, ranges: int | None = None) -> DataFrame:
    """(key, value, next_value): next by descending key, the first row's value after the last.

    Rows are dealt once, to ranges between quantiles of the key, four to a partition. Each range
    also gets a copy of the first row of the range that follows, so that a window over a range
    finds every next value; those copies are as many as the ranges.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(key, value, range_of(F.col(key), cuts(docs, key, ranges)).alias("range"))
    every = Window.orderBy(F.col("range").desc())
    follow = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = rows.groupBy("range").agg(F.max(key).alias("top")).select(
        "range",
        F.when(F.lead("range").over(every).isNull(), F.first("top").over(follow)).otherwise(F.lead("top").over(every)).alias("top"),
    )  # one row a range
    heads = docs.select(key, value).join(F.broadcast(tops), F.col(key).eqNullSafe(F.col("top")))
    heads = heads.groupBy("range").agg(F.max(key).alias(key), F.min(value).alias(value))
    both = rows.withColumn("own", F.lit(True)).unionByName(heads.withColumn("own", F.lit(False)))
    order = Window.partitionBy("range").orderBy(F.col("own").desc(), F.col(key).desc_nulls_last(), F.col(value))
    return both.withColumn("next_value", F.lead(value).over(order)).where("own").drop("own", "range")


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = with_next(rows, "doc_id", "text").withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half),
        F.substring(F.col("next_value"), F.lit(1), half),
    )
    rows = rows.select("doc_id", "n_chars", canonical(F.col("text")).alias("form"), canonical(F.col("next_value")).alias("next_form"), edited.alias("edited"))
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        wide_digest(F.col("form")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        wide_digest(F.col("next_form")).alias("next_fingerprint"),
        F.sha2("form", 256).alias("form_sha256"),
    )
    rows = written(rows, "fingerprints")
    free_shuffles(spark)
    same = written(classes(docs), "fingerprint-classes")
    return rows.join(same, ["fingerprint", "form_sha256"], "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "class_id",
        "class_size",
    )
