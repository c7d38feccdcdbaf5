"""From documents to packed sequences: five stages, each written as Parquet and read again.

Language identification drops what has no language; exact and near duplicates leave one document a
group; the mix repeats, keeps, cuts or drops documents to its targets; packing gives the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespark.llm import exact, language, mixing, near, packing
from wavespark.llm.common import new_path, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Posterior probability under which a text's language counts as unknown.
SURE = 0.5


def _rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with a number for each row: doc_id may be null or repeat."""
    return written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "pipeline-rows")


def _one_each(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Of rows whose key is in kept, the one of least doc_id, a null last, then of least text.

    Copies meet on the map side first, and the join deals by the same key, so texts move once.
    """
    least = rows.groupBy(key).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *COLUMNS)).alias("row"))
    return least.join(kept.select(key), key, "left_semi").select(*(f"row.{c}" for c in COLUMNS))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known; a text without letters has none."""
    model = language.learn(docs)
    rows = language.predict_rows(docs.select(*COLUMNS), model)
    return rows.where((F.col("language.lang_pred") != "und") & (F.col("language.score") >= SURE)).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    kept = exact.exact_dedup(docs).where("kept")
    return _one_each(docs.select(*COLUMNS, exact.text_digest().alias("digest")), kept, "digest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each class of five-word shingles' similarity 0.8 or more."""
    kept = near.kept(near.near_classes(docs))
    return _one_each(docs.select(*COLUMNS, near.text_key().alias("key")), kept, "key")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; a partial copy has its first words alone."""
    rows = _rows(spark, docs)
    plan = mixing.mix(rows, quality=mixing.label_weights(table(spark, sf_dir, "labels")), row_col="row")
    plan = plan.where("epochs > 0 OR part > 0").select("row", F.col("epochs").cast("int").alias("epochs"), F.col("part").cast("int").alias("part"))
    rows = rows.join(plan, "row")
    whole = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    whole = whole.where((F.col("copy") > 0) | (F.col("part") > 0))
    return whole.select(
        "doc_id",
        F.when(F.col("copy") > 0, F.col("text")).otherwise(mixing.first_words(F.col("text"), F.col("part"))).alias("text"),
        "lang",
        "source",
        "n_chars",
    ).withColumn("n_chars", F.char_length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No stage but exact deduplication can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
