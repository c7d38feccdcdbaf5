"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of a budget by weight, at most a multiple of its size; what goes over
is shared again among the others. Of a target, whole epochs come first: every document that often.
The rest is sampled: each document has the key -ln(u) / quality with u uniform from a hash of its
id, documents are taken by ascending key, and sizes are added up until the rest is reached. The
document at the border gives as many of its first words as are missing, so a source's taken words
are its target, rounded down.

Scale: a key's place is its rank among exponential keys, 1 - exp(-key), cut into BINS equal parts.
Sizes are first summed by source and bin; a running sum over those finds the bin at the border, and
a sum over rows is needed inside a bin only. No task holds a source.

Defined results: a null text has size 0; a null source is a source, ordered last; a null or
non-positive quality counts as 1; equal keys go by doc_id, then size; repeated rows are documents
each; sources of size 0 take nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, documents, table, text_of, written

BINS = 1024

#: The weights of op1, by place of the source in code-point order, again and again.
WEIGHTS = (3, 1, 2)

#: Quality weights by label; unlabelled documents count as 1.
QUALITY = {1: 2.0, 0: 0.5}


def n_words(text: Column) -> Column:
    """How many runs of anything but ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text as far as its first n words: what stands before a word stays with it."""
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(parts, F.lit(1), n), "")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the MD5 of the seed and the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources whose cap is reached first come first; the level, words for a unit of weight, is what is
    left of the budget by what is left of the weights, once the capped ones are out.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    rows = sizes.withColumn("place", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(kinds, (F.col("place") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("budget", F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = F.when(F.col("budget") / F.col("open") <= F.col("cap") / F.col("weight"), F.col("budget") / F.col("open"))
    # The level stands at the first source that isn't capped; none is capped after it.
    rows = rows.withColumn("level", F.first(level, ignorenulls=True).over(every))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    quality: DataFrame | None = None,
    seed: int = 1,
    bins: int = BINS,
    row_col: str | None = None,
) -> DataFrame:
    """What the mix takes of each document.

    docs: doc_id, text, source. quality: (doc_id, weight), a row a document, or None. share: the
    budget as a multiple of all sizes; most: a target's cap as a multiple of its source's size.
    row_col: a column that tells rows of one doc_id apart and is returned too, or None.
    Returns doc_id, source, size, source_size, target, epochs (whole copies), part (words of the
    last, partial copy), taken (words in all).
    """
    own = [row_col] if row_col else []
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(text_of()).alias("size"), *own
    )
    rows = written(rows, "mix-sizes")  # texts are read once and don't move
    weight = F.lit(1.0)
    if quality is not None:
        rows = rows.join(quality.select("doc_id", F.col("weight").cast("double").alias("weight")), "doc_id", "left")
        weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    rows = rows.select("doc_id", "source", "size", *own, (-F.log(uniform(F.col("doc_id"), seed)) / weight).alias("key"))
    rows = rows.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * bins), F.lit(bins - 1)).cast("int"))
    summed = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    goal = targets(summed.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, most)
    above = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    summed = summed.withColumn("above", F.coalesce(F.sum("bin_size").over(above), F.lit(0)))
    same = F.col("s.source").eqNullSafe(F.col("g.source"))
    plan = summed.alias("s").join(goal.alias("g"), same).select("s.source", "s.bin", "above", "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("epochs", whole.cast("long"))
    plan = plan.withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    same = F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bin") == F.col("p.bin"))
    rows = rows.alias("r").join(plan.alias("p"), same).drop(F.col("p.source"), F.col("p.bin"))
    inside = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("above") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before)).cast("long"))
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", "part", taken.alias("taken"), *own)


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from labels (doc_id, quality)."""
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("label"))
    weight = F.when(F.col("label") == 1, QUALITY[1]).when(F.col("label") == 0, QUALITY[0]).otherwise(1.0)
    return one.select("doc_id", weight.alias("weight"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(documents(spark, sf_dir), quality=label_weights(table(spark, sf_dir, "labels")))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


SQL = r"""
WITH q AS (
  SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM labels GROUP BY doc_id
), d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((list_sum(list_transform(range(1, 14), lambda i: (instr('0123456789abcdef', substr(md5('1:' || doc_id), i, 1)) - 1)
              * (16::BIGINT ** (13 - i))))::DOUBLE + 0.5) / 4503599627370496.0) / coalesce(weight, 1.0) AS key
  FROM documents LEFT JOIN q USING (doc_id)
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT source, source_size, place, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap FROM s
), b AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0) AS budget,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open
  FROM w WINDOW o AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (SELECT min_by(budget / open, cap / weight) FROM b WHERE budget / open <= cap / weight) AS level FROM b
), t AS (
  SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM l
), e AS (
  SELECT doc_id, size, source_size, target, d.source,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before))::BIGINT AS taken, source, epochs
FROM e
"""
