"""Mixing sources to target weights: capped water-filling, in DataFrame functions only.

Sources stand by code point, null last, and take ``weights`` in turn.  They share
``share`` times all words in proportion to their weights; a source stops at
``max_epochs`` times its own size and what it leaves goes to the others by weight
until none is above.  The repeated clamping has a closed form: with the sources
ordered by cap / weight, those are clamped whose ratio lies below the level that
the words left over would give them and all after them.

A source's target then becomes whole repetitions of every document plus one
fractional repetition: documents in the order of a seeded hash until the rest of
the target is reached, the last one by its leading words.  The running sum is
taken in hash ranges of about ``range_docs`` documents, so no source meets in one
task however large it is.

Null or empty texts have size 0 and nothing is taken; a null source is a source of
its own; equal rows stand side by side in the order and are each counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def unit_hash(seed: int, key: str = "doc_id") -> Column:
    """A uniform number in [0, 1) of 52 bits from md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, n_docs, source_size, target) from rows (source, n_docs, source_size), one for each source."""
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    ranked = ranked.withColumn("_w", turn).withColumn("_cap", F.col("source_size") * max_epochs)
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weight = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    ranked = ranked.withColumn("_level", left / weight).withColumn("_full", F.col("_level") >= F.col("_ratio"))
    level = F.min(F.when(~F.col("_full"), F.struct("_ratio", "_rank", "_level"))).over(every)["_level"]
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.coalesce(level, F.lit(0.0)))
    return ranked.select("source", "n_docs", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 17, range_docs: int = 4096) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words), whole (repetitions), part (words of the last one)."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), unit_hash(seed).alias("_u"))
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    goal = source_targets(per, weights, share, max_epochs).withColumnRenamed("source", "_source")
    ranged = sized.join(goal, sized["source"].eqNullSafe(goal["_source"])).drop("_source")
    ranged = ranged.withColumn("_range", F.floor(F.col("_u") * F.ceil(F.col("n_docs") / F.lit(float(range_docs)))))
    totals = ranged.groupBy("source", "_range").agg(F.sum("size").alias("_size"))
    up = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_size").over(up), F.lit(0)).alias("_base"))
    within = Window.partitionBy("source", "_range").orderBy("_u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = ranged.join(totals, ranged["source"].eqNullSafe(totals["_s"]) & (ranged["_range"] == totals["_r"]))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("bigint")
    out = out.withColumn("whole", whole)
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - F.col("_base") - F.col("_in")))
    out = out.withColumn("part", part)
    taken = F.col("whole") * F.col("size") + F.col("part")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "whole", "part")


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as the mix takes them: a row for each repetition, the fractional one with its leading words.

    ``n_chars`` follows the text where the table has it.  Documents are matched by
    doc_id; rows that share an id are counted off against one another.
    """
    turn = Window.partitionBy("doc_id").orderBy("size", "_k")
    left = docs.withColumn("_k", F.xxhash64("text")).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))
    left = left.withColumn("_n", F.row_number().over(turn)).withColumn("_id", F.col("doc_id"))
    right = mixed.select(F.col("doc_id").alias("_d"), "whole", "part", F.row_number().over(Window.partitionBy("doc_id").orderBy("size", "taken")).alias("_m"))
    both = left.join(right, left["_id"].eqNullSafe(right["_d"]) & (left["_n"] == right["_m"]))
    copies = F.col("whole") + (F.col("part") > 0).cast("bigint")
    both = both.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    cut = F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0)
    lead = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*', 0)")
    short = F.concat(cut, F.array_join(F.slice(lead, F.lit(1), F.col("part").cast("int")), ""))
    last = (F.col("_copy") > F.col("whole")) & (F.col("part") < F.col("size"))
    text = F.when(last, short).otherwise(F.col("text"))
    out = {c: F.col(c) for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(last, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return both.select(*[v.alias(k) for k, v in out.items()])


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0 AS u
  FROM documents),
per AS (SELECT source, sum(size)::bigint AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS rk FROM per),
weighed AS (
  SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3.0::double WHEN 1 THEN 1.0::double ELSE 2.0::double END AS w, source_size * 2 AS cap FROM ranked),
levels AS (
  SELECT *, cap / w AS ratio,
    (sum(source_size) OVER () * 1.5::double - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lev
  FROM weighed WINDOW o AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (
  SELECT source, source_size, CASE WHEN lev >= ratio THEN cap::double
    ELSE w * (SELECT lev FROM levels WHERE lev < ratio ORDER BY ratio, rk LIMIT 1) END AS target FROM levels),
cum AS (
  SELECT s.doc_id, s.size, f.source_size, f.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.u, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN f.source_size > 0 THEN floor(f.target / f.source_size)::bigint ELSE 0 END AS whole
  FROM sized s JOIN final f ON s.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (whole * size + greatest(0, least(size, round(target - whole * source_size)::bigint - before)))::bigint AS taken
FROM cum
"""
