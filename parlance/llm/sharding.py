"""Sharding by extendible hashing, in DataFrame functions only.

The directory is indexed by leading bits of a hash of the key.  A bucket above
``limit`` bytes, and no other, splits on one more bit until every shard fits.  A
histogram over the first bits holds many levels at once: each pass aggregates
bytes by prefix, rolls the prefixes up level by level, and gives each prefix the
first depth that fits.  Only prefixes that are still too large take part in the
next pass, with finer bits.

A document that is larger than the limit gets a shard of its own, marked
``overfull``; rows that share one key cannot be told apart by its hash and stay
together, marked likewise.  Null texts have 0 bytes, a null key hashes as 'null'.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm._spark import Workspace

BITS = 60


def shard(docs: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, shard (its bits), depth, shard_bytes, shard_docs, overfull."""
    work = Workspace(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    hashed = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), hashed.alias("_h"))
    rows = work.table(rows, "keys")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(3, math.ceil(math.log2(max(total / limit, 1))) + 3))
    left, done, step = rows, None, 0
    while True:
        cut = F.shiftright("_h", BITS - high)
        fine = left.groupBy(cut.alias("_p")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        fine = work.table(fine, f"fine_{step}")
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
        levels = levels.withColumn("_q", F.expr(f"_p div cast(pow(2, {high} - depth) as bigint)"))
        sums = levels.groupBy("depth", "_q").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        sums = sums.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == BITS))
        # A bucket's at most two parts lie beside each other, so that they meet by their parent's number; the parents of the first level are known not to fit.
        halves = sums.groupBy("depth", F.expr("_q div 2").alias("_parent")).agg(F.sum("shard_bytes").alias("_b"), F.sum("shard_docs").alias("_n"), F.collect_list(F.struct("_q", "shard_bytes", "shard_docs", "fits")).alias("_parts"))
        split = (F.col("depth") == low) | ((F.col("_b") > limit) & (F.col("_n") > 1))
        parts = work.table(halves.where(split).select("depth", F.inline("_parts")), f"parts_{step}")
        covered = F.explode(F.expr(f"sequence(_q * cast(pow(2, {high} - depth) as bigint), (_q + 1) * cast(pow(2, {high} - depth) as bigint) - 1)"))
        first = parts.where("fits").select("depth", "_q", "shard_bytes", "shard_docs", covered.alias("_p"))
        # The directory grows with the corpus and its files are much smaller than its rows: it never goes to the driver.
        placed = left.withColumn("_p", cut).join(first.hint("merge"), "_p").drop("_p")
        done = placed if done is None else done.unionByName(placed)
        over = parts.where((F.col("depth") == high) & ~F.col("fits")).select(F.col("_q").alias("_p"))
        if high == BITS or over.isEmpty():
            break
        left = work.table(left.withColumn("_p", cut).join(over.hint("merge"), "_p", "left_semi").drop("_p"), f"keys_{step}")
        low, high, step = high + 1, min(BITS, high + 8), step + 1
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin(F.col("_q")), F.col("depth"), F.lit("0")))
    return done.select("doc_id", "n_bytes", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("overfull"))


def sql(limit: int) -> str:
    """The same directory in DuckDB: for each row the first depth at which its bucket fits."""
    return f"""
WITH keys AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0)::bigint AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint AS h FROM documents),
levels AS (
  SELECT r, doc_id, n_bytes, d AS depth, h >> ({BITS} - d) AS q FROM keys, range(0, {BITS + 1}) t(d)),
sums AS (
  SELECT *, sum(n_bytes) OVER p AS shard_bytes, count(*) OVER p AS shard_docs FROM levels WINDOW p AS (PARTITION BY depth, q)),
best AS (
  SELECT * FROM sums WHERE shard_bytes <= {limit} OR shard_docs = 1 OR depth = {BITS}
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY depth) = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(q::bit::varchar, depth::int) END AS shard, depth::int AS depth,
  shard_bytes::bigint AS shard_bytes, shard_docs::bigint AS shard_docs, shard_bytes > {limit} AS overfull FROM best
"""
