"""Exact dedup by skew-safe combining, in DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space becomes one space.
1. Each map task combines the copies it holds (the partial side of the first aggregate).
2. What the tasks found meets in salted groups; the salt is the task's number, so a text with copies
   everywhere is spread over `salts` reducers, each of which gets one row from each of its tasks.
3. The salts' winners meet once more without the salt.
Every stage groups by digest *and* full normalised text, so equal digests never merge different texts.
Rows then look their class up by digest; digests under which step 3 found several texts (none with SHA-256,
but a caller may pass a weaker digest) are looked up by digest and text.

Defined cases: a null text counts as empty. A null id takes part; it stays only in a class without any id.
Of rows that repeat an id with the same text one is kept at most; they are counted with the first combining and
dealt out again at the end. Other columns are left out, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, saved


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (binary)."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    merged = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "text", "salt")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        .groupBy("digest", "text")
        .agg(F.min("id").alias("keep_id"), F.sum("n").alias("n"))
    )
    by_digest = merged.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), F.min("keep_id").alias("keep_id"))
    repeated = saved(by_digest.where("n > 1"), "dedup")
    members = rows.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    classes = repeated.where("texts = 1").select("digest", "n", "keep_id")
    clashing = repeated.where("texts > 1").select("digest")
    if clashing.isEmpty():
        found = members.join(classes, "digest", "left")
    else:
        apart = rows.join(clashing, "digest", "left_semi")
        texts = merged.join(clashing, "digest", "left_semi")
        found = members.join(clashing, "digest", "left_anti").join(classes, "digest", "left").select("digest", "id", "copies", "n", "keep_id")
        apart = apart.groupBy("id", "digest", "text").agg(F.count(F.lit(1)).alias("copies"))
        found = found.unionByName(apart.join(texts, ["digest", "text"]).select("digest", "id", "copies", "n", "keep_id"))
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (keep.eqNullSafe(F.col("id")) & (F.col("copy") == 1)).alias("kept"), F.col("digest"),
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
