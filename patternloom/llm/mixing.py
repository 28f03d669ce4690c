"""Mixing sources to target weights by a low-discrepancy source schedule.

1. Targets: sources in code-point order (null last) have the weights 5, 2, 1, repeating, and share `share` times
   all words; no target exceeds `most` times its source, and what is cut off is shared again by weight.
2. Blocks: a source's documents are put into a seeded hash order and laid end to end; every `block` words of that
   stream are one block, so all blocks of a source but its last are equal. Positions come from prefix sums in two
   levels (hash buckets of a source, then rows of a bucket), so no source is one task's work.
3. Schedule: slot k has the golden-ratio point frac((k+1) * phi); the source whose stretch of the cumulative weights
   holds the point owns the slot. Slots are ranked per source; rank r takes block r mod (blocks of the source), in
   pass r div (blocks). Each source uses its first ceil(target / block) slots; slots that low discrepancy leaves
   short follow at the end. The last slot is cut so that a source gives round(target) words exactly.
4. Join: slots with blocks, blocks with the documents' pieces. A block gives a document each of its words once a
   pass, so none gives more than `most` = 2 times its size.

Defined cases: null text has no words; a document without words is in no block and gives 0. A null source is a
source. Rows with null or repeated ids are documents of their own, told apart by size and text, else
interchangeable. An empty table gives an empty result. Other columns are left out (`mixed`: kept unchanged).
The list of sources, one row each, goes through the driver, which needs some 300 bytes a source; nothing is cut off.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, fresh, saved

WEIGHTS = (5, 2, 1)
PHI = (math.sqrt(5) - 1) / 2

def fill_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most * size; the excess goes to the others by weight, until none is above."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in over)
        open_ -= set(over)
    return targets


def golden(start: int, stop: int) -> np.ndarray:
    """Points frac((k+1) * phi) for k in start..stop-1, from integers so that every machine agrees."""
    step = np.uint64(round(PHI * 2**64) & (2**64 - 1) | 1)
    with np.errstate(over="ignore"):
        return (np.arange(start + 1, stop + 1, dtype=np.uint64) * step).astype(np.float64) / 2.0**64


def hashes(id_col: str, text_col: str, seed: int) -> tuple[Column, Column]:
    """The seeded order of a row, and 64 bits more that tell rows apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(F.lit(seed), F.col(id_col), text), F.xxhash64(text, F.col(id_col), F.lit(~seed))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """id, source, size and the hashes of every document: small columns only."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h, g = hashes(id_col, text_col, seed)
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(NOT_SPACE)).cast("long").alias("size"),
        h.alias("h"), g.alias("g"),
    )


def low_discrepancy_mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, slots: int = 1 << 18, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents: id, source, size, source_size, target, start (of its first word in its source's stream), taken;
    schedule: slot, source, pass, block, words)."""
    spark = docs.sparkSession
    rows = saved(measured(docs, id_col, text_col, source_col, seed), "mix")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    per_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in per_source]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    goals = [min(round(t), int(most * n)) for t, n in zip(targets, sizes)]
    total = sum(goals)
    block = max(1, -(-total // slots))
    sources = spark.createDataFrame(
        [(i, r["source"], n, t, g) for i, (r, n, t, g) in enumerate(zip(per_source, sizes, targets, goals))],
        "source_id int, source string, source_size long, target double, goal long",
    )

    # positions in the source's stream
    buckets = max(256, sum(r["rows"] for r in per_source) // 50_000)
    rows = rows.join(F.broadcast(sources.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("bucket", F.expr(f"cast(shiftrightunsigned(h, 33) * {buckets} / {1 << 31} as long)"))
    bases = rows.groupBy("source_id", "bucket").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("source_id", "bucket", F.coalesce(F.sum("words").over(up_to), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_id", "bucket").orderBy(F.shiftrightunsigned("h", 33), "h", "g", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(bases, ["source_id", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    # slots of the schedule
    need = [g // n * -(-n // block) + -(-(g % n) // block) if n else 0 for g, n in zip(goals, sizes)]
    blocks = [max(1, -(-n // block)) for n in sizes]
    edges = np.cumsum([g / max(total, 1) for g in goals])[:-1]

    def owners(batches):
        import pyarrow as pa

        for batch in batches:
            k = batch.column(0).to_numpy()
            if len(k):
                points = golden(int(k[0]), int(k[-1]) + 1)[k - k[0]]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.searchsorted(edges, points, side="right").astype(np.int32))], ["slot", "source_id"])

    length = int(sum(need) * 1.01) + 64 if total else 0
    drawn = spark.range(length).mapInArrow(owners, "slot long, source_id int")
    rank = Window.partitionBy("source_id", "part").orderBy("slot")
    drawn = drawn.withColumn("part", F.expr("slot div 4096"))
    before = Window.partitionBy("source_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("source_id", "part").count()
    counts = counts.select("source_id", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    drawn = drawn.join(counts, ["source_id", "part"]).select("slot", "source_id", (F.col("base") + F.row_number().over(rank) - 1).alias("rank"))
    wanted = spark.createDataFrame([(i, n, b, g) for i, (n, b, g) in enumerate(zip(need, blocks, goals))], "source_id int, need long, blocks long, goal long")
    wanted = wanted.join(F.broadcast(sources.select("source_id", "source_size")), "source_id")
    got = drawn.groupBy("source_id").count()
    late = (
        wanted.join(got, "source_id", "left").where("need > coalesce(count, 0)")
        .select("source_id", F.explode(F.sequence(F.coalesce("count", F.lit(0)), F.col("need") - 1)).alias("rank"))
        .withColumn("slot", F.lit(length) + F.col("rank"))
    )
    slots_of = drawn.unionByName(late).join(F.broadcast(wanted), "source_id").where("rank < need")
    schedule = slots_of.withColumn("pass", F.expr("rank div blocks")).withColumn("block", F.col("rank") % F.col("blocks"))
    # words of the stream that the slot's block has, less what would pass the goal in the last pass
    whole = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    taken_before = F.col("pass") * F.col("source_size") + F.col("block") * block
    schedule = schedule.withColumn("words", F.greatest(F.lit(0), F.least(whole, F.col("goal") - taken_before))).where("words > 0")

    # a block's use: how often it is taken whole, and how many of its first words once more
    used = schedule.groupBy("source_id", "block").agg(
        F.sum(F.when(F.col("words") == whole, 1).otherwise(0)).alias("times"), F.max(F.when(F.col("words") < whole, F.col("words")).otherwise(0)).alias("rest"),
    )
    piece = (
        rows.where("size > 0")
        .withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
        .withColumn("from", F.greatest(F.col("start"), F.col("block") * block) - F.col("block") * block)
        .withColumn("to", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("block") * block)
    )
    keys = ["source_id", "h", "g", "id", "size", "start"]
    words = F.col("times") * (F.col("to") - F.col("from")) + F.greatest(F.lit(0), F.least("to", "rest") - F.col("from"))
    taken = piece.join(used, ["source_id", "block"], "left").groupBy(*keys).agg(F.sum(F.coalesce(words, F.lit(0))).cast("long").alias("taken"))
    documents = taken.unionByName(rows.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken")))
    documents = documents.join(F.broadcast(sources), "source_id").select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "start", "taken", "h", "g")
    return documents, schedule.select("slot", "source_id", "pass", "block", "words")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs as the mix takes them: whole documents, each as often as the mix takes it to the nearest number of passes.

    Documents without words carry no weight and stay once. Rows are looked up by seeded hash and text digest; those that repeat
    id and text count as the one of them that the mix takes most often."""
    documents, _ = low_discrepancy_mix(docs, id_col=id_col, text_col=text_col, **options)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    h, g, n, copy = (fresh(c, docs.columns) for c in ("h", "g", "copies", "copy"))
    copies = documents.groupBy(F.col("h").alias(h), F.col("g").alias(g)).agg(F.max(copies).alias(n)).where(F.col(n) > 0)
    keyed = docs.withColumns(dict(zip((h, g), hashes(id_col, text_col, options.get("seed", 42)))))
    return keyed.join(saved(copies, "copies"), [h, g]).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    documents, _ = low_discrepancy_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")
