"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get the numbers 0..N-1 by (id, text crc, size), through a range sort and prefix sums of the partitions'
counts. A keyed Feistel network permutes the smallest even-bit power of two that holds N; numbers that fall
outside 0..N-1 are permuted again until they fall inside, which is a permutation of 0..N-1. The image p gives
shard p mod S and slot p div S, so both can be computed for any row number, and inverted, without the data.
Counts differ by one at most, slots have no gaps, and reruns agree. That is the law `rows`.

Defined cases: a null id sorts first; a null text has crc 0 and size 1; rows equal in all three are
interchangeable. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, saved


class Feistel:
    """A permutation of range(n), given by a seed. Arrays in, arrays out."""

    ROUNDS = 6

    def __init__(self, n: int, seed: int = 42):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mix(np.arange(1, self.ROUNDS + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(self.ROUNDS + 1))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (mix(left ^ key) & self.mask), left
            else:
                left, right = right, left ^ (mix(right ^ key) & self.mask)
        return left << np.uint64(self.half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while len(outside := np.flatnonzero(out >= np.uint64(self.n))):
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)

    def forward(self, x) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, x) -> np.ndarray:
        return self._walk(x, True)


def numbered(rows: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """rows (few, small columns) with their global numbers in ascending order, and how many there are.

    Only one pair (partition, count) per partition meets in one place."""
    tagged = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(tagged.groupBy(part.alias("part")).count().collect())
    bases = np.concatenate([[0], np.cumsum([c["count"] for c in counts], dtype=np.int64)]) if counts else np.zeros(1, np.int64)
    table = rows.sparkSession.createDataFrame([(int(c["part"]), int(b)) for c, b in zip(counts, bases)], "part long, base long")
    out = tagged.withColumn("part", part).join(F.broadcast(table), "part")
    return out.withColumn(name, F.col("base") + within).drop("at", "part", "base"), int(bases[-1])


def feistel_shards(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, row_number, shard, slot of every row."""
    text = F.col(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows, n = numbered(rows, ["id", "text_crc32", "size"])
    permutation = Feistel(n, seed)

    @F.pandas_udf("long")
    def permuted(number):
        import pandas as pd

        return pd.Series(permutation.forward(number.to_numpy()))

    rows = rows.withColumn("place", permuted("row_number"))
    return rows.select(
        F.col("id").alias(id_col), "size", "text_crc32", "row_number",
        (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"),
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    out = feistel_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _mixed(x: str, source: str) -> str:
    """mix() of column x of a query, as its column m, one subquery a step."""
    step = lambda shift, factor, inner: f"SELECT *, CAST(CAST(xor(m, m >> {shift}) AS UHUGEINT) * {factor} % 18446744073709551616 AS UBIGINT) AS y FROM ({inner})"
    renamed = lambda inner: f"SELECT * EXCLUDE (m, y), y AS m FROM ({inner})"
    out = renamed(step(30, 0xBF58476D1CE4E5B9, f"SELECT *, {x} AS m FROM {source}"))
    out = renamed(step(27, 0x94D049BB133111EB, out))
    return f"SELECT * EXCLUDE (m), xor(m, m >> 31) AS m FROM ({out})"


_ROUNDS = ", ".join(f"({j}, CAST({int(k)} AS UBIGINT))" for j, k in enumerate(Feistel(1).keys))
#: crc32 byte by byte; the rounds of the network row by row, again and again until the number falls inside.
ORACLE = f"""
WITH RECURSIVE g AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM g WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM g WHERE k = 8),
d AS (SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE octet_length(encode(text)) END + 1 AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
e AS (SELECT doc_id, size, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS crc FROM d, tab),
o AS (SELECT *, CAST(row_number() OVER (ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS UBIGINT) AS i FROM e),
z AS (SELECT CAST(n AS UBIGINT) AS n, half, CAST((1 << half) - 1 AS UBIGINT) AS mask FROM (SELECT count(*) AS n, greatest(1, (length(ltrim(bin(greatest(count(*) - 1, 1)), '0')) + 1) // 2) AS half FROM e)),
keys(j, key) AS (VALUES {_ROUNDS}),
w AS (SELECT i, 0 AS r, i >> half AS a, i & mask AS b FROM o, z
  UNION ALL SELECT i, r + 1, b, xor(a, m & mask) FROM ({_mixed("xor(b, key)", "(SELECT w.*, key, mask FROM w, z, keys WHERE j = r % 6 AND NOT (r > 0 AND r % 6 = 0 AND ((a << half) | b) < n))")})),
p AS (SELECT w.i, CAST((a << half) | b AS BIGINT) AS place FROM w, z WHERE r > 0 AND r % 6 = 0 AND ((a << half) | b) < n)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place % 8 AS INTEGER) AS shard, place // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM o JOIN p ON p.i = o.i
"""
