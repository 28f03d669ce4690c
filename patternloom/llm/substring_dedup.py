"""Substring dedup by fixed-block anchors.

A window is `window` consecutive words. Every window holds a whole block of the document's grid of non-overlapping
blocks of (window + 1) // 2 words, so a window that starts anywhere else too makes one of its own blocks occur elsewhere.
1. Index and probe: the blocks of each document are the index; the hashes of every rolling run of block length are the
   probes. Both meet in hash buckets; a block whose hash is probed from a second place is an anchor. (Short hashes here:
   a false anchor only costs step 2 some work.)
2. Extend: around anchors, and only there, the windows that hold an anchor are hashed over their full length with 95 bits
   (two polynomials, so that 10^12 windows are told apart; words by 64 bits) and meet in buckets again. Those that occur twice are repeats; runs of them are the maximal exact repeats, whose
   union per document is what is cut out. All windows are judged on the input.
In both steps keys that repeat inside a task's batch are settled there, so a passage that a third of all documents
hold costs each batch one entry; no pairs of documents are made anywhere.

Defined cases: null and short texts have no windows and lose nothing; a null text keeps the empty string. Rows are
known by hashes of id and text, so null ids are ordinary, and rows that repeat id and text repeat each other. Empty
tables give an empty result. Other columns, whatever their names, are left out, or kept by `keep`.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, byte_column, input_mb, rolling, saved
from .keyed import bucket_bits, pack, repeated, slices, unpack

SHORT = 38  # bits of a block's hash below the bucket's
BATCH = 1_500_000  # words
SECOND = np.uint64(0xD6E8FEB86659FD93)  # base of the second polynomial
PLACE = np.dtype([("row", "<i8"), ("block", "<i4")])


def _anchors(rows: DataFrame, window: int, block: int, bits: int) -> DataFrame:
    """row (hash), blocks: the numbers of its anchors."""

    def probe(batches):
        import pyarrow as pa

        hashes, held, wanted, n = WordHashes(), [], [], 0
        kinds = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("places", pa.binary()), ("settled", pa.binary())])

        def flush():
            keys, count = np.unique(np.concatenate(held), return_counts=True)
            own = np.concatenate([k for k, _ in wanted])
            places = np.concatenate([p for _, p in wanted])
            at = np.searchsorted(keys, own)
            here = count[at] > 1
            order = np.argsort(at[~here], kind="stable")
            places, settled, at = places[~here][order], places[here], at[~here][order]
            value = ((keys << np.uint64(bits)) >> np.uint64(64 - SHORT) << np.uint64(2)) | (count > 1).astype(np.uint64)
            value[at] |= np.uint64(2)
            out = [{"bucket": TaskContext.get().partitionId() % (1 << bits), "settled": settled.tobytes()}] if len(settled) else []
            for bucket, a, b in slices(keys, bits):
                x, y = np.searchsorted(at, [a, b])
                out.append({"bucket": bucket, "keys": pack(value[a:b], 5), "places": places[x:y].tobytes()})
            return pa.RecordBatch.from_pylist(out, kinds)

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), byte_column(batch, "text")):
                words = text.split()
                if len(words) < window:
                    continue
                run = rolling(hashes.array(words), block)
                place = np.zeros(-(-len(run) // block), PLACE)
                place["row"], place["block"] = row, np.arange(len(place))
                held.append(run)
                wanted.append((run[::block], place))
                n += len(run)
                if n >= BATCH:
                    yield flush()
                    held, wanted, n = [], [], 0
        if n:
            yield flush()

    def meet(table):
        import pyarrow as pa

        found = [np.frombuffer(b, PLACE) for b in table.column("settled").to_pylist() if b]
        parts = [(unpack(k, 5), np.frombuffer(p, PLACE)) for k, p in zip(table.column("keys").to_pylist(), table.column("places").to_pylist()) if k]
        if parts:
            values = np.concatenate([v for v, _ in parts])
            key = values >> np.uint64(2)
            hit = repeated(key)
            multi = np.unique(key[(values & np.uint64(1)) > 0])
            hit |= np.isin(key, multi)
            want = (values & np.uint64(2)) > 0
            found.append(np.concatenate([p for _, p in parts])[hit[want]])
        found = np.concatenate(found) if found else np.zeros(0, PLACE)
        return pa.table({"row": pa.array(found["row"]), "block": pa.array(found["block"])})

    probes = rows.select("row", "text").mapInArrow(probe, "bucket long, keys binary, places binary, settled binary")
    hits = probes.groupBy("bucket").applyInArrow(meet, "row long, block int")
    return hits.groupBy("row").agg(F.collect_set("block").alias("blocks"))


def _repeats(rows: DataFrame, anchors: DataFrame, window: int, block: int, bits: int) -> DataFrame:
    """row, check (hashes), starts, ends: the word ranges of maximal repeats."""

    def extend(batches):
        import pyarrow as pa

        hashes, held, docs, n, number = WordHashes(), [], [], 0, 0
        kinds = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary()), ("places", pa.binary()), ("docs", pa.binary())])

        def flush():
            first, second, place = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = np.lexsort((second, first))
            first, second = first[order], second[order]
            new = np.ones(len(order), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            at = np.zeros(len(order), np.int64)
            at[order] = np.cumsum(new) - 1
            keys, rest, multi = first[new], second[new], np.bincount(at) > 1
            place = place.astype("<u4")
            where = np.zeros(len(keys), "<u4")
            where[at] = place
            batch = (TaskContext.get().partitionId() << 24) + number
            rest = rest & ~np.uint32(1) | multi.astype(np.uint32)
            out = [{"bucket": batch % (1 << bits), "batch": batch, "places": np.sort(place[multi[at]]).tobytes(), "docs": np.array(docs, "<i8").tobytes()}]
            for bucket, a, b in slices(keys, bits):
                out.append({"bucket": bucket, "batch": batch, "keys": keys[a:b].astype("<u8").tobytes() + rest[a:b].astype("<u4").tobytes(), "places": where[a:b][~multi[a:b]].tobytes()})
            return pa.RecordBatch.from_pylist(out, kinds)

        for batch in batches:
            for row, check, text, blocks in zip(*(batch.column(k).to_pylist() for k in (0, 1)), byte_column(batch, "text"), batch.column(3).to_pylist()):
                words = text.split()
                own = hashes.array(words)
                run, second = rolling(own, window), rolling(own, window, SECOND)
                anchor = np.zeros(len(words) // block + 2, bool)
                blocks = np.array(blocks, np.int64)
                anchor[blocks[blocks < len(anchor)]] = True  # others belong to a row whose hash is the same
                near = np.flatnonzero(anchor[-(-np.arange(len(run)) // block)])
                held.append((run[near], (second[near] >> np.uint64(32)).astype(np.uint32), near + n))
                docs.append((row, check, n))
                n += len(words)
                if n >= BATCH:
                    yield flush()
                    held, docs, n, number = [], [], 0, number + 1
        if docs:
            yield flush()

    def meet(table):
        import pyarrow as pa

        out, parts = [], []
        for batch, keys, places, docs in zip(*(table.column(c).to_pylist() for c in ("batch", "keys", "places", "docs"))):
            if docs is not None:
                out.append((batch, places, docs))
            else:
                n = len(keys) // 12
                parts.append((batch, np.frombuffer(keys, "<u8", n), np.frombuffer(keys, "<u4", n, 8 * n), np.frombuffer(places, "<u4")))
        if parts:
            first, second = (np.concatenate([x[k] for x in parts]) for k in (1, 2))
            order = np.lexsort((second >> np.uint32(1), first))
            same = (first[order][1:] == first[order][:-1]) & (second[order][1:] >> np.uint32(1) == second[order][:-1] >> np.uint32(1))
            hit = np.zeros(len(first), bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            at = 0
            for batch, _, v, places in parts:
                own = hit[at : at + len(v)][(v & np.uint32(1)) == 0]
                at += len(v)
                if own.any():
                    out.append((batch, places[own].tobytes(), None))
        batch, places, docs = zip(*out) if out else ((), (), ())
        return pa.table({"batch": pa.array(batch, pa.int64()), "places": pa.array(places, pa.binary()), "docs": pa.array(docs, pa.binary())})

    def ranges(table):
        import pyarrow as pa

        starts = np.unique(np.concatenate([np.frombuffer(p, "<u4") for p in table.column("places").to_pylist()])).astype(np.int64)
        docs = np.frombuffer(next(d for d in table.column("docs").to_pylist() if d is not None), "<i8").reshape(-1, 3)
        owner = np.searchsorted(docs[:, 2], starts, side="right") - 1
        out = {"row": [], "check": [], "starts": [], "ends": []}
        if len(starts):
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] > starts[:-1] + window)])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
            who, begin, end = owner[first], starts[first], starts[last] + window
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(who)) + 1, [len(who)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                row, check, base = docs[who[a]].tolist()
                for name, x in (("row", row), ("check", check), ("starts", (begin[a:b] - base).tolist()), ("ends", (end[a:b] - base).tolist())):
                    out[name].append(x)
        return pa.table({"row": pa.array(out["row"], pa.int64()), "check": pa.array(out["check"], pa.int64()), "starts": pa.array(out["starts"], pa.list_(pa.int32())), "ends": pa.array(out["ends"], pa.list_(pa.int32()))})

    near = rows.join(anchors, "row").select("row", "check", "text", "blocks")
    dealt = near.mapInArrow(extend, "bucket long, batch long, keys binary, places binary, docs binary")
    met = dealt.groupBy("bucket").applyInArrow(meet, "batch long, places binary, docs binary")
    return met.groupBy("batch").applyInArrow(ranges, "row long, check long, starts array<int>, ends array<int>").dropDuplicates(["row", "check"])


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_text (kept words joined by one space), spans removed; and the columns in keep."""
    keep, block = keep or [], (window + 1) // 2
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.struct(*keep).alias("_kept")] if keep else []
    rows = docs.select(F.col(id_col).alias("_id"), *kept, F.xxhash64(F.col(id_col), text).alias("row"), F.crc32(text.cast("binary")).alias("check"), text.alias("text"))
    bits = bucket_bits(input_mb(docs, text_col))
    anchors = saved(_anchors(rows.select("row", "text"), window, block, bits), "anchors")
    repeats = saved(_repeats(rows, anchors, window, block, bits), "repeats", drop=(anchors,))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            words, removed, texts, begins, ends = [], [], [], [], []
            at = batch.schema.get_field_index
            for text, a, b in zip(byte_column(batch, "text"), batch.column(at("starts")).to_pylist(), batch.column(at("ends")).to_pylist()):
                split = text.split()
                left, pos = [], 0
                for x, y in zip(a or (), b or ()):
                    left += split[pos:x]
                    pos = y
                left += split[pos:]
                words.append(len(split))
                removed.append(len(split) - len(left))
                texts.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(at(c)) for c in passed), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), batch.column(at("starts")), batch.column(at("ends"))],
                [*passed, "n_words", "n_removed", "kept_text", "starts", "ends"],
            )

    passed = ["_id", *(["_kept"] if keep else [])]
    joined = rows.join(repeats, ["row", "check"], "left").select(*passed, "text", "starts", "ends")
    schema = ", ".join([*(f"{c} {joined.schema[c].dataType.simpleString()}" for c in passed), "n_words long, n_removed long, kept_text string, starts array<int>, ends array<int>"])
    out = joined.mapInArrow(cut, schema)
    return out.select(F.col("_id").alias(id_col), *(["_kept.*"] if keep else []), "n_words", "n_removed", "kept_text", "starts", "ends")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, p, array_to_string(list_slice(w, p, p + 34), ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
rep AS (SELECT r, p FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT r, list(DISTINCT q) AS q FROM (SELECT r, unnest(range(p, p + 35)) AS q FROM rep) GROUP BY r),
w AS (SELECT r, list(x ORDER BY i) AS k FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) t
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, unnest(q) AS q FROM gone) g WHERE g.r = t.r AND g.q = t.i) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(gone.q), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(w.k, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.r = gone.r LEFT JOIN w ON d.r = w.r
"""
