"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of `window` words (an item with fewer words is one window). The tokens of a
window are its shingles of `shingle` words. A document holds a window only if it holds all of its shingles,
so of the shingles in order of rarity (document frequency over the whole corpus, then code) a prefix of one
is enough: the rarest. Documents are probed with it; each hit fixes where the window would start, which gives
the length bound (the window must end inside the document) and the positional bound (it must begin inside it);
what remains is verified word by word over the item-sized window. Shingles are known by 64-bit hashes; two with the
same hash cost a verification more and change nothing.

The benchmark is a stated query set. Its windows are cut into blocks of `block_windows`, a long item into several; a
block is a file in the shared folder. The driver holds one block at a time, and so does a task: every batch of documents
meets one block after another, in one job that counts and one that judges, whatever the number of blocks.

Defined cases: null texts and texts without words have no words and no hits; an item without words has no window.
Rows that repeat an item_id are one item; a null item_id counts as an item named `null`. Documents are judged row
by row, so null and repeated ids need no care. Empty tables give an empty result, or no hits. Other columns are
left out, whatever their names, or kept in the struct `kept`.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, discard, mix, read_whole, saved, workspace, write_whole

#: Digits, ASCII letters in lower case and all other UTF-8 bytes stay; the rest separates words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class Block:
    """Windows of some items, as word numbers from 1 on, with the shingle by which each is probed."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        self.shingle, self.window = shingle, window
        numbers: dict[str, int] = {}
        seen: dict[tuple[int, ...], set[int]] = {}
        for name, words in items:
            number = numbers.setdefault(name, len(numbers))
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                seen.setdefault(tuple(ids[k : k + window]), set()).add(number)
        self.names = list(numbers)
        self.lengths = np.array([len(w) for w in seen], np.int64)
        self.windows = np.zeros((len(seen), window), np.int32)
        for k, w in enumerate(seen):
            self.windows[k, : len(w)] = w
        # items of window k: owners[owned[k]:owned[k + 1]], numbers in names
        self.owned = np.cumsum([0, *map(len, seen.values())])
        self.owners = np.fromiter((i for x in seen.values() for i in sorted(x)), np.int32)
        # distinct shingles of all windows; a window shorter than a shingle has itself, filled with zeros
        self.codes = np.unique(np.concatenate([c.ravel() for _, c in self._shingles()])) if seen else np.zeros(0, np.uint64)

    def _shingles(self):
        """(window numbers, codes of their shingles, one row a window) for each length of windows."""
        for length in np.unique(self.lengths):
            own = np.flatnonzero(self.lengths == length)
            n = min(self.shingle, int(length))
            yield own, np.stack([self._code([self.windows[own, k + j] for j in range(n)]) for k in range(int(length) - n + 1)], 1)

    def _code(self, columns: list[np.ndarray]) -> np.ndarray:
        """Hashes of shingles whose words, as numbers, are given column by column; filled with zeros to the full size."""
        code = np.zeros(len(columns[0]), np.uint64)
        for k in range(self.shingle):
            code = code * BASE + (columns[k].astype(np.uint64) if k < len(columns) else np.uint64(0))
        return mix(code)

    def codes_at(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, codes) of the runs of n word numbers in which all words are known."""
        m = len(ids) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        known = np.ones(m, bool)
        for k in range(n):
            known &= ids[k : k + m] > 0
        where = np.flatnonzero(known)
        return where, self._code([ids[where + k] for k in range(n)])

    def sizes(self) -> list[int]:
        return sorted({min(self.shingle, int(n)) for n in np.unique(self.lengths)})

    def found(self, ids: np.ndarray) -> np.ndarray:
        """Numbers (in codes) of the shingles that occur in ids."""
        out = []
        for n in self.sizes():
            _, code = self.codes_at(ids, n)
            at = np.searchsorted(self.codes, code)
            at[at == len(self.codes)] = 0
            out.append(at[self.codes[at] == code])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def choose(self, frequency: np.ndarray) -> None:
        """Give each window its rarest shingle, the first in code order if several are; frequency by number in codes."""
        code, offset = np.zeros(len(self.lengths), np.uint64), np.zeros(len(self.lengths), np.int64)
        for own, codes in self._shingles():
            rank = frequency[np.searchsorted(self.codes, codes)]
            best = np.zeros(len(own), np.int64)
            row = np.arange(len(own))
            for k in range(1, codes.shape[1]):
                better = (rank[:, k] < rank[row, best]) | ((rank[:, k] == rank[row, best]) & (codes[:, k] < codes[row, best]))
                best[better] = k
            code[own], offset[own] = codes[row, best], best
        self.at_window = np.argsort(code, kind="stable")
        self.at_offset = offset[self.at_window]
        self.anchors, first = np.unique(code[self.at_window], return_index=True)
        self.first = np.append(first, len(code))
        self.codes = None

    def match(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window numbers, starts) of all occurrences in one document."""
        got_w, got_s = [], []
        for n in self.sizes():
            where, code = self.codes_at(ids, n)
            at = np.searchsorted(self.anchors, code)
            at[at == len(self.anchors)] = 0
            hit = self.anchors[at] == code
            where, at = where[hit], at[hit]
            if not len(where):
                continue
            count = self.first[at + 1] - self.first[at]
            entry = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            w = self.at_window[entry]
            start = np.repeat(where, count) - self.at_offset[entry]
            inside = (start >= 0) & (start + self.lengths[w] <= len(ids)) & (np.minimum(self.lengths[w], self.shingle) == n)
            w, start = w[inside], start[inside]
            for k in range(self.window):
                ok = (k >= self.lengths[w]) | (ids[np.minimum(start + k, len(ids) - 1)] == self.windows[w, k])
                w, start = w[ok], start[ok]
            got_w.append(w)
            got_s.append(start)
        return (np.concatenate(got_w), np.concatenate(got_s)) if got_w else (np.zeros(0, np.int64),) * 2

    def items(self, windows: np.ndarray) -> set[str]:
        return {self.names[i] for w in np.unique(windows) for i in self.owners[self.owned[w] : self.owned[w + 1]]}

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


def pieces_of(items: DataFrame, item_col: str, text_col: str, window: int, block_windows: int):
    """Lists of (item, words) with block_windows windows each, but the last: all windows, each once an item."""
    held, room = [], block_windows
    for name, text in items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")), text_col).toLocalIterator():
        words = words_of(None if text is None else text.encode())
        at, total = 0, max(1, len(words) - window + 1) if words else 0
        while at < total:
            take = min(room, total - at)
            held.append((name, words[at : at + take + window - 1]))
            at, room = at + take, room - take
            if not room:
                yield held
                held, room = [], block_windows
    if held:
        yield held


def _blocks(docs: DataFrame, items: DataFrame, window: int, shingle: int, block_windows: int, text_col: str, item_col: str) -> tuple[str, int]:
    """Write the blocks, each window with its rarest shingle; their folder and number."""
    spark, folder, n = docs.sparkSession, workspace(docs.sparkSession, "blocks"), 0
    for held in pieces_of(items, item_col, text_col, window, block_windows):
        write_whole(f"{folder}/{n}", [pickle.dumps(Block(held, window, shingle))])
        n += 1

    def seen(batches):
        import pyarrow as pa

        number, block, total = -1, None, None

        def counted():
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array(some), pa.array(total[some])], ["block", "code", "n"])

        for batch in batches:
            texts = byte_column(batch, text_col)
            for k in range(n):
                if k != number:
                    if block is not None:
                        yield counted()
                    number, block = k, pickle.loads(read_whole(f"{folder}/{k}"))
                    total = np.zeros(len(block.codes), np.int64)
                for text in texts:
                    total[block.found(block.ids(words_of(text)))] += 1
        if block is not None:
            yield counted()

    if n:
        counts = docs.select(text_col).mapInArrow(seen, "block long, code long, n long").groupBy("block", "code").agg(F.sum("n").alias("n"))
        counts = saved(counts, "frequencies")
        for k in range(n):
            block = pickle.loads(read_whole(f"{folder}/{k}"))
            frequency = np.zeros(len(block.codes), np.int64)
            for row in counts.where(F.col("block") == k).toLocalIterator():  # as many as the block has shingles
                frequency[row["code"]] = row["n"]
            block.choose(frequency)
            write_whole(f"{folder}/{k}-chosen", [pickle.dumps(block)])
        discard(counts)
    return folder, n


def contamination(docs: DataFrame, items: DataFrame, window: int = 8, shingle: int = 3, min_items: int = 2, block_windows: int = 200_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", keep: list[str] | None = None) -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items (sorted names), contaminated; and `kept`, a struct of the columns in keep.

    Reads its blocks when it runs; discard() deletes them."""
    folder, n = _blocks(docs, items, window, shingle, block_windows, text_col, item_col)
    passed = ["_id", *(["kept"] if keep else [])]

    def judge(batches):
        import pyarrow as pa

        number, block = -1, None
        for batch in batches:
            texts = byte_column(batch, "_text")
            names, hits, n_words = [set() for _ in texts], [None] * len(texts), [len(words_of(t)) for t in texts] if n != 1 else [0] * len(texts)
            for k in range(n):
                if k != number:
                    number, block = k, pickle.loads(read_whole(f"{folder}/{k}-chosen"))
                for i, text in enumerate(texts):
                    words = words_of(text)
                    n_words[i] = len(words)
                    w, start = block.match(block.ids(words))
                    if len(w):
                        if hits[i] is None:
                            hits[i] = np.zeros(len(words) + 1, np.int64)
                        np.add.at(hits[i], start, 1)
                        np.add.at(hits[i], start + block.lengths[w], -1)
                        names[i] |= block.items(w)
            n_hit = [0 if h is None else int((np.cumsum(h)[:-1] > 0).sum()) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in passed), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
                 pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array([len(x) >= min_items for x in names], pa.bool_())],
                [*passed, "n_words", "n_hit", "n_items", "items", "contaminated"],
            )

    own = docs.select(F.col(id_col).alias("_id"), *([F.struct(*keep).alias("kept")] if keep else []), F.col(text_col).alias("_text"))
    schema = ", ".join([*(f"{c} {own.schema[c].dataType.simpleString()}" for c in passed), "n_words long, n_hit long, n_items long, items array<string>, contaminated boolean"])
    out = own.mapInArrow(judge, schema).withColumnRenamed("_id", id_col)
    out.saved_path = folder
    return out


def item_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS k, array_to_string(list_slice(w, p, p + least(len(w), 8) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS p FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT g.doc_id, g.p, g.k, win.item_id FROM grams g JOIN win ON g.k = win.k AND g.s = win.s),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
