"""Token-ID files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

Documents are range-sorted by id; each task encodes its range and writes three flat little-endian files: `.ids`
(unsigned 16 or 32 bits, by the vocabulary), `.offsets` (int64, one more than documents, from the part's start) and
`.docs` (int64 ids). The manifest has each part's counts; prefix sums over them give the parts' bases, so
a document's global start is base + local offset. A part counts only if the manifest names it, so files of
lost or repeated tasks do no harm.

Encoding: if the vocabulary file has the normaliser and pre-tokenizer SETTINGS, which never reach across white space, and
added tokens without any, pieces between ASCII white space are encoded apart, each distinct piece once per task. With any
other file whole texts are encoded. A test compares both.

Defined cases: a null text is empty and gets the end id only. A null id is written as the smallest int64, sorts
first and is read back as null, as an id of that value is. Rows that repeat an id are neighbours, by text. An empty table has no parts.
Other columns are left out.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from itertools import chain

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_column, local_path, open_fs, saved, workspace, write_whole

NO_ID = -(2**63)
MANIFEST = "part int, path string, docs long, ids long, width int"


#: The settings of a vocabulary file whose tokens never reach across white space.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """piece -> its ids as bytes, in two generations: when the young one is full it becomes the old one, and pieces that
    are met again move on, so frequent pieces are never encoded twice. Only a cache; the ids don't depend on it.

    Unknown pieces are encoded together, joined by spaces, and told apart by offsets; those of a-z alone go to the model
    itself if probes show that the tokenizer does nothing else with such. A piece of ASCII letters and digits
    with punctuation behind it is the ids of the one and then of the other, as the pre-tokenizer cuts there."""

    LIMIT = 200_000
    LETTERS = re.compile(rb"[a-z]+")
    TAIL = re.compile(rb"([0-9a-z]+)([!-&(-/:-@\[-`{-~]+)")

    def __init__(self, path: str, kind: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        text = self.tokenizer.to_str()
        found = json.loads(text[: text.index('"model":')].rstrip(" ,\n") + "}")  # the vocabulary comes last and is left out
        added = [t["content"] for t in found["added_tokens"]]
        self.by_piece = all(found[k] == v for k, v in SETTINGS.items()) and found["post_processor"] is None and all(t.startswith("<|") and not re.search(r"\s", t) for t in added)
        self.model = self.tokenizer.model
        probes = ["a", "xyz", "the", "zqj", "internationalisation", "s", "ll", "don"]
        self.direct = all(self.tokenizer.encode(p, add_special_tokens=False).ids == [t.id for t in self.model.tokenize(p)] for p in probes)

    def learn(self, pieces: set[bytes]) -> None:
        young, new, tails = self.young, set(), []
        for p in pieces:
            if p in self.old:
                young[p] = self.old[p]
            elif m := self.TAIL.fullmatch(p):
                tails.append((p, *m.groups()))
                new.update(x for x in m.groups() if x not in young and x not in self.old)
            elif p not in young:
                new.add(p)
        self.fresh(sorted(new))
        for p, core, tail in tails:
            young[p] = b"".join(young[x] if x in young else self.old[x] for x in (core, tail))

    def fresh(self, pieces: list[bytes]) -> None:
        if self.direct:
            tokenize, code, rest = self.model.tokenize, "H" if self.kind == "<u2" else "I", []
            for p in pieces:
                if self.LETTERS.fullmatch(p):
                    self.young[p] = array(code, [t.id for t in tokenize(p.decode())]).tobytes()
                else:
                    rest.append(p)
            pieces = rest
        for at in range(0, len(pieces), 512):
            part = [p.decode("utf-8", "replace") for p in pieces[at : at + 512]]
            starts = np.cumsum([0, *(len(p) + 1 for p in part)])
            code = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(code.ids, self.kind)
            owner = np.searchsorted(starts, np.array([a for a, _ in code.offsets], np.int64), side="right") - 1
            cuts = (np.searchsorted(owner, np.arange(len(part) + 1)) * ids.itemsize).tolist()
            data = ids.tobytes()
            for k, p in enumerate(pieces[at : at + 512]):
                self.young[p] = data[cuts[k] : cuts[k + 1]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as bytes. Lower case first, as the tokenizer folds it anyway, but not where an added token might stand."""
        if not self.by_piece:
            return [np.array(c.ids, self.kind).tobytes() for c in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        split = [(t.lower() if b"<|" not in t else t).split() for t in texts]
        pieces = set(chain.from_iterable(split))
        unknown = pieces.difference(self.young)
        if len(self.young) + len(unknown) > self.LIMIT:
            self.old, self.young = self.young, {}
            unknown = pieces
        self.learn(unknown)
        get = self.young.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


def _groups(texts: list[bytes], most: int = 1 << 20):
    """Ranges of texts that hold about `most` bytes, or one long text."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def write_tokens(docs: DataFrame, uri: str, vocabulary_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs' ids under uri; the manifest, saved. The vocabulary file is read on each executor from its path."""
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_file(vocabulary_path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")

    def write(batches):
        import pyarrow as pa

        part = TaskContext.get().partitionId()
        stem = f"{uri}/part-{part:05d}-{uuid.uuid4().hex[:12]}"
        encoder, end = PieceEncoder(vocabulary_path, kind), np.array([end_id], kind).tobytes()
        width, ids, lengths = np.dtype(kind).itemsize, [], []

        def pieces():
            for batch in batches:
                ids.append(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
                texts = byte_column(batch, "text")
                for a, b in _groups(texts):
                    code = [c + end for c in encoder.encode(texts[a:b])]
                    lengths.append(np.array([len(c) // width for c in code], np.int64))
                    yield b"".join(code)

        total = write_whole(f"{stem}.ids", pieces())
        if lengths:
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
            write_whole(f"{stem}.offsets", [offsets.tobytes()])
            write_whole(f"{stem}.docs", [np.concatenate(ids).astype("<i8").tobytes()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([stem]), pa.array([len(offsets) - 1], pa.int64()), pa.array([total // width], pa.int64()), pa.array([width], pa.int32())],
                ["part", "path", "docs", "ids", "width"],
            )

    return saved(rows.mapInArrow(write, MANIFEST), "tokens-manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with each part's base: ids in all parts before it. One row per part, so one window serves."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def mapped(uri: str, kind: str, start: int = 0, count: int | None = None) -> np.ndarray:
    """count values of a flat file from start on: a memory map where the store has paths, else one ranged read."""
    path, width = local_path(uri), np.dtype(kind).itemsize
    if count == 0:
        return np.zeros(0, kind)
    if path is not None:
        return np.memmap(path, kind, "r", start * width, None if count is None else (count,))
    store, path = open_fs(uri)
    with store.open_input_file(path) as file:
        count = file.size() // width - start if count is None else count
        return np.frombuffer(file.read_at(count * width, start * width), kind)


def read_tokens(spark: SparkSession, manifest: DataFrame, id_col: str = "doc_id", docs_per_task: int = 20_000) -> DataFrame:
    """id, start (global), tokens (ids as little-endian unsigned 32 bits) of every document, from the files."""
    ranges = with_bases(manifest).withColumn("first", F.explode(F.expr(f"sequence(0L, docs - 1, {docs_per_task}L)")))
    n = max(1, min(ranges.count(), 100_000))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                first, count = r["first"], min(docs_per_task, r["docs"] - r["first"])
                offsets = mapped(f"{r['path']}.offsets", "<i8", first, count + 1)
                names = mapped(f"{r['path']}.docs", "<i8", first, count)
                flat = mapped(f"{r['path']}.ids", f"<u{r['width']}", int(offsets[0]), int(offsets[-1] - offsets[0]))
                at = offsets - offsets[0]
                for a in range(0, count, 500):
                    b = min(a + 500, count)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(names[a:b]), mask=np.asarray(names[a:b]) == NO_ID), pa.array(np.asarray(offsets[a:b]) + r["base"]), pa.array([flat[at[k] : at[k + 1]].astype("<u4").tobytes() for k in range(a, b)], pa.binary())],
                        [id_col, "start", "tokens"],
                    )

    return ranges.repartition(n).mapInArrow(read, f"{id_col} long, start long, tokens binary")


def digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return tokens.select(id_col, "start", F.expr("cast(octet_length(tokens) div 4 as long)").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32"))


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), workspace(spark, "tokens"), vocabulary())
    return digests(read_tokens(spark, manifest))
