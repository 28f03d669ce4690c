"""Helpers that the training-data operators share: the shared folder, tables written to cut
lineage, file access from executors, and word splitting."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts state it; bytes.split() without an argument cuts at the same bytes.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local[...] session without that setting gets a folder of its own, removed at exit."""
    global _local_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="patternloom-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return f"file://{_local_dir}"


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared folder; each call has its own."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, drop: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later jobs start from the files,
    so a lost executor costs no earlier stage, and shuffle files behind it can go. The tables in drop, made by
    saved() and needed no longer, are deleted then."""
    spark = df.sparkSession
    path = workspace(spark, name)
    df.write.parquet(path)
    schema = df.schema
    discard(*drop)
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.saved_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by saved(); nothing may read them from then on."""
    for table in tables:
        remove(table.sparkSession, table.saved_path)


def fresh(name: str, columns: list[str]) -> str:
    """A name for a helper column that no column of the caller has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by workspace()."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop shuffle files that no live plan needs."""
    gc.collect()
    spark._jvm.System.gc()


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The plain path of a file:// URI, which can be memory-mapped; None for other stores."""
    if uri.startswith("file:"):
        return re.sub(r"^file:/+", "/", uri)
    return uri if uri.startswith("/") else None


def write_whole(uri: str, pieces) -> int:
    """Write byte pieces to a new file under a temporary name, then move it into place; bytes written.

    A task that dies leaves only a file that no manifest names."""
    store, path = open_fs(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with store.open_output_stream(temporary) as out:
        for piece in pieces:
            out.write(piece)
            n += len(piece)
    store.move(temporary, path)
    return n


def read_whole(uri: str) -> bytes:
    """The bytes of a file that write_whole() made."""
    store, path = open_fs(uri)
    with store.open_input_stream(path) as file:
        return file.read()


def input_mb(df: DataFrame, text_col: str = "text") -> float:
    """Size of df in MB, used only to set numbers of partitions and buckets: that of the files behind a plain scan as the
    optimizer knows it; for any other plan, whose estimate may be far off, the bytes of its texts."""
    plan = df._jdf.queryExecution().optimizedPlan()
    kinds, todo = set(), [plan]
    while todo:
        node = todo.pop()
        kinds.add(node.getClass().getSimpleName())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    if kinds <= {"Project", "Filter", "LogicalRelation"}:
        return float(str(plan.stats().sizeInBytes())) / 1e6
    found = df.agg(F.sum(F.octet_length(F.col(text_col)).cast("double")), F.count(F.lit(1))).first()
    return ((found[0] or 0) + 32 * found[1]) / 1e6


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_column(batch, name: str) -> list:
    """A string column of an Arrow batch as UTF-8 bytes objects, None for nulls."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


class WordHashes(dict):
    """word -> 64-bit hash. Only a cache: emptied when large, with the same values before and after."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after the other, and the number of words of each text. A to Z count
    as a to z. Words are read eight bytes at a time for all texts at once; those beyond 64 bytes one by one."""
    import xxhash

    data = b" ".join(texts).lower() + b" " * 9
    inside = ~_SPACES[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, size = edges[::2], edges[1::2] - edges[::2]
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, begin))
    eight, step = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)), np.uint64(0x9E3779B97F4A7C15)
    out = mix(size.astype(np.uint64) * step ^ (eight[starts] & _LOW_BYTES[np.minimum(size, 8)]))
    k, more = 8, np.flatnonzero(size > 8)
    while len(more) and k < 64:
        out[more] = mix(out[more] * step + (eight[starts[more] + k] & _LOW_BYTES[np.minimum(size[more] - k, 8)]))
        k, more = k + 8, more[size[more] > k + 8]
    for i in more.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + size[i]])
    return out, counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), so that every bit of the result is usable."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(words: np.ndarray, k: int, base: np.uint64 = np.uint64(0x9E3779B97F4A7C15)) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes: a polynomial in base by doubling of run lengths, then mix()."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, have, power, run, length = None, 0, None, words, 1
    step = base  # base ** length
    rest = k
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                part = run[have : have + n]
                total = part.copy() if total is None else total * step_pow(base, length) + part
                have += length
            rest >>= 1
            if rest:
                run = run[: len(run) - length] * step + run[length:]
                length *= 2
                step = step_pow(base, length)
    return mix(total + np.uint64(k))


def step_pow(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def crc_of_id(column) -> "F.Column":
    """crc32 of an id written as text."""
    return F.crc32(column.cast("string").cast("binary"))
