"""Pieces that several operators share: checkpoints, hashing of words, packed blocks.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, which is what
``bytes.split`` gives; only A-Z are lower-cased, which is what ``bytes.lower`` does.
"""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression for one separator of words.
SPACES = r"[ \t-\r]"
#: Java regular expression for one word.
WORD = r"[^ \t-\r]+"

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset a temporary folder
    stands in, on a local master alone: elsewhere executors could not read it back.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="gridloom-"))
    return _local[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; sizes blocks and buckets in proportion to the input."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def pieces_for(total: int, each: int) -> int:
    """How many pieces of ``each`` bytes hold ``total`` bytes; one at least."""
    return max(1, math.ceil(total / each))


def give_back() -> None:
    """Hands pages that a worker has freed back to the machine; else it keeps them while other stages run."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


# --- hashing ---------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(size, base, U64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up, self.down


_POWERS = _Powers()
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` and the byte offsets they start at."""
    if not data:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    codes = np.frombuffer(data, np.uint8)
    inside = ~_IS_SPACE[codes]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _POWERS.upto(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * up[: len(codes)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64)), start


#: Texts are hashed in runs of about this many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 20


def runs(texts: list[bytes]):
    """(first, last, joined) over consecutive texts, about RUN_BYTES each."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > RUN_BYTES:
            yield first, k, b"\n".join(texts[first:k])
            first, size = k, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts), b"\n".join(texts[first:])


def document_words(texts: list[bytes]):
    """Yields the word hashes of each text, in order."""
    for first, last, data in runs(texts):
        hashes, start = word_hashes(data)
        ends = np.cumsum([len(t) + 1 for t in texts[first:last]])
        at = np.searchsorted(start, ends)
        low = 0
        for high in at:
            yield hashes[low:high]
            low = high


def slices(batches, column: str = "text"):
    """The Arrow batches cut into slices of about RUN_BYTES of text each, so that little is unpacked at once."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        piece = np.cumsum(sizes) // RUN_BYTES
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _odd(k: int) -> int:
    return (pow(0xD1342543DE82EF95, 2 * k + 3, 1 << 64)) | 1


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words; fewer words give the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    k = min(n, size)
    total = np.full(n - k + 1, (k * 0xA0761D6478BD642F) & _MASK, U64)
    for j in range(k):
        total += words[j : n - k + 1 + j] * U64(_odd(j))
    return mix(total)


def lowered(texts) -> list[bytes]:
    """UTF-8 of the texts with A-Z lower-cased; null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]


def to_long(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


# --- packed blocks -----------------------------------------------------------
#
# A block is a bounded set of whole documents, chosen by hash, that travels as a few
# compressed rows.  Stages that need all words of a block together group by its number.


def packed_blocks(docs: DataFrame, columns: list[str], blocks: int) -> DataFrame:
    """(block, payload): the named columns of all rows, dealt to blocks by their hash."""
    chosen = docs.select(F.pmod(F.xxhash64(*columns), F.lit(blocks)).alias("_block"), *columns)

    def pack(batches):
        import io

        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(number, kind="stable")
            cuts = np.flatnonzero(np.diff(number[order])) + 1
            body = pa.Table.from_batches([batch]).select(columns)
            out = []
            for rows in np.split(order, cuts) if len(order) else []:
                sink = io.BytesIO()
                part = body.take(pa.array(rows)).combine_chunks()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_table(part)
                out.append((int(number[rows[0]]), squeeze.compress(sink.getvalue())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in out], pa.int64()), pa.array([v for _, v in out], pa.binary())],
                ["block", "payload"],
            )

    return chosen.mapInArrow(pack, "block long, payload binary")


def unpacked(payloads) -> pd.DataFrame:
    """The rows that ``packed_blocks`` put into these payloads; texts as Python strings."""
    import pyarrow as pa
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    tables = [pa.ipc.open_stream(open_.decompress(p)).read_all() for p in payloads]
    frame = pa.concat_tables(tables).to_pandas(integer_object_nulls=True)
    # plain objects: Arrow-backed strings in several pieces don't go back to Spark
    return frame.astype({c: object for c in frame.columns if frame[c].dtype != object and not pd.api.types.is_numeric_dtype(frame[c])})


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share."""
    import uuid

    return f"{shared_folder(spark)}/{'-'.join(name.split())}-{uuid.uuid4().hex}"


def handed_on(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; the next stage's input."""
    path = shared_path(df.sparkSession, f"stage {name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Shelf:
    """Intermediate tables in the shared folder, compressed, that ``clear`` removes.

    Lineage is cut as by a checkpoint, and sizes are known to the planner.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, shared_path(spark, name), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
