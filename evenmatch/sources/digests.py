"""SHA-256 of files too large for one task.

A digest runs along the bytes of a file, but all it knows of those it has taken is eight numbers, their
count and the last block: so one task can stop and another go on. The byte ranges of all files are read
at once and written down as pieces; then each round takes the next ``step`` bytes or so of every file,
one file per task, and leaves a state of some hundred bytes. Rounds follow one another, tasks stay small.

Ranges come from the text reader, whose values are the bytes between line feeds as they are. Its lines
say neither whether the last one ends with a line feed nor whether a byte order mark was left out at
the start; both follow from the size of the file.
"""

from __future__ import annotations

import _hashlib
import ctypes
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .storage import Scratch

#: A vector of the Parquet reader holds 4096 pieces.
PIECE = 1 << 13
BLOCK = 64
MARK = b"\xef\xbb\xbf"
STATE = "no int, block long, seq long, data binary"


class Sha256:
    """A SHA-256 that can be saved and resumed. The compression is that of the library behind ``hashlib``."""

    def __init__(self, saved: bytes = b""):
        self._lib = ctypes.CDLL(getattr(_hashlib, "__file__", None))
        self._context = ctypes.create_string_buffer(256)  # begins with the eight numbers
        self._lib.SHA256_Init(self._context)
        self.n, self._last = 0, b""
        if saved:
            *numbers, self.n = struct.unpack_from(">8IQ", saved)
            ctypes.memmove(self._context, struct.pack("=8I", *numbers), 32)
            self._last = saved[40:]

    def take(self, data: bytes) -> Sha256:
        """Go on with ``data``. The last 1 to 64 bytes wait, so that the very last one can be taken back."""
        self.n += len(data)
        data = self._last + data
        done = max(len(data) - 1, 0) // BLOCK * BLOCK
        self._lib.SHA256_Update(self._context, data, ctypes.c_size_t(done))
        self._last = data[done:]
        return self

    def _numbers(self) -> tuple[int, ...]:
        return struct.unpack_from("=8I", self._context.raw)

    def saved(self) -> bytes:
        return struct.pack(">8IQ", *self._numbers(), self.n) + self._last

    def hexdigest(self, size: int) -> str:
        """The digest of the first ``size`` bytes: all that were taken, or all but the last."""
        if self.n - size not in (0, 1):
            raise ValueError(f"{self.n} bytes were read of a file of {size}")
        end = self._last[: len(self._last) - (self.n - size)] + b"\x80"
        end += bytes(-(len(end) + 8) % BLOCK) + struct.pack(">Q", 8 * size)
        self._lib.SHA256_Update(self._context, end, ctypes.c_size_t(len(end)))
        return struct.pack(">8I", *self._numbers()).hex()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of byte ranges, in order -> pieces of at most ``PIECE`` bytes, numbered within their range."""
    last, seq = None, 0
    for batch in batches:
        paths, blocks, lines = (batch.column(c) for c in ("path", "block", "value"))
        runs = pc.run_end_encode(blocks).run_ends.to_pylist() if len(pc.unique(paths)) == 1 else range(1, len(lines) + 1)
        start = 0
        for end in runs:
            at = paths[start].as_py(), blocks[start].as_py()
            seq = seq if at == last else 0
            run = pa.ListArray.from_arrays([0, end - start], lines.slice(start, end - start))
            data = pc.binary_join(run, b"\n")[0].as_py() + b"\n"
            parts = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
            k = len(parts)
            yield pa.record_batch(
                {"path": [at[0]] * k, "block": pa.array([at[1]] * k, pa.int64()), "seq": pa.array(range(seq, seq + k), pa.int64()),
                 "n": pa.array([len(p) for p in parts], pa.int64()), "data": pa.array(parts, pa.binary())})
            start, last, seq = end, at, seq + k


def _resumed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A state before the pieces that follow it in its file, file by file -> the states after them."""
    row = lambda no, sha: pa.record_batch(
        {"no": pa.array([no], pa.int32()), "block": pa.array([-1], pa.int64()), "seq": pa.array([0], pa.int64()), "data": pa.array([sha.saved()], pa.binary())})
    no, sha = None, None
    for batch in batches:
        for n, block, data in zip(*(batch.column(c) for c in ("no", "block", "data")), strict=True):
            if block.as_py() < 0:
                if sha:
                    yield row(no, sha)
                no, sha = n.as_py(), Sha256(data.as_py())
            else:
                sha.take(data.as_py())
    if sha:
        yield row(no, sha)


def sha256_in_rounds(spark: SparkSession, root: str, sizes: dict[str, int], large: Column, step: int, **options) -> DataFrame:
    """(path, sha256) of the files below ``root`` that ``large`` picks by their ``_metadata``; ``sizes`` has their bytes by path.

    One task reads about ``step`` bytes of a file, or one byte range and line where these are longer.
    """
    work = Scratch(spark, "digests")
    files = spark.createDataFrame([(no, path, sizes[path]) for no, path in enumerate(sorted(sizes))], "no int, path string, n_bytes long")
    lines = spark.read.options(lineSep="\n", **options).text(root).where(large)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    pieces = lines.mapInArrow(_pieces, "path string, block long, seq long, n long, data binary").join(F.broadcast(files), "path")
    pieces = work.write(pieces.select("no", "block", "seq", "n", "data", F.expr(f"int(block div {step})").alias("round")), "pieces", ["round"])

    over = F.coalesce(F.col("n"), F.lit(0)) - F.col("n_bytes")  # each line has its line feed, the last one perhaps too many
    start = F.when(over.isin(0, 1), F.lit(Sha256().saved())).when(over.isin(-3, -2), F.lit(Sha256().take(MARK).saved()))
    start = F.coalesce(start, F.raise_error(F.concat(F.lit("not read as it is: "), "path")).cast("binary"))
    read = files.join(pieces.groupBy("no").agg(F.sum("n").alias("n")), "no", "left")
    state = work.write(read.select("no", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("seq"), start.alias("data")), "state")
    for no in range(-(-max(sizes.values()) // step)):
        both = state.unionByName(pieces.where(F.col("round") == no).select(*state.columns))
        both = both.repartitionById(len(sizes), "no").sortWithinPartitions("no", "block", "seq")
        state = work.write(both.mapInArrow(_resumed, STATE), f"state-{no}")
        work.drop(f"state-{no - 1}" if no else "state")
    work.drop("pieces")
    digest = F.udf(lambda data, size: Sha256(bytes(data)).hexdigest(size), "string")
    return state.join(files, "no").select("path", digest("data", "n_bytes").alias("sha256"))
