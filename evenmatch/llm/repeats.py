"""Removal of byte strings of ``WINDOW`` bytes that start at more than one place.

The index is a sparse suffix array kept as a logarithmic family. Of the suffixes of a text those are
indexed that start at an anchor: in each window of ``WINDOW`` bytes the place whose next ``GRAM``
bytes hash lowest, leftmost among equals. Equal windows have their anchor at the same offset, so no
repeated window can be missed. A level is a table of suffix names (hash of the first ``GRAM`` bytes)
in order, with the number of suffixes of that name. Each batch of documents becomes a level, is
merge-scanned against the existing levels for names in both, and levels of equal rank are merged.

Windows whose anchor's name occurs once are done. Of the others, a run of windows with one anchor
repeats if all its bytes stand at two places. What is left is cut at fixed offsets to the anchor: a
piece repeats if all its bytes do, and does not if the core that its windows share occurs once. Only
the windows of the few pieces still open are compared one by one. Of what is settled as repeated, one
representative stays in the comparison. All of this is grouping on 64-bit fingerprints with map-side
counts, so a passage in very many documents is only ever a count.

The suffixes of a level are ordered by fingerprint, not by letter: lexical order would need the bytes
of every suffix beside it, 40 times the size of the text.

Texts are UTF-8 bytes, null counts as empty, shorter texts keep all bytes, repeated rows are further
places, and rows with one id and different texts are separate.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.storage import Scratch
from .contamination import BROADCAST_ROWS
from .words import _powers, mix, text_bytes

WINDOW = 200
GRAM = 40
RUN = 32
BATCHES = 2
CHUNK = 1 << 17  # bytes worked on at a time; an anchor's place in a chunk takes PLACE bits
PLACE = 18
_ONE = np.uint64(1)
_STEP = np.uint64(0xD1342543DE82EF95)


class Prints:
    """Fingerprints of any byte range of a chunk."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _ONE) * up[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64) * _STEP + np.uint64(salt))


def chunks(column: pa.Array):
    """``(rows, first byte of each in the chunk, first byte of each in its text, bytes, row ends)``.

    Texts of a chunk lie one behind the other; a longer text is cut into pieces that overlap by
    ``WINDOW - 1`` bytes, so that each window lies in exactly one piece.
    """
    data, at = text_bytes(column)
    rows, starts, size = [], [], 0
    for row in range(len(at) - 1):
        a, b = int(at[row]), int(at[row + 1])
        if b - a < WINDOW:
            continue  # too short to hold a repeated window
        if b - a > CHUNK:
            for c in range(a, b - WINDOW + 1, CHUNK):
                piece = data[c : min(b, c + CHUNK + WINDOW - 1)]
                yield np.array([row]), np.array([0, len(piece)]), np.array([c - a]), piece
            continue
        if size + b - a > CHUNK:
            yield _joined(data, at, rows)
            rows, size = [], 0
        rows.append(row)
        size += b - a
    if rows:
        yield _joined(data, at, rows)


def _joined(data, at, rows):
    cut = np.concatenate([[0], np.cumsum([at[r + 1] - at[r] for r in rows])]).astype(np.int64)
    return np.array(rows), cut, np.zeros(len(rows), np.int64), np.concatenate([data[at[r] : at[r + 1]] for r in rows])


def anchor_runs(cut: np.ndarray, data: np.ndarray):
    """Runs of windows with one anchor: ``(text number, first window, windows, anchor, its name, fingerprint of all bytes)``."""
    prints = Prints(data)
    begin = np.arange(len(data) - GRAM + 1)
    name = prints.of(begin, begin + GRAM)
    low = name >> np.uint64(PLACE) << np.uint64(PLACE) | begin.astype(np.uint64)
    width = WINDOW - GRAM + 1
    reach = 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    anchor = (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))[: len(anchor)]
    inside = np.arange(len(anchor)) + WINDOW <= cut[1:][owner]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new & inside)
    run = np.cumsum(new) - 1
    size = np.bincount(run[inside], minlength=run[-1] + 1)[run[first]]
    whole = prints.of(first, first + size - 1 + WINDOW, 4)
    return owner[first], first, size, anchor[first], name[anchor[first]].view(np.int64), whole.view(np.int64)


def _anchors(batches):
    for batch in batches:
        key = batch.column("k").to_numpy(zero_copy_only=False)
        for rows, cut, base, data in chunks(batch.column("text")):
            owner, first, size, anchor, name, whole = anchor_runs(cut, data)
            shift = base[owner] - cut[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[rows[owner]]), pa.array((first + shift).astype(np.int32)), pa.array(size.astype(np.int16)), pa.array((anchor - first).astype(np.int16)), pa.array(name), pa.array(whole)],
                names=["k", "first", "size", "offset", "name", "whole"],
            )


def _texts(batch):
    for text in batch.column("text").to_pylist():
        yield np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _unpacked(runs, *fields: str) -> list[np.ndarray]:
    """The wanted fields of the runs of a text."""
    return [np.array([r[f] for r in runs], np.int64) for f in fields]


def _pieces(first: np.ndarray, size: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs cut where the offset to the anchor passes a multiple of ``RUN``.

    Returns first window, windows, anchor, number by offset, and number of the run of each piece.
    """
    high, low = offset // RUN, (offset - size + 1) // RUN
    count = high - low + 1
    of = np.repeat(np.arange(len(first)), count)
    no = high[of] - (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    anchor = first[of] + offset[of]
    start = np.maximum(first[of], anchor - (no * RUN + RUN - 1))
    end = np.minimum(first[of] + size[of], anchor - no * RUN + 1)
    return start, end - start, anchor, no, of


def _filled(batches):
    """Rows of ``k, text, runs`` with the text as bytes."""
    for batch in batches:
        yield from zip(batch.column("k").to_pylist(), _texts(batch), batch.column("runs").to_pylist(), strict=True)


def _table(parts: list[list[np.ndarray]], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, kinds, strict=True)], names=names)


def _run_pieces(batches):
    """Fingerprints of the pieces of all runs: of the core that their windows share, and of all their bytes."""
    for batch in batches:
        parts = []
        for k, data, runs in _filled([batch]):
            prints = Prints(data)
            first, size, offset, weight = _unpacked(runs, "first", "size", "offset", "w")
            start, count, anchor, no, of = _pieces(first, size, offset)
            core = prints.of(anchor - no * RUN, anchor - (no * RUN + RUN - 1) + WINDOW, 1)
            whole = prints.of(start, start + count - 1 + WINDOW, 2)
            parts.append([np.full(len(start), k), start, count, core.view(np.int64), whole.view(np.int64), weight[of]])
        yield _table(parts, ["k", "first", "size", "core", "whole", "w"], [np.int64, np.int32, np.int32, np.int64, np.int64, np.int32])


def _run_windows(batches):
    for batch in batches:
        parts = []
        for k, data, runs in _filled([batch]):
            first, size, weight = _unpacked(runs, "first", "size", "w")
            start = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            parts.append([np.full(len(start), k), start, Prints(data).of(start, start + WINDOW, 3).view(np.int64), np.repeat(weight, size)])
        yield _table(parts, ["k", "first", "name", "w"], [np.int64, np.int32, np.int64, np.int32])


def _merged(batches):
    """Maximal removed byte ranges of each text."""
    for batch in batches:
        out = []
        for runs in batch.column("runs").to_pylist():
            first, size = _unpacked(runs, "first", "size")
            order = np.argsort(first, kind="stable")
            a, b = first[order], np.maximum.accumulate((first + size - 1 + WINDOW)[order])
            new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            out.append([{"lo": int(x), "hi": int(y)} for x, y in zip(a[new], b[np.append(new[1:] - 1, len(b) - 1)], strict=True)])
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, kind)], names=["k", "spans"])


def _cut(batches):
    for batch in batches:
        out = []
        for data, spans in zip(_texts(batch), batch.column("spans").to_pylist(), strict=True):
            left, at = [], 0
            for span in spans or ():
                left.append(data[at : span["lo"]].tobytes())
                at = span["hi"]
            kept = b"".join([*left, data[at:].tobytes()])
            out.append((len(data), len(data) - len(kept), len(spans or ()), hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("spans"), *[pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]],
            names=["doc_id", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


class SuffixLevels:
    """The logarithmic family: levels of suffix names, merged in pairs of equal rank."""

    def __init__(self, work: Scratch, name: str):
        self.work, self.name, self.no, self.levels = work, name, 0, []
        self.shared: list[DataFrame] = []

    def _write(self, level: DataFrame) -> tuple[str, DataFrame]:
        self.no += 1
        key = f"{self.name}-{self.no}"
        return key, self.work.write(level.sortWithinPartitions("name"), key)

    def add(self, batch: DataFrame) -> None:
        """Index the suffix names of a batch and note those that an earlier level or the batch itself repeats."""
        key, level = self._write(batch.groupBy("name").agg(F.count("*").alias("n")))
        self.shared.append(level.where("n > 1").select("name"))
        for _, _, older in self.levels:
            self.shared.append(level.where("n = 1").join(older.where("n = 1").select("name"), "name").select("name"))
            self.shared.append(level.where("n = 1").join(older.where("n > 1").select("name"), "name").select("name"))
        rank = 0
        found = self.work.write(self._union(), f"{self.name}-shared-{self.no}")
        self.shared = [found]
        while self.levels and self.levels[-1][0] == rank:
            _, old_key, older = self.levels.pop()
            both = level.unionByName(older).groupBy("name").agg(F.sum("n").alias("n"))
            new_key, level = self._write(both)
            self.work.drop(key, old_key)
            key, rank = new_key, rank + 1
        self.levels.append((rank, key, level))

    def _union(self) -> DataFrame:
        out = self.shared[0]
        for more in self.shared[1:]:
            out = out.unionByName(more)
        return out.distinct()

    def repeated(self) -> DataFrame:
        """Names with at least two suffixes."""
        return self._union()


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and text; repeated rows share it and have the same result."""
    return F.xxhash64(id_col, text_col).alias("k")


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans (removed byte ranges), n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row."""
    work = Scratch(docs.sparkSession, "repeats")
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    runs_of = lambda part: part.select("k", "text").mapInArrow(_anchors, "k long, first int, size short, offset short, name long, whole long")
    family = SuffixLevels(work, "level")
    for no in range(BATCHES):
        family.add(runs_of(rows.where(F.pmod(F.xxhash64("k", F.lit(1)), F.lit(BATCHES)) == no)).select("name"))
    # runs are taken from the texts again: that costs less than keeping the names of all suffixes with their places
    found = work.write(runs_of(rows).join(family.repeated(), "name", "left_semi"), "runs")

    equal = found.groupBy("whole").agg(F.count("*").alias("n")).where("n > 1").select("whole", F.lit(True).alias("again"))
    found = work.write(found.join(equal, "whole", "left"), "judged")
    left, settled = found.where("again is null"), found.where("again")
    stand_ins = settled.join(left.select("name").distinct(), "name", "left_semi").groupBy("whole").agg(F.min(F.struct("k", "first", "size", "offset")).alias("m")).select("m.*", F.lit(2).alias("w"))
    todo = left.select("k", "first", "size", "offset", F.lit(1).alias("w")).unionByName(stand_ins)
    pieces = work.write(_with_texts(todo, rows).mapInArrow(_run_pieces, "k long, first int, size int, core long, whole long, w int"), "pieces")

    equal = pieces.groupBy("whole").agg(F.sum("w").alias("n")).where("n > 1").select("whole", F.lit(True).alias("again"))
    cores = pieces.groupBy("core").agg(F.sum("w").alias("n")).where("n > 1").select("core")
    pieces = work.write(pieces.join(cores, "core", "left_semi").join(equal, "whole", "left"), "judged-pieces")
    left, more = pieces.where("again is null"), pieces.where("again")
    stand_ins = more.join(left.select("core").distinct(), "core", "left_semi").groupBy("whole").agg(F.min(F.struct("k", "first", "size")).alias("m")).select("m.*", F.lit(2).alias("w"))
    todo = left.select("k", "first", "size", "w").unionByName(stand_ins)
    windows = work.write(_with_texts(todo, rows).mapInArrow(_run_windows, "k long, first int, name long, w int"), "windows")
    again = windows.groupBy("name").agg(F.sum("w").alias("n")).where("n > 1").select("name")
    single = windows.join(again, "name", "left_semi").select("k", "first", F.lit(1).alias("size"))

    repeated = settled.select("k", "first", "size").unionByName(more.select("k", "first", "size")).unionByName(single)
    spans = repeated.groupBy("k").agg(F.collect_list(F.struct("first", "size")).alias("runs")).mapInArrow(_merged, "k long, spans array<struct<lo:int,hi:int>>")
    spans = work.write(spans, "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    ranges = spans.agg(F.count("*") + F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    spans = F.broadcast(spans) if ranges <= BROADCAST_ROWS else spans  # else texts and ranges are joined by shuffle
    cut = rows.join(spans, "k", "left").select("doc_id", "text", "spans")
    return cut.mapInArrow(_cut, f"doc_id {kind}, spans array<struct<lo:int,hi:int>>, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _with_texts(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """``k, text, runs``: the runs of each text beside it."""
    fields = [c for c in runs.columns if c != "k"]
    listed = runs.groupBy("k").agg(F.collect_list(F.struct(*fields)).alias("runs"))
    return rows.select("k", "text").join(listed, "k").dropDuplicates(["k"])
