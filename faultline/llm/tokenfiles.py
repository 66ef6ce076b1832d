"""Packed token ids as binary files.

Documents are tokenised in the tasks that scan them. Pieces gather until a chunk is
full; the chunk is packed by best-fit-decreasing and written at once, so a task
holds one chunk, whatever its input. A segment tree over the free places of the
rows finds the fullest row that still has room for a piece in logarithmic time.

A chunk gives three files: the id matrix (rows of ``size`` ids, unused places 0), the
cumulative segment lengths of each row, and the positions, which restart at 0 with
each segment. Overlong documents are cut into rows' lengths; nothing is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import files
from faultline.llm.common import small_batches
from faultline.llm.tokens import bpe
from faultline.session import materialise, scratch_path

END_ID = 0
SMALL_VOCABULARY = 1 << 16


def _narrow(values: int) -> str:
    return "<u2" if values <= SMALL_VOCABULARY else "<u4"


@dataclass(frozen=True)
class Layout:
    """size: ids of a row; chunk: ids of a file; vocabulary: number of ids, which decides
    between 16 and 32 bits (None: that of the tokenizer's file)."""

    size: int = 1024
    chunk: int = 2_000_000
    vocabulary: int | None = None

    def of(self, tokenizer: str) -> Layout:
        """This layout with the vocabulary of a tokenizer's file."""
        return self if self.vocabulary else replace(self, vocabulary=bpe(tokenizer).size)

    @property
    def ids(self) -> str:
        return _narrow(self.vocabulary)

    @property
    def positions(self) -> str:
        return _narrow(self.size)


class CapacityTree:
    """How many rows have each number of free places, in a segment tree."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, free: int, by: int) -> None:
        at = self.leaves + free
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """A row of the least free places that are ``length`` or more; it leaves the tree."""
        at = self.leaves + length
        if not self.count[at]:
            # Up to the first right neighbour that holds rows, then down to its first leaf.
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        free = at - self.leaves
        self._add(free, -1)
        return self.rows[free].pop(), free


def best_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """Row and place in the row of each piece; longer pieces are placed first, equal ones
    in their order."""
    tree, placed, rows = CapacityTree(size), [(0, 0)] * len(lengths), 0
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[piece]
        found = tree.take(length)
        row, free = found if found else (rows, size)
        rows += not found
        placed[piece] = (row, size - free)
        if free > length:
            tree.put(row, free - length)
    return placed


PIECES = (
    "doc_id long, start long, length long, doc_tokens long, file string, row long, offset long, "
    "segment long, rows long, written_crc32 long"
)
_ARROW = {"long": pa.int64(), "string": pa.string()}


def _names(base: str) -> tuple[str, str, str]:
    return f"{base}.ids", f"{base}.lengths", f"{base}.positions"


def _write(pieces: list[tuple], folder: str, layout: Layout) -> list[tuple]:
    """Pack and write one chunk; returns the rows of PIECES."""
    placed = best_fit_decreasing([len(p[2]) // 4 for p in pieces], layout.size)
    rows = max(row for row, _ in placed) + 1
    ids = np.zeros((rows, layout.size), layout.ids)
    ordered = sorted(range(len(pieces)), key=placed.__getitem__)
    base, told, lengths, starts, segment = files.fresh_name(folder, "packed", ""), [], [], [0], 0
    row_before = 0
    flat = np.frombuffer(b"".join(pieces[i][2] for i in ordered), "<u4")
    if len(flat) and flat.max() >= layout.vocabulary:
        raise ValueError(f"id {flat.max()} is not below the vocabulary of {layout.vocabulary}")
    # Rows are filled from their start, so each one's pieces lie end to end.
    sizes = np.array([len(pieces[i][2]) // 4 for i in ordered])
    begins = np.array([placed[i][0] * layout.size + placed[i][1] for i in ordered])
    before = np.cumsum(sizes) - sizes
    counted = np.arange(len(flat)) - np.repeat(before, sizes)
    places = np.repeat(begins, sizes) + counted
    ids.reshape(-1)[places] = flat
    positions = np.zeros((rows, layout.size), layout.positions)
    positions.reshape(-1)[places] = counted
    for i in ordered:
        doc_id, start, raw, total = pieces[i]
        row, offset = placed[i]
        if row != row_before:
            starts.append(len(lengths))
            row_before, segment = row, 0
        length = len(raw) // 4
        lengths.append(offset + length)
        told.append((doc_id, start, length, total, base, row, offset, segment, rows, zlib.crc32(raw)))
        segment += 1
    starts.append(len(lengths))
    header = np.array([rows, len(lengths)], "<u4")
    body = (header, np.array(starts, "<u4"), np.array(lengths, "<u4"))
    for name, data in zip(
        _names(base), (ids.tobytes(), b"".join(x.tobytes() for x in body), positions.tobytes()), strict=True
    ):
        with files.create(name) as out:
            # Positions repeat long runs; all files are zlib streams of plain arrays.
            out.write(zlib.compress(data, 1))
    return told


def write_packed(docs: DataFrame, tokenizer: str, folder: str, layout: Layout | None = None) -> DataFrame:
    """Write the ids of all documents, each with a final id 0; a stored table of PIECES.

    docs: needs ``doc_id`` and ``text``; other columns are ignored. ``lengths`` files
    hold rows, segments, the first segment of each row and one past the last, and where
    each segment ends in its row.
    """
    layout = (layout or Layout()).of(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = bpe(tokenizer).encode, END_ID.to_bytes(4, "little")
        schema = pa.schema([(n, _ARROW[k]) for n, k in (x.split() for x in PIECES.split(", "))])
        waiting, held = [], 0

        def told() -> pa.RecordBatch:
            columns = zip(*_write(waiting, folder, layout), strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, layout.size):
                    part = ids[4 * start : 4 * (start + layout.size)]
                    waiting.append((doc_id, start, part, total))
                    held += len(part) // 4
                    if held >= layout.chunk:
                        yield told()
                        waiting, held = [], 0
        if waiting:
            yield told()

    small_batches(docs.sparkSession, 200)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return materialise(source.mapInArrow(run, PIECES))


class PackedFile:
    """The three arrays of one chunk."""

    def __init__(self, base: str, layout: Layout):
        ids, lengths, positions = (zlib.decompress(files.Reader().whole(n)) for n in _names(base))
        self.ids = np.frombuffer(ids, layout.ids).reshape(-1, layout.size)
        self.positions = np.frombuffer(positions, layout.positions).reshape(-1, layout.size)
        numbers = np.frombuffer(lengths, "<u4")
        rows, segments = numbers[:2]
        self.starts, self.ends = numbers[2 : rows + 3], numbers[rows + 3 :]
        assert len(self.ids) == rows and len(self.ends) == segments

    def segment(self, row: int, number: int) -> tuple[int, np.ndarray]:
        """Place and ids of a segment, as lengths and position resets tell it."""
        at = int(self.starts[row]) + number
        end = int(self.ends[at])
        begin = int(self.ends[at - 1]) if number else 0
        if (self.positions[row, begin:end] != np.arange(end - begin)).any():
            raise ValueError("positions do not restart with the segment")
        return begin, self.ids[row, begin:end]


def read_packed(pieces: DataFrame, layout: Layout) -> DataFrame:
    """Read the segments named by ``pieces`` from the files: PIECES with ``ids_crc32`` (of the
    ids as little-endian 32-bit integers). Rows of one file lie together in ``pieces``. Fails
    if the ids differ from those that were to be written.

    layout: as written, with its vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = files.Recent(lambda base: PackedFile(base, layout), 2)
        for batch in batches:
            checks, offsets = [], []
            for file, row, number in zip(*(batch[c].to_pylist() for c in ("file", "row", "segment")), strict=True):
                offset, ids = held[file].segment(row, number)
                offsets.append(offset)
                checks.append(zlib.crc32(ids.astype("<u4").tobytes()))
            if not set(zip(offsets, batch["offset"].to_pylist(), strict=True)) <= {(o, o) for o in offsets}:
                raise ValueError("a segment does not lie where it was put")
            if checks != batch["written_crc32"].to_pylist():
                raise ValueError("ids read back are not those that were written")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(checks, pa.int64())], [*batch.schema.names, "ids_crc32"]
            )

    small_batches(pieces.sparkSession, 5000)
    return pieces.mapInArrow(run, PIECES + ", ids_crc32 long")


def write_and_read(
    spark: SparkSession, docs: DataFrame, tokenizer: str, layout: Layout | None = None
) -> DataFrame:
    """Write all documents as packed files and read every segment back.

    A null or empty text gives the single id 0. Null ids stay null, rows that repeat
    are written each, and an empty table gives no rows and no files.
    """
    layout = (layout or Layout()).of(tokenizer)
    pieces = write_packed(docs, tokenizer, scratch_path(spark, "packed"), layout)
    return read_packed(pieces, layout).drop("rows", "written_crc32")
