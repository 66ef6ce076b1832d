"""Online packing of token ids into windows, with a fixed number of open windows.

Each partition streams through its documents. A document longer than a window
gives full windows and a rest; a piece goes into the open window where it fits
best, and when it fits nowhere and all places are taken, the fullest window is
emitted. So a task holds ``open_windows`` windows, whatever its input.

What is still open at the end of the partitions is merged by the same rule:
whole windows are placed into windows, in rounds of ever fewer tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import small_batches
from faultline.llm.tokens import bpe
from faultline.session import materialise

END_ID = 0
#: So many times the open windows of a task go to one task of the next round.
FAN_IN = 64


class OpenWindows:
    """Best-fit placing into at most ``limit`` windows of ``size``; windows are numbered from ``first``."""

    def __init__(self, size: int, limit: int, first: int):
        self.size, self.limit, self.next = size, limit, first
        self.free: list[tuple[int, int]] = []  # free places and window, sorted
        self.held: dict[int, list] = {}

    def place(self, piece, length: int) -> list[tuple[int, list]]:
        """Put ``piece`` into a window; returns the windows that are emitted for it."""
        emitted = []
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            free, window = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                emitted.append(self._emit(0))
            free, window = self.size, self.next
            self.next += 1
            self.held[window] = []
        self.held[window].append((self.size - free, piece))
        insort(self.free, (free - length, window))
        if free == length:
            emitted.append(self._emit(0))
        return emitted

    def _emit(self, at: int) -> tuple[int, list]:
        _, window = self.free.pop(at)
        return window, self.held.pop(window)

    def rest(self) -> Iterator[tuple[int, list]]:
        while self.free:
            yield self._emit(0)


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, filled long, open boolean"
)
MOVES = "sequence_id long, target long, shift long, filled long, open boolean"


def _rows(columns: list[str], rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    values = zip(*rows, strict=True) if rows else [[] for _ in columns]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(v), types.field(c).type) for c, v in zip(columns, values, strict=True)],
        schema=types,
    )


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _first_pass(docs: DataFrame, tokenizer: str, size: int, limit: int, keep_ids: bool) -> DataFrame:
    ddl = PIECES + (", ids binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, schema = bpe(tokenizer).encode, _schema(ddl)
        end = END_ID.to_bytes(4, "little")
        windows = OpenWindows(size, limit, TaskContext.get().partitionId() << 32)

        def told(window: int, pieces: list, still_open: bool) -> Iterator[tuple]:
            filled = sum(piece[2] for _, piece in pieces)
            for offset, (doc_id, start, length, crc, total, ids) in pieces:
                row = (doc_id, start, length, crc, total, window, offset, filled, still_open)
                yield row + ((ids,) if keep_ids else ())

        for batch in batches:
            made: list[tuple] = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    length = len(part) // 4
                    piece = (doc_id, start, length, zlib.crc32(part), total, part if keep_ids else None)
                    for window, pieces in windows.place(piece, length):
                        made.extend(told(window, pieces, False))
            yield _rows(schema.names, made, schema)
        left = [row for window, pieces in windows.rest() for row in told(window, pieces, True)]
        yield _rows(schema.names, left, schema)

    small_batches(docs.sparkSession, 200)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return source.mapInArrow(run, ddl)


def _merge(open_windows: DataFrame, tasks: int, round_: int, size: int, limit: int) -> DataFrame:
    """Where each open window goes; rows in a fixed order, so that a lost task repeats itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(MOVES)
        first = (round_ << 56) | (TaskContext.get().partitionId() << 32)
        windows, last = OpenWindows(size, limit, first), tasks == 1

        def told(window: int, moved: list, still_open: bool) -> Iterator[tuple]:
            filled = sum(n for _, (_, n) in moved)
            for shift, (old, _) in moved:
                yield (old, window, shift, filled, still_open)

        for batch in batches:
            made: list[tuple] = []
            for old, filled in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for window, moved in windows.place((old, filled), filled):
                    made.extend(told(window, moved, False))
            yield _rows(schema.names, made, schema)
        left = [row for window, moved in windows.rest() for row in told(window, moved, not last)]
        yield _rows(schema.names, left, schema)

    items = open_windows.select("sequence_id", "filled").repartition(tasks, "sequence_id")
    return items.sortWithinPartitions(F.desc("filled"), "sequence_id").mapInArrow(run, MOVES)


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = 1024,
    open_windows: int = 128,
    keep_ids: bool = False,
) -> DataFrame:
    """Pack the ids of all documents, each followed by id 0, into windows of ``size``.

    docs: needs ``doc_id`` and ``text``; other columns are ignored. tokenizer: path
    of a byte-level BPE file that every executor has. Returns a row per piece:
    ``doc_id``, ``start`` (ids of the document before it), ``length``, ``ids_crc32``
    (of the ids as little-endian 32-bit integers), ``doc_tokens`` (with the final
    id), ``sequence_id``, ``offset`` and, with ``keep_ids``, ``ids`` (bytes).

    A null or empty text gives the single id 0. A null doc_id stays null. Rows
    that repeat are packed each. An empty table gives no rows.
    """
    pieces = materialise(_first_pass(docs, tokenizer, size, open_windows, keep_ids))
    kept = [c for c in pieces.columns if c not in ("filled", "open")]
    done, left, round_ = [pieces.where("not open").select(kept)], pieces.where("open"), 0
    while True:
        windows = left.select("sequence_id", "filled").distinct()
        tasks, round_ = -(-windows.count() // (open_windows * FAN_IN)), round_ + 1
        if not tasks:
            break
        moves = materialise(_merge(windows, tasks, round_, size, open_windows))
        left = materialise(
            left.drop("filled", "open")
            .join(moves, "sequence_id")
            .withColumn("sequence_id", F.col("target"))
            .withColumn("offset", F.col("offset") + F.col("shift"))
            .select(*kept, "filled", "open")
        )
        done.append(left.where("not open").select(kept))
        left = left.where("open")
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result
