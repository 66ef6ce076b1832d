"""SimHash near-duplicates, searched by the generalised pigeonhole principle.

Fingerprints whose bits differ in at most ``radius`` places are linked. The bits
are cut into ``m`` parts. If the allowed differences ``T_i`` of the parts add up
to ``radius - m + 1`` (-1 leaves a part out), two fingerprints within the radius
differ by at most ``T_i`` in at least one part. So a fingerprint probes each part
with all values within its own ``T_i``, and every hit is verified on all bits.

* Bits that vary together go into one part: frequent values then gather in few
  parts, which the fingerprints concerned can leave out.
* ``T`` is chosen for each fingerprint by dynamic programming over the parts, on
  candidate counts estimated from histograms over all fingerprints.
* Equal fingerprints are one row from the start. Each value of two parts together first
  links its members to its smallest one; the probes then only look for links between the
  components this gave, each in one part, so a dense cloud of near copies yields few rows.

Each link is a true one and none within the radius is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import map_batches
from faultline.llm.components import connected_components
from faultline.session import materialise

SEED = 42
HASHES_AT_ONCE = 60_000  # under 65,536, so that 16-bit counters suffice
KEY_BITS = 44  # most bits of one key
_LANE_STEP = 0x9E3779B97F4A7C15
CELL_BITS = 8  # bits of a histogram cell; a part has one or more cells


@dataclass(frozen=True)
class SimHash:
    """words: of a shingle; lanes: 64 bits of fingerprint each; radius: differing
    bits within which every link is found; parts: of the bits; accept: differing
    bits up to which a pair that the probes meet is linked, at least ``radius``."""

    words: int = 3
    lanes: int = 1
    radius: int = 2
    parts: int = 3
    accept: int | None = None
    most: int = 2  # largest threshold of one part

    @property
    def bits(self) -> int:
        return 64 * self.lanes

    @property
    def limit(self) -> int:
        return self.radius if self.accept is None else self.accept

    @property
    def columns(self) -> list[str]:
        return [f"f{lane}" for lane in range(self.lanes)]


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 bits of the same shingles: the hash mixed with the lane's number."""
    if lane == 0:
        return hashes
    return _mixed(hashes + np.uint64(_LANE_STEP * lane % (1 << 64)))


def _lanes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """A column of ``_lane`` for each lane."""
    mixed = _mixed(hashes[:, None] + np.arange(lanes, dtype=np.uint64) * np.uint64(_LANE_STEP))
    mixed[:, 0] = hashes
    return mixed


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return hashes ^ (hashes >> np.uint64(31))


def fingerprint(text: bytes | None, words: int, lanes: int = 1) -> np.ndarray:
    """Lanes of the fingerprint, the first with the plain XXH64 bits; no words: zeros."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(lanes, np.uint64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths), ends[min(words, len(found)) - 1 :]
    total, counts, digest = len(ends), np.zeros(64 * lanes, np.int64), xxhash.xxh64_intdigest
    for at in range(0, total, HASHES_AT_ONCE):
        spans = zip(
            starts[at : min(total, at + HASHES_AT_ONCE)].tolist(),
            ends[at : at + HASHES_AT_ONCE].tolist(),
            strict=True,
        )
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        for lane in range(lanes):
            rows = _lane(hashes, lane).astype(">u8").view(np.uint8).reshape(-1, 8)
            ones = np.add.reduce(np.unpackbits(rows, axis=1), axis=0, dtype=np.uint16)
            counts[64 * lane : 64 * lane + 64] += ones
    return np.packbits(2 * counts > total).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, spec: SimHash) -> DataFrame:
    """``doc_id``, ``text_hash`` and the lanes ``f0..`` of every row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lanes = np.stack([fingerprint(t, spec.words, spec.lanes) for t in batch["text"].to_pylist()])
        values = {c: pa.array(lanes[:, i].view(np.int64)) for i, c in enumerate(spec.columns)}
        named = {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], **values}
        return pa.RecordBatch.from_pydict(named)

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.col("text").cast("binary").alias("text"),
    )
    lanes = ", ".join(f"{c} long" for c in spec.columns)
    return map_batches(source, run, f"doc_id long, text_hash long, {lanes}")


def _bits(batch: pa.RecordBatch, spec: SimHash) -> np.ndarray:
    """Rows of 0/1, the highest bit of the first lane first."""
    lanes = [batch[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in spec.columns]
    # Stacking turns to native byte order, so the bytes are put in order after it.
    raw = np.stack(lanes, axis=1).astype(">u8").view(np.uint8)
    return np.unpackbits(raw.reshape(batch.num_rows, -1), axis=1)


def _summed(
    frame: DataFrame, count: Callable[[np.ndarray], np.ndarray], read: Callable[[pa.RecordBatch], np.ndarray]
):
    """Sum a fixed number of counters over all fingerprints; each task sends one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(count(read(batch)).ravel().astype(np.int64) for batch in batches if batch.num_rows)
        if np.ndim(total):
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"cell": cells.astype(np.int32), "n": total[cells]})

    found = frame.mapInArrow(run, "cell int, n long")
    summed = found.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    return summed["cell"].to_numpy(np.int64), summed["n"].to_numpy(float)


def correlated_parts(together: np.ndarray, rows: float, parts: int) -> list[list[int]]:
    """Split the bits into parts of nearly equal size, correlated bits together.

    together: how many rows have both bits set. A part starts with the bit most
    correlated with the bits still free and takes the bit nearest to its members.
    """
    share = together / max(rows, 1)
    alone = np.diag(share)
    spread = np.sqrt(np.maximum(alone * (1 - alone), 1e-12))
    near = np.abs((share - np.outer(alone, alone)) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    free, made = list(range(len(near))), []
    for part in range(parts):
        size = -(-len(free) // (parts - part))
        chosen = [max(free, key=lambda b: (near[b, free].sum(), -b))]
        free.remove(chosen[0])
        while len(chosen) < size:
            best = max(free, key=lambda b: (near[b, chosen].sum(), -b))
            chosen.append(best)
            free.remove(best)
        made.append(sorted(chosen))
    return made


def _cells(parts: list[list[int]]) -> list[list[list[int]]]:
    return [[p[i : i + CELL_BITS] for i in range(0, len(p), CELL_BITS)] for p in parts]


def _values(bits: np.ndarray, places: list[int]) -> np.ndarray:
    weights = 1 << np.arange(len(places) - 1, -1, -1, dtype=np.int64)
    return bits[:, places].astype(np.int64) @ weights


@dataclass(frozen=True)
class PartPlan:
    """Parts of the bits, and for each cell the share of rows at 0, 1 and 2 bits' distance."""

    parts: list[list[int]]
    near: list[list[np.ndarray]]
    rows: float


def plan_parts(distinct: DataFrame, spec: SimHash) -> PartPlan:
    """Counted over all distinct fingerprints; what reaches the driver has a fixed size."""
    return plan_groups(distinct.select(*spec.columns), spec, 1, lambda batch: _bits(batch, spec))[0]


def plan_groups(
    distinct: DataFrame, spec: SimHash, groups: int, read: Callable[[pa.RecordBatch], np.ndarray]
) -> list[PartPlan]:
    """``plan_parts`` of each of ``groups`` fingerprints that a row has side by side.

    read: the rows of 0/1 of a batch, ``groups`` times ``spec.bits`` wide.
    """
    width = spec.bits
    upper = np.triu_indices(width)

    def pairs(bits: np.ndarray) -> np.ndarray:
        ones = np.ascontiguousarray(bits.reshape(len(bits), groups, width).transpose(1, 0, 2), np.float32)
        return (ones.transpose(0, 2, 1) @ ones).round()[:, *upper]

    cells, counts = _summed(distinct, pairs, read)
    together, rows = np.zeros(groups * len(upper[0])), float(distinct.count())
    together[cells] = counts
    parts = []
    for half in together.reshape(groups, -1):
        whole = np.zeros((width, width))
        whole[upper] = half
        parts.append(correlated_parts(np.maximum(whole, whole.T), rows, spec.parts))
    flat = [
        [g * width + b for b in cell] for g in range(groups) for part in _cells(parts[g]) for cell in part
    ]

    def histogram(bits: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.bincount(_values(bits, cell), minlength=1 << CELL_BITS) for cell in flat]
        )

    cells, counts = _summed(distinct, histogram, read)
    shares = np.zeros(len(flat) << CELL_BITS)
    shares[cells] = counts / max(rows, 1)
    shares, at, plans = shares.reshape(len(flat), -1), 0, []
    for group in parts:
        near = []
        for part in _cells(group):
            made = []
            for cell in part:
                value = np.arange(1 << len(cell))
                own = shares[at, : len(value)]
                flips = [1 << b for b in range(len(cell))]
                one = sum((own[value ^ f] for f in flips), np.zeros(len(value)))
                two = sum((own[value ^ (f | g)] for f, g in combinations(flips, 2)), np.zeros(len(value)))
                made.append(np.stack([own, one, two], axis=1))
                at += 1
            near.append(made)
        plans.append(PartPlan(group, near, rows))
    return plans


def _masks(width: int, within: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``within`` ones."""
    made = [
        sum(1 << b for b in chosen)
        for ones in range(within + 1)
        for chosen in combinations(range(width), ones)
    ]
    return np.array(made, np.int64)


def allocate(bits: np.ndarray, plan: PartPlan, spec: SimHash) -> np.ndarray:
    """Thresholds (-1 to ``most``) of each part for each row, of the least estimated cost.

    Cost: rows expected within the threshold, and one for each value probed.
    """
    total, most = len(bits), spec.most
    costs = np.zeros((len(plan.parts), most + 2, total))
    for i, (part, near) in enumerate(zip(_cells(plan.parts), plan.near, strict=True)):
        chance = np.zeros((total, 3))
        chance[:, 0] = 1
        for cell, shares in zip(part, near, strict=True):
            here = shares[_values(bits, cell)]
            chance = np.stack(
                [sum(chance[:, a] * here[:, d - a] for a in range(d + 1)) for d in range(3)], axis=1
            )
        for t in range(most + 1):
            probes = len(_masks(len(plan.parts[i]), t))
            costs[i, t + 1] = plan.rows * chance[:, : t + 1].sum(axis=1) + probes
    target = spec.radius + 1  # the sum of T_i + 1
    best = np.full((target + 1, total), np.inf)
    best[0], choice = 0, []
    for cost in costs:
        options = np.full((most + 2, target + 1, total), np.inf)
        for step in range(min(most + 1, target) + 1):
            options[step, step:] = best[: target + 1 - step] + cost[step]
        choice.append(options.argmin(axis=0))
        best = options.min(axis=0)
    chosen, left = np.zeros((total, len(costs)), np.int64), np.full(total, target)
    for i in range(len(costs) - 1, -1, -1):
        chosen[:, i] = choice[i][left, np.arange(total)]
        left -= chosen[:, i]
    return chosen - 1


def _index(
    frame: DataFrame, parts: list[list[int]], spec: SimHash, *carried: str
) -> DataFrame:
    """A row for each part of each fingerprint, keyed by the part's value."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = _bits(batch, spec)
        keys = np.concatenate([_values(bits, p) | (i << 48) for i, p in enumerate(parts)])
        taken = batch.take(pa.array(np.tile(np.arange(len(bits)), len(parts))))
        return pa.RecordBatch.from_arrays([pa.array(keys), *taken.columns], ["key", *taken.schema.names])

    lanes = ", ".join(f"{c} long" for c in spec.columns)
    extra = "".join(f", {c} string" for c in carried)
    return map_batches(frame.select(*spec.columns, *carried), run, f"key long, {lanes}{extra}")


def _probes(frame: DataFrame, plan: PartPlan, spec: SimHash, *carried: str) -> DataFrame:
    """A row for each value that a fingerprint probes under its own thresholds."""
    parts = plan.parts
    masks = {(i, t): _masks(len(p), t) for i, p in enumerate(parts) for t in range(spec.most + 1)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = _bits(batch, spec)
        wanted, keys, rows = allocate(bits, plan, spec), [], []
        used = (wanted >= 0) @ (1 << np.arange(len(parts), dtype=np.int64))
        for i, t in masks:
            at = np.flatnonzero(wanted[:, i] == t)
            values = _values(bits[at], parts[i]) | (i << 48)
            keys.append((values[:, None] ^ masks[i, t]).ravel())
            rows.append(np.repeat(at, len(masks[i, t])))
        at = np.concatenate(rows)
        taken = batch.take(pa.array(at))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys)), pa.array(used[at]), *taken.columns],
            ["key", "used", *taken.schema.names],
        )

    lanes = ", ".join(f"{c} long" for c in spec.columns)
    extra = "".join(f", {c} string" for c in carried)
    schema = f"key long, used long, {lanes}{extra}"
    return map_batches(frame.select(*spec.columns, *carried), run, schema)


def _met_before(plan: PartPlan, spec: SimHash) -> Column:
    """True if the probing fingerprint ``a`` has met ``b`` in an earlier part for sure."""
    met = F.lit(False)
    for j, part in enumerate(plan.parts):
        equal = (F.shiftright("a.key", 48) > j) & (F.shiftright("a.used", j).bitwiseAND(1) == 1)
        for lane, name in enumerate(spec.columns):
            mask = sum(1 << (63 - b % 64) for b in part if b // 64 == lane)
            if mask:
                signed = mask - (1 << 64) if mask >> 63 else mask
                differs = F.col(f"a.{name}").bitwiseXOR(F.col(f"b.{name}"))
                equal = equal & (differs.bitwiseAND(F.lit(signed).cast("long")) == 0)
        met = met | equal
    return met


def star_parts(parts: list[list[int]]) -> list[list[int]]:
    """Two parts at a time: long values, which near copies share and strangers do not."""
    count = len(parts)
    pairs = {tuple(sorted({i, (i + step) % count})) for step in (1, 2) for i in range(count)}
    return [[b for i in pair for b in parts[i]][:KEY_BITS] for pair in sorted(pairs)]


def _apart(left: str, right: str, spec: SimHash) -> Column:
    """Bits in which two fingerprints differ."""
    lanes = [F.bit_count(F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))) for c in spec.columns]
    return reduce(Column.__add__, lanes)


def _name(spec: SimHash, prefix: str = "") -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(f"{prefix}{c}")), 16, "0") for c in spec.columns])


def _labelled(distinct: DataFrame, labels: DataFrame) -> DataFrame:
    joined = distinct.drop("component").join(labels, distinct["fingerprint"] == labels["node"], "left")
    return joined.withColumn("component", F.coalesce("component", "fingerprint")).drop("node")


def near_duplicates(docs: DataFrame, spec: SimHash) -> DataFrame:
    """Group near-duplicate documents.

    docs: needs ``doc_id`` and ``text``; other columns are ignored. Returns a row
    for each row of ``docs``: ``doc_id``, ``text_hash`` (of the text, 64 bits),
    ``fingerprint`` (hex digits), ``component`` (the same string for all rows of
    a group) and ``component_id`` (the group's smallest doc_id).

    A null or blank text has fingerprint zero and is linked like any other. Rows
    may repeat. A null doc_id never is the smallest unless its group has no
    other, in which case component_id is null. An empty table gives no rows.
    """
    rows = materialise(fingerprints(docs, spec).withColumn("fingerprint", _name(spec)))
    distinct = materialise(
        rows.groupBy("fingerprint", *spec.columns).agg(F.min("doc_id").alias("first_id"))
    )
    plan = plan_parts(distinct, spec)
    index = _index(distinct, star_parts(plan.parts), spec)
    lanes = F.struct(*spec.columns)
    # Aggregates are stored before they are joined by their key: a join that reuses the
    # shuffle of the aggregate could not split a hot key.
    centres = materialise(
        index.groupBy("key")
        .agg(F.min(lanes).alias("c"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("key", "c.*")
    )
    star = (
        index.alias("a")
        .join(centres.alias("b"), (F.col("a.key") == F.col("b.key")) & (_apart("a", "b", spec) > 0)
              & (_apart("a", "b", spec) <= spec.limit))
        .select(_name(spec, "a.").alias("a"), _name(spec, "b.").alias("b"))
        .distinct()
    )
    star = materialise(star)
    grouped = materialise(_labelled(distinct, connected_components(star)))
    probes = _probes(grouped, plan, spec, "component")
    index = _index(grouped, plan.parts, spec, "component")
    across = (
        probes.alias("a")
        .join(index.alias("b"), (F.col("a.key") == F.col("b.key"))
              & (_apart("a", "b", spec) <= spec.limit)
              & (F.col("a.component") < F.col("b.component")) & ~_met_before(plan, spec))
        .select(F.col("a.component").alias("a"), F.col("b.component").alias("b"))
        .distinct()
    )
    merged = connected_components(materialise(across)).withColumnRenamed("component", "merged")
    final = (
        grouped.join(merged, grouped["component"] == merged["node"], "left")
        .select("fingerprint", "first_id", F.coalesce("merged", "component").alias("component"))
    )
    least = materialise(final.groupBy("component").agg(F.min("first_id").alias("component_id")))
    return rows.join(final.join(least, "component").drop("first_id"), "fingerprint").select(
        "doc_id", "text_hash", "fingerprint", "component", "component_id"
    )


def keep_one(docs: DataFrame, spec: SimHash) -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate group, that of the
    smallest doc_id (ties: the smallest text hash; of wholly equal rows one).

    All columns of ``docs`` are returned; they may have any names.
    """
    return keep_first(docs, near_duplicates(docs, spec))


def keep_first(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """As ``keep_one``, of groups given by ``doc_id``, ``text_hash`` and ``component``."""
    counted = grouped.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_hash", "n")
    keepers = materialise(
        counted.groupBy("component").agg(F.min(order).alias("k"))
        .select(F.col("k.doc_id").alias("id"), F.col("k.text_hash").alias("hash"), F.col("k.n").alias("n"))
    )
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(
        keepers,
        F.col("row.doc_id").cast("long").eqNullSafe(F.col("id"))
        & (F.xxhash64("row.text") == F.col("hash")),
    )
    once = joined.where("n = 1").select("row.*")
    repeated = joined.where("n > 1").dropDuplicates(["id", "hash"]).select("row.*")
    return once.unionByName(repeated)
