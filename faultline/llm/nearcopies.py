"""Near copies by the exact similarity of their word shingles.

Two rows are linked if the Jaccard similarity of their sets of shingles is at least
``similarity``. Links are found in three steps:

* A SimHash search by the generalised pigeonhole principle, in ``lanes`` partitionings: each
  lane is a fingerprint of 64 bits of its own, cut into ``parts`` by correlated bits, and a row
  probes the parts within thresholds that dynamic programming chooses for it, as in
  ``simhash``. All pairs that differ by at most ``radius`` bits in any lane meet for sure; so
  do those within 479 of all 10,240 bits. A pair at 0.8 differs in 15 % of the bits (some sets
  of few shingles: in 16 %) and meets in no lane with probability 4e-7 (those: 1e-5), whatever
  else the table holds; at 0.85 with 6e-12. In sets of at most ``few`` shingles bits may flip
  more often. Two such sets at 0.8 are equal but for one shingle, and meet by that.
* Pairs that meet are sieved: by 128, then by 256 bits over the set, not over its repeats (a
  pair at 0.8 differs in 39 +- 6 of 256 bits, 72 pass).
* What the sieve leaves is compared shingle by shingle, by the texts.

Rows of equal sets are one node. The members of a part's value are first compared with its
smallest one; then only pairs of different components are, so a cloud of near copies
gives few rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm import simhash
from faultline.llm.common import map_batches
from faultline.llm.components import connected_components
from faultline.session import materialise

SEED = 42
LANES = 4  # of the sieve
BLOCK = 16  # lanes searched at once; their pairs are stored before the next are searched
HASHES_AT_ONCE = 1024


@dataclass(frozen=True)
class NearCopies:
    """words: of a shingle; similarity: least Jaccard similarity of a link; lanes: fingerprints
    of 64 bits, each searched within ``radius`` by ``parts``; first, sieve: most differing bits
    of 128 and of 256 of a compared pair; tiny: shingles up to which the 256 bits are no sieve,
    for so few leave them no such spread; few: up to which sets also meet by the sets with one
    shingle fewer."""

    words: int = 5
    similarity: float = 0.8
    lanes: int = 160
    radius: int = 2
    parts: int = 3
    first: int = 44
    sieve: int = 72
    tiny: int = 32
    few: int = 8

    @property
    def search(self) -> simhash.SimHash:
        return simhash.SimHash(words=self.words, radius=self.radius, parts=self.parts)


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingles, as sorted 64-bit hashes. A text of fewer words is one
    shingle, a blank one has none."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends[min(words, len(found)) - 1 :].tolist()
    hashes = {digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)}
    return np.sort(np.fromiter(hashes, np.uint64, len(hashes)))


def jaccard(left: np.ndarray, right: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are equal."""
    if not len(left) and not len(right):
        return 1.0
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both / (len(left) + len(right) - both)



def sketch(found: np.ndarray, lanes: int) -> np.ndarray:
    """Lanes of 64 bits of SimHash over a set of shingles."""
    counts = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(found), HASHES_AT_ONCE):
        for weight, rows in enumerate(_added(simhash._lanes(found[at : at + HASHES_AT_ONCE], lanes))):
            ones = np.unpackbits(rows.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
            counts += ones.sum(axis=0, dtype=np.int64) << weight
    return np.packbits(2 * counts > len(found), bitorder="little").view("<u8").astype(np.uint64)


def _added(rows: np.ndarray) -> list[np.ndarray]:
    """At most two rows of bits for each power of two; they add up to ``rows``, bit by bit."""
    made = []
    while len(rows):
        carried = [rows[:0]]
        while len(rows) > 2:
            third = len(rows) // 3
            a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
            carried.append((a & b) | ((a ^ b) & c))
            rows = np.concatenate([a ^ b ^ c, rows[3 * third :]])
        made.append(rows)
        rows = np.concatenate(carried)
    return made


def one_fewer(found: np.ndarray, spec: NearCopies) -> list[str]:
    """Digests of the set without each of its shingles, of those that can be so similar."""
    total = len(found)
    if total > spec.few or (total - 1) < spec.similarity * total:
        return []
    return [_digest(np.delete(found, i)) for i in range(total)]


def _digest(found: np.ndarray) -> str:
    return xxhash.xxh128_hexdigest(found.tobytes(), SEED)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.col("text").cast("binary").alias("text"),
    )


def _named(docs: DataFrame, spec: NearCopies) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``node`` (digest of the set) of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes = [_digest(shingles(text, spec.words)) for text in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text_hash"], pa.array(nodes, pa.string())], ["doc_id", "text_hash", "node"]
        )

    return map_batches(_source(docs), run, "doc_id long, text_hash long, node string")


def _sketched(texts: DataFrame, spec: NearCopies) -> DataFrame:
    """``node``, its source (``doc_id``, ``text_hash``) and the sketches of its set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lanes, sizes, fewer = [], [], []
        for text in batch["text"].to_pylist():
            found = shingles(text, spec.words)
            lanes.append(sketch(found, spec.lanes))
            sizes.append(len(found))
            fewer.append(one_fewer(found, spec))
        bits = np.stack(lanes).view(np.int64)
        return pa.RecordBatch.from_pydict(
            {
                "node": batch["node"],
                "doc_id": batch["doc_id"],
                "text_hash": batch["text_hash"],
                **{f"f{i}": pa.array(bits[:, i]) for i in range(LANES)},
                "size": pa.array(sizes, pa.int64()),
                "lanes": pa.array([row.astype("<u8").tobytes() for row in lanes], pa.binary()),
                "fewer": pa.array(fewer, pa.list_(pa.string())),
            }
        )

    lanes = ", ".join(f"f{i} long" for i in range(LANES))
    schema = f"node string, doc_id long, text_hash long, {lanes}, size long, lanes binary, fewer array<string>"
    return map_batches(texts, run, schema)


def _nodes(docs: DataFrame, rows: DataFrame, spec: NearCopies) -> DataFrame:
    """A row with ``id`` and sketches for each node, from one row of ``docs`` that has its set."""
    counted = rows.groupBy("node", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    source = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_hash", "n")
    chosen = materialise(
        counted.groupBy("node").agg(F.min(source).alias("s"))
        .select("node", F.col("s.doc_id").alias("id"), F.col("s.text_hash").alias("hash"), F.col("s.n").alias("n"))
    )

    def texts(some: DataFrame) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
        return _source(docs).join(some, same).select("node", "doc_id", "text_hash", "text")

    # Only rows that repeat wholly need to be told apart.
    once = texts(materialise(chosen.where("n = 1")))
    repeated = texts(materialise(chosen.where("n > 1"))).dropDuplicates(["node"])
    sketches = _sketched(once.union(repeated), spec)
    return materialise(sketches.withColumn("id", F.monotonically_increasing_id()))


def lane_bits(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of 0/1 of all lanes."""
    raw = np.frombuffer(b"".join(batch["lanes"].to_pylist()), np.uint8)
    return np.unpackbits(raw.reshape(batch.num_rows, -1), axis=1)


#: What a keyed row is: a value that others may probe, a value it probes itself, or both.
PROBES, INDEXED = 1, 2


def part_values(
    bits: np.ndarray, plan: simhash.PartPlan, lane: int, spec: NearCopies
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, places of their rows in ``bits`` (of one lane) and kinds."""
    wanted = simhash.allocate(bits, plan, spec.search)
    keys, places, kinds = [], [], []
    for i, part in enumerate(plan.parts):
        own = simhash._values(bits, part) | ((lane * spec.parts + i) << 48)
        keys.append(own)
        places.append(np.arange(len(bits)))
        kinds.append(np.where(wanted[:, i] >= 0, PROBES | INDEXED, INDEXED))
        for t in range(1, spec.search.most + 1):
            at, masks = np.flatnonzero(wanted[:, i] == t), simhash._masks(len(part), t)[1:]
            keys.append((own[at][:, None] ^ masks).ravel())
            places.append(np.repeat(at, len(masks)))
            kinds.append(np.full(len(at) * len(masks), PROBES))
    return np.concatenate(keys), np.concatenate(places), np.concatenate(kinds)


def _keyed(nodes: DataFrame, plans: list[simhash.PartPlan], lanes: range, spec: NearCopies) -> DataFrame:
    """A row for each value of the lanes' parts that a node is indexed by or probes."""
    chosen = {lane: plans[lane] for lane in lanes}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = lane_bits(batch)
        made = [part_values(bits[:, 64 * n : 64 * n + 64], plan, n, spec) for n, plan in chosen.items()]
        keys, places, kinds = (np.concatenate(column) for column in zip(*made, strict=True))
        taken = batch.select(["id", "component", "f0", "f1"]).take(pa.array(places))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(kinds.astype(np.int32)), *taken.columns],
            ["key", "kind", *taken.schema.names],
        )

    schema = "key long, kind int, id long, component long, f0 long, f1 long"
    return map_batches(nodes.select("id", "component", "f0", "f1", "lanes"), run, schema)


def _first_sieve(spec: NearCopies) -> Column:
    bits = [F.bit_count(F.col(f"a.f{i}").bitwiseXOR(F.col(f"b.f{i}"))) for i in range(2)]
    return reduce(Column.__add__, bits) <= spec.first


CARRIED = ["id", *[f"f{i}" for i in range(LANES)], "size"]


def _near(left: str, right: str, spec: NearCopies) -> Column:
    """False for two carried rows that surely, or by their bits, are less similar."""

    def a(name: str) -> Column:
        return F.col(f"{left}.{name}")

    def b(name: str) -> Column:
        return F.col(f"{right}.{name}")

    # A subset of a set is as similar as their sizes at most.
    sizes = F.least(a("size"), b("size")) / F.greatest(a("size"), b("size")) >= F.lit(spec.similarity)
    bits = [F.bit_count(a(f"f{i}").bitwiseXOR(b(f"f{i}"))) for i in range(LANES)]
    close = (F.least(a("size"), b("size")) <= spec.tiny) | (reduce(Column.__add__, bits) <= spec.sieve)
    return sizes & close


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, spec: NearCopies) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets of shingles are similar enough."""
    carried = nodes.select(*CARRIED)
    pairs = materialise(
        pairs.alias("p").join(carried.alias("a"), F.col("p.a") == F.col("a.id"))
        .join(carried.alias("b"), F.col("p.b") == F.col("b.id"))
        .where(_near("a", "b", spec)).select("p.a", "p.b")
    )
    texts = _texts(docs, nodes, pairs.select("a").union(pairs.select("b")).distinct())
    both = (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
        .select("a", "b", "left", "right")
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[int, np.ndarray] = {}

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in seen:
                if len(seen) >= 8:
                    seen.pop(next(iter(seen)))
                seen[node] = shingles(text.as_py(), spec.words)
            return seen[node]

        a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
        left, right = batch["left"], batch["right"]
        # No rounding: a pair at exactly the least similarity is linked.
        kept = [
            jaccard(of(a[i], left[i]), of(b[i], right[i])) >= spec.similarity for i in range(len(a))
        ]
        return batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return map_batches(both, run, "a long, b long")


def near_copies(docs: DataFrame, spec: NearCopies | None = None) -> DataFrame:
    """Group rows of ``docs`` that are linked, directly or by others.

    docs: needs ``doc_id`` and ``text``. Returns ``doc_id``, ``text_hash`` and
    ``component`` (the same string for all rows of a group) for each row. Texts of equal
    sets are one group; so are all null and blank texts.
    """
    spec = spec or NearCopies()
    rows = materialise(_named(docs, spec))
    nodes = _nodes(docs, rows, spec)
    plans = simhash.plan_groups(nodes.select("lanes"), spec.search, spec.lanes, lane_bits)
    blocks = [range(at, min(at + BLOCK, spec.lanes)) for at in range(0, spec.lanes, BLOCK)]
    star = materialise(_star(nodes, plans, blocks[0], spec).union(_one_apart(nodes)).distinct())
    links = materialise(_linked(star, docs, nodes, spec))
    parts = connected_components(links).withColumnRenamed("node", "member")
    grouped = materialise(
        nodes.join(parts, F.col("id") == F.col("member"), "left")
        .select("id", "f0", "f1", "lanes", F.coalesce("component", "id").alias("component"))
    )
    across = reduce(
        DataFrame.union, [materialise(_across(grouped, plans, block, spec)) for block in blocks]
    )
    across = materialise(across.distinct().join(star, ["a", "b"], "left_anti"))
    more = materialise(_linked(across, docs, nodes, spec))
    merged = connected_components(links.union(more)).withColumnRenamed("node", "member")
    named = nodes.select("node", "id").join(merged, F.col("id") == F.col("member"), "left")
    return rows.join(
        named.select("node", F.coalesce("component", "id").cast("string").alias("component")), "node"
    ).drop("node")


def _ordered() -> list[Column]:
    return [F.greatest("a.id", "b.id").alias("a"), F.least("a.id", "b.id").alias("b")]


def _star(nodes: DataFrame, plans: list[simhash.PartPlan], lanes: range, spec: NearCopies) -> DataFrame:
    """Pairs of the members of a part's value with its smallest one."""
    plain = nodes.withColumn("component", F.col("id"))
    index = _keyed(plain, plans, lanes, spec).where(F.col("kind").bitwiseAND(INDEXED) > 0)
    index = index.select("key", "id", "f0", "f1")
    centres = materialise(
        index.groupBy("key").agg(F.min(F.struct("id", "f0", "f1")).alias("c"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("key", "c.*")
    )
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id")) & _first_sieve(spec)
    return index.alias("a").join(centres.alias("b"), met).select(*_ordered()).distinct()


def _one_apart(nodes: DataFrame) -> DataFrame:
    """Pairs of a set of few shingles and the one that has one more."""
    fewer = nodes.select("id", F.explode("fewer").alias("node"))
    return (
        fewer.alias("a").join(nodes.select("node", "id").alias("b"), F.col("a.node") == F.col("b.node"))
        .select(*_ordered())
    )


def _across(grouped: DataFrame, plans: list[simhash.PartPlan], lanes: range, spec: NearCopies) -> DataFrame:
    """Pairs of different components, of a node that probes a value and one that has it."""
    keyed = _keyed(grouped, plans, lanes, spec)
    # Both sides in one condition: one shuffle then serves both.
    kinds = F.col("a.kind").bitwiseAND(PROBES) + F.col("b.kind").bitwiseAND(INDEXED) == PROBES + INDEXED
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component"))
    return keyed.alias("a").join(keyed.alias("b"), met & kinds & _first_sieve(spec)).select(*_ordered()).distinct()


def _texts(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``id`` and a text of each node of ``ids`` (their column ``a``)."""
    wanted = nodes.join(ids, F.col("id") == F.col("a"), "left_semi").select(
        "id", F.col("doc_id").alias("wanted_id"), F.col("text_hash").alias("hash")
    )
    found = _source(docs).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("hash"))
    )
    return materialise(found.select("id", "text").dropDuplicates(["id"]))


def keep_one(docs: DataFrame, spec: NearCopies | None = None) -> DataFrame:
    """The rows of ``docs`` with one row of each group, as ``simhash.keep_one`` chooses it."""
    return simhash.keep_first(docs, near_copies(docs, spec))
