"""Features known when an incident opens, without a look ahead."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.ordering import (
    MICROS_PER_DAY,
    count_points,
    micros,
    running_before,
    time_levels,
)
from faultline.operators.quality import require_clean, risk_input_checks
from faultline.session import materialise

# What is counted before each opening: key column -> look-back days.
PRIOR_COUNTS = {
    "assigned_group": (1, 7, 30),
    "product": (7,),
    "category": (7,),
    "priority_code": (7,),
}
OUTCOME_KEY, OUTCOME_DAYS = "assigned_group", 30
_VALUES = ["opened", "known", "breached"]
CELLS = 144  # parts of a day
CELL_MICROS = MICROS_PER_DAY // CELLS


def _key_text(name: str) -> str:
    """Key as text in which null is a value of its own."""
    return f"coalesce('=' || {name}, 'null')"


def _held(kind: str) -> str:
    """Column of a point with its key of one kind; without a value the point is none of that kind."""
    return f"key_{kind}"


def _days_back(kind: str) -> list[int]:
    return sorted({0, *PRIOR_COUNTS[kind], *([OUTCOME_DAYS] if kind == OUTCOME_KEY else [])})


def _structs(entries: list[dict[str, str]]) -> Column:
    """Rows to unfold, as one parsed expression."""
    rows = [", ".join(f"{value} AS {name}" for name, value in entry.items()) for entry in entries]
    return F.expr("inline(array(" + ", ".join(f"struct({row})" for row in rows) + "))")


def _instants(silver: DataFrame) -> DataFrame:
    outcome = F.coalesce(F.col(S.ELIGIBLE), F.lit(False)) & F.col(S.TARGET).isNotNull()
    return silver.select(
        "incident_id",
        *PRIOR_COUNTS,
        micros(F.col("opened_at")).alias("opened_us"),
        F.when(outcome, micros(F.col("closed_at"))).alias("outcome_us"),
        F.col(S.TARGET).cast("long").alias("target"),
    )


def _opening() -> dict[str, str]:
    keys = {_held(kind): _key_text(kind) for kind in PRIOR_COUNTS}
    return {"incident_id": "incident_id", "at": "opened_us", "asked": "true"} | keys | {
        "opened": "1L", "known": "0L", "breached": "0L"
    }


def _closing() -> dict[str, str]:
    none = "CAST(NULL AS string)"
    keys = {_held(kind): _key_text(kind) if kind == OUTCOME_KEY else none for kind in PRIOR_COUNTS}
    return {"incident_id": none, "at": "outcome_us", "asked": "false"} | keys | {
        "opened": "0L", "known": "1L", "breached": "target"
    }


def _per_kind(points: DataFrame, at: str) -> DataFrame:
    """A row with ``kind`` and ``key`` for each key of a point, with ``at`` and the values."""
    kinds = [{"kind": f"'{kind}'", "key": _held(kind)} for kind in PRIOR_COUNTS]
    return points.select(at, *_VALUES, _structs(kinds)).where(F.col("key").isNotNull())


def _all_kinds() -> list[Column]:
    """The key columns of a point that has a ``kind`` and a ``key``."""
    return [F.when(F.col("kind") == kind, F.col("key")).alias(_held(kind)) for kind in PRIOR_COUNTS]


def _cells(points: DataFrame) -> DataFrame:
    """Totals before each part of a day that holds points or the start of a look-back:
    ``kind``, ``key``, ``cell`` and the values."""
    keys = ["kind", "key"]
    # Stored: small beside the points, and read for the parts and for the look-backs.
    held = materialise(
        _per_kind(points, "cell").groupBy(*keys, "cell").agg(*[F.sum(v).alias(v) for v in _VALUES])
    )

    def starts(kind: str) -> str:
        return f"array({', '.join(f'cell - {days * CELLS}' for days in _days_back(kind))})"

    marks = held.select(
        *keys,
        F.expr(f"explode({_by_kind(starts)})").alias("cell"),
        *[F.lit(0).cast("long").alias(v) for v in _VALUES],
    )
    levels = {"cell_day": F.floor(F.col("cell") / CELLS), "cell": F.col("cell")}
    counted = count_points(held.unionByName(marks), levels, {v: F.col(v) for v in _VALUES}, keys)
    return running_before(counted, list(levels), _VALUES, keys).select(
        *keys, "cell", *[F.col(f"before_{v}").alias(v) for v in _VALUES]
    )


def _by_kind(text: Callable[[str], str]) -> str:
    return "CASE " + " ".join(f"WHEN kind = '{k}' THEN {text(k)}" for k in PRIOR_COUNTS) + " END"


def _totals_of(kind: str) -> list[tuple[str, int]]:
    """Values and days back at which a running total of a kind is looked up."""
    spans = [("opened", days) for days in (0, *PRIOR_COUNTS[kind])]
    return spans + [(v, d) for v in _VALUES[1:] for d in (0, OUTCOME_DAYS) if kind == OUTCOME_KEY]


class _Totals:
    """Values of points added up by cell (a part, a key and a day) and place in it.

    Points must come by place within a cell.
    """

    def __init__(self, cells: np.ndarray, place: np.ndarray, values: np.ndarray):
        order = np.argsort(cells, kind="stable")
        self.cells, self.first, counts = np.unique(cells[order], return_index=True, return_counts=True)
        self.code = (np.repeat(np.arange(len(counts)), counts) << 31) | place[order]
        self.sums = np.concatenate([np.zeros((1, values.shape[1]), np.int64), np.cumsum(values[order], axis=0)])

    def before(self, cells: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Sums over the points of each cell at earlier places; 0 for a cell without points."""
        at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        low = self.first[at]
        high = np.maximum(np.searchsorted(self.code, (at << 31) | place), low)
        return np.where((self.cells[at] == cells)[:, None], self.sums[high] - self.sums[low], 0)


@dataclass
class _Points:
    """Points of one kind, by part and place."""

    keys: pa.Array
    part: np.ndarray
    place: np.ndarray
    day: np.ndarray
    values: np.ndarray

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each point's part and key, the days, and each point's place among them."""
        codes = pc.dictionary_encode(self.keys).indices.to_numpy()
        group = self.part * (int(codes.max()) + 1) + codes
        days, at = np.unique(self.day, return_inverse=True)
        return group, days, at

    def after(self, earlier: _Points | None) -> _Points:
        if earlier is None:
            return self
        arrays = [np.concatenate([getattr(p, n) for p in (earlier, self)]) for n in _ARRAYS]
        return _Points(pa.concat_arrays([earlier.keys, self.keys]), *arrays)

    def summed_up(self, part: int, end: int) -> _Points | None:
        """Those of one part as two of each key and day: all before the place ``end``, and at it."""
        rows = np.flatnonzero(self.part == part)
        if not len(rows):
            return None
        mine = _Points(self.keys.take(pa.array(rows)), *[getattr(self, n)[rows] for n in _ARRAYS])
        group, days, at = mine.cells()
        last = mine.place == end
        # All before the end come first, as points by place do.
        code = (last * (group.max() + 1) + group) * len(days) + at
        order = np.argsort(code, kind="stable")
        firsts = np.flatnonzero(np.diff(code[order], prepend=-1))
        one = order[firsts]
        return _Points(
            mine.keys.take(pa.array(one)), mine.part[one], np.where(last[one], end, 0), mine.day[one],
            np.add.reduceat(mine.values[order], firsts),
        )


_ARRAYS = ["part", "place", "day", "values"]


def _points_of(kind: str, batch: pa.RecordBatch, part: np.ndarray, place: np.ndarray) -> _Points:
    keys = batch[_held(kind)]
    rows = np.flatnonzero(keys.is_valid().to_numpy(zero_copy_only=False))
    names = _VALUES if kind == OUTCOME_KEY else _VALUES[:1]
    values = np.stack([batch[v].to_numpy()[rows] for v in names], axis=1)
    return _Points(keys.take(pa.array(rows)), part[rows], place[rows], batch["day"].to_numpy()[rows], values)


def _looked_up(kind: str, points: _Points, asked: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
    """The totals of a kind for the rows of ``points`` numbered in ``asked``."""
    group, days, at = points.cells()
    totals = _Totals(group * len(days) + at, points.place, points.values)
    place, found = points.place[asked], {}
    for back in _days_back(kind):
        then = points.day[asked] - back
        day = np.minimum(np.searchsorted(days, then), len(days) - 1)
        cells = np.where(days[day] == then, group[asked] * len(days) + day, -1)
        sums = totals.before(cells, place)
        for i, value in enumerate(_VALUES):
            if (value, back) in _totals_of(kind):
                found[f"{kind}_{value}_{back}"] = sums[:, i]
    return found


def _totals_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running totals at each asked point and at the starts of its look-backs.

    The points of a part of the day come together, by place in the part, of all keys and
    days. So earlier points of any of these days have been seen; what is kept of them
    are two sums a key and day: before the last place, and at it. Batches are taken
    together until they hold as many points as are kept.
    """
    kept: dict[str, _Points | None] = dict.fromkeys(PRIOR_COUNTS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        part, place = np.divmod(batch["place"].to_numpy(), CELL_MICROS + 1)
        asked = batch["asked"].to_numpy(zero_copy_only=False).astype(bool)
        found = {}
        for kind in PRIOR_COUNTS:
            own, earlier = _points_of(kind, batch, part, place), kept[kind]
            if earlier is not None and earlier.part[0] != part[0]:
                earlier = None
            points = own.after(earlier)
            held = batch[_held(kind)].is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(asked[held]) + (len(points.part) - len(own.part))
            if len(rows):
                found |= _looked_up(kind, points, rows)
            kept[kind] = points.summed_up(part[-1], place[-1])
        ids = batch["incident_id"].filter(batch["asked"])
        return pa.RecordBatch.from_pydict(
            {"incident_id": ids}
            | {name: pa.array(found.get(name, np.zeros(0)), pa.int64()) for name in _TOTALS}
        )

    waiting, count = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            count += batch.num_rows
        if count and count >= sum(len(p.part) for p in kept.values() if p is not None):
            yield run(_together(waiting))
            waiting, count = [], 0
    if waiting:
        yield run(_together(waiting))


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


_TOTALS = [f"{kind}_{value}_{days}" for kind in PRIOR_COUNTS for value, days in _totals_of(kind)]


def _found(points: DataFrame) -> DataFrame:
    """Openings, known outcomes and breaches before each asked point and its look-backs:
    a row per asked point with ``incident_id`` and a column per kind, value and days back.

    points: ``at``, ``incident_id``, ``asked``, a key of each kind and the values; an asked
    point has all keys. A look-back of whole days starts at the same time of day. So the
    points of one part of the day, on all days, are dealt to one task and run through by
    the time of day; there each look-back finds what it falls among. The totals of all
    earlier parts come in as one more point of each key and day. Nothing is joined, and
    nothing asked is unfolded.
    """
    placed = points.where(F.col("at").isNotNull()).withColumn(
        "cell", F.floor(F.col("at") / CELL_MICROS)
    )
    names = ["incident_id", "asked", *map(_held, PRIOR_COUNTS), *_VALUES, "cell", "place"]
    before = _cells(placed).select(
        "cell", *_VALUES, *_all_kinds(), F.lit(None).cast("string").alias("incident_id"),
        F.lit(False).alias("asked"), F.lit(0).cast("long").alias("place"),
    )
    # Place 0 is before the part.
    placed = placed.withColumn("place", F.col("at") - F.col("cell") * CELL_MICROS + 1)
    dealt = (
        placed.select(*names)
        .unionByName(before.select(*names))
        .withColumn("part", F.pmod("cell", F.lit(CELLS)))
        .repartition("part")
        .select(
            "incident_id", "asked", *map(_held, PRIOR_COUNTS), *_VALUES,
            F.floor(F.col("cell") / CELLS).alias("day"),
            # One number, so that the sort compares nothing else.
            (F.col("part") * (CELL_MICROS + 1) + F.col("place")).alias("place"),
        )
        .sortWithinPartitions("place")
    )
    totals = ", ".join(f"{name} long" for name in _TOTALS)
    return dealt.mapInArrow(_totals_before, f"incident_id string, {totals}")


def _moved(found: DataFrame) -> DataFrame:
    """The nine features per incident, as differences of the running totals found for it."""

    def moved(kind: str, value: str, days: int) -> str:
        return f"max({kind}_{value}_0) - max({kind}_{value}_{days})"

    columns = {
        f"{kind.removesuffix('_code')}_incidents_previous_{days}d": moved(kind, "opened", days)
        for kind, spans in PRIOR_COUNTS.items()
        for days in spans
    }
    known = moved(OUTCOME_KEY, "known", OUTCOME_DAYS)
    breached = moved(OUTCOME_KEY, "breached", OUTCOME_DAYS)
    columns |= {
        "assigned_group_known_outcomes_previous_30d": known,
        "assigned_group_breaches_previous_30d": breached,
        "assigned_group_breach_rate_previous_30d": f"try_divide({breached}, {known})",
    }
    # Dealt first: few incidents have two rows, so adding up before that spares nothing.
    return found.repartition("incident_id").groupBy("incident_id").agg(
        *[F.expr(text).alias(name) for name, text in columns.items()]
    )


def history_features(silver: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The nine historical features per incident id.

    asked: if given, the only ids (``incident_id``) to return; all rows count for them.
    """
    instants, opening = _instants(silver), _opening()
    if asked is not None:
        wanted = asked.select("incident_id").distinct().withColumn("wanted", F.lit(True))
        instants = instants.join(wanted, "incident_id", "left")
        opening |= {"asked": "coalesce(wanted, false)"}
    return _moved(_found(instants.select(_structs([opening, _closing()]))))


LONGEST = max(OUTCOME_DAYS, *(days for spans in PRIOR_COUNTS.values() for days in spans))


def history_points(opened: DataFrame, closed: DataFrame) -> DataFrame:
    """Openings of ``opened`` and known outcomes of ``closed``, added up per key and instant.

    What a stream has to remember: with the points of the last ``LONGEST`` days the
    features of any arriving row follow (``features_from_points``).
    """
    openings = _instants(opened).select(_structs([_opening()]))
    closings = _instants(closed).select(_structs([_closing()]))
    points = _per_kind(openings.unionByName(closings), "at")
    levels = {"at_day": time_levels(F.col("at"))["at_day"], "at": F.col("at")}
    return count_points(points, levels, {v: F.col(v) for v in _VALUES}, ["kind", "key"])


def features_from_points(opened: DataFrame, points: DataFrame) -> DataFrame:
    """The nine features of the rows ``opened``, counted in ``points``.

    ``points`` must hold the openings and outcomes of the ``LONGEST`` days before each row;
    older ones and those of other keys change nothing. Only keys that ``opened`` holds are
    run over.
    """
    none = {v: "0L" for v in _VALUES}
    asked = _instants(opened).select(_structs([_opening() | none]))
    keys = materialise(_per_kind(asked, "at").select("kind", "key").distinct())
    counted = points.join(keys, ["kind", "key"], "left_semi").select(
        F.lit(None).cast("string").alias("incident_id"), "at", F.lit(False).alias("asked"),
        *_all_kinds(), *_VALUES,
    )
    return _moved(_found(asked.unionByName(counted)))


def temporal_features(silver: DataFrame) -> DataFrame:
    opened = F.col("opened_at")
    return silver.withColumns(
        {
            "opened_hour": F.hour(opened),
            "opened_day_of_week": F.weekday(opened),
            "opened_month": F.month(opened),
            "is_weekend": (F.weekday(opened) >= 5).cast("int"),
        }
    )


def risk_features(
    silver: DataFrame,
    require_targets: bool = True,
    check: bool = True,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Ids, eligibility, target and the twenty model features; of the ids in ``asked`` only,
    if given."""
    if check:
        require_clean(risk_input_checks(silver, require_targets))
    return with_history(silver, history_features(silver, asked))


def with_history(silver: DataFrame, history: DataFrame) -> DataFrame:
    # Both sides have a row per incident. Planned from the size of compressed files, a small
    # table would be sent through the driver.
    joined = temporal_features(silver).join(history.hint("merge"), "incident_id")
    return joined.select("incident_id", "opened_at", S.ELIGIBLE, S.TARGET, *S.MODEL_FEATURES)


def temporal_split(features: DataFrame, train_end, test_start, unit: str = "month") -> DataFrame:
    """Mark training rows up to one period and test rows from another."""
    period = F.date_trunc(unit, F.col("opened_at"))
    last, first = [F.date_trunc(unit, F.lit(d).cast("timestamp")) for d in (train_end, test_start)]
    eligible = F.coalesce(F.col(S.ELIGIBLE), F.lit(False))
    return features.withColumn(
        "dataset_split",
        F.when(eligible & (period <= last), F.lit("pretest_train"))
        .when(eligible & (period >= first), F.lit("final_test"))
        .otherwise("not_eligible"),
    )


def split_summary(features: DataFrame) -> DataFrame:
    target = F.coalesce(F.col(S.TARGET), F.lit(False)).cast("int")
    return features.groupBy("dataset_split").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(target).alias("positives"),
        F.avg(target).alias("positive_rate"),
        F.min("opened_at").alias("opened_at_min"),
        F.max("opened_at").alias("opened_at_max"),
    )


def eligible_rows(frame: DataFrame) -> DataFrame:
    return frame.where(F.col(S.ELIGIBLE))


def breach_rate_by_priority(frame: DataFrame) -> DataFrame:
    return (
        eligible_rows(frame)
        .groupBy("priority_code")
        .agg(
            F.count(F.lit(1)).alias("eligible"),
            F.avg(F.col(S.TARGET).cast("int")).alias("breach_rate"),
        )
    )


def monthly_breach_rate(frame: DataFrame) -> DataFrame:
    breaches = F.coalesce(F.sum(F.col(S.TARGET).cast("int")), F.lit(0))
    return (
        eligible_rows(frame)
        .groupBy(F.date_format("opened_at", "yyyy-MM").alias("year_month"))
        .agg(
            F.count(F.lit(1)).alias("eligible"),
            breaches.alias("breaches"),
            (breaches * 100 / F.count(F.lit(1))).alias("breach_rate_pct"),
        )
    )


def latest_features(silver: DataFrame) -> DataFrame:
    """Features of the newest cohort, from no more history than they look back on.

    Openings and closings of the longest look-back before the cohort's day are enough.
    """
    last = eligible_rows(silver).agg(F.max(F.to_date("opened_at"))).first()[0]
    start = F.date_sub(F.lit(last).cast("date"), LONGEST).cast("timestamp")
    recent = silver.where((F.col("opened_at") >= start) | (F.col("closed_at") >= start))
    # Written once: the cohort's day and its rows are read in passes of their own.
    return latest_cohort(materialise(risk_features(recent, require_targets=False, check=False)))


def latest_cohort(features: DataFrame) -> DataFrame:
    """Eligible rows opened on the last day that has any."""
    eligible = eligible_rows(features)
    last = eligible.agg(F.max(F.to_date("opened_at"))).scalar()
    return eligible.where(F.to_date("opened_at") == last)
