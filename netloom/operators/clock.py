"""The capture's clock: what time it is at each packet, robust to stray timestamps.

The clock goes forward with the packets' times and ignores a time over ``TOLERANCE`` away, unless the next timed packet agrees with it: then
it jumps, forward or back. A jump back begins a new epoch, in which earlier times can't be compared.

Where no time is that far away, the clock is a running maximum, taken by ranges of indexes. Otherwise it is a state (clock, held time) that
every packet steps. Ranges are stepped side by side from guessed states, each from where the range before it ended; those whose guess
was wrong are stepped again until none is. A state is forgotten with the next accepted or confirmed time, so a few rounds do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.stored import discard, materialize

from .ranges import carry
from .windows import confirmed_clock

#: The largest step that needs no confirmation: a day.
TOLERANCE = 86_400_000_000_000
#: Packet indexes in a range; as many whole packets are held by a Python task at most.
RANGE = 1 << 16
ACCEPTED, HELD, FORWARD, BACKWARD = 0, 1, 2, 3
STATE = "now bigint, candidate bigint"


def step_all(times: np.ndarray, now: int | None, candidate: int | None, tolerance: int) -> tuple[np.ndarray, np.ndarray, int | None, int | None]:
    """``(clock, step, now, candidate)`` after each of the times in order; stretches without a far time are one running maximum."""
    clock, step, i, n = np.empty(len(times), np.int64), np.zeros(len(times), np.int8), 0, len(times)
    while i < n:
        if now is None:
            now = int(times[i])
        size = 64
        while i < n:
            part = times[i : i + size]
            running = np.maximum.accumulate(np.concatenate([[now], part]))
            far = np.flatnonzero(np.abs(part - running[:-1]) > tolerance)
            good = int(far[0]) if len(far) else len(part)
            if good:
                clock[i : i + good] = running[1 : good + 1]
                now, candidate = int(running[good]), None
                i += good
            if len(far):
                break
            size = min(2 * size, 1 << 16)
        if i == n:
            break
        at = int(times[i])
        if candidate is not None and abs(candidate - at) <= tolerance:
            later = max(candidate, at)
            step[i] = BACKWARD if later < now else FORWARD
            now, candidate = later, None
        else:
            candidate = at
            step[i] = HELD
        clock[i] = now
        i += 1
    return clock, step, now, candidate


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[pa.RecordBatch]]:
    """Whole groups of rows of one key, each in the parts that it came in, from batches in which they stand together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        of = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and held[-1].column(key)[0] != part.column(key)[0]:
                yield held
                held = []
            held.append(part)
    if held:
        yield held


def _entry(group: list[pa.RecordBatch]) -> tuple[int | None, int | None]:
    return group[0].column("in_now")[0].as_py(), group[0].column("in_candidate")[0].as_py()


def _times(group: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    column = pa.concat_arrays([part.column("at") for part in group])
    timed = np.asarray(column.is_valid())
    return np.asarray(column.fill_null(0)), timed


def confirm_all(times: np.ndarray, now: int | None, previous: int | None, width: int) -> tuple[np.ndarray, np.ndarray, int | None, int | None]:
    """``(clock, step, now, previous)`` of a rule's clock, which goes forward to the lower of the last two times, and back to the higher
    of them where both lie over ``width`` behind it. At the first time it is not known yet; that time is given."""
    clock, step, i, n = np.empty(len(times), np.int64), np.zeros(len(times), np.int8), 0, len(times)
    if n and previous is None:
        clock[0], previous, i = times[0], int(times[0]), 1
    while i < n:
        before = np.concatenate([[previous], times[i:-1]])
        low, high = np.minimum(before, times[i:]), np.maximum(before, times[i:])
        running = np.maximum.accumulate(low if now is None else np.concatenate([[now], low]))
        known = np.concatenate([[np.iinfo(np.int64).min // 2], running[:-1]]) if now is None else running[:-1]
        back = np.flatnonzero(high + width < known)
        good = int(back[0]) if len(back) else n - i
        running = running if now is None else running[1:]
        clock[i : i + good] = running[:good]
        if good:
            now, previous = int(running[good - 1]), int(times[i + good - 1])
        i += good
        if i < n:
            now, step[i] = int(high[good]), BACKWARD
            clock[i], previous = now, int(times[i])
            i += 1
    return clock, step, now, previous


def _exits(machine, limit: int):
    """One row per range: the state it was entered and left with, and what happened on the way."""
    names = ["range", "in_now", "in_candidate", "now", "candidate", "first_step", "resets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "range"):
            at, timed = _times(group)
            entry = _entry(group)
            _, step, now, candidate = machine(at[timed], *entry, limit)
            row = (group[0].column("range")[0].as_py(), *entry, now, candidate, int(step[0]) if len(step) else None, int((step == BACKWARD).sum()))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names)

    return run


EXIT = "range bigint, in_now bigint, in_candidate bigint, now bigint, candidate bigint, first_step bigint, resets bigint"


def _clocks(machine, limit: int):
    """Every row with its clock, epoch and what became of its time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "range"):
            at, timed = _times(group)
            now, candidate = _entry(group)
            epoch, confirms = group[0].column("in_epoch")[0].as_py(), group[0].column("next_confirms")[0].as_py()
            clock, step, *_ = machine(at[timed], now, candidate, limit)
            # a row without a time has the clock of the timed one before it
            place = np.cumsum(timed)
            known = np.concatenate([[now or 0], clock])[place]
            missing = (place == 0) & (now is None)
            epochs = epoch + np.concatenate([[0], np.cumsum(step == BACKWARD)])[place]
            held, confirmed = np.zeros(len(at), bool), np.zeros(len(at), np.int8)
            held[timed] = step == HELD
            # the next timed packet of a held one confirms it or not; that of the last one is in the next range
            after = np.append(np.where(step[1:] >= FORWARD, step[1:], 0), confirms)[: len(step)]
            confirmed[timed] = np.where(step == HELD, after, 0)
            out = [pa.array(known, pa.int64(), mask=missing), pa.array(epochs, pa.int64()), pa.array(held), pa.array(confirmed, pa.int8())]
            i = 0
            for part in group:
                yield pa.RecordBatch.from_arrays([part.column("row"), *[c.slice(i, part.num_rows) for c in out]], ["row", "clock", "epoch", "held", "confirmed"])
                i += part.num_rows

    return run


def ranged_maximum(packets: DataFrame, order: str, ts: str, size: int) -> DataFrame:
    """Add ``before``, the running maximum of ``ts`` over all rows before this one; null for the first.

    The maximum of each range of ``size`` indexes is a small written table; two levels of ranges keep its running maximum off one task."""
    tops = materialize(packets.groupBy(F.floor(F.col(order) / size).alias("__range")).agg(F.max(ts).alias("__top")), "clock-ranges")
    tops = tops.withColumn("__block", F.floor(F.col("__range") / 4096)).withColumn("__all", F.lit(0))
    tops = carry(tops, ["__all"], "__block", __earlier=(F.max, F.col("__top")))
    own = F.max("__top").over(Window.partitionBy("__block").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = tops.select("__range", F.greatest(own, "__earlier").alias("__start"))
    w = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranged = packets.withColumn("__range", F.floor(F.col(order) / size)).join(starts, "__range")
    return ranged.withColumn("before", F.greatest(F.max(ts).over(w), "__start")).drop("__range", "__start")


def _before(exits: DataFrame, order: str = "range") -> DataFrame:
    """Each range with the state that the range before it was left with (``at_*``), whatever numbers are left out."""
    cut = carry(exits.withColumn("__block", F.floor(F.col(order) / 4096)).withColumn("__all", F.lit(0)), ["__all"], "__block", __last=(F.max, F.struct(order, "now", "candidate")))
    w = Window.partitionBy("__block").orderBy(order)
    last = F.coalesce(F.lag(F.struct(order, "now", "candidate")).over(w), "__last")
    return cut.withColumn("__l", last).select("*", F.col("__l.now").alias("at_now"), F.col("__l.candidate").alias("at_candidate")).drop("__block", "__all", "__last", "__l")


def range_states(rows: DataFrame, machine, limit: int) -> DataFrame:
    """``EXIT`` of every range of the written table ``rows`` (range, packet_index, at), each stepped from where the one before it ended."""

    def stepped(part: DataFrame) -> DataFrame:
        return part.select("range", "packet_index", "at", "in_now", "in_candidate").repartition("range").sortWithinPartitions("range", "packet_index").mapInArrow(_exits(machine, limit), EXIT)

    none = F.lit(None).cast("bigint")
    exits = materialize(stepped(rows.withColumn("in_now", none).withColumn("in_candidate", none)), "clock-exits")
    while True:
        wrong = _before(exits).filter(~(F.col("in_now").eqNullSafe(F.col("at_now")) & F.col("in_candidate").eqNullSafe(F.col("at_candidate"))))
        wrong = materialize(wrong.select("range", F.col("at_now").alias("in_now"), F.col("at_candidate").alias("in_candidate")), "clock-wrong")
        if wrong.isEmpty():
            discard(wrong)
            return exits
        again = stepped(rows.join(wrong, "range"))
        after = materialize(exits.join(wrong.select("range"), "range", "left_anti").unionByName(again), "clock-exits")
        discard(exits, wrong)
        exits = after


def _unbroken(packets: DataFrame, order: str, ts: str, span: int, *more: Column) -> DataFrame:
    """The packets as a written table with their running maximum as ``clock``, and ``epoch``, ``held`` and ``confirmed`` of a clock that never jumps."""
    plain = ranged_maximum(packets, order, ts, span)
    return materialize(plain.select(*packets.columns, F.greatest(ts, "before").alias("clock"), F.lit(0).cast("bigint").alias("epoch"), F.lit(False).alias("held"), F.lit(0).cast("tinyint").alias("confirmed"), *more), "clocked")


def _first_clock(table: DataFrame, order: str) -> Column:
    return table.filter(F.col("clock").isNotNull()).agg(F.min(F.struct(order, "clock"))["clock"]).scalar()


def running(packets: DataFrame, order: str = "packet_index", ts: str = "ts_ns", span: int = RANGE) -> DataFrame:
    """The columns of ``clocked`` where no time is doubted: the clock is the running maximum, however far times step forward or back."""
    table = _unbroken(packets, order, ts, span)
    timed = table.filter(F.col("clock").isNull()).isEmpty()
    return table if timed else table.withColumn("clock", F.coalesce("clock", _first_clock(table, order), F.lit(0)))


def clocked(packets: DataFrame, tolerance: int = TOLERANCE, order: str = "packet_index", ts: str = "ts_ns", span: int = RANGE) -> DataFrame:
    """The packets as a written table, with ``clock``, ``epoch`` (jumps back so far), ``held`` (the time wasn't accepted when it came) and ``confirmed`` (0, or how the next
    timed packet confirmed it: ``FORWARD`` or ``BACKWARD``).

    Packets before the first time have that time's clock, and without any time the clock is 0. Indexes are unique."""
    names = packets.columns
    table = _unbroken(packets, order, ts, span, F.coalesce(F.abs(F.col(ts) - F.col("before")) > tolerance, F.lit(False)).alias("__far"))
    seen = table.agg(F.bool_or("__far").alias("far"), F.count_if(F.col("clock").isNull()).alias("untimed")).first()
    if not seen["far"]:
        table = table.drop("__far")
        return table if not seen["untimed"] else table.withColumn("clock", F.coalesce("clock", _first_clock(table, order), F.lit(0)))
    rows = table.select(F.floor(F.col(order) / span).alias("range"), F.col(order).alias("packet_index"), F.col(ts).alias("at"), F.struct(*names).alias("row"))
    out = stepped_rows(rows, step_all, tolerance)
    discard(table)
    return out.withColumn("clock", F.coalesce("clock", _first_clock(out, order), F.lit(0)))


def stepped_rows(rows: DataFrame, machine, limit: int) -> DataFrame:
    """The columns of ``row`` of the written table ``rows`` (range, packet_index, at, row) with ``clock``, ``epoch``, ``held`` and ``confirmed``, as a written table."""
    exits = range_states(rows, machine, limit)
    cut = _before(exits).withColumn("__block", F.floor(F.col("range") / 4096)).withColumn("__all", F.lit(0))
    # jumps back before each range, and the range before it that has a time
    timed = F.when(F.col("first_step").isNotNull(), F.col("range"))
    cut = carry(cut, ["__all"], "__block", __resets=(F.sum, F.col("resets")), __timed=(F.max, timed))
    earlier = Window.partitionBy("__block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    epoch = F.coalesce("__resets", F.lit(0)) + F.coalesce(F.sum("resets").over(earlier), F.lit(0))
    states = cut.select("range", F.col("at_now").alias("in_now"), F.col("at_candidate").alias("in_candidate"), epoch.alias("in_epoch"), "first_step", F.coalesce(F.max(timed).over(earlier), "__timed").alias("__timed"))
    states = materialize(states, "clock-states")
    # a range whose first time confirms one held before it tells the range that holds it
    told = states.filter(F.col("first_step") >= FORWARD).select(F.col("__timed").alias("range"), F.col("first_step").alias("next_confirms"))
    entries = states.drop("first_step", "__timed").join(told, "range", "left").withColumn("next_confirms", F.coalesce("next_confirms", F.lit(0)))
    dealt = rows.join(entries, "range").repartition("range").sortWithinPartitions("range", "packet_index")
    kind = rows.schema["row"].dataType.simpleString()
    out = dealt.mapInArrow(_clocks(machine, limit), f"row {kind}, clock bigint, epoch bigint, held boolean, confirmed tinyint").select("row.*", "clock", "epoch", "held", "confirmed")
    out = materialize(out, "clocked")
    discard(exits, states)
    return out


def clock_summary(table: DataFrame, order: str = "packet_index", ts: str = "ts_ns") -> DataFrame:
    """``timestamp_outliers`` and ``clock_jumps`` of a ``clocked`` table: held times that nothing confirmed, and those that were."""
    return table.agg(F.count_if(F.col("held") & (F.col("confirmed") == 0)).alias("timestamp_outliers"), F.count_if(F.col("confirmed") > 0).alias("clock_jumps"))


def rule_clock(rows: DataFrame, ts: str, order: str, width: int, span: int = RANGE) -> DataFrame:
    """A rule's rows in ``order`` with ``epoch`` and ``evaluated``, as a written table: the clock goes forward to the lower of the last two times, so one wrong
    time can't move it; a time over ``width`` past it isn't evaluated. Two times over ``width`` behind it set it back and begin a new epoch, to
    which the first of the two belongs. Times must not be null.

    Where no two times are that far behind, the clock is a running maximum by ranges; else ranges are stepped as ``clocked`` steps them."""
    names = rows.columns
    written = materialize(rows, "rule-rows")
    timed = confirmed_clock(written.withColumn("__all", F.lit(0)), ["__all"], ts, order, span, "__earlier")
    back = F.coalesce(F.greatest(ts, "__earlier") + width < F.col("clock"), F.lit(False))
    clock = materialize(timed.select(*names, (F.col(ts) <= F.col("clock") + width).alias("evaluated"), back.alias("__back")), "rule-clock")
    discard(written)
    if clock.filter("__back").isEmpty():
        return clock.select(*names, F.lit(0).cast("bigint").alias("epoch"), "evaluated")
    whole = clock.select(F.floor(F.col(order) / span).alias("range"), F.col(order).alias("packet_index"), F.col(ts).alias("at"), F.struct(*names).alias("row"))
    out = stepped_rows(whole, confirm_all, width)
    # the row before a reset announced it and belongs to the new epoch, if within the width
    cut = out.withColumn("__part", F.floor(F.col(order) / span)).withColumn("__all", F.lit(0)).withColumn("__range", -F.col("__part"))
    first = F.struct((-F.col(order)).alias("i"), F.col("epoch").alias("e"), F.col(ts).alias("t"))
    cut = carry(cut, ["__all"], "__range", __next=(F.max, first))
    after = F.coalesce(F.lead(F.struct(F.lit(0).cast("bigint").alias("i"), F.col("epoch").alias("e"), F.col(ts).alias("t"))).over(Window.partitionBy("__part").orderBy(order)), "__next")
    cut = cut.withColumn("__after", after)
    announced = F.coalesce((F.col("__after.e") > F.col("epoch")) & (F.col(ts) + width >= F.greatest(F.col(ts), F.col("__after.t"))), F.lit(False))
    late = F.col(ts) > F.col("clock") + width
    return materialize(cut.select(*names, F.when(announced, F.col("__after.e")).otherwise(F.col("epoch")).alias("epoch"), (announced | ~late).alias("evaluated")), "rule-clock")
