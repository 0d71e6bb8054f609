"""The capture's clock and flow starts against plain walks, over one range and over many."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import clock, flows
from tests.test_flows import BASE, SCHEMA, S, packet

DAY = 86_400


def walked(times, tolerance):
    """(clock, epoch, held, confirmed) of every packet, one after the other."""
    now = candidate = None
    out, epoch, holder = [], 0, None
    for k, t in enumerate(times):
        held = False
        if t is None:
            pass
        elif now is None:
            now = t
        elif abs(t - now) <= tolerance:
            candidate, now = None, max(now, t)
        elif candidate is not None and abs(candidate - t) <= tolerance:
            later = max(candidate, t)
            out[holder][3] = clock.BACKWARD if later < now else clock.FORWARD
            epoch, now, candidate = epoch + (later < now), later, None
        else:
            candidate, holder, held = t, k, True
        out.append([now, epoch, held, 0])
    first = next((o[0] for o in out if o[0] is not None), 0)
    return [(first if o[0] is None else o[0], *o[1:]) for o in out]


@pytest.mark.parametrize("seed", range(3))
def test_clock_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    times, base = [], 0
    for _ in range(rng.choice([3, 60, 150])):
        base += rng.choice([0, 1, 3, 30 if seed % 2 else 2])
        times.append(None if rng.random() < 0.1 else base + (rng.choice([-100, 1000, 12, -12, 50]) if rng.random() < 0.25 else 0))
        base += rng.choice([-200, 300]) if rng.random() < 0.05 else 0
    # an index may be left out, and whole ranges with it
    rows = spark.createDataFrame([(i + (40 if i > 30 else 0), t) for i, t in enumerate(times)], "packet_index bigint, ts_ns bigint")
    for span in (4, 1 << 18):
        got = clock.clocked(rows, 10, span=span).orderBy("packet_index").select("clock", "epoch", "held", "confirmed").collect()
        assert [tuple(r) for r in got] == walked(times, 10), span
    assert clock.clocked(rows.filter("false"), 10).count() == 0
    untimed = clock.clocked(rows.withColumn("ts_ns", F.lit(None).cast("bigint")), 10)
    assert {r["clock"] for r in untimed.collect()} == {0}


A, B, C, X = (10, 1), (11, 2), (12, 3), (13, 9)


def udp(i, at, src, dst):
    return packet(i, at if at is not None else 0, src, dst, 17)[:1] + (None if at is None else BASE + round(at * S),) + packet(i, 0, src, dst, 17)[2:]


def built(spark, steps, span=1 << 18):
    rows = [udp(i + 1, *s) for i, s in enumerate(steps)]
    table = clock.clocked(spark.createDataFrame(rows, SCHEMA), span=span)
    flowed = flows.flows_of(table, span=span)
    done = flows.end_reasons(flows.flow_records(flowed), flows.tcp_summary(flowed).select("first_packet", "tcp_state"), flows.epoch_ends(table))
    return [(r["packets_total"], r["end_reason"], r["timestamp_outliers"]) for r in done.orderBy("first_packet").collect()], tuple(clock.clock_summary(table).first())


@pytest.mark.parametrize("span", [2])
def test_doubted_times_and_jumps(spark, span):
    """One wrong time changes nothing; two that agree move the clock, forward or back; what was held is counted when it's confirmed."""
    lone = [(0, A, B), (0.01, C, B), (3e9, A, B), (0.02, A, B), (120, A, B)]
    assert built(spark, lone, span) == ([(3, "idle_timeout", 1), (1, "idle_timeout", 0), (1, "capture_end", 0)], (1, 0))
    first_wrong = [(None, A, B), (3e9, C, X), (0, A, B), (0.01, A, B), (100, A, B)]
    assert built(spark, first_wrong, span) == ([(2, "clock_reset", 0), (1, "clock_reset", 0), (1, "idle_timeout", 0), (1, "capture_end", 0)], (0, 1))
    gap = [(0, A, B), (0.005, B, A), (2 * DAY, C, X), (2 * DAY + 0.005, X, C)]
    assert built(spark, gap, span) == ([(2, "idle_timeout", 0), (2, "capture_end", 0)], (0, 1))
    sparse = [(0, A, B), (1000, A, B), (2000, A, B)]
    assert built(spark, sparse, span) == ([(1, "idle_timeout", 0)] * 2 + [(1, "capture_end", 0)], (0, 0))
    skewed = [x for i in range(10) for x in ((200 + i, A, B), (80 + i, B, A))]
    assert built(spark, skewed, span)[0] == [(20, "capture_end", 0)]
    back = [(400 * DAY, (10, p), X) for p in range(20)] + [x for i in range(1, 8) for x in (((400 - 2 * i) * DAY, (10, 1), X), ((400 - 2 * i) * DAY + 0.001, (10, 1), X))]
    found, summary = built(spark, back, span)
    assert summary == (0, 7) and sum(end == "clock_reset" for _, end, _ in found) == 20 + 6


def plain_flows(rows, idle, linger):
    """The first packet of each packet's flow, by a walk over the packets of every key."""
    open_, out = {}, {}
    for i, ts, _, _, sb, db, sp, dp, protocol, flags, *_ in rows:
        ends = ((len(sb), sb, sp or 0), (len(db), db, dp or 0))
        key = (protocol, min(ends), max(ends))
        state = open_.get(key)
        opening = flags is not None and flags & 18 == 2
        if state is not None:
            first, last, tracked, fins, reset = state
            done = tracked and (reset or len(fins) == 2)
            if ts - last > (linger if done else idle) or (done and opening):
                state = None
        if state is None:
            state = (i, ts, flags is not None, frozenset(), False)
        first, _, tracked, fins, reset = state
        if tracked and flags is not None:
            reset = reset or bool(flags & 4)
            fins = fins | {ends[0] <= ends[1]} if flags & 1 else fins
        open_[key] = (first, ts, tracked, fins, reset)
        out[i] = first
    return out


@pytest.mark.parametrize("seed", range(2))
def test_flow_starts_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    ends, rows, at = [(10, 5000), (80, 443), (81, 443)], [], 0.0
    for i in range(400):
        at += rng.choice([0.1, 1, 11, 301] if i % 50 > 5 else [0.1])
        src, dst = rng.sample(ends[: 2 + seed % 2], 2)
        rows.append(packet(i + 1, at, src, dst, 6, rng.choice([2, 16, 17, 4, 18, 16, 17, None]), 0, 1))
    wanted = plain_flows(rows, 300 * S, 10 * S)
    packets = spark.createDataFrame(rows, SCHEMA)
    for span in (3, 1 << 18):
        got = {r["packet_index"]: r["first_packet"] for r in flows.flows_of(packets, span=span).select("packet_index", "first_packet").collect()}
        assert got == wanted, span


def rule_walk(times, width):
    previous = now = None
    out, epoch = [], 0
    for k, t in enumerate(times):
        if previous is not None:
            low, high = min(previous, t), max(previous, t)
            if now is None or low > now:
                now = low
            elif high + width < now:
                epoch, now = epoch + 1, high
                if previous + width >= high:
                    out[k - 1] = (epoch, True)
        previous = t
        out.append((epoch, now is None or t <= now + width))
    return out


@pytest.mark.parametrize("seed", range(1, 3))
def test_rule_clock_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    times, base = [], 1000
    for _ in range(80):
        base += rng.choice([0, 1, 4, 15])
        base -= rng.choice([0] * 12 + [300 * (seed > 0)])
        times.append(base + (rng.choice([-60, 500]) if rng.random() < 0.1 else 0))
    rows = spark.createDataFrame(list(enumerate(times)), "i bigint, t bigint")
    for span in (5, 1 << 18):
        got = clock.rule_clock(rows, "t", "i", 10, span=span).orderBy("i").select("epoch", "evaluated").collect()
        assert [tuple(r) for r in got] == rule_walk(times, 10), span


def test_flow_queries_read_their_input_once_or_twice(spark):
    from netloom.plans import catalog, flow_queries  # noqa: F401

    for name in ("w5_w6_flow_of_packets", "w7_w9_directions", "w12_w14_arrivals", "w17_duplicate_segments", "w22_end_reasons", "w24_retention", "w27_peak_active", "w28_flow_sorts"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert 1 <= plan.count("FileScan parquet") <= (3 if name.startswith("w5") else 8), name


def test_a_hot_key_is_shortlisted_in_parts(spark):
    from netloom.operators import windows

    rows = spark.range(3000).selectExpr("IF(id < 2900, 'hot', CAST(id % 7 AS STRING)) AS k", "id", "(id * 7919) % 3001 AS t")
    got = sorted((r["k"], r["place"], r["id"]) for r in windows.shortlist(rows, ["k"], ["t", "id"], 50, "id").collect())
    each = {}
    for r in rows.collect():
        each.setdefault(r["k"], []).append((r["t"], r["id"]))
    assert got == sorted((k, n, i) for k, v in each.items() for n, (_, i) in enumerate(sorted(v)[:50], 1))
