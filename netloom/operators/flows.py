"""Flow reconstruction: idle-gap sessions, flows of a bidirectional key, their records, and names as of their start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.stored import discard, materialize

from .clock import FORWARD, RANGE, TOLERANCE, clocked, ranged_maximum
from .flow_starts import ACK, BASES, ENTRY, ENTRY_SCHEMA, EXIT_SCHEMA, FIN, RST, SYN, Idle, entries, exits, starts
from .ranges import SPAN, carry
from .windows import shortlist

SECOND = 1_000_000_000
# Idle times that end a flow, by what it is.
TCP_IDLE, OTHER_IDLE, FINISHED_LINGER = 300 * SECOND, 60 * SECOND, 10 * SECOND


def with_clock(packets: DataFrame, order: str = "packet_index", ts: str = "ts_ns", span: int = RANGE) -> DataFrame:
    """Add ``clock``, the running maximum of ``ts`` in ``order``; ``clock.clocked`` is the same but for times that are far off."""
    return ranged_maximum(packets, order, ts, span).withColumn("clock", F.greatest(ts, "before")).drop("before")


def sessionize(packets: DataFrame, key: list[str], timeout: Column | int, order: str = "packet_index", span: int = SPAN, name: str = "session") -> DataFrame:
    """Add ``session``, numbered from 0 per key: a new one begins where the clock is over ``timeout`` past its last.

    Keys are cut into ranges of ``span`` indexes. A range is a row of its first and last clock and the sessions that begin within
    it; those rows give each range the number of its first session."""
    cut = packets.withColumn("__part", F.floor(F.col(order) / span)).withColumn("__limit", timeout if isinstance(timeout, Column) else F.lit(timeout))
    w = Window.partitionBy(*key, "__part").orderBy(order)
    cut = cut.withColumn("__new", F.coalesce((F.col("clock") - F.lag("clock").over(w) > F.col("__limit")).cast("int"), F.lit(0)))
    ends = cut.groupBy(*key, "__part").agg(F.min("clock").alias("__first"), F.max("clock").alias("__last"), F.sum("__new").alias("__n"), F.first("__limit").alias("__limit"))
    v = Window.partitionBy(*key).orderBy("__part")
    ends = ends.withColumn("__begins", F.coalesce((F.col("__first") - F.lag("__last").over(v) > F.col("__limit")).cast("int"), F.lit(0)))
    first = F.sum(F.col("__begins") + F.col("__n")).over(v.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    numbered = cut.join(ends.select(*key, "__part", first.alias("__before")), [*key, "__part"])
    return numbered.withColumn(name, F.col("__before") + F.sum("__new").over(w)).drop("__new", "__part", "__limit", "__before")


def session_statistics(sessions: DataFrame, key: list[str], ts: str = "ts_ns", size: str = "original_length", span: int = SPAN) -> DataFrame:
    """Packets, bytes, sizes, inter-arrival gaps and late packets of each session.

    A gap runs from the greatest earlier time of the session and is 0 for a late packet; the first packet has none."""
    by = [*key, "session"]
    cut = carry(sessions.withColumn("__part", F.floor(F.col("packet_index") / span)), by, "__part", __top=(F.max, F.col(ts)))
    before = F.max(ts).over(Window.partitionBy(*by, "__part").orderBy("packet_index").rowsBetween(Window.unboundedPreceding, -1))
    gaps = cut.withColumn("__before", F.greatest(before, "__top")).withColumn("__gap", F.when(F.col("__before").isNotNull(), F.greatest(F.col(ts) - F.col("__before"), F.lit(0))))
    return gaps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum(size).alias("bytes"),
        F.min(size).alias("size_min"),
        F.max(size).alias("size_max"),
        F.avg(size).alias("size_mean"),
        F.stddev_pop(size).alias("size_stddev"),
        F.min("__gap").alias("gap_min"),
        F.max("__gap").alias("gap_max"),
        F.avg("__gap").alias("gap_mean"),
        F.stddev_pop("__gap").alias("gap_stddev"),
        F.count_if(F.col(ts) < F.col("__before")).alias("late"),
        F.min("packet_index").alias("first_packet"),
        ((F.max(ts) - F.min(ts)) / 1e9).alias("duration_s"),
    )


def dominant_side(sent: Column, received: Column) -> Column:
    """The side with over 55 % of the bytes; integers alone."""
    total = sent + received
    return F.when(sent * 100 > total * 55, "initiator").when(received * 100 > total * 55, "responder").otherwise("balanced")


def latest_before(events: DataFrame, facts: DataFrame, key: str, at: str, fact_at: str, value: str, span: int = 1 << 44) -> DataFrame:
    """As-of join: each event with the value of the last fact of its key at or before it, by one sorted pass.

    Keys are cut into ranges of ``span`` of the time (about five hours of nanoseconds), which hand on their last fact."""
    marked = events.withColumn("__value", F.lit(None).cast(facts.schema[value].dataType)).withColumn("__at", F.col(at)).withColumn("__fact", F.lit(1))
    told = facts.select(F.col(key), F.col(value).alias("__value"), F.col(fact_at).alias("__at"), F.lit(0).alias("__fact"))
    both = marked.unionByName(told, allowMissingColumns=True).withColumn("__part", F.expr(f"__at DIV {span}"))
    fact = F.when(F.col("__value").isNotNull(), F.struct("__at", "__value"))
    both = carry(both, [key], "__part", __handed=(F.max, fact))
    last = F.last("__value", ignorenulls=True).over(Window.partitionBy(key, "__part").orderBy("__at", "__fact").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, F.coalesce(last, "__handed.__value")).filter("__fact = 1").drop("__value", "__at", "__fact", "__part", "__handed")


# --- flows of a bidirectional key ------------------------------------------------------------------------------


def observed(packets: DataFrame) -> DataFrame:
    """Packets with an address, with the endpoints ``a`` and ``b`` of their key, lower one first, and ``from_a``.

    An endpoint is (family, address bytes, port), so IPv4 comes before IPv6; without a transport header ports are 0."""
    end = lambda side: F.struct(F.octet_length(f"{side}_bin").alias("family"), F.col(f"{side}_bin").alias("bin"), F.coalesce(f"{side}_port", F.lit(0)).alias("port"), F.col(f"{side}_ip").alias("ip"))
    seen = packets.filter("src_bin IS NOT NULL AND dst_bin IS NOT NULL").withColumns({"src": end("src"), "dst": end("dst")})
    seen = seen.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst"), "from_a": F.col("src") <= F.col("dst")})
    return seen.withColumn("has_tcp", F.coalesce((F.col("protocol") == 6) & F.col("tcp_flags").isNotNull(), F.lit(False)))


#: Packets of a key that are walked at once at most; a key with more is cut into parts of as many packet indexes.
PART = 1 << 16


def flows_of(packets: DataFrame, tcp_idle: int = TCP_IDLE, other_idle: int = OTHER_IDLE, linger: int = FINISHED_LINGER, span: int = PART, tolerance: int = TOLERANCE) -> DataFrame:
    """Each packet with its flow: ``first_packet`` (the index of its flow's first packet, which names the flow), ``initiator``,
    ``basis`` and ``forward``; and with the clock's columns (packets that have them already are ``clock.clocked``) and ``valid_ns``, the time if it counts.

    A flow ends after its protocol's idle time; if it is finished, after ``linger`` or at a SYN without ACK; and at a jump back of the clock.
    A held time that a jump forward confirms is its flow's last. Packets without an address are left out, and indexes are unique.
    A key of over ``span`` packets is walked by parts of ``span`` indexes (``flow_starts``), so a key with all packets is many tasks."""
    idle = Idle(tcp_idle, other_idle, linger)
    table = packets if "clock" in packets.columns else clocked(packets, tolerance)
    seen = observed(table).withColumn("valid_ns", F.when(~F.col("held") | (F.col("confirmed") > 0), F.col("ts_ns")))
    key = F.concat_ws("|", "epoch", "protocol", F.hex("a.bin"), "a.port", F.hex("b.bin"), "b.port")
    reached = F.greatest("clock", F.when(F.col("confirmed") == FORWARD, F.col("ts_ns")))
    flags = F.when(F.col("has_tcp"), F.col("tcp_flags")).cast("int")
    rows = seen.select(F.encode(key, "utf-8").alias("key"), "packet_index", F.col("protocol").cast("int").alias("protocol"), "clock", reached.alias("reached"), "from_a", flags.alias("flags"), F.struct("*").alias("row"))
    # keys of over span packets are one for each span packets at most, so they can be sent to every task
    long = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > span).select("key", F.lit(True).alias("long")), "flow-long-keys")
    if long.isEmpty():
        discard(long)
        dealt = rows.withColumns({"part": F.lit(0).cast("bigint")} | {f"in_{c}": F.lit(0).cast("bigint") for c in ENTRY})
    else:
        part = F.when(F.col("long"), F.floor(F.col("packet_index") / span)).otherwise(F.lit(-1))
        rows = rows.join(F.broadcast(long), "key", "left").withColumn("part", part)
        walked = rows.filter("long").drop("row", "long")
        left = walked.repartition("key", "part").sortWithinPartitions("key", "part", "packet_index").mapInArrow(exits(idle), EXIT_SCHEMA)
        entered = materialize(left.repartition("key").sortWithinPartitions("key", "part").mapInArrow(entries(idle), ENTRY_SCHEMA), "flow-entries")
        dealt = rows.drop("long").join(entered, ["key", "part"], "left")
    row = rows.schema["row"].dataType.simpleString()
    out = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "packet_index").mapInArrow(starts(idle), f"row {row}, first_packet bigint, a_began boolean, basis int")
    out = out.select("row.*", "first_packet", "a_began", F.element_at(F.array(*map(F.lit, BASES)), F.col("basis") + 1).alias("basis"))
    return out.withColumns({"initiator": F.when(F.col("a_began"), F.col("a")).otherwise(F.col("b")), "forward": F.col("from_a") == F.col("a_began")}).drop("a_began")


def arrival_gaps(flowed: DataFrame, span: int = SPAN) -> DataFrame:
    """Add ``earlier_ns``, the greatest earlier time of the flow that counts, and ``gap_s`` from it, 0 for a packet out of order; null
    for the first, and for a time that was held when it came. ``out_of_order`` says that it lies before ``earlier_ns``."""
    cut = carry(flowed.withColumn("__part", F.floor(F.col("packet_index") / span)), ["first_packet"], "__part", __top=(F.max, F.col("valid_ns")))
    before = F.max("valid_ns").over(Window.partitionBy("first_packet", "__part").orderBy("packet_index").rowsBetween(Window.unboundedPreceding, -1))
    out = cut.withColumn("earlier_ns", F.greatest(before, "__top"))
    counts = F.col("earlier_ns").isNotNull() & ~F.col("held")
    gap = F.when(counts, F.greatest(F.col("ts_ns") - F.col("earlier_ns"), F.lit(0)) / 1e9)
    return out.withColumns({"gap_s": gap, "out_of_order": F.coalesce(counts & (F.col("ts_ns") < F.col("earlier_ns")), F.lit(False))}).drop("__part", "__top")


def repeated_segments(flowed: DataFrame, span: int = SPAN) -> DataFrame:
    """``first_packet, duplicates``: segments with payload, SYN or FIN that equal the one before in their direction, in flags,
    sequence number and length."""
    own = ["first_packet", "forward"]
    segments = flowed.filter("has_tcp").filter((F.col("payload_length") > 0) | (F.col("tcp_flags").bitwiseAND(SYN | FIN) != 0)).withColumn("__part", F.floor(F.col("packet_index") / span))
    view = F.struct("tcp_flags", "seq", "payload_length")
    segments = carry(segments, own, "__part", __handed=(F.max, F.struct("packet_index", view.alias("view"))))
    before = F.coalesce(F.lag(view).over(Window.partitionBy(*own, "__part").orderBy("packet_index")), "__handed.view")
    return segments.withColumn("again", before == view).groupBy("first_packet").agg(F.count_if("again").alias("duplicates"))


def first_values(flowed: DataFrame, value: Column, limit: int = 4) -> DataFrame:
    """``first_packet, values``: the flow's first ``limit`` distinct values in order of arrival, joined by commas.

    Equal values of a flow are one row before any of them are put side by side."""
    each = flowed.select("first_packet", "packet_index", value.alias("value")).filter("value IS NOT NULL").groupBy("first_packet", "value").agg(F.min("packet_index").alias("at"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("first_packet").orderBy("at", "value"))).filter(F.col("rank") <= limit)
    return ranked.groupBy("first_packet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), ",").alias("values"))


#: Sizes of a flow from which the median of ``w11_median_of_flows`` is taken, as its SQL says.
MEDIAN_OF = 256


def size_medians(flowed: DataFrame, limit: int | None = None) -> DataFrame:
    """``first_packet, size_median, exact``: the median of all sizes of the flow; with ``limit`` of its first ``limit`` sizes, exact if it has no more.

    Equal sizes of a flow are counted in each task before they meet, and first ones are chosen in parts of a flow, so that a flow with most
    packets isn't put in order as a whole."""
    if limit is None:
        return flowed.groupBy("first_packet").agg(F.median("original_length").alias("size_median"), F.lit(True).alias("exact"))
    few = shortlist(flowed.select("first_packet", "packet_index", "original_length"), ["first_packet"], ["packet_index"], limit, "packet_index")
    medians = few.groupBy("first_packet").agg(F.median("original_length").alias("size_median"))
    counts = flowed.groupBy("first_packet").agg((F.count(F.lit(1)) <= limit).alias("exact"))
    return medians.join(counts, "first_packet")


def first_lists(flowed: DataFrame, values: dict[str, Column], limit: int = 4) -> DataFrame:
    """``first_packet`` and for each name the flow's first ``limit`` distinct values in order of arrival, as arrays; empty where there are none.

    All lists are made of one pass: a value is a row of its list's name before equal ones are merged."""
    tagged = F.array(*[F.struct(F.lit(k).alias("list"), v.alias("value")) for k, v in values.items()])
    each = flowed.select("first_packet", "packet_index", F.explode(tagged).alias("x")).filter("x.value IS NOT NULL")
    once = each.groupBy("first_packet", F.col("x.list").alias("list"), F.col("x.value").alias("value")).agg(F.min("packet_index").alias("at"))
    few = shortlist(once, ["first_packet", "list"], ["at", "value"], limit, "value")
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == k, F.struct("place", "value")))), lambda x: x["value"]).alias(k)
    return few.groupBy("first_packet").agg(*[of(k) for k in values])


def tcp_summary(flowed: DataFrame) -> DataFrame:
    """``first_packet`` and the flow's TCP state, flags of both sides and counts; only flows whose first packet has a TCP header.

    The state is closed over the whole flow: a reset wins, then FINs; else the handshake as far as it came in order."""
    flag = lambda mask: F.col("tcp_flags").bitwiseAND(mask) != 0
    when = lambda cond: F.when(cond, F.col("packet_index"))
    tcp = flowed.filter("has_tcp")
    first = F.col("packet_index") == F.col("first_packet")
    agree, plain = flag(SYN) & flag(ACK), flag(ACK) & ~flag(SYN)
    seen = tcp.groupBy("first_packet").agg(
        F.max(F.when(first, F.col("tcp_flags"))).alias("opening"),
        F.bool_or(flag(RST)).alias("reset"),
        F.bool_or(flag(FIN) & F.col("forward")).alias("fin_forward"),
        F.bool_or(flag(FIN) & ~F.col("forward")).alias("fin_back"),
        F.min(when(agree & ~first)).alias("agreed"),
        F.max(when(plain)).alias("acked"),
        F.coalesce(F.bit_or(F.when(F.col("forward"), F.col("tcp_flags"))), F.lit(0)).alias("flags_initiator"),
        F.coalesce(F.bit_or(F.when(~F.col("forward"), F.col("tcp_flags"))), F.lit(0)).alias("flags_responder"),
        F.count_if(flag(SYN)).alias("syn"),
        F.count_if(flag(FIN)).alias("fin"),
        F.count_if(flag(RST)).alias("rst"),
    )
    opening = F.col("opening").bitwiseAND(SYN | ACK)
    handshake = (
        F.when((opening == SYN) & F.col("agreed").isNull(), "syn_sent")
        .when(opening == SYN, F.when(F.col("acked") > F.col("agreed"), "established").otherwise("syn_received"))
        .when(opening == SYN | ACK, F.when(F.col("acked") > F.col("first_packet"), "established").otherwise("syn_received"))
        .otherwise("midstream")
    )
    state = F.when(F.col("reset"), "reset").when(F.col("fin_forward") & F.col("fin_back"), "closed").when(F.col("fin_forward") | F.col("fin_back"), "closing").otherwise(handshake)
    return seen.filter("opening IS NOT NULL").select("first_packet", state.alias("tcp_state"), "flags_initiator", "flags_responder", "syn", "fin", "rst")


def flow_records(flowed: DataFrame) -> DataFrame:
    """One row per flow: endpoints, counters of both directions, sizes, times, warnings and the dominant side."""
    side = lambda x, forward: F.coalesce(F.sum(F.when(F.col("forward") == forward, x)), F.lit(0)).cast("bigint")
    one = F.lit(1)
    records = flowed.groupBy("first_packet").agg(
        F.first("protocol").alias("protocol"),
        F.first("initiator").alias("initiator"),
        F.first(F.when(F.col("a") == F.col("initiator"), F.col("b")).otherwise(F.col("a"))).alias("responder"),
        F.first("basis").alias("basis"),
        F.first(F.struct("epoch", "protocol", "a", "b")).alias("flow_key"),
        F.first("epoch").alias("epoch"),
        F.min("valid_ns").alias("first_seen_ns"),
        F.max("valid_ns").alias("last_seen_ns"),
        F.max(F.greatest("clock", F.when(F.col("confirmed") == FORWARD, F.col("ts_ns")))).alias("last_clock"),
        F.count(one).alias("packets_total"),
        F.sum("original_length").cast("bigint").alias("bytes_total"),
        side(one, True).alias("packets_initiator"),
        side(one, False).alias("packets_responder"),
        side(F.col("original_length"), True).alias("bytes_initiator"),
        side(F.col("original_length"), False).alias("bytes_responder"),
        side(F.col("payload_length"), True).alias("payload_initiator"),
        side(F.col("payload_length"), False).alias("payload_responder"),
        F.min("original_length").alias("size_min"),
        F.max("original_length").alias("size_max"),
        F.avg("original_length").alias("size_mean"),
        F.stddev_pop("original_length").alias("size_stddev"),
        F.count_if(F.col("ts_ns").isNull()).alias("missing_timestamp"),
        F.count_if(F.col("fragment")).alias("fragments"),
        F.count_if(F.col("protocol").isin(6, 17) & ~F.col("fragment") & F.col("src_port").isNull()).alias("missing_transport"),
        F.count_if(F.col("held") & (F.col("confirmed") == 0)).alias("timestamp_outliers"),
    )
    shown = records.withColumns({f"{end}_{x}": F.col(f"{end}.{x}") for end in ("initiator", "responder") for x in ("ip", "bin", "port")}).drop("initiator", "responder")
    duration = F.coalesce((F.col("last_seen_ns") - F.col("first_seen_ns")) / 1e9, F.lit(0.0))
    return shown.withColumns({"duration_s": duration, "dominant": dominant_side(F.col("bytes_initiator"), F.col("bytes_responder"))})


def epoch_ends(table: DataFrame) -> DataFrame:
    """``epoch, final_clock`` of a ``clocked`` table: as far as the clock came before it jumped back, or the capture ended."""
    return table.groupBy("epoch").agg(F.max("clock").alias("final_clock"))


def end_reasons(records: DataFrame, states: DataFrame, ends: DataFrame, tcp_idle: int = TCP_IDLE, other_idle: int = OTHER_IDLE, linger: int = FINISHED_LINGER) -> DataFrame:
    """Records with ``tcp_state`` and ``end_reason``: a flow ended if another one of its key follows or the clock passed its deadline;
    then it was finished or idle. What is left ends with its epoch. ``ends`` is ``epoch_ends``, a row for each jump back and one more."""
    joined = records.join(states, "first_packet", "left")
    finished = F.coalesce(F.col("tcp_state").isin("reset", "closed"), F.lit(False))
    idle = F.when(F.col("protocol") == 6, F.when(finished, linger).otherwise(tcp_idle)).otherwise(other_idle)
    # the last flow of each key is found again by its own number, so that no key's flows meet
    last = joined.groupBy("flow_key").agg(F.max("first_packet").alias("first_packet")).select("first_packet", F.lit(True).alias("__last_of_key"))
    if ends.limit(2).count() < 2:
        timed = joined.withColumns({"final_clock": ends.agg(F.max("final_clock")).scalar(), "__last_epoch": F.lit(True)})
    else:
        timed = joined.join(ends, "epoch").withColumn("__last_epoch", F.col("epoch") == ends.agg(F.max("epoch")).scalar())
    over = F.col("__last_of_key").isNull() | (F.col("final_clock") > F.col("last_clock") + idle)
    reason = F.when(~over, F.when(F.col("__last_epoch"), "capture_end").otherwise("clock_reset")).when(finished, "tcp_finished").otherwise("idle_timeout")
    return timed.join(last, "first_packet", "left").withColumn("end_reason", reason).drop("flow_key", "final_clock", "__last_epoch", "__last_of_key")


def peak_active(spans: DataFrame, begin: str, end: str, span: int = 1 << 44) -> DataFrame:
    """``peak``: the most rows of ``[begin, end]`` that cover one point, by running sums over ranges of ``span``."""
    steps = spans.select(F.col(begin).alias("at"), F.lit(1).alias("step")).union(spans.select((F.col(end) + 1).alias("at"), F.lit(-1).alias("step")))
    steps = steps.groupBy("at").agg(F.sum("step").alias("step")).withColumn("part", F.expr(f"at DIV {span}")).withColumn("all", F.lit(0))
    steps = carry(steps, ["all"], "part", before=(F.sum, F.col("step")))
    within = F.sum("step").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return steps.select((F.coalesce("before", F.lit(0)) + within).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("peak"))


def names_at_start(starts: DataFrame, answers: DataFrame, limit: int = 4) -> DataFrame:
    """``first_packet, names``: of flows ``(first_packet, responder_ip)`` the first ``limit`` names that answers ``(name, ip, at)``
    had given the responder's address by the flow's first packet.

    Only the first ``limit`` distinct names of an address can ever be among them, so each address has as many rows."""
    told = answers.groupBy("ip", "name").agg(F.min("at").alias("at"))
    few = told.withColumn("rank", F.row_number().over(Window.partitionBy("ip").orderBy("at", "name"))).filter(F.col("rank") <= limit)
    joined = starts.join(few, (F.col("ip") == F.col("responder_ip")) & (F.col("at") <= F.col("first_packet")))
    return joined.groupBy("first_packet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ",").alias("names"))
