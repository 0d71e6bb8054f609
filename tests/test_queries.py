"""Every query of the catalog equals its SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__
from netloom.operators import clock, flows, rules
from netloom.plans import catalog, flow_queries
from netloom.sources import views

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages documents".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return value


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = catalog.QUERIES[name](spark, SMALL)
    wanted = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(plain(r[c]) for c in names) for r in got.collect()) == Counter(tuple(map(plain, r)) for r in wanted.fetchall())


def test_entry_has_columns(spark):
    assert __spark_entry__.entry(spark).columns == ["flow_id", "initiator", "responder", "bytes_out", "state"]


def test_every_query_without_sql_runs(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL):
        assert catalog.QUERIES[name](spark, SMALL).count() > 0, name


def test_names_are_split(spark):
    names = spark.createDataFrame([("A.b.Example.com.",), ("example.com",), ("",), (None,)], "name string")
    parent, rest = rules.split_name(names["name"])
    assert [tuple(r) for r in names.select(parent, rest).collect()] == [("example.com", "a.b"), (None, None), (None, None), (None, None)]


def test_flow_numbers_run_over_ranges(spark):
    rows = spark.createDataFrame([(i * 7,) for i in range(100)], "p bigint")
    assert sorted(r["flow_number"] for r in rules.flow_numbers(rows, "p", "__r", span=20).collect()) == list(range(1, 101))


@pytest.mark.parametrize("name", ["w5_w6_flow_of_packets", "w22_end_reasons", "d2_d9_decoded_frames", "u6_table_of_networks"])
def test_users_beyond_16_bits_have_addresses_of_their_own(spark, tmp_path, name):
    con = duckdb.connect()
    # every user again with numbers that end in the same 16 bits; the copies' packets come between the first ones
    con.execute(f"COPY (SELECT event_id * 3 + c AS event_id, ts, user_id + 65536 * 7 * c AS user_id, event_type, value, props FROM '{SMALL}/events.parquet', range(3) r(c)) TO '{tmp_path}/events.parquet'")
    con.execute(f"COPY (SELECT * FROM '{SMALL}/supplier.parquet') TO '{tmp_path}/supplier.parquet'")
    for table in ("events", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    wanted = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*names)
    assert Counter(map(tuple, got.collect())) == Counter(wanted.fetchall())


def test_failed_flows_with_one_number_count_as_in_sql(spark, tmp_path):
    con = duckdb.connect()
    # one client with 200 failed lines, every second number twice
    con.execute(f"COPY (SELECT CAST(i // 2 * 2 AS BIGINT) AS l_orderkey, CAST(7 AS BIGINT) AS l_partkey, CAST(3 AS BIGINT) AS l_suppkey, 1 AS l_linenumber, 5.0 AS l_quantity, 10.0 AS l_extendedprice, 0.0 AS l_discount, 0.0 AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * CAST(i // 2 AS INTEGER) AS l_shipdate FROM range(200) r(i)) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"COPY (SELECT i AS o_orderkey, CAST(23 AS BIGINT) AS o_custkey FROM range(200) r(i)) TO '{tmp_path}/orders.parquet'")
    for table in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    wanted = con.execute(catalog.ORACLE_SQL["r4_tcp_fail"])
    names = [d[0] for d in wanted.description]
    got = catalog.QUERIES["r4_tcp_fail"](spark, str(tmp_path)).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())


OVER_FLOWS = ["w5_w6_flow_of_packets", "w7_w9_directions", "w15_w16_tcp_state", "w17_duplicate_segments", "w18_first_names", "w18_lists_of_flows", "w22_end_reasons", "w27_peak_active", "w28_flow_sorts"]


@pytest.mark.parametrize("name", OVER_FLOWS)
def test_times_that_begin_again_leave_the_flows_of_the_sql(spark, tmp_path, name):
    con = duckdb.connect()
    # all events once more after the last one, with other users and the same times, 30 days behind the clock
    con.execute(f"COPY (SELECT event_id + c * (SELECT max(event_id) + 1 FROM '{SMALL}/events.parquet') AS event_id, ts, user_id + 1500 * c AS user_id, event_type, value, props FROM '{SMALL}/events.parquet', range(2) r(c)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    wanted = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*names)
    assert Counter(map(tuple, got.collect())) == Counter(wanted.fetchall())


def test_keys_of_few_packets_are_walked_whole(spark, monkeypatch):
    wire = views.wire(spark, SMALL)
    wanted = flows.flows_of(wire, flow_queries.TCP_IDLE, flow_queries.OTHER_IDLE, flow_queries.LINGER).select("packet_index", "first_packet").collect()

    def never(idle):
        raise AssertionError("a key of few packets was cut")

    monkeypatch.setattr(flows, "exits", never)
    # 10,000 indexes in parts of 1,000, and no key with as many packets
    got = flows.flows_of(wire, flow_queries.TCP_IDLE, flow_queries.OTHER_IDLE, flow_queries.LINGER, span=1000).select("packet_index", "first_packet").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, wanted))


def test_a_range_is_not_put_together_with_its_rows():
    batch = lambda at: pa.RecordBatch.from_pydict({"range": [0] * 3, "at": at, "row": [{"x": a} for a in at], "in_now": [None] * 3, "in_candidate": [None] * 3, "in_epoch": [0] * 3, "next_confirms": [0] * 3})
    out = list(clock._clocks(clock.step_all, 10)(iter([batch([1, 2, 3]), batch([500, 5, 4])])))
    assert [b.num_rows for b in out] == [3, 3]
    assert [x for b in out for x in b.column("clock").to_pylist()] == [1, 2, 3, 3, 5, 5]
    assert [x for b in out for x in b.column("held").to_pylist()] == [False, False, False, True, False, False]
