"""Rules over flows read their input once or twice, and give the same rows however groups are cut."""

from netloom.operators import detect
from netloom.plans import alert_queries
from netloom.sources import views

SF = "/root/testdata/sf0.001"


def reads(df):
    """How often a plan reads the orders that name the flows' initiators."""
    return sum("Relation [o_orderkey" in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_rare_ports_leave_no_join_of_all_flows(spark):
    assert reads(views.host_flows(spark, SF)) == 1
    assert reads(alert_queries.r6_rare_ports(spark, SF)) == 0


def test_flows_with_alerts_read_stored_flows(spark):
    assert reads(alert_queries.u10_u11_flows_with_alerts(spark, SF)) == 0


def test_beacons_of_cut_groups(spark):
    columns = ["src", "dst", "protocol", "responder_port", "first_seen_ns", "last_seen_ns", "flow_id"]
    hosts = views.host_flows(spark, SF).selectExpr("src % 3 AS src", "dst % 2 AS dst", "protocol", "1 + responder_port % 5 AS responder_port", *columns[4:])
    whole = sorted(map(str, detect.beacons(hosts, 3, 10.0, 1.5).collect()))
    assert whole
    for held in (1, 80):
        assert sorted(map(str, detect.beacons(hosts, 3, 10.0, 1.5, held=held).collect())) == whole
