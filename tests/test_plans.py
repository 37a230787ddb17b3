"""Plans stay free of the shapes that do not survive a hundredfold of data."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import stock
from shelfwise.plans import reports
from shelfwise.plans.catalog import AS_OF, Catalog

ROOT = pathlib.Path(__file__).resolve().parent.parent
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def catalog(spark):
    return Catalog(spark, FOLDER)


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["reorder_recommendations", "lost_sales_imputation", "dead_stock", "transfer_intelligence",
                                  "churn_scores", "basket_rules", "accuracy_report", "residual_demand"])
def test_no_cartesian_product(catalog, name):
    assert "CartesianProduct" not in plan(catalog[name])


def test_scans_read_only_needed_columns(catalog):
    text = plan(catalog["sku_metrics"])
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    line = next(s for s in schemas if "l_partkey" in s)
    assert {c.split(":")[0] for c in line.split(",")} == {"l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"}


def test_date_filters_reach_the_scan(catalog):
    text = plan(catalog["sku_metrics"])
    assert re.search(r"(PushedFilters|DataFilters): \[[^\]]*o_orderdate", text)


def test_aggregates_start_on_the_map_side(catalog):
    assert plan(catalog["demand_quality"]).count("partial_count") >= 1


def test_imputation_aggregates_the_days_once(catalog):
    counted = catalog["lost_sales_imputation"].groupBy().count()
    counted.collect()
    assert "ReusedExchange" in counted._jdf.queryExecution().executedPlan().toString()


def test_snapshots_are_made_by_many_tasks(catalog):
    assert catalog["inventory"].select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_snapshots_are_reduced_by_hash(make):
    keys = "sku_id string, location_id string, "
    snaps = make(keys + "snapshot_date date, qty_on_hand double, reorder_point double, unit_cost double", [])
    master = make("sku_id string, abc_class string, avg_weekly_units double, last_sale_date date, unit_cost double", [])
    orders = make("po_number int, line_number int, sku_id string, supplier_id string, status string, actual_delivery_date date, unit_cost double", [])
    sales = make(keys + "transaction_date date, is_warranty boolean", [])
    needs = make(keys + "recommendation_date date, qty_to_order double", [])
    text = plan(stock.dead_stock(snaps, master, orders, sales, make("prod_line_pn string, tran_date date", []), needs,
                                 make(keys[:-2], []), AS_OF))
    assert not re.search(r"SortAggregate[^\n]*\n(?:[^\n]+\n)*?[^\n]*max_by\([^\n]*qty_on_hand", text)


def test_critical_actions_read_the_order_lines_once(catalog, make):
    alerts = make("alert_type string, severity string, alert_key string, sku_id string, location_id string, supplier_id string,"
                  " financial_impact double", [])
    text = plan(reports.critical_actions(alerts, catalog["purchase_orders"], catalog["supplier_scores"], AS_OF))
    assert "lineitem" not in text  # open orders and scores come from stored rows


def test_sources_follow_the_house_rules():
    banned = re.compile(r"localCheckpoint|\.collect\(\)|\.toPandas\(\)|\brdd\b|\.crossJoin\((?!F\.broadcast)")
    for path in (p for p in (ROOT / "shelfwise").rglob("*.py") if "llm" not in p.parts):  # that subpackage has its own tests
        hits = [line for line in path.read_text().splitlines() if banned.search(line) and "# at most" not in line]
        assert not hits, (path, hits)


def test_broadcasts_are_of_one_row_frames_or_partition_counts():
    for path in (ROOT / "shelfwise").rglob("*.py"):
        text = path.read_text()
        for arg in re.findall(r"F\.broadcast\(([a-z_]+)\)", text):
            assert arg in {"top", "offsets", "bounds", "longest", "outlook", "climate", "listed", "one_row", "work", "start", "last",
                           "enough"}, (path, arg)
