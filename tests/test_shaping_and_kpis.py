"""Total rows, grids, merges, KPI sheets, prices, stock, classes and finance on hand-made rows."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from found import rows
from shopledger.operators import classes, finance, inventory, kpis, pricing, shaping
from shopledger.plans.parameters import DISTRICTS, OTHER_REGION, REGIONS, WAREHOUSE_REGION


def test_total_row_is_apart_from_a_null_key(make):
    df = make("k string, v int", ("a", 1), (None, 2))
    got = shaping.with_total(df, ["k"], "k", "All", [F.sum("v").alias("v")])
    assert rows(got, "k", "v", "is_total") == [(None, 2, False), ("All", 3, True), ("a", 1, False)]


def test_dense_grid(make):
    facts = make("o int, c string, v int, ok boolean", (1, "x", 5, True), (1, "x", 1, False), (1, "other", 7, False), (2, "y", 2, False))
    values = make("c string", ("x",), ("y",), ("x",), (None,))
    assert rows(shaping.dense_grid(facts, ["o"], "c", values, ["v"])) == [
        (1, "other", 7, None), (1, "x", 6, 1), (1, "y", 0, 1), (2, "x", 0, 1), (2, "y", 2, 1),
    ]
    assert rows(shaping.dense_grid(facts, ["o"], "c", values, ["v"], only="ok")) == [
        (1, "other", 7, None), (1, "x", 6, 1), (1, "y", 0, 1), (2, "y", 2, None),
    ]


def test_dense_grid_with_a_long_dimension(make, spark):
    facts = make("o int, c int, v int", (1, 1, 5), (None, 2, 1), (2, -7, 3))
    values = spark.range(1001).select(F.col("id").cast("int").alias("c"))
    got = shaping.dense_grid(facts, ["o"], "c", values, ["v"])
    assert got.count() == 3 * 1001 + 1
    assert rows(got.where("v > 0")) == [(None, 2, 1, 1), (1, 1, 5, 1), (2, -7, 3, None)]


def test_merge_wide_refuses_a_key_twice(make):
    a, b = make("k string, a int", ("x", 1), ("x", 2)), make("k string, b int", ("x", 2))
    with pytest.raises(Exception, match="key twice"):
        shaping.merge_wide(["k"], a, b).collect()


def test_merge_wide_keeps_keys_of_every_input(make):
    a, b, c = make("k string, a int", ("x", 1), (None, 9)), make("k string, b int", ("y", 2), (None, 8)), make("k string, c int", ("z", 3))
    assert rows(shaping.merge_wide(["k"], a, b, c)) == [(None, 9, 8, None), ("x", 1, None, None), ("y", None, 2, None), ("z", None, None, 3)]
    assert rows(shaping.all_keys(["k"], a, b)) == [(None,), ("x",), ("y",)]


def test_day_and_two_day(make):
    df = make("k int, d int, v int", (1, 2, 5), (1, 1, 3), (1, 0, 9), (2, 1, 4))
    got = kpis.day_and_two_day(df, ["k"], {"v": "v"}, F.col("d") == 2, F.col("d").between(1, 2))
    assert rows(got) == [(1, 5, 8), (2, None, 4)]


def test_demand_classes_may_overlap(make):
    lines = make("date_analytics_id bigint, c string, v int", (1, "a", 5), (1, "ab", 3), (2, "n", 9), (2, None, 1))
    rules = {1: F.col("c").contains("a"), 2: F.col("c").contains("b")}
    demand = kpis.demand_classes(lines, rules, "v")
    assert rows(demand) == [(1, 1, 8), (1, 2, 3)]
    calendar = make("date_analytics_id bigint, gregorian_date date", (1, date(2022, 1, 1)), (2, date(2022, 1, 2)))
    plan = make("date_analytics_id bigint, f double, b double", (2, 7.0, 8.0))
    got = kpis.demand_vs_plan(calendar, plan, demand, {1: ("f", "b"), 2: (None, None)})
    assert rows(got, "date_analytics_id", "class_id", "forecast_demand", "budgeted_demand", "dollars") == [
        (1, 1, 0.0, 0.0, 8), (1, 2, 0.0, 0.0, 3), (2, 1, 7.0, 8.0, 0), (2, 2, 0.0, 0.0, 0),
    ]


def test_split_and_discount_net(make):
    lines = make("o int, v int", (1, 5), (2, 6))
    assert rows(kpis.split_by_existence(lines, make("o int", (1,), (1,)), ["o"])) == [(1, 5, True), (2, 6, False)]
    schema = "order_line_analytics_id string, order_analytics_id int, d int, merchandise int, quantity int"
    sales = make(schema, ("a", 1, 1, 10, 1), ("b", 1, 1, 20, 1))
    returns = make(schema, ("c", 2, 1, 4, 1), ("c2", 3, 2, 7, 1))
    codes = make("order_line_analytics_id string, discount_code string", ("a", "COOK1"), ("a", "COOK2"), ("b", "X"), ("c", "COOK"), ("c2", "COOK"))
    assert rows(kpis.discount_net(sales, returns, codes, "COOK", ["d"])) == [(1, 16, 1, 2), (2, -7, -1, 1)]


def test_price_endings(make):
    prices = [None, "0.29", "10.06", "10.16", "10.01", "10.11", "10.00", "10.09", "1234567.01"]
    df = make("p decimal(18,4)", *[(None if p is None else Decimal(p),) for p in prices])
    got = {r[0] and str(r[0].quantize(Decimal("0.01"))): r[1] for r in df.select("p", pricing.price_ending_type("p")).collect()}
    assert got == {
        None: "NP", "0.29": "MKD", "10.06": "POS", "10.16": "POS", "10.01": "MOS", "10.11": "REG", "10.00": "REG",
        "10.09": "MKD", "1234567.01": "MOS",
    }


def test_current_price_and_age(make):
    products = make("product_analytics_id bigint, retail_price double", (1, 10.0), (2, 20.0), (3, None))
    history = make(
        "product_analytics_id bigint, snapshot_date date, price double",
        (1, date(2022, 1, 1), 5.0), (1, date(2022, 1, 2), 6.0), (1, date(2022, 1, 2), 7.0), (3, None, 1.0),
    )
    assert rows(pricing.current_price(products, history), "product_analytics_id", "current_retail_price") == [(1, 7.0), (2, 20.0), (3, 1.0)]
    as_of = date(2022, 12, 31)
    days = [91, 92, 182, 183, 273, 274, 364, 365]
    df = make("n int, d date", *[(n, date.fromordinal(as_of.toordinal() - n)) for n in days], (None, None))
    got = rows(df.select("n", pricing.age_bucket("d", as_of, "id")))
    assert got == [(None, 1), (91, 5), (92, 4), (182, 4), (183, 3), (273, 3), (274, 2), (364, 2), (365, 1)]


def test_price_type_and_departments(make):
    fact = make("product_analytics_id bigint, date_analytics_id bigint", (1, 1), (1, 2), (2, 1))
    history = make("product_analytics_id bigint, date_analytics_id bigint, price_type string", (1, 1, "regular_price"), (2, 1, None))
    assert rows(pricing.price_type_on_day(fact, history)) == [(1, 1, "regular_price"), (1, 2, "other"), (2, 1, "other")]
    taxonomy = make(
        "taxonomy_analytics_id bigint, parent_taxonomy_analytics_id bigint, name string, taxonomy_code string, level bigint",
        (3, 1, "A", "07", 3), (8, 1, "B", "8", 3), (77, 1, "C", "9", 3), (5, 1, "D", "x", 5),
    )
    assert rows(pricing.department_dim(taxonomy), "level_3_analytics_id", "department_code", "merch_group") == [
        (3, 7, "Kitchen"), (8, 8, "Entertaining"), (77, 9, "Other"),
    ]


PO = (
    "purchase_order_analytics_id bigint, po_line_number string, location_analytics_id bigint, product_analytics_id bigint, "
    "quantity_open double, is_closed int, current_arrival_date date, current_arrival_date_analytics_id bigint"
)


def test_next_arrivals(make):
    po = make(
        PO,
        (1, "a", 5, 10, 3.0, 0, date(2022, 1, 1), 1), (2, "a", 904, 10, 4.0, 0, date(2022, 1, 2), 2), (3, "a", 904, 10, 9.0, 1, date(2022, 1, 1), 1),
        (4, "a", 904, 10, -1.0, 0, date(2022, 1, 1), 1), (5, "a", 904, 11, 6.0, 0, date(2022, 1, 5), 5), (6, "a", 904, None, 6.0, 0, date(2022, 1, 5), 5),
    )
    any_site = inventory.next_arrivals(po)
    assert rows(any_site, "product_analytics_id", "arrival_order", "arrival_label", "quantity_open") == [
        (10, 1, "Next PO", 3.0), (10, 2, "2nd Next PO", 4.0), (11, 1, "Next PO", 6.0),
    ]
    assert rows(inventory.next_arrival_at(any_site, 904), "product_analytics_id", "next_po_units") == [(11, 6.0)]
    at_site = inventory.next_arrivals(po, scope="site", site=904)
    assert rows(inventory.next_arrival_at(at_site, 904), "product_analytics_id", "next_po_units") == [(10, 4.0), (11, 6.0)]
    assert rows(inventory.open_order_units(po, 904)) == [(10, 4.0), (11, 6.0)]


def test_backorders_and_coverage(make):
    lines = make(
        "product_analytics_id bigint, is_backorder int, status string, date_ordered timestamp_ntz, merchandise double, quantity double",
        (1, 1, "open", datetime(2022, 1, 5, 9), 10.0, 2.0), (1, 1, "open", datetime(2022, 1, 3, 9), 5.0, 1.0), (1, 0, "open", datetime(2021, 1, 1), 9.0, 9.0),
        (2, 1, "closed", datetime(2022, 1, 3), 5.0, 1.0), (None, 1, "open", datetime(2022, 1, 3), 5.0, 1.0),
    )
    assert rows(inventory.open_backorders(lines, date(2022, 1, 13))) == [(1, date(2022, 1, 3), 15.0, 3.0, 10)]
    assert inventory.open_backorders(lines, date(2022, 1, 13), date(2022, 1, 5)).first().open_backorder_units == 2.0
    wide = make(
        "open_backorder_units double, next_po_units double, s1 double, s2 double, open_on_order_units double",
        (10.0, 4.0, 5.0, None, 5.0), (None, 4.0, 0.0, 0.0, None), (3.0, 9.0, None, 6.0, None),
    )
    got = inventory.coverage(wide, "s1", ["s1", "s2"])
    assert rows(got, "oversold_units", "coverage_ratio", "backorder_to_stock_ratio") == [(0.0, None, None), (0.0, 0.0, 0.5), (6.0, 1.0, 2.0)]


def test_open_vs_received(make):
    schema = (
        "vendor_po_name string, purchase_order_analytics_id bigint, po_line_number string, next_cost_effective_date date, cancel_date date, "
        "location_analytics_id bigint, current_arrival_date_analytics_id bigint, open_landed_cost double, open_vendor_cost double, "
        "quantity_open double, quantity_ordered double"
    )
    day = date(2099, 12, 31)
    lines = make(schema, ("v", 1, "a", day, day, 5, 7, 1.0, 2.0, 3.0, 4.0), ("v", 2, "a", day, day, 5, 7, 1.0, 2.0, 3.0, 4.0))
    receipts = make(
        "location_analytics_id bigint, po_line_number string, purchase_order_analytics_id bigint, received_date_analytics_id bigint, recieved_quantity double",
        (5, "a", 1, 7, 2.0), (5, "a", 1, 7, 1.0), (5, "a", 2, 8, 9.0), (5, "a", 3, 7, 9.0),
    )
    got = inventory.open_vs_received(lines, receipts)
    assert rows(got, "purchase_order_analytics_id", "open_units", "received_units") == [(1, 3.0, 3.0), (2, 3.0, None)]


def test_stores_changes_and_regions(make):
    sales = make(
        "date_analytics_id bigint, attribution_location_analytics_id bigint, merchandise double",
        (1, 1, 5.0), (2, 1, 5.0), (2, 2, -5.0), (2, 2, 4.0), (2, 3, 1.0), (9, 1, 1.0),
    )
    sites = make("location_analytics_id bigint, channel_analytics_id string", (1, "1"), (2, "1"), (3, "2"))
    assert rows(inventory.active_stores(sales, sites, [1, 2])) == [("1", 2, 1), ("2", 2, 1)]
    assert rows(inventory.active_stores(sales, sites, [])) == []
    df = make("a double, b double", (3.0, 2.0), (3.0, 0.0), (3.0, None), (None, 2.0))
    assert rows(inventory.changes(df, "a", "b", "x"), "a", "b", "x_change", "x_change_pct") == [
        (None, 2.0, None, None), (3.0, None, None, None), (3.0, 0.0, 3.0, None), (3.0, 2.0, 1.0, 0.5),
    ]
    locations = make(
        "location_analytics_id bigint, name string, district_code string, channel_code string",
        (14, "a", "NW", "store"), (2, "b", "DC", "web"), (904, "c", None, "warehouse"), (5, "d", None, None),
    )
    got = inventory.region_map(locations, REGIONS, DISTRICTS, WAREHOUSE_REGION, OTHER_REGION, [14])
    assert rows(got, "location_analytics_id", "region", "region_order", "district_code", "district_name", "district_order", "is_flag_store") == [
        (2, "ecommerce", 5, "DC", "ecommerce", 9, "N"), (5, "zOther", 7, "No Code", "Other", 11, "N"),
        (14, "West Coast", 1, "NW", "West Coast North", 1, "Y"), (904, "DC", 6, "No Code", "DC", 10, "N"),
    ]


def test_fill_rate(make):
    sessions = make("sku string, maximum_seats bigint, price double", ("a", 10, 50.0), ("b", 0, 50.0), ("c", 4, 50.0), ("d", 3, 50.0))
    lines = make(
        "sku string, order_number string, is_return string, is_canceled string, quantity int, sub_total double",
        ("a", "1", "FALSE", None, 4, 200.0), ("a", "2", "TRUE", "FALSE", 5, 1.0), ("a", "3", None, "TRUE", 5, 1.0), ("b", "4", "FALSE", "FALSE", 1, 40.0),
        ("d", "5", "FALSE", "FALSE", 5, 250.0),
    )
    prices = make("order_number string, sku string, unit_price double", ("1", "a", 60.0))
    got = classes.fill_rate(sessions, lines, prices)
    assert rows(got, "sku", "paid_seats", "available_seats", "fill_rate", "cost", "actual_revenue", "potential_revenue") == [
        ("a", 4, 6, 0.4, 60.0, 200.0, 560.0), ("b", 1, -1, 0.0, 50.0, 40.0, -10.0), ("c", 0, 4, 0.0, 50.0, 0.0, 200.0),
        ("d", 5, -2, 1.6667, 50.0, 250.0, 150.0),
    ]


def test_names_and_cancelled_lines(make):
    df = make("n string, f string, l string", ("P", None, "Last"), ("P", "First", "Last"), ("X", "First", "Last"), ("P", None, None), (None, "F", "L"))
    assert rows(df.select(classes.resolve_name("n", "f", "l", "P"))) == [(None,), ("",), ("First Last",), ("Last",), ("X",)]
    lines = make(
        "k int, sku string, loc string, quantity int, quantity_returned int, quantity_canceled int, sub_total double",
        (1, "a", "x", 4, 1, 0, 100.0), (2, "a", "x", 0, 0, 0, 30.0), (3, "b", "x", 2, 0, 2, 100.0),
    )
    got = classes.cancelled_lines(lines, ["loc", "sku"], ["loc"], ["k"])
    assert rows(got, "k", "seat_price", "net_quantity", "extended_price", "class_revenue", "class_net_quantity", "rank_in_class") == [
        (1, 25.0, 3, 75.0, 130.0, 3, 1), (2, 0.0, 0, 0.0, 130.0, 3, 3), (3, 50.0, 0, 0.0, 100.0, 0, 1),
    ]


def test_tender_chain_and_contacts(make):
    key = (("O", 1, date(2022, 1, 1), 1, 1), ("O", 1, date(2022, 1, 1), 1, 2))
    k = "organization_id string, rtl_loc_id bigint, business_date date, wkstn_id bigint, trans_seq bigint, "
    transactions = make(
        k + "create_date timestamp_ntz, trans_statcode string, post_void_flag int, create_user_id string",
        (*key[0], datetime(2022, 1, 31, 23, 59, 59), "COMPLETE", 0, "u"), (*key[1], datetime(2022, 1, 5), "COMPLETE", 0, None),
    )
    retail = make(k + "cust_party_id bigint, create_user_id string", (*key[0], 7, "u"), (*key[1], 8, "u"))
    cheques = make(
        k + "payable_to_name string, payable_to_address string, payable_to_address2 string, payable_to_apt string, payable_to_city string, "
        "payable_to_state string, payable_to_postal_code string, payable_to_country bigint, create_user_id string",
        (*key[0], "n", "a", None, "apt", "c", "s", "z", 1, "u"), (*key[1], "n", "a", None, "apt", "c", "s", "z", 1, "u"),
    )
    tenders = make(
        k + "rtrans_lineitm_seq bigint, amt double, tndr_id string, create_user_id string",
        (*key[0], 1, -5.0, "HOME_OFFICE_CHECK", "u"), (*key[0], 2, -6.0, "HOME_OFFICE_CHECK", "u"), (*key[0], 3, -7.0, "HOME_OFFICE_CHECK", "DATALOADER"),
        (*key[0], 4, -8.0, "CASH", "u"), (*key[1], 1, -9.0, "HOME_OFFICE_CHECK", "u"),
    )
    items = make(k + "rtrans_lineitm_seq bigint, void_flag int, create_user_id string", *[(*key[0], i, int(i == 2), "u") for i in (1, 2, 3, 4)], (*key[1], 1, 0, "u"))
    got = finance.tender_chain(transactions, retail, cheques, tenders, items, date(2022, 1, 1), date(2022, 1, 31))
    assert rows(got, "cust_party_id", "payable_to_apartment", "amount") == [(7, "apt", 5.0)]
    phones = make(
        "party_id bigint, telephone_number string, contact_flag int, create_date timestamp_ntz",
        (1, "old flagged", 1, datetime(2020, 1, 1)), (1, "new", 0, datetime(2022, 1, 1)), (2, "a", 1, datetime(2020, 1, 1)), (2, "b", 1, datetime(2020, 1, 1)),
        (3, None, 1, datetime(2020, 1, 1)),
    )
    assert rows(finance.preferred_contact(phones)) == [(1, "old flagged"), (2, "b")]


def test_discount_attribution(make):
    facts = make(
        "order_line_analytics_id string, d int, merchandise double, quantity int, fair_market_value double",
        ("none", 1, 10.0, 1, 4.0), ("one", 1, 20.0, 1, None), ("two", 1, 30.0, 2, 5.0),
    )
    codes = make(
        "order_line_analytics_id string, discount_code string, subdiscount_code string, discount_amount double",
        ("one", "A", "1", 2.0), ("two", "B", "1", 3.0), ("two", "A", "2", 4.0),
    )
    got = finance.discount_attribution(facts, codes, ["d"])
    assert rows(got, "order_line_analytics_id", "discount_code", "dollars", "discount_dollars", "unique_factor") == [
        ("none", "No Discount", 10.0, 0.0, 1), ("one", "A", 20.0, 2.0, 1), ("two", "A", 30.0, 4.0, 1), ("two", "B", 30.0, 3.0, 0),
    ]
    once = got.agg(F.sum(F.col("dollars") * F.col("unique_factor"))).first()[0]
    assert once == facts.agg(F.sum("merchandise")).first()[0]
