"""Decision-table cases of the pricing cascade."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from pricewright.functions import numbers
from pricewright.operators import percentiles, pricing, ranges

ITEM = "product bigint, list_type string, value decimal(18,6), special_value string"


def scale(rows, kind):
    d = lambda v: F.lit(None if v is None else str(v)).cast("decimal(18,6)")
    if kind == "range":
        return F.array(*[F.struct(d(a).cast("decimal(18,4)").alias("cost_from"), d(b).cast("decimal(18,4)").alias("cost_to"), d(p).alias("percent")) for a, b, p in rows])
    return F.array(*[F.struct(d(a).cast("decimal(18,4)").alias("price_from"), d(p).alias("percent")) for a, p in rows])


def run(spark, cost, prices, items=(), markup=((0, None, "0.15"),), no_comp=((0, None, "0.03"),), bend=((0, "0.5"), (2000, "0.2"), (5000, "0.1")), step="0.01", mode="math"):
    products = spark.createDataFrame([(1, None if cost is None else D(str(cost)))], "product bigint, cost decimal(18,4)")
    offers = spark.createDataFrame([(1, f"s{i}", D(str(p)), D(1)) for i, p in enumerate(prices)], "product bigint, source string, price decimal(18,4), coef decimal(18,6)")
    rules = pricing.rule_values(spark.createDataFrame([(1, t, D(str(v)), None) for t, v in items], ITEM))
    out = pricing.price(products, pricing.candidates(offers), rules, scale(markup, "range"), scale(no_comp, "range"), scale(bend, "step"), F.lit(0), F.lit(step).cast("decimal(18,6)"), F.lit(mode))
    return out.first()


def test_ordered_search_takes_the_first_candidate_above_the_floor(spark):
    r = run(spark, 2500, [2850, 2900, 3000])
    assert (r["final"], r["rank"], r["zone"]) == (D("2994.0000"), 3, "right")


def test_bend_is_looked_up_by_the_competitors_price(spark):
    r = run(spark, 2500, [9000])
    assert r["final"] == D("8991.0000")


def test_rounding_never_goes_below_the_floor(spark):
    r = run(spark, "100.009", [100], markup=((0, None, 0),), mode="down")
    assert r["final"] == D("100.0100")


@pytest.mark.parametrize(("items", "prices", "want"), [
    ([("min_markup", 25)], [105], "133.3400"), ([("max_markup", 10)], [200], "199.0000"), ([("min_price", 150)], [105], "150.0000"), ([("max_price", 130)], [200], "130.0000"),
    ([("memorandum", 118), ("memorandum", 115)], [200], "115.0000"), ([("fixed_price", 1200)], [], "1200.0000"),
])
def test_rule_lists(spark, items, prices, want):
    assert run(spark, 100, prices, items)["final"] == D(want)


def test_fixed_markup_passes_over_competitors(spark):
    r = run(spark, 250, [100], [("fixed_markup", 25)])
    assert (r["final"], r["reason"]) == (D("333.3300"), "fixed_markup_list")


@pytest.mark.parametrize("cost", [None, 0])
def test_missing_cost(spark, cost):
    r = run(spark, cost, [100])
    assert (r["final"], r["reason"], r["zone"]) == (D("0.0000"), "missing_cost", None)


def test_no_competitors_and_all_below_the_floor(spark):
    assert run(spark, 100, [])["reason"] == "no_competitors"
    r = run(spark, 100, [50])
    assert (r["reason"], r["final"]) == ("all_competitors_failed_mdc", D("117.6500"))


def test_excluded_products_are_dropped(spark):
    assert run(spark, 100, [120], [("exclude", 0)]) is None


def test_hard_minimum_after_rounding(spark):
    assert run(spark, 1, [7226], [("min_price", 7300)], bend=((0, 0),), step="72.26")["final"] == D("7300.0000")


@pytest.mark.parametrize(("final", "zone"), [(99, "left"), (100, "optimal"), (103, "optimal"), ("103.01", "right")])
def test_zone_bounds(spark, final, zone):
    d = lambda v: F.lit(str(v)).cast("decimal(18,4)")
    assert spark.range(1).select(numbers.zone(d(final), d(100)).alias("z")).first().z == zone


def test_ranges_and_steps(spark):
    r = scale([(0, 10, "0.1"), (10, 20, "0.2"), (30, 40, "0.3")], "range")
    got = spark.createDataFrame([(5,), (10,), (25,), (99,)], "v int").select(ranges.in_range(r, F.col("v")).alias("p")).collect()
    assert [float(x.p) for x in got] == [0.1, 0.1, 0.3, 0.3]
    s = scale([(10, 1), (20, 2)], "step")
    got = spark.createDataFrame([(5,), (10,), (25,)], "v int").select(ranges.as_of(s, F.col("v"), F.lit(7)).alias("p")).collect()
    assert [float(x.p) for x in got] == [7, 1, 2]


def test_invalid_ranges(spark):
    rows = spark.createDataFrame([(1, 0.0, 10.0), (1, 5.0, 20.0), (2, 0.0, None), (2, 5.0, 6.0), (3, 5.0, 4.0), (4, -1.0, 3.0)], "k int, cost_from double, cost_to double")
    assert sorted((r.k, r.why) for r in ranges.invalid_ranges(rows, ["k"]).collect()) == [(1, "overlap"), (2, "overlap"), (3, "turned"), (4, "negative")]


def test_percentile_of_percentiles(spark):
    v = spark.createDataFrame([(1, p, v) for v in (100.0, 300.0) for p in percentiles.LEVELS], "product int, percentile int, value double")
    got = {r.percentile: (r.value, r.n_groups) for r in percentiles.percentile_of_percentiles(v, ["product"]).collect()}
    assert {p: round(x[0], 6) for p, x in got.items()} == {10: 120, 20: 140, 30: 160, 40: 180, 60: 220} and got[10][1] == 2


def test_global_regular_percentiles(spark):
    prices = [2270, 2015, 1299.2, 1912.54, 1912.54, 1299.2, 2015, 2090.72, 1898.02, 1886.26, 0, -5]
    rows = spark.createDataFrame([(1, f"s{i}", float(p)) for i, p in enumerate(prices)], "product int, source string, price double")
    got = percentiles.regular_percentiles(rows, ["product"], "price", "source").collect()
    assert {r.percentile: round(r.value, 4) for r in got} == {10: 1299.2, 20: 1768.848, 30: 1894.492, 40: 1906.732, 60: 1953.524}
    assert (got[0].sample_count, got[0].source_count) == (10, 10)
