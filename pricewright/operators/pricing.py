"""The rule cascade: from candidates, scales and lists to an explained selling price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fence import fix
from ..functions.numbers import FINE, MONEY, as_fraction, from_margin, round_to, zone
from .ranges import as_of, in_range, in_range_or

RULES = ("fixed_price", "fixed_markup", "critical_markup", "min_markup", "max_markup", "min_price", "max_price", "exclude", "no_bend", "percentile")


def candidates(offers: DataFrame, product: str = "product", source: str = "source", price: str = "price", coef: str = "coef") -> DataFrame:
    """(product, candidates): the lowest adjusted price of each source, ascending; ties by source.

    Prices that aren't positive go first; a coefficient of 0 or null counts as 1.
    """
    c = F.coalesce(F.when(F.col(coef) != 0, F.col(coef)), F.lit(1)).cast(FINE)
    best = offers.where(F.col(price) > 0).groupBy(product, source).agg(F.min((F.col(price).cast(MONEY) * c).cast(MONEY)).alias("p"))
    return best.groupBy(product).agg(F.array_sort(F.collect_list(F.struct("p", F.col(source).alias("s")))).alias("candidates"))


def search(cands: Column, floor: Column, bend: Column, fallback: Column, no_bend: Column) -> Column:
    """The candidates with their bent prices, up to the first that reaches the floor (``ok``)."""

    def bent(x: Column) -> Column:
        b = F.when(no_bend, F.lit(0)).otherwise(as_of(bend, x["p"], fallback)).cast(FINE)
        v = (x["p"] * (1 - b / 100)).cast("decimal(24,8)")
        return F.struct(x["p"].alias("p"), x["s"].alias("s"), b.alias("bend"), v.alias("bent"), (v >= floor).alias("ok"))

    return F.transform(cands, bent)


def conflicts(items: DataFrame) -> DataFrame:
    """Products with more than one active row of a list type (caps apart): these abort a run."""
    return items.where("list_type <> 'memorandum'").groupBy("product", "list_type").agg(F.count("*").alias("n")).where("n > 1")


def rule_values(items: DataFrame) -> DataFrame:
    """Active list items as one row per product and a column per rule; a critical '-' doesn't count, an exclusion without a value does."""
    value = F.when(F.col("list_type") == "exclude", F.coalesce("value", F.lit(1))).otherwise(F.col("value")).cast(FINE)
    good = items.where("NOT (list_type = 'critical_markup' AND special_value <=> '-')")
    return good.groupBy("product").agg(*[F.max(F.when(F.col("list_type") == r, value)).alias(r) for r in RULES], F.min(F.when((F.col("list_type") == "memorandum") & (F.col("value") > 0), F.col("value"))).cast(MONEY).alias("cap"), F.count_if(F.col("list_type") == "memorandum").alias("n_caps"))


def price(products: DataFrame, cands: DataFrame, rules: DataFrame, markup: Column, no_comp: Column, bend: Column, fallback_bend: Column, step: Column, mode: Column) -> DataFrame:
    """Price products(product, cost) in one pass of expressions over one row per product.

    markup, no_comp, bend: scale arrays (see ``ranges``) with fractions, fractions and
    percent points. Returns cost, final, reason, chosen source, price and rank,
    floor (mdc), zone and the number of candidates. Order of the rules: missing
    cost; fixed price; fixed markup; markups bounded by lists; floor; ordered
    search; minimum and maximum price; rounding and floor; hard minimum; cap.
    Excluded products are dropped, as in a batch run.
    """
    dec = lambda c: c.cast("decimal(24,8)")
    x = products.join(cands, "product", "left").join(rules, "product", "left").where("exclude IS NULL")
    cost = F.col("cost").cast(MONEY)
    some = F.coalesce(F.size("candidates") > 0, F.lit(False))
    x = fix(x, mk0=in_range(markup, cost).cast(FINE))
    x = fix(x, nc0=in_range_or(no_comp, cost, F.col("mk0")).cast(FINE))
    critical = F.when(some & F.col("critical_markup").isNotNull(), as_fraction(F.col("critical_markup"))).otherwise(F.col("mk0"))
    bound = lambda c: F.least(F.greatest(c, as_fraction(F.col("min_markup"))), as_fraction(F.col("max_markup"))).cast(FINE)
    x = fix(x, mk=bound(critical), nc=bound(F.col("nc0")))
    x = fix(x, mdc=dec(from_margin(cost, F.col("mk"))))
    no_bend = F.coalesce(F.col("no_bend") != 0, F.lit(False))
    x = fix(x, tried=search(F.col("candidates"), F.col("mdc"), bend, fallback_bend, no_bend))
    x = fix(x, rank=F.array_position(F.transform("tried", lambda t: t["ok"]), F.lit(True)).cast("int"))
    x = fix(x, hit=F.when(F.col("rank") > 0, F.get("tried", F.col("rank") - 1)))
    base = F.when(~some, dec(from_margin(cost, F.col("nc")))).when(F.col("hit").isNotNull(), F.col("hit.bent")).otherwise(F.col("mdc"))
    held = F.greatest(base, dec(F.col("min_price")))
    x = fix(x, held=F.when(F.col("max_price").isNotNull(), F.least(held, dec(F.col("max_price")))).otherwise(held))
    x = fix(x, rounded=round_to(F.col("held"), step, mode))
    floored = F.when(F.col("rounded") < F.col("mdc"), round_to(F.col("mdc"), step, F.lit("up"))).otherwise(F.col("rounded"))
    guarded = F.when(F.col("max_price").isNotNull(), F.col("held").cast(MONEY)).otherwise(F.greatest(floored, F.col("min_price").cast(MONEY)))
    fixed = F.when(F.col("fixed_price").isNotNull(), F.col("fixed_price").cast(MONEY)).when(F.col("fixed_markup").isNotNull(), round_to(dec(from_margin(cost, as_fraction(F.col("fixed_markup")))), step, mode))
    missing = ~(cost > 0) | cost.isNull()
    x = fix(x, uncapped=F.when(missing, F.lit(0).cast(MONEY)).otherwise(F.coalesce(fixed, guarded)))
    x = fix(x, final=F.when(missing, F.col("uncapped")).otherwise(F.least("uncapped", "cap")).cast(MONEY))
    reason = (
        F.when(missing, "missing_cost").when(F.col("fixed_price").isNotNull(), "fixed_price_list").when(F.col("fixed_markup").isNotNull(), "fixed_markup_list")
        .when(~some, "no_competitors").when(F.col("hit").isNull(), "all_competitors_failed_mdc").otherwise("competitor")
    )
    lowest = F.get("candidates", F.lit(0))["p"]
    return x.select(
        "product", cost.alias("cost"), "final", reason.alias("reason"), F.col("hit.s").alias("source"), F.col("hit.p").alias("source_price"), F.when(F.col("rank") > 0, F.col("rank")).alias("rank"),
        F.when(~missing, F.col("mdc").cast(MONEY)).alias("mdc"), F.when(~missing, zone(F.col("final"), lowest)).alias("zone"), F.coalesce(F.size("candidates"), F.lit(0)).alias("n_candidates"), (F.col("cap") < F.col("uncapped")).alias("capped"),
    )
