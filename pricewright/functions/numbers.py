"""Money, percentages and tolerant number parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY, FINE = "decimal(18,4)", "decimal(18,6)"


def tolerant_decimal(c: Column, kind: str = FINE) -> Column:
    """Digits with blanks, no-break spaces, currency and decimal comma; what is no number: null."""
    t = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(?U)[\s ]", ""), r"[^\d,.\-]", "")
    # 1.234,56 and 1,234.56: the last sign is the decimal one
    t = F.when(t.rlike(r"\..*,"), F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")).when(t.rlike(r",.*\."), F.regexp_replace(t, ",", "")).otherwise(F.regexp_replace(t, ",", "."))
    return F.when(t.rlike(r"^-?\d+(\.\d+)?$|^-?\.\d+$"), t).try_cast(kind)


def price(c: Column) -> Column:
    """Positive, 4 places; else null."""
    p = tolerant_decimal(c, MONEY)
    return F.when(p > 0, p)


def whole(c: Column) -> Column:
    """Truncated to a whole number; else null."""
    return tolerant_decimal(c, "double").cast("bigint")


def flag(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("1", "true", "yes", "y", "да", "истина", "+"), True).when(t.isin("0", "false", "no", "n", "нет", "ложь", "-", ""), False)


def as_fraction(c: Column) -> Column:
    """A percentage as a fraction; values between 0 and 1 are fractions already, 1 is one percent."""
    return F.when((c > 0) & (c < 1), c).otherwise(c / 100)


def percent_points(c: Column) -> Column:
    """``5,5``, ``5%`` and ``0.055`` as 5.5, 5 and 5.5."""
    v = tolerant_decimal(c)
    return F.when((v > 0) & (v < 1) & ~F.contains(c.cast("string"), F.lit("%")), v * 100).otherwise(v).cast(FINE)


def from_margin(cost: Column, margin: Column) -> Column:
    """cost / (1 - margin); a margin of 1 or more is an error."""
    return F.when(margin < 1, cost / (1 - margin)).otherwise(F.raise_error(F.lit("margin must be less than 1")))


def margin_percent(cost: Column, p: Column) -> Column:
    return F.try_divide((p - cost) * 100, p)


def quantum(step: Column, precision: Column) -> Column:
    """The step if it is positive, else ten to minus the precision, held to 0..6."""
    p = F.greatest(F.lit(0), F.least(F.lit(6), F.coalesce(precision, F.lit(2))))
    table = F.array(*[F.lit(f"{10 ** -i:.6f}").cast(FINE) for i in range(7)])
    return F.when(step > 0, step.cast(FINE)).otherwise(F.get(table, p))


def round_to(p: Column, q: Column, mode: Column) -> Column:
    """To a multiple of ``q``: ``up`` (ceiling), ``down`` (floor), else half up. Decimals throughout."""
    n = p.cast("decimal(24,8)") / q.cast(FINE)
    k = F.when(mode == "up", F.ceil(n)).when(mode == "down", F.floor(n)).otherwise(F.floor(n + F.lit("0.5").cast("decimal(2,1)")))
    return (k * q.cast(FINE)).cast(MONEY)


def coefficient(c: Column) -> Column:
    """Within 0.01 .. 100, else 1."""
    return F.when(c.between(0.01, 100), c).otherwise(F.lit(1)).cast(FINE)


def zone(final: Column, reference: Column) -> Column:
    """left below the reference, optimal up to 3 % above it, right beyond; null without one."""
    return F.when(~(reference > 0) | reference.isNull() | final.isNull(), None).when(final < reference, "left").when(final <= reference * F.lit("1.03").cast("decimal(3,2)"), "optimal").otherwise("right")
