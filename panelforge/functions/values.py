"""Scalar rules of the data model: flags, finite values, missing values, industries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public twelve-industry classification by SIC ranges, first match wins, else Other.
INDUSTRIES = ["NoDur", "Durbl", "Manuf", "Enrgy", "Chems", "BusEq", "Telcm", "Utils", "Shops", "Hlth", "Money", "Other"]
SIC_RANGES = {
    "NoDur": [(100, 999), (2000, 2399), (2700, 2749), (2770, 2799), (3100, 3199), (3940, 3989)],
    "Durbl": [(2500, 2519), (3630, 3659), (3710, 3711), (3714, 3714), (3716, 3716), (3750, 3751), (3792, 3792), (3900, 3939), (3990, 3999)],
    "Manuf": [(2520, 2589), (2600, 2699), (2750, 2769), (3000, 3099), (3200, 3569), (3580, 3629), (3700, 3709), (3712, 3713), (3715, 3715), (3717, 3749), (3752, 3791), (3793, 3799), (3830, 3839), (3860, 3899)],
    "Enrgy": [(1200, 1399), (2900, 2999)],
    "Chems": [(2800, 2829), (2840, 2899)],
    "BusEq": [(3570, 3579), (3660, 3692), (3694, 3699), (3810, 3829), (7370, 7379)],
    "Telcm": [(4800, 4899)],
    "Utils": [(4900, 4949)],
    "Shops": [(5000, 5999), (7200, 7299), (7600, 7699)],
    "Hlth": [(2830, 2839), (3693, 3693), (3840, 3859), (8000, 8099)],
    "Money": [(6000, 6999)],
}


def industry(sic: Column) -> Column:
    """Industry of a SIC code given as text or number; codes that aren't whole numbers are Other."""
    value = sic.cast("string").try_cast("double")
    whole = value.isNotNull() & ~F.isnan(value) & (value == F.floor(value))
    out = F.when(~F.coalesce(whole, F.lit(False)), "Other")
    for name in INDUSTRIES[:-1]:
        inside = F.lit(False)
        for low, high in SIC_RANGES[name]:
            inside = inside | value.between(float(low), float(high))
        out = out.when(inside, name)
    return out.otherwise("Other")


def flag(value: Column) -> Column:
    """true and 1, false and 0 in any case; anything else is null."""
    text = F.lower(value.cast("string"))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def present(value: Column) -> Column:
    """A double whose NaN is null."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    value = value.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
