"""Amounts, voting-power units and conviction weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Asset id, decimal zeros to remove, unit. A missing asset id means the native unit, unscaled.
ASSETS = [(1984, 6, "USDT"), (1337, 6, "USDC"), (30, 3, "DED")]
NATIVE_UNIT = "DOT"

# Fixed value: weight of a vote without a lock.
UNLOCKED_WEIGHT = 0.1


def scaled_amount(amount: Column, asset_id: Column) -> Column:
    scaled = F.when(F.lit(False), amount)
    for asset, zeros, _ in ASSETS:
        scaled = scaled.when(asset_id == asset, amount / F.lit(float(10**zeros)))
    return scaled.otherwise(amount)


def unit_label(asset_id: Column) -> Column:
    label = F.when(asset_id.isNull(), F.lit(f" {NATIVE_UNIT}"))
    for asset, _, unit in ASSETS:
        label = label.when(asset_id == asset, F.lit(f" {unit}"))
    return label.otherwise(F.concat(F.lit(" (Asset ID: "), asset_id.cast("string"), F.lit(")")))


def with_display(rows: DataFrame, amount: str, asset_id: str) -> DataFrame:
    """Adds ``<amount>_formatted`` and ``<amount>_display``; null where the amount is missing or NaN."""
    number = F.col(amount).try_cast("double")
    asset = F.col(asset_id).try_cast("double").try_cast("bigint")
    formatted = F.when(F.isnan(number), None).otherwise(F.format_number(scaled_amount(number, asset), 2))
    return rows.withColumn(f"{amount}_formatted", formatted).withColumn(
        f"{amount}_display", F.concat(formatted, unit_label(asset))
    )


def remove_zeros(amount: Column, decimals: int = 9) -> Column:
    """Base units to whole units without rounding, for amounts of up to 38 digits; what is no such number is null."""
    number = amount.try_cast("decimal(38,0)").cast("string")
    digits, sign = F.ltrim(number, F.lit("-")), F.when(F.startswith(number, F.lit("-")), "-").otherwise("")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(decimals + 1)), "0")
    whole = F.left(padded, F.length(padded) - decimals)
    return F.concat(sign, whole, F.lit("."), F.right(padded, F.lit(decimals))).try_cast(f"decimal(38,{decimals})")


def conviction_weighted(balance: Column, lock_period: Column) -> Column:
    """Balance times lock period; a vote without lock counts a tenth; null when either part is not numeric."""
    number, lock = balance.try_cast("double"), lock_period.try_cast("double")
    return number * F.when(lock == 0, F.lit(UNLOCKED_WEIGHT)).otherwise(lock)
