"""Small numeric and text Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowintel import dims

def ratio(num: Column, den: Column) -> Column:
    """num / den as double, null when the denominator is 0 (ANSI mode raises otherwise)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column, digits: int) -> Column:
    return F.round(ratio(num, den) * 100, digits)


def finite_or_zero(name: str) -> str:
    """SQL text: column to double; null, blank and non-finite values become 0.0.

    Text that is neither a number nor a known token stays null, as a plain cast gives.
    """
    value = f"try_cast({name} AS double)"
    return (
        f"CASE WHEN {name} IS NULL OR cast({name} AS string) = '' OR isnan({value}) "
        f"OR abs({value}) <=> double('Infinity') THEN 0.0D ELSE {value} END")


def non_finite_to_null(name: str) -> str:
    """SQL text: column to double with NaN and +-Infinity as null."""
    value = f"cast({name} AS double)"
    return f"CASE WHEN isnan({value}) OR abs({value}) = double('Infinity') THEN NULL ELSE {value} END"


def _tokens(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


# SQL text of the token checks on a text column
TOKEN_CHECKS = {
    "null_or_empty": "{c} IS NULL OR {c} = ''",
    "pos_infinity": f"{{c}} IN ({_tokens(dims.POS_INF_TOKENS)}) OR try_cast({{c}} AS double) = double('Infinity')",
    "neg_infinity": f"{{c}} IN ({_tokens(dims.NEG_INF_TOKENS)}) OR try_cast({{c}} AS double) = double('-Infinity')",
    "nan": f"{{c}} IN ({_tokens(dims.NAN_TOKENS)}) OR isnan(try_cast({{c}} AS double))",
}


def fixed_decimals(x: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals, ties rounded up."""
    scale = float(10 ** digits)
    return F.format_string(f"%.{digits}f", F.floor(x * scale + 0.5) / scale)


def uniform_from_keys(keys: list[str], seed: int, buckets: int = 1_000_000) -> Column:
    """Bucket 0..buckets-1 from a hash of the key columns.

    The same row always lands in the same bucket, on every retry and in every layout of
    the input, which a random generator cannot promise after an executor was lost.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets
