"""Text to typed columns; whatever does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.functions.text import strip

# Texts that stand for null, true and false.
NULL_TOKENS = ["NaN", "nan", "null", "NULL", ""]
TRUE_TOKENS = ["true", "1", "yes", "y", "t"]
FALSE_TOKENS = ["false", "0", "no", "n", "f"]

# Type names of a schema file and the type they are loaded as.
LOGICAL_TYPES = {
    "date": "date",
    "datetime": "timestamp",
    "timestamp": "timestamp",
    "int64": "integer",
    "integer": "integer",
    "int": "integer",
    "float64": "float",
    "float": "float",
    "double": "float",
    "bool": "boolean",
    "boolean": "boolean",
    "string": "text",
    "str": "text",
    "text": "text",
    "object": "text",
}

# A text column whose name has one of these parts is taken for a date, where names may decide.
DATE_NAME_PARTS = ["date", "time", "created", "updated"]


def normalize_null(value: Column) -> Column:
    return F.when(value.isin(NULL_TOKENS), None).otherwise(value)


def to_timestamp(value: Column) -> Column:
    return value.try_cast("timestamp_ntz")


def to_date(value: Column) -> Column:
    return to_timestamp(value).cast("date")


def to_integer(value: Column) -> Column:
    """Whole number of up to 38 digits, cut towards zero, without the precision loss of a float; more digits are null.

    Plain numbers are cut as text. With an exponent the number is exact where it is whole; one with a fraction is small
    enough for a double to hold its whole part.
    """
    text = strip(value.cast("string"))
    plain = F.regexp_extract(text, r"^([+-]?)0*(\d*)\.?\d*$", 1), F.regexp_extract(text, r"^[+-]?0*(\d*)\.?\d*$", 1)
    whole = F.concat(plain[0], F.when(plain[1] == "", "0").otherwise(plain[1])).try_cast("decimal(38,0)")
    double = text.try_cast("double")
    cut = F.when(double < 0, F.ceil(double)).otherwise(F.floor(double)).cast("decimal(38,0)")
    is_plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$")
    fraction = (F.abs(double) < 2**53) & (double != F.floor(double))
    return F.when(is_plain, whole).when(fraction, cut).otherwise(text.try_cast("decimal(38,0)"))


def to_float(value: Column) -> Column:
    number = strip(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number)


def to_boolean(value: Column) -> Column:
    token = F.lower(strip(value.cast("string")))
    return F.when(token.isin(TRUE_TOKENS), True).when(token.isin(FALSE_TOKENS), False)


CONVERTERS = {
    "date": to_date,
    "timestamp": to_timestamp,
    "integer": to_integer,
    "float": to_float,
    "boolean": to_boolean,
    "text": lambda value: normalize_null(value.cast("string")),
}


def schema_types(schema_info: dict) -> dict[str, str]:
    """Column to logical type from either form of a schema file: ``{column: {data_type}}`` or ``{columns: {...}}``."""
    columns = schema_info.get("columns", schema_info)
    return {c: LOGICAL_TYPES.get(str(info.get("data_type", "")).lower(), "text") for c, info in columns.items()}


def apply_schema(df: DataFrame, types: dict[str, str], dates_by_name: bool = False) -> DataFrame:
    """Casts the columns that have a declared type; the others keep theirs, with null tokens removed from text."""
    out = []
    for name, current in df.dtypes:
        declared = types.get(name)
        if declared is None and current == "string":
            by_name = dates_by_name and any(part in name.lower() for part in DATE_NAME_PARTS)
            declared = "date" if by_name else "text"
        out.append((CONVERTERS[declared](F.col(name)) if declared else F.col(name)).alias(name))
    return df.select(*out)
