"""Nested records to flat ones."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark.functions.keys import sanitize_key, sanitize_name
from govspark.functions.text import is_meaningful


def path_value(record: Column, path: str, kind: str = "string") -> Column:
    """Value at a dotted path of a variant; null where the path or the type does not fit."""
    return F.try_variant_get(record, f"$.{path}", kind)


def record_schema(df: DataFrame, column: str) -> str:
    """Merged schema of a JSON text column, from one aggregate pass; mixed types stay variants."""
    ddl = df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column)))).first()[0]
    return re.sub(r"\bVOID\b(?=[,>]|$)", "STRING", ddl.replace("OBJECT<", "STRUCT<"))


def parse_records(df: DataFrame, column: str, schema: str | None = None) -> DataFrame:
    """Replaces a JSON text column by its typed value."""
    return df.withColumn(column, F.from_json(F.col(column), schema or record_schema(df, column)))


def _array_sizes(value: Column, kind: T.DataType, path: str, lists: bool = False):
    """(path, largest size in this row) of every array, those inside other arrays included.

    With ``lists`` the column holds all values of the path in this row as one array.
    """
    if isinstance(kind, T.ArrayType):
        yield path, F.array_max(F.transform(value, F.size)) if lists else F.size(value)
        yield from _array_sizes(F.flatten(F.array_compact(value)) if lists else value, kind.elementType, f"{path}[]", True)
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            inner = value[f.name]  # on a list of structs: the list of that field
            yield from _array_sizes(inner, f.dataType, f"{path}.{f.name}", lists)


def array_widths(df: DataFrame) -> dict[str, int]:
    """Largest number of elements of each array, from one aggregate row."""
    sizes = [s for f in df.schema.fields for s in _array_sizes(F.col(f"`{f.name}`"), f.dataType, f.name)]
    if not sizes:
        return {}
    row = df.agg(*[F.max(size).alias(str(i)) for i, (_, size) in enumerate(sizes)]).first()
    return {path: max(row[i] or 0, 0) for i, (path, _) in enumerate(sizes)}


def _leaves(value: Column, kind: T.DataType, name: str, path: str, widths: dict[str, int]):
    """(flat name, column, type) of every leaf below ``value``."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _leaves(value[f.name], f.dataType, f"{name}_{sanitize_name(f.name)}", f"{path}.{f.name}", widths)
    elif isinstance(kind, T.ArrayType):
        for i in range(widths[path]):
            yield from _leaves(F.get(value, F.lit(i)), kind.elementType, f"{name}_{i}", f"{path}[]", widths)
    elif isinstance(kind, (T.MapType, T.VariantType)):
        yield name, F.to_json(value), T.StringType()
    else:
        yield name, value, kind


def _later_first(found: list[tuple[Column, T.DataType]]) -> Column:
    """The last of several leaves of one name that has a value; as text where their types differ."""
    same = len({kind.simpleString() for _, kind in found}) == 1
    return F.coalesce(*[leaf if same else leaf.cast("string") for leaf, _ in reversed(found)])


def flatten_wide(df: DataFrame, max_array: int | None = None, on_collision: str = "error") -> DataFrame:
    """One flat column per leaf: ``parent_child`` for fields, ``parent_0`` for list elements.

    One generated projection, no shuffle. Lists are as wide as the longest one found; with ``max_array`` a longer
    one is an error. A job finds the widths first. Two leaves of one flat name are an error unless
    ``on_collision="last"`` asks for the later one that has a value: a null does not hide an earlier value.
    """
    widths = array_widths(df)
    if max_array is not None and (wide := [f"{p}: {n}" for p, n in widths.items() if n > max_array]):
        raise ValueError(f"lists longer than {max_array}: {wide}")
    leaves: dict[str, list[tuple[Column, T.DataType]]] = defaultdict(list)
    for f in df.schema.fields:
        for name, leaf, kind in _leaves(F.col(f"`{f.name}`"), f.dataType, sanitize_name(f.name), f.name, widths):
            leaves[name].append((leaf, kind))
    twice = [n for n, found in leaves.items() if len(found) > 1]
    if twice and on_collision != "last":
        raise ValueError(f"keys collide after cleaning: {twice}")
    return df.select(*[(_later_first(f) if len(f) > 1 else f[0][0]).alias(name) for name, f in leaves.items()])


def depth_of(json: Column) -> Column:
    """How deep containers are nested in a JSON text; strings in it are set aside first."""
    plain = F.regexp_replace(F.regexp_replace(json, r"\\.", ""), '"[^"]*"', "")
    brackets = F.regexp_replace(plain, r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, sign: Column) -> Column:
        now = F.when(sign.isin("[", "{"), acc["now"] + 1).when(sign.isin("]", "}"), acc["now"] - 1).otherwise(acc["now"])
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda acc: acc["most"])


def flatten_long(df: DataFrame, key: str, column: str, max_depth: int | None = None) -> DataFrame:
    """One row per leaf of a JSON text column: key, path, value as text.

    Containers are opened level by level while leaves pass through, in one pass without a shuffle. Empty containers
    yield nothing, a key that cleans to nothing adds no text. As many levels are opened as the deepest document has, which a
    job finds first; with ``max_depth`` a deeper one is an error.
    """
    depth = df.agg(F.max(depth_of(F.to_json(F.try_parse_json(F.col(column)))))).first()[0] or 0
    if max_depth is not None and depth > max_depth:
        raise ValueError(f"documents are nested {depth} deep, more than {max_depth}")
    rows = df.select(
        F.col(key), F.lit("").alias("path"), F.lit(None).cast("string").alias("leaf_key"), F.try_parse_json(F.col(column)).alias("value")
    ).where(F.col("value").isNotNull())
    for _ in range(depth):
        # The outer form gives one row without position for a leaf and for an empty container: both are kept as is.
        stepped = rows.lateralJoin(
            df.sparkSession.tvf.variant_explode_outer(F.col("value").outer()).toDF("pos", "child_key", "child")
        )
        opened = F.col("pos").isNotNull()
        step = F.coalesce(sanitize_key(F.col("child_key")), F.col("pos").cast("string"))
        deeper = F.when(F.col("path") == "", step).otherwise(F.concat("path", F.lit("_"), step))
        rows = stepped.select(
            key,
            F.when(opened, deeper).otherwise(F.col("path")).alias("path"),
            F.when(opened, F.col("child_key")).otherwise(F.col("leaf_key")).alias("leaf_key"),
            F.when(opened, F.col("child")).otherwise(F.col("value")).alias("value"),
        )
    text = F.to_json("value")
    shown = F.when(F.left(text, F.lit(1)).isin("{", "["), text).otherwise(F.col("value").try_cast("string"))
    return rows.where(~text.isin("{}", "[]")).select(key, "path", "leaf_key", shown.alias("value"))


def text_leaves(df: DataFrame, key: str, column: str, max_depth: int | None = None) -> DataFrame:
    """Meaningful texts of a JSON document, object fields with their key in front.

    Every text is kept; a caller that wants the first thousand per document ranks by ``path``.
    """
    leaves = flatten_long(df, key, column, max_depth).where(is_meaningful(F.col("value")))
    named = F.when(F.col("leaf_key").isNotNull(), F.concat(F.lit("["), F.col("leaf_key"), F.lit("]: "), F.col("value")))
    return leaves.select(key, "path", F.coalesce(named, F.col("value")).alias("extract"))
