from __future__ import annotations

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark.streaming import growing


def land(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(line if isinstance(line, str) else json.dumps(line) + "\n" for line in lines))


def as_json(df):
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()]


@pytest.fixture
def folders(tmp_path):
    return tmp_path / "landing", str(tmp_path / "target"), str(tmp_path / "check")


def test_later_batches_lose_nothing(spark, folders):
    landing, target, check = folders
    first = [{"id": i, "n": 10**15 + i, "deep": {"a": i}, "list": [{"x": 1}]} for i in range(20)]
    land(landing, "1.json", first)
    got = growing.growing_load(spark, str(landing), target, check)
    assert sorted(as_json(got), key=lambda r: r["id"]) == first
    # a new field beside and inside, a field that becomes text, one that becomes a decimal
    second = [{"id": 100 + i, "n": f"{i} DOT", "deep": {"a": i + 0.25, "b": "new"}, "list": [{"x": 1, "y": True}], "title": "t", "only null": None} for i in range(20)]
    land(landing, "2.json", second)
    got = growing.growing_load(spark, str(landing), target, check)
    expected = first + [{k: v for k, v in r.items() if v is not None} for r in second]
    assert sorted(as_json(got), key=lambda r: r["id"]) == expected
    kinds = {f.name: f.dataType for f in got.schema.fields}
    assert isinstance(kinds["n"], T.VariantType) and kinds["deep"]["a"].dataType == T.DecimalType(21, 2)
    assert len(growing.versions(spark, target)) == 2
    # the older shape again needs no new version and is widened in its own part
    third = [{"id": 300, "n": 7, "deep": {"a": 1}}]
    land(landing, "3.json", third)
    got = growing.growing_load(spark, str(landing), target, check)
    assert sorted(as_json(got), key=lambda r: r["id"])[-1] == third[0]
    assert len(growing.versions(spark, target)) == 2 and got.count() == 41
    assert got.where(F.col("id") == 3).select(F.try_variant_get("n", "$", "bigint")).first()[0] == 10**15 + 3


def test_rejected_lines_and_replay(spark, folders):
    landing, target, check = folders
    lines = [{"id": 1, "a": 1}, "no json\n", "[1, 2]\n", "3\n", "\n", {"id": 2, "a": 2}, '{"id": 3, "a"\n', "null\n"]
    df = spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in lines], "value string")
    for _ in range(2):  # the same batch again
        growing.append_growing(df, 0, target, "id")
    assert sorted(r.id for r in growing.read_growing(spark, target).collect()) == [1, 2]
    assert growing.rejected(spark, target).count() == len(lines) - 2
    assert len(growing.versions(spark, target)) == 1
    # known keys stay out, even if the key's type has changed since
    more = spark.createDataFrame([('{"id": "1", "a": 9}',), ('{"id": "x", "a": 9}',), ('{"id": "x", "a": 8}',), ('{"a": 5}',)], "value string")
    growing.append_growing(more, 1, target, "id")
    found = growing.read_growing(spark, target)
    assert sorted(r[0] for r in found.select(F.try_variant_get("id", "$", "string")).collect()) == ["1", "2", "x"]
    assert found.where("a = 9").count() + found.where("a = 8").count() == 1


def test_nothing_landed(spark, folders):
    landing, target, check = folders
    landing.mkdir()
    assert growing.growing_load(spark, str(landing), target, check).count() == 0
    assert growing.rejected(spark, target).count() == 0
    land(landing, "1.json", ["bad\n"])
    assert growing.growing_load(spark, str(landing), target, check).count() == 0
    assert growing.rejected(spark, target).count() == 1


def test_merged_types():
    bigint, text, null = T.LongType(), T.StringType(), T.NullType()
    assert growing.merge(bigint, T.DecimalType(4, 2)) == T.DecimalType(21, 2)
    assert growing.merge(bigint, T.DecimalType(38, 20)) == T.VariantType()
    assert growing.merge(null, text) == growing.merge(text, null) == text
    assert growing.merge(T.ArrayType(bigint), T.ArrayType(text)) == T.ArrayType(T.VariantType())
    assert growing.merge(T.DoubleType(), bigint) == T.VariantType()
    a, b = T.StructType.fromDDL("x bigint, y string"), T.StructType.fromDDL("z int, x string")
    assert growing.merge(a, b) == T.StructType.fromDDL("x variant, y string, z int")


def test_widened_values(spark):
    df = spark.createDataFrame([(1, Decimal("2.50"), [(1, None)], None)], "a long, d decimal(4,2), l array<struct<x:long,y:long>>, s struct<q:int>")
    wanted = T.StructType.fromDDL("a variant, d decimal(21,2), l array<struct<x:variant,z:string>>, s struct<q:variant,w:int>")
    own = df.schema
    out = df.select(*(growing.widen(F.col(f.name), own[f.name].dataType, f.dataType).alias(f.name) for f in wanted.fields))
    assert as_json(out) == [{"a": 1, "d": 2.5, "l": [{"x": 1}]}] and out.first().s is None
