from __future__ import annotations

import json

from govspark.sources import variants


def test_paths_come_from_their_own_columns(spark, tmp_path):
    rows = [(i, json.dumps({"a": {"b": {"c": i, "big": "x" * 50}}, "title": f"t{i}", "list": [{"q": i}], "odd": i if i % 2 else "text"})) for i in range(2000)]
    rows += [(5000, "no json"), (5001, None), (5002, "[1]"), (5003, '{"a": null}'), (5004, '{"a": {"b": 3}}')]
    path = str(tmp_path / "v")
    variants.store_records(spark.createDataFrame(rows, "id long, value string"), path, keys=["id"])
    before = spark.conf.get("spark.sql.variant.pushVariantIntoScan")
    with variants.shredding(spark):
        stored = spark.read.parquet(path)
        one = variants.fields(stored, {"a.b.c": "bigint"}, ["id"])
        plan = one._jdf.queryExecution().executedPlan().toString()
        found = {r.id: r for r in variants.fields(stored, {"a.b.c": "bigint", "title": "string", "list.0.q": "int", "odd": "json", "a.b": "json", "none": "string"}, ["id"]).collect()}
        some = one.where("a_b_c = 77")
        assert [r.id for r in some.collect()] == [77]
        assert "PushedFilters: [" in some._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,record:struct<0:bigint>>" in plan  # no other part of the record is read
    assert spark.conf.get("spark.sql.variant.pushVariantIntoScan") == before
    for i in range(0, 2000, 97):
        assert tuple(found[i])[1:5] == (i, f"t{i}", i, str(i) if i % 2 else "text") and found[i].none is None
        assert json.loads(found[i].a_b) == {"c": i, "big": "x" * 50}
    assert all(v is None for k in (5000, 5001, 5002, 5003) for v in tuple(found[k])[1:])
    assert found[5004].a_b == "3" and found[5004].a_b_c is None
