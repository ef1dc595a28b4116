from __future__ import annotations

import datetime as dt
import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

from govspark.sources import envelope_source as es

SCHEMA = "network string, id long, title string, amount decimal(20,2), at timestamp, day date, score double, tags array<string>"


@pytest.fixture(scope="module")
def source(spark):
    es.register(spark)
    return spark


def rows(n=2500):
    out = []
    for i in range(n):
        net = ["polkadot", "kusama", None][min(2, i % 5)]
        out.append((net, i, f'title "items" {i}\n é' if i % 3 else None, Decimal(f"{i}.25"), dt.datetime(2024, 1, 1, 2, 3, 4, i), dt.date(2024, 1, 1 + i % 28), i / 7, ["a", "b"][: i % 3]))
    return out


def same(df, expected):
    key = lambda r: r[1]
    return sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)


def test_round_trip(source, tmp_path):
    path, data = str(tmp_path / "x"), rows()
    df = source.createDataFrame(data, SCHEMA).repartition(3)
    df.write.format("envelopes").mode("append").option("path", path).option("items", "100").save()
    read = source.read.format("envelopes").schema(SCHEMA).option("path", path)
    assert same(read.load(), data)
    assert same(read.option("splitBytes", "777").load(), data)
    lines = [json.loads(x) for f in os.listdir(path) if f.endswith(".json") for x in open(f"{path}/{f}")]
    assert all(e["total_items"] == len(e["items"]) <= 100 for e in lines) and len({e["network"] for e in lines}) == 3
    df.limit(10).write.format("envelopes").mode("overwrite").option("path", path).save()
    assert read.load().count() == 10
    assert not [f for f in os.listdir(f"{path}/_manifests") if f.startswith(".")]


def test_filters_reach_the_source(source, tmp_path):
    path, data = str(tmp_path / "x"), rows(1000)
    for net in ("polkadot", "kusama"):
        mine = [r for r in data if r[0] == net]
        source.createDataFrame(mine, SCHEMA).coalesce(1).write.format("envelopes").mode("append").option("path", path).save()
    read = source.read.format("envelopes").schema(SCHEMA).option("path", path).load()
    kept = read.where((F.col("network") == "kusama") & (F.col("id") > 500) & F.col("title").contains("9"))
    assert same(kept, [r for r in data if r[0] == "kusama" and r[1] > 500 and "9" in (r[2] or "")])
    reader = es.EnvelopeReader(read.schema, {"path": path})
    tests = [EqualTo(("network",), "kusama"), GreaterThan(("id",), 500), StringContains(("title",), "9"), In(("id",), (1, 501, 506)), EqualTo(("day",), dt.date(2024, 1, 1))]
    assert list(reader.pushFilters(tests)) == [tests[2], tests[4]]
    splits = reader.partitions()
    assert len({p for s in splits for p, _, _ in s.pieces}) == 1  # the other network's file is not opened
    found = [r for s in splits for b in reader.read(s) for r in b.to_pylist()]
    assert [r["id"] for r in found] == [501, 506] and found[0]["network"] == "kusama"
    assert same(read.where("network IN ('polkadot', 'other')"), [r for r in data if r[0] == "polkadot"])


def test_a_stream_takes_each_manifest_once(source, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    data = rows(900)
    write = lambda part: source.createDataFrame(part, SCHEMA).write.format("envelopes").mode("append").option("path", path).save()

    def run():
        stream = source.readStream.format("envelopes").schema(SCHEMA).option("path", path).load()
        query = stream.writeStream.format("envelopes").option("path", out).option("run", "copy").option("checkpointLocation", check).start()
        query.processAllAvailable()
        query.stop()

    read = source.read.format("envelopes").schema(SCHEMA).option("path", out)
    write(data[:300])
    run()
    assert same(read.load(), data[:300])
    write(data[300:500])
    write(data[500:])
    run()
    assert same(read.load(), data)
    run()
    assert same(read.load(), data)


def test_a_repeated_commit_writes_nothing_twice(source, tmp_path):
    path, data = str(tmp_path / "x"), rows(50)
    schema = source.createDataFrame(data, SCHEMA)
    batches = schema.toArrow().to_batches()
    writer = es.EnvelopeStreamWriter(schema.schema, {"path": path, "run": "r"}, False)
    for _ in range(2):
        writer.commit([writer.write(iter(batches)), None], 4)
    writer.commit([writer.write(iter(batches[:0]))], 5)
    lost = writer.write(iter(batches))  # never committed
    read = source.read.format("envelopes").schema(SCHEMA).option("path", path)
    assert same(read.load(), data) and es.Folder(path).manifests() == [0, 1]
    writer.abort([lost], 6)
    assert len([f for f in os.listdir(path) if f.endswith(".json")]) == 1


def test_damage_is_told(source, tmp_path):
    path, data = str(tmp_path / "x"), rows(50)
    schema = source.createDataFrame(data, SCHEMA)
    writer = es.EnvelopeStreamWriter(schema.schema, {"path": path, "run": "r"}, False)
    message = writer.write(iter(schema.toArrow().to_batches()))
    file = f"{path}/{message.files[0]['path']}"
    with open(file, "ab") as out:
        out.write(b"x")
    with pytest.raises(RuntimeError, match="bytes"):
        writer.commit([message], 0)
    os.makedirs(tmp_path / "plain")
    (tmp_path / "plain" / "a.json").write_text('{"network": "n", "total_items": 2, "items": [{"id": 1}]}\n')
    with pytest.raises(Exception, match="of 2 items holds 1"):
        source.read.format("envelopes").schema("network string, id long").option("path", str(tmp_path / "plain")).load().collect()
    (tmp_path / "plain" / "a.json").write_text('\n{"network": "n", "items": [{"id": 1}, {"id": null}]}\n{"network": "m", "items": []}')
    read = source.read.format("envelopes").schema("network string, id long").option("path", str(tmp_path / "plain")).load()
    assert [tuple(r) for r in read.collect()] == [("n", 1), ("n", None)]


def test_empty(source, tmp_path):
    path = str(tmp_path / "x")
    read = source.read.format("envelopes").schema(SCHEMA).option("path", path)
    assert read.load().count() == 0
    source.createDataFrame([], SCHEMA).write.format("envelopes").mode("append").option("path", path).save()
    assert read.load().count() == 0
