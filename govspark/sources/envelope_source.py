"""Envelope folders as a data source: ``spark.read.format("envelopes")``, ``readStream``, ``write`` and ``writeStream``.

An envelope is one line ``{network, timestamp, total_items, items}``. Rows are ``network`` and the columns of one item. Every
commit writes new files and then one manifest, numbered in order, that lists them with their envelopes and rows per network.
Only files of a manifest are read, so a failed or repeated commit shows nowhere:

- a streaming commit is known by its query and batch; the same batch again writes no second manifest;
- every task holds the rows it wrote against those that lie in its file, and the manifest appears only if all files are whole;
- the offset of a stream is the number of the last manifest.

Large files are split at lines. Filters on ``network`` skip files, others skip rows before they reach Spark. A folder without
manifests, as other programs leave it, is read as it is, by batch only. The folder may lie on any store that Arrow knows.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

NAME = "envelopes"
MANIFESTS = "_manifests"
#: Items of one envelope, bytes of one partition, rows of one batch.
ENVELOPE_ITEMS, SPLIT_BYTES, BATCH_ROWS = 1000, 64 << 20, 10_000
NETWORK = "network"

_TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EnvelopeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class Folder:
    """Files and manifests below a path."""

    def __init__(self, path: str):
        self.files, self.base = fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))

    def manifests(self) -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.base}/{MANIFESTS}", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def manifest(self, number: int) -> dict:
        with self.files.open_input_stream(f"{self.base}/{MANIFESTS}/{number:012d}.json") as file:
            return json.loads(file.read())

    def plain_files(self) -> list[dict]:
        found = self.files.get_file_info(fs.FileSelector(self.base, recursive=True, allow_not_found=True))
        return [{"path": f.path[len(self.base) + 1 :], "bytes": f.size, "networks": None} for f in found if f.is_file and f.base_name.endswith(".json")]

    def listed(self, after: int = -1, upto: int | None = None) -> list[dict]:
        """The files of manifests behind ``after``; a manifest that replaces hides all before it."""
        out: list[dict] = []
        numbers = [n for n in self.manifests() if n > after and (upto is None or n <= upto)]
        for number in numbers:
            manifest = self.manifest(number)
            out = manifest["files"] if manifest["replaces"] and after < 0 else out + manifest["files"]
        return out if numbers or after >= 0 or self.manifests() else self.plain_files()

    def commit(self, messages: Iterable[Written | None], replaces: bool, run: str, batch: int) -> None:
        """One manifest for the files of all tasks, unless this run has committed this batch before."""
        numbers, written = self.manifests(), [f for m in messages if m for f in m.files]
        for number in reversed(numbers):
            known = self.manifest(number)
            if (known["run"], known["batch"]) == (run, batch):
                self.remove(written)
                return
        for file in written:
            if (size := self.files.get_file_info(f"{self.base}/{file['path']}").size) != file["bytes"]:
                raise RuntimeError(f"{file['path']} holds {size} bytes, {file['bytes']} were written")
        number = numbers[-1] + 1 if numbers else 0
        self.files.create_dir(f"{self.base}/{MANIFESTS}", recursive=True)
        hidden = f"{self.base}/{MANIFESTS}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(hidden) as out:
            out.write(json.dumps({"run": run, "batch": batch, "replaces": replaces, "files": written}).encode())
        self.files.move(hidden, f"{self.base}/{MANIFESTS}/{number:012d}.json")

    def remove(self, files: Iterable[dict]) -> None:
        for file in files:
            self.files.delete_file(f"{self.base}/{file['path']}")


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class Split(InputPartition):
    """Lines of files, [path, begin, end): those that begin there."""

    pieces: list[tuple[str, int, int]] = field(default_factory=list)


def _splits(files: list[dict], size: int = SPLIT_BYTES) -> list[Split]:
    """Small files together, large ones cut."""
    out, held, used = [], [], 0
    for file in files:
        for begin in range(0, max(1, file["bytes"]), size):
            piece = (file["path"], begin, min(file["bytes"], begin + size))
            if held and used + piece[2] - begin > size:
                out.append(Split(held))
                held, used = [], 0
            held.append(piece)
            used += piece[2] - begin
    return [*out, Split(held)] if held else out


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_timestamp(kind) or pa.types.is_date(kind) or pa.types.is_decimal(kind):
        text = pa.array([None if v is None else str(v) for v in values], pa.string())
        if pa.types.is_timestamp(kind) and kind.tz:
            zoned = pc.match_substring_regex(text, r"(Z|[+-]\d\d:?\d\d)$")  # without a zone it is UTC
            text = pc.if_else(zoned, text, pc.binary_join_element_wise(text, "Z", ""))
            return text.cast(pa.timestamp(kind.unit, "UTC")).cast(pa.timestamp(kind.unit, kind.tz))
        return text.cast(kind)
    return pa.array(values, kind)


class Reader:
    """What batch and stream readers share."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.size = int(options.get("splitbytes", SPLIT_BYTES))
        self.tests: list[Filter] = []

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        folder, schema = Folder(self.path), to_arrow_schema(self.schema)
        networks = self._networks()
        for path, begin, end in split.pieces:
            held: list[tuple] = []
            with folder.files.open_input_file(f"{folder.base}/{path}") as raw:
                for at, line in _lines(raw, max(0, begin - 1)):
                    if at >= end:
                        break
                    if at < begin or not line.strip():  # the split before reads the line in which this one begins
                        continue
                    envelope = json.loads(line)
                    items = envelope.get("items") or []
                    if envelope.get("total_items", len(items)) != len(items):
                        raise ValueError(f"{path}: an envelope of {envelope.get('total_items')} items holds {len(items)}")
                    if networks is None or envelope.get(NETWORK) in networks:
                        held.extend((envelope.get(NETWORK), item) for item in items)
                    while len(held) >= BATCH_ROWS:
                        yield from self._batch(held[:BATCH_ROWS], schema)
                        held = held[BATCH_ROWS:]
            yield from self._batch(held, schema)

    def _batch(self, rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        columns = [_column([n if f.name == NETWORK else item.get(f.name) for n, item in rows], f.type) for f in schema]
        batch = pa.RecordBatch.from_arrays(columns, schema=schema)
        for test in self.tests:
            column = batch.column(schema.get_field_index(test.attribute[0]))
            if isinstance(test, In):
                keep = pc.is_in(column, pa.array(list(test.value), column.type))
            else:
                keep = _TESTS[type(test)](column, pa.scalar(test.value, column.type))
            batch = batch.filter(keep)
        yield batch

    def _networks(self) -> set | None:
        """Networks that may be read, by the filters."""
        found = None
        for test in self.tests:
            if test.attribute == (NETWORK,) and isinstance(test, (EqualTo, In)):
                mine = set(test.value) if isinstance(test, In) else {test.value}
                found = mine if found is None else found & mine
        return found

    def _wanted(self, files: list[dict]) -> list[dict]:
        networks = self._networks()
        return [f for f in files if networks is None or f["networks"] is None or networks & set(f["networks"])]


def _lines(raw, begin: int = 0) -> Iterator[tuple[int, bytes]]:
    """(where it begins, line) from a byte of an open file on."""
    raw.seek(begin)
    held: list[bytes] = []
    while chunk := raw.read(1 << 20):
        *whole, rest = chunk.split(b"\n")
        for line in whole:
            line = b"".join([*held, line])
            held = []
            yield begin, line
            begin += len(line) + 1
        held.append(rest)
    if line := b"".join(held):
        yield begin, line


def _count(line: bytes) -> int:
    """An envelope's item count, from its head."""
    head = line[: line.index(b'"items"')]
    return json.loads(head.rstrip().rstrip(b",") + b"}")["total_items"]


class EnvelopeReader(Reader, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of a column with a number, text or truth value are made here."""
        for test in filters:
            values = test.value if isinstance(test, In) else [getattr(test, "value", None)]
            simple = len(getattr(test, "attribute", ())) == 1 and all(isinstance(v, (str, int, float, bool)) for v in values)
            if simple and (type(test) in _TESTS or isinstance(test, In)):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[Split]:
        return _splits(self._wanted(Folder(self.path).listed()), self.size) or [Split([])]


class EnvelopeStreamReader(Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"manifest": -1}

    def latestOffset(self) -> dict:
        return {"manifest": max(Folder(self.path).manifests(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        folder = Folder(self.path)
        files = [f for n in folder.manifests() if start["manifest"] < n <= end["manifest"] for f in folder.manifest(n)["files"]]
        return _splits(files, self.size) or [Split([])]


class Writer:
    """What batch and stream writers share: every task writes one file, an envelope a line, at most one open per network."""

    def __init__(self, schema: T.StructType, options: dict, replaces: bool):
        if NETWORK not in schema.names:
            raise ValueError(f"rows need a column {NETWORK}")
        self.path, self.replaces = options["path"], replaces
        self.items = int(options.get("items", ENVELOPE_ITEMS))
        self.run = options.get("run") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, name = Folder(self.path), f"part-{uuid.uuid4().hex}.json"
        held: dict[str | None, list[dict]] = {}
        counts: dict[str, int] = {}
        lines: list[bytes] = []
        out = None

        def close(network: str | None) -> None:
            items = held.pop(network)
            counts[network or ""] = counts.get(network or "", 0) + len(items)
            stamp = dt.datetime.now(dt.timezone.utc).isoformat()
            envelope = {NETWORK: network, "timestamp": stamp, "total_items": len(items), "items": items}
            lines.append(json.dumps(envelope, ensure_ascii=False).encode() + b"\n")

        try:
            for batch in iterator:
                texts = [c.cast(pa.string()) if _as_text(c.type) else c for c in batch.columns]
                rows = pa.RecordBatch.from_arrays(texts, names=batch.schema.names).to_pylist()
                for row in rows:
                    network = row.pop(NETWORK)
                    held.setdefault(network, []).append(row)
                    if len(held[network]) == self.items:
                        close(network)
                if rows and out is None:
                    folder.files.create_dir(folder.base, recursive=True)
                    out = folder.files.open_output_stream(f"{folder.base}/{name}")
                if lines:
                    out.write(b"".join(lines))
                    lines = []
            for network in list(held):
                close(network)
            if lines:
                out.write(b"".join(lines))
            size = out.tell() if out is not None else 0
        finally:
            if out is not None:
                out.close()
        if out is not None:
            with folder.files.open_input_file(f"{folder.base}/{name}") as raw:
                stored = sum(_count(line) for _, line in _lines(raw))
            if stored != sum(counts.values()):
                raise RuntimeError(f"{name} holds {stored} items, {sum(counts.values())} were written")
        return Written([{"path": name, "bytes": size, "networks": counts}] if out is not None else [])

    def abort_files(self, messages: Iterable[Written | None]) -> None:
        Folder(self.path).remove(f for m in messages if m for f in m.files)


def _as_text(kind: pa.DataType) -> bool:
    return pa.types.is_timestamp(kind) or pa.types.is_date(kind) or pa.types.is_decimal(kind)


class EnvelopeWriter(Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        Folder(self.path).commit(messages, self.replaces, self.run, 0)

    def abort(self, messages: list[Written | None]) -> None:
        self.abort_files(messages)


class EnvelopeStreamWriter(Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        Folder(self.path).commit(messages, False, self.run, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.abort_files(messages)


class EnvelopeSource(DataSource):
    """Options: ``path``; for reading ``splitBytes``; for writing ``items`` per envelope and ``run``, the name under which a
    commit is known (a stream needs one, so that a batch that is run again after a restart is told)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("give the columns with .schema(): network and those of an item")

    def reader(self, schema: T.StructType) -> EnvelopeReader:
        return EnvelopeReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> EnvelopeStreamReader:
        return EnvelopeStreamReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> EnvelopeWriter:
        return EnvelopeWriter(schema, self.options, overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> EnvelopeStreamWriter:
        if not self.options.get("run"):
            raise ValueError("a stream into envelopes needs the option run, a name that stays when the stream is started again")
        return EnvelopeStreamWriter(schema, self.options, overwrite)
