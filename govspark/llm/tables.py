"""Small helpers shared by the operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of ids (8 bytes each) up to which a table of ids travels to every task: about 100 MB as a hash relation.
BROADCAST_IDS = 1_000_000


def broadcast_ids(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``ids``, a stored table of one id column, with a broadcast hint only if its counted size is within the limit.

    Beyond it Spark joins by shuffle; the result is the same.
    """
    return F.broadcast(ids) if ids.count() <= limit else ids


def plain_docs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The two columns an operator works on, under fixed names, so that further columns cannot clash.

    The names differ from the usual ones: an alias that changes nothing is dropped by Spark in some branches of a plan
    only, and branches that differ cannot share a shuffle.
    """
    return docs.select(docs[key].cast("long").alias("doc"), docs[text].cast("string").alias("body"))


def spare(df: DataFrame, *names: str) -> list[str]:
    """These names, each made longer until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def not_null(**fields: str) -> T.StructType:
    """A schema whose columns are never null."""
    return T.StructType([T.StructField(name, {"long": T.LongType(), "int": T.IntegerType()}[kind], False) for name, kind in fields.items()])


def required(**columns) -> pa.RecordBatch:
    """A batch for a schema of ``not_null``."""
    arrays = {name: value if isinstance(value, pa.Array) else pa.array(value) for name, value in columns.items()}
    return pa.RecordBatch.from_arrays(list(arrays.values()), schema=pa.schema([pa.field(n, a.type, False) for n, a in arrays.items()]))
