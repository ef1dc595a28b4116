"""Links to proposals and source tracking from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.functions.text import strip

# Networks, the path of each proposal type that has a page, and the defaults.
NETWORKS = ["polkadot", "kusama"]
PATHS = {"ReferendumV2": "referenda", "Discussion": "post"}
DEFAULT_NETWORK, DEFAULT_TYPE = "polkadot", "ReferendumV2"


def link_rules(spark, site: str) -> DataFrame:
    """(network, proposal type) to the start of a link; the host is the caller's."""
    rows = [(n, kind, f"https://{n}.{site}/{path}/") for n in NETWORKS for kind, path in PATHS.items()]
    return spark.createDataFrame(rows, "_network string, _type string, _prefix string")


def with_proposal_link(
    rows: DataFrame, site: str, key: str = "proposal_index", network: str = "network", kind: str = "proposal_type", title: str = "title"
) -> DataFrame:
    """Adds ``proposal_link`` and ``proposal_link_display``; null for a network or type without page."""
    given = F.lower(F.col(network))
    joined = rows.withColumns(
        {
            "_network": F.when(given.isNull() | (given == ""), DEFAULT_NETWORK).otherwise(given),
            "_type": F.when(F.col(kind).isNull() | (F.col(kind) == ""), DEFAULT_TYPE).otherwise(F.col(kind)),
        }
    ).join(F.broadcast(link_rules(rows.sparkSession, site)), ["_network", "_type"], "left")
    number = strip(F.col(key).cast("string"))
    usable = ~number.isin("", "None", "NaN")
    link = F.when(usable, F.concat("_prefix", number))
    heading = strip(F.col(title))
    shown = F.when(heading.isNull() | heading.isin("", "None"), F.concat(F.lit("Proposal "), number)).otherwise(F.col(title))
    return joined.withColumns(
        {"proposal_link": link, "proposal_link_display": F.concat(F.lit("["), shown, F.lit("]("), link, F.lit(")"))}
    ).drop("_network", "_type", "_prefix")


def file_network(file: Column) -> Column:
    """Network from a file name ``network_type_...``; unknown where the name has no such parts."""
    parts = F.split(F.regexp_replace(file, r"\.csv", ""), "_")
    return F.when((F.size(parts) >= 2) & parts[0].isin(NETWORKS), parts[0]).otherwise("unknown")


def file_proposal_type(file: Column) -> Column:
    parts = F.split(F.regexp_replace(file, r"\.csv", ""), "_")
    return F.when(F.size(parts) >= 2, F.get(parts, F.lit(1))).otherwise("unknown")
