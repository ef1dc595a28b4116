"""All named queries. Importing this package fills the registry."""

from govspark.suite import (
    chains,
    filters,
    governance,
    loads,
    profiles,
    retrieval,
    sources,
    streams,
    texts,
    transforms,
    voting,
)
from govspark.suite.registry import ORACLES, QUERIES  # noqa: F401
