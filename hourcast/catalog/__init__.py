"""Named queries with their DuckDB twins (imported for registration)."""

from hourcast.catalog import registry
from hourcast.catalog import (  # noqa: F401
    alerting, artifacts, boosted, contracts, enrichment, history, ingest, ledgers, models, monitoring, repository, runs, series, storage, streams, text)

QUERIES = registry.QUERIES
ORACLE = registry.ORACLE
FAMILY = registry.FAMILY
