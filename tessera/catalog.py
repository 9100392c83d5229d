"""All registered queries of the engine's own operators, with their SQL."""

from tessera.plans import aggregates, filters, retrieval, streams, tables, texts, vectors  # noqa: F401  they register themselves
from tessera.plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
