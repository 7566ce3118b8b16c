"""Tables and queries of a Postgres server over JDBC."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from .facts import load_facts
from .table import SourceTable, reads_query

# Fixed value: seconds to wait for a connection.
CONNECT_TIMEOUT_S = 5


def connection_options(env: dict[str, str] | None = None) -> dict[str, str]:
    """JDBC options from ``DB_HOST``, ``DB_PORT``, ``DB_NAME``, ``DB_USER``,
    ``DB_PASSWORD`` and, when set, ``DB_SSLMODE``.

    Names and defaults are fixed values."""
    env = dict(os.environ) if env is None else env
    host, port = env.get("DB_HOST", "localhost"), env.get("DB_PORT", "5432")
    made = {
        "url": f"jdbc:postgresql://{host}:{port}/{env.get('DB_NAME', 'gobernanza')}",
        "user": env.get("DB_USER", "postgres"),
        "password": env.get("DB_PASSWORD", "postgres"),
        "driver": "org.postgresql.Driver",
        "connectTimeout": str(CONNECT_TIMEOUT_S),
    }
    if env.get("DB_SSLMODE"):
        made["sslmode"] = env["DB_SSLMODE"]
    return made


def quoted(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def read_options(
    table: str | None = None,
    *,
    query: str | None = None,
    schema: str = "public",
    limit: int | None = None,
    partition: tuple[str, int, int, int] | None = None,
) -> dict[str, str]:
    """Options of the read. ``partition`` is (column, lower, upper, tasks) and
    lets that many tasks read a table at once; a limit runs in the database."""
    by_query = reads_query(table, query)
    if by_query:
        if not query.lstrip(" \t\r\n(").lower().startswith(("select", "with")):
            raise ValueError("the query is no SELECT; this source only reads")
        return {"query": query}
    full = f"{quoted(schema)}.{quoted(table)}"
    if limit is not None:
        return {"query": f"SELECT * FROM {full} LIMIT {int(limit)}"}
    made = {"dbtable": full}
    if partition is not None:
        column, lower, upper, tasks = partition
        made.update(
            partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(tasks)
        )
    return made


def load_postgres(
    spark: SparkSession,
    table: str | None = None,
    *,
    query: str | None = None,
    schema: str = "public",
    limit: int | None = None,
    partition: tuple[str, int, int, int] | None = None,
    connection: dict[str, str] | None = None,
) -> SourceTable:
    options = read_options(table, query=query, schema=schema, limit=limit, partition=partition)
    connection = connection or connection_options()
    df = spark.read.format("jdbc").options(**connection, **options).load()
    version = (
        spark.read.format("jdbc").options(**connection, query="SELECT version() AS v").load().first()["v"]
    )
    facts = load_facts(df, empty_warning=True)
    facts.update(
        schema=schema if table is not None else None,
        table=table,
        query=query,
        limit=limit,
        server_version=version,
    )
    return SourceTable(df, "postgres", f"{schema}.{table}" if table is not None else "<query>", facts)
