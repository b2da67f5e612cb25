"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives its rows where SQL can."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lay_file(lines: DataFrame, path: str) -> None:
    """Lay down ``value`` in the order of ``section, nth`` as one text file, on whatever file system the folder is."""
    from tidewright.sources.commits import Files

    folder, _, name = path.rpartition("/")
    lines.repartition(1).sortWithinPartitions("section", "nth").select("value").write.text(f"{path}.parts")
    files = Files(lines.sparkSession, folder)
    (part,) = [n for n in files.names(f"{name}.parts") if n.startswith("part-")]
    files.fs.rename(files.path(f"{name}.parts/{part}"), files.path(name))
    files.delete(f"{name}.parts")


def line(spark: SparkSession, section: int, text: str) -> DataFrame:
    """One line for :func:`lay_file`."""
    return spark.createDataFrame([(section, 0, text)], "section int, nth bigint, value string")


def _load() -> None:
    from tidewright.plans import flagship, ingest_queries, restore_queries, scalar_queries, state_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
