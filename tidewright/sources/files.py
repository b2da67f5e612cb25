"""Files of JSON arrays, version files, accounts and bundles."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources.json_scan import file_stem

VERSION_FIELDS = "appVersion string, appHash string, dataVersion string, assetVersion string, assetHash string, cdnVersion int"


def _or_none(read, spark: SparkSession, schema: str) -> DataFrame:
    """What ``read`` gives, or an empty table where its path is missing; other faults are raised."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def table_files(spark: SparkSession, folder: str) -> DataFrame:
    """``stem, path`` of every ``*.json`` right in ``folder``; none if it is missing. Nothing is read but names."""
    path = f"{folder.rstrip('/')}/*.json"
    at = F.col("_metadata.file_path")
    return _or_none(lambda: spark.read.format("binaryFile").load(path).select(file_stem(at).alias("stem"), at.alias("path")), spark, "stem string, path string")


def file_stems(spark: SparkSession, folder: str) -> DataFrame:
    """``stem`` of every ``*.json`` right in ``folder``; none if it is missing. Nothing is read but names."""
    return table_files(spark, folder).select("stem")


def json_files(spark: SparkSession, folder: str) -> DataFrame:
    """``stem, value`` of every ``*.json`` right in ``folder``, a row a file; none if it is missing.

    For small files such as versions and accounts; tables are read in byte ranges by
    :mod:`tidewright.sources.json_scan`.
    """
    path = f"{folder.rstrip('/')}/*.json"
    return _or_none(
        lambda: spark.read.text(path, wholetext=True).select(file_stem(F.col("_metadata.file_path")).alias("stem"), "value"), spark, "stem string, value string"
    )


def is_array(value: Column) -> Column:
    """Whether a text is a JSON array."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("ARRAY"), F.lit(False))


def records_of(files: DataFrame, *keep: str) -> DataFrame:
    """``stem, pos, record`` of the objects in each file's array, and the columns ``keep``; other elements are skipped."""
    parsed = files.select("stem", *keep, F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("pos", "record"))
    return parsed.where(F.schema_of_variant("record").startswith("OBJECT"))


def file_status(files: DataFrame) -> DataFrame:
    """``stem, ok, rows``: a file whose text is no JSON array fails, and it alone."""
    array = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    objects = F.filter(array, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    return files.select("stem", array.isNotNull().alias("ok"), F.coalesce(F.size(objects), F.lit(0)).alias("rows"))


def accounts_of(files: DataFrame) -> DataFrame:
    """``stem, account`` of files with an object or an array of objects; bad files give none."""
    value = F.try_parse_json("value")
    many = F.when(F.schema_of_variant(value).startswith("OBJECT"), F.array(value)).otherwise(F.try_variant_get(value, "$", "array<variant>"))
    found = files.select("stem", F.explode(many).alias("account"))
    return found.where(F.schema_of_variant("account").startswith("OBJECT"))


def version_of(text: Column) -> Column:
    """A version file's fields; missing ones, and all of a bad file, are empty or 0."""
    v = F.from_json(text, VERSION_FIELDS)
    names = [f.split()[0] for f in VERSION_FIELDS.split(", ")]
    return F.struct(*[F.coalesce(v[n], F.lit(0) if n == "cdnVersion" else F.lit("")).alias(n) for n in names])


def first_hit(rows: DataFrame, key: str, source_order: str, value: str) -> DataFrame:
    """Of each key the value of the first source that has one."""
    hit = rows.where(F.col(value).isNotNull())
    return hit.groupBy(key).agg(F.min_by(value, source_order).alias(value), F.min(source_order).alias(source_order))


def bundle_members(bundles: DataFrame, version_name: str) -> DataFrame:
    """``path, name, is_version, value, error`` of the flat ``*.json`` members of tar files.

    ``bundles`` is a ``binaryFile`` read (``path, content``). Members in folders,
    links, dotfiles and other names are skipped. A file that is no tar, or is cut
    short, has a row without a name that tells the error; it leaves the others alone,
    and what could be read before stays. Members are given on one by one.
    """
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("is_version", pa.bool_()), ("value", pa.string()), ("error", pa.string())])

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i]
                try:
                    with tarfile.open(fileobj=pa.BufferReader(content.as_buffer()) if content.is_valid else io.BytesIO()) as tar:
                        for m in tar:
                            if m.isfile() and m.name.endswith(".json") and "/" not in m.name and not m.name.startswith("."):
                                value = tar.extractfile(m).read().decode("utf-8", "replace")
                                yield row(path, m.name, m.name == version_name, value, None)
                except (tarfile.TarError, EOFError, OSError) as e:
                    yield row(path, None, False, None, f"{type(e).__name__}: {e}")

    return bundles.select("path", "content").mapInArrow(run, "path string, name string, is_version boolean, value string, error string")


def bundle_status(bundles: DataFrame, members: DataFrame) -> DataFrame:
    """``path, files, version, error`` of every bundle; one without a table's file is an error."""
    found = members.groupBy(F.col("path").alias("_p")).agg(
        F.count_if(F.col("name").isNotNull() & ~F.col("is_version")).alias("files"),
        F.max(F.when(F.col("is_version"), F.col("value"))).alias("version"),
        F.max("error").alias("error"),
    )
    both = bundles.select("path").join(found, F.col("path") == F.col("_p"), "left")
    files = F.coalesce("files", F.lit(0))
    return both.select("path", files.alias("files"), "version", F.coalesce("error", F.when(files == 0, F.lit("the bundle has no files"))).alias("error"))


def write_tables(tables: DataFrame, folder: str) -> DataFrame:
    """Write ``table_key, value`` as JSON lines, a folder a table; returns ``table_key, outcome, n``.

    Keys that are no safe file names are skipped. Tables that are not in
    ``tables`` stay as they are.
    """
    from tidewright.functions.predicates import safe_path_part

    marked = tables.withColumn("outcome", F.when(safe_path_part(F.col("table_key")), "written").otherwise("skipped"))
    written = marked.where("outcome = 'written'").select("table_key", F.to_json("value").alias("value"))
    written.write.partitionBy("table_key").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(folder)
    return marked.groupBy("table_key", "outcome").agg(F.count(F.lit(1)).alias("n"))


def read_tables(spark: SparkSession, folder: str) -> DataFrame:
    """``table_key, value`` of what :func:`write_tables` wrote."""
    found = spark.read.schema("value string, table_key string").text(folder)
    return found.select("table_key", F.try_parse_json("value").alias("value"))


def write_versions(versions: DataFrame, folder: str) -> None:
    """The current version row of each ``region``, and a snapshot by ``region`` and ``dataVersion``.

    Only the regions in ``versions`` are replaced, and of snapshots only those of the
    same version. A data version that is no safe file name has no snapshot.
    """
    from tidewright.functions.predicates import safe_path_part

    def put(rows: DataFrame, name: str, by: list[str]) -> None:
        rows.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder.rstrip('/')}/{name}")

    put(versions, "current", ["region"])
    put(versions.where(safe_path_part(F.col("dataVersion"))).withColumn("snapshot", F.col("dataVersion")), "snapshots", ["region", "snapshot"])
