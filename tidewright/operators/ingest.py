"""Ingest: names resolved, schemas united, values coerced leniently, partitions replaced."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.text import trimmed
from tidewright.operators.restore import kind, members
from tidewright.sources.commits import Run

#: Tables that are never taken in.
SKIPPED = ("character_profiles", "virtual_items", "virtualitems")
_TYPES = {
    "int64": "bigint", "int32": "bigint", "int": "bigint", "float64": "double", "float32": "double", "float": "double",
    "bool": "boolean", "string": "string", "json.RawMessage": "variant",
}


def catalog_of(entries: list[dict]) -> dict[str, dict[str, str]]:
    """``{table: {column: type}}`` of ``name`` and ``columns`` (``col:type``; no type is a string)."""
    return {e["name"]: dict((c.split(":", 1) if ":" in c else (c, "string")) for c in e["columns"]) for e in entries}


def plain_name(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit("_"), F.lit("")))


def resolve_tables(stems: DataFrame, tables: DataFrame) -> DataFrame:
    """``stems`` (``stem``) with the ``table`` of each: its name as is, with ``s`` or with ``es``.

    ``tables`` has ``table``, a row a name. Case and underscores do not matter; a
    table also answers to its name without a last ``s``. Unknown and skipped names
    have null. Of tables that answer to one name the first by name wins.
    """
    plain = plain_name(F.col("table"))
    answers = tables.select("table", F.explode(F.array_distinct(F.array(plain, F.regexp_replace(plain, "s$", "")))).alias("_name"))
    answers = answers.groupBy("_name").agg(F.min("table").alias("table"))
    own = plain_name(F.col("stem"))
    asked = stems.select("stem").distinct().where(~F.col("stem").isin(*SKIPPED) & ~own.isin(*SKIPPED))
    asked = asked.select(F.col("stem").alias("_stem"), F.posexplode(F.array(own, F.concat(own, F.lit("s")), F.concat(own, F.lit("es")))).alias("_try", "_ask"))
    found = asked.join(answers, F.col("_ask") == F.col("_name")).groupBy("_stem").agg(F.min_by("table", "_try").alias("table"))
    return stems.join(found, F.col("stem") == F.col("_stem"), "left").drop("_stem")


def plain_key(key: Column) -> Column:
    """A record's key as it is compared: without underscores, in small letters; ``id`` is ``gameid``."""
    k = F.lower(F.translate(key, "_", ""))
    return F.when(k == "id", F.lit("gameid")).otherwise(k)


def plain_column(column: str) -> str:
    return column.lower().replace("_", "")


def coerce(value: Column, sort: str) -> Column:
    """A variant as a catalog type; null where it does not fit.

    Whole numbers must be written so (1.0 is none) and fit 64 bits, or be a
    text of one; floats are any number or a text of one, ``inf`` and ``nan`` too;
    booleans are not numbers. Texts may have white space of any kind around them.
    A string takes every value, structured ones as JSON.
    """
    k = kind(value)
    return _coerced(value, k, _text_of(value, k), sort)


def _text_of(value: Column, k: Column) -> Column:
    return trimmed(F.when(k == "STRING", F.try_variant_get(value, "$", "string")))


def _coerced(value: Column, k: Column, text: Column, sort: str) -> Column:
    """:func:`coerce` of a value whose kind and trimmed text are known."""
    if sort in ("int64", "int32", "int"):
        whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
        return F.when(k == "BIGINT", F.try_variant_get(value, "$", "bigint")).otherwise(whole)
    if sort in ("float64", "float32", "float"):
        number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
        number = number.when(text.rlike("(?i)^[+]?inf(inity)?$"), F.lit(float("inf"))).when(text.rlike("(?i)^-inf(inity)?$"), F.lit(float("-inf")))
        number = number.when(text.rlike("(?i)^[+-]?nan$"), F.lit(float("nan")))
        return F.when(k.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(value, "$", "double")).otherwise(number)
    if sort == "bool":
        word = F.when(text == "true", True).when(text == "false", False)
        return F.when(k == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).otherwise(word)
    if sort == "string":
        return F.when(k == "STRING", F.try_variant_get(value, "$", "string")).when(k != "VOID", F.to_json(value))
    return F.when(k != "VOID", value)


def with_plain_keys(records: DataFrame) -> DataFrame:
    """Add ``_by_key``: a record's members by their compared keys.

    Of keys that become equal the last by name wins. The entries are a column of
    their own, so that the test for repeats does not take the record apart again.
    """
    entries = F.transform(F.map_entries(members(F.col("record"))), lambda e: F.struct(plain_key(e["key"]).alias("key"), e["value"].alias("value")))
    found, all_ = records.withColumn("_entries", entries), F.col("_entries")
    last = F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda x: x["key"] == e["key"]))
    plain = F.size(F.array_distinct(all_["key"])) == F.size(all_)
    return found.withColumn("_by_key", F.map_from_entries(F.when(plain, all_).otherwise(last))).drop("_entries")


def typed_rows(records: DataFrame, columns: dict[str, str], region: str | Column, keep: tuple[str, ...] = (), special: dict[str, Column] | None = None) -> DataFrame:
    """One projection from ``record`` to the catalog's columns and ``server_region``.

    Keys without a column are dropped, columns without a key are typed nulls.
    ``special`` overrides columns by expressions over the map ``_by_key``.
    """
    special = special or {}
    where = F.lit(region) if isinstance(region, str) else region
    rows = with_plain_keys(records).withColumn("_region_of", where)
    # A cell's value, its kind and its text are columns of their own: each is worked out once, whatever asks for it.
    plain = [(f"_{i}", name, sort) for i, (name, sort) in enumerate(columns.items()) if name not in special]
    given = {name: (f"_s{i}", value) for i, (name, value) in enumerate(special.items()) if name in columns}
    carry = [*keep, "_region_of"]
    rows = rows.select(*carry, *[v.alias(c) for c, v in given.values()], *[F.try_element_at("_by_key", F.lit(plain_column(name))).alias(f"{c}v") for c, name, _ in plain])
    carry += [c for c, _ in given.values()]
    rows = rows.select(*carry, *[f"{c}v" for c, _, _ in plain], *[kind(F.col(f"{c}v")).alias(f"{c}k") for c, _, _ in plain])
    rows = rows.select(*carry, *[f"{c}{x}" for c, _, _ in plain for x in "vk"], *[_text_of(F.col(f"{c}v"), F.col(f"{c}k")).alias(f"{c}t") for c, _, _ in plain])
    value = {name: _coerced(*[F.col(f"{c}{x}") for x in "vkt"], sort) for c, name, sort in plain} | {name: F.col(c) for name, (c, _) in given.items()}
    return rows.select(*keep, *[value[name].cast(_TYPES.get(sort, "variant")).alias(name) for name, sort in columns.items()], F.col("_region_of").alias("server_region"))


def archive_name(column: str = "assetbundle_name") -> Column:
    """The asset name of cards: the archive's type where it is ``res<digits>_no<digits>``.

    Tested trimmed, taken untrimmed; else a string that is not blank; else as any string.
    """
    of = lambda c: F.try_element_at("_by_key", F.lit(plain_column(c)))
    archive = coerce(F.when(kind(of("archive_display_type")) == "STRING", of("archive_display_type")), "string")
    return F.when(trimmed(archive).rlike("^res[0-9]+_no[0-9]+$"), archive).otherwise(coerce(of(column), "string"))


def united_columns(records: DataFrame) -> DataFrame:
    """``stem, column, place``: all keys that any record of a file has, in the order they are first met.

    ``records`` has ``stem, pos, record``. Keys that one record brings are in the order
    of their names. Found by partial aggregation; a file has few columns.
    """
    keys = records.select("stem", "pos", F.explode(F.map_keys(members(F.col("record")))).alias("column"))
    first = keys.groupBy("stem", "column").agg(F.min("pos").alias("_pos"))
    place = F.row_number().over(Window.partitionBy("stem").orderBy("_pos", "column")) - 1
    return first.select("stem", "column", place.alias("place"))


def replace_regions(rows: DataFrame, path: str) -> int:
    """Replace the table's partitions of the regions in ``rows``; others stay. The number of rows is returned.

    Without rows nothing is replaced. Spark stages the files and puts partitions in
    place when all tasks are done; the rows are counted as they are written.
    """
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.partitionBy("server_region").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return int(seen.get["n"])


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, for tables that declare them unique."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_reason(rows: DataFrame, standing: DataFrame | None, keys: list[str]) -> DataFrame:
    """``rows`` with ``reason``: ``repeated`` where another row has the key, ``standing`` where the table has it, else null.

    A key with a null in it is no other's. Keys are counted by partial sums and the
    standing ones met in a left semi-join of keys only, which Spark narrows by a
    Bloom filter at run time where that pays; so no key needs a task of its own.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    counted = rows.where(whole).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    known = counted.withColumn("_held", F.lit(False))
    if standing is not None:
        met = counted.join(standing.select(*[F.col(k).alias(f"_{k}") for k in keys]), [f"_{k}" for k in keys], "left_semi").withColumn("_held", F.lit(True))
        known = counted.where("_n > 1").withColumn("_held", F.lit(False)).unionByName(met)
        known = known.groupBy(*[f"_{k}" for k in keys]).agg(F.max("_n").alias("_n"), F.max("_held").alias("_held"))
    odd = known.where("_n > 1 or _held")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    reason = F.when(F.col("_n") > 1, "repeated").when(F.col("_held"), "standing")
    return rows.join(odd, same, "left").withColumn("reason", reason).drop("_n", "_held", *[f"_{k}" for k in keys])


def put_unique(run: Run, name: str, rows: DataFrame, keys: list[str]) -> None:
    """Stage the rows of a table whose ``keys`` are unique, and the others, with ``reason``, as the table ``<name>_aside``.

    Keys are unique among the rows and against the partitions that stay; those that
    ``rows`` replaces do not count. All that share a key among the rows are set aside.
    """
    from tidewright.sources.shared import materialize

    staged = materialize(rows)
    standing = run.tables.read(name)
    if standing is not None:
        replaced = staged.select(F.col("server_region").alias("_s")).distinct()
        standing = standing.join(F.broadcast(replaced), F.col("server_region").cast("string") == F.col("_s"), "left_anti")  # regions are few
    judged = materialize(with_reason(staged, standing, keys))
    run.put(name, judged.where("reason is null").drop("reason"))
    run.put(f"{name}_aside", judged.where("reason is not null"))


class IngestError(Exception):
    """Files of a run that failed; all others are taken in. ``outcomes`` has every file's."""

    def __init__(self, outcomes: list[tuple[str, str, str]]):
        failed = [f"{region}/{stem}" for region, stem, outcome in outcomes if outcome == "failed"]
        super().__init__(f"ingest failed for {len(failed)} file(s): {', '.join(failed)}")
        self.outcomes = outcomes


def ingest_regions(
    spark: SparkSession, folders: dict[str, str | None], catalog: dict[str, dict[str, str]], target: str, at_once: int = 8, run: Run | None = None
) -> list[tuple[str, str, str]]:
    """Take in the table files of all regions; ``(region, stem, outcome)`` of each, or IngestError at the end.

    ``folders`` gives a region's folder; regions without one (null or empty), and
    missing folders, are skipped. Outcomes are ``written``, ``empty`` (no objects:
    what the table has stays), ``unknown`` (no such table), ``second`` (a table's further
    file in a region: the first by name is taken in) and ``failed`` (no JSON array). A
    file's failure leaves all others alone. Files may be of any size: they are read in
    byte ranges (:mod:`tidewright.sources.json_scan`), and the driver sees their names,
    and a row a range. A table is one write of all its regions, ``at_once`` tables side by side.
    They replace partitions under ``target`` table by table; with ``run``, a run of a set of tables,
    they are staged there instead, and :meth:`Run.commit` shows all tables at once.
    """
    from tidewright.sources.files import table_files
    from tidewright.sources.json_scan import array_scan

    tables = spark.createDataFrame([(t,) for t in catalog], "table string")
    outcomes: dict[tuple[str, str], str] = {}
    work: dict[str, dict[str, tuple[str, str, str]]] = {}
    for region, folder in folders.items():
        if folder:
            for r in sorted(resolve_tables(table_files(spark, folder), tables).collect(), key=lambda r: r.stem):
                outcomes[region, r.stem] = "unknown" if r.table is None else "second"
                if r.table is not None:
                    work.setdefault(r.table, {}).setdefault(region, (r.stem, r.path, f"{folder.rstrip('/')}/{r.stem}.json"))

    def one(name: str) -> None:
        files, special = work[name], {"assetbundle_name": archive_name()} if name == "cards" else None
        stems = {region: stem for region, (stem, _, _) in files.items()}
        try:
            scan = array_scan(spark, [at for _, _, at in files.values()])
            seen = {r.path: r for r in scan.status().collect()}
            good = {region: path for region, (_, path, _) in files.items() if path in seen and seen[path].ok}
            if any(seen[path].rows for path in good.values()):
                region = F.create_map(*[F.lit(x) for region, path in good.items() for x in (path, region)])[F.col("path")]
                rows = typed_rows(scan.records().where(F.col("path").isin(*good.values())), catalog[name], region, special=special)
                if run is None:
                    replace_regions(rows, f"{target.rstrip('/')}/{name}")
                else:
                    run.put(name, rows)
        except PySparkException:
            outcomes.update({(region, stem): "failed" for region, stem in stems.items()})
            return
        for region, stem in stems.items():
            outcomes[region, stem] = "failed" if region not in good else "written" if seen[good[region]].rows else "empty"

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(inheritable_thread_target(spark)(one), sorted(work)))
    done = [(region, stem, outcome) for (region, stem), outcome in outcomes.items()]
    if any(outcome == "failed" for _, _, outcome in done):
        raise IngestError(done)
    return done
