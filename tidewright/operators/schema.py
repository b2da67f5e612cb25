"""Table definitions from a catalog, given as rows ``table, place, column, sort``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.ingest import _TYPES

#: Unique keys of tables without the regular one; an empty list means none.
UNIQUE_KEYS = {
    "areaitemlevel": ["area_item_id", "level", "server_region"],
    "cardcostume3d": ["costume3_d_id", "server_region"],
    "cardraritie": ["card_rarity_type", "server_region"],
    "eventmusic": ["event_id", "music_id", "server_region"],
    "masterlesson": ["card_rarity_type", "master_rank", "server_region"],
    "worldbloomdifferentattributebonuse": ["attribute_count", "server_region"],
    "worldbloomsupportdeckbonuse": ["card_rarity_type", "server_region"],
    "eventcard": ["card_id", "event_id", "server_region"],
    "level": ["level_type", "level", "server_region"],
    "musictag": ["music_id", "music_tag", "server_region"],
    "charactermissionv2parametergroup": ["game_id", "seq", "server_region"],
    "resourceboxe": ["resource_box_purpose", "game_id", "server_region"],
    "ngword": [],
}


def catalog_rows(spark: SparkSession, catalog: dict[str, dict[str, str]]) -> DataFrame:
    """A catalog as rows."""
    rows = [(t, i, c, s) for t, columns in catalog.items() for i, (c, s) in enumerate(columns.items())]
    return spark.createDataFrame(rows, "table string, place int, column string, sort string")


def spark_type(sort: Column) -> Column:
    """The Spark type of a catalog type; what is not known is a variant."""
    types = F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(types, sort), F.lit("variant"))


def definitions(catalog: DataFrame) -> DataFrame:
    """``table, place, column, sort, type, key``: what the tables are made of.

    The column ``id`` is ``game_id``, and ``server_region`` comes last, once. ``key``
    has the columns that tell a table's rows apart, with commas; empty if it has no
    such. A column that a table repeats counts once, where it is first.
    """
    column = F.when(F.col("column") == "id", F.lit("game_id")).otherwise(F.col("column"))
    region = F.struct(F.lit(1 << 30).alias("place"), F.lit("server_region").alias("column"), F.lit("string").alias("sort"))
    own = F.struct(F.col("place").cast("int").alias("place"), column.alias("column"), "sort")
    rows = catalog.select("table", F.explode(F.array(own, region)).alias("c")).select("table", "c.*")
    rows = rows.groupBy("table", "column").agg(F.min("place").alias("place"), F.min_by("sort", "place").alias("sort"))
    rows = rows.withColumn("place", F.when(F.col("column") == "server_region", F.lit(1 << 30)).otherwise(F.col("place")))
    has_id = rows.groupBy(F.col("table").alias("_t")).agg(F.max(F.col("column") == "game_id").alias("_id"))
    special = F.create_map(*[F.lit(x) for t, k in UNIQUE_KEYS.items() for x in (t, ",".join(k))])
    key = F.coalesce(F.try_element_at(special, F.col("table")), F.when(F.col("_id"), F.lit("game_id,server_region")), F.lit(""))
    return rows.join(has_id, F.col("table") == F.col("_t")).select("table", "place", "column", "sort", spark_type(F.col("sort")).alias("type"), key.alias("key"))


def _columns_of(defined: DataFrame) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("place", "column", "sort", "type")))  # a table has few columns
    return defined.groupBy("table", "key").agg(listed.alias("c"))


def create_statements(defined: DataFrame, location: str | None = None) -> DataFrame:
    """``table, statement``: makes a table, partitioned by region, unless it is there."""
    made = F.array_join(F.transform("c", lambda x: F.concat(F.lit("`"), x["column"], F.lit("` "), x["type"])), ", ")
    where = F.concat(F.lit(" LOCATION '"), F.lit(location.rstrip("/")), F.lit("/"), F.col("table"), F.lit("'")) if location else F.lit("")
    text = [F.lit("CREATE TABLE IF NOT EXISTS `"), F.col("table"), F.lit("` ("), made, F.lit(") USING parquet PARTITIONED BY (server_region)"), where, F.lit(" TBLPROPERTIES ('unique_key' = '"), F.col("key"), F.lit("')")]
    return _columns_of(defined).select("table", F.concat(*text).alias("statement"))


def catalog_entries(defined: DataFrame) -> DataFrame:
    """``entry``: the catalog as JSON, a row a table: ``name``, ``columns`` and ``unique_keys``."""
    columns = F.transform("c", lambda x: F.concat(x["column"], F.lit(":"), x["sort"]))
    keys = F.when(F.col("key") == "", F.array().cast("array<array<string>>")).otherwise(F.array(F.split("key", ",")))
    return _columns_of(defined).select(F.to_json(F.struct(F.col("table").alias("name"), columns.alias("columns"), keys.alias("unique_keys"))).alias("entry"))


def create_account_tables(spark: SparkSession, users: str, grants: str) -> None:
    """Make the two tables of authorization unless they are there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {users} (id string, credential string, remark string) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {grants} (user_id string, server string) USING parquet")
