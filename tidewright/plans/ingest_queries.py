"""Queries of ingest, sources, sinks and table definitions."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidewright.operators import ingest as I
from tidewright.operators import schema as S
from tidewright.plans.registry import lay_file, line, query, table
from tidewright.sources import files
from tidewright.sources.commits import Files, TableSet
from tidewright.sources.shared import new_folder

CATALOG = I.catalog_of(
    [
        {"name": "customers", "columns": ["game_id:int64", "name", "balance:float64", "active:bool", "extra:json.RawMessage"]},
        {"name": "cards", "columns": ["game_id:int64", "assetbundle_name:string"]},
        {"name": "cardrarities", "columns": ["card_rarity_type:string"]},
    ]
)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records with untidy keys and kinds, and white space of all kinds."""
    k = F.col("c_custkey")
    v = lambda c: c.cast("variant")
    id_ = F.when(k % 4 == 0, v(F.concat(F.lit("\t"), k, F.lit("\n\u00a0")))).when(k % 4 == 1, F.parse_json(F.concat(k, F.lit(".5")))).otherwise(v(k))
    active = F.when(k % 3 == 0, v(F.lit("\ttrue "))).when(k % 3 == 1, v(F.lit(False))).otherwise(v(F.lit(1)))
    balance = F.when(k % 10 == 0, v(F.lit(" Infinity"))).when(k % 10 == 1, v(F.concat(F.col("c_acctbal"), F.lit("\r\n")))).otherwise(v(F.col("c_acctbal")))
    fields = [F.lit("_id"), id_, F.lit("Name"), v(F.col("c_name")), F.lit("bal_ance"), balance, F.lit("isActive_"), v(F.lit(1)), F.lit("active"), active]
    record = F.create_map(*fields, F.lit("extra"), F.to_variant_object(F.array(F.col("c_nationkey"))))
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_variant_object(record).alias("record"))


@query(
    "i4_i6_i8_typed_rows",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_custkey END AS game_id, c_name AS name, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS balance, c_custkey % 10 = 0 AS infinite,
       CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS active, '[' || c_nationkey || ']' AS extra, 'kr' AS server_region FROM customer""",
)
def i4(spark, sf_dir):
    rows = I.typed_rows(_records(spark, sf_dir), CATALOG["customers"], "kr", keep=("c_custkey",))
    infinite = F.col("balance") == float("inf")
    return rows.withColumn("extra", F.to_json("extra")).withColumn("infinite", infinite).withColumn("balance", F.when(~F.col("infinite"), F.col("balance")))


@query(
    "i1_i2_names",
    """SELECT c_custkey, stem, CASE WHEN stem IN ('Cards', 'card') THEN 'cards' WHEN stem = 'card_rarities' THEN 'cardrarities' WHEN stem IN ('customer', 'custo_MER_s') THEN 'customers' END AS "table"
       FROM (SELECT c_custkey, ['Cards', 'card', 'card_rarities', 'card_rarity', 'nosuch', 'virtual_items', 'customer', 'custo_MER_s'][1 + c_custkey % 8] AS stem FROM customer)""",
)
def i1(spark, sf_dir):
    names = ("Cards", "card", "card_rarities", "card_rarity", "nosuch", "virtual_items", "customer", "custo_MER_s")
    stems = table(spark, sf_dir, "customer").select("c_custkey", F.get(F.array(*map(F.lit, names)), (F.col("c_custkey") % 8).cast("int")).alias("stem"))
    return I.resolve_tables(stems, S.catalog_rows(spark, CATALOG).select("table").distinct())


@query(
    "i3_united_columns",
    """SELECT 'customers' AS stem, unnest(['Name', '_id', 'active', 'bal_ance', 'extra', 'isActive_', 'Late']) AS "column", unnest([0, 1, 2, 3, 4, 5, 6]) AS place""",
)
def i3(spark, sf_dir):
    more = F.to_variant_object(F.create_map(F.lit("Late"), F.col("c_custkey")))
    rows = _records(spark, sf_dir).withColumn("stem", F.lit("customers")).withColumn("pos", F.col("c_custkey"))
    late = rows.where("c_custkey > 5").withColumn("record", more)
    return I.united_columns(rows.unionByName(late)).withColumn("place", F.col("place").cast("int"))


@query(
    "i5_i7_cards",
    """SELECT p_partkey, p_partkey AS game_id, CASE p_partkey % 3 WHEN 0 THEN 'res017_no' || p_size WHEN 1 THEN p_name END AS assetbundle_name, 'cn' AS server_region FROM part""",
)
def i7(spark, sf_dir):
    k = F.col("p_partkey")
    v = lambda c: c.cast("variant")
    kinds = [F.create_map(F.lit("id"), v(k), F.lit("_assetbundleName"), v(F.col("p_name")), F.lit("archiveDisplayType"), x) for x in (v(F.concat(F.lit("res017_no"), "p_size")), v(F.lit("normal")))]
    record = F.when(k % 3 == 0, kinds[0]).when(k % 3 == 1, kinds[1]).otherwise(F.create_map(F.lit("id"), v(k)))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.to_variant_object(record).alias("record"))
    return I.typed_rows(rows, CATALOG["cards"], "cn", keep=("p_partkey",), special={"assetbundle_name": I.archive_name()})


@query(
    "i9_i10_replace",
    """SELECT CASE c_nationkey % 2 WHEN 0 THEN 'jp' ELSE 'en' END AS server_region, count(*) AS n, sum(CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 1 END) AS v FROM customer GROUP BY 1""",
)
def i9(spark, sf_dir):
    path = new_folder(spark)
    region = F.when(F.col("c_nationkey") % 2 == 0, "jp").otherwise("en")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit(1).alias("version"), region.alias("server_region"))
    I.replace_regions(rows, path)
    I.replace_regions(rows.where("server_region = 'jp'").withColumn("version", F.lit(2)), path)
    I.replace_regions(rows.where("false"), path)
    return spark.read.parquet(path).groupBy("server_region").agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("v"))


@query("i14_unique_keys", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def i14(spark, sf_dir):
    return I.repeated_keys(table(spark, sf_dir, "orders"), ["o_custkey"])


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Lay down a small file, on whatever file system the folder is."""
    folder, _, name = path.rpartition("/")
    Files(spark, folder).put_new(name, text)


def _put_array(records: DataFrame, path: str) -> None:
    """Lay down JSON texts (``value``) as one file with one array; other elements come first."""
    spark = records.sparkSession
    body = records.select(F.lit(1).alias("section"), F.lit(0).cast("bigint").alias("nth"), F.concat(F.lit(","), "value").alias("value"))
    lay_file(line(spark, 0, '[17,"x"').unionByName(body).unionByName(line(spark, 2, "]")), path)


@query(
    "s1_s3_i12_i13_i15_regions",
    """WITH r AS (SELECT count(*) AS n FROM customer) SELECT * FROM (VALUES ('en', 'customer', 'empty', 0), ('jp', 'Customers', 'written', (SELECT n FROM r)), ('jp', 'nation', 'failed', 0), ('jp', 'nosuch', 'unknown', 0),
       ('kr', 'customer', 'second', 0), ('kr', 'Customer', 'written', (SELECT n FROM r)), ('kr', 'nation', 'written', 1)) t(region, stem, outcome, "rows")""",
)
def s1(spark, sf_dir):
    """Two runs over the folders of all regions; the second has a file that fails, one without rows, and a table's second file."""
    folder = new_folder(spark)
    records = table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("Name"))).alias("value"))
    catalog = I.catalog_of([{"name": "customers", "columns": ["game_id:int64", "name"]}, {"name": "nations", "columns": ["game_id:int64"]}])
    for path, value in (("jp/nation", "{"), ("jp/nosuch", "[]"), ("en/customer", "[5]"), ("kr/nation", '[{"id":" 1"}]'), ("kr/customer", "[]")):
        _put(spark, f"{folder}/in/{path}.json", value)
    for path in ("jp/Customers", "kr/Customer"):
        _put_array(records, f"{folder}/in/{path}.json")
    folders = {r: f"{folder}/in/{r}" for r in ("jp", "en", "kr", "tw")} | {"cn": None}
    outcomes = []
    for regions in (("kr",), ("jp", "en", "kr", "tw", "cn")):
        try:
            outcomes = I.ingest_regions(spark, {r: folders[r] for r in regions}, catalog, f"{folder}/out")
        except I.IngestError as e:
            outcomes = e.outcomes
    done = spark.createDataFrame(outcomes, "region string, stem string, outcome string")
    named = I.resolve_tables(done, S.catalog_rows(spark, catalog).select("table").distinct())
    rows = [spark.read.parquet(f"{folder}/out/{t}").groupBy(F.col("server_region").alias("_r")).agg(F.count("game_id").alias("rows")).withColumn("_t", F.lit(t)) for t in catalog]
    counted = named.join(rows[0].unionByName(rows[1]), (F.col("region") == F.col("_r")) & (F.col("table") == F.col("_t")) & (F.col("outcome") == "written"), "left")
    return counted.select("region", "stem", "outcome", F.coalesce("rows", F.lit(0)).alias("rows"))


@query(
    "s1_s2_large_arrays",
    """SELECT o_orderpriority AS server_region, o_orderkey AS game_id, o_orderstatus AS status, o_custkey AS customer FROM orders""",
)
def s1_large(spark, sf_dir):
    """All orders as one file a priority, read in byte ranges; each record has an object and a text with brackets inside."""
    folder = new_folder(spark)
    orders = table(spark, sf_dir, "orders")
    inner = F.struct(F.struct(F.col("o_custkey").alias("of")).alias("by"), F.lit('}{"[\\').alias("text"), F.array("o_orderkey").alias("keys"))
    record = F.to_json(F.struct(F.col("o_orderkey").alias("id"), inner.alias("inner"), F.col("o_orderstatus").alias("Status")))
    catalog = I.catalog_of([{"name": "orders", "columns": ["game_id:int64", "status", "inner:json.RawMessage"]}])
    folders = {}
    for priority in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        folders[priority] = f"{folder}/{priority[0]}"
        _put_array(orders.where(F.col("o_orderpriority") == priority).select(record.alias("value")), f"{folders[priority]}/orders.json")
    tables = TableSet(spark, f"{folder}/set")
    run = tables.begin()
    I.ingest_regions(spark, folders, catalog, "", run=run)
    run.commit()
    return tables.read("orders").select("server_region", "game_id", "status", F.try_variant_get("inner", "$.by.of", "bigint").alias("customer"))


@query(
    "i9_i12_commits",
    """WITH t AS (SELECT 'customers' AS "table", CASE WHEN c_nationkey % 2 = 0 THEN 'jp' ELSE 'en' END AS server_region, count(*) AS n FROM customer GROUP BY 2
         UNION ALL SELECT 'orders', CASE WHEN o_custkey % 2 = 0 THEN 'jp' ELSE 'en' END, count(*) FROM orders GROUP BY 2)
       SELECT c AS "commit", "table", server_region, n, n * CASE WHEN c = 2 AND server_region = 'jp' THEN 2 ELSE 1 END AS v FROM t, (VALUES (1), (2)) v(c)""",
)
def i9_commits(spark, sf_dir):
    """Two tables over three runs, of which the second is lost between its tables; both states that readers saw."""
    tables = TableSet(spark, new_folder(spark))
    region = lambda c: F.when(F.col(c) % 2 == 0, "jp").otherwise("en").alias("server_region")
    given = {"customers": table(spark, sf_dir, "customer").select("c_custkey", region("c_nationkey")), "orders": table(spark, sf_dir, "orders").select("o_orderkey", region("o_custkey"))}
    first, lost, second = tables.begin(), tables.begin(), tables.begin()
    for name, rows in given.items():
        first.put(name, rows.withColumn("version", F.lit(1)))
    first.commit()
    lost.put("customers", given["customers"].withColumn("version", F.lit(9)))
    for name, rows in given.items():
        second.put(name, rows.where("server_region = 'jp'").withColumn("version", F.lit(2)))
    second.commit()
    tables.sweep(keep=2, older_s=0)
    seen = [tables.read(name, c).groupBy("server_region").agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("v")).select(F.lit(c).alias("commit"), F.lit(name).alias("table"), "server_region", "n", "v") for c in (1, 2) for name in given]
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3])


@query(
    "i14_enforced",
    """WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 3 = 0 AS old FROM orders), n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM o WHERE NOT old AND o_orderkey % 7 <> 0), s AS (SELECT DISTINCT o_custkey FROM (SELECT o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM o WHERE old) WHERE n = 1)
       SELECT o_orderkey, CASE WHEN n > 1 THEN 'repeated' WHEN o_custkey IN (SELECT o_custkey FROM s) THEN 'standing' ELSE 'written' END AS outcome FROM n
       UNION ALL SELECT o_orderkey, 'written' FROM o WHERE NOT old AND o_orderkey % 7 = 0
       UNION ALL SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN 'repeated' ELSE 'written' END FROM o WHERE old""",
)
def i14_enforced(spark, sf_dir):
    """A table with one order a customer, taken in over two runs; null keys are nobody's, and what breaks the rule is set aside."""
    tables = TableSet(spark, new_folder(spark))
    orders = table(spark, sf_dir, "orders")
    old = F.col("o_orderkey") % 3 == 0
    key = F.when(old | (F.col("o_orderkey") % 7 != 0), F.col("o_custkey")).alias("customer")
    for region, rows in (("en", orders.where(old)), ("jp", orders.where(~old))):
        run = tables.begin()
        I.put_unique(run, "firsts", rows.select("o_orderkey", key, F.lit(region).alias("server_region")), ["customer"])
        run.commit()
    aside = tables.read("firsts_aside")
    return tables.read("firsts").select("o_orderkey", F.lit("written").alias("outcome")).unionByName(aside.select("o_orderkey", F.col("reason").alias("outcome")))


@F.arrow_udf(BinaryType())
def _bundle(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A tar file for each number: garbage, without tables, or with some and a version; one is cut short."""

    def one(k: int) -> bytes:
        if k % 5 == 0:
            return b"no tar" * 300
        out, names = io.BytesIO(), ["notes.txt", "nested/x.json", ".hidden.json"]
        names += [f"t{i}.json" for i in range(k % 3 + 1)] + ["version.json"] if k % 5 != 1 else []
        with tarfile.open(fileobj=out, mode="w") as tar:
            for name in names:
                data = f'[{{"id":{k}}}]'.encode()
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return out.getvalue()

    for column in batches:
        yield pa.array([one(k) for k in column.to_pylist()], pa.binary())


@query(
    "s10_bundles",
    """SELECT s_suppkey::VARCHAR AS path, CASE WHEN s_suppkey % 5 IN (0, 1) THEN 0 ELSE s_suppkey % 3 + 1 END AS files, CASE WHEN s_suppkey % 5 > 1 THEN '[{"id":' || s_suppkey || '}]' END AS version,
       CASE s_suppkey % 5 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'the bundle has no files' END AS error FROM supplier""",
)
def s10(spark, sf_dir):
    k = F.col("s_suppkey")
    bundles = table(spark, sf_dir, "supplier").select(k.cast("string").alias("path"), _bundle(k).alias("content"))
    status = files.bundle_status(bundles, files.bundle_members(bundles, "version.json"))
    return status.withColumn("error", F.when(F.col("error").startswith("ReadError"), "unreadable").otherwise(F.col("error")))


@query(
    "s11_s12_s13_sources",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '1.' || c_nationkey ELSE '' END AS app, CASE c_custkey % 3 WHEN 0 THEN 3 ELSE 0 END AS cdn,
       CASE c_custkey % 3 WHEN 2 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS accounts, CASE WHEN c_custkey % 2 = 0 THEN 'file' ELSE 'url' END AS source FROM customer""",
)
def s11(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.to_json(F.struct(F.concat(F.lit("1."), "c_nationkey").alias("appVersion"), F.lit(3).alias("cdnVersion")))).when(k % 3 == 1, '[{"a":1},2,{"b":1}]').otherwise("{bad")
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.alias("value"))
    counted = files.accounts_of(rows.select(k.alias("stem"), "value")).groupBy(F.col("stem").alias("s")).agg(F.count(F.lit(1)).alias("accounts"))
    hits = rows.select("c_custkey", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.when(k % 2 == 0, "file").alias("source")), F.struct(F.lit(2).alias("seq"), F.lit("url").alias("source")))).alias("h"))
    first = files.first_hit(hits.select(k.alias("h_key"), "h.*"), "h_key", "seq", "source").drop("seq")
    v = files.version_of(F.col("value"))
    out = rows.join(counted, k == F.col("s"), "left").join(first, k == F.col("h_key"))
    return out.select("c_custkey", v["appVersion"].alias("app"), v["cdnVersion"].cast("bigint").alias("cdn"), F.coalesce("accounts", F.lit(0)).cast("bigint").alias("accounts"), "source")


@query(
    "k1_k3_a4_write_tables",
    """SELECT n_name AS table_key, n_nationkey::BIGINT AS id, CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END AS version, 'written' AS outcome FROM nation
       UNION ALL SELECT * FROM (VALUES ('..', NULL, NULL, 'skipped'), ('a/b', NULL, NULL, 'skipped'))""",
)
def k1(spark, sf_dir):
    """Written, some tables written again, and read back."""
    folder = new_folder(spark)
    value = lambda v: F.to_variant_object(F.array(F.struct(F.col("n_nationkey").cast("bigint").alias("id"), F.lit(v).alias("version"))))
    good = table(spark, sf_dir, "nation").select(F.col("n_name").alias("table_key"), "n_regionkey", value(1).alias("value"), value(2).alias("again"))
    bad = spark.createDataFrame([("..",), ("a/b",)], "table_key string").withColumn("value", F.parse_json(F.lit("[]")))
    first = files.write_tables(good.select("table_key", "value").unionByName(bad), folder)
    files.write_tables(good.where("n_regionkey = 1").select("table_key", F.col("again").alias("value")), folder)
    read = files.read_tables(spark, folder).select(F.col("table_key").alias("_k"), F.try_variant_get("value", "$[0].id", "bigint").alias("id"), F.try_variant_get("value", "$[0].version", "int").alias("version"))
    return first.join(read, F.col("table_key") == F.col("_k"), "left").select("table_key", "id", "version", "outcome")


@query(
    "k4_versions",
    """SELECT 'current' AS kind, n_name AS region, CASE WHEN n_nationkey % 2 = 0 THEN '2.' ELSE '1.' END || n_regionkey AS version FROM nation
       UNION ALL SELECT 'snapshot', n_name, '1.' || n_regionkey FROM nation UNION ALL SELECT 'snapshot', n_name, '2.' || n_regionkey FROM nation WHERE n_nationkey % 2 = 0
       UNION ALL SELECT 'current', 'odd', '../x'""",
)
def k4(spark, sf_dir):
    """Current versions and their history after two rounds; one version is no file name."""
    folder = new_folder(spark)
    rows = table(spark, sf_dir, "nation")
    version = lambda v: F.concat(F.lit(f"{v}."), "n_regionkey").alias("dataVersion")
    files.write_versions(rows.select(F.col("n_name").alias("region"), version(1)), folder)
    odd = spark.createDataFrame([("odd", "../x")], "region string, dataVersion string")
    files.write_versions(rows.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("region"), version(2)).unionByName(odd), folder)
    read = lambda name, kind: spark.read.parquet(f"{folder}/{name}").select(F.lit(kind).alias("kind"), "region", F.col("dataVersion").alias("version"))
    return read("current", "current").unionByName(read("snapshots", "snapshot"))


@query(
    "g3_g6_definitions",
    """WITH t AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey = 3 THEN 'ngword' WHEN s_suppkey = 4 THEN 'musictag' ELSE 't' || s_suppkey END AS t FROM supplier),
       c AS (SELECT t, k, unnest(['name', 'score', 'raw', 'odd', 'server_region']) AS c, unnest(['string', 'double', 'variant', 'variant', 'string']) AS y FROM t UNION ALL SELECT t, k, 'game_id', 'bigint' FROM t WHERE k % 3 = 0)
       SELECT t AS "table", c AS "column", y AS "type", CASE WHEN k = 3 THEN '' WHEN k = 4 THEN 'music_id,music_tag,server_region' WHEN k % 3 = 0 THEN 'game_id,server_region' ELSE '' END AS key,
         (k % 3 = 0)::INT + 5 AS columns FROM c""",
)
def g3(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k == 3, "ngword").when(k == 4, "musictag").otherwise(F.concat(F.lit("t"), k))
    column = lambda i, c, s: F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.lit(s).alias("sort"))
    some = F.array(column(1, "name", "string"), column(2, "score", "float64"), column(3, "raw", "json.RawMessage"), column(4, "odd", "unheard"))
    columns = F.when(k % 3 == 0, F.concat(F.array(column(0, "id", "int64")), some)).otherwise(some)
    catalog = table(spark, sf_dir, "supplier").select(name.alias("table"), F.explode(columns).alias("c")).select("table", "c.*")
    defined = S.definitions(catalog)
    # The statements and the JSON, taken apart again.
    entries = S.catalog_entries(defined).select(F.from_json("entry", "name string, columns array<string>, unique_keys array<array<string>>").alias("e"))
    entries = entries.select(F.col("e.name").alias("_n"), F.size("e.columns").alias("columns"), F.col("e.unique_keys").alias("keys"))
    made = S.create_statements(defined).select(F.col("table").alias("_s"), "statement")
    both = defined.join(entries, F.col("table") == F.col("_n")).join(made, F.col("table") == F.col("_s"))
    right = F.col("statement").contains(F.concat(F.lit("`"), "column", F.lit("` "), "type")) & (F.coalesce(F.array_join(F.get("keys", F.lit(0)), ","), F.lit("")) == F.col("key"))
    return both.where(right).select("table", "column", "type", "key", "columns")
