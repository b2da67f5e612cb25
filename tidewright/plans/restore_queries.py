"""Queries of codecs and schema-driven restores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import restore as R
from tidewright.operators.ordered import OrderedRegistry
from tidewright.plans.registry import lay_file, line, query, table
from tidewright.sources import codecs
from tidewright.sources.columnar_scan import ColumnarScan
from tidewright.sources.shared import new_folder

SCHEMAS = [
    {
        "type": "record", "namespace": "shop", "name": "Customer",
        "fields": [
            {"name": "custKey", "type": "long", "msgpack_key": 0},
            {"name": "name", "type": ["null", "string"], "msgpack_key": 1},
            {"name": "costs", "msgpack_key": 3, "type": {"type": "array", "items": {"type": "record", "name": "Cost", "fields": [
                {"name": "kind", "type": "string", "msgpack_key": 0}, {"name": "amount", "type": "double", "msgpack_key": 1}]}}},
        ],
    },
    {
        "type": "record", "name": "Order",
        "fields": [{"name": "orderKey", "type": "long", "msgpack_key": "OrderKey"}, {"name": "status", "type": "string", "msgpack_key": "Status"}],
    },
    {"type": "record", "name": "Tagged", "fields": [], "msgpack_unions": {"0": "shop.Customer", "1": "Order"}},
]

_VARIANT = "variant"


def registry() -> R.Registry:
    return R.Registry(SCHEMAS)


def _positional():
    """Customers as positional arrays; a third of the names are null."""
    cost = F.to_variant_object(F.array(F.array(F.col("c_mktsegment").cast(_VARIANT), F.col("c_acctbal").cast(_VARIANT)).cast("array<variant>")))
    name = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).cast(_VARIANT)
    return F.to_variant_object(F.array(F.col("c_custkey").cast(_VARIANT), name, F.lit(7).cast(_VARIANT), cost))


def _get(v, path, kind):
    return F.try_variant_get(v, path, kind)


@query(
    "r1_r2_r5_positional",
    """SELECT c_custkey, c_custkey AS key, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, c_mktsegment AS kind, c_acctbal AS amount,
       CASE WHEN c_custkey % 3 <> 0 THEN 3 ELSE 2 END AS members FROM customer""",
)
def r2(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", registry().compile("shop.Customer")(_positional()).alias("v"))
    return rows.select(
        "c_custkey",
        _get("v", "$.custKey", "bigint").alias("key"),
        _get("v", "$.name", "string").alias("name"),
        _get("v", "$.costs[0].kind", "string").alias("kind"),
        _get("v", "$.costs[0].amount", "double").alias("amount"),
        F.size(R.members(F.col("v"))).cast("bigint").alias("members"),
    )


@query(
    "r3_r4_keyed",
    """SELECT o_orderkey, o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS extra, true AS extra_null, 4 AS members FROM orders""",
)
def r3(spark, sf_dir):
    k = F.col("o_orderkey")
    items = [F.lit("OrderKey"), k.cast(_VARIANT), F.lit("extra"), F.col("o_orderpriority").cast(_VARIANT), F.lit("void"), F.parse_json(F.lit("null"))]
    plain = F.create_map(*items, F.lit("Status"), F.lit("old").cast(_VARIANT), F.lit("status"), F.col("o_orderstatus").cast(_VARIANT))
    short = F.create_map(F.lit("OrderKey"), k.cast(_VARIANT), F.lit("extra"), F.col("o_orderpriority").cast(_VARIANT), F.lit("Status"), F.col("o_orderstatus").cast(_VARIANT), F.lit("void"), F.parse_json(F.lit("null")))
    value = F.to_variant_object(F.when(k % 2 == 0, plain).otherwise(short))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", registry().compile("Order")(value).alias("v"))
    return rows.select(
        "o_orderkey",
        _get("v", "$.orderKey", "bigint").alias("key"),
        _get("v", "$.status", "string").alias("status"),
        _get("v", "$.extra", "string").alias("extra"),
        F.is_variant_null(_get("v", "$.void", "variant")).alias("extra_null"),
        F.size(R.members(F.col("v"))).cast("bigint").alias("members"),
    )


@query(
    "r3_r4_ordered",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '{"orderKey":' || o_orderkey || ',"status":"' || o_orderstatus || '","zeta":{"b":1,"a":[2,"x"]},"extra":"' || o_orderpriority || '","void":null}'
         WHEN 1 THEN '{"orderKey":' || o_orderkey || ',"status":"own","1":"1"}' ELSE '[{"custKey":' || o_custkey || ',"name":"n\\"","costs":[{"kind":"' || o_orderstatus || '","amount":1.25}]},7]' END AS text FROM orders""",
)
def r3_ordered(spark, sf_dir):
    """Fields in the order of the schema, then what is left over in its own order; looked at as text."""
    k, quote = F.col("o_orderkey"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    keyed = F.concat(F.lit('{"zeta":{"b":1,"a":[2,"x"]},"Status":'), quote(F.col("o_orderstatus")), F.lit(', "extra":'), quote(F.col("o_orderpriority")), F.lit(',"void":null,"OrderKey":'), k, F.lit("}"))
    clash = F.concat(F.lit('{"status":"own","1":"1","Status":"lost","OrderKey":'), k, F.lit("}"))
    placed = F.concat(F.lit("[["), F.col("o_custkey"), F.lit(',"n\\"",null,[['), quote(F.col("o_orderstatus")), F.lit(",1.25]]],7]"))
    orders = OrderedRegistry(SCHEMAS)
    text = F.when(k % 3 == 0, orders.compile("Order")(keyed)).when(k % 3 == 1, orders.compile("Order")(clash)).otherwise(orders.compile({"type": "array", "items": ["null", "shop.Customer"]})(placed))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


@query(
    "r6_r7_r9_maps",
    """SELECT c_custkey, c_mktsegment AS kind, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS amount FROM customer""",
)
def r6(spark, sf_dir):
    k = F.col("c_custkey")
    cost = F.to_variant_object(F.array(F.col("c_mktsegment").cast(_VARIANT), F.when(k % 2 == 0, F.col("c_acctbal")).cast(_VARIANT)))
    value = F.to_variant_object(F.create_map(F.lit("a"), cost))
    rows = table(spark, sf_dir, "customer").select("c_custkey", registry().compile({"type": "map", "values": ["null", "Cost"]})(value).alias("v"))
    return rows.select("c_custkey", _get("v", "$.a.kind", "string").alias("kind"), _get("v", "$.a.amount", "double").alias("amount"))


@query(
    "r8_tagged_union",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 0 ELSE c_custkey % 4 END AS tag,
       CASE WHEN c_custkey % 4 IN (0, 3) THEN c_custkey END AS restored, CASE WHEN c_custkey % 4 IN (1, 2) THEN c_custkey END AS raw FROM customer""",
)
def r8(spark, sf_dir):
    k = F.col("c_custkey")
    tag = F.when(k % 4 == 3, F.lit("x").cast(_VARIANT)).otherwise((k % 4).cast(_VARIANT))
    value = F.to_variant_object(F.array(tag, F.to_variant_object(F.array(k.cast(_VARIANT)))))
    rows = table(spark, sf_dir, "customer").select("c_custkey", registry().compile("Tagged")(value).alias("v"))
    raw = F.coalesce(_get("v", "$.value[0]", "bigint"), F.lit(None).cast("bigint"))
    # An array against a record with keys only is an empty object: the order's branch (1) has no value to look at.
    return rows.select(
        "c_custkey",
        _get("v", "$.__type", "bigint").alias("tag"),
        _get("v", "$.value.custKey", "bigint").alias("restored"),
        F.when(F.col("c_custkey") % 4 == 1, F.when(F.to_json(_get("v", "$.value", "variant")) == "{}", k)).otherwise(raw).alias("raw"),
    )


@query(
    "r10_r13_tables",
    """SELECT 'customers' AS table_key, c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer UNION ALL SELECT 'nations', n_nationkey, n_name FROM nation
       UNION ALL SELECT 'compactNations', NULL, NULL UNION ALL SELECT 'other', NULL, NULL""",
)
def r10(spark, sf_dir):
    """Tables that come as arrays, as one value and in columns; the stale rows of one are replaced."""
    customers = table(spark, sf_dir, "customer").select(F.lit("customers").alias("table_key"), F.to_variant_object(F.array(_positional())).alias("value"))
    nations = table(spark, sf_dir, "nation").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    compact = nations.select(
        F.lit("compactNations").alias("table_key"),
        F.to_variant_object(F.struct(F.col("r.n_nationkey").alias("custKey"), F.col("r.n_name").alias("name"))).alias("value"),
    )
    plain = lambda key, text: spark.range(1).select(F.lit(key).alias("table_key"), F.parse_json(F.lit(text)).alias("value"))
    whole = customers.unionByName(compact).unionByName(plain("nations", '["stale","old"]')).unionByName(plain("other", '{"x":1}'))
    done = R.expand_columnar(R.restore_records(R.table_records(whole), registry(), {"customers": "shop.Customer", "other": "Order"}))
    return done.select("table_key", _get("record", "$.custKey", "bigint").alias("id"), F.when(F.col("table_key") != "compactNations", _get("record", "$.name", "string")).alias("name"))


@query(
    "r11_r12_columnar",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
       SELECT o_custkey, o_orderkey AS key, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE ['F','O','P'][1 + o_orderkey % 5] END AS status FROM o WHERE i < greatest(n - 1, 0)""",
)
def r11(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    value = F.to_variant_object(
        F.struct(
            F.lit("no array").alias("note"),
            F.col("k").alias("id"),
            F.slice(F.transform("k", lambda x: F.when(x % 5 != 4, x % 5)), 1, F.size("k") - 1).alias("status"),
            F.struct(F.array(F.lit("F"), F.lit("O"), F.lit("P")).alias("status")).alias("__ENUM__"),
        )
    )
    made = rows.select("o_custkey", F.explode(R.columnar_rows(value)).alias("r"))
    return made.select("o_custkey", _get(F.col("r")["id"], "$", "bigint").alias("key"), _get(F.col("r")["status"], "$", "string").alias("status"))


@query(
    "r14_r18_responses",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '/event/{id}/ranking-border' WHEN 1 THEN '/event/{id}/{view}' END AS template,
       CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 > 1 AND o_orderkey % 4 <> 0 THEN o_custkey END AS card, CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 5 > 1 AND o_orderkey % 4 <> 0 THEN o_orderstatus END AS status FROM orders""",
)
def r14(spark, sf_dir):
    k = F.col("o_orderkey")
    view = F.get(F.array(F.lit("ranking-border?x=1"), F.lit("top"), F.lit("top/all")), (k % 3).cast("int"))
    value = F.to_variant_object(F.struct(F.array(F.struct(F.array(F.col("o_custkey"), F.lit(30).cast("bigint")).alias("userCard"))).alias("rankings"), F.col("o_orderstatus").alias("Status")))
    method = F.when(k % 4 == 0, "post").otherwise("GET")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("//event/"), k % 50, F.lit("/"), view).alias("path"), value.alias("value"), (k % 5 > 1).alias("secondary"), method.alias("method"))
    routes = [
        {"path": "/event/{id}/ranking-border", "fields": [{"selector": "rankings[].userCard", "schema": "shop.Customer"}, {"selector": "missing.x", "schema": "Order"}]},
        {"path": "/event/{id}/{view}", "schema": "Order"},
    ]
    done = R.restore_responses(rows, registry(), routes, F.col("secondary"), "method")
    return done.select("o_orderkey", "template", _get("value", "$.rankings[0].userCard.custKey", "bigint").alias("card"), _get("value", "$.status", "string").alias("status"))


@query(
    "s5_s9_codecs",
    """SELECT c_custkey, c_custkey AS key, c_name AS name, c_acctbal AS amount, c_custkey % 2 = 0 AS bad, CASE WHEN c_custkey % 3 <> 0 THEN '{"z":1,"a":[2]}' END AS ordered, c_custkey % 7 <> 0 AS shallow FROM customer""",
)
def s5(spark, sf_dir):
    key, iv = F.unhex(F.lit("00112233445566778899aabbccddeeff")), F.unhex(F.lit("ffeeddccbbaa99887766554433221100"))
    body = codecs.json_to_msgpack(F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")))
    k = F.col("c_custkey")
    more = codecs.json_to_msgpack(F.when(k % 3 == 0, F.lit("[1]")).otherwise(F.lit('{"z":1,"a":[2]}')))
    nested = F.when(k % 7 == 0, F.lit(b"\x91" * 3000)).otherwise(F.lit(b"\x91" * 100 + b"\x01"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", codecs.encrypt(body, key, iv).alias("sent"), more.alias("more"), nested.alias("nested"))
    rows = rows.withColumn("bad", codecs.decrypt(F.substring(F.col("sent"), 1, F.length("sent") - (k + 1) % 2), key, iv).isNull())
    text = codecs.msgpack_to_json(codecs.decrypt(F.col("sent"), key, iv))
    v = rows.select(
        "c_custkey", "bad", F.from_json(text, "c_custkey bigint, c_name string, c_acctbal double").alias("v"),
        codecs.object_text(codecs.msgpack_to_json("more")).alias("ordered"), codecs.msgpack_to_json("nested").isNotNull().alias("shallow"),
    )
    return v.select("c_custkey", F.col("v.c_custkey").alias("key"), F.col("v.c_name").alias("name"), F.col("v.c_acctbal").alias("amount"), "bad", "ordered", "shallow")


@query(
    "r10_r12_row_ranges",
    """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS id, CASE WHEN o_orderkey % 5 < 3 THEN ['F','O','P'][1 + o_orderkey % 5] WHEN o_orderkey % 5 = 3 THEN 'kept' END AS status, 'a,"' || o_custkey AS customer FROM orders""",
)
def r10_ranges(spark, sf_dir):
    """All orders as one columnar file, whose columns are read and put together by ranges."""
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 3, '"kept"').when(k % 5 == 4, "9").otherwise((k % 5).cast("string"))
    columns = {"id": k.cast("string"), "status": status, "customer": F.concat(F.lit('{"of":"a,\\"'), F.col("o_custkey"), F.lit('"}'))}
    lines = line(spark, 0, '{"__ENUM__":{"status":["F","O","P"]},"note":"no array"')
    for i, (name, value) in enumerate(columns.items()):
        cells = table(spark, sf_dir, "orders").select(F.lit(3 * i + 2).alias("section"), k.cast("bigint").alias("nth"), F.concat(value, F.lit(",")).alias("value"))
        lines = lines.unionByName(line(spark, 3 * i + 1, f',"{name}":[')).unionByName(cells).unionByName(line(spark, 3 * i + 3, "null]"))
    path = f"{new_folder(spark)}/orders.json"
    lay_file(lines.unionByName(line(spark, 99, "}")), path)
    rows = ColumnarScan(spark, path).rows().where(_get("record", "$.id", "bigint").isNotNull())  # the last line is a null in each column
    return rows.select("pos", _get("record", "$.id", "bigint").alias("id"), _get("record", "$.status", "string").alias("status"), _get("record", "$.customer.of", "string").alias("customer"))
