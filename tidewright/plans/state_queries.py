"""Queries of state merges, authorization, routing, timed state and summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions.text import REGIONS
from tidewright.operators import state as S
from tidewright.operators.schema import create_account_tables
from tidewright.plans.registry import query, table
from tidewright.sources.shared import materialize


def _line():
    """A number that tells an order's lines apart."""
    return (F.col("l_linenumber").cast("bigint") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("seq")


def _versions(rows, key: str, blank: int):
    """A version row of each ``key``; fields are blank by turns."""
    k = F.col(key)
    text = lambda name, i: F.when((k + i) % blank == 0, " ").otherwise(F.concat(F.lit(name), k % 13)).alias(name)
    names = ("appVersion", "appHash", "dataVersion", "assetVersion", "assetHash")
    region = F.when(k == 1, "jp").when(k == 11, "en").otherwise(k.cast("string"))
    return rows.select(region.alias("region"), *[text(n, i) for i, n in enumerate(names)], (k % 3).cast("int").alias("cdnVersion"))


_FIELD = "CASE WHEN (k + {i}) % {b} = 0 THEN ' ' ELSE '{n}' || (k % 13) END"


def _merge_sql() -> str:
    names = ("appVersion", "appHash", "dataVersion", "assetVersion", "assetHash")
    side = lambda p, b: ", ".join(f"{_FIELD.format(i=i, b=b, n=n)} AS {p}{n}" for i, n in enumerate(names))
    pick = lambda a, b: f"CASE WHEN trim(coalesce({a}, '')) <> '' THEN {a} WHEN trim(coalesce({b}, '')) <> '' THEN {b} ELSE '' END"
    return f"""
    WITH o AS (SELECT c_custkey AS k, {side("o_", 2)}, c_custkey % 3 AS o_cdn FROM customer WHERE c_custkey % 4 <> 0),
    n AS (SELECT c_custkey AS k, {side("n_", 3)}, c_custkey % 3 AS n_cdn FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 6 <> 2
      UNION ALL SELECT c_custkey AS k, {side("n_", 5)}, c_custkey % 3 AS n_cdn FROM customer WHERE c_custkey % 6 = 2)
    SELECT CASE k WHEN 1 THEN 'jp' WHEN 11 THEN 'en' ELSE CAST(k AS VARCHAR) END AS region, {pick("o_appVersion", "n_appVersion")} AS appVersion, {pick("o_appHash", "n_appHash")} AS appHash,
      {pick("n_dataVersion", "o_dataVersion")} AS dataVersion, {pick("n_assetVersion", "o_assetVersion")} AS assetVersion,
      CASE WHEN n_cdn IS NULL OR k IN (1, 11) THEN {pick("n_assetHash", "o_assetHash")} ELSE n_assetHash END AS assetHash,
      coalesce(CASE WHEN n_cdn > 0 THEN n_cdn END, CASE WHEN o_cdn > 0 THEN o_cdn END, 0) AS cdnVersion
    FROM o FULL JOIN n USING (k)
    """


@query("m1_m4_merge_versions", _merge_sql())
def m1(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    old, polled = _versions(rows.where("c_custkey % 4 <> 0"), "c_custkey", 2), _versions(rows.where("c_custkey % 5 <> 0"), "c_custkey", 3)
    bundled = _versions(rows.where("c_custkey % 6 = 2"), "c_custkey", 5)
    out = S.merge_versions(old, S.preferred_versions(bundled, polled))
    return out.withColumn("cdnVersion", F.col("cdnVersion").cast("bigint"))


@query(
    "m2_m3_app_hash",
    """SELECT c_custkey::VARCHAR AS region, CASE WHEN c_custkey % 3 = 0 THEN '6.0.0' ELSE '6.1.0' END AS appVersion, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS appHash,
       c_custkey % 3 <> 0 OR c_custkey % 2 = 0 AS changed FROM customer""",
)
def m2(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", k.cast("string").alias("region"))
    current = rows.select("region", F.lit("6.0.0").alias("appVersion"), F.lit("old").alias("appHash"))
    answer = F.struct(F.lit(2).alias("seq"), F.when(k % 3 == 0, "").otherwise("6.1.9").alias("appVersion"), F.when(k % 2 == 0, "new").otherwise(" ").alias("appHash"))
    none = F.struct(F.lit(1).alias("seq"), F.lit(None).cast("string").alias("appVersion"), F.lit(None).cast("string").alias("appHash"))
    later = F.struct(F.lit(3).alias("seq"), F.lit("9.9.9").alias("appVersion"), F.lit("late").alias("appHash"))
    return S.app_hash_changes(current, rows.select("region", F.explode(F.array(none, answer, later)).alias("a")).select("region", "a.*"))


@query(
    "m5_retry",
    """SELECT c_custkey::VARCHAR AS region, c_custkey % 3 = 0 OR (c_custkey % 2 = 0 AND c_custkey % 5 <> 0) AS due, c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AS retry FROM customer""",
)
def m5(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", k.cast("string").alias("region"))
    runs = rows.where(k % 5 != 0).select("region", (k % 2 == 0).alias("failed"))
    return S.regions_to_ingest(rows.select("region", (k % 3 == 0).alias("is_new")), runs)


@query(
    "p1_authorize",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN 500 WHEN c_custkey IS NULL OR o_orderkey % 7 = 0 THEN 401 WHEN o_orderkey % 29 = 0 THEN 500 WHEN c_nationkey % 5 <> o_orderkey % 5 THEN 403 ELSE 200 END AS status
       FROM (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN -o_custkey ELSE o_custkey END AS u FROM orders) LEFT JOIN customer ON u = c_custkey""",
)
def p1(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("o_orderkey")
    region = lambda x: F.get(F.array(*map(F.lit, REGIONS)), (x % 5).cast("int"))
    user = F.when(k % 11 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    secret = lambda x: F.concat(F.lit("c"), x)
    requests = table(spark, sf_dir, "orders").select("o_orderkey", user.alias("user_id"), F.when(k % 7 == 0, "bad").otherwise(secret(F.abs(user))).alias("credential"), region(k).alias("server"))
    users = c.select(F.col("c_custkey").alias("id"), secret(F.col("c_custkey")).alias("credential"))
    users = users.unionByName(users.where("id % 2 = 0"))  # repeated ids
    grants = c.select(F.col("c_custkey").alias("user_id"), region(F.col("c_nationkey")).alias("server"))
    return S.authorize(requests, users, grants, user_fault=k % 31 == 0, grant_fault=k % 29 == 0).select("o_orderkey", F.col("status").cast("bigint").alias("status"))


@query(
    "k7_account_tables",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 401 WHEN c_custkey % 2 = 1 THEN 403 ELSE 200 END::BIGINT AS status FROM customer""",
)
def k7(spark, sf_dir):
    """The two tables made (a second time without effect), filled, and asked; the answer stays when they go."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    mark = uuid.uuid4().hex
    users, grants = f"users_{mark}", f"grants_{mark}"
    for _ in range(2):
        create_account_tables(spark, users, grants)
        if spark.table(users).isEmpty():
            c.select(key.cast("string").alias("id"), F.col("c_name").alias("credential"), F.lit(None).cast("string").alias("remark")).write.insertInto(users)
            c.where(key % 2 == 0).select(key.cast("string").alias("user_id"), F.lit("jp").alias("server")).write.insertInto(grants)
    requests = c.select("c_custkey", key.cast("string").alias("user_id"), F.when(key % 3 != 0, F.col("c_name")).alias("credential"), F.lit("jp").alias("server"))
    answered = materialize(S.authorize(requests, spark.table(users), spark.table(grants)).select("c_custkey", F.col("status").cast("bigint").alias("status")))
    for name in (users, grants):
        spark.sql(f"DROP TABLE {name}")
    return answered


@query(
    "a1_a2_summaries",
    """WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS s FROM events),
       r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM e WHERE s > 3)
       SELECT event_type, max(n) AS n, min(v) AS min, max(CASE WHEN i = floor(0.5 * (n - 1) + 0.5) THEN v END) AS p50, max(CASE WHEN i = floor(0.95 * (n - 1) + 0.5) THEN v END) AS p95,
       round(avg(v), 6) AS mean, max(v) AS max FROM r GROUP BY 1""",
)
def a1(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    kept = S.after_warm_up(rows, "event_type", "event_id", 3)
    return S.summarize(kept, "event_type", "value").withColumn("mean", F.round("mean", 6))


@query(
    "a3_composed",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity + l_discount, 6) AS cpu_new, round(l_extendedprice + l_tax + l_discount, 6) AS cpu_old FROM lineitem""",
)
def a3(spark, sf_dir):
    totals = {"cpu_new": ["l_quantity", "l_discount"], "cpu_old": ["l_extendedprice", "l_tax", "l_discount"]}
    rows = S.composed(table(spark, sf_dir, "lineitem"), totals)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(t, 6).alias(t) for t in totals])


@query(
    "a5_a6_array_diagnostics",
    "SELECT o_custkey, count(*) AS n, CASE WHEN o_custkey % 2 = 0 THEN 'BIGINT' ELSE 'STRING' END AS kind FROM orders GROUP BY o_custkey",
)
def a5(spark, sf_dir):
    from tidewright.operators.restore import elements, kind

    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("k"))
    value = F.when(F.col("o_custkey") % 2 == 0, F.to_variant_object("k")).otherwise(F.to_variant_object(F.transform("k", lambda x: x.cast("string"))))
    rows = rows.select("o_custkey", value.alias("v"))
    return rows.select("o_custkey", F.size(elements(F.col("v"))).cast("bigint").alias("n"), kind(F.get(elements(F.col("v")), F.lit(0))).alias("kind"))


@query(
    "o1_o3_routing",
    """WITH t AS (SELECT l_orderkey AS request, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS seq, l_partkey % 3 AS priority, l_partkey % 2 = 0 AS is_local, l_suppkey % 4 = 0 AS is_open,
         ['network', 'not_found', NULL, 'database'][1 + l_suppkey % 4] AS error, l_returnflag FROM lineitem),
       p AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY is_open, priority, is_local DESC, seq) AS place FROM t),
       s AS (SELECT *, min(CASE WHEN error IS NULL OR error = 'not_found' THEN place END) OVER (PARTITION BY request) AS f, max(place) OVER (PARTITION BY request) AS l FROM p)
       SELECT request, place, error FROM s WHERE place = coalesce(f, l)""",
)
def o1(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request"),
        _line(),
        (F.col("l_partkey") % 3).alias("priority"),
        (F.col("l_partkey") % 2 == 0).alias("is_local"),
        (F.col("l_suppkey") % 4 == 0).alias("is_open"),
        F.get(F.array(F.lit("network"), F.lit("not_found"), F.lit(None), F.lit("database")), (F.col("l_suppkey") % 4).cast("int")).alias("error"),
    )
    out = S.first_outcome(S.routed_order(rows))
    return out.withColumn("place", F.col("place").cast("bigint"))


@query(
    "o4_o6_round_robin",
    """WITH s AS (SELECT l_orderkey AS request, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx, l_partkey % 2 = 0 AS busy, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
       a AS (SELECT *, ((idx - request % n) + n) % n AS away FROM s)
       SELECT request, idx FROM a QUALIFY row_number() OVER (PARTITION BY request ORDER BY busy, away) = 1""",
)
def o4(spark, sf_dir):
    rows, of_order = table(spark, sf_dir, "lineitem"), Window.partitionBy("l_orderkey")
    listed = of_order.orderBy(*[F.asc_nulls_last(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")])  # one number of them would mix large keys up
    n = F.count(F.lit(1)).over(of_order)
    slots = rows.select(
        F.col("l_orderkey").alias("request"),
        (F.row_number().over(listed) - 1).cast("bigint").alias("idx"),
        (F.col("l_partkey") % 2 == 0).alias("busy"),
        (F.col("l_orderkey") % n).alias("cursor"),
        n.alias("n"),
    )
    return S.round_robin(slots)


@query("o6_first_wins", "SELECT l_orderkey, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey) AS l_partkey FROM lineitem GROUP BY 1")
def o6(spark, sf_dir):
    return S.first_wins(table(spark, sf_dir, "lineitem").withColumn("seq", _line()), "l_orderkey", "l_partkey", "seq")


@query(
    "o5_member_order",
    """SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 2147483647 END, CASE WHEN p_partkey % 3 = 1 THEN p_type ELSE p_name END, p_partkey) AS place FROM part""",
)
def o5(spark, sf_dir):
    k = F.col("p_partkey")
    order = S.member_order(F.when(k % 3 == 0, F.col("p_size")), F.when(k % 3 == 1, F.col("p_type")), F.col("p_name"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(order, k)).cast("bigint")
    return table(spark, sf_dir, "part").select("p_partkey", place.alias("place"))


@query(
    "t1_breaker",
    """WITH c AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS t, value > 20 AS failed FROM events),
       i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM c),
       f AS (SELECT *, CASE WHEN failed THEN sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, g ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS n FROM i)
       SELECT event_id, n::BIGINT AS failures, CASE WHEN n >= 3 THEN t + 30000 ELSE 0 END AS open_until FROM f""",
)
def t1(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("target"), _millis("ts").alias("ts_ms"), F.col("event_id").alias("seq"), (F.col("value") > 20).alias("failed"))
    return S.breaker_states(calls).select(F.col("seq").alias("event_id"), F.col("failures").cast("bigint").alias("failures"), "open_until")


_LEADERS = """WITH RECURSIVE c AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t, {ok} AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
       w AS (SELECT event_id, user_id, i, t, CASE WHEN ok THEN event_id END AS leader, t + {took} AS until, event_id AS led FROM c WHERE i = 1
         UNION ALL SELECT c.event_id, c.user_id, c.i, c.t, CASE WHEN w.leader IS NOT NULL AND w.until > c.t THEN w.leader WHEN c.ok THEN c.event_id END,
           CASE WHEN w.leader IS NOT NULL AND w.until > c.t THEN w.until ELSE c.t + {took} END, CASE WHEN w.leader IS NOT NULL AND w.until > c.t THEN w.leader ELSE c.event_id END
         FROM c JOIN w ON c.user_id = w.user_id AND c.i = w.i + 1)
       SELECT event_id, led AS leader{more} FROM w"""


def _millis(ts: str):
    """Milliseconds since 1970 of a timestamp without a zone."""
    c = F.col(ts)
    day = F.date_diff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    return (day * 86_400_000 + F.hour(c) * 3_600_000 + F.minute(c) * 60_000 + F.floor(F.extract(F.lit("SECOND"), c) * 1000)).cast("bigint")


def _calls(spark, sf_dir, took: int):
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("key"), F.col("event_id").alias("call"), _millis("ts").alias("start"), F.lit(took).cast("bigint").alias("took"), (F.col("value") > 20).alias("ok"))


@query("t2_t3_cache", _LEADERS.format(ok="value > 20", took=86_400_000, more=", led <> event_id AS hit"))
def t2(spark, sf_dir):
    out = S.cached(_calls(spark, sf_dir, 86_400_000))
    return out.select(F.col("call").alias("event_id"), "leader", "hit")


@query("t4_single_flight", _LEADERS.format(ok="true", took=36_000_000, more=""))
def t4(spark, sf_dir):
    return S.single_flight(_calls(spark, sf_dir, 36_000_000)).select(F.col("call").alias("event_id"), "leader")


@query(
    "t6_debounce",
    """WITH e AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 2 MINUTE THEN 0 ELSE 1 END AS cut FROM events),
       g AS (SELECT *, sum(cut) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM e)
       SELECT event_type, min(ts) AS first, max(ts) AS last, count(*) AS n FROM g GROUP BY event_type, i""",
)
def t6(spark, sf_dir):
    return S.debounced(table(spark, sf_dir, "events"), "event_type", "ts", "2 minutes")
