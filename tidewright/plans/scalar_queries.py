"""Queries of scalar functions and predicates, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import predicates as P
from tidewright.functions import text as T
from tidewright.plans.registry import query, table

_REGION_SQL = "['jp','en','tw','kr','cn'][1 + {} % 5]"


def _region(c):
    return F.get(F.array(*map(F.lit, T.REGIONS)), (c % 5).cast("int"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query(
    "f1_compare_version",
    """
    WITH v AS (SELECT o_orderkey, (o_custkey % 7) || '.' || (o_orderkey % 5) || CASE WHEN o_orderkey % 3 = 0 THEN '.0' ELSE '' END a,
      (o_orderkey % 7) || '.' || (o_custkey % 5) || CASE WHEN o_custkey % 11 = 0 THEN '.x' ELSE '' END b FROM orders)
    SELECT o_orderkey, CASE WHEN b LIKE '%x' THEN NULL ELSE
      (split_part(a,'.',1)::INT, split_part(a,'.',2)::INT) > (split_part(b,'.',1)::INT, split_part(b,'.',2)::INT) END AS newer FROM v
    """,
)
def f1(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = F.concat(c % 7, F.lit("."), k % 5, F.when(k % 3 == 0, ".0").otherwise(""))
    b = F.concat(k % 7, F.lit("."), c % 5, F.when(c % 11 == 0, ".x").otherwise(""))
    return _orders(spark, sf_dir).select("o_orderkey", T.version_newer(a, b).alias("newer"))


@query(
    "f2_effective_version",
    f"""
    WITH v AS (SELECT o_orderkey, {_REGION_SQL.format("o_orderkey")} r, CASE WHEN o_custkey % 4 = 0 THEN '6.' || (o_custkey % 9)
      ELSE '6.' || (o_custkey % 9) || '.' || (o_orderkey % 90) END v FROM orders)
    SELECT o_orderkey, CASE WHEN r IN ('jp','en') OR len(string_split(v,'.')) <> 3 THEN v
      ELSE split_part(v,'.',1) || '.' || split_part(v,'.',2) || '.0' END AS version FROM v
    """,
)
def f2(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    v = F.when(c % 4 == 0, F.concat(F.lit("6."), c % 9)).otherwise(F.concat(F.lit("6."), c % 9, F.lit("."), k % 90))
    return _orders(spark, sf_dir).select("o_orderkey", T.effective_version(_region(k), v).alias("version"))


@query(
    "f3_f4_f18_names",
    """
    SELECT p_partkey, lower(regexp_replace(n, '(.)([A-Z])', '\\1_\\2', 'g')) AS snake, lower(w) || CASE WHEN w ~ 's$' THEN '' WHEN w ~ '(ch|sh|x|z)$' THEN 'es' ELSE 's' END AS many,
      lower(n[1]) || n[2:] AS field
    FROM (SELECT p_partkey, 'Part' || 'Brand' || (p_size % 10) AS n, CASE p_partkey % 4 WHEN 0 THEN 'box' WHEN 1 THEN 'match' WHEN 2 THEN 'gas' ELSE 'card' END AS w FROM part)
    """,
)
def f3(spark, sf_dir):
    name = F.concat(F.lit("PartBrand"), F.col("p_size") % 10)
    word = F.get(F.array(*map(F.lit, ("box", "match", "gas", "card"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        T.camel_to_snake(name).alias("snake"),
        T.plural(word).alias("many"),
        T.json_field_name(F.concat(F.lit("_"), name)).alias("field"),
    )


@query(
    "f5_table_keys",
    """
    SELECT p_partkey, k AS table_key FROM (SELECT p_partkey, unnest(CASE p_partkey % 4
      WHEN 0 THEN ['card', 'cards'] WHEN 1 THEN ['card2dBox', 'card2dBoxes'] WHEN 2 THEN ['font', 'fonts', 'customProfileTextFonts'] ELSE ['rarity', 'rarities'] END) AS k FROM part)
    """,
)
def f5(spark, sf_dir):
    record = F.get(F.array(*map(F.lit, ("MasterCard", "MasterCard2DBoxModel", "MasterFont", "MasterRarity"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(T.table_keys(record)).alias("table_key"))


@query("f6_percent_encode", "SELECT p_partkey, url_encode(p_name || ' ~*/+é&' || p_type) AS encoded FROM part")
def f6(spark, sf_dir):
    text = F.concat(F.col("p_name"), F.lit(" ~*/+é&"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", T.percent_encode(text).alias("encoded"))


@query(
    "f7_f8_f9_tokens",
    """
    SELECT c_custkey, c_name AS plain, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey::VARCHAR END AS user_id,
      CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS open_id FROM customer
    """,
)
def f7(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_name")
    url = lambda c: F.regexp_replace(F.translate(T.base64_encode(c), "+/", "-_"), "=+$", "")
    body = url(F.to_json(F.struct(k.cast("string").alias("userId"), n.alias("openId"))))
    token = F.concat_ws(".", F.lit("h"), body, F.when(k % 5 != 0, F.lit("s")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        T.base64_text(url(n)).alias("plain"),
        T.jwt_field(token, "userId").alias("user_id"),
        T.wrapped_jwt_field(T.base64_encode(token), "openId").alias("open_id"),
    )


@query(
    "f10_f11_f13_f19_text",
    f"""
    SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' ELSE c_custkey::VARCHAR END AS id, r AS region, upper(r) AS label,
      'https://host/' || r || '/user/' || c_custkey AS url
    FROM (SELECT c_custkey, {_REGION_SQL.format("c_custkey")} AS r FROM customer)
    """,
)
def f10(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, "null").when(k % 3 == 1, k.cast("string")).otherwise(F.concat(F.lit('"'), k, F.lit('"')))
    path = F.concat(F.when(k % 2 == 0, F.lit("/api/")).otherwise(F.lit("/")), F.upper(_region(k)), F.lit("/system"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        T.as_text(raw).alias("id"),
        T.path_region(path).alias("region"),
        T.region_label(F.concat(F.lit(' "'), _region(k), F.lit('" '))).alias("label"),
        T.fill_template(F.lit("https://host/{region}/user/{userId}"), k.cast("string"), _region(k)).alias("url"),
    )


@query("f12_cookies", "SELECT c_custkey, 'session=' || c_name || '; token=def==' || (c_custkey % 9) AS cookie FROM customer")
def f12(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_name")
    headers = F.array(F.concat(F.lit(" session\t=\u00a0"), n, F.lit("\n; Path=/; HttpOnly; =x")), F.concat(F.lit("token=def=="), k % 9, F.lit("; Secure; SameSite=None")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.cookies(headers).alias("cookie"))


@query(
    "f14_f15_f20_formats",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '***9é' || (o_custkey % 10) WHEN length(o_custkey::VARCHAR) <= 4 THEN '****' ELSE '***' || right(o_custkey::VARCHAR, 4) END AS hidden,
      CASE WHEN us >= 1000 THEN printf('%.3f ms', us / 1000) ELSE printf('%.1f us', us) END AS took,
      CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE ' ' || o_orderstatus END AS chosen
    FROM (SELECT *, (o_orderkey % 2500)::DOUBLE AS us FROM orders)
    """,
)
def f14(spark, sf_dir):
    k = F.col("o_orderkey")
    return _orders(spark, sf_dir).select(
        "o_orderkey",
        T.redact(F.when(k % 3 == 0, F.concat(F.lit("user9é"), F.col("o_custkey") % 10)).otherwise(F.col("o_custkey").cast("string"))).alias("hidden"),
        T.duration_text((k % 2500).cast("double")).alias("took"),
        T.first_non_blank(F.when(k % 4 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" "), "o_orderstatus")), F.col("o_orderpriority")).alias("chosen"),
    )


_NAMES = ("session_error", "cookie_expired", "upgrade_required", "under_maintenance", "network", "parse", "not_found", "forbidden", "database", "odd")
_KINDS = "[" + ",".join(f"'{n}'" for n in _NAMES) + "]"


@query(
    "f16_f17_p9_p10_errors",
    f"""
    SELECT event_id, kind, CASE kind WHEN 'session_error' THEN 403 WHEN 'cookie_expired' THEN 403 WHEN 'upgrade_required' THEN 426 WHEN 'under_maintenance' THEN 503
      WHEN 'network' THEN 502 WHEN 'parse' THEN 400 WHEN 'not_found' THEN 404 WHEN 'forbidden' THEN 403 ELSE 500 END AS status,
      kind NOT IN ('under_maintenance','parse','not_found','forbidden') AS fault, kind IN ('session_error','cookie_expired','network') AS again,
      CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'conflict' END AS name
    FROM (SELECT event_id, {_KINDS}[1 + event_id % 10] AS kind FROM events)
    """,
)
def f16(spark, sf_dir):
    kinds = F.array(*map(F.lit, _NAMES))
    rows = table(spark, sf_dir, "events").select("event_id", F.get(kinds, (F.col("event_id") % 10).cast("int")).alias("kind"))
    code = F.get(F.array(F.lit(200), F.lit(409), F.lit(418)), (F.col("event_id") % 3).cast("int"))
    kind = F.col("kind")
    return rows.select(
        "event_id", "kind", P.error_status(kind).alias("status"), P.is_target_fault(kind).alias("fault"), P.is_retryable(kind).alias("again"), P.status_name(code).alias("name")
    )


@query(
    "p3_p4_p5_p11_checks",
    f"""
    SELECT event_id, event_id % 3 <> 1 AS digits, CASE WHEN r IN ('jp','en') THEN event_id % 2 = 0 ELSE event_id % 2 = 1 END AS image,
      event_id % 2 = 0 AS thumb, event_id % 4 = 3 AS safe, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS flag
    FROM (SELECT event_id, {_REGION_SQL.format("event_id")} AS r FROM events)
    """,
)
def p3(spark, sf_dir):
    k = F.col("event_id")
    pick = lambda n, *xs: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), (k % n).cast("int"))
    hash_ = F.sha2(k.cast("string"), 256)
    one = F.when(k % 2 == 0, hash_).otherwise(k.cast("string"))
    uuid = F.concat_ws("-", *[F.substring(F.upper(hash_), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return table(spark, sf_dir, "events").select(
        "event_id",
        P.digits_only(pick(3, "123", "12a", "")).alias("digits"),
        P.image_parameters(_region(k), one, one).alias("image"),
        P.thumbnail_parameters(one, uuid).alias("thumb"),
        P.safe_path_part(pick(4, "..", "a/b", "", "cards.json")).alias("safe"),
        P.flag(pick(4, None, "TRUE", "False", "yes"), True).alias("flag"),
    )


@query(
    "p6_p7_p8_versions",
    """
    SELECT o_orderkey, (a <> '' AND a <> b) OR x > y AS sync, CASE WHEN a = '' THEN false ELSE o_orderkey % 5 > o_custkey % 5 END AS newer,
      x > y AS master, x > y AND a <> '' AS asset, x > y OR (a <> '' AND a <> b) AS save
    FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '2.' || (o_orderkey % 5) END AS a, '2.' || (o_custkey % 5) AS b, o_orderkey % 3 AS x, o_custkey % 3 AS y FROM orders)
    """,
)
def p6(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a, b = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("2."), k % 5)), F.concat(F.lit("2."), c % 5)
    changes = P.cdn_changes(a, a, k % 3, b, c % 3)
    rows = _orders(spark, sf_dir).select("o_orderkey", P.needs_sync(a, b, k % 3, c % 3).alias("sync"), P.version_differs(a, b).alias("newer"), changes.alias("c"))
    return rows.select("o_orderkey", "sync", "newer", "c.*")
