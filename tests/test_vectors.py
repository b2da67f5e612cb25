"""Small cases of functions and operators.

Fixed values: the inputs and results of versions, content versions, regions in
paths, cookies, card names and version merges have to be these.
"""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from tidewright.functions import predicates as P
from tidewright.functions import text as T
from tidewright.operators import ingest, ranges, restore, schema, state
from tidewright.sources import codecs, files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def js(spark, value):
    return F.parse_json(F.lit(json.dumps(value)))


# The cases below, in this order, are given; results must be these.
@pytest.mark.parametrize("a,b,want", [("6.0.0.1", "6.0.0", True), ("6.0", "6.0.0", False), ("10.0", "9.9", True), ("a", "1", None), ("", "1", None)])
def test_version_newer(spark, a, b, want):
    assert one(spark, T.version_newer(F.lit(a), F.lit(b))) is want


@pytest.mark.parametrize(
    "region,v,want", [("tw", "6.0.2", "6.0.0"), ("kr", "3.4.99", "3.4.0"), ("jp", "6.0.2", "6.0.2"), ("cn", "6.0", "6.0"), ("cn", "invalid", "invalid")]
)
def test_effective_version(spark, region, v, want):
    assert one(spark, T.effective_version(F.lit(region), F.lit(v))) == want


@pytest.mark.parametrize(
    "a,b,c,d,want", [("2.0.0.1", "1.0.0.1", 0, 0, True), ("1.0.0.1", "2.0.0.1", 0, 0, True), ("1.0.0.1", "1.0.0.1", 5, 4, True), ("1", "1", 0, 0, False), ("", "1", 0, 0, False)]
)
def test_needs_sync(spark, a, b, c, d, want):
    assert one(spark, P.needs_sync(F.lit(a), F.lit(b), F.lit(c), F.lit(d))) is want


def test_cdn_changes(spark):
    case = lambda *x: tuple(one(spark, P.cdn_changes(*map(F.lit, x))))
    assert case("", "", 159, "d", 159) == (False, False, False)
    assert case("", " ", 160, "d", 159) == (True, False, True)


def test_text_functions(spark):
    lit = F.lit
    assert [one(spark, T.plural(lit(w))) for w in ("box", "city", "day", "gas", "match", "card")] == ["boxes", "cities", "days", "gas", "matches", "cards"]
    assert [one(spark, T.path_region(lit(p))) for p in ("/api/jp/system", "/jp/system", "/", "/api", "/image/tw/x/1/2")] == ["jp", "jp", "", "", "tw"]
    cookies = F.array(lit("session=abc; Path=/; HttpOnly"), lit("token=def==; Secure; SameSite=None"))
    assert one(spark, T.cookies(cookies)) == "session=abc; token=def=="
    assert one(spark, T.redact(lit("1234"))) == "****" and one(spark, T.redact(lit("12345"))) == "***2345"
    assert one(spark, T.redact(lit("ééééé"))) == "***éé" and one(spark, T.redact(lit("aaaa日本"))).startswith("***")
    assert one(spark, T.trimmed(lit(" \t\n\u00a0x y\u2003\r\n"))) == "x y" and one(spark, T.is_blank(lit("\u3000\t")))
    assert one(spark, T.duration_text(lit(1000.0))) == "1.000 ms" and one(spark, T.duration_text(lit(999.94))) == "999.9 us"
    assert one(spark, T.percent_encode(lit("a b~*é"))) == "a%20b~%2A%C3%A9"
    assert one(spark, T.camel_to_snake(lit("assetbundleName2D"))) == "assetbundle_name2_d"
    assert one(spark, T.base64_text(lit("!!"))) is None
    assert one(spark, T.table_keys(lit("MasterResource"))).index("customProfileShapeResources") > 1
    assert [one(spark, T.as_text(lit(x))) for x in ("null", "5", '"a"')] == ["", "5", "a"]


def test_coercion(spark):
    got = lambda v, t: one(spark, ingest.coerce(js(spark, v), t))
    assert [got(v, "int64") for v in (1.5, " 12 ", "1.5", "1e3", 9223372036854775808, True, "not an integer")] == [None, 12, None, None, None, None, None]
    assert one(spark, ingest.coerce(F.parse_json(F.lit("1.0")), "int64")) is None
    assert [got(v, "bool") for v in (True, " true ", "TRUE", 1, "1", "yes")] == [True, True, None, None, None, None]
    assert [got(v, "string") for v in (True, [1, 2], None, "x")] == ["true", "[1,2]", None, "x"]
    assert [got(v, "float64") for v in (1, " 2.5e1 ", "x", True)] == [1.0, 25.0, None, None]
    assert got({"param1": [1, 2, 3]}, "int64") is None
    assert [got(v, "int64") for v in ("\t12\n", "\u00a0-7\u3000", "1 2", "")] == [12, -7, None, None]
    assert [got(v, "bool") for v in ("\ttrue", "false\r\n")] == [True, False]
    assert [got(v, "float64") for v in ("inf", " -Infinity\n", "+INF", "1.", ".5", "infin")] == [float("inf"), float("-inf"), float("inf"), 1.0, 0.5, None]
    assert str(got("NaN", "float64")) == "nan"


def test_key_normalisation(spark):
    keys = ["_assetbundleName", "assetbundleName", "assetbundle_name", "id", "_id"]
    assert [one(spark, ingest.plain_key(F.lit(k))) for k in keys] == ["assetbundlename"] * 3 + ["gameid"] * 2


def test_repeated_keys_of_a_record(spark):
    row = spark.range(1).select(js(spark, {"id": 1, "_id": 2, "name": "n"}).alias("record"))
    got = ingest.typed_rows(row, {"game_id": "int64", "name": "string", "none": "bool"}, "jp").first()
    assert (got.game_id in (1, 2), got.name, got.none, got.server_region) == (True, "n", None, "jp")


def test_positional_without_places_is_empty(spark):
    r = restore.Registry([{"type": "record", "name": "K", "fields": [{"name": "a", "type": "int"}]}])
    assert one(spark, F.to_json(r.compile("K")(js(spark, [1])))) == "{}"
    assert one(spark, F.to_json(r.compile("K")(js(spark, 5)))) == "5"
    assert one(spark, F.to_json(r.compile("Unknown")(js(spark, [1])))) == "[1]"


def test_keyed_record_keeps_what_is_left(spark):
    r = restore.Registry([{"type": "record", "name": "K", "fields": [{"name": "id", "type": "int", "msgpack_key": "Id"}, {"name": "none", "type": "int"}]}])
    got = json.loads(one(spark, F.to_json(r.compile("K")(js(spark, {"Id": 1, "unknownPascal": True, "left": None, "none": None})))))
    assert got == {"id": 1, "unknownPascal": True, "left": None}


def test_columnar_edges(spark):
    rows = lambda v: json.loads(one(spark, F.to_json(restore.columnar_rows(js(spark, v)))))
    assert len(rows({"a": [1, 2, 3], "b": [1, 2]})) == 2 and rows({"a": 1}) == []
    got = rows({"k": [5, -1, "x", 0, None], "__ENUM__": {"k": ["a", "b"]}})
    assert [r.get("k") for r in got] == [None, -1, "x", "a", None]


def test_selector_misses_change_nothing(spark):
    r = restore.Registry([{"type": "record", "name": "C", "fields": [{"name": "id", "type": "int", "msgpack_key": 0}]}])
    value = {"a": {"b": 1}, "rows": [{"c": [7]}, 5]}
    at = lambda s: json.loads(one(spark, F.to_json(restore.apply_at(js(spark, value), s, r.compile("C")))))
    assert at("rows[].c")["rows"] == [{"c": {"id": 7}}, 5]
    assert at("nosuch[].c") == value and at("a.b.c") == value and at("a[].b") == value


def test_msgpack(spark):
    data = bytes([0x84, 0x00, 0xA5]) + b"alpha" + bytes([0x01, 0x92, 0x0A, 0x14, 0xA4]) + b"name" + bytes([0xA3]) + b"bob" + bytes([0xA3]) + b"bin" + bytes([0xC4, 2, 0xDE, 0xAD])
    assert json.loads(codecs.unpack(data)) == {"0": "alpha", "1": [10, 20], "name": "bob", "bin": "3q0="}
    for value in ({"a": 1, "b": [2, 3], "c": "hello"}, [-1, -33, 200, 70000, 2**40, 1.5, None, True], "x" * 40, list(range(20))):
        assert json.loads(codecs.unpack(codecs.pack(value))) == value
    assert json.loads(codecs.unpack(b"\x91" * codecs.DEPTH + b"\x05"))
    for bad in (b"", b"\xc1", b"\x92\x01", b"\xcb" + b"\x7f\xf0" + b"\0" * 6, b"\x91" * 3000, b"\x81\x01" * 3000):
        with pytest.raises(ValueError):
            codecs.unpack(bad)


def test_deep_payloads_do_not_fail_the_job(spark):
    rows = spark.createDataFrame([(b"\x91" * 3000,), (b"\x05",)], "b binary").select(codecs.msgpack_to_json("b").alias("x"))
    assert [r.x for r in rows.collect()] == [None, "5"]
    assert one(spark, codecs.json_to_msgpack(F.lit("[" * 5000 + "]" * 5000))) is None
    assert [one(spark, codecs.object_text(F.lit(x))) for x in ('{"b":1,"a":2}', "[1]", "x")] == ['{"b":1,"a":2}', None, None]


def test_decrypt_bad_lengths(spark):
    key, iv = F.unhex(F.lit("00112233445566778899aabbccddeeff")), F.unhex(F.lit("ffeeddccbbaa99887766554433221100"))
    for body in (b"", b"123", b"0123456789abcdef"):
        assert one(spark, codecs.decrypt(F.lit(body), key, iv)) is None
    assert bytes(one(spark, codecs.decrypt(codecs.encrypt(F.lit(b"hello"), key, iv), key, iv))) == b"hello"


def test_summary_ranks(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", None)], "k string, v double")
    got = {r.k: r for r in state.summarize(rows, "k", "v").collect()}
    assert (got["a"].n, got["a"].min, got["a"].p50, got["a"].mean, got["a"].p95, got["a"].max) == (10, 1.0, 6.0, 5.5, 10.0, 10.0)
    assert tuple(got["b"])[1:] == (0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_merge_keeps_other_columns_and_blank_hashes(spark):
    cols = "region string, appVersion string, appHash string, dataVersion string, assetVersion string, assetHash string, cdnVersion int"
    old = spark.createDataFrame([("cn", "6.0.2", "app-hash", "6.0.0.48", "6.0.0.1", "stale", 159, "kept"), ("jp", "1", "h", "d", "a", "hash", 0, "k")], cols + ", more string")
    new = spark.createDataFrame([("cn", "", "", "", "", "", 0), ("jp", "", "", "", "", "", 0)], cols)
    got = {r.region: r for r in state.merge_versions(old, new).collect()}
    assert tuple(got["cn"])[1:] == ("6.0.0", "app-hash", "6.0.0.48", "6.0.0.1", "", 159, "kept")
    assert got["jp"].assetHash == "hash"


def test_breaker(spark):
    calls = [("t", i, i * 1000, True) for i in range(3)] + [("t", 3, 3000, False), ("t", 4, 4000, True)]
    got = state.breaker_states(spark.createDataFrame(calls, "target string, seq bigint, ts_ms bigint, failed boolean")).orderBy("seq").collect()
    assert [(r.failures, r.open_until) for r in got] == [(1, 0), (2, 0), (3, 32000), (0, 0), (1, 0)]


def naive_leaders(calls, stored):
    out, state = {}, {}
    for key, call, start, took, ok in sorted(calls, key=lambda c: (c[0], c[2], c[1])):
        leader, until = state.get(key, (None, None))
        if leader is not None and until > start:
            out[key, call] = leader
        else:
            out[key, call] = call
            state[key] = (call if stored(ok) else None, start + took)
    return out


def test_leaders_and_breakers_over_many_ranges(spark, monkeypatch):
    import random

    monkeypatch.setattr(ranges, "EACH", 20)
    monkeypatch.setattr(ranges.ranged, "__defaults__", ("_range", 20))
    rng = random.Random(5)
    calls = [(rng.choice("aaaab"), i, rng.randrange(0, 400), rng.choice([0, 1, 7, 40]), rng.random() < 0.7) for i in range(300)]
    df = spark.createDataFrame(calls, "key string, call bigint, start bigint, took bigint, ok boolean")
    assert {(r.key, r.call): r.leader for r in state.cached(df).collect()} == naive_leaders(calls, lambda ok: ok)
    assert {(r.key, r.call): r.leader for r in state.single_flight(df).collect()} == naive_leaders(calls, lambda ok: True)
    assert state.cached(df.where("false")).count() == 0
    # The same call numbers in two keys stay apart.
    twice = df.where("key = 'a'").unionByName(df.where("key = 'a'").withColumn("key", F.lit("c")))
    assert state.single_flight(twice).count() == twice.count()
    steps = df.select(F.col("key").alias("target"), F.col("start").alias("ts_ms"), F.col("call").alias("seq"), F.col("ok").alias("failed"))
    want, failures = {}, {}
    for key, call, _, _, failed in sorted(calls, key=lambda c: (c[2], c[1])):
        failures[key] = failures.get(key, 0) + 1 if failed else 0
        want[call] = failures[key]
    assert {r.seq: r.failures for r in state.breaker_states(steps).collect()} == want
    got = state.summarize(df, "key", "start").collect()
    for r in got:
        v = sorted(c[2] for c in calls if c[0] == r.key)
        assert (r.n, r.p50, r.p95) == (len(v), v[int(0.5 * (len(v) - 1) + 0.5)], v[int(0.95 * (len(v) - 1) + 0.5)])
    spans = df.select("key", F.timestamp_seconds("start").alias("ts"))
    runs = sorted((r.key, r["first"].timestamp(), r["last"].timestamp(), r.n) for r in state.debounced(spans, "key", "ts", "3 seconds").collect())
    plain = []
    for key in "ab":
        for t in sorted(c[2] for c in calls if c[0] == key):
            if plain and plain[-1][0] == key and t - plain[-1][2] < 3:
                plain[-1] = (key, plain[-1][1], t, plain[-1][3] + 1)
            else:
                plain.append((key, t, t, 1))
    assert runs == sorted(plain)


def test_open_mode(spark):
    requests = spark.createDataFrame([("u", "c", "jp")], "user_id string, credential string, server string")
    assert state.authorize(requests, None, None, open_mode=True).first().status == 200


def test_authorization_of_repeated_users_and_faults(spark):
    requests = spark.createDataFrame([(i, "u", "c", "jp") for i in range(4)], "id int, user_id string, credential string, server string")
    users = spark.createDataFrame([("u", "c"), ("u", "c")], "id string, credential string")
    grants = spark.createDataFrame([("u", "jp"), ("u", "jp")], "user_id string, server string")
    got = state.authorize(requests, users, grants, user_fault=F.col("id") == 1, grant_fault=F.col("id") == 2)
    assert sorted((r.id, r.status) for r in got.collect()) == [(0, 200), (1, 500), (2, 500), (3, 200)]


def bundle(names):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name in names:
            info = tarfile.TarInfo(name)
            info.size = 2
            tar.addfile(info, io.BytesIO(b"[]"))
    return out.getvalue()


def test_bundle_members(spark, tmp_path):
    names = ("events.json", "cards.json", "nested/escape.json", "not_json.txt", ".hidden.json", "version.json")
    (tmp_path / "b.tar").write_bytes(bundle(names))
    (tmp_path / "empty.tar").write_bytes(bundle([]))
    (tmp_path / "bad.tar").write_bytes(b"x" * 2000)
    (tmp_path / "cut.tar").write_bytes(bundle(["a.json", "b.json"])[:1540])
    tars = spark.read.format("binaryFile").load(str(tmp_path))
    members = files.bundle_members(tars, "version.json")
    whole = [r for r in members.collect() if r.path.endswith("/b.tar")]
    assert sorted((r.name, r.is_version) for r in whole) == [("cards.json", False), ("events.json", False), ("version.json", True)]
    status = {r.path.rsplit("/", 1)[1]: (r.files, r.error is None) for r in files.bundle_status(tars, members).collect()}
    assert status["b.tar"] == (2, True) and status["empty.tar"] == (0, False) and status["bad.tar"] == (0, False) and not status["cut.tar"][1]


def test_ingest_regions(spark, tmp_path):
    for region in ("jp", "kr"):
        (tmp_path / region).mkdir()
        (tmp_path / region / "Cards.json").write_text('[{"id":1,"assetbundleName":"localized title","archiveDisplayType":"res017_no037"},{"id":"2"},7]')
    (tmp_path / "jp" / "nosuch.json").write_text("[]")
    (tmp_path / "jp" / "customers.json").write_text("{")
    folders = {"jp": str(tmp_path / "jp"), "en": None, "tw": str(tmp_path / "missing"), "kr": str(tmp_path / "kr")}
    catalog = ingest.catalog_of([{"name": "cards", "columns": ["game_id:int64", "assetbundle_name"]}, {"name": "customers", "columns": ["game_id:int64"]}])
    target = str(tmp_path / "out")
    with pytest.raises(ingest.IngestError, match="jp/customers") as failed:
        ingest.ingest_regions(spark, folders, catalog, target)
    assert sorted(failed.value.outcomes) == [("jp", "Cards", "written"), ("jp", "customers", "failed"), ("jp", "nosuch", "unknown"), ("kr", "Cards", "written")]
    (tmp_path / "jp" / "customers.json").unlink()
    (tmp_path / "jp" / "Cards.json").write_text("[]")
    assert ("jp", "Cards", "empty") in ingest.ingest_regions(spark, folders, catalog, target)
    rows = spark.read.parquet(f"{target}/cards").orderBy("server_region", "game_id").collect()
    assert [(r.server_region, r.game_id, r.assetbundle_name) for r in rows] == [(s, i, a) for s in ("jp", "kr") for i, a in ((1, "res017_no037"), (2, None))]
    assert files.json_files(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "a+b c.json").write_text("[{}]")
    assert [r.stem for r in files.file_stems(spark, str(tmp_path / "odd")).collect()] == ["a+b c"]


def test_names_of_tables(spark):
    stems = spark.createDataFrame([(s,) for s in ("Cards", "card", "card_rarities", "nosuch", "box", "virtual_items", "Character_Profiles")], "stem string")
    tables = spark.createDataFrame([(t,) for t in ("cards", "cardrarities", "boxes", "virtualitems")], "table string")
    got = {r.stem: r.table for r in ingest.resolve_tables(stems, tables).collect()}
    assert got == {"Cards": "cards", "card": "cards", "card_rarities": "cardrarities", "nosuch": None, "box": "boxes", "virtual_items": None, "Character_Profiles": None}


def test_templates(spark):
    routes = ["/event/{id}/ranking-border", "/event/{id}/{view}", "/a.b", "/"]
    best = lambda p: one(spark, restore.best_template(F.lit(p), routes))
    assert [best(p) for p in ("/event/1/ranking-border?x=/y", "event//1/top/", "/event/1", "/aXb", "/a.b", "", "//")] == [routes[0], routes[1], None, None, routes[2], "/", "/"]


def test_definitions(spark):
    catalog = {"cards": {"id": "int64", "name": "string", "extra": "json.RawMessage"}, "ngword": {"id": "int64"}, "gamecards": {"game_id": "int64", "server_region": "string"}}
    defined = schema.definitions(schema.catalog_rows(spark, catalog))
    for r in schema.create_statements(defined).collect():
        spark.sql(r.statement)
    assert spark.table("cards").columns == ["game_id", "name", "extra", "server_region"]
    keys = {r.table: r.key for r in defined.collect()}
    assert keys == {"cards": "game_id,server_region", "ngword": "", "gamecards": "game_id,server_region"}
    entries = {e["name"]: e for e in (json.loads(r.entry) for r in schema.catalog_entries(defined).collect())}
    assert entries["gamecards"] == {"name": "gamecards", "columns": ["game_id:int64", "server_region:string"], "unique_keys": [["game_id", "server_region"]]}
    schema.create_account_tables(spark, "users_t", "grants_t")
    assert spark.table("grants_t").columns == ["user_id", "server"]


ORDERED = [
    ({"type": "array", "items": "long"}, "[3, 1,\n2]", "[3,1,2]"),
    ("Order", '{"b":1.25,"Status":"x","a":{"z":1,"y":[true,null]},"OrderKey":1}', '{"orderKey":1,"status":"x","b":1.25,"a":{"z":1,"y":[true,null]}}'),
    ("Order", '{"status":"own","OrderKey":null,"Status":"lost"}', '{"status":"own"}'),
    ("Order", "[1,2]", "{}"),
    ("Order", "7", "7"),
    ("shop.Customer", '[1,null,9,[["a\\"b",2]]]', '{"custKey":1,"costs":[{"kind":"a\\"b","amount":2}]}'),
    ("Tagged", "[0,[5]]", '{"__type":0,"value":{"custKey":5}}'),
    ("Tagged", '["x",[5,"1"]]', '{"__type":0,"value":{"custKey":5,"name":"1"}}'),
    ("Tagged", "[9,[5]]", '{"__type":9,"value":[5]}'),
    ("Tagged", "[1]", "[1]"),
    ({"type": "map", "values": ["null", "Order"]}, '{"b":{"OrderKey":"1"},"a":null}', '{"b":{"orderKey":"1"},"a":null}'),
]


def test_ordered_restores_as_text(spark):
    from tidewright.operators.ordered import OrderedRegistry
    from tidewright.plans.restore_queries import SCHEMAS

    registry = OrderedRegistry(SCHEMAS)
    for schema, text, want in ORDERED:
        assert one(spark, registry.compile(schema)(F.lit(text))) == want, text
    assert one(spark, registry.compile("Order")(F.lit(None).cast("string"))) is None
