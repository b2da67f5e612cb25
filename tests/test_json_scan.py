"""Large JSON arrays in byte ranges against the json module, and sets of tables that change in one step."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import ingest
from tidewright.sources.commits import TableSet
from tidewright.sources.json_scan import array_scan, fragments


def some_value(rng, depth=0):
    kinds = ["text", "number", "word", *(["object", "array"] if depth < 4 else [])]
    kind = rng.choice(kinds)
    if kind == "text":
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "😀", "a", " ", "\n", "\t"]) for _ in range(rng.randrange(12)))
    if kind == "number":
        return rng.choice([0, -1, 2.5, 10**12])
    if kind == "word":
        return rng.choice([None, True, False])
    if kind == "array":
        return [some_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}{rng.choice('}{')}": some_value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.fixture
def tiny_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", "spark.sql.execution.arrow.maxRecordsPerBatch") if spark.conf.get(k, None)}
    yield lambda size, rows: [spark.conf.set(k, v) for k, v in (("spark.sql.files.maxPartitionBytes", size), ("spark.sql.files.openCostInBytes", 0), ("spark.sql.execution.arrow.maxRecordsPerBatch", rows))]
    for k, v in was.items():
        spark.conf.set(k, v)


def plain(text):
    """The objects of an array, or None for a text that is none."""
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return [v for v in value if isinstance(v, dict)] if isinstance(value, list) else None


@pytest.mark.parametrize(("size", "batch"), [(37, 3), (211, 2), (100_000, 10_000)])
def test_records_are_those_of_the_whole_text(spark, tmp_path, tiny_splits, size, batch):
    rng = random.Random(size)
    for i in range(12):
        value = [some_value(rng) for _ in range(rng.randrange(30))]
        text = json.dumps(value, ensure_ascii=i % 2 == 0, indent=[None, 1, 3][i % 3])
        (tmp_path / f"f{i:02d}.json").write_text(text + " \n" * (i % 2))
    tiny_splits(size, batch)
    scan = array_scan(spark, str(tmp_path))
    assert len(scan.splits) > 12 or size > 1000
    got = {}
    for r in sorted(scan.records().select("path", "pos", F.to_json("record").alias("v")).collect(), key=lambda r: (r.path, r.pos)):
        got.setdefault(r.path[-8:-5], []).append(json.loads(r.v))
    ok = {r.path[-8:-5]: (r.ok, r.rows) for r in scan.status().collect()}
    for i in range(12):
        want = plain((tmp_path / f"f{i:02d}.json").read_text())
        assert got.get(f"f{i:02d}", []) == want and ok[f"f{i:02d}"] == (True, len(want))


BROKEN = ["{", "", "  ", "5", '{"a":1}', '{"a":{"b":1},"c":{"d":[2]}}', '[{"a":1}', '[{"a":1}]]', '[{"a":1} {"a":2}]', '[{"a":1}{"a":2}]', '[{"a":1},,{"a":2}]', '[{"a":1},]', '[,{"a":1}]', '[{"a":}]', '[{"a":"x]', '[{"a":1}] x', '[{"a":1}],[{"b":2}]', '[] []', '[{"a":1}][{"b":2}]', '[1],[{"b":2}]', '[{"a":1},{"b":[}]}]', '[{"a":1}, nope, {"b":2}]', '[[{"a":1}]}', '[{"a":1},[{"b":2}],{"c":"}"}']
FINE = ["[]", " [ ] ", "[5]", '[[{"a":1}],{"b":2},"}{",[[]]]', '[{"a":"\\\\"},{"b":"\\""}]', '\n[\n{"a":[{"b":{}}]}\n,\n{}\n]\n']


@pytest.mark.parametrize("size", [2, 7, 100_000])
def test_a_file_that_is_no_array_fails_alone(spark, tmp_path, tiny_splits, size):
    for i, text in enumerate([*BROKEN, *FINE]):
        (tmp_path / f"f{i:02d}.json").write_text(text)
    tiny_splits(size, 2)
    ok = {r.path[-8:-5]: (r.ok, r.rows) for r in array_scan(spark, str(tmp_path)).status().collect()}
    for i, text in enumerate([*BROKEN, *FINE]):
        want = plain(text)
        assert (want is None) == (i < len(BROKEN))
        found = ok.get(f"f{i:02d}", (False, 0))
        assert found[0] == (want is not None) and (want is None or found[1] == len(want)), text


def test_one_large_file_is_many_tasks(spark, tmp_path, tiny_splits):
    """Records with objects inside, and a record that is larger than a split."""
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "customers.json", "w") as f:
        f.write("[")
        for i in range(60_000):
            f.write(("," if i else "") + json.dumps({"id": i, "name": f"n{i}", "more": {"x": [i], "t": "{" * (300_000 if i == 777 else 1)}}))
        f.write("]")
    tiny_splits(1 << 18, 10_000)
    assert fragments(spark, str(tmp_path / "in")).rdd.getNumPartitions() > 8
    catalog = ingest.catalog_of([{"name": "customers", "columns": ["game_id:int64", "name"]}])
    assert ingest.ingest_regions(spark, {"jp": str(tmp_path / "in")}, catalog, str(tmp_path / "out")) == [("jp", "customers", "written")]
    rows = spark.read.parquet(str(tmp_path / "out" / "customers"))
    assert rows.agg(F.count(F.lit(1)), F.sum("game_id"), F.count_distinct("name")).first()[:] == (60_000, 60_000 * 59_999 // 2, 60_000)


CATALOG = [{"name": "cards", "columns": ["game_id:int64", "assetbundle_name"]}, {"name": "areas", "columns": ["game_id:int64"]}]


def lay(folder, **tables):
    folder.mkdir(parents=True, exist_ok=True)
    for name, ids in tables.items():
        (folder / f"{name}.json").write_text(json.dumps([{"id": i} for i in ids]))


def ids(tables, name, commit=None):
    rows = tables.read(name, commit)
    return {} if rows is None else {s: sorted(r.game_id for r in rows.where(F.col("server_region") == s).collect()) for s in sorted(r[0] for r in rows.select("server_region").distinct().collect())}


def test_all_tables_of_a_run_change_at_once(spark, tmp_path):
    catalog, tables = ingest.catalog_of(CATALOG), TableSet(spark, str(tmp_path / "set"))
    assert tables.read("cards") is None and tables.state() == {}
    for region in ("jp", "kr"):
        lay(tmp_path / region, cards=[1, 2], areas=[3])
    folders = {r: str(tmp_path / r) for r in ("jp", "kr")}
    run = tables.begin()
    ingest.ingest_regions(spark, folders, catalog, "", run=run)
    assert ids(tables, "cards") == {}  # staged, not seen
    assert run.commit() == 1
    assert ids(tables, "cards") == {"jp": [1, 2], "kr": [1, 2]} and ids(tables, "areas") == {"jp": [3], "kr": [3]}

    # A run that ends between two tables shows the old state whole; so does one whose file fails, but for that file.
    lay(tmp_path / "jp", cards=[7], areas=[8])
    lost = tables.begin()
    lost.put("cards", spark.createDataFrame([(7, "jp")], "game_id bigint, server_region string"))
    assert ids(tables, "cards")["jp"] == [1, 2]
    (tmp_path / "kr" / "areas.json").write_text("[{")
    run = tables.begin()
    with pytest.raises(ingest.IngestError):
        ingest.ingest_regions(spark, folders, catalog, "", run=run)
    assert ids(tables, "areas") == {"jp": [3], "kr": [3]}
    assert run.commit() == 2
    assert ids(tables, "cards") == {"jp": [7], "kr": [1, 2]} and ids(tables, "areas") == {"jp": [8], "kr": [3]}
    assert ids(tables, "areas", commit=1) == {"jp": [3], "kr": [3]}

    # What no commit names goes, the lost run's folder and the first run's parts that were all replaced.
    assert tables.sweep(keep=2) == []
    gone = tables.sweep(keep=1, older_s=0)
    assert any(lost.id in g for g in gone) and not any(run.id in g for g in gone)
    assert ids(tables, "cards") == {"jp": [7], "kr": [1, 2]} and tables.commits() == [2]


def test_runs_side_by_side_both_stay(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path / "set"))
    rows = lambda n, region: spark.createDataFrame([(n, region)], "game_id bigint, server_region string")
    one, other = tables.begin(), tables.begin()
    one.put("cards", rows(1, "a b/c=d"))
    other.put("cards", rows(2, "kr"))
    other.put("areas", rows(5, "kr").where("false"))
    assert (one.commit(), other.commit()) == (1, 2)
    assert ids(tables, "cards") == {"a b/c=d": [1], "kr": [2]} and tables.read("areas") is None
    assert tables.files.put_new("_commits/000000000002.json", "{}") is False
    assert ids(tables, "cards") == {"a b/c=d": [1], "kr": [2]}
