"""Columnar tables read by ranges against the whole object in Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_json_scan import some_value, tiny_splits  # noqa: F401
from tidewright.sources import columnar_scan as C


def plain(table):
    """Rows as many as the shortest array column has; whole numbers from 0 on are looked up where there is a dictionary."""
    columns = {k: x for k, x in table.items() if k != "__ENUM__" and isinstance(x, list)}
    books = table.get("__ENUM__", {})

    def cell(k, x):
        book = books.get(k)
        whole = isinstance(x, int) and not isinstance(x, bool) and x >= 0
        return (book[x] if x < len(book) else None) if isinstance(book, list) and whole else x

    return [{k: cell(k, x[i]) for k, x in columns.items()} for i in range(min(map(len, columns.values()), default=0))]


def some_table(rng, i):
    n = rng.randrange(1, 25)
    table = {"note": "no, array", "id": list(range(n)), 'st"a,t': [rng.choice([None, 0, 1, 2, 7, "x", -1]) for _ in range(n + rng.randrange(2))]}
    table |= {"obj": [some_value(rng) for _ in range(n)], "x": {"a": [1, 2], "b": [3]}}
    if i % 3:
        table["__ENUM__"] = {'st"a,t': ["A,", None, 'C"]'], "q": [1]}
    if i == 5:
        table["empty"] = []
    items = list(table.items())
    rng.shuffle(items)
    return {6: {}, 7: {"only": [5]}}.get(i, dict(items))


@pytest.mark.parametrize(("size", "batch", "rows"), [(23, 3, 3), (97, 2, 7), (100_000, 10_000, 1000)])
def test_rows_are_those_of_the_whole_table(spark, tmp_path, tiny_splits, monkeypatch, size, batch, rows):  # noqa: F811
    monkeypatch.setattr(C, "ROWS", rows)
    rng, want = random.Random(size), {}
    for i in range(8):
        table = some_table(rng, i)
        (tmp_path / f"f{i}.json").write_text(json.dumps(table, indent=[None, 1][i % 2], ensure_ascii=False))
        want[f"f{i}"] = plain(table)
    tiny_splits(size, batch)
    got = {name: [] for name in want}
    for r in C.ColumnarScan(spark, str(tmp_path)).rows().select("path", "pos", F.to_json("record").alias("v")).collect():
        got[r.path[-7:-5]].append((r.pos, json.loads(r.v)))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == {k: list(enumerate(v)) for k, v in want.items()}


def test_a_large_table_is_many_tasks(spark, tmp_path, tiny_splits):  # noqa: F811
    n = 30_000
    table = {"id": list(range(n)), "word": [i % 3 for i in range(n)], "__ENUM__": {"word": ["a", "b"]}, "more": [{"x": [i, "],"]} for i in range(n)]}
    (tmp_path / "t.json").write_text(json.dumps(table))
    tiny_splits(1 << 16, 1000)
    rows = C.ColumnarScan(spark, str(tmp_path)).rows()
    id_, word, x = (F.try_variant_get("record", p, t) for p, t in (("$.id", "bigint"), ("$.word", "string"), ("$.more.x[0]", "bigint")))
    found = rows.agg(F.count(F.lit(1)), F.count_if((id_ == F.col("pos")) & (x == id_)), F.count_if(word == "a"), F.count_if(word == "b"), F.count_if(word.isNull())).first()
    assert found[:] == (n, n, n // 3, n // 3, n // 3)
    assert C.ColumnarScan(spark, str(tmp_path)).cells.rdd.getNumPartitions() > 8
