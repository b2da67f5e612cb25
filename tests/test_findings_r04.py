"""Cases of the fourth round's findings."""

import duckdb

from tidewright.operators.state import round_robin
from tidewright.plans import registry


def test_round_robin_lists_lines_by_each_of_their_keys(spark, tmp_path):
    # In one number, parts of a million or more would go over into the line, and suppliers into the part.
    lines = [
        (8, 1, 1_000_001, 3), (8, 1, 3_500_002, 1), (8, 2, 5, 7), (8, 3, 4, 7),
        (9, 1, 2, 1_500_001), (9, 1, 3, 1), (9, 2, 7, 4),
        (10, 1, 1_199_999, 59_999), (10, 2, 19_998, 1), (10, 2, 19_999, 1),
        (-5, 1, 2, 1), (-5, 2, 9_000_000_001, 1), (-5, 2, 3, 9_000_000_000),
        (11, None, 3, 1), (11, 1, None, 1), (11, 2, 1_000_000, None),
        (12, 1, 4, 1), (12, 2, None, 1), (None, 1, 6, 1),
    ]
    rows = [(k + 1000 * i if k else k, *r) for i in range(20) for k, *r in lines if k or not i]
    path = f"{tmp_path}/lineitem.parquet"
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint").write.parquet(path)
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{path}/*.parquet'")
    want = db.execute(registry.oracle_sql()["o4_o6_round_robin"]).fetchall()
    got = registry.queries()["o4_o6_round_robin"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) == 121


def test_round_robin_takes_a_slot_of_unknown_state_last(spark):
    rows = [(1, 0, None, 0, 3), (1, 1, True, 0, 3), (1, 2, False, 0, 3), (2, 0, None, 0, 2), (2, 1, True, 0, 2)]
    slots = spark.createDataFrame(rows, "request bigint, idx bigint, busy boolean, cursor bigint, n bigint")
    assert {r.request: r.idx for r in round_robin(slots).collect()} == {1: 2, 2: 1}
