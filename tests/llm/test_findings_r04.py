"""Cases of the fourth round's findings on training data."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA
from tidewright.llm import near_copies
from tidewright.llm.simhash import fingerprint_of


def words(i, n):
    return " ".join(f"w{i}x{j}" for j in range(n))


def looked_at_before():
    """Texts that the count of common shingles, once over one text in sixteen, took in."""
    return F.pmod(F.xxhash64("text", F.lit(3)), F.lit(16)) == 0


def test_shingles_of_all_texts_are_counted(spark):
    line = " ".join(f"line{j}" for j in range(30))
    rows = spark.createDataFrame([(i, f"{words(i, 60)} {line}", "en", "a", 1) for i in range(300)], SCHEMA).where(~looked_at_before())
    assert rows.count() >= 200
    keys = near_copies.signatures(rows).select(F.explode("keys").alias("key"))
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] == 1  # the line is in none of the keys
    assert near_copies.keep_one_of_each(rows).count() == rows.count()


def test_near_dedup_does_not_hang_on_what_is_common(spark):
    # Texts that hold a whole other one and a third more: similarity 0.75, where the sketch links some.
    made = spark.createDataFrame([(i, words(i, 64)) for i in range(200)], "i int, text string")
    base = made.where(looked_at_before()).orderBy("i").first().text
    more = {1000 + i: f"{base} {words(1000 + i, 20)}" for i in range(60)}
    sketch = lambda t: np.frombuffer(near_copies._sketch(near_copies.shingles(t.encode())), np.uint8)
    bits = lambda a, b: np.bitwise_count(sketch(a) ^ sketch(b)).sum()
    apart = {i for i, t in more.items() if bits(base, t) > near_copies.MOST_BITS and (fingerprint_of(base.encode()) ^ fingerprint_of(t.encode())).bit_count() > 3}
    assert 10 <= len(apart) <= 50
    for copies in (1, 100):  # rare or common
        rows = [(i, base, "en", "a", 1) for i in range(copies)] + [(i, t, "en", "a", 1) for i, t in more.items()]
        kept = {r.doc_id for r in near_copies.keep_one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert kept == {0} | apart
