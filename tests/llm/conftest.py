import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Nulls in any column, empty and blank texts, one very long text, ties and repeated rows.
LONG = " ".join(f"long{i % 977} text{i % 31}" for i in range(40_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog today", "en", "a", 3),
    (1, "the quick brown fox jumps over the lazy dog today", "en", "a", 3),
    (2, None, None, None, None),
    (None, "words without an id in this row", "en", "a", 3),
    (4, "", "en", "b", 0),
    (5, " \t\n", "en", "b", 3),
    (6, LONG, "en", "a", 1),
    (7, "ein kleiner text auf deutsch mit einigen worten", "de", "b", 2),
    (8, "The Quick brown fox jumps over the lazy dog today", None, "a", 3),
    (9, "12345 67890 !!", "en", "c", 14),
    (9, "eine andere zeile mit gleicher nummer", "de", None, 5),
    (10, "naïve café 😀 e\u0301 zürich", "fr", "c", 5),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


#: Names that operators make, or made once, for themselves.
CLASHING = (
    "shard", "SLOT", "mix_slot", "_h", "_fp", "_m", "_src", "_rank", "_found", "lang_pred", "rid", "_rid", "hub", "_hub", "q_of", "j", "runs",
    "_j", "_period", "_run", "_runs", "_at", "_q", "_start", "_unit", "_unit_of", "_q_of", "_j_of", "_parent", "_got", "_none", "d", "h", "part", "place",
    "_part", "_place", "_of", "_made", "n", "s", "key", "cid", "sig", "keys", "tokens", "rule", "label", "_v", "_d", "_l", "size", "law", "id", "stretch",
    "guest", "others", "root", "node", "first", "gone_part", "gone_place", "unit", "weight", "blocks", "_b", "_n", "_off", "p", "m", "_metadata",
)


def wider(df):
    """The same with columns whose names clash with those that operators make; each holds an x."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(name) for name in CLASHING])


def untouched(df, made=()):
    """Whether a result still has the clashing columns, each with its x, but for those that are said to be replaced."""
    gone = {m.lower() for m in made}
    kept = [c for c in CLASHING if c.lower() not in gone]
    return set(kept) <= set(df.columns) and all(r[c] == "x" for r in df.select(*[f"`{c}`" for c in kept]).collect() for c in kept)
