"""The pipeline's stages on a small table and on odd rows."""

from collections import Counter

import corpus_pipeline
from tests.llm.conftest import SCHEMA, wider
from tidewright.llm.mixing import mix

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_whole_run(spark, docs):
    rows = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows.count()
        rows = stage(spark, rows, SF)
        assert rows.count() <= before
        if number < len(corpus_pipeline.STAGES) - 1:
            assert rows.columns == docs.columns, name
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) == rows.count() and {"shard", "slot"} <= set(out[0].asDict())
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_decisions_take_effect(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    clean = [r for r in docs.collect() if r.lang == "en"][:30]
    near = clean[3].text + " more"
    extra = [(900, near, "en", "x", 1), (901, "12 34", "en", "x", 1), (902, None, None, None, None), (903, f"before {item.text} after", "en", "x", 1)]
    rows = spark.createDataFrame([tuple(r) for r in clean] + extra, SCHEMA)
    ids = lambda df: {r.doc_id for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert ids(rows) - ids(stages["language"](spark, rows, SF)) == {901, 902}
    assert 900 not in ids(stages["near_dedup"](spark, rows, SF)) and clean[3].doc_id in ids(stages["near_dedup"](spark, rows, SF))
    assert 903 not in ids(stages["decontaminate"](spark, rows, SF))
    assert ids(stages["mixing"](spark, rows, SF)) == ids(rows)


def test_mixture_shows_in_the_result(spark, monkeypatch, tmp_path):
    # Sources in stretches, all texts different; files of very different sizes.
    kinds = [("a", 1200), ("b", 400), ("c", 300)]
    rows = [(i, f"{s} {i} " + "x" * (i % 7 * 300), "en", s, 1) for i, s in enumerate(s for s, n in kinds for _ in range(n))]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [x for x in corpus_pipeline.STAGES if x[0] in ("mixing", "sharding")])
    slots = {r.doc_id: (r.mix_slot, r.mix_offset, r.mix_weight) for r in mix(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    shards = len({r.shard for r in out})
    # In each shard slots follow the mixture, and equal slots of all shards are one stretch of it.
    for s in range(shards):
        own = [slots[r.doc_id][:2] for r in sorted((r for r in out if r.shard == s), key=lambda r: r.slot)]
        assert own == sorted(own)
    stretches = sorted((r.slot, slots[r.doc_id], r.source) for r in out)
    assert [x[1] for x in stretches] == sorted(x[1] for x in stretches)
    # Less than one block from the target while all sources last, and a few rows in a shard.
    weight = {r.source: slots[r.doc_id][2] for r in out if slots[r.doc_id][0] < 100}
    seen = Counter()
    for n, (_, _, source) in enumerate(stretches[:400], 1):
        seen[source] += 1
        assert all(abs(seen[x] - n * w) < 8 for x, w in weight.items())
    for s in range(shards):
        first = Counter(r.source for r in out if r.shard == s and r.slot < 40)
        assert all(abs(first[x] - 40 * w) <= 10 for x, w in weight.items()), (s, first, weight)


def test_odd_and_empty_tables(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        assert stage(spark, wider(odd), SF).count() <= odd.count(), name
