"""Cases of the third round's findings."""

import math

import numpy as np

import corpus_pipeline
from tests.llm.conftest import SCHEMA
from tidewright.llm import near_copies
from tidewright.llm.lm_score import lm_scores
from tidewright.llm.simhash import fingerprint_of, near_duplicates


def test_lm_text_that_fills_the_last_group_of_its_shard(spark):
    # 200,000 tokens are learned from at a time; after this text nothing of its shard is left.
    texts = {0: "one two three four " * 50_000, 4: "one two three four"}
    rows = [(i, t, "en", "a", 1) for i, t in texts.items()]
    for some in (rows[:1], rows):
        found = {r.doc_id: r for r in lm_scores(spark.createDataFrame(some, SCHEMA)).collect()}
        assert {i: r.n_tokens for i, r in found.items()} == {i: len(texts[i].split()) + 1 for i, *_ in some}
        assert all(r.n_known == r.n_tokens and r.train_tokens >= 200_001 and math.isfinite(r.score) for r in found.values())
        assert found[0].score > found[0].base_score  # it has learned from that text


def test_near_dedup_takes_all_links_of_the_fingerprints(spark, docs):
    # The same line over and over, and ends of their own: equal fingerprints of three-word
    # shingles, whose repeats count, and few five-word shingles in common.
    texts = ["one line that comes again and again " * 400 + " ".join(f"{x}{i}" for i in range(60)) for x in "abc"]
    prints = [fingerprint_of(t.encode()) for t in texts]
    assert all((prints[0] ^ p).bit_count() <= 3 for p in prints)
    sketches = [np.frombuffer(near_copies._sketch(near_copies.shingles(t.encode())), np.uint8) for t in texts]
    assert all(np.bitwise_count(sketches[0] ^ x).sum() > near_copies.MOST_BITS for x in sketches[1:])
    clean = [tuple(r) for r in docs.limit(150).collect()]
    some = [(90_000 + i, " ".join(r[1].split()[:-1]), *r[2:]) for i, r in enumerate(clean) if len((r[1] or "").split()) >= 40]
    rows = spark.createDataFrame(clean + some + [(95_000 + i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    component = {r.doc_id: r.component_id for r in near_duplicates(rows).collect()}
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, "").collect()]
    assert len({component[i] for i in kept}) == len(kept)  # one of each component of operator 3 at most
    assert 95_000 in kept and not {95_001, 95_002} & set(kept)
    assert len(some) >= 20 and not {r[0] for r in some} & set(kept)
