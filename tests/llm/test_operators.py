"""The ten operators against plain versions, and on odd tables."""

import hashlib
import inspect
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS, untouched, wider
from tidewright.llm import decontaminate, lm_score, lz_fingerprint, near_copies, simhash
from tidewright.llm.components import components
from tidewright.llm import language_id as language_id_module
from tidewright.llm import quality as quality_module
from tidewright.llm.language_id import language_id, predict
from tidewright.llm.lm_score import lm_scores
from tidewright.llm.mixing import mix
from tidewright.llm.ngrams import class_sample, presence, presence_blocks
from tidewright.llm.quality import quality_scores
from tidewright.llm.queries import tokenizer_file
from tidewright.llm.sharding import propagate, shard_documents
from tidewright.llm.token_count import PieceCounter, count_tokens, token_counts
from tidewright.llm.url_filter import judge_urls, viterbi


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def crc(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


MIXED = ("mix_source", "mix_block", "mix_slot", "mix_offset", "mix_release", "mix_deadline", "mix_weight")


def plain_mixture(blocks, period):
    """The slot of each source's blocks: earliest deadline first, a slot at a time."""
    sources = sorted(blocks, key=lambda s: (s is None, s or ""))
    total = sum(math.sqrt(n) for n in blocks.values())
    q = {s: max(1, math.floor(math.sqrt(blocks[s]) / total * max(period, 4 * len(sources)) + 0.5)) for s in sources}
    slots, base, f = {}, 0, 0
    while any(blocks[s] > f * q[s] for s in sources):
        c = {s: max(0, min(q[s], blocks[s] - f * q[s])) for s in sources}
        size = sum(c.values())
        done = dict.fromkeys(sources, 0)
        for slot in range(size):
            ready = [s for s in sources if done[s] < c[s] and done[s] * size // c[s] <= slot]
            s = min(ready, key=lambda s: (-(-(done[s] + 1) * size // c[s]), sources.index(s)))
            slots[s, f * q[s] + done[s]] = base + slot
            done[s] += 1
        base, f = base + size, f + 1
    return slots


def test_mixing_is_earliest_deadline_first(spark, docs):
    rng = np.random.default_rng(2)
    rows = [(i, None if s == 3 else f"s{s:02d}") for i, s in enumerate(rng.choice(12, 700, p=np.arange(1, 13) / 78).tolist())]
    df = spark.createDataFrame(rows, "doc_id bigint, source string")
    for table, period in ((df, 40), (docs.select("doc_id", "source"), 5)):
        got = mix(table, period=period, block=2).collect()
        counts = Counter(r.source for r in got)
        want = plain_mixture({s: -(-n // 2) for s, n in counts.items()}, period)
        assert {(r.mix_source, r.mix_block): r.mix_slot for r in got} == want
        assert all(r.mix_release <= r.mix_slot < r.mix_deadline and r.source == r.mix_source for r in got)


def test_mixing_keeps_windows_and_rows(docs, odd, empty):
    got = mix(docs.select("doc_id", "source"), period=97).collect()
    slots = {r.mix_slot: (r.mix_source, r.mix_weight) for r in got}
    assert len(got) == docs.count() and sorted(slots) == list(range(len(slots)))
    shares = {s[0]: s[1] for s in list(slots.values())[:50]}
    ahead = Counter()
    for slot in range(min(50, len(slots))):
        ahead[slots[slot][0]] += 1
        assert all(abs(ahead[s] - (slot + 1) * w) < 1 for s, w in shares.items() if w == slots[0][1])
    out = mix(wider(odd))
    assert out.count() == len(ROWS) and out.where("mix_source is null").count() == 2 and untouched(out, MIXED)
    assert mix(empty).count() == 0
    weighted = mix(odd, weights={"a": 3}, block=1).collect()
    assert sorted(r.mix_slot for r in weighted) == list(range(len(ROWS)))
    assert {r.mix_weight for r in weighted if r.source == "a" and r.mix_slot < 6} == {0.5}  # 3 of 3 + 1 + 1 + 1


def test_mixing_of_very_many_sources(spark):
    rows = [(i, f"s{i % 60 if i % 3 else 7}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string")
    got = mix(df, fan=8, block=1, period=50).collect()
    assert sorted(r.mix_slot for r in got) == list(range(len(rows)))
    assert Counter(r.source for r in got) == Counter(s for _, s in rows)
    own = sorted((r.mix_slot, r.mix_block) for r in got if r.source == "s7")
    assert [b for _, b in own] == list(range(len(own)))
    # While all sources last, the hot one is within a block a level of its share.
    weight = next(r.mix_weight for r in got if r.source == "s7" and r.mix_block == 0)
    assert all(abs(slot - block / weight) <= 4 / weight for slot, block in own[:20])


def test_lz_fingerprints_follow_the_order(docs, odd, empty):
    got = {r.doc_id: r for r in lz_fingerprint.lz_fingerprints(docs, stretches=5).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, n = texts[a], len(texts[a])
        edited = t[: n - n // 2] + texts[b][: n // 2]
        own, after, changed = (lz_fingerprint.fingerprint(x) for x in (t, texts[b], edited))
        r = got[a]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (lz_fingerprint.fingerprint_text(own), lz_fingerprint.fingerprint_text(changed))
        assert r.near_edited == lz_fingerprint.likeness(own, changed) and r.near_next == lz_fingerprint.likeness(own, after)
    odd_rows = lz_fingerprint.lz_fingerprints(odd, stretches=3).collect()
    assert len(odd_rows) == len(ROWS) and all(0 <= r.near_next <= 1 for r in odd_rows)
    assert lz_fingerprint.lz_fingerprints(empty).count() == 0
    single = lz_fingerprint.lz_fingerprints(odd.where("doc_id = 7")).first()
    assert single.near_next == 1.0


def plain_phrases(text):
    """The dictionary of a parse, as byte strings."""
    known, open_ = set(), b""
    for c in (text or "").encode():
        open_ += bytes([c])
        if open_ not in known:
            known.add(open_)
            open_ = b""
    return known


def test_lz_likeness_is_that_of_the_dictionaries(docs, odd):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for text in list(texts.values())[:20]:
        own = set()
        lz_fingerprint.parse(text.encode(), own, 0)
        assert len(own) == len(plain_phrases(text))
    got = {r.doc_id: r for r in lz_fingerprint.lz_fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    far = 0
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        x, y = plain_phrases(texts[a]), plain_phrases(texts[b])
        edited = texts[a][: len(texts[a]) - len(texts[a]) // 2] + texts[b][: len(texts[a]) // 2]
        z = plain_phrases(edited)
        for found, want in ((got[a].near_next, len(x & y) / max(1, len(x | y))), (got[a].near_edited, len(x & z) / max(1, len(x | z)))):
            far += abs(found - want) > 0.13
    assert far <= 0.02 * 2 * len(order)
    # Stretches are many or one, with null ids and one heavy id: the same rows.
    wide = odd.unionByName(odd.where("doc_id is null")).unionByName(odd.withColumn("doc_id", F.lit(9).cast("bigint")))
    results = [sorted(map(str, lz_fingerprint.lz_fingerprints(wide, stretches=n).collect())) for n in (1, 4, 9)]
    assert results[0] == results[1] == results[2] and len(results[0]) == wide.count()


def plain_simhash(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(prints, most=3):
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_simhash_components(docs, odd, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {r.doc_id: plain_simhash(r.text) for r in docs.collect()}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == prints
    assert {d: r.component_id for d, r in got.items()} == classes_of(prints)
    rows = simhash.near_duplicates(wider(odd)).collect()
    assert len(rows) == len(ROWS)
    assert {r.component_id for r in rows if int(r.fingerprint, 16) == 0} == {2}
    assert {r.component_id for r in rows if r.doc_id == 8} == {1}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.near_duplicates(empty).count() == 0


def near_prints(seed, n=160):
    """Chains and stars of fingerprints some bits apart, and others by chance."""
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 1 << 62, 20)]
    while len(out) < n:
        p = out[int(rng.integers(0, len(out)))]
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            p ^= 1 << int(b)
        out.append(p)
    return sorted(set(out))


@pytest.mark.parametrize("limit", [16384, 8, 2])
def test_simhash_links_lose_nothing_at_any_limit(spark, limit):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = near_prints(limit)[: 160 if limit > 2 else 25]
    df = spark.createDataFrame([(signed(p),) for p in prints], "p bigint")
    links = simhash.link_fingerprints(df, limit=limit).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in links)
    rooted = {r.node: r.root for r in components(spark.createDataFrame([(r.a, r.b) for r in links] or [(0, 0)], "a bigint, b bigint")).collect()}
    want = classes_of({signed(p): p for p in prints}) if all(p < 1 << 63 for p in prints) else None
    groups = Counter(rooted.get(signed(p), signed(p)) for p in prints)
    truth = Counter(classes_of({i: p for i, p in enumerate(prints)}).values())
    assert sorted(groups.values()) == sorted(truth.values()) and (want is None or sorted(Counter(want.values()).values()) == sorted(truth.values()))


def test_golay_keys_meet_within_three_bits():
    rng = np.random.default_rng(3)
    p = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    q = p.copy()
    for i in range(len(q)):
        for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            q[i] ^= np.uint64(1 << int(b))
    keys = []
    for x in (p, q):
        row, key = simhash.fuzzy_keys(x)
        keys.append([set(key[row == i].tolist()) for i in range(len(x))])
    assert all(a & b for a, b in zip(*keys, strict=True))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 1), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def test_near_copies_stage(spark, docs, odd, empty):
    base = [f"w{i}" for i in range(300)]
    edit = base[:150] + ["changed"] + base[151:]
    far = [f"v{i}" for i in range(300)]
    half = base[:150] + far[:150]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate((base, edit, base, far, half))]
    made = wider(spark.createDataFrame(rows, docs.schema))
    kept = near_copies.keep_one_of_each(made)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4] and kept.columns == made.columns and untouched(kept)
    # Blocks of a crowded key find the same groups.
    many = [(i, " ".join(base[:100] + [f"x{i}"] + base[100:]), "en", "s", 1) for i in range(40)] + rows[3:4]
    assert near_copies.keep_one_of_each(spark.createDataFrame(many, docs.schema), limit=8).count() == 2
    out = near_copies.keep_one_of_each(wider(odd)).collect()
    assert Counter(r.doc_id for r in out)[9] == 2 and Counter(r.doc_id for r in out)[1] == 1
    assert near_copies.keep_one_of_each(empty).count() == 0


def test_near_copies_with_edits_in_one_block(spark):
    rng = np.random.default_rng(3)
    drawn = lambda n: [f"t{x}" for x in rng.integers(0, 30_000, n)]
    edits = [
        lambda t: t + drawn(len(t) * 20 // 100),  # appended
        lambda t: t[len(t) * 17 // 100 :],  # cut
        lambda t: t[: len(t) // 2] + drawn(len(t) * 7 // 100) + t[len(t) // 2 + len(t) * 7 // 100 :],  # replaced
    ]
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    rows, none = [], np.zeros(0, np.uint64)
    for i in range(240):
        old = drawn(int(rng.integers(150, 400)))
        new = edits[i % 3](old)
        a, b = shingles(old), shingles(new)
        assert len(a & b) / len(a | b) >= 0.8
        x, y = (near_copies.shingles(" ".join(t).encode()) for t in (old, new))
        assert len(x) == len(a) and len(np.intersect1d(x, y)) == len(a & b)
        # Every pair meets, whichever shingles are called common.
        common = np.sort(rng.choice(x, len(x) // 2, replace=False))
        for late in (none, common):
            assert len(np.intersect1d(*(near_copies.prefix(h, late, np.arange(len(late))) for h in (x, y))))
        rows += [(2 * i, " ".join(old), "en", "s", 1), (2 * i + 1, " ".join(new), "en", "s", 1)]
    kept = {r.doc_id for r in near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert kept >= set(range(0, 480, 2)) and sum(d % 2 for d in kept) <= 240 * 0.02


def test_language_id_held_out_and_odd_rows(docs, odd, empty):
    rows = language_id(docs).join(docs.select(F.col("doc_id").alias("d"), "lang"), F.col("doc_id") == F.col("d")).where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    got = language_id(wider(odd)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (2, 4, 5)} == {"und"}
    assert language_id(empty).count() == 0
    assert untouched(predict(wider(odd), None), ("lang_pred", "lang_score"))


def grams(text, sizes, lower):
    b = (text or "").encode()
    b = b.lower() if lower else b
    return {b[i : i + n] for n in sizes for i in range(len(b) - n + 1)}


def packed(texts, module, lower):
    return np.concatenate([np.packbits(x, axis=1) for x in presence_blocks(pa.array(texts, pa.string()), module.SIZES, module.BITS, lower)])


def test_language_id_is_kernel_ridge_on_the_plain_kernel(docs):
    rows = [r for r in docs.collect() if r.lang and r.text][:120]
    texts, labels = [r.text for r in rows], [r.lang for r in rows]
    model = language_id_module.fit(packed(texts[:70], language_id_module, True), labels[:70], per_class_landmarks=6)
    model.prepare()
    best, score = model.decide(pa.array(texts[70:], pa.string()))
    sets = [grams(t, (1, 2, 3), True) for t in texts]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    classes = sorted(set(labels[:70]))
    marks = [i for c in classes for i in [i for i in range(70) if labels[i] == c][:6]]
    share = np.array([1 / labels[:70].count(x) for x in labels[:70]])
    cross = np.array([[kernel(sets[i], sets[m]) for m in marks] for i in range(70)])
    inner = np.array([[kernel(sets[i], sets[m]) for m in marks] for i in marks])
    target = np.array([[float(x == c) for c in classes] for x in labels[:70]])
    left = (cross * share[:, None]).T @ cross + 1e-3 * len(classes) * (inner + 1e-6 * np.eye(len(marks)))
    weights = np.linalg.solve(left, (cross * share[:, None]).T @ target)
    out = np.clip(np.array([[kernel(sets[i], sets[m]) for m in marks] for i in range(70, len(rows))]) @ weights, 1e-6, 1)
    assert (best == out.argmax(1)).mean() >= 0.98
    assert np.abs(score - out.max(1) / out.sum(1)).mean() < 0.05  # hashed into bins, so not quite the same


def test_class_sample_is_fixed_and_bounded(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 > 0).cast("int").alias("quality"))
    texts = rows.select("doc_id", F.concat(F.lit("text "), "doc_id").alias("text"))
    take = lambda t, r, most: class_sample(t, r, "quality", 20, most, 1, (1, 2), 8, True)
    (a, x), (b, y) = take(texts, rows, 1000), take(texts.repartition(7), rows.repartition(5), 1000)
    assert Counter(x) == {0: 20, 1: 20} and x == y and (a == b).all() and a.shape == (40, 32)
    assert Counter(take(texts, rows, 10)[1]) == {0: 5, 1: 5}
    # More labels than any limit: each has its share; repeated ids and labels, and null ones, count once or not at all.
    many = rows.withColumn("quality", F.col("doc_id") % 400)
    assert len(Counter(take(texts, many, 400)[1])) == 400
    again = rows.unionByName(rows).unionByName(rows.where("doc_id < 9").withColumn("doc_id", F.lit(None).cast("bigint")))
    assert take(texts.unionByName(texts), again, 1000)[1] == x
    assert take(texts.where("false"), rows, 1000)[1] == [] and take(texts, rows.where("false"), 1000)[1] == []


def test_presence_does_not_span_texts():
    one = presence(np.frombuffer(b"ab", np.uint8), np.array([0, 1, 2]), (2,), 8, False)
    assert one.sum() == 0 and presence(np.zeros(0, np.uint8), np.array([0, 0]), (1, 2), 8, True).sum() == 0


def test_lm_scores_counts_and_held_out(docs, odd, empty):
    got = {r.doc_id: r for r in lm_scores(docs, short=300, classes=200, common=500).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = Counter()
    for d, t in texts.items():
        if crc(d, 7) != 2:
            counts.update([*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    for d, t in texts.items():
        tokens, r = [*words(t), None], got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[x] > 0 for x in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in tokens))
    held = [r for r in got.values() if r.held_out and r.n_tokens > 20]
    assert sum(r.score > r.base_score for r in held) >= 0.7 * len(held)  # 68 thousand tokens teach little
    # However the table is split into tasks, the model is the same.
    again = {r.doc_id: r.score for r in lm_scores(docs.coalesce(1), short=300, classes=200, common=500).collect()}
    assert len(again) == len(got)
    rows = lm_scores(wider(odd)).collect()
    assert len(rows) == len(ROWS) and {r.n_tokens for r in rows if r.doc_id in (2, 4, 5)} == {1}
    assert lm_scores(empty).count() == 0


def test_lm_rounds_meet_every_token_once():
    starts, size = np.array([0, 1, 8, 10]), 25
    rounds = inspect.signature(lm_scores).parameters["rounds"].default
    met = np.concatenate([lm_score.targets(starts, size, r, rounds) for r in range(rounds)])
    assert sorted(met.tolist()) == list(range(size))


def test_lm_probabilities_sum_to_one():
    words = [b"a", b"b", b"", b"rare", b"rarer", b"rarest"]
    counts = np.array([9, 7, 5, 3, 2, 1])
    vocab = lm_score.Vocabulary(words, counts, 27, 6, 3, np.ones(4))
    for w, n in zip(words[3:], counts[3:], strict=True):
        vocab.rest[vocab.place(w) - 3] += n + 1
    vocab.__post_init__()
    model = lm_score.LogBilinear.start(vocab.share, vocab.contexts, 4)
    t1, t2, log_z = model.tables()
    log_count = np.where(np.arange(6) < 3, 0.0, np.log(counts + 1.0))
    for u in range(vocab.contexts)[::50]:
        for v in range(vocab.contexts)[::50]:
            p = np.exp(t1[u] + t2[v] - log_z[u, v])
            assert p.sum() == pytest.approx(1, abs=1e-4)
            known = p[vocab.places] * np.exp(log_count) / np.append(np.ones(3), vocab.rest)[vocab.places]
            assert known.sum() + (p[3:] / vocab.rest).sum() == pytest.approx(1, abs=1e-4)  # and one unknown word a class


def test_lm_scores_are_those_of_the_model(spark, docs):
    """Scores against a plain walk over the tokens with a trained model."""
    learn = docs.select(F.xxhash64("doc_id").alias("h"), "text")
    vocab = lm_score.vocabulary(lm_score.token_counts(docs), 200, 64, 400)
    counts = Counter(w for r in docs.collect() for w in lm_score.tokens_of((r.text or "").encode()))
    assert sum(counts.values()) == vocab.total and vocab.counts[0] == counts[vocab.words[0]]
    sent = spark.sparkContext.broadcast(vocab)
    numbers = lm_score.numbered(learn, sent, 3)
    model = lm_score.train(numbers, vocab, 8, 3)
    other = lm_score.train(lm_score.materialize(numbers.coalesce(1)), vocab, 8, 3)
    assert np.allclose(model.flat(), other.flat(), atol=1e-5)
    t1, t2, log_z = model.tables()
    key = spark.sparkContext.broadcast((vocab, model, 1))
    rows = docs.limit(12).select("text", lm_score._scores(key, 0.0)("text").alias("s")).collect()
    own = {w: i for i, w in enumerate(vocab.words[:200])}
    for r in rows:
        u = v = int(vocab.context[vocab.end])
        want = 0.0
        for w in lm_score.tokens_of((r.text or "").encode()):
            p = own.get(w, vocab.place(w))
            want += float(t1[u, p] + t2[v, p] - log_z[u, v]) / math.log(10)
            if w not in own:
                want -= math.log10(vocab.rest[p - 200])
                if w in vocab.words:
                    want += math.log10(counts[w] + 1)
            u, v = v, int(vocab.context[p])
        assert r.s.score == pytest.approx(want, rel=1e-4)


def test_sharding_laws(docs, odd, empty):
    got = shard_documents(docs, shards=24).collect()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(24))
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert all(r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
    groups = {}
    for r in got:
        groups.setdefault(r.text, set()).add(r.shard)
    repeated = [t for t, n in Counter(r.text for r in got).items() if 1 < n <= min(sizes.values())]
    assert repeated and not any(len(groups[t]) > 1 for t in repeated)
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert untouched(shard_documents(wider(odd), shards=3), made)
    odd_rows = shard_documents(wider(odd), shards=3).collect()
    assert len(odd_rows) == len(ROWS) and sorted(Counter(r.shard for r in odd_rows).values()) == [4, 4, 4]
    assert shard_documents(empty).count() == 0


def test_a_file_read_twice_and_other_shapes_keep_their_rows(spark, docs, tmp_path):
    """Rows are told apart also where files and places do not; a hidden column's name is no hindrance."""
    docs.limit(60).repartition(2).write.parquet(str(tmp_path / "d"))
    once, twice = (spark.read.parquet(*[str(tmp_path / "d")] * n) for n in (1, 2))
    kept = near_copies.keep_one_of_each(once).count()
    for rows in (twice.where("doc_id >= 0"), once.unionByName(once)):
        got = [r["count"] for r in shard_documents(rows).groupBy("shard").count().collect()]
        assert sum(got) == 120 and max(got) - min(got) <= 1
    assert near_copies.keep_one_of_each(twice).count() == kept
    assert shard_documents(once.limit(50)).count() == 50
    named = once.withColumn("_metadata", F.lit("x"))
    named.write.parquet(str(tmp_path / "m"))
    assert shard_documents(named).where("_metadata = 'x'").count() == 60
    read = spark.read.parquet(str(tmp_path / "m"))
    assert near_copies.keep_one_of_each(read).where("_metadata = 'x'").count() == kept
    assert lm_scores(read).count() == 60


def test_propagation_ends_where_nothing_may_move(spark):
    rng = np.random.default_rng(4)
    hubs = [int(h) for h in rng.choice(40, 300, p=np.array([10] + [1] * 39) / 49)]
    rows = [(i, h if h < 30 else None) for i, h in enumerate(hubs)]
    got = propagate(spark.createDataFrame(rows, "rid bigint, hub bigint"), shards=5).collect()
    assert sorted(r.rid for r in got) == list(range(300))
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    held = Counter((r.hub, r.shard) for r in got if r.hub is not None)
    asks = Counter()
    for hub in {h for h, _ in held}:
        open_ = [(n, -s) for (h, s), n in held.items() if h == hub and n < sizes[s]]
        closed = {s for (h, s), n in held.items() if h == hub and n >= sizes[s]}
        if open_ and sum(n for (h, _), n in held.items() if h == hub) > 1:
            target = -max(open_)[1]
            for (h, s), n in held.items():
                if h == hub and s != target and s not in closed:
                    asks[s, target] += n
    loose = Counter(r.shard for r in got if r.hub is None)
    assert not any(asks.get((b, a)) or loose[b] for a, b in asks)


def test_decontamination_finds_edited_copies(spark, odd, empty):
    rng = np.random.default_rng(7)
    fresh = lambda n: [f"q{int(x)}" for x in rng.integers(0, 10_000, n)]
    items = [(i, " ".join(fresh(40))) for i in range(30)] + [(90, None), (91, ""), (92, "two words")]
    rows, want = [], set()
    for i, text in items[:30]:
        w = text.split()
        for p in rng.choice(40, 6, replace=False):  # 15 % of the words changed
            w[p] = "edited"
        del w[int(rng.integers(0, 30))]
        rows.append((i, " ".join(fresh(100) + w + fresh(100)).upper()))
        want.add((i, i))
    rows += [(100 + i, " ".join(fresh(200) + items[i][1].split()[:8])) for i in range(30)]  # a fifth of an item is none
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(df, bench).collect()} == want
    blocks = decontaminate.with_matches(df, bench, "m", block_bytes=500)
    assert blocks.where("size(m) > 0").count() == 30
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()) == list(range(100, 130))
    assert decontaminate.drop_contaminated(wider(odd), bench).count() == len(ROWS) and untouched(decontaminate.drop_contaminated(wider(odd), bench))
    twice = bench.unionByName(bench.where("item_id < 2"))
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(wider(df.unionByName(df.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("bigint")))), twice).collect()} == want | {(None, 1)}
    assert decontaminate.contaminated_pairs(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(odd, bench.where("false")).count() == len(ROWS)


def plain_alignment(a, b):
    best, h = 0.0, [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_the_plain_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(30):
        item, passages = rng.integers(0, 4, 9), rng.integers(-1, 4, (3, 14))
        score, _ = decontaminate.align(passages, item)
        assert score.tolist() == [plain_alignment(item.tolist(), p.tolist()) for p in passages]


def test_token_counts_equal_the_library(docs, odd, empty):
    model = tokenizer_file("piece_bpe_32k.model")
    counter = PieceCounter(model)
    got = {r.doc_id: r for r in token_counts(docs, model).collect()}
    for r in docs.collect():
        n = len(counter.processor.encode(r.text or ""))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (n, n > 4096)
    strange = ["", " ", "  a  b ", "a▁b c", "▁", " x", "x ", "\u3000 a", "<s> </s> <unk>", "a\u00a0b c\nd", "é e\u0301 😀 ﬁ"]
    assert counter.count(strange) == [len(counter.processor.encode(t)) for t in strange]
    rng = np.random.default_rng(6)
    dense = ["".join(chr(int(x)) for x in rng.choice([0x4E00 + i for i in range(500)] + list(range(97, 123)) + [0xE9, 0x1F600, 0x3042], n)) for n in (3000, 40_000, 90_000)]
    dense += ["a" * 70_000, "ab" * 40_000 + "\n" * 5000, " " * 50_000]
    assert counter.count(dense) == [len(counter.processor.encode(t)) for t in dense]
    assert untouched(count_tokens(wider(odd), model))
    assert len(token_counts(wider(odd), model).collect()) == len(ROWS) and token_counts(empty, model).count() == 0


def test_quality_held_out_and_odd_rows(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_scores(docs, labels).join(labels.select(F.col("doc_id").alias("d"), "quality"), F.col("doc_id") == F.col("d")).where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    got = quality_scores(wider(odd), labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality_scores(empty, labels).count() == 0
    assert {r.score for r in quality_scores(odd, labels.where("false")).collect()} == {0.5}
    # Repeated and null label rows change nothing.
    more = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0)], labels.schema))
    some = docs.limit(50)
    assert sorted(map(tuple, quality_scores(some, labels).collect())) == sorted(map(tuple, quality_scores(some, more).collect()))


def test_quality_is_a_hinge_loss_on_count_ratios():
    """Weights against a plain, dense coordinate descent; scores against plain sums."""
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcd") if i % 2 else list("cdef"), 12)) for i in range(60)]
    y = np.array([i % 2 for i in range(60)])
    model = quality_module.fit(packed(texts, quality_module, False), y.tolist())
    dense = np.unpackbits(packed(texts, quality_module, False), axis=1).astype(float)
    counts = [dense[y == k].sum(0) + 1 for k in (0, 1)]
    ratio = np.log(counts[1] / 32) - np.log(counts[0] / 32)
    x = np.append(dense * ratio / np.sqrt(dense.sum(1, keepdims=True)), np.ones((60, 1)), axis=1)
    sign, alpha, w = np.where(y == 1, 1.0, -1.0), np.zeros(60), np.zeros(x.shape[1])
    for _ in range(400):
        for i in range(60):
            new = min(max(alpha[i] - (sign[i] * (w @ x[i]) - 1) / (x[i] @ x[i]), 0.0), 1.0)
            w += (new - alpha[i]) * sign[i] * x[i]
            alpha[i] = new
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w)).sum()
    some = ratio != 0
    own = np.append(np.where(some, model.weights / np.where(some, ratio, 1), 0.0), model.bias)
    assert loss(own) <= 1.03 * loss(w)
    margin = np.array([model.weights[np.flatnonzero(d)].sum() / math.sqrt(d.sum()) + model.bias for d in dense])
    assert np.allclose(model.score(pa.array(texts, pa.string())), 1 / (1 + np.exp(-(model.slope * margin + model.shift))), atol=1e-4)


def pages_of(spark, urls, html="<p>free words here casino news paper garden</p>"):
    return spark.createDataFrame([(i, u, html) for i, u in urls], "page_id bigint, url string, html string")


def test_url_rules_and_odd_urls(spark):
    urls = [
        (1, "HTTP://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        (2, "x://foo.com/en/", "foo.com", "/en/", "com/en/", "block"),
        (3, "x://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
        (4, "x://notexample.net/de/81", "notexample.net", "/de/81", "net/de/", "allow"),
        (5, "x://com/en/", "com", "/en/", "com/en/", "block"),
        (6, None, "", "", None, "allow"),
        (7, "no scheme", "", "", None, "allow"),
        (9, "x://a.org/es/#://b.com/en/", "a.org", "/es/", "org/es/", "block"),
        (10, "x://b.net/de/" + "long/" * 9000, "b.net", "/de/" + "long/" * 9000, "net/de/", "allow"),
    ]
    df = pages_of(spark, [(u[0], u[1]) for u in urls])
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(wider(df)).collect()}
    assert got == {(u[0], *u[2:]) for u in urls}
    assert judge_urls(df.unionByName(df)).count() == 2 * len(urls)
    assert judge_urls(df.where("false")).count() == 0 and judge_urls(df.withColumn("html", F.lit(None).cast("string"))).count() == len(urls)


def cheapest(name, counts):
    """The cost of the likeliest split, over all splits there are."""
    total = sum(counts.values())
    dear = 2 * (math.log(total + 1) + 1)
    best = math.inf
    for cuts in range(1 << (len(name) - 1)):
        parts, at = [], 0
        for i in range(1, len(name) + 1):
            if i == len(name) or cuts >> (i - 1) & 1:
                parts.append(name[at:i])
                at = i
        cost = 0.0
        for p in parts:
            cost += math.log((total + 1) / counts[p]) if p in counts else dear if len(p) == 1 else math.inf
        best = min(best, cost)
    return best


def test_segmentation_is_the_likeliest():
    counts = {"free": 10, "casino": 5, "casi": 1, "no": 50, "an": 3, "anno": 2}
    total = sum(counts.values())
    assert viterbi("freecasino", counts, total, 20) == ["free", "casino"] and viterbi("xqz", counts, total, 20) == ["xqz"] and viterbi("", counts, total, 20) == []
    assert viterbi("xxfreeyyno", counts, total, 20) == ["xx", "free", "yy", "no"]
    dear = 2 * (math.log(total + 1) + 1)
    rng = np.random.default_rng(3)
    for _ in range(60):
        name = "".join(rng.choice(["an", "no", "casi", "free", "x", "o", "n"], 4))[:11]
        words = viterbi(name, counts, total, 20)
        cost = sum(math.log((total + 1) / counts[w]) if w in counts else dear * len(w) for w in words)
        assert "".join(words) == name and cost == pytest.approx(cheapest(name, counts))


def test_url_odds_are_multinomial_naive_bayes(spark):
    rng = np.random.default_rng(9)
    names = ["freecasino", "gardennews", "paperwords", "casino-free", "news", "zzz"]
    tops = ["com", "net", "org", "info"]
    urls = [(i, f"http://{rng.choice(names)}.{rng.choice(tops)}/{rng.choice(['en', 'de', 'es', 'x'])}/{rng.choice(['news', 'free', 'free-free', '7'])}") for i in range(150)]
    for most in (200_000, 3):  # all odds sent, or most of them joined
        got = {r.page_id: r for r in judge_urls(pages_of(spark, urls), most_sent=most).collect()}
        dictionary = Counter(["free", "words", "here", "casino", "news", "paper", "garden"] * len(urls))

        def tokens(r):
            host = [w for n in re.findall("[a-z0-9]+", r.host) for w in viterbi(n, dictionary, sum(dictionary.values()), 20)]
            return ["h:" + w for w in host] + ["p:" + w for w in re.findall("[a-z]+", r.path)]

        seen = {"block": Counter(), "allow": Counter()}
        labels = Counter()
        for r in got.values():
            if r.rule:
                seen[r.verdict].update(tokens(r))
                labels[r.verdict] += 1
        size = len(set(seen["block"]) | set(seen["allow"]))
        for r in got.values():
            want = math.log(labels["block"]) - math.log(labels["allow"])
            for t in tokens(r):
                if seen["block"][t] + seen["allow"][t]:
                    want += math.log((seen["block"][t] + 1) / (sum(seen["block"].values()) + size)) - math.log((seen["allow"][t] + 1) / (sum(seen["allow"].values()) + size))
            assert r.block_odds == pytest.approx(want)
            assert r.rule or r.verdict == ("block" if want > 0 else "allow")
