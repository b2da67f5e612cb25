"""Operators 11 to 13 against plain versions, and on odd tables."""

import hashlib
import re
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LONG, ROWS, SCHEMA, untouched, wider
from tidewright.llm import conversation_repair as C
from tidewright.llm import fill_middle as M
from tidewright.llm import toxicity as T


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Conversation repair.

TURNS = "conv_id bigint, turn bigint, role string, text string"


def search(turns):
    """All edits of ``(initial, fault)`` turns, plainly: the least cost and of those the ASCII-least audit."""
    best = None
    for choice in product("KRD", repeat=len(turns)):
        for inserts in product(range(3), repeat=len(turns) + 1):
            cost, audit, roles, fine = 2 * sum(inserts), "", [], True
            for (initial, fault), letter, n in zip([*turns, ("", 0)], [*choice, ""], inserts, strict=True):
                audit += "I" * n + letter
                roles += ["?"] * n + ({"K": [initial], "R": ["?"]}.get(letter, []))
                cost += {"K": 0, "R": 2, "D": 3, "": 0}[letter] + (letter in ("K", "R") and fault == C.CUT)
                fine &= letter in ("D", "") or fault not in (C.BLANK, C.DUPLICATE)
            body = roles[1:] if roles[:1] == ["s"] else roles
            fine &= len(body) % 2 == 0 and all(r in ("?", "ua"[i % 2]) for i, r in enumerate(body)) and (roles == body or len(body) > 0)
            if fine and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_cheapest_edits_are_those_of_a_full_search():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 3, 4, 4, 4):
        for _ in range(6):
            turns = [(str(rng.choice(list("suax") + [""])), int(rng.integers(0, 4))) for _ in range(n)]
            assert C.ended(C.cheapest(turns))[:2] == search(turns), turns


def test_ranges_of_turns_compose():
    rng = np.random.default_rng(6)
    for _ in range(60):
        turns = [(str(rng.choice(list("suax"))), int(rng.integers(0, 4))) for _ in range(int(rng.integers(0, 30)))]
        cut = int(rng.integers(0, len(turns) + 1))
        ways = {}
        for entry, (cost, audit) in C.cheapest(turns[:cut]).items():
            for q, (more, rest) in C.cheapest(turns[cut:], entry).items():
                ways[q] = min(ways.get(q, (10**9, "")), (cost + more, audit + rest))
        assert C.ended(ways)[:2] == C.ended(C.cheapest(turns))[:2]


def plain_repair(rows):
    """Report and repaired turns of one conversation's ``(turn, role, text)``, by the faults' definitions."""
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=lambda r: (r[0] is not None, r[0] or 0))
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append(C.BLANK if not last else C.DUPLICATE if (role, text) in seen else C.SOUND if last[0] in ".!?" else C.CUT)
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, _ = C.ended(C.cheapest(list(zip(initials, faults, strict=True))))
    out, at = [], 0
    for letter in audit:
        _, role, text = rows[at] if at < len(rows) else (None, None, None)
        at += letter != "I"
        if letter == "K":
            out.append((role, text))
        elif letter != "D":
            out.append(("assistant" if out and out[-1][0][:1] == "u" else "user", "" if letter == "I" else text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *[faults.count(k) for k in (C.BLANK, C.DUPLICATE, C.CUT)], pairs, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in out))), out


def held_against_plain(spark, rows):
    """Compare a whole table; of equal turns of a conversation there must be one."""
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair_conversations(df).collect()}
    lines = {}
    for r in sorted(C.repaired_turns(df).collect(), key=lambda r: (str(r.conv_id), r.place)):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {c: plain_repair([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == {c: w[0] for c, w in want.items()}
    assert lines == {c: w[1] for c, w in want.items() if w[1]}


def test_repair_of_odd_conversations(spark):
    rng = np.random.default_rng(7)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", "", None, " \t", "Well?\n", "naïve 😀", "1.", "a b c!"]
    rows = [(c, t, roles[rng.integers(6)], texts[rng.integers(9)]) for c in range(40) for t in rng.permutation(12)[: rng.integers(1, 9)].tolist()]
    rows += [(None, None, "user", "Hello."), (None, 3, "assistant", "Hi."), (77, None, None, None), (78, 1, "user", LONG), (78, 2, "assistant", LONG + ".")]
    held_against_plain(spark, rows)


def test_repair_of_one_conversation_over_many_ranges(spark, monkeypatch):
    """A conversation with most of the rows, its texts repeated at will, is cut into ranges."""
    monkeypatch.setattr(C, "EACH", 25)
    rng = np.random.default_rng(8)
    rows = [(5, t, ["user", "assistant", "system", "x"][rng.integers(4)], ["Yes.", "no", "", "Why?", f"t{t}."][rng.integers(5)]) for t in range(400)]
    rows += [(c, t, "user", f"{t}.") for c in (1, 2, 9) for t in range(5)]
    held_against_plain(spark, rows)


def test_repeated_rows_of_one_turn_are_split(spark, monkeypatch):
    monkeypatch.setattr(C, "EACH", 20)
    rows = [(1, 1, "user", "Again.")] * 150 + [(1, 2, "assistant", "Once.")]
    (got,) = C.repair_conversations(spark.createDataFrame(rows, TURNS)).collect()
    assert (got.duplicate, got.blank, got.cost, got.audit) == (149, 0, 447, "D" * 149 + "KK") or got.audit == "K" + "D" * 149 + "K"
    assert got.repaired_sha256 == sha("user:Again.\nassistant:Once.")


def test_damage_and_conversations_without_turns(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "One. Two!") for c in range(30) for t in range(3)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, TURNS)
    broken = C.damaged(wider(df)).collect()
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if k == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(k, text), k == 0)
        want += [row] * (2 if k == 3 else 1)
    assert sorted(map(tuple, broken), key=repr) == sorted(want, key=repr)
    got = {r.conv_id: r for r in C.repair_damaged(wider(df)).collect()}
    for c in {r[0] for r in rows}:
        assert tuple(got[c])[1:] == plain_repair([r[1:4] for r in want if r[0] == c and not r[4]])[0]
    none = C.repair_conversations(df.withColumn("gone", F.lit(True)), absent="gone").collect()
    assert {tuple(r)[1:] for r in none} == {(0, 0, 0, 0, 0, 0, "", sha(""))} and len(none) == 31
    assert C.repair_damaged(df.limit(0)).count() == 0 and C.repaired_turns(df.limit(0)).count() == 0


# Fill in the middle.


def plain_units(text, unit):
    if unit == "char":
        return list(text)
    # White space goes with the word before it; at the start of a text it is a unit of its own.
    form = r"(?s)^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*" if unit == "word" else r"(?s)[^\n]*\n|[^\n]+"
    return re.findall(form, text)


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("size", [1, 3, 64])
def test_cuts_are_those_of_plain_units(unit, size):
    rng = np.random.default_rng(size)
    texts = ["".join(rng.choice(list("aé😀 \n\tb"), n)) for n in (0, 1, 2, 5, 40, 0, 200)] + [" \n ", "x", "\n"]
    data, offsets = M.text_bytes(pa.array(texts))
    chunks = M.Chunks(data, offsets, unit, size)
    units = [plain_units(t, unit) for t in texts]
    assert chunks.units().tolist() == [len(u) for u in units]
    for part in (0, 0.3, 1):
        ranks = np.array([int(part * len(u)) for u in units])
        assert chunks.cut(ranks).tolist() == [len("".join(u[:r]).encode()) for u, r in zip(units, ranks, strict=True)]


def plain_fim(doc_id, text, seed=1):
    text = text or ""
    h = [int(sha(f"{seed}:{'' if doc_id is None else doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    spm = h[3] % 100 < 20
    return doc_id, n, "spm" if spm else "psm", a, b - a, sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fill_in_middle_is_the_plain_one(spark, docs, odd, empty):
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(["a<P>b", "<S>", "x<M>", "<P", "<<S", "S>", "\0", "é" * 5000] * 6)], SCHEMA)
    for df in (docs, odd, more, wider(odd)):
        rows = df.select("doc_id", "text").collect()
        got = M.fill_in_middle_digest(df).collect()
        assert sorted(map(tuple, got), key=repr) == sorted([plain_fim(*r) for r in rows], key=repr)
    assert {r.form for r in M.fill_in_middle_digest(docs).collect()} == {"plain", "psm", "spm"}
    assert M.fill_in_middle_digest(empty).count() == 0


def test_fill_in_middle_keeps_columns_and_counts_units(odd):
    out = M.fill_in_middle(wider(odd), unit="word", rate=100)
    assert out.count() == len(ROWS) and untouched(out)
    for r in out.collect():
        assert r.fim.units == len(plain_units(r.text or "", "word"))
        assert r.fim.form == ("plain" if not r.text else r.fim.form)
        if r.fim.form != "plain":
            assert r.fim.prefix + r.fim.middle + r.fim.suffix == r.text


# Toxicity.


def small_network(seed=3):
    m = T.Network(np.array([5, 9], np.uint64), np.zeros(1 << T.BITS, np.float32), np.zeros(2, np.float32), seed)
    m.back *= 2
    return m


def plain_score(m, x):
    """One window, a word and a state at a time."""
    k, soft = T.STATES, lambda v: v / (1 + abs(v))
    states = []
    for way in (0, 1):
        h, out = np.zeros(k), []
        for row in x if way == 0 else x[::-1]:
            g, u = row @ m.into[way] + m.bias[way][0], h @ m.back[way]
            z, r = (0.5 + 0.5 * soft(g[i * k : i * k + k] + u[i * k : i * k + k]) for i in (0, 1))
            h = z * h + (1 - z) * soft(g[2 * k :] + r * u[2 * k :])
            out.append(h)
        states.append(out if way == 0 else out[::-1])
    both = np.concatenate(states, 1)
    a = np.exp(both @ m.look)
    return float((a / a.sum()) @ both @ m.out + m.shift[0])


def test_forward_is_the_plain_recurrence():
    m, rng = small_network(), np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(30, T.INPUTS)), np.zeros((1, T.INPUTS))]).astype(np.float32)
    lengths = [1, 5, 12]
    ids = np.full((12, 3), 30)
    for j, n in enumerate(lengths):
        ids[:n, j] = rng.integers(0, 30, n)
    got = m.forward(ids, x)
    assert np.allclose(got, [plain_score(m, x[ids[:n, j]]) for j, n in enumerate(lengths)], atol=1e-4)


def test_gradients_are_those_of_differences():
    m, rng = small_network(), np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(9, T.INPUTS)), np.zeros((1, T.INPUTS))]).astype(np.float32)
    ids, weight = rng.integers(0, 9, (6, 4)), rng.normal(size=4).astype(np.float32)
    ids[4:, 1] = 9
    keep = {}
    m.forward(ids, x, keep)
    d, dg = m.backward(keep, weight)
    d["into"] = np.stack([sum(np.outer(x[ids[t, j]], dg[w, t, :, j]) for t in range(6) for j in range(4)) for w in (0, 1)])
    for name in ("into", "back", "look", "out", "shift"):
        p = getattr(m, name)
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in p.shape)
            was, ends = p[at], []
            for step in (0.02, -0.02):
                p[at] = was + step
                ends.append(float(m.forward(ids, x) @ weight))
            p[at] = was
            assert abs((ends[0] - ends[1]) / 0.04 - d[name][at]) < 2e-3, name


def plain_words(text):
    runs = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode().lower())
    return [r[i : i + T.LONGEST] for r in runs for i in range(0, len(r), T.LONGEST)]


def plain_windows(words):
    if not words:
        return []
    return [words[i : i + T.WINDOW] for i in range(0, max(1, len(words) - T.WINDOW + T.STEP), T.STEP)]


TEXTS = ["", None, "One word", "a, b; c", " \n", "x" * 500 + " y", " ".join(f"w{i}" for i in range(65)), LONG, "é" * 3000, "a" + " " * 5000 + "b", " ".join(f"Q{i % 9}" for i in range(3000))]


@pytest.mark.parametrize("block", [4096, 1 << 19])
def test_windows_are_all_of_the_whole_text(monkeypatch, block):
    """Also of texts that are read in pieces: the highest score is that of the plain windows."""
    m = small_network()
    monkeypatch.setattr(T.Network, "highest", lambda self, c, f=T.Network.highest: f(self, c))
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "pieces_of", lambda d, a, b, f=T.pieces_of: f(d, a, b, block))
    got = m.highest(pa.array(TEXTS))
    for text, score in zip(TEXTS, got, strict=True):
        windows = plain_windows(plain_words(text))
        if not windows:
            assert np.isnan(score)
            continue
        scores = []
        for w in windows:
            data = np.frombuffer(b" ".join(w), np.uint8)
            ids, n, v = T.read_words(data, np.array([0, len(data)]))
            assert n.tolist() == [len(w)]
            scores.append(plain_score(m, m.inputs(v)[ids]))
        assert abs(max(scores) - score) < 1e-3


def test_word_inputs_are_means_over_grams():
    m = small_network()
    words = [b"a", b"moron", b"\xc3\xa9t\xc3\xa9", b"beginning"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ids, _, v = T.read_words(data, np.array([0, len(data)]))
    x = m.inputs(v)
    for i, word in zip(ids, words, strict=True):
        marked = b"\x01" + word + b"\x02"
        n = sum(max(0, len(marked) - k + 1) for k in T.GRAMS) + sum(len(marked) >= k for k in T.STEMS)
        bins = v.bins[v.at[i] : v.at[i + 1]]
        assert len(bins) == n and np.allclose(x[i], m.grams[bins].sum(0) / np.sqrt(n), atol=1e-5)
    again = T.read_words(np.frombuffer(b"x moron", np.uint8), np.array([0, 7]))[2]
    assert set(v.hashes) & set(again.hashes)


def test_toxicity_held_out_and_odd_rows(spark, odd, empty):
    rng = np.random.default_rng(4)
    bad, plain = ["scum", "idiot", "trash"], [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [str(w) for w in rng.choice(plain, rng.integers(5, 300))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(words) // 60):
                words[rng.integers(len(words))] = str(rng.choice(bad))
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, None, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10_000))
    labels = spark.createDataFrame(labels + [(1, None, 7), (None, None, 1), (99_999, None, 1)], "doc_id bigint, quality int, toxic int")
    got = T.toxicity_scores(wider(docs), wider(labels)).collect()
    assert len(got) == 600 + len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    seen = [(r.predicted, int(r.doc_id % 4 == 0)) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(p == y for p, y in seen) >= 0.95 * len(seen)
    assert T.toxicity_scores(empty, labels).count() == 0
    none = T.toxicity_scores(odd, labels.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.5}
