"""Toxicity: a bidirectional gated recurrent network with attention over character and word inputs.

A text is its words; windows of ``WINDOW`` words begin every ``STEP`` words, so that
they overlap. A word's input is the vector of the word, if it is a known one,
and the mean of the vectors of its character n-grams. Both directions read a
window, attention weighs their states, and a text is as toxic as its most toxic window.
Training is numpy too: of each text the windows that score highest get the gradient.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import by_bytes, crc_mod, gives_back, text_bytes
from tidewright.llm.ngrams import LOWER, first_of_each, sampled_texts

WINDOW, STEP = 64, 48
#: Bytes of a word; a longer run of letters is several words.
LONGEST = 48
#: Bytes of character n-grams, with marks before and after the word, those of longer beginnings, and bins of their hashes.
GRAMS, STEMS, BITS = (3, 4, 5), (6, 7, 8, 9), 16
#: Sizes of inputs, and of the state of one direction.
INPUTS, STATES = 8, 8
#: Bytes of texts worked on at a time.
BLOCK = 1 << 19

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end: runs of ASCII letters, digits and bytes outside ASCII, within a text."""
    body = _WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = body.copy(), body.copy()
    first[1:] &= ~body[:-1] | cut[1:-1]
    last[:-1] &= ~body[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    pieces = -(-(ends - starts) // LONGEST)
    if len(pieces) and pieces.max() > 1:
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + within * LONGEST
        ends = np.minimum(starts + LONGEST, np.repeat(ends, pieces))
    return starts, ends


def compact(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in small letters with one byte at most between words, so that words are not far apart."""
    keep = _WORD[data]
    keep[1:] |= keep[:-1].copy()
    lengths, some = np.zeros(len(offsets) - 1, np.int64), np.diff(offsets) > 0
    if some.any():
        lengths[some] = np.add.reduceat(keep, offsets[:-1][some], dtype=np.int64)
    return LOWER[data[keep]], np.concatenate([[0], np.cumsum(lengths)])


def pieces_of(data: np.ndarray, a: int, b: int, most: int = BLOCK) -> Iterator[tuple[int, int, bool]]:
    """A compact text as pieces of bounded size whose windows are the text's own: from, to, and whether it is the last.

    A piece ends between words (or where a long run of letters is cut) and the next one
    begins where its first window does.
    """
    while b - a > most:
        gaps = np.flatnonzero(~_WORD[data[a : a + most]])
        end = a + (int(gaps[-1]) + 1 if len(gaps) else most // LONGEST * LONGEST)
        starts, _ = word_bounds(data[a:end], np.array([0, end - a]))
        yield a, end, False
        a += int(starts[((len(starts) - WINDOW) // STEP + 1) * STEP])
    yield a, b, True


def windows_of(words: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words, and piece of every window; ``words`` counts each piece's words."""
    whole = np.maximum((words - WINDOW) // STEP + 1, 0)
    n = np.where(last, np.where(words > 0, np.maximum(-(-(words - WINDOW) // STEP), 0) + 1, 0), whole)
    piece = np.repeat(np.arange(len(words)), n)
    at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STEP
    return at + (np.cumsum(words) - words)[piece], np.minimum(WINDOW, words[piece] - at), piece


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever it stands."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(_BACK, len(data) + 1)[starts]


def gram_bins(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins of each word's n-grams, and the offsets of each word's; a word is marked before and after."""
    lengths = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(lengths)])
    word = np.repeat(np.arange(len(starts)), lengths)
    within = np.arange(at[-1]) - at[word]
    text = np.full(at[-1], 2, np.uint64)  # the mark after; 1 before
    inner = (within > 0) & (within < lengths[word] - 1)
    text[inner] = data[(starts[word] + within - 1)[inner]]
    text[at[:-1]] = 1
    left, sizes = lengths[word] - within, (*GRAMS, *STEMS)
    bins, fits = np.zeros((at[-1], len(sizes)), np.int32), np.zeros((at[-1], len(sizes)), bool)
    code, first = text, at[:-1]
    for n in range(2, max(sizes) + 1):
        code = code[:-1] * np.uint64(0x100000001B3) + text[n - 1 :]
        if n in GRAMS:
            where = slice(0, len(code))
        elif n in STEMS:
            where = first[first < len(code)]
        else:
            continue
        h = (code[where] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        bins[where, sizes.index(n)] = h >> np.uint64(64 - BITS)
        fits[where, sizes.index(n)] = left[where] >= n
    upto = np.concatenate([[0], np.cumsum(fits.sum(1))])
    return bins[fits], upto[at]


@dataclass
class Vocabulary:
    """Distinct words of some texts: the hash of each, and its n-grams."""

    hashes: np.ndarray
    bins: np.ndarray
    at: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Vocabulary]:
    """The number of each word of compact texts in a vocabulary, the words of each text, and the vocabulary."""
    starts, ends = word_bounds(data, offsets)
    hashes, first, ids = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    bins, at = gram_bins(data, starts[first], ends[first])
    return ids, np.diff(np.searchsorted(starts, offsets)), Vocabulary(hashes, bins, at)


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: what gates and candidates go by, at a tenth of the time of tanh."""
    y = np.abs(x)
    y += 1
    np.divide(x, y, out=x)
    return x


NAMES = ("words", "grams", "into", "bias", "back", "look", "out", "shift")


class Network:
    """The parameters, and passes over windows forwards and backwards.

    ``into`` is from inputs to the update, reset and candidate gates of both directions,
    ``back`` from states to them; ``look`` weighs states for attention and ``out``
    reads the pooled state.
    """

    def __init__(self, known: np.ndarray, ratios: np.ndarray, word_ratios: np.ndarray, seed: int = 13):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.known = known  # sorted hashes of the words with vectors
        self.words, self.grams = draw(len(known) + 1, INPUTS, scale=0.02), draw(1 << BITS, INPUTS, scale=0.05)
        self.grams[:, 0], self.words[:-1, 0], self.words[-1] = ratios, word_ratios, 0
        self.into, self.bias = draw(2, INPUTS, 3 * STATES, scale=0.4), np.zeros((2, 1, 3 * STATES), np.float32)
        self.back = draw(2, STATES, 3 * STATES, scale=0.2)
        self.look, self.out, self.shift = draw(2 * STATES, scale=0.2), draw(2 * STATES, scale=0.3), np.array([-2.0], np.float32)
        self.slope, self.level, self.empty = 1.0, 0.0, 0.0

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each word's vector; the last one, of zeros, for unknown words."""
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        return np.where(self.known[at] == hashes, at, len(self.known)) if len(self.known) else np.zeros(len(hashes), np.int64)

    def inputs(self, v: Vocabulary) -> np.ndarray:
        """The input of each word of a vocabulary, and a row of zeros for no word."""
        x = np.zeros((len(v.hashes) + 1, INPUTS), np.float32)
        if len(v.hashes):
            grams = np.take(np.ascontiguousarray(self.grams.T), v.bins, axis=1)
            sums = np.add.reduceat(grams, v.at[:-1], axis=1)
            x[:-1] = self.words[self.rows(v.hashes)] + (sums / np.sqrt(np.diff(v.at)).astype(np.float32)).T
        return x

    def forward(self, ids: np.ndarray, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The score of each window; ``ids`` has the words of each, a row a place, the last number for none.

        ``x`` has the inputs of the words. Windows are the last axis of all other
        arrays, so that each step is a few passes over long rows.
        """
        (width, n), none, k = ids.shape, len(x) - 1, STATES
        seen = np.ascontiguousarray(x[ids].transpose(0, 2, 1))
        into = self.into.transpose(0, 2, 1)[:, None] @ seen + self.bias.transpose(0, 2, 1)[:, None]
        h = np.zeros((2, k, n), np.float32)
        there = (ids != none).astype(np.float32)
        full = bool(there.all())
        states = np.empty((width, 2, k, n), np.float32)
        back = np.ascontiguousarray(self.back.transpose(0, 2, 1))
        for t in range(width):
            s = width - 1 - t
            u = back @ h
            zr = u[:, : 2 * k]
            zr[0] += into[0, t, : 2 * k]
            zr[1] += into[1, s, : 2 * k]
            zr = _soft(zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :k], zr[:, k:]
            c = r * u[:, 2 * k :]
            c[0] += into[0, t, 2 * k :]
            c[1] += into[1, s, 2 * k :]
            c = _soft(c)
            m = None if full else np.stack([there[t], there[s]])[:, None]
            if keep is not None:
                keep.setdefault("steps", []).append((h, z, r, c, u[:, 2 * k :], m))
            move = c - h
            move *= 1 - z
            if m is not None:
                move *= m
            h = h + move
            states[t, 0], states[s, 1] = h[0], h[1]
        states = states.reshape(width, 2 * k, n)
        e = self.look @ states
        e += (there - 1) * 1e4
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tkn->kn", a, states)
        if keep is not None:
            keep.update(states=states, a=a, pooled=pooled, ids=ids)
        return self.out @ pooled + self.shift

    def backward(self, keep: dict, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters after the inputs, and of the gates at each place; ``slope`` is of the scores."""
        k, states, a = STATES, keep["states"], keep["a"]
        (width, n), d = keep["ids"].shape, {"out": keep["pooled"] @ slope, "shift": slope.sum(keepdims=True), "back": np.zeros_like(self.back)}
        dp = self.out[:, None] * slope
        through = np.einsum("tkn,kn->tn", states, dp)
        de = a * (through - (a * through).sum(0))
        d["look"] = np.einsum("tn,tkn->k", de, states)
        ds = (a[:, None] * dp + de[:, None] * self.look[:, None]).reshape(width, 2, k, n)
        dh, dg = np.zeros((2, k, n), np.float32), np.zeros((2, width, 3 * k, n), np.float32)
        for t in range(width - 1, -1, -1):
            s = width - 1 - t
            h, z, r, c, uc, m = keep["steps"][t]
            dh = dh + np.stack([ds[t, 0], ds[s, 1]])
            dn = dh if m is None else dh * m
            # The slope of x / (1 + |x|) is (1 - |y|) squared.
            dz = dn * (h - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dc = dn * (1 - z) * (1 - np.abs(c)) ** 2
            dr = dc * uc * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            du = np.concatenate([dz, dr, dc * r], 1)
            d["back"] += h @ du.transpose(0, 2, 1)
            dh = (dh - dn) + dn * z + self.back @ du
            both = np.concatenate([dz, dr, dc], 1)
            dg[0, t], dg[1, s] = both[0], both[1]
        return d, dg

    def window_scores(self, ids: np.ndarray, first: np.ndarray, n: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Scores of the windows of ``n`` words from ``first`` on; those of about equal length go together."""
        out, none = np.empty(len(first), np.float32), len(x) - 1
        padded = np.append(ids, np.full(WINDOW, none))
        order = np.argsort(n, kind="stable")
        for i in range(0, len(order), 1024):
            some = order[i : i + 1024]
            within = np.arange(int(n[some].max()))[:, None]
            grid = np.where(within < n[some], padded[first[some] + within], none)
            out[some] = self.forward(grid, x)
        return out

    def highest(self, column: pa.Array) -> np.ndarray:
        """The score of each text's most toxic window; NaN for texts without words."""
        data, offsets = compact(*text_bytes(column))
        parts = [(i, *p) for i in range(len(offsets) - 1) for p in pieces_of(data, int(offsets[i]), int(offsets[i + 1]))]
        best = np.full(len(offsets) - 1, -np.inf)
        sizes = np.concatenate([[0], np.cumsum([b - a for _, a, b, _ in parts])]).astype(np.int64)
        for i, j in by_bytes(sizes, BLOCK):
            block = np.concatenate([data[a:b] for _, a, b, _ in parts[i:j]])
            ids, words, v = read_words(block, sizes[i : j + 1] - sizes[i])
            first, n, piece = windows_of(words, np.array([last for *_, last in parts[i:j]]))
            if len(first):
                got = self.window_scores(ids, first, n, self.inputs(v))
                np.maximum.at(best, np.array([p[0] for p in parts[i:j]])[piece], got)
        return np.where(np.isfinite(best), best, np.nan)

    def probability(self, score: np.ndarray) -> np.ndarray:
        """Of texts' highest scores; NaN (no words) has the share of toxic texts."""
        margin = np.where(np.isnan(score), self.empty, self.slope * np.nan_to_num(score) + self.level)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def spread_windows(column: pa.Array, most: int) -> Iterator[list[bytes]]:
    """Of each text ``most`` windows at most, evenly over the whole text, as the bytes of their words."""
    data, offsets = compact(*text_bytes(column))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        starts, ends = word_bounds(data[a:b], np.array([0, b - a]))
        first, n, _ = windows_of(np.array([len(starts)]), np.array([True]))
        take = np.unique(np.linspace(0, len(first) - 1, most).round().astype(int)) if len(first) > most else np.arange(len(first))
        yield [data[a + starts[first[w]] : a + ends[first[w] + n[w] - 1]].tobytes() for w in take]


class Adam:
    def __init__(self, model: Network, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.mean = {n: np.zeros_like(getattr(model, n)) for n in NAMES}
        self.square = {n: np.zeros_like(getattr(model, n)) for n in NAMES}

    def step(self, d: dict[str, np.ndarray]) -> None:
        self.t += 1
        for n, g in d.items():
            m, s = self.mean[n], self.square[n]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            update = (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.99**self.t)) + 1e-6)
            getattr(self.model, n)[...] -= self.rate * update


def _log_ratios(counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Of each feature how much commoner it is in toxic texts, on a small scale; ``counts`` has a column a class."""
    share = (counts + 1) / (counts.sum(0) + len(counts))
    return (0.3 * np.clip(np.log(share[:, 1] / share[:, 0]), -4, 4)).astype(np.float32)


def fit(texts: list[list[bytes]], labels: list[int], prior: float, rounds: int = 6, known: int = 4096) -> Network | None:
    """Train on windows of labelled texts; None unless both classes have a text with words.

    Vectors start from the log-ratios of the classes' counts. In each round the windows are scored,
    and the highest of a toxic text, and the two highest of another, are learned from.
    ``prior`` is the share of toxic texts that probabilities are for; they are set on a
    quarter of the texts, which the rest of the training does not see.
    """
    y = np.array(labels)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(set(y[of].tolist())) < 2:
        return None
    flat = [w for t in texts for w in t]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in flat])])
    ids, n, v = read_words(np.frombuffer(b"".join(flat), np.uint8), offsets)
    first = np.cumsum(n) - n
    folds = np.arange(len(texts)) % 4
    learn = folds != 0 if all(((folds != 0) & (y == k)).any() and ((folds == 0) & (y == k)).any() for k in (0, 1)) else np.ones(len(y), bool)

    # How many of the texts to learn from have each word and n-gram, by class.
    met = np.unique(np.repeat(of, n).astype(np.int64) * len(v.hashes) + ids)
    text, word = met // len(v.hashes), met % len(v.hashes)
    counts = np.stack([np.bincount(word[learn[text] & (y[text] == k)], minlength=len(v.hashes)) for k in (0, 1)], 1)
    grams = np.stack([np.bincount(v.bins, np.repeat(counts[:, k], np.diff(v.at)), 1 << BITS) for k in (0, 1)], 1)
    total = counts.sum(1)
    common = np.flatnonzero(total >= 3)
    common = np.sort(common[np.argsort(-total[common], kind="stable")[:known]])
    model = Network(v.hashes[common], _log_ratios(grams, y), _log_ratios(counts, y)[common])
    row = model.rows(v.hashes)
    adam, rng = Adam(model, 0.01), np.random.default_rng(13)
    share = np.array([(learn & (y == k)).sum() for k in (0, 1)]) / learn.sum()
    none = len(v.hashes)
    padded = np.append(ids, np.full(WINDOW, none))

    def highest() -> np.ndarray:
        scores = model.window_scores(ids, first, n, model.inputs(v))
        order = np.lexsort((-scores, of))
        place = np.arange(len(of)) - np.searchsorted(of, of)
        rank = np.empty(len(of), int)
        rank[order] = place
        best = np.full(len(texts), np.nan)
        best[of[rank == 0]] = scores[rank == 0]
        return best, np.flatnonzero((rank < np.where(y[of] == 1, 1, 2)) & learn[of])

    for _ in range(rounds):
        _, chosen = highest()
        chosen = rng.permutation(chosen)
        for i in range(0, len(chosen), 96):
            some = chosen[i : i + 96]
            within = np.arange(int(n[some].max()))[:, None]
            grid = np.where(within < n[some], padded[first[some] + within], none)
            used, local = np.unique(grid, return_inverse=True)
            local = local.reshape(grid.shape)
            if used[-1] != none:
                used = np.append(used, none)
            sizes = np.diff(v.at)[used[:-1]]
            spans = np.repeat(v.at[used[:-1]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            small = Vocabulary(v.hashes[used[:-1]], v.bins[spans], np.concatenate([[0], np.cumsum(sizes)]))
            x = model.inputs(small)
            keep: dict = {}
            z = model.forward(local, x, keep)
            target = y[of[some]]
            slope = ((1 / (1 + np.exp(-z)) - target) / (2 * share[target]) / len(some)).astype(np.float32)
            d, dg = model.backward(keep, slope)
            flat_dg, where = dg.transpose(0, 1, 3, 2).reshape(2, -1, 3 * STATES), local.reshape(-1)
            per_word = np.zeros((2, len(used), 3 * STATES), np.float32)
            for k in (0, 1):
                np.add.at(per_word[k], where, flat_dg[k])
            per_word[:, -1] = 0
            d["into"], d["bias"] = x.T @ per_word, per_word.sum(1, keepdims=True)
            dx = (per_word @ model.into.transpose(0, 2, 1)).sum(0)[:-1]
            d["words"], d["grams"] = np.zeros_like(model.words), np.zeros_like(model.grams)
            np.add.at(d["words"], row[used[:-1]], dx)
            d["words"][-1] = 0
            np.add.at(d["grams"], small.bins, np.repeat(dx / np.sqrt(sizes)[:, None], sizes, axis=0))
            adam.step(d)

    best, _ = highest()
    seen = np.flatnonzero(np.isfinite(best) & (~learn if not learn.all() else learn))
    weight = np.where(y[seen] == 1, prior, 1 - prior) / np.maximum(1, np.bincount(y[seen], minlength=2))[y[seen]]
    model.slope, model.level = _calibrated(best[seen], y[seen], weight * len(seen))
    model.empty = float(np.log(prior / (1 - prior)))
    return model


def _calibrated(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level that make scores log-odds: a weighted logistic loss, kept near 1 and 0, by Newton's method."""
    theta, start, x = np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.stack([score, np.ones_like(score)], 1)

    def loss(t: np.ndarray) -> float:
        return float(weight @ (np.logaddexp(0, x @ t) - y * (x @ t)) + 0.05 * ((t - start) ** 2).sum())

    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 0.1 * (theta - start)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad)
        while np.abs(step).max() > 1e-6 and loss(theta - step) > loss(theta):
            step /= 2
        theta = theta - step
    return max(float(theta[0]), 1e-3), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_class: int = 1500, windows: int = 32) -> Network | None:
    """Fit on at most ``per_class`` labelled texts of each class, and ``windows`` windows of each, spread over it.

    Texts become windows inside Spark, so that the driver gets a bounded number of
    bytes: 2 * 1500 * 32 windows of 64 words at most, however long texts are.
    """
    rows = labels.where(learn & F.col(label).isin(0, 1)).select("doc_id", label)
    picked, each, counts = sampled_texts(docs, rows, label, per_class, 2 * per_class, seed=13)
    if picked is None or len(counts) < 2:
        return None

    @F.arrow_udf("array<binary>")
    @gives_back
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(list(spread_windows(column, windows)), pa.list_(pa.binary()))

    kept = first_of_each(picked.select("_h", "doc_id", "_l", cut("text").alias("w")).collect(), each)
    prior = counts[1] / (counts[0] + counts[1])
    return fit([[bytes(w) for w in r["w"]] for r in kept], [int(r["_l"]) for r in kept], prior)


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    ``score`` is the likelihood of ``toxic`` 1, from the whole text alone: that of its most
    toxic window. Learns from labels whose crc32 of the id's text modulo 5 is not 0 (a
    bounded sample, see :func:`train`). A text that is null or without words has the
    share of toxic texts as its score. Labels other than 0 and 1, and labels without a document,
    are not used; of an id with several labels the smallest is, and of one with several
    texts one. Without labels and words of both classes every score is 0.5. Texts of any length are
    read some hundred thousand bytes at a time. One narrow pass over the texts; rows stay
    as they are, repeated rows too; an empty table gives an empty one; other columns are not used.
    """
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = train(docs, labels, ~held, per_class=per_class)
    score: Column = F.lit(0.5)
    if model is not None:
        network = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, fixed by the parameters

        @F.arrow_udf("double")
        @gives_back
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in batches:
                yield pa.array(network.value.probability(network.value.highest(column)), pa.float64())

        score = scored("text")
    rows = docs.select("doc_id", "text").withColumn("score", score)
    return rows.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
