"""LM scoring: a log-bilinear model trained with noise-contrastive estimation.

The output has a place for each of the commonest words (and the text's end), and
classes, by a hash, that all other words fall into. The two words before predict
the next place: ``s(w | u, v) = (C1 q_u + C2 q_v) . r_w + b_w``; a context word has a
vector of its own if it is very common, else that of its class. A word in a class has
the class's probability times its share there by its count in the corpus. So
every word is predicted by the model, in one step or in two.

Training is noise-contrastive, in numpy, on shards of the training texts side by
side from the same start, and the results are averaged, weighted by their tokens.
For scoring, ``s`` falls apart into a term for each context place, so two matrix
products give all terms and one more gives the normalisers of all pairs of context
words at once: each token's probability is exactly normalised and costs three
look-ups.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import commonest, crc_mod, fresh, materialize, read_order, text_bytes

#: The text's end as a token; no word is empty.
END = b""
#: Places of context words: those of the commonest words, and classes for all others.
NEAR, NEAR_CLASSES = 768, 256
#: Tokens of a shard, about; blocks that parameters are cut into to be averaged.
SHARD, _BLOCKS = 2_000_000, 16


def tokens_of(text: bytes) -> list[bytes]:
    """Words between white space of one byte, A-Z lower-cased, and the end."""
    words = text.lower().split()
    words.append(END)
    return words


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = text_bytes(column)
    raw, at = data.tobytes(), offsets.tolist()
    for i, j in zip(at[:-1], at[1:], strict=True):
        yield raw[i:j]


def token_counts(docs: DataFrame, most_held: int = 300_000) -> DataFrame:
    """``token`` (binary), ``n``: counts over all of ``docs``.

    Tasks sum what they read, ``most_held`` tokens at a time, before the shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"]
            )
            counts.clear()
            return out

        for batch in batches:
            for text in _texts(batch.column(0)):
                counts.update(tokens_of(text))
                if len(counts) > most_held:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The commonest words by falling count, and what is known of the rest."""

    words: list[bytes]
    counts: np.ndarray
    total: int  # tokens in training
    distinct: int
    short: int  # words with a place of their own
    rest: np.ndarray  # of each class: the sum over its words of count + 1, and 1 for an unknown word

    def __post_init__(self):
        own = self.counts[: self.short] + 1.0
        share = np.append(own, self.rest)
        self.share = share / share.sum()
        every = np.arange(len(share))
        near = min(NEAR, self.short)
        #: The context place of each output place.
        self.context = np.where(every < near, every, near + every % NEAR_CLASSES)
        self.contexts = near + NEAR_CLASSES
        #: The output place of each common word.
        self.places = np.array([i if i < self.short else self.place(w) for i, w in enumerate(self.words)], np.int64)

    def place(self, word: bytes) -> int:
        """The output place of a word without one of its own."""
        return self.short + crc32(word) % len(self.rest)

    @property
    def end(self) -> int:
        """The output place of the text's end."""
        return self.words.index(END) if END in self.words[: self.short] else self.place(END)


def vocabulary(counts: DataFrame, short: int, classes: int, common: int) -> Vocabulary:
    """At most ``common`` of the commonest words, a documented bound of what is broadcast."""
    kept, total, distinct = commonest(counts, "n", common)
    rows = sorted(kept.collect(), key=lambda r: (-r.n, bytes(r.token)))
    words = [bytes(r.token) for r in rows]
    short = min(short, len(rows))
    rest = np.ones(classes, np.float64)
    for r in counts.groupBy(F.pmod(F.crc32("token"), F.lit(classes)).alias("k")).agg(F.sum(F.col("n") + 1).alias("n")).collect():
        rest[r.k] += r.n
    for r, w in zip(rows[:short], words, strict=False):
        rest[crc32(w) % classes] -= r.n + 1
    return Vocabulary(words, np.array([r.n for r in rows], np.int64), total, distinct, short, rest)


@dataclass
class LogBilinear:
    """Parameters: vectors q of context places, vectors r of output places with their biases as last column, context matrices c1 and c2."""

    q: np.ndarray
    r: np.ndarray
    c1: np.ndarray
    c2: np.ndarray

    @classmethod
    def start(cls, share: np.ndarray, contexts: int, width: int, seed: int = 5) -> LogBilinear:
        """Biases are the places' shares, so the model starts as the unigram one."""
        rng = np.random.default_rng(seed)
        q, r = (rng.normal(0, 0.1, (size, width)).astype(np.float32) for size in (contexts, len(share)))
        near = [(np.eye(width) + rng.normal(0, 0.02, (width, width))).astype(np.float32) for _ in range(2)]
        return cls(q, np.append(r, np.log(share).astype(np.float32)[:, None], axis=1), *near)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in (self.q, self.r, self.c1, self.c2)]).astype(np.float64)

    def filled(self, flat: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for x in (self.q, self.r, self.c1, self.c2):
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*out)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """``t1[u, w]`` (the bias is in it) and ``t2[v, w]``, with log normalisers taken off later.

        Returns ``(t1, t2, log_z)`` of context by output and context by context
        places; the log-probability of ``w`` after ``u, v``
        (``v`` the nearer) is ``t1[u, w] + t2[v, w] - log_z[u, v]``.
        """
        r, b = self.r[:, :-1], self.r[:, -1]
        t1 = np.clip((self.q @ self.c1.T) @ r.T, -15, 15) + b
        t2 = np.clip((self.q @ self.c2.T) @ r.T, -15, 15)
        return t1, t2, np.log(np.exp(t1) @ np.exp(t2).T)


class Trainer:
    """Noise-contrastive steps with AdaGrad; the noise of a batch is shared by its rows."""

    def __init__(self, model: LogBilinear, share: np.ndarray, noise: int = 64, rate: float = 0.1, seed: int = 0):
        self.m, self.rate, self.noise = model, np.float32(rate), noise
        self.rng = np.random.default_rng(seed)
        self.weight = 10.0  # noise words that stand against each true word
        self.log_noise = (np.log(share) + np.log(self.weight)).astype(np.float32)
        self.cumulated = np.cumsum(share)
        self.sums = [np.full_like(x, 1e-2) for x in (model.q, model.r, model.c1, model.c2)]

    def _rows(self, x: np.ndarray, s: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
        """An AdaGrad step on the rows ``at``; gradients of equal rows are summed."""
        at, width = at.astype(np.uint16), x.shape[1]  # short numbers sort faster
        order = at.argsort(kind="stable")
        ordered = at[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        rows, group = ordered[new], np.empty(len(at), np.int64)
        group[order] = np.cumsum(new) - 1
        cells = (group[:, None] * width + np.arange(width)).ravel()
        total = np.bincount(cells, weights=grad.ravel(), minlength=len(rows) * width).reshape(-1, width).astype(np.float32)
        squares = s[rows] + total**2
        s[rows] = squares
        x[rows] += self.rate * total / np.sqrt(squares)

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        m, n = self.m, len(w)
        qu, qv = m.q.take(u, axis=0), m.q.take(v, axis=0)
        h = np.ones((n, m.r.shape[1]), np.float32)  # the last column is for biases
        np.matmul(qu, m.c1.T, out=h[:, :-1])
        h[:, :-1] += qv @ m.c2.T
        k = np.minimum(np.searchsorted(self.cumulated, self.rng.random(self.noise)), len(self.cumulated) - 1)
        rw, rk = m.r.take(w, axis=0), m.r.take(k, axis=0)
        true = np.einsum("ij,ij->i", h, rw) - self.log_noise[w]
        false = h @ rk.T
        false -= self.log_noise[k]
        g = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        np.clip(false, -30, 30, out=false)
        np.negative(false, out=false)
        np.exp(false, out=false)
        false += 1
        f = np.divide(np.float32(-self.weight / self.noise), false, out=false)
        gh = (g[:, None] * rw + f @ rk)[:, :-1]
        scale = np.float32(1.0 / np.sqrt(n))
        self._rows(m.r, self.sums[1], np.concatenate([w, k]), np.concatenate([g[:, None] * h, f.T @ h]) * scale)
        g1, g2 = gh.T @ qu, gh.T @ qv
        self._rows(m.q, self.sums[0], np.concatenate([u, v]), np.concatenate([gh @ m.c1, gh @ m.c2]) * scale)
        for x, s, grad in ((m.c1, self.sums[2], g1 * scale), (m.c2, self.sums[3], g2 * scale)):
            s += grad**2
            x += np.float32(0.2) * self.rate * grad / np.sqrt(s)


def contexts(numbers: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The two words before each token, texts one after another; the end stands before a text."""
    u, v = np.full(len(numbers), end, numbers.dtype), np.full(len(numbers), end, numbers.dtype)
    v[1:], u[2:] = numbers[:-1], numbers[:-2]
    v[starts] = end
    u[starts] = end
    second = starts + 1
    u[second[second < len(u)]] = end
    return u, v


def _groups(texts: Iterable[bytes], most: int) -> Iterator[tuple[list[list[bytes]], np.ndarray]]:
    """Tokens of texts in groups of about ``most`` tokens, and where each text starts."""
    group: list[list[bytes]] = []
    size = 0
    for text in texts:
        group.append(tokens_of(text))
        size += len(group[-1])
        if size >= most:
            yield group, np.cumsum([0, *map(len, group[:-1])])
            group, size = [], 0
    if group:
        yield group, np.cumsum([0, *map(len, group[:-1])])


class _Places(dict):
    """Output places by word; those of words that are not common are worked out."""

    def __init__(self, vocab: Vocabulary):
        super().__init__(zip(vocab.words, vocab.places.tolist(), strict=True))
        self.place = vocab.place

    def __missing__(self, word: bytes) -> int:
        return self.place(word)


def numbered(learn: DataFrame, sent, shards: int) -> DataFrame:
    """``shard, h, places``: the texts as output places, two bytes a token, in shards sorted by ``h``.

    ``learn`` has ``h``, a hash that tells rows apart, and ``text``. Which shard a
    row is in, and where, follows from ``h`` alone. Written to the shared folder, so
    texts are taken apart once for all rounds.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(sent.value)
        for batch in batches:
            get = places.__getitem__
            found = []
            for text in _texts(batch.column(1)):
                words = tokens_of(text)
                found.append(np.fromiter(map(get, words), np.uint16, len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["h", "places"])

    rows = learn.select("h", "text").mapInArrow(run, "h long, places binary")
    rows = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    return materialize(rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h"))


def targets(starts: np.ndarray, size: int, number: int, rounds: int) -> np.ndarray:
    """The tokens whose places in their texts are ``number`` modulo ``rounds``: over all rounds, each once."""
    lengths = np.diff(np.append(starts, size))
    return np.flatnonzero((np.arange(size) - np.repeat(starts, lengths)) % rounds == number)


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of ``seen`` and ``part`` by ``block``."""
    sums: dict[int, list] = {}
    for b in batches:
        for block, seen, part in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            held = sums.setdefault(block, [0, 0.0])
            held[0] += seen
            held[1] = held[1] + np.frombuffer(part, np.float64)
    blocks = sorted(sums)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(blocks, pa.int32()),
            pa.array([sums[k][0] for k in blocks], pa.int64()),
            pa.array([sums[k][1].tobytes() for k in blocks], pa.binary()),
        ],
        names=["block", "seen", "part"],
    )


def train(numbers: DataFrame, vocab: Vocabulary, width: int = 32, rounds: int = 3, batch: int = 1024) -> LogBilinear:
    """Train on all tokens of ``numbers`` (see :func:`numbered`), dealt over ``rounds`` by their places in their texts.

    In a round each shard starts from the same parameters and trains on its tokens;
    a task adds up its shards' parameters, in blocks, which are summed in two steps,
    so the driver gets one model. The model does not depend on how tasks read the files;
    the same rows in other files are dealt to shards otherwise and give another one.
    """
    model = LogBilinear.start(vocab.share, vocab.contexts, width)
    if not vocab.total:
        return model
    spark = numbers.sparkSession
    schema = "block int, seen long, part binary"
    for number in range(rounds):
        sent = spark.sparkContext.broadcast((vocab.share, vocab.context, vocab.end, model))

        def run(batches: Iterable[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            share, context, end, start = sent.value
            total, seen = 0.0, 0
            shard, trainer, held, size, more = None, None, [], 0, 0

            def learn() -> int:
                nonlocal held, size
                if not held:  # the shard's last text filled a group
                    return 0
                out = np.concatenate(held).astype(np.int64)
                starts = np.cumsum([0, *map(len, held[:-1])])
                held, size = [], 0
                u, v = contexts(context[out], starts, context[end])
                at = targets(starts, len(out), number, rounds)
                trainer.rng.shuffle(at)
                for i in range(0, len(at), batch):
                    k = at[i : i + batch]
                    trainer.step(u[k], v[k], out[k])
                return len(at)

            for b in batches:
                for own, places in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if own != shard:
                        if trainer is not None:
                            more += learn()
                            total, seen, more = total + trainer.m.flat() * more, seen + more, 0
                        shard, trainer = own, Trainer(start.filled(start.flat()), share, rate=0.1 / (1 + number), seed=number)
                    held.append(np.frombuffer(places.as_buffer(), np.uint16))
                    size += len(held[-1])
                    if size >= 200_000:
                        more += learn()
            if trainer is not None:
                more += learn()
                total, seen = total + trainer.m.flat() * more, seen + more
            if seen:
                parts = np.array_split(total, _BLOCKS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(_BLOCKS), pa.int32()), pa.array([seen] * _BLOCKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                    names=["block", "seen", "part"],
                )

        trained = numbers.select("shard", "places").mapInArrow(run, schema)
        for salts in (_BLOCKS, 1):  # task by task first, so that no task adds up all of them
            salt = F.pmod(F.spark_partition_id(), F.lit(salts))
            trained = trained.withColumn("salt", salt).repartition(_BLOCKS * salts, "block", "salt").drop("salt").mapInArrow(_added, schema)
        rows = sorted(trained.collect(), key=lambda r: r.block)
        sent.unpersist()
        if not rows:
            return model
        model = model.filled(np.concatenate([np.frombuffer(r.part, np.float64) / r.seen for r in rows]))
    return model


_TABLES: dict = {}


def _scores(sent, base_log: float):
    """``n_tokens, n_known, base, score`` of each text by its common words, and its other words."""

    @F.arrow_udf("struct<n_tokens:bigint,n_known:bigint,base:double,score:double,others:array<binary>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab, model, key = sent.value
        if key not in _TABLES:  # one model at a time in a worker
            _TABLES.clear()
            _TABLES[key] = ({w: i for i, w in enumerate(vocab.words)}, model.tables())
        ranks, (t1, t2, log_z) = _TABLES[key]
        get, end = ranks.get, vocab.context[vocab.end]
        # By rank; the last (-1) is for words that are not common.
        log_base = np.append(np.log10(vocab.counts + 1.0) - base_log, 0.0)
        log_count = np.append(np.log10(vocab.counts + 1.0), 0.0)
        log_count[: vocab.short] = 0.0
        # By place: what a class's counts are divided by.
        log_rest = np.append(np.zeros(vocab.short), np.log10(vocab.rest))
        for column in batches:
            out: list[list[np.ndarray]] = []
            others: list[bytes] = []
            ends = [np.zeros(1, np.int64)]
            for group, starts in _groups(_texts(column), 200_000):
                words = [w for text in group for w in text]
                rank = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                known = rank >= 0
                place = vocab.places[rank] if len(vocab.words) else np.zeros(len(words), np.int64)
                rare = np.flatnonzero(~known)
                strange = [words[i] for i in rare.tolist()]
                place[rare] = [vocab.place(w) for w in strange]
                u, v = contexts(vocab.context[place], starts, end)
                log_p = (t1[u, place] + t2[v, place] - log_z[u, v]).astype(float) / np.log(10) + log_count[rank] - log_rest[place]
                out.append([np.add.reduceat(x, starts) for x in (np.ones(len(words), np.int64), known.astype(np.int64), log_base[rank], log_p)])
                ends.append(len(others) + np.searchsorted(rare, np.append(starts[1:], len(words))))
                others += strange
            if not out:
                out.append([np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2)
            arrays = [pa.array(np.concatenate([g[i] for g in out])) for i in range(4)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(others, pa.binary()))
            yield pa.StructArray.from_arrays([*arrays, lists], names=["n_tokens", "n_known", "base", "score", "others"])

    return run


def lm_scores(docs: DataFrame, short: int = 4096, classes: int = 4096, common: int = 200_000, width: int = 32, rounds: int = 3) -> DataFrame:
    """Base and model log10 probabilities of every document.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``. Learns from documents whose crc32 of the id's text modulo 7 is not
    2 (``held_out``: it is 2). A null or empty text is its end alone. Counts are
    over all training texts and whole; the ``common`` commonest words are
    broadcast, the others meet their counts in a join. The ``short`` commonest have
    places of their own in the model, all others one of ``classes`` (together under
    65,536). Without training texts every token is unknown. Repeated rows are scored
    alike; an empty table gives an empty one; other columns are not used.
    """
    spark = docs.sparkSession
    held = crc_mod(F.col("doc_id"), 7) == 2
    part, place = fresh(docs, "_part"), fresh(docs, "_place")
    learn = read_order(docs, part, place).where(~held).select(F.xxhash64(place, "doc_id", "text").alias("h"), "text")
    counts = materialize(token_counts(learn))
    vocab = vocabulary(counts, short, classes, common)
    words = spark.sparkContext.broadcast(vocab)
    numbers = numbered(learn, words, max(1, -(-vocab.total // SHARD)))
    model = train(numbers, vocab, width, rounds)
    words.unpersist()
    base_log = float(np.log10(vocab.total + vocab.distinct + 1.0))
    sent = spark.sparkContext.broadcast((vocab, model, hash(model.flat().tobytes())))
    scored = docs.select("doc_id", held.alias("held_out"), _scores(sent, base_log)("text").alias("s"))
    scored = materialize(scored.select("doc_id", "held_out", "s.*", F.monotonically_increasing_id().alias("rid")))
    log = lambda c: F.log10(F.coalesce(c, F.lit(0)) + F.lit(1.0))
    rare = (
        scored.select("rid", F.explode("others").alias("o"))
        .join(counts.select(F.col("token").alias("t"), F.col("n").alias("c")), F.col("o") == F.col("t"), "left")
        .groupBy("rid")
        .agg(
            F.count_if(F.col("c") > 0).alias("known"),
            F.sum(log(F.col("c")) - base_log).alias("base_more"),
            F.sum(log(F.col("c"))).alias("score_more"),
        )
        .withColumnRenamed("rid", "r")
    )
    return scored.drop("others").join(rare, F.col("rid") == F.col("r"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("score_more", F.lit(0.0))).alias("score"),
    )
