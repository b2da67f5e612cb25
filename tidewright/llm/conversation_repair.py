"""Conversation structure repair: the cheapest edits that make turns alternate.

A retained-subsequence search: each turn is kept, given another role, or deleted.
What is retained depends only on the retained turn before it: deleted turns in
between cost by a prefix sum, and the two roles say how many turns have to be
inserted. So a running minimum for each role of the last retained turn prices all
gaps at once. A stretch of turns is in this way a small table from the role before
it to the role after it, which is how a conversation of any length is cut into
ranges that are worked on apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import materialize

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Faults of a turn; of several the first counts.
SOUND, BLANK, DUPLICATE, CUT = range(4)
WHITE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Initials of the last retained turn ("": none yet), and the turns to insert before the next one or the end.
NEXT = {"": {"s": 0, "u": 0, "a": 1}, "s": {"u": 0, "a": 1}, "u": {"u": 1, "a": 0}, "a": {"u": 0, "a": 1}}
END = {"": 0, "s": 2, "u": 1, "a": 0}
ROLE = {"u": "user", "a": "assistant"}
#: Rows of a range of conversations, and bytes of their texts.
EACH, EACH_BYTES = 100_000, 64 << 20


def shape_fault(text: str) -> int:
    """The fault that a turn has by its text alone."""
    body = text.rstrip(WHITE)
    return BLANK if not body else SOUND if body[-1] in ENDS else CUT


def cheapest(turns: list[tuple[str, int]], entry: str = "") -> dict[str, tuple[int, str]]:
    """Cost and audit of the cheapest way to each role after ``turns`` (initial, fault), from ``entry`` before them.

    Of ways of equal cost the one with the ASCII-least audit. Neither of two audits of
    the same turns begins with the other, so their order is that of what came first in
    them: ``rank`` has it, and no audits are compared.
    """
    # By the role of the last retained turn: cost less the prefix sum of deletions, rank of the audit, last link.
    best: dict[str, tuple[int, int, int]] = {entry: (0, 0, -1)}
    links: list[tuple[int, int, str]] = []  # the link before, the turn, what was written for it
    for t, (initial, fault) in enumerate(turns):
        gone = DELETE * t
        # Audits up to this turn, as (rank before, letters): all go on by D, or a role is reached by retaining the turn.
        reach = {q: (net, (rank, "D"), link) for q, (net, rank, link) in best.items()}
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT else 0
            for role in "sua":
                kept = role == initial
                if role == "s" and not kept:
                    continue
                price, letter = extra + (0 if kept else REROLE), "K" if kept else "R"
                ways = [(net + gone + INSERT * NEXT[q][role] + price, (rank, "I" * NEXT[q][role] + letter), link) for q, (net, rank, link) in best.items() if role in NEXT[q]]
                if not ways:
                    continue
                cost, key, link = min(ways, key=lambda w: w[:2])
                net = cost - gone - DELETE
                if role not in reach or (net, key) < reach[role][:2]:
                    links.append((link, t, key[1]))
                    reach[role] = (net, key, len(links) - 1)
        order = {key: i for i, key in enumerate(sorted(key for _, key, _ in reach.values()))}
        best = {q: (net, order[key], link) for q, (net, key, link) in reach.items()}
    found = {}
    for q, (net, _, link) in best.items():
        parts, upto = [], len(turns)
        while link >= 0:
            before, t, letters = links[link]
            parts += ["D" * (upto - t - 1), letters]
            link, upto = before, t
        parts.append("D" * upto)
        found[q] = (net + DELETE * len(turns), "".join(reversed(parts)))
    return found


def ended(best: dict[str, tuple[int, str]]) -> tuple[int, str, str]:
    """The cheapest whole: cost, audit, and the role it ends in before the last inserts."""
    cost, audit, q = min((cost + INSERT * END[q], audit + "I" * END[q], q) for q, (cost, audit) in best.items())
    return cost, audit, q


class Writer:
    """Repaired turns from audits, in order."""

    def __init__(self):
        self.last = ""

    def insert(self, n: int) -> Iterator[tuple[str, str]]:
        for _ in range(n):
            self.last = "a" if self.last == "u" else "u"
            yield ROLE[self.last], ""

    def turn(self, token: str, role: str | None, text: str | None) -> Iterator[tuple[str, str]]:
        """What a turn's letters (inserts, then K, R or D) write."""
        yield from self.insert(token.count("I"))
        if token.endswith("K"):
            self.last = role[:1]
            yield role, text
        elif token.endswith("R"):
            self.last = "a" if self.last == "u" else "u"
            yield ROLE[self.last], text


def tokens(audit: str) -> tuple[list[str], int]:
    """The letters of each turn, and the number of inserts after the last one."""
    out, inserts = [], 0
    for letter in audit:
        if letter == "I":
            inserts += 1
        else:
            out.append("I" * inserts + letter)
            inserts = 0
    return out, inserts


class Facts:
    """Counts over turns in order: faults, illegal pairs, and gaps in their numbers."""

    def __init__(self):
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.low = self.high = None

    def add(self, initial: str, fault: int, turn: int | None) -> None:
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == CUT
        self.illegal += self.n > 0 and self.last + initial not in ("su", "ua", "au")
        self.first, self.last = (initial if self.first is None else self.first), initial
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn
        self.n += 1

    def join(self, after: Facts) -> None:
        """Take in the facts of the turns that follow."""
        if not after.n:
            return
        for name in ("blank", "duplicate", "truncated", "illegal", "distinct"):
            setattr(self, name, getattr(self, name) + getattr(after, name))
        self.illegal += self.n > 0 and self.last + after.first not in ("su", "ua", "au")
        self.distinct -= self.high is not None and self.high == after.low
        self.first, self.last = (self.first if self.n else after.first), after.last
        self.low, self.high = (after.low if self.low is None else self.low), (self.high if after.high is None else after.high)
        self.n += after.n

    def counts(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_REPORT = ", ".join(f"{c} bigint" for c in (*COUNTS, "cost")) + ", audit string, repaired_sha256 string"
_LINE = "_at bigint, new_role string, new_text string"


class _Hash:
    """SHA-256 of ``role:text`` lines, a line at a time."""

    def __init__(self):
        self.hash, self.n = hashlib.sha256(), 0

    def add(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.n else "") + f"{role}:{text}").encode())
        self.n += 1

    def hex(self) -> str:
        return self.hash.hexdigest()


def _streamed(rows: DataFrame, schema: str, task: Callable[[Iterator[tuple]], Iterator[tuple]], each: int = 2000) -> DataFrame:
    """Run ``task`` on the rows of each partition in turn; what it yields goes on in small batches."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    made = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(made)

        def read() -> Iterator[tuple]:
            for batch in batches:
                for i in range(0, batch.num_rows, 1000):
                    yield from zip(*[c.to_pylist() for c in batch.slice(i, 1000).columns], strict=True)

        def put(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        out: list[tuple] = []
        for row in task(read()):
            out.append(row)
            if len(out) >= each:
                yield put(out)
                out = []
        if out:
            yield put(out)

    return rows.mapInArrow(run, made)


def _in_ranges(turns: DataFrame, absent: str | None) -> DataFrame:
    """``conv_id, turn, role, text, _gone`` by ranges of conversations and turns, each sorted.

    Turns of equal number are in the order of their roles, and then of a hash of role and text.
    """
    gone = F.lit(False) if absent is None else F.coalesce(F.col(absent), F.lit(False))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], gone.alias("_gone"))
    rows = rows.withColumn("_h", F.xxhash64("role", "text")).withColumn("_id", F.monotonically_increasing_id())
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    least = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "_h", "_id"]
    return rows.repartitionByRange(max(least, -(-seen.n // EACH), -(-(seen.b or 0) // EACH_BYTES)), *order).sortWithinPartitions(*order).drop("_h", "_id")


def _solved(rows: list[tuple]) -> tuple[Facts, int, str, list[tuple[str, str]]]:
    """Facts, cost, audit and repaired turns of a conversation's ``(turn, role, text)``."""
    facts, met, turns = Facts(), set(), []
    for turn, role, text in rows:
        fault = shape_fault(text)
        if fault != BLANK:
            fault = DUPLICATE if (role, text) in met else fault
            met.add((role, text))
        facts.add(role[:1], fault, turn)
        turns.append((role[:1], fault))
    cost, audit, _ = ended(cheapest(turns))
    writer, lines = Writer(), []
    each, more = tokens(audit)
    for token, (_, role, text) in zip(each, rows, strict=True):
        lines += writer.turn(token, role, text)
    return facts, cost, audit, lines + list(writer.insert(more))


def _first_pass(rows: DataFrame, schema: str, whole: Callable[[object, list[tuple]], Iterator[tuple]], blanks: int) -> DataFrame:
    """Work on conversations that lie in one range; the turns of those that may go on in another pass through.

    Those are a range's first and last. ``whole`` makes the rows of a conversation; the
    others have ``_part``, the range, and ``_place`` among the turns in it (none: the turn is absent).
    """
    nothing = (None,) * blanks
    placed = rows.withColumn("_part", F.spark_partition_id())

    def run(stream: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        conv, number, place, part = None, 0, 0, None

        def through(turn: int | None, role: str, text: str, gone: bool) -> tuple:
            nonlocal place
            place += not gone
            return (conv, *nothing, part, None if gone else place - 1, turn, role, text)

        for key, turn, role, text, gone, part in stream:
            if number == 0 or key != conv:
                if number > 1:
                    yield from whole(conv, [r[:3] for r in held if not r[3]])
                conv, number, held, place = key, number + 1, [], 0
            if number == 1:  # the first one is not held
                yield through(turn, role, text, gone)
            else:
                held.append((turn, role, text, gone))
        for row in held:
            yield through(*row)

    kind = dict(rows.dtypes)["conv_id"]
    return _streamed(placed, f"conv_id {kind}, {schema}, _part int, _place bigint, turn bigint, role string, text string", run)


def _token_rows(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of conversations over several ranges: a report of each, and the letters of each turn.

    A range is solved for each role before it, on initials and faults only; the
    tables of a conversation's ranges are joined in order, which says how it is entered.
    """
    kind = dict(open_.dtypes)["conv_id"]
    present = open_.where("_place is not null")
    body = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    shape = F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(*ENDS), SOUND).otherwise(CUT)
    small = present.select("conv_id", "_part", "_place", "turn", F.substring("role", 1, 1).alias("initial"), shape.alias("fault"), F.sha2(F.concat_ws("\0", "role", "text"), 256).alias("_d"))
    # The first turn of each text; found by partial sums, so that a text may have any share of the rows.
    again = small.where(F.col("fault") != BLANK).groupBy(F.col("conv_id").alias("_c"), F.col("_d").alias("_e")).agg(F.min(F.struct("_part", "_place")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_d") == F.col("_e"))
    joined = small.join(again.where("_n > 1"), same, "left")
    repeated = (F.col("fault") != BLANK) & (F.struct("_part", "_place") != F.col("_first"))
    coded = joined.select("conv_id", "_part", "_place", "turn", "initial", F.when(repeated, DUPLICATE).otherwise(F.col("fault")).alias("fault"))
    coded = coded.repartition("conv_id", "_part").sortWithinPartitions("conv_id", "_part", "_place")
    fact = "n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, distinct bigint, first string, last string, low bigint, high bigint"
    names = [f.split()[0] for f in fact.split(", ")]

    def solve(stream: Iterator[tuple]) -> Iterator[tuple]:
        key, facts, turns = None, Facts(), []

        def done() -> Iterator[tuple]:
            for entry in NEXT:
                ways = cheapest(turns, entry)
                yield (*key, *[getattr(facts, n) for n in names], entry, list(ways), [c for c, _ in ways.values()], [a for _, a in ways.values()])

        for conv, part, _, turn, initial, fault in stream:
            if (conv, part) != key:
                if key is not None:
                    yield from done()
                key, facts, turns = (conv, part), Facts(), []
            facts.add(initial, fault, turn)
            turns.append((initial, fault))
        if key is not None:
            yield from done()

    parts = _streamed(coded, f"conv_id {kind}, _part int, {fact}, entry string, roles array<string>, costs array<bigint>, audits array<string>", solve, each=1)
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "_part", "entry")

    def fold(stream: Iterator[tuple]) -> Iterator[tuple]:
        conv, facts, best, steps, part, tables = None, None, {}, [], None, {}

        def step() -> None:
            """Take in a range: of each role after it the cheapest way."""
            ways: dict[str, tuple] = {}
            for entry, (cost, rank) in best.items():
                for q, (more, audit) in tables[entry].items():
                    way = (cost + more, (rank, audit), entry)
                    if q not in ways or way[:2] < ways[q][:2]:
                        ways[q] = way
            order = {key: i for i, key in enumerate(sorted(key for _, key, _ in ways.values()))}
            steps.append((part, {q: (entry, key[1]) for q, (_, key, entry) in ways.items()}))
            best.clear()
            best.update({q: (cost, order[key]) for q, (cost, key, _) in ways.items()})

        def done() -> Iterator[tuple]:
            step()
            cost, _, q = min((cost + INSERT * END[q], (rank, "I" * END[q]), q) for q, (cost, rank) in best.items())
            tail = "I" * END[q]
            path = [(None, tail)]
            for at, ways in reversed(steps):
                q, audit = ways[q]
                path.append((at, audit))
            path.reverse()
            yield (conv, *facts.counts(), cost, "".join(a for _, a in path), None, None)
            for at, audit in path:
                yield (conv, *[None] * 7, at, audit)

        for row in stream:
            key, at, entry = row[0], row[1], row[-4]
            if facts is None or key != conv:
                if facts is not None:
                    yield from done()
                conv, facts, part, tables, steps = key, Facts(), None, {}, []
                best.clear()
                best[""] = (0, 0)
            if at != part:
                if part is not None:
                    step()
                part, tables, more = at, {}, Facts()
                for n, v in zip(names, row[2:], strict=False):
                    setattr(more, n, v)
                facts.join(more)
            tables[entry] = {q: (c, a) for q, c, a in zip(*row[-3:], strict=True)}
        if facts is not None:
            yield from done()

    counts = ", ".join(f"{c} bigint" for c in (*COUNTS, "cost"))
    folded = materialize(_streamed(parts, f"conv_id {kind}, {counts}, audit string, _part int, _letters string", fold, each=1))
    reports = folded.where("audit is not null").select("conv_id", *COUNTS, "cost", "audit")
    letters = folded.where("audit is null")
    inside = letters.where("_part is not null").select("conv_id", "_part", F.posexplode(F.regexp_extract_all("_letters", F.lit("I*[KRD]"), F.lit(0))).alias("_nth", "token"))
    after = letters.where("_part is null and _letters <> ''").select("conv_id", F.lit((1 << 31) - 1).alias("_part"), F.lit(0).alias("_nth"), F.col("_letters").alias("token"))
    return reports, inside.unionByName(after)


def _ordered_tokens(open_: DataFrame, token_rows: DataFrame) -> DataFrame:
    """``conv_id, token, role, text`` of open conversations, each conversation in order in one task's stream."""
    t = token_rows.select(F.col("conv_id").alias("_c"), F.col("_part").alias("_p"), F.col("_nth"), "token")
    present = open_.where("_place is not null").select("conv_id", "_part", "_place", "role", "text")
    same = t["_c"].eqNullSafe(F.col("conv_id")) & (F.col("_p") == F.col("_part")) & (F.col("_nth") == F.col("_place"))
    both = t.join(present, same, "left").select(F.col("_c").alias("conv_id"), "_p", "_nth", "token", "role", "text")
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "_p", "_nth").drop("_p", "_nth")


def _written(rows: DataFrame, schema: str, make: Callable[[], object]) -> DataFrame:
    """Stream the repaired turns of each conversation through what ``make`` gives (``add``, and ``end``)."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(stream: Iterator[tuple]) -> Iterator[tuple]:
        conv, writer, sink = None, None, None
        for key, token, role, text in stream:
            if writer is None or key != conv:
                if writer is not None:
                    yield from ((conv, *r) for r in sink.end())
                conv, writer, sink = key, Writer(), make()
            lines = writer.turn(token, role, text) if token[-1] != "I" else writer.insert(len(token))
            for line in lines:
                yield from ((conv, *r) for r in sink.add(*line))
        if writer is not None:
            yield from ((conv, *r) for r in sink.end())

    return _streamed(rows, f"conv_id {kind}, {schema}", run)


class _Digest(_Hash):
    def add(self, role: str, text: str) -> Iterator[tuple]:
        super().add(role, text)
        return iter(())

    def end(self) -> Iterator[tuple]:
        yield (self.hex(),)


class _Lines:
    def __init__(self):
        self.at = 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        yield self.at, role, text
        self.at += 1

    def end(self) -> Iterator[tuple]:
        return iter(())


def repair_conversations(turns: DataFrame, absent: str | None = None) -> DataFrame:
    """A row a conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``turns`` has ``conv_id, turn, role, text``; null roles and texts are one space, and an
    empty role is none that can be kept. Turns are taken by number, nulls first; those
    of equal number by role, then by a hash of role and text. Retained turns and inserts have the
    initials ``(s?(ua)+)?``; ``audit`` has the letters K, R, D, I of the cheapest edits,
    the ASCII-least of equally cheap ones. ``repaired_sha256`` is of the repaired turns'
    ``role:text`` joined by newlines. Turns whose column ``absent`` is true are not there, but
    their conversation is: without turns it has zeros, an empty audit and the hash of
    the empty text. A null ``conv_id`` is a conversation. Other columns are not used.

    Turns move once, to ranges of conversations and numbers of bounded size. Conversations
    inside a range are done there; the first and the last one of a range, and so any of
    more than a range, in :func:`_token_rows`, a range a task. Only their SHA-256 is then
    taken in one stream a conversation, as it has to be; it holds one turn at a time.
    """

    def whole(conv: object, rows: list[tuple]) -> Iterator[tuple]:
        facts, cost, audit, lines = _solved(rows)
        hash_ = _Hash()
        for line in lines:
            hash_.add(*line)
        yield (conv, *facts.counts(), cost, audit, hash_.hex(), None, None, None, None, None)

    first = materialize(_first_pass(_in_ranges(turns, absent), _REPORT, whole, 8))
    names = [*COUNTS, "cost", "audit", "repaired_sha256"]
    open_ = first.where("_part is not null")
    reports, letters = _token_rows(open_)
    hashes = _written(_ordered_tokens(open_, letters), "repaired_sha256 string", _Digest).withColumnRenamed("conv_id", "_h")
    ids = open_.select(F.col("conv_id").alias("_c")).distinct()
    made = ids.join(reports, F.col("_c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(hashes, F.col("_c").eqNullSafe(F.col("_h")), "left")
    none = {"audit": "", "repaired_sha256": _Hash().hex()}
    made = made.select(F.col("_c").alias("conv_id"), *[F.coalesce(n, F.lit(none.get(n, 0))).alias(n) for n in names])
    return first.where("_part is null").select("conv_id", *names).unionByName(made)


def repaired_turns(turns: DataFrame, absent: str | None = None) -> DataFrame:
    """``conv_id, place, role, text``: the repaired turns of :func:`repair_conversations`, in order of ``place``."""

    def whole(conv: object, rows: list[tuple]) -> Iterator[tuple]:
        for at, line in enumerate(_solved(rows)[3]):
            yield (conv, at, *line, None, None, None, None, None)

    first = materialize(_first_pass(_in_ranges(turns, absent), _LINE, whole, 3))
    open_ = first.where("_part is not null")
    lines = _written(_ordered_tokens(open_, _token_rows(open_)[1]), _LINE, _Lines)
    made = first.where("_part is null").select("conv_id", "_at", "new_role", "new_text").unionByName(lines)
    return made.select("conv_id", F.col("_at").alias("place"), F.col("new_role").alias("role"), F.col("new_text").alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, absent``: turns with faults by ``crc32(conv_id:turn) % 20``.

    0 leaves a turn out, 1 empties its text, 2 takes the ends of its sentences away,
    3 repeats it, 4 makes its role user; nulls are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    k = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(space("text"), ENDS, "")).otherwise(space("text"))
    times = F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(k == 4, "user").otherwise(space("role"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (k == 0).alias("absent"), times.alias("_copy")).drop("_copy")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """:func:`repair_conversations` of :func:`damaged` turns."""
    return repair_conversations(damaged(turns), absent="absent")


#: The same in SQL: the search goes on by a turn a step, with a row for each conversation and role of the last retained turn.
REPAIR_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::UBIGINT),
    lambda crc, b: list_reduce([xor(crc, b), 1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END), 4294967295::UBIGINT) AS crc FROM conversations),
m AS (SELECT *, xor(crc, 4294967295::UBIGINT) % 20 AS d FROM k),
x AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE d WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM m),
r AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, lag(role) OVER w AS prior FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 'truncated' ELSE '' END AS fault FROM r),
e AS (SELECT * FROM (VALUES ('', 's', 0), ('', 'u', 0), ('', 'a', 1), ('s', 'u', 0), ('s', 'a', 1), ('u', 'u', 1), ('u', 'a', 0), ('a', 'u', 0), ('a', 'a', 1)) t(q, r, ins)),
way AS (SELECT f.conv_id, f.i, q, r, ins * 2 + (fault = 'truncated')::INT + CASE WHEN role[1:1] = r THEN 0 ELSE 2 END AS price, repeat('I', ins) || CASE WHEN role[1:1] = r THEN 'K' ELSE 'R' END AS letters,
    repeat(CASE r WHEN 'u' THEN E'assistant:
' ELSE E'user:
' END, ins) || CASE WHEN role[1:1] = r THEN role WHEN r = 'u' THEN 'user' ELSE 'assistant' END || ':' || text || E'
' AS lines
  FROM f, e WHERE fault NOT IN ('blank', 'duplicate') AND (r <> 's' OR role[1:1] = 's')
  UNION ALL SELECT f.conv_id, f.i, q, q, 3, 'D', '' FROM f, (VALUES (''), ('s'), ('u'), ('a')) t(q)),
dp AS (SELECT conv_id, 0::BIGINT AS i, '' AS q, 0 AS cost, '' AS audit, '' AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, q, (b).cost, (b).audit, (b).lines FROM (
    SELECT dp.conv_id, dp.i + 1 AS i, way.r AS q, min({'cost': dp.cost + price, 'audit': dp.audit || letters, 'lines': dp.lines || way.lines}) AS b
    FROM dp JOIN way ON dp.conv_id IS NOT DISTINCT FROM way.conv_id AND way.i = dp.i + 1 AND way.q = dp.q GROUP BY ALL)),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prior IS NOT NULL AND prior[1:1] || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
last AS (SELECT dp.conv_id, min({'cost': cost + 2 * ins, 'audit': audit || repeat('I', ins), 'lines': lines || tail}) AS b
  FROM dp JOIN (VALUES ('', 0, ''), ('s', 2, E'user:
assistant:
'), ('u', 1, E'assistant:
'), ('a', 0, '')) t(q, ins, tail) USING (q) LEFT JOIN n ON dp.conv_id IS NOT DISTINCT FROM n.conv_id WHERE i = coalesce(n.n, 0) GROUP BY 1)
SELECT last.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  (b).cost::BIGINT AS cost, (b).audit AS audit, sha256((b).lines[:-2]) AS repaired_sha256 FROM last LEFT JOIN n ON last.conv_id IS NOT DISTINCT FROM n.conv_id
"""
