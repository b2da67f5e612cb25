"""Token counts: batch encoding that returns lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import by_bytes, text_bytes

#: A place where a text may be cut: one space between two characters that are
#: no spaces. No piece of the vocabulary holds a space mark after another
#: character (``safe_pieces`` checks that), so no token spans such a place, and
#: the library itself puts the space mark before each part.
_CUT = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")


def safe_pieces(processor) -> bool:
    """Whether no piece has a space mark after another character."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return all("▁" not in p.lstrip("▁") for p in pieces)


def size_of(text: str) -> int:
    """Bytes of UTF-8."""
    return len(text) if text.isascii() else len(text.encode())


class PieceCounter:
    """Counts a text's tokens with sentencepiece.

    Texts are cut at safe places; parts that recur are encoded once. New parts
    go to the library in batches of about ``batch_bytes``. ``cache_bytes`` bounds the
    remembered parts, which are forgotten together when there are more. A part
    of more than ``long`` characters is cut between two characters that no piece
    has next to each other: no token spans those either.
    """

    def __init__(self, model_file: str, batch_bytes: int = 1 << 18, cache_bytes: int = 24 << 20, long: int = 1 << 15):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.safe = safe_pieces(self.processor)
        self.batch_bytes, self.cache_bytes, self.long = batch_bytes, cache_bytes, long
        self.known: dict[str, int] = {}
        self.held = 0
        self.pairs: set[str] | None = None

    def _encode(self, parts: list[str]) -> list[int]:
        lengths: list[int] = []
        batch: list[str] = []
        size = 0
        for p in parts:
            batch.append(p)
            size += size_of(p)
            if size >= self.batch_bytes:
                lengths += map(len, self.processor.encode(batch, num_threads=1))
                batch, size = [], 0
        if batch:
            lengths += map(len, self.processor.encode(batch, num_threads=1))
        return lengths

    def _long(self, part: str) -> int:
        """The tokens of a long part: of its stretches, each encoded after the character before it, less that one's."""
        if self.pairs is None:
            pieces = (self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size()))
            self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        shown = part.replace(" ", "▁")
        total, at = 0, 0
        while at < len(part):
            end = at + self.long
            while end < len(part) and shown[end - 1 : end + 1] in self.pairs:
                end += 1
            lead = part[at - 1 : at] if at else ""
            total += len(self.processor.encode(lead + part[at:end])) - (len(self.processor.encode(lead)) if lead else 0)
            at = end
        return total

    def count(self, texts: list[str]) -> list[int]:
        """The numbers of tokens of ``texts``, in order."""
        if not self.safe:
            return self._encode(texts)
        if self.held > self.cache_bytes:
            self.known, self.held = {}, 0
        known = self.known
        cut = [_CUT.split(t) for t in texts]
        new = {p for parts in cut for p in parts if p not in known}
        if new:
            fresh = [p for p in new if len(p) <= self.long]
            known.update(zip(fresh, self._encode(fresh), strict=True))
            known.update((p, self._long(p)) for p in new if len(p) > self.long)
            self.held += sum(map(len, new)) + 100 * len(new)
        get = known.__getitem__
        return [sum(map(get, parts)) for parts in cut]


def count_tokens(
    df: DataFrame, model_file: str, text: str = "text", out: str = "n_tokens", group_bytes: int = 4 << 20
) -> DataFrame:
    """Add the number of tokens of ``text`` as the column ``out``.

    A null counts as the empty text and has no tokens. Texts of any length are
    counted whole. Tasks are narrow: the text goes to Python, in groups of about
    ``group_bytes``, and one integer comes back, no shuffle. Special strings in a text are ordinary text, as the
    library treats them by default. A column that is already called ``out``
    (in any case of its letters) is replaced.
    """
    return df.withColumn(out, _counter(model_file, group_bytes)(F.col(text)))


def _counter(model_file: str, group_bytes: int):
    @F.arrow_udf("bigint")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PieceCounter(model_file)
        for batch in batches:
            data, offsets = text_bytes(batch)
            out: list[int] = []
            for i, j in by_bytes(offsets, group_bytes):
                raw, at = data[offsets[i] : offsets[j]].tobytes(), (offsets[i : j + 1] - offsets[i]).tolist()
                out += counter.count([raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)])
            yield pa.array(out, pa.int64())

    return lengths


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document.

    Null ids and repeated rows stay; an empty table gives an empty one; other columns
    are not used.
    """
    n_bytes: Column = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = count_tokens(docs.select("doc_id", "text"), model_file)
    return counted.select(
        "doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
