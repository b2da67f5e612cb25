"""Fill-in-the-middle: texts cut in three and written with the middle last.

Cuts are found by overlapping chunks. Whether a unit (a code point, a word, a
line) begins at a byte shows in that byte and the one before, so chunks that
overlap by a byte count their units apart from each other. Prefix sums over the
counts say which chunk holds a wanted unit, and only that chunk is looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import by_bytes, text_bytes

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk.
CHUNK = 4096

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def begins(before: np.ndarray, here: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit begins at each byte of ``here``, by it and the byte before.

    A ``char`` is a code point; a ``word`` has the white space after it (that at the
    start of a text is a unit of its own), and a ``line`` its end.
    """
    if unit == "char":
        return (here & 0xC0) != 0x80
    if unit == "word":
        return _SPACE[before] & ~_SPACE[here]
    if unit == "line":
        return before == 10
    raise ValueError(f"no such unit: {unit}")


class Chunks:
    """The chunks of a batch of texts, and how many units begin in each and before it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str, size: int = CHUNK):
        self.data, self.offsets, self.unit = data, offsets, unit
        of_text = -(-np.diff(offsets) // size)  # chunks of each text; an empty one has none
        self.first = np.concatenate([[0], np.cumsum(of_text)])
        text = np.repeat(np.arange(len(of_text)), of_text)
        within = np.arange(len(text)) - self.first[text]
        self.starts = np.append(offsets[text] + within * size, len(data))
        self.opens = within == 0  # the first unit of a text begins whatever lies before
        counts = np.zeros(len(text), np.int64)
        for i, j in by_bytes(self.starts, 1 << 20):
            a = self.starts[i]
            counts[i:j] = np.add.reduceat(self.marks(i, j), self.starts[i:j] - a, dtype=np.int64)
        self.upto = np.concatenate([[0], np.cumsum(counts)])

    def marks(self, i: int, j: int) -> np.ndarray:
        """Where units begin in the chunks ``i`` to ``j``, which overlap with what lies before by a byte."""
        a, b = self.starts[i], self.starts[j]
        before = np.empty(b - a, np.uint8)
        before[0] = self.data[a - 1] if a else 0
        before[1:] = self.data[a : b - 1]
        marks = begins(before, self.data[a:b], self.unit)
        marks[self.starts[i:j][self.opens[i:j]] - a] = True
        return marks

    def units(self) -> np.ndarray:
        """The number of units of each text."""
        return self.upto[self.first[1:]] - self.upto[self.first[:-1]]

    def cut(self, ranks: np.ndarray) -> np.ndarray:
        """The byte of each text (from its start) where the unit numbered ``ranks`` begins; its end if there is none."""
        ends = np.diff(self.offsets)
        wanted = self.upto[self.first[:-1]] + ranks
        inside = np.flatnonzero(ranks < self.units())
        owner = np.searchsorted(self.upto, wanted[inside], side="right") - 1
        out = ends.copy()
        for text, k in zip(inside.tolist(), owner.tolist(), strict=True):
            at = np.flatnonzero(self.marks(k, k + 1))[wanted[text] - self.upto[k]]
            out[text] = self.starts[k] + at - self.offsets[text]
        return out


def cuts(column: pa.Array, one: np.ndarray, other: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the bytes after the smaller and the larger of ``one`` and ``other`` modulo units + 1."""
    data, offsets = text_bytes(column)
    chunks = Chunks(data, offsets, unit)
    n = chunks.units()
    a, b = one % (n + 1), other % (n + 1)
    return n, chunks.cut(np.minimum(a, b)), chunks.cut(np.maximum(a, b))


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` wrote as ``output`` in ``form``.

    The marks stand once each: a text that holds one is written plainly.
    """
    after = lambda mark: F.substring_index(output, mark, -1)
    prefix = F.substring_index(F.substring_index(after(PREFIX), SUFFIX, 1), MIDDLE, 1)
    suffix = F.substring_index(F.substring_index(after(SUFFIX), PREFIX, 1), MIDDLE, 1)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, after(MIDDLE), suffix))


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, unit: str = "char", id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``fim``: ``form, output, units, prefix, middle, suffix`` of each text.

    Of 100 texts ``rate`` are cut and of 100 of these ``spm`` have the suffix first; which,
    and where, is told by the SHA-256 of ``seed:id``. Empty texts and those that hold a
    mark are plain: their output is the text, and ``prefix``, ``middle``, ``suffix``
    are null. A null text is the empty text, a null id the empty id; equal ids are
    cut by the same numbers. A very long text is a few chunks at a time. Only the
    cuts come from Python; rows and other columns stay as they are, but for a
    column ``fim``, which is replaced. One narrow pass.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]

    @F.arrow_udf("struct<units: bigint, first: bigint, second: bigint>")
    def found(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, one, other in batches:
            n, first, second = cuts(column, one.to_numpy(zero_copy_only=False), other.to_numpy(zero_copy_only=False), unit)
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, first, second)], ["units", "first", "second"])

    at, raw = F.col("fim"), source.cast("binary")
    piece = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    prefix, middle, suffix = piece(F.lit(0), at["first"]), piece(at["first"], at["second"]), piece(at["second"], F.length(raw))
    marked = F.contains(source, F.lit(PREFIX)) | F.contains(source, F.lit(SUFFIX)) | F.contains(source, F.lit(MIDDLE))
    form = F.when((source == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    cut = form != "plain"
    parts = {"prefix": prefix, "middle": middle, "suffix": suffix}
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(form == "plain", source).when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    made = F.struct(form.alias("form"), output.alias("output"), at["units"].alias("units"), *[F.when(cut, c).alias(name) for name, c in parts.items()])
    return docs.withColumn("fim", found(source, h[0], h[1])).withColumn("fim", made)


def fill_in_middle_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of :func:`fill_in_middle`."""
    done = fill_in_middle(docs.select("doc_id", "text"))
    fim = F.col("fim")
    return done.select(
        "doc_id",
        fim["units"].alias("n"),
        fim["form"].alias("form"),
        F.length(fim["prefix"]).cast("long").alias("prefix_chars"),
        F.length(fim["middle"]).cast("long").alias("middle_chars"),
        F.sha2(fim["output"], 256).alias("output_sha256"),
        F.sha2(restored(fim["output"], fim["form"]), 256).alias("restored_sha256"),
    )


DIGEST_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM o
"""
