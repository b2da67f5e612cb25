"""Binary payloads: AES in CBC mode and MessagePack."""

from __future__ import annotations

import base64
import json
import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


def decrypt(body: Column, key: Column, iv: Column) -> Column:
    """AES-CBC with PKCS#7 padding; null if the body or its padding does not fit."""
    fits = (F.length(body) > 0) & (F.length(body) % 16 == 0)
    return F.when(fits, F.try_aes_decrypt(F.concat(iv, body), key, F.lit("CBC"), F.lit("PKCS")))


def encrypt(body: Column, key: Column, iv: Column) -> Column:
    """The inverse of :func:`decrypt`: the vector is not part of the result."""
    whole = F.aes_encrypt(body, key, F.lit("CBC"), F.lit("PKCS"), iv)
    return F.substring(whole, 17, 1 << 30)


#: Arrays and maps in each other; what is nested deeper is no value.
DEPTH = 128


class _Reader:
    """Reads one MessagePack value; ValueError if the bytes are none."""

    def __init__(self, data: bytes):
        self.data, self.at, self.depth = data, 0, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack(">" + form, self.take(struct.calcsize(form)))[0]

    def text(self, n: int) -> str:
        try:
            return self.take(n).decode()
        except UnicodeDecodeError:
            return ""

    def blob(self, n: int) -> str:
        return base64.b64encode(self.take(n)).decode()

    def real(self, form: str) -> float:
        x = self.number(form)
        if not math.isfinite(x):
            raise ValueError("not a finite number")
        return x

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            raise ValueError("nested too deep")

    def array(self, n: int) -> list:
        self.deeper()
        out = [self.value() for _ in range(n)]
        self.depth -= 1
        return out

    def object(self, n: int) -> dict:
        self.deeper()
        out = {}
        for _ in range(n):
            key, value = self.value(), self.value()
            if isinstance(key, str):
                out[key] = value
            elif isinstance(key, int) and not isinstance(key, bool):
                out[str(key)] = value
        self.depth -= 1
        return out

    def value(self):
        c = self.take(1)[0]
        if c < 0x80:
            return c
        if c < 0x90:
            return self.object(c & 15)
        if c < 0xA0:
            return self.array(c & 15)
        if c < 0xC0:
            return self.text(c & 31)
        if c >= 0xE0:
            return c - 256
        if c in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[c]
        if c in _SIZED:
            sort, form = _SIZED[c]
            n = self.number(form) if len(form) == 1 and not form.isdigit() else int(form)
            if sort == "ext":
                self.take(1)  # its kind
                return self.blob(n)
            return {"bin": self.blob, "str": self.text, "map": self.object, "array": self.array}[sort](n)
        if c in _NUMBERS:
            form = _NUMBERS[c]
            return self.real(form) if form in "fd" else self.number(form)
        raise ValueError("no such type")


#: Fixed values of the format: first byte, and the form of what follows.
_NUMBERS = {0xCA: "f", 0xCB: "d", 0xCC: "B", 0xCD: "H", 0xCE: "I", 0xCF: "Q", 0xD0: "b", 0xD1: "h", 0xD2: "i", 0xD3: "q"}
_SIZED = {
    0xC4: ("bin", "B"), 0xC5: ("bin", "H"), 0xC6: ("bin", "I"),
    0xC7: ("ext", "B"), 0xC8: ("ext", "H"), 0xC9: ("ext", "I"),
    0xD4: ("ext", "1"), 0xD5: ("ext", "2"), 0xD6: ("ext", "4"), 0xD7: ("ext", "8"), 0xD8: ("ext", "16"),
    0xD9: ("str", "B"), 0xDA: ("str", "H"), 0xDB: ("str", "I"),
    0xDC: ("array", "H"), 0xDD: ("array", "I"), 0xDE: ("map", "H"), 0xDF: ("map", "I"),
}


def unpack(data: bytes) -> str:
    """MessagePack bytes as JSON text.

    Whole-number keys become text and keys of other kinds are left out; binary
    values become base64; a text that is no UTF-8 is empty. ValueError for bytes
    that are no value, or one nested over ``DEPTH`` deep.
    """
    return json.dumps(_Reader(data).value(), ensure_ascii=False, separators=(",", ":"))


def pack(value) -> bytes:
    """JSON-like data as MessagePack, in the shortest forms."""
    if value is None or isinstance(value, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[value]
    if isinstance(value, int):
        if 0 <= value < 128 or -32 <= value < 0:
            return struct.pack(">B", value & 255)
        for byte, form in ((0xCC, "B"), (0xCD, "H"), (0xCE, "I"), (0xCF, "Q")) if value > 0 else ((0xD0, "b"), (0xD1, "h"), (0xD2, "i"), (0xD3, "q")):
            try:
                return bytes([byte]) + struct.pack(">" + form, value)
            except struct.error:
                continue
        raise ValueError("too large")
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, bytes):
        return b"\xc6" + struct.pack(">I", len(value)) + value
    if isinstance(value, str):
        raw = value.encode()
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else b"\xdb" + struct.pack(">I", len(raw))) + raw
    if isinstance(value, (list, tuple)):
        return (bytes([0x90 | len(value)]) if len(value) < 16 else b"\xdd" + struct.pack(">I", len(value))) + b"".join(map(pack, value))
    if isinstance(value, dict):
        head = bytes([0x80 | len(value)]) if len(value) < 16 else b"\xdf" + struct.pack(">I", len(value))
        return head + b"".join(pack(k) + pack(v) for k, v in value.items())
    raise TypeError(type(value).__name__)


def object_text(text: Column) -> Column:
    """JSON text whose value is an object, as it is (so its members keep their order); null for any other value."""
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)


@F.arrow_udf(StringType())
def msgpack_to_json(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Arrow batches of MessagePack to JSON text; null where the bytes are no value.

    Spark has no such function; this is the one codec that runs in Python.
    """

    def one(data: bytes | None) -> str | None:
        try:
            return None if data is None else unpack(data)
        except (ValueError, struct.error):
            return None

    for column in batches:
        yield pa.array([one(x.as_py()) for x in column], pa.string())


@F.arrow_udf(BinaryType())
def json_to_msgpack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The inverse, for writing payloads; null for null or text that is no JSON."""

    def one(text: str | None) -> bytes | None:
        try:
            return None if text is None else pack(json.loads(text))
        except (ValueError, RecursionError):  # no JSON, or nested without end
            return None

    for column in batches:
        yield pa.array([one(x.as_py()) for x in column], pa.binary())
