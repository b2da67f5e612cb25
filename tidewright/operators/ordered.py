"""Restores that keep the order of members: from JSON text to JSON text.

A variant sorts its members by name. Here an object is a list of names and texts, in
order: a record's fields as its schema lists them, then what it has besides, as it came. A
schema is compiled to one column expression, as in :mod:`tidewright.operators.restore`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.operators.restore import Registry, Restore, kind

NULL = "null"


def _pairs(text: Column) -> Column:
    """Names and JSON texts of an object's members, in order; null if it is none."""
    raw = F.map_entries(F.from_json(text, "map<string,string>"))
    typed = F.map_values(F.from_json(text, "map<string,variant>"))
    return F.zip_with(raw, typed, lambda r, v: F.struct(r["key"].alias("key"), _as_text(v, r["value"]).alias("value")))


def _items(text: Column) -> Column:
    """JSON texts of an array's elements; null if it is none."""
    return F.zip_with(F.from_json(text, "array<variant>"), F.from_json(text, "array<string>"), _as_text)


def _as_text(value: Column, raw: Column) -> Column:
    """The JSON text of a value: what stands there, but for strings, whose quotes the parser takes away."""
    return F.coalesce(F.when(kind(value) == "STRING", F.to_json(value)).otherwise(raw), F.lit("null"))


def _string(text: str | Column) -> Column:
    return F.to_json((F.lit(text) if isinstance(text, str) else text).cast("variant"))


def _object(pairs: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(_string(p["key"]), F.lit(":"), p["value"])), ","), F.lit("}"))


def _array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


class OrderedRegistry(Registry):
    """A schema bundle whose restores are from JSON text to JSON text.

    Values that do not fit their schema pass through as they are. White space between
    members is not kept, and of numbers the value is (1.50 is 1.5).
    """

    def compile(self, schema, depth: int = 12) -> Restore:
        if isinstance(schema, list):
            rest = [s for s in schema if s != "null"]
            inner = self.compile(rest[0], depth) if rest else (lambda t: t)
            return lambda t: F.when(t == NULL, t).otherwise(inner(t))
        if isinstance(schema, str):
            if schema == "null":
                return lambda t: F.lit(NULL)
            found = self.records.get(schema)
            return self.compile(found, depth - 1) if found is not None and depth > 0 else (lambda t: t)
        sort = schema["type"]
        if sort == "array":
            inner = self.compile(schema["items"], depth)
            return lambda t: F.when(_starts(t, "["), _array(F.transform(_items(t), inner))).otherwise(t)
        if sort == "map":
            inner = self.compile(schema["values"], depth)

            def mapped(t: Column) -> Column:
                done = F.transform(_pairs(t), lambda p: F.struct(p["key"].alias("key"), inner(p["value"]).alias("value")))
                return F.when(_starts(t, "{"), _object(done)).otherwise(t)

            return mapped
        if sort == "record":
            return self._tagged(schema, depth) if schema.get("msgpack_unions") else self._record(schema, depth)
        return self.compile(sort, depth) if not isinstance(sort, str) or sort in self.records else (lambda t: t)

    def _record(self, schema: dict, depth: int) -> Restore:
        fields = [(f["name"], f.get("msgpack_key", f["name"]), self.compile(f["type"], depth)) for f in schema["fields"]]

        def entry(name: str, value: Column, restore: Restore) -> Column:
            there = value.isNotNull() & (value != NULL)
            return F.struct(F.lit(name).alias("key"), F.when(there, restore(value)).alias("value"))

        def run(t: Column) -> Column:
            placed = [(n, k, r) for n, k, r in fields if isinstance(k, int)]
            row, pairs = _items(t), _pairs(t)
            present = lambda entries: F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
            by_place = _object(present([entry(n, F.get(row, F.lit(k)), r) for n, k, r in placed])) if placed else F.lit("{}")
            of = lambda k: F.get(F.filter(pairs, lambda p: p["key"] == str(k)), F.lit(0))["value"]
            keys = F.array(*[F.lit(str(k)) for _, k, _ in fields]) if fields else F.array().cast("array<string>")
            rest = F.filter(pairs, lambda p: ~F.array_contains(keys, p["key"]))
            if not fields:
                return F.when(_starts(t, "["), by_place).when(_starts(t, "{"), _object(rest)).otherwise(t)
            own = present([entry(n, of(k), r) for n, k, r in fields])
            # What is left over wins over a field of its name, in the field's place.
            taken = F.transform(own, lambda e: F.coalesce(F.get(F.filter(rest, lambda p: p["key"] == e["key"]), F.lit(0)), e))
            more = F.filter(rest, lambda p: ~F.exists(own, lambda e: e["key"] == p["key"]))
            return F.when(_starts(t, "["), by_place).when(_starts(t, "{"), _object(F.concat(taken, more))).otherwise(t)

        return run

    def _tagged(self, schema: dict, depth: int) -> Restore:
        branches = {int(t): self.compile(s, depth) for t, s in schema["msgpack_unions"].items()}

        def run(t: Column) -> Column:
            pair = _items(t)
            tag = F.coalesce(F.when(F.get(pair, F.lit(0)).rlike("^-?[0-9]+$"), F.get(pair, F.lit(0)).try_cast("bigint")), F.lit(0).cast("bigint"))
            value = raw = F.get(pair, F.lit(1))
            for number, restore in branches.items():
                value = F.when(tag == number, restore(raw)).otherwise(value)
            done = F.concat(F.lit('{"__type":'), tag.cast("string"), F.lit(',"value":'), value, F.lit("}"))
            return F.when(_starts(t, "[") & (F.size(pair) == 2), done).otherwise(t)

        return run


def _starts(text: Column, mark: str) -> Column:
    return F.startswith(F.ltrim(text), F.lit(mark))
