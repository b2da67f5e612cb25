"""Schema-driven restore: positional and keyed records, unions, columnar tables.

Values are variants. A schema is compiled on the driver to one column
expression, so that a restore is a projection: no Python runs on the rows.

Schemas are given as in Avro's JSON, with ``msgpack_key`` (a position or a key)
on a record's fields and ``msgpack_unions`` (tag to record) on a record.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Restore = Callable[[Column], Column]


def kind(value: Column) -> Column:
    """``ARRAY``, ``OBJECT``, ``VOID``, ``BIGINT``, ... of a variant; null for none."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def elements(value: Column) -> Column:
    """A variant array as an array; null if it is none."""
    return F.try_variant_get(value, "$", "array<variant>")


def members(value: Column) -> Column:
    """A variant object as a map; null if it is none."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _present(value: Column) -> Column:
    return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))


class Registry:
    """Named records of a schema bundle; full and short names both find one, the last wins."""

    def __init__(self, schemas: list[dict]):
        self.records: dict[str, dict] = {}
        for s in schemas:
            self._add(s)

    def _add(self, node) -> None:
        if isinstance(node, list):
            for n in node:
                self._add(n)
        elif isinstance(node, dict):
            if node.get("type") == "record":
                full = f"{node['namespace']}.{node['name']}" if node.get("namespace") else node["name"]
                self.records[full] = node
                self.records[full.rsplit(".", 1)[-1]] = node
                for f in node.get("fields", ()):
                    self._add(f["type"])
            elif node.get("type") in ("array", "map"):
                self._add(node.get("items") or node.get("values"))
            elif isinstance(node.get("type"), (list, dict)):
                self._add(node["type"])

    def compile(self, schema, depth: int = 12) -> Restore:
        """The restore of a schema as a function from column to column.

        Names are resolved here. A record that holds itself is unrolled
        ``depth`` levels; deeper values pass through.
        """
        if isinstance(schema, list):
            rest = [s for s in schema if s != "null"]
            inner = self.compile(rest[0], depth) if rest else (lambda v: v)
            return lambda v: F.when(_present(v), inner(v))
        if isinstance(schema, str):
            found = self.records.get(schema)
            if schema == "null":
                return lambda v: F.lit(None).cast("variant")
            return self.compile(found, depth - 1) if found is not None and depth > 0 else (lambda v: v)
        sort = schema["type"]
        if sort == "array":
            inner = self.compile(schema["items"], depth)
            return lambda v: F.when(kind(v) == "ARRAY", F.to_variant_object(F.transform(elements(v), inner))).otherwise(v)
        if sort == "map":
            inner = self.compile(schema["values"], depth)
            return lambda v: F.when(
                kind(v) == "OBJECT", F.to_variant_object(F.transform_values(members(v), lambda _, x: inner(x)))
            ).otherwise(v)
        if sort == "record":
            return self._tagged(schema, depth) if schema.get("msgpack_unions") else self._record(schema, depth)
        return self.compile(sort, depth) if not isinstance(sort, str) or sort in self.records else (lambda v: v)

    def _record(self, schema: dict, depth: int) -> Restore:
        fields = [(f["name"], f.get("msgpack_key", f["name"]), self.compile(f["type"], depth)) for f in schema["fields"]]
        placed = [f for f in fields if isinstance(f[1], int)]
        keyed = [(n, str(k), r) for n, k, r in fields]

        def made(entries: list[Column], more: Column | None = None) -> Column:
            whole = F.filter(F.array(*entries), lambda e: _present(e["value"])) if entries else None
            if more is not None:
                if whole is not None:  # a key left over wins over a field of its name
                    whole = F.filter(whole, lambda e: ~F.exists(more, lambda m: m["key"] == e["key"]))
                whole = more if whole is None else F.concat(whole, more)
            if whole is None:
                return F.parse_json(F.lit("{}"))
            return F.to_variant_object(F.map_from_entries(whole))

        def entry(name: str, value: Column) -> Column:
            return F.struct(F.lit(name).alias("key"), value.alias("value"))

        def run(v: Column) -> Column:
            row, map_ = elements(v), members(v)
            by_place = made([entry(n, r(F.get(row, F.lit(k)))) for n, k, r in placed])
            keys = F.array(*[F.lit(k) for _, k, _ in keyed])
            left = F.map_entries(F.map_filter(map_, lambda k, _: ~F.array_contains(keys, k)))
            left = F.transform(left, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
            by_key = made([entry(n, r(F.try_element_at(map_, F.lit(k)))) for n, k, r in keyed], left)
            return F.when(kind(v) == "ARRAY", by_place).when(kind(v) == "OBJECT", by_key).otherwise(v)

        return run

    def _tagged(self, schema: dict, depth: int) -> Restore:
        branches = {int(t): self.compile(s, depth) for t, s in schema["msgpack_unions"].items()}

        def run(v: Column) -> Column:
            pair = elements(v)
            tag = F.coalesce(F.when(kind(F.get(pair, F.lit(0))) == "BIGINT", F.try_variant_get(v, "$[0]", "bigint")), F.lit(0).cast("bigint"))
            raw = F.get(pair, F.lit(1))
            value = raw
            for t, restore in branches.items():
                value = F.when(tag == t, restore(raw)).otherwise(value)
            done = F.to_variant_object(F.struct(tag.alias("__type"), value.alias("value")))
            return F.when((kind(v) == "ARRAY") & (F.size(pair) == 2), done).otherwise(v)

        return run


def table_records(tables: DataFrame) -> DataFrame:
    """``table_key, pos, record``: an array's elements are rows of their own; another value is one, without ``pos``.

    ``tables`` has ``table_key, value``. From here on a row is a record, so no table
    has to fit one value or one task.
    """
    value = F.col("value")
    whole = F.when(kind(value) == "ARRAY", elements(value))
    rows = tables.withColumn("_all", whole).select("table_key", "value", "_all")
    many = rows.where("_all is not null").select("table_key", F.posexplode("_all").alias("pos", "record"))
    one = rows.where("_all is null").select("table_key", F.lit(None).cast("int").alias("pos"), F.col("value").alias("record"))
    return many.unionByName(one)


def restore_records(records: DataFrame, registry: Registry, schemas: dict[str, str]) -> DataFrame:
    """Restore each ``record`` by the schema its ``table_key`` is mapped to.

    Keys without a schema stay as they are. The mapping is small and compiled in.
    """
    out = F.col("record")
    for key, schema in schemas.items():
        out = F.when(F.col("table_key") == key, registry.compile(schema)(F.col("record"))).otherwise(out)
    return records.withColumn("record", out)


def columnar_rows(value: Column) -> Column:
    """The rows of a columnar table as an array of objects.

    There are as many rows as the shortest array column has values; members that
    are no arrays are left out. ``__ENUM__`` has dictionaries: a whole number
    from 0 on is looked up (null outside), other values stay.
    """
    columns = F.map_filter(members(value), lambda k, v: k != "__ENUM__")
    arrays = F.map_filter(F.transform_values(columns, lambda _, v: elements(v)), lambda _, a: a.isNotNull())
    words = F.coalesce(members(F.try_variant_get(value, "$.__ENUM__", "variant")), F.create_map().cast("map<string,variant>"))
    books = F.transform_values(words, lambda _, v: elements(v))

    def cell(v: Column, book: Column) -> Column:
        code = F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        return F.when(book.isNotNull() & (code >= 0), F.get(book, code.cast("int"))).otherwise(F.when(_present(v), v))

    def rows(t: Column) -> Column:
        n = F.coalesce(F.array_min(F.transform(F.map_values(t["arrays"]), lambda a: F.size(a))), F.lit(0))
        # The dictionary of a column is looked up once for all of its cells.
        read = F.transform_values(
            t["arrays"],
            lambda k, a: F.flatten(F.transform(F.array(F.try_element_at(t["books"], k)), lambda book: F.transform(F.slice(a, 1, n), lambda v: cell(v, book)))),
        )
        made = F.transform(F.array(read), lambda m: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform_values(m, lambda _, a: F.get(a, i))))
        return F.when(n > 0, F.get(made, F.lit(0))).otherwise(F.array().cast("array<map<string,variant>>"))

    # A lambda's argument is worked out once, unlike what it refers to outside.
    table = F.array(F.struct(arrays.alias("arrays"), books.alias("books")))
    return F.get(F.transform(table, rows), F.lit(0))


def expand_columnar(records: DataFrame, prefix: str = "compact") -> DataFrame:
    """Add the row tables of columnar ones: ``compactXyz`` gives ``xyz``, a row a record.

    ``records`` are :func:`table_records`. A row table made so replaces one of its
    name; the columnar one stays.
    """
    columnar = records.where(F.col("table_key").rlike(f"^{prefix}[A-Z]") & (kind(F.col("record")) == "OBJECT"))
    rest = F.substring(F.col("table_key"), len(prefix) + 1, 1_000)
    named = columnar.withColumn("table_key", F.concat(F.lower(F.substring(rest, 1, 1)), F.substring(rest, 2, 1_000)))
    made = named.select("table_key", F.posexplode(columnar_rows(F.col("record"))).alias("pos", "row"))
    made = made.select("table_key", "pos", F.to_variant_object("row").alias("record"))
    replaced = named.select(F.col("table_key").alias("_made")).distinct()
    return records.join(replaced, F.col("table_key") == F.col("_made"), "left_anti").unionByName(made)


def best_template(path: Column, templates: list[str]) -> Column:
    """The longest of the ``templates`` that a path fits (the last by name of equally long ones); null if none.

    ``{x}`` stands for any one segment; the query and empty segments are ignored. Routes
    are known when the plan is made, so they are one CASE and nothing is joined.
    """
    plain = F.substring_index(path, "?", 1)
    best = F.lit(None).cast("string")
    for t in sorted(set(templates), key=lambda t: (len(t), t)):  # the last to fit wins
        parts = [p for p in t.split("?")[0].split("/") if p]
        form = "".join("/+" + ("[^/]+" if re.fullmatch(r"\{.*\}", p) else "\\Q" + p + "\\E") for p in parts)
        best = F.when(F.concat(F.lit("/"), plain).rlike(f"^{form}/*$"), F.lit(t)).otherwise(best)
    return best


def apply_at(value: Column, selector: str, restore: Restore) -> Column:
    """Restore what ``a.b[].c`` points at; where a node is missing or of another kind, nothing changes."""

    def step(v: Column, parts: list[str]) -> Column:
        if not parts:
            return restore(v)
        name, each = re.fullmatch(r"(.*?)(\[\])?", parts[0]).groups()
        if name == "":
            return F.when(kind(v) == "ARRAY", F.to_variant_object(F.transform(elements(v), lambda x: step(x, parts[1:])))).otherwise(v)
        inner = (lambda c: step(c, ["[]", *parts[1:]])) if each else (lambda c: step(c, parts[1:]))
        changed = F.transform_values(members(v), lambda k, x: F.when(k == name, inner(x)).otherwise(x))
        return F.when(kind(v) == "OBJECT", F.to_variant_object(changed)).otherwise(v)

    return step(value, [p for p in selector.split(".") if p])


def restore_responses(responses: DataFrame, registry: Registry, routes: list[dict], secondary: Column, method: str | None = None) -> DataFrame:
    """Restore ``value`` of responses by the longest route that fits ``path``, and add its ``template``.

    A route has ``path`` and optionally ``schema`` for the whole body, which comes
    first, and ``fields`` (``selector``, ``schema``). Rows where ``secondary`` is
    false pass, as do answers to POST where ``method`` names the column of methods.
    """
    found = responses.withColumn("template", best_template(F.col("path"), [r["path"] for r in routes]))
    use = F.coalesce(secondary, F.lit(False))
    if method:
        use = use & ~F.coalesce(F.upper(F.col(method)) == "POST", F.lit(False))
    out = F.col("value")
    for r in routes:
        done = registry.compile(r["schema"])(F.col("value")) if r.get("schema") else F.col("value")
        for f in r.get("fields", ()):
            done = apply_at(done, f["selector"], registry.compile(f["schema"]))
        out = F.when(use & (F.col("template") == r["path"]), done).otherwise(out)
    return found.withColumn("value", out)
