"""Record shapes compiled to Column predicates over VARIANT values.

A shape says which keys a record has, which of them it must have, whether others
may occur, and what each value is. :func:`faults` turns a shape into one
expression that lists what is wrong with a value, as (path, fault) pairs:

``unknown_key``   a key that a closed record does not have
``missing_key``   a required key that is not there
``wrong_type``    a value of another type (null where null is not allowed)
``too_short``, ``too_long``, ``too_small``, ``too_large``, ``not_listed``
                  a value outside the limits that the shape states

All of it runs in the JVM on parsed documents: no Python, no schema inference, no
join. Array elements are named by ``[]``, so a path is one of a fixed number.
A document, an object's map and each of its values are bound by a lambda: they are
read once a record, and the plan grows with the shape, not with its depth.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import bound

FAULTS = "array<struct<path:string,fault:string>>"
INVALID = "not_json"


@dataclass(frozen=True)
class Text:
    null: bool = False
    least: int | None = None     # code points
    most: int | None = None
    among: tuple[str, ...] = ()


@dataclass(frozen=True)
class Whole:
    null: bool = False
    least: int | None = None
    most: int | None = None


@dataclass(frozen=True)
class Flag:
    null: bool = False


@dataclass(frozen=True)
class Items:
    of: object
    null: bool = False
    least: int | None = None     # elements


@dataclass(frozen=True)
class Record:
    keys: dict[str, object]
    required: tuple[str, ...] = ()
    closed: bool = True
    null: bool = False


def _fault(path: str, name: str) -> Column:
    return F.struct(F.lit(path).alias("path"), F.lit(name).alias("fault"))


def _none() -> Column:
    return F.array().cast(FAULTS)


def _when(bad: Column, path: str, name: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(_fault(path, name))).otherwise(_none())


def _kind(value: Column) -> Column:
    """Type of a scalar variant as SQL names it (``OBJECT<...>``, ``ARRAY<...>`` for the others)."""
    return F.schema_of_variant(value)


def _scalar(value: Column, path: str, null: bool, kind: str, checks: list[tuple[Column, str]]) -> Column:
    limits = F.concat(*[_when(c, path, name) for c, name in checks]) if checks else _none()
    empty = _none() if null else F.array(_fault(path, "wrong_type"))
    return bound(_kind(value), lambda k: F.when(k == "VOID", empty).when(k == kind, limits).otherwise(F.array(_fault(path, "wrong_type"))))


def faults(shape: object, value: Column, path: str = "") -> Column:
    """array<struct<path, fault>> of a VARIANT column (a null column: no faults)."""
    if isinstance(shape, Text):
        text = F.try_variant_get(value, "$", "string")
        checks = []
        if shape.least is not None:
            checks.append((F.length(text) < shape.least, "too_short"))
        if shape.most is not None:
            checks.append((F.length(text) > shape.most, "too_long"))
        if shape.among:
            checks.append((~text.isin(*shape.among), "not_listed"))
        return _scalar(value, path, shape.null, "STRING", checks)
    if isinstance(shape, Whole):
        number = F.try_variant_get(value, "$", "bigint")
        checks = []
        if shape.least is not None:
            checks.append((number < shape.least, "too_small"))
        if shape.most is not None:
            checks.append((number > shape.most, "too_large"))
        return _scalar(value, path, shape.null, "BIGINT", checks)
    if isinstance(shape, Flag):
        return _scalar(value, path, shape.null, "BOOLEAN", [])
    if isinstance(shape, Items):
        elements = F.try_variant_get(value, "$", "array<variant>")
        inside = F.flatten(F.transform(elements, lambda x: faults(shape.of, x, f"{path}[]")))
        short = _when(F.size(elements) < shape.least, path, "too_short") if shape.least else _none()
        empty = _none() if shape.null else F.array(_fault(path, "wrong_type"))
        return bound(_kind(value), lambda k: F.when(k == "VOID", empty).when(F.startswith(k, F.lit("ARRAY")), F.concat(short, inside))
                     .otherwise(F.array(_fault(path, "wrong_type"))))
    if isinstance(shape, Record):
        return _record(shape, value, path)
    raise TypeError(f"no shape: {shape!r}")


def _checked(shape: object, path: str):
    return lambda value: faults(shape, value, path)


def _record(shape: Record, value: Column, path: str) -> Column:
    at = f"{path}." if path else ""

    def inside(fields: Column, keys: Column) -> Column:
        found = []
        if shape.closed:
            known = F.array(*[F.lit(k) for k in shape.keys])
            found.append(F.transform(F.array_except(keys, known), lambda k: F.struct(F.concat(F.lit(at), k).alias("path"), F.lit("unknown_key").alias("fault"))))
        for k in shape.required:
            found.append(_when(~F.array_contains(keys, k), at + k, "missing_key"))
        for k, s in shape.keys.items():
            of = bound(F.element_at(fields, F.lit(k)), _checked(s, at + k))
            found.append(F.when(F.array_contains(keys, k), of).otherwise(_none()))
        return F.concat(*found)

    fields = F.try_variant_get(value, "$", "map<string,variant>")
    checked = bound(fields, lambda m: bound(F.map_keys(m), lambda keys: inside(m, keys)))
    empty = _none() if shape.null else F.array(_fault(path or "$", "wrong_type"))
    return bound(_kind(value), lambda k: F.when(k == "VOID", empty).when(F.startswith(k, F.lit("OBJECT")), checked)
                 .otherwise(F.array(_fault(path or "$", "wrong_type"))))


def document_faults(shape: object, text: Column) -> Column:
    """The faults of JSON text; text that is no JSON document has the one fault
    ``not_json`` (a document that repeats a key of one object counts as such)."""
    return bound(F.try_parse_json(text), lambda parsed: F.when(parsed.isNull(), F.array(_fault("$", INVALID))).otherwise(faults(shape, parsed)))
