"""Filter predicates over event fields.

``pred(field, op, value)`` gives a Column that is never null: a field that does
not apply to a row makes the predicate false, so ``~pred(...)`` keeps the row.
Combine predicates with ``&``, ``|`` and ``~``. Nulls are excluded by null-safe
equality and explicit tests, which the Parquet reader can use; a surrounding
``coalesce`` would keep the filter from it.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrilake.functions.fields import payload, pid, process_name
from sentrilake.schema import EVENT_TYPES

Value = str | float | int | bool

# Accepted spellings of each field.
FIELD_NAMES = {
    "type": "type", "event.type": "type", "event_type": "type",
    "process.name": "process", "process": "process", "executable": "process",
    "process.pid": "pid", "pid": "pid",
    "crypto.algorithm": "algorithm", "algorithm": "algorithm",
    "crypto.provider": "provider", "provider": "provider",
    "network.external": "external", "network.is_external": "external",
    "network.remote_address": "address", "network.dst_ip": "address",
    "network.remote_port": "port", "network.dst_port": "port",
    "file.path": "path", "path": "path",
    "confidence": "confidence",
    "privacy": "privacy",
}
PATH_TYPES = ["FileOpen", "FileRead", "FileWrite", "FileDelete"]
_PASCAL = {name.lower(): name for name in EVENT_TYPES}
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)", re.I)
_EPSILON = 2.0**-52


def pred(field: str, op: str, value: Value) -> Column:
    """Predicate on one field; an unknown field is false on every row."""
    kind = FIELD_NAMES.get(field.lower())
    op = op.upper()
    if kind == "type":
        out = _type_test(op, value)
    elif kind == "process":
        out = _text_test(F.lower(process_name()), op, value)
    elif kind == "pid":
        out = _number_test(pid(), op, value)
    elif kind in ("algorithm", "provider"):
        out = _only("CryptoOperation") & _text_test(F.lower(payload(kind)), op, value)
    elif kind == "external":
        out = _only("NetworkConnect") & _flag_test(payload("is_external"), op, value)
    elif kind == "address":
        out = _only("NetworkConnect") & _text_test(payload("remote_address"), op, value)
    elif kind == "port":
        out = _only("NetworkConnect") & _number_test(payload("remote_port"), op, value)
    elif kind == "path":
        out = _type_in(PATH_TYPES) & _text_test(F.lower(payload("path")), op, value)
    elif kind in ("confidence", "privacy"):
        out = _text_test(F.lower(F.col(kind)), op, value)
    else:
        out = F.lit(False)
    return out


def _only(event_type: str) -> Column:
    return F.col("event_type").eqNullSafe(event_type)


def _type_in(names: list[str]) -> Column:
    return F.col("event_type").isNotNull() & F.col("event_type").isin(names)


def _as_text(value: Value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        number = Decimal(repr(float(value)))
        return format(number.quantize(Decimal(1)) if number == number.to_integral_value() else number, "f")
    return value.lower()


def _as_number(value: Value) -> float:
    if isinstance(value, str):
        return float(value) if _NUMBER.fullmatch(value) else 0.0
    return float(value)


def _text_test(actual: Column, op: str, value: Value) -> Column:
    """Equality and literal substring tests; order operators are false."""
    expected = F.lit(_as_text(value))
    if op == "=":
        return actual.eqNullSafe(expected)
    if op == "!=":
        return actual.isNotNull() & (actual != expected)
    if op == "CONTAINS":
        return actual.isNotNull() & actual.contains(expected)
    if op == "STARTS_WITH":
        return actual.isNotNull() & actual.startswith(expected)
    return F.lit(False)


def _type_test(op: str, value: Value) -> Column:
    """Names are compared without case, but as plain equality on the stored name.

    ``lower(event_type) = x`` would not reach the Parquet reader.
    """
    if op in ("=", "!="):
        name = _PASCAL.get(_as_text(value))
        if name is None:
            return F.lit(op == "!=")
        return _only(name) if op == "=" else ~_only(name)
    if op == "CONTAINS":
        return _type_in([n for low, n in _PASCAL.items() if _as_text(value) in low])
    if op == "STARTS_WITH":
        return _type_in([n for low, n in _PASCAL.items() if low.startswith(_as_text(value))])
    return F.lit(False)


def _number_test(actual: Column, op: str, value: Value) -> Column:
    number = _as_number(value)
    if op in ("=", "!="):
        # The column is an integer: a whole number compares exactly and is pushed down.
        if number.is_integer() and abs(number) < 2**53:
            same = actual == int(number)
        else:
            same = F.abs(actual.cast("double") - F.lit(number)) < F.lit(_EPSILON)
        return actual.isNotNull() & (same if op == "=" else ~same)
    if number != number:
        return F.lit(False)
    bound = F.lit(int(number)) if number.is_integer() and abs(number) < 2**53 else F.lit(number)
    if op == "<":
        return actual.isNotNull() & (actual < bound)
    if op == "<=":
        return actual.isNotNull() & (actual <= bound)
    if op == ">":
        return actual.isNotNull() & (actual > bound)
    if op == ">=":
        return actual.isNotNull() & (actual >= bound)
    return F.lit(False)


def _flag_test(actual: Column, op: str, value: Value) -> Column:
    if isinstance(value, str):
        expected = value.lower() == "true"
    else:
        expected = value != 0
    if op == "=":
        return actual.eqNullSafe(F.lit(expected))
    if op == "!=":
        return actual.eqNullSafe(F.lit(not expected))
    return F.lit(False)
