"""Typed literals inside JSON texts: strict parsing, conformance to a declared type and one canonical form per value."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

TYPES = ("int", "real", "bool", "string", "address", "collection")

_INT = re.compile(r"(-?(?:0|[1-9][0-9]*))(?:\.0+)?")
_REAL = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_SPACE = re.compile(r"[ \t\n\r]*")
_ADDRESS = re.compile(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3}):([0-9]{1,5})")
# texts that are literals of a type without blanks or escapes and, but for reals, canonical as they are; most values are, so they need no parser
_PLAIN = {"int": re.compile("0|-?[1-9][0-9]{0,8}"), "real": _REAL, "bool": re.compile("true|false"), "string": re.compile(r'"([^"\\\x00-\x1f]*)"')}
_BAD = object()


class _Number(str):
    """The digits of a JSON number, kept as written."""


def _refuse(name: str):
    raise ValueError(f"{name} is not standard JSON")


_decode = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_refuse).decode


def strict_json(text: str):
    """The value of a text that is exactly one value of standard JSON, however deep; ValueError for any other. Numbers stay digits."""
    try:
        return _decode(text)
    except RecursionError:
        return _decode_deep(text)


def _decode_deep(text: str):
    """`_decode` with a stack of open lists and objects in place of recursion."""
    skip = lambda i: _SPACE.match(text, i).end()

    def named(i: int) -> tuple[str, int]:
        if not text.startswith('"', i):
            raise ValueError(f"no name at {i}")
        name, i = scanstring(text, i + 1, True)
        if not text.startswith(":", i := skip(i)):
            raise ValueError(f"no colon at {i}")
        return name, skip(i + 1)

    around: list[list] = []  # list or object, and the name of its next value
    i = skip(0)
    while True:
        c = text[i : i + 1]
        if c == "[" or c == "{":
            v = [] if c == "[" else {}
            i = skip(i + 1)
            if not text.startswith("]" if c == "[" else "}", i):
                name, i = (None, i) if c == "[" else named(i)
                around.append([v, name])
                continue
            i += 1
        elif c == '"':
            v, i = scanstring(text, i + 1, True)
        elif m := _REAL.match(text, i):
            v, i = _Number(m[0]), m.end()
        else:
            for word, v in (("true", True), ("false", False), ("null", None)):
                if text.startswith(word, i):
                    i += len(word)
                    break
            else:
                raise ValueError(f"no value at {i}")
        while True:  # v is whole
            i = skip(i)
            if not around:
                if i != len(text):
                    raise ValueError(f"more text at {i}")
                return v
            box, name = around[-1]
            if isinstance(box, list):
                box.append(v)
            else:
                box[name] = v
            if text.startswith(",", i):
                i = skip(i + 1)
                if isinstance(box, dict):
                    around[-1][1], i = named(i)
                break
            if not text.startswith("]" if isinstance(box, list) else "}", i):
                raise ValueError(f"no end at {i}")
            v, i = around.pop()[0], i + 1


def is_json(text: str) -> bool:
    try:
        strict_json(text)
    except ValueError:
        return False
    return True


def _plain(v):
    """Equal values to equal forms: numbers by value, objects without regard to the order of their keys."""
    if isinstance(v, _Number):
        if _INT.fullmatch(v):
            return int(v.partition(".")[0])
        x = float(v)
        return int(x) if x == x and abs(x) < 2**53 and x == int(x) else x
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return v


def _plain_text(v) -> str:
    """`_plain` as JSON, with a stack for what is nested too deeply for recursion."""
    try:
        return json.dumps(_plain(v), sort_keys=True, separators=(",", ":"))
    except RecursionError:
        out, todo = [], [(True, v)]  # values, and texts that stand as they are
        while todo:
            is_value, v = todo.pop()
            if not is_value:
                out.append(v)
            elif isinstance(v, list):
                todo += [(False, "]"), *[x for i in reversed(range(len(v))) for x in ((True, v[i]), (False, "," if i else ""))], (False, "[")]
            elif isinstance(v, dict):
                names = sorted(v)
                todo.append((False, "}"))
                for i in reversed(range(len(names))):
                    todo += [(True, v[names[i]]), (False, ("," if i else "") + json.dumps(names[i]) + ":")]
                todo.append((False, "{"))
            else:
                out.append(json.dumps(_plain(v)))
        return "".join(out)


def _canonical(v, kind: str):
    if kind == "collection":
        return _plain_text(v) if isinstance(v, list | dict) else _BAD
    if kind == "bool":
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str) and not isinstance(v, _Number) and v.lower() in ("true", "false"):
            return v.lower()
        return _BAD
    if not isinstance(v, str):
        return _BAD
    if kind == "string":
        return _BAD if isinstance(v, _Number) else v
    if kind == "address":
        m = None if isinstance(v, _Number) else _ADDRESS.fullmatch(v)
        if m and max(map(int, m.groups()[:4])) <= 255 and int(m[5]) <= 65535:
            return "{}.{}.{}.{}:{}".format(*map(int, m.groups()))
        return _BAD
    if kind == "int":
        if (m := _INT.fullmatch(v)) and len(m[1]) <= 11 and -(2**31) <= int(m[1]) < 2**31:
            return str(int(m[1]))
        return _BAD
    if kind == "real":
        return repr(float(v) + 0.0) if _REAL.fullmatch(v) else _BAD
    raise ValueError(f"unknown type {kind}")


def conform(text: str | None, kind: str) -> tuple[str | None, bool]:
    """(canonical form, bad) of a value read as JSON under a declared type.

    A null text or a JSON null is no value: (None, False). An object of exactly `type` and `value` is taken off, also
    repeatedly. What is no JSON or of another type is bad: (None, True).
    """
    if text is None:
        return None, False
    if (plain := _PLAIN.get(kind)) and (m := plain.fullmatch(text)):
        return (repr(float(text) + 0.0) if kind == "real" else m[m.lastindex or 0]), False
    try:
        v = strict_json(text)
        while isinstance(v, dict) and v.keys() == {"type", "value"}:
            v = v["value"]
        if v is None:
            return None, False
        c = _canonical(v, kind)
    except (ValueError, OverflowError):
        return None, True
    return (None, True) if c is _BAD else (c, False)
