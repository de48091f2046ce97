"""JSON values as Python objects that keep numbers as written."""

from __future__ import annotations

import json


class Number(str):
    """A JSON number, as written; digits are kept however many there are."""

    __slots__ = ()


def _no_number(name: str):
    raise ValueError(f"{name} is not JSON")


def parse(text: str | None):
    """The value of a JSON text; raises ValueError if it isn't one, or nests beyond the parser's depth."""
    if text is None:
        raise ValueError("null")
    try:
        return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=_no_number)
    except RecursionError as e:
        raise ValueError("too deeply nested") from e


def kind(value) -> str | None:
    """text, number, boolean, list or record; None for null."""
    if value is None:
        return None
    if isinstance(value, Number):
        return "number"
    if isinstance(value, str):
        return "text"
    if isinstance(value, bool):
        return "boolean"
    return "list" if isinstance(value, list) else "record"


def plain(value) -> str | None:
    """The value as a text: list elements joined by commas, true and false in words."""
    if value is None:
        return None
    if isinstance(value, str):
        # A lone surrogate cannot be written as UTF-8.
        return value.encode("utf-8", "replace").decode("utf-8")
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return ",".join(plain(x) or "" for x in value)
    return json.dumps(value, ensure_ascii=True, sort_keys=True)
