"""Driver-side literals: typed values written as text, and durations."""

from __future__ import annotations

import re

from .columns import INT64

_INT = re.compile(r"[+-]?[0-9]+")
_SPAN = re.compile(r"([0-9]+)([smhd])")
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


class LiteralError(ValueError):
    """A literal that its field's kind can't have."""


def parse(kind: str, text: str) -> str | int | bool:
    """The value that ``text`` has as ``kind``.

    Integers may have a sign and leading zeros, but no blanks, and must fit 64
    bits; booleans are exactly ``true`` or ``false``.
    """
    if kind in ("text", "link"):
        return text
    if kind == "int":
        if _INT.fullmatch(text) and INT64[0] <= int(text) <= INT64[1]:
            return int(text)
        raise LiteralError(f"{text!r} is no integer")
    if kind == "bool":
        if text in ("true", "false"):
            return text == "true"
        raise LiteralError(f"{text!r} is no boolean")
    raise LiteralError(f"unknown kind {kind!r}")


def seconds(text: str) -> int | None:
    """Seconds of ``<n>[smhd]``; None for ``forever``."""
    if text == "forever":
        return None
    m = _SPAN.fullmatch(text)
    if not m:
        raise LiteralError(f"{text!r} is no duration")
    return int(m[1]) * _UNITS[m[2]]
