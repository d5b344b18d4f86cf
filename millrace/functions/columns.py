"""Column expressions: liveness, folded containment, partition ids, casts, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT64 = (-(2**63), 2**63 - 1)


def live(now: Column | int, expires: str = "expires_at") -> Column:
    """Rows without an end, or with one after ``now``."""
    return F.col(expires).isNull() | (F.col(expires) > now)


def unexpired(expires: str = "expires_at") -> Column:
    """Rows without any end: only these hold unique keys; a lease holds none."""
    return F.col(expires).isNull()


def contains_fold(column: Column, text: str) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` have no meaning of their own."""
    return F.contains(F.lower(column), F.lower(F.lit(text)))


def time_slot(time: str, width: int) -> Column:
    """The number of the tumbling bucket that the column ``time`` falls in."""
    return F.expr(f"`{time}` div {int(width)}")


def partition_id(key: Column | None, slot_no: Column) -> Column:
    """``k<hex of the key>-<slot>``, or ``n-<slot>`` for tables without a partition key."""
    if key is None:
        return F.concat(F.lit("n-"), slot_no.cast("string"))
    return F.concat(F.lit("k"), F.lower(F.hex(F.encode(key, "UTF-8"))), F.lit("-"), slot_no.cast("string"))


def is_int_text(column: Column) -> Column:
    """Whether a text is a 64-bit integer in canonical form: no sign +, no leading zeros."""
    shaped = column.rlike(r"^(0|-?[1-9][0-9]{0,18})$")
    return F.coalesce(shaped & column.try_cast("bigint").isNotNull(), F.lit(False))


def is_bool_text(column: Column) -> Column:
    return F.coalesce(column.isin("true", "false"), F.lit(False))


def convert(column: Column, before: str, after: str) -> Column:
    """A stored value under another kind: text, link, int and bool convert as the evolution rules allow."""
    if before == after or {before, after} <= {"text", "link"}:
        return column
    if after == "int":
        return column.cast("long")
    if after == "bool":
        return F.when(column.isNotNull(), column.cast("string").isin("true", "1"))
    if before == "bool":
        return F.when(column, F.lit("true")).when(~column, F.lit("false"))
    return column.cast("string")


def filled(column: Column, default: str | int | bool) -> Column:
    return F.coalesce(column, F.lit(default))


def violates(column: Column, values: list | None = None, low: int | None = None, high: int | None = None) -> Column:
    """Whether a present value breaks its domain or range; absent values break nothing."""
    bad = F.lit(False)
    if values is not None:
        bad = bad | ~column.isin(*values)
    if low is not None:
        bad = bad | (column < low)
    if high is not None:
        bad = bad | (column > high)
    return F.coalesce(bad, F.lit(False))


def value_bytes(column: Column, kind: str) -> Column:
    """Charged size of a value: fixed kinds take their width, others their bytes, absent ones nothing."""
    if kind == "bool":
        size = F.lit(1)
    elif kind in ("int", "uint"):
        size = F.lit(8)
    else:
        size = F.octet_length(column)
    return F.when(column.isNull(), F.lit(0)).otherwise(size).cast("long")


def _hexed(value: Column) -> Column:
    return F.lower(F.hex(value.cast("binary")))


def record_digest(time: Column, keys: list[Column], payload: Column) -> Column:
    """A SHA-256 of a record's time, keys and payload; hexadecimal text between colons keeps them apart."""
    return F.sha2(F.concat_ws(":", time.cast("string"), *map(_hexed, [*keys, payload])), 256)


def content_token(operator: Column, token: Column, digests: Column) -> Column:
    """A SHA-256 name of a batch: operator, token and its records' digests in order."""
    return F.sha2(F.concat_ws(":", operator.cast("string"), _hexed(token), F.array_join(digests, "")), 256)


def json_path(pointer: str) -> str:
    """A JSON pointer as a VARIANT path: ``/a.b/0/a~1b`` is ``$['a.b'][0]['a/b']``."""
    if pointer == "":
        return "$"
    if not pointer.startswith("/"):
        raise ValueError(f"not a JSON pointer: {pointer!r}")
    out = "$"
    for part in pointer[1:].split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        if part.isdigit() and (part == "0" or part[0] != "0"):
            out += f"[{part}]"
        elif "'" in part:
            out += f'["{part}"]'
        else:
            out += f"['{part}']"
    return out
