"""Guarded scalar functions: built-in expressions, with an error where a bad argument must not pass.

Each takes columns (or names) and returns a column; all stay in the JVM. ``guard`` raises
when its condition is FALSE for a row; a null condition lets the row pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def guard(ok: Column, value: Column, message: str) -> Column:
    return F.when(~ok, F.raise_error(F.lit(message))).otherwise(value)


# Arithmetic


def int_divide(a: ColumnLike, b: ColumnLike) -> Column:
    """Truncating 64-bit division; zero is an error."""
    return F.call_function("div", _c(a).cast("long"), _c(b).cast("long"))


def finite(x: ColumnLike) -> Column:
    """The double itself; NaN and infinities are errors."""
    x = _c(x)
    return guard(~(F.isnan(x) | (F.abs(x) == float("inf"))), x, "a float is not finite")


def float_op(a: ColumnLike, op: str, b: ColumnLike) -> Column:
    a, b = finite(_c(a).cast("double")), finite(_c(b).cast("double"))
    if op == "/":
        return finite(guard(b != 0, a, "division by zero") / b)
    return finite({"+": a + b, "-": a - b, "*": a * b}[op])


def decimal_add(a: ColumnLike, b: ColumnLike, p1: int, s1: int, p2: int, s2: int, minus: bool = False) -> Column:
    """Scale the greater of both, one digit more than either needs, 38 at most."""
    s = max(s1, s2)
    p = max(p1 - s1, p2 - s2) + s + 1
    if p > 38:
        raise ValueError("a decimal sum needs more than 38 digits")
    out = _c(a) - _c(b) if minus else _c(a) + _c(b)
    return out.cast(f"decimal({p},{s})")


def decimal_multiply(a: ColumnLike, b: ColumnLike, p1: int, s1: int, p2: int, s2: int) -> Column:
    if p1 + p2 > 38:
        raise ValueError("a decimal product needs more than 38 digits")
    return (_c(a) * _c(b)).cast(f"decimal({p1 + p2},{s1 + s2})")


def decimal_divide(a: ColumnLike, b: ColumnLike, s1: int, s2: int) -> Column:
    """Scale the greatest of both and 6, 38 digits; a quotient that isn't exact is an error."""
    s = max(s1, s2, 6)
    a, b = _c(a), _c(b)
    quotient = (guard(b != 0, a, "division by zero") / b).cast(f"decimal(38,{s})")
    exact = (quotient.cast(f"decimal(28,{s})") * b).cast(f"decimal(38,{s + s2})") == a.cast(f"decimal(38,{s + s2})") if s + s2 <= 20 else quotient * b == a
    return guard(exact, quotient, "the decimal quotient is not exact")


def negate(x: ColumnLike) -> Column:
    return -_c(x)


def absolute(x: ColumnLike) -> Column:
    return F.abs(_c(x))


def floor(x: ColumnLike) -> Column:
    """Of a double a double."""
    return F.floor(_c(x)).cast("double")


def ceil(x: ColumnLike) -> Column:
    return F.ceil(_c(x)).cast("double")


def round_half_away(x: ColumnLike) -> Column:
    return F.round(_c(x))


# Text


def trim(x: ColumnLike) -> Column:
    """Without Unicode white space at both ends."""
    space = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
    return F.regexp_replace(_c(x), f"^{space}+|{space}+$", "")


def length(x: ColumnLike) -> Column:
    return F.char_length(_c(x)).cast("long")


def byte_length(x: ColumnLike) -> Column:
    return F.octet_length(_c(x)).cast("long")


def concat(*xs: ColumnLike) -> Column:
    return F.concat(*[_c(x) for x in xs])


def substr(x: ColumnLike, start: ColumnLike | int, size: ColumnLike | int | None = None) -> Column:
    """From 1; a start below 1 or a negative size is an error."""
    start = F.lit(start) if isinstance(start, int) else _c(start)
    size = F.lit(size) if isinstance(size, int) else size
    ok = start >= 1 if size is None else (start >= 1) & (_c(size) >= 0)
    x = _c(x)
    out = F.substr(x, start.cast("int")) if size is None else F.substr(x, start.cast("int"), _c(size).cast("int"))
    return guard(ok, out, "substr: the start is below 1 or the length is negative")


def left(x: ColumnLike, n: ColumnLike | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else _c(n)
    return guard(n >= 0, F.left(_c(x), n), "left: the count is negative")


def right(x: ColumnLike, n: ColumnLike | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else _c(n)
    return guard(n >= 0, F.right(_c(x), n), "right: the count is negative")


def replace(x: ColumnLike, old: ColumnLike, new: ColumnLike) -> Column:
    old = _c(old)
    return guard(F.char_length(old) > 0, F.replace(_c(x), old, _c(new)), "replace: the needle is empty")


def unhex(x: ColumnLike) -> Column:
    """Strict: an even number of hex digits, else an error."""
    x = _c(x)
    return guard(x.rlike(r"^(?:[0-9A-Fa-f]{2})*\z"), F.unhex(x), "unhex: not hex digits")


def from_base64(x: ColumnLike) -> Column:
    x = _c(x)
    return guard(x.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"), F.unbase64(x), "from_base64: not base64")


def regexp_like(x: ColumnLike, pattern: str) -> Column:
    """Unanchored; look-around is outside the dialect."""
    check_pattern(pattern)
    return _c(x).rlike(pattern)


def check_pattern(pattern: str) -> None:
    from fathomic.errors import Blocked

    if any(x in pattern for x in ("(?=", "(?!", "(?<=", "(?<!")):
        raise Blocked("FX-SQL-FEATURE", "look-around is outside the pattern dialect")


def regexp_replace(x: ColumnLike, pattern: str, new: str) -> Column:
    r"""Back-references are written ``\1``."""
    import re

    check_pattern(pattern)
    return F.regexp_replace(_c(x), pattern, re.sub(r"\\(\d)", r"$\1", new.replace("$", r"\$")))


def url_domain(x: ColumnLike) -> Column:
    """Host of a URL without scheme, user, ``www.`` and port; IPv6 hosts keep their brackets."""
    rest = F.regexp_replace(_c(x), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//", "")
    authority = F.regexp_replace(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), r"(?s)^.*@", "")
    host = F.regexp_replace(authority, r"^[Ww][Ww][Ww]\.", "")
    return F.when(host.startswith("["), F.regexp_extract(host, r"(?s)^(\[[^\]]*\]?)", 1)).otherwise(F.regexp_extract(host, r"(?s)^([^:]*)", 1))


# Dates and times


def date_add_days(d: ColumnLike, n: ColumnLike | int) -> Column:
    return F.date_add(_c(d), F.lit(n) if isinstance(n, int) else _c(n).cast("int"))


def date_sub_days(d: ColumnLike, n: ColumnLike | int) -> Column:
    return F.date_sub(_c(d), F.lit(n) if isinstance(n, int) else _c(n).cast("int"))


def date_diff_days(a: ColumnLike, b: ColumnLike) -> Column:
    return F.datediff(_c(a), _c(b)).cast("long")


def timestamp_add_seconds(t: ColumnLike, n: ColumnLike | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else _c(n)
    return _c(t) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def timestamp_sub_seconds(t: ColumnLike, n: ColumnLike | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else _c(n)
    return timestamp_add_seconds(t, -n)


def timestamp_diff_seconds(a: ColumnLike, b: ColumnLike) -> Column:
    """Whole seconds of left minus right, cut toward zero."""
    micros = F.unix_micros(_c(a).cast("timestamp")) - F.unix_micros(_c(b).cast("timestamp"))
    return F.call_function("div", micros, F.lit(1_000_000).cast("long"))


# Null handling and casts


def coalesce(*xs: ColumnLike) -> Column:
    return F.coalesce(*[_c(x) for x in xs])


def nullif(a: ColumnLike, b: ColumnLike) -> Column:
    return F.nullif(_c(a), _c(b))


def case_when(condition: Column, yes: Column, no: Column) -> Column:
    """A null condition takes the other branch."""
    return F.when(condition, yes).otherwise(no)


def cast(x: ColumnLike, source: str, target: str) -> Column:
    """A cast that fails on what it would change: fractions to integers, odd words to booleans."""
    x = _c(x)
    if source in ("double", "float") and target in ("bigint", "int", "long"):
        return guard(x == F.floor(x).cast("double"), finite(x).cast(target), "cast: the float is not integral")
    if source == "string" and target == "boolean":
        return guard(F.lower(x).isin("true", "false"), x.cast("boolean"), "cast: the text is neither true nor false")
    return x.cast(target)


def try_cast(x: ColumnLike, source: str, target: str) -> Column:
    """As ``cast``, with null for what fails."""
    x = _c(x)
    if source in ("double", "float") and target in ("bigint", "int", "long"):
        return F.when(x == F.floor(x).cast("double"), x.try_cast(target))
    if source == "string" and target == "boolean":
        return F.when(F.lower(x).isin("true", "false"), x.try_cast("boolean"))
    if source == "string" and target in ("bigint", "int", "long"):
        return F.when(x.rlike(r"^\s*[+-]?[0-9]+\s*\z"), x.try_cast(target))
    return x.try_cast(target)


def double_i64(x: ColumnLike) -> Column:
    """Twice a 64-bit integer; overflow is an error."""
    return _c(x).cast("long") * F.lit(2).cast("long")
