"""Scalar functions as column expressions: parsing, formatting, names, arithmetic, arrays, maps, validators. Null in,
null out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date forms that are tried in order.
DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\s]+"
PHONE = r"^\+?[0-9][0-9 ().-]{6,18}[0-9]$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# text


def parse_date(c, forms: Sequence[str] = DATE_FORMS) -> Column:
    return F.coalesce(*(F.try_to_timestamp(_col(c), F.lit(f)) for f in forms))


def sanitized(c, most: int | None = None) -> Column:
    """Without tags, quotes, semicolons, double dashes and control characters, trimmed, at most ``most`` characters."""
    x = F.regexp_replace(_col(c), "<[^>]+>", "")
    x = F.regexp_replace(x, "(--|;|'|\")", "")
    x = F.trim(F.regexp_replace(x, r"[\x00-\x1F\x7F]", ""))
    return F.substring(x, 1, most) if most else x


def truncated(c, most: int = 100, suffix: str = "...") -> Column:
    c = _col(c)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - len(suffix)), F.lit(suffix)))


def camel(c) -> Column:
    words = F.split(_col(c), r"[-_\s]")
    first = F.get(words, F.lit(0))
    low = F.concat(F.lower(F.substring(first, 1, 1)), F.substring(first, F.lit(2), F.length(first)))
    rest = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    return F.concat(low, F.array_join(rest, ""))


def kebab(c) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(_col(c), "([a-z])([A-Z])", "$1-$2"), r"[\s_]", "-"))


def snake(c) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(_col(c), "([a-z])([A-Z])", "$1_$2"), r"[\s-]", "_"))


def title(c) -> Column:
    return F.initcap(F.lower(_col(c)))


def sentence(c) -> Column:
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def capitalized(c) -> Column:
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def slug(c) -> Column:
    x = F.regexp_replace(F.trim(F.lower(_col(c))), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(x, r"\s+", "-"), "-+", "-")


def padded(c, size: int, fill: str = " ") -> Column:
    c = _col(c)
    return F.when(F.length(c) >= size, c).otherwise(F.rpad(c, size, fill))


def masked_email(c) -> Column:
    """The first character of the name and the host."""
    return F.regexp_replace(_col(c), "^(.)[^@]*@", "$1***@")


def phone_text(c, form: str = "(XXX) XXX-XXXX") -> Column:
    """Ten digits in the places of the Xs of ``form``; other texts stay."""
    digits, parts, at = F.regexp_replace(_col(c), "[^0-9]", ""), [], 0
    for x in form:
        parts.append(F.substring(digits, at + 1, 1) if x == "X" else F.lit(x))
        at += x == "X"
    return F.when(F.length(digits) == 10, F.concat(*parts)).otherwise(_col(c))


# numbers


def number_text(c, places: int = 2) -> Column:
    return F.format_number(_col(c).cast("double"), places)


def percent_text(c, places: int = 1) -> Column:
    return F.concat(F.call_function("format_number", _col(c).cast("double") * 100, F.lit("0." + "0" * places if places else "0")), F.lit("%"))


def size_text(c, places: int = 2) -> Column:
    """Bytes in the largest unit that they are one or more of."""
    x, units = _col(c).cast("double"), ("B", "KB", "MB", "GB", "TB", "PB")
    out = F.when(x == 0, "0 B")
    for i, u in enumerate(units):
        form = F.concat(F.call_function("format_number", x / 1024.0**i, F.lit("0." + "0" * places if places else "0")), F.lit(f" {u}"))
        out = out.when(x < 1024.0 ** (i + 1), form) if i + 1 < len(units) else out.when(x.isNotNull(), form)
    return out


def rounded_half_up(c, places: int = 0) -> Column:
    k = 10.0**places
    return F.floor(_col(c).cast("double") * k + 0.5) / k


def clamped(c, least, most) -> Column:
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(least), F.least(c, F.lit(most))))


def mapped(c, low, high, to_low, to_high) -> Column:
    return F.try_divide((_col(c).cast("double") - low) * (to_high - to_low), F.lit(float(high - low))) + to_low


def normalized(c, least, most) -> Column:
    return F.try_divide(_col(c).cast("double") - least, F.lit(float(most - least)))


def percent_of(c, total) -> Column:
    return F.try_divide(_col(c).cast("double") * 100, _col(total).cast("double") if not isinstance(total, (int, float)) else F.lit(float(total)))


def percent_change(old, new) -> Column:
    return F.try_divide((_col(new).cast("double") - _col(old)) * 100, _col(old).cast("double"))


def even(c) -> Column:
    return F.pmod(_col(c), F.lit(2)) == 0


def age(birth, on) -> Column:
    """Whole years from ``birth`` to ``on``."""
    birth, on = _col(birth), _col(on)
    early = (F.month(on) < F.month(birth)) | (F.month(on) == F.month(birth)) & (F.dayofmonth(on) < F.dayofmonth(birth))
    return F.year(on) - F.year(birth) - early.cast("int")


# arrays and maps


def chunked(c, size: int) -> Column:
    """An array in arrays of ``size``."""
    c = _col(c)
    starts = F.when(F.size(c) > 0, F.sequence(F.lit(1), F.size(c), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(c, i, F.lit(size)))


def unique_by(c, field: str) -> Column:
    """The first struct of an array for each value of a field."""
    return F.filter(_col(c), lambda x, i: F.array_position(F.transform(_col(c), lambda y: y[field]), x[field]) == i + 1)


def array_total(c) -> Column:
    return F.aggregate(_col(c), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def array_mean(c) -> Column:
    c = F.filter(_col(c), lambda x: x.isNotNull())
    return F.try_divide(array_total(c), F.size(c).cast("double"))


def picked(c, keys: Sequence[str]) -> Column:
    return F.map_filter(_col(c), lambda k, _: k.isin(*keys))


def omitted(c, keys: Sequence[str]) -> Column:
    return F.map_filter(_col(c), lambda k, _: ~k.isin(*keys))


def merged_maps(a, b) -> Column:
    """Both maps; values of ``b`` for keys of both."""
    return F.map_concat(F.map_filter(_col(a), lambda k, _: ~F.array_contains(F.map_keys(_col(b)), k)), _col(b))


def nested(c, path: str) -> Column:
    """A value of JSON text at a dotted path."""
    return F.get_json_object(_col(c), "$." + path)


# validators


def is_email(c) -> Column:
    return _col(c).rlike(EMAIL)


def is_url(c) -> Column:
    return _col(c).rlike(URL)


def is_phone(c) -> Column:
    return _col(c).rlike(PHONE)


def has_extension(c, allowed: Sequence[str]) -> Column:
    return F.concat(F.lit("."), F.element_at(F.split(F.lower(_col(c)), r"\."), -1)).isin(*(a.lower() for a in allowed))


def has_length(c, least: int = 0, most: int | None = None) -> Column:
    n = F.length(_col(c))
    return (n >= least) & (n <= most) if most is not None else n >= least


def is_integer(c) -> Column:
    return _col(c).cast("string").rlike(r"^[+-]?[0-9]+$")


def is_decimal(c, places: int | None = None) -> Column:
    return _col(c).cast("string").rlike(r"^[+-]?[0-9]+(\.[0-9]" + (f"{{1,{places}}}" if places else "+") + ")?$")


def is_card(c) -> Column:
    """Thirteen to nineteen digits, spaces and dashes aside, that pass Luhn's check."""
    x = F.regexp_replace(_col(c), "[ -]", "")
    return F.when(x.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", x)).otherwise(x.isNull() & F.lit(None).cast("boolean"))
