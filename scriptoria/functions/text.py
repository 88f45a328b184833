"""Text helpers whose white space, case and rounding rules are those of the data's origin, not Spark's defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """A missing text is an empty one."""
    return F.coalesce(col(c), F.lit(""))


def stripped(c: Column | str) -> Column:
    """Without Unicode white space at both ends (trim() would take U+0020 only)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def clean(c: Column | str) -> Column:
    """White space made single and stripped; null gives an empty text."""
    return stripped(F.regexp_replace(text(c), r"(?U)\s+", " "))


def or_else(*cs: Column | str) -> Column:
    """The first that is neither null nor empty, else an empty text."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs], F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is made once for a row, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def half_up(c: Column | str) -> Column:
    """Rounding with halves towards positive infinity."""
    return F.floor(col(c) + 0.5)


def upper_median(values: Column) -> Column:
    """The upper middle element of an array of numbers; no interpolation."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def like(c: Column | str, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(col(c), F.lit(pattern)), F.lit(False))


def uri_component(c: Column | str) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) alone."""
    out = F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20"))
    for plain, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def words(c: Column | str) -> Column:
    """Lower-case words of two or more letters or digits that are no stop words."""
    found = F.regexp_extract_all(F.lower(text(c)), F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


#: The stop list of passage retrieval.
STOP_WORDS = (
    "a an and are as at be been by can could did do does for from had has have how i in is it its me of on or our should that the their them there these they this those to was we were what when where which who why will with would you your "
    "explain please paper study result results"
).split()


def terms(c: Column | str) -> Column:
    return F.array_distinct(words(c))


def byte_size(c: Column | str) -> Column:
    """A size in bytes for people: B, KB, MB or GB with one decimal from KB on."""
    n = col(c).cast("double")
    return (
        F.when(n < 1024, F.concat(F.format_number(n, 0), F.lit(" B")))
        .when(n < 1024**2, F.concat(F.format_number(n / 1024, 1), F.lit(" KB")))
        .when(n < 1024**3, F.concat(F.format_number(n / 1024**2, 1), F.lit(" MB")))
        .otherwise(F.concat(F.format_number(n / 1024**3, 1), F.lit(" GB")))
    )


def file_name(c: Column | str, most: int = 255) -> Column:
    """The last part of a path without line breaks and NULs, cut to most characters."""
    return F.left(F.regexp_replace(F.regexp_extract(col(c), r"([^/\\]*)$", 1), r"[\r\n\x00]", ""), F.lit(most))


def xml_escaped(c: Column | str) -> Column:
    out = text(c)
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def xml_restored(c: Column | str) -> Column:
    out = text(c)
    for plain, code in (("<", "&lt;"), (">", "&gt;"), ("&", "&amp;")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def excerpt(c: Column | str, limit: Column) -> Column:
    """Texts over the limit: the first 70 % of what it leaves, a mark, and the end."""
    t = text(c)
    room = limit - len(SHORTENED)
    head = F.floor(room * 0.7).cast("int")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, F.lit(1), head), F.lit(SHORTENED), F.right(t, room - head)))


#: Fixed value: what stands where a message was shortened.
SHORTENED = "\n[earlier message shortened]\n"


def retry_delay(attempt: Column, after_ms: Column) -> Column:
    """Milliseconds to wait before a retry: doubling from one second, or what the server asks for if that is longer."""
    return F.greatest(F.pow(F.lit(2.0), attempt) * 1000, F.coalesce(after_ms.cast("double"), F.lit(0.0)))
