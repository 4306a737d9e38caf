"""Text functions as column expressions. Lengths and offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorevane import constants as C

SPACE = r"\p{IsWhite_Space}"
HANZI = r"[一-鿿㐀-䶿]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Full-width forms lie at a fixed distance from their ASCII forms.
WIDE = "　" + "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = " " + "".join(map(chr, range(0x21, 0x7F)))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once. Inside of a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind that Unicode knows."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{SPACE}]+$", "")


def to_simplified(c: Column, table: tuple[str, str]) -> Column:
    return F.translate(c, *table) if table[0] else c


def to_half_width(c: Column) -> Column:
    return F.translate(c, WIDE, NARROW)


def normalize(c: Column, table: tuple[str, str] = ("", "")) -> Column:
    """Simplified, half width, runs of white space as one space, trimmed. Case stays."""
    return F.trim(F.regexp_replace(F.translate(c, table[0] + WIDE, table[1] + NARROW), rf"[{SPACE}]+", " "))


def hanzi_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(HANZI))


def has_hanzi(c: Column) -> Column:
    return c.rlike(HANZI)


def is_latin_or_digit(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9]+$")


def has_long_run(c: Column) -> Column:
    """Over six ideographs in a row."""
    return c.rlike(HANZI + "{7,}")


def first_chars(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def lines(c: Column) -> Column:
    """Lines without their ends; a final line end begins no line."""
    parts = F.split(F.regexp_replace(c, r"\r\n", "\n"), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def occurrences(c: Column, needle: Column) -> Column:
    """Non-overlapping occurrences; 0 for an empty needle."""
    n = (F.length(c) - F.length(F.replace(c, needle, F.lit("")))) / F.length(needle)
    return F.when(F.length(needle) > 0, n).otherwise(F.lit(0)).cast("long")


def quoted(needle: Column) -> Column:
    """A pattern for just this text."""
    return F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def overlapping(c: Column, needle: Column) -> Column:
    """Occurrences that may overlap. Only a needle that ends as it begins can overlap itself and needs the slower count."""
    ahead = F.concat(F.lit("(?="), quoted(needle), F.lit(")"))
    n = F.length(needle)
    ends = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.exists(ends, lambda k: F.call_function("left", needle, k) == F.call_function("right", needle, k))
    return F.when(own, F.regexp_count(c, ahead).cast("long")).otherwise(occurrences(c, needle))


def find_in(c: Column, needle: Column, start: Column) -> Column:
    """Offset (from 0) of the needle at or after ``start``; -1 if it isn't there."""
    return F.call_function("locate", needle, c, start + 1) - 1


def snippet(body: Column, query: Column, most: int = 90) -> Column:
    """The ``most`` characters from 80 before the first occurrence on, with ellipses; a short body as it is."""
    q = strip(query)
    at = F.when(F.length(q) > 0, F.greatest(F.call_function("instr", body, q) - 81, F.lit(0))).otherwise(F.lit(0))
    cut = F.call_function("substring", body, at + 1, F.lit(most))
    cut = F.concat(F.when(at > 0, F.lit("…")).otherwise(F.lit("")), cut, F.when(at + most < F.length(body), F.lit("…")).otherwise(F.lit("")))
    return F.when(F.length(body) <= most, body).otherwise(cut)


def highlight(body: Column, query: Column) -> Column:
    """Spans (start, end) of the non-overlapping occurrences of the trimmed query."""
    q = strip(query)
    n = F.length(q)
    parts = F.split(body, quoted(q))
    ends = F.aggregate(
        F.slice(parts, F.lit(1), F.size(parts) - 1), F.array().cast("array<int>"),
        lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0)) + F.length(x) + n)))
    spans = F.transform(ends, lambda e: F.struct((e - n).alias("start"), e.alias("end")))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def decode_entities(c: Column) -> Column:
    """The five XML entities, the ampersand first."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_code_fence(c: Column) -> Column:
    t = strip(c)
    inner = strip(F.regexp_replace(strip(F.regexp_replace(t, r"^```(?:json)?", "")), r"(?:```)+$", ""))
    return F.when(t.startswith("```"), inner).otherwise(t)


def strip_heading_marks(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), r"^[【】「」\[\]]+|[【】「」\[\]]+$", ""))


def timestamp_text(c: Column) -> Column:
    """UTC to the second, as text."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def copy_payload(template: Column, row: dict[str, Column]) -> Column:
    """Fills a template's fields one after another, as the values stand."""
    for k in ("entity_type", "title", "body", "public_body", "source_path"):
        template = F.replace(template, F.lit("{" + k + "}"), row[k])
    return template


def template_of(key: Column, body: Column) -> Column:
    """A stored template, else the default of its key; an unknown key gets the player's."""
    default = F.lit(C.TEMPLATES["player"])
    for k in ("full", "source"):
        default = F.when(key == k, F.lit(C.TEMPLATES[k])).otherwise(default)
    return F.coalesce(body, default)
