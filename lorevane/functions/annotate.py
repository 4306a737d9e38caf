"""Keys, kinds, names and visibility of a chunk, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorevane import constants as C

from .text import HANZI, SPACE, first_chars, lines, normalize, strip

BAR = "|"


def body_hash(body: Column) -> Column:
    return F.sha1(F.concat(F.lit("body:"), body).cast("binary"))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def stable_key(path: Column, title: Column, table=("", ""), ordinal: Column | None = None) -> Column:
    """Key of a chunk by path and title; with an ordinal, the form that a second chunk of that key gets."""
    parts = [normalize(path, table), normalize(title, table)] + ([ordinal.cast("string")] if ordinal is not None else [])
    return F.sha1(F.concat_ws(BAR, *parts).cast("binary"))


def alt_anchor(path: Column, body: Column, table=("", "")) -> Column:
    return F.sha1(F.concat_ws(BAR, normalize(path, table), first_chars(normalize(body, table), 80)).cast("binary"))


def entity_type(title: Column, body: Column) -> Column:
    """First class with one of its words in the title or the first 80 characters of the body."""
    text = F.concat(title, F.lit("\n"), first_chars(body, 80))
    out = F.lit("other")
    for kind, words in reversed(C.ENTITY_WORDS):
        out = F.when(text.rlike("|".join(words)), F.lit(kind)).otherwise(out)
    return out


def latin_tail(title: Column) -> Column:
    """The Latin name at the end of a title that has ideographs before it; null if there is none."""
    tail = strip(F.regexp_extract(title, r"([A-Za-z \t\n\f\r'-]+)$", 1))
    head = F.regexp_replace(title, r"[A-Za-z \t\n\f\r'-]+$", "")
    return F.when(head.rlike(HANZI) & (F.length(tail) >= 2), tail)


def aliases(title: Column, body: Column) -> Column:
    """Other names: listed after a marker, in brackets in the title, or as its Latin tail. Sorted, distinct."""
    marker = f"(?:{'|'.join(C.NAME_MARKERS)})[{C.NAME_COLONS}][{SPACE}]*"
    rest_of_line = F.regexp_extract_all(F.concat(title, F.lit("\n"), body), F.lit(marker + "([^\n]+)"), F.lit(1))
    listed = F.flatten(F.transform(rest_of_line, lambda x: F.split(x, f"[{C.NAME_COMMAS}]")))
    # The first bracket that has something before it and in it.
    inner = strip(F.regexp_extract(title, f"^(?s:.+?)[{C.OPEN_BRACKETS}]([^{C.CLOSE_BRACKETS}]+)[{C.CLOSE_BRACKETS}]", 1))
    bracket = F.when((F.length(inner) > 0) & (F.length(inner) <= C.BRACKET_MOST), F.array(inner)).otherwise(F.array().cast("array<string>"))
    tail = latin_tail(title)
    rest = F.when(tail.isNotNull(), F.array(tail)).otherwise(F.array().cast("array<string>"))
    found = F.concat(F.transform(listed, strip), bracket, rest)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x) > 0)))


def secret_line(line: Column) -> Column:
    t = strip(line)
    out = t.contains(C.SECRET_PHRASE)
    for p in C.SECRET_PREFIXES:
        out = out | t.startswith(p)
    return out


def visibility(body: Column) -> Column:
    """Bits that the lines of a body call for."""
    def secret(x):
        t = strip(x)
        return t.startswith("【秘密】") | t.startswith("【密谋】") | F.lower(t).contains("secret")

    def dm(x):
        t = strip(x)
        return t.startswith("【DM】") | t.startswith("DM only") | t.contains(C.SECRET_PHRASE)

    rows = lines(body)
    bit = lambda test, v: F.when(F.exists(rows, test), F.lit(v)).otherwise(F.lit(0))
    return (F.lit(C.PUBLIC).bitwiseOR(bit(secret, C.SECRET)).bitwiseOR(bit(dm, C.DM_ONLY))).cast("long")


def is_hidden(visibility: Column) -> Column:
    return visibility.bitwiseAND(C.SECRET | C.DM_ONLY | C.HIDDEN) != 0


def is_secret(visibility: Column) -> Column:
    return visibility.bitwiseAND(C.SECRET) != 0


def public_body(body: Column, visibility: Column) -> Column:
    """The body without secret lines; a placeholder where nothing public is left."""
    rows = lines(body)
    left = F.array_join(F.filter(rows, lambda x: ~secret_line(x)), "\n")
    hidden = is_hidden(visibility) | F.exists(rows, secret_line)
    return F.when(strip(left) != "", left).when(hidden, F.lit(C.HIDDEN_BODY)).otherwise(body)


def search_text(title: Column, body: Column, names: Column, pinyin: Column, table=("", ""), synonyms: Column | None = None) -> Column:
    """What the full-text index holds: title, body, names, synonyms, readings and the normalised body; blank parts go."""
    extra = F.array_join(synonyms, "\n") if synonyms is not None else F.lit("")
    parts = F.array(title, body, F.array_join(names, "\n"), extra, pinyin, normalize(body, table))
    return F.array_join(F.filter(parts, lambda x: strip(x) != ""), "\n")


def chapter_like(t: Column) -> Column:
    t = strip(t)
    return t.startswith("第") | t.rlike("[章节回]")


def entry_heading(t: Column) -> Column:
    """A short line that may be the title of an entry."""
    t = strip(t)
    bracketed = t.startswith("【") & t.endswith("】")
    plain = ~t.rlike("[；;]$") & ~t.rlike("[。！？：:]")
    return F.length(t).between(2, 16) & ~chapter_like(t) & (bracketed | plain)


def wants_model(title: Column, text: Column) -> Column:
    n = F.length(text)
    return (n >= C.LLM_LEAST) & (chapter_like(title) | (n >= C.LLM_PLAIN_LEAST))


def chapter_prefix(path: Column) -> Column:
    """The path without its last part; empty if it has one part only."""
    return F.regexp_extract(path, r"(?s)^(.*) / ", 1)


def relative_path(path: Column, root: Column) -> Column:
    """A path below the root; the file's name if it lies elsewhere."""
    p, r = F.translate(path, "\\", "/"), F.regexp_replace(F.translate(root, "\\", "/"), "/+$", "")
    below = F.call_function("substring", p, F.length(r) + 2)
    return F.when(p.startswith(F.concat(r, F.lit("/"))), below).otherwise(F.regexp_extract(p, "([^/]*)$", 1))
