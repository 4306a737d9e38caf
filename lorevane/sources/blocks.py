"""Texts to titled blocks: Markdown, HTML, plain text, and the cutting of long blocks.

Every reader is one projection, without a shuffle: a text is cut in one pass over its lines. A block is
struct<heading_level:int, title:string, text:string>; the Python readers have it as a tuple (level, title, text).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorevane import constants as C
from lorevane.functions import text as T
from lorevane.functions.lift import SPACES, lift

BLOCK = "struct<heading_level:int,title:string,text:string>"
NONE = f"array<{BLOCK}>"
Block = tuple[int, str, str]

_HANZI = re.compile(T.HANZI)
_BLANKS = re.compile(f"[{SPACES}]+")
_ATX = re.compile(r"(#{1,4})[ \t]")


def nothing(kind: str = NONE) -> Column:
    return F.array().cast(kind)


def lines_of(text: str) -> list[str]:
    """Lines without their ends; a final line end begins no line."""
    out = text.replace("\r\n", "\n").split("\n")
    return out[:-1] if not out[-1] else out


def normal(text: str, table: dict[int, str]) -> str:
    return _BLANKS.sub(" ", text.translate(table)).strip(" ")


def _mapping(table: tuple[str, str]) -> dict[int, str]:
    return str.maketrans(table[0] + T.WIDE, table[1] + T.NARROW)


def overlapped(text: str) -> list[str]:
    """A text as itself if it has up to 900 characters, else in parts that repeat the last 40 characters of the part before."""
    if len(text) <= C.LONG_BLOCK:
        return [text]
    out, part, size = [], [], 0
    for p in text.split("\n"):
        if size and size + len(p) > C.LONG_BLOCK:
            whole = "".join(part)
            out.append(whole.strip(SPACES))
            part = [whole[-C.LONG_OVERLAP :]]
            size = len(part[0])
        part += [p, "\n"]
        size += len(p) + 1
    last = "".join(part).strip(SPACES)
    return [*out, last] if last else out


def cut_long(blocks: list[Block]) -> list[Block]:
    return [(level, title, t) for level, title, text in blocks for t in overlapped(text)]


class Outline:
    """Blocks as they are found: a heading closes the block before it."""

    def __init__(self):
        self.level, self.title, self.body, self.out = 1, C.DOCUMENT, [], []

    def close(self) -> None:
        text = "".join(self.body).strip(SPACES)
        if text:
            self.out.append((self.level, self.title, text))
        self.body = []

    def head(self, level: int, title: str) -> None:
        self.close()
        self.level, self.title = level, title or C.UNTITLED


def headed(text: str) -> list[Block]:
    """Markdown's blocks before long ones are cut; empty if there are none."""
    rows, o, i = lines_of(text), Outline(), 0
    while i < len(rows):
        line = rows[i].rstrip(SPACES)
        i += 1
        if m := _ATX.match(line):
            o.head(len(m[1]), line[len(m[1]) :].strip(SPACES).rstrip("#").strip(SPACES))
            continue
        name, under = line.strip(SPACES), rows[i].strip(SPACES) if i < len(rows) else ""
        if 1 <= len(name) <= 80 and len(under) >= 3 and set(under) in ({"="}, {"-"}):
            o.head(1 if under[0] == "=" else 2, name)
            i += 1
        elif line in ("***", "---", "___"):
            o.close()
        else:
            o.body += [rows[i - 1], "\n"]
    o.close()
    return o.out


def paragraphs(text: str) -> list[str]:
    """Parts of a plain text: a blank line closes one that is long enough, and 2000 characters close any."""
    out, part, size = [], [], 0
    for line in text.split("\n"):
        p = line.rstrip(SPACES)
        if not p:
            if size > C.PLAIN_CHARS or len(_HANZI.findall("".join(part))) > C.PLAIN_HANZI:
                out.append("".join(part))
                part, size = [], 0
            else:
                part.append("\n")
                size += 1
            continue
        part += ["\n", p] if size else [p]
        size += len(p) + (size > 0)
        if size >= C.PLAIN_MOST:
            out.append("".join(part))
            part, size = [], 0
    last = "".join(part)
    out += [last] if last.strip(SPACES) else []
    return [x for x in out or [text] if x.strip(SPACES)]


def plain_blocks(text: str, table: dict[int, str]) -> list[Block]:
    found = paragraphs(text)
    return [(1, normal(x, table)[: C.TITLE_CHARS] or f"{C.PARAGRAPH}{i}", x) for i, x in enumerate(found, 1)]


def heading_blocks(text: Column) -> Column:
    return lift(headed, NONE)(text)


def plain(text: Column, table=("", "")) -> Column:
    """Blocks of a plain text, each under its first characters."""
    to = _mapping(table)
    return lift(lambda x: plain_blocks(x, to), NONE)(text)


def split_long(text: Column) -> Column:
    return lift(overlapped, "array<string>")(text)


def split_long_blocks(blocks: Column) -> Column:
    return lift(lambda bs: cut_long([(b["heading_level"], b["title"], b["text"]) for b in bs]), NONE)(blocks)


def markdown(text: Column, table=("", "")) -> Column:
    to = _mapping(table)
    return lift(lambda x: cut_long(headed(x)) or plain_blocks(x, to), NONE)(text)


LEVEL, OPEN, SHUT = "\ue002", "\ue000", "\ue001"
# Which elements go with what is in them, and that anything else in angle brackets is a tag.
DROPPED = ("script", "style")
TAGS = "(?is)" + "|".join(f"<{x}[^>]*>.*?</{x}>" for x in DROPPED) + "|<[^>]+>"


def html_text(html: Column) -> Column:
    """HTML as Markdown: headings as # lines, everything else in tags, scripts and styles as a space. Entities stay.

    A heading begins at the leftmost opening tag of any level and ends at the next closing one, so headings don't nest."""
    # Private characters stand for a heading's level and ends until its inner tags are gone and it can be trimmed.
    html = F.translate(html, LEVEL + OPEN + SHUT, "")
    html = F.regexp_replace(html, r"(?is)<h([1-4])[^>]*>(.*?)</h[1-4]>", f"\n{LEVEL}$1 {OPEN}$2{SHUT}\n")
    html = F.regexp_replace(html, TAGS, " ")
    html = F.regexp_replace(html, rf"{OPEN}[{T.SPACE}]+", OPEN)
    html = F.regexp_replace(html, rf"[{T.SPACE}]+{SHUT}", SHUT)
    for n in range(1, 5):
        html = F.replace(html, F.lit(f"{LEVEL}{n}"), F.lit("#" * n))
    return F.translate(html, OPEN + SHUT, "")


def html(text: Column, table=("", "")) -> Column:
    return markdown(html_text(text), table)


def merged(blocks: list[dict]) -> list[Block]:
    """Neighbouring blocks of one title as one block."""
    runs: list[tuple[int, str, list[str]]] = []
    for b in blocks:
        if runs and b["title"] and runs[-1][1] == b["title"]:
            runs[-1][2].append(b["text"])
        else:
            runs.append((b["heading_level"], b["title"], [b["text"]]))
    return [(level, title, "\n".join(texts)) for level, title, texts in runs]


def coalesce_titles(blocks: Column) -> Column:
    return lift(merged, NONE)(blocks)


def parse(kind: Column, text: Column, table=("", "")) -> Column:
    """Blocks of a text by its format."""
    to = _mapping(table)
    read = lift(lambda x, k: (cut_long(headed(x)) if k in ("markdown", "html") else []) or plain_blocks(x, to), NONE)
    return read(F.when(kind == "html", html_text(text)).otherwise(text), kind)


def heading_paths(blocks: Column, stem: Column) -> Column:
    """For each block the path of the headings above it: a heading closes those of its level and below."""

    def paths(bs: list[dict], name: str) -> list[str]:
        above: list[tuple[int, str]] = []
        out = []
        for b in bs:
            while above and above[-1][0] >= b["heading_level"]:
                above.pop()
            above.append((b["heading_level"], b["title"]))
            out.append(" / ".join([name, *(t for _, t in above)]))
        return out

    return lift(paths, "array<string>")(blocks, stem)
