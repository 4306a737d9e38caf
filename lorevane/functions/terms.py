"""Search terms of spoken queries, and romanised forms of names.

Runs and n-grams are expressions. Ranking a query's terms and multiplying out readings run as Arrow functions, over queries
and titles only; the tables of readings have a fixed size.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lorevane import constants as C

from .text import HANZI, let

_RUN = re.compile(f"({HANZI}+)|([A-Za-z0-9]+)")
_IS_HANZI = re.compile(HANZI)


def runs(normalized: Column) -> Column:
    """Maximal runs of ideographs or of ASCII letters and digits, the latter in lower case."""
    return F.transform(F.regexp_extract_all(normalized, F.lit(f"{HANZI}+|[A-Za-z0-9]+"), F.lit(0)), F.lower)


def ngrams(run: Column, least: int = 3, most: int = 4) -> Column:
    """Long grams first, in order; those that begin or end with a stop word are left out."""
    stop = F.array(*[F.lit(w) for w in sorted({w for w in C.STOP_WORDS if len(w) == 1})])

    def of(chars: Column, n: int) -> Column:
        at = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - (n - 1))).otherwise(F.array().cast("array<int>"))
        grams = F.transform(at, lambda i: F.slice(chars, i, n))
        good = F.filter(grams, lambda g: ~F.array_contains(stop, g[0]) & ~F.array_contains(stop, F.element_at(g, -1)))
        return F.transform(good, lambda g: F.array_join(g, ""))

    return let(F.split(run, ""), lambda chars: F.concat(*[of(chars, n) for n in range(most, least - 1, -1)]))


def escape(term: Column) -> Column:
    """A term as the full-text syntax needs it: quoted unless it is letters and digits and no reserved word."""
    bare = term.rlike("^[A-Za-z0-9]+$") & ~F.upper(term).isin(*C.RESERVED)
    return F.when(bare, term).otherwise(F.concat(F.lit('"'), F.replace(term, F.lit('"'), F.lit('""')), F.lit('"')))


def unescape(term: Column) -> Column:
    return F.replace(F.regexp_replace(F.trim(term), '^"+|"+$', ""), F.lit('""'), F.lit('"'))


def spellings(text: str, table: dict[str, tuple[str, ...]], most: int = C.PINYIN_COMBOS) -> list[str]:
    """Readings of the ideographs of a text: spaced, joined, and initials; up to ``most`` combinations."""
    combos: list[list[str]] = [[]]
    chars = _IS_HANZI.findall(text)
    if not chars:
        return []
    for c in chars:
        combos = [[*row, r] for row in combos for r in table.get(c) or ("?",)][:most]
    out = set()
    for row in combos:
        joined, initials = "".join(row), "".join(x[0] for x in row)
        out.add(" ".join(row))
        out |= {joined} if len(joined) >= 3 else set()
        out |= {initials} if len(initials) >= 2 else set()
    return sorted(out)


def extract(q: str, table: dict[str, tuple[str, ...]], *, gram_cap: int = C.GRAM_CAP, term_cap: int = C.TERM_CAP) -> list[str]:
    """Terms of a normalised query, best first."""
    stop, ranked = set(C.STOP_WORDS), {}

    def offer(weight: int, term: str) -> None:
        if term:
            ranked.setdefault(term, weight)

    def romanised(weight: int, text: str) -> None:
        for s in spellings(text, table):
            if len(s.replace(" ", "")) >= 3:
                offer(weight, s)

    for han, latin in _RUN.findall(q):
        if latin:
            if len(latin) >= 3:
                offer(80, latin.lower())
        elif len(han) <= 6:
            if len(han) >= 3 and han not in stop:
                offer(100 + len(han), han)
            if len(han) >= 2:
                romanised(70, han)
        else:
            grams = [han[i : i + n] for n in (4, 3) for i in range(len(han) - n + 1)]
            for g in [g for g in grams if g[0] not in stop and g[-1] not in stop][:gram_cap]:
                if g not in stop:
                    offer(50 + len(g), g)
                    romanised(40, g)
    n = len(_IS_HANZI.findall(q))
    if q and not n:
        joined = re.sub("[^A-Za-z0-9]", "", q)
        offer(95, joined if len(joined) >= 3 else "")
        offer(90, q if " " in q else "")
    elif 1 <= n <= 6 and len(q) >= 3:
        offer(90, q if q not in stop else "")
        romanised(60, q)
    return sorted(ranked, key=lambda t: (-ranked[t], len(t.encode())))[:term_cap]


def extract_udf(table: dict[str, tuple[str, ...]], gram_cap: int = C.GRAM_CAP):
    def run(q: pd.Series) -> pd.Series:
        return q.map(lambda x: extract(x, table, gram_cap=gram_cap) if x else [])

    return F.pandas_udf(run, "array<string>")


def pinyin_bag(table: dict[str, tuple[str, ...]]):
    """(title, names) to the lines of all their spellings."""
    def run(title: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(sorted({s for x in (t, *(a if a is not None else ())) if x for s in spellings(x, table)})) for t, a in zip(title, names)])

    return F.pandas_udf(run, "string")
