"""Tables about Han characters, made by the transliteration rules that ship with Spark (ICU), which give one reading a character, and a
small table of other readings.

Each table is made in one call over the two blocks of common ideographs and kept for the process.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import SparkSession

BLOCKS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF))

#: Readings besides the one that the rules give, for common characters that have several.
MORE_READINGS = {
    "行": "hang", "长": "zhang", "重": "chong", "乐": "yue", "了": "liao", "都": "du", "还": "huan", "得": "dei", "地": "de",
    "着": "zhao zhuo", "和": "huo", "会": "kuai", "传": "zhuan", "单": "shan chan", "调": "tiao", "朝": "zhao", "藏": "zang",
    "曾": "zeng", "差": "chai ci", "车": "ju", "宿": "xiu", "石": "dan", "厦": "xia", "薄": "bao", "血": "xie", "角": "jue",
    "校": "jiao", "降": "xiang", "觉": "jiao", "解": "xie", "卡": "qia", "壳": "qiao", "落": "la lao", "绿": "lu", "模": "mu",
    "弹": "tan", "提": "di", "系": "ji", "省": "xing", "盛": "cheng", "什": "shi", "似": "shi", "率": "shuai", "为": "wei", "削": "xue",
    "约": "yao", "择": "zhai", "扎": "za", "占": "zhan", "种": "chong", "属": "zhu", "拓": "ta", "尾": "yi", "舍": "she", "色": "shai",
    "便": "pian", "泊": "po", "参": "shen cen", "称": "chen", "澄": "deng", "大": "dai", "给": "ji", "号": "hao", "吓": "he",
    "见": "xian", "叶": "xie", "少": "shao", "数": "shuo", "说": "shui", "同": "tong", "吐": "tu", "万": "mo", "吁": "xu", "熟": "shou",
}


def _over_blocks(spark: SparkSession, rule: str) -> dict[str, str]:
    """Each character of the blocks to what the rule makes of it alone."""
    chars = [chr(c) for a, b in BLOCKS for c in range(a, b + 1)]
    t = spark._jvm.com.ibm.icu.text.Transliterator.getInstance(rule)
    return dict(zip(chars, t.transliterate("\n".join(chars)).split("\n"), strict=True))


@lru_cache(1)
def _simplified(spark: SparkSession) -> tuple[str, str]:
    pairs = [(a, b) for a, b in _over_blocks(spark, "Hant-Hans").items() if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def simplified(spark: SparkSession) -> tuple[str, str]:
    """(traditional characters, their simplified forms), for ``translate``."""
    return _simplified(spark)


@lru_cache(1)
def _readings(spark: SparkSession) -> dict[str, tuple[str, ...]]:
    out = {}
    for c, r in _over_blocks(spark, "Han-Latin; Latin-ASCII; Lower").items():
        r = r.strip()
        if re.fullmatch("[a-z]+", r):
            out[c] = tuple(sorted({r, *MORE_READINGS.get(c, "").split()}))
    return out


def readings(spark: SparkSession) -> dict[str, tuple[str, ...]]:
    """Toneless readings of each character, sorted."""
    return _readings(spark)
