"""Replies of a splitting model, and the tables around it: settings, judgements and the cache of replies."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevane import constants as C
from lorevane.functions.text import strip, strip_code_fence

#: Numbers come as text, since models also write "003" or "[003]".
RAW = "array<struct<title:string,aliases:array<string>,entity_type:string,body:string,anchor:string,start:string,end:string,heading_level:string>>"
ENTRY = "struct<title:string,aliases:array<string>,entity_type:string,body:string,anchor:string,start:bigint,end:bigint,heading_level:int>"


def flexible_int(c: Column) -> Column:
    """First run of digits as a number; -1 if there is none or it is too large. A number keeps its sign."""
    text = c.cast("string")
    whole = F.call_function("try_to_number", F.regexp_extract(text, "([0-9]+)", 1), F.lit("9" * 19)).cast("decimal(20,0)")
    fits = whole <= F.lit(2**63 - 1).cast("decimal(20,0)")
    n = F.when(fits, whole.cast("bigint"))
    return F.coalesce(F.when(text.rlike(r"^\s*-[0-9]+\s*$"), -n).otherwise(n), F.lit(-1)).cast("bigint")


def clean(e: Column) -> Column:
    """An entry with trimmed fields, a known kind, a level from 1 to 3 and proper names."""
    title, kind = strip(F.coalesce(e["title"], F.lit(""))), strip(F.coalesce(e["entity_type"], F.lit("")))
    level = flexible_int(e["heading_level"])
    names = F.filter(F.transform(F.coalesce(e["aliases"], F.array().cast("array<string>")), lambda a: strip(a)), lambda a: (a != "") & (a != title))
    return F.struct(
        title.alias("title"), names.alias("aliases"), F.when(kind.isin(*C.ENTITY_TYPES), kind).otherwise(F.lit("")).alias("entity_type"),
        strip(F.coalesce(e["body"], F.lit(""))).alias("body"), strip(F.coalesce(e["anchor"], F.lit(""))).alias("anchor"),
        flexible_int(e["start"]).alias("start"), flexible_int(e["end"]).alias("end"),
        F.when(level.between(1, 3), level).otherwise(F.lit(2)).cast("int").alias("heading_level"))


def parse_entries(raw: Column) -> Column:
    """Entries of a reply: a bare array, an object with "entries", or the array inside of other text. Null if there are none."""
    t = strip_code_fence(raw)
    bare = F.when(t.startswith("["), F.from_json(t, RAW))
    wrapped = F.when(t.startswith("{"), F.from_json(t, f"entries {RAW}")["entries"])
    inner = F.from_json(F.regexp_extract(t, r"(?s)(\[.*\])", 1), RAW)
    found = F.filter(F.transform(F.coalesce(bare, wrapped, inner), clean), lambda e: e["title"] != "")
    return F.when(F.size(found) > 0, found)


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """Lexical judgements of an evaluation file: query, relevant titles, terms of which one must be extracted."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    x = F.from_json("value", "query string, relevant_chunk_ids array<string>, kind string, must_extract_any array<string>")
    return rows.select(x.alias("x")).select("x.*").where("kind = 'lexical'")


def cache_key(model: Column, title: Column, piece: Column, prompt: str) -> Column:
    return F.sha1(F.concat_ws("|", F.lit("v3"), F.sha1(F.lit(prompt).cast("binary")), model, title, piece).cast("binary"))


def cached(pieces: DataFrame, cache: DataFrame) -> DataFrame:
    """Pieces (key, ...) with the reply the cache has for them, or null."""
    return pieces.join(cache.select("key", "reply"), "key", "left")


def remember(cache: DataFrame, answered: DataFrame) -> DataFrame:
    """What to append to the cache: successful replies that it lacks."""
    good = answered.where("reply is not null").select("key", "reply").dropDuplicates(["key"])
    return good.join(cache.select("key"), "key", "left_anti")


DEFAULT_SETTINGS = '[llm]\nbase_url = ""\nmodel = ""\napi_key = ""\n'


def settings(path: str) -> dict[str, str] | None:
    """Model settings of a TOML file, flat or below [llm]; blank fields give none. A missing file is made with blank ones."""
    file = Path(path)
    if not file.exists():
        file.write_text(DEFAULT_SETTINGS)
    data = tomllib.loads(file.read_text())
    data = data.get("llm", data)
    found = {k: str(v).strip() for k, v in data.items()}
    return found if all(found.get(k) for k in ("base_url", "model")) else None
