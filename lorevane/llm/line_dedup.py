"""Line dedup by a deletion-neighbourhood join.

Two lines are alike if at most one character is inserted, deleted or replaced between them, after ASCII letters are
lower-cased and white space is collapsed. A line goes if an equal line, or one alike, stands earlier: in a document
with a smaller id, or higher up in the same one. Blank lines stay; lines under ``LEAST`` characters go only for equal ones.

1. Every line becomes a hash, its place, and the hashes of its two halves. Equal lines meet by hash.
2. One edit leaves one half of the shorter line untouched, so only distinct lines that share a half with another can
   have a partner; the rest, nearly all, are settled.
3. Each line left emits its deletion neighbourhood as hashed keys: itself, and itself without its i-th character
   for every i. Equal keys join: a line with another's variant (one insertion), or two variants without the same place
   (one replacement). A bucket joins its members to its earliest one, or to the one whole line in it, never to each other.
4. The pairs are verified by edit distance on the lines themselves; the later one goes.

Counts per key combine before the shuffle, so a line, half or variant that very many documents share is no large task.

Texts of candidate lines are fetched from their documents: a sieve of fixed size lets those pass, and few others, before they are
joined by id and text.

Nulls and edges: a null text has no lines and stays null; null ids come last; lines of rows with equal ids count as
being at the same place when their numbers are equal, and neither is the earlier; an empty table gives no rows;
extra columns come through ``clean`` and are ignored by ``report``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevane.scratch import Scratch

from .common import sieve, sifted
from .words import raw

#: Characters that a line needs to be compared by edits.
LEAST = 10
LAST = (1 << 63) - 1


def canonical(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def halves(line: str) -> list[int]:
    """Hashes that a line shares with every line one edit away, at least one of them."""
    n, out = len(line), []
    for h in {n // 2, (n - 1) // 2}:
        out.append(xxhash.xxh64_intdigest(line[:h].encode(), 2 * h))
        out.append(xxhash.xxh64_intdigest(line[n - h :].encode(), 2 * h + 1))
    return out


_LINES = pa.schema([("did", pa.int64()), ("t", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("k", pa.list_(pa.int64()))])


def _hash(line: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(line)
    return d >> 64, d & 0xFFFFFFFFFFFFFFFF


def _lines(least: int):
    def run(batches):
        def out():
            h = np.array(hashes, np.uint64).reshape(-1, 2).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_keys)]).astype(np.int32)), pa.array(np.array(flat, np.uint64).view(np.int64)))
            b = pa.record_batch([pa.array(dids), pa.array(ts), pa.array(nos, pa.int32()), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), keys], schema=_LINES)
            for x in (dids, ts, nos, hashes, n_keys, flat):
                x.clear()
            return b

        dids, ts, nos, hashes, n_keys, flat = [], [], [], [], [], []
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                for did, t, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), raw(part.column(2))):
                    for no, line in enumerate(text.split(b"\n")):
                        c = canonical(line)
                        if not c:
                            continue
                        dids.append(did)
                        ts.append(t)
                        nos.append(no)
                        hashes.append(_hash(c))
                        s = c.decode()
                        k = halves(s) if len(s) >= least else []
                        n_keys.append(len(k))
                        flat += k
                    if len(dids) > 20_000:
                        yield out()
        if dids:
            yield out()

    return run


def _texts(batches):
    """(lines wanted, text) to the canonical texts of those lines, with their hashes."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            rows = []
            for wanted, text in zip(part.column(0).to_pylist(), raw(part.column(1))):
                lines = text.split(b"\n")
                for w in wanted:
                    if w["line"] < len(lines):
                        c = canonical(lines[w["line"]])
                        h = np.array(_hash(c), np.uint64).view(np.int64)
                        if (int(h[0]), int(h[1])) == (w["h1"], w["h2"]):
                            rows.append((w["h1"], w["h2"], w["did"], w["line"], c.decode()))
            if rows:
                h1, h2, did, line, text = zip(*rows)
                yield pa.record_batch({"h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "did": pa.array(did, pa.int64()), "line": pa.array(line, pa.int32()), "text": pa.array(text)})


def _variants(batches):
    """(id, text) to (key, place, id): the line itself at place -1, then the line without each of its characters."""
    for b in batches:
        keys, places, ids = [], [], []
        for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            v = [xxhash.xxh64_intdigest(s.encode())]
            v += [xxhash.xxh64_intdigest((s[:p] + s[p + 1 :]).encode()) for p in range(len(s))]
            keys.append(np.array(v, np.uint64).view(np.int64))
            places.append(np.arange(-1, len(s), dtype=np.int32))
            ids.append(np.full(len(v), i, np.int64))
            if sum(map(len, keys)) > 200_000:
                yield pa.record_batch({"key": np.concatenate(keys), "place": np.concatenate(places), "id": np.concatenate(ids)})
                keys, places, ids = [], [], []
        if keys:
            yield pa.record_batch({"key": np.concatenate(keys), "place": np.concatenate(places), "id": np.concatenate(ids)})


def _keyed(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64("text")


def find(spark: SparkSession, docs: DataFrame, scratch: Scratch, *, least: int = LEAST) -> DataFrame:
    """Every line that is not blank: did, t, line, and why it goes: null, 'equal' or 'near'.

    did and t name the document: its id and the hash of its text."""
    keep = scratch.keep
    did, t = _keyed(docs)
    slim = docs.where("text is not null").select(did.alias("did"), t.alias("t"), "text")
    lines = keep(slim.mapInArrow(_lines(least), "did long, t long, line int, h1 long, h2 long, k array<long>"))
    # t tells which of the documents with that id it is; it decides no order.
    first = F.min(F.struct("did", "line", "t")).alias("first")
    distinct = keep(lines.groupBy("h1", "h2").agg(first, F.first("k").alias("k")))
    keyed = distinct.select("h1", "h2", F.explode("k").alias("key"))
    shared = keep(keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key"))
    some = keyed.join(shared, "key", "left_semi").select("h1", "h2").distinct()
    some = keep(some.join(distinct, ["h1", "h2"]).select("h1", "h2", "first.*"))
    wanted = some.groupBy(F.col("did").alias("_d"), F.col("t").alias("_t")).agg(F.collect_list(F.struct("h1", "h2", "did", "line")).alias("wanted"))
    wanted = keep(wanted)
    own = sifted(spark, slim.select(F.xxhash64("did", "t").alias("h"), "did", "t", "text"), sieve(wanted.select(F.xxhash64("_d", "_t").alias("h"))))
    texts = own.join(wanted.hint("merge"), (F.col("did") == F.col("_d")) & (F.col("t") == F.col("_t"))).select("wanted", "text")
    texts = texts.mapInArrow(_texts, "h1 long, h2 long, did long, line int, text string").dropDuplicates(["h1", "h2"])
    texts = keep(texts.withColumn("id", F.monotonically_increasing_id()))
    places = texts.select("id", F.struct("did", "line").alias("at"))
    v = keep(texts.select("id", "text").mapInArrow(_variants, "key long, place int, id long"))
    full = keep(v.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("key"))
    v = keep(v.join(full, "key", "left_semi").join(places, "id"))
    whole = v.where("place = -1").select("key", F.col("id").alias("other"))
    holes = v.where("place >= 0")
    inserted = holes.join(whole, "key").select("id", "other")
    early = keep(holes.groupBy("key", "place").agg(F.min(F.struct("at", "id")).alias("e")).select("key", "place", F.col("e.id").alias("other")))
    replaced = holes.join(early, ["key", "place"]).where("id <> other").select("id", "other")
    pairs = keep(inserted.unionByName(replaced).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).where("a <> b").distinct())
    one, two = (texts.select(F.col("id").alias(x), F.struct("text", F.struct("did", "line").alias("at"), "h1", "h2").alias(f"r{x}")) for x in "ab")
    checked = pairs.join(one, "a").join(two, "b").where(F.levenshtein("ra.text", "rb.text", 1).between(0, 1))
    later = F.when(F.col("ra.at") < F.col("rb.at"), F.col("rb")).when(F.col("rb.at") < F.col("ra.at"), F.col("ra"))
    near = keep(checked.select(later.alias("x")).where("x is not null").select(F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2")).distinct())
    near = near.withColumn("near", F.lit(True))
    fate = keep(distinct.select("h1", "h2", F.struct("first.did", "first.line").alias("first")).join(near, ["h1", "h2"], "left"))
    out = lines.select("did", "t", "line", "h1", "h2").join(fate, ["h1", "h2"])
    why = F.when(F.col("near"), F.lit("near")).when(F.struct("did", "line") > F.col("first"), F.lit("equal"))
    return out.select("did", "t", "line", why.alias("why"))


def report(spark: SparkSession, docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """One row per (doc_id, text): doc_id, n_lines (not blank), n_equal and n_near (removed), removed (line numbers from 0)."""
    scratch = Scratch(spark, "lines")
    did, t = _keyed(docs)
    lines = find(spark, docs, scratch, least=least)
    by = lines.groupBy("did", "t").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("why") == "equal").alias("e"), F.count_if(F.col("why") == "near").alias("m"),
        F.array_sort(F.collect_list(F.when(F.col("why").isNotNull(), F.col("line")))).alias("gone"))
    by = scratch.keep(by)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    own = docs.select("doc_id", did.alias("did"), t.alias("t"))
    return own.join(by, ["did", "t"], "left").select(
        "doc_id", zero("n").alias("n_lines"), zero("e").alias("n_equal"), zero("m").alias("n_near"),
        F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))


def clean(spark: SparkSession, docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """``docs`` without the lines that go; without documents that had lines and keep none but blank ones. n_chars follows."""
    scratch = Scratch(spark, "lines")
    did, t = _keyed(docs)
    lines = find(spark, docs, scratch, least=least)
    by = lines.groupBy("did", "t").agg(F.count(F.lit(1)).alias("_n"), F.collect_list(F.when(F.col("why").isNotNull(), F.col("line"))).alias("_gone"))
    by = scratch.keep(by.where(F.size("_gone") > 0))
    # The columns of docs travel as one, so that none of their names can clash.
    d = docs.select(F.struct("*").alias("row"), did.alias("did"), t.alias("t")).join(by, ["did", "t"], "left")
    d = d.where(F.col("_n").isNull() | (F.size("_gone") < F.col("_n")))
    kept = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), i))
    d = d.withColumn("new", F.when(F.col("_gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")))
    own = {"text": F.col("new"), "n_chars": F.when(F.col("_gone").isNull(), F.col("row.n_chars")).otherwise(F.length("new").cast("long"))}
    return d.select(*[(own[c] if c in own else F.col("row")[c]).alias(c) for c in docs.columns])
