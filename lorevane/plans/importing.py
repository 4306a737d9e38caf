"""The write path: files to documents, chunks and vectors.

Every step is a plan over all files at once. A file that fails is a row with an error and leaves the others alone.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevane import constants as C
from lorevane.functions.annotate import search_text
from lorevane.functions.terms import pinyin_bag
from lorevane.operators import maintain, refine, vector
from lorevane.scratch import Scratch
from lorevane.sources import blocks as B
from lorevane.sources import docx, files

#: Encodes texts: a function over arrays of texts that gives one vector, or None, for each.
Encoder = Callable[[list[str]], list[list[float] | None]]


@dataclass
class Options:
    splitter: Callable[[], refine.Splitter] | None = None
    encoder: Encoder | None = None
    reprocess: bool = False
    table: tuple[str, str] = ("", "")
    readings: dict = field(default_factory=dict)


def encode(parts: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """Adds v: the vector of each text, null where encoding failed."""
    def run(batches):
        for pdf in batches:
            yield pdf.assign(v=encoder(pdf[text].tolist()))

    schema = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes) + ", v array<float>"
    return parts.mapInPandas(run, schema)


def read_blocks(d: DataFrame, table=("", "")) -> DataFrame:
    """Files (format, content, ...) with their blocks, or an error."""
    word = d.where("format = 'docx'").withColumn("_x", docx.unzip("content"))
    word = word.withColumn("blocks", docx.blocks_from_xml(F.col("_x.xml")))
    none = F.when(F.size(F.coalesce("blocks", B.nothing())) == 0, F.lit("no text in the .docx"))
    word = word.withColumn("error", F.coalesce("error", "_x.error", none)).drop("_x")
    text = files.decode(F.col("content"))
    rest = d.where("format <> 'docx'").withColumn("blocks", B.parse(F.col("format"), text, table))
    return rest.unionByName(word)


def with_index_text(chunks: DataFrame, options: Options) -> DataFrame:
    bag = pinyin_bag(options.readings)(F.col("title"), F.col("names")) if options.readings else F.lit("")
    return chunks.withColumn("search_text", search_text(F.col("title"), F.col("body"), F.col("names"), bag, options.table))


def import_files(spark: SparkSession, found: DataFrame, known: DataFrame, corrections: DataFrame, options: Options | None = None, next_id: int = 1) -> dict[str, DataFrame]:
    """Files (as ``sources.files.scan`` gives them) against known documents (doc_id, file_path, content_hash).

    Returns frames: documents (upserts), changed (doc ids whose chunks are replaced), chunks (without ids), vectors (doc_id,
    ordinal, seq, text, v), unmatched corrections and report."""
    o = options or Options()
    scratch = Scratch(spark, "import")
    docs = found.where("class = 'doc' and error is null")
    status = maintain.collapse(maintain.detect(docs, known, reprocess=o.reprocess))
    fresh = status.where("status = 'new'")
    numbered = maintain.number(fresh.drop("doc_id"), next_id, ["rel_path"], scratch, into="doc_id")
    status = status.where("status <> 'new'").unionByName(numbered.select(*status.columns))
    # Unless all is done anew, a moved file's content is known, so only its path changes.
    todo = status.where("status <> 'skip'") if o.reprocess else status.where("status in ('new', 'changed')")
    read = scratch.keep(read_blocks(todo, o.table))
    good = read.where("error is null")
    stem = F.regexp_extract("file_name", r"^(.+?)(?:\.[^.]*)?$", 1)
    b = good.select("doc_id", stem.alias("stem"), F.posexplode(B.coalesce_titles(F.col("blocks"))).alias("block", "x"))
    b = b.select("doc_id", "stem", "block", F.col("x.heading_level").alias("level"), F.col("x.title").alias("title"), F.col("x.text").alias("text"))
    drafts, notes = refine.drafts(b, o.table, o.splitter, scratch)
    own = corrections.join(good.select("doc_id"), "doc_id", "left_semi")
    drafts, unmatched = maintain.apply_corrections(scratch.keep(drafts), own)
    chunks = scratch.keep(with_index_text(drafts, o).withColumn("source_rank", F.lit(C.SOURCE_RANK)))
    out = {"documents": status.where("status <> 'skip'").join(read.where("error is not null").select("rel_path"), "rel_path", "left_anti").select(
        "doc_id", F.col("rel_path").alias("file_path"), "file_name", F.col("format").alias("file_type"), "content_hash", "status"),
        "changed": good.select("doc_id"), "chunks": chunks, "unmatched": unmatched, "notes": notes}
    if o.encoder is not None:
        parts = chunks.select("doc_id", "ordinal", F.posexplode(vector.windows(F.col("body"))).alias("seq", "text"))
        v = scratch.keep(encode(parts, o.encoder).withColumn("chunk_id", F.struct("doc_id", "ordinal")))
        out["vectors"] = vector.all_or_none(v).drop("chunk_id")
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    u = unmatched.groupBy("doc_id").agg(F.count(F.lit(1)).alias("unmatched"))
    errors = read.where("error is not null").select("rel_path", F.col("error").alias("_e"))
    per = found.join(status.select("rel_path", "status", "doc_id").dropDuplicates(["rel_path"]), "rel_path", "left").join(errors, "rel_path", "left")
    per = per.withColumn("error", F.coalesce("error", F.concat_ws(": ", "path", "_e"))).withColumn("error", F.when(F.col("error") != F.col("path"), F.col("error")))
    per = per.join(n, "doc_id", "left").join(u, "doc_id", "left").withColumn("status", F.when((F.col("class") == "doc") & F.col("status").isNull() & F.col("error").isNull(), F.lit("moved")).otherwise(F.col("status")))
    warned = notes.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("note")), "\n").alias("warning"))
    out["report"] = maintain.import_report(per.join(warned, "doc_id", "left"))
    return out


def backfill(chunks: DataFrame, vectors: DataFrame, encoder: Encoder) -> tuple[DataFrame, DataFrame]:
    """Vectors (chunk_id, seq, text, v) for the chunks that have none, and the number of those chunks (one row: missing)."""
    need = vector.missing(chunks, vectors)
    parts = need.select(F.col("id").alias("chunk_id"), F.posexplode(vector.windows(F.col("body"))).alias("seq", "text"))
    return vector.all_or_none(encode(parts, encoder)), need.agg(F.count(F.lit(1)).alias("missing"))


def hashed_encoder(dimension: int = 64) -> Encoder:
    """A stand-in without a model: hashed character trigrams, length 1. It has no semantic quality."""
    import zlib

    import numpy as np

    signed: dict[int, tuple[int, float]] = {}

    def of(code: int) -> tuple[int, float]:
        """Place and sign of a trigram, whose three code points are the number."""
        if code not in signed:
            if len(signed) > 300_000:
                signed.clear()
            h = zlib.crc32("".join(map(chr, (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF))).encode())
            signed[code] = h % dimension, 1.0 if h >> 16 & 1 else -1.0
        return signed[code]

    def some(texts: list[str]) -> list[list[float] | None]:
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(t) for t in texts])
        begin = np.cumsum(size) - size
        # Trigrams of all the texts side by side; those across two texts are left out.
        codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
        row = np.repeat(np.arange(len(texts)), np.maximum(size - 2, 0))
        at = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(size - 2, 0)) - np.maximum(size - 2, 0), np.maximum(size - 2, 0)) + begin[row]
        key, inverse = np.unique(codes[at], return_inverse=True)
        place, sign = map(np.array, zip(*map(of, key.tolist())))
        v = np.bincount(row * dimension + place[inverse], sign[inverse], len(texts) * dimension).reshape(len(texts), dimension)
        norm = np.sqrt((v * v).sum(axis=1))
        return [(x / n).tolist() if n else None for x, n in zip(v, norm)]

    def short(t: str) -> list[float] | None:
        h = zlib.crc32(t.encode())
        v = [0.0] * dimension
        v[h % dimension] = 1.0 if h >> 16 & 1 else -1.0
        return v if t else None

    def run(texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for start in range(0, len(texts), 250):
            part = [(t or "").strip() for t in texts[start : start + 250]]
            long = [t for t in part if len(t) > 2]
            done = iter(some(long) if long else ())
            out += [next(done) if len(t) > 2 else short(t) for t in part]
        return out

    return run


def find_model(*folders: str, model: str = "model.onnx", tokenizer: str = "tokenizer.json") -> tuple[str, str] | None:
    """Paths of a model and its tokenizer in the first of these folders that has both; None if none has. Every machine that encodes
    needs them at that place."""
    for folder in folders:
        paths = os.path.join(folder, model), os.path.join(folder, tokenizer)
        if all(map(os.path.isfile, paths)):
            return paths
    return None


def onnx_encoder(model: str, tokenizer: str, *, query: bool = False, dimension: int = C.DIMENSION) -> Encoder:
    """Encodes with an ONNX model: first row of the last hidden state, length 1. Files are opened once per worker process.

    Texts are trimmed, queries get their prefix, empty texts fail, and 512 tokens are kept from the left."""
    state: dict = {}

    def load():
        import onnxruntime
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.enable_truncation(512, direction="right")
        state["t"], state["m"] = t, onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])

    def run(texts: list[str]) -> list[list[float] | None]:
        import numpy as np

        if not state:
            load()
        out: list[list[float] | None] = []
        for text in texts:
            t = (text or "").strip()
            if not t:
                out.append(None)
                continue
            e = state["t"].encode(C.QUERY_PREFIX + t if query else t)
            feed = {"input_ids": e.ids, "attention_mask": e.attention_mask, "token_type_ids": e.type_ids}
            names = {i.name for i in state["m"].get_inputs()}
            v = state["m"].run(None, {k: np.array([x], np.int64) for k, x in feed.items() if k in names})[0][0, 0]
            norm = float(np.sqrt((v * v).sum()))
            out.append((v / norm if norm > 1e-12 else v).tolist() if len(v) == dimension else None)
        return out

    return run

