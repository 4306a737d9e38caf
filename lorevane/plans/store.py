"""A store: one folder of versioned Parquet tables and numbered manifests that say which files make up a version.

A write adds files and then one manifest, so readers see all of a write or nothing of it, and a writer that dies leaves the version
before it in place. A manifest's number can be taken once: of two writers that began with the same version the second one fails and
loses nothing but its own write. Folders may lie on any file system that Spark reads.

Chunks, their vectors and their postings are dealt to parts by document. A write replaces the parts that it changes, or adds files to
them, and leaves the other parts' files as they are.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevane import constants as C
from lorevane.functions.annotate import is_hidden, public_body
from lorevane.functions.text import copy_payload, template_of
from lorevane.operators import fulltext, maintain, vector
from lorevane.scratch import Scratch
from lorevane.sources import files

from . import importing, searching

TABLES = {
    "documents": "doc_id bigint, file_path string, file_name string, file_type string, content_hash string",
    "chunks": "id bigint, doc_id bigint, ordinal bigint, stable_key string, alt_anchor string, content_hash string, entity_type string, title string, body string, "
    "parent_path string, visibility bigint, names array<string>, search_text string, source_rank int",
    "corrections": "correction_id bigint, doc_id bigint, stable_key string, alt_anchor string, entity_type string, visibility bigint, names array<string>",
    "vectors": "chunk_id bigint, seq int, text string, v array<float>",
    "postings": "gram bigint, id bigint, tf bigint",
    "synonyms": "term string, canonical string",
    "embedding_meta": "model_id string, model_version string, pooling string, query_prefix string",
    "query_log": "log_id bigint, query string, used_semantic boolean, created_at string",
    "templates": "key string, body string",
    "options": "key string, body string",
}
#: Tables dealt to parts by their document, and the column that names their chunk.
PARTED = {"chunks": "id", "vectors": "chunk_id", "postings": "id"}
#: Parts of a new store, unless it is told: about as many as writes that change little should leave alone.
PARTS = 64


class ConflictError(RuntimeError):
    """Another writer was first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, manifest: dict, version: int = 0):
        self.spark, self.root, self.manifest, self.version = spark, root.rstrip("/"), manifest, version

    # Manifests, through the file system that the root names.

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    @classmethod
    def _names(cls, spark: SparkSession, path: str) -> list[str]:
        fs, p = cls._fs(spark, path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    @classmethod
    def _read(cls, spark: SparkSession, path: str) -> str:
        fs, p = cls._fs(spark, path)
        stream = fs.open(p)
        try:
            return bytes(x % 256 for x in stream.readAllBytes()).decode()
        finally:
            stream.close()

    @classmethod
    def _latest(cls, spark: SparkSession, root: str) -> tuple[int, dict] | None:
        """The highest manifest that was written to its end, and the highest number taken."""
        names = sorted((n for n in cls._names(spark, f"{root}/manifests") if n.endswith(".json")), reverse=True)
        for name in names:
            try:
                return int(names[0].removesuffix(".json")), json.loads(cls._read(spark, f"{root}/manifests/{name}"))
            except json.JSONDecodeError:
                continue
        return None

    def _commit(self, manifest: dict) -> None:
        fs, p = self._fs(self.spark, f"{self.root}/manifests/{self.version + 1:012}.json")
        try:
            out = fs.create(p, False)  # fails if it is there
        except Py4JJavaError as e:
            raise ConflictError(f"version {self.version + 1} of {self.root} is another writer's") from e
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        self.manifest, self.version = manifest, self.version + 1

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str = "campaign", parts: int = PARTS) -> Store:
        """A new store with the default templates; refuses a folder that has one."""
        if cls._latest(spark, root.rstrip("/")) is not None:
            raise FileExistsError(root)
        store = cls(spark, root, {"schema_version": C.SCHEMA_VERSION, "name": name, "parts": parts, "tables": {}, "last": {"doc": 0, "chunk": 0}})
        store.write(templates=spark.createDataFrame(list(C.TEMPLATES.items()), TABLES["templates"]))
        return store

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Store:
        """An existing store; a newer schema is refused, an older one brought up to date."""
        found = cls._latest(spark, root.rstrip("/"))
        if found is None:
            raise FileNotFoundError(f"no store in {root}")
        version, m = found
        if "schema_version" not in m or "tables" not in m:
            raise ValueError(f"{root} is no store")
        if m["schema_version"] > C.SCHEMA_VERSION:
            raise ValueError(f"schema {m['schema_version']} is newer than {C.SCHEMA_VERSION}")
        store = cls(spark, root, m, version)
        if m["schema_version"] < C.SCHEMA_VERSION:
            store.migrate()
        return store

    def migrate(self) -> None:
        """Fills what an older schema didn't have: defaults of chunks' columns, postings, templates and counters."""
        chunks = self.table("chunks")
        none = F.array().cast("array<string>")
        chunks = chunks.withColumn("names", F.coalesce("names", none)).withColumn("visibility", F.coalesce("visibility", F.lit(C.PUBLIC).cast("long")))
        chunks = chunks.withColumn("source_rank", F.coalesce("source_rank", F.lit(C.SOURCE_RANK)))
        fresh = importing.with_index_text(chunks, self.options()).select("id", F.col("search_text").alias("_s"))
        chunks = chunks.join(fresh, "id").withColumn("search_text", F.coalesce("search_text", "_s")).drop("_s")
        chunks = Scratch(self.spark, "store").keep(chunks.select(*_names("chunks")))
        last = self.table("documents").agg(F.max("doc_id")).first()[0], chunks.agg(F.max("id")).first()[0]
        self.manifest = self.manifest | {"last": {"doc": last[0] or 0, "chunk": last[1] or 0}}
        templates = self.table("templates")
        rest = self.spark.createDataFrame(list(C.TEMPLATES.items()), TABLES["templates"]).join(templates, "key", "left_anti")
        old = self.table("vectors").join(chunks.select(F.col("id").alias("chunk_id"), self._part().alias("part")), "chunk_id")
        self.write(
            templates=templates.unionByName(rest), chunks=chunks.withColumn("part", self._part()), postings=self._postings(chunks), vectors=old)

    def table(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """A table; of one that is dealt to parts, all of them or some."""
        found = self.manifest["tables"].get(name)
        if isinstance(found, dict):
            found = [p for k, ps in found.items() if parts is None or int(k) in parts for p in ps]
        paths = [f"{self.root}/{p}" for p in ([found] if isinstance(found, str) else found or [])]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*paths)

    def write(self, *, replaced: list[int] | None = None, added: tuple[str, ...] = (), **tables: DataFrame) -> None:
        """New versions of tables, visible together. Tables that are dealt to parts come with a column part: rows of the parts
        ``replaced`` (all, if not given), or rows to add for those named in ``added``."""
        now = dict(self.manifest["tables"])
        for name, df in tables.items():
            path = f"{name}/{uuid.uuid4().hex}"
            if name not in PARTED:
                df.select(*_names(name)).write.parquet(f"{self.root}/{path}")
                now[name] = path
                continue
            rows = df.select(*_names(name), "part").hint("rebalance", "part")
            rows = rows.sortWithinPartitions("part", "gram") if name == "postings" else rows
            rows.write.partitionBy("part").parquet(f"{self.root}/{path}")
            new = {n.removeprefix("part="): [f"{path}/{n}"] for n in self._names(self.spark, f"{self.root}/{path}") if n.startswith("part=")}
            old = now.get(name) or {}
            old = {} if isinstance(old, str) else old
            if name in added:
                now[name] = old | {k: old.get(k, []) + ps for k, ps in new.items()}
            else:
                now[name] = {k: ps for k, ps in old.items() if replaced is not None and int(k) not in replaced} | new
        self._commit(self.manifest | {"schema_version": C.SCHEMA_VERSION, "tables": now})

    def _part(self) -> Column:
        return F.pmod(F.col("doc_id"), F.lit(self.manifest.get("parts", PARTS))).cast("int")

    def _postings(self, chunks: DataFrame) -> DataFrame:
        """Postings of chunks, with their part."""
        return fulltext.index(chunks).join(chunks.select("id", self._part().alias("part")), "id")

    def _put_options(self, o: importing.Options) -> dict[str, DataFrame]:
        """What index texts depend on, to write if it isn't what is stored."""
        now = self.options()
        if (now.table, now.readings) == (o.table, o.readings):
            return {}
        rows = [("table", json.dumps(o.table)), ("readings", json.dumps(o.readings))]
        return {"options": self.spark.createDataFrame(rows, TABLES["options"])}

    def options(self) -> importing.Options:
        """The simplification table and readings that the chunks' index texts were made with."""
        held = {r["key"]: json.loads(r["body"]) for r in self.table("options").collect()}  # two rows
        return importing.Options(table=tuple(held.get("table", ("", ""))), readings={k: tuple(v) for k, v in held.get("readings", {}).items()})

    # The write path.

    def import_paths(self, paths: list[str], options: importing.Options | None = None) -> dict:
        return self.import_with(paths, options or importing.Options())

    def import_with(self, paths: list[str], options: importing.Options) -> dict:
        """Reads files and replaces the chunks of those that changed; returns the report's counters and messages."""
        return self.import_files(files.scan(self.spark, paths), options)

    def import_files(self, found: DataFrame, options: importing.Options) -> dict:
        """``import_with`` for files as ``sources.files.scan`` gives them."""
        scratch = Scratch(self.spark, "store")
        last = self.manifest["last"]
        documents, corrections = self.table("documents"), self.table("corrections")
        found = scratch.keep(found)
        got = importing.import_files(self.spark, found, documents, corrections, options, last["doc"] + 1)
        fresh = scratch.keep(got["documents"].drop("status"))
        changed = scratch.keep(got["changed"])
        new = maintain.number(got["chunks"], last["chunk"] + 1, ["doc_id", "ordinal"], scratch)
        new = scratch.keep(new.select(*_names("chunks")))
        ends = fresh.agg(F.max("doc_id")).first()[0], new.agg(F.max("id")).first()[0]
        parts = [r[0] for r in changed.select(self._part().alias("part")).distinct().collect()]  # as many as parts, at most
        old = {k: self.table(k, parts) for k in PARTED}
        stays = old["chunks"].join(changed, "doc_id", "left_anti").select(F.col("id").alias("chunk_id"), self._part().alias("part"))
        stays = scratch.keep(stays)
        vectors = old["vectors"].join(stays, "chunk_id")
        if "vectors" in got:
            v = got["vectors"].join(new.select("doc_id", "ordinal", F.col("id").alias("chunk_id"), self._part().alias("part")), ["doc_id", "ordinal"])
            vectors = vectors.unionByName(v.select(*vectors.columns))
        postings = old["postings"].join(stays.withColumnRenamed("chunk_id", "id"), "id").unionByName(self._postings(new))
        report = got["report"].first().asDict()
        self.manifest = self.manifest | {"last": {"doc": max(last["doc"], ends[0] or 0), "chunk": max(last["chunk"], ends[1] or 0)}}
        self.write(
            replaced=parts, documents=maintain.upsert(documents, fresh, ["doc_id"]),
            chunks=maintain.replace_children(old["chunks"], new, changed).withColumn("part", self._part()), vectors=vectors, postings=postings,
            **self._put_options(options))
        return report

    def update_chunks(self, patches: DataFrame) -> None:
        """Patches (id, entity_type, visibility, names; null keeps) to live chunks, stored as corrections too. Index texts and
        postings of the patched chunks follow, with the options that the store was filled with; other chunks stay as they are."""
        scratch = Scratch(self.spark, "store")
        ids = patches.select("id").distinct()
        parts = [r[0] for r in self.table("chunks").join(ids, "id", "left_semi").select(self._part().alias("part")).distinct().collect()]  # as many as parts, at most
        old, corrections = {k: self.table(k, parts) for k in PARTED}, self.table("corrections")
        own = scratch.keep(old["chunks"].join(ids, "id", "left_semi").select(*_names("chunks")))
        live, stored = maintain.patch(own, patches)
        live = scratch.keep(importing.with_index_text(live, self.options()).select(*_names("chunks")))
        last = corrections.agg(F.max("correction_id")).first()[0] or 0
        stored = maintain.number(stored, last + 1, ["doc_id", "stable_key"], scratch, into="correction_id")
        rest = old["chunks"].join(ids, "id", "left_anti")
        postings = old["postings"].join(rest.select("id", self._part().alias("part")), "id").unionByName(self._postings(live))
        self.write(
            replaced=parts, chunks=rest.select(*live.columns).unionByName(live).withColumn("part", self._part()), postings=postings,
            corrections=maintain.upsert(corrections, stored.select(*corrections.columns), ["doc_id", "stable_key"]))

    def put_synonyms(self, rows: DataFrame) -> None:
        self.write(synonyms=maintain.upsert(self.table("synonyms"), rows, ["term"]))

    def synonyms(self) -> DataFrame:
        return self.table("synonyms").orderBy("term")

    def put_template(self, key: str, body: str) -> None:
        row = self.spark.createDataFrame([(key, body)], TABLES["templates"])
        self.write(templates=maintain.upsert(self.table("templates"), row, ["key"]))

    def use_model(self, model_id: str, model_version: str) -> bool:
        """Sets the model of the vectors; drops all vectors, and returns True, if they came from another one."""
        now = {"model_id": model_id, "model_version": model_version, "pooling": C.POOLING, "query_prefix": C.QUERY_PREFIX}
        if vector.same_model(self.table("embedding_meta"), now):
            return False
        meta = self.spark.createDataFrame([tuple(now.values())], TABLES["embedding_meta"])
        none = self.spark.createDataFrame([], TABLES["vectors"] + ", part int")
        self.write(embedding_meta=meta, vectors=none)
        return True

    def backfill_embeddings(self, encoder: importing.Encoder, ids: DataFrame | None = None) -> int:
        """Vectors for chunks, or those of (id), that have none; returns how many those were. Files are added, none is written anew."""
        chunks = self.table("chunks")
        chunks = chunks if ids is None else chunks.join(ids, "id", "left_semi")
        new, missing = importing.backfill(chunks, self.table("vectors"), encoder)
        n = missing.first()[0]
        if n:
            self.write(added=("vectors",), vectors=new.join(chunks.select(F.col("id").alias("chunk_id"), self._part().alias("part")), "chunk_id"))
        return n

    # The read path.

    def search(self, queries: DataFrame, **lanes) -> DataFrame:
        """Ranked hits, by way of the stored index; ``lanes`` as for ``searching.search``."""
        return searching.search(queries, self.table("chunks"), postings=self.table("postings"), synonyms=self.table("synonyms"), **lanes)

    def log_queries(self, rows: DataFrame, keep: int = C.RETENTION) -> None:
        """Appends (query, used_semantic, created_at) and keeps the latest entries."""
        old = self.table("query_log")
        last = old.agg(F.max("log_id")).first()[0] or 0
        new = maintain.number(rows, last + 1, ["created_at", "query"], Scratch(self.spark, "store"), into="log_id")
        both = old.unionByName(new.select(*old.columns)).withColumn("_all", F.lit(1))
        self.write(query_log=maintain.retain(both, "_all", keep, F.desc("log_id")))

    def chunk(self, ids: DataFrame) -> DataFrame:
        """Chunks of (id) with their file names and neighbours."""
        c = maintain.neighbours(self.table("chunks"), "doc_id", "ordinal", "id")
        return c.join(ids, "id").join(self.table("documents").select("doc_id", "file_name"), "doc_id")

    def copy_payload(self, ids: DataFrame, key: str) -> DataFrame:
        """(id, payload): chunks through a template; players never see hidden lines."""
        c = self.table("chunks").join(ids, "id").join(self.table("documents").select("doc_id", "file_name"), "doc_id")
        t = self.table("templates").where(F.col("key") == key).select(F.col("body").alias("_t"))
        c = c.join(t, F.lit(True), "left")
        row = {k: F.col(k) for k in ("entity_type", "title", "body")} | {
            "public_body": public_body(F.col("body"), F.col("visibility")), "source_path": F.concat_ws(" · ", "file_name", "parent_path")}
        return c.select("id", copy_payload(template_of(F.lit(key), F.col("_t")), row).alias("payload"), is_hidden(F.col("visibility")).alias("hidden"))

    def info(self) -> DataFrame:
        return maintain.info(self.table("chunks"), self.table("embedding_meta"), self.table("vectors"))

    def source_paths(self) -> DataFrame:
        return self.table("documents").select("file_path").orderBy("file_path")

    def export_snapshot(self, target: str) -> Store:
        """A copy of all tables in another folder, whatever was there."""
        fs, p = self._fs(self.spark, target)
        if fs.exists(p):
            fs.delete(p, True)
        copy = Store(self.spark, target, self.manifest | {"tables": {}})
        part = self.table("chunks").select(F.col("id").alias("_id"), self._part().alias("part"))
        tables = {k: self.table(k) for k in self.manifest["tables"]}
        copy.write(**{k: d.join(part, F.col(PARTED[k]) == F.col("_id")).drop("_id") if k in PARTED else d for k, d in tables.items()})
        return copy

    def close(self) -> None:
        """Ends the use of this object: leftovers that no version points to go. Nothing else is held open."""
        self.vacuum()

    def vacuum(self) -> int:
        """Deletes files that the current version doesn't point to, and older manifests; returns how many tables' versions went."""
        used = {p for found in self.manifest["tables"].values() for ps in ([[found]] if isinstance(found, str) else found.values()) for p in ps}
        n = 0
        for name in TABLES:
            for run in self._names(self.spark, f"{self.root}/{name}"):
                path = f"{name}/{run}"
                if not any(u == path or u.startswith(path + "/") for u in used):
                    self._delete(path)
                    n += 1
                elif path not in used:
                    for part in self._names(self.spark, f"{self.root}/{path}"):
                        if part.startswith("part=") and f"{path}/{part}" not in used:
                            self._delete(f"{path}/{part}")
        for name in self._names(self.spark, f"{self.root}/manifests"):
            if name.endswith(".json") and int(name.removesuffix(".json")) < self.version:
                self._delete(f"manifests/{name}")
        return n

    def _delete(self, path: str) -> None:
        fs, p = self._fs(self.spark, f"{self.root}/{path}")
        fs.delete(p, True)


def _names(table: str) -> list[str]:
    return [x.split()[0] for x in _fields(table)]


def _fields(name: str) -> list[str]:
    """'column type' of each column; no type has a comma at its top level but within <>."""
    return [x.strip() for x in TABLES[name].split(", ")]
