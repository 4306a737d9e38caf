"""Files: which to read, their bytes and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevane.functions.annotate import file_hash, relative_path

TEXT = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "txt": "plain", "rtf": "plain", "docx": "docx"}
REFUSED = {"pdf": "PDF text is not extracted", "doc": "save .doc files as .docx"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([A-Za-z0-9]+)$", 1))


def classify(path: Column) -> Column:
    """'doc', 'unsupported' (skipped with a message) or 'skip'."""
    e = extension(path)
    return F.when(e.isin(*TEXT), F.lit("doc")).when(e.isin(*REFUSED), F.lit("unsupported")).otherwise(F.lit("skip"))


def file_format(path: Column) -> Column:
    e, out = extension(path), F.lit(None).cast("string")
    for k, v in TEXT.items():
        out = F.when(e == k, F.lit(v)).otherwise(out)
    return out


def message(path: Column) -> Column:
    e, out = extension(path), F.lit(None).cast("string")
    for k, v in REFUSED.items():
        out = F.when(e == k, F.lit(v)).otherwise(out)
    return out


def decode(content: Column) -> Column:
    """Text of bytes: UTF-8 if they are valid, else GB18030."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "GB18030"))


def _local(path: str) -> str:
    """A path without the scheme of the local file system."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def described(d: DataFrame, base: str, *, contents: bool = True) -> DataFrame:
    """Rows of binary files (path, content) as ``scan`` gives them, named by their paths below a folder."""
    kind = classify(F.col("path"))
    wanted = F.when(kind == "doc", F.col("content")) if contents else F.lit(None).cast("binary")
    return d.select(
        "path", relative_path(F.regexp_replace("path", "^file:/+", "/"), F.lit(base)).alias("rel_path"),
        F.regexp_extract("path", "([^/]*)$", 1).alias("file_name"), kind.alias("class"), file_format(F.col("path")).alias("format"),
        message(F.col("path")).alias("message"), wanted.alias("content"), file_hash(wanted).alias("content_hash"), F.lit(None).cast("string").alias("error"))


def from_rows(d: DataFrame, folder: str) -> DataFrame:
    """Binary files that came into a folder, say as a batch of a stream."""
    return described(d, _local(folder.rstrip("/")))


def scan(spark: SparkSession, roots: list[str], *, contents: bool = True) -> DataFrame:
    """Files of folders (at any depth) and single files: path, rel_path, file_name, class, format, content, content_hash.

    A root that doesn't exist is a row with an error and no content. Only files that can be read are opened."""
    fs_of = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    out = None
    schema = "path string, rel_path string, file_name string, class string, format string, message string, content binary, content_hash string, error string"
    for root in roots:
        p = path(root)
        fs = fs_of(p)
        if not fs.exists(p):
            part = spark.createDataFrame([(root, None, None, "missing", None, None, None, None, f"does not exist: {root}")], schema)
        else:
            d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            part = described(d, _local(fs.getFileStatus(p).getPath().toString()) if fs.getFileStatus(p).isDirectory() else "/-", contents=contents)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
