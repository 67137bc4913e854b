"""Tables of documents, from files or from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _null(kind: str):
    return F.lit(None).cast(kind)


def from_text(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", filename: str | None = None, mime_type: str | None = None, type_hint: str | None = None) -> DataFrame:
    """Docs from a string column; names of further columns may be given."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        _null("binary").alias("content"),
        df[text_col].alias("text"),
        F.lit(True).alias("is_string"),
        (df[type_hint] if type_hint else _null("string")).alias("type_hint"),
        (df[filename] if filename else _null("string")).alias("filename"),
        (df[mime_type] if mime_type else _null("string")).alias("mime_type"),
    )


def from_bytes(df: DataFrame, *, id_col: str = "doc_id", content_col: str = "content", filename: str | None = None, mime_type: str | None = None, type_hint: str | None = None) -> DataFrame:
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        df[content_col].alias("content"),
        _null("string").alias("text"),
        F.lit(False).alias("is_string"),
        (df[type_hint] if type_hint else _null("string")).alias("type_hint"),
        (df[filename] if filename else _null("string")).alias("filename"),
        (df[mime_type] if mime_type else _null("string")).alias("mime_type"),
    )


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Docs from files: the id is a hash of the path, the name its last part."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return from_bytes(files.select(F.xxhash64("path").alias("doc_id"), "content", F.element_at(F.split("path", "/"), -1).alias("filename")), filename="filename")


def read_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The same as a stream of files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).load(path)
    return from_bytes(files.select(F.xxhash64("path").alias("doc_id"), "content", F.element_at(F.split("path", "/"), -1).alias("filename")), filename="filename")
