"""Format detection as one column expression: the first tier that decides wins.

Explicit type, MIME type, extension, leading bytes, and for strings a look at the content.  Only
bounded prefixes of the content are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, trim_start

# Formats by file extension.
BY_EXTENSION = {
    "pdf": ["pdf"],
    "image": ["png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff", "tif", "svg"],
    "csv": ["csv", "tsv"],
    "html": ["html", "htm"],
    "xlsx": ["xlsx", "xls"],
    "docx": ["docx", "doc"],
    "email": ["eml", "msg"],
    "text": ["txt"],
    "markdown": ["md", "markdown"],
}

# Formats by MIME type.
BY_MIME = {
    "pdf": ["application/pdf"],
    "image": ["image/png", "image/jpeg", "image/gif", "image/webp", "image/bmp", "image/tiff"],
    "csv": ["text/csv", "text/tab-separated-values"],
    "html": ["text/html"],
    "xlsx": ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel"],
    "docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword"],
    "email": ["message/rfc822"],
    "text": ["text/plain"],
    "markdown": ["text/markdown"],
}

# Leading bytes in hexadecimal.
BY_MAGIC = [("pdf", "25504446%"), ("image", "89504E47%"), ("image", "FFD8FF%"), ("image", "47494638%"), ("image", "52494646________57454250%"), ("image", "424D%"), ("image", "49492A00%"), ("image", "4D4D002A%")]

# Fixed value: header names that open a mail.
MAIL_HEADERS = "From|To|Subject|Date|MIME-Version|Content-Type"


def _looked_up(value: Column, table: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("string")
    for kind, names in table.items():
        out = F.when(value.isin(names), F.lit(kind)).otherwise(out)
    return out


def by_mime(mime: Column) -> Column:
    return _looked_up(F.trim(F.split_part(F.lower(mime), F.lit(";"), F.lit(1))), BY_MIME)


def by_extension(filename: Column) -> Column:
    return _looked_up(F.nullif(F.regexp_extract(F.lower(filename), r"\.([^.]*)$", 1), F.lit("")), BY_EXTENSION)


def by_magic(head: Column) -> Column:
    """From the first twelve bytes; fewer than four decide nothing."""
    digits, out = F.hex(head), F.lit(None).cast("string")
    for kind, pattern in reversed(BY_MAGIC):
        out = F.when(digits.like(pattern), F.lit(kind)).otherwise(out)
    return F.when(F.octet_length(head) >= 4, out)


def _separated(text: Column, sign: str) -> Column:
    lines = F.slice(F.split(text, "\n"), 1, 5)
    counts = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit(""))))
    return (F.size(lines) >= 2) & (F.get(counts, F.lit(0)) > 0) & F.forall(counts, lambda n: n == F.get(counts, F.lit(0)))


def by_content(text: Column) -> Column:
    """For strings: html, email, markdown, csv, else text; null for empty ones."""
    t = trim_start(text)
    starts = t.startswith("<!DOCTYPE") | t.startswith("<html") | t.startswith("<HTML")
    mail = F.substring(t, 1, 500).rlike(f"(?m)^(?:{MAIL_HEADERS}):[{SPACE}]")
    heading = F.substring(t, 1, 2000).rlike(f"(?m)^#{{1,6}}[{SPACE}]")
    table = _separated(t, ",") | _separated(t, "\t")
    return F.when(F.length(text) > 0, F.when(starts, "html").when(mail, "email").when(heading, "markdown").when(table, "csv").otherwise("text"))


def format_of(config_type: str | None = None) -> Column:
    """Format of a row of docs.  A configured type replaces the row's hint, 'auto' included."""
    hint = F.lit(config_type) if config_type is not None else F.col("type_hint")
    head = F.when(F.col("is_string"), F.encode(F.substring("text", 1, 16), "UTF-8")).otherwise(F.col("content"))
    return F.coalesce(
        F.when(hint != "auto", hint),
        by_mime(F.col("mime_type")),
        by_extension(F.col("filename")),
        by_magic(F.substring(head, 1, 12)),
        F.when(F.col("is_string"), by_content(F.col("text"))),
        F.lit("text"),
    )


def detect(docs: DataFrame, config_type: str | None = None) -> DataFrame:
    """``docs`` with a column ``format``; one narrow projection."""
    return docs.withColumn("format", format_of(config_type))
