"""Normalisation: documents to blocks of text.

Text and markdown are projections.  All other formats need a parser: they go through one Arrow
function, which gets nothing of the documents that don't need it.  Either way documents are read once.
Scanned PDFs and images go to the OCR backend in that pass.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NormalizeConfig
from ..errors import NormalizeError
from ..schemas import ERROR, SOURCE
from .detect import detect

#: Embedded text of a PDF counts if it is longer than this.
LEAST_PDF_TEXT = 50
PLAIN = ("text", "markdown")


def _as_text(content: bytes | None, text: str | None) -> str:
    return text if text is not None else (content or b"").decode("utf-8", "replace")


def parse_one(format: str, content: bytes | None, text: str | None, filename: str | None, mime: str | None, config: NormalizeConfig) -> list[tuple[str, str | None, bool]]:
    """Blocks of one document as (text, sheet, is_visual)."""
    from ..functions import parsers

    data = content if content is not None else (text or "").encode()
    if format in PLAIN:
        return [(_as_text(content, text), None, False)]
    if format == "csv":
        return [(parsers.csv_table(_as_text(content, text), config.escape_pipes), None, False)]
    if format == "html":
        return [(parsers.html_text(_as_text(content, text), config.preserve_tables), None, False)]
    if format == "email":
        return [(parsers.email_text(data, config.include_headers), None, False)]
    if format == "xlsx":
        return [(t, name, False) for name, t in parsers.xlsx_sheets(data, config.sheets, config.escape_pipes)]
    if format == "docx":
        return [(parsers.docx_markdown(data), None, False)]
    if format == "pdf":
        found, why = "", None
        try:
            found = (config.pdf_text or parsers.pdf_text)(data).strip()
        except Exception as e:
            why = e
        if len(found) > LEAST_PDF_TEXT:
            return [(found, None, False)]
        if config.ocr is None:
            raise NormalizeError(f"no text in the PDF ({why}) and no OCR backend", "pdf")
        return [(config.ocr.parse(data, filename=filename, mime_type="application/pdf"), None, True)]
    if format == "image":
        if config.ocr is None:
            raise NormalizeError("images need an OCR backend", "image")
        return [(config.ocr.parse(data, filename=filename, mime_type=mime), None, True)]
    raise NormalizeError(f"unsupported format {format}", str(format))


_BLOCKS = f"array<struct<block_index:int,text:string,is_visual:boolean,source:{SOURCE},error:{ERROR}>>"


def _arrow_blocks() -> pa.DataType:
    def texts(*names):
        return pa.struct([(n, pa.string()) for n in names])

    source = pa.struct([("format", pa.string()), ("page", pa.int32()), ("sheet", pa.string()), ("filename", pa.string())])
    return pa.list_(pa.struct([("block_index", pa.int32()), ("text", pa.string()), ("is_visual", pa.bool_()), ("source", source), ("error", texts("class", "message", "phase", "format"))]))


def _parser(config: NormalizeConfig):
    """(doc_id, format, content, text, filename, mime type) -> blocks; nothing where the format is plain.

    Spark cuts its batches by bytes (spark.sql.execution.arrow.maxBytesPerBatch), so that large
    documents come few at a time."""

    @F.arrow_udf(_BLOCKS)
    def run(doc_id: pa.Array, format: pa.Array, content: pa.Array, text: pa.Array, filename: pa.Array, mime: pa.Array) -> pa.Array:
        out = []
        for d, f, c, t, n, m in zip(doc_id, format, content, text, filename, mime):
            f = f.as_py()
            if f in PLAIN:
                out.append(None)
                continue
            n = n.as_py()
            source = {"format": f, "page": None, "sheet": None, "filename": n}
            try:
                found = parse_one(f, c.as_py(), t.as_py(), n, m.as_py(), config)
                out.append([{"block_index": k, "text": x, "is_visual": visual, "source": source | {"sheet": sheet}, "error": None} for k, (x, sheet, visual) in enumerate(found)])
            except Exception as e:
                if config.on_error == "throw":
                    raise e if isinstance(e, NormalizeError) else NormalizeError(f"document {d.as_py()}: {e}", f) from e
                error = {"class": type(e).__name__, "message": str(e), "phase": "normalize", "format": f}
                out.append([{"block_index": 0, "text": None, "is_visual": False, "source": source, "error": error}])
        return pa.array(out, _arrow_blocks())

    return run


def normalize(docs: DataFrame, config: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    """Blocks of all documents; with ``on_error='skip'`` also rows that hold an error instead of text.

    Documents are read once: the parser sees the contents of those that need it, and null of others."""
    found = detect(docs, config.type)
    plain = F.struct(
        F.lit(0).alias("block_index"),
        F.when(F.col("is_string"), F.coalesce("text", F.lit(""))).otherwise(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"),
        F.lit(False).alias("is_visual"),
        F.struct(F.col("format"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("sheet"), F.col("filename")).alias("source"),
        F.lit(None).cast(ERROR).alias("error"),
    )
    if config.type in PLAIN:
        return found.select("doc_id", plain.alias("b")).select("doc_id", "b.*")
    is_plain = F.col("format").isin(*PLAIN)
    needed = [F.when(~is_plain, F.col(c)).alias(f"_{c}") for c in ("content", "text")]
    parsed = _parser(config)("doc_id", "format", *needed, "filename", "mime_type")
    blocks = F.when(is_plain, F.array(plain)).otherwise(parsed).cast(_BLOCKS)
    return found.select("doc_id", F.explode(blocks).alias("b")).select("doc_id", "b.*")


def csv_table_of(df: DataFrame, columns: list[str], order: list[str], by: list[str] | None = None) -> DataFrame:
    """Whole tables as markdown, natively: (by..., text), the column names as the head.

    For rows that are in a DataFrame already, so that no CSV text has to be parsed."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    rows = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    return df.groupBy(*(by or [])).agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("text"))
