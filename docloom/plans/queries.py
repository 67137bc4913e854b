"""Registered queries of the document engine: (spark, sf_dir) -> flat DataFrame, over whole tables."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..backends import FakeOcr
from ..config import ChunkConfig, ExtractConfig, MergeConfig, NormalizeConfig
from ..operators.chunk import auto_strategy, chunk
from ..operators.detect import detect
from ..operators.extract import NativeModel, extract, extract_vision
from ..operators.merge import merge
from ..operators.normalize import csv_table_of, normalize
from ..operators.prompt import with_prompts
from ..schemas import SOURCE
from ..sources.docs import from_bytes, from_text
from .pipeline import Extracted, Normalized


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source(format: str = "text", page: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(format).alias("format"), (null if page is None else page).cast("int").alias("page"), null.cast("string").alias("sheet"), null.cast("string").alias("filename")).cast(SOURCE)


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("block_index"), "text", F.lit(False).alias("is_visual"), _source().alias("source"))


def turn_blocks(spark: SparkSession, sf_dir: str, pages: bool = False) -> DataFrame:
    """A conversation is a document, a turn a block (a page, if asked for)."""
    t = _table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("block_index"), "text", F.lit(False).alias("is_visual"), _source(page=F.col("turn") if pages else None).alias("source"))


def heading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as markdown: one block, a section a turn."""
    t = _table(spark, sf_dir, "conversations")
    section = F.concat(F.lit("# "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), "text")
    rows = F.array_sort(F.collect_list(F.struct("turn", section.alias("s"))))
    return t.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(rows, lambda r: r["s"]), "\n").alias("text")).select(
        "doc_id", F.lit(0).alias("block_index"), "text", F.lit(False).alias("is_visual"), _source("markdown").alias("source")
    )


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markdown table of its orders for each customer."""
    o = _table(spark, sf_dir, "orders")
    t = csv_table_of(o, ["o_orderkey", "o_orderstatus", "o_orderpriority"], ["o_orderkey"], ["o_custkey"])
    return t.select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("block_index"), "text", F.lit(False).alias("is_visual"), _source("csv").alias("source"))


def flat(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_id", F.col("index").cast("long").alias("chunk_index"), F.col("total").cast("long").alias("total"), "text", F.coalesce("context", F.lit("")).alias("context"), F.col("char_offset").cast("long").alias("char_offset")
    )


# ------------------------------------------------------------------------------------- detection


def detect_documents(spark, sf_dir):
    d = from_text(_table(spark, sf_dir, "documents"))
    p = _table(spark, sf_dir, "pages")
    pages = from_text(p.select((F.col("page_id") + 1_000_000_000).alias("doc_id"), F.col("html").alias("text")))
    return detect(d.unionByName(pages)).groupBy("format").agg(F.count("*").alias("n_docs"), F.sum("doc_id").alias("sum_ids"))


def detect_names(spark, sf_dir):
    """Extension, MIME type and hint tiers over names made of the parts table."""
    p = _table(spark, sf_dir, "part")
    ends = F.array(*map(F.lit, ["pdf", "PNG", "tsv", "htm", "xls", "docx", "msg", "md", "zip", ""]))
    mimes = F.array(*map(F.lit, ["text/html; charset=utf-8", "APPLICATION/PDF", "image/webp", "message/rfc822", "text/unknown"]))
    k = F.col("p_partkey")
    rows = p.select(
        k.alias("doc_id"),
        F.col("p_name").alias("text"),
        F.concat("p_name", F.lit("."), F.get(ends, (k % 10).cast("int"))).alias("filename"),
        F.when(k % 3 == 0, F.get(mimes, (k % 5).cast("int"))).alias("mime_type"),
        F.when(k % 7 == 0, "markdown").when(k % 11 == 0, "auto").alias("type_hint"),
    )
    return detect(from_text(rows, filename="filename", mime_type="mime_type", type_hint="type_hint")).select("doc_id", "format")


# -------------------------------------------------------------------------------------- chunking


def chunk_sliding(spark, sf_dir):
    return flat(chunk(document_blocks(spark, sf_dir), ChunkConfig("sliding", max_chars=1000, overlap=200)))


def chunk_none(spark, sf_dir):
    return flat(chunk(turn_blocks(spark, sf_dir), ChunkConfig("none")))


def chunk_page(spark, sf_dir):
    return flat(chunk(turn_blocks(spark, sf_dir, pages=True), ChunkConfig("page")))


def chunk_row(spark, sf_dir):
    return flat(chunk(document_blocks(spark, sf_dir), ChunkConfig("row", max_chars=1000, context_window=100)))


def chunk_row_tables(spark, sf_dir):
    return flat(chunk(order_tables(spark, sf_dir), ChunkConfig("row", max_chars=200, context_window=50)))


def chunk_structural(spark, sf_dir):
    return flat(chunk(heading_blocks(spark, sf_dir), ChunkConfig("structural", max_chars=1_000_000_000, context_window=60)))


def chunk_structural_packed(spark, sf_dir):
    return flat(chunk(heading_blocks(spark, sf_dir), ChunkConfig("structural", max_chars=4000, context_window=60)))


def chunk_structural_long(spark, sf_dir):
    return flat(chunk(heading_blocks(spark, sf_dir), ChunkConfig("structural", max_chars=400, context_window=60)))


def chunk_sentence(spark, sf_dir):
    return flat(chunk(document_blocks(spark, sf_dir), ChunkConfig("sentence", max_chars=2000, context_window=300)))


def sentence_slices(spark, sf_dir):
    """Every sentence chunk is a slice of its document; coverage and lengths per document."""
    c = chunk(document_blocks(spark, sf_dir), ChunkConfig("sentence", max_chars=2000, context_window=300))
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.col("text").alias("whole"))
    j = c.join(d, F.col("doc_id") == F.col("d"))
    exact = F.substring(F.col("whole"), F.col("char_offset") + 1, F.length("text")) == F.col("text")
    letters = F.length(F.regexp_replace("text", r"\s", ""))
    return j.groupBy("doc_id").agg(F.min(exact).alias("exact"), F.sum(letters).alias("n_signs"), F.max(F.length("text") <= 2000).alias("bounded"))


def chunk_auto(spark, sf_dir):
    return flat(chunk(document_blocks(spark, sf_dir), ChunkConfig("auto", max_chars=2000, context_window=300)))


def auto_choice(spark, sf_dir):
    b = document_blocks(spark, sf_dir).select("doc_id", "block_index", "text", "source")
    t = order_tables(spark, sf_dir).select((-1 - F.col("doc_id")).alias("doc_id"), "block_index", F.concat("text", F.lit("\n"), F.repeat(F.lit("x"), F.lit(9000))).alias("text"), "source")
    return auto_strategy(b.unionByName(t)).select("doc_id", "strategy")


def chunk_context(spark, sf_dir):
    c = chunk(turn_blocks(spark, sf_dir), ChunkConfig("row", max_chars=1_000_000_000, context_window=40))
    return c.select("doc_id", F.col("index").cast("long").alias("chunk_index"), F.coalesce("context", F.lit("")).alias("context"))


def _halves(frame: pd.DataFrame) -> pd.DataFrame:
    """A user's own chunker: each block in two halves."""
    rows = []
    for b in frame.itertuples():
        h = len(b.text) // 2
        for part, off in ((b.text[:h], 0), (b.text[h:], h)):
            rows.append((b.doc_id, len(rows), 0, part, None, off, b.block_index, b.source))
    return pd.DataFrame(rows, columns=["doc_id", "index", "total", "text", "context", "char_offset", "block_index", "source"])


def chunk_custom(spark, sf_dir):
    return flat(chunk(turn_blocks(spark, sf_dir), ChunkConfig(_halves)))


# --------------------------------------------------------------------------------- normalisation


def normalize_text(spark, sf_dir):
    b = normalize(from_text(_table(spark, sf_dir, "documents")), NormalizeConfig(type="text"))
    return b.select("doc_id", "text", F.col("source.format").alias("format"), "is_visual")


def csv_native(spark, sf_dir):
    n = csv_table_of(_table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"])
    r = csv_table_of(_table(spark, sf_dir, "region"), ["r_regionkey", "r_name"], ["r_regionkey"])
    return n.select(F.lit("nation").alias("name"), "text").union(r.select(F.lit("region").alias("name"), "text"))


def _quoted(c: str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_parsed(spark, sf_dir):
    """CSV texts of the customers of each nation, parsed to markdown tables."""
    c = _table(spark, sf_dir, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), _quoted("c_name"), _quoted("c_mktsegment"))
    rows = F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l"))))
    text = F.concat(F.lit("key,name,segment\n"), F.array_join(F.transform(rows, lambda r: r["l"]), "\n"), F.lit("\n\n"))
    docs = c.groupBy(F.col("c_nationkey").cast("long").alias("doc_id")).agg(text.alias("text"))
    return normalize(from_text(docs), NormalizeConfig(type="csv")).select("doc_id", "text")


def html_text(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    docs = from_text(p.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.concat("url", F.lit(".html")).alias("filename")), filename="filename")
    return normalize(docs).select("doc_id", "text", F.col("source.format").alias("format"))


def html_tables(spark, sf_dir):
    """Tables of HTML as aligned columns."""
    n = _table(spark, sf_dir, "nation")
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td>"), "n_name", F.lit("</td></tr>"))
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r"))))
    html = F.concat(F.lit("<html><body><h1>Nations</h1><table><tr><th>key</th><th>name</th></tr>"), F.array_join(F.transform(rows, lambda r: r["r"]), ""), F.lit("</table></body></html>"))
    docs = n.groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(html.alias("text"))
    return normalize(from_text(docs)).select("doc_id", "text")


def email_text(spark, sf_dir):
    """Turns as mails."""
    t = _table(spark, sf_dir, "conversations")
    body = F.regexp_replace("text", "[\r\n]+", " ")
    mail = F.concat(
        F.lit("From: "), "role", F.lit("@example.com\r\nTo: a@example.com, b@example.com\r\nSubject: turn "), F.col("turn").cast("string"), F.lit("\r\nDate: Mon, 01 Jan 2024 10:00:00 +0200\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), body, F.lit("\r\n")
    )
    docs = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.encode(mail, "UTF-8").alias("content"), F.lit("m.eml").alias("filename"))
    return normalize(from_bytes(docs, filename="filename")).select("doc_id", "text")


def _xlsx(sheets: list[tuple[str, list[list[str]]]]) -> bytes:
    """A small workbook with inline strings."""
    from xml.sax.saxutils import escape

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (_, rows) in enumerate(sheets, 1):
            body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in r) + "</row>" for r in rows)
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def xlsx_sheets(spark, sf_dir):
    """A workbook for each region: its nations, and an empty sheet."""

    def book(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n_nationkey")
        rows = [["key", "name"], *([str(k), n] for k, n in zip(frame.n_nationkey, frame.n_name))]
        return pd.DataFrame({"doc_id": [int(frame.n_regionkey.iloc[0])], "content": [_xlsx([("nations", rows), ("empty", [])])], "filename": ["book.xlsx"]})

    docs = _table(spark, sf_dir, "nation").groupBy("n_regionkey").applyInPandas(book, "doc_id long, content binary, filename string")
    return normalize(from_bytes(docs, filename="filename")).select("doc_id", F.col("block_index").cast("long").alias("block_index"), F.col("source.sheet").alias("sheet"), "text")


def docx_markdown(spark, sf_dir):
    """Suppliers of each nation as a heading and a list."""

    def letter(frame: pd.DataFrame) -> pd.DataFrame:
        from xml.sax.saxutils import escape

        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        key = int(frame.s_nationkey.iloc[0])
        item = '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/></w:numPr></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>%s</w:t></w:r></w:p>'
        body = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Nation {key}</w:t></w:r></w:p>' + "".join(item % escape(n) for n in frame.sort_values("s_suppkey").s_name)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        return pd.DataFrame({"doc_id": [key], "content": [out.getvalue()], "filename": ["letter.docx"]})

    docs = _table(spark, sf_dir, "supplier").groupBy("s_nationkey").applyInPandas(letter, "doc_id long, content binary, filename string")
    return normalize(from_bytes(docs, filename="filename")).select("doc_id", "text")


def _pdf(lines: list[str]) -> bytes:
    shown = b"BT /F1 12 Tf 72 720 Td " + b" ".join(b"(" + x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj 0 -14 Td" for x in lines) + b" ET"
    packed = zlib.compress(shown)
    return b"%PDF-1.4\n4 0 obj\n<< /Filter /FlateDecode /Length " + str(len(packed)).encode() + b" >>\nstream\n" + packed + b"\nendstream\nendobj\n%%EOF"


def pdf_text(spark, sf_dir):
    """Parts by brand as PDFs; short ones go to the OCR backend."""

    def file(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("p_partkey")
        return pd.DataFrame({"doc_id": [int(frame.p_partkey.iloc[0])], "content": [_pdf(list(frame.p_name))]})

    docs = _table(spark, sf_dir, "part").groupBy("p_brand", "p_size").applyInPandas(file, "doc_id long, content binary")
    b = normalize(from_bytes(docs), NormalizeConfig(ocr=FakeOcr("scanned")))
    return b.select("doc_id", "text", "is_visual", F.col("source.format").alias("format"))


def image_ocr(spark, sf_dir):
    """Images of known sizes through the fake backend."""
    s = _table(spark, sf_dir, "supplier")
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode("s_name", "UTF-8"))
    docs = s.select(F.col("s_suppkey").alias("doc_id"), png.alias("content"))
    return normalize(from_bytes(docs), NormalizeConfig(ocr=FakeOcr())).select("doc_id", "text", "is_visual")


def normalize_errors(spark, sf_dir):
    """One bad document leaves an error, not a failed query."""
    s = _table(spark, sf_dir, "supplier")
    docs = s.select(F.col("s_suppkey").alias("doc_id"), F.encode("s_name", "UTF-8").alias("content"), F.when(F.col("s_suppkey") % 2 == 0, "a.png").otherwise("a.txt").alias("filename"))
    b = normalize(from_bytes(docs, filename="filename"), NormalizeConfig(on_error="skip"))
    return b.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("error.class", F.lit("")).alias("error"), F.coalesce("error.format", F.lit("")).alias("format"))


# ------------------------------------------------------------------------- prompts and extraction

ORDER_SCHEMA = {
    "type": "object",
    "properties": {"status": {"type": "string", "enum": ["O", "F"]}, "count": {"type": "integer"}, "items": {"type": "array", "items": {"type": "object", "properties": {"line": {"type": "string"}}}}},
    "required": ["status", "count"],
}


def prompt_build(spark, sf_dir):
    config = ExtractConfig("schema", "Find the facts.", model=NativeModel(lambda p, t: t), schema={"type": "object"}, examples=[{"input": "a", "output": {"b": 1}}])
    c = with_prompts(chunk(turn_blocks(spark, sf_dir), ChunkConfig("none")), config)
    return c.select("doc_id", F.col("index").cast("long").alias("chunk_index"), "prompt")


def _facts(prompt: Column, text: Column) -> Column:
    """Status of the first order in a table's piece, and how many rows it has."""
    return F.to_json(
        F.struct(
            F.regexp_extract(text, r"(?m)^\| \d+ \| (\w) \|", 1).alias("status"),
            F.regexp_count(text, F.lit(r"(?m)^\| \d+ ")).alias("count"),
            F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\| (\d+) "), F.lit(1)), lambda x: F.struct(x.alias("line"))).alias("items"),
        )
    )


def _order_config(**more) -> ExtractConfig:
    return ExtractConfig("schema", "Read the orders.", model=NativeModel(_facts), schema=ORDER_SCHEMA, **more)


def schema_extract(spark, sf_dir):
    c = chunk(order_tables(spark, sf_dir), ChunkConfig("none"))
    e = extract(c, _order_config())
    return e.select("doc_id", F.coalesce("data.status", F.lit("")).alias("status"), F.coalesce("data.count", F.lit(0)).alias("n_orders"), F.coalesce(F.size("data.items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("error.message", F.lit("")).alias("error"))


class OddModel:
    """A model that fails on every third chunk and shows what it has so far before its answer."""

    def generate(self, prompt: str, *, system=None, schema=None, **options):
        text = prompt.split("[Document]: ", 1)[1].rsplit("\n\n", 1)[0]
        if len(text) % 3 == 0:
            raise RuntimeError("no answer")
        yield text[:5]
        yield text[:10]


def error_policy(spark, sf_dir):
    c = chunk(turn_blocks(spark, sf_dir), ChunkConfig("none"))
    e = extract(c, ExtractConfig("markdown", "Convert.", model=OddModel()))
    return e.select("doc_id", F.col("index").cast("long").alias("chunk_index"), F.coalesce("data", F.lit("")).alias("data"), F.coalesce("error.message", F.lit("")).alias("error"), F.size("partials").cast("long").alias("n_partials"))


class LengthVision:
    def generate(self, prompt: str, *, data: bytes, **options):
        return f"{prompt}: {len(data)} bytes"


def vision_extract(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    docs = from_bytes(s.select(F.col("s_suppkey").alias("doc_id"), F.encode("s_name", "UTF-8").alias("content")))
    e = extract_vision(docs, ExtractConfig("markdown", "Size", vision_model=LengthVision()))
    return e.select("doc_id", "data", F.col("text").alias("chunk_text"), F.col("source.format").alias("format"))


# --------------------------------------------------------------------------------------- merging


def _order_rows(spark, sf_dir) -> DataFrame:
    """Lines of an order as its extractions: strings, numbers, arrays, nested objects, nulls."""
    item = F.struct(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"))
    data = F.struct(
        F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("number"),
        F.array(item).alias("items"),
        F.struct(F.col("l_linestatus").alias("status"), (F.col("l_linenumber") > 2).alias("late")).alias("inner"),
    )
    # line numbers repeat within an order, and an extraction's index must not
    index = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), index.alias("index"), data.alias("data"))


def _flat_merge(r: DataFrame) -> DataFrame:
    x = F.col("result")
    return r.select(
        "doc_id",
        x["flag"].alias("flag"),
        F.coalesce(x["number"], F.lit(-1)).alias("number"),
        F.array_join(F.transform(x["items"], lambda i: F.concat(i["part"].cast("string"), F.lit(":"), i["flag"], F.lit(":"), i["line"].cast("string"))), ",").alias("items"),
        x["inner"]["status"].alias("status"),
        x["inner"]["late"].alias("late"),
    )


def merge_concat(spark, sf_dir):
    return _flat_merge(merge(_order_rows(spark, sf_dir)))


def merge_first(spark, sf_dir):
    return _flat_merge(merge(_order_rows(spark, sf_dir), MergeConfig("first")))


def merge_dedupe_first(spark, sf_dir):
    return _flat_merge(merge(_order_rows(spark, sf_dir), MergeConfig("dedupe", dedupe_key=lambda i: i["flag"])))


def merge_dedupe_last(spark, sf_dir):
    return _flat_merge(merge(_order_rows(spark, sf_dir), MergeConfig("dedupe", dedupe_key=lambda i: i["flag"], dedupe_winner="last")))


def merge_markdown(spark, sf_dir):
    """Texts of all turns, joined."""
    t = _table(spark, sf_dir, "conversations")
    rows = t.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("index"), F.col("text").alias("data"))
    return merge(rows, docs=t.select(F.col("conv_id").alias("doc_id"))).select("doc_id", F.coalesce("result", F.lit("")).alias("result"))


def _longest(values: list) -> str:
    return max(values, key=lambda v: (len(v), v))


def merge_custom(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations")
    rows = t.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("index"), F.col("text").alias("data"))
    return merge(rows, MergeConfig(_longest))


# ---------------------------------------------------------------------------------------- chains


def _first_line(prompt: Column, text: Column) -> Column:
    return F.concat(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit("/"), F.length(text).cast("string"))


def chain_markdown(spark, sf_dir):
    """normalize -> sliding chunks -> native markdown extraction -> concat, one exchange."""
    docs = from_text(_table(spark, sf_dir, "documents"))
    config = ExtractConfig("markdown", "First line.", model=NativeModel(_first_line))
    return Normalized(NormalizeConfig(type="text")).chunk(ChunkConfig("sliding", max_chars=1000, overlap=200)).extract(config).run(docs).select("doc_id", F.coalesce("result", F.lit("")).alias("result"))


def chain_orders(spark, sf_dir):
    """CSV-like tables -> row chunks -> typed extraction -> keyed dedupe."""
    docs = from_text(order_tables(spark, sf_dir).select("doc_id", "text"))
    chain = Normalized(NormalizeConfig(type="markdown")).chunk(ChunkConfig("row", max_chars=300)).extract(_order_config())
    out = chain.merge(MergeConfig("dedupe", dedupe_key=lambda i: i["line"])).run(docs)
    return out.select("doc_id", F.coalesce(F.array_join(F.transform("result.items", lambda i: i["line"]), ","), F.lit("")).alias("lines"))


def events(spark, sf_dir):
    """The course of a chain as one table of events: conversations, all turns in order, in several chunks."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    docs = _table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(turns["text"], "\n").alias("text"))
    config = ExtractConfig("markdown", "Convert.", model=NativeModel(_first_line))
    chain = Normalized(NormalizeConfig(type="text")).chunk(ChunkConfig("sliding", max_chars=200, overlap=50)).extract(config).merge()
    docs = from_text(docs)
    return chain.events(docs).select("doc_id", F.col("seq").cast("long").alias("seq"), "phase", F.coalesce("done", F.lit(False)).alias("done"), F.coalesce("text", "value").alias("content"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        detect_documents, detect_names, chunk_sliding, chunk_none, chunk_page, chunk_row, chunk_row_tables, chunk_structural, chunk_structural_packed, chunk_structural_long, chunk_sentence, sentence_slices, chunk_auto, auto_choice,
        chunk_context, chunk_custom, normalize_text, csv_native, csv_parsed, html_text, html_tables, email_text, xlsx_sheets, docx_markdown, pdf_text, image_ocr, normalize_errors, prompt_build, schema_extract,
        error_policy, vision_extract, merge_concat, merge_first, merge_dedupe_first, merge_dedupe_last, merge_markdown, merge_custom, chain_markdown, chain_orders, events,
    )
    return {f.__name__: f for f in own}
