import io
import re
import zipfile

import pytest

from docloom.backends import FakeOcr, HttpOcr
from docloom.config import ChunkConfig, ExtractConfig, MergeConfig, NormalizeConfig
from docloom.errors import NormalizeError
from docloom.functions.parsers import csv_table, docx_markdown, email_text, html_text, pdf_text
from docloom.operators.normalize import parse_one
from docloom.plans.json_schema import issues, spark_type
from docloom.plans.queries import _pdf, _xlsx


def test_csv():
    assert csv_table('﻿a,"b ""q"""\n\n1,"x\ny"\n3\n') == '| a | b "q" |\n| --- | --- |\n| 1 | x\ny |\n| 3 |'
    assert csv_table("a\tb\n1\t2") == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert csv_table("") == ""
    assert csv_table("a|b,c\n1,2") == "| a|b | c |\n| --- | --- |\n| 1 | 2 |"
    long = "x" * 200_000
    assert csv_table(f"a;b\n{long};1\n" + f"c;{long}\n" * 9).startswith("| a | b |")
    assert csv_table("a;b;c\n1;2;3\n1;2\n4;5;6") == "| a | b | c |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n| 1 | 2 |\n| 4 | 5 | 6 |"
    assert csv_table("a|b,c\n1,2", escape=True).startswith("| a\\|b | c |")


def test_html():
    html = "<!DOCTYPE html><head><title>t</title></head><body><h1>Big  one</h1><p>See <a href='u'>this</a> &amp; that<br>now<img src=x></p><script>no</script><ol><li>a<li>b</ol></body>"
    assert html_text(html) == "Big one\n\nSee this & that\nnow\n\n1. a\n2. b"
    assert html_text("<table><tr><th>k</th><th>v</th></tr><tr><td>long</td><td>1</td></tr></table>") == "k      v\nlong   1"
    assert html_text("") == ""
    assert html_text("<div><select><option>no</div><p>yes<button>no<span>no</p>and</p>") == "yes\n\nand"
    assert html_text("<head><title>no</title><body>yes<svg><g></svg> still") == "yes still"
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000
    assert html_text(deep) == "x"


def test_email():
    raw = b"From: a@x.org\nTo: b@x.org, c@x.org\nDate: Mon, 1 Jan 2024 00:00:00 +0100\n\nhi\n"
    assert email_text(raw) == "From: a@x.org\nTo: b@x.org, c@x.org\nDate: 2023-12-31T23:00:00.000Z\n\nhi\n"
    assert email_text(raw, headers=False) == "hi\n"
    assert email_text(b"Subject: s\nContent-Type: text/html\n\n<p>x</p>") == "Subject: s\n\nx"
    both = b"Content-Type: multipart/alternative; boundary=q\n\n--q\nContent-Type: text/html\n\n<p>h</p>\n--q\nContent-Type: text/plain\n\np\n--q--\n"
    assert email_text(both).strip() == "p" and email_text(both).startswith("\n")


def _docx(body: str, numbering: str = "", rels: str = "") -> bytes:
    w, r = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:r="{r}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/numbering.xml", f'<w:numbering xmlns:w="{w}">{numbering}</w:numbering>')
        z.writestr("word/_rels/document.xml.rels", f"<Relationships>{rels}</Relationships>")
    return out.getvalue()


def test_docx():
    def p(text, num=None, level=0, style=""):
        props = f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr></w:pPr>' if num else style
        return f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r></w:p>"

    kinds = "".join(f'<w:abstractNum w:abstractNumId="{k}"><w:lvl w:ilvl="0"><w:numFmt w:val="{a}"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="{b}"/></w:lvl></w:abstractNum>' for k, (a, b) in enumerate([("decimal", "bullet"), ("bullet", "decimal")]))
    numbering = kinds + "".join(f'<w:num w:numId="{k + 5}"><w:abstractNumId w:val="{k}"/></w:num>' for k in range(2))
    body = p("one", 5) + p("in", 5, 1) + p("two", 5) + p("a_b (c)") + p("dot", 6) + p("x", 6, 1) + p("y", 6, 1)
    assert docx_markdown(_docx(body, numbering)) == "1. one\n\t- in\n2. two\n\na\\_b \\(c\\)\n\n- dot\n\t1. x\n\t2. y"
    bold = "<w:r><w:rPr><w:b/></w:rPr><w:t>%s</w:t></w:r>"
    link = '<w:hyperlink r:id="r1"><w:r><w:t>here</w:t></w:r></w:hyperlink>'
    rel = '<Relationship Id="r1" Target="http://a.org/x" TargetMode="External"/>'
    assert docx_markdown(_docx(f"<w:p>{bold % 'a'}{bold % 'b'}<w:r><w:t> see </w:t></w:r>{link}</w:p>", "", rel)) == "__ab__ see [here](http://a.org/x)"


def test_sheets_by_id():
    book = _xlsx([("one", [["h", "i"], ["1", ""]]), ("none", []), ("three", [["x"]])])
    get = lambda sheets: [(s, t) for t, s, _ in parse_one("xlsx", book, None, None, None, NormalizeConfig(sheets=sheets))]
    assert get("all") == [("one", "| h | i |\n| --- | --- |\n| 1 |  |"), ("none", ""), ("three", "| x |\n| --- |")]
    assert [s for s, _ in get("first")] == ["one"]
    assert [s for s, _ in get([3])] == ["three"]


def test_pdf_falls_back_to_ocr_at_fifty_characters():
    assert pdf_text(_pdf(["a (b)", "c\\"])) == "a (b)\nc\\"
    run = lambda n, **c: parse_one("pdf", _pdf(["x" * n]), None, "f.pdf", None, NormalizeConfig(**c))
    assert run(51) == [("x" * 51, None, False)]
    assert run(50, ocr=FakeOcr("seen")) == [("seen", None, True)]
    with pytest.raises(NormalizeError):
        run(50)
    with pytest.raises(NormalizeError):
        parse_one("image", b"x", None, None, None, NormalizeConfig())


def test_pdf_streams_whose_last_byte_is_a_line_end():
    """The checksum of a deflated stream may end in any byte, and a stream's length is what it states."""
    lasts = set()
    for k in range(3000):
        lines = [f"part {k} of a longer list", "cold ring", "large gizmo"]
        made = _pdf(lines)
        lasts.add(made[made.index(b"\nendstream") - 1])
        assert pdf_text(made) == "\n".join(lines)
    assert {10, 13} <= lasts
    # without a length, with a wrong one and with one that is held elsewhere
    for length in (b"", b"/Length 7", b"/Length 5 0 R"):
        assert pdf_text(re.sub(rb"/Length \d+", length, made)) == "\n".join(lines)
    shown = b"BT (the word endstream) Tj ET"
    assert pdf_text(b"%%PDF-1.4\n<< /Length %d >>\nstream\n%s\nendstream" % (len(shown), shown)) == "the word endstream"
    assert pdf_text(made.replace(b"\nendstream", b"").replace(b"endobj", b"endstream")) == "\n".join(lines)
    assert pdf_text(made[: made.index(b"\nendstream") - 9] + b"\nendstream") == ""


def test_http_backend_request_and_answer():
    b = HttpOcr("http://host/", formula_enable=False)
    body, kind = b.body(b"DATA", None, "image/png")
    assert b.url == "http://host" and kind.startswith("multipart/form-data")
    assert b'filename="document.pdf"' in body and b"DATA" in body and b"table_enable" in body and b"formula_enable" not in body
    assert b.text_of({"results": {"a": {"md_content": ""}, "b": {"md_content": "x"}}}) == "x"
    assert b.text_of({"md_content": "y"}) == "y"
    with pytest.raises(RuntimeError):
        b.text_of({})


def test_schemas():
    s = {"type": "object", "properties": {"a": {"type": ["string", "null"]}, "n": {"type": "array", "items": {"type": "integer"}}, "k": {"enum": ["x"]}}, "required": ["a"]}
    assert spark_type(s).simpleString() == "struct<a:string,n:array<bigint>,k:string>"
    assert spark_type({"type": "object", "additionalProperties": {"type": "number"}}).simpleString() == "map<string,double>"
    assert spark_type({}).simpleString() == "variant"
    assert issues({"a": None, "n": [1, 2.0]}, s) == []
    assert issues({"n": [True], "k": "y"}, s) == ["a is missing", "n[0] is not integer", "k is none of x"]


@pytest.mark.parametrize("make", [lambda: ChunkConfig("sliding", max_chars=5, overlap=5), lambda: ChunkConfig(max_chars=0), lambda: MergeConfig("odd"), lambda: ExtractConfig("schema", "p", model=1), lambda: ExtractConfig("text", "p", model=1), lambda: NormalizeConfig(type="odd")])
def test_bad_settings(make):
    with pytest.raises(ValueError):
        make()
