"""The steps on DataFrames, and the shape of their plans."""

import pytest
from pyspark.sql import functions as F

from docloom import ChunkConfig, ExtractConfig, MergeConfig, NativeModel, NormalizeConfig, chunk, detect, merge, normalize
from docloom.operators.extract import extract
from docloom.operators.prompt import with_prompts
from docloom.schemas import BLOCKS, DOCS
from docloom.sources.docs import from_text, read_files, read_stream


def docs_of(spark, *rows):
    """rows: (content, text, hint, filename, mime)."""
    return spark.createDataFrame([(i, c, t, t is not None, h, f, m) for i, (c, t, h, f, m) in enumerate(rows)], DOCS)


def formats(spark, *rows, config=None):
    return [r.format for r in detect(docs_of(spark, *rows), config).orderBy("doc_id").collect()]


def text(t):
    return (None, t, None, None, None)


def test_detection_by_content(spark):
    cases = {
        "<!DOCTYPE html>": "html", "  <html>": "html", "<!doctype html>": "text", "BMW drives": "image", "BM": "text", "Subject: x\nhi": "email", "# h\nx": "markdown", "#x": "text",
        "a,b\n1,2": "csv", "a,b\n1,2\n": "text", "a,b\n" * 5: "csv", "a\tb\n1\t2": "csv", "a,b\n1": "text", "": "text", " \n ": "text", "%PDF-1": "pdf",
    }
    assert dict(zip(cases, formats(spark, *map(text, cases)))) == cases


def test_detection_by_bytes_names_and_hints(spark):
    data = lambda b, **k: (bytearray(b), None, k.get("hint"), k.get("name"), k.get("mime"))
    got = formats(
        spark, data(b"\x89PNG"), data(b"\xff\xd8\xff\xe0"), data(b"RIFF1234WEBP"), data(b"RIFF1234WAVE"), data(b"PK\x03\x04"), data(b"BM"), data(b"II*\x00"), data(b"a,b\n1,2"),
        data(b"x", name="a.b.TSV"), data(b"%PDF", name="x.zip"), data(b"%PDF", mime="Text/HTML ; charset=x"), data(b"%PDF", hint="email", mime="text/html"), data(b"%PDF", hint="auto", name="x.md"),
    )
    assert got == ["image", "image", "image", "text", "text", "text", "image", "text", "csv", "pdf", "html", "email", "markdown"]
    assert formats(spark, data(b"%PDF", hint="email"), config="auto") == ["pdf"]


def blocks_of(spark, *texts, pages=False):
    rows = [(1, i, t, False, ("text", i if pages else None, None, None)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, BLOCKS)


def chunks_of(spark, config, *texts, **k):
    return [(r["index"], r.total, r.text, r.context, r.char_offset) for r in chunk(blocks_of(spark, *texts, **k), config).orderBy("index").collect()]


def test_sliding_windows(spark):
    c = ChunkConfig("sliding", max_chars=4, overlap=1)
    assert chunks_of(spark, c, "abcd", "", "abcdefgh") == [(0, 4, "abcd", None, 0), (1, 4, "abcd", None, 0), (2, 4, "defg", "c", 3), (3, 4, "gh", "f", 6)]
    assert chunks_of(spark, ChunkConfig("sliding", max_chars=3, overlap=0), "abcdef") == [(0, 2, "abc", None, 0), (1, 2, "def", None, 3)]


def test_context_crosses_blocks(spark):
    c = ChunkConfig("row", max_chars=3, context_window=2)
    assert chunks_of(spark, c, "ab\ncd", "ef") == [(0, 3, "ab", None, 0), (1, 3, "cd", "ab", 3), (2, 3, "ef", "cd", 0)]
    assert [x[3] for x in chunks_of(spark, ChunkConfig("row", max_chars=3, context_window=0), "ab\ncd")] == [None, None]
    assert chunks_of(spark, ChunkConfig("none"), "a", "", "b") == [(0, 3, "a", None, 0), (1, 3, "", None, 0), (2, 3, "b", None, 0)]


@pytest.mark.parametrize(
    "texts,pages,expected",
    [(["x" * 8000], False, 1), (["x y. " * 1700], False, 2), (["| a |\n" + "x\n" * 4500], False, 2), (["# a\n" + "b c. " * 1700 + "\n# d"], False, 3), (["y" * 4001, "z" * 4001], True, 2), (["w" * 10001 + "\n# late"], False, 2)],
)
def test_auto(spark, texts, pages, expected):
    assert len(chunks_of(spark, ChunkConfig("auto", max_chars=8000), *texts, pages=pages)) == expected


def test_prompts(spark):
    config = ExtractConfig("markdown", "Go.", model=NativeModel(lambda p, t: t), examples=[{"input": "i", "output": {"é": [1, 2]}}])
    c = chunk(blocks_of(spark, "a" * 600, "", "b"), ChunkConfig("none"))
    got = [r.prompt for r in with_prompts(c, config).orderBy("index").collect()]
    head, tail = 'Go.\n\nExamples:\nQ: i\nA: {"é":[1,2]}\n', "\n\nConvert the document content above into clean, well-structured markdown."
    assert got[0] == head + "\n\n[Document]: " + "a" * 600 + tail
    assert got[1] == head + "\n\n[Previous context]: " + "a" * 500 + "\n\n[Document]: " + tail
    assert got[2] == head + "\n\n[Document]: b" + tail  # the chunk before is empty


SCHEMA = {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a"]}


class Model:
    def generate(self, prompt, *, system, schema, **options):
        t = prompt.split("[Document]: ")[1].split("\n")[0]
        if t == "bad":
            raise RuntimeError("broken")
        return t


def test_extraction_policies(spark):
    c = chunk(blocks_of(spark, '{"a": 1}', "bad", '{"b": 2}', "no json"), ChunkConfig("none"))
    e = extract(c, ExtractConfig("schema", "p", model=Model(), schema=SCHEMA)).orderBy("index").collect()
    assert [x.data.a if x.data else None for x in e] == [1, None, None, None]
    assert [x.error and x.error["message"] for x in e][:3] == [None, "broken", "a is missing"] and e[3].error is not None
    with pytest.raises(Exception, match="extraction failed for chunk"):
        extract(c, ExtractConfig("schema", "p", model=Model(), schema=SCHEMA, on_chunk_error="throw")).collect()
    native = extract(c, ExtractConfig("schema", "p", model=NativeModel(lambda p, t: t), schema=SCHEMA)).orderBy("index").collect()
    assert [x.data.a if x.data else None for x in native] == [1, None, None, None]
    assert [x.error and x.error["message"] for x in native] == [None, "the answer is not JSON", "a is missing", "the answer is not JSON"]
    with pytest.raises(Exception, match="extraction failed for chunk 1"):
        extract(c, ExtractConfig("schema", "p", model=NativeModel(lambda p, t: t), schema=SCHEMA, on_chunk_error="throw")).collect()


def test_native_and_python_checks_say_the_same(spark):
    from docloom.plans.json_schema import issues, native_issues, resolved

    schema = {
        "type": "object",
        "$defs": {"code": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^[a-z]+$"}},
        "properties": {
            "a": {"type": "integer", "minimum": 1, "maximum": 9}, "b": {"type": ["string", "null"]}, "c": {"$ref": "#/$defs/code"}, "d": {"enum": ["x", 1, True, None]}, "e": {"const": 2},
            "f": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "properties": {"k": {"type": "number"}}, "required": ["k"], "additionalProperties": False}},
            "g": {"anyOf": [{"type": "boolean"}, {"type": "array", "items": {"type": "string"}}]}, "h": {"type": "object", "additionalProperties": {"type": "integer"}}, "i": {"allOf": [{"type": "string"}, {"minLength": 2}]},
        },
        "required": ["a", "b"],
        "additionalProperties": False,
    }
    values = [
        {"a": 1, "b": None}, {"b": "x"}, {"a": 1}, {"a": 1.0, "b": ""}, {"a": 1.5, "b": 3}, {"a": 0, "b": "x", "zz": 1, "y": 2}, {"a": 10, "b": None, "c": "a"}, {"a": 2, "b": None, "c": "abcd"},
        {"a": 2, "b": None, "c": "AB"}, {"a": 2, "b": None, "c": None}, {"a": 2, "b": None, "d": "x", "e": 2}, {"a": 2, "b": None, "d": 1.0, "e": 2.0}, {"a": 2, "b": None, "d": True, "e": "2"},
        {"a": 2, "b": None, "d": None}, {"a": 2, "b": None, "d": False}, {"a": 2, "b": None, "f": []}, {"a": 2, "b": None, "f": [{"k": 1}, {"k": "1"}, {"l": 1}]}, {"a": 2, "b": None, "f": {"k": 1}},
        {"a": 2, "b": None, "f": [None, {"k": None}]}, {"a": 2, "b": None, "g": True}, {"a": 2, "b": None, "g": ["s"]}, {"a": 2, "b": None, "g": [1]}, {"a": 2, "b": None, "h": {"q": 1, "p": "x", "o": None}},
        {"a": 2, "b": None, "i": "x"}, {"a": 2, "b": None, "i": 5}, {"a": 12345678901234567890123, "b": "é"}, [1], "text", None, 5, True,
    ]
    import json

    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, raw string")
    for s in (schema, {"type": "array", "items": {"type": "integer"}}, {"type": ["integer", "null"]}, {}, {"enum": [[1], "text"]}):
        s = resolved(s)
        got = {r.k: r.found for r in rows.select("k", native_issues(F.try_parse_json("raw"), s).alias("found")).collect()}
        for k, v in enumerate(values):
            assert got[k] == issues(v, s), (s, v)
    with pytest.raises(ValueError):
        resolved({"$defs": {"t": {"type": "array", "items": {"$ref": "#/$defs/t"}}}, "$ref": "#/$defs/t"})


def test_a_native_model_has_no_callback(spark):
    c = chunk(blocks_of(spark, "x"), ChunkConfig("none"))
    with pytest.raises(ValueError):
        extract(c, ExtractConfig("markdown", "p", model=NativeModel(lambda p, t: t), on_chunk_error=print))


def merged(spark, ddl, values, config=MergeConfig()):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], f"doc_id long, index int, data {ddl}")
    return merge(rows.repartition(3), config).first().result


def test_merging(spark):
    t = "struct<s:string,n:int,b:boolean,l:array<string>,o:struct<x:string,y:int>>"
    a, b, c = (("p", None, False, ["1"], ("q", 0)), (None, 5, True, None, None), ("r", 6, None, ["1", "2"], ("t", 7)))
    r = merged(spark, t, [a, b, c])
    assert (r.s, r.n, r.b, r.l, r.o.x, r.o.y) == ("p\n\n---\n\nr", 5, False, ["1", "1", "2"], "q\n\n---\n\nt", 0)
    assert merged(spark, t, [a, b, c], MergeConfig("first")).s == "p"
    assert merged(spark, "string", ["x", None, "y"]) == "x\n\n---\n\ny"
    items = "array<struct<k:string,v:int>>"
    values = [[("a", 1), ("b", 2)], [("a", 3), ("c", 4), (None, 5)], [(None, 6)]]
    key = lambda i: i["k"]
    assert [tuple(x) for x in merged(spark, items, values, MergeConfig("dedupe", dedupe_key=key))] == [("a", 1), ("b", 2), ("c", 4), (None, 5)]
    assert [tuple(x) for x in merged(spark, items, values, MergeConfig("dedupe", dedupe_key=key, dedupe_winner="last"))] == [("a", 3), ("b", 2), ("c", 4), (None, 6)]
    alone = [[("a", 1), ("a", 2)]]
    assert len(merged(spark, items, alone, MergeConfig("dedupe", dedupe_key=key))) == 2  # one extraction is left alone
    assert merged(spark, "map<string,int>", [{"a": 1}, {"a": 2, "b": 3}]) == {"a": 1, "b": 3}
    assert merged(spark, "int", [1, 2], MergeConfig(max)) == 2


def test_untyped_merge(spark):
    from docloom.operators.merge import merge_json

    rows = spark.createDataFrame([(1, 0, '{"a":"x","b":1}'), (1, 1, '{"a":2,"c":[1]}'), (1, 2, '{"a":"y","c":[2]}')], "doc_id long, index int, data string")
    assert merge_json(rows).first().result == '{"a": "x\\n\\n---\\n\\ny", "b": 1, "c": [1, 2]}'


def test_chain_and_documents_without_result(spark):
    docs = docs_of(spark, text("one\ntwo"), text("bad"))
    chain = normalize(NormalizeConfig(type="text")).extract(ExtractConfig("markdown", "p", model=Model()))
    assert {r.doc_id: r.result for r in chain.run(docs).collect()} == {0: "one", 1: None}
    assert [(r.seq, r.phase) for r in chain.merge().events(docs).filter("doc_id = 1").orderBy("seq").collect()] == [(0, "normalizing"), (1, "chunking"), (2, "error"), (3, "merging")]
    with pytest.raises(ValueError):
        chain.run()
    assert chain.bind(docs).run().count() == 2


class Counted:
    """Counts its calls in a file, and answers with their number."""

    def __init__(self, path):
        self.path = path

    def generate(self, prompt, *, system, schema, **options):
        with open(self.path, "ab") as f:
            f.write(b".")
            f.flush()
            n = f.tell()
        yield f"part {n}"
        yield f"answer {n}"


def test_events_call_a_model_once_a_chunk(spark, tmp_path):
    calls = tmp_path / "calls"
    docs = docs_of(spark, text("one\ntwo"), text("bad"))
    chain = normalize(NormalizeConfig(type="text")).chunk(ChunkConfig("row", max_chars=4)).extract(ExtractConfig("markdown", "p", model=Counted(str(calls)), concurrency=1)).merge()
    got = chain.events(docs).orderBy("doc_id", "seq").collect()
    assert calls.stat().st_size == 3
    first = [r for r in got if r.doc_id == 0]
    assert [(r.phase, r.done) for r in first] == [("normalizing", None), ("chunking", None), ("chunking", None), ("extracting", False), ("extracting", True), ("extracting", False), ("extracting", True), ("merging", True)]
    answers = [r.value for r in first if r.phase == "extracting"]
    assert [a.replace("part", "answer") for a in answers[::2]] == answers[1::2]
    assert first[-1].value == "\n\n---\n\n".join(answers[1::2])


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_plans(spark, sf_dir):
    docs = from_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    blocks = normalize(NormalizeConfig(type="text")).run(docs)
    c = chunk(blocks, ChunkConfig("sliding", max_chars=1000))
    assert exchanges(c) == 1
    for whole in (normalize().run(docs), chunk(blocks, ChunkConfig("auto"))):
        plan = whole._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1  # documents are read once, whatever their route
    e = extract(c, ExtractConfig("markdown", "p", model=NativeModel(lambda p, t: t)))
    assert exchanges(merge(e)) == 1  # windows and the merge share one exchange
    scan = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.length("text").alias("n")).filter("doc_id > 5")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(doc_id,5)" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_files_and_streams(spark, tmp_path):
    from docloom.streaming.stream import parquet_sink, run_stream

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"d{k}.txt").write_text(f"text {k}")
    (tmp_path / "in" / "t.csv").write_text("a,b\n1,2")
    assert {r.filename: r.text for r in normalize().run(read_files(spark, str(tmp_path / "in"))).select("source.filename", "text").collect()}["t.csv"].startswith("| a | b |")
    chain = normalize().extract(ExtractConfig("markdown", "p", model=NativeModel(lambda p, t: F.upper(t))))
    run_stream(read_stream(spark, str(tmp_path / "in"), max_files=2), chain, parquet_sink(str(tmp_path / "out")), checkpoint=str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 4 and got.filter("result = 'TEXT 1'").count() == 1


def test_registered_queries_match_their_sql(spark, sf_dir):
    import duckdb

    from docloom.plans.oracles import oracle_sql
    from docloom.plans.queries import queries

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    known = queries()
    for name, sql in oracle_sql().items():
        want = con.execute(sql).fetchdf()
        got = known[name](spark, sf_dir).toPandas()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns, name
        assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values)), name
