"""Extraction: one model call per chunk, schema-checked, with errors kept beside the chunk.

A model is one of

* ``NativeModel(f)``: f(prompt, text) -> column of JSON or markdown; stays in the JVM;
* an object with ``generate(prompt, *, system, schema, **options)`` that returns a text, or an
  iterable of growing texts whose last is the result.  It is called in Arrow batches, at most
  ``concurrency`` calls at a time in a task.

The Python pass reports no partitioning, and must not be run twice by Spark's rewriting: keep its
result (``persist`` or a table) where several actions follow.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ExtractConfig
from ..errors import ExtractionError
from ..plans.json_schema import issues, let, native_issues, resolved, spark_type
from ..schemas import ERROR
from .prompt import system_prompt, with_prompts


@dataclass(frozen=True)
class NativeModel:
    """A model that is a column expression."""

    function: Callable[[Column, Column], Column]


def _finish(texts: list[str], schema: dict | None) -> str:
    """The last text, checked: what the schema says against it is the error."""
    if not texts:
        raise ValueError("the model gave no answer")
    if schema is not None:
        try:
            value = json.loads(texts[-1])
        except json.JSONDecodeError:
            raise ValueError("the answer is not JSON") from None
        found = issues(value, schema)
        if found:
            raise ValueError("; ".join(found))
    return texts[-1]


def _answers(call: Callable[[], Any]) -> list[str]:
    got = call()
    if isinstance(got, str):
        return [got]
    if isinstance(got, (dict, list)):
        return [json.dumps(got, ensure_ascii=False)]
    return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in got]


_RAW = f"raw string, partials array<string>, error {ERROR}"


def _call_model(rows: DataFrame, config: ExtractConfig, columns: list[str], call: Callable[[Any], Any]) -> DataFrame:
    """Append raw, partials and error to ``columns``; ``call`` gets a row."""
    schema = resolved(config.schema) if config.output == "schema" else None
    policy, width = config.on_chunk_error, config.concurrency
    keep = rows.select(*columns).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(row):
            texts: list[str] = []
            try:
                texts = _answers(lambda: call(row))
                return _finish(texts, schema), texts[:-1], None
            except Exception as e:
                if policy == "throw":
                    raise ExtractionError(f"extraction failed for chunk {getattr(row, 'index', 0)}: {e}", row, e) from e
                if callable(policy):
                    policy(e, row)
                return None, texts[:-1], {"class": type(e).__name__, "message": str(e), "phase": "extract", "format": None}

        with ThreadPoolExecutor(width) as pool:
            for frame in frames:
                got = list(pool.map(one, [_Row(frame.columns, r) for r in frame.itertuples(index=False, name=None)]))
                out = frame[columns].copy()
                for k, name in enumerate(("raw", "partials", "error")):
                    out[name] = pd.Series([g[k] for g in got], index=out.index, dtype=object)
                yield out

    kinds = T.StructType(keep.fields + T.StructType.fromDDL(_RAW).fields)
    return rows.mapInPandas(run, kinds)


class _Row:
    """A row by attribute, whatever its columns are called."""

    def __init__(self, names, values):
        self.__dict__.update(zip(names, values))


def _native_error(raw: Column, schema: dict) -> Column:
    """What ``_finish`` says, where the model is native."""

    def told(value: Column) -> Column:
        found = F.nullif(F.array_join(native_issues(value, schema), "; "), F.lit(""))
        return F.when(value.isNull(), F.lit("the answer is not JSON")).otherwise(found)

    message = F.when(raw.isNull(), F.lit("the model gave no answer")).otherwise(let(F.try_parse_json(raw), told))

    def error(m: Column) -> Column:
        return F.when(m.isNotNull(), F.struct(F.lit("ValueError").alias("class"), m.alias("message"), F.lit("extract").alias("phase"), F.lit(None).cast("string").alias("format")))

    return let(message, error)


def typed(rows: DataFrame, config: ExtractConfig) -> DataFrame:
    """``raw`` as ``data``: the schema's type, or the text."""
    if config.output == "markdown":
        return rows.withColumn("data", F.col("raw"))
    kind = spark_type(resolved(config.schema))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return rows.withColumn("data", F.from_json("raw", kind))
    if isinstance(kind, T.VariantType):
        return rows.withColumn("data", F.try_parse_json("raw"))
    return rows.withColumn("data", F.get_json_object("raw", "$").cast(kind))


def extract(chunks: DataFrame, config: ExtractConfig) -> DataFrame:
    """``chunks`` with data, raw, partials and error (null where the extraction went well)."""
    if config.model is None:
        raise ValueError("extraction from chunks needs a model")
    rows = with_prompts(chunks, config)
    columns = chunks.columns
    if isinstance(config.model, NativeModel):
        if callable(config.on_chunk_error):
            raise ValueError("a native model has no process that could call on_chunk_error: 'skip' or 'throw'")
        out = rows.withColumn("raw", config.model.function(F.col("prompt"), F.col("text"))).withColumn("partials", F.array().cast("array<string>"))
        error = _native_error(F.col("raw"), resolved(config.schema)) if config.output == "schema" else F.lit(None).cast(ERROR)
        out = typed(out.withColumn("error", error), config)
        if config.on_chunk_error == "throw":
            told = F.concat(F.lit("extraction failed for chunk "), F.col("index").cast("string"), F.lit(": "), F.col("error.message"))
            out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(told).cast(ERROR)))
        return out.withColumn("data", F.when(F.col("error").isNull(), F.col("data"))).select(*columns, "data", "raw", "partials", "error")
    model, system, options = config.model, system_prompt(config), dict(config.generation_options)
    schema = resolved(config.schema) if config.output == "schema" else None

    def call(row):
        return model.generate(row.prompt, **({"system": system, "schema": schema} | options))

    return typed(_call_model(rows, config, columns, call), config).select(*columns, "data", "raw", "partials", "error")


def extract_vision(docs: DataFrame, config: ExtractConfig) -> DataFrame:
    """Straight from the documents' bytes: one synthetic chunk a document."""
    if config.vision_model is None:
        raise ValueError("vision extraction needs a vision model")
    model, system, options, prompt = config.vision_model, system_prompt(config), dict(config.generation_options), config.prompt
    schema = resolved(config.schema) if config.output == "schema" else None
    source = F.struct(F.lit("image").alias("format"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("sheet"), F.col("filename"))
    rows = docs.select(
        "doc_id",
        F.lit(0).alias("index"),
        F.lit(1).alias("total"),
        F.lit("[image input]").alias("text"),
        F.lit(None).cast("string").alias("context"),
        F.lit(0).alias("char_offset"),
        F.lit(0).alias("block_index"),
        source.alias("source"),
        F.coalesce("content", F.encode("text", "UTF-8")).alias("_bytes"),
    )
    columns = [c for c in rows.columns if c != "_bytes"]

    def call(row):
        return model.generate(prompt, data=bytes(row._bytes), **({"system": system, "schema": schema} | options))

    return typed(_call_model(rows, config, columns, call), config).select(*columns, "data", "raw", "partials", "error")
