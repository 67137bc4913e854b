"""The lazy chain normalize -> chunk -> extract -> merge.

A chain is an immutable value that holds settings only; ``run`` composes DataFrames, and nothing is
computed before an action.  ``events`` is the chain's whole course as one table; as its phases and
the merge have to show the same answers, those of a Python model are written to the shared folder
of ``spark.checkpoint.dir`` first, which calls the model once a chunk when ``events`` is called.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ChunkConfig, ExtractConfig, MergeConfig, NormalizeConfig
from ..operators.chunk import chunk as chunk_blocks
from ..operators.extract import NativeModel, extract_vision
from ..operators.extract import extract as extract_chunks
from ..operators.merge import merge as merge_extractions
from ..operators.normalize import normalize as normalize_docs
from ..schemas import ERROR
from ..sources.shared import written


@dataclass(frozen=True)
class Normalized:
    config: NormalizeConfig = NormalizeConfig()

    def run(self, docs: DataFrame) -> DataFrame:
        return normalize_docs(docs, self.config)

    def chunk(self, config: ChunkConfig = ChunkConfig()) -> Chunked:
        return Chunked(self, config)

    def extract(self, config: ExtractConfig) -> Extracted:
        return Extracted(config, self, None)

    def events(self, docs: DataFrame) -> DataFrame:
        return _numbered(_block_events(self.run(docs)))


@dataclass(frozen=True)
class Chunked:
    normalized: Normalized
    config: ChunkConfig = ChunkConfig()

    def run(self, docs: DataFrame) -> DataFrame:
        return chunk_blocks(_text_of(self.normalized.run(docs)), self.config)

    def extract(self, config: ExtractConfig) -> Extracted:
        return Extracted(config, self.normalized, self.config)


@dataclass(frozen=True)
class Extracted:
    config: ExtractConfig
    normalized: Normalized | None = None
    chunking: ChunkConfig | None = None
    docs: DataFrame | None = None

    def bind(self, docs: DataFrame) -> Extracted:
        """The chain with its input, so that run() needs none."""
        return replace(self, docs=docs)

    def _steps(self, docs: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
        if self.normalized is None and self.config.vision_model is not None:
            return None, None, extract_vision(docs, self.config)
        blocks = (self.normalized or Normalized()).run(docs)
        chunks = chunk_blocks(_text_of(blocks), self.chunking or ChunkConfig(strategy="none"))
        return blocks, chunks, extract_chunks(chunks, self.config)

    def extractions(self, docs: DataFrame | None = None) -> DataFrame:
        return self._steps(_given(docs, self.docs))[2]

    def merge(self, config: MergeConfig = MergeConfig()) -> Merged:
        return Merged(self, config)

    def run(self, docs: DataFrame | None = None) -> DataFrame:
        """(doc_id, result); several extractions of a document are concatenated."""
        return self.merge().run(docs)

    def _course(self, docs: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
        """The steps' tables for several readers: a Python model has answered for good."""
        blocks, chunks, found = self._steps(docs)
        return blocks, chunks, found if isinstance(self.config.model, NativeModel) else written(found, "answers")

    def events(self, docs: DataFrame | None = None) -> DataFrame:
        return _numbered(_extract_events(*self._course(_given(docs, self.docs))))


@dataclass(frozen=True)
class Merged:
    extracted: Extracted
    config: MergeConfig = MergeConfig()

    def bind(self, docs: DataFrame) -> Merged:
        return replace(self, extracted=self.extracted.bind(docs))

    def run(self, docs: DataFrame | None = None) -> DataFrame:
        docs = _given(docs, self.extracted.docs)
        return merge_extractions(self.extracted.extractions(docs), self.config, docs)

    def events(self, docs: DataFrame | None = None) -> DataFrame:
        docs = _given(docs, self.extracted.docs)
        blocks, chunks, found = self.extracted._course(docs)
        done = merge_extractions(found, self.config, docs)
        last = _event(done, "merging", 3, F.lit(0), F.lit(0), done=F.lit(True), value=_json(done, "result"))
        return _numbered(_extract_events(blocks, chunks, found).unionByName(last))


def _given(docs: DataFrame | None, bound: DataFrame | None) -> DataFrame:
    if docs is None and bound is None:
        raise ValueError("the chain has no input")
    return bound if docs is None else docs


def _text_of(blocks: DataFrame) -> DataFrame:
    """Blocks without those that stand for an error."""
    return blocks.filter(F.col("error").isNull()) if "error" in blocks.columns else blocks


def _json(rows: DataFrame, column: str):
    plain = dict(rows.dtypes)[column]
    nested = plain.startswith(("struct", "array", "map", "variant"))
    return F.to_json(column) if nested else F.col(column).cast("string")


def _event(rows: DataFrame, phase: str, stage: int, index, part, *, done=None, text=None, value=None, error=None) -> DataFrame:
    null = F.lit(None)
    return rows.select(
        "doc_id",
        F.lit(stage).alias("_stage"),
        index.cast("int").alias("_index"),
        part.cast("int").alias("_part"),
        (F.when(error.isNotNull(), F.lit("error")).otherwise(F.lit(phase)) if error is not None else F.lit(phase)).alias("phase"),
        (null.cast("boolean") if done is None else done).alias("done"),
        index.cast("int").alias("index"),
        (null.cast("string") if text is None else text).alias("text"),
        (null.cast("string") if value is None else value).alias("value"),
        (null.cast(ERROR) if error is None else error).alias("error"),
    )


def _block_events(blocks: DataFrame) -> DataFrame:
    return _event(blocks, "normalizing", 0, F.col("block_index"), F.lit(0), text=F.col("text"), error=F.col("error"))


def _extract_events(blocks: DataFrame | None, chunks: DataFrame | None, found: DataFrame) -> DataFrame:
    well = F.col("error").isNull()
    answer = F.struct(F.size("partials").alias("part"), F.when(well, _json(found, "data")).alias("value"), well.alias("done"), F.col("error").alias("error"))
    partials = F.transform("partials", lambda v, k: F.struct(k.alias("part"), v.alias("value"), F.lit(False).alias("done"), F.lit(None).cast(ERROR).alias("error")))
    rows = found.select("doc_id", "index", F.explode(F.concat(partials, F.array(answer))).alias("e"))
    out = _event(rows, "extracting", 2, F.col("index"), F.col("e.part"), done=F.col("e.done"), value=F.col("e.value"), error=F.col("e.error"))
    if chunks is not None:
        out = _event(chunks, "chunking", 1, F.col("index"), F.lit(0), text=F.col("text")).unionByName(out)
    return out if blocks is None else _block_events(blocks).unionByName(out)


def _numbered(events: DataFrame) -> DataFrame:
    """seq: blocks, then chunks, then extractions by chunk, then the merged value."""
    order = Window.partitionBy("doc_id").orderBy("_stage", "_index", "_part")
    return events.withColumn("seq", F.row_number().over(order) - 1).select("doc_id", "seq", "phase", "done", "index", "text", "value", "error")
