"""Chunking: blocks to chunks, by one of seven strategies.

Blocks are cut independently of each other, which is narrow; what depends on the document's order
(index, total, context) is window functions over one exchange by doc_id.  The context of a chunk is
the end of the chunk before it, so it needs no state while cutting.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.text import SPACE, tail
from ..schemas import CHUNKS, PIECES

#: Documents of at most so many characters stay whole under 'auto', which looks at the first
#: ``AUTO_SAMPLE`` characters of longer ones.
AUTO_WHOLE, AUTO_SAMPLE = 8000, 10_000

_PASS = ("none", "page")
_SPLIT = ("sentence", "structural", "row")
_COLUMNS = ["doc_id", "index", "total", "text", "context", "char_offset", "block_index", "source"]


def _pieces(most: int):
    """(strategy, text) -> pieces, in Arrow batches."""

    @F.arrow_udf(PIECES)
    def run(strategy: pa.Array, text: pa.Array) -> pa.Array:
        from ..functions.splitters import SPLITTERS

        kind = pa.list_(pa.struct([("text", pa.string()), ("off", pa.int32())]))
        out = []
        for s, t in zip(strategy.to_pylist(), text):
            t = t.as_py()
            out.append([] if t is None else [{"text": p, "off": o} for p, o in SPLITTERS[s](t, most)])
        return pa.array(out, kind)

    return run


def _windows(text: Column, most: int, overlap: int) -> Column:
    """Sliding windows in closed form: one every most - overlap characters until the end is reached."""
    n, step = F.length(text), most - overlap
    last = F.greatest(F.lit(0), F.ceil((n - most) / F.lit(step)).cast("int"))

    def one(k: Column) -> Column:
        off = (k * step).cast("int")
        before = F.substring(text, F.greatest(off - overlap, F.lit(0)) + 1, F.least(off, F.lit(overlap)))
        return F.struct(
            F.substring(text, off + 1, F.lit(most)).alias("text"),
            off.alias("off"),
            F.when(off > 0, F.nullif(before, F.lit(""))).alias("context"),
        )

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<struct<text:string,off:int,context:string>>"))


def auto_strategy(blocks: DataFrame) -> DataFrame:
    """``blocks`` with a column ``strategy`` chosen for each document.

    The sample is the document's blocks joined by line feeds; each block tests its own part of it."""
    doc = Window.partitionBy("doc_id")
    before = doc.orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.length("text"), F.lit(0))
    out = blocks.withColumn("_at", F.coalesce(F.sum(size + 1).over(before), F.lit(0)))
    room = F.greatest(F.lit(0), AUTO_SAMPLE - F.col("_at")).cast("int")
    part = F.substring(F.concat("text", F.lit("\n")), F.lit(1), room)
    # the line feed behind the last block isn't there, and ends nothing that matters
    table = part.rlike(r"(?m)^\|.+\|$")
    heading = part.rlike(f"(?m)^#{{1,6}}[{SPACE}]")
    out = out.withColumn("_table", F.coalesce(table, F.lit(False))).withColumn("_heading", F.coalesce(heading, F.lit(False)))
    pages = (F.count("*").over(doc) > 1) & F.min(F.col("source.page").isNotNull()).over(doc)
    strategy = (
        F.when(F.sum(size).over(doc) <= AUTO_WHOLE, "none")
        .when(F.max("_table").over(doc), "row")
        .when(F.max("_heading").over(doc), "structural")
        .when(pages, "page")
        .otherwise("sentence")
    )
    return out.withColumn("strategy", strategy).drop("_at", "_table", "_heading")


def numbered(pieces: DataFrame, context: Column | None = None) -> DataFrame:
    """Index, total and (unless given) context of pieces ordered by block and place."""
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("block_index", "pos")
    return pieces.withColumn("index", F.row_number().over(order) - 1).withColumn("total", F.count("*").over(doc).cast("int")).withColumn("context", F.col("context") if context is None else context).select(*_COLUMNS)


def _custom(blocks: DataFrame, function: Callable) -> DataFrame:
    """``function(pandas blocks of a document, in order) -> pandas chunks``, taken as they are."""

    def run(frame):
        return function(frame.sort_values("block_index"))[_COLUMNS]

    return blocks.groupBy("doc_id").applyInPandas(run, CHUNKS)


def chunk(blocks: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of all blocks (the CHUNKS table)."""
    if callable(config.strategy):
        return _custom(blocks, config.strategy)
    order = Window.partitionBy("doc_id").orderBy("block_index", "pos")
    before = tail(F.lag("text").over(order), config.context_window)
    if config.strategy == "sliding":
        made = blocks.select("doc_id", "block_index", "source", F.posexplode(_windows(F.col("text"), config.max_chars, config.overlap)).alias("pos", "p"))
        return numbered(made.select("doc_id", "block_index", "pos", "p.text", F.col("p.context").alias("context"), F.col("p.off").alias("char_offset"), "source"))
    if config.strategy in _PASS:
        made = blocks.select("doc_id", "block_index", F.lit(0).alias("pos"), "text", F.lit(0).alias("char_offset"), "source")
        return numbered(made, F.lit(None).cast("string"))
    if config.strategy in _SPLIT:
        routed = blocks.withColumn("strategy", F.lit(config.strategy))
    else:  # anything else is auto
        routed = auto_strategy(blocks)
    cut = F.col("strategy").isin(*_SPLIT)
    # blocks are read once: the splitters get no text of those that stay whole
    whole = F.array(F.struct(F.col("text").alias("text"), F.lit(0).alias("off")))
    pieces = F.when(cut, _pieces(config.max_chars)("strategy", F.when(cut, F.col("text")))).otherwise(whole)
    split = routed.withColumn("pieces", pieces)
    made = split.select("doc_id", "block_index", "source", "strategy", F.posexplode("pieces").alias("pos", "p"))
    made = made.select("doc_id", "block_index", "pos", "p.text", F.col("p.off").alias("char_offset"), "source", "strategy")
    if config.strategy in _SPLIT:
        return numbered(made, before)
    return numbered(made, F.when(F.col("strategy").isin(*_SPLIT), before))
