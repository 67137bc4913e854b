"""Prompts of chunks: one window and a concatenation, no Python."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ExtractConfig

#: Characters of the chunk before that a prompt shows, whatever the chunking's own context.
CONTEXT = 500

# The fixed lines of a prompt.
EXAMPLES, QUESTION, ANSWER = "Examples:", "Q: ", "A: "
PREVIOUS, DOCUMENT = "[Previous context]: ", "[Document]: "
CLOSING = {
    "schema": "Extract the data according to the schema.",
    "markdown": "Convert the document content above into clean, well-structured markdown.",
}

#: System prompt of markdown output, if none is given.
MARKDOWN_SYSTEM = "\n".join(
    [
        "Turn the document you are given into clean markdown.",
        "Keep its structure and order: headings by level, lists as lists, tables as markdown tables, emphasis and code as such.",
        "Mend what scanning has plainly broken, change nothing else, and answer with the markdown alone.",
    ]
)


def system_prompt(config: ExtractConfig) -> str | None:
    return config.system_prompt or (MARKDOWN_SYSTEM if config.output == "markdown" else None)


def with_prompts(chunks: DataFrame, config: ExtractConfig) -> DataFrame:
    """``chunks`` with ``prompt`` and ``system``.

    The context is the chunk before it of the same format, file name and sheet."""
    opening = [config.prompt]
    if config.examples:
        opening += ["", EXAMPLES]
        for e in config.examples:
            opening += [QUESTION + str(e["input"]), ANSWER + json.dumps(e["output"], separators=(",", ":"), ensure_ascii=False), ""]
    s = F.col("source")
    same = Window.partitionBy("doc_id", s["format"], F.coalesce(s["filename"], F.lit("unknown")), F.coalesce(s["sheet"], F.lit(""))).orderBy("index")
    previous = F.nullif(F.lag("text").over(same), F.lit(""))
    context = F.when(previous.isNotNull(), F.concat(F.lit("\n\n" + PREVIOUS), F.right(previous, F.lit(CONTEXT))))
    prompt = F.concat(
        F.lit("\n".join(opening)),
        F.coalesce(context, F.lit("")),
        F.lit("\n\n" + DOCUMENT),
        F.coalesce("text", F.lit("")),
        F.lit("\n\n" + CLOSING[config.output]),
    )
    return chunks.withColumn("prompt", prompt).withColumn("system", F.lit(system_prompt(config)).cast("string"))
