"""Settings of the four steps, as immutable values with the documented defaults."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from .schemas import FORMATS


@dataclass(frozen=True)
class NormalizeConfig:
    """``sheets``: 'all', 'first' (the sheet whose id is 1) or ids from 1.
    ``on_error``: 'throw' fails the query, 'skip' leaves an error beside the document."""

    type: str | None = None
    ocr: Any = None
    sheets: str | Sequence[int] = "all"
    preserve_tables: bool = True
    include_headers: bool = True
    pdf_text: Callable[[bytes], str] | None = None
    escape_pipes: bool = False
    on_error: str = "throw"

    def __post_init__(self):
        if self.type is not None and self.type not in FORMATS:
            raise ValueError(f"unknown format {self.type!r}")
        if self.on_error not in ("throw", "skip"):
            raise ValueError("on_error is 'throw' or 'skip'")


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str | Callable = "auto"
    max_chars: int = 8000
    context_window: int = 500
    overlap: int = 200

    def __post_init__(self):
        if self.max_chars < 1 or self.overlap < 0 or self.context_window < 0:
            raise ValueError("max_chars must be positive, overlap and context_window not negative")
        if self.strategy == "sliding" and self.overlap >= self.max_chars:
            raise ValueError("windows never end unless overlap is less than max_chars")


@dataclass(frozen=True)
class ExtractConfig:
    """``output``: 'schema' or 'markdown'.  ``model``: see ``operators.extract``.
    ``on_chunk_error``: 'skip', 'throw' or a function (error, chunk)."""

    output: str
    prompt: str
    model: Any = None
    schema: Mapping | None = None
    vision_model: Any = None
    examples: Sequence[Mapping] = ()
    system_prompt: str | None = None
    generation_options: Mapping[str, Any] = field(default_factory=dict)
    passes: int = 1
    concurrency: int = 3
    on_chunk_error: str | Callable = "skip"

    def __post_init__(self):
        if self.output not in ("schema", "markdown"):
            raise ValueError("output is 'schema' or 'markdown'")
        if self.output == "schema" and self.schema is None:
            raise ValueError("schema output needs a schema")
        if self.model is None and self.vision_model is None:
            raise ValueError("a model is needed")
        if self.concurrency < 1 or self.passes < 1:
            raise ValueError("concurrency and passes are at least 1")


@dataclass(frozen=True)
class MergeConfig:
    """``strategy``: 'concat', 'first', 'dedupe' or a function of a document's extractions.
    ``dedupe_key``: a function from an item column to a key column."""

    strategy: str | Callable = "concat"
    dedupe_key: Callable | None = None
    dedupe_winner: str = "first"
    strings: str = "join"

    def __post_init__(self):
        if not callable(self.strategy) and self.strategy not in ("concat", "first", "dedupe"):
            raise ValueError(f"unknown merge strategy {self.strategy!r}")
        if self.dedupe_winner not in ("first", "last") or self.strings not in ("join", "first"):
            raise ValueError("dedupe_winner is 'first' or 'last', strings 'join' or 'first'")
