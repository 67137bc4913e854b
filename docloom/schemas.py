"""Tables that pass between the steps.

``docs -> blocks -> chunks -> prompts -> extractions -> results``; ``events`` is their union.
Order is data: ``block_index`` within a document, ``index`` over its chunks, ``seq`` over events.
Lengths and offsets count code points.
"""

from __future__ import annotations

SOURCE = "struct<format:string,page:int,sheet:string,filename:string>"
ERROR = "struct<class:string,message:string,phase:string,format:string>"
DOCS = "doc_id long, content binary, text string, is_string boolean, type_hint string, filename string, mime_type string"
BLOCKS = f"doc_id long, block_index int, text string, is_visual boolean, source {SOURCE}"
CHUNKS = f"doc_id long, index int, total int, text string, context string, char_offset int, block_index int, source {SOURCE}"
PIECES = "array<struct<text:string,off:int>>"

FORMATS = ("auto", "pdf", "image", "csv", "html", "xlsx", "docx", "email", "text", "markdown")
