"""OCR backends: objects with ``name`` and ``parse(data, *, filename, mime_type) -> text``."""

from .fake import FakeOcr
from .http_ocr import HttpOcr

__all__ = ["FakeOcr", "HttpOcr"]
