"""Error classes; every one knows the phase it belongs to."""

from __future__ import annotations


class DocloomError(Exception):
    phase = "unknown"

    def __init__(self, message: str, phase: str | None = None):
        super().__init__(message)
        if phase:
            self.phase = phase


class NormalizeError(DocloomError):
    phase = "normalize"

    def __init__(self, message: str, format: str = "unknown"):
        super().__init__(message)
        self.format = format


class ChunkError(DocloomError):
    phase = "chunk"

    def __init__(self, message: str, block: object = None):
        super().__init__(message)
        self.block = block


class ExtractionError(DocloomError):
    phase = "extract"

    def __init__(self, message: str, chunk: object = None, cause: BaseException | None = None):
        super().__init__(message)
        self.chunk, self.cause = chunk, cause
