"""A backend for tests: says what it got."""

from __future__ import annotations


class FakeOcr:
    name = "fake"

    def __init__(self, text: str | None = None):
        self.text = text

    def parse(self, data: bytes, *, filename: str | None = None, mime_type: str | None = None) -> str:
        return self.text if self.text is not None else f"{len(data)} bytes of {filename or 'unnamed'} ({mime_type or 'unknown'})"
