"""A document parsing service over HTTP (multipart POST to /file_parse)."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
import uuid


class HttpOcr:
    name = "http"

    def __init__(self, url: str, table_enable: bool = True, formula_enable: bool = True, timeout: float = 600):
        self.url, self.table_enable, self.formula_enable, self.timeout = url.rstrip("/"), table_enable, formula_enable, timeout

    def fields(self) -> dict[str, str]:
        out = {"parse_method": "auto"}
        if self.table_enable:
            out["table_enable"] = "true"
        if self.formula_enable:
            out["formula_enable"] = "true"
        return out

    def body(self, data: bytes, filename: str | None, mime_type: str | None) -> tuple[bytes, str]:
        edge = uuid.uuid4().hex
        parts = [f'--{edge}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in self.fields().items()]
        head = f'--{edge}\r\nContent-Disposition: form-data; name="files"; filename="{filename or "document.pdf"}"\r\nContent-Type: {mime_type or "application/octet-stream"}\r\n\r\n'
        return b"".join([*parts, head.encode(), data, f"\r\n--{edge}--\r\n".encode()]), f"multipart/form-data; boundary={edge}"

    @staticmethod
    def text_of(answer: dict) -> str:
        """The first text among the results, else the answer's own."""
        results = answer.get("results") or answer
        for x in results.values() if isinstance(results, dict) else results:
            if isinstance(x, dict) and x.get("md_content"):
                return x["md_content"]
        if answer.get("md_content"):
            return answer["md_content"]
        raise RuntimeError("the answer holds no text")

    def parse(self, data: bytes, *, filename: str | None = None, mime_type: str | None = None) -> str:
        body, kind = self.body(data, filename, mime_type)
        request = urllib.request.Request(f"{self.url}/file_parse", body, {"Content-Type": kind}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return self.text_of(json.load(answer))
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"the service answered {e.code}: {e.read()[:200]!r}") from e
