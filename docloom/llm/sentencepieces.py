"""SentencePiece encoding and decoding (operator 3): shared-prefix Viterbi, see ``pieces``.

A narrow Arrow pass: each task takes about eight megabytes of text at a time, encodes their
distinct marked words in sorted order and puts the documents together from them.  The memo of
words and the memo of fitting neighbours are bounded; nothing is shuffled.

Defined cases: null and empty text give no tokens and decode to the empty text.  A literal word
mark in a text is a space to the vocabulary, so it decodes to a space.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_bytes, tidy

MODEL = "piece_bpe_32k.model"

_vocabularies: dict[str, object] = {}


def _vocabulary(path: str):
    from .pieces import Vocabulary

    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode(docs: DataFrame, model: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every row."""
    model = model or default_model()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches):
        v = _vocabulary(model)
        for whole in batches:
            for b in slices(whole, "text"):
                ids = v.encode(text_bytes(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "token_ids"])

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, token_ids array<int>")


def decode(encoded: DataFrame, model: str | None = None, *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, text) from ids."""
    model = model or default_model()
    rows = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("token_ids"))

    def run(batches):
        v = _vocabulary(model)
        for b in batches:
            texts = [v.decode(x or ()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, model: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: (doc_id, n_chars, n_tokens, ids_crc32, decoded_sha256, exact).

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers; exact tells whether the
    decoded text is the input (with marks as spaces)."""
    model = model or default_model()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches):
        from .pieces import _MARK_BYTES

        v = _vocabulary(model)
        for whole in batches:
            for b in slices(whole, "text"):
                texts = text_bytes(b.column(1))
                ids = v.encode(texts)
                back = [v.decode(x) for x in ids]
                same = [t == r or t.replace(_MARK_BYTES, b" ") == r for t, r in zip(texts, back)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array([len(r.decode("utf-8", "replace")) for r in back], pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(r).hexdigest() for r in back], pa.string()),
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "n_chars", "n_tokens", "ids_crc32", "decoded_sha256", "exact"],
                )

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n_chars long, n_tokens long, ids_crc32 long, decoded_sha256 string, exact boolean")

