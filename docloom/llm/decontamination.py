"""Benchmark decontamination (operator 6): one Aho-Corasick automaton over normalised test items.

Normalisation lower-cases A-Z and keeps words of digits, letters and everything beyond ASCII.
It works on UTF-8 bytes with one translation table: all separators are single bytes below 0x80,
so bytes of longer characters pass unchanged.  The words of a text, joined by single spaces with
a space at either end, are scanned once; each window of an item (``window`` consecutive words, or
the whole item if it has fewer) is a pattern with a space at either end, so matches start and end
at words.  Match positions are mapped to word numbers, and by ``spans`` to the original text.

The benchmark is broadcast and made an automaton once in each worker.  An automaton takes about 48
bytes a state and a benchmark has up to ten states a byte (each word is in ten windows), so it is
measured first and cut into blocks of at most ``block_bytes`` of text, a quarter of a gigabyte of
automaton each.  One block is the normal case; with more, each block is one narrow pass over the
documents, only hits are written, and they are put together by the texts' digests.

Defined cases: null and empty texts have no words, are never hit, and as items give no windows.
Items that repeat the same words are all reported.  A repeated doc_id is one output row for each
input row.
"""

from __future__ import annotations

import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, fresh, pick, slices, text_bytes, tidy


def _table() -> bytes:
    out = bytearray(range(256))
    for i in range(128):
        c = chr(i)
        out[i] = ord(c.lower()) if c.isascii() and c.isalnum() else 32
    return bytes(out)


_NORMAL = _table()
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows_of(words: list[bytes], window: int) -> set[bytes]:
    if not words:
        return set()
    n = max(1, len(words) - window + 1)
    return {b" " + b" ".join(words[i : i + window]) + b" " for i in range(n)}


class Windows:
    """The automaton: for each window, the items that hold it and its length in words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        import ahocorasick

        found: dict[bytes, set[int]] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            for w in windows_of(words_of(text), window):
                found.setdefault(w, set()).add(number[name])
        self.automaton = ahocorasick.Automaton()
        for w, who in found.items():
            self.automaton.add_word(w.decode("latin-1"), (len(w), w.count(b" ") - 1, tuple(sorted(who))))
        self.empty = not found
        if found:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word intervals [a, b) that windows cover, merged; numbers of the items."""
        if self.empty or not words:
            return [], set()
        text = b" " + b" ".join(words) + b" "
        ends, lengths, items = [], [], set()
        for end, (chars, n, who) in self.automaton.iter(text.decode("latin-1")):
            ends.append(end - chars + 2)  # where the first word starts
            lengths.append(n)
            items.update(who)
        if not ends:
            return [], items
        starts = np.cumsum([1, *(len(w) + 1 for w in words[:-1])])
        first = np.searchsorted(starts, ends)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(zip(first.tolist(), (first + lengths).tolist())):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


def spans(text: str, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets in the original text of covered word intervals."""
    raw = text.encode()
    at = [(m.start(), m.end()) for m in _WORD.finditer(raw.translate(_NORMAL))]
    # characters before a byte offset: bytes that don't continue a character
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[at[a][0]]), int(chars[at[b - 1][1]])) for a, b in covered]


def blocks(benchmark: DataFrame, block_bytes: int, id_col: str = "item_id", text_col: str = "text"):
    """The items in blocks of bounded size, read one block at a time.

    The size is measured first; only if it exceeds the bound are items dealt over blocks by id."""
    items = pick(benchmark, i=id_col, t=text_col).filter("t is not null").withColumn("i", F.coalesce(F.col("i").cast("string"), F.lit("")))
    total = items.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t.encode()) for r in part.collect()]


#: The automaton of the latest block in this worker, by its name and window.
_latest: dict[tuple[str, int], Windows] = {}


def _windows(sent, window: int) -> Windows:
    key = (sent.value[0], window)
    if key not in _latest:
        _latest.clear()  # the one before goes first
        _latest[key] = Windows(list(sent.value[1]), window)
    return _latest[key]


def _sent(spark, block: list[tuple[str, bytes]]):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, tuple(block)))


def _scanned(rows: DataFrame, block: list[tuple[str, bytes]], window: int, columns: list[str], keep_spans: bool) -> DataFrame:
    """``columns`` of each row, with its number of words and what one block's windows hit."""
    sent = _sent(rows.sparkSession, block)
    text_at, places = rows.columns.index("text"), [rows.columns.index(c) for c in columns]
    kinds = dict(rows.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in columns) + "n_words long, covered array<struct<start:int,end:int>>, items array<string>, spans array<struct<start:int,end:int>>"
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        w = _windows(sent, window)
        for whole in batches:
            for b in slices(whole, "text"):
                texts = text_bytes(b.column(text_at))
                words = [words_of(t) for t in texts]
                found = [w.scan(ws) for ws in words]
                as_pairs = lambda xs: pa.array([[{"start": x, "end": y} for x, y in c] for c in xs], pair)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(k) for k in places),
                        pa.array([len(ws) for ws in words], pa.int64()),
                        as_pairs([c for c, _ in found]),
                        pa.array([[w.names[i] for i in sorted(who)] for _, who in found], pa.list_(pa.string())),
                        as_pairs([spans(t.decode(), c) if c and keep_spans else [] for t, (c, _) in zip(texts, found)]),
                    ],
                    [*columns, "n_words", "covered", "items", "spans"],
                )

    return rows.mapInArrow(tidy(run), schema)


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, id_col: str, text_col: str, item_col: str, keep_spans: bool) -> DataFrame:
    """(doc_id, n_words, covered, items, spans) of every row, over all blocks."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    parts = blocks(benchmark, block_bytes, item_col, text_col)
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return _scanned(rows, first, window, ["doc_id"], keep_spans)
    keyed = rows.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    work, lists, found = Tables(docs.sparkSession, "hits"), ("covered", "items", "spans"), None
    for k, block in enumerate(chain([first, second], parts)):
        # equal texts have equal hits, so the first will do
        made = _scanned(keyed, block, window, ["key"], keep_spans).filter(F.size("items") > 0).groupBy("key").agg(*[F.first(c).alias(c) for c in lists])
        made = work.keep(made, f"block{k}")
        found = made if found is None else found.union(made)
    found = found.groupBy(F.col("key").alias("of")).agg(
        F.array_sort(F.flatten(F.collect_list("covered"))).alias("covered"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")
    )
    counted = _scanned(keyed, [], window, ["doc_id", "key"], False).select("doc_id", "key", "n_words")
    return counted.join(found, F.col("key") == F.col("of"), "left").select("doc_id", "n_words", "covered", "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, *, block_bytes: int = 512 << 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", keep_spans: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    With ``keep_spans`` also the covered spans of the original text (code points, end exclusive)."""
    h = _hits(docs, benchmark, window, block_bytes, id_col, text_col, item_col, keep_spans)
    # intervals in order, counted up to where the ones before have reached
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc, x):
        return F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["end"]).alias("end"))

    n_hit = F.coalesce(F.aggregate("covered", none, add)["n"], F.lit(0)).cast("long")
    names = F.array_join(F.array_sort(F.coalesce("items", F.array().cast("array<string>"))), ",")
    out = [F.col("doc_id"), F.col("n_words"), n_hit.alias("n_hit"), F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")]
    return h.select(*out, *(["spans"] if keep_spans else []))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, *, block_bytes: int = 512 << 10) -> DataFrame:
    """The rows of ``docs`` (same columns) that hold no window of any item.

    One block is a narrow pass; of more, the digests of the texts they hit are put together."""
    parts = blocks(benchmark, block_bytes)
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return _clean(docs, first, window)
    key, of = fresh(docs, "key", "of")
    keyed = docs.select(docs["text"].alias("text"), F.sha2(docs["text"], 256).alias("key"))
    work, found = Tables(docs.sparkSession, "contaminated"), None
    for k, block in enumerate(chain([first, second], parts)):
        made = work.keep(_scanned(keyed, block, window, ["key"], False).filter(F.size("items") > 0).select("key").distinct(), f"block{k}")
        found = made if found is None else found.union(made)
    tagged = docs.withColumn(key, F.sha2(docs["text"], 256))
    return tagged.join(found.distinct().withColumnRenamed("key", of), F.col(key) == F.col(of), "left_anti").drop(key)


def _clean(docs: DataFrame, block: list[tuple[str, bytes]], window: int) -> DataFrame:
    sent = _sent(docs.sparkSession, block)

    def run(batches):
        w = _windows(sent, window)
        for whole in batches:
            for b in slices(whole, "text"):
                clean = [not w.scan(words_of(t))[0] for t in text_bytes(b.column(b.schema.get_field_index("text")))]
                yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
