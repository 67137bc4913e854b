"""Token counts (operator 8): a two-tier lookup on the map side, without a pre-token shuffle.

Tier one is a compact hash table of the lengths (in tokens) of frequent pre-tokens, broadcast to
all workers: at most ``table_size`` entries in one open-addressing table of 64-bit hashes, looked
up for all pre-tokens of a slice of texts at once, without making Python objects of them.  Which
pre-tokens are frequent is counted over all documents by bounded summaries, one of each task, that
are merged 32 at a time until one is left; pre-tokens are not shuffled.  The choice changes speed
only, never a count.  Tier two is a bounded cache in each worker, filled by encoding what the table
misses with the library.  A pre-token meets a wrong entry with probability entries / 2**64.

Defined cases: null and empty texts have no tokens (and no bytes).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, span_hashes, text_bytes, tidy
from .sentencepieces import default_model

#: Summaries that one task merges, and the longest pre-token that a table takes.
MERGED, LONGEST = 32, 64


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, pre-tokens of each text, starts, ends, bytes) of the pre-tokens of texts."""
    from .pieces import MARK

    mark = MARK.encode()
    marked = [b" " + (t.replace(mark, b" ") if mark in t else t) if t else b"" for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(t) for t in marked])]).astype(np.int64)
    raw = np.frombuffer(b"".join(marked), np.uint8)
    space = raw == 32
    starts = space | (raw == 10)
    starts[1:] &= ~(space[1:] & space[:-1])
    starts[edges[:-1][edges[:-1] < edges[1:]]] = True
    a = np.flatnonzero(starts)
    z = np.append(a[1:], len(raw)) if len(a) else a
    return span_hashes(raw, a, z), np.diff(np.searchsorted(a, edges)), a, z, raw


def hashes_of(units: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(u) for u in units], dtype=np.int64)
    return span_hashes(np.frombuffer(b"".join(units), np.uint8), np.concatenate([[0], ends[:-1]]), ends) if units else np.zeros(0, np.uint64)


class LengthTable:
    """Open addressing: slots hold entry numbers, entries a hash, a length and the pre-token's bytes."""

    def __init__(self, units: list[bytes], lengths: list[int]):
        self.units, self.lengths = b"".join(units), np.array(lengths, np.uint16)
        self.ends = np.cumsum([len(u) for u in units]).astype(np.uint32)
        self.hashes = hashes_of(units)
        self.mask = (1 << max(4, (2 * len(units)).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        for i, h in enumerate(self.hashes.tolist()):
            k = h & self.mask
            while self.slots[k] >= 0:
                k = (k + 1) & self.mask
            self.slots[k] = i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry number of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        left, at = np.arange(len(h)), (h & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            entry = self.slots[at]
            taken = entry >= 0
            left, at, entry = left[taken], at[taken], entry[taken]
            same = self.hashes[entry] == h[left]
            out[left[same]] = entry[same]
            left, at = left[~same], (at[~same] + 1) & self.mask
        return out

    def _unit(self, i: int) -> bytes:
        return self.units[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])]

    def get(self, unit: bytes) -> int | None:
        i = int(self.find(hashes_of([unit]))[0])
        return int(self.lengths[i]) if i >= 0 and self._unit(i) == unit else None

    def items(self):
        return ((self._unit(i), int(n)) for i, n in enumerate(self.lengths))


def _heaviest(seen: dict[bytes, int], most: int) -> list[tuple[bytes, int]]:
    return sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most]


def frequent(docs: DataFrame, table_size: int, per_task: int, text_col: str = "text") -> list[bytes]:
    """The heaviest pre-tokens of all documents, from bounded summaries merged in a tree."""
    schema = "units array<binary>, counts array<long>"

    def packed(top: list[tuple[bytes, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([[u for u, _ in top]], pa.list_(pa.binary())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["units", "counts"])

    def summed(batches):
        seen: dict[int, list] = {}
        for whole in batches:
            for b in slices(whole, "text"):
                h, _, a, z, raw = cut(text_bytes(b.column(0)))
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                # what a slice holds once is not frequent
                kept = (n > 1) & (z[first] - a[first] <= LONGEST)
                for key, i, c in zip(u[kept].tolist(), first[kept].tolist(), n[kept].tolist()):
                    if key in seen:
                        seen[key][1] += c
                    else:
                        seen[key] = [raw[a[i] : z[i]].tobytes(), c]
                if len(seen) > 32 * per_task:  # heavy hitters stay, the tail goes
                    seen = dict(sorted(seen.items(), key=lambda x: -x[1][1])[: 8 * per_task])
        yield packed(_heaviest(dict(map(tuple, seen.values())), per_task))

    def merged(batches):
        seen: dict[bytes, int] = {}
        for b in batches:
            for units, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for u, n in zip(units, counts):
                    seen[u] = seen.get(u, 0) + n
                seen = dict(_heaviest(seen, 4 * table_size)) if len(seen) > 8 * table_size else seen
        yield packed(_heaviest(seen, table_size))

    rows = docs.select(docs[text_col].alias("text"))
    parts = rows.rdd.getNumPartitions()
    rows = rows.mapInArrow(tidy(summed), schema)
    while parts > 1:
        parts = -(-parts // MERGED)
        rows = rows.repartition(parts).mapInArrow(tidy(merged), schema)
    got = rows.collect()  # one summary at most
    return [bytes(u) for r in got for u in r.units][:table_size]


class Counter:
    """Numbers of tokens of whole texts; one per task."""

    def __init__(self, table: LengthTable, library, cache: int):
        self.table, self.library, self.cache = table, library, cache
        self.hashes, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        h, per_text, a, z, raw = cut(texts)
        entry = self.table.find(h)
        n = np.zeros(len(h), np.int64)
        hit = entry >= 0
        n[hit] = self.table.lengths[entry[hit]]
        missed = np.flatnonzero(~hit)
        if len(missed):
            u, first, inverse = np.unique(h[missed], return_index=True, return_inverse=True)
            place = np.searchsorted(self.hashes, u)
            at = np.minimum(place, max(0, len(self.hashes) - 1))
            known = self.hashes[at] == u if len(self.hashes) else np.zeros(len(u), bool)
            lengths = np.zeros(len(u), np.int64)
            lengths[known] = self.lengths[at[known]]
            new = np.flatnonzero(~known)
            spans = missed[first[new]]
            lengths[new] = self.library.lengths([raw[x:y].tobytes() for x, y in zip(a[spans].tolist(), z[spans].tolist())])
            kept = new[: max(0, self.cache - len(self.hashes))]
            self.hashes, self.lengths = np.insert(self.hashes, place[kept], u[kept]), np.insert(self.lengths, place[kept], lengths[kept])
            n[missed] = lengths[inverse]
        total = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(per_text)
        return total[ends] - total[ends - per_text]


def token_counts(docs: DataFrame, model: str | None = None, *, limit: int = 4096, table_size: int = 16_384, per_task: int = 8_192, cache: int = 250_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, as the library counts."""
    from .pieces import Library

    model = model or default_model()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    units = frequent(docs, table_size, per_task, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(LengthTable(units, Library(model).lengths(units)))

    def run(batches):
        from .pieces import Library

        counter = Counter(sent.value, Library(model), cache)
        for whole in batches:
            for b in slices(whole, "text"):
                texts = text_bytes(b.column(1))
                n = counter.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
