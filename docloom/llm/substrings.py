"""Substring dedup (operator 4): repeated windows by level-wise doubling.

A word goes if it lies in a window of ``window`` words whose word sequence also starts earlier.
Counting all windows of full length would shuffle a row for each word of the corpus, so lengths
are doubled level by level (5, 10, 20 words): a window can only repeat if every shorter run in it
repeats, so only windows whose run at one length was repeated are extended to twice that length,
until none are left or full length is reached.

At a level each surviving window stands for itself by one of its runs, the one with the least
hash (leftmost of equals): equal windows choose equal runs, and neighbouring windows mostly share
theirs, so about an eighth of the rows travel at the first level.  A run seen twice in one slice of a task is
known to repeat there; otherwise one row (hash, document) goes to the hash's partition, so a run
that a third of all documents hold gives a row a slice, not a row a document.  At full length the
first occurrence is kept: a slice marks what it can see itself and sends its own first; a rank over
those (96-bit hashes) finds the others.  Texts are shuffled once, by id: all levels and the last
pass read that one exchange.

Defined cases: null and empty texts have no words; texts shorter than a window lose none; rows with
one doc_id are one document (equal rows give equal output rows, none makes the other a repeat);
rows without id are one document, before all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_words, join_hashes, mix64, number_lists, slices, text_bytes, tidy, window_hashes

_NO_ID = -(2**63)
_SALT = np.uint64(0xA0761D6478BD642F)


def sliding_argmin(a: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value in each run of ``width`` values, the leftmost of equals."""
    if len(a) < width:
        return np.zeros(0, np.int64)
    v, p, span = a, np.arange(len(a)), 1

    def step(v, p, by):
        take = v[by:] < v[:-by]
        return np.where(take, v[by:], v[:-by]), np.where(take, p[by:], p[:-by])

    while span * 2 <= width:
        v, p = step(v, p, span)
        span *= 2
    if width > span:
        v, p = step(v, p, width - span)
    return p


class Slice:
    """The words of a slice of documents in one array, with what windows need."""

    def __init__(self, texts: pa.Array, window: int):
        self.h, sizes = hashed_words(texts)
        self.first = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.window, self.known = window, {}
        # starts of windows that end inside their document
        n = max(0, len(self.h) - window + 1)
        start = np.arange(n)
        self.start = start[self.doc[:n] == self.doc[window - 1 : window - 1 + n]]

    def runs(self, length: int) -> np.ndarray:
        """Hashes of all runs of ``length`` words; those of the next length are joined from them."""
        if length not in self.known:
            half = self.known.get(length // 2) if length % 2 == 0 else None
            n = length // 2
            self.known = {length: window_hashes(self.h, length) if half is None else join_hashes(half[: max(0, len(half) - n)], half[n:])}
        return self.known[length]

    def anchors(self, length: int) -> np.ndarray:
        """For each window the place of the run that stands for it; ascends within a document."""
        return sliding_argmin(self.runs(length), self.window - length + 1)[self.start]

    def survivors(self, length: int, repeated: list[np.ndarray]) -> None:
        """Keep the windows whose run at ``length`` is among the repeated ones of their document."""
        if not len(self.start):
            return
        at = self.anchors(length)
        first = np.flatnonzero(np.diff(at, prepend=-1))  # neighbours share their run
        one = at[first]
        doc = np.repeat(np.arange(len(repeated)), [len(r) for r in repeated]).astype(np.uint64)
        known = join_hashes(doc, np.concatenate([*repeated, np.zeros(0, np.uint64)]))
        stays = np.isin(join_hashes(self.doc[one].astype(np.uint64), self.runs(length)[one]), known)
        self.start = self.start[np.repeat(stays, np.diff(first, append=len(at)))]


def _ids(column) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), np.int64)


def _repeated(keys: pa.Array, packs: pa.Array) -> list[np.ndarray]:
    """Repeated runs of each document: single hashes and packed ones."""
    return [np.concatenate([k.view(np.uint64), *(np.frombuffer(x, np.uint64) for x in p or ())]) for k, p in zip(number_lists(keys, np.int64), packs.to_pylist())]


def _level(rows: DataFrame, length: int, shorter: int | None, window: int) -> DataFrame:
    """(did, keys, packs): for each document its runs of ``length`` that repeat somewhere.

    ``rows`` has (did, text), and from the second level on keys and packs of the level before."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", 16 << 20):
                s = Slice(b.column(1), window)
                did = _ids(b.column(0))
                if shorter:
                    s.survivors(shorter, _repeated(b.column(2), b.column(3)))
                if not len(s.start):
                    continue
                at = s.anchors(length)
                at = at[np.flatnonzero(np.diff(at, prepend=-1))]
                value, doc = s.runs(length)[at], s.doc[at]
                u, inverse, count = np.unique(value, return_inverse=True, return_counts=True)
                often = count[inverse] >= 2
                single = ~often
                # packed: a document's runs that this slice saw twice; they need no partner
                order = np.argsort(doc[often], kind="stable")
                v, d = value[often][order], doc[often][order]
                cut = np.flatnonzero(np.diff(d, prepend=-1))
                packed = [np.unique(x).tobytes() for x in np.split(v, cut[1:])] if len(v) else []
                owners = did[d[cut]] if len(v) else np.zeros(0, np.int64)
                shown = u[count >= 2]
                n1, n2, n3 = int(single.sum()), len(shown), len(packed)
                key = np.concatenate([value[single].view(np.int64), shown.view(np.int64), mix64(owners.view(np.uint64) + _SALT).view(np.int64)])
                who = np.concatenate([did[doc[single]], np.zeros(n2, np.int64), owners])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key),
                        pa.array(who, mask=np.concatenate([np.zeros(n1, bool), np.ones(n2, bool), np.zeros(n3, bool)])),
                        pa.array(np.concatenate([np.ones(n1, np.int32), np.full(n2 + n3, 2, np.int32)])),
                        pa.concat_arrays([pa.nulls(n1 + n2, pa.binary()), pa.array(packed, pa.binary())]),
                    ],
                    ["k", "did", "n", "pack"],
                )

    sent = rows.mapInArrow(tidy(run), "k long, did long, n int, pack binary")
    total = F.sum("n").over(Window.partitionBy("k"))
    kept = sent.withColumn("total", total).filter("total >= 2 and did is not null")
    return kept.groupBy("did").agg(F.collect_list(F.when(F.col("pack").isNull(), F.col("k"))).alias("keys"), F.collect_list("pack").alias("packs"))


def _intervals(starts: np.ndarray) -> bytes:
    """Sorted window starts as runs (first, last), packed."""
    cut = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
    return np.stack([starts[cut], starts[np.append(cut[1:] - 1, len(starts) - 1)]], 1).astype("<i4").tobytes()


def _later(rows: DataFrame, shorter: int | None, window: int) -> DataFrame:
    """(did, marks): of each document the starts of windows that also start earlier."""

    def run(batches):
        import xxhash

        for whole in batches:
            for b in slices(whole, "text", 16 << 20):
                b = b.take(pa.array(np.argsort(_ids(b.column(0)), kind="stable")))
                texts = text_bytes(b.column(1))
                s = Slice(b.column(1), window)
                did = _ids(b.column(0))
                if shorter:
                    s.survivors(shorter, _repeated(b.column(2), b.column(3)))
                if not len(s.start):
                    continue
                at, doc = s.start, s.doc[s.start]
                n = window // 2
                left, right = (s.runs(n)[at], s.runs(n)[at + n]) if window % 2 == 0 else (s.h[at], s.runs(window)[at])
                one = join_hashes(left, right)
                two = (join_hashes(right, left) >> np.uint64(33)).astype(np.int32)
                pos, who = at - s.first[doc], did[doc]
                # windows stand in the order of ids and places, which stable sorting keeps
                order = np.argsort(one, kind="stable")
                o, t = one[order], two[order]
                same = o[1:] == o[:-1]
                if (same & (t[1:] != t[:-1])).any():
                    order = np.lexsort((two, one))
                    o, t = one[order], two[order]
                    same = o[1:] == o[:-1]
                new = np.ones(len(order), bool)
                new[1:] = ~same | (t[1:] != t[:-1])
                lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                # the first of its sequence in this slice; equal rows of one document are both first
                first = np.zeros(len(order), bool)
                first[order] = (who[order] == who[lead]) & (pos[order] == pos[lead])
                text_id = np.array([xxhash.xxh32_intdigest(x) for x in texts], np.uint32).view(np.int32)
                marked, owners = [], []
                later = np.flatnonzero(~first)
                if len(later):
                    cut = np.flatnonzero(np.diff(doc[later], prepend=-1))
                    marked = [_intervals(x) for x in np.split(pos[later], cut[1:])]
                    owners = doc[later][cut]
                owners = np.array(owners, np.int64)
                f = np.flatnonzero(first)
                n, m = len(f), len(marked)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([one[f].view(np.int64), mix64(did[owners].view(np.uint64) + _SALT).view(np.int64)])),
                        pa.array(np.concatenate([two[f], np.full(m, -1, np.int32)])),
                        pa.array(np.concatenate([who[f], did[owners]])),
                        pa.array(np.concatenate([text_id[doc[f]], text_id[owners]])),
                        pa.array(np.concatenate([pos[f], np.full(m, -1)]).astype(np.int32)),
                        pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(marked, pa.binary())]),
                    ],
                    ["h1", "h2", "did", "text_id", "pos", "pack"],
                )

    sent = rows.mapInArrow(tidy(run), "h1 long, h2 int, did long, text_id int, pos int, pack binary")
    rank = F.rank().over(Window.partitionBy("h1", "h2").orderBy("did", "pos"))
    kept = sent.withColumn("rank", rank).filter("rank > 1 or pack is not null")
    one, many = F.col("pack").isNull(), F.col("pack").isNotNull()
    return kept.groupBy("did").agg(
        F.collect_list(F.when(one, F.struct("text_id", "pos"))).alias("marks"),
        F.collect_list(F.when(many, F.struct("text_id", "pack"))).alias("packs"),
    )


def remove_repeats(docs: DataFrame, *, window: int = 20, shortest: int = 5, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; with ``keep_text`` also what is kept."""
    levels = [window]
    while levels[0] // 2 >= shortest:
        levels.insert(0, levels[0] // 2)
    base = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)).alias("did"), docs[text_col].alias("text"))
    kind = dict(docs.dtypes)[id_col]

    def with_info(info: DataFrame, *columns: str) -> DataFrame:
        info = info.withColumnRenamed("did", "of")
        return base.join(info, base["did"] == info["of"], "left").select("did", "text", *columns)

    rows, shorter = base.select("did", "text"), None
    for length in levels[:-1]:
        rows, shorter = with_info(_level(rows, length, shorter, window), "keys", "packs"), length
    marks = _later(rows, shorter, window).withColumnRenamed("did", "of")
    # the same columns as in the levels' joins, so that all of them read one exchange
    final = base.join(marks, base["did"] == marks["of"], "left").select(
        F.nullif("did", F.lit(_NO_ID)).cast(kind).alias("doc_id"), "text", F.col("marks.text_id").alias("of"), F.col("marks.pos").alias("pos"), "packs"
    )

    def run(batches):
        import xxhash

        for whole in batches:
            for b in slices(whole, "text"):
                texts, out, kept_texts = text_bytes(b.column(1)), [], []
                of, pos = number_lists(b.column(2), np.int32), number_lists(b.column(3), np.int32)
                for t, whose, at, packs in zip(texts, of, pos, b.column(4).to_pylist()):
                    words = left = t.split()
                    if len(at) or packs:
                        me = np.uint32(xxhash.xxh32_intdigest(t)).astype(np.int32)
                        at = at[whose == me]
                        runs = [np.frombuffer(x["pack"], "<i4").reshape(-1, 2) for x in packs or () if x["text_id"] == me]
                        first = np.concatenate([at, *(r[:, 0] for r in runs)])
                        last = np.concatenate([at, *(r[:, 1] for r in runs)])
                        covered = np.bincount(first, minlength=len(words) + 1) - np.bincount(last + window, minlength=len(words) + 1)
                        keep = np.cumsum(covered[:-1]) == 0
                        left = [w for w, k in zip(words, keep.tolist()) if k]
                    joined = b" ".join(left)
                    out.append((len(words), len(words) - len(left), hashlib.sha256(joined).hexdigest()))
                    if keep_text:
                        kept_texts.append(joined.decode("utf-8", "replace"))
                columns = [b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    columns.append(pa.array(kept_texts, pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names)

    return final.mapInArrow(tidy(run), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
