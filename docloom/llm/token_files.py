"""Token-ID output (operator 5): encode, write patched frame of reference files, read them back.

Documents are range-partitioned by id (ties by text), sorted within partitions and encoded there,
so the files follow ascending ids and only text is shuffled, once.  Each task writes files of at
most ``file_bytes`` into the shared folder; a file is written under a hidden name and then moved,
and its name and bytes depend on its partition's rows alone, so a task that runs again after a
lost executor replaces it with the same file.  The manifest lists the files of successful tasks.

Encoding: the vocabulary lower-cases and drops white space, and no rule of its normaliser,
pre-tokeniser or special tokens reaches across ASCII white space, so each run of other characters
is encoded alone and distinct runs go through a bounded memo.  A full stop or comma behind a letter
at a run's end is a pre-token of its own, so such runs share the encoding of the rest.  What the memo lacks goes
to the library in long texts, with a separator whose token tells the runs apart.

Defined cases: null and empty texts hold the end id alone; null ids come first; a repeated id is a
document for each row, ordered by text.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_words, shared_dir, slices, tidy

TOKENIZER = "word_bpe_49k.json"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


#: A run that ends with a stop or comma behind an ASCII or Latin-1 small letter.
_STOPPED = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])[.,]\Z")
_SEPARATOR = "\x01"


class WordEncoder:
    """Ids of whole texts; one per worker.

    The memo is sorted hashes beside one pool of ids, some thirty bytes an entry; it stops growing
    at ``limit`` entries, so a text's word meets a wrong entry with probability limit / 2**64."""

    def __init__(self, path: str, limit: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.mark = self._ids(_SEPARATOR)
        self.stops = {ord(c): self._ids(c) for c in ".,"}
        self.hashes = np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def fresh(self, runs: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct runs of other characters than white space, by the library."""
        out: dict[bytes, np.ndarray] = {}
        stopped = {r for r in runs if r[-1] in b".," and _STOPPED.search(r) and b"\x01" not in r}
        odd = {r for r in runs if b"\x01" in r} if len(self.mark) == 1 else set(runs) - stopped
        for r in odd:
            out[r] = np.array(self._ids(r.decode("utf-8", "replace")), np.uint32)
        todo = list({r[:-1] if r in stopped else r for r in runs} - odd)
        for i in range(0, len(todo), 500):
            part = todo[i : i + 500]
            ids = np.array(self._ids(f" {_SEPARATOR} ".join([r.decode("utf-8", "replace") for r in part])), np.uint32)
            ends = np.flatnonzero(ids == self.mark[0]).tolist()
            for r, a, z in zip(part, [0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True):
                out[r] = ids[a:z]
        for r in stopped:
            out[r] = np.append(out[r[:-1]], np.array(self.stops[r[-1]], np.uint32))
        return [out[r] for r in runs]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        import pyarrow.compute as pc

        # where a special token may be spelled out, the text is encoded as it stands
        special = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring(texts, "<|"), False)))
        if len(special):
            alone = {int(i): np.array(self._ids(texts[int(i)].as_py()), np.uint32) for i in special}
            mask = np.zeros(len(texts), bool)
            mask[special] = True
            ids, sizes = self.encode(pc.if_else(pa.array(mask), pa.scalar("", texts.type), texts))
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, x in alone.items():
                parts[i], sizes[i] = x, len(x)
            return np.concatenate(parts), sizes
        h, counts, a, z, raw = cut_words(texts, lower=True)
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, u)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == u if len(self.hashes) else np.zeros(len(u), bool)
        starts, sizes, pool = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64), self.pool
        starts[known], sizes[known] = self.starts[at[known]], self.sizes[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            got = self.fresh([raw[x:y].tobytes() for x, y in zip(a[first[new]].tolist(), z[first[new]].tolist())])
            sizes[new] = [len(x) for x in got]
            starts[new] = len(pool) + np.cumsum(sizes[new]) - sizes[new]
            pool = np.concatenate([pool, *got])
            if len(self.hashes) + len(new) <= self.limit:
                place = np.searchsorted(self.hashes, u[new])
                self.starts, self.sizes = np.insert(self.starts, place, starts[new]), np.insert(self.sizes, place, sizes[new])
                self.hashes, self.pool = np.insert(self.hashes, place, u[new]), pool
        n = sizes[inverse]
        before = np.cumsum(n) - n
        ids = pool[np.repeat(starts[inverse] - before, n) + np.arange(int(n.sum()))]
        total = np.concatenate([[0], np.cumsum(n)])
        words = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[words])


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _put(path: str, name: str, data: bytes) -> None:
    from pyarrow import fs
    from pyspark import TaskContext

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    hidden = f"{root}/.{name}-{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(hidden) as f:
        f.write(data)
    if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:  # of an attempt that was lost
        store.delete_file(f"{root}/{name}")
    store.move(hidden, f"{root}/{name}")


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, *, end_id: int = 2, file_bytes: int = 32 << 20, percentile: float = 90.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` below ``path``; returns the manifest (file, first_id, n_docs, n_tokens, start)."""
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        from . import pfor

        place, encoder = TaskContext.get().partitionId(), _encoder(tokenizer)
        ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held, n = 0, 0

        def flush():
            nonlocal held, n
            sizes = np.concatenate(lengths)
            name = f"tokens-{place:06d}-{n:05d}.pfr"
            data = pfor.write(np.concatenate(parts), np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids]), sizes, percentile)
            _put(f"{path}/files", name, data)
            row = (name, ids[0], len(ids), int(sizes.sum()), place, n)
            for x in (ids, lengths, parts):
                x.clear()
            held, n = 0, n + 1
            return row

        out = []
        for whole in batches:
            for b in slices(whole, "text"):
                tokens, sizes = encoder.encode(b.column(1))
                # the end id behind each document
                ended = np.empty(len(tokens) + len(sizes), np.uint32)
                last = np.cumsum(sizes + 1) - 1
                body = np.ones(len(ended), bool)
                body[last] = False
                ended[body], ended[last] = tokens, end_id
                if held and held + ended.nbytes > 2 * file_bytes:
                    out.append(flush())
                ids += b.column(0).to_pylist()
                lengths.append(sizes + 1)
                parts.append(ended)
                held += ended.nbytes
        if ids:
            out.append(flush())
        names = ["file", "first_id", "n_docs", "n_tokens", "place", "seq"]
        kinds = [pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(6)], names)

    made = rows.mapInArrow(tidy(run), "file string, first_id long, n_docs long, n_tokens long, place long, seq long")
    made.write.parquet(f"{path}/manifest")
    manifest = docs.sparkSession.read.schema(made.schema).parquet(f"{path}/manifest")
    # one row a file, so one task can add up where each file starts
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "place", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("place", "seq")


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the bytes of the files."""

    def run(batches):
        from . import pfor

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                r = pfor.Reader(data.as_buffer().to_pybytes())
                ends = np.cumsum(r.lengths)
                for k in range(0, r.n_docs, 8192):  # a bounded number of documents at a time
                    last = min(r.n_docs, k + 8192)
                    first = int(ends[k] - r.lengths[k])
                    tokens = r.values(first, int(ends[last - 1])).astype("<u4")
                    at = ends[k:last] - r.lengths[k:last]
                    crc = [zlib.crc32(tokens[a - first : z - first]) for a, z in zip(at.tolist(), ends[k:last].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (last - k)), pa.array(r.ids[k:last], pa.int64(), mask=r.is_null[k:last]), pa.array(at), pa.array(r.lengths[k:last]), pa.array(crc, pa.int64())],
                        ["file", "doc_id", "offset", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").load(f"{path}/files").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    found = files.mapInArrow(tidy(run), "file string, doc_id long, offset long, n_tokens long, ids_crc32 long")
    starts = manifest.select(F.col("file").alias("f"), F.col("start").alias("s"))
    if manifest.count() <= 100_000:  # some 10 MB; beyond that Spark joins as it sees fit
        starts = F.broadcast(starts)
    return found.join(starts, F.col("file") == F.col("f")).select("doc_id", (F.col("s") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str | None = None, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents to token files in the shared folder and return what is read back."""
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    manifest = write_token_files(docs, path, tokenizer, end_id=end_id, id_col=id_col, text_col=text_col)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, path, manifest)
