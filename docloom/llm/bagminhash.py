"""Near-duplicates (operator 1): BagMinHash signatures, bands, exact multiset overlap.

A document is the bag of its runs of five words.  BagMinHash draws, for each distinct run, a
Poisson process of points over time and weight, each point landing on one of ``size`` registers; a
register keeps the least time of the points below the weights of the bag.  Two bags agree on a
register with probability equal to their weighted Jaccard similarity, without bias.

Hierarchy.  Weights (counts) are discretised to the levels 0, 1, 2, 4, 8, ...; a run of weight w
takes part in the processes of all the intervals between levels below w.  The process of the
interval (2^(k-1), 2^k] has the rate 2^(k-1): its points are the points of its sub-intervals,
and each is handed down by halving, one hash bit a level, to the unit interval it belongs to, so a
bag whose weight ends inside keeps the points that fall below.  Almost all runs have weight one and
cost a single process.  Points come in ascending order of time and are drawn only up to a bound
that leaves every register filled with high probability; the bound is doubled for bags where one
stayed empty.  All of it is done for a slice of documents at once in numpy.

``bands`` bands of ``rows`` registers give candidates: at similarity 0.8 a pair of differing texts
escapes all 24 bands of 5 with probability 7e-5.  Equal texts are grouped exactly beforehand.

Buckets aren't expanded into pairs.  In a first step the members of a bucket are compared with its
most central member alone (the one whose buckets hold most members in all), which joins nearly
every group.  Only buckets that still hold several components are looked at again, by what their
texts have that a centre has not (the text that leads most members of a component's buckets).  For
centre z, texts x and y and d the difference of their sets of runs from z's: if d(x) and d(y) have
no run in common, x and y are at most as alike as x and z.  So a text unlike the centre meets only
texts that share such a run: one that the centre lacks, rare ones first and only while enough others
may follow to reach the threshold, or, among texts whose sizes allow it, one that only the centre
has.  Copies edited apart, each in its own way, share none, so a group of them costs rows in
proportion to its texts and not to its pairs.  Runs found in many texts are dealt into blocks of
``pack``; texts of the component that holds most of a run's texts don't meet each other.  What meets
is settled by the signatures if these agree on so few registers that the threshold is 4.5 standard
deviations away, else on the exact bags.

Steps are cut by tables in the shared folder, removed when nothing needs them any more.

Defined cases: null and empty texts (no words) are singletons each, never linked to each other;
texts of fewer than five words have one run of all their words; of a doc_id with several texts each
text has its own class; rows without doc_id have the class of an equal text that has one, else null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, WordHashes, fresh, mix64, slices, text_bytes, tidy, window_hashes
from .components import components

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bag(words: list[bytes], hashes: WordHashes, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the runs of k words and their counts."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hashes.of(words)
    return np.unique(window_hashes(h, min(k, len(h))), return_counts=True)


def numbered(b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A bag as a sorted set: the hashes of its runs with their occurrence numbers."""
    e, n = b
    h = np.repeat(e, n)
    k = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    out = np.where(k == 0, h, mix64(h ^ mix64(k.astype(np.uint64) * _GOLD)))
    out.sort()
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two numbered bags (0 if either is empty)."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int(np.count_nonzero(b[at] == a))
    return common / (len(a) + len(b) - common)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """BagMinHash signatures, one row a bag, as 64-bit hashes of the winning points (0: empty bag)."""
    n = len(bags)
    best = np.full((n, size), np.inf)
    win = np.zeros((n, size), np.uint64)
    todo = np.array([len(e) > 0 for e, _ in bags])
    weight = np.array([w.sum() for _, w in bags], np.float64)
    bound = np.where(todo, size / np.maximum(weight, 1) * (np.log(size) + 4), 0)
    while todo.any():
        live = np.flatnonzero(todo)
        element = np.concatenate([bags[i][0] for i in live])
        count = np.concatenate([bags[i][1] for i in live])
        row = np.repeat(live, [len(bags[i][0]) for i in live])
        best[live], win[live] = np.inf, 0
        level = 0  # interval (low, high] of weights; level 0 is (0, 1]
        while len(element):
            rate = 1.0 if level == 0 else 2.0 ** (level - 1)
            low = 0 if level == 0 else 1 << (level - 1)
            _process(element, count - low, row, level, rate, bound, best, win, size)
            more = count > (1 << level)
            element, count, row = element[more], count[more], row[more]
            level += 1
        todo[live] = ~np.isfinite(best[live]).all(1)
        bound = np.where(todo, bound * 2, bound)
    return win


def _process(element, share, row, level, rate, bound, best, win, size):
    """Points of one weight interval of all elements; share: how many unit intervals of it count."""
    state = mix64(element ^ mix64(np.full(len(element), level + 1, np.uint64) * _GOLD))
    time = np.zeros(len(element))
    while len(state):
        state = mix64(state + _GOLD)
        time = time - np.log(_uniform(state)) / rate
        near = time < bound[row]
        state, time, row, share = state[near], time[near], row[near], share[near]
        if not len(state):
            return
        point = mix64(state ^ np.uint64(0xD6E8FEB86659FD93))
        counts = np.ones(len(state), bool)
        if level > 1:  # hand the point down to a unit interval, one bit a halving
            unit = (point >> np.uint64(40)) & np.uint64((1 << (level - 1)) - 1)
            counts = unit.astype(np.int64) < share
        p, t, r = point[counts], time[counts], row[counts]
        register = (p & np.uint64(0xFFFFFFFF)).astype(np.int64) % size
        # the least time of each (row, register): sorted descending, the last assignment stays
        order = np.argsort(-t, kind="stable")
        r, register, t, p = r[order], register[order], t[order], p[order]
        better = t < best[r, register]
        r, register, t, p = r[better], register[better], t[better], p[better]
        best[r, register] = t
        win[r, register] = p


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, different between bands."""
    out = np.zeros((len(signature), bands), np.uint64)
    s = signature.reshape(len(signature), bands, rows)
    for j in range(rows):
        out = mix64((out + _GOLD) ^ s[:, :, j])
    return mix64(out ^ (np.arange(bands, dtype=np.uint64) * _GOLD))


def _digest(text):
    """128 bits of a text's digest, null without words."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text) of the rows with words; h is a digest of the whole text."""
    return docs.select(docs[id_col].alias("id"), _digest(docs[text_col]).alias("h"), docs[text_col].alias("text")).filter("h is not null")


def _signed(texts: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(id, h, keys): the band keys of each text; copies inside a slice are signed once."""

    def run(batches):
        hashes = WordHashes()
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                digests = b.column(1).to_pylist()
                first = {h: i for i, h in reversed(list(enumerate(digests)))}
                place = {h: n for n, h in enumerate(first)}
                column = text_bytes(b.column(2))
                bags = [bag(column[i].split(), hashes, k) for i in first.values()]
                keys = band_keys(signatures(bags, bands * rows), bands, rows).view(np.int64)[[place[h] for h in digests]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(digests) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["id", "h", "keys"])

    return texts.mapInArrow(tidy(run), "id long, h binary, keys array<long>")


def _bags(texts: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(id, bag, sig): numbered bags and 8 bits of each register."""

    def run(batches):
        hashes = WordHashes()
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                bags = [bag(t.split(), hashes, k) for t in text_bytes(b.column(1))]
                sigs = (signatures(bags, bands * rows) >> np.uint64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([numbered(x).tobytes() for x in bags], pa.binary()), pa.array([x.tobytes() for x in sigs], pa.binary())],
                    ["id", "bag", "sig"],
                )

    return texts.mapInArrow(tidy(run), "id long, bag binary, sig binary")


def _hashes(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are at least ``threshold`` alike."""
    x = bags.select(F.col("id").alias("i"), F.col("bag").alias("x"))
    y = bags.select(F.col("id").alias("j"), F.col("bag").alias("y"))
    rows = pairs.join(x, F.col("a") == F.col("i")).join(y, F.col("b") == F.col("j")).select("a", "b", "x", "y")

    def run(batches):
        for b in batches:
            sims = [overlap(_hashes(p), _hashes(q)) for p, q in zip(b.column(2), b.column(3))]
            keep = np.array(sims) >= threshold
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(tidy(run), "a long, b long")


def _profiles(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(lead, id, root, hub, n, own, near, more, less) of the pairs (lead, id, root, hub).

    more: the runs of the text that its centre lacks, own their number; less: the runs of the centre
    that the text lacks, if own is a small enough share; near: whether text and centre are alike."""
    x = bags.select(F.col("id").alias("i"), F.col("bag").alias("x"))
    y = bags.select(F.col("id").alias("j"), F.col("bag").alias("y"))
    rows = pairs.join(x, F.col("id") == F.col("i")).join(y, F.col("lead") == F.col("j")).select("lead", "id", "root", "hub", "x", "y")

    def run(batches):
        for b in batches:
            n, own, near, more, less = [], [], [], [], []
            for p, q in zip(b.column(4), b.column(5)):
                text, centre = _hashes(p), _hashes(q)
                extra = np.setdiff1d(text, centre, assume_unique=True)
                size, common = len(text), len(text) - len(extra)
                n.append(size)
                own.append(len(extra))
                near.append(common / max(size + len(centre) - common, 1) >= threshold)
                more.append(extra.view(np.int64))
                inside = len(extra) <= (1 - threshold) * size + 1e-9
                less.append(np.setdiff1d(centre, text, assume_unique=True).view(np.int64) if inside else extra[:0].view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (more, less)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int32()), pa.array(own, pa.int32()), pa.array(near, pa.bool_()), *lists], ["lead", "id", "root", "hub", "n", "own", "near", "more", "less"])

    return rows.mapInArrow(tidy(run), "lead long, id long, root long, hub long, n int, own int, near boolean, more array<long>, less array<long>")


def _candidates(profiles: DataFrame, threshold: float, pack: int) -> DataFrame:
    """(a, b), with repeats: texts of different components that may be alike, a is apart from the centre.

    A text unlike the centre can only be like another one of the bucket if some run is in both and
    not in the centre, or in neither and in the centre.  Without a run of the first kind all they
    share are runs of the centre, which bounds the size of either by the other's profile."""
    t = threshold
    apart = F.col("root") != F.col("hub")
    # the most runs that a partner may have that shares none of the text's own runs
    top = F.floor((F.col("n") - F.col("own")) * ((1 + t) / t) + F.lit(1e-6)) - F.col("n")
    p = profiles.withColumn("top", top).withColumn("apart", apart)
    inner = p.filter(F.col("own") <= (1 - t) * F.col("n") + 1e-9)
    bounds = inner.groupBy("lead").agg(F.max(F.when(F.col("apart"), F.col("top"))).alias("most"), F.min("n").alias("low"))
    bounds = bounds.filter(F.col("most") >= F.col("low")).withColumnRenamed("lead", "l")
    shorter = inner.join(bounds, F.col("lead") == F.col("l")).filter((F.col("n") <= F.col("most")) | (F.col("apart") & (F.col("top") >= F.col("low"))))
    cols = ["lead", "id", "root", "n", "own", "top", "apart"]
    runs = p.select(*cols, F.explode("more").alias("run"), F.lit(False).alias("lacks"))
    runs = runs.union(shorter.select(*cols, F.explode("less").alias("run"), F.lit(True).alias("lacks")))
    key = ["lead", "run", "lacks"]
    # pairs of one component are no candidates: the most frequent one of a key meets the others only
    held = runs.groupBy(*key, "root").agg(F.count("*").alias("c"), F.max("apart").alias("any"))
    held = held.groupBy(*key).agg(F.count("*").alias("kinds"), F.max("any").alias("any"), F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("m"))
    held = held.filter((F.col("kinds") > 1) & F.col("any")).select(*key, "all", F.col("m.root").alias("major"), F.ceil(F.col("all") / pack).alias("blocks"))
    # rare runs first: the run by which a pair is first found has e - 1 at most behind it that both may have
    order = Window.partitionBy("lead", "id", "lacks").orderBy(F.desc("all"), "run")
    dealt = runs.join(held, key).withColumn("e", F.row_number().over(order))
    dealt = dealt.filter(F.col("lacks") | (F.col("e") >= F.col("own") - F.col("n") + F.ceil(t * F.col("n") - 1e-9)))
    few = dealt.filter(F.col("root") != F.col("major")).select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"{c}1") for c in (*cols[1:], "e")])
    whole = dealt.select(*key, F.pmod(F.xxhash64("id"), "blocks").alias("block"), *[F.col(c).alias(f"{c}2") for c in (*cols[1:], "e")])
    fit = (F.col("root1") != F.col("root2")) & (F.col("apart1") | F.col("apart2")) & (F.least("n1", "n2") >= t * F.greatest("n1", "n2") - 1e-9)
    need = F.ceil((F.col("n1") + F.col("n2")) * (t / (1 + t)) - 1e-6) - F.least(F.col("n1") - F.col("own1"), F.col("n2") - F.col("own2"))
    fit &= F.when(F.col("lacks"), (F.col("n2") <= F.col("top1")) & (F.col("n1") <= F.col("top2"))).otherwise(F.least("e1", "e2") >= need)
    pairs = few.join(whole, [*key, "block"]).filter(fit)
    first = F.col("apart1") & (~F.col("apart2") | (F.col("id1") > F.col("id2")))
    pairs = pairs.select(F.when(first, F.col("id1")).otherwise(F.col("id2")).alias("a"), F.when(first, F.col("id2")).otherwise(F.col("id1")).alias("b"))
    return pairs.union(profiles.filter(apart & F.col("near")).select("id", "lead"))


def _residual(members: DataFrame, roots: DataFrame, bags: DataFrame, threshold: float, bands: int, rows: int, pack: int) -> DataFrame:
    """Links (a, b) inside buckets between members of different components."""
    root = roots.select(F.col("node").alias("id"), "root")
    hub = roots.select(F.col("node").alias("lead"), F.col("root").alias("hub"))
    m = members.select("lead", "id").distinct()
    # buckets led by texts of one component share its centre, the lead with most members
    leads = m.groupBy("lead").agg(F.count("*").alias("n")).join(hub, "lead", "left").withColumn("hub", F.coalesce("hub", "lead"))
    centre = leads.groupBy("hub").agg(F.max(F.struct("n", (-F.col("lead")).alias("lead"))).alias("m")).select("hub", (-F.col("m.lead")).alias("centre"))
    m = m.join(leads.select("lead", "hub").join(centre, "hub"), "lead").select(F.col("centre").alias("lead"), "hub", "id").distinct().join(root, "id", "left")
    m = m.select("lead", "id", F.coalesce("root", "id").alias("root"), "hub")
    several = m.groupBy("lead").agg(F.max(F.col("root") != F.col("hub")).alias("open")).filter("open").select("lead")
    work = Tables(members.sparkSession, "residual")
    profiles = work.keep(_profiles(m.filter("id <> lead").join(several, "lead"), bags, threshold), "profiles")
    # signatures settle most of what can't be alike before whole bags travel
    sigma = (threshold * (1 - threshold) / (bands * rows)) ** 0.5
    least = (threshold - 4.5 * sigma) * bands * rows
    x = bags.select(F.col("id").alias("i"), F.col("sig").alias("x"))
    y = bags.select(F.col("id").alias("j"), F.col("sig").alias("y"))
    found = _candidates(profiles, threshold, pack).distinct().join(x, F.col("a") == F.col("i")).join(y, F.col("b") == F.col("j")).select("a", "b", "x", "y")

    def run(batches):
        for b in batches:
            same = [np.count_nonzero(np.frombuffer(p.as_buffer(), np.uint8) == np.frombuffer(q.as_buffer(), np.uint8)) for p, q in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(np.array(same) >= least, pa.bool_()))

    links = work.keep(_verified(found.mapInArrow(tidy(run), "a long, b long"), bags, threshold), "links")
    work.remove("profiles")
    return links


def _text_classes(docs: DataFrame, k: int, threshold: float, bands: int, rows: int, pack: int, id_col: str, text_col: str) -> DataFrame:
    """(h, class_id): the least id of the class of each text with words."""
    work = Tables(docs.sparkSession, "near-duplicates")
    texts = _keyed(docs, id_col, text_col)
    # one row a text; ids alone may repeat for different texts, so a text's node is its least id
    # only where no other text has the same one
    signed = _signed(texts.filter("id is not null"), k, bands, rows).groupBy("h").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"))
    signed = work.keep(signed, "signed")
    shared = signed.groupBy("rep").agg(F.count("*").alias("c"), F.min("h").alias("f")).filter("c > 1").select(F.col("rep").alias("r"), "f")
    repeated = not shared.isEmpty()
    node = F.col("rep")
    if repeated:
        signed = signed.join(shared, F.col("rep") == F.col("r"), "left")
        node = F.when(F.col("f").isNull() | (F.col("f") == F.col("h")), F.col("rep")).otherwise(F.xxhash64("h"))
    signed = signed.select("h", "rep", node.alias("id"), "keys")
    banded = signed.select("id", F.explode("keys").alias("key"))
    # buckets of one member are no candidates
    held = work.keep(banded.join(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"), "held")
    degree = held.groupBy("id").agg(F.sum("n").alias("degree"))
    lead = held.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("id"))).alias("m")).select("key", (-F.col("m.id")).alias("lead"))
    members = work.keep(held.select("key", "id").join(lead, "key").select("id", "lead").distinct(), "members")
    wanted = signed.select("h", "rep", "id").join(members.select("id").distinct(), "id", "left_semi").select(F.col("h").alias("wh"), F.col("rep").alias("wr"), F.col("id").alias("node"))
    bags = _bags(texts.join(wanted, (F.col("id") == F.col("wr")) & (F.col("h") == F.col("wh"))).select(F.col("node").alias("id"), "text"), k, bands, rows)
    bags = work.keep(bags, "bags")
    twice = bags.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id")
    if not twice.isEmpty():  # whole rows that repeat
        bags = bags.join(twice, "id", "left_anti").union(bags.join(twice, "id", "left_semi").dropDuplicates(["id"]))
    links = work.keep(_verified(members.filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")), bags, threshold), "links")
    roots = work.keep(components(links), "roots")
    more = _residual(members, roots, bags, threshold, bands, rows, pack)
    if not more.isEmpty():  # the links between components join their roots
        at = [roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}r")) for x in ("a", "b")]
        between = more.join(at[0], "a", "left").join(at[1], "b", "left").select(F.coalesce("ar", "a").alias("a"), F.coalesce("br", "b").alias("b"))
        joined = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
        known = roots.union(more.select(F.col("a").alias("node"), F.col("a").alias("root"))).union(more.select(F.col("b").alias("node"), F.col("b").alias("root")))
        known = known.groupBy("node").agg(F.min("root").alias("root"))
        roots = known.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    named = signed.select("h", "rep", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("h", "rep", F.coalesce("root", "id").alias("class_id"))
    if repeated:
        least = named.groupBy("class_id").agg(F.min("rep").alias("least"))
        named = named.join(least, "class_id").select("h", F.col("least").alias("class_id"))
    for name in ("bags", "held", "members", "links"):
        work.remove(name)
    return named.select("h", "class_id")


def _row_classes(docs: DataFrame, k: int, threshold: float, bands: int, rows: int, pack: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, class_id) of every row."""
    classes = _text_classes(docs, k, threshold, bands, rows, pack, id_col, text_col)
    return docs.select(docs[id_col].alias("doc_id"), _digest(docs[text_col]).alias("h")).join(classes, "h", "left").select("doc_id", "h", F.coalesce("class_id", "doc_id").alias("class_id"))


def near_duplicates(docs: DataFrame, *, k: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 5, pack: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id), one row a row of ``docs``: class_id is the least doc_id of the row's class."""
    return _row_classes(docs, k, threshold, bands, rows, pack, id_col, text_col).select("doc_id", "class_id")


def drop_near_duplicates(docs: DataFrame, *, k: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 5, pack: int = 64) -> DataFrame:
    """The rows of ``docs`` (same columns) whose document is the least of its class.

    Rows without id stay.  A row is judged by its own text, so an id with several texts keeps those
    that no lesser id has; rows equal in id and text stay or go together."""
    gone = _row_classes(docs, k, threshold, bands, rows, pack, "doc_id", "text").filter("doc_id <> class_id")
    own, i, h = fresh(docs, "own", "i", "h")
    gone = gone.select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct()
    rows_ = docs.withColumn(own, _digest(docs["text"]))
    return rows_.join(gone, (rows_["doc_id"] == F.col(i)) & (F.col(own) == F.col(h)), "left_anti").drop(own)
