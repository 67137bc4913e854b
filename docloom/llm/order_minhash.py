"""Document fingerprints (operator 7): Order MinHash, in DataFrame functions only.

A text's k-mers are its runs of five words.  Each is numbered by its occurrence, so the second
time it appears is another element than the first, and hashed.  The hash's top six bits name one of
64 bins; of each bin the two least elements are selected, put back into text order, and the pair
is hashed: one entry of the fingerprint (a bin of one element hashes that one).  An entry agrees
between two texts only if both elements stayed and kept their order, so moving passages lowers the
likeness as well as replacing them: it follows edit distance, not only the overlap of sets.

Binning makes one pass of one hash do the work of 64 permutations.  An element is one long, hash
bits above its position, so one sort of longs gives bins, ranks and positions at once; occurrence
numbers are worked out only for texts that do repeat a k-mer.

``likeness`` is the share of equal entries among the bins that either fingerprint fills.

Defined cases: null is the empty text; texts without words have an empty fingerprint, alike (1.0)
to another empty one only; fewer than five words make one k-mer.  Ids are keys: equal ids are
ordered by text.  Null ids come last in descending order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, KEPT, K = 64, 2, 5
_POSITION = 24  # bits of an element's position


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _element(h: Column, occurrence: Column, position: Column) -> Column:
    v = F.xxhash64(h, occurrence.cast("int"))
    mask = (1 << _POSITION) - 1
    return v.bitwiseAND(F.lit(~mask)).bitwiseOR(position.cast("long").bitwiseAND(F.lit(mask)))


def _numbered(kmers: Column) -> Column:
    """Elements of k-mers some of which repeat: sorted, counted from the start of their run."""

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (F.get(s, j)["h"] != F.get(s, j - 1)["h"]))

        def of_starts(b: Column) -> Column:
            def run(start: Column, q: Column) -> Column:
                end = F.coalesce(F.get(b, q + 1), n) - 1
                return F.transform(F.sequence(start, end), lambda j: _element(F.get(s, j)["h"], j - start, F.get(s, j)["i"]))

            return F.flatten(F.transform(b, run))

        return _let(starts, of_starts)

    return _let(F.array_sort(F.transform(kmers, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: array<int> of the entries of the string column ``text``, by bin."""
    hash_, kmers, sorted_ = f"__{name}_w", f"__{name}_k", f"__{name}_s"
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn(hash_, F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col(hash_)
    last = F.greatest(F.size(h) - K, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(K))))
    none = F.array().cast("array<long>")
    df = df.withColumn(kmers, F.when(F.size(h) == 0, none).otherwise(runs))
    k = F.col(kmers)
    plain = F.transform(k, lambda x, i: _element(x, F.lit(0), i))
    df = df.withColumn(sorted_, F.sort_array(F.when(F.size(F.array_distinct(k)) == F.size(k), plain).otherwise(_numbered(k))))
    s = F.col(sorted_)

    def bin_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, 58)

    places = F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(s) - 1))
    starts = F.filter(places, lambda i: (i == 0) | (bin_of(F.get(s, i)) != bin_of(F.get(s, i - 1))))

    def entry(i: Column) -> Column:
        def pair(two: Column) -> Column:
            a, b = two["a"], two["b"]
            mask = F.lit((1 << _POSITION) - 1)
            x, y = F.shiftright(a, _POSITION), F.shiftright(b, _POSITION)
            before = a.bitwiseAND(mask) < b.bitwiseAND(mask)
            alone = b.isNull() | (bin_of(a) != bin_of(b))
            t = F.when(alone, F.xxhash64(x)).when(before, F.xxhash64(x, y)).otherwise(F.xxhash64(y, x))
            # 26 bits of the tuple's hash over the bin's number, as a signed int
            return F.shiftright(F.shiftleft(F.shiftleft(t, 6).bitwiseOR(bin_of(a)), 32), 32).cast("int")

        return _let(F.struct(F.get(s, i).alias("a"), F.get(s, i + 1).alias("b")), pair)

    return df.withColumn(name, F.transform(starts, entry)).drop(hash_, kmers, sorted_)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries among the bins that either fingerprint fills."""

    def filled(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda acc, e: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), e.bitwiseAND(F.lit(63)))))

    bins = F.bit_count(filled(a).bitwiseOR(filled(b)))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def as_string(x: Column) -> Column:
    """Eight hexadecimal digits an entry."""
    return F.array_join(F.transform(x, lambda e: F.lower(F.lpad(F.hex(e.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the value, by binary search; -1 for null."""
    if not bounds:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0))
    b, bits = F.lit(bounds), len(bounds).bit_length()

    def step(acc: Column, j: Column) -> Column:
        at = acc + F.call_function("shiftleft", F.lit(1), j)
        return F.when((at <= len(bounds)) & (F.get(b, at - 1) <= value), at).otherwise(acc)

    return F.when(value.isNull(), F.lit(-1)).otherwise(F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), F.lit(0), step))


def with_next(df: DataFrame, derived, columns: list[str], per_partition: int = 8) -> DataFrame:
    """Add next_<c> of the next row by descending doc_id; the first row follows the last.

    ``df`` has doc_id and text; ``derived`` adds columns to it, once for every row that is sent.  Ids are dealt into ranges of equal numbers of rows
    (their bounds are approximate quantiles, as many as ``per_partition`` times the shuffle
    partitions), so the order is worked out range by range, without one task for all.  The first
    row of each range is also sent to the range above, where it follows the last row."""
    spark = df.sparkSession
    n = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("q")).first()["q"] if n > 1 else []
    bucket = _bucket(F.col("doc_id"), sorted(set(cuts or [])))
    tops = ids.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top"))
    # one row a range: few, and their number is bounded by the number of ranges
    above = F.lead("bucket").over(Window.orderBy("bucket"))
    lowest = F.min("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = tops.select("bucket", "top", F.coalesce(above, lowest).alias("to"))
    mine = df.select(bucket.alias("bucket"), F.lit(0).alias("guest"), "doc_id", "text")
    heads = mine.join(F.broadcast(tops.select(F.col("bucket").alias("of"), "top", "to")), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
    # of rows that share the id, the first in the order below
    heads = heads.withColumn("r", F.row_number().over(Window.partitionBy("of").orderBy(F.xxhash64("text"), "text"))).filter("r = 1")
    guests = heads.select(F.col("to").alias("bucket"), F.lit(1).alias("guest"), "doc_id", "text")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    out = derived(mine.union(guests))
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(order))
    return out.filter("guest = 0").drop("bucket", "guest")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, whose last half is the next text's start.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)"""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = with_next(rows, lambda x: with_fingerprint(x, "text", "fp"), ["text", "fp"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
