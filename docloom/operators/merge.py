"""Merging: the extractions of a document to one value, as aggregates directed by their type.

Strings are joined, arrays concatenated, objects merged field by field, and of numbers and booleans
the first that isn't null counts, always in the order of ``index``.  For values of one type this
fold is associative, so every leaf is one ordered aggregate and Spark combines partially.  One
extraction alone is passed on untouched.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MergeConfig

#: Fixed value: what stands between joined strings.
SEPARATOR = "\n\n---\n\n"


def _in_order(value: Column) -> Column:
    """The non-null values of a group by index."""
    both = F.collect_list(F.when(value.isNotNull(), F.struct(F.col("index").alias("i"), value.alias("v"))))
    return F.transform(F.array_sort(both, lambda a, b: F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)), lambda z: z["v"])


def _first(value: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col("index")))


def merged(value: Column, kind: T.DataType, strings: str = "join") -> Column:
    """The aggregate that folds a column of this type."""
    if isinstance(kind, T.StringType) and strings == "join":
        return F.when(F.count(value) > 0, F.array_join(_in_order(value), SEPARATOR))
    if isinstance(kind, T.ArrayType):
        return F.when(F.count(value) > 0, F.flatten(_in_order(value)))
    if isinstance(kind, T.StructType):
        return F.when(F.count(value) > 0, F.struct(*(merged(value[f.name], f.dataType, strings).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.MapType):
        # later keys are added, present ones stay: the first of each key
        entries = F.flatten(F.transform(_in_order(value), F.map_entries))
        return F.when(F.count(value) > 0, F.map_from_entries(deduped(entries, lambda e: e["key"], "first")))
    return _first(value)


def deduped(items: Column, key: Callable[[Column], Column], winner: str) -> Column:
    """An array with one item a key, at the place of the key's first; the first item or the last.

    Places are sorted by key, so it takes n log n, and items need no order."""

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | ~F.get(s, j)["k"].eqNullSafe(F.get(s, j - 1)["k"]))

        def of_starts(b: Column) -> Column:
            def place(j: Column, q: Column) -> Column:
                end = F.coalesce(F.get(b, q + 1), n) - 1
                return F.struct(F.get(s, j)["i"].alias("first"), F.get(s, j if winner == "first" else end)["i"].alias("taken"))

            return F.transform(F.array_sort(F.transform(b, place)), lambda p: F.get(items, p["taken"]))

        return F.element_at(F.transform(F.array(starts), of_starts), 1)

    places = F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
    return F.when(F.size(items) <= 1, items).otherwise(F.element_at(F.transform(F.array(places), of_sorted), 1))


def deduped_value(value: Column, kind: T.DataType, key: Callable[[Column], Column], winner: str) -> Column:
    """All arrays of a value, through objects but not inside items."""
    if isinstance(kind, T.ArrayType):
        return F.when(value.isNotNull(), deduped(value, key, winner))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(deduped_value(value[f.name], f.dataType, key, winner).alias(f.name) for f in kind.fields)))
    return value


# ----------------------------------------------------------------------------- values without a type


def fold_values(a: Any, b: Any) -> Any:
    """The same fold for two JSON values of any kinds."""
    if a is None or b is None:
        return b if a is None else a
    if isinstance(a, str) and isinstance(b, str):
        return a + SEPARATOR + b
    if isinstance(a, list) and isinstance(b, list):
        return a + b
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: fold_values(a.get(k), b.get(k)) for k in [*a, *(k for k in b if k not in a)]}
    return a


def merge_json(rows: DataFrame, column: str = "data") -> DataFrame:
    """(doc_id, result): JSON strings of any kinds, folded from the left in index order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = None
        for k, x in enumerate(frame.sort_values("index")[column]):
            x = None if x is None else json.loads(x)
            out = x if not k else fold_values(out, x)
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]], "result": [json.dumps(out, ensure_ascii=False)]})

    return rows.select("doc_id", "index", column).groupBy("doc_id").applyInPandas(run, "doc_id long, result string")


# -------------------------------------------------------------------------------------------- entry


def merge(extractions: DataFrame, config: MergeConfig = MergeConfig(), docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, result) from (doc_id, index, data); documents without extractions get null if
    ``docs`` is given.  Rows with an error don't count."""
    rows = extractions.filter(F.col("error").isNull()) if "error" in extractions.columns else extractions
    kind = rows.schema["data"].dataType
    if callable(config.strategy):
        out = _custom(rows, config.strategy, kind)
    elif config.strategy == "first":
        out = rows.groupBy("doc_id").agg(F.min_by("data", "index").alias("result"))
    elif isinstance(kind, T.VariantType):
        out = merge_json(rows.withColumn("data", F.to_json("data")))
    else:
        alone, value = F.count("*") == 1, F.col("data")
        all_ = merged(value, kind, config.strings)
        out = rows.groupBy("doc_id").agg(alone.alias("_alone"), F.min_by("data", "index").alias("_one"), all_.alias("_all"))
        every = F.col("_all")
        if config.strategy == "dedupe" and config.dedupe_key is not None:
            every = deduped_value(every, kind, config.dedupe_key, config.dedupe_winner)
        out = out.select("doc_id", F.when(F.col("_alone"), F.col("_one")).otherwise(every).alias("result"))
    if docs is not None:
        out = docs.select("doc_id").distinct().join(out, "doc_id", "left")
    return out


def _custom(rows: DataFrame, function: Callable, kind: T.DataType) -> DataFrame:
    """``function(list of values in order) -> value``; a single extraction isn't given to it."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("result", kind)])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = list(frame.sort_values("index")["data"])
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]], "result": [values[0] if len(values) == 1 else function(values)]})

    return rows.select("doc_id", "index", "data").groupBy("doc_id").applyInPandas(run, schema)
