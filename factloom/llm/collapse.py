"""Records that differ only in formatting: range partitioning, external sort, and a scan of adjacent runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.canonical import field_set, letters_digits, with_nfc
from factloom.plans.session import cut, partitions, written

RUNS = "id bigint, head bigint, part int, opens boolean, edge string, at_end boolean"


def canonical_records(df: DataFrame, id_col: str = "fact_id", text: str = "a", fields: str = "key") -> DataFrame:
    """(id, ck): the record's whole canonical form. Equal ck means equal records but for formatting and field order."""
    rec = with_nfc(df.select(F.col(id_col).alias("id"), F.col(text).alias("t"), F.col(fields).alias("f")), ["t", "f"])
    return rec.select("id", F.concat_ws("\x02", letters_digits(F.col("t")), field_set(F.col("f"))).alias("ck"))


def scan_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over a sorted partition: each row with the first id of its run of equal keys, and the partition's first and last key."""
    part = TaskContext.get().partitionId()
    key, head, opens = None, None, True
    for pdf in batches:
        if not len(pdf):
            continue
        keys, ids = pdf["ck"].to_numpy(object), pdf["id"].to_numpy(np.int64)
        starts = np.empty(len(ids), bool)
        starts[1:] = keys[1:] != keys[:-1]
        starts[0] = key is None or keys[0] != key
        if key is None:
            yield pd.DataFrame({"id": [None], "head": [ids[0]], "part": [part], "opens": [True], "edge": [keys[0]], "at_end": [False]})
        run = np.cumsum(starts)
        heads = np.concatenate(([ids[0] if head is None else head], ids[starts]))[run]
        first = opens & (run == (1 if key is None else 0))
        key, head, opens = keys[-1], int(heads[-1]), bool(first[-1])
        yield pd.DataFrame({"id": ids, "head": heads, "part": part, "opens": first, "edge": None, "at_end": None})
    if key is not None:
        yield pd.DataFrame({"id": [None], "head": [head], "part": [part], "opens": [opens], "edge": [key], "at_end": [True]})


def run_heads(records: DataFrame) -> DataFrame:
    """(id, head): head is the smallest id with the same ck.

    Rows are range-partitioned by (ck, id), so a key with a third of all rows spreads over many partitions; runs that
    cross partitions are joined by two edge rows per partition, all that the driver sees. Null ids are left out.
    """
    spark = records.sparkSession
    kept = written(records.filter(F.col("id").isNotNull()))  # sampling for the ranges and the shuffle both read it
    ordered = kept.repartitionByRange(partitions(spark), "ck", "id").sortWithinPartitions("ck", "id")
    runs = cut(ordered.mapInPandas(scan_runs, RUNS))
    edges: dict[int, dict] = {}
    for r in runs.filter(F.col("edge").isNotNull()).collect():
        edges.setdefault(r["part"], {})["last" if r["at_end"] else "first"] = r
    carried: dict[int, int] = {}
    key = head = None
    for p in sorted(edges):
        first, last = edges[p]["first"], edges[p]["last"]
        if key is not None and first["edge"] == key:
            carried[p] = head
        key = last["edge"]
        head = carried.get(p, last["head"]) if last["opens"] else last["head"]
    rows = runs.filter(F.col("id").isNotNull())
    moved = F.create_map(*[F.lit(x) for kv in carried.items() for x in kv])[F.col("part")] if carried else F.lit(None).cast("bigint")
    return rows.select("id", F.when(F.col("opens"), F.coalesce(moved.cast("bigint"), F.col("head"))).otherwise(F.col("head")).alias("head"))


def format_copies(df: DataFrame, id_col: str = "fact_id", text: str = "a", fields: str = "key") -> DataFrame:
    """(id_a, id_b): the smallest id of each group of copies with each other id of it.

    Null and empty texts and keys count as empty: such records are copies when the other part agrees. An empty table gives no rows.
    """
    return run_heads(canonical_records(df, id_col, text, fields)).filter("id <> head").select(F.col("head").alias("id_a"), F.col("id").alias("id_b"))


def collapse_copies(df: DataFrame, id_col: str = "fact_id", text: str = "a", fields: str = "key") -> DataFrame:
    """One record per group, that of the smallest id, with all its columns and `copies`, the group's number of records (1 or more)."""
    counts = run_heads(canonical_records(df, id_col, text, fields)).groupBy("head").agg(F.count(F.lit(1)).alias("copies"))
    name = "copies" if "copies" not in df.columns else "copies_"
    return df.join(counts.select(F.col("head").alias(id_col), F.col("copies").alias(name)), id_col)
