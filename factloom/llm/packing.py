"""Filling containers of a fixed capacity: minimum bin slack over bounded blocks, with the badly filled containers packed again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.session import cut

#: Pieces packed by one task; more are spread over several blocks.
BLOCK = 20_000
PACKED = "kind string, block int, bin int, window_id bigint, piece int, n int, at int, full boolean"


def fullest(lengths: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The multiset of available lengths whose sum is the largest not above room, as (index, copies).

    Subset sums are the bits of an integer; copies of one length go in by powers of two. Lengths come longest first, and
    the search ends as soon as room itself is reached.
    """
    mask, reach, seen, steps = (1 << (room + 1)) - 1, 1, [], []
    for i in np.flatnonzero((counts > 0) & (lengths <= room)):
        n, left, k = int(lengths[i]), min(int(counts[i]), room // int(lengths[i])), 1
        while left > 0:
            take = min(k, left)
            seen.append(reach)
            steps.append((int(i), take, n * take))
            reach |= (reach << (n * take)) & mask
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for before, (i, take, size) in zip(reversed(seen), reversed(steps)):
        if not before >> total & 1:
            out[i] = out.get(i, 0) + take
            total -= size
    return list(out.items())


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each size; none is above capacity. Each container starts with the longest piece left and gets the
    fullest combination beside it."""
    lengths, which = np.unique(-sizes, return_inverse=True)
    lengths = -lengths
    order = np.argsort(which, kind="stable")
    counts = np.bincount(which, minlength=len(lengths))
    ends = np.cumsum(counts)
    starts, out, b, top = ends - counts, np.full(len(sizes), -1), -1, 0

    def take(i: int, copies: int) -> None:
        at = starts[i] + counts[i] - copies
        out[order[at : at + copies]] = b
        counts[i] -= copies

    while top < len(lengths):
        if not counts[top]:
            top += 1
            continue
        if not lengths[top]:
            b = max(b, 0)
            take(top, int(counts[top]))
            continue
        b += 1
        take(top, 1)
        for i, copies in fullest(lengths, np.where(lengths > 0, counts, 0), capacity - int(lengths[top])):
            take(i, copies)
    return out


def pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n", "window_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    capacity = int(pdf["capacity"].iloc[0])
    pdf["bin"] = fill(pdf["n"].to_numpy(), capacity)
    used = pdf.groupby("bin")["n"].transform("sum")
    pdf["at"] = pdf.groupby("bin")["n"].cumsum() - pdf["n"]
    pdf["full"] = used >= capacity
    return pdf[["kind", "block", "bin", "window_id", "piece", "n", "at", "full"]]


def pieces(windows: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per window, and for a window longer than its container one per piece of at most a container's capacity."""
    size = windows.select("window_id", "kind", "prompt_len", F.coalesce(F.size("codes"), F.lit(-1)).alias("s")).withColumn("n_codes", F.greatest("s", F.lit(0))).drop("s")
    sized = size.join(F.broadcast(targets.filter("capacity > 0").groupBy("kind").agg(F.max("capacity").alias("capacity"))), "kind", "left")
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_codes") / F.col("capacity")).cast("int") - 1, F.lit(0)))
    cut_ = sized.withColumn("piece", F.explode(F.when(F.col("capacity").isNull(), F.array(F.lit(0))).otherwise(cuts)))
    start = F.when(F.col("capacity").isNull(), F.lit(0)).otherwise(F.col("piece") * F.col("capacity"))
    return cut_.withColumn("start", start).withColumn("n", F.when(F.col("capacity").isNull(), F.col("n_codes")).otherwise(F.least("capacity", F.col("n_codes") - F.col("start"))))


def pack(windows: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each window's place: kind, container (null only where the kind has no capacity or the window no id), at (offset in the container),
    window_id, piece, start (offset in the window), n (codes), prompt_at and prompt_n (the piece's part of the prompt, in the
    container; both null for a null prompt_len).

    A window stays whole unless longer than its container. Null and empty codes take no room and share a container. A
    prompt_len beyond the codes ends with them, a negative one counts as 0. A window_id met twice is packed twice. Blocks
    hold up to `block` pieces of one kind by hash, so no task grows with the data; the containers that a round leaves short
    of full are emptied and packed together in the next, until one block a kind is left or a round no longer helps.
    """
    spark = windows.sparkSession
    all_pieces = cut(pieces(windows, targets))
    todo, done, rounds = all_pieces.filter("capacity is not null and window_id is not null").select("kind", "window_id", "piece", "n", "capacity"), [], 0
    caps = {r["kind"]: r["capacity"] for r in targets.filter("capacity > 0").groupBy("kind").agg(F.max("capacity").alias("capacity")).collect()}
    before: dict[str, int] = {}
    while True:
        counts = {r["kind"]: r["c"] for r in todo.groupBy("kind").agg(F.count(F.lit(1)).alias("c")).collect()}
        if not counts:
            break
        blocks = {k: -(-c // block) for k, c in counts.items()}
        tasks = min(2 * sum(blocks.values()), 4 * spark.sparkContext.defaultParallelism)  # else all blocks may end in one small task
        n_blocks = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])[F.col("kind")]
        placed = todo.withColumn("block", F.pmod(F.xxhash64("window_id", "piece", F.lit(rounds)), n_blocks).cast("int"))
        packed = cut(placed.repartition(tasks, "kind", "block").groupBy("kind", "block").applyInPandas(pack_block, PACKED)).withColumn("round", F.lit(rounds))
        last = all(b == 1 for b in blocks.values()) or (before and all(c > 0.8 * before.get(k, c) for k, c in counts.items()))
        done.append(packed if last else packed.filter("full"))
        if last:
            break
        before = counts
        cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("kind")]
        todo = packed.filter("not full").select("kind", "window_id", "piece", "n", cap.alias("capacity"))
        rounds += 1
    if not done:
        done = [spark.createDataFrame([], PACKED).withColumn("round", F.lit(0))]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    container = F.concat_ws("-", F.col("kind"), F.col("round"), F.col("block"), F.col("bin"))
    at = out.select("kind", "window_id", "piece", container.alias("container"), "at")
    # A window_id met twice gives the same (window_id, piece) twice: numbered on either side, they pair off one to one.
    same = Window.partitionBy("kind", "window_id", "piece")
    left = all_pieces.withColumn("twin", F.row_number().over(same.orderBy("n", "prompt_len")))
    left = left.withColumn("size", F.col("n"))
    right = out.select("kind", "window_id", "piece", container.alias("container"), "at", F.row_number().over(same.orderBy("n", "at", container)).alias("twin"))
    begin = F.greatest(F.col("start"), F.lit(0))
    inside = F.greatest(F.lit(0), F.least(F.col("prompt_len"), F.col("n_codes"), begin + F.col("n")) - begin)
    return left.join(right, ["kind", "window_id", "piece", "twin"], "left").select(
        "kind", "container", "at", "window_id", "piece", "start", "n",
        F.when(F.col("prompt_len").isNotNull(), F.col("at")).alias("prompt_at"),
        F.when(F.col("prompt_len").isNotNull(), inside).alias("prompt_n"),
    )


def packing_report(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """By kind: containers used, the least that could do, and the share of room left empty."""
    cap = targets.groupBy("kind").agg(F.max("capacity").alias("capacity"))
    by = placed.filter("container is not null").groupBy("kind").agg(F.countDistinct("container").alias("containers"), F.sum("n").alias("codes"))
    return by.join(F.broadcast(cap), "kind").select(
        "kind", "containers", F.ceil(F.col("codes") / F.col("capacity")).alias("least"), (1 - F.col("codes") / (F.col("containers") * F.col("capacity"))).alias("empty_share")
    )


def packing_checks(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """By kind: windows and codes placed, containers filled beyond their capacity, pieces that begin before the former one's
    end, and windows cut though no longer than a container. The last three must be 0."""
    cap = targets.filter("capacity > 0").groupBy("kind").agg(F.max("capacity").alias("capacity"))
    inside = placed.filter("container is not null").join(F.broadcast(cap), "kind")
    before = F.coalesce(F.max(F.col("at") + F.col("n")).over(Window.partitionBy("kind", "container").orderBy("at", "n", "window_id", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flagged = inside.withColumn("overlap", (F.col("at") < before).cast("int")).withColumn("over", (F.col("at") + F.col("n") > F.col("capacity")).cast("int"))
    cut_short = ((F.col("start") > 0) & (F.col("start") % F.col("capacity") != 0)) | ((F.col("piece") > 0) & (F.col("start") < F.col("capacity")))
    return flagged.groupBy("kind").agg(
        F.sum((F.col("piece") == 0).cast("bigint")).alias("windows"), F.sum("n").alias("codes"), F.sum("over").alias("overfull"), F.sum("overlap").alias("overlaps"), F.sum(cut_short.cast("int")).alias("cut")
    )
