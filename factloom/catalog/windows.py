"""Ranks, running sums and other operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.catalog.nested import ONCE, turns
from factloom.functions import text as T
from factloom.plans.session import table
from factloom.registry import query


@query("win_first_seen", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(lower(trim(text))) ORDER BY source, ord, doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1")
def win_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each text; min_by combines before the shuffle, so a hot text is no hot task."""
    docs = table(spark, d, "documents").filter("text is not null")
    first = F.struct(F.col("source").isNull().alias("x"), "source", "ord", "doc_id")
    return docs.groupBy(F.md5(F.lower(F.trim("text"))).alias("k")).agg(F.min_by("doc_id", first).alias("doc_id")).select("doc_id")


def running(df: DataFrame, order: list, value: str, out: str, buckets: int = 64) -> DataFrame:
    """df with out, the sum of value up to each row in order, without a single-partition window over all rows.

    Rows are ranged into partitions; sums of whole partitions, one number each, give every partition its offset.
    """
    ranged = df.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    sums = ranged.groupBy("_p").agg(F.sum(value).alias("_s"))
    offsets = sums.withColumn("_o", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o")
    inside = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_i", inside).join(F.broadcast(offsets), "_p").withColumn(out, F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")


@query("win_byte_budget", "WITH r AS (SELECT doc_id, length(text) AS n, sum(length(text)) OVER (ORDER BY doc_id) AS upto FROM documents WHERE text IS NOT NULL), t AS (SELECT sum(length(text)) * 0.4 AS budget FROM documents) SELECT doc_id, upto::BIGINT AS upto FROM r, t WHERE upto <= budget")
def win_byte_budget(spark: SparkSession, d: str) -> DataFrame:
    """Documents by id until two fifths of all characters are reached."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.length("text").cast("bigint").alias("n"))
    budget = docs.agg((F.sum("n") * F.lit(0.4)).alias("budget"))
    return running(docs, ["doc_id"], "n", "upto").crossJoin(F.broadcast(budget)).filter("upto <= budget").select("doc_id", "upto")


@query("win_topk_session", "SELECT source, item_id, n, rank FROM (SELECT source, item_id, length(a) AS n, row_number() OVER (PARTITION BY source ORDER BY length(a) DESC, item_id DESC) AS rank FROM items WHERE a IS NOT NULL) WHERE rank <= 5")
def win_topk_session(spark: SparkSession, d: str) -> DataFrame:
    """Five longest answers of each source; the rank filter runs on both sides of the shuffle."""
    w = Window.partitionBy("source").orderBy(F.desc("n"), F.desc("item_id"))
    i = table(spark, d, "items").filter("a is not null").select("source", "item_id", F.length("a").alias("n"))
    return i.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")


_SIZES = f"WITH {ONCE}, s AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM d)"


def suffix(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return turns(spark, d).withColumn("n", F.length(T.text(F.col("text"))).cast("bigint")).withColumn("back", F.sum("n").over(w))


@query("win_history_kept", _SIZES + " SELECT conv_id, turn, CASE WHEN back <= 300 THEN n ELSE 300 - (back - n) END::BIGINT AS kept FROM s WHERE back <= 300 OR (back - n < 300 AND 300 - (back - n) > 32)")
def win_history_kept(spark: SparkSession, d: str) -> DataFrame:
    """Newest turns first into 300 characters; the first that doesn't fit gives its tail if more than 32 characters are left."""
    left = 300 - (F.col("back") - F.col("n"))
    s = suffix(spark, d).filter((F.col("back") <= 300) | ((left > 0) & (left > 32)))
    return s.select("conv_id", "turn", F.when(F.col("back") <= 300, F.col("n")).otherwise(left).alias("kept"))


@query("win_quarter_drop", _SIZES + " SELECT conv_id, min(turn) FILTER (WHERE back <= 1000 - 250) AS first_in FROM s GROUP BY conv_id")
def win_quarter_drop(spark: SparkSession, d: str) -> DataFrame:
    """The first turn that stays once a quarter of the context is freed."""
    return suffix(spark, d).groupBy("conv_id").agg(F.min(F.when(F.col("back") <= 750, F.col("turn"))).alias("first_in"))


@query("win_overfit_alarm", "WITH b AS (SELECT batch, avg(length(a)) AS x, avg(length(q)) AS y FROM knowledge_real GROUP BY batch), l AS (SELECT batch, x, y, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2 FROM b WINDOW w AS (ORDER BY batch)) SELECT batch, coalesce(x < x1 AND x1 < x2 AND y > y1 AND y1 > y2, false) AS alarm FROM l")
def win_overfit_alarm(spark: SparkSession, d: str) -> DataFrame:
    """One curve falls while the other rises over two checks; the window holds one row a batch."""
    b = table(spark, d, "knowledge_real").groupBy("batch").agg(F.avg(F.length("a")).alias("x"), F.avg(F.length("q")).alias("y"))
    w = Window.orderBy("batch")
    x1, x2, y1, y2 = F.lag("x", 1).over(w), F.lag("x", 2).over(w), F.lag("y", 1).over(w), F.lag("y", 2).over(w)
    return b.select("batch", F.coalesce((F.col("x") < x1) & (x1 < x2) & (F.col("y") > y1) & (y1 > y2), F.lit(False)).alias("alarm"))


def folded(spark: SparkSession, d: str) -> DataFrame:
    """By user, the values in order of time."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("es"))
    return e.select("user_id", F.transform("es", lambda x: x["value"]).alias("vs"))


@query("win_ema")
def win_ema(spark: SparkSession, d: str) -> DataFrame:
    """0.98 of the mean so far and 0.02 of the new value: an ordered fold."""
    return folded(spark, d).select("user_id", F.aggregate("vs", F.lit(None).cast("double"), lambda s, v: F.when(s.isNull(), v).otherwise(0.98 * s + 0.02 * v)).alias("ema"))


@query("win_running_best")
def win_running_best(spark: SparkSession, d: str) -> DataFrame:
    """The best value that improved by at least 0.5, and how many checks in a row did not."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"))
    step = lambda s, v: F.when(v < s["best"] - 0.5, F.struct(v.alias("best"), F.lit(0).alias("bad"))).otherwise(F.struct(s["best"].alias("best"), (s["bad"] + 1).alias("bad")))
    return folded(spark, d).select("user_id", F.aggregate("vs", start, step).alias("s")).select("user_id", "s.best", "s.bad")


@query("win_freq_rank", "SELECT kind, source, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, source NULLS LAST) AS rank FROM (SELECT kind, source, count(*) AS n FROM documents GROUP BY kind, source)")
def win_freq_rank(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").groupBy("kind", "source").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), F.col("source").asc_nulls_last())))


@query("win_paragraph_starts", "SELECT doc_id, len(list_filter(range(1, len(l) + 1), lambda i: l[i] <> '' AND (i = 1 OR l[i - 1] = '')))::BIGINT AS starts FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)")
def win_paragraph_starts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    starts = F.filter("l", lambda x, i: (x != "") & ((i == 0) | (F.get("l", i - 1) == "")))
    return docs.select("doc_id", F.size(starts).cast("bigint").alias("starts"))


@query(
    "win_nearest_depth",
    """WITH p AS (SELECT doc_id, text, unnest(l) AS sentence, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, text, regexp_split_to_array(text, '[.!?][ \\n]') AS l FROM documents WHERE length(text) > 0)),
a AS (SELECT doc_id, sentence, pos, (coalesce(sum(length(sentence) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / length(text) AS rel FROM p)
SELECT doc_id, depth::DOUBLE AS depth, arg_min(pos, (round(abs(rel - depth), 9), pos))::BIGINT AS pos FROM a, (VALUES (0.1), (0.5), (0.9)) t(depth) GROUP BY ALL""",
)
def win_nearest_depth(spark: SparkSession, d: str) -> DataFrame:
    """For three depths the number of the sentence that begins nearest to it, of equal ones the earlier."""
    docs = table(spark, d, "documents").filter("length(text) > 0").select("doc_id", "text", F.posexplode(F.split("text", r"[.!?][ \n]")).alias("pos", "sentence"))
    before = F.sum(F.length("sentence") + 2).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    placed = docs.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), (F.coalesce(before, F.lit(0)) / F.length("text")).alias("at"))
    at = placed.withColumn("depth", F.explode(F.array(*map(F.lit, (0.1, 0.5, 0.9)))))
    return at.groupBy("doc_id", "depth").agg(F.min_by("pos", F.struct(F.round(F.abs(F.col("at") - F.col("depth")), 9), "pos")).alias("pos"))

