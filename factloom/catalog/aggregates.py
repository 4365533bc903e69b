"""Counts, ratios, histograms, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.plans.session import table
from factloom.registry import query

WORDS = "(SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: lower(w))) AS w FROM documents)"


def doc_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(T.words(F.col("text"))).alias("w"))


@query("agg_unit_counts", f"SELECT w, count(*) AS n FROM {WORDS} WHERE length(w) >= 2 GROUP BY w")
def agg_unit_counts(spark: SparkSession, d: str) -> DataFrame:
    return doc_words(spark, d).filter(F.length("w") >= 2).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("agg_df_idf", f"WITH t AS (SELECT count(*) AS n FROM documents), f AS (SELECT w, count(DISTINCT doc_id) AS df FROM {WORDS} GROUP BY w) SELECT w, df, round(ln((1 + n) / (1 + df)), 9) AS idf FROM f, t")
def agg_df_idf(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and idf; words are made distinct inside each document, so no distinct aggregate is shuffled."""
    docs = table(spark, d, "documents")
    f = docs.select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    return f.crossJoin(F.broadcast(total)).select("w", "df", F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))), 9).alias("idf"))


@query("agg_bincount", "SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM windows) GROUP BY code")
def agg_bincount(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "windows").select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("agg_source_counts", "SELECT source, kind, count(*) AS docs, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM documents GROUP BY source, kind")
def agg_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "kind").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("chars"))


@query("sink_manifest", "SELECT source, count(*) AS rows, count(DISTINCT q) AS questions, count(*) FILTER (WHERE a IS NULL OR trim(a) = '') AS empty, min(batch) AS first, max(batch) AS last FROM knowledge_real GROUP BY source")
def sink_manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_real").groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("q").alias("questions"), F.count_if(F.col("a").isNull() | (F.trim("a") == "")).alias("empty"), F.min("batch").alias("first"), F.max("batch").alias("last"))


@query("agg_percentiles", "SELECT kind, count(*) AS n, round(quantile_cont(len(codes), 0.5), 6) AS p50, round(quantile_cont(len(codes), 0.95), 6) AS p95, round(quantile_cont(len(codes), 0.99), 6) AS p99, max(len(codes)) AS top FROM windows WHERE codes IS NOT NULL GROUP BY kind")
def agg_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    w = table(spark, d, "windows").filter("codes is not null").withColumn("n", F.size("codes"))
    p = [F.round(F.percentile("n", x), 6).alias(name) for x, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return w.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *p, F.max("n").cast("bigint").alias("top")).select("kind", F.col("n"), "p50", "p95", "p99", "top")


@query("agg_dups", "SELECT source, sum(n - 1)::BIGINT AS extra, count(*) AS texts FROM (SELECT source, lower(trim(a)) AS t, count(*) AS n FROM knowledge_real WHERE a IS NOT NULL GROUP BY source, t) GROUP BY source")
def agg_dups(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "knowledge_real").filter("a is not null").groupBy("source", F.md5(F.lower(F.trim("a"))).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy("source").agg(F.sum(F.col("n") - 1).alias("extra"), F.count(F.lit(1)).alias("texts"))


_RATE = "sum(CASE WHEN hit THEN 1 ELSE 0 END)::BIGINT AS k, count(*) AS n"
_WILSON = "SELECT {keys}, k, n, round(k / n, 6) AS share, round(greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS low, round(least(1, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM g"


def rated(g: DataFrame, *keys: str) -> DataFrame:
    """k, n, share and its Wilson interval."""
    low, high = T.wilson(F.col("k"), F.col("n"))
    return g.select(*keys, "k", "n", F.round(F.col("k") / F.col("n"), 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("agg_rate_wilson", f"WITH g AS (SELECT split, {_RATE} FROM (SELECT split, a LIKE '%.' AS hit FROM items WHERE a IS NOT NULL) GROUP BY split) " + _WILSON.format(keys="split"))
def agg_rate_wilson(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "items").filter("a is not null").groupBy("split").agg(F.count_if(F.col("a").endswith(".")).alias("k"), F.count(F.lit(1)).alias("n"))
    return rated(g, "split")


@query("agg_pool_seeds", "SELECT source, sum(k)::BIGINT AS k, sum(n)::BIGINT AS n, round(sum(k) / sum(n), 9) AS pooled, round(avg(k / n), 9) AS mean FROM (SELECT source, split, sum(CASE WHEN length(a) > 40 THEN 1 ELSE 0 END) AS k, count(*) AS n FROM items GROUP BY source, split) GROUP BY source")
def agg_pool_seeds(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "items").groupBy("source", "split").agg(F.count_if(F.length("a") > 40).alias("k"), F.count(F.lit(1)).alias("n"))
    return runs.groupBy("source").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.round(F.sum("k") / F.sum("n"), 9).alias("pooled"), F.round(F.avg(F.col("k") / F.col("n")), 9).alias("mean"))


@query("agg_grounding", "SELECT split, count(*) FILTER (WHERE s = 'right') AS grounded, count(*) FILTER (WHERE s = 'refused') AS refused, count(*) FILTER (WHERE s = 'copied') AS copied, count(*) FILTER (WHERE s = 'invented') AS invented FROM (SELECT split, CASE WHEN a IS NULL OR trim(a) = '' THEN 'refused' WHEN lower(a) = lower(q) THEN 'copied' WHEN len(list_intersect(list_distinct(regexp_extract_all(lower(a), '[a-z]+')), list_distinct(regexp_extract_all(lower(coalesce(q, '')), '[a-z]+')))) >= 2 THEN 'right' ELSE 'invented' END AS s FROM items) GROUP BY split")
def agg_grounding(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.regexp_extract_all(F.lower(T.text(F.col(c))), F.lit("[a-z]+"), 0)
    status = F.when(F.col("a").isNull() | (F.trim("a") == ""), "refused").when(F.lower("a") == F.lower("q"), "copied").when(F.size(F.array_intersect(words("a"), words("q"))) >= 2, "right").otherwise("invented")
    s = table(spark, d, "items").select("split", status.alias("s"))
    return s.groupBy("split").agg(*[F.count_if(F.col("s") == v).alias(n) for v, n in (("right", "grounded"), ("refused", "refused"), ("copied", "copied"), ("invented", "invented"))])


@query("agg_by_age", "WITH t AS (SELECT conv_id, turn / (max(turn) OVER (PARTITION BY conv_id) + 1) AS age, length(coalesce(text, '')) AS n FROM dialogues) SELECT CASE WHEN age < 0.1 THEN 'first' WHEN age > 0.9 THEN 'last' ELSE 'middle' END AS part, count(*) AS turns, round(avg(n), 6) AS chars FROM t GROUP BY part")
def agg_by_age(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dialogues").withColumn("age", F.col("turn") / (F.max("turn").over(Window.partitionBy("conv_id")) + 1))
    part = F.when(F.col("age") < 0.1, "first").when(F.col("age") > 0.9, "last").otherwise("middle")
    return t.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("turns"), F.round(F.avg(F.length(T.text(F.col("text")))), 6).alias("chars"))


@query("agg_grid", "SELECT kind, lang, source, count(*) AS n, round(avg(n_chars), 6) AS chars FROM documents WHERE n_chars IS NOT NULL GROUP BY GROUPING SETS ((kind), (lang), (source), (kind, lang, source))")
def agg_grid(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("n_chars is not null").select("kind", "lang", "source", "n_chars")
    cols = [F.col("kind"), F.col("lang"), F.col("source")]
    return t.groupingSets([[cols[0]], [cols[1]], [cols[2]], cols], *cols).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("chars"))


@query("agg_f1_tokens", """WITH w AS (SELECT item_id, list_transform(regexp_extract_all(coalesce(q,''), '[A-Za-z]+'), lambda x: lower(x)) AS p, list_transform(regexp_extract_all(coalesce(a,''), '[A-Za-z]+'), lambda x: lower(x)) AS g FROM items),
c AS (SELECT item_id, len(p) AS np, len(g) AS ng, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0) AS common FROM w)
SELECT item_id, round(CASE WHEN np + ng > 0 THEN 2 * common / (np + ng) ELSE 0 END, 9) AS f1 FROM c""")
def agg_f1_tokens(spark: SparkSession, d: str) -> DataFrame:
    """F1 of two bags of words, kept inside the row."""
    p, g = T.words(T.text(F.col("q"))), T.words(T.text(F.col("a")))
    w = table(spark, d, "items").select("item_id", p.alias("p"), g.alias("g"))
    count = lambda bag, x: F.size(F.filter(F.col(bag), lambda y: y == x))
    both = F.aggregate(F.transform(F.array_distinct("p"), lambda x: F.least(count("p", x), count("g", x))), F.lit(0), lambda s, x: s + x)
    n = F.size("p") + F.size("g")
    return w.select("item_id", F.round(F.when(n > 0, 2 * both / n).otherwise(0.0), 9).alias("f1"))


@query("agg_repetition", "WITH w AS (SELECT doc_id, regexp_extract_all(lower(replace(text, 'İ', 'i̇')), '[a-z]+') AS w FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) AS t FROM w) SELECT doc_id, round(CASE WHEN len(t) > 0 THEN 1 - len(list_distinct(t)) / len(t) ELSE 0 END, 9) AS repetition FROM t")
def agg_repetition(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").filter("text is not null").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("w"))
    grams = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1), F.get("w", i + 2)))
    t = w.select("doc_id", grams.alias("t"))
    return t.select("doc_id", F.round(F.when(F.size("t") > 0, 1 - F.size(F.array_distinct("t")) / F.size("t")).otherwise(0.0), 9).alias("repetition"))


@query("agg_class_bits", "WITH c AS (SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM windows) GROUP BY code), r AS (SELECT code, n, row_number() OVER (ORDER BY n DESC, code) AS r FROM c) SELECT CASE WHEN r <= 100 THEN 'top100' WHEN r <= 1000 THEN 'top1000' ELSE 'rest' END AS band, count(*) AS codes, sum(n)::BIGINT AS uses FROM r GROUP BY band")
def agg_class_bits(spark: SparkSession, d: str) -> DataFrame:
    """Uses by frequency band; only the thousand most frequent codes are ranked, the rest needs no order."""
    c = table(spark, d, "windows").select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    top = c.orderBy(F.desc("n"), "code").limit(1000).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "code"))).select("code", "r")
    band = F.when(F.col("r") <= 100, "top100").when(F.col("r") <= 1000, "top1000").otherwise("rest")
    return c.join(F.broadcast(top), "code", "left").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("codes"), F.sum("n").alias("uses"))


@query("agg_bits_per_byte", "SELECT kind, round(sum(loo * len(codes)) / sum(len(codes)), 6) AS weighted, count(*) AS windows FROM windows WHERE len(codes) > 0 AND loo IS NOT NULL GROUP BY kind")
def agg_bits_per_byte(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "windows").filter("size(codes) > 0 and loo is not null")
    return w.groupBy("kind").agg(F.round(F.sum(F.col("loo") * F.size("codes")) / F.sum(F.size("codes")), 6).alias("weighted"), F.count(F.lit(1)).alias("windows"))


@query("agg_passes", "WITH k AS (SELECT kind, count(*) AS n FROM windows GROUP BY kind), t AS (SELECT sum(n) AS total FROM k) SELECT kind, n, round(total / 9 / n, 9) AS passes FROM k, t")
def agg_passes(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "windows").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return k.crossJoin(F.broadcast(k.agg(F.sum("n").alias("total")))).select("kind", "n", F.round(F.col("total") / 9 / F.col("n"), 9).alias("passes"))


@query("agg_arms", "WITH a AS (SELECT kind, split, round(avg(len(codes)), 6) AS m FROM windows WHERE codes IS NOT NULL GROUP BY kind, split) SELECT kind, arg_max(split, (m, split)) AS best, max(m) AS value FROM a GROUP BY kind")
def agg_arms(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "windows").filter("codes is not null").groupBy("kind", "split").agg(F.round(F.avg(F.size("codes")), 6).alias("m"))
    return a.groupBy("kind").agg(F.max_by("split", F.struct("m", "split")).alias("best"), F.max("m").alias("value"))


@query("agg_energy", "SELECT user_id, round(avg(value) * (epoch(max(ts)) - epoch(min(ts))), 3) AS energy, count(*) AS samples FROM events GROUP BY user_id")
def agg_energy(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the samples times the seconds they span."""
    seconds = F.max(F.col("ts").cast("timestamp").cast("double")) - F.min(F.col("ts").cast("timestamp").cast("double"))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value") * seconds, 3).alias("energy"), F.count(F.lit(1)).alias("samples"))


@query("agg_collisions", f"WITH u AS (SELECT w, count(*) AS n, ('0x' || substring(md5(w), 1, 3))::BIGINT AS code FROM {WORDS} GROUP BY w) SELECT code, arg_max(w, (n, w)) AS kept, count(*) - 1 AS lost, (sum(n) - max(n))::BIGINT AS lost_mass FROM u GROUP BY code")
def agg_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Words that share a code of twelve bits: the most frequent keeps it."""
    u = doc_words(spark, d).groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.conv(F.substring(F.md5("w"), 1, 3), 16, 10).cast("bigint"))
    return u.groupBy("code").agg(F.max_by("w", F.struct("n", "w")).alias("kept"), (F.count(F.lit(1)) - 1).alias("lost"), (F.sum("n") - F.max("n")).alias("lost_mass"))


@query("agg_auc", """WITH s AS (SELECT n_chars AS x, kind = 'article' AS pos FROM documents WHERE n_chars IS NOT NULL),
c AS (SELECT x, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS q FROM s GROUP BY x),
r AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT round(sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0), 9) AS auc FROM r""")
def agg_auc(spark: SparkSession, d: str) -> DataFrame:
    """Rank AUC of text length for articles: counts by value first, so the running sum passes distinct values only."""
    s = table(spark, d, "documents").filter("n_chars is not null")
    c = s.groupBy(F.col("n_chars").alias("x")).agg(F.count_if(F.col("kind") == "article").alias("p"), F.count_if(F.col("kind") != "article").alias("q"))
    below = F.coalesce(F.sum("q").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = c.withColumn("below", below)
    return r.agg(F.round(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")), 9).alias("auc"))


@query("agg_confusion", """WITH s AS (SELECT least(n_chars / 5000, 1) AS x, kind = 'article' AS pos FROM documents WHERE n_chars IS NOT NULL), t AS (SELECT unnest(range(1, 20)) * 5 AS pct)
SELECT pct::INT AS pct, count(*) FILTER (WHERE x * 100 >= pct AND pos) AS tp, count(*) FILTER (WHERE x * 100 >= pct AND NOT pos) AS fp, count(*) FILTER (WHERE x * 100 < pct AND pos) AS fn FROM s, t GROUP BY pct""")
def agg_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Confusion by nineteen thresholds: one pass with conditional counts, no row is multiplied."""
    x = F.least(F.col("n_chars") / 5000, F.lit(1.0)) * 100
    pos = F.col("kind") == "article"
    s = table(spark, d, "documents").filter("n_chars is not null")
    cells = [F.struct(F.lit(p).alias("pct"), F.count_if((x >= p) & pos).alias("tp"), F.count_if((x >= p) & ~pos).alias("fp"), F.count_if((x < p) & pos).alias("fn")) for p in range(5, 100, 5)]
    return s.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).select(F.explode(F.array(*[f"c{i}" for i in range(len(cells))])).alias("c")).select("c.*")
