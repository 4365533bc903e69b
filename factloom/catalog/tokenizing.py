"""Scanner units, n-gram tables and code statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import encoder
from factloom.plans.session import cut, table
from factloom.registry import query

UNIT = encoder.JAVA_SCAN


@query("scan_units")
def scan_units(spark: SparkSession, d: str) -> DataFrame:
    """The scanner's units; put together they give the text again."""
    return table(spark, d, "documents").select("doc_id", F.regexp_extract_all(T.text(F.col("text")), F.lit(UNIT), 0).alias("units"))


@query("scan_round_trip", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def scan_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return scan_units(spark, d).select("doc_id", F.array_join("units", "").alias("text"))


def ngrams(windows: DataFrame, order: int) -> DataFrame:
    """(ctx, next, n): each context of order - 1 codes with the code that follows; grams are cut inside the row."""
    size = order - 1
    gram = F.transform(F.slice("codes", F.lit(1), F.greatest(F.size("codes") - size, F.lit(0))), lambda x, i: F.struct(F.slice("codes", i + 1, F.lit(size)).alias("ctx"), F.get("codes", i + size).alias("next")))
    return windows.filter("codes is not null").select(F.explode(gram).alias("g")).groupBy("g.ctx", "g.next").agg(F.count(F.lit(1)).alias("n"))


def follower_table(windows: DataFrame, order: int, top: int) -> DataFrame:
    """(ctx, followers, counts, total): the most frequent followers of each context, ties by smaller code."""
    n = ngrams(windows, order)
    ranked = n.withColumn("r", F.row_number().over(Window.partitionBy("ctx").orderBy(F.desc("n"), "next"))).withColumn("total", F.sum("n").over(Window.partitionBy("ctx")))
    kept = ranked.filter(F.col("r") <= top).groupBy("ctx").agg(F.sort_array(F.collect_list(F.struct("r", "next", "n"))).alias("f"), F.first("total").alias("total"))
    return kept.select("ctx", F.transform("f", lambda x: x["next"]).alias("followers"), F.transform("f", lambda x: x["n"]).alias("counts"), "total")


_GRAMS = "g AS (SELECT codes[i] AS ctx, codes[i + 1] AS next, count(*) AS n FROM (SELECT codes, unnest(range(1, len(codes))) AS i FROM windows WHERE codes IS NOT NULL) GROUP BY 1, 2)"


@query("agg_ngram", f"WITH {_GRAMS} SELECT ctx, next, n FROM g")
def agg_ngram(spark: SparkSession, d: str) -> DataFrame:
    return ngrams(table(spark, d, "windows"), 2).select(F.get("ctx", 0).alias("ctx"), "next", "n")


@query("ngram_table", f"WITH {_GRAMS}, r AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, next) AS r, sum(n) OVER (PARTITION BY ctx) AS total FROM g) SELECT [ctx] AS ctx, list(next ORDER BY r) AS followers, list(n ORDER BY r) AS counts, max(total)::BIGINT AS total FROM r WHERE r <= 16 GROUP BY ctx")
def ngram_table(spark: SparkSession, d: str) -> DataFrame:
    return follower_table(table(spark, d, "windows"), 2, 16)


@query("ngram_table3", "WITH g AS (SELECT [codes[i], codes[i + 1]] AS ctx, codes[i + 2] AS next, count(*) AS n FROM (SELECT codes, unnest(range(1, len(codes) - 1)) AS i FROM windows WHERE len(codes) > 2) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, next) AS r, sum(n) OVER (PARTITION BY ctx) AS total FROM g) SELECT ctx, list(next ORDER BY r) AS followers, list(n ORDER BY r) AS counts, max(total)::BIGINT AS total FROM r WHERE r <= 16 GROUP BY ctx")
def ngram_table3(spark: SparkSession, d: str) -> DataFrame:
    return follower_table(table(spark, d, "windows"), 3, 16)


@query("win_topk_followers", f"WITH {_GRAMS} SELECT ctx, next, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, next) AS rank FROM g) WHERE rank <= 3")
def win_topk_followers(spark: SparkSession, d: str) -> DataFrame:
    n = ngrams(table(spark, d, "windows"), 2).select(F.get("ctx", 0).alias("ctx"), "next", "n")
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("ctx").orderBy(F.desc("n"), "next"))).filter("rank <= 3")


@query("ngram_features", f"WITH {_GRAMS}, t AS (SELECT ctx, sum(n)::BIGINT AS total, arg_max(next, (n, -next)) AS top FROM g GROUP BY ctx), w AS (SELECT window_id, unnest(range(1, len(codes) + 1)) AS i, codes FROM windows WHERE codes IS NOT NULL) SELECT window_id, (i - 1)::BIGINT AS pos, coalesce(top, -1) AS top, coalesce(total, 0) AS total FROM w LEFT JOIN t ON t.ctx = w.codes[i]")
def ngram_features(spark: SparkSession, d: str) -> DataFrame:
    """For every position of the windows its context's top follower and total, -1 and 0 where unseen."""
    w = table(spark, d, "windows")
    t = ngrams(w, 2).groupBy(F.get("ctx", 0).alias("code")).agg(F.sum("n").alias("total"), F.max_by("next", F.struct("n", (-F.col("next")).alias("m"))).alias("top"))
    p = w.filter("codes is not null").select("window_id", F.posexplode("codes").alias("pos", "code"))
    return p.join(t, "code", "left").select("window_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce("top", F.lit(-1)).alias("top"), F.coalesce("total", F.lit(0)).alias("total"))


@query("ngram_conf", f"WITH {_GRAMS} SELECT ctx, round(ln(1 + sum(n)), 6) AS log_total, round(max(n) / sum(n), 6) AS top_share, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS bits FROM g GROUP BY ctx")
def ngram_conf(spark: SparkSession, d: str) -> DataFrame:
    """Of each context: log of its total, share of its top follower, entropy."""
    n = ngrams(table(spark, d, "windows"), 2).groupBy(F.get("ctx", 0).alias("ctx"))
    bits = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    return n.agg(F.round(F.log1p(F.sum("n")), 6).alias("log_total"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"), (F.round(bits, 6) + F.lit(0.0)).alias("bits"))


@query("stats_codes", "SELECT kind, count(*) AS windows, sum(len(codes))::BIGINT AS codes, round(avg(len(codes)), 6) AS mean, (SELECT count(DISTINCT c) FROM (SELECT kind AS k2, unnest(codes) AS c FROM windows) WHERE k2 = w.kind) AS used FROM windows w WHERE codes IS NOT NULL GROUP BY kind")
def stats_codes(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "windows").filter("codes is not null")
    s = w.groupBy("kind").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.size("codes")).alias("codes"), F.round(F.avg(F.size("codes")), 6).alias("mean"))
    used = w.select("kind", F.explode(F.array_distinct("codes")).alias("c")).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("used"))
    return s.join(used, "kind")


@query("repeat_banned", """SELECT window_id, list_sort(list_distinct(list_transform(list_filter(range(1, len(codes) - 1), lambda i: codes[i] = codes[-2] AND codes[i + 1] = codes[-1]), lambda i: codes[i + 2]))) AS banned
FROM windows WHERE len(codes) > 2""")
def repeat_banned(spark: SparkSession, d: str) -> DataFrame:
    """The codes that may not come next, as each would repeat three codes of its window."""
    w = table(spark, d, "windows").filter(F.size("codes") > 2)
    last = lambda k: F.element_at("codes", -k)
    after = F.filter(F.transform("codes", lambda x, i: F.when((x == last(2)) & (F.get("codes", i + 1) == last(1)), F.get("codes", i + 2))), lambda x: x.isNotNull())
    return w.select("window_id", F.array_sort(F.array_distinct(after)).alias("banned"))


@query("batch_pad", """WITH w AS (SELECT window_id, coalesce(codes, []) AS codes, max(coalesce(len(codes), 0)) OVER (PARTITION BY window_id // 64) AS n FROM windows)
SELECT window_id, list_concat(codes, list_transform(range(0, n - len(codes)), lambda i: 0)) AS padded, list_concat(list_transform(codes, lambda c: 1), list_transform(range(0, n - len(codes)), lambda i: 0)) AS mask FROM w""")
def batch_pad(spark: SparkSession, d: str) -> DataFrame:
    """Every window filled up with zeros to the longest of its batch of 64, and a mask of what is no filling."""
    w = table(spark, d, "windows").select("window_id", F.coalesce("codes", F.array().cast("array<int>")).alias("codes"))
    longest = F.max(F.size("codes")).over(Window.partitionBy(F.floor(F.col("window_id") / 64)))
    fill = w.withColumn("fill", F.array_repeat(F.lit(0), longest - F.size("codes")))
    return fill.select("window_id", F.concat("codes", "fill").alias("padded"), F.concat(F.transform("codes", lambda _: F.lit(1)), "fill").alias("mask"))


@query("audit_windows", "SELECT kind, count(*) AS n, count(*) FILTER (WHERE codes IS NULL OR len(codes) = 0) AS empty, count(*) FILTER (WHERE prompt_len IS NULL) AS no_prompt, count(*) FILTER (WHERE prompt_len > len(codes)) AS beyond, count(*) FILTER (WHERE len(gold) > 0) AS with_gold, count(*) - count(DISTINCT codes::VARCHAR) FILTER (WHERE codes IS NOT NULL) AS copies FROM windows GROUP BY kind")
def audit_windows(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "windows")
    c = F.count_if
    rows = w.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), c(F.col("codes").isNull() | (F.size("codes") == 0)).alias("empty"), c(F.col("prompt_len").isNull()).alias("no_prompt"), c(F.col("prompt_len") > F.size("codes")).alias("beyond"), c(F.size("gold") > 0).alias("with_gold"))
    texts = w.filter("codes is not null").select("kind", F.sha2(F.array_join(F.transform("codes", lambda x: x.cast("string")), ","), 256).alias("h")).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("texts"))
    return rows.join(texts, "kind", "left").select("kind", "n", "empty", "no_prompt", "beyond", "with_gold", (F.col("n") - F.coalesce("texts", F.lit(0))).alias("copies"))


@query("fit_pieces")
def fit_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary of 8,192 ids fitted on all documents."""
    entries = encoder.fit(table(spark, d, "documents"), "text").entries
    return spark.createDataFrame([(encoder.FIRST + i, k, b) for i, (k, b) in enumerate(entries)], "entry_id int, kind string, piece binary")


@query("encode")
def encode(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return encoder.encode(docs, encoder.fit(docs, "text"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query("decode", "SELECT doc_id AS id, coalesce(text, '') AS text FROM documents")
def decode(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    dictionary = encoder.fit(docs, "text")
    return encoder.decode(encoder.encode(docs, dictionary, "doc_id", "text"), dictionary)


@query("encode_hash", "SELECT u, (('0x' || substring(md5(u), 1, 7))::BIGINT % 512) * 1024 + ('0x' || substring(md5(u), 9, 7))::BIGINT % 1024 AS code, n FROM (SELECT u, count(*) AS n FROM (SELECT unnest(regexp_extract_all(q, '[A-Za-z]+')) AS u FROM items) GROUP BY u)")
def encode_hash(spark: SparkSession, d: str) -> DataFrame:
    """Words with a code of two hashed parts."""
    u = table(spark, d, "items").select(F.explode(F.regexp_extract_all("q", F.lit("[A-Za-z]+"), 0)).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    part = lambda at, m: F.conv(F.substring(F.md5("u"), at, 7), 16, 10).cast("bigint") % m
    return u.select("u", (part(1, 512) * 1024 + part(9, 1024)).alias("code"), "n")


@query("agg_phrase_cand", """WITH w AS (SELECT regexp_extract_all(lower(replace(text, 'İ', 'i̇')), '[a-z]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT unnest(flatten([list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' ')) for k in [2, 3, 4]])) AS phrase FROM w)
SELECT phrase, count(*) AS n FROM g GROUP BY phrase HAVING count(*) >= 20""")
def agg_phrase_cand(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of two to four words met twenty times or more. A longer phrase is at most as frequent as those inside it, so each
    length is counted only where both its shorter ones were frequent."""
    w = table(spark, d, "documents").filter("text is not null").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("w"))
    out, frequent = None, None
    for k in (2, 3, 4):
        own = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(0))), lambda x, i: F.array_join(F.slice("w", i + 1, F.lit(k)), " "))
        grams = w.select(F.explode(own).alias("phrase"))
        if frequent is not None:
            for part in (F.regexp_extract("phrase", r"^(.*) ", 1), F.regexp_extract("phrase", r"^[^ ]+ (.*)$", 1)):
                grams = grams.withColumn("part", part).join(frequent.select(F.col("phrase").alias("part")), "part", "left_semi").select("phrase")
        frequent = cut(grams.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20"))
        out = frequent if out is None else out.unionByName(frequent)
    return out


@query("agg_fidelity", "WITH u AS (SELECT w, count(*) AS n, ('0x' || substring(md5(w), 1, 3))::BIGINT AS code FROM (SELECT unnest(list_transform(regexp_extract_all(a, '[A-Za-z]+'), lambda x: lower(x))) AS w FROM knowledge_real) GROUP BY w), k AS (SELECT code, arg_max(w, (n, w)) AS kept FROM u GROUP BY code) SELECT round(sum(CASE WHEN w = kept THEN n * length(w) ELSE 0 END) / sum(n * length(w)), 9) AS exact, round(sum(CASE WHEN w <> kept THEN n * length(w) ELSE 0 END) / sum(n * length(w)), 9) AS collided FROM u JOIN k USING (code)")
def agg_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Shares of letters in words that keep their code of twelve bits, and in those that lose it."""
    u = table(spark, d, "knowledge_real").select(F.explode(T.words(F.col("a"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.conv(F.substring(F.md5("w"), 1, 3), 16, 10).cast("bigint"))
    j = u.join(u.groupBy("code").agg(F.max_by("w", F.struct("n", "w")).alias("kept")), "code").withColumn("m", F.col("n") * F.length("w"))
    share = lambda c: F.round(F.sum(F.when(c, F.col("m")).otherwise(0)) / F.sum("m"), 9)
    return j.agg(share(F.col("w") == F.col("kept")).alias("exact"), share(F.col("w") != F.col("kept")).alias("collided"))
