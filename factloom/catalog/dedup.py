"""Deduplication, splits, sampling and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.catalog.text import FINGER, NOT_WORD
from factloom.catalog.windows import running
from factloom.functions import text as T
from factloom.plans.session import cut, table
from factloom.registry import query

_LINES = "l AS (SELECT doc_id, source, ord, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", "source", "ord", F.posexplode(F.split("text", "\n")).alias("pos", "p"))


@query("dedup_paragraph", f"WITH {_LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY {FINGER.replace('{0}', 'p')} ORDER BY source NULLS FIRST, ord, doc_id, pos) AS n FROM l) SELECT doc_id, count(*) AS kept, sum(length(p))::BIGINT AS chars FROM k WHERE length(p) <= 60 OR n = 1 GROUP BY doc_id")
def dedup_paragraph(spark: SparkSession, d: str) -> DataFrame:
    """Long paragraphs where first seen, short ones always. The first is a min by key, so a hot paragraph is no hot task."""
    order = F.struct(F.col("source").isNotNull().alias("x"), "source", "ord", "doc_id", "pos")
    l = lines(spark, d).withColumn("k", T.fingerprint(F.col("p"))).withColumn("at", order)  # noqa: E741
    long = l.filter(F.length("p") > 60)
    first = long.groupBy("k").agg(F.min("at").alias("at"))
    kept = long.join(first, ["k", "at"], "left_semi").select("doc_id", "p").unionByName(l.filter(F.length("p") <= 60).select("doc_id", "p"))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.length("p")).alias("chars"))


@query("dedup_exact_text", "SELECT md5(trim(a)) AS text, min(fact_id) AS fact_id, count(*) AS copies FROM knowledge_real WHERE a IS NOT NULL GROUP BY 1")
def dedup_exact_text(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "knowledge_real").filter("a is not null").groupBy(F.md5(F.trim("a")).alias("text"))
    return k.agg(F.min("fact_id").alias("fact_id"), F.count(F.lit(1)).alias("copies"))


@query("dedup_dialogue", "WITH f AS (SELECT conv_id, arg_min(lower(trim(coalesce(text, ''))), (turn, sent_at)) AS k FROM dialogues GROUP BY conv_id), h AS (SELECT DISTINCT k FROM f WHERE conv_id % 10 = 1), s AS (SELECT conv_id, CASE WHEN conv_id % 10 = 1 THEN 'held' WHEN k IN (SELECT k FROM h) THEN 'overlap' WHEN row_number() OVER (PARTITION BY k, conv_id % 10 = 1 ORDER BY conv_id) > 1 THEN 'dup' ELSE 'kept' END AS status FROM f) SELECT status, count(*) AS n FROM s GROUP BY status")
def dedup_dialogue(spark: SparkSession, d: str) -> DataFrame:
    """By first turn: overlap with the held-out tenth counts before duplicates."""
    f = table(spark, d, "dialogues").groupBy("conv_id").agg(F.min_by(F.md5(F.lower(F.trim(T.text(F.col("text"))))), F.struct("turn", "sent_at")).alias("k"))
    held = f.filter("conv_id % 10 = 1").select("k").distinct().withColumn("h", F.lit(True))
    first = f.filter("conv_id % 10 <> 1").groupBy("k").agg(F.min("conv_id").alias("first"))
    s = f.join(held, "k", "left").join(first, "k", "left")
    status = F.when(F.col("conv_id") % 10 == 1, "held").when(F.col("h"), "overlap").when(F.col("conv_id") != F.col("first"), "dup").otherwise("kept")
    return s.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("dedup_first200", "SELECT substring(text, 1, 200) AS opening, count(*) AS docs, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dedup_first200(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").filter("text is not null").groupBy(F.substring("text", 1, 200).alias("opening"))
    return g.agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first")).filter("docs > 1")


@query("dedup_unseen", "WITH k AS (SELECT doc_id, source, md5(substring(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 120)) AS k FROM documents WHERE text IS NOT NULL) SELECT doc_id FROM k WHERE source LIKE 'web%' AND k NOT IN (SELECT k FROM k WHERE source NOT LIKE 'web%')")
def dedup_unseen(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "documents").filter("text is not null").select("doc_id", "source", F.md5(F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 120)).alias("k"))
    return k.filter("source like 'web%'").join(k.filter("source not like 'web%'").select("k").distinct(), "k", "left_anti").select("doc_id")


@query("para_hash8", f"WITH {_LINES} SELECT doc_id, pos::BIGINT AS pos, substring(sha256(lower(replace(regexp_replace(p, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), 'İ', 'i̇'))), 1, 16) AS k FROM l WHERE strlen(p) >= 40")
def para_hash8(spark: SparkSession, d: str) -> DataFrame:
    k = F.substring(F.sha2(F.lower(F.regexp_replace("p", r"\s+", " ")), 256), 1, 16)
    return lines(spark, d).filter(F.octet_length("p") >= 40).select("doc_id", F.col("pos").cast("bigint").alias("pos"), k.alias("k"))


@query("decontaminate_eval", f"WITH {_LINES}, e AS (SELECT passage_id, unnest(string_split(text, '. ')) AS p FROM eval_passages), t AS (SELECT DISTINCT lower(trim(unnest(string_split(p, '. ')), '.')) AS k FROM l) SELECT passage_id, count(*) AS sentences, count(*) FILTER (WHERE length(p) < 40 OR lower(trim(p, '.')) NOT IN (SELECT k FROM t)) AS clean FROM e GROUP BY passage_id")
def decontaminate_eval(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of held-out passages that no training line has; short ones stay."""
    tidy = lambda c: F.lower(F.btrim(c, F.lit(".")))
    e = table(spark, d, "eval_passages").select("passage_id", F.explode(F.split("text", r"\. ")).alias("p")).withColumn("k", tidy(F.col("p")))
    t = lines(spark, d).select(F.explode(F.split("p", r"\. ")).alias("s")).select(tidy(F.col("s")).alias("k")).distinct().withColumn("seen", F.lit(True))
    clean = (F.length("p") < 40) | F.col("seen").isNull()
    return e.join(t, "k", "left").groupBy("passage_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(clean).alias("clean"))


@query("split_positional", "SELECT fact_id, source, CASE WHEN n > 0.98 * total THEN 'held' ELSE 'train' END AS split FROM (SELECT fact_id, source, row_number() OVER (PARTITION BY source ORDER BY fact_id) AS n, count(*) OVER (PARTITION BY source) AS total FROM knowledge_real)")
def split_positional(spark: SparkSession, d: str) -> DataFrame:
    """The last fiftieth of each source is held out. Rows are ranked inside (source, slice of ids), so a source with a third
    of all rows is ranked by many tasks; the sizes of the slices before give the rest."""
    size = 2048
    k = table(spark, d, "knowledge_real").select("fact_id", "source").withColumn("slice", F.floor(F.col("fact_id") / size))
    c = k.groupBy("source", "slice").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("source")
    c = c.withColumn("before", F.coalesce(F.sum("c").over(w.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("c").over(w)).withColumnRenamed("source", "s2")
    n = k.withColumn("i", F.row_number().over(Window.partitionBy("source", "slice").orderBy("fact_id")))
    j = n.join(c, (n["slice"] == c["slice"]) & n["source"].eqNullSafe(c["s2"]))
    return j.select("fact_id", "source", F.when(F.col("before") + F.col("i") > 0.98 * F.col("total"), "held").otherwise("train").alias("split"))


@query("split_reserved", "SELECT item_id, item_id % 5 = 0 AS reserved FROM items")
def split_reserved(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("item_id", (F.col("item_id") % 5 == 0).alias("reserved"))


@query("sample_hash_order", "SELECT fact_id, h FROM (SELECT fact_id, md5(q) AS h FROM knowledge_real WHERE q IS NOT NULL) ORDER BY h, fact_id LIMIT 500")
def sample_hash_order(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 500 in the order of a hash."""
    return table(spark, d, "knowledge_real").filter("q is not null").select("fact_id", F.md5("q").alias("h")).orderBy("h", "fact_id").limit(500)


# Kinds of windows with their share of a mix.
SHARES = (("qa", 0.2), ("convo", 0.2), ("skills", 0.1), ("recall", 0.1), ("docqa", 0.1), ("rehearse", 0.1), ("buried", 0.1), ("story", 0.05), ("longconv", 0.05))


@query("mix_by_share", "SELECT step::BIGINT AS step, CASE " + " ".join(f"WHEN b < {round(sum(x for _, x in SHARES[: i + 1]) * 1000)} THEN '{k}'" for i, (k, _) in enumerate(SHARES)) + " END AS kind FROM (SELECT step, ('0x' || substring(md5(step::VARCHAR), 1, 8))::BIGINT % 1000 AS b FROM range(0, 20000) t(step))")
def mix_by_share(spark: SparkSession, d: str) -> DataFrame:
    """A kind for each of 20,000 steps, by hash against cumulative shares."""
    b, pick, total = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint") % 1000, None, 0.0
    for k, share in SHARES:
        total += share
        pick = F.when(b < round(total * 1000), k) if pick is None else pick.when(b < round(total * 1000), k)
    return spark.range(20_000).select(F.col("id").alias("step"), pick.alias("kind"))


@query("mix", f"""WITH h AS (SELECT *, ('0x' || substring(sha256(text), 7, 2) || substring(sha256(text), 5, 2) || substring(sha256(text), 3, 2) || substring(sha256(text), 1, 2))::BIGINT % 100 = 0 AS held FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, source, ord, held, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM h),
k AS (SELECT *, {FINGER.replace('{0}', 'p')} AS k FROM l), hk AS (SELECT DISTINCT k FROM k WHERE held AND length(p) >= 60),
leak AS (SELECT DISTINCT doc_id FROM k WHERE NOT held AND source LIKE 'evidence%' AND length(p) >= 60 AND k IN (SELECT k FROM hk)),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source NULLS FIRST, ord, doc_id, pos) AS n FROM k WHERE NOT held AND doc_id NOT IN (SELECT doc_id FROM leak)),
o AS (SELECT source, count(DISTINCT doc_id) AS docs, sum(length(p))::BIGINT AS chars FROM t WHERE length(p) <= 60 OR n = 1 GROUP BY source),
c AS (SELECT source, count(*) FILTER (WHERE held) AS held, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM leak)) AS leaks FROM h GROUP BY source)
SELECT c.source, coalesce(o.docs, 0) AS docs, coalesce(o.chars, 0) AS chars, c.held, c.leaks FROM c LEFT JOIN o ON c.source IS NOT DISTINCT FROM o.source""")
def mix(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of a training mix without budgets: hold out a hundredth by hash, drop evidence that touches it, keep long
    paragraphs where first seen, count by source."""
    docs = table(spark, d, "documents").filter("text is not null").withColumn("held", T.held_out_100(F.col("text")))
    order = F.struct(F.col("source").isNotNull().alias("x"), "source", "ord", "doc_id", "pos")
    k = docs.select("doc_id", "source", "ord", "held", F.posexplode(F.split("text", "\n")).alias("pos", "p")).withColumn("k", T.fingerprint(F.col("p"))).withColumn("at", order)
    long = F.length("p") >= 60
    held_keys = k.filter(F.col("held") & long).select("k").distinct()
    leaks = cut(k.filter(~F.col("held") & F.col("source").startswith("evidence") & long).join(held_keys, "k", "left_semi").select("doc_id").distinct())
    t = k.filter(~F.col("held")).join(leaks, "doc_id", "left_anti")
    first = t.groupBy("k").agg(F.min("at").alias("at"))
    kept = t.filter(F.length("p") > 60).join(first, ["k", "at"], "left_semi").select("doc_id", "source", "p").unionByName(t.filter(F.length("p") <= 60).select("doc_id", "source", "p"))
    by_doc = kept.groupBy("source", "doc_id").agg(F.sum(F.length("p")).alias("chars"))
    o = by_doc.groupBy(F.col("source").alias("s2")).agg(F.count(F.lit(1)).alias("docs"), F.sum("chars").alias("chars"))
    c = docs.join(leaks.withColumn("leak", F.lit(True)), "doc_id", "left").groupBy("source").agg(F.count_if("held").alias("held"), F.count_if("leak").alias("leaks"))
    return c.join(o, c["source"].eqNullSafe(o["s2"]), "left").select("source", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("chars", F.lit(0)).alias("chars"), "held", "leaks")


@query("set_overlap", "SELECT w FROM (SELECT unnest(regexp_extract_all(q, '[A-Z][a-z]{4,}')) AS w FROM items WHERE split = 'train') INTERSECT SELECT w FROM (SELECT unnest(regexp_extract_all(q, '[A-Z][a-z]{4,}')) AS w FROM items WHERE split <> 'train')")
def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Names that both training and evaluation items have."""
    w = table(spark, d, "items").select("split", F.explode(F.regexp_extract_all("q", F.lit("[A-Z][a-z]{4,}"), 0)).alias("w"))
    return w.filter("split = 'train'").select("w").intersect(w.filter("split <> 'train'").select("w"))


@query("set_except", "SELECT source, q FROM items WHERE split = 'dev' EXCEPT ALL SELECT source, q FROM items WHERE split = 'train'")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "items")
    return i.filter("split = 'dev'").select("source", "q").exceptAll(i.filter("split = 'train'").select("source", "q"))
