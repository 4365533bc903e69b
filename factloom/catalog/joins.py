"""Semi, anti, as-of, range, nearest-neighbour and similarity joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.catalog.nested import ONCE, turns
from factloom.catalog.text import FINGER
from factloom.functions import text as T
from factloom.plans.session import table
from factloom.registry import query

# Sentences of 40 characters or more, by the fingerprint of their words.
PARTS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '[.!?]+[ \\n]+'), lambda s: length(s) >= 40)"


def parts(c: Column) -> Column:
    return F.filter(F.split(T.text(c), r"[.!?]+[ \n]+"), lambda s: F.length(s) >= 40)


def keyed(df: DataFrame, key: str, col: str) -> DataFrame:
    return df.select(key, F.explode(parts(F.col(col))).alias("s")).select(key, T.fingerprint(F.col("s")).alias("k"))


_DOC = f"d AS (SELECT doc_id, {FINGER.replace('{0}', 's')} AS k FROM (SELECT doc_id, unnest({PARTS.replace('{0}', 'text')}) AS s FROM documents))"
_HELD = f"h AS (SELECT DISTINCT {FINGER.replace('{0}', 's')} AS k FROM (SELECT unnest({PARTS.replace('{0}', 'text')}) AS s FROM eval_passages))"


@query("join_anti_heldout", f"WITH {_DOC}, {_HELD} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d WHERE k IN (SELECT k FROM h))")
def join_anti_heldout(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a sentence of the held-out passages."""
    docs = table(spark, d, "documents")
    held = keyed(table(spark, d, "eval_passages"), "passage_id", "text").select("k").distinct()
    return docs.select("doc_id").join(keyed(docs, "doc_id", "text").join(held, "k", "left_semi"), "doc_id", "left_anti")


@query("join_semi_trained", f"WITH {ONCE}, r AS (SELECT conv_id, md5(lower(trim(coalesce(text, '')))) AS k FROM d WHERE role = 'assistant') SELECT DISTINCT conv_id FROM r WHERE conv_id % 10 = 1 AND conv_id NOT IN (SELECT a.conv_id FROM r a JOIN r b ON a.k = b.k WHERE a.conv_id % 10 = 1 AND b.conv_id % 10 <> 1)")
def join_semi_trained(spark: SparkSession, d: str) -> DataFrame:
    """Held-out conversations (a tenth, by id) none of whose replies was trained on."""
    r = turns(spark, d).filter("role = 'assistant'").select("conv_id", F.md5(F.lower(F.trim(T.text(F.col("text"))))).alias("k"))
    held, trained = r.filter("conv_id % 10 = 1"), r.filter("conv_id % 10 <> 1").select("k").distinct()
    return held.select("conv_id").distinct().join(held.join(trained, "k", "left_semi"), "conv_id", "left_anti")


@query("join_anti_split", "SELECT item_id FROM items e WHERE split <> 'train' AND NOT EXISTS (SELECT 1 FROM items t WHERE t.split = 'train' AND t.q IS NOT DISTINCT FROM e.q AND t.a IS NOT DISTINCT FROM e.a)")
def join_anti_split(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "items").withColumn("k", F.md5(F.to_json(F.struct("q", "a"))))
    return items.filter("split <> 'train'").join(items.filter("split = 'train'").select("k").distinct(), "k", "left_anti").select("item_id")


@query("join_anti_lines", f"WITH {_DOC}, p AS (SELECT passage_id, {FINGER.replace('{0}', 's')} AS k FROM (SELECT passage_id, unnest({PARTS.replace('{0}', 'text')}) AS s FROM eval_passages)), f AS (SELECT passage_id, k, row_number() OVER (PARTITION BY k ORDER BY passage_id) AS n FROM p) SELECT passage_id, k FROM f WHERE n = 1 AND k NOT IN (SELECT k FROM d)")
def join_anti_lines(spark: SparkSession, d: str) -> DataFrame:
    """Held-out sentences that no document has, each where first seen."""
    p = keyed(table(spark, d, "eval_passages"), "passage_id", "text").groupBy("k").agg(F.min("passage_id").alias("passage_id"))
    return p.join(keyed(table(spark, d, "documents"), "doc_id", "text").select("k").distinct(), "k", "left_anti").select("passage_id", "k")


@query("join_id_dedup", "SELECT conv_id, count(*) AS items FROM items WHERE conv_id IS NOT NULL AND conv_id NOT IN (SELECT conv_id FROM dialogues WHERE conv_id IS NOT NULL) GROUP BY conv_id")
def join_id_dedup(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "dialogues").select("conv_id").distinct()
    return table(spark, d, "items").filter("conv_id is not null").join(known, "conv_id", "left_anti").groupBy("conv_id").agg(F.count(F.lit(1)).alias("items"))


@query("join_exact_key", "WITH f AS (SELECT lower(trim(key)) AS k, min(fact_id) AS first, count(*) AS copies FROM knowledge_real WHERE key IS NOT NULL GROUP BY 1) SELECT i.fact_id, f.first, f.copies FROM knowledge_real i JOIN f ON lower(trim(i.q)) = f.k")
def join_exact_key(spark: SparkSession, d: str) -> DataFrame:
    """Questions that are a fact's key; the first stored fact of a key wins. Keys are unique on one side, so a hot question
    is split by adaptive execution without multiplying rows."""
    k = table(spark, d, "knowledge_real")
    f = k.filter("key is not null").groupBy(F.lower(F.trim("key")).alias("k")).agg(F.min("fact_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    return k.select("fact_id", F.lower(F.trim("q")).alias("k")).join(f, "k").select("fact_id", "first", "copies")


@query("join_index_lookup", """WITH s AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(q,'')), '[a-z]{5,}'))) AS w FROM items WHERE split <> 'train'),
p AS (SELECT fact_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(q,'')), '[a-z]{5,}'))) AS w FROM knowledge_real),
df AS (SELECT w, count(*) AS df FROM p GROUP BY w HAVING count(*) <= 0.05 * (SELECT count(*) FROM knowledge_real))
SELECT item_id, fact_id, count(*) AS shared FROM s JOIN df USING (w) JOIN p USING (w) GROUP BY item_id, fact_id""")
def join_index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Query words to postings to facts; a word is posted if at most a twentieth of the facts hold it."""
    tokens = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(T.text(F.col(c))), F.lit("[a-z]{5,}"), 0)))
    s = table(spark, d, "items").filter("split <> 'train'").select("item_id", tokens("q").alias("w"))
    p = table(spark, d, "knowledge_real").select("fact_id", tokens("q").alias("w"))
    total = F.broadcast(table(spark, d, "knowledge_real").agg(F.count(F.lit(1)).alias("n")))
    rare = p.groupBy("w").agg(F.count(F.lit(1)).alias("df")).crossJoin(total).filter("df <= 0.05 * n").select("w")
    return s.join(rare, "w").join(p, "w").groupBy("item_id", "fact_id").agg(F.count(F.lit(1)).alias("shared"))


def nearest(vectors: DataFrame, k: int, every: int = 50, block: int = 4096) -> DataFrame:
    """(vec_id, neighbour, sim, rank): of every vector whose id is divisible by `every`, the k nearest others by cosine.

    Queries go through the table in blocks of at most `block`, each broadcast by itself; a task keeps k candidates a query,
    so what is shuffled is queries times tasks times k. Null and zero vectors and vectors of another length are left out.
    """
    spark = vectors.sparkSession
    base = vectors.filter("vec_id is not null and embedding is not null and size(embedding) > 0").select("vec_id", "embedding")
    out = None
    queries = base.filter(F.col("vec_id") % every == 0).withColumn("n", F.xxhash64("vec_id"))
    total = queries.count()
    blocks = max(1, -(-total // block))
    for b in range(blocks):
        part = queries.filter(F.pmod("n", F.lit(blocks)) == b).collect()
        if not part:
            continue
        ids, mat = np.asarray([r["vec_id"] for r in part], np.int64), np.asarray([r["embedding"] for r in part], np.float64)
        mat /= np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-12)
        blob = spark.sparkContext.broadcast((ids, mat))

        def best(batches: Iterator[pd.DataFrame], blob=blob) -> Iterator[pd.DataFrame]:
            qids, qmat = blob.value
            kept = [np.empty((0, 2))] * len(qids)
            for pdf in batches:
                pdf = pdf[pdf["embedding"].map(len) == qmat.shape[1]]
                if not len(pdf):
                    continue
                v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                own, sims = pdf["vec_id"].to_numpy(np.int64), qmat @ v.T
                for i, q in enumerate(qids):
                    row = np.where(own == q, -np.inf, sims[i])
                    top = np.argpartition(-row, min(k, len(row) - 1))[: k + 1]
                    both = np.concatenate([kept[i], np.stack([own[top], row[top]], 1)])
                    both = both[np.isfinite(both[:, 1])]
                    kept[i] = both[np.lexsort((both[:, 0], -both[:, 1]))][:k]
            rows = [(int(q), int(n), float(s)) for q, ns in zip(qids, kept) for n, s in ns]
            yield pd.DataFrame(rows, columns=["vec_id", "neighbour", "sim"])

        found = base.mapInPandas(best, "vec_id bigint, neighbour bigint, sim double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "vec_id bigint, neighbour bigint, sim double, rank int")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("sim"), "neighbour"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


_COS = "(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))"


@query("join_knn", f"WITH s AS (SELECT a.vec_id, b.vec_id AS neighbour, {_COS} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbour) AS rank FROM s) SELECT vec_id, neighbour, round(sim, 6) AS sim, rank FROM r WHERE rank <= 4")
def join_knn(spark: SparkSession, d: str) -> DataFrame:
    return nearest(table(spark, d, "embeddings"), 4).withColumn("sim", F.round("sim", 6))


@query("join_rank_diag", f"WITH s AS (SELECT a.vec_id, a.label = b.label AS same, {_COS} AS sim, b.vec_id AS other FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS rank FROM s) SELECT vec_id, count(*) FILTER (WHERE same AND rank <= 1) AS at1, count(*) FILTER (WHERE same AND rank <= 10) AS at10 FROM r GROUP BY vec_id")
def join_rank_diag(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the same label among the nearest one and ten."""
    e = table(spark, d, "embeddings")
    n = nearest(e, 10).join(e.select("vec_id", "label"), "vec_id").join(e.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("other")), "neighbour")
    same = F.col("label") == F.col("other")
    return n.groupBy("vec_id").agg(F.count_if(same & (F.col("rank") <= 1)).alias("at1"), F.count_if(same).alias("at10"))


@query("join_latest", "SELECT source, arg_max(fact_id, (added_at, fact_id)) AS fact_id, max(added_at) AS added_at FROM knowledge_real WHERE added_at IS NOT NULL GROUP BY source")
def join_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest record of each source, as max_by with a tie rule: partial results combine before the shuffle."""
    k = table(spark, d, "knowledge_real").filter("added_at is not null")
    return k.groupBy("source").agg(F.max_by("fact_id", F.struct("added_at", "fact_id")).alias("fact_id"), F.max("added_at").alias("added_at"))


@query("join_asof", f"WITH {ONCE}, i AS (SELECT item_id, conv_id, turn FROM items WHERE conv_id IS NOT NULL) SELECT i.item_id, max(d.turn) AS told FROM i JOIN d ON i.conv_id = d.conv_id AND d.turn <= i.turn AND d.role = 'user' GROUP BY i.item_id")
def join_asof(spark: SparkSession, d: str) -> DataFrame:
    """The last user turn at or before each item: both sides in one stream by conversation and turn, carried forward."""
    told = turns(spark, d).filter("role = 'user'").select("conv_id", "turn", F.col("turn").alias("told"), F.lit(None).cast("bigint").alias("item_id"))
    asked = table(spark, d, "items").filter("conv_id is not null").select("conv_id", "turn", F.lit(None).cast("int").alias("told"), "item_id")
    w = Window.partitionBy("conv_id").orderBy("turn", F.col("item_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = told.unionByName(asked).withColumn("told", F.last("told", ignorenulls=True).over(w))
    return both.filter("item_id is not null and told is not null").select("item_id", "told")


@query("join_range_window", f"WITH {ONCE}, f AS (SELECT conv_id, max(turn) - 3 AS first_in FROM d GROUP BY conv_id) SELECT item_id, turn >= first_in AS skipped FROM items JOIN f USING (conv_id)")
def join_range_window(spark: SparkSession, d: str) -> DataFrame:
    """Items whose turn still stands in the window of the last four turns."""
    f = turns(spark, d).groupBy("conv_id").agg((F.max("turn") - 3).alias("first_in"))
    return table(spark, d, "items").join(f, "conv_id").select("item_id", (F.col("turn") >= F.col("first_in")).alias("skipped"))


# Statement templates, most specific first.
TEMPLATES = [("moved", r"^Actually, (.+?) moved to ([^ ]+)"), ("told", r"^I told you that (.+?), my [a-z]+, keeps (?:a|an) ([a-z]+)"), ("lives", r"^My [a-z]+ (.+?) lives in ([^ ]+)"), ("works", r"^(.+?) starts work at ([0-9]+)")]


@query("join_pattern", "SELECT item_id, CASE " + " ".join(f"WHEN regexp_matches(q, '{rx}') THEN '{n}'" for n, rx in TEMPLATES) + " END AS attribute, CASE " + " ".join(f"WHEN regexp_matches(q, '{rx}') THEN regexp_extract(q, '{rx}', 1)" for _, rx in TEMPLATES) + " END AS who, CASE " + " ".join(f"WHEN regexp_matches(q, '{rx}') THEN regexp_extract(q, '{rx}', 2)" for _, rx in TEMPLATES) + " END AS value FROM items WHERE " + " OR ".join(f"regexp_matches(q, '{rx}')" for _, rx in TEMPLATES))
def join_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Statements read by templates: the bank is an expression, so no table is multiplied by it."""
    q, any_ = F.col("q"), F.lit(False)
    out: dict[str, Column | None] = {"attribute": None, "who": None, "value": None}
    for n, rx in TEMPLATES:
        any_ = any_ | q.rlike(rx)
        for k, v in (("attribute", F.lit(n)), ("who", F.regexp_extract(q, rx, 1)), ("value", F.regexp_extract(q, rx, 2))):
            out[k] = F.when(q.rlike(rx), v) if out[k] is None else out[k].when(q.rlike(rx), v)
    return table(spark, d, "items").filter(any_).select("item_id", *[c.alias(k) for k, c in out.items()])


@query("join_front_outer", "WITH n AS (SELECT source, count(*) AS fresh FROM items WHERE split = 'dev' GROUP BY source), r AS (SELECT source, count(*) AS held FROM knowledge_real GROUP BY source) SELECT coalesce(n.source, r.source) AS source, fresh, held, CASE WHEN fresh IS NULL THEN 'MISSING' WHEN held IS NULL THEN 'new' ELSE 'both' END AS status FROM n FULL OUTER JOIN r ON n.source IS NOT DISTINCT FROM r.source")
def join_front_outer(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "items").filter("split = 'dev'").groupBy("source").agg(F.count(F.lit(1)).alias("fresh"))
    r = table(spark, d, "knowledge_real").groupBy(F.col("source").alias("s2")).agg(F.count(F.lit(1)).alias("held"))
    status = F.when(F.col("fresh").isNull(), "MISSING").when(F.col("held").isNull(), "new").otherwise("both")
    return n.join(r, n["source"].eqNullSafe(r["s2"]), "full_outer").select(F.coalesce("source", "s2").alias("source"), "fresh", "held", status.alias("status"))


@query("join_lookup_eval", "WITH k AS (SELECT passage_id, list_distinct(regexp_extract_all(text, '[A-Z][a-zà-ÿ]{6,}')) AS names FROM eval_passages), n AS (SELECT passage_id, unnest(names) AS name FROM k), f AS (SELECT fact_id, unnest(list_distinct(regexp_extract_all(coalesce(a, ''), '[A-Z][a-zà-ÿ]{6,}'))) AS name FROM knowledge_real) SELECT passage_id, min(fact_id) AS fact_id, count(DISTINCT name) AS names FROM n JOIN f USING (name) GROUP BY passage_id")
def join_lookup_eval(spark: SparkSession, d: str) -> DataFrame:
    """For each passage the first stored fact that holds one of its names."""
    names = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(T.text(F.col(c)), F.lit("[A-Z][a-zà-ÿ]{6,}"), 0)))
    n = table(spark, d, "eval_passages").select("passage_id", names("text").alias("name"))
    f = table(spark, d, "knowledge_real").select("fact_id", names("a").alias("name")).groupBy("name").agg(F.min("fact_id").alias("fact_id"))
    return n.join(f, "name").groupBy("passage_id").agg(F.min("fact_id").alias("fact_id"), F.countDistinct("name").alias("names"))
