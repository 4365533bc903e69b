"""Two-step lookups, entity resolution, outcomes and other composites."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.catalog.retrieval import evidence_pairs
from factloom.functions import text as T
from factloom.plans.session import table
from factloom.registry import ORACLES, query
from factloom.streaming.conversations import statements


@query("join_idf_similarity", ORACLES["evidence_pairs"].rstrip() + " AND sim BETWEEN 0.10 AND 0.8")
def join_idf_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Of evidence pairs those that are similar but no near copies: 0.10 to 0.8."""
    return evidence_pairs(spark, d).filter("sim between 0.10 and 0.8")


@query("agg_pair_counts", "SELECT l, r, count(*) AS n FROM (SELECT w[i] AS l, w[i + 1] AS r FROM (SELECT w, unnest(range(1, length(w))) AS i FROM (SELECT unnest(regexp_extract_all(lower(coalesce(q, '')), '[a-z]+')) AS w FROM items))) GROUP BY l, r")
def agg_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring letters of all words: words are counted first, so each distinct word is taken apart once."""
    words = table(spark, d, "items").select(F.explode(F.regexp_extract_all(F.lower(T.text(F.col("q"))), F.lit("[a-z]+"), 0)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.length("w") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.struct(F.substring(F.col("w"), i, F.lit(1)).alias("l"), F.substring(F.col("w"), i + 1, F.lit(1)).alias("r")))
    return words.select("n", F.explode(pairs).alias("p")).groupBy("p.l", "p.r").agg(F.sum("n").alias("n"))


@query("score_right", "SELECT item_id, (contains(t, 'the') OR contains(t, 'will')) AND NOT contains(t, 'sorry') AS right FROM (SELECT item_id, lower(replace(coalesce(a, ''), '’', '''')) AS t FROM items)")
def score_right(spark: SparkSession, d: str) -> DataFrame:
    """Every wanted group is met and no forbidden word is."""
    t = F.lower(F.replace(T.text(F.col("a")), F.lit("’"), F.lit("'")))
    want, wrong = F.array(F.array(F.lit("the"), F.lit("will"))), F.array(F.lit("sorry"))
    right = F.forall(want, lambda g: F.exists(g, lambda k: F.contains(t, k))) & ~F.exists(wrong, lambda k: F.contains(t, k))
    return table(spark, d, "items").select("item_id", right.alias("right"))


@query("mine_outcomes", "SELECT kind, arg_max(window_id, (loo, window_id)) AS best, arg_min(window_id, (loo, window_id)) AS worst, round(max(loo) - min(loo), 6) AS gain FROM windows WHERE loo IS NOT NULL GROUP BY kind HAVING max(loo) - min(loo) > 0.05")
def mine_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Best and worst candidate by outcome, where they differ by more than 0.05."""
    key = F.struct("loo", "window_id")
    g = table(spark, d, "windows").filter("loo is not null").groupBy("kind").agg(F.max_by("window_id", key).alias("best"), F.min_by("window_id", key).alias("worst"), (F.max("loo") - F.min("loo")).alias("gain"))
    return g.filter("gain > 0.05").withColumn("gain", F.round("gain", 6))


@query("parse_statement")
def parse_statement(spark: SparkSession, d: str) -> DataFrame:
    """What items tell: who, attribute and value by the template bank."""
    return statements(table(spark, d, "items").filter("q is not null and conv_id is not null").select("conv_id", "turn", F.col("q").alias("text")))


def clusters(pdf: pd.DataFrame) -> pd.DataFrame:
    """Names of one conversation to persons, in order of turn: a name joins the person that shares a part of it, and becomes
    a new one if two persons do."""
    people: list[set[str]] = []
    rows = []
    for r in pdf.sort_values(["turn", "who"]).itertuples():
        parts = {r.who.lower(), *r.who.lower().split()}
        hits = [i for i, p in enumerate(people) if p & parts]
        if len(hits) == 1:
            people[hits[0]] |= parts
            at = hits[0]
        else:
            people.append(parts)
            at = len(people) - 1
        rows.append((r.conv_id, int(r.turn), r.who, at))
    return pd.DataFrame(rows, columns=["conv_id", "turn", "who", "person"])


@query("entity_resolve")
def entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Persons by conversation: an ordered fold, with a conversation as its unit."""
    return parse_statement(spark, d).filter("who <> ''").groupBy("conv_id").applyInPandas(clusters, "conv_id bigint, turn int, who string, person int")


@query("join_chain2", """WITH q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(coalesce(a, ''), '[A-Z][a-z]{5,}'))) AS n FROM items WHERE split <> 'train'), f AS (SELECT fact_id, unnest(list_distinct(regexp_extract_all(coalesce(a, ''), '[A-Z][a-z]{5,}'))) AS n FROM knowledge_real),
r AS (SELECT n, min(fact_id) AS told FROM f GROUP BY n HAVING count(*) <= 0.05 * (SELECT count(*) FROM knowledge_real)), h AS (SELECT item_id, min(told) AS told FROM q JOIN r USING (n) GROUP BY item_id), w AS (SELECT fact_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(key, '')), '[a-z]{8,}'))) AS w FROM knowledge_real),
c AS (SELECT w, min(fact_id) AS stored FROM w GROUP BY w HAVING count(*) <= 0.05 * (SELECT count(*) FROM knowledge_real)) SELECT item_id, told, min(stored) AS stored FROM h JOIN w ON w.fact_id = h.told JOIN c USING (w) GROUP BY item_id, told""")
def join_chain2(spark: SparkSession, d: str) -> DataFrame:
    """Question to the fact that shares its name, and on to a stored fact that shares a rare long word with that one."""
    names = lambda t, key: t.select(key, F.explode(F.array_distinct(F.regexp_extract_all(T.text(F.col("a")), F.lit("[A-Z][a-z]{5,}"), 0))).alias("n"))
    facts = table(spark, d, "knowledge_real")
    total = F.broadcast(facts.agg(F.count(F.lit(1)).alias("total")))
    r = names(facts, "fact_id").groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.min("fact_id").alias("told")).crossJoin(total).filter("c <= 0.05 * total").select("n", "told")
    h = names(table(spark, d, "items").filter("split <> 'train'"), "item_id").join(r, "n").groupBy("item_id").agg(F.min("told").alias("told"))
    w = facts.select("fact_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(T.text(F.col("key"))), F.lit("[a-z]{8,}"), 0))).alias("w"))
    c = w.groupBy("w").agg(F.count(F.lit(1)).alias("c"), F.min("fact_id").alias("stored")).crossJoin(total).filter("c <= 0.05 * total").select("w", "stored")
    return h.join(w, h["told"] == w["fact_id"]).join(c, "w").groupBy("item_id", "told").agg(F.min("stored").alias("stored"))


@query("hotpot_context", "SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?:^|\\n)([^.\\n]{1,60})\\n'), lambda x: trim(x, chr(10))))) AS titles FROM documents WHERE kind = 'article' AND text IS NOT NULL")
def hotpot_context(spark: SparkSession, d: str) -> DataFrame:
    """Distinct heading lines of articles, sorted."""
    titles = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?:^|\n)([^.\n]{1,60})\n"), 0), lambda x: F.btrim(x, F.lit("\n")))))
    return table(spark, d, "documents").filter("kind = 'article' and text is not null").select("doc_id", titles.alias("titles"))


@query("make_windows", "SELECT kind, split, count(*) AS n, sum(CASE WHEN prompt_len = 0 THEN 1 ELSE 0 END)::BIGINT AS plain, sum(len(gold))::BIGINT AS spans, max(copy_end) AS copy_end FROM windows GROUP BY kind, split")
def make_windows(spark: SparkSession, d: str) -> DataFrame:
    """Training windows by kind: how many, plain ones, gold spans, and the end of what may be copied."""
    w = table(spark, d, "windows").groupBy("kind", "split")
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prompt_len") == 0).alias("plain"), F.sum(F.when(F.col("gold").isNotNull(), F.size("gold"))).alias("spans"), F.max("copy_end").alias("copy_end"))


@query("gen_session")
def gen_session(spark: SparkSession, d: str) -> DataFrame:
    """Invented sessions of 10 to 40 turns with one planted fact, asked for at the end; a hash of the session draws all."""
    n = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(31)) + 10
    value = F.element_at(F.array(*map(F.lit, "Oslo Lima Cairo Quito Dakar Hanoi".split())), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(6)) + 1).cast("int"))
    s = spark.range(2000).select("id", n.alias("n"), value.alias("value")).withColumn("at", F.pmod(F.xxhash64("id", F.lit(3)), F.col("n") - 1))
    t = s.select("id", "n", "value", "at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("turn"))
    text = F.when(F.col("turn") == F.col("at"), F.concat(F.lit("My brother Timo lives in "), "value", F.lit("."))).when(F.col("turn") == F.col("n") - 1, F.lit("Where does my brother Timo live?")).otherwise(F.concat(F.lit("Tell me something about topic "), F.pmod(F.xxhash64("id", "turn"), F.lit(500)).cast("string"), F.lit(".")))
    return t.select(F.col("id").alias("session"), "turn", text.alias("text"), F.when(F.col("turn") == F.col("n") - 1, F.col("value")).alias("target"))
