"""Conversation memory: questions about told facts, recency, corrections, markup and answers that decline."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.catalog.joins import nearest
from factloom.catalog.nested import ONCE, turns
from factloom.catalog.retrieval import _EVERY, _SQL, Found, Shard, divided, moments, questions, search, store
from factloom.functions import text as T
from factloom.plans.session import table
from factloom.registry import query


@query("src_parquet", "SELECT doc_id, source FROM documents WHERE kind = 'web' AND n_chars > 1000")
def src_parquet(spark: SparkSession, d: str) -> DataFrame:
    """Two columns and a pushed filter: the scan reads nothing else."""
    return table(spark, d, "documents").filter("kind = 'web' and n_chars > 1000").select("doc_id", "source")


@query("flt_long", "SELECT doc_id, n_chars FROM documents WHERE length(text) > 4000")
def flt_long(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.length("text") > 4000).select("doc_id", "n_chars")


@query("narrative", "SELECT doc_id FROM documents WHERE len(regexp_extract_all(substring(text, 1, 3000), '(treaty|siege|monarch|empire|archive|dynasty)')) >= 3")
def narrative(spark: SparkSession, d: str) -> DataFrame:
    """Documents with three or more words of history in their first 3,000 characters."""
    return table(spark, d, "documents").filter(F.regexp_count(F.substring("text", 1, 3000), F.lit("(treaty|siege|monarch|empire|archive|dynasty)")) >= 3).select("doc_id")


@query("flt_has_answer", "SELECT item_id FROM items WHERE trim(coalesce(a, '')) <> '' AND trim(coalesce(q, '')) <> ''")
def flt_has_answer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").filter((F.trim(T.text(F.col("a"))) != "") & (F.trim(T.text(F.col("q"))) != "")).select("item_id")


@query("escape", r"SELECT item_id, replace(replace(replace(coalesce(q, ''), '\', '\\'), chr(10), '\n'), chr(9), '\t') AS value FROM items")
def escape(spark: SparkSession, d: str) -> DataFrame:
    out = T.text(F.col("q"))
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return table(spark, d, "items").select("item_id", out.alias("value"))


def without_nested(text: str, opening: str, closing: str) -> str:
    """text without everything between balanced marks, however deep; an opening that never closes stays."""
    out: list[str] = []
    marks: list[int] = []
    for part in re.split(f"({re.escape(opening)}|{re.escape(closing)})", text):
        if part == opening:
            marks.append(len(out))
            out.append(part)
        elif part == closing and marks:
            del out[marks.pop() :]
        else:
            out.append(part)
    return "".join(out)


def plain_markup(text: str) -> str:
    """Wiki or web markup as plain paragraphs: no comments, references, tags, templates, tables, link targets, headings, menus."""
    text = html.unescape(html.unescape(text))
    text = re.sub(r"(?s)<!--.*?-->|<ref[^>]*/>|<ref.*?</ref>", "", text)
    text = without_nested(without_nested(text, "{{", "}}"), "{|", "|}")
    text = re.sub(r"<[^<>\n]{1,200}>", "", text)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", text)
    text = re.sub(r"'{2,}", "", text)
    kept = []
    for line in text.split("\n"):
        if re.fullmatch(r"\s*=+[^=]*=+\s*", line):
            if re.search(r"(?i)references|external links|see also|further reading", line):
                break
            continue
        if re.search(r"\w", line) and not re.fullmatch(r"(?:[^|.]{1,30}\|)+[^|.]{1,30}", line.strip()):
            kept.append(line.strip())
    return "\n".join(kept)


def per_text(f):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "value": [f(t) for t in pdf["text"]]})

    return run


@query("strip_nested")
def strip_nested(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    return docs.mapInPandas(per_text(lambda t: without_nested(t, "(", ")")), "doc_id bigint, value string")


@query("clean_wiki")
def clean_wiki(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", "text").mapInPandas(per_text(plain_markup), "doc_id bigint, value string")


@query("parse_question", "SELECT fact_id, regexp_extract(q, '^(?:What is|Do you remember the) (.+?)(?:''s | of )(.+?)[?.]?$', 1) AS x, regexp_extract(q, '^(?:What is|Do you remember the) (.+?)(?:''s | of )(.+?)[?.]?$', 2) AS y FROM knowledge_real WHERE source = 'skill' AND regexp_matches(q, '^(?:What is|Do you remember the) (.+?)(?:''s | of )(.+?)[?.]?$')")
def parse_question(spark: SparkSession, d: str) -> DataFrame:
    """Questions for a person's attribute, taken apart."""
    rx = r"^(?:What is|Do you remember the) (.+?)(?:'s | of )(.+?)[?.]?$"
    return table(spark, d, "knowledge_real").filter((F.col("source") == "skill") & F.col("q").rlike(rx)).select("fact_id", F.regexp_extract("q", rx, 1).alias("x"), F.regexp_extract("q", rx, 2).alias("y"))


@query("norm_who", "SELECT item_id, list_sort(list_distinct([lower(w), 'my ' || lower(split_part(w, ' ', 2)), lower(split_part(w, ' ', 3))])) AS aliases FROM (SELECT item_id, regexp_extract(q, '^(My [a-z]+ [^ ]+)', 1) AS w FROM items) WHERE w <> ''")
def norm_who(spark: SparkSession, d: str) -> DataFrame:
    """The names by which a person is known: in full, as a relative, by name."""
    i = table(spark, d, "items").select("item_id", F.regexp_extract(T.text(F.col("q")), r"^(My [a-z]+ [^ ]+)", 1).alias("w")).filter("w <> ''")
    p = F.split("w", " ")
    return i.select("item_id", F.array_sort(F.array_distinct(F.array(F.lower("w"), F.concat(F.lit("my "), F.lower(F.get(p, 1))), F.lower(F.get(p, 2))))).alias("aliases"))


_FACTS = "f AS (SELECT lower(regexp_replace(split_part(key, '|', 1), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS who, lower(regexp_replace(split_part(key, '|', 2), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS attribute, batch, fact_id FROM knowledge_real WHERE source = 'skill' AND len(string_split(key, '|')) = 3)"


def facts(spark: SparkSession, d: str) -> DataFrame:
    p = F.transform(F.split("key", r"\|"), lambda x: F.lower(T.strip(x)))
    k = table(spark, d, "knowledge_real").filter(F.col("source") == "skill").select("fact_id", "batch", p.alias("p")).filter(F.size("p") == 3)
    return k.select(F.get("p", 0).alias("who"), F.get("p", 1).alias("attribute"), "batch", "fact_id")


@query("fast_lane", f"WITH {_FACTS} SELECT who, attribute, arg_max(fact_id, (batch, fact_id)) AS fact_id FROM f GROUP BY who, attribute")
def fast_lane(spark: SparkSession, d: str) -> DataFrame:
    """The newest record of each person and attribute."""
    return facts(spark, d).groupBy("who", "attribute").agg(F.max_by("fact_id", F.struct("batch", "fact_id")).alias("fact_id"))


@query("never_told", f"WITH {_FACTS}, a AS (SELECT DISTINCT attribute FROM f WHERE attribute IN ('hobby', 'shoe size', 'pet')), p AS (SELECT DISTINCT who FROM f) SELECT who, a.attribute FROM p, a WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.who = p.who AND f.attribute = a.attribute)")
def never_told(spark: SparkSession, d: str) -> DataFrame:
    """Known persons of whom one of three attributes was never told: a person's told attributes are one array."""
    wanted = F.array(*map(F.lit, ("hobby", "shoe size", "pet")))
    f = facts(spark, d)
    known = F.broadcast(f.filter(F.array_contains(wanted, F.col("attribute"))).agg(F.collect_set("attribute").alias("known")))  # three at most
    told = f.groupBy("who").agg(F.collect_set(F.when(F.array_contains(wanted, F.col("attribute")), F.col("attribute"))).alias("told"))
    return told.crossJoin(known).select("who", F.explode(F.array_except("known", "told")).alias("attribute"))


@query("decide", f"WITH {_FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY who, attribute ORDER BY batch DESC, fact_id DESC) AS n FROM f) SELECT fact_id, n > 1 AS superseded FROM r")
def decide(spark: SparkSession, d: str) -> DataFrame:
    """Whether a newer record of the same person and attribute replaces a fact."""
    w = Window.partitionBy("who", "attribute").orderBy(F.desc("batch"), F.desc("fact_id"))
    return facts(spark, d).withColumn("n", F.row_number().over(w)).select("fact_id", (F.col("n") > 1).alias("superseded"))


def weighted(shard: Shard, found: np.ndarray, shared: np.ndarray, total: float, least: float) -> Found:
    return shard.ids[found], divided(shared, total) + divided(0.5 * shared, total + shard.totals[found] - shared)


def scores(shard: Shard, found: np.ndarray, shared: np.ndarray, total: float, least: float) -> Found:
    """The facts with what the search made of them."""
    return shard.ids[found], shared


@query("hybrid_weighted", _EVERY + " SELECT item_id, fact_id, round(shared / nullif(qsum, 0) + 0.5 * shared / nullif(qsum + fsum - shared, 0), 6) AS score FROM s JOIN qs USING (item_id) JOIN fs USING (fact_id)")
def hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Coverage plus half the union score."""
    s = store(spark, d, 1)
    return search(s, s.asked(questions(spark, d)), weighted, "fact_id bigint, score double", s.facts.filter("id is not null")).select("item_id", "fact_id", F.round("score", 6).alias("score"))


@query("std_weight_sweep", _SQL + ", c AS (SELECT shared / nullif(qsum, 0) AS x FROM s JOIN qs USING (item_id)) SELECT round(stddev_pop(x), 6) AS sd, round(avg(x), 6) AS mean, count(*) AS n FROM c")
def std_weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of literal scores, by which both score kinds are brought to one scale."""
    s = store(spark, d)
    c = search(s, s.asked(questions(spark, d)), moments, "n bigint, x double, xx double").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("x").alias("x"), F.sum("xx").alias("xx"))
    mean = F.try_divide("x", "n")
    return c.select(F.round(F.sqrt(F.when(F.col("n") > 0, F.greatest(F.try_divide("xx", "n") - mean * mean, F.lit(0.0)))), 6).alias("sd"), F.round(mean, 6).alias("mean"), "n")


@query("strict_exact", "SELECT i.fact_id, min(k.fact_id) AS first FROM knowledge_real i JOIN (SELECT min(fact_id) AS fact_id, regexp_replace(lower(key), '[^a-z0-9 ]', '', 'g') AS k FROM knowledge_real WHERE key IS NOT NULL GROUP BY 2) k ON k.k = regexp_replace(lower(i.q), '[^a-z0-9 ]', '', 'g') WHERE len(string_split(k.k, ' ')) >= 2 GROUP BY i.fact_id")
def strict_exact(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose normal form of two words or more is that of a key."""
    norm = lambda c: F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9 ]", "")
    t = table(spark, d, "knowledge_real")
    k = t.filter("key is not null").groupBy(norm("key").alias("k")).agg(F.min("fact_id").alias("first")).filter(F.size(F.split("k", " ")) >= 2)
    return t.select("fact_id", norm("q").alias("k")).join(k, "k").groupBy("fact_id").agg(F.min("first").alias("first"))


_RECENT = """b AS (SELECT i.item_id, string_agg(t.text, ' ') AS q FROM items i JOIN (SELECT DISTINCT conv_id, turn, text FROM dialogues WHERE role = 'user') t ON t.conv_id = i.conv_id AND t.turn BETWEEN i.turn - 4 AND i.turn - 1 WHERE i.split <> 'train' GROUP BY i.item_id)"""
_OWN = _SQL + ", o AS (SELECT item_id, fact_id, shared / nullif(qsum, 0) AS score FROM s JOIN qs USING (item_id)) SELECT * FROM o"
_EARLIER = _SQL.replace("WITH f AS", "WITH " + _RECENT + ", f AS").replace("FROM items WHERE split <> 'train')", "FROM b)") + ", o AS (SELECT item_id, fact_id, 0.6 * shared / nullif(qsum, 0) AS score FROM s JOIN qs USING (item_id)) SELECT * FROM o"


@query("recent_expand", f"SELECT item_id, fact_id, round(max(score), 6) AS score FROM (({_OWN}) UNION ALL ({_EARLIER})) GROUP BY item_id, fact_id")
def recent_expand(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a question's own words, and at six tenths those of the user's words in the four turns before; the better counts."""
    items = table(spark, d, "items").filter("split <> 'train'").select("item_id", "conv_id", "turn")
    told = table(spark, d, "dialogues").filter("role = 'user'").select("conv_id", F.col("turn").alias("t"), "text").distinct()
    before = items.join(told, "conv_id").filter("t between turn - 4 and turn - 1").groupBy("item_id").agg(F.array_join(F.collect_list("text"), " ").alias("q"))
    s = store(spark, d)
    earlier = s.asked(before).select("id", *(F.col(c).alias(f"{c}2") for c in ("total", "ws", "vs")))
    asked = s.asked(questions(spark, d)).join(earlier, "id", "full").withColumn("total", F.coalesce("total", F.lit(1.0))).withColumn("total2", F.coalesce("total2", F.lit(1.0)))
    return search(s, asked, scores, "fact_id bigint, score double").select("item_id", "fact_id", F.round("score", 6).alias("score"))


@query("name_follow", "WITH n AS (SELECT fact_id, unnest(list_distinct(regexp_extract_all(coalesce(a, ''), '[A-Z][a-z]{5,}'))) AS name FROM knowledge_real), i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(coalesce(a, ''), '[A-Z][a-z]{5,}'))) AS name FROM items WHERE split <> 'train'), r AS (SELECT name FROM n GROUP BY name HAVING count(*) <= 0.05 * (SELECT count(*) FROM knowledge_real)) SELECT item_id, count(DISTINCT fact_id) AS facts FROM i JOIN r USING (name) JOIN n USING (name) GROUP BY item_id")
def name_follow(spark: SparkSession, d: str) -> DataFrame:
    """Facts that share a name with an item, by names that at most a twentieth of the facts hold."""
    names = lambda t, key: t.select(key, F.explode(F.array_distinct(F.regexp_extract_all(T.text(F.col("a")), F.lit("[A-Z][a-z]{5,}"), 0))).alias("name"))
    n, i = names(table(spark, d, "knowledge_real"), "fact_id"), names(table(spark, d, "items").filter("split <> 'train'"), "item_id")
    total = F.broadcast(table(spark, d, "knowledge_real").agg(F.count(F.lit(1)).alias("n")))
    r = n.groupBy("name").agg(F.count(F.lit(1)).alias("c")).crossJoin(total).filter("c <= 0.05 * n").select("name")
    return i.join(r, "name").join(n, "name").groupBy("item_id").agg(F.countDistinct("fact_id").alias("facts"))


@query("lookalikes", _SQL + ", k AS (SELECT item_id, fact_id, round(shared / nullif(qsum, 0), 6) AS score FROM s JOIN qs USING (item_id)) SELECT k.item_id, k.fact_id FROM k JOIN items i USING (item_id) JOIN knowledge_real f ON f.fact_id = k.fact_id WHERE score >= 0.2 AND len(list_intersect(regexp_extract_all(lower(coalesce(i.a, '')), '[a-z]{6,}'), regexp_extract_all(lower(coalesce(f.a, '')), '[a-z]{6,}'))) = 0")
def lookalikes(spark: SparkSession, d: str) -> DataFrame:
    """Facts near a question that share no longer word with its answer."""
    long = lambda c: F.regexp_extract_all(F.lower(T.text(F.col(c))), F.lit("[a-z]{6,}"), 0)
    answers = lambda name, key: table(spark, d, name).select(F.col(key).alias("id"), long("a").alias("answer"))
    s = store(spark, d)
    asked = s.asked(questions(spark, d)).join(answers("items", "item_id"), "id")
    return search(s, asked, scores, "fact_id bigint, score double", s.facts.join(answers("knowledge_real", "fact_id"), "id")).select("item_id", "fact_id")


@query("synonyms", "WITH s AS (SELECT a.vec_id, b.vec_id AS neighbour, a.label = b.label AS same, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbour) AS rank FROM s) SELECT vec_id, neighbour FROM r WHERE rank <= 6 AND sim >= 0.2 AND NOT same")
def synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Of the six nearest vectors those above a similarity and of another label."""
    e = table(spark, d, "embeddings")
    n = nearest(e, 6).filter("sim >= 0.2").join(e.select("vec_id", "label"), "vec_id").join(e.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("other")), "neighbour")
    return n.filter("label <> other").select("vec_id", "neighbour")


@query("abstained", "SELECT item_id, regexp_matches(t, '(^|[^a-z])(not told|don''t know|not sure|no idea|never told|don''t have)') AS abstained FROM (SELECT item_id, replace(lower(coalesce(a, '')), '’', '''') AS t FROM items)")
def abstained(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.lower(T.text(F.col("a"))), F.lit("’"), F.lit("'"))
    return table(spark, d, "items").select("item_id", t.rlike("(^|[^a-z])(not told|don't know|not sure|no idea|never told|don't have)").alias("abstained"))


@query("significance", "WITH g AS (SELECT source, avg(length(a)) FILTER (WHERE split = 'train') AS x, avg(length(a)) FILTER (WHERE split <> 'train') AS y, stddev_samp(length(a)) / sqrt(count(a)) AS se FROM items GROUP BY source) SELECT source, CASE WHEN y > x + 2 * se THEN 'win' WHEN y < x - 2 * se THEN 'loss' ELSE 'same' END AS mark FROM g")
def significance(spark: SparkSession, d: str) -> DataFrame:
    n, train = F.length("a"), F.col("split") == "train"
    g = table(spark, d, "items").groupBy("source").agg(F.avg(F.when(train, n)).alias("x"), F.avg(F.when(~train, n)).alias("y"), (F.stddev_samp(n) / F.sqrt(F.count("a"))).alias("se"))
    return g.select("source", F.when(F.col("y") > F.col("x") + 2 * F.col("se"), "win").when(F.col("y") < F.col("x") - 2 * F.col("se"), "loss").otherwise("same").alias("mark"))


_VALUES = _FACTS.replace("batch, fact_id FROM", "lower(regexp_replace(split_part(key, '|', 3), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS v FROM")


@query("contradiction_scan", f"WITH {_VALUES} SELECT who, attribute, count(DISTINCT v) AS told FROM f GROUP BY who, attribute HAVING count(DISTINCT v) > 1")
def contradiction_scan(spark: SparkSession, d: str) -> DataFrame:
    """Persons told to have several values of one attribute."""
    p = F.transform(F.split("key", r"\|"), lambda x: F.lower(T.strip(x)))
    k = table(spark, d, "knowledge_real").filter(F.col("source") == "skill").select(p.alias("p")).filter(F.size("p") == 3)
    return k.groupBy(F.get("p", 0).alias("who"), F.get("p", 1).alias("attribute")).agg(F.countDistinct(F.get("p", 2)).alias("told")).filter("told > 1")


@query("mem_write_turn", f"WITH {ONCE} SELECT conv_id, turn, length(text) > 200 AS cut FROM d WHERE text IS NOT NULL AND (role = 'user' OR length(text) >= 40)")
def mem_write_turn(spark: SparkSession, d: str) -> DataFrame:
    """Turns that are remembered: what the user says, and replies of forty characters or more; long ones are cut to pieces."""
    return turns(spark, d).filter("text is not null and (role = 'user' or length(text) >= 40)").select("conv_id", "turn", (F.length("text") > 200).alias("cut"))


@query("drop_turn", f"WITH {ONCE}, l AS (SELECT conv_id, max(turn) AS turn FROM d GROUP BY conv_id) SELECT d.conv_id, count(*) AS left_over FROM d JOIN l ON d.conv_id = l.conv_id AND d.turn < l.turn GROUP BY d.conv_id")
def drop_turn(spark: SparkSession, d: str) -> DataFrame:
    """Turns that stay once the last one is taken back."""
    t = turns(spark, d)
    last = t.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return t.join(last, "conv_id").filter("turn < last").groupBy("conv_id").agg(F.count(F.lit(1)).alias("left_over"))
