"""Invented facts, perturbed questions and training windows, all seeded by hashes of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.catalog.nested import turns
from factloom.functions import text as T
from factloom.plans.session import table
from factloom.registry import query
from factloom.streaming.conversations import batch_facts

# Attributes with a statement, a question, and values.
ATTRIBUTES = (
    ("city", "{who} lives in {value}.", "Where does {who} live?", "Oslo Lima Cairo Quito Dakar Hanoi Turin Leeds".split()), ("pet", "{who} keeps a {value}.", "Which pet does {who} keep?", "parrot terrier tortoise kitten hamster pony".split()),
    ("color", "{who} paints everything {value}.", "Which color does {who} paint with?", "amber teal violet olive crimson ivory".split()), ("hobby", "{who} spends evenings on {value}.", "What does {who} do in the evening?", "chess origami weaving rowing fencing baking".split()),
)
NAMES = "Ada Ben Cleo Dov Elin Farid Gwen Hugo Iris Jonas Kemi Lars Mina Nuri Olga Pavel".split()


def drawn(values: list[str], salt: int, key: Column) -> Column:
    """One of values by the hash of key and salt."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(len(values))).cast("int"))


@query("gen_fact")
def gen_fact(spark: SparkSession, d: str) -> DataFrame:
    """Invented facts with statement, question and answer; every fifth name is kept for tests."""
    base = spark.range(20_000).withColumn("who", drawn(NAMES, 1, F.col("id"))).withColumn("at", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(len(ATTRIBUTES))).cast("int"))
    value = F.get(F.array(*[drawn(v, 3 + i, F.col("id")) for i, (_, _, _, v) in enumerate(ATTRIBUTES)]), F.col("at"))
    pick = lambda k: F.get(F.array(*[F.lit(a[k]) for a in ATTRIBUTES]), F.col("at"))
    fill = lambda t: F.replace(F.replace(t, F.lit("{who}"), F.col("who")), F.lit("{value}"), F.col("value"))
    facts = base.withColumn("value", value)
    reserved = F.array_contains(F.array(*[F.lit(n) for n in NAMES[::5]]), F.col("who"))
    return facts.select("id", "who", pick(0).alias("attribute"), "value", fill(pick(1)).alias("statement"), fill(pick(2)).alias("question"), reserved.alias("reserved"))


@query("perturb")
def perturb(spark: SparkSession, d: str) -> DataFrame:
    """Each question with one word dropped and one doubled, by hash of its id."""
    w = table(spark, d, "items").filter("q is not null").select("item_id", F.split("q", " ").alias("w")).filter(F.size("w") > 2)
    drop, twice = F.pmod(F.xxhash64("item_id", F.lit(1)), F.size("w")).cast("int"), F.pmod(F.xxhash64("item_id", F.lit(2)), F.size("w")).cast("int")
    out = F.flatten(F.transform("w", lambda x, i: F.when(i == drop, F.array().cast("array<string>")).when(i == twice, F.array(x, x)).otherwise(F.array(x))))
    return w.select("item_id", F.array_join(out, " ").alias("q"))


@query("cloze", "SELECT doc_id, s[1] AS sentence, array_to_string(w[1 : len(w) // 2], ' ') AS q, array_to_string(w[len(w) // 2 + 1 :], ' ') AS a FROM (SELECT doc_id, s, string_split(s[1], ' ') AS w FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]+[ \\n]+') AS s FROM documents WHERE text IS NOT NULL)) WHERE len(w) >= 6")
def cloze(spark: SparkSession, d: str) -> DataFrame:
    """The first sentence of each document, its halves as question and answer."""
    s = table(spark, d, "documents").filter("text is not null").select("doc_id", F.get(F.split("text", r"[.!?]+[ \n]+"), 0).alias("sentence"))
    w = s.withColumn("w", F.split("sentence", " ")).filter(F.size("w") >= 6).withColumn("h", F.floor(F.size("w") / 2).cast("int"))
    return w.select("doc_id", "sentence", F.array_join(F.slice("w", F.lit(1), F.col("h")), " ").alias("q"), F.array_join(F.slice("w", F.col("h") + 1, F.size("w")), " ").alias("a"))


@query("window_build")
def window_build(spark: SparkSession, d: str) -> DataFrame:
    """Items of each conversation into 400 characters: one that doesn't fit is skipped and the next is tried; an ordered fold."""
    i = table(spark, d, "items").filter("conv_id is not null and a is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "item_id", F.length("a").alias("n")))).alias("xs"))
    start = F.struct(F.array().cast("array<bigint>").alias("ids"), F.lit(0).alias("used"))
    step = lambda s, x: F.when(s["used"] + x["n"] <= 400, F.struct(F.array_append(s["ids"], x["item_id"]).alias("ids"), (s["used"] + x["n"]).alias("used"))).otherwise(s)
    return i.select("conv_id", F.aggregate("xs", start, step).alias("s")).select("conv_id", "s.ids", "s.used")


@query("doc_insert", "SELECT window_id, list_concat(list_concat(codes[1 : len(codes) // 2], [7, 7, 7]), codes[len(codes) // 2 + 1 :]) AS codes, (len(codes) // 2)::INT AS s, (len(codes) // 2 + 3)::INT AS e FROM windows WHERE codes IS NOT NULL")
def doc_insert(spark: SparkSession, d: str) -> DataFrame:
    """A piece of three codes put into the middle of each window, with its span."""
    w = table(spark, d, "windows").filter("codes is not null").select("window_id", "codes", F.floor(F.size("codes") / 2).cast("int").alias("s"))
    new = F.concat(F.slice("codes", F.lit(1), F.col("s")), F.array(F.lit(7), F.lit(7), F.lit(7)), F.slice("codes", F.col("s") + 1, F.size("codes")))
    return w.select("window_id", new.alias("codes"), "s", (F.col("s") + 3).alias("e"))


@query("fact_table")
def fact_table(spark: SparkSession, d: str) -> DataFrame:
    """Newest values and history of what is told in items, by conversation; the stream keeps the same state."""
    told = table(spark, d, "items").filter("q is not null and conv_id is not null").select("conv_id", "turn", F.col("q").alias("text"))
    return batch_facts(told)


@query("pronoun_last")
def pronoun_last(spark: SparkSession, d: str) -> DataFrame:
    """For turns with a pronoun the person named last before."""
    named = F.regexp_extract(T.text(F.col("text")), r"\b([A-Z][a-z]{4,}) [A-Z][a-z]+\b", 1)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    t = turns(spark, d).withColumn("who", F.when(named != "", named))
    return t.withColumn("last", F.last("who", ignorenulls=True).over(w)).filter(F.col("text").rlike(r"(?i)\b(she|he|they|her|him|them)\b")).select("conv_id", "turn", "last")


@query("gate_fronts", "WITH m AS (SELECT kind, split, round(avg(loo), 6) AS v FROM windows WHERE loo IS NOT NULL GROUP BY kind, split), r AS (SELECT kind, min(v) AS best FROM m WHERE split = 'train' GROUP BY kind), n AS (SELECT kind, min(v) AS fresh FROM m WHERE split <> 'train' GROUP BY kind) SELECT coalesce(r.kind, n.kind) AS kind, best, fresh, CASE WHEN fresh IS NULL THEN 'MISSING' WHEN best IS NULL THEN 'new' WHEN fresh <= best + 0.02 THEN 'HOLDS' ELSE 'LOST' END AS status FROM r FULL OUTER JOIN n USING (kind)")
def gate_fronts(spark: SparkSession, d: str) -> DataFrame:
    """New values of each front against the best reference, with a tolerance; a missing one fails."""
    m = table(spark, d, "windows").filter("loo is not null").groupBy("kind", "split").agg(F.round(F.avg("loo"), 6).alias("v"))
    r = m.filter("split = 'train'").groupBy("kind").agg(F.min("v").alias("best"))
    n = m.filter("split <> 'train'").groupBy("kind").agg(F.min("v").alias("fresh"))
    status = F.when(F.col("fresh").isNull(), "MISSING").when(F.col("best").isNull(), "new").when(F.col("fresh") <= F.col("best") + 0.02, "HOLDS").otherwise("LOST")
    return r.join(n, "kind", "full_outer").select("kind", "best", "fresh", status.alias("status"))
