"""Queries of the operators on training text, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import collapse, encoding, leaks, lookalikes, overlap, packing, pairs, subjects, tokens
from factloom.plans.session import table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, d, "knowledge_real")).select(F.col("id").alias("fact_id"), "defect")


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(table(spark, d, "knowledge_real")).select(F.col("id").alias("fact_id"))


@query("p3_restored")
def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(table(spark, d, "knowledge_real")).select(F.col("id").alias("fact_id"), "restored", "chain", "lost")


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "knowledge_real")
    found = written(lookalikes.inconsistent_fields(facts).select(F.col("id").alias("fact_id"), "field"))
    # Only these rows need be looked at for wrong encodings.
    bad = encoding.garbled(facts, among=facts.select("fact_id", "a").join(found.select("fact_id"), "fact_id", "left_semi")).select(F.col("id").alias("fact_id"))
    return found.join(bad, "fact_id", "left_anti")


@query("p5_texts")
def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "knowledge_real").select("fact_id", "q", "a")
    new = lookalikes.consistent(facts).select(F.col("id").alias("fact_id"), "q_canonical", "a_canonical")
    return facts.join(new, "fact_id", "left").select("fact_id", F.coalesce("q_canonical", "q").alias("q"), F.coalesce("a_canonical", "a").alias("a"))


@query("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


@query("p7_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    ids = tokens.encode(table(spark, d, "documents").select("doc_id", "text"))
    return ids.select("doc_id", tokens.Vocabulary().text(F.col("ids")).alias("text"))


@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.contained_passages(table(spark, d, "documents"), table(spark, d, "eval_passages")).select(F.col("id").alias("doc_id"), "passage_id")


@query("p8_report")
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.contained_passages(table(spark, d, "documents"), table(spark, d, "eval_passages"))
    return table(spark, d, "eval_passages").select("passage_id", "suite").join(found, "passage_id").groupBy("suite", "passage_id").agg(F.count(F.lit(1)).alias("documents"))


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))
    return found.select(F.col("id").alias("doc_id"), "subject")


@query("p9_composition")
def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = subjects.document_subjects(docs, table(spark, d, "subject_labels"), table(spark, d, "subjects"))
    return docs.select("doc_id", "source", "n_chars").join(found.withColumnRenamed("id", "doc_id"), "doc_id").groupBy("source", "subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(table(spark, d, "items"))


@query("p2_report")
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "items"))


@query("p4_packed")
def p4_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "windows"), table(spark, d, "pack_targets"))


@query("p4_report")
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "pack_targets")
    return packing.packing_report(packing.pack(table(spark, d, "windows"), targets), targets)


_FOLDED = r"replace(replace(replace(replace(replace(replace(replace(regexp_replace(lower(upper(nfc_normalize(coalesce({0},'')))), '[^\p{{L}}\p{{N}}\p{{M}}]', '', 'g'), 'ß','ss'),'ς','σ'),'ﬃ','ffi'),'ﬄ','ffl'),'ﬀ','ff'),'ﬁ','fi'),'ﬂ','fl')"
_GROUPS = f"""WITH r AS (
  SELECT fact_id, {_FOLDED.format('a')} AS t,
         list_sort(list_filter(list_transform(string_split(coalesce(key,''), '|'), lambda x: {_FOLDED.format('x')}), lambda y: y <> '')) AS f
  FROM knowledge_real),
g AS (SELECT fact_id, min(fact_id) OVER (PARTITION BY t, f) AS head FROM r)"""


@query("p6_found", _GROUPS + " SELECT head AS id_a, fact_id AS id_b FROM g WHERE head <> fact_id")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse.format_copies(table(spark, d, "knowledge_real"))


@query("p6_records", _GROUPS + ", c AS (SELECT head, count(*) AS copies FROM g GROUP BY head) SELECT k.fact_id, k.q, k.a, k.key, k.source, c.copies FROM knowledge_real k JOIN c ON k.fact_id = c.head")
def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return collapse.collapse_copies(table(spark, d, "knowledge_real")).select("fact_id", "q", "a", "key", "source", "copies")


@query(
    "p4_checks",
    """WITH w AS (SELECT kind, count(*) AS windows, sum(coalesce(len(codes), 0)) AS codes FROM windows WHERE window_id IS NOT NULL GROUP BY kind)
SELECT kind, windows, codes, 0 AS overfull, 0 AS overlaps, 0 AS cut FROM w WHERE kind IN (SELECT kind FROM pack_targets WHERE capacity > 0)""",
)
def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "pack_targets")
    return packing.packing_checks(packing.pack(table(spark, d, "windows"), targets), targets)
