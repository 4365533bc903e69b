"""Conversations and nested data: turns as arrays, adjacency, trees, exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.plans.session import table
from factloom.registry import query

# Turns delivered twice count once: of each (conv_id, turn) the earliest delivery stays.
ONCE = "d AS (SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY sent_at, role, text) AS n FROM dialogues) WHERE n = 1)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, role, text; of a turn delivered twice the earliest stays."""
    w = Window.partitionBy("conv_id", "turn").orderBy("sent_at", "role", "text")
    return table(spark, d, "dialogues").withColumn("n", F.row_number().over(w)).filter("n = 1").select("conv_id", "turn", "role", "text")


@query("flt_well_formed", f"""WITH {ONCE}, o AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM d)
SELECT conv_id FROM o GROUP BY conv_id HAVING count(*) >= 4 AND bool_and(coalesce(role, '') = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END)""")
def flt_well_formed(spark: SparkSession, d: str) -> DataFrame:
    o = turns(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    due = F.when(F.col("i") % 2 == 0, "user").otherwise("assistant")
    return o.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.every(F.coalesce("role", F.lit("")) == due).alias("ok")).filter("n >= 4 and ok").select("conv_id")


@query("pairs_of_turns", f"""WITH {ONCE}, l AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS q, t2 AS a FROM l WHERE role = 'user' AND r2 = 'assistant'""")
def pairs_of_turns(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns(spark, d).withColumns({"r2": F.lead("role").over(w), "t2": F.lead("text").over(w)})
    return t.filter("role = 'user' and r2 = 'assistant'").select("conv_id", "turn", F.col("text").alias("q"), F.col("t2").alias("a"))


@query("win_turn_adjacent", f"WITH {ONCE}, l AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM d) SELECT conv_id, turn FROM l WHERE role = before")
def win_turn_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("role = before").select("conv_id", "turn")


@query("render_turns", f"""WITH {ONCE} SELECT conv_id, string_agg((CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END) || regexp_replace(regexp_replace(coalesce(text, ''), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) ORDER BY turn) AS value FROM d GROUP BY conv_id""")
def render_turns(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.regexp_replace(T.strip(T.text(F.col("text"))), r"\n{3,}", "\n\n"))
    t = turns(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("ts"))
    return t.select("conv_id", F.array_join(F.transform("ts", lambda x: x["line"]), "\n").alias("value"))


@query("exchange_windows", f"""WITH {ONCE}, l AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS r0, lag(text) OVER w AS t0 FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT conv_id, turn, trim(coalesce(t0, '')) AS q, trim(coalesce(text, '')) AS a FROM l WHERE role = 'assistant' AND r0 = 'user'),
k AS (SELECT conv_id, turn, CASE WHEN length(q) <= 350 THEN q ELSE '...' || right(q, 350) END AS q, a, length(a) >= 30 AS ok FROM u),
p AS (SELECT *, lag(CASE WHEN ok THEN 'User: ' || q || chr(10) || 'Assistant: ' || a END) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM k)
SELECT conv_id, turn, CASE WHEN prev IS NOT NULL AND length(prev) + 1 + length('User: ' || q || chr(10) || 'Assistant: ' || a) <= 950 THEN prev || chr(10) ELSE '' END || 'User: ' || q || chr(10) || 'Assistant: ' || a AS unit FROM p WHERE ok""")
def exchange_windows(spark: SparkSession, d: str) -> DataFrame:
    """Each reply with its question, and the exchange before it where both fit 950 characters; short replies drop out."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns(spark, d).withColumns({"r0": F.lag("role").over(w), "t0": F.lag("text").over(w)}).filter("role = 'assistant' and r0 = 'user'")
    q, a = F.trim(T.text(F.col("t0"))), F.trim(T.text(F.col("text")))
    u = t.select("conv_id", "turn", F.when(F.length(q) <= 350, q).otherwise(F.concat(F.lit("..."), F.right(q, F.lit(350)))).alias("q"), a.alias("a"))
    u = u.withColumn("unit", F.concat(F.lit("User: "), "q", F.lit("\nAssistant: "), "a")).withColumn("ok", F.length("a") >= 30)
    u = u.withColumn("prev", F.lag(F.when(F.col("ok"), F.col("unit"))).over(w)).filter("ok")
    both = F.col("prev").isNotNull() & (F.length("prev") + 1 + F.length("unit") <= 950)
    return u.select("conv_id", "turn", F.when(both, F.concat("prev", F.lit("\n"), "unit")).otherwise(F.col("unit")).alias("unit"))


@query("src_exchanges")
def src_exchanges(spark: SparkSession, d: str) -> DataFrame:
    """The exchanges written in documents as User:/Assistant: blocks."""
    blocks = F.posexplode(F.split("text", r"\n\n(?=User: )")).alias("pos", "block")
    rx = r"(?s)^User: (.*?)\nAssistant: (.*)$"
    return table(spark, d, "documents").filter(F.contains("text", F.lit("User: "))).select("doc_id", blocks).filter(F.col("block").rlike(rx)).select("doc_id", "pos", F.regexp_extract("block", rx, 1).alias("q"), T.strip(F.regexp_extract("block", rx, 2)).alias("a"))


@query("tree_best_path", f"""WITH RECURSIVE {ONCE}, n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY length(coalesce(text, '')) DESC, turn) AS rank, turn // 2 AS depth FROM d)
SELECT conv_id, depth::INT AS depth, turn FROM n WHERE rank = 1""")
def tree_best_path(spark: SparkSession, d: str) -> DataFrame:
    """Of the replies at each depth of a conversation the best-ranked one; longer texts rank first, ties by turn."""
    depth = F.floor(F.col("turn") / 2).cast("int")
    w = Window.partitionBy("conv_id", "depth").orderBy(F.length(T.text(F.col("text"))).desc(), "turn")
    return turns(spark, d).withColumn("depth", depth).withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("conv_id", "depth", "turn")


@query("agg_depth_hist", f"WITH {ONCE}, c AS (SELECT conv_id, least(count(*) FILTER (WHERE role = 'user'), 6) AS depth FROM d GROUP BY conv_id) SELECT depth, count(*) AS conversations FROM c GROUP BY depth")
def agg_depth_hist(spark: SparkSession, d: str) -> DataFrame:
    c = turns(spark, d).groupBy("conv_id").agg(F.least(F.count_if(F.col("role") == "user"), F.lit(6).cast("bigint")).alias("depth"))
    return c.groupBy("depth").agg(F.count(F.lit(1)).alias("conversations"))


@query("split_questions")
def split_questions(spark: SparkSession, d: str) -> DataFrame:
    """One row for each question of a user's turn."""
    return turns(spark, d).filter("role = 'user' and text is not null").select("conv_id", "turn", F.explode(T.questions(F.col("text"))).alias("question"))


@query("split_text")
def split_text(spark: SparkSession, d: str) -> DataFrame:
    """Sentences in pieces of at most 200 characters: a fold over the sentences of a turn; longer ones are cut at a blank."""
    limit = 200
    sentences = F.flatten(F.transform(F.filter(F.split(T.strip(F.col("text")), r"(?<=[.!?\n])\s+"), lambda s: s != ""), lambda s: F.regexp_extract_all(s, F.lit(rf"(?s)\S.{{0,{limit - 2}}}(?=\s|$)|\S{{{limit}}}"), 0)))
    fold = F.aggregate(
        sentences, F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur")),
        lambda acc, s: F.when((acc["cur"] != "") & (F.length(acc["cur"]) + 1 + F.length(s) > limit), F.struct(F.array_append(acc["out"], acc["cur"]).alias("out"), s.alias("cur"))).otherwise(F.struct(acc["out"].alias("out"), F.trim(F.concat_ws(" ", acc["cur"], s)).alias("cur"))),
        lambda acc: F.filter(F.array_append(acc["out"], acc["cur"]), lambda x: x != ""),
    )
    return turns(spark, d).filter("text is not null").select("conv_id", "turn", F.posexplode(fold).alias("pos", "piece"))


@query("mc_flatten", r"""SELECT doc_id, regexp_extract(text, '\(Options: ([^)]*)\)', 1) AS options, regexp_extract(text, 'Answer: ([^\n]*)', 1) AS answer,
list_contains(list_transform(string_split(regexp_extract(text, '\(Options: ([^)]*)\)', 1), ';'), lambda x: trim(x)), trim(regexp_extract(text, 'Answer: ([^\n]*)', 1))) AS keyed FROM documents WHERE contains(text, '(Options: ')""")
def mc_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Options and answer of passages with options, and whether the answer is one of them."""
    options, answer = F.regexp_extract("text", r"\(Options: ([^)]*)\)", 1), F.regexp_extract("text", r"Answer: ([^\n]*)", 1)
    keyed = F.array_contains(F.transform(F.split(options, ";"), F.trim), F.trim(answer))
    return table(spark, d, "documents").filter(F.contains("text", F.lit("(Options: "))).select("doc_id", options.alias("options"), answer.alias("answer"), keyed.alias("keyed"))


@query("explode_qas", "SELECT doc_id, pos::BIGINT AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE kind = 'statements') WHERE trim(line) <> ''")
def explode_qas(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").filter("kind = 'statements'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return s.filter("trim(line) <> ''").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


@query("gold_spans", "SELECT window_id, i::BIGINT AS span, g.s AS s, g.e AS e, len(codes[g.s + 1 : g.e]) AS n FROM (SELECT window_id, codes, unnest(gold) AS g, generate_subscripts(gold, 1) - 1 AS i FROM windows WHERE codes IS NOT NULL)")
def gold_spans(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "windows").filter("codes is not null").select("window_id", "codes", F.posexplode("gold").alias("span", "g"))
    size = F.greatest(F.lit(0), F.least(F.col("g.e"), F.size("codes")) - F.greatest(F.col("g.s"), F.lit(0)))
    return w.select("window_id", F.col("span").cast("bigint").alias("span"), "g.s", "g.e", size.cast("bigint").alias("n"))
