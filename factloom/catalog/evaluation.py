"""Scoring rules, audits and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.plans.session import table
from factloom.registry import query


@query("score_has", "SELECT item_id, regexp_matches(lower(coalesce(a, '')), '(^|[^a-z0-9])' || lower(w)) AS has FROM (SELECT item_id, a, regexp_extract(coalesce(q, ''), '([A-Z][a-z]+)', 1) AS w FROM items) WHERE w <> ''")
def score_has(spark: SparkSession, d: str) -> DataFrame:
    """Whether an answer holds the question's first name as the beginning of a word."""
    w = table(spark, d, "items").select("item_id", F.lower(T.text(F.col("a"))).alias("a"), F.lower(F.regexp_extract(T.text(F.col("q")), "([A-Z][a-z]+)", 1)).alias("w")).filter("w <> ''")
    return w.select("item_id", F.rlike("a", F.concat(F.lit("(^|[^a-z0-9])"), "w")).alias("has"))


@query("keyword_check", "SELECT item_id, (contains(lower(a), 'the') OR contains(lower(a), 'a ')) AND (contains(lower(a), 'of') OR contains(lower(a), 'in')) AS right FROM items WHERE a IS NOT NULL")
def keyword_check(spark: SparkSession, d: str) -> DataFrame:
    """Every group has one of its keywords in the answer."""
    groups = F.array(F.array(F.lit("the"), F.lit("a ")), F.array(F.lit("of"), F.lit("in")))
    right = F.forall(groups, lambda g: F.exists(g, lambda k: F.contains(F.lower("a"), k)))
    return table(spark, d, "items").filter("a is not null").select("item_id", right.alias("right"))


@query("score_asks", "SELECT item_id, contains(t, '?') AND (contains(t, ' or ') OR contains(t, 'which') OR contains(t, 'do you mean')) AS asks FROM (SELECT item_id, lower(coalesce(q, '')) AS t FROM items)")
def score_asks(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower(T.text(F.col("q")))
    has = lambda x: F.contains(t, F.lit(x))
    return table(spark, d, "items").select("item_id", (has("?") & (has(" or ") | has("which") | has("do you mean"))).alias("asks"))


_W = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z]{{4,}}'))"


@query("support", f"SELECT item_id, round(CASE WHEN len({_W.format('a')}) > 0 THEN len(list_intersect({_W.format('a')}, {_W.format('q')})) / len({_W.format('a')}) ELSE 0.8 END, 6) AS support FROM items")
def support(spark: SparkSession, d: str) -> DataFrame:
    """Share of an answer's words that the question has; 0.8 where it has none."""
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(T.text(F.col(c))), F.lit("[a-z]{4,}"), 0))
    i = table(spark, d, "items").select("item_id", w("q").alias("q"), w("a").alias("a"))
    return i.select("item_id", F.round(F.when(F.size("a") > 0, F.size(F.array_intersect("a", "q")) / F.size("a")).otherwise(0.8), 6).alias("support"))


@query("grounded_share", f"SELECT split, round(avg(CASE WHEN s >= 0.5 THEN 1 ELSE 0 END), 9) AS share, count(*) AS n FROM (SELECT split, len(list_intersect({_W.format('a')}, {_W.format('q')})) / len({_W.format('a')}) AS s FROM items WHERE len({_W.format('a')}) > 0) GROUP BY split")
def grounded_share(spark: SparkSession, d: str) -> DataFrame:
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(T.text(F.col(c))), F.lit("[a-z]{4,}"), 0))
    i = table(spark, d, "items").select("split", w("q").alias("q"), w("a").alias("a")).filter(F.size("a") > 0)
    s = F.size(F.array_intersect("a", "q")) / F.size("a")
    return i.groupBy("split").agg(F.round(F.avg(F.when(s >= 0.5, 1.0).otherwise(0.0)), 9).alias("share"), F.count(F.lit(1)).alias("n"))


@query("diff_holds", "WITH g AS (SELECT source, split = 'train' AS base, sum(CASE WHEN length(a) > 50 THEN 1 ELSE 0 END) AS k, count(*) AS n FROM items GROUP BY 1, 2), j AS (SELECT source, max(k) FILTER (WHERE NOT base) AS k1, max(n) FILTER (WHERE NOT base) AS n1, max(k) FILTER (WHERE base) AS k0, max(n) FILTER (WHERE base) AS n0 FROM g GROUP BY source) SELECT source, k1 / n1 >= k0 / n0 - 2 * sqrt(greatest(k1 / n1 * (1 - k1 / n1) / n1 + k0 / n0 * (1 - k0 / n0) / n0, 1e-9)) AS holds FROM j WHERE n1 > 0 AND n0 > 0")
def diff_holds(spark: SparkSession, d: str) -> DataFrame:
    """Whether a share holds against a base within two standard errors."""
    base, hit = F.col("split") == "train", F.length("a") > 50
    g = table(spark, d, "items").groupBy("source").agg(F.count_if(~base & hit).alias("k1"), F.count_if(~base).alias("n1"), F.count_if(base & hit).alias("k0"), F.count_if(base).alias("n0")).filter("n1 > 0 and n0 > 0")
    p1, p0 = F.col("k1") / F.col("n1"), F.col("k0") / F.col("n0")
    se = F.sqrt(F.greatest(p1 * (1 - p1) / F.col("n1") + p0 * (1 - p0) / F.col("n0"), F.lit(1e-9)))
    return g.select("source", (p1 >= p0 - 2 * se).alias("holds"))


@query("gate_floors", "WITH v AS (SELECT kind, round(avg(len(codes)), 6) AS value FROM windows WHERE codes IS NOT NULL GROUP BY kind), f(kind, direction, bound) AS (VALUES ('qa', 'floor', 200.0), ('story', 'floor', 1000.0), ('convo', 'ceiling', 900.0), ('none', 'floor', 1.0)) SELECT f.kind, value, CASE WHEN value IS NULL THEN 'unknown' WHEN direction = 'floor' AND value >= bound THEN 'holds' WHEN direction = 'ceiling' AND value <= bound THEN 'holds' ELSE 'lost' END AS status FROM f LEFT JOIN v USING (kind)")
def gate_floors(spark: SparkSession, d: str) -> DataFrame:
    """Values against fixed floors and ceilings; a missing one is unknown."""
    f = spark.createDataFrame([("qa", "floor", 200.0), ("story", "floor", 1000.0), ("convo", "ceiling", 900.0), ("none", "floor", 1.0)], "kind string, direction string, bound double")
    v = table(spark, d, "windows").filter("codes is not null").groupBy("kind").agg(F.round(F.avg(F.size("codes")), 6).alias("value"))
    ok = ((F.col("direction") == "floor") & (F.col("value") >= F.col("bound"))) | ((F.col("direction") == "ceiling") & (F.col("value") <= F.col("bound")))
    return f.join(v, "kind", "left").select("kind", "value", F.when(F.col("value").isNull(), "unknown").when(ok, "holds").otherwise("lost").alias("status"))


@query("audit_dataset", """SELECT split, count(*) AS n, count(*) FILTER (WHERE q IS NULL OR trim(q) = '') AS empty_q, count(*) FILTER (WHERE a IS NULL OR trim(a) = '') AS empty_a,
count(*) - count(DISTINCT (coalesce(q, '') || chr(1) || coalesce(a, ''))) AS copies, round(quantile_cont(length(a), 0.95), 6) AS p95 FROM items GROUP BY split""")
def audit_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Empties, copies and lengths by split; copies come from a count of distinct texts that combines before the shuffle."""
    i = table(spark, d, "items")
    rows = i.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q").isNull() | (F.trim("q") == "")).alias("empty_q"), F.count_if(F.col("a").isNull() | (F.trim("a") == "")).alias("empty_a"), F.round(F.percentile(F.length("a"), 0.95), 6).alias("p95"))
    texts = i.select("split", F.sha2(F.concat_ws("\x01", T.text(F.col("q")), T.text(F.col("a"))), 256).alias("h")).distinct().groupBy("split").agg(F.count(F.lit(1)).alias("texts"))
    return rows.join(texts, "split").select("split", "n", "empty_q", "empty_a", (F.col("n") - F.col("texts")).alias("copies"), "p95")


@query("position_bands", "SELECT least(pos // 256, 15)::BIGINT AS band, count(*) AS n, round(avg(code), 6) AS mean FROM (SELECT unnest(codes) AS code, generate_subscripts(codes, 1) - 1 AS pos FROM windows) GROUP BY band")
def position_bands(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "windows").select(F.posexplode("codes").alias("pos", "code"))
    return p.groupBy(F.least(F.floor(F.col("pos") / 256), F.lit(15)).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("code"), 6).alias("mean"))


@query("recall_by_distance", "SELECT source, least(turn, 20) AS distance, count(*) AS n, count(*) FILTER (WHERE length(a) > 30) AS recalled FROM items GROUP BY source, distance")
def recall_by_distance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").groupBy("source", F.least("turn", F.lit(20)).alias("distance")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("a") > 30).alias("recalled"))


@query("history_gain", "SELECT kind, round(1 - avg(loo) FILTER (WHERE prompt_len > 0) / nullif(avg(loo), 0), 6) AS gain FROM windows WHERE loo IS NOT NULL GROUP BY kind")
def history_gain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "windows").filter("loo is not null").groupBy("kind").agg(F.round(1 - F.try_divide(F.avg(F.when(F.col("prompt_len") > 0, F.col("loo"))), F.avg("loo")), 6).alias("gain"))


# Signs and words of the four operations.
OPERATIONS = {"+": "plus", "-": "minus", "*": "times", "x": "times", "/": "divided by", "plus": "plus", "minus": "minus", "times": "times", "multiplied by": "times", "divided by": "divided by", "over": "divided by"}
_NUMBER = r"(\d{1,9}(?:\.\d{1,6})?)"
_SUM = rf"(?:^|[^\d:.\-]){_NUMBER}\s+(multiplied by|divided by|plus|minus|times|over|[-+*/x])\s+{_NUMBER}(?:[^\d:.\-]|$)"
_OP = "CASE op " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OPERATIONS.items()) + " END"


@query(
    "tool_arith",
    f"""WITH t AS (SELECT doc_id AS id, lower(text) AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT item_id, lower(q) FROM items WHERE q IS NOT NULL UNION ALL SELECT -1, 'what is 12 plus 30?' UNION ALL SELECT -2, '7 x 2.5' UNION ALL SELECT -3, '9 over 0'),
m AS (SELECT id, regexp_extract(t, '{_SUM}', 1) AS x, regexp_extract(t, '{_SUM}', 2) AS op, regexp_extract(t, '{_SUM}', 3) AS y FROM t),
v AS (SELECT id, x::DOUBLE AS x, {_OP} AS op, y::DOUBLE AS y FROM m WHERE op <> '')
SELECT id, x, op, y, round(CASE op WHEN 'plus' THEN x + y WHEN 'minus' THEN x - y WHEN 'times' THEN x * y ELSE x / y END, 6) AS value FROM v WHERE NOT (op = 'divided by' AND y = 0)""",
)
def tool_arith(spark: SparkSession, d: str) -> DataFrame:
    """The first sum in a text, in signs or words, and what it comes to; three sums of known result stand beside the tables' texts.
    Dividing by zero gives no row."""
    known = spark.createDataFrame([(-1, "what is 12 plus 30?"), (-2, "7 x 2.5"), (-3, "9 over 0")], "id bigint, t string")
    texts = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), F.lower("text").alias("t"))
    asked = table(spark, d, "items").filter("q is not null").select(F.col("item_id").alias("id"), F.lower("q").alias("t"))
    part = lambda k: F.regexp_extract("t", _SUM, k)
    names = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])
    found = texts.unionByName(asked).unionByName(known).select("id", part(1).alias("x"), part(2).alias("sign"), part(3).alias("y")).filter("sign <> ''")
    v = found.select("id", F.col("x").cast("double").alias("x"), names[F.col("sign")].alias("op"), F.col("y").cast("double").alias("y")).filter("not (op = 'divided by' and y = 0)")
    x, y, op = F.col("x"), F.col("y"), F.col("op")
    value = F.when(op == "plus", x + y).when(op == "minus", x - y).when(op == "times", x * y).otherwise(F.try_divide(x, y))
    return v.select("id", "x", "op", "y", F.round(value, 6).alias("value"))


# Days of the week in order.
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


@query("tool_calendar", "SELECT event_id, ['" + "', '".join(DAYS) + "'][isodow(ts) % 7 + 1] AS after FROM events")
def tool_calendar(spark: SparkSession, d: str) -> DataFrame:
    """The day after each event's."""
    days = F.array(*map(F.lit, DAYS))
    return table(spark, d, "events").select("event_id", F.get(days, (F.weekday("ts") + 1) % 7).alias("after"))
