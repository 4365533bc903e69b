"""Text normalisation, predicates and filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.plans.session import table
from factloom.registry import query

WS = r"[ \t\n\x0B\f\r]"
NOT_WORD = r"[^\p{L}\p{N}_]+"
# SQL fragments, with {0} for the text.
STRIP = rf"regexp_replace({{0}}, '^{WS}+|{WS}+$', '', 'g')"  # filled by str.format or replace
COLLAPSE = STRIP.format(rf"regexp_replace({{0}}, '{WS}+', ' ', 'g')")
PUNCT = "replace(replace(translate(replace(replace({0}, chr(8203), ''), chr(65279), ''), '‘’‚“”„–' || chr(160) || chr(8239), '''''''\"\"\"-  '), '—', '--'), '…', '...')"
LOWER = "lower(replace({0}, 'İ', 'i̇'))"
FINGER = f"md5(trim(regexp_replace({LOWER}, '{NOT_WORD}', ' ', 'g')))"
LETTERS = r"(CASE WHEN length({0}) > 0 THEN length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')) / length({0}) ELSE 0 END)"


def scalar(name: str, tab: str, key: str, col: str, f: Callable[[Column], Column], sql: str) -> None:
    """A query of key and value: f over col in Spark, sql in the oracle."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, tab).select(*key.split(", "), f(T.text(F.col(col))).alias("value"))

    value = sql.replace("{0}", f"coalesce({col}, '')").replace("{{", "{").replace("}}", "}")
    query(name, f"SELECT {key}, {value} AS value FROM {tab}")(run)


def words_rx(words: list[str], plural: bool = False, case: bool = False) -> str:
    body = "|".join(w.replace("'", "''") for w in words)
    return ("" if case else "(?i)") + r"(?:^|[^\p{L}\p{N}_])(?:" + body + ")" + ("s?" if plural else "") + r"(?:[^\p{L}\p{N}_]|$)"


def count_words(words: list[str]) -> str:
    """Occurrences of whole words: every word of the text against the list, so neighbours don't hide each other."""
    listed = ", ".join(f"'{w}', '{w}s'" for w in words)
    return f"len(list_filter(regexp_extract_all(lower({{0}}), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda w: w IN ({listed})))"


AMERICAN = f"({count_words(T.BRITISH)} < 2 OR {count_words(T.BRITISH)} <= {count_words(T.AMERICAN)})"

scalar("norm_punct", "documents", "doc_id", "text", T.ascii_punctuation, PUNCT)
scalar("norm_hash", "documents", "doc_id", "text", T.fingerprint, FINGER)
scalar("norm_prefix120", "documents", "doc_id", "text", lambda c: T.prefix_key(c, 120), f"substring({COLLAPSE}, 1, 120)")
scalar("norm_first300", "documents", "doc_id", "text", T.first_key, f"substring({COLLAPSE.format(LOWER)}, 1, 300)")
scalar("reply_key", "dialogues", "conv_id, turn", "text", T.reply_key, f"md5(trim(substring(regexp_replace(lower({PUNCT}), '{NOT_WORD}', ' ', 'g'), 1, 160)))")
scalar("norm_crlf_ws", "documents", "doc_id", "text", lambda c: F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), "[ \t]+", " "), " ?\n[ \n]*", "\n\n"), r"regexp_replace(regexp_replace(replace({0}, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10) || chr(10), 'g')")
scalar("unwrap_lines", "documents", "doc_id", "text", lambda c: F.array_join(F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: T.strip(F.regexp_replace(p, r"\s*\n\s*", " "))), lambda p: p != ""), "\n\n"), f"array_to_string(list_filter(list_transform(regexp_split_to_array({{0}}, '\\n{WS}*\\n'), lambda p: {STRIP.format(f'regexp_replace(p, {chr(39)}{WS}*\\n{WS}*{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}), lambda p: p <> ''), chr(10) || chr(10))")
scalar("fold_blank", "items", "item_id", "a", lambda c: F.regexp_replace(T.strip(c), r"\n\s*\n", "\n"), f"regexp_replace({STRIP}, '\\n{WS}*\\n', chr(10), 'g')")
scalar("cap_first", "knowledge_real", "fact_id", "a", lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.expr("substring(coalesce(a, ''), 2)")), "upper(substring({0}, 1, 1)) || substring({0}, 2)")
scalar("your", "dialogues", "conv_id, turn", "text", lambda c: F.regexp_replace(F.regexp_replace(c, r"\bMy\b", "Your"), r"\bmy\b", "your"), r"regexp_replace(regexp_replace({0}, '(^|[^\p{{L}}\p{{N}}_])My($|[^\p{{L}}\p{{N}}_])', '\1Your\2', 'g'), '(^|[^\p{{L}}\p{{N}}_])my($|[^\p{{L}}\p{{N}}_])', '\1your\2', 'g')")
scalar("doc_title", "documents", "doc_id", "text", lambda c: F.when(F.length(F.substring_index(c, "\n", 1)) <= 80, T.strip(F.substring_index(c, "\n", 1))), f"CASE WHEN length(split_part({{0}}, chr(10), 1)) <= 80 THEN {STRIP.format('split_part({0}, chr(10), 1)')} END")
scalar("lead_sentence", "knowledge_real", "fact_id", "a", lambda c: F.regexp_extract(c, r"(?s)^(.{3,200}? (?:is|was|are|were) .{10,300}?\.)(?:\s|$)", 1), f"regexp_extract({{0}}, '(?s)^(.{{{{3,200}}}}? (?:is|was|are|were) .{{{{10,300}}}}?\\.)(?:{WS}|$)', 1)")
scalar("cut_at_sentence", "documents", "doc_id", "text", lambda c: T.cut_at_sentence(c, 400), f"CASE WHEN length({{0}}) <= 400 THEN {{0}} WHEN length(regexp_extract(substring({{0}}, 1, 400), '(?s)^(.*[.!?](?:{WS}|$))', 1)) > 133 THEN {STRIP.format(f'regexp_extract(substring({{0}}, 1, 400), {chr(39)}(?s)^(.*[.!?](?:{WS}|$)){chr(39)}, 1)')} ELSE '' END")
scalar("gsm_clean", "documents", "doc_id", "text", lambda c: F.concat(F.regexp_replace(F.substring_index(c, "####", 1), "<<[^>]*>>", ""), F.lit("\nAnswer: "), T.strip(F.substring_index(c, "####", -1))), f"regexp_replace(split_part({{0}}, '####', 1), '<<[^>]*>>', '', 'g') || chr(10) || 'Answer: ' || {STRIP.format('string_split({0}, {1}####{1})[-1]'.replace('{1}', chr(39)))}")
scalar("final_number", "documents", "doc_id", "text", lambda c: F.replace(F.try_element_at(F.regexp_extract_all(c, F.lit(r"Answer:[ ]*(-?[0-9][0-9,]*)"), 1), F.lit(-1)), F.lit(","), F.lit("")), r"replace(regexp_extract_all({0}, 'Answer:[ ]*(-?[0-9][0-9,]*)', 1)[-1], ',', '')")
scalar("flt_american", "documents", "doc_id", "text", T.american, AMERICAN)
scalar("flt_ascii_share", "dialogues", "conv_id, turn", "text", lambda c: F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")) / F.length(c) < 0.9).otherwise(False), r"(CASE WHEN length({0}) > 0 THEN length(regexp_replace({0}, '[^\x00-\x7F]', '', 'g')) / length({0}) < 0.9 ELSE false END)")
scalar("flt_reading", "documents", "doc_id", "text", lambda c: c.rlike(r"Passage:|\nContext:|\(Options:"), r"regexp_matches({0}, 'Passage:|\nContext:|\(Options:')")
scalar("flt_open_ended", "knowledge_real", "fact_id", "q", lambda c: c.rlike("^(Explain|Describe|Discuss|Summarize|Why|How)") & ~F.contains(c, F.lit("\n")), r"(regexp_matches({0}, '^(Explain|Describe|Discuss|Summarize|Why|How)') AND NOT contains({0}, chr(10)))")
scalar("flt_max_words", "documents", "doc_id", "text", lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) <= 150, f"len(list_filter(regexp_split_to_array({{0}}, '{WS}+'), lambda w: w <> '')) <= 150")
scalar("words_of", "knowledge_real", "fact_id", "a", lambda c: F.array_join(T.words(c), " "), "array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z]+'), lambda w: lower(w)), ' ')")
scalar("encode_bytes", "items", "item_id", "q", lambda c: F.hex(F.encode(c, "UTF-8")), "upper(hex(encode({0})))")

_KEY = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z]+'), lambda w: lower(w)), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP) + "))))"
_PARA = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z]{{3,}}'), lambda w: lower(w)), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in T.COMMON) + "))))"
_CONTENT = "list_sort(list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9@.\\-#'']*'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP) + "))))"
scalar("key_of", "knowledge_real", "fact_id", "key", T.word_key, _KEY)
scalar("para_key", "documents", "doc_id", "text", T.paragraph_key, _PARA)
scalar("content_words", "items", "item_id", "a", T.content_words, _CONTENT)
scalar("fold_stem", "items", "item_id", "q", lambda c: F.transform(T.words(c), T.stem), "list_transform(list_transform(regexp_extract_all({0}, '[A-Za-z]+'), lambda w: lower(w)), lambda w: CASE WHEN w LIKE '%ies' AND length(w) >= 7 THEN left(w, length(w) - 3) || 'y' " + " ".join(f"WHEN w LIKE '%{e}' AND length(w) >= {len(e) + 4} THEN left(w, length(w) - {len(e)})" for e in ("ing", "ed", "es", "ly", "s")) + " ELSE w END)")
scalar("case_split", "items", "item_id", "q", lambda c: F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), 0), lambda w: F.concat(F.when(w.rlike("^[A-Z][a-z]*$"), "CAP ").when(w.rlike("^[A-Z]{2,}$"), "UPPER ").otherwise(F.when(w.rlike("[A-Z]"), "none ").otherwise("")), F.when(w.rlike("^([A-Z][a-z]*|[A-Z]{2,})$"), F.lower(w)).otherwise(w))), "list_transform(regexp_extract_all({0}, '[A-Za-z]+'), lambda w: CASE WHEN regexp_full_match(w, '[A-Z][a-z]*') THEN 'CAP ' || lower(w) WHEN regexp_full_match(w, '[A-Z]{{2,}}') THEN 'UPPER ' || lower(w) WHEN regexp_matches(w, '[A-Z]') THEN 'none ' || w ELSE w END)")
scalar("split_md5_10", "knowledge_real", "fact_id", "q", T.md5_tenth, f"list_sum(list_transform(range(1, 33), lambda i: (CASE WHEN i = 32 THEN 1 ELSE 6 END) * (strpos('0123456789abcdef', md5(lower({STRIP}))[i]) - 1)))::BIGINT % 10")
scalar("split_hash100", "documents", "doc_id", "text", T.held_out_100, "(('0x' || substring(sha256({0}), 7, 2) || substring(sha256({0}), 5, 2) || substring(sha256({0}), 3, 2) || substring(sha256({0}), 1, 2))::BIGINT % 100) = 0")


@query("flt_clean_piece", "SELECT fact_id FROM knowledge_real WHERE length(a) >= 60 AND NOT (" + " OR ".join(f"contains(a, {x})" for x in ("'http'", "'|'", "'{{'", "'[['", "'=='", "'<'", "'>'", "chr(9)")) + f") AND {LETTERS.format('a')} > 0.7 AND regexp_matches(a, '^\\p{{Lu}}') AND regexp_matches(a, '[.!?\")]{WS}*$')")
def flt_clean_piece(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_real").filter(T.clean_piece(F.col("a"))).select("fact_id")


@query("flt_clean_sentence", f"SELECT fact_id FROM knowledge_real WHERE length(a) BETWEEN 40 AND 180 AND regexp_matches(a, '^\\p{{Lu}}') AND a LIKE '%.' AND NOT (" + " OR ".join(f"contains(a, '{x}')" for x in (";", "http", "|", "  ", "(vb", "�", '"', "?")) + f") AND NOT regexp_matches(a, '{words_rx(T.PERSON)}') AND NOT regexp_matches(a, '{words_rx(T.OPINION)}') AND regexp_matches(a, '{words_rx(T.STATEMENT, case=True)}') AND {LETTERS.format('a')} > 0.8 AND {AMERICAN.format('a')}")
def flt_clean_sentence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_real").filter(T.clean_statement(F.col("a"))).select("fact_id")


@query("flt_question_like", "SELECT fact_id FROM knowledge_real WHERE q LIKE '%?' AND length(q) < 200 AND NOT contains(q, chr(10)) AND length(a) > 20 AND length(a) < 400 AND NOT (a LIKE 'For %' OR a LIKE 'This %' OR a LIKE 'See %' OR a LIKE 'Not to be confused%')")
def flt_question_like(spark: SparkSession, d: str) -> DataFrame:
    q, a = F.col("q"), F.col("a")
    hat = a.startswith("For ") | a.startswith("This ") | a.startswith("See ") | a.startswith("Not to be confused")
    return table(spark, d, "knowledge_real").filter(q.endswith("?") & (F.length(q) < 200) & ~q.contains("\n") & (F.length(a) > 20) & (F.length(a) < 400) & ~hat).select("fact_id")


@query("flt_lang_score", "SELECT doc_id, source, text FROM documents WHERE lang = 'en' AND n_chars >= 300")
def flt_lang_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("lang = 'en' and n_chars >= 300").select("doc_id", "source", "text")


@query("flt_min_len", "SELECT doc_id, length(text) > 2000 AS long FROM documents WHERE length(text) >= 300")
def flt_min_len(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.length("text") >= 300).select("doc_id", (F.length("text") > 2000).alias("long"))


@query("flt_category", f"SELECT fact_id FROM knowledge_real WHERE source NOT IN ('skill', 'doc') AND {STRIP.format('a')} <> ''")
def flt_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_real").filter(~F.col("source").isin("skill", "doc") & (T.strip(F.col("a")) != "")).select("fact_id")


@query("wiki_filters", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN 'null' WHEN regexp_matches(text, '(?i)^#REDIRECT') THEN 'redirect' WHEN regexp_matches(text, '^(Home \\||Template:|Category:)') THEN 'namespace' WHEN length(text) < 500 THEN 'short' ELSE 'kept' END AS reason FROM documents) GROUP BY reason")
def wiki_filters(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    reason = F.when(t.isNull(), "null").when(t.rlike("(?i)^#REDIRECT"), "redirect").when(t.rlike(r"^(Home \||Template:|Category:)"), "namespace").when(F.length(t) < 500, "short").otherwise("kept")
    return table(spark, d, "documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("drop_front_matter", f"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n{WS}*\\n')) AS p, generate_subscripts(regexp_split_to_array(text, '\\n{WS}*\\n'), 1) AS i FROM documents),
c AS (SELECT doc_id, p, i, regexp_matches(p, '(?i){T.CREDITS.replace("'", "''")}') AS credit FROM p),
s AS (SELECT doc_id, coalesce(min(CASE WHEN length(p) >= 200 AND NOT credit AND upper(p) <> p THEN i END), 0) AS first FROM c GROUP BY doc_id)
SELECT doc_id, i::BIGINT AS pos, p AS paragraph FROM c JOIN s USING (doc_id) WHERE i >= first AND NOT credit""")
def drop_front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs from the first long prose one on, without credits; the first is found while the document is one row."""
    paras = F.transform(F.split("text", r"\n\s*\n"), lambda p, i: F.struct((i + 1).cast("bigint").alias("pos"), p.alias("p"), p.rlike("(?i)" + T.CREDITS).alias("credit")))
    prose = F.filter(F.col("ps"), lambda x: (F.length(x["p"]) >= 200) & ~x["credit"] & (F.upper(x["p"]) != x["p"]))
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", paras.alias("ps")).withColumn("first", F.coalesce(F.get(prose, 0)["pos"], F.lit(0)))
    return docs.select("doc_id", "first", F.explode("ps").alias("x")).filter("x.pos >= first and not x.credit").select("doc_id", "x.pos", F.col("x.p").alias("paragraph"))


@query("latex_to_plain")
def latex_to_plain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.latex_to_plain(T.text(F.col("text"))).alias("value"))


@query("metamath_final", f"SELECT doc_id, {STRIP.format("regexp_extract(text, '(?s)Answer:[ ]*([^\\n]+)$', 1)")} AS final FROM documents WHERE regexp_matches(text, '(?s)Answer:[ ]*[^\\n]+$')")
def metamath_final(spark: SparkSession, d: str) -> DataFrame:
    rx = r"(?s)Answer:[ ]*([^\n]+)\z"
    return table(spark, d, "documents").filter(F.col("text").rlike(rx)).select("doc_id", T.strip(F.regexp_extract("text", rx, 1)).alias("final"))
