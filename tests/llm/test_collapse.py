import random

from factloom.functions.canonical import letters_digits
from factloom.llm.collapse import collapse_copies, format_copies
from pyspark.sql import functions as F

SCHEMA = "fact_id bigint, a string, key string, copies int"


def pairs(df):
    return {(r.id_a, r.id_b) for r in format_copies(df).collect()}


def test_formatting_and_field_order(spark):
    rows = [(5, "It is 44.", "Ann | age | 44", 0), (3, " IT  is 44!", "age|44 | ann", 0), (9, "It is 45.", "Ann | age | 44", 0), (7, "größe", "k", 0), (8, "GRÖSSE", "K", 0), (11, "grosse", "k", 0), (12, "café", "x", 0), (13, "Café", "x |", 0)]
    assert pairs(spark.createDataFrame(rows, SCHEMA)) == {(3, 5), (7, 8), (12, 13)}


def test_nulls_empty_table_and_clashing_names(spark):
    rows = [(1, None, None, 4), (2, "", "|", 4), (3, "...", None, 4), (None, "x", "y", 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert pairs(df) == {(1, 2), (1, 3)}
    out = collapse_copies(df).collect()
    assert [(r.fact_id, r.copies, r.copies_) for r in out] == [(1, 4, 3)]
    assert format_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_group_spreads_and_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["same text"] * 3 + [f"text {rng.randrange(200)}", f"Text, {rng.randrange(200)}"]), "k", 0) for i in range(3000)]
    rng.shuffle(rows)
    groups = {}
    for i, a, _, _ in rows:
        groups.setdefault("".join(c for c in a.lower() if c.isalnum()), []).append(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert pairs(spark.createDataFrame(rows, SCHEMA).repartition(7)) == want
    assert collapse_copies(spark.createDataFrame(rows, SCHEMA)).agg(F.sum("copies_")).first()[0] == 3000


def test_letters_digits(spark):
    got = spark.createDataFrame([("Ab-c 1²!",), ("Σας",), (None,), ("x" * 100_000,)], "t string").select(letters_digits(F.col("t")).alias("t")).collect()
    assert [r.t[:10] for r in got] == ["abc1²", "σασ", "", "x" * 10]
