import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES = "answer_policy gate score_union std_weight_sweep hybrid_weighted merge_round_robin score_coverage hybrid_topk lookalikes recent_expand two_pool_delta".split()


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """60 facts of 120 words; ids and words that stand twice, null ids and texts, questions without a known word, empty conversations."""
    d = str(tmp_path_factory.mktemp("retrieval"))
    word = lambda k: "w" + chr(97 + k // 26) + chr(97 + k % 26)
    key = lambda i: " ".join(["common", word(i), word(i + 1), word(2 * i % 60)])
    facts = [(i, key(i), f"answer {word(i)}longer") for i in range(60)] + [(5, key(5), "answer again"), (None, key(7), "none"), (900, None, None), (901, key(8), None)]
    items = [(i, "train" if i % 5 == 0 else "dev", 1, i, f"common {word(i)} {word(i + 2)} {word(i)}", f"{word(i + 1)}longer" if i % 2 else None) for i in range(50)]
    items += [(7, "dev", 1, 7, f"{word(7)} {word(30)}", "other answer"), (None, "dev", 1, 3, word(3), "x"), (800, "dev", None, 0, None, None), (801, "dev", 2, 4, "unknown words", "x")]
    told = [(1, t, "user", f"{word(t)} {word(t + 5)}") for t in range(50)] + [(1, 3, "bot", word(9)), (2, 2, "user", word(11))]
    con = duckdb.connect()
    for name, cols, rows in (("knowledge_real", "fact_id BIGINT, key VARCHAR, a VARCHAR", facts), ("items", "item_id BIGINT, split VARCHAR, conv_id BIGINT, turn INTEGER, q VARCHAR, a VARCHAR", items), ("dialogues", "conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR", told)):
        con.execute(f"CREATE TABLE {name} ({cols})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"COPY {name} TO '{os.path.join(d, name)}.parquet' (FORMAT parquet)")
    return d, con


@pytest.mark.parametrize("name", QUERIES)
def test_pairs_stay_in_their_task(spark, tables, name):
    """No exchange by question and fact: shuffles grow with the tables, not with the pairs."""
    df = entry.queries()[name](spark, tables[0])
    assert "MapInArrow" in (plan := df._jdf.queryExecution().executedPlan().toString()) and not any("fact_id" in x and "item_id" in x for x in plan.split("\n") if "Exchange hashpartitioning" in x)


@pytest.mark.parametrize("name", QUERIES)
@pytest.mark.parametrize("size", [100_000, 7])
def test_odd_rows_as_sql(spark, tables, name, size, monkeypatch):
    monkeypatch.setattr("factloom.catalog.retrieval.SHARD_FACTS", size)
    monkeypatch.setattr("factloom.catalog.retrieval.PAIRS", 10)
    df = entry.queries()[name](spark, tables[0])
    got = tables[1].execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert len(got) > 0 and sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, got))


@pytest.fixture
def shared_questions(spark, tmp_path, monkeypatch):
    """200 facts and 90 questions, of which 3 are different, in shards of 7 facts."""
    monkeypatch.setattr("factloom.catalog.retrieval.SHARD_FACTS", 7)
    facts = [(i, f"alpha{chr(97 + i % 25)} beta{chr(97 + i % 23)} common" if i % 11 else f"word{'xyz'[i % 3]}", "a") for i in range(6000)]
    asked = [(i, "dev", 1, i, ("alphab betac", "wordx common", "betac alphab common")[i % 3], "a") for i in range(90)]
    for name, schema, rows in (("knowledge_real", "fact_id long, key string, a string", facts), ("items", "item_id long, split string, conv_id long, turn int, q string, a string", asked)):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_top_facts_leave_a_task_once(spark, shared_questions):
    """hybrid_topk: facts are sent once, by a number of their id, and a task gives five of all its shards for each different question."""
    plan = entry.queries()["hybrid_topk"](spark, shared_questions)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("hashpartitioning(id#", "hashpartitioning(item_id#"))
    from factloom.catalog import retrieval

    best, asked = retrieval.searched_once(spark, shared_questions)
    assert asked.count() == 90 and asked.select("bag").distinct().count() == 3
    assert 15 <= best.count() <= 15 * spark.sparkContext.defaultParallelism


def test_merged_lists_search_once(spark, shared_questions):
    """merge_round_robin: nothing is exchanged by the ids of items or of facts before the lists are merged."""
    df = entry.queries()["merge_round_robin"](spark, shared_questions)
    by = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert sum("fact_id#" in x for x in by) == 1 and not any("(id#" in x or "(item_id#" in x for x in by)
    got = {r["fact_id"]: r["place"] for r in df.collect()}
    assert len(got) == 10 and set(got.values()) == {10, 20, 30, 40, 50}


EVERY = ["gate", "hybrid_weighted", "score_coverage"]


@pytest.mark.parametrize("name", EVERY)
def test_common_words_bring_candidates(spark, tmp_path, name):
    """A fact that shares with a question only a word that most facts hold is met too; questions of words without weight give no score."""
    facts = [(i, "common often" if i < 30 else f"common w{chr(97 + i - 30)}x", "a") for i in range(50)]
    asked = [(1, "dev", 1, 0, "often", "a"), (2, "dev", 1, 1, "common", "a"), (3, "dev", 1, 2, "often wax", "a")]
    con = duckdb.connect()
    for table, schema, rows in (("knowledge_real", "fact_id long, key string, a string", facts), ("items", "item_id long, split string, conv_id long, turn int, q string, a string", asked)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path := str(tmp_path / f"{table}.parquet"))
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    rows = df.collect()
    assert sum(r["kept"] if name == "gate" else 1 for r in rows if r["item_id"] == 1) == 30
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()))


def test_bar_loses_no_fact():
    """With a bar all facts that reach it have the weight they have without, also where ids stand twice."""
    import numpy as np
    import pyarrow as pa

    from factloom.catalog.retrieval import Shard

    rng = np.random.default_rng(3)
    for ids in (np.arange(300), np.arange(300) // 2):
        ws = [np.flatnonzero(rng.random(20) < np.linspace(0.9, 0.02, 20)).tolist() for _ in ids]
        shard = Shard(pa.table({"id": ids, "total": np.ones(len(ids)), "ws": pa.array(ws, pa.list_(pa.int64()))}))
        for _ in range(50):
            asked = rng.permutation(25)[:7]
            idf = np.linspace(0.1, 4, 25)[asked]
            bar = 0.3 * idf.sum()
            every, some = (dict(zip(f.tolist(), s.round(9).tolist())) for f, s in (shard.match(shard.places(asked), idf), shard.match(shard.places(asked), idf, bar)))
            assert {k: v for k, v in some.items() if v >= bar} == {k: v for k, v in every.items() if v >= bar}


def test_two_pools(spark, tmp_path):
    """two_pool_delta: three facts and two earlier turns of the own conversation at most, each within 0.25 of its pool's best."""
    facts = [(i, "red" + chr(97 + i) + " boat", "a") for i in range(20)] + [(30 + i, "amber gate", "a") for i in range(5)] + [(40 + i, f"fill{chr(97 + i % 26)}{chr(97 + i // 26)}", "a") for i in range(100)]
    asked = [(1, "dev", 1, 9, "amber gate kept", "a")]
    told = [(1, 1, "user", "the amber gate"), (1, 2, "user", "amber gate kept"), (1, 3, "user", "gate kept amber"), (1, 4, "user", "kept"), (1, 5, "assistant", "amber gate kept"), (1, 9, "user", "amber gate kept"), (2, 1, "user", "amber gate kept")]
    con = duckdb.connect()
    for table, schema, rows in (("knowledge_real", "fact_id long, key string, a string", facts), ("items", "item_id long, split string, conv_id long, turn int, q string, a string", asked), ("dialogues", "conv_id long, turn int, role string, text string", told)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path := str(tmp_path / f"{table}.parquet"))
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    rows = entry.queries()["two_pool_delta"](spark, str(tmp_path)).collect()
    assert sorted((r["pool"], r["fact_id"] or r["turn"]) for r in rows) == [("fact", 32), ("fact", 33), ("fact", 34), ("turn", 2), ("turn", 3)]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, con.execute(entry.oracle_sql()["two_pool_delta"]).fetchall()))


def test_answer_policy(spark, tmp_path):
    """One word apart is to be clarified, unless the question has the word; exact questions are answered, others of one word or without a fact are not."""
    facts = [(1, "sam birthday party", "a"), (2, "eli birthday party", "a"), (3, "sky blue why", "a"), (4, "sky appears blue colour", "a"), (5, "solo", "a")] + [(40 + i, f"fill{chr(97 + i % 26)}{chr(97 + i // 26)}", "a") for i in range(100)]
    texts = ["birthday party", "birthday party eli when", "sky blue", "sam birthday party", "solo", "unknown words", None]
    asked = [(i, "dev", 1, i, q, "a") for i, q in enumerate(texts)]
    con = duckdb.connect()
    for table, schema, rows in (("knowledge_real", "fact_id long, key string, a string", facts), ("items", "item_id long, split string, conv_id long, turn int, q string, a string", asked)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path := str(tmp_path / f"{table}.parquet"))
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    rows = sorted(map(tuple, entry.queries()["answer_policy"](spark, str(tmp_path)).collect()))
    assert rows == list(enumerate(["clarify", "answer", "answer", "answer", "abstain", "abstain", "abstain"]))
    assert rows == sorted(con.execute(entry.oracle_sql()["answer_policy"]).fetchall())
