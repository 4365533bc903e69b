import random

import pytest
from factloom.catalog.tokenizing import follower_table
from factloom.operators.encoder import Dictionary, fit_pieces, fnv1a64, scan, unfold
from factloom.sources import files
from factloom.streaming.conversations import batch_facts, stream_facts
from pyspark.sql import functions as F


def test_units_and_flags():
    assert scan(b"The cat sat.") == [b"The", b" cat", b" sat", b"."] and scan(b"abc123") == [b"abc", b"1", b"2", b"3"]
    assert scan(b"x\n\n\ty") == [b"x", b"\n\n", b"\t", b"y"]
    assert unfold(b"The") == (256, b"the") and unfold(b" NASA") == (257, b" nasa") and unfold(b"iPhone") == (None, b"iPhone")


def test_encoder_round_trip():
    d = Dictionary(fit_pieces({b" the": 9, b" then": 4, b"thing": 5, b" other": 3}, 12))
    rng = random.Random(1)
    for _ in range(500):
        data = bytes(rng.choice(b"tThHeEnN g.\n\xc3\xa9") for _ in range(rng.randint(0, 40)))
        assert d.decode(d.encode(data)) == data
    assert fit_pieces({}, 5) == [] and fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    with pytest.raises(ValueError):
        d.decode([99_999])


def test_follower_tables(spark):
    w = spark.createDataFrame([([1, 2, 3, 1, 2, 4, 1, 2, 3, 1, 2, 3, 5],), (None,), ([],)], "codes array<int>")
    got = {tuple(r.ctx): (r.followers, r.counts, r.total) for r in follower_table(w, 2, 2).collect()}
    assert got[(2,)] == ([3, 4], [3, 1], 4)
    assert {tuple(r.ctx): r.followers for r in follower_table(w, 3, 4).collect()}[(1, 2)] == [3, 4]


def test_documents_and_exchanges(spark, tmp_path):
    df = spark.createDataFrame([("one\n\npara",), ("two\fpages",), (None,)], "text string").coalesce(1)
    files.write_documents(df, str(tmp_path / "docs"))
    assert sorted(r.text for r in files.read_documents(spark, str(tmp_path / "docs")).collect()) == ["one\n\npara", "two pages"]
    (tmp_path / "x.txt").write_text("User: a?\nAssistant: b\nc\n\nUser: d\nAssistant: e\n\n")
    assert [(r.q, r.a) for r in files.read_exchanges(spark, str(tmp_path / "x.txt")).collect()] == [("a?", "b\nc"), ("d", "e")]
    (tmp_path / "m.txt").write_text("====\nFILE: n1\n====\nbody 1\n====\nFILE: n2\n====\nbody 2")
    assert [(r.name, r.text.strip()) for r in files.read_marked(spark, str(tmp_path / "m.txt")).collect()] == [("n1", "body 1"), ("n2", "body 2")]
    (tmp_path / "w.xml").write_text("<d><page><title>T</title><revision><text>body</text></revision></page></d>")
    assert [(r.title, r.text) for r in files.read_wiki(spark, str(tmp_path / "w.xml")).collect()] == [("T", "body")]
    (tmp_path / "b-8.txt").write_bytes("caf\xe9\r\n*** START OF IT ***\r\nText\r\n*** END OF IT ***\r\nrest".encode("latin-1"))
    assert files.read_books(spark, str(tmp_path / "b-8.txt")).first().text == "Text"


def test_id_files(spark):
    assert files.unpack_ids(files.pack_ids([1, 70_000], 100_000, 7), 7) == [1, 70_000]
    with pytest.raises(ValueError):
        files.unpack_ids(files.pack_ids([1], 10, 7), 8)
    rows = files.packed_ids(spark.createDataFrame([([1, 2],), (None,)], "codes array<int>"), 10, 7).collect()
    assert files.unpack_ids(rows[0].packed, 7) == [1, 2] and rows[1].packed is None


TURNS = [(1, 1, "My sister Kim lives in Oslo."), (1, 3, "Actually, Kim moved to Bergen after selling it."), (1, 2, "nothing here"), (2, 1, "My uncle Lars lives in Lima."), (2, 2, None)]


def test_corrections_keep_history(spark):
    df = spark.createDataFrame(TURNS, "conv_id bigint, turn int, text string")
    got = {(r.conv_id, r.who, r.attribute): (r.value, r.history) for r in batch_facts(df).collect()}
    assert got == {(1, "Kim", "lives"): ("Bergen", ["Oslo"]), (2, "Lars", "lives"): ("Lima", [])}
    assert batch_facts(df.limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    for i, part in enumerate((TURNS[:1] + TURNS[3:], TURNS[1:3])):
        spark.createDataFrame(part, "conv_id bigint, turn int, text string").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema("conv_id bigint, turn int, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream_facts(source).writeStream.format("memory").queryName("facts").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("facts").groupBy("conv_id", "who", "attribute").agg(F.max_by("value", "turn").alias("value")).collect()
    assert {(r.conv_id, r.who, r.value) for r in last} == {(1, "Kim", "Bergen"), (2, "Lars", "Lima")}


def test_batch_keeps_the_whole_history(spark):
    from factloom.streaming import conversations

    cities = ["Lo" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(151)]
    turns = spark.createDataFrame([(1, i, f"My aunt Anna lives in {c}.") for i, c in enumerate(cities)], "conv_id bigint, turn int, text string")
    told = conversations.statements(turns).orderBy("turn").collect()
    assert len(told) == len(cities)
    (r,) = conversations.batch_facts(turns).collect()
    assert r.value == told[-1].value and r.history == [x.value for x in told[:-1]]
