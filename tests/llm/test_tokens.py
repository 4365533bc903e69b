import random

import pytest
from factloom.llm.tokens import Vocabulary, encode, mix, murmur
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
TOK = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = TOK.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n\n \t x", "It's we'll I'VE don’t", "a" * 3000, "-" * 777, "ab" * 500, "日本語のテキスト。", "naïve café ﬁ №½", "\x00\x01\x85  x", "<|endoftext|>", "👩‍🔬 ok", "  leading   spaces  ", "x1y22 333,4"]
    out += ["".join(rng.choice("abc -'.\n1é日") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    out += ["".join(rng.choice("aab") for _ in range(rng.randint(1, 40))) for _ in range(150)]
    return out


def test_hashes_are_spark_hashes(spark):
    words = ["", "a", "héllo", " world!!", "日本"]
    rows = spark.createDataFrame([(w, i * 7919 - 3) for i, w in enumerate(words)], "w string, n bigint").select("w", "n", F.hash("w").alias("h"), F.xxhash64("n").alias("x")).collect()
    for r in rows:
        assert murmur(r.w.encode()) == r.h & 0xFFFFFFFF and mix(r.n) == r.x & (1 << 64) - 1


def test_same_ids_and_round_trip(spark, reference):
    rows = [(i, t, "kept") for i, t in enumerate(texts())]
    df = encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"))
    got = {r.doc_id: r for r in df.withColumn("back", Vocabulary().text(F.col("ids"))).collect()}
    for i, t, _ in rows:
        assert list(got[i].ids) == reference(t), repr(t)
        assert got[i].back == (t or "")


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "Wezibaxum is here"), (1, "Wezibaxum is here"), (None, "Wezibaxum is here")]
    assert len({tuple(r.ids) for r in encode(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}) == 1
    assert encode(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 3
    assert encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
