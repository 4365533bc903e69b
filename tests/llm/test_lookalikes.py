import pytest
from factloom.llm.lookalikes import Canonical, Trie, consistent, inconsistent_fields

WORDS = {"royal": 9, "pastry": 9, "the": 50, "ремонта": 9, "рот": 3, "pot": 2}


@pytest.mark.parametrize("given,want", [
    ("the rοyal раѕtry", "the royal pastry"), ("после рeмонтa", "после ремонта"), ("ｔｈｅ ｃａｔ", "the cat"), ("café", "café"), ("s​oft­ly", "softly"), ("a b c　d", "a b c d"),
    ("ﬁnd", "find"), ("300 K", "300 K"), ("ﾎﾃﾙ は", "ホテル は"), ("NÃO É РERMITIDO", "NÃO É PERMITIDO"),
])
def test_changes(given, want):
    assert Canonical(WORDS)(given) == want


@pytest.mark.parametrize("text", ["“quoted” – dash — and…", "m² ½ № 5", "the ratio is close to π", "Жители с города у моста", "the word “город” is Russian", "どこ（古い）？そう！", "👩‍🔬 checked it ❤️", "", "plain", "x" * 50_000, None])
def test_no_cases(text):
    assert Canonical(WORDS)(text) == text


def test_words_take_the_vocabulary_spelling_at_no_cost():
    trie = Trie({"café": 4, "find": 3, "softly": 2, "сор": 3, "cop": 2})
    assert trie.spell("cafe\u0301") == "café" and trie.spell("ﬁnd") == "find" and trie.spell("s\u200boft\u00adly") == "softly" and trie.spell("ｃｏｐ", "L") == "cop"
    assert trie.spell("cоp", "C") == "сор" and trie.spell("cоp", "L") == "cop"


def test_other_edits_have_weights():
    trie = Trie({"bridge": 4, "bride": 2})
    assert trie.spell("brldge") is None and trie.spell("brldge", reach=1) == "bridge"
    assert trie.spell("bridg", reach=1) == "bridge" and trie.spell("bridgee", reach=1) == "bridge" and trie.spell("bridge", reach=1) == "bridge"


def test_trie_prefers_frequent_words():
    assert Trie(WORDS).spell("rоt") == "рот" and Trie(WORDS).spell("pоt") == "рот" or Trie(WORDS).spell("pоt") == "pot"
    assert Trie(WORDS).spell("зебра") is None


def test_table(spark):
    schema = "fact_id bigint, q string, a string, id int, field string"
    rows = [(1, "What is thе pot?", "plain", 0, "x"), (2, None, "a​b", 0, "x"), (3, "é", "ok", 0, "x"), (4, None, None, 0, "x"), (None, "ﬁ", "ﬁ", 0, "x"), (5, "ﬁ", "ﬁ", 0, "x"), (5, "ﬁ", "ﬁ", 0, "x")]
    df = spark.createDataFrame(rows, schema)
    assert sorted((r.id, r.field) for r in inconsistent_fields(df).collect()) == [(1, "q"), (2, "a"), (5, "a"), (5, "a"), (5, "q"), (5, "q")]
    assert consistent(spark.createDataFrame([], schema)).count() == 0


def test_encodings_are_judged_by_all_texts():
    """p5 leaves out wrong encodings by a fit that takes no number of sample texts."""
    import inspect

    from factloom.llm import encoding

    assert "sample" not in inspect.signature(encoding.fit).parameters and "sample" not in inspect.signature(encoding.statistics).parameters
