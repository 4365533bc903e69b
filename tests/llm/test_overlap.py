import random

from factloom.llm.overlap import cross_split, overlap_pairs, read_record, say_the_same, slip

SCHEMA = "item_id bigint, split string, source string, q string, a string, rep int"


def test_slips():
    assert slip("many", "maany") and slip("that", "tat") and slip("does", "dose") and slip("fortress", "forrtes")
    assert not slip("pear", "boat") and not slip("to", "on")


def test_names_and_numbers_must_agree():
    plain = lambda w: w not in {"hope"}
    read = lambda q, a: read_record((q, a))
    base = read("How long is the Kobenar bridge?", "The Kobenar bridge is 746 meters long.")
    assert say_the_same(base, read("how LONG is the Kobenar brigde", "The Kobenar bridge is 746 meters long"), plain)
    assert not say_the_same(base, read("How long is the Kobenar bridge?", "The Kobenar bridge is 747 meters long."), plain)
    assert not say_the_same(base, read("How long is the Tasimul bridge?", "The Tasimul bridge is 746 meters long."), plain)
    assert not say_the_same(read(None, None), read("", None), plain)


def test_pairs_against_brute_force(spark):
    rng, rows = random.Random(5), []
    nouns = "bridge tower river market harbor garden school mill".split()
    for i in range(400):
        name = "".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3)).title()
        n = rng.randrange(100, 999)
        rows.append([i, rng.choice(["train", "train", "dev"]), rng.choice(["fact", "turn"]), f"How long is the {name} {rng.choice(nouns)}?", f"It is {n} meters long and stands in {name} since {n + 1000}.", 0])
    for i in range(400, 480):
        j = rng.randrange(400)
        q, a = rows[j][3], rows[j][4]
        a = rng.choice([a, a.upper(), a.replace("meters", "metres"), "Quick one: " + a, a.replace(" and stands", " stands")])
        rows.append([i, rng.choice(["train", "dev", "ood"]), rows[j][2], q, a, 0])
    rows += [[900, "dev", "fact", None, None, 0], [901, "train", "fact", None, "", 0], [902, None, "fact", "x", "y", 0], [903, "dev", None, "x", "y", 0]]
    records = {r[0]: read_record((r[3], r[4])) for r in rows}
    want = {
        (min(t[0], e[0]), max(t[0], e[0])) for t in rows for e in rows
        if t[1] == "train" and e[1] not in (None, "train") and t[2] == e[2] and t[2] and say_the_same(records[t[0]], records[e[0]], lambda w: True)
    }
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.id_a, r.id_b) for r in overlap_pairs(df).collect()} == want
    assert {(r.train_id, r.eval_id) for r in cross_split(df, shard_records=20).collect()} == {(r.train_id, r.eval_id) for r in cross_split(df).collect()}


def test_hot_copies_and_empty(spark):
    rows = [(i, "train" if i % 2 else "dev", "fact", "What is Bolimur?", "Bolimur is a large town near Kalotan.", 0) for i in range(60)]
    assert overlap_pairs(spark.createDataFrame(rows, SCHEMA)).count() == 900
    assert overlap_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_templated_text_against_comparing_all(spark):
    """Records over few words, where every word is frequent; the truth is counted here, not by the operator's comparison."""
    rng = random.Random(8)
    vocab = "bolar denit fosul gamer halim jurok kesad lomin mirat nodul pasor ralit sudan tomer varil wesok yamut zorin".split()
    held = ["We saw " + " ".join(rng.choice(vocab) for _ in range(10)) for _ in range(300)]
    train = []
    for i in range(60):
        words = held[rng.randrange(300)].split()
        words[2 + rng.randrange(10)] = rng.choice(held[rng.randrange(300)].split()[2:])
        train.append(" ".join(words))
    want = set()
    for i, t in enumerate(train):
        for j, h in enumerate(held):
            a, b = t.split(), h.split()
            both = sum(min(a.count(w), b.count(w)) for w in set(a))
            if both >= 0.7 * len(a):
                want.add((1000 + i, j))
    rows = [(j, "dev", "fact", "", h, 0) for j, h in enumerate(held)] + [(1000 + i, "train", "fact", "", t, 0) for i, t in enumerate(train)]
    got = {(r.train_id, r.eval_id) for r in cross_split(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert want and got == want


def test_candidates_by_name_or_by_containment():
    """Of records that share only ordinary words with a named one few are looked at, and none is lost that holds its names or lies in it."""
    import numpy as np

    from factloom.llm import overlap

    rng = random.Random(5)
    common = "the old bridge near river was built by people who lived there when water rose again each spring".split()
    fields = []
    for i in range(600):
        name, words = "Na" + "".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3)), rng.sample(common, 9)
        extra = rng.choice(["", f" in {rng.randint(1, 40)}", f" with Na{rng.choice('bdfg')}a"])
        fields += [(f"Where is {name}", " ".join(words) + extra), (f"Where is {name}", " ".join(words[:8]) + extra), ("where", " ".join(words[:9]))]
    index = overlap.Index(np.arange(len(fields)), fields)
    records = [overlap.read_record(f) for f in fields]
    looked, seen = 0, overlap.say_the_same
    same = {(q, d) for q in range(0, len(fields), 37) for d in range(len(fields)) if seen(records[q], records[d], index.common.__contains__)}
    got = set()
    for q in range(0, len(fields), 37):
        for _, found in index.candidates([records[q]]):
            got |= {(q, d) for d in found.tolist() if seen(records[q], records[d], index.common.__contains__)}
        probes, either = index.probes(records[q], sorted(overlap.digits(records[q].words)))
        looked += bool(records[q].names) and either
    assert {(q, d) for q, d in same if records[q].names} <= got and looked > 5
