import random
from collections import Counter
from itertools import combinations

from factloom.llm.subjects import Rules, Tree, document_subjects, labels, mine, sentences

DOCS, LABELS, SUBJECTS = "doc_id bigint, text string, subject string, id int", "doc_id bigint, subject string, annotator string", "subject string, title string"
WORDS = {"law": "court judge verdict appeal statute witness jury clause".split(), "music": "violin chord sonata tempo orchestra flute choir encore".split(), "sport": "goal referee sprint league striker trophy relay stadium".split()}


def sentence(rng, subject):
    a, b, c = rng.sample(WORDS[subject], 3)
    return rng.choice([f"The {a} and the {b} changed the {c} in most years.", f"Without a {a}, the old {b} replaces no {c} at all.", f"About 40 of the {a} were kept near the {b} and the {c}."])


def corpus(n, seed):
    rng, docs, truth = random.Random(seed), [], []
    for i in range(n):
        main = rng.sample(sorted(WORDS), rng.choice([1, 1, 2]))
        parts = [sentence(rng, s) for s in main for _ in range(rng.randint(3, 7))]
        passing = rng.choice(sorted(WORDS))
        if passing not in main:
            parts += [sentence(rng, passing)] * rng.randint(0, 2)
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), "x", 0))
        truth += [(i, s) for s in main]
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(600, 1)
    rng = random.Random(2)
    own = [(i, rng.choice([s, s.upper(), f" {s}"]), "ann") for i, s in truth if i < 200] + [(3, None, "ann"), (4, "nonsense", "ann"), (5, "law", "bob")]
    docs += [(1000, None, "x", 0), (1001, "  ", "x", 0), (1002, "Home | Search | About", "x", 0), (None, docs[0][1], "x", 0), (1003, docs[0][1] * 300, "x", 0)]
    subjects = spark.createDataFrame([(s, s.title()) for s in WORDS], SUBJECTS)
    got = {(r.id, r.subject) for r in document_subjects(spark.createDataFrame(docs, DOCS), spark.createDataFrame(own, LABELS), subjects).collect()}
    want = {(i, s) for i, s in truth if i >= 200}
    mine = {x for x in got if 200 <= x[0] < 600}
    assert len(mine & want) >= 0.95 * len(want) and len(mine - want) <= 0.05 * len(want)
    assert not {i for i, _ in got} & {1000, 1001, 1002}


def test_no_labels_and_empty_tables(spark):
    subjects = spark.createDataFrame([(s, s.title()) for s in WORDS], SUBJECTS)
    none = spark.createDataFrame([], LABELS)
    assert document_subjects(spark.createDataFrame(corpus(20, 3)[0], DOCS), none, subjects).count() == 0
    assert document_subjects(spark.createDataFrame([], DOCS), none, subjects).count() == 0
    assert labels(none, subjects).count() == 0


def test_sentences_and_evidence():
    assert sentences(None) == [] and sentences("Too short. (Options: a; b; c; d e f)") == []
    rules = Rules({"court": [("law", 2.0)], "goal": [("sport", 2.0)]}, {"old": [("goal", "music", 9.0)]}, 1.5)
    assert rules.subject(frozenset(["court", "old"])) == "law" and rules.subject(frozenset(["court", "goal"])) is None
    assert rules.subject(frozenset(["old", "goal"])) == "music"


def test_patterns_against_counting():
    rng, rows = random.Random(4), []
    for _ in range(300):
        rows.append((sorted(rng.sample(range(12), rng.randint(1, 6))), rng.choice("ab")))
    tree = Tree()
    for items, s in rows:
        tree.add(items, Counter({s: 1}))
    got = {items: counts for items, counts in tree.patterns(lambda x: True, 5, 2)}
    for k in (1, 2):
        for items in combinations(range(12), k):
            counts = Counter(s for own, s in rows if set(items) <= set(own))
            assert got.get(items, Counter()) == (counts if max(counts.values(), default=0) >= 5 else Counter())


def test_a_sentence_of_many_words_stored_often(spark):
    words = [f"{a}{b}word" for a in "abcdef" for b in "ghijk"]
    learned = [(i, n, words, ["law"]) for i in range(100) for n in range(100)] + [(200 + i, 0, [f"{s}{i % 9}", "plain", "thing"], [s]) for s in ("music", "sport") for i in range(9000)]
    rules = mine(spark.createDataFrame(learned, "id bigint, n int, words array<string>, own array<string>"))
    assert rules.best(frozenset(words))[0] == "law"
