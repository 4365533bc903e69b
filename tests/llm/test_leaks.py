import random

from factloom.llm.leaks import LEAST, Index, contained_passages, tokens

DOCS, PASSAGES = "doc_id bigint, text string, id int, passage_id int", "passage_id bigint, text string, suite string, id int"


def passages(n, seed=1):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bdfgklmnrst") + rng.choice("aeiou") for _ in range(4)).title()
    vocab = [name().lower() for _ in range(300)]
    return [" ".join(f"Of the {rng.randrange(100, 999)} {' '.join(rng.choice(vocab) for _ in range(6))} counted near {name()}, only the {rng.choice(vocab)} ones were {rng.choice(vocab)} by {name()}." for _ in range(3)) for _ in range(n)]


def filler(rng):
    return " ".join(rng.choice("the a river runs by old mills and towers of grey stone while rain falls on quiet fields".split()) for _ in range(rng.randint(5, 60))) + "."


def damaged(words, rng, share):
    out = list(words)
    for i in range(0, len(out)):
        if rng.random() < share:
            out[i] = rng.choice(["modest", out[i][:1] + out[i][2:] if len(out[i]) > 3 else "x"])
    return out


def test_recall_against_planted(spark):
    rng, texts = random.Random(7), passages(60)
    docs, want = [], set()
    for i in range(400):
        p = rng.randrange(60)
        words = texts[p].split()
        start, n = rng.randrange(0, len(words) - 24), rng.randint(20, 24)
        part = damaged(words[start : start + n], rng, 0.08)
        kind = i % 4
        if kind == 0:
            docs.append((i, f"{filler(rng)} {' '.join(part)} {filler(rng)}", 0, 0))
            want.add((i, p))
        elif kind == 1:
            docs.append((i, filler(rng).join(s + ". " for s in texts[p].upper().split(". ")), 0, 0))
            want.add((i, p))
        elif kind == 2:
            docs.append((i, f"{filler(rng)} {' '.join(words[:9])} {filler(rng)}", 0, 0))
        else:
            docs.append((i, filler(rng), 0, 0))
    got = {(r.id, r.passage_id) for r in contained_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts)], PASSAGES)).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_edges(spark):
    text = passages(1, 3)[0]
    ps = spark.createDataFrame([(1, text, "s", 0), (2, text, "s", 0), (3, None, "s", 0), (4, "", "s", 0)], PASSAGES)
    docs = spark.createDataFrame([(1, text, 0, 0), (1, text, 0, 0), (2, None, 0, 0), (3, "", 0, 0), (None, text, 0, 0), (4, "word " * 30_000 + text, 0, 0)], DOCS)
    got = sorted((r.id, r.passage_id) for r in contained_passages(docs, ps).collect())
    assert got == [(1, 1), (1, 1), (1, 2), (1, 2), (4, 1), (4, 2)]
    none = spark.createDataFrame([], PASSAGES)
    assert contained_passages(docs, none).count() == 0
    assert contained_passages(spark.createDataFrame([], DOCS), ps).count() == 0


def test_just_enough_words():
    text = passages(1, 5)[0]
    ix, words = Index([(1, text)]), tokens(text)
    assert ix.found([words[3 : 3 + LEAST]]) == [(0, 0)] and ix.found([words[3 : 3 + LEAST - 4]]) == []


def test_stretches_of_common_words():
    rng = random.Random(3)
    vocab = [f"w{i}x" for i in range(80)]
    common = [[rng.choice(vocab) for _ in range(44)] for _ in range(300)]
    ix = Index([(i, " ".join(ws + [f"only{i}"])) for i, ws in enumerate(common)])
    docs, want = [], set()
    for d in range(200):
        p = rng.randrange(300)
        part = common[p][4 : 4 + LEAST + 4]
        for i in rng.sample(range(len(part)), 2):
            part[i] = "zzz"
        docs.append(["aaa"] * 5 + part + ["bbb"] * 5)
        want.add((d, p))
    got = set(ix.found(docs))
    assert got <= want and len(got) >= 0.9 * len(want)
