import random

import pytest
from factloom.llm import encoding
from factloom.llm.encoding import Restorer, fit, garbled, undo

SCHEMA = "fact_id bigint, a string, id string, t int"
TEXTS = [
    "Les élèves préfèrent la forêt près de la métairie, malgré l'été très chaud.", "Die Brücke über den Fluß gehört zu den größten der Gegend.", "El señor más anciano recuerda bien la pequeñez de la montaña.",
    "Mieszkańcy często mówią, że ścieżka jest najpiękniejsza wiosną.", "Жители считают, что крепость старше, чем часовня у моста.", "A população cuidou da região até à última reforma.", "この地域ではホテルより工場のほうが古いと言われています。",
    "It says “the old one” — a naïve but common view beside the café.", "NÃO É PERMITIDO atravessar a região sem autorização.", "Plain text about bridges and rivers and so on.",
]


def wrong(text, true, decoder):
    return text.encode(true).decode(decoder)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [f"{rng.choice(TEXTS)} {rng.choice(TEXTS)}" for _ in range(1500)]


@pytest.fixture(scope="module")
def restorer(spark, corpus) -> Restorer:
    return fit(spark.createDataFrame([(i, t, None, 0) for i, t in enumerate(corpus)], SCHEMA), "a")


def test_undo_is_strict():
    assert undo("cafÃ©", "utf-8", "cp1252") == "café"
    assert undo("café", "utf-8", "cp1252") is None and undo("plain", "utf-8", "cp1252") is None


@pytest.mark.parametrize("true,decoder", [("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp850")])
def test_round_trips(restorer, true, decoder):
    for text in TEXTS[:8]:
        assert restorer.restore(wrong(text, true, decoder))[0] == text


def test_legacy_pages_double_and_partial(restorer):
    assert restorer.restore(wrong(TEXTS[4], "koi8-r", "cp1251"))[0] == TEXTS[4]
    assert restorer.restore(wrong(TEXTS[4], "cp1251", "latin-1"))[0] == TEXTS[4]
    twice = wrong(wrong(TEXTS[0], "utf-8", "latin-1"), "utf-8", "latin-1")
    assert restorer.restore(twice)[0] == TEXTS[0]
    assert restorer.restore(TEXTS[1] + " " + wrong(TEXTS[2], "utf-8", "latin-1"))[0] == TEXTS[1] + " " + TEXTS[2]


def test_clean_texts_stay(restorer):
    for text in [*TEXTS, "m² at ±5 °C for £12 or ¥90", "What the paѕtry chefs сall a whisk", "", "ascii"]:
        assert restorer.restore(text) == (text, ())


def test_table(spark, corpus):
    rows = [(i, t, None, 0) for i, t in enumerate(corpus)]
    rows += [(9001, wrong(TEXTS[0], "utf-8", "latin-1"), None, 0), (9001, wrong(TEXTS[0], "utf-8", "latin-1"), None, 0), (9002, "Ka�da ��ka", None, 0), (9003, None, None, 0), (9004, "", None, 0), (None, "cafÃ© Ã  la carte", None, 0), (9005, TEXTS[3] * 800, None, 0)]
    got = [(r.id, r.restored == TEXTS[0], r.lost) for r in garbled(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == [(9001, True, False), (9001, True, False), (9002, False, True)]
    assert garbled(spark.createDataFrame([], SCHEMA)).count() == 0


def test_margins_come_from_all_texts(spark, monkeypatch):
    """More texts than CLEAN: the one that gains most when read is among them whatever its hash; only a share may exceed the margin."""
    texts = [f"{t} {i}" for i in range(30) for t in TEXTS[:9]]
    monkeypatch.setattr(encoding, "DAMAGED", "�")
    model = encoding.Model(encoding.statistics(spark.createDataFrame([(t,) for t in texts], "a string"), "a"))

    class Held:
        value = model

    rows = encoding.pd.concat(encoding.gained(Held)(iter([encoding.pd.DataFrame({"t": texts})])))
    assert rows[rows["kind"] == "n"]["gain"].sum() == len(texts)
    for clean in (20, 90, 1000):
        monkeypatch.setattr(encoding, "CLEAN", clean)
        got = encoding.fit_margins(model, spark.createDataFrame([(t,) for t in texts], "t string"))
        for k in "uds":
            own = sorted(rows[(rows["kind"] == k) & ~rows["garbled"].astype(bool)]["gain"], reverse=True)
            hits = sorted(rows[(rows["kind"] == k) & rows["garbled"].astype(bool)]["gain"])
            worst = own[len(texts) // clean] if len(own) > len(texts) // clean else 0.0
            weak = hits[len(hits) // 50] if hits else encoding.PRIOR[k]
            assert abs(got[k] - min(encoding.PRIOR[k], max(encoding.FLOOR, worst + 0.5 * max(0.0, weak - worst)))) < 1e-9


def test_margins_weigh_every_garbling(spark):
    """Each clean text counts with all its garblings that lead back, each with the gain that reading it gives; none is drawn."""
    texts = TEXTS[:8]
    model = encoding.Model(encoding.statistics(spark.createDataFrame([(t,) for t in texts], "a string"), "a"))

    class Held:
        value = model

    free, ways = Restorer(model, {}), [("utf-8", w) for w in encoding.UTF8_AS] + [*encoding.DOUBLE_BYTE, *encoding.SINGLE_BYTE]
    for text in texts:
        want = []
        for true, decoder in ways:
            try:
                bad = text.encode(true).decode("latin-1").translate(encoding.bytes_as(decoder))
            except UnicodeEncodeError:
                continue
            if bad != text:
                want += [(kind, round(gain, 6)) for gain, kind, chains, make in free.gains(free.read(bad), 0, len(bad), "us") if chains == ((true, decoder),) and make() == text]
        rows = encoding.pd.concat(encoding.gained(Held)(iter([encoding.pd.DataFrame({"t": [text]})])))
        if rows["gain"][rows["kind"] == "n"].sum():
            own = rows[rows["garbled"].astype(bool)]
            assert len(want) > 10 and sorted(want) == sorted(zip(own["kind"], own["gain"].round(6)))
