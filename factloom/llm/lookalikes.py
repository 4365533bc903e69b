"""Visually identical text in different characters: one canonical spelling by a vocabulary trie and a zero-cost edit automaton."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.session import spread

# Letters of Cyrillic and Greek that look like a Latin letter, each above its double.
CYRILLIC = "аеорсухіјѕһԁԛԝҽАВЕКМНОРСТУХІЈЅԌҮ"
CYRILLIC_AS = "aeopcyxijshdqweABEKMHOPCTYXIJSGY"
GREEK = "ονακιρτυχγϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ"
GREEK_AS = "ovakiptuxycjABEZHIKMNOPTYXC"

#: Most words of the vocabulary, by frequency.
VOCABULARY = 100_000
LETTERS = r"A-Za-zªºÀ-ÖØ-öø-ɏɐ-ʯͰ-ϿЀ-ԯḀ-ỿἀ-῿"
IGNORED = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
BLANKS = "               　"
TOKEN = re.compile(f"[{LETTERS}̀-ͯ{IGNORED}]+")
#: Other widths, joined letters and one-character doubles of letters; what looks different (², ½, №) isn't among them.
FORMS = "！-～｡-ￜ￠-￮ﬀ-ﬆﬓ-ﬗĲĳǄ-ǌǱ-ǳℂℊ-ℓℕℙ-ℝℤΩℨK-ℭℯ-ℴℹℼ-ℿⅅ-ⅉ\U0001d400-\U0001d7ff"
SUSPECT = re.compile(f"[{IGNORED}{BLANKS}{FORMS}̀-゙゚ͯ]")
FORM = re.compile(f"[{FORMS}]+")
UNUSUAL = re.compile(f"[{LETTERS}̀-ͯ{IGNORED}{FORMS}]+")
JAPANESE = re.compile("[぀-ヿ㐀-鿿]")
WIDE_SIGNS = re.compile("[！-／：-＠［-｀｛-～]")
FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
PLAIN = re.compile("[A-Za-zÀ-ɏ]")


@lru_cache(1)
def doubles() -> dict[str, str]:
    """Each letter to all letters that look like it, itself among them."""
    groups: dict[str, str] = {}
    for a, b in zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS):
        groups[b] = groups.get(b, b) + a
    out: dict[str, str] = {}
    for group in groups.values():
        for c in group:
            out[c] = "".join(dict.fromkeys(out.get(c, "") + group))
    return out


@lru_cache(1)
def to_script() -> dict[str, dict[str, str]]:
    latin = dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS))
    by = {"L": latin, "C": {}, "G": {}}
    for c, letters, own in (("C", CYRILLIC, CYRILLIC_AS), ("G", GREEK, GREEK_AS)):
        for a, b in zip(letters, own):
            by[c].setdefault(b, a)
    return by


def script(c: str) -> str:
    return "G" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "C" if "Ѐ" <= c <= "ԯ" else "L"


def spelled_out(text: str) -> str:
    """Letters and accents apart, forms of other width, joined letters and one-character doubles as plain letters."""
    return unicodedata.normalize("NFD", FORM.sub(lambda m: unicodedata.normalize("NFKD", m.group()), text))


class Trie:
    """Words, spelled out, as nested dictionaries; under "" stand the words that end there and how often each was met."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for w, n in words.items():
            if SUSPECT.search(w):
                continue
            node = self.root
            for c in unicodedata.normalize("NFD", w):
                node = node.setdefault(c, {})
            node.setdefault("", []).append((n, w))

    def spell(self, token: str, scripts: str = "LCG", reach: int = 0) -> str | None:
        """The word of the given scripts that a weighted edit automaton reaches from token at the least cost up to `reach`, the
        most frequent of them. Look-alike letters cost nothing, nor do characters without width, accents apart from their
        letter, other widths and joined letters; any other letter changed, missing or added costs 1."""
        alike = doubles()
        states = self.skip({id(self.root): (0, self.root)}, reach)
        for c in spelled_out(token):
            if c in IGNORED:
                continue
            after: dict[int, tuple[int, dict]] = {}
            own = alike.get(c, c)
            for cost, node in states.values():
                for x in own if cost == reach else node:
                    if x and x in node:
                        self.enter(after, node[x], cost + (x not in own), reach)
                self.enter(after, node, cost + 1, reach)
            states = self.skip(after, reach)
            if not states:
                return None
        ends = [(-cost, n, w) for cost, node in states.values() for n, w in node.get("", ()) if {script(c) for c in w if c.isalpha()} <= set(scripts)]
        return max(ends)[2] if ends else None

    @staticmethod
    def enter(states: dict[int, tuple[int, dict]], node: dict, cost: int, reach: int) -> None:
        if cost <= reach and cost < states.get(id(node), (reach + 1, node))[0]:
            states[id(node)] = (cost, node)

    def skip(self, states: dict[int, tuple[int, dict]], reach: int) -> dict[int, tuple[int, dict]]:
        """states, and those reached by letters that the token lacks."""
        open_ = [s for s in states.values() if s[0] < reach]
        while open_:
            cost, node = open_.pop()
            for x, below in node.items():
                if x and cost + 1 <= reach and cost + 1 < states.get(id(below), (reach + 1, below))[0]:
                    states[id(below)] = (cost + 1, below)
                    open_.append((cost + 1, below))
        return states


class Canonical:
    def __init__(self, words: dict[str, int]):
        self.trie = Trie(words)

    def __call__(self, text: str | None) -> str | None:
        """The consistent form of text; null and texts without unusual characters come back as they are.

        Words with unusual characters take the spelling that the automaton finds in the vocabulary; what it doesn't find, and
        what is no word, is put right by table.
        """
        if not text or text.isascii():
            return text
        mixed = FOREIGN.search(text) and PLAIN.search(text)
        if not mixed and not SUSPECT.search(text):
            return text
        keep = JAPANESE.search(text)
        out = text if keep or not self.trie.root else UNUSUAL.sub(lambda m: self.known(m.group()), text)
        out = FORM.sub(lambda m: "".join(c if keep and WIDE_SIGNS.match(c) else unicodedata.normalize("NFKC", c) for c in m.group()) if len(m.group()) == 1 or keep else unicodedata.normalize("NFKC", m.group()), out)
        out = re.sub("[｡-ﾟ]+", lambda m: unicodedata.normalize("NFKC", m.group()), out)
        out = re.sub(f"[{BLANKS}]", " ", unicodedata.normalize("NFC", out))
        if any(c in IGNORED for c in out):
            out = "".join(c for i, c in enumerate(out) if c not in IGNORED or self.joins_signs(out, i))
            out = unicodedata.normalize("NFC", out)
        if FOREIGN.search(out) and PLAIN.search(out):
            out = self.words(out)
        return out

    def known(self, token: str) -> str:
        """The vocabulary's spelling of a token with unusual characters of one script; the token itself if it has none."""
        if not SUSPECT.search(token):
            return token
        scripts = {script(c) for c in spelled_out(token) if c.isalpha()}
        return (self.trie.spell(token, next(iter(scripts))) or token) if len(scripts) == 1 else token

    @staticmethod
    def joins_signs(text: str, i: int) -> bool:
        """Whether the character at i joins two signs to one, as in emoji of several people."""
        return text[i] == "‍" and 0 < i < len(text) - 1 and unicodedata.category(text[i - 1]) in ("So", "Sk", "Mn") and unicodedata.category(text[i + 1]) == "So"

    def words(self, text: str) -> str:
        found = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
        sure = [self.own_script(w) for _, _, w in found]
        whole = Counter(s for s in sure if s in "LCG").most_common(1)
        out, last = [], 0
        for i, (start, end, w) in enumerate(found):
            kinds = {script(c) for c in w if c.isalpha()}
            if kinds <= {"L"} and not (whole and whole[0][0] == "C"):
                continue
            near = Counter(s for s in sure[max(0, i - 2) : i] + sure[i + 1 : i + 3] if s in "LCG").most_common(1) or whole
            new = self.respell(w, kinds, sure[i], near[0][0] if near else "L")
            if new != w:
                out += [text[last:start], new]
                last = end
        return "".join([*out, text[last:]])

    @staticmethod
    def own_script(word: str) -> str:
        """L, C or G where a letter without a double of another script tells; ? where none does, ! where two scripts do."""
        alike = doubles()
        sure = {script(c) for c in word if c.isalpha() and c not in alike}
        return "?" if not sure else sure.pop() if len(sure) == 1 else "!"

    def respell(self, word: str, kinds: set[str], sure: str, near: str) -> str:
        if sure == "!" or (len(kinds) == 1 and sure in kinds):
            return word
        into = near if sure == "?" else sure
        if len(kinds) == 1 and into in kinds:
            return word
        best = self.trie.spell(word, into)
        if best is not None:
            return best
        if len(kinds) == 1 and into != "L":  # a whole Latin word among others needs the vocabulary
            return word
        table = to_script()["L"]
        latin = "".join(table.get(c, c) for c in word)
        if into == "L":
            return latin if all(script(c) == "L" for c in latin if c.isalpha()) else word
        back = to_script()[into]
        new = "".join(c if script(c) == into else back.get(table.get(c, c), c) for c in word)
        return new if all(script(c) == into for c in new if c.isalpha()) else word


def vocabulary(df: DataFrame, cols: list[str], most: int = VOCABULARY) -> dict[str, int]:
    """The `most` frequent words of one script, over all rows and columns; words met once are no vocabulary."""
    words = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]+"), 0) for c in cols]))
    one = r"^(\p{IsLatin}+|\p{IsCyrillic}+|\p{IsGreek}+)$"
    rows = spread(df.select(*cols)).select(F.explode(words).alias("w")).groupBy("w").count().filter((F.col("count") > 1) & F.col("w").rlike(one)).orderBy(F.desc("count"), "w").limit(most).collect()
    return {r["w"]: r["count"] for r in rows}


def respelled(blob) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canonical = Canonical(blob.value)
        for pdf in batches:
            for c in pdf.columns[1:]:
                pdf[f"{c}_canonical"] = pdf[c].map(canonical)
            yield pdf

    return run


def consistent(df: DataFrame, id_col: str = "fact_id", cols: tuple[str, ...] = ("q", "a")) -> DataFrame:
    """(id, *cols, *cols_canonical): each column with its consistent form, for rows where one reaches beyond ASCII.

    Rows left out are consistent already (pure ASCII, null or empty in all cols) or have no id.
    """
    blob = df.sparkSession.sparkContext.broadcast(vocabulary(df, list(cols)))
    high = F.lit(False)
    for c in cols:
        high = high | F.coalesce(F.col(c).rlike(r"[^\x00-\x7F]"), F.lit(False))
    some = df.filter(high & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *cols)
    schema = "id bigint, " + ", ".join(f"{c} string" for c in cols) + ", " + ", ".join(f"{c}_canonical string" for c in cols)
    return spread(some, "id").mapInPandas(respelled(blob), schema)


def inconsistent_fields(df: DataFrame, id_col: str = "fact_id", cols: tuple[str, ...] = ("q", "a")) -> DataFrame:
    """(id, field): the fields with at least one character that must change."""
    fields = F.filter(F.array(*[F.when(F.col(c) != F.col(f"{c}_canonical"), F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    return consistent(df, id_col, cols).select("id", F.explode(fields).alias("field"))
