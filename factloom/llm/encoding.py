"""Text decoded with the wrong character encoding: candidates by undoing encode-decode chains, judged by character n-grams."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.lookalikes import Canonical
from factloom.plans.session import cut, spread

#: Wrong decoders of UTF-8 bytes, and (true, wrong) pairs of other encodings.
UTF8_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8-r", "iso8859-2", "iso8859-15", "cp1254", "cp1257")
#: Of these, the ones under which ordinary words are no valid UTF-8.
TELLING = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman")
DOUBLE_BYTE = (("cp932", "cp1252"), ("euc_jp", "cp1252"), ("cp932", "cp437"), ("euc_jp", "cp437"), ("cp932", "mac_roman"))
SINGLE_BYTE = (
    ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "mac_roman"),
    ("mac_roman", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1250", "cp437"), ("cp1251", "mac_roman"), ("cp852", "cp1252"), ("cp1252", "cp852"),
)
#: Longest chain of wrong decodings that is undone; n-grams kept by the model; of so many clean texts one may gain more than the least margin.
DEPTH, NGRAMS, CLEAN, FLOOR = 3, 300_000, 4000, 4.0
HIGH = re.compile(r"[^\x00-\x7f]+")
LATIN_HIGH = re.compile("[\x80-\xff]")
#: Characters that no code page of one or two bytes shows as a sign of a byte.
OTHER = re.compile("[Ѐ-ӿ\u3000-\uffef]")
BLANK = re.compile(r"[ \t\n]+")
SENTENCE = re.compile(r"(?<=[.!?。！？\n])\s*")
#: What keeps a text out of training: replacement characters, control codes of Latin-1, box drawing, a sign between letters,
#: a capital after a small letter.
DAMAGED = r"[�\u0080-\u009F─-▟]|\p{L}[\p{S}\p{No}§¶¿¡«»…†‡•‰‹›„‚]\p{L}|\p{Ll}\p{Lu}"
#: Until the margins are fitted, a gain above this (in nats) marks a text as garbled.
PRIOR = {"u": 12.0, "d": 25.0, "s": 15.0}


@lru_cache(1)
def tables() -> dict[str, dict[int, str]]:
    """For str.translate: each character to the Latin-1 character of its byte. Bytes a code page leaves open stand for themselves."""
    out = {}
    for enc in {w for w in UTF8_AS} | {w for _, w in DOUBLE_BYTE + SINGLE_BYTE}:
        t = {}
        for b in range(256):
            try:
                c = bytes([b]).decode(enc)
            except UnicodeDecodeError:
                c = chr(b)
            t.setdefault(ord(c), chr(b))
        out[enc] = t
    return out


def undo(text: str, true: str, wrong: str) -> str | None:
    """The text whose bytes in `true`, read as `wrong`, give text; None if there is none or it is the same."""
    raw = text.translate(tables()[wrong])
    try:
        out = raw.encode("latin-1").decode(true)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None
    # A character without a place in `wrong` may have fallen on a free Latin-1 code: only a chain that leads back counts.
    table = tables()[wrong]
    return out if out != text and all(ord(c) in table for c in set(text)) else None


@lru_cache(1)
def recodings() -> list[dict[str, str]]:
    """For each pair of code pages of single bytes: each character of `wrong` beyond ASCII to that of its byte in `true`."""
    out = []
    for true, wrong in SINGLE_BYTE:
        m = {}
        for c, byte in tables()[wrong].items():
            if c > 127:
                try:
                    m[chr(c)] = byte.encode("latin-1").decode(true)
                except UnicodeDecodeError:
                    continue
        out.append(m)
    return out


class Model:
    """Character trigrams with Dirichlet smoothing towards bigrams and single characters."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total = sum(n for g, n in counts.items() if len(g) == 1) + 1
        self.context: dict[str, int] = {}
        for g, n in counts.items():
            if len(g) > 1:
                self.context[g[:-1]] = self.context.get(g[:-1], 0) + n
        self.cache: dict[str, float] = {}
        self.logs: dict[str, float] = {}
        self.singles: dict[str, float] = {}

    def single(self, c: str) -> float:
        p = self.singles.get(c)
        if p is None:
            p = self.singles[c] = math.log(self.one(c))
        return p

    def one(self, gram: str) -> float:
        p = self.cache.get(gram)
        if p is None:
            if len(gram) == 1:
                p = (self.counts.get(gram, 0) + 0.1) / (self.total + 1e4)
            else:
                p = (self.counts.get(gram, 0) + 4 * self.one(gram[1:])) / (self.context.get(gram[:-1], 0) + 4)
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[gram] = p
        return p

    def score(self, text: str) -> float:
        logs = self.logs
        return sum([logs[g] if g in logs else self.log(g) for g in [text[:1], *[text[max(0, i - 2) : i + 1] for i in range(1, len(text))]]]) if text else 0

    def log(self, gram: str) -> float:
        if len(self.logs) > 500_000:
            self.logs.clear()
        p = self.logs[gram] = math.log(self.one(gram))
        return p


FOLD = Canonical({})
Chains = tuple[tuple[str, str], ...]
IMPOSSIBLE = -1e6


@dataclass
class Reading:
    """A text, its runs beyond ASCII with their options, and running sums over them of code pages' gains."""

    text: str
    starts: list[int]
    ends: list[int]
    options: list[Options]
    gain: np.ndarray
    single: np.ndarray


class Options:
    """What can be undone in one run of characters beyond ASCII: by chain of UTF-8 (gain, text), by pair of code pages arrays of
    gains and of changes in single characters, and texts. IMPOSSIBLE where a pair cannot have given the run."""

    __slots__ = ("utf8", "gain", "single", "text")

    def __init__(self, model: Model, left: str, run: str, right: str):
        base = model.score(left + run + right)
        self.utf8: dict[Chains, tuple[float, str]] = {}
        front: list[tuple[str, Chains]] = [(run, ())] if len(run) > 1 else []  # no single byte beyond ASCII is UTF-8
        for _ in range(DEPTH):
            after = []
            for text, chains in front:
                for wrong in UTF8_AS:
                    out = undo(text, "utf-8", wrong)
                    if out is not None:
                        step = (*chains, ("utf-8", wrong))
                        after.append((out, step))
                        self.utf8[step] = (model.score(left + out + right) - base, out)
            front = after
        self.text: list[str] = []
        self.gain, self.single = np.full(len(SINGLE_BYTE), IMPOSSIBLE), np.zeros(len(SINGLE_BYTE))
        old = sum(map(model.single, run))
        for k, table in enumerate(recodings()):
            letters = [table.get(c) for c in run]
            if None in letters:
                self.text.append(run)
                continue
            out = "".join(letters)
            self.text.append(out)
            self.single[k] = sum(map(model.single, out)) - old
            self.gain[k] = model.score(left + out + right) - base if out != run else 0.0


class Garblings:
    """What undoing each way to garble one run gains: by wrong decoder of UTF-8, and by pair of code pages with changes in single
    characters and the garbled run. nan where a way doesn't lead back."""

    __slots__ = ("utf8", "gain", "single", "text")

    def __init__(self, model: Model, left: str, run: str, right: str):
        base, old = model.score(left + run + right), sum(map(model.single, run))
        self.utf8, self.gain, self.single = (np.full(n, np.nan) for n in (len(UTF8_AS), len(SINGLE_BYTE), len(SINGLE_BYTE)))
        scores: dict[str, float] = {}  # many ways give the same characters

        def gain(bad: str) -> float:
            if bad not in scores:
                scores[bad] = base - model.score(left + bad + right)
            return scores[bad]

        raw = {true: as_bytes(run, true) for true in ("utf-8", *dict(SINGLE_BYTE))}
        for k, wrong in enumerate(UTF8_AS):
            bad = raw["utf-8"].translate(bytes_as(wrong))
            if undo(bad, "utf-8", wrong) == run:
                self.utf8[k] = gain(bad)
        self.text: list[str] = []
        for k, ((true, wrong), table) in enumerate(zip(SINGLE_BYTE, recodings())):
            bad = raw[true].translate(bytes_as(wrong)) if raw[true] else ""
            self.text.append(bad)
            if bad and "".join([table.get(c, "") for c in bad]) == run:
                self.single[k] = old - sum(map(model.single, bad))
                self.gain[k] = gain(bad) if bad != run else 0.0


class Restorer:
    def __init__(self, model: Model, margins: dict[str, float]):
        self.model, self.margins = model, margins
        self.memo: dict[tuple[str, str, str], Options] = {}
        self.ways: dict[tuple[str, str, str], Garblings] = {}

    def __getstate__(self) -> dict:
        return {"model": self.model, "margins": self.margins, "memo": {}, "ways": {}}

    def options(self, left: str, run: str, right: str) -> Options:
        key = (left, run, right)
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            found = self.memo[key] = Options(self.model, left, run, right)
        return found

    def read(self, text: str) -> Reading:
        """The runs of text beyond ASCII, each with its options between the ASCII beside it."""
        spans, options = [m.span() for m in HIGH.finditer(text)], []
        for k, (s, e) in enumerate(spans):
            left = text[max(spans[k - 1][1] if k else 0, s - 2) : s]
            right = text[e : min(spans[k + 1][0] if k + 1 < len(spans) else len(text), e + 2)]
            options.append(self.options(left, text[s:e], right))
        # Gains of code pages add up over runs: any piece's are a difference of two sums.
        gain = np.cumsum([np.zeros(len(SINGLE_BYTE)), *(o.gain for o in options)], 0)
        single = np.cumsum([np.zeros(len(SINGLE_BYTE)), *(o.single for o in options)], 0)
        return Reading(text, [s for s, _ in spans], [e for _, e in spans], options, gain, single)

    def gains(self, r: Reading, start: int, end: int, kinds: str) -> Iterator[tuple[float, str, Chains, Callable[[], str]]]:
        """(gain in log-likelihood, kind, chains, text) of every way to undo chains on a piece of the text that was read."""
        lo, hi = bisect_left(r.starts, start), bisect_left(r.starts, end)
        if lo == hi:
            return
        piece = r.text[start:end]

        def put(texts: list[str]) -> str:
            out, at = [], start
            for k, t in zip(range(lo, hi), texts):
                out += [r.text[at : r.starts[k]], t]
                at = r.ends[k]
            return "".join([*out, r.text[at:end]])

        if "u" in kinds:
            own = [o.utf8 for o in r.options[lo:hi]]
            for chains in own[0]:
                if all(chains in o for o in own):
                    yield sum(o[chains][0] for o in own), "u", chains, lambda chains=chains: put([o[chains][1] for o in own])
        if "s" not in kinds:
            return
        gain = r.gain[hi] - r.gain[lo]
        some = np.flatnonzero((gain > 0) & (r.single[hi] - r.single[lo] >= -3))
        dense = 3 * sum(r.ends[k] - r.starts[k] for k in range(lo, hi)) >= end - start and not OTHER.search(piece)
        if not len(some) and not dense:
            return
        # Beside the text as it stands, legacy code pages compete with swapped look-alike letters.
        folded, lead = FOLD(piece), 0.0
        base = self.model.score(piece)
        if folded != piece:
            lead = max(0.0, self.model.score(folded) - base)
        for k in some:
            yield float(gain[k]) - lead, "s", (SINGLE_BYTE[k],), lambda k=k: put([o.text[k] for o in r.options[lo:hi]])
        if dense:
            for true, wrong in DOUBLE_BYTE:
                out = undo(piece, true, wrong)
                if out is not None:
                    yield self.model.score(out) - base - lead, "d", ((true, wrong),), lambda out=out: out

    def restore(self, text: str) -> tuple[str, Chains]:
        """The likeliest text and the chains undone: over the whole text, else by sentences, words and runs beyond ASCII."""
        if text.isascii():
            return text, ()
        return self.parts(self.read(text), 0, len(text), 0)[:2]

    def gains_back(self, r: Reading) -> Iterator[tuple[str, float]]:
        """(kind, gain), as in gains, of undoing each way to garble the whole text that was read, where that gives the text again."""
        text, own = r.text, []
        for k, (s, e) in enumerate(zip(r.starts, r.ends)):
            key = (text[max(r.ends[k - 1] if k else 0, s - 2) : s], text[s:e], text[e : min(r.starts[k + 1] if k + 1 < len(r.starts) else len(text), e + 2)])
            found = self.ways.get(key)
            if found is None:
                if len(self.ways) > 20_000:
                    self.ways.clear()
                found = self.ways[key] = Garblings(self.model, *key)
            own.append(found)
        for gain in sum(o.utf8 for o in own).tolist():
            if gain == gain:
                yield "u", gain

        def lead(bad: str) -> float:
            folded = FOLD(bad)
            return max(0.0, self.model.score(folded) - self.model.score(bad)) if folded != bad else 0.0

        gain = sum(o.gain for o in own)
        for k in np.flatnonzero((gain > 0) & (sum(o.single for o in own) >= -3)):
            out, at = [], 0
            for s, e, o in zip(r.starts, r.ends, own):
                out += [text[at:s], o.text[k]]
                at = e
            yield "s", float(gain[k]) - lead("".join([*out, text[at:]]))
        raw = {true: as_bytes(text, true) for true in dict(DOUBLE_BYTE)}
        for true, wrong in DOUBLE_BYTE:
            if raw[true] is None or 3 * len(LATIN_HIGH.findall(raw[true])) < len(raw[true]):
                continue
            bad = raw[true].translate(bytes_as(wrong))
            if not OTHER.search(bad) and undo(bad, true, wrong) == text:
                yield "d", self.model.score(text) - self.model.score(bad) - lead(bad)

    def parts(self, r: Reading, start: int, end: int, level: int) -> tuple[str, Chains, float]:
        """The likeliest text of a piece, the chains undone, and the gain. What its parts gain together counts against what the
        piece gains as a whole where the whole is no UTF-8, by more than a margin."""
        lo, hi = bisect_left(r.starts, start), bisect_left(r.starts, end)
        if lo == hi:
            return r.text[start:end], (), 0.0
        top: tuple[float, Callable[[], str], Chains, str] | None = None
        for gain, kind, chains, make in self.gains(r, start, end, ("us", "us", "s", "u")[level]):
            if gain > self.margins[kind] and (top is None or gain > top[0] + 1e-9):
                top = (gain, make, chains, kind)
        whole = (top[1](), top[2], top[0]) if top else (r.text[start:end], (), 0.0)
        if level == 3 or top and (top[3] == "u" or not any(o.utf8 for o in r.options[lo:hi])) or not top and not self.hope(r, lo, hi):
            return whole
        if level == 0:
            cuts = [m.end() for m in SENTENCE.finditer(r.text)]
        elif level == 1:
            cuts = [m.end() for m in BLANK.finditer(r.text, start, end)]
        else:
            cuts = [x for k in range(lo, hi) for x in (r.starts[k], r.ends[k])]
        bounds = sorted({start, end, *cuts})
        out, chains, total = [], (), 0.0
        for s, e in zip(bounds, bounds[1:]):
            new, how, gain = self.parts(r, s, e, level + 1)
            out.append(new)
            chains = chains or how
            total += gain
        return ("".join(out), chains, total) if not top or total > top[0] + PRIOR["u"] else whole

    def hope(self, r: Reading, lo: int, hi: int) -> bool:
        """Whether some run could gain a margin in a smaller piece: gains of a piece are those of its runs, the positive ones at best."""
        own = r.options[lo:hi]
        if any(o.utf8 for o in own) or 3 * sum(r.ends[k] - r.starts[k] for k in range(lo, hi)) >= r.ends[hi - 1] - r.starts[lo]:
            return True
        return bool((np.maximum(r.gain[lo + 1 : hi + 1] - r.gain[lo:hi], 0).sum(0) > self.margins["s"]).any())


@lru_cache(200_000)
def wrong_run(run: str) -> bool:
    return any(undo(run, "utf-8", w) is not None for w in TELLING)


def decodable(text: str) -> bool:
    """Whether a run beyond ASCII in text are bytes of UTF-8 under some wrong decoder; hardly any clean text has one."""
    return any(wrong_run(run) for run in HIGH.findall(text))


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over clean texts: (g, n) for each character trigram, packed to a number."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for pdf in batches:
        texts = [t for t, high in zip(pdf["t"], pdf["high"]) if not high or not decodable(t)]
        if not texts:
            continue
        codes = np.frombuffer(("\0\0" + "\0\0".join(texts)).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        grams = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
        new, n = np.unique(grams[codes[2:] > 0], return_counts=True)
        keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
    yield pd.DataFrame({"g": keys, "n": counts})


def undamaged(df: DataFrame, text: str) -> DataFrame:
    """(t, high) of texts without a sign of damage; high says that one reaches beyond ASCII."""
    t = df.select(F.col(text).alias("t")).filter("t <> ''").withColumn("high", F.col("t").rlike(r"[^\x00-\x7F]"))
    return t.filter(~(F.col("high") & F.col("t").rlike(DAMAGED)))


def statistics(df: DataFrame, text: str, ngrams: int = NGRAMS) -> dict[str, int]:
    """Counts of all characters and of the `ngrams` most frequent pairs and trigrams of them in all clean texts."""
    seen = cut(spread(undamaged(df, text)).mapInPandas(counted, "g bigint, n bigint"))
    counts: dict[str, int] = {}
    for bits in (21, 42, 63):
        by = seen.groupBy(F.col("g").bitwiseAND(F.lit((1 << bits) - 1)).alias("g")).agg(F.sum("n").alias("n"))
        for r in by.orderBy(F.desc("n"), "g").limit(ngrams).collect():
            codes = [r["g"] >> shift & 0x1FFFFF for shift in range(bits - 21, -1, -21)]
            if all(codes):
                counts["".join(map(chr, codes))] = r["n"]
    return counts


@lru_cache
def bytes_as(wrong: str) -> dict[int, int]:
    """For str.translate: each byte's Latin-1 character to the character that `wrong` shows."""
    return {ord(v): k for k, v in tables()[wrong].items()}


def as_bytes(text: str, true: str) -> str | None:
    """The bytes of text in `true` as Latin-1 characters; None if it has none."""
    try:
        return text.encode(true).decode("latin-1")
    except UnicodeEncodeError:
        return None


def gained(blob) -> Callable:
    """Over clean texts: (kind, garbled, gain) of each one's best gain by kind, of what each garbling of it gains when undone, and as
    kind n the number of texts. Those that PRIOR already tells as garbled are set aside."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = Restorer(blob.value, dict.fromkeys("uds", -math.inf))
        for pdf in batches:
            rows, n = [], 0
            for text in pdf["t"]:
                if decodable(text):
                    continue
                r, best = free.read(text), {}
                for p in ((0, len(text), "us"), *((s, e, "u") for s, e in zip(r.starts, r.ends))):
                    for gain, kind, _, _ in free.gains(r, *p):
                        best[kind] = max(best.get(kind, 0.0), gain)
                if any(gain > PRIOR[kind] for kind, gain in best.items()):
                    continue
                n += 1
                rows += [(kind, False, gain) for kind, gain in best.items() if gain > 0]
                rows += [(kind, True, gain) for kind, gain in free.gains_back(r)]
            yield pd.DataFrame([*rows, ("n", False, float(n))], columns=["kind", "garbled", "gain"])

    return run


def fit_margins(model: Model, texts: DataFrame) -> dict[str, float]:
    """By kind of chain, a margin between the gains of clean texts (t) and of the same texts, each garbled here in every way.

    The least margin is the gain that one in CLEAN of all clean texts exceeds, with fewer texts the best gain; from there the
    margin goes half the way to the gain that all but one in fifty garbled texts reach. From twice PRIOR on that gain makes the
    margin PRIOR, whatever it is; so larger gains count as this one, and equal gains take one row.
    """
    blob = texts.sparkSession.sparkContext.broadcast(model)
    gains = spread(texts).mapInPandas(gained(blob), "kind string, garbled boolean, gain double")
    most = F.coalesce(*(F.when(F.col("garbled") & (F.col("kind") == k), F.lit(2 * v)) for k, v in PRIOR.items()), F.lit(math.inf))
    seen = cut(gains.groupBy("kind", "garbled", F.least("gain", most).alias("gain")).count())
    n = int(seen.filter("kind = 'n'").agg(F.sum(F.col("gain") * F.col("count"))).first()[0] or 0)
    hits = {r["kind"]: r["n"] for r in seen.filter("garbled").groupBy("kind").agg(F.sum("count").alias("n")).collect()}

    def nth(rows: DataFrame, largest: bool, k: int) -> float | None:
        """The gain at k, from 0, by size, each row counted as often as it says."""
        blocks = rows.groupBy(F.floor("gain").alias("b")).agg(F.sum("count").alias("n")).collect()
        for b in sorted(blocks, key=lambda b: b["b"], reverse=largest):
            if k < b["n"]:
                for r in rows.filter(F.floor("gain") == b["b"]).orderBy(F.desc("gain") if largest else "gain").toLocalIterator():
                    k -= r["count"]
                    if k < 0:
                        return r["gain"]
            k -= b["n"]
        return None

    out = {}
    for k in "uds":
        own = seen.filter(F.col("kind") == k)
        worst = nth(own.filter("not garbled"), True, n // CLEAN) or 0.0
        weak = nth(own.filter("garbled"), False, hits[k] // 50) if k in hits else PRIOR[k]
        out[k] = min(PRIOR[k], max(FLOOR, worst + 0.5 * max(0.0, weak - worst)))
    return out


def fit(df: DataFrame, text: str) -> Restorer:
    """n-gram counts come from all clean texts, the margins from all of them that reach beyond ASCII, equal ones once."""
    model = Model(statistics(df, text))
    return Restorer(model, fit_margins(model, undamaged(df, text).filter("high").select("t").distinct()))


def restored(blob) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = blob.value
        for pdf in batches:
            got = [r.restore(t) for t in pdf["t"]]
            out = pd.DataFrame({"id": pdf["id"], "restored": [x[0] for x in got], "chain": [" ".join(f"{a}<{b}" for a, b in x[1]) for x in got]})
            out["lost"] = out["restored"].str.contains("�", regex=False)
            yield out[(out["chain"] != "") | out["lost"]]

    return run


def garbled(df: DataFrame, id_col: str = "fact_id", text: str = "a", among: DataFrame | None = None) -> DataFrame:
    """(id, restored, chain, lost) of each record with text that was decoded wrongly.

    chain lists what was undone (true<wrong), empty if nothing can be; lost says that characters were replaced for good and
    stay so in restored. The model is fitted on all of df; with `among` only its rows are looked at. Null, empty and pure ASCII texts are never found, nor rows without an id.
    """
    spark = df.sparkSession
    blob = spark.sparkContext.broadcast(fit(df, text))
    high = (df if among is None else among).select(F.col(id_col).alias("id"), F.col(text).alias("t")).filter(F.col("id").isNotNull() & F.col("t").rlike(r"[^\x00-\x7F]"))
    return spread(high, "id").mapInPandas(restored(blob), "id bigint, restored string, chain string, lost boolean")
