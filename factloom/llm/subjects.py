"""Subject areas of documents: class-association rules mined by parallel FP-growth, and calibrated evidence of each sentence."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.session import cut, spread

#: Labelled documents that are learned from, by hash of their id; words that may stand in rules; sentences that a subject needs.
LABELLED, WORDS, SENTENCES = 20_000, 20_000, 3
#: Least sentences behind a rule, and their least share, most words in one, and how much a longer rule must gain over a shorter one.
SUPPORT, SHARE, LENGTH, GAIN = 3, 5e-5, 2, 0.05
SPLIT = re.compile(r"(?<=[.!?。])[\"”'’)]*\s+|\n+")
WORD = re.compile(r"[^\W\d_]{2,}")
ROLE = re.compile(r"^\s*(?:user|assistant|system|passage|question|answer|q|a|statement)\s*:\s*")


def sentences(text: str | None) -> list[frozenset[str]]:
    """The word sets of a text's sentences: at least four words, no list of options."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    out = []
    for s in SPLIT.split(text.lower()):
        if not s or s[0] == "(":
            continue
        words = WORD.findall(ROLE.sub("", s) if ":" in s[:16] else s)
        if len(words) >= 4:
            out.append(frozenset(words))
    return out


def labels(subject_labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject) as spelled in subjects; null and unknown subjects and doubled labels are left out."""
    tidy = lambda c: F.lower(F.trim(F.col(c)))
    names = subjects.select("subject", tidy("subject").alias("k")).union(subjects.select("subject", tidy("title").alias("k"))).distinct()
    return subject_labels.select("doc_id", tidy("subject").alias("k")).join(F.broadcast(names), "k").select("doc_id", "subject").distinct()


def transactions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, n, sorted(s), list(own)) for i, t, own in zip(pdf["id"], pdf["t"], pdf["own"]) for n, s in enumerate(sentences(t))]
        yield pd.DataFrame(rows, columns=["id", "n", "words", "own"])


@dataclass
class Rules:
    """word -> rules of it alone, as (subject, weight), and of it with another word, as (other word, subject, weight); weights
    are log-odds. threshold: the evidence that makes a sentence deal with a subject."""

    alone: dict[str, list[tuple[str, float]]]
    joint: dict[str, list[tuple[str, str, float]]]
    threshold: float = 2.0

    def __post_init__(self):
        self.known = frozenset(self.alone) | frozenset(self.joint)

    def evidence(self, words: frozenset[str]) -> dict[str, float]:
        """By subject, the three strongest rules that match."""
        hits: dict[str, list[float]] = {}
        for w in words & self.known:
            for subject, weight in self.alone.get(w, ()):
                hits.setdefault(subject, []).append(weight)
            for other, subject, weight in self.joint.get(w, ()):
                if other in words:
                    hits.setdefault(subject, []).append(weight)
        return {s: sum(ws) if len(ws) < 4 else sum(nlargest(3, ws)) for s, ws in hits.items()}

    def best(self, words: frozenset[str]) -> tuple[str | None, float]:
        """The subject of most evidence, none if two have as much."""
        top, subject = -math.inf, None
        for s, e in self.evidence(words).items():
            if e > top:
                top, subject = e, s
            elif e == top:
                subject = None
        return subject, top

    def subject(self, words: frozenset[str], threshold: float | None = None) -> str | None:
        subject, e = self.best(words)
        return subject if e >= (self.threshold if threshold is None else threshold) else None

    def subjects(self, text: str | None, threshold: float | None = None) -> list[str]:
        counts = Counter(self.subject(s, threshold) for s in sentences(text))
        return sorted(s for s, n in counts.items() if s and n >= SENTENCES)


class Tree:
    """A tree of frequent patterns: transactions share prefixes, and each node counts them by subject."""

    def __init__(self):
        self.item, self.parent, self.counts = [-1], [0], [Counter()]
        self.child: dict[tuple[int, int], int] = {}
        self.nodes: dict[int, list[int]] = defaultdict(list)

    def add(self, items: Sequence[int], counts: Counter) -> None:
        at = 0
        for x in items:
            new = self.child.get((at, x))
            if new is None:
                new = self.child[at, x] = len(self.item)
                self.item.append(x)
                self.parent.append(at)
                self.counts.append(Counter())
                self.nodes[x].append(new)
            at = new
            self.counts[at].update(counts)

    def prefix(self, node: int) -> list[int]:
        out = []
        while (node := self.parent[node]):
            out.append(self.item[node])
        return out[::-1]

    def patterns(self, own: Callable[[int], bool], least: float, longest: int) -> Iterator[tuple[tuple[int, ...], Counter]]:
        """Patterns of up to `longest` items that end with an item of one's own, and their counts by subject, where one reaches `least`."""
        for x in sorted(self.nodes):
            if not own(x):
                continue
            total: Counter = Counter()
            for node in self.nodes[x]:
                total.update(self.counts[node])
            if max(total.values()) < least:
                continue
            yield (x,), total
            if longest > 1:
                under = Tree()
                for node in self.nodes[x]:
                    if self.parent[node]:
                        under.add(self.prefix(node), self.counts[node])
                for items, counts in under.patterns(lambda _: True, least, longest - 1):
                    yield (*items, x), counts


def shared(blob, groups: int) -> Callable:
    """For each group of items, the prefixes of the transactions up to their last item of that group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = blob.value
        for pdf in batches:
            rows = []
            for words, subject, n in zip(pdf["words"], pdf["subject"], pdf["c"]):
                items = sorted(number[w] for w in words if w in number)
                done = set()
                for at in range(len(items) - 1, 0, -1):
                    if (g := items[at] % groups) not in done:
                        done.add(g)
                        rows.append((g, items[: at + 1], subject, n))
            yield pd.DataFrame(rows, columns=["g", "items", "subject", "c"])

    return run


def grown(least: float, groups: int) -> Callable:
    """The frequent patterns of two words up to LENGTH of one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree()
        for items, subject, n in zip(pdf["items"], pdf["subject"], pdf["c"]):
            tree.add([int(x) for x in items], Counter({subject: int(n)}))
        g = int(pdf["g"].iloc[0])
        rows = [(list(items), s, n, sum(counts.values())) for items, counts in tree.patterns(lambda x: x % groups == g, least, LENGTH) if len(items) > 1 for s, n in counts.items() if n >= least]
        return pd.DataFrame(rows, columns=["items", "subject", "n", "total"])

    return run


def mine(learned: DataFrame) -> Rules:
    """Rules from labelled sentences (columns id, n, words, own): parallel FP-growth over telling words, then pruning.

    Equal sentences are one transaction with a weight. Items go to groups, each of which grows its own tree from the
    prefixes that end in it, and patterns longer than LENGTH are never formed.
    """
    spark = learned.sparkSession
    single = learned.filter(F.size("own") == 1).groupBy(F.get("own", F.lit(0)).alias("subject"), "words").agg(F.count(F.lit(1)).alias("c"))
    single = cut(single)
    prior = {r["subject"]: r["c"] for r in single.groupBy("subject").agg(F.sum("c").alias("c")).collect()}
    total = sum(prior.values())
    if not total:
        return Rules({}, {})
    prior = {s: n / total for s, n in prior.items()}
    by = single.select("subject", "c", F.explode("words").alias("w")).groupBy("w", "subject").agg(F.sum("c").alias("c"))
    word = by.groupBy("w").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.map_from_entries(F.collect_list(F.struct("subject", "c"))).alias("by"))
    telling = word.filter((F.col("n") >= SUPPORT) & (F.col("top") / F.col("n") > 2 * max(prior.values()))).orderBy(F.desc("n"), "w").limit(WORDS).collect()
    least = max(SUPPORT, SHARE * total)
    confidence = lambda freq, n, p: (freq + 2 * p) / (n + 2)
    odds = lambda c, p: math.log(c / (1 - c)) - math.log(p / (1 - p))
    one = {(i, s): confidence(c, r["n"], prior[s]) for i, r in enumerate(telling) for s, c in r["by"].items() if c >= least}
    alone: dict[str, list] = defaultdict(list)
    joint: dict[str, list] = defaultdict(list)
    for (i, s), c in sorted(one.items()):
        if c >= max(2 * prior[s], 0.3):
            alone[telling[i]["w"]].append((s, odds(c, prior[s])))
    groups = 8 * spark.sparkContext.defaultParallelism
    blob = spark.sparkContext.broadcast({r["w"]: i for i, r in enumerate(telling)})
    prefixes = single.mapInPandas(shared(blob, groups), "g int, items array<int>, subject string, c bigint")
    found = prefixes.groupBy("g").applyInPandas(grown(least, groups), "items array<int>, subject string, n bigint, total bigint")
    # Only what beats its shorter rules leaves the executors.
    p = F.create_map(*[F.lit(x) for kv in prior.items() for x in kv])[F.col("subject")]
    strong = found.withColumn("c", (F.col("n") + 2 * p) / (F.col("total") + 2)).filter((F.col("c") >= F.greatest(2 * p, F.lit(0.3))) & (F.size("items") == 2))
    shorter = spark.sparkContext.broadcast(one)

    def better(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            least_gain = [c >= GAIN + max(shorter.value.get((int(x), s), 0.0) for x in items) for items, s, c in zip(pdf["items"], pdf["subject"], pdf["c"])]
            yield pdf[np.asarray(least_gain, bool)]

    # At most LABELLED documents' sentences with `least` of each, so no more than pairs of a sentence / SHARE rules.
    rows = strong.select("items", "subject", "c").mapInPandas(better, "items array<int>, subject string, c double").collect()
    for r in sorted(rows):
        a, b = (telling[i]["w"] for i in r["items"])
        joint[a].append((b, r["subject"], odds(r["c"], prior[r["subject"]])))
    return Rules(dict(alone), dict(joint))


def fit(docs: DataFrame, subject_labels: DataFrame, subjects: DataFrame, most: int = LABELLED) -> Rules:
    """Rules from at most `most` labelled documents; the threshold is the one under which their labels are met best (F1)."""
    own = labels(subject_labels, subjects).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("own"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    some = docs.select("doc_id", F.col("text").alias("t")).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").alias("id"), "t", "own")
    some = cut(some.repartition(3 * docs.sparkSession.sparkContext.defaultParallelism, "id"))
    learned = cut(some.mapInPandas(transactions, "id bigint, n int, words array<string>, own array<string>"))
    rules = mine(learned)
    blob = docs.sparkSession.sparkContext.broadcast(rules)
    counts = some.mapInPandas(agreement(blob), "step int, hit bigint, found bigint, wanted bigint").groupBy("step").agg(F.sum("hit").alias("hit"), F.sum("found").alias("found"), F.sum("wanted").alias("wanted"))
    rows = sorted(counts.collect(), key=lambda r: (-2 * r["hit"] / max(1, r["found"] + r["wanted"]), r["step"]))
    if rows:
        rules.threshold = rows[0]["step"] / 4
    return rules


def agreement(blob) -> Callable:
    """For thresholds in quarters: subjects found that are labelled, found at all, and labelled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules, total = blob.value, {step: [0, 0, 0] for step in range(2, 49)}
        for pdf in batches:
            for text, own in zip(pdf["t"], pdf["own"]):
                seen: dict[str, list[float]] = defaultdict(list)
                for words in sentences(text):
                    s, e = rules.best(words)
                    if s:
                        seen[s].append(e)
                # A subject is found as long as its third-strongest sentence stays above the threshold.
                third = {s: sorted(e, reverse=True)[SENTENCES - 1] for s, e in seen.items() if len(e) >= SENTENCES}
                for step, t in total.items():
                    found = {s for s, e in third.items() if e >= step / 4}
                    t[0] += len(found & set(own))
                    t[1] += len(found)
                    t[2] += len(own)
        yield pd.DataFrame([(step, *t) for step, t in total.items()], columns=["step", "hit", "found", "wanted"])

    return run


def assigned(blob) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = blob.value
        for pdf in batches:
            rows = [(i, s) for i, t in zip(pdf["id"], pdf["t"]) for s in rules.subjects(t)]
            yield pd.DataFrame(rows, columns=["id", "subject"])

    return run


def document_subjects(docs: DataFrame, subject_labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(id, subject): each subject that at least SENTENCES sentences of a document deal with.

    Null, blank and boilerplate texts have no row, and without labels nothing has. Copies are judged one by one.
    """
    rules = fit(docs, subject_labels, subjects)
    blob = docs.sparkSession.sparkContext.broadcast(rules)
    some = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).filter("id is not null and trim(t) <> ''")
    return spread(some, "id").mapInPandas(assigned(blob), "id bigint, subject string")
