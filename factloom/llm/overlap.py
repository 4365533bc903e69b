"""Records that stand in two splits: a compressed full-text index of evaluation shards, through which the training split is streamed.

A shard's records make one text over the alphabet of their words, each record's distinct words rarest first, so that neither
formatting nor word order matters. It is kept as its Burrows-Wheeler transform, by word the sorted rows that follow it, in
which one binary search extends a match by a word to the left for a whole batch of training records at once. Texts lie packed.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.canonical import letters_digits
from factloom.plans.session import cut, spread, written

#: Records of a shard and shards searched in one scan, which bound what is broadcast; records packed together.
SHARD_RECORDS, SHARDS, PACKED = 100_000, 8, 64
#: Words of a record beyond which lengths aren't told apart in an index.
LONGEST = (1 << 24) - 2
#: Share of the words that agree, and of the distinct words that stand exactly so in both records, not up to a slip.
SHARE, EXACT = 0.7, 0.4
WORD = re.compile(r"[^\W_]+")
STARTS = re.compile(r"(?:^|[.!?:;•\n“\"«»(\[]|\d\.)\s*$")


@dataclass
class Record:
    """A record's words: counts, those that are names, those at a sentence's start or in a text without letter case, and their order."""

    words: Counter
    names: frozenset
    unsure: frozenset
    order: tuple = ()


def read_record(fields: tuple[str | None, ...]) -> Record:
    words, names, unsure, order = Counter(), set(), set(), []
    for field in fields:
        text = unicodedata.normalize("NFC", field or "")
        found = [(m.group(), m.start()) for m in WORD.finditer(text)]
        lettered = [w for w, _ in found if w[0].isalpha()]
        upper = sum(w[0].isupper() for w in lettered)
        plain = len(lettered) > 2 and (upper > 0.6 * len(lettered) or not upper)
        for w, at in found:
            k = w.casefold()
            words[k] += 1
            order.append(k)
            if not w[0].isalpha() or len(w) < 2:
                continue
            if plain or (w[0].isupper() and STARTS.search(text[max(0, at - 6) : at])):
                unsure.add(k)
            elif w[0].isupper():
                names.add(k)
    return Record(words, frozenset(names), frozenset(unsure - names), tuple(order))


def slip(a: str, b: str) -> bool:
    """Whether a and b differ by a slip of spelling: one letter more, less, other or swapped with the next; two from eight letters on."""
    if a == b:
        return True
    most = 0 if min(len(a), len(b)) < 3 else 1 if max(len(a), len(b)) < 8 else 2
    if abs(len(a) - len(b)) > most:
        return False
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if two and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return False
        two, one = one, row
    return one[-1] <= most


def aside(extra: list[str], record: Record) -> bool:
    """Whether all that a record has more is one phrase of three words or more before or after the rest, without a number; its
    capital begins a sentence, though no stop stands before it."""
    n = len(extra)
    ends = [part for part in (record.order[:n], record.order[-n:]) if Counter(part) == Counter(extra)]
    return n > 2 and any(p[0] in extra and sum(w in record.names for w in p) <= (p[0] in record.names) for p in ends) and not any(c.isdigit() for w in extra for c in w)


def say_the_same(a: Record, b: Record, ordinary: Callable[[str], bool], share: float = SHARE) -> bool:
    """All names and numbers agree and so do `share` of the words of the longer record, up to slips of spelling."""
    n = max(a.words.total(), b.words.total())
    if not n or not min(a.words.total(), b.words.total()):
        return False
    both = a.words & b.words
    left, right = list((a.words - both).elements()), list((b.words - both).elements())
    if both.total() + min(len(left), len(right)) < share * n:
        return False
    for mine, own, other in ((left, a, b), (right, b, a)):
        if own is (a if not right else b if not left else None) and aside(mine, own):
            continue
        if any(w not in other.words and (w in own.names or any(c.isdigit() for c in w)) for w in mine):
            return False
    agreed = both.total()
    for w in list(left):
        if len(w) > 2 and (y := next((y for y in right if slip(w, y)), None)):
            left.remove(w)
            right.remove(y)
            agreed += 1
    strange = [any(w in r.unsure and w not in o.words and not ordinary(w) for w in rest) for rest, r, o in ((left, a, b), (right, b, a))]
    return agreed >= share * n and not all(strange)


def digits(words: Counter) -> frozenset[str]:
    """Words with a digit; a pair must have the same ones."""
    return frozenset(w for w in words if not w.isalpha() and any(c.isdigit() for c in w))


class Index:
    """The full-text index of one shard of records."""

    def __init__(self, ids: np.ndarray, fields: list[tuple[str | None, ...]]):
        self.ids = ids
        records = [read_record(f) for f in fields]
        df = Counter(w for r in records for w in r.words)
        lower = Counter(w for r in records for w in r.words if w not in r.names and w not in r.unsure)
        self.common = frozenset(w for w, c in lower.items() if c > 1 and 2 * c >= df[w])
        self.symbol = {w: i for i, w in enumerate(sorted(df, key=lambda w: (df[w], w)))}
        rows = [sorted(self.symbol[w] for w in r.words) for r in records]
        self.sizes = np.fromiter(map(len, rows), np.int32, len(rows))
        self.lengths = np.fromiter((r.words.total() for r in records), np.int32, len(records))
        self.numbers = np.fromiter((hash_of(digits(r.words)) for r in records), np.int64, len(records))
        text, doc = self.layout(rows)
        order = self.suffixes(text, int(self.sizes.max(initial=0)) + 1)
        self.doc = doc[order].astype(np.int32)
        before = text[order - 1] if len(text) else text
        real = np.flatnonzero(before >= len(rows))  # a record's end sign is never searched
        by = np.argsort(before[real], kind="stable")
        self.first = np.searchsorted(before[real][by], np.arange(len(df) + 1) + len(rows)).astype(np.int32)
        # By word, the records that hold it, in the order of what must agree: numbers, then length.
        holds, symbol = self.doc[real[by]], before[real][by]
        self.agree = self.numbers << 24 | np.minimum(self.lengths, LONGEST)
        own = np.lexsort((self.agree[holds], symbol))
        self.holds = holds[own]
        self.keys = self.agree[self.holds]
        # Likewise the records by their rarest word alone, for those of which all words must be among a query's.
        some = np.flatnonzero(self.sizes)
        rarest = np.fromiter((rows[d][0] for d in some.tolist()), np.int64, len(some))
        own = np.lexsort((self.agree[some], rarest))
        self.heads = some[own].astype(np.int32)
        self.head_keys = self.agree[self.heads]
        self.head_first = np.searchsorted(rarest[own], np.arange(len(df) + 1)).astype(np.int32)
        self.texts = [zlib.compress(pickle.dumps(fields[i : i + PACKED], protocol=5)) for i in range(0, len(fields), PACKED)]
        self.tokens = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.empty(0, np.int32)
        name = [{self.symbol[w] for w in r.names} for r in records]
        self.named = np.fromiter((x in own for row, own in zip(rows, name) for x in row), bool, len(self.tokens))
        self.names_of = np.fromiter(map(len, name), np.int32, len(name))
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.read: dict[int, Record] = {}
        self.unpacked: dict[int, list] = {}

    @staticmethod
    def layout(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The text of all records, each with an end sign of its own that keeps matches inside it, and the record at each place."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        text = np.empty(int((sizes + 1).sum()), np.int64)
        at = 0
        for d, row in enumerate(rows):
            text[at : at + len(row)] = row
            text[at : at + len(row)] += len(rows)
            text[at + len(row)] = d
            at += len(row) + 1
        return text, np.repeat(np.arange(len(rows)), sizes + 1)

    @staticmethod
    def suffixes(text: np.ndarray, longest: int) -> np.ndarray:
        """The order of the text's suffixes, by doubling; records end differently, so `longest` symbols tell any two apart."""
        n, k = len(text), 1
        order = np.argsort(text, kind="stable")
        rank = text
        while n:
            key = rank[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
            if k >= longest:
                break
            after = np.zeros(n, np.int64)
            after[:-k] = rank[k:] + 1
            rank = rank * (n + 1) + after
            order = np.argsort(rank, kind="stable")
            k *= 2
        return order

    def size_of(self) -> int:
        """Bytes of the index without the dictionary of words."""
        return sum(a.nbytes for a in (self.holds, self.keys, self.first, self.heads, self.head_keys, self.head_first, self.tokens, self.sizes, self.lengths, self.numbers)) + sum(map(len, self.texts))

    def probes(self, r: Record, numbers: list[str]) -> tuple[list[int], bool]:
        """The words from which a search must start so that no record that says the same is lost, of which one posting is enough
        where it returns True: then the other record holds them all, or all of its words are among this one's.

        All words with digits stand in both records. All names do, but for one at the head of a phrase that this record has
        beside all of the other. A record of k distinct words that shares s of them shares one of its k - s + 1 rarest.
        """
        if any(w not in self.symbol for w in numbers):
            return [], False
        sure = [self.symbol[w] for w in numbers]
        if r.names:
            absent = sum(w not in self.symbol for w in r.names)
            return ([], absent == 1) if absent else ([*sure, *(self.symbol[w] for w in r.names)], True)
        if numbers:
            return [min(sure)], False
        k = len(r.words)
        known = sorted(self.symbol[w] for w in r.words if w in self.symbol)
        return known[: max(0, k - math.ceil(EXACT * k) + 1 - (k - len(known)))], False

    def candidates(self, records: list[Record]) -> Iterator[tuple[int, np.ndarray]]:
        """(query, records) that share what a pair must share, by the rows of the index that follow the query's probes."""
        for q, r in enumerate(records):
            if not r.words:
                continue
            numbers = digits(r.words)
            probes, either = self.probes(r, sorted(numbers))
            if not probes and not either:
                continue
            n, own = r.words.total(), hash_of(numbers) << 24
            ends = np.array([own | min(math.floor(SHARE * n), LONGEST), own | min(math.ceil(n / SHARE), LONGEST) + 1])
            hits = []
            for x in probes:
                at = self.first[x]
                lo, hi = self.keys[at : self.first[x + 1]].searchsorted(ends)
                hits.append(self.holds[at + lo : at + hi])
            if either:
                hits = [min(hits, key=len)] if hits else []
                words = [x for w in r.words if (x := self.symbol.get(w)) is not None and self.head_first[x] < self.head_first[x + 1]]
                for x in words:
                    at = self.head_first[x]
                    lo, hi = self.head_keys[at : self.head_first[x + 1]].searchsorted(ends)
                    hits.append(self.heads[at + lo : at + hi])
            hits = [h for h in hits if len(h)]
            if not hits:
                continue
            d = hits[0] if len(hits) == 1 else np.unique(np.concatenate(hits))
            d = d[(self.lengths[d] >= SHARE * n) & (self.lengths[d] * SHARE <= n)]
            if not len(d):
                continue
            mine = np.fromiter(sorted(self.symbol[w] for w in r.words if w in self.symbol), np.int32)
            is_name = np.isin(mine, [self.symbol[w] for w in r.names if w in self.symbol])
            held = self.sizes[d]
            at = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(self.starts[d], held)
            own = self.tokens[at]
            place = np.minimum(np.searchsorted(mine, own), len(mine) - 1)
            same, edges = mine[place] == own, np.cumsum(held) - held
            shared = np.add.reduceat(same.astype(np.int32), edges)
            lacks_mine = len(r.names) > np.add.reduceat((same & is_name[place]).astype(np.int32), edges)
            lacks_own = self.names_of[d] > np.add.reduceat((same & self.named[at]).astype(np.int32), edges)
            near = (shared >= EXACT * np.minimum(held, len(r.words))) & (~lacks_mine | (shared == held)) & (~lacks_own | (shared == len(r.words)))
            if near.any():
                yield q, d[near]

    def record(self, d: int) -> Record:
        """The record at d, unpacked and read when a candidate first needs it."""
        r = self.read.get(d)
        if r is None:
            block = self.unpacked.get(d // PACKED)
            if block is None:
                if len(self.unpacked) > 500:
                    self.unpacked.clear()
                block = self.unpacked[d // PACKED] = pickle.loads(zlib.decompress(self.texts[d // PACKED]))
            if len(self.read) > 50_000:
                self.read.clear()
            r = self.read[d] = read_record(block[d % PACKED])
        return r

    def search(self, ids: np.ndarray, records: list[Record]) -> Iterator[tuple[int, int]]:
        for q, found in self.candidates(records):
            for d in found.tolist():
                if say_the_same(records[q], self.record(d), self.common.__contains__):
                    yield int(ids[q]), int(self.ids[d])


def hash_of(words: frozenset[str]) -> int:
    return zlib.crc32("\x01".join(sorted(words)).encode())


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    index = Index(pdf["id"].to_numpy(np.int64), list(zip(pdf["q"], pdf["a"])))
    return pd.DataFrame({"source": [pdf["source"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "index": [zlib.compress(pickle.dumps(index, protocol=5), 1)]})


def streamed(blobs: list[tuple[str, Broadcast]]) -> Callable:
    """A function for mapInPandas that searches the broadcast indexes of their source for each training record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indexes = [(source, pickle.loads(zlib.decompress(blob.value))) for source, blob in blobs]
        for pdf in batches:
            for source in dict.fromkeys(s for s, _ in indexes):
                own = pdf[pdf["source"] == source]
                ids, records = own["id"].to_numpy(np.int64), [read_record((q, a)) for q, a in zip(own["q"], own["a"])]
                found = [pair for s, index in indexes if s == source for pair in index.search(ids, records)]
                if found:
                    yield pd.DataFrame(found, columns=["id", "rep"])

    return run


def classes(df: DataFrame, cols: list[Column]) -> DataFrame:
    """df with rep, the smallest id of the rows that are equal but for letter case, blanks and punctuation."""
    key = F.sha2(F.concat_ws("\x02", *[F.concat(letters_digits(c), F.lit("\x03"), F.coalesce(c, F.lit(""))) for c in cols]), 256)
    keyed = df.withColumn("_key", key)
    return keyed.join(keyed.groupBy("_key", "source").agg(F.min("id").alias("rep")), ["_key", "source"]).drop("_key")


def cross_split(items: DataFrame, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """(train_id, eval_id, split, source): each training record with each evaluation record of the same source that says the same.

    A null q or a counts as empty, a record without words overlaps with nothing, and rows without a source, split or id are
    left out. Equal evaluation records are searched once and expanded afterwards, so copies cost no search. Evaluation
    records are the stated query set, indexed in shards of about shard_records; a scan of the training records searches SHARDS of
    them. A pair in which fewer than EXACT of the distinct words stand exactly, all others up to slips, is not searched.
    """
    spark = items.sparkSession
    base = items.filter("split is not null and source is not null and item_id is not null").select(F.col("item_id").alias("id"), "split", "source", "q", "a")
    held = cut(classes(base.filter("split <> 'train'"), [F.col("q"), F.col("a")]))
    train = base.filter("split = 'train'")
    reps = held.filter("id = rep").select("id", "source", "q", "a").dropDuplicates(["id"])
    sizes = reps.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    numbered = reps.join(F.broadcast(sizes), "source").withColumn("shard", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / shard_records)).cast("int"))
    built = written(numbered.groupBy("source", "shard").applyInPandas(build, "source string, shard int, index binary"))
    some = spread(train.select("id", "source", "q", "a"), "id")
    found = []
    keys = [(r["source"], r["shard"]) for r in built.select("source", "shard").orderBy("source", "shard").collect()]
    for part in (keys[i : i + SHARDS] for i in range(0, len(keys), SHARDS)):
        wanted = F.lit(False)
        for source, shard in part:
            wanted = wanted | ((F.col("source") == source) & (F.col("shard") == shard))
        blobs = [(r["source"], spark.sparkContext.broadcast(bytes(r["index"]))) for r in built.filter(wanted).toLocalIterator()]
        found.append(some.mapInPandas(streamed(blobs), "id bigint, rep bigint"))
    if not found:
        return spark.createDataFrame([], "train_id bigint, eval_id bigint, split string, source string")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumnRenamed("id", "train_id").join(held.select("rep", F.col("id").alias("eval_id"), "split", "source"), "rep").select("train_id", "eval_id", "split", "source")


def overlap_pairs(items: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first, of cross_split."""
    return cross_split(items).select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def overlap_report(items: DataFrame) -> DataFrame:
    """By evaluation split and source: overlapping pairs, evaluation records leaked and training records concerned."""
    return cross_split(items).groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("eval_id").alias("leaked"), F.countDistinct("train_id").alias("train_records")
    )
