"""Evaluation passages inside training text: windows of words embedded by a random walk, sampled into buckets, verified by edits.

The walk (CGK) reads a window's words in steps; each step notes the word under the head, and a random bit of step and word
says whether the head moves on. Windows that few edits part agree in most steps, so hashes of a few sampled steps meet. A
window is as long as the least stretch that makes a passage contained, and the number of samples follows from RECALL.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.overlap import slip
from factloom.plans.session import spread

#: A passage is contained from so many of its words in a row on, of which one in five may be wrong.
LEAST, SHARE = 18, 0.8
#: Words of a window, steps of a walk, walks, steps sampled together; text windows begin every STRIDE words.
WINDOW, STEPS, WALKS, SAMPLED, STRIDE = LEAST, 27, 4, 4, 3
#: Share of the worst windows that still contain a passage which must meet in one table; words a bucket mate must have in place.
RECALL, EQUAL = 0.9, 8
#: Words that a matching segment needs; what a wrong, missing or added word costs it; diagonals on either side that edits may reach;
#: words of a dense stretch, and equal words that a candidate may lack.
SEGMENT, WRONG, BAND, DENSE, SLACK = 8, 2, 3, 9, 2
#: Characters of passages in one broadcast index.
SHARD_CHARS = 20_000_000
WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    text = text or ""
    return WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold())




def word_bits(word: str, walk: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{walk} {word}".encode(), digest_size=8).digest(), "little", signed=True)


def walked(text: np.ndarray, starts: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """steps x windows: the word under the head at each step of one walk over the windows that begin at starts."""
    head, end, last = starts.copy(), starts + WINDOW, len(text) - 1
    steps = np.empty((STEPS, len(starts)), np.int32)
    for j in range(STEPS):
        word = text[np.minimum(head, last)]
        word[head >= end] = 0
        steps[j] = word
        head += bits[word] >> j & 1
    return steps


@lru_cache(4)
def samples(recall: float) -> tuple[tuple[tuple[int, ...], ...], ...]:
    """For each walk, the samples of steps: as many as let `recall` of the worst windows meet. A worst window has as many wrong
    words as a contained stretch may have, and begins as far beside it as STRIDE allows; these are simulated."""
    rng, n, words = np.random.default_rng(5), 3000, 5000
    plain = rng.integers(2, words, (n, WINDOW)).astype(np.int32)
    other = plain.copy()
    for row in other:
        row[rng.choice(WINDOW - STRIDE + 1, LEAST - math.ceil(SHARE * LEAST), replace=False)] = 1
        row[WINDOW - STRIDE + 1 :] = 1
    starts = np.arange(n, dtype=np.int64) * WINDOW
    bits = rng.integers(-(1 << 62), 1 << 62, (WALKS, words))
    same = [walked(plain.ravel(), starts, b) == walked(other.ravel(), starts, b) for b in bits]
    out: list[list[tuple[int, ...]]] = [[] for _ in range(WALKS)]
    met, at = np.zeros(n, bool), 0
    while met.mean() < recall:
        steps = np.sort(rng.choice(STEPS, SAMPLED, replace=False))
        out[at % WALKS].append(tuple(steps.tolist()))
        met |= same[at % WALKS][steps].all(0)
        at += 1
    return tuple(map(tuple, out))


class Index:
    """Passages, their words, and the buckets of their windows."""

    def __init__(self, passages: list[tuple[int, str]], recall: float = RECALL):
        self.ids = [i for i, _ in passages]
        self.words = [tokens(t) for _, t in passages]
        self.number = {w: i + 2 for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}  # 0 fills up, 1 is any other word
        self.bits = np.zeros((WALKS, len(self.number) + 2), np.int64)
        self.number[""] = 0
        for walk in range(WALKS):
            self.bits[walk, :2] = word_bits("", walk), word_bits(" ", walk)
            for w, i in self.number.items():
                if w:
                    self.bits[walk, i] = word_bits(w, walk)
        self.samples = samples(recall)
        held = Counter(w for ws in self.words for w in set(ws))
        self.rarity = [np.asarray([held[w] for w in ws]) for ws in self.words]
        triples = [list(zip(ws, ws[1:], ws[2:])) for ws in self.words]
        stood = Counter(t for own in {tuple(ws): set(ts) for ws, ts in zip(self.words, triples)}.values() for t in own)
        self.own = [np.asarray([stood[t] == 1 for t in ts], bool) for ts in triples]
        self.sizes = sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.begin = np.cumsum(sizes + WINDOW) - sizes - WINDOW
        self.flat = np.zeros(int((sizes + WINDOW).sum()), np.int32)
        self.own_flat = np.zeros(len(self.flat), bool)
        owner, offset = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for p, ws in enumerate(self.words):
            self.flat[self.begin[p] : self.begin[p] + len(ws)] = [self.number[w] for w in ws]
            self.own_flat[self.begin[p] : self.begin[p] + len(self.own[p])] = self.own[p]
            n = max(len(ws) - EQUAL + 1, 0)
            owner.append(np.full(n, p))
            offset.append(np.arange(n))
        owner, offset = np.concatenate(owner), np.concatenate(offset)
        self.tables = []
        for keys in self.hashes(self.flat, self.begin[owner] + offset):
            order = np.argsort(keys, kind="stable")
            held = np.zeros(1 << 20, bool)
            held[keys & (len(held) - 1)] = True
            self.tables.append((keys[order], owner[order], offset[order], held))

    def hashes(self, text: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """For each table: the windows' bucket keys."""
        for bits, own in zip(self.bits, self.samples):
            if not own:
                continue
            steps = walked(text, starts, bits) if len(starts) else np.empty((STEPS, 0), np.int32)
            for sample in own:
                keys = np.zeros(len(starts), np.int64)
                for j in sample:
                    keys = (keys + steps[j]) * np.int64(0x1E3779B97F4A7C15)
                    keys ^= keys >> 29
                yield keys

    def candidates(self, text: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Distinct (document, passage, diagonal) of bucket mates with EQUAL words in place; diagonal: text less passage position."""
        known = np.concatenate(([0], np.cumsum(text > 1)))
        starts = np.arange(0, len(text), STRIDE)
        wrong = LEAST - math.ceil(SHARE * LEAST)
        starts = starts[known[np.minimum(starts + WINDOW, len(text))] - known[starts] >= WINDOW - STRIDE + 1 - 2 * wrong]
        padded = np.concatenate([text, np.zeros(WINDOW, np.int32)])
        out = [np.empty((3, 0), np.int64)]
        for keys, (sorted_keys, owner, offset, held) in zip(self.hashes(padded, starts), self.tables):
            some = held[keys & (len(held) - 1)]
            k, s = keys[some], starts[some]
            lo, hi = np.searchsorted(sorted_keys, k, "left"), np.searchsorted(sorted_keys, k, "right")
            ends = np.cumsum(hi - lo)
            at = 0
            while at < len(k):  # in parts, as one bucket may hold a phrase of all passages
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 200_000, "right")))
                many = hi[at:to] - lo[at:to]
                rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[at:to], many)
                begin, p, o = np.repeat(s[at:to], many), owner[rows], offset[rows]
                equal = np.zeros(len(rows), np.int8)
                for i in range(WINDOW):
                    own = self.flat[self.begin[p] + o + i]
                    equal += (own > 1) & (padded[begin + i] == own)
                near = equal >= EQUAL
                d = np.searchsorted(begins, begin[near], "right") - 1
                out.append(np.unique(np.stack([d, p[near], begin[near] - o[near]]), axis=1))
                at = to
        return np.unique(np.concatenate(out, 1), axis=1).T

    def promising(self, text: np.ndarray, bounds: np.ndarray, found: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """By (document, passage) the diagonals, where together they hold as many equal words in dense stretches as containment
        needs, less SLACK. A stretch is dense if two of three words of DENSE in a row are equal; of a contained one four in five
        are. A diagonal counts if it has three words that only its passage has, or enough words by itself, as in align."""
        longest = max(map(len, self.words), default=1)
        marks: dict[tuple[int, int], np.ndarray] = {}
        diagonals: dict[tuple[int, int], list[int]] = {}
        step = max(1, 2_000_000 // longest)
        for part in (found[i : i + step] for i in range(0, len(found), step)):
            d, p, diagonal = part.T
            at = np.arange(longest)
            own = self.flat[np.minimum(self.begin[p][:, None] + at, len(self.flat) - 1)]
            own[at[None, :] >= self.sizes[p][:, None]] = 0
            spots = diagonal[:, None] + at
            inside = (spots >= bounds[d, 0][:, None]) & (spots < bounds[d, 1][:, None])
            same = (text[np.where(inside, spots, 0)] == own) & inside & (own > 1)
            padded = np.pad(same, ((0, 0), (DENSE, DENSE))).astype(np.int16)
            total = np.cumsum(padded, 1)
            good = np.cumsum(np.pad(total[:, DENSE:] - total[:, :-DENSE] >= 2 * DENSE // 3, ((0, 0), (1, 0))), 1)
            dense = same & (good[:, at + DENSE] - good[:, at] > 0)  # at least one of the stretches that hold the word
            triples = self.own_flat[np.minimum(self.begin[p][:, None] + at, len(self.flat) - 1)] & same
            triples[:, :-2] &= same[:, 1:-1] & same[:, 2:]
            for i in np.flatnonzero((dense.sum(1) >= SHARE * LEAST - SLACK) | (dense & triples).any(1)):
                key = (int(d[i]), int(p[i]))
                marks[key] = marks[key] | dense[i] if key in marks else dense[i]
                diagonals.setdefault(key, []).append(int(diagonal[i]))
        return {k: diagonals[k] for k, m in marks.items() if m.sum() >= min(SHARE * self.sizes[k[1]], SHARE * LEAST) - SLACK}

    def found(self, documents: list[list[str]]) -> list[tuple[int, int]]:
        """(number of the document, number of the passage) for each passage that one of the documents contains."""
        flat: list[str] = []
        bounds = []
        for words in documents:
            bounds.append((len(flat), len(flat) + len(words)))
            flat += words + [""] * WINDOW
        text = np.fromiter(map(self.number.get, flat, repeat(1)), np.int32, len(flat))
        if not len(text) or not len(self.flat):
            return []
        edges = np.asarray(bounds)
        out = []
        for (d, p), diagonals in self.promising(text, edges, self.candidates(text, edges[:, 0])).items():
            (s, e), near = bounds[d], []
            hits = np.zeros(len(self.words[p]), bool)
            for diagonal in diagonals:
                if not any(abs(x - diagonal) <= BAND // 2 for x in near):
                    near.append(diagonal)
                    hits |= self.align(p, diagonal - s, flat[s:e], text[s:e])
            if self.contained(p, hits):
                out.append((d, p))
        return out

    def align(self, p: int, diagonal: int, words: list[str], text: np.ndarray) -> np.ndarray:
        """The passage words that segments near this diagonal match: local alignments by edits, of SEGMENT words
        or more. Below what makes a passage contained, a segment needs three words in a row that no other passage has: the
        phrases that many share are no part of any."""
        own, names = self.flat[self.begin[p] : self.begin[p] + len(self.words[p])].tolist(), self.words[p]
        marks, open_ = np.zeros(len(own), bool), [(max(0, -diagonal - BAND), min(len(own), len(words) - diagonal + BAND))]
        while open_:
            lo, hi = open_.pop()
            if hi - lo < SEGMENT:
                continue
            path = self.best(own[lo:hi], names[lo:hi], diagonal + lo, words, text)
            if len(path) >= SEGMENT:
                part = np.zeros(len(own), bool)
                part[[lo + i for i in path]] = True
                if len(path) >= SHARE * LEAST or (part[:-2] & part[1:-1] & part[2:] & self.own[p]).any():
                    marks |= part
                open_ += [(lo, lo + path[0]), (lo + path[-1] + 1, hi)]
        return marks

    @staticmethod
    def best(own: list[int], names: list[str], diagonal: int, words: list[str], text: np.ndarray) -> list[int]:
        """The best local alignment within BAND of the diagonal, as the passage positions it matches, slips of spelling among them."""
        width, n = 2 * BAND + 1, len(text)
        lo, hi = diagonal - BAND, diagonal + len(own) + BAND
        line = [-1] * max(0, -lo) + text[max(0, lo) : max(0, min(hi, n))].tolist()
        line += [-1] * (hi - lo - len(line))
        last, back, top = [0] * (width + 1), [], (0, 0, 0)
        for i, x in enumerate(own):
            row, from_ = [0] * (width + 1), [0] * width
            for k in range(width):
                y, score, how = line[i + k], 0, 0
                before = last[k]
                if y == x or (before > 0 and y == 1 or before > 0 and y > 1) and close(names[i], words[lo + i + k]):
                    score, how = before + 1, 1
                elif before > WRONG:
                    score, how = before - WRONG, 2
                if last[k + 1] - WRONG > score:
                    score, how = last[k + 1] - WRONG, 3
                if k and row[k - 1] - WRONG > score:
                    score, how = row[k - 1] - WRONG, 4
                row[k], from_[k] = score, how
                if score and score >= top[0]:
                    top = (score, i, k)
            last = row
            back.append(from_)
        path, (_, i, k) = [], top
        while top[0] and i >= 0 and 0 <= k < width and (how := back[i][k]):
            if how == 1:
                path.append(i)
            if how == 4:
                k -= 1
            else:
                i, k = i - 1, k + (how == 3)
        return path[::-1]

    def contained(self, p: int, matched: np.ndarray) -> bool:
        """Whether matched holds SHARE of the passage, or of LEAST or more of its words in a row, and is no mere pattern."""
        n = len(matched)
        if matched.sum() < min(SHARE * n, int(SHARE * LEAST)):
            return False
        if matched.sum() >= SHARE * n and self.own_words(p, 0, n, matched):
            return True
        total = np.concatenate(([0], np.cumsum(matched - SHARE)))
        for i in range(n - LEAST + 1):
            ends = i + LEAST + np.flatnonzero(total[i + LEAST :] - total[i] >= -1e-9)
            if len(ends) and any(self.own_words(p, i, int(e), matched) for e in {ends[0], ends[-1]}):
                return True
        return False

    def own_words(self, p: int, i: int, j: int, matched: np.ndarray) -> bool:
        """Whether half of a stretch's rarest words are matched, of which there are one more than may be wrong. Words that are
        wrong by chance spare them; where a pattern is shared, just these differ."""
        rarest = np.lexsort((self.flat[self.begin[p] + i : self.begin[p] + j], self.rarity[p][i:j]))[: (j - i) - math.ceil(SHARE * (j - i)) + 1]
        return bool(2 * matched[i:j][rarest].sum() >= len(rarest))


def close(a: str, b: str) -> bool:
    """Whether b is a with a slip of spelling; numbers have none."""
    return abs(len(a) - len(b)) < 3 and (a[0] == b[0] or a[-1] == b[-1]) and not a.isdigit() and slip(a, b)


def searched(blob) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = pickle.loads(blob.value)
        for pdf in batches:
            for part in (pdf.iloc[i : i + 200] for i in range(0, len(pdf), 200)):
                ids = part["id"].to_list()
                rows = [(ids[d], index.ids[p]) for d, p in index.found([tokens(t) for t in part["t"]])]
                yield pd.DataFrame(rows, columns=["id", "passage_id"])

    return run


def contained_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text: str = "text", passage_id: str = "passage_id", passage_text: str = "text") -> DataFrame:
    """(id, passage_id) of each passage that a document contains: the whole passage or LEAST of its words in a row.

    Passages are the stated query set; they are indexed in shards of bounded size, each broadcast by itself. Null and empty
    texts contain nothing, null and empty passages stand nowhere, copies of documents and of passages each count.
    """
    spark = docs.sparkSession
    some = spread(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).filter("t is not null and id is not null"), "id")
    wanted = passages.select(F.col(passage_id).alias("p"), F.col(passage_text).alias("t")).filter("p is not null and trim(t) <> ''")
    chars = wanted.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    shards = int(chars // SHARD_CHARS) + 1
    out = None
    for s in range(shards):
        part = wanted.filter(F.pmod(F.xxhash64("p"), F.lit(shards)) == s)
        index = Index([(r["p"], r["t"]) for r in part.orderBy("p").toLocalIterator()])
        blob = spark.sparkContext.broadcast(pickle.dumps(index, protocol=5))
        found = some.mapInPandas(searched(blob), "id bigint, passage_id bigint")
        out = found if out is None else out.unionByName(found)
    return out
