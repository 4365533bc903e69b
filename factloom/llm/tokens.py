"""Byte-level BPE with a public vocabulary, as expressions of Spark: ranked merges folded over the bytes of distinct words.

A word under way is an array of ids with the ranks of their pairs, so that a merge looks up two new ranks only. The rank map
is a literal: a perfect hash of the pairs over three arrays.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public tokenizer's division of text, with Unicode's white space.
PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z\p{L}]++| ?\p{N}++| ?[^\p{IsWhite_Space}\p{L}\p{N}]++|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}++"
SLOTS, BUCKETS, WHOLE, NONE = 1 << 16, 1 << 14, 1 << 18, 1 << 20
#: Share of the texts that are sampled for hot words, which one in HOT of them holds; slots of their lookup.
SAMPLED, HOT, HOT_SLOTS = 0.005, 100, 1 << 14


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def mix(x: int) -> int:
    """Spark's xxhash64 of one long, as unsigned."""
    p1, p2, p3, p4, p5, m = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, (1 << 64) - 1
    rotate = lambda v, r: ((v << r) | (v >> (64 - r))) & m
    h = (42 + p5 + 8) & m
    h ^= (rotate((x & m) * p2 & m, 31) * p1) & m
    h = (rotate(h, 27) * p1 + p4) & m
    h = ((h ^ (h >> 33)) * p2) & m
    h = ((h ^ (h >> 29)) * p3) & m
    return h ^ (h >> 32)


def murmur(data: bytes) -> int:
    """Spark's hash of one string, as unsigned."""
    m = 0xFFFFFFFF
    rotate = lambda v, r: ((v << r) | (v >> (32 - r))) & m

    def stir(h: int, k: int) -> int:
        h ^= rotate(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        return (rotate(h, 13) * 5 + 0xE6546B64) & m

    h, whole = 42, len(data) & ~3
    for i in range(0, whole, 4):
        h = stir(h, int.from_bytes(data[i : i + 4], "little"))
    for b in data[whole:]:
        h = stir(h, (b - 256 if b > 127 else b) & m)
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def perfect(keys: Sequence[int]) -> tuple[int, list[int], list[int]]:
    """(cut, shift by bucket, entry by slot): a perfect hash of distinct keys. An entry is key << 16 | number, -1 where empty."""
    for cut in range(17, 40):
        buckets: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = mix(k)
            buckets.setdefault(h & (BUCKETS - 1), []).append((h >> cut & (SLOTS - 1), k << 16 | i))
        if any(len({h for h, _ in m}) < len(m) for m in buckets.values()):
            continue
        shifts, entries = [0] * BUCKETS, [-1] * SLOTS
        for b, members in sorted(buckets.items(), key=lambda kv: -len(kv[1])):
            shift = next((x for x in range(SLOTS) if all(entries[h ^ x] == -1 for h, _ in members)), None)
            if shift is None:
                break
            shifts[b] = shift
            for h, entry in members:
                entries[h ^ shift] = entry
        else:
            return cut, shifts, entries
    raise ValueError("no perfect hash found")


def longs(values: Sequence[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


class Vocabulary:
    """The public tokenizer as literals. path: its file, by default that of the installed package."""

    def __init__(self, path: str | None = None):
        with open(path or default_path(), encoding="utf-8") as f:
            model = json.load(f)["model"]
        names, ids = byte_names(), model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pieces = [b""] * (max(ids.values()) + 1)
        for text, i in ids.items():
            self.pieces[i] = bytes(names[c] for c in text) if all(c in names for c in text) else text.encode()
        self.pairs = [(ids[a], ids[b]) for a, b in pairs]
        self.merged = [ids[a + b] for a, b in pairs]
        self.cut, shifts, entries = perfect([a << 16 | b for a, b in self.pairs])
        self.shifts, self.entries = longs(shifts), longs(entries)
        made = {*self.merged, *(i for i, p in enumerate(self.pieces) if len(p) == 1)}
        self.merged_ids = F.split(F.lit(",".join(map(str, self.merged))), ",").cast("array<int>")
        single = {p[0]: i for i, p in enumerate(self.pieces) if len(p) == 1}
        first = {self.pieces[a] + self.pieces[b]: r for r, (a, b) in reversed(list(enumerate(self.pairs))) if len(self.pieces[a]) == len(self.pieces[b]) == 1}
        self.first_ranks = F.split(F.lit(",".join(str(first.get(bytes((a, b)), NONE)) for a in range(256) for b in range(256))), ",").cast("array<int>")
        self.single_ids = F.split(F.lit(",".join(str(single[b]) for b in range(256))), ",").cast("array<int>")
        # Words that are one piece by Spark's hash; where two meet in a slot the later one takes the long way like any other word.
        slots, spelled = [-1] * WHOLE, [""] * len(self.pieces)
        for i, piece in enumerate(self.pieces):
            try:
                word = piece.decode()
            except UnicodeDecodeError:
                continue
            at = murmur(piece) & (WHOLE - 1)
            if i in made and word and "\x01" not in word and slots[at] < 0:
                slots[at], spelled[i] = i, word
        self.slots = F.split(F.lit(",".join(map(str, slots))), ",").cast("array<int>")
        self.spelled = F.split(F.lit("\x01".join(spelled)), "\x01")
        self.hex = F.split(F.lit(",".join(p.hex() for p in self.pieces)), ",")

    def rank(self, left: Column, right: Column) -> Column:
        """The merge's rank, null if the pair is none."""
        key = F.shiftleft(left.cast("bigint"), 16).bitwiseOR(right.cast("bigint"))

        def look(h: Column) -> Column:
            at = F.shiftrightunsigned(h, self.cut).bitwiseXOR(F.get(self.shifts, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))).bitwiseAND(F.lit(SLOTS - 1))
            return F.get(self.entries, at.cast("int"))

        return let(let(F.xxhash64(key), look), lambda e: F.when(F.shiftright(e, 16) == key, e.bitwiseAND(F.lit(0xFFFF)).cast("int")))

    def whole(self, word: Column) -> Column:
        """The id of a word that is one piece, null for any other word."""
        at = F.get(self.slots, F.hash(word).bitwiseAND(F.lit(WHOLE - 1)))
        return F.when(F.get(self.spelled, at) == word, at)

    def encode_word(self, word: Column) -> Column:
        """array<int>: the ids of one word. Each step merges the leftmost pair of the least rank and looks up two new ranks.

        An element of the folded array holds an id below the rank of the pair that it begins, NONE where that is none.
        """
        chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        bytes_ = F.transform(chars, F.ascii)
        packed = lambda rank, code: F.shiftleft(F.coalesce(rank, F.lit(NONE)).cast("bigint"), 20) + code
        start = let(bytes_, lambda b: F.transform(b, lambda x, i: packed(F.get(self.first_ranks, x * 256 + F.get(b, i + 1)), F.get(self.single_ids, x))))
        code = lambda e: e.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")

        def merged(e: Column, i: Column) -> Column:
            new = F.get(self.merged_ids, F.shiftright(F.get(e, i - 1), 20).cast("int"))
            before = code(F.get(e, i - 2))
            # One mention of the rank map serves both new pairs: each would be a literal of its own in the plan.
            mine, pair = F.struct(new.alias("l"), code(F.get(e, i + 1)).alias("r")), F.struct(before.alias("l"), new.alias("r"))
            middle = F.transform(F.when(i > 1, F.array(pair, mine)).otherwise(F.array(mine)), lambda p: packed(self.rank(p["l"], p["r"]), p["l"]))
            return F.concat(F.slice(e, 1, F.greatest(i - 2, F.lit(0))), middle, F.slice(e, i + 2, F.lit(1 << 30)))

        def merge(e: Column, _: Column) -> Column:
            least = F.array_min(e)
            return F.when(least >= NONE << 20, e).otherwise(let(F.array_position(e, least).cast("int"), lambda i: merged(e, i)))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.octet_length(word), F.lit(1))), start, merge, lambda e: F.transform(e, code))

    def hot(self, texts: DataFrame) -> Callable[[Column], Column]:
        """A lookup of the words of several pieces that at least one in HOT texts of a sample holds: their ids, else null.

        A text holds a bounded number of words on average, so there are at most HOT times as many of them.
        """
        some = texts.sample(SAMPLED, 7).select(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("t"), F.lit("")), F.lit(PATTERN), 0)).alias("w"))
        counts = some.select(F.explode(F.filter("w", lambda w: self.whole(w).isNull())).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
        total = some.agg(F.count(F.lit(1)).alias("all"))
        frequent = counts.filter("n > 2").crossJoin(F.broadcast(total)).filter(F.col("n") * HOT >= F.col("all"))
        known = frequent.select("w", F.array_join(self.encode_word(F.col("w")).cast("array<string>"), " ").alias("i")).collect()
        slots, own = [-1] * HOT_SLOTS, []
        for r in sorted(known):
            at = murmur(r["w"].encode()) & (HOT_SLOTS - 1)
            if slots[at] < 0 and "\x01" not in r["w"]:
                slots[at] = len(own)
                own.append(r)
        places = F.split(F.lit(",".join(map(str, slots))), ",").cast("array<int>")
        names, values = (F.split(F.lit("\x01".join(r[c] for r in own)), "\x01") for c in ("w", "i"))

        def look(word: Column) -> Column:
            at = F.get(places, F.hash(word).bitwiseAND(F.lit(HOT_SLOTS - 1)))
            return F.when(F.get(names, at) == word, F.split(F.get(values, at), " ").cast("array<int>"))

        return look

    def text(self, ids: Column) -> Column:
        """The text of ids: their binary pieces, one after the other."""
        return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.hex, i)), "")), "UTF-8")


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """df with out, array<int>: the ids of text without special tokens; null and empty texts give an empty list.

    A word that is one piece, or that a sample shows to be in many texts, is looked up in place. The other distinct words go
    by word to where each is encoded once, in all of df, and come back by the text's hash: two texts with one hash only share
    a larger dictionary, so the result stays exact. What the sample misses is slower, not wrong. Columns of df keep their
    names; one called out is replaced.
    """
    vocab = Vocabulary(path)
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PATTERN), 0)
    hot = vocab.hot(df.select(F.col(text).alias("t")))
    hard = F.filter(F.array_distinct(words), lambda w: vocab.whole(w).isNull() & hot(w).isNull())
    some = df.select(F.xxhash64(text).alias("_key"), F.explode(hard).alias("w")).repartition("w")
    # The least key keeps both sides of the join one shuffle, whose texts are divided once.
    known = some.groupBy("w").agg(F.min("_key").alias("k")).select("w", "k", vocab.encode_word(F.col("w")).alias("i"))
    entry = F.struct("w", F.when(F.col("k") <= F.col("_key"), F.col("i")).alias("i"))
    by_text = some.join(known.hint("shuffle_hash"), "w").groupBy("_key").agg(F.map_from_entries(F.collect_set(entry)).alias("_ids"))
    rows = df.withColumn("_key", F.xxhash64(text)).join(by_text, "_key", "left")
    at = lambda w: F.get(vocab.slots, F.hash(w).bitwiseAND(F.lit(WHOLE - 1)))
    ids = F.flatten(F.transform(words, lambda w: F.when(F.get(vocab.spelled, at(w)) == w, F.array(at(w))).otherwise(F.coalesce(hot(w), F.col("_ids")[w]))))
    return rows.withColumn(out, F.coalesce(ids, F.array().cast("array<int>"))).drop("_key", "_ids")
