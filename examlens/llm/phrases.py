"""Phrase collocations, counted in counting quotient filters.

Texts become arrays of word ids. An n-gram packs its ids into 64-bit limbs; an invertible
permutation spreads them, the leading bits being the quotient and all others the remainder, so a
filter (sorted quotients and remainders, with counts) loses nothing and is decoded by
the inverse. Each task fills filters, which are split by quotient; the parts of one range of
quotients are merged across tasks. Lengths are counted one after the other: a longer
n-gram is only counted where both its ends can be frequent, by a bitmap of the frequent quotients.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running, stage


@dataclass(frozen=True)
class PhraseSpec:
    longest: int = 5  # words of a candidate, from 2 on
    least: int = 100  # occurrences of a candidate
    inside: int = 100  # percent of its occurrences in a longer candidate by which one is dropped
    top: int = 2000  # phrases of a language
    chunk: int = 1 << 21  # bytes of text that share a dictionary
    entries: int = 1 << 22  # n-grams that go into one filter of a task
    block: int = 1 << 20  # n-grams of a merged block, on average at most
    words: int = 200_000  # a dictionary of so many words, and 64 bytes for each, may be broadcast; a larger one is joined
    slots: int = 8  # bits of the bitmap for each frequent n-gram
    most_bits: int = 27  # the bitmap has 2**27 bits (16 MB) at most


BREAK = b"\xff"  # no byte of UTF-8; stands between pieces
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))


class Ids(dict):
    """Local ids in order of appearance; a break is 0."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def chunk_row(lang: str, data: bytes, before: list[bytes]) -> tuple[pd.DataFrame, list[bytes]]:
    """One row for a translated text: its words, how often each occurs, and the text as local ids.
    The tokens `before` it are context that was counted already."""
    tokens = before + data.replace(BREAK, b" \xff ").split()
    ids = Ids({BREAK: 0})
    at = np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens))
    counts = np.bincount(at[len(before):], minlength=len(ids))[1:]
    words = [w.decode() for w in list(ids)[1:]]
    row = pd.DataFrame({"lang": [lang], "lead": [len(before)], "words": [words], "counts": [counts.astype(np.int64)], "ids": [at.tobytes()]})
    return row, tokens


def chunks_of(docs: DataFrame, spec: PhraseSpec = PhraseSpec()) -> DataFrame:
    """Chunks of text of one language: small texts share one, a long text takes several that overlap by context."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> pd.DataFrame:
            sizes.pop(lang)
            return chunk_row(lang, BREAK.join(held.pop(lang)), [])[0]

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                data = text.encode().translate(TABLE)
                if len(data) > spec.chunk:
                    yield from long_text(lang, data, spec)
                    continue
                held.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data) + 1
                if sizes[lang] >= spec.chunk:
                    yield flush(lang)
                elif sum(sizes.values()) >= 8 * spec.chunk:
                    yield flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield flush(lang)

    texts = docs.where("text <> ''").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    rows = texts.mapInPandas(cut, "lang string, lead int, words array<string>, counts array<long>, ids binary")
    return stage(rows.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def long_text(lang: str, data: bytes, spec: PhraseSpec) -> Iterator[pd.DataFrame]:
    at, before = 0, []
    while at < len(data):
        ends = [e for e in (data.find(b" ", at + spec.chunk), data.find(BREAK, at + spec.chunk)) if e >= 0]
        end = min(ends, default=len(data))
        row, tokens = chunk_row(lang, data[at:end], before)
        yield row
        before, at = tokens[max(0, len(tokens) - spec.longest + 1):], end


def word_table(chunks: DataFrame, spec: PhraseSpec = PhraseSpec()) -> tuple[DataFrame, DataFrame]:
    """(lang, word, f, gid) of words that are frequent enough, with ids from 1 without gaps in a language, and (lang, n) of all words."""
    all_words = stage(chunks.select("lang", F.inline(F.arrays_zip("words", "counts"))).groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")), "words")
    total = stage(all_words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent = all_words.where(F.col("f") >= spec.least).withColumn("block", F.pmod(F.xxhash64("word"), F.lit(256)))
    ids = running(frequent, ["lang"], "block", ["word"], F.lit(1), "gid")
    return stage(ids.select("lang", "word", "f", (F.col("gid") + 1).cast("int").alias("gid")), "dictionary"), total


def encoded(chunks: DataFrame, dictionary: DataFrame, spec: PhraseSpec = PhraseSpec()) -> DataFrame:
    """(lang, lead, ids): chunks as ids of the dictionary; 0 is a break or a word that is not in it.

    A dictionary up to the bound is sent to all tasks. Beyond, the chunks' words meet it in a
    join, and come back to the chunk as one small row.
    """
    rows, size = dictionary.agg(F.count("*"), F.sum(F.octet_length("word").cast("long"))).first()
    if rows <= spec.words and (size or 0) <= 64 * spec.words:
        known: dict[str, dict[str, int]] = {}
        for lang, word, gid in dictionary.select("lang", "word", "gid").collect():  # spec.words rows at most
            known.setdefault(lang, {})[word] = gid
        sent = chunks.sparkSession.sparkContext.broadcast(known)

        def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for lang, words, ids in zip(batch["lang"], batch["words"], batch["ids"]):
                    of = sent.value.get(lang, {})
                    out.append(np.array([0, *[of.get(w, 0) for w in words]], np.int32)[np.frombuffer(ids, np.int32)].tobytes())
                yield pd.DataFrame({"lang": batch["lang"], "lead": batch["lead"], "ids": out})

        return stage(chunks.select("lang", "lead", "words", "ids").mapInPandas(look_up, "lang string, lead int, ids binary"), "encoded")
    words = chunks.select("chunk", "lang", F.posexplode("words").alias("at", "word"))
    maps = words.join(dictionary.select("lang", "word", "gid"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "gid")).alias("map"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ids, at, gid in zip(batch["ids"], batch["at"], batch["gid"]):
                local = np.frombuffer(ids, np.int32)
                to = np.zeros(int(local.max()) + 1, np.int32)
                to[np.asarray(at, np.int64) + 1] = np.asarray(gid, np.int32)
                out.append(to[local].tobytes())
            yield pd.DataFrame({"lang": batch["lang"], "lead": batch["lead"], "ids": out})

    joined = chunks.select("chunk", "lang", "lead", "ids").join(maps, "chunk")
    return stage(joined.select("lang", "lead", "ids", F.col("map.at").alias("at"), F.col("map.gid").alias("gid")).mapInPandas(encode, "lang string, lead int, ids binary"), "encoded")


# --- the filter --------------------------------------------------------------

_U = np.uint64
_ODD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_BACK = tuple(pow(m, -1, 1 << 64) for m in _ODD)
_ROUNDS = 2


@dataclass(frozen=True)
class Layout:
    """How `size` ids of `bits` bits lie in limbs of equal width, with no more than 64 bits each."""

    size: int
    bits: int

    @property
    def limbs(self) -> int:
        return -(-self.size // (64 // self.bits))

    @property
    def per(self) -> int:
        return -(-self.size // self.limbs)

    @property
    def width(self) -> int:
        return self.per * self.bits

    def pack(self, words: np.ndarray) -> np.ndarray:
        """Rows of ids, one for each place of the n-gram, as rows of limbs."""
        out = np.zeros((self.limbs, words.shape[1]), _U)
        for k, w in enumerate(words):
            out[k // self.per] = (out[k // self.per] << _U(self.bits)) | w.astype(_U)
        return out

    def unpack(self, limbs: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, limbs.shape[1]), np.int64)
        for k in range(self.size):
            last = min(self.size, (k // self.per + 1) * self.per) - 1
            out[k] = (limbs[k // self.per] >> _U(self.bits * (last - k))) & _U((1 << self.bits) - 1)
        return out

    def _times(self, x: np.ndarray, m: int) -> np.ndarray:
        return (x * _U(m)) & _U((1 << self.width) - 1)

    def _fold(self, x: np.ndarray) -> np.ndarray:
        """Half of the bits onto the other half; its own inverse."""
        return x ^ (x >> _U((self.width + 1) // 2))

    def _turn(self, x: np.ndarray, i: int, r: int, key: int) -> np.ndarray:
        """What limb i is combined with in round r: the limb before it and the key."""
        add = _U((key * 0x9E3779B97F4A7C15 + r * 64 + i + 1) % (1 << 64))
        mixed = x[i - 1] * _U(0x2545F4914F6CDD1D) + add if self.limbs > 1 else np.full(x.shape[1], add)
        return mixed >> _U(64 - self.width)

    def permute(self, x: np.ndarray, key: int) -> np.ndarray:
        """A permutation of all keys of this layout."""
        x = x.copy()
        for r in range(_ROUNDS):
            for i in range(self.limbs):
                y = x[i] ^ self._turn(x, i, r, key)
                x[i] = self._fold(self._times(self._fold(self._times(self._fold(y), _ODD[0])), _ODD[1]))
        return x

    def restore(self, x: np.ndarray, key: int) -> np.ndarray:
        """The inverse of `permute`."""
        x = x.copy()
        for r in reversed(range(_ROUNDS)):
            for i in reversed(range(self.limbs)):
                y = self._fold(self._times(self._fold(self._times(self._fold(x[i]), _BACK[1])), _BACK[0]))
                x[i] = y ^ self._turn(x, i, r, key)
        return x

    def quotient(self, limbs: np.ndarray, bits: int) -> np.ndarray:
        return (limbs[0] >> _U(self.width - bits)).astype(np.int64) if bits else np.zeros(limbs.shape[1], np.int64)

    def write(self, keys: np.ndarray, block: int, block_bits: int) -> bytes:
        """Sorted keys of one block. The first limb is kept as the step from the key before, byte by byte in
        planes: of dense filters only remainders are left. Further limbs are kept whole."""
        base = _U(int(block) << (self.width - block_bits) if block_bits else 0)
        steps = np.diff(keys[0], prepend=base)
        return b"".join([planes(steps, (int(steps.max()).bit_length() + 7) // 8), *[planes(k, -(-self.width // 8)) for k in keys[1:]]])

    def read(self, data: bytes, n: int, block: int, block_bits: int) -> np.ndarray:
        base = _U(int(block) << (self.width - block_bits) if block_bits else 0)
        tail = n * -(-self.width // 8) * (self.limbs - 1)
        head = data[: len(data) - tail]
        rest = data[len(head):]
        size = len(rest) // max(1, self.limbs - 1)
        return np.stack([base + np.cumsum(whole(head, n), dtype=_U), *[whole(rest[i * size:(i + 1) * size], n) for i in range(self.limbs - 1)]])


def planes(x: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each number, all first bytes first."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def whole(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    width = len(data) // n
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(_U)


def counted(limbs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A filter: distinct permuted keys, sorted by quotient and remainder, with their counts (or sums of counts)."""
    if not limbs.shape[1]:
        return limbs, np.zeros(0, np.int64)
    order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
    limbs = limbs[:, order]
    first = np.flatnonzero(np.concatenate([[True], (limbs[:, 1:] != limbs[:, :-1]).any(axis=0)]))
    if counts is None:
        return limbs[:, first], np.diff(np.append(first, limbs.shape[1]))
    return limbs[:, first], np.add.reduceat(counts[order], first)


def has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def lang_key(lang: str) -> int:
    return zlib.crc32(lang.encode())


def frequent_grams(coded: DataFrame, layout: Layout, block_bits: int, shorter: DataFrame | None, spec: PhraseSpec = PhraseSpec()) -> DataFrame:
    """(lang, ids, f, key) of the n-grams of `layout.size` words that are frequent; key is the first permuted limb.
    `shorter`: the same for one word less, or None if single words are all that is known."""
    size, block_bits = layout.size, min(block_bits, layout.width)
    ends = None
    if shorter is not None:
        below = Layout(size - 1, layout.bits)
        bits = min(spec.most_bits, below.width, max(16, (spec.slots * shorter.count()).bit_length()))
        ends = below, bits, coded.sparkSession.sparkContext.broadcast(bitmap_of(shorter, below, bits))  # 2**(most_bits - 3) bytes at most

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}
        total = 0

        def flush() -> Iterator[pd.DataFrame]:
            for lang, found in held.items():
                keys, counts = counted(np.concatenate(found, axis=1))
                if not len(counts):
                    continue
                cuts = np.searchsorted(layout.quotient(keys, block_bits), np.arange((1 << block_bits) + 1))
                full = np.flatnonzero(np.diff(cuts))
                narrow = counts.astype(np.min_scalar_type(int(counts.max())))
                yield pd.DataFrame({
                    "lang": [lang] * len(full), "block": full.astype(np.int32), "n": np.diff(cuts)[full],
                    "keys": [layout.write(keys[:, cuts[b]:cuts[b + 1]], int(b), block_bits) for b in full],
                    "counts": [narrow[cuts[b]:cuts[b + 1]].tobytes() for b in full]})
            held.clear()

        for batch in batches:
            for lang, lead, ids in zip(batch["lang"], batch["lead"], batch["ids"]):
                ids = np.frombuffer(ids, np.int32)
                first = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(ids != 0, size).all(axis=1)) if len(ids) >= size else np.zeros(0, np.int64)
                first = first[first + size > lead]
                key = lang_key(lang)
                for part in np.array_split(first, len(first) // spec.entries + 1):
                    words = np.stack([ids[part + k] for k in range(size)])
                    if ends is not None and len(part):
                        below, bits, bitmap = ends
                        for end in (slice(0, -1), slice(1, None)):
                            words = words[:, has(bitmap.value, below.quotient(below.permute(below.pack(words[end]), key), bits))]
                    held.setdefault(lang, []).append(layout.permute(layout.pack(words), key))
                    total += words.shape[1]
                    if total >= spec.entries:
                        yield from flush()
                        total = 0
        yield from flush()

    def merge(group: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        lang, block = group
        keys = [layout.read(k, n, block, block_bits) for k, n in zip(parts["keys"], parts["n"])]
        counts = [np.frombuffer(c, f"u{len(c) // n}").astype(np.int64) for c, n in zip(parts["counts"], parts["n"])]
        merged, f = counted(np.concatenate(keys, axis=1), np.concatenate(counts))
        often = f >= spec.least
        merged, f = merged[:, often], f[often]
        ids = layout.unpack(layout.restore(merged, lang_key(lang))).T.astype(np.int32)
        return pd.DataFrame({"lang": pd.Series([lang] * len(f), dtype=object), "ids": pd.Series(list(ids), dtype=object), "f": f, "key": merged[0].view(np.int64)})

    filters = coded.mapInPandas(fill, "lang string, block int, n long, keys binary, counts binary")
    return stage(filters.groupBy("lang", "block").applyInPandas(merge, "lang string, ids array<int>, f long, key long"), f"grams{size}")


def bitmap_of(grams: DataFrame, layout: Layout, bits: int) -> np.ndarray:
    """The quotients of `bits` bits that occur, as a bitmap; comes to the driver in pages of 4 KB that are full of its bits."""
    slot = F.shiftrightunsigned(F.col("key"), layout.width - bits) + 1
    pages = grams.groupBy(F.bitmap_bucket_number(slot).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(max(1 << max(0, bits - 3), 4096), np.uint8)
    for page, found in pages.collect():
        out[(page - 1) * 4096:page * 4096] = np.frombuffer(found, np.uint8)
    return out


# --- scores ------------------------------------------------------------------


def collocations(docs: DataFrame, spec: PhraseSpec = PhraseSpec()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first `spec.top` phrases of every language.

    - a null lang counts as `und`, an empty one is a language of its own; a null or empty text has no words;
    - repeated rows are rows: all their occurrences count; doc_id and other columns are ignored;
    - equal scores go by occurrences, then by the phrase in byte order, so no ties are left;
    - an empty table, or one without frequent phrases, gives an empty result.

    Products are decimals of 38 digits. Bitmaps and dictionaries of bounded size are
    all that is broadcast by hand.
    """
    chunks = chunks_of(docs, spec)
    dictionary, total = word_table(chunks, spec)
    coded = encoded(chunks, dictionary, spec)
    top_id = dictionary.agg(F.max("gid")).first()[0] or 1
    most = total.agg(F.max("n")).first()[0] or 1
    id_bits, block_bits = int(top_id).bit_length(), max(0, (int(most) // spec.block).bit_length())
    grams = dictionary.select("lang", F.array("gid").alias("ids"), "f")
    shorter = None
    for size in range(2, spec.longest + 1):
        shorter = frequent_grams(coded, Layout(size, id_bits), block_bits, shorter, spec)
        grams = grams.unionByName(shorter.drop("key"))
    return ranked(stage(grams, "grams"), dictionary, total, spec)


def ranked(grams: DataFrame, dictionary: DataFrame, total: DataFrame, spec: PhraseSpec = PhraseSpec()) -> DataFrame:
    size = F.size("ids")
    candidates = grams.where(size >= 2).withColumnRenamed("f", "a")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).withColumns(
        {"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.expr("slice(ids, k + 1, size(ids) - k)")})
    known = lambda part, f: grams.select("lang", F.col("ids").alias(part), F.col("f").alias(f))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"]).join(total, "lang").withColumns(
        {"over": wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), "under": wide("l") * wide("r")}).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # An inner phrase of n-2 words or less has an inner phrase of n-1 around it, which occurs as often at least.
    inner = candidates.where(size >= 3).select("lang", "a", F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"))
    around = inner.groupBy("lang", "ids").agg(F.max("a").alias("around"))
    kept = best.join(around, ["lang", "ids"], "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * spec.inside))
    kept = stage(kept.select("lang", "ids", "a", "n", "cut.score", "cut.l", "cut.r"), "kept")
    spelled = kept.select("lang", "ids", F.posexplode("ids").alias("at", "gid")).join(dictionary.select("lang", "gid", "word"), ["lang", "gid"]).groupBy("lang", "ids").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.join(spelled, ["lang", "ids"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= spec.top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
