import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tables import docs

from examlens.llm.phrases import Layout, PhraseSpec, collocations, counted, lang_key

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, spec):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + m])) for m in range(1, spec.longest + 1) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= spec.least}
    out = []
    for (lang, w), a in cand.items():
        if any(100 * b >= spec.inside * a and o == lang and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (o, v), b in cand.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    out.sort()
    rank, rows = Counter(), []
    for lang, score, a, phrase, l, r in out:
        rank[lang] += 1
        if rank[lang] <= spec.top:
            rows.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(rows)


def made(seed=1, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "c", "the", "of", "Naïve", "x\x01", "x", "漢", "THE", "e-f", "q"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((text + "one fixed phrase of six words", rng.choice(["en", "de", None, "und", ""])))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, l, None, None) for i, (t, l) in enumerate(rows)], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("ids", "f", "n", "chunk", "word", "gid", "at", "rank", "phrase")})


def test_permutation_is_lossless():
    rng = np.random.default_rng(1)
    for bits in (3, 14, 21, 32):
        for size in (2, 3, 4, 5):
            layout, en = Layout(size, bits), lang_key("en")
            words = rng.integers(1, 1 << bits, (size, 500)).astype(np.int64)
            keys = layout.permute(layout.pack(words), en)
            assert (layout.unpack(layout.restore(keys, en)) == words).all() and layout.width <= 64
            assert len(np.unique(keys.T, axis=0)) == len(np.unique(words.T, axis=0))
            # Written by blocks and read again
            keys, _ = counted(keys)
            for block_bits in (0, 2):
                at = layout.quotient(keys, block_bits)
                for block in np.unique(at):
                    part = keys[:, at == block]
                    assert (layout.read(layout.write(part, int(block), block_bits), part.shape[1], np.int32(block), block_bits) == part).all()
    small = Layout(2, 3)
    every = np.array([[a, b] for a in range(8) for b in range(8)]).T
    assert sorted(small.permute(small.pack(every), 7)[0].tolist()) == list(range(64))


def test_filters_merge():
    rng = np.random.default_rng(2)
    for limbs in (1, 2, 3):
        x = rng.integers(0, 4, (limbs, 3000)).astype(np.uint64)
        want, k = np.unique(x.T, axis=0, return_counts=True)
        parts = [counted(p) for p in np.array_split(x, 7, axis=1)]
        got, f = counted(np.concatenate([p for p, _ in parts], axis=1), np.concatenate([c for _, c in parts]))
        assert (got.T == want).all() and (f == k).all()
        assert (counted(x)[1] == k).all()


def test_against_plain_loops(spark):
    rows = made()
    for spec in (PhraseSpec(least=4, top=50), PhraseSpec(least=3, top=9, inside=60, chunk=64, entries=32, block=16, slots=1, words=2)):
        got = sorted(map(tuple, collocations(frame(spark, rows), spec).collect()))
        assert got == plain(rows, spec) and got


def test_long_text_is_cut_with_context(spark):
    text = "alpha beta gamma delta epsilon zeta " * 300
    rows = [(text, "en"), (text + ". " + text, "en")]
    spec = PhraseSpec(least=5, chunk=50)
    assert sorted(map(tuple, collocations(frame(spark, rows), spec).collect())) == plain(rows, spec)


def test_awkward(spark):
    df = docs(spark)
    spec = PhraseSpec(least=2)
    got = collocations(df, spec)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    small = [(r.text, r.lang) for r in df.collect() if len(r.text or "") < 1000]
    want = plain(small, spec)
    ours = sorted(map(tuple, collocations(df.where("text is null or length(text) < 1000"), spec).collect()))
    assert ours == want and got.count() >= len(want)
    assert collocations(docs(spark, []), spec).count() == 0
    assert collocations(df, PhraseSpec(least=10**6)).count() == 0
