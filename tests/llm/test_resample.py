import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F
from tables import docs

from examlens.llm.resample import TABLE, ResampleSpec, bucket_counts, gains, hashes, resampled

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def grams(text, order=3):
    w = words(text)
    return [b" ".join(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def plain(rows, targets, spec):
    b = lambda g: zlib.crc32(g) % spec.buckets
    s, t = Counter(b(g) for _, x in rows for g in grams(x)), Counter(b(g) for x in targets for g in grams(x))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (S + spec.buckets) / ((s[k] + 1) * (T + spec.buckets))))
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"{spec.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b(g)) for g in grams(x))
        out.append([i, len(grams(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(x))])
    able = sorted((o for o in out if o[5] >= spec.min_words), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[2], o[1]))
    for k, o in enumerate(able[: spec.percent * len(able) // 100]):
        o[4] = k + 1
    return sorted((tuple(o[:5]) for o in out), key=repr)


def test_words_and_chains():
    spec = ResampleSpec()
    for text in ["", "a", "A b", "One-two  THREE four\tfive\0six 'x' É9 漢字 \x85 z", "x" * 50 + " y", " , "]:
        for size in (1, 5, 1 << 20):
            got = [int(h) for found, _ in hashes(text, ResampleSpec(block=size)) for h in found]
            assert sorted(got) == sorted(zlib.crc32(g) for g in grams(text))
        assert sum(n for _, n in hashes(text, spec)) == len(words(text))
        assert text.encode().translate(TABLE).split() == words(text)


def test_against_plain_loops(spark):
    spec = ResampleSpec(min_words=5, percent=40, buckets=97)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(vocabulary[(i * k * k + 3 * k) % 60] for k in range(i % 17))) for i in range(150)]
    rows += [rows[20]] * 9 + [(None, rows[33][1])] * 3 + [(21, "a b c d e f"), (21, "b c d e f g"), (5000, None), (5001, "")]
    target = [" ".join(vocabulary[:30]), None, "w1 w2 w3"]
    df = spark.createDataFrame([(i, x, None, None, None) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit("x") for c in ("rank", "score", "weight", "part", "range", "copies", "all")})
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    got = sorted((tuple(r) for r in resampled(df, bench, spec).collect()), key=repr)
    assert got == plain(rows, target, spec)


def test_awkward(spark):
    df = docs(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    bench = spark.createDataFrame([("word1 word2 word3",)], "text string")
    spec = ResampleSpec(min_words=3, percent=50)
    got = resampled(df, bench, spec)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, ["word1 word2 word3"], spec)
    assert resampled(df, bench.limit(0), spec).count() == len(rows)
    assert resampled(docs(spark, []), bench, spec).count() == 0
    assert bucket_counts(docs(spark, [])).count() == 0 and len(gains(df, bench)) == 10_000
