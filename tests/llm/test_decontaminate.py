import itertools
import random

from tables import LONG, docs, tuples

from examlens.llm.decontaminate import SeedSpec, leaks, without_leaks

ITEM = "id item_id"
WORDS = [f"w{i}" for i in range(40)]


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, seed string, at string")


def test_masks_find_every_window_with_two_replaced_words():
    spec = SeedSpec()
    for bad in itertools.combinations(range(spec.window), 2):
        assert any(not {s + j for j in m} & set(bad) for m in spec.masks for s in range(spec.window - spec.span + 1))


def test_awkward_rows(spark):
    b = bench(spark, [(1, " ".join(LONG.split()[500:520]), "x", "x"), (2, None, "x", "x"), (3, "", "x", "x"), (4, "too short to tell", "x", "x"), (None, "A b c d e f g h", "x", "x")])
    d = docs(spark)
    assert tuples(leaks(d, b), "doc_id", "item_id", "words", "matches") == [(5, 1, 13, 13)]
    left = without_leaks(d, b)
    assert left.columns == d.columns and left.count() == 10 and left.where("doc_id = 5").count() == 0
    assert leaks(docs(spark, []), b).count() == 0 and leaks(d, bench(spark, [])).count() == 0
    assert without_leaks(d, bench(spark, [])).count() == 11


def plain(doc, item, spec=SeedSpec()):
    """Best window of any shift, without seeds."""
    n, best = min(len(item), spec.window), 0
    for shift in range(-len(item), len(doc)):
        same = [0 <= j + shift < len(doc) and item[j] == doc[j + shift] for j in range(len(item))]
        best = max([best, *(sum(same[s : s + n]) for s in range(len(item) - n + 1))])
    return best >= -(-n * 4 // 5)


def test_replaced_words_against_brute_force(spark):
    rng = random.Random(3)
    items = {i: [rng.choice(WORDS) for _ in range(rng.choice([8, 10, 13, 25, 50]))] for i in range(12)}
    rows = []
    for k in range(150):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(0, 60))]
        if k % 3:
            part = list(items[k % 12])
            a = rng.randrange(0, max(1, len(part) - 12))
            part = part[a:] if k % 2 else part[: a + 13]
            for _ in range(rng.randrange(0, 5)):
                part[rng.randrange(len(part))] = "other"
            at = rng.randrange(0, len(w) + 1)
            w = w[:at] + part + w[at:]
        rows.append((k, " ".join(w).upper() if k % 4 == 0 else " \n".join(w), "en", "a", 0))
    got = set(tuples(leaks(docs(spark, rows), bench(spark, [(i, " ".join(w), "x", "x") for i, w in items.items()])), "doc_id", "item_id"))
    want = {(r[0], i) for r in rows for i, item in items.items() if plain(r[1].lower().split(), item)}
    short = {i for i, item in items.items() if len(item) < 13}  # two masks promise two replaced words in 13
    assert got <= want
    assert {p for p in want if p[1] not in short} <= got
    chunked = leaks(docs(spark, rows), bench(spark, [(i, " ".join(w), "x", "x") for i, w in items.items()]), SeedSpec(chunk_words=60))
    assert set(tuples(chunked, "doc_id", "item_id")) == got
