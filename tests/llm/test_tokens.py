import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import LONG, docs

from examlens.llm import tokens
from examlens.llm.tokens import FRESH, STATES, boundaries, chunk_maps, compose, scan, token_counts

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = ["a", "b", "e", "s", "t", " ", "  ", "\n", "'", "'re", "'ll", "'s", "l", "r", "v", "1", "23", "!", "--", "é", "漢", " ", "　", "ß", "the", "ing", "==", "<|endoftext|>", "\t", "²", "\x1c", "\x85", "A"]


@pytest.fixture(scope="module")
def path():
    return P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model(path):
    return tokens.compiled(path)


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda texts: [len(e.ids) for e in t.encode_batch(list(texts), add_special_tokens=False)]


def mixed(seed, n, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_as_the_library_counts(model, library):
    rng = random.Random(5)
    texts = mixed(1, 20_000) + [x * k for x in ("a", "=", " ", "ab", "漢字", "'s", "\n", "é") for k in range(0, 200, 7)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(5)] + [LONG, ""]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), rng.randrange(0x10000, 0x1F000)])) for _ in range(60)) for _ in range(1000)]
    assert model.count(texts).tolist() == library(texts)


def test_blocks_change_nothing(model, library):
    texts = ["".join(mixed(2, 40)), "x" * 5000, " " * 3000, "a 'r " * 700, *mixed(3, 50)]
    want = library(texts)
    for block in (7, 64, 1000):
        assert model.count(texts, block).tolist() == want


def test_chunk_maps_compose(model):
    """Boundaries by any chunk size are those of one run, and the scan is the composition of all maps before."""
    for text in ["".join(mixed(4, 60)), "a'r" * 300, "b" * 1000, "   x" * 200]:
        symbols = model.symbols(text) if hasattr(model, "classes") else None
        if symbols is None:
            model.open()
            symbols = model.symbols(text)
        one = boundaries(symbols, chunk=len(symbols) + 1)
        for chunk in (1, 2, 3, 10, 100):
            assert boundaries(symbols, chunk=chunk).tolist() == one.tolist()
    maps = np.random.default_rng(1).integers(0, STATES, (STATES, 37))
    got, acc = scan(maps), np.arange(STATES)[:, None]
    for j in range(37):
        acc = compose(acc, maps[:, j : j + 1])
        assert got[:, j].tolist() == acc[:, 0].tolist()
    assert chunk_maps(np.zeros((3, 2), np.intp)).shape == (STATES, 2) and FRESH == 0


def test_transitions_sum_to_the_encoding(model):
    """The emitted counts along a path are the tokens of every prefix, also after the table of states was emptied."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    model.open()
    pairs = model.pieces.pairs
    word = "unconstitutionallyaaaaaaaxyzzy"
    state = total = 0
    pairs.bound, kept = 5, pairs.bound
    assert pairs.count(word.encode()) == len(t.encode(word).ids)
    pairs.bound = kept
    pairs._forget()
    for i, c in enumerate(word.encode()):
        state, emitted = pairs.transition(state, c)
        total += emitted
        assert total == len(t.encode(word[: i + 1]).ids)


def test_whole_table(spark, path, library):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    got = token_counts(df, path).collect()
    want = dict(zip(texts, library(texts.values())))
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == df.count()
    assert all(r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024) for r in got)


def test_awkward(spark, path, library):
    df = docs(spark).withColumns({c: F.lit("x") for c in ("n_tokens", "n_bytes", "over_limit")})
    got = token_counts(df, path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and [t for _, t in got.dtypes] == ["bigint", "bigint", "bigint", "boolean"]
    rows = df.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()), n, n > 1024) for r, n in zip(rows, library([r.text or "" for r in rows]))), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert token_counts(docs(spark, []), path).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokens.compiled(P.path("word_bpe_49k.json"))
