import random
from dataclasses import replace

from pyspark.sql import functions as F

from examlens.config import PARSER
from examlens.operators.numbers import Reader, _in_blocks, scan_numbers

SPAN = (
    "exam_id bigint, span int, line_no int, page int, img boolean, kind string, num int, own_w int, own_e boolean, raw_w int, raw_e boolean, after string, "
    "head_w int, head_e boolean, `set` array<int>, tail int, shared_line int, last_line int"
)


def spans(exam, n, seed):
    """Numbered lines of all kinds; numbers rise, jump, fall back to 1 and repeat."""
    rng, num, out = random.Random(seed), 1, [(exam, -1, *[None] * 7, None, None, None, 3, None, [None] * 5, None, 2, 4)]
    for i in range(n):
        num = rng.choice([num + 1, num + 1, num + 1, num + 2, 1, 1, rng.randint(1, 99), num])
        num = num if num < 100 else 1
        bare, line = rng.random() < 0.3, 5 + 3 * i
        options = [rng.choice([None, 0, 1, 2, 4]) for _ in range(5)]
        out.append((
            exam, line, line, 1 + i // 9, rng.random() < 0.2, "alone" if bare else "start", num, None if bare else rng.randint(0, 14), None if bare else rng.random() < 0.5,
            rng.randint(0, 9), rng.random() < 0.5, rng.choice([None, "text", "option"]), rng.randint(0, 12), rng.choice([None, True, False]), options, rng.choice([None, 1, 3, 5]), 2, line + 2))
    return out


def rows(scan):
    return [sorted(map(tuple, df.collect()), key=repr) for df in (scan.items, scan.seen, scan.exams)]


def test_blocks_change_nothing(spark):
    """One exam of many blocks, several of one, and resets: the same rows for every cut."""
    table = [r for exam, n in ((1, 400), (2, 30), (3, 0), (4, 90)) for r in spans(exam, n, exam)]
    df = spark.createDataFrame(table, SPAN)
    cfg = replace(PARSER, min_score=10, weak_max_score=80.0, weak_max_useful=9.0, weak_min_items=1)
    for reset in (False, True):
        want = rows(scan_numbers(df, reset, replace(cfg, scan_lines=10**6)))
        assert len(want[1]) == 520 and any(r[9] for r in want[0]) and (not reset or any(r[10] for r in want[0]))
        assert rows(scan_numbers(df.repartition(5, F.rand(1)), reset, replace(cfg, scan_lines=100))) == want
        assert rows(scan_numbers(df, reset, replace(cfg, scan_lines=10))) == want


def test_blocks_count_numbered_lines(spark):
    """Sparse line numbers make no blocks; many numbered lines do, in order and each of bounded size."""
    df = spark.createDataFrame([(1, -1)] + [(1, 100_000 * i) for i in range(1, 11)] + [(2, i) for i in range(-1, 1000)], "exam_id bigint, span int")
    got = _in_blocks(df, replace(PARSER, scan_lines=64)).groupBy("exam_id", "block").agg(
        F.count("*").alias("n"), F.min("span").alias("a"), F.max("span").alias("z")).orderBy("exam_id", "block").collect()
    assert [(r.exam_id, r.block, r.n) for r in got if r.exam_id == 1] == [(1, 0, 11)]
    dense = [r for r in got if r.exam_id == 2]
    assert len(dense) > 8 and sum(r.n for r in dense) == 1001 and max(r.n for r in dense) <= 128
    assert all(x.z < y.a for x, y in zip(dense, dense[1:]))


def test_state_travels_as_text():
    names = SPAN.replace("`", "").split(", ")
    names = [x.split(" ")[0] for x in names]
    one, two = Reader(), Reader()
    cfg = replace(PARSER, min_score=10)
    for r in spans(1, 300, 7)[1:]:
        c = dict(zip(names, r))
        assert list(one.read(c, True, cfg)) == list(two.read(c, True, cfg))
        two = Reader.load(two.dump())
        two.kept = one.kept
    assert one == two
