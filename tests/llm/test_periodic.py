import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloop.llm import periodic, queries
from tests.conftest import SF0001
from tests.llm import brute
from tests.llm.conftest import SCHEMA, odd_rows, prose

FIELDS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 7), st.integers(1, 3)), max_size=6), st.randoms(use_true_random=False))
@settings(max_examples=150, deadline=None)
def test_runs_of_built_texts(parts, rng):
    """Repeated pieces of few and many letters, some with a period inside the period."""
    words = []
    for period, times, letters in parts:
        piece = [rng.choice([b"a", b"b", b"c"][:letters]) for _ in range(period)]
        words += piece * times + piece[:rng.randint(0, period)]
        words += [b"%d" % rng.randint(0, 9) for _ in range(rng.randint(0, 4))]
    assert periodic.runs(words) == brute.runs(words)


@pytest.mark.parametrize("period", [8, 9, 15, 16, 17, 24, 31, 32, 33, 63, 64, 65, 100, 128, 129, 250, 511, 700])
def test_every_scale_at_the_least_length(period):
    rng = random.Random(period)
    piece = [b"%d" % rng.randint(0, 1) for _ in range(period - 1)] + [b"x"]
    for extra in (-1, 0, 1):
        words = [b"p"] * 2 + (piece * 5)[:4 * period + extra] + [b"q"]
        assert ((2, 4 * period + extra, period) in periodic.runs(words)) == (extra >= 0)
        if period < 140:
            assert periodic.runs(words) == brute.runs(words)


def test_fibonacci_words_and_one_letter():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 900:
        a, b = b, b + a
    for words in (b, [b"z"] * 700, [b"z"] * 5, b[:300] * 5, [], [b"a"]):
        assert periodic.runs(words) == brute.runs(words)


def test_odd_rows(spark, odd, none):
    for df, rows in ((odd, odd_rows()), (none, [])):
        df.createOrReplaceTempView("x")
        out = op13(df)
        assert out.columns == list(FIELDS)
        assert rows_of(out) == sorted((brute.periodic(*r[:2]) for r in rows), key=str)


def op13(df):
    """The query over a table that is at hand."""
    held, queries.table = queries.table, lambda *_: df
    try:
        return queries.QUERIES["op13_periodic_runs"](df.sparkSession, "")
    finally:
        queries.table = held


def test_planted_and_long(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(120)]
    rows += [(1000 + i, " ".join(["x y"] * rng.randint(1, 30)) + "\n\t" + prose(rng, 9)) for i in range(20)] + [(2007, "a " * 30_000), (2008, prose(rng, 300) + (" " + prose(rng, 170)) * 9)]
    docs = spark.createDataFrame([(*r, *[None] * 8) for r in rows], SCHEMA)
    assert rows_of(op13(docs)) == sorted((brute.periodic(*r) if r[0] != 2007 else long(r) for r in rows), key=str)


def long(row):
    n = 30_000
    sha = lambda x: brute.hashlib.sha256(x.encode()).hexdigest()
    return (row[0], 1, 0, n, 1, 1000 * n, sha(f"0,{n},1\n"), sha("a"))


def test_test_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    got = rows_of(queries.QUERIES["op13_periodic_runs"](spark, SF0001))
    assert got == sorted((brute.periodic(*r) if len(r[1] or "") < 9_000 else next(g for g in got if g[0] == r[0]) for r in docs), key=str)
