import itertools
import random

import duckdb
import pytest

from labelloop.llm import decontaminate as d
from labelloop.llm.quality_rules import QUALITY_SQL, fails, quality_rules
from tests.llm import brute
from tests.llm.conftest import odd_rows, prose, table


def oracle(sql, docs, items=()):
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.sql("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    if items:
        con.executemany("insert into benchmark values (?, ?)", items)
    out = con.sql(sql)
    return out.columns, sorted(out.fetchall(), key=str)


LINES = ["Home | About | Contact", "home", "HOME about login", "All Rights Reserved.", "We use cookies to improve this site, accept them all.", "A normal line of some words.",
         "A normal line of some words.", "!!! wow!! so!! good!!", "a > b > c", "$$$ %%% ###", "x y z", "   ", "\t|\t|\t"]


def test_quality_rules_as_sql(spark, odd, none):
    rng = random.Random(3)
    rows = [r[:2] for r in odd_rows() if r[1] is None or "\0" not in r[1]]
    rows += [(500 + i, "\n".join(rng.choice([*LINES, prose(rng, 12)]) for _ in range(rng.randint(1, 12)))) for i in range(120)]
    rows += [(900, prose(rng, 9)), (901, prose(rng, 10)), (902, " ".join(["a b c d e"] * 3)), (903, "a a a a a a a a a a a a")]
    columns, want = oracle(QUALITY_SQL, rows)
    got = table(quality_rules(spark.createDataFrame(rows, "doc_id long, text string")), *columns)
    assert got == want
    assert quality_rules(odd).count() == len(odd_rows())
    assert quality_rules(none).collect() == []


def test_line_rules():
    assert [fails(x) for x in LINES[:11]] == [True, True, True, True, True, False, False, True, True, True, False]


def passage(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(12)
    items = [(i, " ".join(passage(rng, rng.choice([5, 9, 15, 24, 40])))) for i in range(25)] + [(50, None), (51, ""), (52, "one two"), (60, "W1, w2; W3 - w4 w5!")]
    items.append((61, items[3][1]))
    docs = []
    for i in range(150):
        words = passage(rng, rng.randint(0, 60))
        if i % 2:
            source = items[rng.randrange(25)][1].split(" ")
            a = rng.randint(0, max(0, len(source) - 12))
            part = source[a:a + rng.choice([7, 12, 15, 40])]
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                part[rng.randrange(len(part))] = "zz"
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((i, " ".join(words) if i % 3 else " ".join(words).upper().replace(" ", ", ")))
    return docs + [(900, None), (901, ""), (None, items[0][1]), docs[1]], items


def frames(spark, docs, items):
    extra = [(i, t, "x", 1, [1]) for i, t in docs]
    return (spark.createDataFrame(extra, "doc_id long, text string, h string, pos int, key array<int>"), spark.createDataFrame(items, "item_id long, text string"))


def test_decontamination_finds_what_all_alignments_find(spark, cases):
    docs, items = cases
    got = {r["doc_id"]: r["contaminated"] for r in d.decontaminate(*frames(spark, docs, items)).collect()}
    assert got == {i: brute.contaminated(t, [x for _, x in items]) for i, t in docs}


def test_masks_leave_a_hit_in_every_window_that_agrees():
    for n in range(d.LEAST, d.WINDOW + 1):
        masks = [[i for i, c in enumerate(m) if c == "1"] for m, least, most in d.MASKS if least <= n <= (most or n)]
        replaced = n - -(-d.MATCH_PERCENT * n // 100)
        for gone in itertools.combinations(range(n), replaced):
            assert any(all(p + k not in gone for k in m) for m in masks for p in range(n - m[-1])), (n, gone)


@pytest.mark.parametrize("n", [3, 4, 5, 6, 7, 8, 10, 11, 14, 15, 22])
def test_recall_by_length_is_one(spark, n):
    """Items of n words with as many replaced as the comparison allows, at every place; and with one more."""
    rng = random.Random(n)
    size = min(n, d.WINDOW)
    most = size - -(-d.MATCH_PERCENT * size // 100)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))) for i in range(3)]
    docs, want = [], {}
    for i, t in items:
        for at, gone in enumerate(list(itertools.combinations(range(size), most))[:60] + [tuple(range(size))[:most + 1]]):
            w = t.split()
            for g in gone:
                w[g] = "zz"
            docs.append((1000 * i + at, f"before it {' '.join(w)} and after"))
            want[1000 * i + at] = brute.contaminated(docs[-1][1], [x for _, x in items])
    got = {r["doc_id"]: r["contaminated"] for r in d.decontaminate(*frames(spark, docs, items)).collect()}
    assert got == want and sum(want.values()) >= len(want) - (3 if n <= d.WINDOW else 0)


def test_one_and_two_words_are_no_evidence(spark):
    docs = [(1, "the cat sat on the mat"), (2, "a dog")]
    assert [r["contaminated"] for r in d.decontaminate(*frames(spark, docs, [(1, "the"), (2, "the cat"), (3, "Cat sat,  on")])).orderBy("doc_id").collect()] == [True, False]


def test_decontamination_as_sql_both_ways(spark, cases):
    docs, items = cases
    unique = docs[:-1]
    columns, want = oracle(d.DECONTAMINATE_SQL, unique, items)
    for most in (d.MAX_BROADCAST_SEEDS, 0):
        assert table(d.decontaminate(*frames(spark, unique, items), max_broadcast_seeds=most), *columns) == want


def test_decontamination_of_repeated_ids_both_ways(spark, cases):
    """Rows that share an id, of the benchmark or of the texts, count their own hits once each."""
    docs, items = cases
    items = [*items, (3, items[5][1]), items[5], (None, items[7][1]), (None, items[8][1])]
    docs = [*docs, (900, items[5][1]), (901, items[7][1]), (1, items[3][1]), (None, items[5][1])]
    found = oracle(d.DECONTAMINATE_SQL, docs, items)[1]
    want = sorted({r for r in found}, key=str)
    for most in (d.MAX_BROADCAST_SEEDS, 0):
        got = table(d.decontaminate(*frames(spark, docs, items), max_broadcast_seeds=most), "doc_id", "contaminated", "n_items", "n_hits")
        assert len(got) == len(docs) and sorted(set(got), key=str) == want


def test_decontamination_empty_tables(spark, cases, none):
    docs, items = frames(spark, *cases)
    assert d.decontaminate(none, items).collect() == []
    assert not any(r["contaminated"] for r in d.decontaminate(docs, items.limit(0)).collect())


def test_decontamination_plan_is_native(spark, cases):
    plan = d.decontaminate(*frames(spark, *cases))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
