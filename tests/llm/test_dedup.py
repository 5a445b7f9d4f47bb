import random

import numpy as np
import pytest

from labelloop.llm import simhash, suffix_dedup
from labelloop.llm.components import components
from tests.llm import brute
from tests.llm.conftest import odd_rows, table

FIELDS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def test_suffix_dedup_odd_rows(spark, odd, none):
    got = table(suffix_dedup.suffix_dedup(odd), *FIELDS)
    assert got == sorted(brute.suffix_dedup([r[:2] for r in odd_rows()]), key=str)
    assert table(suffix_dedup.suffix_dedup(none), *FIELDS) == []


def test_suffix_dedup_many_small_buckets(spark, monkeypatch):
    """Self-overlapping runs, shared edges, and matches of exactly 49 and 50 bytes, in tiny buckets."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", 40)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    common = word(400)
    rows = [(9, "a" * 300), (4, "b" * 80 + "a" * 70), (7, common[:49]), (8, common), (2, word(30) + common[100:150] + word(30)), (3, word(10) + common[100:149] + "#")]
    rows += [(20 + i, word(rng.randint(0, 40)) + common[(a := rng.randint(0, 300)):a + rng.randint(30, 100)] + word(20)) for i in range(30)]
    got = table(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")), *FIELDS)
    assert got == sorted(brute.suffix_dedup(rows), key=str)


def test_suffix_dedup_of_a_passage_in_many_documents(spark, monkeypatch):
    """A string that occurs everywhere is no group: no bucket holds all of its places."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", 64)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, often = word(300), word(25)
    rows = [(i, word(rng.randint(0, 60)) + passage + word(40)) for i in range(150)] + [(500 + i, word(60) + often + word(60)) for i in range(150)]
    rows += [rows[3], (None, passage), (700, passage[20:120])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hot = suffix_dedup.hot_strings(docs.filter("doc_id is not null").selectExpr("*", "xxhash64(text) as th"), suffix_dedup._sampled(50, 20), 70)
    assert 10 <= len(hot) < 60
    assert table(suffix_dedup.suffix_dedup(docs), *FIELDS) == sorted(brute.suffix_dedup(rows), key=str)


def test_suffix_entries_take_the_same_room_in_any_number_of_buckets(spark):
    """What goes to the buckets follows the texts, not the number of buckets that a large input has."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i * 7, "".join(rng.choice("abcdefgh ") for _ in range(2_000))) for i in range(2_000)], "doc_id long, text string")
    rows = suffix_dedup.documents(docs.coalesce(1)).selectExpr("*", "xxhash64(text) as th")

    def room(n_buckets):
        made = [rows.mapInArrow(suffix_dedup._entries(suffix_dedup._sampled(50, 20), n_buckets, wave, 2, np.zeros(0, np.uint64)), suffix_dedup._ENTRIES)
                .selectExpr("count(*) as rows", *(f"sum(octet_length({c})) as {c}" for c in ("pos", "doc", "w", "k1"))).first() for wave in range(2)]
        return tuple(sum(r[c] or 0 for r in made) for c in ("rows", "pos", "doc", "w", "k1"))
    few, many = room(4), room(400)
    assert few[1:] == many[1:] and few[4] == 8 * few[3] and few[3] > 200_000
    assert many[0] <= 3 * 402
    bytes_of = np.frombuffer(suffix_dedup._packed(np.arange(300, dtype=np.int64) * 1000 + 2**40), np.uint8).reshape(8, -1)
    assert (bytes_of[2:, 1:] == 0).all()


def test_suffixes_open_only_where_35_bytes_agree(spark):
    """A string of 20 to 34 bytes that texts share by chance sends none of their suffixes to the second sort."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, long = word(30), word(70)
    rows = [(i, word(200) + common + word(200)) for i in range(60)]
    edge = [(100 + i, word(100) + long + word(100)) for i in range(2)]
    found = lambda rows: suffix_dedup._settle(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "xxhash64(text) as th"),
                                              suffix_dedup._sampled(50, 20), 1, 1, True, 50, "ranks").filter("open is not null").select("doc_id").distinct()
    assert found(rows).count() == 0
    assert sorted(r["doc_id"] for r in found(edge).collect()) == [100, 101]


def test_without_duplicates_keeps_columns(spark, odd):
    out = suffix_dedup.without_duplicates(odd)
    assert out.columns == odd.columns
    want = sorted(((i, k.decode(errors="ignore") if t is not None else None) for (i, t), (*_, k) in
                   zip([r[:2] for r in odd_rows()], brute.suffix_dedup([r[:2] for r in odd_rows()]), strict=True)), key=str)
    assert table(out, "doc_id", "text") == want


def test_simhash_odd_rows(odd, none):
    want = sorted(brute.simhash_components([r[:2] for r in odd_rows()]), key=str)
    assert table(simhash.simhash_dedup(odd), "doc_id", "fingerprint", "component_id") == want
    assert table(simhash.simhash_dedup(none), "doc_id") == []


@pytest.mark.parametrize("hot", [1 << 15, 4])
def test_simhash_links_any_two_bits(spark, monkeypatch, hot):
    """Chains and balls of fingerprints, with groups cut into blocks and without."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        x = int(b)
        for _ in range(25):
            x ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            fps.add(x)
            fps.add(int(b) ^ 1 << int(rng.integers(64)) ^ 1 << int(rng.integers(64)))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, first long")
    got = {r["node"]: r["component"] for r in components(simhash.simhash_links(df)).collect()}
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if label[j] < label[i] and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                    label[i], changed = label[j], True
    assert [got.get(i, i) for i in range(len(fps))] == label


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
