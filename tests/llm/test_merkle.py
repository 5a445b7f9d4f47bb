import random

import pytest
from pyspark.sql import functions as F

from labelloop.llm import merkle, queries
from tests.conftest import SF001
from tests.llm import brute
from tests.llm.conftest import odd_rows, prose, table

FIELDS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def presented():
    return {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


def plain(df):
    return brute.merkle([tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()])


def test_odd_rows(odd, none):
    assert table(merkle.merkle_manifest(odd, presented()), *FIELDS) == sorted(plain(odd), key=str)
    assert table(merkle.merkle_manifest(none, presented()), *FIELDS) == []


@pytest.mark.parametrize("height", [1, 2, 3])
def test_trees_of_many_small_blocks(spark, height):
    """Groups of all sizes around powers of two, more groups than a block, lone last nodes."""
    rng = random.Random(height)
    rows, at = [], 0
    for k, n in enumerate((1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33, 1)):
        for _ in range(n):
            at += rng.randint(1, 3)
            rows.append((at, "s", None if k == 11 else f"é{k}", rng.choice((None, 3, 40)), prose(rng, 3)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    out = merkle.merkle_manifest(docs, presented(), height=height)
    assert table(out, *FIELDS) == sorted(brute.merkle(rows), key=str)


def test_one_leaf_and_one_group(spark):
    for n in (1, 2, 3):
        rows = [(i, None, "en", 1, "x") for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
        assert table(merkle.merkle_manifest(docs, presented()), *FIELDS) == sorted(brute.merkle(rows), key=str)


def test_versions_share_untouched_nodes():
    leaves = [brute.hashlib.sha256(bytes([i])).hexdigest() for i in range(13)]
    root = merkle.Version.of(leaves, 4)

    def nodes(node):
        return {} if node is None else {id(node): node} | nodes(node[1]) | nodes(node[2])
    old = nodes(root)
    for at in range(13):
        new = merkle.Version.changed(root, 4, at, "0" * 64)
        assert len(nodes(new).keys() - old.keys()) == 5  # the leaf and its four ancestors
        again = merkle.Version.of([*leaves[:at], "0" * 64, *leaves[at + 1:]], 4)
        assert new == again and root == merkle.Version.of(leaves, 4)
        path = merkle.Version.siblings(root, 4, at)
        assert merkle.folded(leaves[at], path) == root[0] and merkle.folded("0" * 64, merkle.unpacked(merkle.packed(path))) == new[0]


def test_test_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = sorted((tuple(r) for r in queries.QUERIES["op12_merkle_manifest"](spark, SF001).collect()), key=str)
    assert rows == sorted(plain(docs), key=str)
    out = merkle.merkle_manifest(docs, presented()).filter("not verified")
    assert out.count() == sum(not r[-1] for r in rows) > 50
    assert out.filter("n_copied < 8").count() == 0
