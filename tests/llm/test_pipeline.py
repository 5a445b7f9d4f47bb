import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from labelloop.llm import kneser_ney
from labelloop.llm.bpe import ranks_of
from labelloop.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.conftest import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id long, __id int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(20)
    items = [(i, " ".join(f"b{rng.randint(0, 999)}" for _ in range(20))) for i in range(5)]
    texts = [prose(rng, rng.randint(30, 90)) for _ in range(330)]
    texts += [t + " end" for t in texts[:10]] + texts[10:20] + [texts[20][:150] + " " + prose(rng, 40)]
    texts += [prose(rng, 10) + " " + items[i][1] + " " + prose(rng, 30) for i in range(5)]
    texts += ["".join(rng.choice("#$%&QXZ 0123") for _ in range(300)) for _ in range(8)] + [None, "", "é" * 40]
    rows = [(2 * i + 1, t, "en" if i % 3 else "de", None, None if t is None else len(t), "x", 1, 2) for i, t in enumerate(texts)]
    rows.append((None, texts[0], None, None, None, None, None, None))
    rows.append(rows[3])
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:320]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, items


def brute_run(spark, path, rows, items):
    scores = kneser_ney.quality_scores(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")).collect()
    kept = {r["doc_id"] for r in scores if r["kept"]}
    docs = [r[:2] for r in rows if r[0] in kept]
    component = {i: c for i, _, c in brute.simhash_components(docs)}
    near, seen = [], set()
    for i, t in docs:
        if i is None or (component[i] == i and i not in seen):
            near.append((i, t))
            seen.add(i)
    cut = [(r[0], r[5].decode(errors="ignore")) for r in brute.suffix_dedup(near)]
    bad = {i for i, t in cut if brute.contaminated(t, [x for _, x in items])}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(f.read()), special_tokens={})
    out = []
    for i, t in cut:
        if i not in bad:
            ids = np.array(enc.encode_ordinary(t), "<u4").tobytes()
            out.append((i, len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_pipeline_is_the_chain_of_its_stages(spark, folder):
    path, rows, items = folder
    got = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in corpus_pipeline.run(spark, path).collect()]
    want = brute_run(spark, path, rows, items)
    assert sorted(got, key=str) == sorted(want, key=str)
    clean = {r[0] for r in rows[:320]}
    assert len({g[0] for g in got} & clean) > 300


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).collect() == []


def test_clean_documents_stay_and_bad_ones_go(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, path).collect()}
    junk = {r[0] for r in rows if r[1] and r[1].count("#") > 5}
    assert len(junk) == 8 and not junk & kept
    assert len(kept & {r[0] for r in rows[:351]}) >= 345
    clean = {r["doc_id"] for r in corpus_pipeline.decontamination_stage(spark, docs, path).collect()}
    assert len({r[0] for r in rows}) - len(clean) == 5 and clean >= {r[0] for r in rows[:351]}


def test_one_row_of_an_id_stays_whatever_the_partitions(spark):
    rows = [(i % 5, f"text number {i} of its own kind with words {i * i} {i + 7}", "en", f"s{i}", i) for i in range(40)] + [(None, "x y z", None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [sorted(map(tuple, corpus_pipeline.near_dedup_stage(spark, docs.repartition(n), "").collect()), key=str) for n in (1, 7)]
    assert kept[0] == kept[1] and len(kept[0]) == 7 and {r[0] for r in kept[0]} == {0, 1, 2, 3, 4, None}
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "").columns == docs.columns


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_removed_ids_by_broadcast_and_by_shuffle(spark, monkeypatch, bound):
    monkeypatch.setattr(corpus_pipeline, "MAX_BROADCAST_IDS", bound)
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e"), (None, "f")], "doc_id int, removed_id string")
    for gone, left in (([1], "cdef"), ([None, 2], "abe"), ([], "abcdef"), ([7, 1, 1], "cdef")):
        ids = spark.createDataFrame([(i,) for i in gone], "doc_id long")
        assert sorted(r["removed_id"] for r in corpus_pipeline._without(docs, ids).collect()) == sorted(left)


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_the_last_stage_runs_one_python_function_at_a_time(spark, odd):
    """Encode and decode in one stage kept two Python workers for each core of an executor."""
    out = corpus_pipeline.byte_bpe_stage(spark, odd, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    ids = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    strings = {i: s for s, i in ranks_of(open(ids, "rb").read()).items()}
    rows = out.collect()
    got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows)
    want = []
    for r in odd.collect():
        text = (r["text"] or "").encode()
        row = next(x for x in rows if x["decoded_sha256"] == hashlib.sha256(text).hexdigest())
        assert b"".join(strings[i] for i in np.frombuffer(row["ids"], "<u4").tolist()) == text
        want.append((row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]))
    assert got == sorted(want)
