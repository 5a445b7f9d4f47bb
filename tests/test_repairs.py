"""Results that no oracle on the fixtures reaches: empty inputs, tied and large ids, absent classes,
failing annotators, pools over the budget, several feedback rounds, independent draws."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelloop.functions.batches import small
from labelloop.functions.vectors import hash_unit
from labelloop.operators import annotate as AN
from labelloop.operators import demos as DE
from labelloop.operators import retrieve as RE
from labelloop.operators import select as SE
from labelloop.operators import tokenize as TK
from labelloop.operators import train as TR
from labelloop.operators.prompt import generic_task
from labelloop.operators.score import ABSENT, centroid_head, score
from labelloop.plans import rounds as RO
from labelloop.sources import tables as TA


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(1)
    pool = [(i, i % 3, rng.normal(size=5).tolist(), f"text {i}") for i in range(40)]
    queries = [(100 + i, rng.normal(size=5).tolist(), f"q {i}") for i in range(6)] + [(200, None, "no vector")]
    return (spark.createDataFrame(queries, "id bigint, embedding array<double>, text string"),
            spark.createDataFrame(pool, "demo_id bigint, anno int, embedding array<double>, text string"))


@pytest.mark.parametrize("wide", [True, False])
def test_pool_over_the_budget_gives_the_same_rows(space, wide):
    queries, pool = space
    kw = dict(query_id="id", pool_label="anno", wide=wide) | (dict(keep=("text",), pool_text="text") if wide else {})
    small = RE.knn_topk(queries, pool, 4, **kw)
    for budget in (64 * 20, 64 * 7):
        big = RE.knn_topk(queries, pool, 4, max_broadcast_bytes=budget, **kw)
        assert big.columns == small.columns
        assert sorted(map(str, big.collect())) == sorted(map(str, small.collect()))
    if wide:
        assert small.count() == 7 and small.filter("id = 200").first()["demo_ids"] == []


def test_empty_pool_keeps_every_query(space):
    queries, pool = space
    none = pool.limit(0)
    wide = RE.knn_topk(queries, none, 4, query_id="id", pool_label="anno", wide=True, keep=("text",), pool_text="text")
    assert wide.count() == 7 and all(r["demo_ids"] == [] and r["demo_texts"] == [] for r in wide.collect())
    assert RE.knn_topk(queries, none, 4, query_id="id").collect() == []
    labels = RO.initial_round(queries, none, generic_task(3))
    assert labels.count() == 7 and {r["label"] for r in labels.collect()} == {-1}


def test_attach_demos_keeps_order_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [5, 9, 7], "a"), (2, [], "b"), (3, [5, 5], "c")], "id bigint, demo_ids array<bigint>, text string")
    corpus = spark.createDataFrame([(5, "five"), (7, "seven"), (8, "eight")], "id bigint, text string")
    got = {r["id"]: (r["text"], r["demo_texts"]) for r in RE.attach_demos(rows, corpus, ("text",)).collect()}
    assert got == {1: ("a", ["five", None, "seven"]), 2: ("b", []), 3: ("c", ["five", "five"])}


def test_attach_demos_near_and_far_are_the_same_rows(spark):
    """Representatives within the budget are not shuffled; NULL lists, ids and texts, repeated corpus ids."""
    rows = spark.createDataFrame([(1, [5, 9, 7], "a"), (2, [], "b"), (3, [5, None, 5], "c"), (4, None, None)], "id bigint, demo_ids array<bigint>, text string")
    corpus = spark.createDataFrame([(5, "five" * 50, 1), (7, None, 2), (8, "eight", None)], "id bigint, text string, label bigint")
    for side in (corpus, corpus.limit(0)):
        near, far = (RE.attach_demos(rows, side, ("text", "label"), budget=b) for b in (1 << 20, -1))
        assert near.columns == far.columns and "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, near.collect())) == sorted(map(str, far.collect()))
    twice = corpus.union(corpus.filter("id = 8"))
    assert len(RE.attach_demos(rows, twice, ("text",)).collect()) == 4


def test_demo_texts_leave_in_small_batches(spark):
    """A batch of 10,000 rows with ten long demos each is given back in pieces of a few megabytes."""
    pool = spark.createDataFrame([(i, 0, [1.0, i / 10], "x" * 60_000) for i in range(10)], "demo_id bigint, anno int, embedding array<double>, text string")
    queries = spark.range(120).select("id", F.array(F.lit(1.0), F.rand(3)).alias("embedding")).coalesce(1)
    sizes, make = [], type(queries).mapInArrow

    def spy(df, run, schema, *a, **kw):
        sizes.extend((x.num_rows, x.nbytes) for x in run(iter(df.toArrow().combine_chunks().to_batches())))
        return make(df, run, schema, *a, **kw)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(queries), "mapInArrow", spy)
        RE.knn_topk(queries, pool, 10, pool_label="anno", pool_text="text", wide=True)
    assert sum(n for n, _ in sizes) == 120 and max(n for _, n in sizes) <= 8 << 20


def test_feedback_rounds_do_not_delete_each_other(spark, tmp_path):
    def fb(n):
        return RO.Feedback(spark.range(n), spark.range(n).select("id", F.array("id").alias("demo_ids")), spark.range(n).select("id", F.lit(1).alias("pred")))
    for r, n in ((1, 3), (2, 5), (2, 4)):
        RO.write_feedback(fb(n), str(tmp_path), r)
    assert [RO.read_feedback(spark, str(tmp_path), r).trusted.count() for r in (1, 2)] == [3, 4]


@pytest.mark.parametrize("start", [0, 2**53 + 1, 2**62, -(2**63)])
def test_top_fraction_with_tied_large_ids(spark, start):
    rows = [(start + i, 0, 1.0, True) for i in range(300)] + [(start + 500 + i, 1, float(i % 2), True) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, pred int, conf double, matched boolean")
    assert sorted(map(tuple, SE.top_fraction(df).select("id", "pred", "conf").collect())) == sorted(map(tuple, SE.top_fraction_window(df).select("id", "pred", "conf").collect()))


def test_absent_classes_never_win(spark):
    df = spark.createDataFrame([(1, 0, [-1.0, -2.0]), (2, 2, [-2.0, -1.0])], "id bigint, anno int, embedding array<double>")
    head = centroid_head(df, 4)
    logits = [r["logits"] for r in score(spark.createDataFrame([(9, [1.0, 1.0])], "id bigint, embedding array<double>"), head).collect()]
    assert int(np.argmax(logits[0])) in (0, 2) and logits[0][1] == logits[0][3] == ABSENT
    rows = spark.createDataFrame([("ce", i, [float(i), 1.0], i % 2, 1.0) for i in range(6)], "kind string, id bigint, features array<double>, target int, weight double")
    fitted = TR.fit_head(rows, 4)
    p = np.exp(fitted.bias - fitted.bias.max())
    assert p[2] == p[3] == 0


def test_empty_inputs_select_nothing(spark):
    scaled = spark.createDataFrame([(1, None), (2, None)], "id bigint, x double")
    assert SE.fit_gmm(scaled) is None
    assert [r["chosen"] for r in SE.clean_set(scaled).collect()] == [False, False]
    rows = spark.createDataFrame([], "id bigint, pred int, embedding array<double>")
    assert DE.representatives(rows, 3).collect() == []
    schema = "id bigint, label int, embedding array<double>, embedding_bt array<double>, p array<double>, p_bt array<double>, chosen boolean, valid boolean"
    assert TR.softlabel_rows(spark.createDataFrame([], schema), 3, epoch=1).collect() == []
    scored = spark.createDataFrame([(1, 0, 0.5, False, [1.0])], "id bigint, pred int, conf double, matched boolean, embedding array<double>")
    fb = RO.emit_feedback(scored, 2)
    assert fb.trusted.count() == 0 and [r["demo_ids"] for r in fb.demos.collect()] == [[]]


def test_kmeans_from_fixed_centres_is_lloyd(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.4, (30, 2)) for c in (0, 3, 6)])
    rows = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id bigint, pred int, embedding array<double>")
    centres = {(c, j): x[2 * j + c] for c in range(2) for j in range(3)}
    start = spark.createDataFrame([(c, j, v.tolist()) for (c, j), v in centres.items()], "pred int, cluster int, centroid array<double>")
    got = {r["id"]: r["cluster"] for r in DE.kmeans_clusters(rows, 3, start=start, max_iter=5, tol=0.0).collect()}
    for c in range(2):
        own, m = np.arange(c, 90, 2), np.array([centres[c, j] for j in range(3)])
        for _ in range(5):
            near = np.linalg.norm(x[own][:, None] - m[None], axis=2).argmin(axis=1)
            m = np.array([x[own][near == j].mean(axis=0) if (near == j).any() else m[j] * np.nan for j in range(3)])
            m = np.nan_to_num(m, nan=1e9)
        near = np.linalg.norm(x[own][:, None] - m[None], axis=2).argmin(axis=1)
        assert [got[i] for i in own] == near.tolist()


def test_failed_calls_are_no_labels(spark):
    def broken(batch):
        raise OSError("no network")

    prompts = spark.createDataFrame([(1, [("user", "x")])], "id bigint, messages array<struct<role:string,content:string>>")
    with pytest.raises(Exception, match="annotator failed"):
        AN.annotate(prompts, broken).collect()
    kept = AN.parse_labels(AN.annotate(prompts, broken, on_error="keep"), ["no", "yes"]).first()
    assert kept["label"] is None and "no network" in kept["error"]


def test_draws_are_independent(spark):
    n = 20_000
    u = np.array(spark.range(n).select(*(hash_unit("id", s).alias(f"u{s}") for s in (1, 2, 3))).collect())
    assert (0 < u).all() and (u < 1).all() and len(np.unique(u[:, 0])) == n
    assert np.abs(np.corrcoef(u.T) - np.eye(3)).max() < 0.03 and np.abs(u.mean(axis=0) - 0.5).max() < 0.01
    b = np.array(spark.range(n).select(TR.minibatch_bucket("id", 1, n), TR.minibatch_bucket("id", 2, n)).collect())
    pairs = [(i, j) for k in range(200) for i in [*np.flatnonzero(b[:, 0] == k)] for j in [*np.flatnonzero(b[:, 0] == k)] if i < j]
    together = np.mean([b[i, 1] == b[j, 1] for i, j in pairs])
    assert together < 0.01
    lam = np.array([r[0] for r in spark.range(n).select(TR.mix_lambda("id")).collect()])
    # |l - 1/2| of Beta(4, 4): variance 1/36 about 1/2, mean deviation 35/256
    assert abs(np.mean((lam - 0.5) ** 2) - 1 / 36) < 0.001 and abs(np.mean(lam) - 0.5 - 35 / 256) < 0.003


def test_partners_change_with_the_seed(spark):
    clean = spark.range(400).select("id")
    a, b = ({r["id"]: r["partner"] for r in TR.mixup_pairs(clean, seed=s).collect()} for s in (1, 2_000_001))
    assert sorted(a) == sorted(a.values()) == sorted(b.values())
    following = {x: y for x, y in a.items()}
    assert np.mean([following[x] == b[x] for x in b]) < 0.05 and not math.isnan(sum(a.values()))


def test_ragged_csv_with_empty_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,\nabc\n2,text\n1,,x\n"a,b"\n"x,"\n0,"multi\nline"\n1,"q ""z"" w",\n')
    rows, rejects = TA.read_labelled_csv(spark, str(tmp_path), "train_chat")
    got = [(r["label"], r["text"], r["text_bt"]) for r in rows.collect()]
    assert got == [(1, "", None), (None, "abc", None), (2, "text", None), (1, "", "x"), (None, "a,b", None), (None, "x,", None), (0, "multi\nline", None), (1, 'q "z" w', "")]
    assert rejects.count() == 0


def test_vocabulary_is_whole_and_survives_files(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"w{i} w{i % 7} the 3,") for i in range(300)] + [(900, ""), (901, None)], "id bigint, text string")
    vocab = TK.build_vocab(texts)
    ids = sorted(r["token_id"] for r in vocab.collect())
    assert ids == list(range(len(ids))) and len(ids) > 300
    TA.write_vocab(vocab.repartition(4), str(tmp_path / "v"))
    back = TA.read_vocab(spark, str(tmp_path / "v"))
    assert sorted(map(tuple, back.collect())) == sorted((r["token"], r["token_id"]) for r in vocab.collect())
    enc = TK.encode(texts, vocab, max_length=8)
    assert enc.count() == 302 and enc.filter(F.array_contains("input_ids", TK.UNK_ID)).count() == 0
    text = {r["id"]: r["text"] for r in TK.decode(enc, vocab).collect()}
    assert text[12] == "w12 w5 the 3," and text[900] == "" and len(text) == 302


def test_merge_labels_asserts_counts(spark):
    table = spark.range(4)
    labels = spark.range(4).select("id", F.lit(1).alias("label"))
    assert RO.merge_labels(table, labels).count() == 4
    with pytest.raises(ValueError):
        RO.merge_labels(table, labels.filter("id > 0"))


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Vocabulary: 1,000 rows at once, whatever the session says, which keeps its setting."""
    def checked(batch, *limit):
        assert batch.num_rows <= 1000, batch.num_rows
        return small(batch, *limit)
    monkeypatch.setattr(TK, "small", checked)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    texts = spark.range(0, 2500 * spark.sparkContext.defaultParallelism, 1).selectExpr("'a b' AS text")
    assert sorted((r["token"], r["count"]) for r in TK.build_vocab(texts).collect() if r["count"]) == [("▁a", texts.count()), ("▁b", texts.count())]
    assert spark.conf.get(key) == old


def test_pieces_of_long_texts_are_looked_up_in_parts(spark):
    """A batch of long texts is cut by bytes, so that what one look-up holds has a bound."""
    vocab = (pa.array(["▁a", "▁b"]), np.array([7, 9]))

    def numbers(batches):
        for at, ids, codes, unknown, keep, lens in TK._coded(batches, vocab, False, None):
            assert codes.tolist() == [7, 9, -1] * (len(codes) // 3) and unknown.to_pylist() == ["▁c"] and keep.sum() == len(codes)
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([len(ids)])], ["at", "n"])
    rows = spark.range(0, 6, 1, 1).selectExpr("id", "repeat('a b c ', 700000) AS text").mapInArrow(numbers, "at bigint, n bigint").collect()
    assert sum(r["n"] for r in rows) == 6 and len({r["at"] for r in rows}) > 2


def test_a_lookup_holds_no_table_of_the_vocabulary():
    tokens = pa.array([f"piece{i}" for i in range(1_000_000)])
    some = pa.array(["piece999999", "none", "piece0", "piece524288"])
    ids = np.arange(1_000_000) * 3
    default = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(default)
    pa.set_memory_pool(pool)
    try:
        got = TK._looked_up(some, tokens, ids)
    finally:
        pa.set_memory_pool(default)
    assert got.tolist() == [999_999 * 3, -1, 0, 524_288 * 3] and pool.max_memory() < tokens.nbytes / 4
