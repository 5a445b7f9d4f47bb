"""Operator tests: scalable forms against naive twins, reference quirks, and
"""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from labelloop.functions import labels as L
from labelloop.functions import text as TX
from labelloop.functions import vectors as V
from labelloop.operators import annotate as A
from labelloop.operators import select as S
from labelloop.operators.retrieve import knn_topk


def _vectors(spark, n=300, d=8, seed=0, dup=False):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    if dup:
        m[1::3] = m[0]          # many exact duplicates -> similarity ties
    rows = [(i, int(i % 4), [float(x) for x in m[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, label int, embedding array<double>")


def _naive_knn(q, pool, k, group=None):
    """Test twin: cross join + cosine + window (what the scalable form avoids)."""
    j = q.select("id", F.col("embedding").alias("q")).crossJoin(
        pool.select("demo_id", F.col("embedding").alias("p"), *( [group] if group else [])))
    j = j.withColumn("sim", V.cosine("q", "p"))
    keys = ["id"] + ([group] if group else [])
    w = Window.partitionBy(*keys).orderBy(F.col("sim").desc(), F.col("demo_id"))
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
            .select(*keys, "rank", "demo_id")


@pytest.mark.parametrize("dup", [False, True])
def test_knn_equals_naive_twin(spark, dup):
    v = _vectors(spark, dup=dup)
    pool = v.filter("id < 60").select(F.col("id").alias("demo_id"), "embedding", "label")
    fast = knn_topk(v, pool, 5).select("id", "rank", "demo_id")
    slow = _naive_knn(v, pool, 5)
    assert sorted(fast.collect()) == sorted(slow.collect())


def test_knn_chunked_pool_equals_broadcast(spark):
    v = _vectors(spark)
    pool = v.select(F.col("id").alias("demo_id"), "embedding")
    one = knn_topk(v, pool, 7).select("id", "rank", "demo_id")
    chunked = knn_topk(v, pool, 7, max_broadcast_bytes=2000).select("id", "rank", "demo_id")
    assert sorted(one.collect()) == sorted(chunked.collect())


def test_knn_per_group_and_wide(spark):
    v = _vectors(spark)
    pool = v.filter("id < 80").select(F.col("id").alias("demo_id"), "embedding", "label")
    long = knn_topk(v, pool, 2, pool_group="label").select("id", "label", "rank", "demo_id")
    assert sorted(long.collect()) == sorted(_naive_knn(v, pool, 2, "label").collect())
    wide = knn_topk(v, pool, 2, pool_group="label", pool_label="label", wide=True)
    r = wide.filter("id = 5").first()
    assert len(r["demo_ids"]) == 8 and r["demo_labels"] == [0, 0, 1, 1, 2, 2, 3, 3]


def test_knn_exclude_self_and_partition_independence(spark):
    v = _vectors(spark)
    pool = v.select(F.col("id").alias("demo_id"), "embedding")
    with_self = knn_topk(v, pool, 1).filter("rank = 1")
    assert with_self.filter("id = demo_id").count() == v.count()        # quirk 15
    no_self = knn_topk(v, pool, 3, exclude_self=True)
    assert no_self.filter("id = demo_id").count() == 0
    a = knn_topk(v.repartition(1), pool, 3).collect()
    b = knn_topk(v.repartition(7), pool, 3).collect()
    assert sorted(a) == sorted(b)


def test_top_fraction_equals_window_twin_under_skew_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        cls = 0 if i < 1500 else int(i % 3)        # class 0 holds half of all rows
        conf = float(np.round(rng.normal(), 1))     # heavy ties
        rows.append((i, cls, conf, True))
    df = spark.createDataFrame(rows, "id bigint, pred int, conf double, matched boolean")
    fast = S.top_fraction(df, buckets=16).select("id").collect()
    slow = S.top_fraction_window(df).select("id").collect()
    assert sorted(fast) == sorted(slow)
    assert len(fast) == sum(int(n * 0.2) for n in (1500 + 500, 500, 500))


def test_top_fraction_skips_empty_cut(spark):
    df = spark.createDataFrame([(1, 0, 1.0, True), (2, 0, 2.0, True), (3, 1, 5.0, False)],
                               "id bigint, pred int, conf double, matched boolean")
    assert S.top_fraction(df).count() == 0          # int(2 * 0.2) == 0


def test_gmm_posterior_properties(spark):
    rng = np.random.default_rng(2)
    xs = np.concatenate([rng.normal(0.1, 0.05, 400), rng.normal(0.7, 0.1, 200)]).clip(0, 1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id bigint, x double")
    mix = S.fit_gmm(df)
    assert 1 <= mix.n_iter <= 10
    assert min(mix.means) < 0.3 < max(mix.means)
    out = S.clean_set(df)
    probs = [r["prob"] for r in out.collect()]
    assert all(0.0 <= p <= 1.0 for p in probs)
    assert out.filter("chosen").agg(F.max("x")).first()[0] < 0.5


def test_parse_answer_quirks(spark):
    rows = [("positive",), ("Negative.",), ("POSITIVE..",), (" negative",), ("",), ("neutral",), (None,)]
    df = spark.createDataFrame(rows, "raw string")
    got = [r[0] for r in df.select(L.parse_answer("raw", ("negative", "positive"))).collect()]
    assert got == [1, 0, -1, -1, -1, -1, -1]
    trimmed = [r[0] for r in df.select(L.parse_answer("raw", ("negative", "positive"), trim=True)).collect()]
    assert trimmed[3] == 0


def test_label_word_and_cast(spark):
    df = spark.createDataFrame([(0, "1"), (1, "x"), (1, " 7")], "c int, s string")
    r = df.select(L.label_word("c", ("negative", "positive")).alias("w"), L.cast_label("s").alias("n")).collect()
    assert [x["w"] for x in r] == ["negative", "positive", "positive"]
    assert [x["n"] for x in r] == [1, None, 7]


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 1), ([0.0, 0.0, 0.0], -1)], "z array<double>, y int")
    r = df.select(V.argmax("z").alias("a"), V.softmax("z").alias("p"), V.cross_entropy("z", "y").alias("ce"),
                  V.minmax_scale(F.lit(2.0), F.lit(1.0), F.lit(1.0)).alias("mm")).collect()
    assert r[0]["a"] == 1                                   # first maximum wins
    assert abs(sum(r[0]["p"]) - 1) < 1e-12
    assert r[1]["ce"] is None                               # label -1 never indexes the last element
    assert r[0]["mm"] == 0.0                                # constant range -> 0 (quirk 11)
    expect = math.log(math.exp(1) + 2 * math.exp(3)) - 3
    assert abs(r[0]["ce"] - expect) < 1e-12


def test_text_normalisation_and_arrow_pieces_agree(spark):
    import pyarrow as pa
    texts = ["  a b c  ", "Café naïve", "12, 3,4 x5,", "``q'' ok", "", "　", "tab\there"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    col = [r[0] for r in df.select(TX.word_pieces(TX.normalise("t"))).collect()]
    arrow = TX.arrow_pieces(pa.array(texts)).to_pylist()
    assert col == arrow
    assert col[0] == ["▁a", "▁b", "▁c"]
    assert col[1] == ["▁Cafe", "▁naive"]
    assert col[2] == ["▁12", ",", "▁3,4", "▁x5", ","]
    assert col[3] == ['▁"q"', "▁ok"]
    assert col[4] == [] and col[5] == []


def test_model_input_arrays(spark):
    df = spark.createDataFrame([([7, 8, 9], [5])], "a array<int>, b array<int>")
    r = df.select(TX.with_special_tokens("a", "b").alias("x"), TX.special_tokens_mask("a", "b").alias("m"),
                  TX.segment_ids("a", "b").alias("s"), TX.truncate_pad("a", 4).alias("t"),
                  TX.attention_mask("a", 4).alias("am"), TX.truncate_pad("a", 8).alias("t8")).first()
    assert r["x"] == [TX.CLS_ID, 7, 8, 9, TX.SEP_ID, 5, TX.SEP_ID]
    assert r["m"] == [1, 0, 0, 0, 1, 0, 1]
    assert r["s"] == [0, 0, 0, 0, 0, 1, 1]
    assert r["t"] == [TX.CLS_ID, 7, 8, TX.SEP_ID] and r["am"] == [1, 1, 1, 1]
    assert r["t8"] == [TX.CLS_ID, 7, 8, 9, TX.SEP_ID, 0, 0, 0]
    with pytest.raises(ValueError):
        TX.special_tokens_mask("a", "b", already_formatted=True)


def test_annotator_retry_and_failure(spark):
    from tests.doubles import FlakyAnnotator
    msgs = [[{"role": "assistant", "content": "class1"}, {"role": "user", "content": "x"}]]
    flaky = FlakyAnnotator(A.majority_answer_annotator, failures=2)
    answers, err = A.with_retry(flaky, retries=3, base_delay=0.0)(msgs)
    assert answers == ["class1"] and err is None
    always = FlakyAnnotator(A.majority_answer_annotator, failures=99)
    answers, err = A.with_retry(always, retries=1, base_delay=0.0)(msgs)
    assert answers == [None] and "rate limited" in str(err) and always.calls == 2
    final = FlakyAnnotator(A.majority_answer_annotator, failures=99, error=ValueError)   # not retryable: one call
    answers, err = A.with_retry(final, retries=5, base_delay=0.0)(msgs)
    assert answers == [None] and isinstance(err, ValueError) and final.calls == 1


def test_rate_ceiling_spaces_calls():
    import time
    times = []

    def noted(batch):
        times.append(time.monotonic())
        return [""] * len(batch)
    call = A.with_retry(A.RateCeiling(noted, 2, 0.2), retries=20, base_delay=0.01)
    for _ in range(6):
        assert call([[]])[1] is None
    assert all(b - a >= 0.19 for a, b in zip(times, times[2:], strict=False))


def test_majority_annotator_tie_goes_to_first_demo():
    msgs = [{"role": "assistant", "content": a} for a in ["b", "a", "a", "b"]]
    assert A.majority_answer_annotator([msgs]) == ["b"]
    assert A.majority_answer_annotator([[{"role": "user", "content": "x"}]]) == [""]


def test_trusted_override_and_need_annotation(spark):
    labels = spark.createDataFrame([(1, 0), (2, -1), (3, 1)], "id bigint, label int")
    trusted = spark.createDataFrame([(2,)], "id bigint")
    pseudo = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id bigint, pred int")
    out = {r["id"]: r["label"] for r in A.trusted_override(labels, trusted, pseudo).collect()}
    assert out == {1: 0, 2: 6, 3: 1}
    assert sorted(r[0] for r in A.need_annotation(labels.select("id"), trusted).collect()) == [1, 3]


def test_mixup_pairs_is_a_permutation_per_bucket(spark):
    from labelloop.operators.train import mixup_pairs
    df = spark.range(2500).withColumnRenamed("id", "id")
    p = mixup_pairs(df, bucket_rows=1000).collect()
    assert sorted(r["id"] for r in p) == list(range(2500))
    assert sorted(r["partner"] for r in p) == list(range(2500))
    by_id = {r["id"]: r["bucket"] for r in p}
    assert all(by_id[r["partner"]] == r["bucket"] for r in p)
    assert len({r["bucket"] for r in p}) == 3


def test_kmeans_caps_k_by_distinct_vectors(spark):
    from labelloop.operators.demos import kmeans_clusters
    rows = [(i, 0, [1.0, 0.0]) for i in range(5)] + [(10 + i, 1, [float(i), 1.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "id bigint, pred int, embedding array<double>")
    out = kmeans_clusters(df, 10, cls="pred").collect()
    assert {r["cluster"] for r in out if r["pred"] == 0} == {0}          # one distinct vector
    assert len({r["cluster"] for r in out if r["pred"] == 1}) == 3


def test_csv_ragged_scan_and_rejects(spark, tmp_path):
    from labelloop.sources.tables import read_labelled_csv
    p = tmp_path / "in.csv"
    p.write_text('1,"multi\nline text",para\nonly text\nx,bad label\n0,plain\n', encoding="utf-8")
    rows, rej = read_labelled_csv(spark, str(p), "train_chat")
    got = sorted(((r["label"] if r["label"] is not None else -9), r["text"], r["text_bt"]) for r in rows.collect())
    assert got == [(-9, "only text", None), (0, "plain", None), (1, "multi\nline text", "para")]
    assert rej.count() == 1
    rows2, _ = read_labelled_csv(spark, str(p), "train")
    assert rows2.filter("text_bt IS NOT NULL").count() == 0


def test_vocab_merge_and_gaps(spark):
    from labelloop.operators.tokenize import vocab_gaps, vocab_merge
    base = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, token_id int")
    added = spark.createDataFrame([("b", 3), ("d", 4)], "token string, token_id int")
    m = {r["token"]: r["token_id"] for r in vocab_merge(base, added).collect()}
    assert m == {"a": 0, "b": 3, "c": 2, "d": 4}
    gaps = vocab_gaps(vocab_merge(base, added)).collect()
    assert [(r["token"], r["expected"]) for r in gaps] == [("c", 1)]


def test_swap_pairs_paraphrase(spark):
    from labelloop.operators.augment import swap_pairs
    df = spark.createDataFrame([("a b c d e",), ("",), ("one",)], "t string")
    assert [r[0] for r in df.select(swap_pairs("t")).collect()] == ["b a d c e", "", "one"]


def test_unknown_learning_setting_raises(spark):
    from labelloop.plans.q_sources import evaluation_target
    df = spark.createDataFrame([(1, "train")], "id int, split string")
    with pytest.raises(ValueError):
        evaluation_target(df, "tranductive")       # quirk 1: the README typo


def test_knn_tolerates_null_and_ragged_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0, 5.0]), (4, [0.0, 1.0])]
    q = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    pool = spark.createDataFrame([(10, [1.0, 0.1]), (11, [0.0, 1.0])], "demo_id bigint, embedding array<double>")
    out = {r["id"]: r["demo_ids"] for r in knn_topk(q, pool, 1, wide=True).collect()}
    assert out == {1: [10], 2: [], 3: [], 4: [11]}


def test_rampup_weight():
    from labelloop.operators.train import rampup_weight
    assert [rampup_weight(e) for e in (0, 4, 10, 50)] == [0.0, 0.4, 1.0, 1.0]
    assert rampup_weight(3, 0) == 1.0


def test_selection_independent_of_partitioning(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 4)), float(np.round(rng.normal(), 2)), bool(rng.random() < 0.8))
            for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, pred int, conf double, matched boolean")
    a = sorted(r[0] for r in S.top_fraction(df.repartition(1)).select("id").collect())
    b = sorted(r[0] for r in S.top_fraction(df.repartition(13)).select("id").collect())
    assert a == b and len(a) > 0


def test_gmm_recovers_known_components(spark):
    rng = np.random.default_rng(9)
    xs = np.concatenate([rng.normal(0.2, 0.03, 3000), rng.normal(0.8, 0.03, 1000)])
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    mix = S.fit_gmm(df)
    lo, hi = sorted(mix.means)
    assert abs(lo - 0.2) < 0.01 and abs(hi - 0.8) < 0.01
    assert abs(mix.weights[mix.clean_component] - 0.75) < 0.01


def test_paraphraser_callable_batches_of_32(spark):
    from labelloop.operators.augment import augment
    sizes = []

    def upper(batch):
        sizes.append(len(batch))
        return [t.upper() for t in batch]
    rows = [(i, f"text {i}", None if i % 3 else f"kept {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, text string, text_bt string").coalesce(1)
    out = {r["id"]: r["text_bt"] for r in augment(df, paraphraser=upper).collect()}
    assert out[0] == "kept 0" and out[1] == "TEXT 1" and len(out) == 100


def test_encode_and_decode_by_broadcast_and_by_join(spark):
    """A vocabulary over the budget is joined: the same rows, also for repeated ids, empty and
    NULL texts, unknown pieces and a token that the vocabulary skips."""
    from labelloop.operators import tokenize as TK
    rows = [(1, "the cat, sat on 12, the mat"), (1, "the dog"), (2, ""), (3, None), (4, "zebra " * 40), (None, "the end"), (5, "1, 2, 3")]
    docs = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    vocab = TK.build_vocab(docs.filter("id < 4")).filter("token_id <> 7")
    for most in (8, 16, None):
        here, there = (TK.encode(docs, vocab, max_length=most, budget=b) for b in (1 << 20, 0))
        assert here.columns == there.columns
        assert sorted(map(str, here.collect())) == sorted(map(str, there.collect()))
        texts = [sorted(map(str, TK.decode(e, vocab, budget=b).collect())) for e in (here, there) for b in (1 << 20, 0)]
        assert texts[0] == texts[1] == texts[2] == texts[3] and len(texts[0]) == 7
    assert TK.encode(docs.filter("id > 9"), vocab).count() == 0
    assert "Exchange" not in here._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")


def test_large_vocabulary_moves_rare_pieces_only(spark):
    """Beyond the budget the frequent pieces are broadcast: the joins of encode, decode and id_to_token see
    the others, once for each batch, and the rows are those of a broadcast vocabulary."""
    from labelloop.operators import tokenize as TK
    rows = [(i, "the cat sat, on 12, mats " * 5 + f"rare{i} rare{i} {'new' if i % 7 else 'gone'}{i}") for i in range(300)] + [(None, None), (7, "")]
    docs = spark.createDataFrame(rows, "id bigint, text string").repartition(2)
    vocab = TK.build_vocab(docs).filter("token not like '%gone%'").localCheckpoint()
    seen, kept = [], TK.stored

    def spy(df, name):
        out = kept(df, name)
        seen.append(out.agg(F.sum(F.size("tail")).alias("n")).first()["n"])
        return out
    for most in (16, None):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(TK, "stored", spy)
            here, there = (TK.encode(docs, vocab, max_length=most, budget=b).localCheckpoint() for b in (1 << 20, 2_000))
            texts = [sorted(map(str, TK.decode(here, vocab, budget=b).collect())) for b in (1 << 20, 2_000, 0)]
        assert sorted(map(str, here.collect())) == sorted(map(str, there.collect()))
        assert texts[0] == texts[1] == texts[2]
    assert 0 < max(seen[:2] + seen[3:5]) < 700
    long = here.select("id", F.posexplode("input_ids").alias("pos", "token_id")).unionByName(spark.createDataFrame([(1, 0, None), (2, 0, 999_999)], "id bigint, pos int, token_id int"))
    assert len({tuple(sorted(map(str, TK.id_to_token(long, vocab, budget=b).select("id", "pos", "token_id", "token").collect()))) for b in (1 << 20, 2_000, 0)}) == 1
