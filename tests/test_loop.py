"""Commits, paid answers, the annotation log, the loop's restart, the run order, seeding and pools in blocks."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloop.operators import annotate as A
from labelloop.operators import demos as DE
from labelloop.operators import retrieve as RE
from labelloop.operators.answers import AnnotationLog, AnswerStore
from labelloop.operators.prompt import generic_task
from labelloop.operators.score import LinearHead, centroid_head
from labelloop.plans.loop import Loop, outer_loop
from labelloop.plans.rounds import Feedback, initial_round, refinery_round
from labelloop.plans.run import Run
from labelloop.sources.commits import Commits, fingerprint
from labelloop.sources.tables import cached
from tests.doubles import Counted

MESSAGES = "id bigint, messages array<struct<role:string,content:string>>"


def prompts(spark, n=30, parts=3):
    rows = [(i, [("assistant", f"class{i % 3}"), ("user", f"text {i}"), ("user", "which?")]) for i in range(n)]
    return spark.createDataFrame(rows, MESSAGES).repartition(parts, "id")


def test_commits_point_at_whole_data(spark, tmp_path):
    c = Commits(spark, str(tmp_path))
    made = []

    def make():
        made.append(1)
        return spark.range(len(made) * 2)
    assert c.steps() == {}
    assert c.table("a/1", make).count() == 2 and c.table("a/1", make).count() == 2 and len(made) == 1
    lost = c.attempt("b")                      # an attempt that was killed before its record
    spark.range(3).write.parquet(lost)
    assert "b" not in c.steps() and c.table("b", make).count() == 4
    late = c.attempt("b")                      # a second attempt that ends later: the first one counts
    spark.range(9).write.parquet(late)
    c.commit("b", late)
    assert c.table("b", make).count() == 4 and c.steps(latest=True)["b"] == late
    with pytest.raises(ZeroDivisionError):
        c.table("d", lambda: 1 / 0)
    assert list(c.steps()) == ["a/1", "b"]


def test_cache_follows_its_input(spark, tmp_path):
    src, root, calls = str(tmp_path / "in"), str(tmp_path / "cache"), []
    spark.range(5).write.parquet(src)

    def get(**kw):
        df = spark.read.parquet(src)
        return cached(spark, root, {"mode": "x"}, df, lambda: calls.append(1) or df.selectExpr("id * 2 AS v"), **kw)
    assert get().count() == 5 and get().count() == 5 and len(calls) == 1
    before = fingerprint(spark.read.parquet(src))
    spark.range(7).write.mode("append").parquet(src)
    assert fingerprint(spark.read.parquet(src)) != before
    assert get().count() == 12 and len(calls) == 2
    assert get(overwrite=True).count() == 12 and len(calls) == 3
    assert fingerprint(spark.range(3)) == fingerprint(spark.range(4))   # no files: the schema only


def test_a_killed_task_pays_no_answer_twice(spark, tmp_path):
    folder = tmp_path / "paid"
    folder.mkdir()
    store = AnswerStore(str(tmp_path / "answers"), 1)
    df = prompts(spark, 30, 1)
    with pytest.raises(Exception, match="annotator failed"):
        A.annotate(df, Counted(folder, dies_after=2), batch_size=5, store=store).collect()
    assert len(Counted.paid(folder)) == 10
    got = A.annotate(df.repartition(4), Counted(folder), batch_size=7, store=store).collect()   # cut in another way
    want = {r["id"]: r["raw"] for r in A.annotate(df).collect()}
    assert {r["id"]: r["raw"] for r in got} == want and len(got) == 30
    assert Counted.paid(folder) == sorted(f"text {i}" for i in range(30))
    again = A.annotate(df, Counted(folder), store=store).collect()
    assert len(again) == 30 and len(Counted.paid(folder)) == 30
    other = A.annotate(df, Counted(folder), store=AnswerStore(str(tmp_path / "answers"), 2)).collect()
    assert len(other) == 30 and len(Counted.paid(folder)) == 60                                  # another round pays
    changed = df.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit("!")).alias("content"))))
    assert all(r["raw"].endswith("!") for r in A.annotate(changed, Counted(folder), store=store).collect())   # another prompt pays


def test_a_retried_task_reads_its_own_folder(spark, tmp_path):
    """Two actions of one plan: the second finds what the tasks of the first have written."""
    folder = tmp_path / "paid"
    folder.mkdir()
    plan = A.annotate(prompts(spark, 20, 2), Counted(folder), batch_size=4, store=AnswerStore(str(tmp_path / "answers")))
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, plan.collect()))
    assert len(Counted.paid(folder)) == 20


def test_failed_rows_are_not_stored(spark, tmp_path):
    def broken(batch):
        raise OSError("no network")
    store = AnswerStore(str(tmp_path / "answers"))
    kept = A.annotate(prompts(spark), broken, on_error="keep", store=store).collect()
    assert all(r["raw"] is None and "no network" in r["error"] for r in kept)
    assert all(r["error"] is None for r in A.annotate(prompts(spark), store=store).collect())
    short = A.annotate(prompts(spark), lambda b: ["x"], on_error="keep").collect()
    assert all("30 prompts" in r["error"] or "answers" in r["error"] for r in short)


def corpus_of(spark, n=40):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        c = i % 2
        v = (rng.normal(size=4) * 0.2 + (np.array([1, 0, 0, 1]) if c else np.array([0, 1, 1, 0]))).tolist()
        words = ("good fine nice" if c else "bad poor sad").split()
        rows.append((i, " ".join(rng.choice(words, 6)), None if i % 13 == 7 else v, c))
    return spark.createDataFrame(rows, "id bigint, text string, embedding array<double>, gold int")


def pool_of(corpus):
    return corpus.filter("id < 12 and embedding is not null").select(F.col("id").alias("demo_id"), F.col("gold").alias("anno"), "embedding", "text")


class Killed(Exception):
    pass


def test_the_loop_goes_on_after_any_step(spark, tmp_path):
    corpus, task = corpus_of(spark), generic_task(2)
    dev = corpus.select("gold", "text")
    kw = {"dev": dev, "epochs_per_round": 1, "max_iter": 8, "clusterer": DE.fixed_clusters}
    folder = tmp_path / "whole"
    folder.mkdir()
    whole = str(tmp_path / "loop0")
    want = sorted(map(tuple, outer_loop(spark, corpus, pool_of(corpus), 2, task, root=whole, annotator=Counted(folder), **kw).collect()))
    steps = list(Commits(spark, f"{whole}/steps").steps())
    assert {"labels/0", "views", "train/1", "dev", "head/1/1", "eval/1/1", "trusted/1", "demos/1", "pseudo/1", "labels/1"} == set(steps)
    paid = Counted.paid(folder)
    assert len(want) == 40 and len(paid) >= 40
    root, folder = str(tmp_path / "loop1"), tmp_path / "killed"
    folder.mkdir()
    real = Commits.commit
    kills, seen = 0, set()
    while True:      # killed right before the record of every step, once each
        died: list = []

        def commit(self, step, path, died=died):
            if step not in seen and not died:
                seen.add(step)
                died.append(step)
                raise Killed(step)
            real(self, step, path)
        Commits.commit = commit
        try:
            got = sorted(map(tuple, outer_loop(spark, corpus, pool_of(corpus), 2, task, root=root, annotator=Counted(folder), **kw).collect()))
            break
        except Killed:
            kills += 1
        finally:
            Commits.commit = real
    assert kills >= 10 and got == want
    assert Counted.paid(folder) == paid       # nothing was paid for twice
    evals = Loop(spark, root, corpus, pool_of(corpus), task, **kw).evaluations().collect()
    assert {(r["round"], r["epoch"], r["key"]) for r in evals} == {(1, 1, "eval_accuracy"), (1, 1, "eval_n")}


def test_log_is_written_once(spark, tmp_path):
    corpus, task = corpus_of(spark, 20), generic_task(2)
    log = AnnotationLog(spark, str(tmp_path))
    assert log.read() is None
    first = initial_round(corpus, pool_of(corpus), task, log=log, round_no=0).collect()
    folder = tmp_path / "paid"
    folder.mkdir()
    second = initial_round(corpus, pool_of(corpus), task, Counted(folder), log=log, round_no=0).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, second)) and not os.listdir(folder)
    fb = Feedback(corpus.filter("id < 5").select("id"), corpus.select("id", F.array(F.lit(1), F.lit(2)).cast("array<bigint>").alias("demo_ids")), corpus.select("id", F.col("gold").alias("pred")))
    out = refinery_round(corpus.select("id", "text"), fb, task, log=log, round_no=1)
    assert out.count() == 20 and out.count() == 20
    rows = log.read().collect()
    assert len(rows) == 35 and {r["round"] for r in rows} == {0, 1}
    assert all(corpus_text in r["sentence"] for r in rows if r["round"] == 0
               for corpus_text in [next(c["text"] for c in corpus.collect() if c["id"] == r["id"])] if r["id"] < 3)


def test_run_order(spark, tmp_path):
    c = corpus_of(spark).filter("embedding is not null")
    splits = c.select(F.when(F.floor(F.col("id") / 2) % 4 == 0, "dev").when(F.floor(F.col("id") / 2) % 4 == 1, "test").otherwise("train").alias("split"), "id", F.col("gold").alias("label"), "embedding")
    trained = []

    def trainer(rows):
        trained.append(1)
        return centroid_head(rows, 2, label_col="label")
    run = Run(spark, str(tmp_path), splits, trainer, LinearHead(np.zeros((2, 4)), np.zeros(2)))
    assert run() == {} and run.complete() == []
    early = {r["key"]: r["value"] for r in run(do_eval=True)["eval"].collect()}
    assert run.complete() == ["eval"] and set(run(do_train=True)) == {"train"} and run.complete() == ["train", "eval"]
    late = run(do_train=True, do_eval=True, do_predict=True)
    assert len(trained) == 1 and run.complete() == ["train", "eval", "predict"]
    values = {r["key"]: r["value"] for r in late["eval"].collect()}
    assert float(values["eval_accuracy"]) > float(early["eval_accuracy"])   # not the initial head's report
    assert late["predict"].count() == splits.filter("split = 'test'").count()


def test_kmeans_seeding_has_small_inertia(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 3)) * 12
    x = np.concatenate([c + rng.normal(size=(25, 3)) for c in centres])
    rows = spark.createDataFrame([(i, i // 150, v.tolist()) for i, v in enumerate(x)], "id bigint, pred int, embedding array<double>")
    best = {p: sum(((x[a:a + 25] - x[a:a + 25].mean(axis=0)) ** 2).sum() for a in range(150 * p, 150 * p + 150, 25)) for p in range(2)}
    for seed in range(3):
        got = {r["pred"]: r["inertia"] for r in DE.inertia(DE.kmeans_clusters(rows, 6, seed=seed)).collect()}
        assert all(got[p] <= 1.05 * best[p] for p in best)
        start = DE.seeded_centres(rows, 6, seed=seed)
        assert start == DE.seeded_centres(rows.repartition(7), 6, seed=seed) and len(start) == 12
    few = spark.createDataFrame([(i, 0, [float(i % 2), 1.0]) for i in range(9)], "id bigint, pred int, embedding array<double>")
    assert len(DE.seeded_centres(few, 6)) == 2
    assert DE.seeded_centres(few.filter("id < 0"), 6) == {} and DE.kmeans_clusters(few.filter("id < 0"), 3).count() == 0


def test_seeding_needs_no_window(spark):
    import contextlib
    import io
    rows = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(50)], "id bigint, pred int, embedding array<double>")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        DE.kmeans_clusters(rows, 3).explain()
    assert "Window" not in out.getvalue()


@pytest.mark.parametrize("wide", [False, True])
def test_prepared_pool_of_any_size(spark, wide):
    corpus = corpus_of(spark)
    pool = pool_of(corpus)
    kw = {"pool_label": "anno"} | ({"pool_text": "text"} if wide else {})
    small, large = RE.PreparedPool(pool, **kw), RE.PreparedPool(pool, max_broadcast_bytes=120, **kw)
    assert small.blocks is None and large.blocks.n > 2
    how = {"wide": True, "keep": ("text",)} if wide else {}
    a, b = (sorted(map(str, RE.knn_topk(corpus, p, 4, **how).collect())) for p in (small, large))
    assert a == b
    small.release(), large.release()


def full_scan(spark, queries, pool, k, **kw):
    return sorted(map(tuple, RE.knn_topk(queries, pool, k, **kw).select("id", "rank", "demo_id", "demo_label", "sim").collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_pruned_search_equals_the_full_scan(spark, monkeypatch, small):
    """Clusters and ties, NULL and zero vectors on both sides, blocks and parts of a few rows."""
    from labelloop.operators import pruned as PR
    if small:
        monkeypatch.setattr(PR, "BLOCK_ROWS", 7)
        monkeypatch.setattr(PR, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 6)) * 3
    def rows(n, at):
        out = []
        for i in range(n):
            v = (centres[rng.integers(9)] + 0.2 * rng.normal(size=6)).tolist()
            out.append((at + i, i % 4, None if i % 17 == 3 else [0.0] * 6 if i % 19 == 4 else v))
        return out + [(at + n + i, 1, list(out[0][2])) for i in range(12)]      # ties
    schema = "id bigint, label int, embedding array<double>"
    pool = spark.createDataFrame(rows(160, 0), schema).withColumnRenamed("id", "demo_id").withColumnRenamed("label", "anno").repartition(3)
    queries = spark.createDataFrame(rows(60, 100), schema).repartition(3)
    for k, own in ((1, False), (5, True), (200, False)):
        kw = {"pool_label": "anno", "exclude_self": own}
        got = PR.pruned_topk(queries, pool, k, **kw)
        assert sorted(map(tuple, got.rows.collect()), key=str) == full_scan(spark, queries, pool, k, **kw)
        r = got.report.first()
        assert r["queries"] == 72 and 0 < r["scored"] <= 72 * 172
        if k == 1:
            assert r["share"] < 0.5
    assert PR.pruned_topk(queries, pool.filter("demo_id < 0"), 3).rows.count() == 0
    assert PR.pruned_topk(queries.filter("id < 0"), pool, 3).rows.count() == 0
    twice = queries.limit(3).union(queries.limit(3))
    assert sorted(map(tuple, PR.pruned_topk(twice, pool, 2).rows.collect()), key=str) == full_scan(spark, twice, pool, 2)


def test_pruned_search_moves_vectors_by_block(spark, tmp_path):
    """Vectors without a cluster structure rule nothing out: a query travels once for each block,
    not once for each of the 33 clusters, and the rows are those of the full scan."""
    from labelloop.operators import pruned as PR
    rng = np.random.default_rng(9)
    rows = [(i, i % 3, rng.normal(size=24).tolist()) for i in range(1_050)]
    pool = spark.createDataFrame(rows, "demo_id bigint, anno int, embedding array<double>")
    queries = pool.select(F.col("demo_id").alias("id"), "embedding")
    moved = []
    keep = PR.stored

    def spy(df, name):
        out = keep(df, name)
        if name in ("visits", "pairs"):
            moved.append(out.count())
        return out
    with pytest.MonkeyPatch.context() as m:
        m.setattr(PR, "stored", spy)
        got = PR.pruned_topk(queries, pool, 5, pool_label="anno", exclude_self=True)
    assert sorted(map(tuple, got.rows.collect()), key=str) == full_scan(spark, queries, pool, 5, pool_label="anno", exclude_self=True)
    assert got.report.first()["share"] > 0.9 and max(moved) <= 2 * 1_050


def test_only_pairs_that_can_win_are_scored_in_double_precision(monkeypatch):
    """Single precision picks the candidates; none of a query's k best is lost, equal vectors and close calls included."""
    from labelloop.operators import pruned as PR
    monkeypatch.setattr(PR, "TILE", (16, 50))
    rng = np.random.default_rng(2)
    for d in (1, 3, 7, 24, 64, 65):
        m = PR._normalise(rng.normal(size=(600, d)))
        m[300:310] = m[5]
        m[310:330] = PR._normalise(m[6] + 1e-7 * rng.normal(size=(20, d)))
        v = np.concatenate([m[:40], PR._normalise(rng.normal(size=(30, d)))])
        exact = np.einsum("ij,kj->ik", v, m, optimize=False)
        odd = lambda i, j: (i + j) % 3 > 0
        exact[~odd(*np.indices(exact.shape))] = np.nan
        least = np.where(np.arange(len(v)) % 2, np.nan, np.nanquantile(exact, 0.9, axis=1))
        who, cols = (np.concatenate(x) for x in zip(*PR._best_pairs(v, m, least, 5, odd), strict=True))
        assert (np.einsum("ij,ij->i", v[who], m[cols], optimize=False) == exact[who, cols]).all()
        want = {(i, j) for i, js in enumerate(PR._topk_rows(exact, 5)) for j in js if not exact[i, j] < least[i]}
        assert want <= set(zip(who.tolist(), cols.tolist(), strict=True))
        assert d < 24 or len(who) < 30 * len(v)


def test_stored_answers_meet_keys_not_prompts(spark, tmp_path):
    """A run over a full store moves no prompt and calls nobody; new prompts and repeated rows are asked for or found."""
    text = F.concat(F.lit("text "), F.col("id") % 7)
    prompts = spark.range(40).select("id", F.array(F.struct(F.lit("user").alias("role"), text.alias("content")), F.struct(F.lit("user").alias("role"), F.lit("?").alias("content"))).alias("messages"))
    echo = lambda batch: [m[0]["content"] for m in batch]
    store = AnswerStore(str(tmp_path), 0)
    first = sorted(map(tuple, A.annotate(prompts, echo, store=store).collect()))
    again = A.annotate(prompts, lambda batch: 1 / 0, store=store)
    assert "MapInArrow" not in again._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, again.collect())) == first and len(first) == 40
    more = prompts.union(prompts.limit(3)).union(prompts.limit(5).withColumn("id", F.col("id") + 100))
    def new_only(batch):
        assert len(batch) <= 5
        return echo(batch)
    got = sorted(map(tuple, A.annotate(more, new_only, store=store).collect()))
    assert len(got) == 48 and all(raw.startswith("text ") for _, raw, _ in got)
