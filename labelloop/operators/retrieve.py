"""Demonstration retrieval: exact top-k cosine neighbours (J1, J2, W1, W3) and
fetching demonstrations by id list (J3, J4, J9, A12).

Scalable form of J1/W1. The demonstration pool is small by design (the reference
selects 100 demonstrations), so it is *broadcast* as a normalised numpy matrix
after its size is checked, and every query partition computes its similarity
block with one matrix product inside ``mapInArrow``. Only the k winners per query
leave the task: no N x M rows are ever materialised and no shuffle happens.

A pool larger than the broadcast budget is split into chunks that each fit; every
chunk yields its own top-k per query, and a final per-query ``row_number`` with
a literal limit (``WindowGroupLimit``, partial before the shuffle) merges them.
The result is exact either way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloop.functions.batches import runs
from labelloop.session import scratch_dir, stored

DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024
SALT = 8
SIMILARITIES = 4_000_000      # held at once
DEMO_BUDGET = 32 << 20        # bytes of named demos that go to all tasks


def _list_matrix(arr: pa.Array, dim: int | None = None) -> np.ndarray:
    """Arrow list<float|double> column -> dense float64 matrix (rows x d).
    A NULL vector or one of another length becomes a row of NaN (it then has no
    neighbours and NaN scores) instead of failing the task."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, dim or 0))
    offsets = np.asarray(arr.offsets)
    lens = np.diff(offsets)
    valid = np.asarray(arr.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    if dim is None:
        good = lens[valid]
        dim = int(np.bincount(good).argmax()) if len(good) else 0
    values = np.asarray(arr.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    ok = valid & (lens == dim)
    if ok.all() and offsets[0] == 0 and len(values) == n * dim:
        return values.reshape(n, dim)
    out = np.full((n, dim), np.nan)
    rows = np.nonzero(ok)[0]
    if len(rows):
        idx = offsets[rows][:, None] + np.arange(dim)[None, :]
        out[rows] = values[idx]
    return out


def _normalise(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = m / norms
    out[~np.isfinite(out)] = np.nan   # zero vector -> NaN similarities (ranked last)
    return out


def _topk_rows(sim: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best columns per row: similarity descending, then column
    index ascending (columns are pre-sorted by id, so ties go to the lower id).
    NaN ranks last."""
    m = sim.shape[1]
    k = min(k, m)
    key = np.where(np.isnan(sim), np.inf, -sim)
    if m <= 4 * k or m <= 256:
        return np.argsort(key, axis=1, kind="stable")[:, :k]
    # partial selection, then an exact stable order of the candidate set; ties at
    # the k-th value are resolved by index
    kth = np.partition(key, k - 1, axis=1)[:, k - 1:k]
    out = np.empty((sim.shape[0], k), dtype=np.int64)
    for r in range(sim.shape[0]):
        cand = np.nonzero(key[r] <= kth[r, 0])[0]
        order = np.argsort(key[r, cand], kind="stable")[:k]
        out[r] = cand[order]
    return out


def _pool_arrays(pool: DataFrame, pool_id: str, pool_vec: str, pool_group: str | None,
                 pool_label: str | None, pool_text: str | None = None):
    cols = [F.col(pool_id).cast("bigint").alias("pid"), F.col(pool_vec).alias("pvec")]
    cols.append((F.col(pool_group).cast("bigint") if pool_group else F.lit(0).cast("bigint")).alias("pgrp"))
    cols.append((F.col(pool_label).cast("bigint") if pool_label else F.lit(0).cast("bigint")).alias("plab"))
    cols.append((F.col(pool_text).cast("string") if pool_text else F.lit(None).cast("string")).alias("ptxt"))
    tbl = pool.select(*cols).orderBy("pgrp", "pid").toArrow()
    ids = tbl.column("pid").to_numpy()
    grps = tbl.column("pgrp").to_numpy()
    labs = tbl.column("plab").to_numpy()
    texts = tbl.column("ptxt").combine_chunks() if pool_text else None
    mat = _normalise(_list_matrix(tbl.column("pvec")))
    return ids, grps, labs, mat, texts


def _out_schema(query_id: str, with_group: bool, group_name: str, wide: bool,
                keep_schema: str = "", with_text: bool = False) -> str:
    if wide:
        return (f"{query_id} bigint, {keep_schema}demo_ids array<bigint>, demo_labels array<bigint>, "
                f"sims array<double>" + (", demo_texts array<string>" if with_text else ""))
    g = f"{group_name} bigint, " if with_group else ""
    return f"{query_id} bigint, {g}rank int, demo_id bigint, demo_label bigint, sim double"


def _topk_block(queries: DataFrame, bc, k: int, query_id: str, query_vec: str,
                exclude_self: bool, with_group: bool, group_name: str, wide: bool,
                keep: tuple = ()) -> DataFrame:
    kept = queries.select(*keep).schema if keep else None
    keep_schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept.fields) if keep else ""
    with_text = bc.value[4] is not None
    schema = _out_schema(query_id, with_group, group_name, wide, keep_schema, with_text)

    def run(batches):
        ids, grps, labs, mat, texts = bc.value
        groups = [(g, np.nonzero(grps == g)[0]) for g in np.unique(grps)]
        lengths = None if texts is None else np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        step = max(1, SIMILARITIES // max(1, len(ids)))
        for b in (x.slice(at, step) for x in batches for at in range(0, x.num_rows, step)):
            qid = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            q = _normalise(_list_matrix(b.column(1), mat.shape[1]))
            # fixed-order reduction: bitwise the same whatever the batch shape,
            # so results do not depend on partitioning (BLAS gemm does)
            sim = np.einsum("ij,kj->ik", q, mat, optimize=False)
            if exclude_self:
                sim[qid[:, None] == ids[None, :]] = np.nan
            per_group = []
            if not groups:          # no pool: empty lists, or no long rows
                groups = [(0, np.zeros(0, np.int64))]
            for g, idx in groups:
                sg = sim[:, idx]
                top = _topk_rows(sg, k)
                sel = np.take_along_axis(sg, top, axis=1)
                per_group.append((g, idx[top], sel))
            if wide:
                # groups side by side in group order (A12: per-class lists concatenated)
                gidx = np.concatenate([t for _, t, _ in per_group], axis=1)
                gsim = np.concatenate([s for _, _, s in per_group], axis=1)
                valid = ~np.isnan(gsim)
                counts = valid.sum(axis=1)
                # the texts of a row's demos are many times its own: few rows leave at once
                size = np.zeros(len(qid), np.int64) if texts is None else np.where(valid, lengths[gidx], 0).sum(axis=1)
                for at in runs(size + 24 * counts + 64):
                    ok, flat_idx = valid[at], gidx[at][valid[at]]
                    offs = pa.array(np.concatenate([[0], np.cumsum(counts[at])]).astype(np.int32))
                    arrays = [pa.array(qid[at])] + [b.column(2 + i).slice(at.start, at.stop - at.start) for i in range(len(keep))] + [
                        pa.ListArray.from_arrays(offs, pa.array(ids[flat_idx])),
                        pa.ListArray.from_arrays(offs, pa.array(labs[flat_idx])),
                        pa.ListArray.from_arrays(offs, pa.array(gsim[at][ok]))]
                    names = [query_id, *keep, "demo_ids", "demo_labels", "sims"]
                    if texts is not None:
                        arrays.append(pa.ListArray.from_arrays(offs, texts.take(pa.array(flat_idx))))
                        names.append("demo_texts")
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                continue
            out = {n: [] for n in ("q", "g", "r", "d", "l", "s")}
            for g, top, sel in per_group:
                kk = top.shape[1]
                ok = ~np.isnan(sel).ravel()
                out["q"].append(np.repeat(qid, kk)[ok])
                out["g"].append(np.full(int(ok.sum()), g, dtype=np.int64))
                out["r"].append(np.tile(np.arange(1, kk + 1, dtype=np.int32), len(qid))[ok])
                out["d"].append(ids[top.ravel()][ok])
                out["l"].append(labs[top.ravel()][ok])
                out["s"].append(sel.ravel()[ok])
            cat = {n: np.concatenate(v) for n, v in out.items()}
            arrays = [pa.array(cat["q"])] + ([pa.array(cat["g"])] if with_group else []) + [
                pa.array(cat["r"]), pa.array(cat["d"]), pa.array(cat["l"]), pa.array(cat["s"])]
            names = [query_id] + ([group_name] if with_group else []) + [
                "rank", "demo_id", "demo_label", "sim"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    q = queries.select(F.col(query_id).cast("bigint").alias(query_id), F.col(query_vec), *keep)
    return q.mapInArrow(run, schema)


class PreparedPool:
    """A pool made ready once, for callers that retrieve against it many times - every
    micro-batch of a stream. A pool within the budget is collected and broadcast; a larger
    one is written once as a table of blocks that each fit, and every batch streams
    through the blocks: each is broadcast, gives its top-k of the batch, and is freed, and
    the lists are merged. Both give the same rows. ``release()`` frees the broadcast."""

    def __init__(self, pool: DataFrame, *, pool_id: str = "demo_id", pool_vec: str = "embedding",
                 pool_group: str | None = None, pool_label: str | None = None, pool_text: str | None = None,
                 max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES):
        self.how = {"pool_id": pool_id, "pool_vec": pool_vec, "pool_group": pool_group, "pool_label": pool_label, "pool_text": pool_text}
        self.with_group = pool_group is not None
        self.group_name = pool_group or "grp"
        n, d, t = _pool_size(pool, pool_vec, pool_text)
        self.bc = self.blocks = None
        if _fits(n, d, t, max_broadcast_bytes):
            self.bc = pool.sparkSession.sparkContext.broadcast(
                _pool_arrays(pool, pool_id, pool_vec, pool_group, pool_label, pool_text))
        else:
            self.blocks = pool_blocks(pool, n, d, max_broadcast_bytes, **self.how)

    def release(self) -> None:
        if self.bc is not None:
            self.bc.destroy()


def _pool_size(pool: DataFrame, pool_vec: str, pool_text: str | None) -> tuple[int, int, int]:
    text_len = F.sum(F.length(pool_text)) if pool_text else F.lit(0)
    st = pool.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(pool_vec)).alias("d"), text_len.alias("t")).first()
    return int(st["n"]), int(st["d"] or 0), int(st["t"] or 0)


def _fits(n: int, d: int, t: int, budget: int) -> bool:
    return n * 8 * (d + 3) + 4 * t <= budget


@dataclass
class PoolBlocks:
    """A pool written in blocks by a hash of its id; ``n`` blocks of about the budget each."""

    table: DataFrame
    n: int


def pool_blocks(pool: DataFrame, n: int, d: int, budget: int, *, pool_id: str, pool_vec: str, pool_group: str | None, pool_label: str | None,
                pool_text: str | None) -> PoolBlocks:
    """Write the pool's rows once, a folder for each block."""
    n_blocks = max(1, int(np.ceil(n * 8 * (d + 3) / budget)))
    cols = [c for c in dict.fromkeys((pool_id, pool_vec, pool_group, pool_label, pool_text)) if c]
    block = F.pmod(F.xxhash64(F.col(pool_id)), F.lit(n_blocks)).cast("int").alias("__block")
    path = scratch_dir(pool.sparkSession, "pool-blocks")
    x = pool.select(*cols, block)
    x.repartition("__block").write.partitionBy("__block").parquet(path)
    return PoolBlocks(pool.sparkSession.read.schema(x.schema).parquet(path), n_blocks)


def knn_topk(queries: DataFrame, pool, k: int, *, query_id: str = "id",
             query_vec: str = "embedding", pool_id: str = "demo_id", pool_vec: str = "embedding",
             pool_group: str | None = None, pool_label: str | None = None,
             exclude_self: bool = False, wide: bool = False, keep: tuple = (),
             pool_text: str | None = None,
             max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Top-k pool rows per query row by cosine similarity.

    Ranking is similarity descending, then ``demo_id`` ascending. With
    ``pool_group`` the top-k is taken inside each group (J2/W3: per class).
    ``pool_label`` is carried along as ``demo_label``. The query row itself may be
    returned unless ``exclude_self`` (quirk 15).

    Long form: ``(query_id, [pool_group], rank, demo_id, demo_label, sim)``.
    Wide form (``wide=True``): one row per query with ordered arrays
    ``demo_ids, demo_labels, sims`` (groups concatenated in group order); it is
    produced in the same task as the query row, so later per-query work (voting,
    prompt assembly) needs no shuffle. In wide form ``keep`` query columns pass
    through, and ``pool_text`` adds the demos' texts (``demo_texts``) from the
    same broadcast (its size counts against the budget).
    """
    spark = queries.sparkSession
    if isinstance(pool, PreparedPool):
        if not wide and keep:
            raise ValueError("keep needs the wide form")
        if pool.blocks is not None:
            return _knn_from_blocks(queries, pool.blocks, k, query_id=query_id, query_vec=query_vec, exclude_self=exclude_self, wide=wide, keep=keep, **pool.how)
        return _topk_block(queries, pool.bc, k, query_id, query_vec, exclude_self, pool.with_group,
                           pool.group_name, wide, keep)
    # the pool is read twice (size check, then collect): evaluate it once
    pool = pool.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _knn_from_pool(queries, pool, k, query_id=query_id, query_vec=query_vec, pool_id=pool_id,
                              pool_vec=pool_vec, pool_group=pool_group, pool_label=pool_label,
                              exclude_self=exclude_self, wide=wide, keep=keep, pool_text=pool_text,
                              max_broadcast_bytes=max_broadcast_bytes)
    finally:
        pool.unpersist()


def _knn_from_pool(queries: DataFrame, pool: DataFrame, k: int, *, query_id, query_vec, pool_id, pool_vec,
                   pool_group, pool_label, exclude_self, wide, keep, pool_text, max_broadcast_bytes) -> DataFrame:
    spark = queries.sparkSession
    n, d, t = _pool_size(pool, pool_vec, pool_text)
    with_group = pool_group is not None
    group_name = pool_group or "grp"
    if (keep or pool_text) and not wide:
        raise ValueError("keep / pool_text need the wide form")
    if _fits(n, d, t, max_broadcast_bytes):
        # an empty pool is a pool of no columns: every query stays, with empty lists
        arrays = _pool_arrays(pool, pool_id, pool_vec, pool_group, pool_label, pool_text)
        return _topk_block(queries, spark.sparkContext.broadcast(arrays), k, query_id, query_vec, exclude_self,
                           with_group, group_name, wide, keep)
    how = {"pool_id": pool_id, "pool_vec": pool_vec, "pool_group": pool_group, "pool_label": pool_label, "pool_text": pool_text}
    return _knn_from_blocks(queries, pool_blocks(pool, n, d, max_broadcast_bytes, **how), k, query_id=query_id, query_vec=query_vec,
                            exclude_self=exclude_self, wide=wide, keep=keep, **how)


def _knn_from_blocks(queries: DataFrame, blocks: PoolBlocks, k: int, *, query_id, query_vec, pool_id, pool_vec, pool_group, pool_label,
                     exclude_self, wide, keep, pool_text) -> DataFrame:
    """Exact merge of the top-k lists of the blocks of a pool. Each block is broadcast, used
    and freed; ids and similarities travel, texts join at the end."""
    spark, pool = queries.sparkSession, blocks.table
    with_group = pool_group is not None
    group_name = pool_group or "grp"
    merged = None
    for c in range(blocks.n):
        arrays = _pool_arrays(pool.filter(F.col("__block") == c), pool_id, pool_vec, pool_group, pool_label)
        if not len(arrays[0]):
            continue
        bc = spark.sparkContext.broadcast(arrays)
        part = stored(_topk_block(queries, bc, k, query_id, query_vec, exclude_self, with_group, group_name, False), "topk-block")
        bc.destroy()
        merged = part if merged is None else merged.unionByName(part)
    keys = [query_id] + ([group_name] if with_group else [])
    w = Window.partitionBy(*keys).orderBy(F.col("sim").desc(), F.col("demo_id").asc())
    long = (merged.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select(*keys, F.col("rank").cast("int"), "demo_id", "demo_label", "sim"))
    if not wide:
        return long
    order = ([group_name] if with_group else []) + ["rank"]
    packed = (long.groupBy(F.col(query_id).alias("__qid"))
              .agg(F.array_sort(F.collect_list(F.struct(*order, "demo_id", "demo_label", "sim"))).alias("_l")))
    out = queries.select(F.col(query_id).cast("bigint").alias(query_id), *keep).join(packed, F.col(query_id) == F.col("__qid"), "left")
    lists = [F.coalesce(F.col(f"_l.{f}"), F.array().cast(f"array<{t}>")).alias(name)
             for f, t, name in (("demo_id", "bigint", "demo_ids"), ("demo_label", "bigint", "demo_labels"), ("sim", "double", "sims"))]
    out = out.select(query_id, *keep, *lists)
    if pool_text is None:
        return out
    texts = pool.select(F.col(pool_id).cast("bigint").alias(query_id), F.col(pool_text).cast("string").alias("text"))
    if "text" not in keep:
        return attach_demos(out, texts, ("text",), id_col=query_id)
    held = out.withColumnRenamed("text", "__text")
    return attach_demos(held, texts, ("text",), id_col=query_id).withColumnRenamed("__text", "text")


def class_prototypes(df: DataFrame, per_class: int, *, id_col: str = "id", label_col: str = "label",
                     vec_col: str = "embedding", max_classes: int = 10_000) -> DataFrame:
    """Bounded demonstration pool derived from labelled data: per class, the
    ``per_class`` rows nearest (L2) to the class mean, ties by id.

    Class means come from ``Summarizer.mean`` (partial aggregation, one vector per
    class and partition is shuffled). The means table has one row per class and
    is broadcast after a size check. The per-class top-n has a literal limit, so
    Spark inserts a partial ``WindowGroupLimit`` before the shuffle and a hot
    class never sends more than ``per_class`` rows per map task.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from labelloop.functions.vectors import as_double, l2_distance

    lab = df.filter(F.col(label_col).isNotNull() & (F.col(label_col) >= 0))
    # one pass for the class means, collected under a bound (classes x d)
    rows = (lab.groupBy(label_col)
            .agg(Summarizer.mean(array_to_vector(as_double(vec_col))).alias("_m"))
            .select(label_col, vector_to_array("_m").alias("_mean"))
            .limit(max_classes + 1).collect())
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes: over the broadcast bound")
    spark = df.sparkSession
    ltype = dict(df.dtypes)[label_col]
    means = spark.createDataFrame([(r[label_col], list(r["_mean"])) for r in rows],
                                  f"{label_col} {ltype}, _mean array<double>")
    scored = lab.join(F.broadcast(means), label_col).withColumn(
        "dist", l2_distance(as_double(vec_col), F.col("_mean")))
    w = Window.partitionBy(label_col).orderBy(F.col("dist").asc(), F.col(id_col).asc())
    return (scored.withColumn("proto_rank", F.row_number().over(w))
            .filter(F.col("proto_rank") <= per_class)
            .drop("_mean"))


def fetch_demos(demo_lists: DataFrame, corpus: DataFrame, *, list_col: str = "demo_ids",
                id_col: str = "id", corpus_id: str = "id", cols=("text",)) -> DataFrame:
    """Expand an ordered demo-id list and fetch each demo's columns, order kept.

    Returns long form ``(id, pos, demo_id, *cols)``; ``pos`` is 0-based, unknown ids
    give NULL. Lists point into a few representatives, so a demo id is a hot key:
    the list entries of one demo are dealt over ``SALT`` parts by the row's id, and
    only corpus rows that some list names are repeated as often."""
    long = demo_lists.select(F.col(id_col).alias("id"), F.posexplode(list_col).alias("pos", "demo_id"))
    wanted = long.select(F.col("demo_id").alias("__wanted")).distinct()
    side = corpus.join(wanted, corpus[corpus_id] == F.col("__wanted"), "left_semi").select(
        F.col(corpus_id).alias("demo_id"), *cols, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__salt"))
    salted = long.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    return salted.join(side, ["demo_id", "__salt"], "left").select("id", "pos", "demo_id", *cols)


def attach_demos(rows: DataFrame, corpus: DataFrame, cols: tuple, *, list_col: str = "demo_ids",
                 id_col: str = "id", budget: int = DEMO_BUDGET) -> DataFrame:
    """J3/J4, wide: ``rows`` with the ``cols`` of their listed demos as arrays in list
    order (``demo_<col>s``). A corpus within ``budget`` bytes (the representatives) goes to
    all tasks and nothing is shuffled; of a larger one the list entries are joined, and
    row texts do not travel with them."""
    near = _near_corpus(corpus, cols, id_col, budget)
    if near is not None:
        return _attach_near(rows, near, corpus, cols, list_col)
    long = fetch_demos(rows, corpus, list_col=list_col, id_col=id_col, corpus_id=id_col, cols=cols)
    packed = long.groupBy(F.col("id").alias("__id")).agg(F.sort_array(F.collect_list(F.struct("pos", *cols))).alias("__x"))
    out = rows.join(packed, F.col(id_col) == F.col("__id"), "left")
    types = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}
    return out.select(*rows.columns, *(F.coalesce(F.col(f"__x.{c}"), F.array().cast(f"array<{types[c]}>")).alias(f"demo_{c}s") for c in cols))


def _near_corpus(corpus: DataFrame, cols: tuple, id_col: str, budget: int) -> pa.Table | None:
    """The corpus in id order if it is within the budget and its ids are unique."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in cols), F.lit(32))
    st = corpus.agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("ids")).first()
    if (st["bytes"] or 0) > budget or st["n"] != st["ids"]:
        return None
    return corpus.select(F.col(id_col).cast("bigint").alias("__id"), *cols).orderBy("__id").toArrow().combine_chunks()


def _attach_near(rows: DataFrame, near: pa.Table, corpus: DataFrame, cols: tuple, list_col: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(near)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f"demo_{c}s", T.ArrayType(corpus.schema[c].dataType)) for c in cols)])

    def run(batches):
        table = shared.value
        ids = table.column("__id").to_numpy()
        size = np.full(len(ids) + 1, 16, np.int64)
        for c in cols:
            if pa.types.is_string(table.schema.field(c).type):
                size[:-1] += np.asarray(pc.fill_null(pc.binary_length(table.column(c)), 0))
        for b in batches:
            counts = np.asarray(pc.fill_null(pc.list_value_length(b.column(list_col)), 0)).astype(np.int64)
            wanted = pc.list_flatten(b.column(list_col))
            flat = np.asarray(pc.fill_null(wanted, 0)).astype(np.int64)
            at = np.minimum(np.searchsorted(ids, flat), max(len(ids) - 1, 0))
            good = np.asarray(wanted.is_valid()) & (ids[at] == flat if len(ids) else False)
            starts = np.concatenate([[0], np.cumsum(counts)])
            moved = np.concatenate([[0], np.cumsum(size[np.where(good, at, len(ids))])])
            for part in runs(moved[starts[1:]] - moved[starts[:-1]] + 64):
                mine = slice(starts[part.start], starts[part.stop])
                take = pa.array(at[mine], mask=~good[mine])
                offsets = pa.array((starts[part.start:part.stop + 1] - starts[part.start]).astype(np.int32))
                found = (table.column(c).take(take).combine_chunks() for c in cols)
                lists = [pa.ListArray.from_arrays(offsets, x if isinstance(x, pa.Array) else pa.nulls(len(take), x.type)) for x in found]
                old = b.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*old.columns, *lists], names=schema.names)
    return rows.mapInArrow(run, schema)


def collect_ordered(long: DataFrame, key: str, pos: str, value: str, out: str) -> DataFrame:
    """Long rows -> one ordered array per key (the inverse of ``posexplode``)."""
    return (long.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))
                 .alias("_s"))
            .select(key, F.transform("_s", lambda s: s["v"]).alias(out)))
