"""Exact top-k over a large pool without scanning it for every query.

The pool is cut into clusters around about sqrt(n) of its own vectors, at most
``MAX_CENTRES``, drawn by a seeded hash. A cluster has a centre and a radius, the
largest angle between the centre and a member, so no member is nearer to a query
than the angle between query and centre less the radius: a bound on the cosine. A
query first meets the cluster of its highest bound; the k-th similarity found there
rules out every cluster whose bound is lower, and the query meets the rest. The rows
are those of a full scan, ties and all, whatever the clusters are; how much of the
pool is read depends on them and is reported.

Queries and clusters meet by block. Clusters that lie next to each other share a block
of ``BLOCK_ROWS`` rows, a larger cluster is several blocks. The queries of a block (by
their best cluster) are dealt over parts of ``BLOCK_QUERIES``. Which part meets which
block is a small table of pairs. A vector thus travels once for each block that its part
meets, not once for each cluster. Blocks and parts grow with the table, from 8 of them on,
up to ``BLOCK_MOST`` rows. Pairs that would shuffle more than ``ROOM`` times the input meet in
waves, and the files of a wave go before the next one. Only centres and pairs are broadcast. Vectors that are exact in
single precision travel in it.

A task that holds one part and one block multiplies them in single precision, tile by tile.
Its error has a bound (``_best_pairs``), so the pairs that can be among the k best of a query
are known; only these are scored in double precision, in the order of a full scan's sums.
"""

from __future__ import annotations

import contextlib
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloop.functions.vectors import hash_unit
from labelloop.operators.retrieve import _list_matrix, _normalise, _topk_rows
from labelloop.session import stored

MAX_CENTRES = 2048
BLOCK_ROWS = 20_000
BLOCK_QUERIES = 20_000
BLOCK_MOST = 65_536
STEP = 4_000_000     # bounds or similarities held at once
TILE = (512, 4096)   # queries and pool rows multiplied at once
ROOM = 4             # vectors shuffled at once, times those of the input
SLACK = 1e-9          # of the bounds, for rounding
_FOUND = "row bigint, demo_id bigint, demo_label bigint, sim double, scored bigint"


@dataclass
class Search:
    rows: DataFrame      # (query_id, rank, demo_id, demo_label, sim)
    report: DataFrame    # (queries, pool, scored, share)


def _centres(pool: DataFrame, n: int, seed: int) -> np.ndarray:
    """Unit vectors of about sqrt(n) pool rows, in a fixed order."""
    want = min(MAX_CENTRES, math.isqrt(max(n, 1)) + 1)
    drawn = pool.orderBy(hash_unit("pid", seed), "pid").limit(want).select("pvec").toArrow()
    m = _normalise(_list_matrix(drawn.column("pvec")))
    return m[~np.isnan(m).any(axis=1)]


def _lossless(rows: DataFrame, vec: str) -> bool:
    """Whether all vectors are exact in single precision."""
    back = F.col(vec).cast("array<float>").cast("array<double>")
    return bool(rows.agg(F.coalesce(F.bool_and(F.col(vec).isNull() | (F.col(vec) == back)), F.lit(True))).first()[0])


def _clustered(pool: DataFrame, centres: np.ndarray) -> DataFrame:
    """(pid, plab, pvec, cluster, cosine to its centre) of the rows that have a direction."""
    shared = pool.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for b in batches:
            m = _normalise(_list_matrix(b.column("pvec"), shared.value.shape[1]))
            ok = np.flatnonzero(~np.isnan(m).any(axis=1))
            sim = np.einsum("ij,kj->ik", m[ok], shared.value, optimize=False)
            at = sim.argmax(axis=1) if len(ok) else np.zeros(0, np.int64)
            rows = b.take(pa.array(ok))
            yield pa.RecordBatch.from_arrays([rows.column("pid"), rows.column("plab"), rows.column("pvec"), pa.array(at.astype(np.int32)), pa.array(sim[np.arange(len(ok)), at])],
                                             ["pid", "plab", "pvec", "cluster", "cosine"])
    return pool.mapInArrow(run, f"pid bigint, plab bigint, pvec {pool.schema['pvec'].dataType.simpleString()}, cluster int, cosine double")


def _chain(centres: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of ``ids`` in an order where each centre follows the nearest one that was left."""
    left, order = centres[ids], []
    open_, at = np.ones(len(ids), bool), 0
    while len(order) < len(ids):
        open_[at] = False
        order.append(at)
        at = int(np.where(open_, left @ left[at], -np.inf).argmax())
    return np.array(order, np.int64)


@contextlib.contextmanager
def _shuffles_go(spark):
    """Shuffle files of the jobs inside the block are deleted with the job."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


@dataclass
class Layout:
    """Clusters (``ids``, ``radius``) with the group each belongs to; ``first`` and ``n_blocks`` of each group."""

    centres: np.ndarray
    ids: np.ndarray
    radius: np.ndarray
    group: np.ndarray
    first: np.ndarray
    n_blocks: np.ndarray

    def bounds(self, vectors: np.ndarray, which=slice(None)) -> np.ndarray:
        """Of the cosine between unit ``vectors`` and any member of the clusters."""
        cos = np.clip(np.einsum("ij,kj->ik", vectors, self.centres[self.ids[which]], optimize=False), -1, 1)
        return np.cos(np.maximum(0.0, np.arccos(cos) - self.radius[which])) + SLACK


def _layout(centres: np.ndarray, sizes: list, block_rows: int) -> Layout:
    """``sizes``: (cluster, rows, least cosine). Groups: neighbours while they fit a block, or one large cluster."""
    ids = np.array([c for c, _, _ in sizes], np.int64)
    order = _chain(centres, ids) if len(ids) else ids
    rows = np.array([m for _, m, _ in sizes], np.int64)
    group, blocks, held = np.zeros(len(ids), np.int64), [], block_rows + 1
    for c in order:
        if held + rows[c] > block_rows:
            blocks.append(-(-int(rows[c]) // block_rows))
            held = 0
        held += int(rows[c])
        group[c] = len(blocks) - 1
    n_blocks = np.array(blocks, np.int64)
    return Layout(centres, ids, np.arccos(np.clip(np.array([x for *_, x in sizes], np.float64), -1, 1)), group, np.cumsum(n_blocks) - n_blocks, n_blocks)


def _slices(batches, rows: int):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _located(queries: DataFrame, shared) -> DataFrame:
    """(row, qid, qvec, best, home): the cluster of the highest bound and its group, of queries that have a direction."""
    def run(batches):
        lay = shared.value
        for b in _slices(batches, STEP // max(1, len(lay.ids))):
            q = _normalise(_list_matrix(b.column("qvec"), lay.centres.shape[1]))
            ok = np.flatnonzero(~np.isnan(q).any(axis=1)) if len(lay.ids) else np.zeros(0, np.int64)
            best = lay.bounds(q[ok]).argmax(axis=1) if len(ok) else np.zeros(0, np.int64)
            rows = b.take(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(best), pa.array(lay.group[best])], ["row", "qid", "qvec", "best", "home"])
    return queries.select("row", "qid", "qvec").mapInArrow(run, f"row bigint, qid bigint, qvec {queries.schema['qvec'].dataType.simpleString()}, best bigint, home bigint")


def _meetings(rest: DataFrame, shared) -> DataFrame:
    """(home, part, grp): the groups in which some query of the part has a cluster, not its best, whose bound reaches its ``kth``."""
    def run(batches):
        lay = shared.value
        seen: set = set()
        by_group = np.argsort(lay.group, kind="stable")     # each group has a cluster
        starts = np.flatnonzero(np.diff(lay.group[by_group], prepend=-1))
        for b in _slices(batches, STEP // max(1, len(lay.ids))):
            meet = _meets(lay.bounds(_normalise(_list_matrix(b.column("qvec"), lay.centres.shape[1]))), b)
            meet[np.arange(b.num_rows), b.column("best").to_numpy()] = False
            deal = np.stack([b.column("home").to_numpy(), b.column("part").to_numpy()], axis=1)
            deals, who = np.unique(deal, axis=0, return_inverse=True)
            row, grp = np.nonzero(np.logical_or.reduceat(meet[:, by_group], starts, axis=1)) if len(starts) else (np.zeros(0, np.int64),) * 2
            key = np.unique(who.ravel()[row] * len(starts) + grp)
            new = [k for k in ((*deals[x // len(starts)].tolist(), x % len(starts)) for x in key.tolist()) if k not in seen]
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in new], pa.int64()) for i in range(3)], ["home", "part", "grp"])
    return rest.select("qvec", "best", "home", "part", "kth").mapInArrow(run, "home bigint, part bigint, grp bigint").distinct()


def _meets(bound: np.ndarray, q) -> np.ndarray:
    kth = np.asarray(q.column("kth").to_numpy(), np.float64)
    return ~(bound < kth[:, None])     # no k-th yet (NaN): all of them


def _best_pairs(v: np.ndarray, m: np.ndarray, least: np.ndarray, k: int, allowed):
    """(query, pool row) of the ``allowed`` pairs of unit vectors ``v`` and ``m``, all that can be among a query's k
    highest and reach its ``least`` (NaN: any), in runs of queries. Products in single precision differ from
    the cosine by less than (d + 3) / 2**24: rounded terms, rounded sums, and terms that add up to 1 at most."""
    slack = (v.shape[1] + 8) * 2.0**-23
    rows, cols = TILE
    v32, m32 = v.astype(np.float32), m.astype(np.float32)
    for a in range(0, len(v), rows):
        q = v32[a:a + rows]
        floor = np.where(np.isnan(least[a:a + rows]), -2.0, least[a:a + rows] - slack)
        who, at, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in range(0, len(m), cols):
            sim = q @ m32[b:b + cols].T
            flat = np.flatnonzero(sim >= floor.astype(np.float32)[:, None])
            i, j = np.divmod(flat, sim.shape[1])
            ok = allowed(a + i, b + j)
            if not ok.any():
                continue
            who, at, near = np.append(who, i[ok]), np.append(at, b + j[ok]), np.append(near, sim.ravel()[flat[ok]])
            order = np.lexsort((-near, who))
            who, at, near = who[order], at[order], near[order]
            kth = np.flatnonzero(np.arange(len(who)) - np.searchsorted(who, who) == k - 1)
            floor[who[kth]] = np.maximum(floor[who[kth]], near[kth] - 2 * slack)
            keep = near >= floor[who]
            who, at, near = who[keep], at[keep], near[keep]
        yield a + who, at


def _met(queries: DataFrame, pool: DataFrame, pairs: DataFrame, n_pairs: int, shared, k: int, exclude_self: bool, first: bool) -> DataFrame:
    """The top-k of every block that a query's part meets, and how many pairs it scored (a row without a query).
    ``first``: only the best cluster of each query, else all others whose bound reaches its ``kth``, down to it."""
    keys = ["home", "part", "block"]
    parts = max(1, min(2 * n_pairs, 4_000))
    left = queries.join(F.broadcast(pairs), ["home", "part"]).repartition(parts, *keys)
    right = pool.join(F.broadcast(pairs), "block").repartition(parts, *keys)

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        names = ("row", "demo_id", "demo_label", "sim", "scored")
        if not q.num_rows or not p.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "sim" else pa.int64()) for n in names})
        lay = shared.value
        p, q = p.sort_by("pid"), q.sort_by("best")
        ids, labels, cluster = (p.column(c).to_numpy() for c in ("pid", "plab", "at"))
        m = _normalise(_list_matrix(p.column("pvec")))
        which, cluster = np.unique(cluster, return_inverse=True)
        sizes = np.bincount(cluster)
        rows, qid, own = (q.column(c).to_numpy() for c in ("row", "qid", "best"))
        v = _normalise(_list_matrix(q.column("qvec"), m.shape[1]))
        out, scored = [], 0

        def best_of(who, sim, cols):
            order = np.lexsort((cols, -sim, who))       # by id where similarities are equal
            who, sim, cols = who[order], sim[order], cols[order]
            keep = np.arange(len(who)) - np.searchsorted(who, who) < k
            out.append((rows[who[keep]], ids[cols[keep]], labels[cols[keep]], sim[keep]))

        if first:
            for c, number in enumerate(which):
                whose, cols = np.flatnonzero(own == number), np.flatnonzero(cluster == c)
                scored += len(whose) * len(cols)
                step = max(1, STEP // len(cols))          # similarities held at once
                for a in range(0, len(whose), step):
                    mine = whose[a:a + step]
                    sim = np.einsum("ij,kj->ik", v[mine], m[cols], optimize=False)
                    if exclude_self:
                        sim[qid[mine, None] == ids[None, cols]] = np.nan
                    top = _topk_rows(sim, k)
                    best = np.take_along_axis(sim, top, axis=1)
                    keep = ~np.isnan(best)
                    out.append((np.repeat(rows[mine], top.shape[1])[keep.ravel()], ids[cols][top][keep], labels[cols][top][keep], best[keep]))
        else:
            least = np.asarray(q.column("kth").to_numpy(), np.float64)
            step = max(TILE[0], STEP // len(which) // TILE[0] * TILE[0])   # bounds held at once
            for a in range(0, len(v), step):
                part = slice(a, a + step)
                meet = _meets(lay.bounds(v[part], which), q.slice(a, step)) & (own[part, None] != which[None, :])
                scored += int((meet @ sizes).sum())

                def allowed(i, j):
                    return meet[i, cluster[j]] & ((qid[a + i] != ids[j]) if exclude_self else True)  # noqa: B023 - runs at once
                for who, cols in _best_pairs(v[part], m, least[part], k, allowed):
                    sim = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", v[a + who[x:x + 65_536]], m[cols[x:x + 65_536]], optimize=False) for x in range(0, len(who), 65_536)])
                    ok = ~(sim < least[a + who])
                    best_of(a + who[ok], sim[ok], cols[ok])
        row, demo, label, sim = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        none = pa.nulls(1, pa.int64())
        found = pa.table([pa.array(row, pa.int64()), pa.array(demo, pa.int64()), pa.array(label, pa.int64()), pa.array(sim, pa.float64()), pa.nulls(len(row), pa.int64())], names)
        return pa.concat_tables([found, pa.table([none, none, none, pa.nulls(1, pa.float64()), pa.array([scored], pa.int64())], names)])
    with _shuffles_go(queries.sparkSession):
        return stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _FOUND), "met")


def pruned_topk(queries: DataFrame, pool: DataFrame, k: int, *, query_id: str = "id", query_vec: str = "embedding", pool_id: str = "demo_id",
                pool_vec: str = "embedding", pool_label: str | None = None, exclude_self: bool = False, seed: int = 0) -> Search:
    """The rows of ``knn_topk``'s long form for an ungrouped pool of any size, and the share
    of (query, pool row) pairs that were scored. A NULL or zero vector, on either side, has
    no neighbours; repeated query ids are queries each."""
    label = F.col(pool_label).cast("bigint") if pool_label else F.lit(0).cast("bigint")
    pool = pool.select(F.col(pool_id).cast("bigint").alias("pid"), label.alias("plab"), F.col(pool_vec).cast("array<double>").alias("pvec")).filter("pid is not null and pvec is not null")
    queries = queries.select(F.monotonically_increasing_id().alias("row"), F.col(query_id).cast("bigint").alias("qid"), F.col(query_vec).cast("array<double>").alias("qvec"))
    if _lossless(pool, "pvec") and _lossless(queries, "qvec"):
        pool, queries = (x.withColumn(c, F.col(c).cast("array<float>")) for x, c in ((pool, "pvec"), (queries, "qvec")))
    pool, queries = stored(pool, "pool"), stored(queries, "queries")
    n = pool.count()
    centres = _centres(pool, n, seed)
    if not len(centres):
        centres = np.zeros((1, 1))
    members = stored(_clustered(pool, centres), "clusters")
    sizes = sorted((r["cluster"], r["n"], r["least"]) for r in members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")).collect())  # a row for each centre
    spark = pool.sparkSession
    block_rows = min(max(BLOCK_ROWS, n // 8), max(BLOCK_MOST, BLOCK_ROWS))
    lay = _layout(centres, sizes, block_rows)
    shared = spark.sparkContext.broadcast(lay)
    where = spark.createDataFrame([(int(c), i, int(lay.first[g]), int(lay.n_blocks[g])) for i, (c, g) in enumerate(zip(lay.ids, lay.group, strict=True))], "cluster int, at bigint, first bigint, n_blocks bigint")
    cut = stored(members.join(F.broadcast(where), "cluster").select("pid", "plab", "pvec", "at", (F.col("first") + F.pmod(F.xxhash64("pid"), F.col("n_blocks"))).alias("block")), "pool-clusters")
    located = stored(_located(queries, shared), "located")
    homes = {r["home"]: r["n"] for r in located.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each group
    each = min(max(BLOCK_QUERIES, sum(homes.values()) // 8), max(BLOCK_MOST, BLOCK_QUERIES))
    parts = {g: -(-m // each) for g, m in homes.items()}
    dealt = spark.createDataFrame(list(parts.items()), "home bigint, parts bigint")
    located = located.join(F.broadcast(dealt), "home").select(*located.columns, F.pmod(F.xxhash64("row"), F.col("parts")).alias("part"))

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("row").orderBy(F.desc("sim"), "demo_id")
        return found.filter("row is not null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    own = [(g, p, int(lay.first[g] + b)) for g, m in parts.items() for p in range(m) for b in range(lay.n_blocks[g])]
    near = _met(located, cut, spark.createDataFrame(own, "home bigint, part bigint, block bigint"), len(own), shared, k, exclude_self, True)
    kth = best(near).filter(F.col("rank") == k).select(F.col("row").alias("of_row"), F.col("sim").alias("kth"))
    rest = stored(located.join(kth, F.col("row") == F.col("of_row"), "left").select(*located.columns, F.coalesce("kth", F.lit(float("nan"))).alias("kth")), "rest")
    blocks = spark.createDataFrame([(g, int(lay.first[g] + b)) for g in range(len(lay.n_blocks)) for b in range(lay.n_blocks[g])], "grp bigint, block bigint")
    pairs = stored(_meetings(rest, shared).join(F.broadcast(blocks), "grp").select("home", "part", "block"), "pairs")
    n_pairs, n_queries = pairs.count(), sum(homes.values())
    waves = max(1, -(-n_pairs * (block_rows + each) // (ROOM * max(1, n + n_queries))))
    found = reduce(DataFrame.unionByName, [_met(rest, cut, pairs.filter(F.col("block") % waves == w), -(-n_pairs // waves), shared, k, exclude_self, False) for w in range(waves)], near)
    rows = (best(found).join(queries.select(F.col("row").alias("of_row"), F.col("qid").alias(query_id)), F.col("row") == F.col("of_row"))
            .select(query_id, F.col("rank").cast("int"), "demo_id", "demo_label", "sim"))
    report = (queries.agg(F.count(F.lit(1)).alias("queries")).crossJoin(found.agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("scored")))   # one row each
              .select("queries", F.lit(n).cast("bigint").alias("pool"), "scored", (F.col("scored") / F.greatest(F.col("queries") * n, F.lit(1))).alias("share")))
    return Search(rows, report)
