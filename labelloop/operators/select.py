"""Sample selection (L3): 2-component Gaussian mixture on the scaled loss
(A6, A7, A8), per-class top fraction by confidence (W2, A17), warm-up gate (P8)
and the clean / un-chosen split (P7).

Both selections avoid "one task per class":

* The mixture is fitted by EM where each step is one global aggregate
  (sum r, sum r x, sum r x^2, sum log-likelihood) over a cached double column;
  the driver only holds six numbers.
* The per-class top fraction is an exact distributed selection: a histogram
  refinement finds, per class, the value of the cut row, and a second
  refinement on ids settles ties. Each pass is a ``groupBy(class, bucket)``
  with partial aggregation, so a class holding a third of all rows costs the
  same as any other. The result is a filter against a per-class threshold
  table, no window over a class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_2PI = math.log(2 * math.pi)
EPS10 = 10 * 2.220446049250313e-16     # added to component weights, as the usual GMM fit does


@dataclass
class Mixture:
    weights: tuple[float, float]
    means: tuple[float, float]
    variances: tuple[float, float]
    n_iter: int
    converged: bool
    lower_bound: float

    @property
    def clean_component(self) -> int:
        return 0 if self.means[0] <= self.means[1] else 1


def _two_means(xs: DataFrame, x: str, max_iter: int = 20) -> tuple[float, float, bool]:
    """1-D 2-means from centres (min, max); ties go to the first centre."""
    r = xs.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if r["lo"] is None:
        return 0.0, 0.0, True
    c0, c1 = float(r["lo"]), float(r["hi"])
    for _ in range(max_iter):
        first = F.abs(F.col(x) - F.lit(c0)) <= F.abs(F.col(x) - F.lit(c1))
        s = xs.agg(F.avg(F.when(first, F.col(x))).alias("m0"),
                   F.avg(F.when(~first, F.col(x))).alias("m1")).first()
        n0 = c0 if s["m0"] is None else float(s["m0"])
        n1 = c1 if s["m1"] is None else float(s["m1"])
        if n0 == c0 and n1 == c1:
            return c0, c1, True
        c0, c1 = n0, n1
    return c0, c1, False


def _log_weighted(x: Column, w: float, m: float, v: float) -> Column:
    return F.lit(math.log(w) - 0.5 * (LOG_2PI + math.log(v))) - (x - F.lit(m)) * (x - F.lit(m)) / F.lit(2 * v)


def _resp(x: Column, mix: Mixture) -> tuple[Column, Column, Column]:
    """E-step for one row: responsibilities of both components and log p(x)."""
    a = _log_weighted(x, mix.weights[0], mix.means[0], mix.variances[0])
    b = _log_weighted(x, mix.weights[1], mix.means[1], mix.variances[1])
    mx = F.greatest(a, b)
    lpn = mx + F.log(F.exp(a - mx) + F.exp(b - mx))
    return F.exp(a - lpn), F.exp(b - lpn), lpn


def _m_step(n: int, s0, s1, sx0, sx1, sxx0, sxx1, reg: float) -> tuple:
    n0, n1 = s0 + EPS10, s1 + EPS10
    m0, m1 = sx0 / n0, sx1 / n1
    v0 = max(sxx0 / n0 - m0 * m0, 0.0) + reg
    v1 = max(sxx1 / n1 - m1 * m1, 0.0) + reg
    return (n0 / n, n1 / n), (m0, m1), (v0, v1)


def fit_gmm(df: DataFrame, x: str = "x", max_iter: int = 10, tol: float = 1e-2,
            reg_covar: float = 5e-4) -> Mixture | None:
    """EM for a 1-D two-component mixture (``max_iter=10, tol=1e-2,
    reg_covar=5e-4``). Start: 2-means hard assignment, then one M-step. Each EM
    iteration is one aggregate: E-step with the current parameters (its mean
    log-likelihood is the convergence criterion) fused with the M-step sums.
    Without rows there is no mixture (None)."""
    xs = df.select(F.col(x).cast("double").alias("x")).filter(F.col("x").isNotNull())
    xs = xs.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        c0, c1, _ = _two_means(xs, "x")
        first = F.abs(F.col("x") - F.lit(c0)) <= F.abs(F.col("x") - F.lit(c1))
        h0, h1 = first.cast("double"), (~first).cast("double")
        X = F.col("x")
        r = xs.agg(F.count(F.lit(1)).alias("n"), F.sum(h0).alias("s0"), F.sum(h1).alias("s1"),
                   F.sum(h0 * X).alias("sx0"), F.sum(h1 * X).alias("sx1"),
                   F.sum(h0 * X * X).alias("sxx0"), F.sum(h1 * X * X).alias("sxx1")).first()
        n = int(r["n"])
        if n == 0:
            return None
        w, m, v = _m_step(n, r["s0"], r["s1"], r["sx0"], r["sx1"], r["sxx0"], r["sxx1"], reg_covar)
        mix = Mixture(w, m, v, 0, False, -math.inf)
        prev = -math.inf
        for it in range(1, max_iter + 1):
            r0, r1, lpn = _resp(X, mix)
            s = xs.agg(F.sum(r0).alias("s0"), F.sum(r1).alias("s1"),
                       F.sum(r0 * X).alias("sx0"), F.sum(r1 * X).alias("sx1"),
                       F.sum(r0 * X * X).alias("sxx0"), F.sum(r1 * X * X).alias("sxx1"),
                       F.avg(lpn).alias("lb")).first()
            lb = float(s["lb"])
            w, m, v = _m_step(n, s["s0"], s["s1"], s["sx0"], s["sx1"], s["sxx0"], s["sxx1"], reg_covar)
            mix = Mixture(w, m, v, it, False, lb)
            if abs(lb - prev) < tol:
                mix.converged = True
                break
            prev = lb
        return mix
    finally:
        xs.unpersist()


def clean_posterior(mix: Mixture, x: str = "x") -> Column:
    """Posterior of the lower-mean component (closed form, 6 literals)."""
    r0, r1, _ = _resp(F.col(x), mix)
    return r0 if mix.clean_component == 0 else r1


def clean_set(scaled: DataFrame, threshold: float = 0.7, x: str = "x", **fit_kw) -> DataFrame:
    """Valid rows whose clean posterior is strictly above ``threshold``.
    Adds ``prob`` and ``chosen`` to every row (NULL x -> not chosen)."""
    mix = fit_gmm(scaled, x, **fit_kw)
    prob = clean_posterior(mix, x) if mix else F.lit(None).cast("double")
    return (scaled.withColumn("prob", F.when(F.col(x).isNotNull(), prob))
            .withColumn("chosen", F.coalesce(F.col("prob") > F.lit(threshold), F.lit(False))))


def warmup_gate(chosen: str, epoch: int, warmup: int) -> Column:
    """Before the warm-up ends every row counts as chosen."""
    return F.col(chosen) if epoch > warmup else F.lit(True)


def split_clean(df: DataFrame, chosen: str = "chosen", valid: str = "valid") -> DataFrame:
    """P7: 'clean' (chosen and valid), 'unchosen' (valid, not chosen), NULL otherwise."""
    return df.withColumn("part", F.when(F.col(valid) & F.col(chosen), F.lit("clean"))
                         .when(F.col(valid), F.lit("unchosen")))


# ---------------------------------------------------------------------------
# Exact per-group top-n by (value desc, id asc) without a window per group

def _kth_largest(df: DataFrame, group: str, val: str, need: dict, buckets: int = 1024,
                 max_rounds: int = 200, ranges: dict | None = None) -> dict:
    """For each group g with need[g] = k >= 1, find the k-th largest value v*,
    the number of rows strictly above it and the number equal to it.
    Histogram refinement: every round is one ``groupBy(group, bucket)`` with
    count/min/max over the rows still in play; the bucket holding the k-th row
    becomes the new interval. ``ranges`` (g -> (lo, hi, n)) saves the first pass."""
    spark = df.sparkSession
    if ranges is None:
        rng = df.groupBy(group).agg(F.min(val).alias("lo"), F.max(val).alias("hi"),
                                    F.count(F.lit(1)).alias("n")).collect()
        ranges = {r[group]: (r["lo"], r["hi"], r["n"]) for r in rng}
    state = {g: {"lo": lo, "hi": hi, "n": n, "k": need[g], "above": 0}
             for g, (lo, hi, n) in ranges.items() if need.get(g, 0) > 0}
    done = {}
    for _ in range(max_rounds):
        for g in [g for g, st in state.items() if st["lo"] == st["hi"]]:
            st = state.pop(g)
            done[g] = (st["lo"], st["above"], st["n"])
        if not state:
            break
        params = spark.createDataFrame([(g, float(st["lo"]), float(st["hi"])) for g, st in state.items()],
                                       f"{group} {dict(df.dtypes)[group]}, _lo double, _hi double")
        v = F.col(val).cast("double")
        bucket = F.least(F.lit(buckets - 1),
                         F.floor((F.col("_hi") - v) / (F.col("_hi") - F.col("_lo")) * F.lit(buckets))).cast("int")
        hist = (df.join(F.broadcast(params), group)
                .filter((v >= F.col("_lo")) & (v <= F.col("_hi")))
                .groupBy(group, bucket.alias("b"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(val).alias("mn"), F.max(val).alias("mx"))
                .collect())
        per = {}
        for r in hist:
            per.setdefault(r[group], []).append((r["b"], r["n"], r["mn"], r["mx"]))
        for g, st in state.items():
            cum = 0
            for b, n, mn, mx in sorted(per.get(g, [])):
                if cum + n >= st["k"]:
                    st["k"] -= cum
                    st["above"] += cum
                    st["lo"], st["hi"], st["n"] = mn, mx, n
                    break
                cum += n
    else:
        raise RuntimeError("selection did not converge")
    return done


def _kth_smallest_id(df: DataFrame, group: str, need: dict, buckets: int = 1024) -> dict:
    """For each group g the need[g]-th smallest ``_id``, in exact integers: every
    round counts the ids of the current interval in ``buckets`` equal parts and
    goes on with the part that holds the wanted one."""
    spark = df.sparkSession
    gtype = dict(df.dtypes)[group]
    state = {r[group]: (int(r["lo"]), int(r["hi"]), need[r[group]]) for r in
             df.groupBy(group).agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).collect() if r[group] in need}
    done = {}
    wide = "cast({} as decimal(38,0))"
    while state:
        done.update({g: lo for g, (lo, hi, _) in state.items() if lo == hi})
        state = {g: v for g, v in state.items() if v[0] < v[1]}
        if not state:
            break
        width = {g: -(-(hi - lo + 1) // buckets) for g, (lo, hi, _) in state.items()}
        params = spark.createDataFrame([(g, lo, hi, str(width[g])) for g, (lo, hi, _) in state.items()],
                                       f"{group} {gtype}, _lo bigint, _hi bigint, _width string")
        bucket = F.expr(f"cast(({wide.format('_id')} - {wide.format('_lo')}) div {wide.format('_width')} as int)")
        hist = (df.join(F.broadcast(params), group).filter("_id between _lo and _hi")
                .groupBy(group, bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("mn"),
                                                       F.max("_id").alias("mx")).collect())   # <= buckets a group
        for g in list(state):
            left = state[g][2]
            for b, n, mn, mx in sorted((r["b"], r["n"], r["mn"], r["mx"]) for r in hist if r[group] == g):
                if left <= n:
                    state[g] = (int(mn), int(mx), left)
                    break
                left -= n
    return done


def top_per_group(df: DataFrame, group: str, val: str, id_col: str, need: dict,
                  buckets: int = 1024, ranges: dict | None = None) -> DataFrame:
    """Rows ranked 1..need[g] within each group by (val desc, id asc), exact."""
    spark = df.sparkSession
    cut = _kth_largest(df, group, val, need, buckets, ranges=ranges)
    gtype = dict(df.dtypes)[group]
    # rows tied at the cut value: when all of them are needed no id cut is
    # required; otherwise the smallest ids win -> k-th largest of -id
    tie_need = {g: need[g] - above for g, (_, above, n_eq) in cut.items() if need[g] - above < n_eq}
    id_cut = {}
    if tie_need:
        ties = df.join(F.broadcast(spark.createDataFrame(
            [(g, float(cut[g][0])) for g in tie_need], f"{group} {gtype}, _v double")), group) \
            .filter(F.col(val).cast("double") == F.col("_v")) \
            .select(group, F.col(id_col).cast("bigint").alias("_id"))
        id_cut = _kth_smallest_id(ties, group, tie_need, buckets)
    big = (1 << 63) - 1
    rows = [(g, float(cut[g][0]), id_cut.get(g, big)) for g in cut]
    if not rows:
        return df.limit(0)
    th = spark.createDataFrame(rows, f"{group} {gtype}, _v double, _id bigint")
    v = F.col(val).cast("double")
    return (df.join(F.broadcast(th), group)
            .filter((v > F.col("_v")) | ((v == F.col("_v")) & (F.col(id_col) <= F.col("_id"))))
            .drop("_v", "_id"))


def top_fraction(scored: DataFrame, rho: float = 0.2, cls: str = "pred", conf: str = "conf",
                 id_col: str = "id", where: str = "matched", buckets: int = 1024) -> DataFrame:
    """Among rows with ``where`` (matched), per predicted class keep the
    ``int(n_j * rho)`` most confident rows (raw max logit, ties by id). Classes
    whose cut is 0 are skipped. Returns the selected rows."""
    from labelloop.session import cut_lineage
    # the matched rows are read by every histogram round and by the final
    # filter: one reliable checkpoint (no cache left pinned, survives executor loss)
    m = cut_lineage(scored.filter(F.col(where)).select(id_col, cls, conf))
    stats = m.groupBy(cls).agg(F.count(F.lit(1)).alias("n"), F.min(conf).alias("lo"),
                               F.max(conf).alias("hi")).collect()          # one row per class
    ranges = {r[cls]: (r["lo"], r["hi"], int(r["n"])) for r in stats}
    need = {g: int(n * rho) for g, (_, _, n) in ranges.items()}
    need = {g: k for g, k in need.items() if k > 0}
    return top_per_group(m, cls, conf, id_col, need, buckets, ranges=ranges)


def top_fraction_window(scored: DataFrame, rho: float = 0.2, cls: str = "pred", conf: str = "conf",
                        id_col: str = "id", where: str = "matched") -> DataFrame:
    """Test twin of ``top_fraction``: the plain window form (one task per class)."""
    m = scored.filter(F.col(where)).select(id_col, cls, conf)
    w = Window.partitionBy(cls).orderBy(F.col(conf).desc(), F.col(id_col).asc())
    n = F.count(F.lit(1)).over(Window.partitionBy(cls))
    return (m.withColumn("_rk", F.row_number().over(w)).withColumn("_n", n)
            .filter(F.col("_rk") <= F.floor(F.col("_n") * F.lit(rho)))
            .drop("_rk", "_n"))
