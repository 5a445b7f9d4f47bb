"""Quality classifier: interpolated modified Kneser-Ney model of trusted text (operator 2).

The model is over UTF-8 bytes, order ``ORDER``, each text preceded by zero bytes. Trusted texts are
those whose label rows all say quality 1; every fifth of them (by a hash of the id) sets the
thresholds, the others are counted. All of them are used, so counts grow with the corpus.

Tasks count the n-grams they read; counts are summed by n-gram, continuation counts, discounts and
back-off weights follow from grouped aggregates and joins by context or suffix (at most 256 rows a
key). The finished table is cut into shards by the byte before the predicted one, each of a
bounded number of rows, and each shard is broadcast and scores the positions it holds.

A document is rejected when its perplexity is over the ``QUANTILE`` of trusted texts of its
language by more than ``SLACK``. Texts vary more the shorter they are, so the quantiles are taken
by language and by length class (powers of four).

Nulls: a null text is empty; a null language is a language of its own. A class with fewer than
``MIN_TRUSTED`` trusted texts takes the quantile of its length over all languages; failing that,
texts of ``LONG`` bytes and more take that of their language, then of all texts. All others take the
mean of their length class, merged with its neighbours until there are enough texts, and a margin
that is wider the shorter the text is and the fewer texts there are. With no trusted text at all
everything is kept. Empty texts have no perplexity and are
rejected. Repeated rows are scored each.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloop.llm.common import blocks, documents, held, mixed, settings, stored, text_bytes, tidied

ORDER = 5
QUANTILE, SLACK = 0.995, 0.05
MIN_TRUSTED, LONG = 50, 256
SIZES, DEVIATIONS, BYTE_VARIANCE = 7, 4.0, 4.0
SHARD_ROWS = 1 << 21
MAX_BROADCAST_IDS = 4_000_000
_FLUSH = 1 << 21


def padded(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ``order - 1`` zero bytes before each; where each byte of ``data`` now is."""
    n = np.diff(offsets)
    at = np.arange(len(data)) + (order - 1) * (np.repeat(np.arange(len(n)), n) + 1)
    out = np.zeros(len(data) + (order - 1) * len(n), np.uint64)
    out[at] = data
    return out, at


def codes(text: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each place, as a number of ``order`` bytes."""
    code = np.zeros(len(text), np.uint64)
    for k in range(order):
        code[order - 1:] |= text[k:len(text) - order + 1 + k] << np.uint64(8 * (order - 1 - k))
    return code[at]


def _merged(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code)
    code, n = code[order], n[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(first) else n


def _counter(order: int):
    def run(batches):
        code, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for block in blocks(batch):
                c, m = np.unique(codes(*padded(*text_bytes(block), order), order), return_counts=True)
                code, n = _merged(np.concatenate([code, c]), np.concatenate([n, m]))
                if len(code) > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], ["code", "c"])
                    code, n = code[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], ["code", "c"])
    return run


def _discounts(counts: DataFrame) -> list[float]:
    row = counts.agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5))).first()
    n = [0, *(row[f"n{k}"] or 0 for k in range(1, 5))]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return [0.0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] else 0.5 * k for k in range(1, 4)]


def _discount(d: list[float]) -> Column:
    return F.when(F.col("c") == 1, d[1]).when(F.col("c") == 2, d[2]).otherwise(d[3])


def kneser_ney(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(n, code, gram, value): for ``gram`` the log probability of the last byte of an n-gram after
    the others, else the log back-off weight of a context of n - 1 bytes."""
    counts = [stored(trusted.mapInArrow(tidied(_counter(order)), "code long, c long").groupBy("code").agg(F.sum("c").alias("c")), "ngrams")]
    for n in range(order - 1, 0, -1):
        suffix = F.col("code").bitwiseAND((1 << 8 * n) - 1)
        counts.insert(0, stored(counts[0].groupBy(suffix.alias("code")).agg(F.count(F.lit(1)).alias("c")), "continuations"))
    parts, lower = [], None
    for n, c in enumerate(counts, 1):
        d = _discounts(c)
        context = F.shiftright("code", 8)
        sums = c.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(_discount(d)).alias("cut"))
        sums = sums.withColumn("weight", F.col("cut") / F.col("total"))
        x = c.withColumn("h", context).join(sums, F.col("h") == F.col("context"))
        own = (F.col("c") - _discount(d)) / F.col("total")
        if lower is None:
            p = x.select("code", (own + F.col("weight") / 256).alias("p"))
        else:
            below = lower.select(F.col("code").alias("suffix"), F.col("p").alias("q"))
            p = x.withColumn("s", F.col("code").bitwiseAND((1 << 8 * (n - 1)) - 1)).join(below, F.col("s") == F.col("suffix")).select(
                "code", (own + F.col("weight") * F.col("q")).alias("p"))
        lower = stored(p, "probabilities")
        parts.append(lower.select(F.lit(n).alias("n"), "code", F.lit(True).alias("gram"), F.log("p").alias("value")))
        parts.append(sums.select(F.lit(n).alias("n"), F.col("context").alias("code"), F.lit(False).alias("gram"), F.log("weight").alias("value")))
    return stored(reduce(DataFrame.union, parts), "model")


class Lookup:
    """Values by 64-bit key, open addressing over numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values, used = np.zeros(size, np.uint64), np.zeros(size, np.float64), np.zeros(size, bool)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = ~used[at[todo]]
            slots, first = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[slots], self.values[slots], used[slots] = keys[placed], values[placed], True
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] = (at[todo] + 1) & (size - 1)
        self.values[~used] = np.nan
        self.used = used

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """NaN where there is none."""
        at = self._slot(keys)
        out = self.values[at]
        todo = np.flatnonzero((self.keys[at] != keys) & self.used[at])
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            out[todo] = self.values[at[todo]]
            todo = todo[(self.keys[at[todo]] != keys[todo]) & self.used[at[todo]]]
        return out


class Shard:
    def __init__(self, arrays: dict, order: int):
        self.order = order
        self.grams = {n: Lookup(*arrays[n, True]) for n in range(1, order + 1)}
        self.weights = {n: Lookup(*arrays[n, False]) for n in range(1, order + 1)}

    def __call__(self, code: np.ndarray) -> np.ndarray:
        out, left, value = np.zeros(len(code)), np.arange(len(code)), np.zeros(len(code))
        for n in range(self.order, 0, -1):
            c = code[left] & np.uint64((1 << 8 * n) - 1)
            p = self.grams[n](c)
            hit = ~np.isnan(p)
            out[left[hit]] = value[hit] + p[hit]
            left, c, value = left[~hit], c[~hit], value[~hit]
            if not len(left):
                return out
            value = value + np.nan_to_num(self.weights[n](c >> np.uint64(8)))
        out[left] = value - math.log(256)
        return out


def _scorer(shared, shard: int, shards: int, order: int):
    key = uuid.uuid4().hex

    def run(batches):
        score = held(key, lambda: Shard(shared.value, order))
        for batch in batches:
            for block in blocks(batch):
                data, offsets = text_bytes(block)
                code = codes(*padded(data, offsets, order), order)
                if shards > 1:
                    mine = (code >> np.uint64(8) & np.uint64(255)) % np.uint64(shards) == shard
                    logs = np.zeros(len(code))
                    logs[mine] = score(code[mine])
                else:
                    logs = score(code)
                sums = np.append(0, np.cumsum(logs))[offsets]
                yield pa.RecordBatch.from_arrays([block.column(c) for c in ("doc_id", "lang", "trusted", "uid")]
                                                 + [pa.array(np.diff(sums)), pa.array(np.diff(offsets))], ["doc_id", "lang", "trusted", "uid", "log_prob", "n_bytes"])
    run.holds = True
    return run


def _arrays(rows: DataFrame, order: int) -> dict:
    """A shard of the model (bounded: SHARD_ROWS on average) as numpy arrays."""
    with settings(rows.sparkSession, spark__sql__execution__arrow__pyspark__enabled="true"):
        t = rows.toArrow()
    n, gram = t.column("n").to_numpy(), t.column("gram").to_numpy(zero_copy_only=False)
    code, value = t.column("code").to_numpy().astype(np.uint64), t.column("value").to_numpy()
    return {(k, g): (code[w], value[w]) for k in range(1, order + 1) for g in (True, False) for w in [(n == k) & (gram == g)]}


def log_probabilities(rows: DataFrame, model: DataFrame, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``rows`` (doc_id, text, lang, trusted, uid) scored: log_prob and n_bytes of each text. Where
    several shards add up, rows are told apart by a number that is written with them."""
    shards = min(256, -(-model.count() // shard_rows) or 1)
    if shards > 1:
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        own = rows.select("row", F.col("uid").alias("own_uid"))
        rows = rows.select("doc_id", "text", "lang", "trusted", F.col("row").alias("uid"))
    schema = "doc_id long, lang string, trusted int, uid long, log_prob double, n_bytes long"
    spark = rows.sparkSession
    place = F.when(F.col("gram"), F.shiftright("code", 8)).otherwise(F.col("code")).bitwiseAND(255)
    parts = []
    for s in range(shards):
        held = model.filter((F.col("n") == 1) | (place % shards == s))
        shared = spark.sparkContext.broadcast(_arrays(held.select("n", "code", "gram", "value"), order))
        parts.append(rows.mapInArrow(tidied(_scorer(shared, s, shards, order)), schema))
        if shards > 1:
            parts[-1] = stored(parts[-1], "shard-scores")
            shared.destroy()
    if shards == 1:
        return parts[0]
    sums = reduce(DataFrame.union, parts).groupBy("doc_id", "lang", "trusted", "uid").agg(F.sum("log_prob").alias("log_prob"), F.max("n_bytes").alias("n_bytes"))
    return sums.join(own, F.col("uid") == F.col("row")).select("doc_id", "lang", "trusted", F.col("own_uid").alias("uid"), "log_prob", "n_bytes")


def _quantiles(scored: DataFrame, keys: list[str], q: float, name: str) -> DataFrame:
    """The quantile of ``bin`` by key, from a histogram (some thousand bins)."""
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    x = scored.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    x = x.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    return (x.filter((F.col("upto") >= q * F.col("all")) & (F.col("all") >= MIN_TRUSTED)).groupBy(*keys).agg(F.min("bin").alias(name))
            .select(*(F.col(k).alias(f"{name}_{k}") for k in keys), name))


def _margins(held: DataFrame) -> list[tuple[float, float, float]]:
    """For each length class (mean, deviation, deviation times the root of the length) of the nats a
    byte, neighbouring classes merged until there are ``MIN_TRUSTED`` texts; [] without any text."""
    x = -F.col("log_prob") / F.col("n_bytes")
    rows = held.groupBy("size").agg(F.count(F.lit(1)), F.sum(x), F.sum(x * x), F.sum(1 / F.col("n_bytes"))).collect()  # SIZES at most
    sums = {r[0]: np.array(r[1:], float) for r in rows}
    out = []
    for size in range(SIZES if sums else 0):
        for reach in range(SIZES):
            n, total, squares, inverse = sum((v for k, v in sums.items() if abs(k - size) <= reach), np.zeros(4))
            if n >= MIN_TRUSTED:
                break
        left = max(squares - total * total / n, 0.0)
        few = DEVIATIONS * math.sqrt(max(1.0, MIN_TRUSTED / n))
        by_byte = left / inverse if n >= MIN_TRUSTED else max(left / inverse, BYTE_VARIANCE)
        out.append((float(total / n), few * math.sqrt(left / n), few * math.sqrt(by_byte)))
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.col("doc_id").cast("long").alias("trusted_id")).agg(F.min("quality").alias("q")).filter("q = 1 and trusted_id is not null").select("trusted_id")


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   order: int = ORDER, quantile: float = QUANTILE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each row of ``df``: doc_id, lang, n_bytes, log_prob, perplexity, threshold (null:
    none) and ``kept``."""
    ids = stored(trusted_ids(labels), "trusted")
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = documents(df, id_col, text_col, F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    part = F.pmod(F.xxhash64("trusted_id"), F.lit(5))
    rows = rows.join(ids, F.col("doc_id") == F.col("trusted_id"), "left").select(
        "doc_id", "text", "lang", F.when(F.col("trusted_id").isNull(), 0).when(part == 0, 2).otherwise(1).alias("trusted"))
    model = kneser_ney(rows.filter("trusted = 1").select("text"), order)
    scored = log_probabilities(rows.withColumn("uid", F.xxhash64("text")), model, order, shard_rows)
    scored = scored.withColumn("bin", F.round(F.try_divide("log_prob", "n_bytes") * -1000).cast("long")).withColumn(
        "size", F.when(F.col("n_bytes") > 0, F.least(F.floor(F.log(F.greatest("n_bytes", F.lit(1)).cast("double")) / math.log(4)), F.lit(SIZES - 1))).cast("int"))
    scored = stored(scored, "scores")
    held = scored.filter("trusted = 2 and n_bytes > 0")
    margins = _margins(held) or _margins(scored.filter("trusted = 1 and n_bytes > 0"))  # too few to hold one out
    margin = F.lit(None).cast("double")
    if margins:
        mean, wide, by_byte = (F.element_at(F.array(*map(F.lit, v)), F.col("size") + 1) for v in zip(*margins, strict=True))
        margin = mean + F.greatest(wide, by_byte / F.sqrt(F.greatest("n_bytes", F.lit(1))))
    x = scored
    for keys, name in ((["lang", "size"], "a"), (["size"], "b"), (["lang"], "c"), ([], "d")):
        table = _quantiles(held, keys, quantile, name)  # a row for each language and length class
        on = [F.col(k) == F.col(f"{name}_{k}") for k in keys] or F.lit(True)
        x = x.join(F.broadcast(table), on, "left")
    long = F.when(F.col("n_bytes") >= LONG, F.coalesce("c", "d"))
    x = x.select("doc_id", "lang", "n_bytes", "log_prob", F.exp(-F.try_divide("log_prob", "n_bytes")).alias("perplexity"),
                 F.exp(F.coalesce(F.coalesce("a", "b", long) / 1000, margin) + math.log1p(SLACK)).alias("threshold"))
    return x.withColumn("kept", F.when(F.col("n_bytes") == 0, False).otherwise(F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))))
