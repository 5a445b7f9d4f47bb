"""Benchmark decontamination by spaced seeds (operator 9), DataFrame functions only.

Texts become lower-cased runs of letters and digits. A mask keeps some of the words it spans and
ignores the others; every position of every mask is hashed on both sides, and equal hashes join.
A hit fixes an alignment, and the windows of ``WINDOW`` words of the item around it (the whole item
if it is shorter) are compared with the text word by word: in one of them ``MATCH_PERCENT`` must
agree, so some words of a copied passage may be replaced. Masks go by the length of the item: five
words for items of ``SHORT`` words and more, four for shorter ones, three for items of three. They
leave a hit for every way to replace as many words as the comparison allows. Texts are hashed by
the masks that the lengths of the items at hand call for.

The benchmark's hashes are broadcast up to ``MAX_BROADCAST_SEEDS``; beyond that the same hits come
from a shuffled join, and the texts join once more for the comparison. A popular item is only a
repeated match in a scan, never a group.

Nulls: a null text has no words; rows with null ids are judged together, as are repeated ids.
Items of one or two words are no evidence and match nothing. Empty tables match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloop.llm.common import documents

WINDOW, MATCH_PERCENT, LEAST, SHORT = 15, 80, 3, 11
# for items of so many words: masks
MASKS_BY_LENGTH = {(LEAST, LEAST): ("111",), (LEAST + 1, SHORT - 1): ("1111", "11011", "10111", "11101"), (SHORT, None): ("11111", "111101", "111011")}
MASKS = tuple((mask, least, most) for (least, most), masks in MASKS_BY_LENGTH.items() for mask in masks)
MAX_BROADCAST_SEEDS = 1_000_000
_SPAN = max(len(mask) for mask, *_ in MASKS)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hashed_words(df: DataFrame) -> DataFrame:
    """``df`` with ``h``, the hash of each word of ``text``."""
    return df.withColumn("h", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))


def seeds(df: DataFrame, masks: list[int], of_length: Column | None = None) -> DataFrame:
    """``df`` (with ``h``) with one row for each of ``masks`` and position: ``pos`` (from 1), ``mask``,
    ``key``; with ``of_length`` only by the masks for items of that many words."""
    n = F.size("h")
    shifted = [F.slice("h", i, n).alias(f"w{i}") for i in range(2, _SPAN + 1)]
    at = F.when(n > 0, F.arrays_zip(F.sequence(F.lit(1), F.greatest(n, F.lit(1))).alias("pos"), F.col("h").alias("w1"), *shifted))
    x = df.select("*", F.inline(at).alias("pos", *(f"w{i}" for i in range(1, _SPAN + 1))))
    keys = []
    for k in masks:
        mask, least, most = MASKS[k]
        fits = F.col(f"w{len(mask)}").isNotNull()
        if of_length is not None:
            fits = fits & (of_length >= least) & (of_length <= (most or 1 << 30))
        keys.append(F.struct(F.lit(k).alias("mask"), F.when(fits, F.xxhash64(F.lit(k), *(F.col(f"w{i + 1}") for i, c in enumerate(mask) if c == "1"))).alias("key")))
    return x.select(*df.columns, "pos", F.inline(F.array(*keys))).filter("key is not null")


def _span(mask: Column) -> Column:
    return F.element_at(F.array(*(F.lit(len(m)) for m, *_ in MASKS)), mask + 1)


def _agrees() -> Column:
    """Whether a window of the item around the hit agrees with the text on the same alignment."""
    size = F.least(F.col("item_n"), F.lit(WINDOW))
    first = F.greatest(F.lit(1), F.col("item_pos") + _span(F.col("mask")) - size)
    last = F.least(F.col("item_pos"), F.col("item_n") - size + 1)
    shift = F.col("pos") - F.col("item_pos") - 1
    same = F.transform(F.sequence(first, last + size - 1), lambda i: F.when(F.get("item_h", i - 1) == F.get("h", i + shift), 1).otherwise(0))
    enough = lambda s: lambda k: 100 * F.aggregate(F.slice(s, k, size), F.lit(0), lambda x, y: x + y) >= MATCH_PERCENT * size
    return F.exists(F.array(same), lambda s: F.exists(F.sequence(F.lit(1), last - first + 1), enough(s)))


def contaminated_pairs(docs: DataFrame, items: DataFrame, max_broadcast_seeds: int = MAX_BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, n_hits): the alignments that agree, for each pair that has one; equal rows count once."""
    texts = hashed_words(docs).select("doc_id", "h", F.xxhash64("h").alias("text_key"))
    tests = hashed_words(items).select("item_id", F.col("h").alias("item_h"), F.size("h").alias("item_n"), F.xxhash64("h").alias("item_text"), "h").filter(F.col("item_n") >= LEAST)
    within = [F.coalesce(F.max((F.col("item_n") >= least) & (F.col("item_n") <= (most or 1 << 30))), F.lit(False)) for least, most in MASKS_BY_LENGTH]
    held, *classes = tests.agg(F.coalesce(F.sum("item_n"), F.lit(0)), *within).first()
    lengths = [key for key, there in zip(MASKS_BY_LENGTH, classes, strict=True) if there]
    masks = [k for k, (_, *key) in enumerate(MASKS) if tuple(key) in lengths] or [len(MASKS) - 1]
    index = seeds(tests, masks, F.col("item_n")).drop("h").withColumnsRenamed({"pos": "item_pos", "mask": "item_mask", "key": "item_key"})
    on = F.col("key") == F.col("item_key")
    if held * len(masks) <= max_broadcast_seeds:
        # the word hashes of the items follow in a second lookup, so that they are sent once each;
        # rows that share an id are told apart by their words
        held_words = tests.select(F.col("item_id").alias("test_id"), F.col("item_text").alias("test_text"), "item_h", "item_n").dropDuplicates(["test_id", "test_text"])
        hits = (seeds(texts, masks).join(F.broadcast(index.select("item_key", "item_id", "item_text", "item_pos")), on)
                .join(F.broadcast(held_words), F.col("item_id").eqNullSafe(F.col("test_id")) & (F.col("item_text") == F.col("test_text"))))
    else:
        found = seeds(texts, masks).select("doc_id", "text_key", "pos", "mask", "key").join(index.select("item_key", "item_id", "item_text", "item_pos", "item_h", "item_n"), on)
        found = found.withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_text"})
        hits = found.join(texts.dropDuplicates(["doc_id", "text_key"]), F.col("hit_id").eqNullSafe(F.col("doc_id")) & (F.col("hit_text") == F.col("text_key")))
    aligned = hits.filter(_agrees()).select("doc_id", "item_id", "text_key", "item_text", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    return aligned.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_hits"))


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_broadcast_seeds: int = MAX_BROADCAST_SEEDS) -> DataFrame:
    """One row for each row of ``df``: doc_id, contaminated, n_items (benchmark items found in the
    text), n_hits (alignments of them that agree)."""
    docs = documents(df, id_col, text_col)
    items = documents(benchmark, "item_id", "text").withColumnRenamed("doc_id", "item_id")
    found = (contaminated_pairs(docs, items, max_broadcast_seeds).groupBy(F.col("doc_id").alias("found_id"))
             .agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_hits").alias("n_hits")))
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


# Every alignment of every item with every text, with no masks: equal words give the alignments.
DECONTAMINATE_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
dx AS (SELECT row_number() OVER () AS k, id, w FROM d),
bx AS (SELECT row_number() OVER () AS k, id, w, least(len(w), {WINDOW}) AS size FROM b WHERE len(w) >= {LEAST}),
dw AS (SELECT k, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM dx),
bw AS (SELECT k, size, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM bx),
al AS (SELECT dw.k AS dk, bw.k AS bk, dw.p - bw.p AS shift FROM dw JOIN bw ON dw.x = bw.x GROUP BY dw.k, bw.k, bw.size, dw.p - bw.p
  HAVING 100 * count(*) >= {MATCH_PERCENT} * bw.size),
agree AS (SELECT dx.id AS doc_id, bx.id AS item_id FROM al JOIN dx ON dx.k = al.dk JOIN bx ON bx.k = al.bk
  WHERE len(list_filter(range(1, len(bx.w) - size + 2), lambda s: 100 * len(list_filter(range(s, s + size), lambda i:
    i + shift >= 1 AND i + shift <= len(dx.w) AND bx.w[i] = dx.w[i + shift])) >= {MATCH_PERCENT} * size)) > 0),
pair AS (SELECT doc_id, item_id, count(*) AS n FROM agree GROUP BY 1, 2),
found AS (SELECT doc_id, count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_hits FROM pair GROUP BY 1)
SELECT x.doc_id, found.n_items IS NOT NULL AS contaminated, coalesce(found.n_items, 0) AS n_items, coalesce(found.n_hits, 0) AS n_hits
FROM documents x LEFT JOIN found ON x.doc_id IS NOT DISTINCT FROM found.doc_id
"""
