"""Corpus tokenising jobs (T1-T4) and vocabulary operators.

Vocabulary build is a word count with partial aggregation (hot pieces such as
"▁the" are combined map-side, so the shuffle carries one row per piece and
partition). Every piece of the corpus is kept; ids follow the global order of
the counts and are numbered by partition offsets.

Encoding and decoding look pieces up where they are: a vocabulary within the
byte budget is broadcast, the distinct pieces (or ids) of an Arrow batch are looked
up once, and nothing is shuffled. Of a larger vocabulary the smallest ids - the most
frequent pieces - are broadcast up to the budget, and only the other distinct pieces
of each batch are joined: texts stay behind, a piece travels once for each batch, and
the rows of a batch meet what was found for them. Both give the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloop.functions.batches import ROWS, runs, small, tidy
from labelloop.session import arrow_rows, ensure_parallelism, stored
from labelloop.sources.tables import numbered
from labelloop.functions.text import (CLS_ID, PAD_ID, SEP_ID, SPECIAL_TOKENS, UNK_ID, WORD_MARK,
                                      arrow_pieces, normalise, word_pieces)

SALT = 8
VOCAB_BUDGET = 64 << 20      # bytes of a vocabulary (texts, and 16 for each entry) that may be broadcast
JOIN_BUDGET = 16 << 20       # the same for a broadcast join
CODED_BYTES = 8 << 20        # of texts whose distinct pieces are looked up at once
PROBED = 1 << 18             # entries of a vocabulary that are compared at once


def pieces(df: DataFrame, text_col: str = "text", out: str = "pieces", lower: bool = False) -> DataFrame:
    """Normalised word pieces of every text (whole texts)."""
    return df.withColumn(out, word_pieces(normalise(F.col(text_col), lower=lower)))


def build_vocab(texts: DataFrame, text_col: str = "text", lower: bool = False, specials=SPECIAL_TOKENS) -> DataFrame:
    """(token, token_id, count). Special tokens take ids 0..S-1, then every
    piece by count descending, token ascending. The result reads a written
    table: the corpus is counted once however often it is used."""
    counts = (piece_counts(texts.select(text_col), text_col, lower=lower)
              .filter(~F.col("token").isin(*specials))
              .groupBy("token").agg(F.sum("n").alias("count")))
    with arrow_rows(texts.sparkSession, ROWS):
        ranked = numbered(counts.orderBy(F.col("count").desc(), F.col("token").asc()), "token_id", len(specials), "vocab")
    special = texts.sparkSession.createDataFrame(pa.table([pa.array(specials, pa.string()), pa.array(range(len(specials)), pa.int32()), pa.array([0] * len(specials), pa.int64())],
                                                          ["token", "token_id", "count"]))
    return special.unionByName(ranked.select("token", F.col("token_id").cast("int").alias("token_id"), "count"))


def piece_counts(texts: DataFrame, text_col: str = "text", lower: bool = False) -> DataFrame:
    """(token, n): piece counts of every slice of a batch, computed by Arrow kernels
    (``value_counts``) - a map-side combine before the shuffle."""
    def run(batches):
        for b in (x for batch in batches for x in small(batch)):
            if b.num_rows == 0:
                continue
            flat = arrow_pieces(b.column(0), lower=lower).flatten()
            if len(flat) == 0:
                continue
            vc = pc.value_counts(flat)
            yield pa.RecordBatch.from_arrays([vc.field("values"), vc.field("counts")], names=["token", "n"])
    return ensure_parallelism(texts.select(text_col)).mapInArrow(tidy(run), "token string, n bigint")


def vocab_size(vocab: DataFrame) -> DataFrame:
    """T4."""
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"))


def _salted_join(long: DataFrame, vocab: DataFrame, on: str, spread: str) -> DataFrame:
    """Left join of the vocabulary on ``on``; rows of one key are dealt over
    ``SALT`` parts by ``spread``, the vocabulary is repeated as often."""
    v = vocab.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return long.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int")).join(v, [on, "__salt"], "left").drop("__salt")


def _head(vocab: DataFrame, budget: int) -> int | None:
    """The id below which the entries fit the budget; None if all of them do."""
    of = F.sum(F.octet_length("token") + 16).alias("n")
    all_ = vocab.agg(of, F.max("token_id").alias("last")).first()
    if (all_["n"] or 0) <= budget:
        return None
    width = all_["last"] // 4096 + 1
    cut = held = 0
    for r in sorted(vocab.groupBy(F.floor(F.col("token_id") / width).cast("bigint").alias("at")).agg(of).collect()):     # 4,096 rows
        held += r["n"]
        if held > budget:
            break
        cut = (r["at"] + 1) * width
    return cut


def _broadcast_vocab(vocab: DataFrame, budget: int):
    """(tokens, ids) in id order as a broadcast, as far as they fit the budget; the vocabulary beyond (None: nothing)."""
    cut = _head(vocab, budget)
    rest = None if cut is None else vocab.filter(F.col("token_id") >= cut)
    t = (vocab if cut is None else vocab.filter(F.col("token_id") < cut)).select(F.col("token_id").cast("int").alias("token_id"), "token").orderBy("token_id").toArrow()
    tokens = t.column("token").combine_chunks()
    return vocab.sparkSession.sparkContext.broadcast((tokens if isinstance(tokens, pa.Array) else pa.array([], pa.string()), t.column("token_id").to_numpy().astype(np.int64))), rest


def _cut(batch: pa.RecordBatch, lower: bool, most: int | None):
    """(pieces of all rows that fit ``most``, how many of each row, pieces of each whole row)."""
    toks = arrow_pieces(batch.column(1), lower=lower)
    offs = np.asarray(toks.offsets)
    lens = np.diff(offs)
    keep = lens if most is None else np.minimum(lens, most)
    at = np.repeat(offs[:-1] - (np.cumsum(keep) - keep), keep) + np.arange(keep.sum())
    return toks.flatten().take(pa.array(at - offs[0])), keep, lens


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(df: DataFrame, vocab: DataFrame, text_col: str = "text", max_length: int | None = 128,
           lower: bool = False, id_col: str = "id", prefix: str = "", budget: int = VOCAB_BUDGET) -> DataFrame:
    """Normalise -> pieces -> ids (UNK default) -> [CLS] ids [SEP] -> truncate /
    pad to ``max_length`` with an attention mask (None: whole texts, no padding). Also
    returns ``n_tokens``, the piece count of the whole text before truncation. Whole
    texts are cut into pieces; those that truncation drops need no id and do not travel."""
    shared, rest = _broadcast_vocab(vocab, budget)
    names = [id_col, f"{prefix}input_ids", f"{prefix}attention_mask", f"{prefix}n_tokens"]
    schema = f"{id_col} bigint, {prefix}input_ids array<int>, {prefix}attention_mask array<int>, {prefix}n_tokens bigint"
    texts = ensure_parallelism(df.select(F.col(id_col).cast("bigint").alias(id_col), F.coalesce(F.col(text_col), F.lit(""))))

    def run(batches):
        for b, ids, codes, _, keep, lens in _coded(batches, shared.value, lower, max_length):
            yield pa.RecordBatch.from_arrays([ids, *_framed(codes, keep, max_length), pa.array(lens)], names=names)
    if rest is None:
        return texts.mapInArrow(tidy(run), schema)

    def cut(batches):
        last = None
        for b, ids, codes, unknown, keep, lens in _coded(batches, shared.value, lower, max_length):
            yield _part(ids, codes, keep, pa.array(lens), b, unknown if b != last else unknown.slice(0, 0))
            last = b

    def fill(rows: pa.Table, found: pa.Table) -> pa.Table:
        codes, sizes = _flat(rows.column("codes"))
        slots = np.full(max(0, -int(codes.min(initial=0))), UNK_ID, np.int64)
        slots[found.column("slot").to_numpy()] = found.column("token_id").to_numpy()
        out, start = [], np.concatenate([[0], np.cumsum(sizes)])
        for part in runs(sizes, 1 << 18):       # codes that are framed at once
            c = codes[start[part.start]:start[part.stop]]
            beyond = c < 0
            c[beyond] = slots[-c[beyond] - 1]
            out.append(_framed(c, sizes[part], max_length))
        return pa.table([rows.column("id"), *(pa.chunked_array(x, pa.list_(pa.int32())) for x in zip(*out, strict=True)), rows.column("n")], names=names)
    with arrow_rows(df.sparkSession, 4 * ROWS):
        rows = stored(texts.mapInArrow(tidy(cut), _PART.format("string")), "pieces")
    found = _beyond(rows, "token").join(rest.select("token", F.col("token_id").cast("bigint").alias("token_id")), "token").select("of_batch", "slot", "token_id")
    return rows.select("id", "codes", "n", "batch").groupBy("batch").cogroup(found.groupBy("of_batch")).applyInArrow(fill, schema)


# Rows of one Arrow batch: codes are ids, or -1 - the place in ``tail`` (on the first row of a batch).
_PART = "id bigint, codes array<int>, n bigint, batch bigint, tail array<{}>"


def _part(ids, codes, sizes, n, batch: int, tail) -> pa.RecordBatch:
    offsets = np.full(len(ids) + 1, len(tail), np.int32)
    offsets[0] = 0
    return pa.RecordBatch.from_arrays([ids, _lists(codes, sizes), n, pa.array(np.full(len(ids), batch, np.int64)), pa.ListArray.from_arrays(pa.array(offsets), tail)],
                                      ["id", "codes", "n", "batch", "tail"])


def _beyond(rows: DataFrame, name: str) -> DataFrame:
    """(of_batch, slot, name): what the broadcast does not have."""
    return rows.select(F.col("batch").alias("of_batch"), F.posexplode("tail").alias("slot", name))


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of lists of integers; a NULL value is -1, a NULL list empty."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    return np.array(pc.fill_null(pc.list_flatten(lists), -1), np.int64), sizes.astype(np.int64)


def _coded(batches, vocab: tuple, lower: bool, max_length: int | None):
    """(number of the batch, ids, codes, unknown pieces, how many codes of each row, pieces of each whole
    row) for slices of every batch of (id, text), which has ``CODED_BYTES`` at most; the distinct pieces of
    a batch are looked up once."""
    tokens, token_ids = vocab
    most = None if max_length is None else max_length - 2
    at = TaskContext.get().partitionId() << 33
    for batch in (x for whole in batches for x in small(whole, CODED_BYTES)):
        if batch.num_rows == 0:
            continue
        parts = []
        for b in small(batch):
            flat, keep, lens = _cut(b, lower, most)
            flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
            parts.append((b.column(0), flat.dictionary_encode(), keep, lens))
        coded = pa.chunked_array([x[1] for x in parts]).unify_dictionaries()
        distinct = coded.chunk(0).dictionary
        of_piece = _looked_up(distinct, tokens, token_ids)
        known = of_piece >= 0
        of_piece[~known] = -1 - np.arange((~known).sum())
        unknown = distinct.filter(pa.array(~known))
        for (ids, _, keep, lens), chunk in zip(parts, coded.chunks, strict=True):
            yield at, ids, of_piece[chunk.indices.to_numpy()] if len(chunk) else np.zeros(0, np.int64), unknown, keep, lens.astype(np.int64)
        at += 1


def _looked_up(distinct: pa.Array, tokens: pa.Array, token_ids: np.ndarray) -> np.ndarray:
    """The id of each of ``distinct``, -1 without one. The vocabulary is compared with the pieces, part by
    part: the table that is built for it has the size of a batch, not of the vocabulary."""
    out = np.full(len(distinct), -1, np.int64)
    for at in range(0, len(tokens), PROBED):
        where = pc.index_in(tokens.slice(at, PROBED), value_set=distinct)
        out[where.drop_null().to_numpy()] = token_ids[at:at + PROBED][np.asarray(where.is_valid())]
    return out


def _framed(codes: np.ndarray, keep: np.ndarray, max_length: int | None) -> tuple[pa.Array, pa.Array]:
    """[CLS] ids [SEP], padded, and the mask; a code below 0 is unknown."""
    n = keep + 2
    width = n if max_length is None else np.full(len(n), max_length)
    start = np.cumsum(width) - width
    row, mask = np.full(int(width.sum()), PAD_ID, np.int64), np.zeros(int(width.sum()), np.int64)
    row[start], row[start + n - 1] = CLS_ID, SEP_ID
    row[np.repeat(start + 1 - (np.cumsum(keep) - keep), keep) + np.arange(keep.sum())] = np.where(codes < 0, UNK_ID, codes)
    mask[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())] = 1
    return _lists(row, width), _lists(mask, width)


def token_ids_join(tokens: DataFrame, vocab: DataFrame, id_col: str = "id", tokens_col: str = "pieces") -> DataFrame:
    """``posexplode`` -> left join vocabulary -> UNK default."""
    long = tokens.select(id_col, F.posexplode(tokens_col).alias("pos", "token"))
    j = _salted_join(long, vocab.select("token", "token_id"), "token", id_col)
    return j.select(id_col, "pos", "token", F.coalesce("token_id", F.lit(UNK_ID)).alias("token_id"))


def id_to_token(ids_long: DataFrame, vocab: DataFrame, id_col: str = "token_id", budget: int = JOIN_BUDGET) -> DataFrame:
    """Id -> token (unknown ids give NULL). The frequent ids meet a broadcast and stay where they
    are, the others are shuffled; of a larger vocabulary ``ids_long`` is read twice."""
    v = vocab.select(F.col("token_id").alias(id_col), "token")
    cut = _head(vocab, budget)
    if cut is None:
        return ids_long.join(F.broadcast(v), id_col, "left")
    low = F.coalesce(F.col(id_col) < cut, F.lit(False))
    here = ids_long.filter(low).join(F.broadcast(v.filter(F.col(id_col) < cut)), id_col, "left")
    return here.unionByName(ids_long.filter(~low).join(v.filter(F.col(id_col) >= cut), id_col, "left"))


def decode(encoded: DataFrame, vocab: DataFrame, id_col: str = "id", ids_col: str = "input_ids",
           skip_special: bool = True, budget: int = VOCAB_BUDGET) -> DataFrame:
    """Ids -> pieces -> text (F20), special ids dropped, unknown ids skipped."""
    first = len(SPECIAL_TOKENS) if skip_special else 0
    shared, rest = _broadcast_vocab(vocab, budget)
    lists = encoded.select(F.col(id_col).cast("bigint").alias(id_col), F.col(ids_col).cast("array<int>"))

    def places(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids are in the broadcast, and which are in it."""
        _, ids = shared.value
        at = np.minimum(np.searchsorted(ids, flat), max(len(ids) - 1, 0))
        return at, (flat >= first) & (ids[at] == flat) if len(ids) else np.zeros(len(flat), bool)

    def run(batches):
        for b in (x for batch in batches for x in small(batch)):
            flat, sizes = _flat(b.column(1))
            at, good = places(flat)
            yield pa.RecordBatch.from_arrays([b.column(0), _joined(shared.value[0], at, good, sizes)], names=[id_col, "text"])
    if rest is None:
        return lists.mapInArrow(run, f"{id_col} bigint, text string")
    beyond_from = _first_id(rest)

    def cut(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat, _ = _flat(batch.column(1))
            tail = np.unique(flat[(flat >= max(first, beyond_from))])
            for i, b in enumerate(small(batch)):
                flat, sizes = _flat(b.column(1))
                at, good = places(flat)
                codes, far = np.where(good, at, 0), flat >= max(first, beyond_from)
                codes[far] = -1 - np.searchsorted(tail, flat[far])
                held = good | far
                kept = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[held], minlength=len(sizes))
                yield _part(b.column(0), codes[held], kept, pa.array(kept.astype(np.int64)), number, pa.array(tail.astype(np.int32)) if i == 0 else pa.array([], pa.int32()))
            number += 1

    def fill(rows: pa.Table, found: pa.Table) -> pa.Table:
        tokens = shared.value[0]
        slot = found.column("slot").to_numpy()
        extra = found.column("token").combine_chunks()
        extra = extra if isinstance(extra, pa.Array) else pa.array([], pa.string())
        codes, sizes = _flat(rows.column("codes"))
        where = np.full(max(0, -int(codes.min(initial=0))), -1, np.int64)
        where[slot] = np.arange(len(slot))
        out, start = [], np.concatenate([[0], np.cumsum(sizes)])
        for part in runs(sizes, 1 << 18):       # codes of texts that are joined at once
            c = codes[start[part.start]:start[part.stop]]
            far = c < 0
            at = c.copy()
            at[far] = where[-c[far] - 1]
            good = at >= 0
            at[far & good] += len(tokens)
            mine = np.unique(at[good])
            near = mine[mine < len(tokens)]
            both = pa.concat_arrays([tokens.take(pa.array(near)), extra.take(pa.array(mine[len(near):] - len(tokens)))])
            out.append(_joined(both, np.searchsorted(mine, at), good, sizes[part]))
        return pa.table([rows.column("id"), pa.chunked_array(out, pa.string())], names=[id_col, "text"])
    rows = stored(lists.mapInArrow(cut, _PART.format("int")), "ids")
    found = _beyond(rows, "token_id").join(rest.select(F.col("token_id").cast("int").alias("token_id"), "token"), "token_id").select("of_batch", "slot", "token")
    return rows.select("id", "codes", "batch").groupBy("batch").cogroup(found.groupBy("of_batch")).applyInArrow(fill, f"{id_col} bigint, text string")


def _first_id(rest: DataFrame) -> int:
    return rest.agg(F.min("token_id").alias("n")).first()["n"]


def _joined(tokens: pa.Array, at: np.ndarray, good: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The texts of rows of ``sizes`` places in ``tokens``; only ``good`` ones count."""
    kept = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[good], minlength=len(sizes))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)), tokens.take(pa.array(at[good])))
    return pc.utf8_trim(pc.replace_substring(pc.binary_join(lists, ""), WORD_MARK, " "), " ")


def vocab_merge(base: DataFrame, added: DataFrame) -> DataFrame:
    """U4: base vocabulary plus added tokens; an added token wins on conflict."""
    u = (base.select("token", "token_id", F.lit(0).alias("prio"))
         .unionByName(added.select("token", "token_id", F.lit(1).alias("prio"))))
    return u.groupBy("token").agg(F.max_by("token_id", "prio").alias("token_id"))


def vocab_gaps(vocab: DataFrame) -> DataFrame:
    """Ids that do not follow their predecessor (the save-time warning). The
    predecessor of an id is the largest id below it: windows run inside ranges of
    ids, and the largest id before each range comes from one row per range."""
    x = vocab.select("token", "token_id").withColumn("__range", F.shiftright("token_id", 16))
    last = x.groupBy("__range").agg(F.max("token_id").alias("__last"))
    before = last.select(F.col("__range").alias("__r"), F.lag("__last").over(Window.orderBy("__range")).alias("__before"))  # one row for 65,536 ids
    prev = F.lag("token_id").over(Window.partitionBy("__range").orderBy("token_id"))
    x = x.withColumn("__prev", prev).join(before, F.col("__range") == F.col("__r"))
    return (x.withColumn("expected", F.coalesce(F.coalesce("__prev", "__before") + 1, F.lit(0)))
            .filter(F.col("token_id") != F.col("expected")).select("token", "token_id", "expected"))
