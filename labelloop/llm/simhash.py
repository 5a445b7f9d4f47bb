"""SimHash near-dedup by deletion-variant signatures (operator 5).

A fingerprint is cut into two 32-bit segments. Two fingerprints at two bits or less agree in one
segment up to one bit, so each fingerprint is indexed under 2 x 32 variants of a segment with one
bit wiped out; equal variants meet in an equality join and are verified on all 64 bits.

Only distinct fingerprints are indexed (copies collapse first). A group of one variant is searched
outwards from one member, which gives a spanning forest of its links: no more edges than members,
and the same reachability as all links. A variant can only be held by more than ``HOT``
fingerprints if a whole segment value is; those groups are cut by blocks of the other segment (two
differing bits leave one of three blocks equal, twice), which bounds a group by 2**15 values.

Nulls: a null text is empty and has fingerprint zero; a row with a null id has no component.
Repeated rows of an id are one node; texts without words link to each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloop.llm.common import documents, stored, tidied
from labelloop.llm.components import SALT, components

WORDS, SEED, BITS = 3, 42, 2
HOT = 1 << 15
_SLICE = 1 << 16


def shingle_hashes(text: bytes, n_words: int = WORDS) -> np.ndarray:
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < n_words:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    parts = zip(*(words[i:] for i in range(n_words)), strict=False)
    return np.fromiter((digest(b" ".join(p), SEED) for p in parts), np.uint64, len(words) - n_words + 1)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes (none: zero); as a signed 64-bit value."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLICE):
        bits = np.unpackbits(hashes[at:at + _SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([simhash(shingle_hashes(t.as_py().encode(), n_words)) for t in batch.column("text")], pa.int64())],
                ["doc_id", "fp"])
    return docs.mapInArrow(tidied(run), "doc_id long, fp long")


def _segment(which):
    return F.when(which == 0, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))


def variants(fps: DataFrame) -> DataFrame:
    """(variant, sub, fp, first): 64 rows for each fingerprint. ``variant`` is number and segment
    without one bit; ``sub`` is -1, or the block of the other segment for groups that may be hot."""
    hot = (fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg")).select("seg", _segment(F.col("seg")).alias("value"))
           .groupBy("seg", "value").count().filter(F.col("count") > HOT // 2))
    x = fps.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(63))))
    seg = F.shiftright("number", 5)
    bit = F.expr("shiftleft(1L, number & 31)")
    x = x.withColumn("variant", F.expr("shiftleft(cast(number as bigint), 32)").bitwiseOR(_segment(seg).bitwiseAND(F.bitwise_not(bit))))
    if hot.isEmpty():
        return x.select("variant", F.lit(-1).alias("sub"), "fp", "first")
    keys = (hot.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(31))))
            .select(F.expr("shiftleft(cast(seg * 32 + n as bigint), 32) | (value & ~shiftleft(1L, n))").alias("variant"), F.lit(True).alias("hot")).distinct())
    x = x.join(keys, "variant", "left").withColumn("other", _segment(1 - seg))
    blocks = []
    for b in range(3):
        cuts = [0, 11, 22, 32]
        block = f"(shiftright(other, {cuts[b]}) & {(1 << cuts[b + 1] - cuts[b]) - 1})"
        rest = f"((other & {(1 << cuts[b]) - 1}) | shiftleft(shiftright(other, {cuts[b + 1]}), {cuts[b]}))"
        blocks += [f"cast({b * 3 + c} * 1048576 + {block} * 256 + (shiftright({rest}, {8 * c}) & 255) as int)" for c in range(3)]
    subs = F.when(F.col("hot"), F.expr(f"array({', '.join(blocks)})")).otherwise(F.array(F.lit(-1)))
    return x.select("variant", F.explode(subs).alias("sub"), "fp", "first")


def forest(fp: np.ndarray, node: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Links that span the components of one group: search outwards, each member reached once."""
    us, vs, rest = [], [], np.arange(len(fp))
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            parent = np.zeros(len(rest), np.int64)
            for at in range(0, len(front), 64):
                near = np.bitwise_count(fp[front[at:at + 64], None] ^ fp[None, rest]) <= max_bits
                hit = near.any(axis=0) & ~reached
                parent[hit] = front[at + near[:, hit].argmax(axis=0)]
                reached |= hit
            us.append(node[parent[reached]]), vs.append(node[rest[reached]])
            front, rest = rest[reached], rest[~reached]
    return us, vs


def _linker(max_bits: int):
    """Over rows sorted by (variant, sub): the links of each run of equal keys."""
    def emit(v, s, fp, node):
        new = np.append(True, (v[1:] != v[:-1]) | (s[1:] != s[:-1]))
        cuts = np.append(np.flatnonzero(new), len(v))
        us, vs = [], []
        for i in np.flatnonzero(np.diff(cuts) > 1):
            a, b = forest(fp[cuts[i]:cuts[i + 1]], node[cuts[i]:cuts[i + 1]], max_bits)
            us += a
            vs += b
        pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1) if us else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    def run(batches):
        held = [np.zeros(0, k) for k in (np.int64, np.int32, np.uint64, np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(n).to_numpy() for n in ("variant", "sub", "fp", "first")]
            cols[2] = cols[2].view(np.uint64)
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = [x[cut:] for x in cols]
            if cut:
                yield emit(*(x[:cut] for x in cols))
        if len(held[0]):
            yield emit(*held)
    return run


def simhash_links(fps: DataFrame, max_bits: int = BITS) -> DataFrame:
    """``fps`` (fp, first), distinct: (u, v) of ``first``, whose components are those of all links."""
    if max_bits > 2:
        raise ValueError("two segments find differences of two bits at most")
    keyed = variants(fps)
    return keyed.repartition("variant", "sub").sortWithinPartitions("variant", "sub").mapInArrow(tidied(_linker(max_bits)), "u long, v long").distinct()


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, max_bits: int = BITS) -> DataFrame:
    """One row for each row of ``df``: doc_id, fingerprint (16 hex digits), component_id (the
    smallest id that can be reached over links of ``max_bits`` or fewer differing bits)."""
    marked = stored(fingerprints(documents(df, id_col, text_col), n_words), "fingerprints")
    fps = stored(marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    near = components(simhash_links(fps.select("fp", "first"), max_bits))
    labels = (fps.join(near, F.col("first") == F.col("node"), "left").filter("n > 1 or node is not null")
              .select(F.col("fp").alias("label_fp"), F.coalesce("component", "first").alias("label"),
                      F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part")))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    return (salted.join(labels, (F.col("fp") == F.col("label_fp")) & (F.col("salt") == F.col("part")), "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id")))
