"""Exact substring dedup (suffix-array dedup, operator 6).

A byte is removed when a ``length``-byte string that covers it also starts in a document with a
smaller id. Two suffixes that begin with the same 50 bytes are a tie of that length, so the work
is to sort the suffixes by their first 50 bytes, bucket by bucket, and to take the smallest
document of every tie.

The cover sample bounds what is sorted. Its suffixes are chosen by content (the smallest 20-byte
string of every 50-byte window), which keeps the property of a difference cover that matters
here: two suffixes that agree in 50 bytes reach sample suffixes after the same number of bytes.
About one suffix in 16 is in the sample; a residue cover would take one in five and would still
leave every other suffix to be sorted.

1. Each maximal run of suffixes with one sample suffix is a *segment*. Buckets of sample suffixes
   are sorted one at a time by (20-byte string, whole segment). Equal segments get one rank, and
   the smallest document of a rank settles the long ties of all its suffixes at once.
2. Only the first document of a rank can be open. The suffixes of a segment that start far before its
   sample string share the bytes around it, the others those after it: a half is open where 16 bits of
   a hash of these bytes are those of another document at the same string. Open suffixes (edges of a passage,
   places of an edit) are sorted by their 50 bytes in buckets.
3. Settled suffixes become byte spans, which join the texts once.

Strings are compared by two independent 64-bit hashes (128 bits). A bucket holds about
``BUCKET`` rows; their number follows the input, so the memory of a task does not. Entries leave a task
in chunks of about ``CHUNK``, one row for each bucket: places in the chunk and documents as differences,
bytes of equal weight side by side, so that an entry takes the same room however many buckets there are. What
tells the chunk's texts apart goes once from the chunk to its answers. The segments go to their buckets
in ``WAVES``, one after the other, so that a part of them is on disk at a time. Entries are counted
by bucket first; where a bucket is over twice the size, the strings in it with ``BUCKET / 4`` entries
and more take another way: the smallest document of each rank by a grouped aggregate, joined back
salted, so that no task holds all the places of a string that occurs everywhere.

Nulls: a null text is empty; a row with a null id is kept as it is. Repeated ids are one document
(neither copy is smaller), each row keeps its own text. Empty and short texts lose nothing.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloop.llm.common import blocks, documents, give_back, mixed, stored, text_bytes, tidied, total_bytes, unused

LENGTH, SAMPLE = 50, 20
BUCKET, SALT = 1 << 19, 8
CHUNK, WAVES = 1 << 18, 2
SETTLED, NEAR, FAR = 1, 2, 4     # states of an entry: all of it, its later suffixes, its earlier suffixes open
MULT = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@lru_cache(maxsize=None)
def _letters(which: int) -> np.ndarray:
    return np.random.default_rng(97 + which).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


_POWERS: dict = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, inv = np.full(size, MULT[which], np.uint64), np.full(size, pow(MULT[which], -1, 2**64), np.uint64)
        up[0] = inv[0] = 1
        np.cumprod(up, out=up), np.cumprod(inv, out=inv)
        have = _POWERS[which] = (up, inv)
    return have


class Hashes:
    """Polynomial hashes modulo 2**64 of any substring of ``data``, from one prefix sum."""

    def __init__(self, data: np.ndarray, which: int):
        n = len(data)
        up, self.inv = _powers(which, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_letters(which)[data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inv[start])

    def all(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:-k]) * self.inv[:n])


def cover_sample(data: np.ndarray, offsets: np.ndarray, length: int, k: int, strings_only: bool = False):
    """Segments (row, first suffix, number of suffixes, how many of them start far before the sample string, hashes
    of the sample string and of the segment, 16 bits each of hashes of what the near and the far suffixes share).
    ``strings_only``: the hashes of the sample strings."""
    n = len(data)
    if n < length:
        return None
    one = Hashes(data, 0)
    grams = one.all(k)
    bits = np.uint64(max(1, int(n).bit_length()))
    v = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - k + 1, 1
    while have < width:
        step = min(have, width - have)
        v = np.minimum(v[:-step], v[step:])
        have += step
    anchor = (v & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(anchor)]
    ok = np.arange(len(anchor)) + length <= offsets[row + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new & ok)
    if not len(first):
        return None
    at = anchor[first]
    if strings_only:
        return grams[at]
    stop = np.flatnonzero(np.append(new, True))
    last = np.minimum(stop[np.searchsorted(stop, first, side="right")], offsets[row[first] + 1] - length + 1)
    name = mixed(Hashes(data, 1).of(first, last + (length - 1)) + ((at - first) * 64 + (last - first)).astype(np.uint64))
    half = (length - k) // 2
    far = np.clip(at - half - first, 0, last - first)
    near_core = one.of(at, np.minimum(at + length - half, n))      # whole where there is a near suffix
    far_core = one.of(np.maximum(at - half - 1, 0), at + k)
    return row[first], first - offsets[row[first]], last - first, far, grams[at], name, near_core.astype(np.uint16), far_core.astype(np.uint16)


def _as_batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers as differences, bytes of equal weight side by side."""
    return np.ascontiguousarray(np.diff(a, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel())


_ENTRIES = "bucket int, chunk long, head binary, pos binary, doc binary, w binary, far binary, k1 binary, k2 binary, cores binary"
_ANSWERS = "chunk long, head binary, pos binary, w binary, far binary, state binary"
_ENTRY_NAMES, _ANSWER_NAMES = ([x.split()[0] for x in y.split(", ")] for y in (_ENTRIES, _ANSWERS))
_ENTRY_TYPES, _ANSWER_TYPES = [pa.int32(), pa.int64()] + [pa.binary()] * 8, [pa.int64()] + [pa.binary()] * 5


def _chunk_rows(n_buckets: int, seq: int, parts: list[tuple]) -> list[tuple]:
    """One row for each bucket: places in the chunk, documents and, in their order, the entries; and the
    head, a row of its own: id and hash of each text, and where it starts."""
    base, heads, entries = 0, [], []
    for ids, th, offsets, row, s, *entry in parts:
        starts = base + offsets[:-1]
        heads.append(np.stack([ids, th, starts]).astype(np.int64))
        entries.append((starts[row] + s, ids[row], *entry))
        base += int(offsets[-1])
    head = np.concatenate(heads, axis=1).tobytes()
    task = TaskContext.get().partitionId()
    # of the content too: a task that runs again on other rows makes other chunks, never a mixed one
    chunk = int.from_bytes(hashlib.blake2b(head, digest_size=8, salt=seq.to_bytes(8, "little"), person=task.to_bytes(8, "little")).digest(), "little", signed=True)
    pos, doc, w, far, k1, k2, near_core, far_core = (np.concatenate(x) for x in zip(*entries, strict=True))
    bucket = (k1 % np.uint64(n_buckets)).astype(np.uint16 if n_buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order].astype(np.int64)
    cuts = np.flatnonzero(np.diff(sorted_bucket, prepend=-1, append=n_buckets))
    pos, doc, w, far, k1, k2, near_core, far_core = (x[order] for x in (pos, doc, w.astype(np.uint8), far.astype(np.uint8), k1, k2, near_core, far_core))
    out = [(-1 - chunk % n_buckets, chunk, head, *[None] * 7)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out.append((int(sorted_bucket[a]), chunk, None, _packed(pos[a:b]), _packed(doc[a:b]), *(x[a:b].tobytes() for x in (w, far, k1, k2)),
                    near_core[a:b].tobytes() + far_core[a:b].tobytes()))
    return out


def _sampled(length: int, k: int):
    """The segments of each block of texts: (ids, th, offsets, row, s, w, far, k1, k2, near_core, far_core)."""
    def run(batches, strings_only=False):
        for batch in batches:
            for block in blocks(batch):
                data, offsets = text_bytes(block)
                found = cover_sample(data, offsets, length, k, strings_only)
                if found is not None:
                    yield found if strings_only else (block.column("doc_id").to_numpy(), block.column("th").to_numpy(), offsets, *found)
    return run


def _opened(length: int):
    """The open suffixes of each block of texts, one entry each."""
    def run(batches, strings_only=False):
        for batch in batches:
            for block in blocks(batch):
                data, offsets = text_bytes(block)
                if len(data) < length:
                    continue
                seg = [np.unique(np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64).reshape(2, -1) for x in xs], axis=1), axis=1)
                       for xs in block.column("open").to_pylist()]
                row = np.repeat(np.arange(len(seg)), [x.shape[1] for x in seg])
                s, w = np.concatenate(seg, axis=1)
                row, s = np.repeat(row, w), np.repeat(s, w) + _counting(w)
                at = s + offsets[row]
                k1 = Hashes(data, 0).of(at, at + length)
                if strings_only:
                    yield k1
                    continue
                none = np.zeros(len(s), np.uint16)
                yield block.column("doc_id").to_numpy(), block.column("th").to_numpy(), offsets, row, s, none + 1, none, k1, Hashes(data, 1).of(at, at + length), none, none
    return run


def _entries(entries_of, n_buckets: int, wave: int, waves: int, hot: np.ndarray):
    """The entries of the buckets of a wave but those of hot strings, packed by chunk and bucket."""
    def run(batches):
        held, size, seq = [], 0, 0
        for ids, th, offsets, *entry in entries_of(batches):
            k1 = entry[4]
            mine = k1 % np.uint64(n_buckets) % np.uint64(waves) == np.uint64(wave)
            if len(hot):
                mine &= ~np.isin(k1, hot)
            if mine.any():
                held.append((ids, th, offsets, *(x[mine] for x in entry)))
                size += len(held[-1][3])
            if size >= CHUNK:
                yield _as_batch(_chunk_rows(n_buckets, seq, held), _ENTRY_NAMES, _ENTRY_TYPES)
                held, size, seq = [], 0, seq + 1
        if held:
            yield _as_batch(_chunk_rows(n_buckets, seq, held), _ENTRY_NAMES, _ENTRY_TYPES)
    return run


def _bucket_sizes(entries_of, n_buckets: int):
    def run(batches):
        n = np.zeros(n_buckets, np.int64)
        for k1 in entries_of(batches, strings_only=True):
            n += np.bincount((k1 % np.uint64(n_buckets)).astype(np.int64), minlength=n_buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])
    return run


def _string_sizes(entries_of, n_buckets: int, large: np.ndarray):
    """How often each string of the large buckets occurs."""
    def run(batches):
        for k1 in entries_of(batches, strings_only=True):
            k, n = np.unique(k1[np.isin(k1 % np.uint64(n_buckets), large)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["k1", "n"])
    return run


def hot_strings(rows: DataFrame, entries_of, n_buckets: int) -> np.ndarray:
    """The strings with ``BUCKET / 4`` entries and more in buckets of over twice ``BUCKET``; at most
    one for each ``BUCKET / 4`` entries."""
    sizes = rows.mapInArrow(tidied(_bucket_sizes(entries_of, n_buckets)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    large = np.array([r["bucket"] for r in stored(sizes.filter(F.col("n") > 2 * BUCKET), "large-buckets").collect()], np.uint64)
    if not len(large):
        return large
    strings = rows.mapInArrow(tidied(_string_sizes(entries_of, n_buckets, large)), "k1 long, n long").groupBy("k1").agg(F.sum("n").alias("n"))
    return np.array([r["k1"] for r in stored(strings.filter(F.col("n") >= max(2, BUCKET // 4)), "hot-strings").collect()], np.int64).view(np.uint64)


_HOT = "doc_id long, th long, s long, w int, k1 long, k2 long"


def _hot_entries(entries_of, hot: np.ndarray):
    def run(batches):
        for ids, th, _, row, s, w, _, k1, k2, *_ in entries_of(batches):
            at = np.flatnonzero(np.isin(k1, hot))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row[at]], th[row[at]], s[at].astype(np.int64), w[at].astype(np.int32), k1[at].view(np.int64), k2[at].view(np.int64))],
                                             [x.split()[0] for x in _HOT.split(", ")])
    return run


def _counting(n: np.ndarray) -> np.ndarray:
    """0..n0-1, 0..n1-1, ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)


def _half_open(group: np.ndarray, core: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether entries share their string and the hash of their core with another document."""
    key = group << 16 | core.astype(np.int64)
    order = np.argsort(key, kind="stable")
    new = np.append(True, np.diff(key[order]) != 0)
    starts = np.flatnonzero(new)
    differ = np.minimum.reduceat(doc[order], starts) < np.maximum.reduceat(doc[order], starts)
    out = np.empty(len(key), bool)
    out[order] = differ[np.cumsum(new) - 1]
    return out


def _sorted_bucket(leave_open: bool):
    """Sort one bucket; answer each chunk with its settled and its open entries. Heads of chunks pass."""
    def run(key, table):
        if key[0].as_py() < 0:
            return pa.table([table.column("chunk"), table.column("head")] + [pa.nulls(table.num_rows, pa.binary())] * 4, _ANSWER_NAMES)
        get = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
        w, far = get("w", np.uint8), get("far", np.uint8)
        sizes = [len(x) for x in w]
        doc = np.concatenate([_unpacked(x.as_py()) for x in table.column("doc")])
        k1, k2 = np.concatenate(get("k1", np.uint64)), np.concatenate(get("k2", np.uint64))
        order = np.lexsort((doc, k2, k1))
        k1, k2, d = k1[order], k2[order], doc[order]
        new1 = np.append(True, k1[1:] != k1[:-1])
        new2 = new1.copy()
        new2[1:] |= k2[1:] != k2[:-1]
        del doc, k1, k2
        least = d[new2]
        settled = least[np.cumsum(new2) - 1] < d
        state = np.where(settled, SETTLED, 0).astype(np.uint8)
        if leave_open:
            group = np.cumsum(new1) - 1
            starts = np.flatnonzero(new1[new2])
            differ = np.minimum.reduceat(least, starts) < np.maximum.reduceat(least, starts)
            left = np.flatnonzero(~settled & differ[group])
            n_far, all_w = np.concatenate(far)[order[left]], np.concatenate(w)[order[left]]
            cores = np.concatenate([x.reshape(2, -1) for x in get("cores", np.uint16)], axis=1)[:, order[left]]
            for flag, core, has in ((NEAR, cores[0], n_far < all_w), (FAR, cores[1], n_far > 0)):
                if has.any():
                    state[left[has]] |= np.where(_half_open(group[left[has]], core[has], d[left[has]]), flag, 0).astype(np.uint8)
            del group
        answer = np.empty(len(d), np.uint8)
        answer[order] = state
        del order, d, settled, state
        give_back()
        out, at = [], 0
        for i, size in enumerate(sizes):
            a = answer[at:at + size]
            at += size
            hit = np.flatnonzero(a)
            if len(hit):
                pos = _unpacked(table.column("pos")[i].as_py())[hit]
                out.append((table.column("chunk")[i].as_py(), None, _packed(pos), w[i][hit].tobytes(), far[i][hit].tobytes(), a[hit].tobytes()))
        if not out:
            return pa.table([pa.array([], t) for t in _ANSWER_TYPES], _ANSWER_NAMES)
        return pa.Table.from_batches([_as_batch(out, _ANSWER_NAMES, _ANSWER_TYPES)])
    return run


def _spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The union of intervals, as two rows."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > stop[:-1])
    return np.stack([start[new], stop[np.append(new[1:], True)]]).astype(np.uint32)


_DEALT = "doc_id long, th long, spans binary, open binary"


def _dealt(ids, ths, s, w, far, state, length: int) -> pa.Table:
    """Answers by document: byte spans to remove, open suffixes as runs."""
    names, types = ["doc_id", "th", "spans", "open"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    if not len(ids):
        return pa.table([pa.array([], t) for t in types], names)
    order = np.lexsort((s, ths, ids))
    ids, ths, s, w, far, state = ids[order], ths[order], s[order], w[order], far[order], state[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1]))
    cuts = np.append(np.flatnonzero(new), len(ids))
    begin = s + np.where(state & FAR, 0, far)
    end = s + np.where(state & NEAR, w, far)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        done = np.flatnonzero(state[a:b] & SETTLED) + a
        left = np.flatnonzero(state[a:b] & (NEAR | FAR)) + a
        out.append((int(ids[a]), int(ths[a]),
                    _spans(s[done], s[done] + w[done] + length - 1).tobytes() if len(done) else None,
                    np.stack([begin[left], end[left] - begin[left]]).astype(np.uint32).tobytes() if len(left) else None))
    return pa.Table.from_batches([_as_batch(out, names, types)])


def _by_document(length: int):
    """All answers to a chunk, dealt to its documents."""
    def run(key, table):
        heads, answers = table.filter(table.column("head").is_valid()), table.filter(table.column("pos").is_valid())
        if heads.num_rows != 1:
            raise RuntimeError(f"a chunk with {heads.num_rows} heads")
        ids, ths, starts = np.frombuffer(heads.column("head")[0].as_py(), np.int64).reshape(3, -1)
        get = lambda name: np.frombuffer(b"".join(answers.column(name).to_pylist()), np.uint8)
        pos = np.concatenate([np.zeros(0, np.int64), *map(_unpacked, answers.column("pos").to_pylist())])
        row = np.searchsorted(starts, pos, side="right") - 1
        return _dealt(ids[row], ths[row], pos - starts[row], get("w").astype(np.int64), get("far").astype(np.int64), get("state"), length)
    return run


def _hot_by_document(length: int):
    def run(key, table):
        ids, ths, s, w, state = (table.column(c).to_numpy() for c in ("doc_id", "th", "s", "w", "state"))
        return _dealt(ids, ths, s, w, np.zeros(len(s), np.int64), state, length)
    return run


def _settle_hot(entries: DataFrame, leave_open: bool, length: int) -> DataFrame:
    """The same answers for the entries of hot strings, without a group of a string."""
    least = stored(entries.groupBy("k1", "k2").agg(F.min("doc_id").alias("least")), "hot-ranks")
    state = F.when(F.col("least") < F.col("doc_id"), SETTLED)
    if leave_open:
        differ = least.groupBy(F.col("k1").alias("d1")).agg((F.min("least") < F.max("least")).alias("differ"))  # a row for each hot string
        entries = entries.join(F.broadcast(differ), F.col("k1") == F.col("d1"))
        state = state.when(F.col("differ"), NEAR | FAR)
    # a rank can be as hot as its string: entries are dealt over SALT parts, ranks repeated
    least = least.select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), "least", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    salt = F.pmod(F.xxhash64("doc_id", "th", "s"), F.lit(SALT)).cast("int")
    x = entries.withColumn("salt", salt).join(least, (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")) & (F.col("salt") == F.col("part")))
    x = x.select("doc_id", "th", "s", F.col("w").cast("long").alias("w"), F.coalesce(state, F.lit(0)).alias("state")).filter("state > 0").distinct()
    parts = entries.count() // BUCKET + 1
    return (x.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "th"), F.lit(parts))).groupBy("chunk")
            .applyInArrow(_hot_by_document(length), _DEALT))


def _settle(rows: DataFrame, entries_of, n_buckets: int, waves: int, leave_open: bool, length: int, name: str) -> DataFrame:
    """(doc_id, th, spans, open) of the entries, written wave by wave."""
    hot = hot_strings(rows, entries_of, n_buckets)
    waves = min(waves, n_buckets)
    out = [stored(rows.mapInArrow(tidied(_entries(entries_of, n_buckets, wave, waves, hot)), _ENTRIES)
                  .groupBy("bucket").applyInArrow(_sorted_bucket(leave_open), _ANSWERS)
                  .groupBy("chunk").applyInArrow(_by_document(length), _DEALT), name) for wave in range(waves)]
    if len(hot):
        entries = stored(rows.mapInArrow(tidied(_hot_entries(entries_of, hot)), _HOT), "hot-entries")
        out.append(stored(_settle_hot(entries, leave_open, length), name))
    return reduce(DataFrame.union, out)


def cut(text: bytes, *spans: bytes | None) -> tuple[bytes, int]:
    """What is left of ``text``, and the number of maximal runs removed."""
    found = [np.frombuffer(x, np.uint32).reshape(2, -1) for x in spans if x is not None]
    if not found:
        return text, 0
    runs = _spans(*np.concatenate(found, axis=1).astype(np.int64))
    at, kept = 0, []
    for start, stop in runs.T.tolist():
        kept.append(text[at:start])
        at = stop
    return b"".join([*kept, text[at:]]), runs.shape[1]


def _remover(batches):
    for batch in batches:
        for block in blocks(batch):
            out = []
            for i, text, spans in zip(*(block.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                raw = text.encode()
                kept, n = cut(raw, *spans or ())
                out.append((i, len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            yield _as_batch(out, [x.split()[0] for x in _REMOVED.split(", ")], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()])


_REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def duplicate_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, th, spans): byte spans to remove of the documents that lose something; ``th`` is the
    xxhash64 of the text, each of ``spans`` two rows of unsigned 32-bit starts and ends."""
    k = min(SAMPLE, length)
    n = total_bytes(docs)
    rows = docs.filter(F.col("doc_id").isNotNull()).withColumn("th", F.xxhash64("text"))
    first = _settle(rows, _sampled(length, k), n // (BUCKET * 12) + 1, WAVES, True, length, "suffix-ranks")
    open_bytes = int(first.agg(F.sum(F.octet_length("open"))).first()[0] or 0)
    # repeated rows of a document can meet in different chunks, with equal answers
    todo = first.filter(F.col("open").isNotNull()).groupBy("doc_id", "th").agg(F.collect_set("open").alias("open"))
    second = _settle(rows.join(todo, ["doc_id", "th"]).sortWithinPartitions("doc_id", "th"), _opened(length), open_bytes // (BUCKET // 2) + 1, 1, False, length, "suffix-ties")
    both = first.select("doc_id", "th", "spans").union(second.select("doc_id", "th", "spans")).filter("spans is not null")
    return both.groupBy("doc_id", "th").agg(F.collect_set("spans").alias("spans"))


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, kept (the remaining bytes; a cut may fall inside a character)."""
    docs = documents(df, id_col, text_col)
    spans = duplicate_spans(docs, length)
    return (docs.withColumn("th", F.xxhash64("text")).join(spans, ["doc_id", "th"], "left")
            .select("doc_id", "text", "spans").mapInArrow(tidied(_remover), _REMOVED))


def _cut_text(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([t if a is None else cut(t.encode(), *a)[0].decode(errors="ignore") for t, a in zip(text, spans, strict=True)])


def without_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with the shortened texts, all other columns as they are. Bytes of a character that
    was cut through go too; a null text stays null."""
    key, th, found = (unused(df, n) for n in ("span_id", "span_th", "spans"))
    spans = duplicate_spans(documents(df, id_col, text_col), length).select(
        F.col("doc_id").alias(key), F.col("th").alias(th), F.col("spans").alias(found))
    text = F.col(text_col).cast("string")
    x = df.join(spans, (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(th)), "left")
    shorter = F.when(F.col(found).isNull(), F.col(text_col)).otherwise(F.pandas_udf(_cut_text, "string")(text, found))
    return x.withColumn(text_col, shorter).select(*df.columns)
