"""Byte-level BPE: encoding by corpus-level merge replay, decoding, token counts (operators 3 and 4).

A block of texts is cut into pre-tokens, and the distinct new ones are merged together. An
inverted index leads from each pair of adjacent tokens to its places in all words; merges are
replayed in rank order, many places at once, and only the two neighbours of a merged
place are looked at again. A word that was merged before comes from a bounded cache.

Counting (operator 4) needs fewer merges: the strings of the vocabulary that encode alone as one
token are found once by replaying the merges over the vocabulary itself; pre-tokens among them
count one without merging.

The vocabulary file is read by the driver and broadcast (its size is checked); a null text is
empty, and an empty text has no tokens. Every row gives one row, repeated and null ids included.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloop.llm.common import blocks, documents, held, text_bytes, tidied

MAX_VOCABULARY_BYTES = 64 << 20
MAX_CACHED_WORDS = 200_000
_SHIFT = 20
NO_RANK = 1 << 40

# Characters on which the classes of ``re`` (word, digit, space) and the Unicode
# properties L, N and White_Space agree.
_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\x7f\\xa0-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]")


class PreTokenizer:
    """Matches of ``pattern``; plain Latin text takes the same pattern in terms of ``re``, which is faster."""

    def __init__(self, pattern: str):
        self.any = regex.compile(pattern).findall
        self.plain = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")).findall

    def __call__(self, text: str) -> list[str]:
        return self.any(text) if _PLAIN.search(text) else self.plain(text)


class Merges:
    """Token strings, and which pairs of tokens merge at which rank into which token.

    ``pairs``: left << 20 | right -> rank; ``made``: rank -> token."""

    def __init__(self, strings: list[bytes], pairs: dict[int, int], made: np.ndarray | range):
        if len(strings) >= 1 << _SHIFT:
            raise ValueError("the vocabulary is too large")
        self.strings, self.made = strings, np.asarray(made, np.int64)
        ids = {s: i for i, s in enumerate(strings)}
        self.of_byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int64, len(pairs))
        order = np.argsort(keys)
        # one key above all others, so that a search always ends at a key
        self.keys, self.ranks = np.append(keys[order], np.int64(1) << 62), np.append(ranks[order], NO_RANK)
        both = self.of_byte[:, None] << _SHIFT | self.of_byte[None, :]
        self.first = self.rank_of(both.ravel()).reshape(256, 256)
        top = max(1, len(self.made) - 1)
        self.bounds = np.array([*(1 << i for i in range(8, top.bit_length())), NO_RANK], np.int64)

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        """The rank at which pairs merge, ``NO_RANK`` if they don't."""
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int]) -> Merges:
        """Any two tokens merge whose joined bytes are a token; its id is the rank."""
        strings = sorted(ranks, key=ranks.__getitem__)
        if [ranks[s] for s in strings] != list(range(len(strings))):
            raise ValueError("ranks must be 0, 1, 2, ...")
        pairs = {}
        for s, rank in ranks.items():
            for cut in range(1, len(s)):
                a, b = ranks.get(s[:cut]), ranks.get(s[cut:])
                if a is not None and b is not None:
                    pairs[a << _SHIFT | b] = rank
        return cls(strings, pairs, range(len(strings)))

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """The tokens of each word."""
        tokens, offsets = self.replay_flat(words)
        return np.split(tokens, offsets[1:-1])

    def replay_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words one after the other, and where each word starts (n + 1 offsets).

        The inverted index leads from the rank of a pair to its places in all words, in
        buckets of ranks. A bucket is worked off in rounds: each word applies its lowest
        rank at all its places (of overlapping ones every second), and the pairs of a
        merged place with its two neighbours are looked up and go into their bucket. Words
        don't meet, so this is every merge in rank order."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(data)) + word  # one more place after each word, so that no pair spans two
        total = len(data) + len(words)
        token = np.full(total + 1, -1, np.int64)
        token[at] = self.of_byte[data]
        rank = np.full(total + 1, NO_RANK, np.int64)
        if len(data) > 1:
            rank[at[:-1]] = np.where(word[1:] == word[:-1], self.first[data[:-1], data[1:]], NO_RANK)
        owner = np.full(total + 1, -1, np.int64)
        owner[at] = word
        after, before = np.arange(1, total + 2), np.arange(-1, total)
        early: list[np.ndarray] = []
        buckets: list[list[np.ndarray]] = [[] for _ in self.bounds]

        def enter(places: np.ndarray) -> None:
            number = np.searchsorted(self.bounds, rank[places], side="right")
            order = np.argsort(number, kind="stable")
            cuts = np.searchsorted(number[order], np.arange(len(self.bounds) + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                buckets[b].append(places[order[cuts[b]:cuts[b + 1]]])
        enter(np.flatnonzero(rank < NO_RANK))
        low = 0
        for b, high in enumerate(self.bounds):
            while buckets[b]:
                places = np.sort(np.concatenate(buckets[b]))
                buckets[b] = []
                own = rank[places]
                places = places[(own >= low) & (own < high) & np.append(places[1:] != places[:-1], True)]
                if not len(places):
                    break
                own, r = owner[places], rank[places]
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                lowest = r == np.repeat(np.minimum.reduceat(r, starts), np.diff(np.append(starts, len(r))))
                later, i = places[~lowest], places[lowest]
                follows = np.append(False, after[i[:-1]] == i[1:])
                runs = np.flatnonzero(~follows)
                nth = np.arange(len(i)) - np.repeat(runs, np.diff(np.append(runs, len(i))))
                i = i[nth % 2 == 0]
                was = rank[i]
                j = after[i]
                k = after[j]
                made = self.made[was]
                # left to right, the place before has a new left side while this one is still unmerged
                near = np.flatnonzero(k[:-1] == i[1:])
                early.append(owner[i[near[self.rank_of(made[near] << _SHIFT | token[k[near]]) < was[near]]]])
                token[i], token[j], rank[j] = made, -2, NO_RANK
                after[i], before[k] = k, i
                left, right = before[i], token[k] >= 0
                rank[i] = np.where(right, self.rank_of(token[i] << _SHIFT | np.maximum(token[k], 0)), NO_RANK)
                inner = left >= 0
                inner[inner] = token[left[inner]] >= 0
                left, was_left = left[inner], was[inner]
                rank[left] = self.rank_of(token[left] << _SHIFT | token[i[inner]])
                early += [owner[i[rank[i] < was]], owner[left[rank[left] < was_left]]]
                buckets[b].append(later)
                enter(np.concatenate([x[rank[x] < NO_RANK] for x in (i, left)]))
            low = high
        found = np.flatnonzero(token >= 0)
        offsets = np.append(0, np.searchsorted(found, ends + np.arange(len(words))))
        out = token[found]
        # A pair of lower rank that comes up later must go before further places of this rank in
        # its word; vocabularies made by merging never have one, and such a word is done alone.
        again = np.unique(np.concatenate(early)) if early else []
        if len(again):
            parts = np.split(out, offsets[1:-1])
            for w in again:
                parts[w] = self._alone(words[w])
            out, offsets = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return out, offsets

    def _alone(self, word: bytes) -> np.ndarray:
        seq = self.of_byte[np.frombuffer(word, np.uint8)]
        while len(seq) > 1:
            ranks = self.rank_of(seq[:-1] << _SHIFT | seq[1:])
            i = int(np.argmin(ranks))
            if ranks[i] == NO_RANK:
                break
            seq = np.concatenate([seq[:i], [self.made[ranks[i]]], seq[i + 2:]])
        return seq


def read_small(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: a vocabulary of over {MAX_VOCABULARY_BYTES} bytes")
    return data


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def _letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def merges_of(data: bytes) -> tuple[Merges, list[str]]:
    """The merges of a tokenizer file (byte-level BPE, one pattern), and its special strings."""
    spec = json.loads(data)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model["ignore_merges"]:
        raise ValueError("not a plain byte-level BPE file")
    byte = _letters()
    raw = lambda s: bytes(byte[c] for c in s)
    vocab = {raw(s): i for s, i in model["vocab"].items()}
    strings = sorted(vocab, key=vocab.__getitem__)
    if [vocab[s] for s in strings] != list(range(len(strings))):
        raise ValueError("ids must be 0, 1, 2, ...")
    pairs, made = {}, []
    for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
        a, b = raw(a), raw(b)
        pairs[vocab[a] << _SHIFT | vocab[b]] = rank
        made.append(vocab[a + b])
    return Merges(strings, pairs, np.array(made)), [t["content"] for t in spec["added_tokens"]]


def _fill(cache: dict, words: set, whole: dict, merges: Merges, values) -> None:
    """Add ``words`` to the cache: whole tokens directly, the others merged together;
    ``values`` makes what is kept of each from all tokens and offsets."""
    rest = []
    for w in words:
        hit = whole.get(w)
        if hit is None:
            rest.append(w)
        else:
            cache[w] = hit
    if rest:
        cache.update(zip(rest, values(*merges.replay_flat([w.encode() for w in rest])), strict=True))


def _id_bytes(tokens: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    data, cuts = tokens.astype("<u4").tobytes(), (4 * offsets).tolist()
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _decodable(strings: list[bytes]) -> dict[str, int]:
    out = {}
    for i, s in enumerate(strings):
        try:
            out[s.decode()] = i
        except UnicodeDecodeError:
            continue
    return out


def bpe_encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit)."""
    docs = documents(df, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(read_small(path))

    def load():
        merges = Merges.from_ranks(ranks_of(shared.value))
        whole = {w: np.array([i], "<u4").tobytes() for w, i in _decodable(merges.strings).items()}
        return merges, whole, PreTokenizer(pattern), {}

    def run(batches):
        merges, whole, cut, cache = held(("encode", path, pattern), load)
        get = cache.__getitem__
        for batch in batches:
            for block in blocks(batch):
                words = [cut(t.as_py()) for t in block.column("text")]
                new = set().union(*words)
                if len(cache) + len(new) > MAX_CACHED_WORDS:
                    cache.clear()
                _fill(cache, new.difference(cache), whole, merges, _id_bytes)
                ids = [b"".join(map(get, w)) for w in words]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                                                 ["doc_id", "n_tokens", "ids"])
        cache.clear()  # an idle worker keeps the merges only
    run.holds = True
    return docs.mapInArrow(tidied(run), "doc_id long, n_tokens long, ids binary")


def bpe_decode(df: DataFrame, path: str) -> DataFrame:
    """``df`` (doc_id, n_tokens, ids) with the decoded bytes in ``decoded``."""
    shared = df.sparkSession.sparkContext.broadcast(read_small(path))

    def load():
        ranks = ranks_of(shared.value)
        strings = sorted(ranks, key=ranks.__getitem__)
        sizes = np.array([len(s) for s in strings])
        return np.frombuffer(b"".join(strings), np.uint8), sizes, np.cumsum(sizes) - sizes

    def run(batches):
        letters, sizes, starts = held(("decode", path), load)
        for batch in batches:
            for block in blocks(batch, "ids"):
                raw, offsets = text_bytes(block, "ids")
                ids = np.frombuffer(raw.tobytes(), "<u4")
                n = sizes[ids]
                ends = np.cumsum(n)
                data = letters[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[ids] - (ends - n), n)].tobytes()
                cuts = np.append(0, ends)[offsets // 4].tolist()
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("n_tokens"), block.column("ids"),
                                                  pa.array([data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                                                 ["doc_id", "n_tokens", "ids", "decoded"])
    run.holds = True
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"), F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(
        tidied(run), "doc_id long, n_tokens long, ids binary, decoded binary")


def token_counts(df: DataFrame, path: str, pattern: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_bytes, n_tokens, over_limit, as the tokenizer file encodes
    the text; a special string inside the text is one token."""
    docs = documents(df, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(read_small(path))

    def load():
        merges, special = merges_of(shared.value)
        proven = {s for s, n in zip(merges.strings, np.diff(merges.replay_flat(merges.strings)[1]).tolist(), strict=True) if n == 1}
        whole = {w: 1 for w in _decodable(merges.strings) if w.encode() in proven}
        split = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))).split if special else lambda t: [t]
        return merges, whole, PreTokenizer(pattern), split, {}

    def run(batches):
        merges, whole, cut, split, cache = held(("count", path, pattern), load)
        get = cache.__getitem__
        for batch in batches:
            for block in blocks(batch):
                texts = block.column("text").to_pylist()
                parts = [split(t) for t in texts]
                words = [cut(p[0]) if len(p) == 1 else [w for x in p for w in cut(x)] for p in parts]
                new = set().union(*words)
                if len(cache) + len(new) > MAX_CACHED_WORDS:
                    cache.clear()
                _fill(cache, new.difference(cache), whole, merges, lambda _, offsets: np.diff(offsets).tolist())
                n = [sum(map(get, w)) + len(p) - 1 for w, p in zip(words, parts, strict=True)]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.diff(text_bytes(block)[1])), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                                                 ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        cache.clear()
    run.holds = True
    return docs.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
