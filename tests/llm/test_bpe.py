import hashlib
import random

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
import tokenizers

from labelloop.llm.bpe import Merges, PreTokenizer, bpe_decode, bpe_encode, merges_of, ranks_of, token_counts
from tests.llm.conftest import odd_rows, table

RANKS, FILE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
STRANGE = ["a<|endoftext|>b  c", "<|endoftext|><|endoftext|>", " \n\n x\t", "ß²½ 漢字かな 🙂👍🏽 é   \x1c x", "x" * 3000 + " " * 500, "aaaa" * 50 + "é" * 100, "don't 'LL 1234567"]


def read(path):
    with open(path, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def strange(spark, odd):
    return odd.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, s) for i, s in enumerate(STRANGE)], "doc_id long, text string"))


def all_texts():
    return [r[:2] for r in odd_rows()] + [(10_000 + i, s) for i, s in enumerate(STRANGE)]


def test_plain_pattern_agrees_on_every_character():
    cut = PreTokenizer(P.PATTERN)
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            text = f"a{c}1{c}{c}. {c} {c}b"
            assert cut(text) == cut.any(text), hex(cp)


def test_encode_and_decode_as_the_library(strange, none):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks_of(read(RANKS)), special_tokens={})
    got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in bpe_decode(bpe_encode(strange, RANKS, P.PATTERN), RANKS).collect()]
    want = [(i, len(ids := enc.encode_ordinary(t or "")), np.array(ids, "<u4").tobytes(), (t or "").encode()) for i, t in all_texts()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe_decode(bpe_encode(none, RANKS, P.PATTERN), RANKS).collect() == []


def test_counts_as_the_library(strange, none):
    lib = tokenizers.Tokenizer.from_file(FILE)
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in all_texts()]
    assert table(token_counts(strange, FILE, P.PATTERN, 512), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert token_counts(none, FILE, P.PATTERN, 512).collect() == []


def test_replay_is_lowest_rank_first():
    """Also where a merge brings up a pair of a lower rank, and with overlapping places."""
    rng = random.Random(2)
    for seed in range(30):
        rng.seed(seed)
        strings = [bytes([b]) for b in range(256)]
        extra = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode() for _ in range(25)}
        strings += sorted(extra, key=lambda _: rng.random())
        m = Merges.from_ranks({s: i for i, s in enumerate(strings)})
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))).encode() for _ in range(60)]
        assert [x.tolist() for x in m.replay(words)] == [m._alone(w).tolist() for w in words]


def test_proven_whole_tokens():
    merges, special = merges_of(read(FILE))
    lib = tokenizers.Tokenizer.from_file(FILE)
    assert special == ["<|endoftext|>"]
    for i in range(0, len(merges.strings), 97):
        try:
            s = merges.strings[i].decode()
        except UnicodeDecodeError:
            continue
        if len(PreTokenizer(P.PATTERN)(s)) == 1:
            assert len(merges.replay([merges.strings[i]])[0]) == len(lib.encode(s, add_special_tokens=False).ids)


def test_round_trip_digest(odd):
    x = bpe_decode(bpe_encode(odd, RANKS, P.PATTERN), RANKS).collect()
    assert sorted(hashlib.sha256(bytes(r["decoded"])).hexdigest() for r in x) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in odd_rows())
