"""Text expressions: prompt cleaning (P3), normalisation (F15-F18), word pieces
(F19), detokenising (F20) and model-input arrays (F21-F24).

Everything is a Catalyst expression except accent stripping, which needs
Unicode decomposition that Spark SQL lacks; that one is an Arrow
UDF whose work happens in Arrow's C++ kernels (NFKD + one regex), not per row
in Python.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloop.functions.batches import small

# The word-boundary marker of sentence-piece vocabularies and the
# special tokens of the encoder (ids are their positions in SPECIAL_TOKENS).
WORD_MARK = "▁"
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = range(5)

# Python's str.split() whitespace, written as a class for Java regex (Spark)
# and for RE2 (DuckDB oracles).
WS_JAVA = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
WS_RE2 = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
DIGIT_COMMA = r"\p{Nd},$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(s) -> Column:
    """Drop newlines (no space is put in their place)."""
    return F.regexp_replace(_c(s), "\n", "")


def fill_template(template: str, s) -> Column:
    """Put the text into a sentence template with one ``{}`` slot."""
    before, after = template.split("{}", 1)
    return F.concat(F.lit(before), _c(s), F.lit(after))


def norm_space(s) -> Column:
    """collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(_c(s), WS_JAVA, " "))


def norm_quotes(s) -> Column:
    """F16: doubled back-ticks and doubled apostrophes become a double quote."""
    return F.replace(F.replace(_c(s), F.lit("``"), F.lit('"')), F.lit("''"), F.lit('"'))


@lru_cache(maxsize=1)
def _combining_class_regex() -> str:
    """RE2 class of every code point with a non-zero canonical combining class,
    built from the running Python's Unicode tables."""
    ranges, start, prev = [], None, None
    for cp in range(sys.maxunicode + 1):
        if unicodedata.combining(chr(cp)):
            if start is None:
                start = cp
            elif cp != prev + 1:
                ranges.append((start, prev))
                start = cp
            prev = cp
    if start is not None:
        ranges.append((start, prev))
    parts = [f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges]
    return "[" + "".join(parts) + "]"


def strip_accents_arrow(values):
    """NFKD, then drop combining marks; Arrow array in, Arrow array out."""
    import pyarrow.compute as pc
    out = pc.utf8_normalize(values, "NFKD")
    return pc.replace_substring_regex(out, _combining_class_regex(), "")


@F.arrow_udf(T.StringType())
def _strip_accents_udf(s: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([s], ["s"])
    return pa.concat_arrays([strip_accents_arrow(b.column(0)) for b in small(batch)])


def strip_accents(s) -> Column:
    """Unicode NFKD, then remove combining characters."""
    return _strip_accents_udf(_c(s))


def normalise(s, lower: bool = False, keep_accents: bool = False, remove_space: bool = True) -> Column:
    """F15-F18 chained in the reference order."""
    x = norm_space(s) if remove_space else _c(s)
    x = norm_quotes(x)
    if not keep_accents:
        x = strip_accents(x)
    if lower:
        x = F.lower(x)
    return x


def split_digit_comma(pieces) -> Column:
    """a piece ending in ``<digit>,`` is split into the piece and ``,``."""
    return F.flatten(F.transform(_c(pieces), lambda p: F.when(
        p.rlike(DIGIT_COMMA), F.array(p.substr(F.lit(1), F.length(p) - 1), F.lit(","))
    ).otherwise(F.array(p))))


def word_pieces(normalised) -> Column:
    """Word pieces of normalised text: every whitespace-separated word gets the
    word mark in front, then F19 applies."""
    words = F.filter(F.split(_c(normalised), " "), lambda w: w != "")
    return split_digit_comma(F.transform(words, lambda w: F.concat(F.lit(WORD_MARK), w)))


def detokenise(tokens) -> Column:
    """join pieces, word marks become spaces, trim."""
    return F.trim(F.replace(F.array_join(_c(tokens), ""), F.lit(WORD_MARK), F.lit(" ")))


def with_special_tokens(a, b=None) -> Column:
    """[CLS] a [SEP] or [CLS] a [SEP] b [SEP]."""
    cls, sep = F.array(F.lit(CLS_ID)), F.array(F.lit(SEP_ID))
    if b is None:
        return F.concat(cls, _c(a), sep)
    return F.concat(cls, _c(a), sep, _c(b), sep)


def special_tokens_mask(a, b=None, already_formatted: bool = False) -> Column:
    """1 marks a special token position, 0 a sequence token."""
    if already_formatted:
        if b is not None:
            raise ValueError("a second sequence cannot come with an already formatted one")
        return F.transform(_c(a), lambda x: F.when(x.isin(CLS_ID, SEP_ID), F.lit(1)).otherwise(F.lit(0)))
    zeros = lambda arr: F.transform(arr, lambda _: F.lit(0))
    one = F.array(F.lit(1))
    if b is None:
        return F.concat(one, zeros(_c(a)), one)
    return F.concat(one, zeros(_c(a)), one, zeros(_c(b)), one)


def segment_ids(a, b=None) -> Column:
    """0 for [CLS] a [SEP], 1 for b [SEP]."""
    first = F.array_repeat(F.lit(0), F.size(_c(a)) + 2)
    if b is None:
        return first
    return F.concat(first, F.array_repeat(F.lit(1), F.size(_c(b)) + 1))


def truncate_pad(ids, max_length: int, pad_id: int = PAD_ID) -> Column:
    """F21 (single sequence): keep max_length - 2 tokens, add [CLS]/[SEP], pad."""
    body = F.slice(_c(ids), 1, max_length - 2)
    full = with_special_tokens(body)
    return F.slice(F.concat(full, F.array_repeat(F.lit(pad_id), F.lit(max_length))), 1, max_length)


def attention_mask(ids, max_length: int) -> Column:
    """1 for the real positions of ``truncate_pad``, 0 for padding."""
    n = F.least(F.size(_c(ids)) + 2, F.lit(max_length))
    return F.slice(F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length))), 1, max_length)


# ---------------------------------------------------------------------------
# Vectorised form of normalise() + word_pieces() for the corpus jobs (T1, T2):
# the same semantics on Arrow arrays, executed by Arrow's C++ kernels inside
# mapInArrow, one pass per batch.

def arrow_pieces(values, lower: bool = False):
    """Arrow string array -> ListArray of word pieces (F15-F19 semantics)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    x = pc.replace_substring_regex(values, WS_RE2, " ")
    x = pc.utf8_trim(x, " ")
    x = pc.replace_substring(pc.replace_substring(x, "``", '"'), "''", '"')
    x = strip_accents_arrow(x)
    if lower:
        x = pc.utf8_lower(x)
    words = pc.split_pattern(x, " ")
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    offsets = np.asarray(words.offsets)
    flat = words.flatten()
    keep = np.asarray(pc.not_equal(flat, "").to_numpy(zero_copy_only=False), dtype=bool)
    row_of = np.repeat(np.arange(len(words)), np.diff(offsets))
    flat = flat.filter(pa.array(keep))
    row_of = row_of[keep]
    marked = pc.binary_join_element_wise(WORD_MARK, flat, "")
    n = len(marked)
    split = np.asarray(pc.match_substring_regex(marked, DIGIT_COMMA).to_numpy(zero_copy_only=False), dtype=bool)
    stripped = pc.replace_substring_regex(marked, ",$", "")
    src = pa.concat_arrays([marked, stripped, pa.array([","], pa.string())])
    reps = 1 + split.astype(np.int64)
    base = np.repeat(np.arange(n), reps)
    first = np.ones(len(base), dtype=bool)
    first[1:] = base[1:] != base[:-1]
    take = np.where(split[base] & first, n + base, np.where(split[base], 2 * n, base))
    pieces = src.take(pa.array(take))
    per_row = np.bincount(np.repeat(row_of, reps), minlength=len(words))
    new_offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(new_offsets), pieces)
