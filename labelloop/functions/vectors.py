"""Vector and logit expressions on ARRAY<DOUBLE> columns.

All of these are Catalyst higher-order functions, so they stay inside
whole-stage code generation; none of them round-trips through Python.
Arrays of FLOAT must be cast to ARRAY<DOUBLE> first (``as_double``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """cosine similarity; NULL when either vector has zero norm."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_distance(a, b) -> Column:
    """Euclidean distance ``||a - b||``."""
    diff = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x))


def logsumexp(logits) -> Column:
    m = F.array_max(_c(logits))
    return m + F.log(F.aggregate(_c(logits), F.lit(0.0), lambda s, x: s + F.exp(x - m)))


def softmax(logits) -> Column:
    """numerically stable softmax."""
    lse = logsumexp(logits)
    return F.transform(_c(logits), lambda x: F.exp(x - lse))


def log_softmax(logits) -> Column:
    """F4."""
    lse = logsumexp(logits)
    return F.transform(_c(logits), lambda x: x - lse)


def row_max(logits) -> Column:
    """A4: confidence = largest raw logit."""
    return F.array_max(_c(logits))


def argmax(logits) -> Column:
    """A4: 0-based index of the first maximum (numpy ``argmax`` tie rule)."""
    return (F.array_position(_c(logits), F.array_max(_c(logits))) - 1).cast("int")


def cross_entropy(logits, label) -> Column:
    """per-row CE, NULL when the label is invalid (< 0) or out of range."""
    lab = _c(label)
    return F.when(lab >= 0, logsumexp(logits) - F.get(_c(logits), lab))


def kl_div(p_teacher, log_q_student) -> Column:
    """KL(p || q) = sum p (ln p - ln q); 0 ln 0 counts as 0."""
    terms = F.zip_with(_c(p_teacher), _c(log_q_student),
                       lambda p, lq: F.when(p > 0, p * (F.log(p) - lq)).otherwise(F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def one_hot(label, num_classes: int) -> Column:
    """F7."""
    return F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)),
                       lambda i: F.when(i == _c(label), F.lit(1.0)).otherwise(F.lit(0.0)))


def lerp(a, b, lam) -> Column:
    """F8: ``lam * a + (1 - lam) * b`` element-wise."""
    lam = _c(lam) if not isinstance(lam, (int, float)) else F.lit(float(lam))
    return F.zip_with(_c(a), _c(b), lambda x, y: lam * x + (F.lit(1.0) - lam) * y)


def scale(a, factor) -> Column:
    """F10 (temperature): every element divided by ``factor``."""
    return F.transform(_c(a), lambda x: x / F.lit(float(factor)))


def linear_rampup(current, length) -> Column:
    """``min(1, current / length)``; a zero length means 1."""
    n = (length if isinstance(length, Column) else F.lit(length)).cast("double")
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.try_divide(_c(current).cast("double"), n)))


def minmax_scale(x, lo, hi) -> Column:
    """``(x - lo) / (hi - lo)``; a constant column scales to 0 (quirk 11)."""
    return F.coalesce((_c(x) - _c(lo)) / F.nullif(_c(hi) - _c(lo), F.lit(0.0)), F.lit(0.0))


def first_position(seq) -> Column:
    """The first position vector of a sequence of vectors (CLS pooling)."""
    return F.get(_c(seq), 0)


def hash_unit(id_col, seed: int = 0) -> Column:
    """Deterministic uniform number in (0, 1) from a key and a seed.

    The first 52 bits of ``md5("key:seed")``: every bit depends on the key and on
    the seed, so draws with different seeds are independent and orders by
    different seeds are unrelated. The DuckDB oracles have the same md5."""
    digest = F.md5(F.concat(_c(id_col).cast("string"), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
