import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, fp int, kept string, first string, size string"
SYLLABLES = "an the re in on er ti ha nd ou ea ing tion ed of to is".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    """Nulls in any column, empty and very long texts, copies, near copies, repeated rows and ids."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(20, 120)) for _ in range(12)]
    texts = [None, "", " \n\t", "a", "A b", "\x00   é漢字🙂", "x" * 30_000, prose(rng, 9_000)]
    texts += base + base[:4]
    texts += [b.replace("the", "THE", 1) for b in base[:3]]
    texts += [base[0][:90] + " zz " + base[1][40:160], base[2] + "\n" + base[2], prose(rng, 6) + " " + base[3][:70]]
    rows = [(i * 3 + 1, t, ("en", "de", None)[i % 3], None if i % 5 == 0 else f"s{i % 2}", None, "x", i, "no", None, "9") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, base[0], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)
