import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloop.llm import kneser_ney, language_id, toxicity
from tests.llm import brute
from tests.llm.conftest import SCHEMA, odd_rows, prose, table

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize(("order", "shard_rows"), [(3, 1 << 21), (5, 400)])
def test_kneser_ney_probabilities(spark, order, shard_rows):
    rng = random.Random(4)
    trusted = [prose(rng, rng.randint(1, 30)) for _ in range(25)] + ["", "é漢"]
    texts = [(i, t) for i, t in enumerate([*trusted[:8], prose(rng, 40), "ZZ 99", "", "漢"])]
    model = kneser_ney.kneser_ney(spark.createDataFrame([(t,) for t in trusted], "text string"), order)
    rows = spark.createDataFrame([(i, t, "en", 0, i) for i, t in texts], "doc_id long, text string, lang string, trusted int, uid long")
    got = {r["doc_id"]: r["log_prob"] for r in kneser_ney.log_probabilities(rows, model, order, shard_rows).collect()}
    plain = brute.KneserNey(trusted, order)
    assert got == pytest.approx({i: plain.log_prob(t) for i, t in texts}, abs=1e-6)


def test_kneser_ney_sums_to_one():
    plain = brute.KneserNey(["the then there", "this is it"], 3)
    for context in (b"th", b"zz", b" i"):
        assert sum(plain.p(context + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_quality_scores_odd_rows(spark, odd, none):
    ids = [r[0] for r in odd_rows() if r[0] is not None]
    labels = spark.createDataFrame([(i, 1, 0) for i in ids[6:18]] + [(ids[7], 0, 0), (ids[8], None, 0), (None, 1, 0)], LABELS)
    got = kneser_ney.quality_scores(odd, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows())
    assert all(not r["kept"] and r["perplexity"] is None for r in got if r["n_bytes"] == 0)
    assert kneser_ney.quality_scores(none, labels).collect() == []
    unlabelled = kneser_ney.quality_scores(odd, labels.limit(0)).collect()
    assert all(r["kept"] == (r["n_bytes"] > 0) for r in unlabelled)


def test_quality_scores_of_repeated_rows_in_shards(spark, odd):
    """Repeated rows and null ids with equal texts are scored each, whatever the number of shards."""
    labels = spark.createDataFrame([(i * 3 + 1, 1, 0) for i in range(6, 24)], LABELS)
    rows = odd.unionByName(odd.filter("doc_id is null")).unionByName(odd.filter("doc_id % 4 = 0"))
    key = lambda r: (str(r["doc_id"]), r["lang"], r["n_bytes"], r["kept"], round(r["log_prob"], 3), r["threshold"] is None)
    one = sorted(map(key, kneser_ney.quality_scores(rows, labels).collect()))
    many = sorted(map(key, kneser_ney.quality_scores(rows, labels, shard_rows=20_000).collect()))
    assert len(one) == rows.count() and many == one


def test_quality_thresholds_by_language(spark):
    """Junk goes, trusted and unlabelled clean texts stay; two languages, one text unlike the other."""
    rng = random.Random(6)
    rows = [(i, prose(rng, 60) if i % 2 else prose(rng, 60).upper(), ("en", "de")[i % 2]) for i in range(700)]
    rows += [(1000 + i, "".join(chr(rng.randint(33, 90)) for _ in range(400)), "en") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 600)], LABELS)
    got = {r["doc_id"]: r for r in kneser_ney.quality_scores(docs, labels).collect()}
    assert sum(not got[i]["kept"] for i in range(700)) <= 7
    assert not any(got[1000 + i]["kept"] for i in range(10))
    assert len({round(r["threshold"], 9) for r in got.values() if r["lang"] == "en"}) >= 1
    held = sorted(r["perplexity"] for r in got.values() if r["lang"] == "de")
    assert math.isfinite(held[-1])


@pytest.mark.parametrize("trusted", [400, 3])
def test_quality_thresholds_of_short_texts(spark, trusted):
    """Every text has a threshold as soon as there is trusted text, and short junk goes."""
    rng = random.Random(7)
    rows = [(i, prose(rng, 10 if i % 20 == 0 else 60), "en") for i in range(500)]
    junk = ["".join(chr(rng.randint(33, 64)) for _ in range(n)) for n in (40, 90, 150, 240)] * 2
    docs = spark.createDataFrame(rows + [(1000 + i, t, ("en", "xx")[i % 2]) for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in kneser_ney.quality_scores(docs, spark.createDataFrame([(i, 1, 0) for i in range(trusted)], LABELS)).collect()}
    assert all(r["threshold"] is not None for r in got.values())
    if trusted > 3:
        assert not any(got[i]["kept"] for i in range(1000, 1000 + len(junk)))
        assert sum(not got[i]["kept"] for i in range(500)) <= 5


def toxic_docs(rng, n, start):
    rows, labels = [], []
    for i in range(start, start + n):
        toxic = i % 5 == 0
        words = prose(rng, rng.randint(10, 80)).split(" ")
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "trash", "scum", "blarghen", "blarghic", "blarghos"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    rows, labels = toxic_docs(rng, 600, 0)
    more, truth = toxic_docs(rng, 300, 1000)
    df = spark.createDataFrame(rows + more, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, spark.createDataFrame(labels, LABELS)).collect()}
    wrong = [i for i, _, y in truth if got[i]["toxic"] != bool(y)]
    assert len(wrong) <= 3
    assert all(0 <= got[i]["p_insult"] <= 1 and 0 <= got[i]["p_contempt"] <= 1 for i, _ in more)


def test_toxicity_chain_uses_earlier_probabilities():
    import numpy as np
    import pyarrow as pa
    rng = random.Random(9)
    rows, labels = toxic_docs(rng, 300, 0)
    lists = pa.array([sorted(toxicity.features(t)) for _, t in rows], pa.list_(pa.string()))
    words = toxicity.WordRows(lists)
    first = np.array([int("idiot" in t.split(" ")) for _, t in rows])
    chain = toxicity.train_chain(words, {"a": first, "b": np.array([y for *_, y in labels])}, np.arange(len(rows)) % 3)
    assert [len(earlier) for _, _, earlier, _ in chain] == [0, 1]
    a, b = toxicity.score(toxicity.features("idiot the"), chain), toxicity.score(toxicity.features("the"), chain)
    assert a[0] > 0.9 > 0.1 > b[0] and a[1] > b[1]


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 1, 0), (None, 1, 1), (7, 1, None)], LABELS)
    for use in (labels, labels.limit(0)):
        got = toxicity.toxicity(odd, use).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows())
        assert toxicity.toxicity(none, use).collect() == []
    assert all(r["p_toxic"] is None and r["toxic"] is False for r in got)


def page(lang, text, mark):
    return f'<html lang="{mark}"><body><article><p>{text}</p></article></body></html>' if mark is not None else f"<p>{text}</p>"


def test_languages_fuse_evidence(spark, none):
    rng = random.Random(10)
    syllables = {"en": "th ing the and wh er".split(), "de": "sch ung der ein ch zu".split()}
    words = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    docs = spark.createDataFrame([(i, words(x, 50), x) for i, x in enumerate(["en", "de"] * 20)] + [(90, None, "en"), (91, "x", None)], "doc_id long, text string, lang string")
    rows = [(i, f"https://{x}{i % 3}.site-{x}.org/{i}", page(x, words(x, 40), x)) for i, x in enumerate(["en", "de"] * 30)]
    rows += [(100, "https://de0.site-de.org/x", "<p></p>"), (101, "http://new.example.org/", page("en", words("en", 40), "de")), (102, None, None),
             (103, "https://de1.site-de.org/y", page("de", "", None)), rows[0], (None, "::bad//", "<html lang=de"), (104, "https://en0.site-en.org/q", page("en", words("de", 30), "de"))]
    pages = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "page_id long, url string, html string, host string, score double")
    got = language_id.identify_languages(pages, docs)
    by = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    assert all(by[i]["lang"] == x and by[i]["text_lang"] == x for i, x in enumerate(["en", "de"] * 30))
    assert by[100]["lang"] == by[103]["lang"] == "de" and by[100]["text_lang"] is None
    assert by[101]["lang"] == "en" and by[101]["markup_lang"] == "de"
    assert by[102]["lang"] in ("en", "de") and 0.3 < by[102]["probability"] < 0.9
    assert by[104]["lang"] == "de"
    assert language_id.identify_languages(pages.limit(0), docs).collect() == []
    assert all(r["lang"] is None for r in language_id.identify_languages(pages, docs.limit(0)).collect())


def test_text_model_counts_all_documents(spark, odd):
    langs, model = language_id.text_model(odd)
    assert langs == ["de", "en"] and model.shape == (2, language_id.CELLS)
    assert table(odd.select(F.lit(1).alias("a")).limit(1), "a") == [(1,)] and SCHEMA


def brute_languages(pages, langs, model):
    """Fused by dictionaries, page by page, the page's own vote taken out of all counts."""
    import math
    import re
    from collections import Counter

    from labelloop.llm.common import mixed
    from labelloop.llm.html_extract import host_of, page_blocks

    facts = []
    for _, url, html in pages:
        parts, mark = page_blocks(html or "")
        main = [t for chrome, m, _, t in parts if m and not chrome] or [t for chrome, _, _, t in parts if not chrome]
        b = " ".join(main).encode().lower()
        cells = [int(mixed(np.array([b[i] << 16 | b[i + 1] << 8 | b[i + 2]], np.uint64))[0] >> np.uint64(48)) for i in range(len(b) - 2)]
        score = [sum(float(model[k, c]) for c in cells) for k in range(len(langs))]
        host = host_of(url)
        facts.append({"score": score, "text": langs[int(np.argmax(score))] if cells else None, "host": host, "domain": language_id._domain(host),
                      "suffix": host.rpartition(".")[2], "markup": re.split("[-_]", mark.strip().lower())[0]})
    count = {key: Counter((f[key], f["text"]) for f in facts) for key in ("host", "domain", "suffix", "markup")}
    total = Counter(f["text"] for f in facts)
    out = []
    for (page, _, _), f in zip(pages, facts, strict=True):
        fused = []
        for k, lang in enumerate(langs):
            own, voted = int(f["text"] == lang), int(f["text"] is not None)
            seen = lambda key, x: count[key][f[key], x]  # noqa: B023, E731
            all_seen = {key: sum(seen(key, x) for x in langs) for key in ("host", "domain")}
            prior = (total[lang] - own + 0.5) / (sum(total[x] for x in langs) - voted + 0.5 * len(langs))
            for key in ("domain", "host"):
                prior = (seen(key, lang) - own + 20 * prior) / (all_seen[key] - voted + 20)
            value = 0.25 * f["score"][k] + math.log(prior)
            for key in ("markup", "suffix"):
                value += math.log((seen(key, lang) - own + 0.5) / (total[lang] - own + 0.5 * len({g[key] for g in facts})))
            fused.append(value)
        weight = sum(math.exp(v - max(fused)) for v in fused)
        out.append((page, langs[int(np.argmax(fused))], round(1 / weight, 6), f["text"], f["markup"]))
    return out


def test_languages_equal_a_plain_fusion(spark):
    rng = random.Random(21)
    words = {"en": "the and of to with from".split(), "de": "und der das nicht von mit".split(), "fr": "les des avec pour dans une".split()}
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words[k]) for _ in range(40)), k) for i, k in enumerate("en de fr".split() * 8)], "doc_id long, text string, lang string")
    hosts = ["a.example.com", "b.example.com", "x.co.uk", "y.co.uk", "10.0.0.1", "n.github.io", "m.github.io", "z.de"]
    pages = []
    for i in range(60):
        k = rng.choice(list(words))
        mark = rng.choice(["", f' lang="{k}"', ' lang="en-US"'])
        pages.append((i, rng.choice([f"http://{rng.choice(hosts)}/{i}", None]), rng.choice([None, "<p></p>"]) if i % 15 == 0 else f"<html{mark}><p>{' '.join(rng.choice(words[k]) for _ in range(rng.randint(1, 9)))}</p>"))
    pages += [pages[3], (None, *pages[4][1:])]
    langs, model = language_id.text_model(docs)
    got = [(r["page_id"], r["lang"], round(r["probability"], 6), r["text_lang"], r["markup_lang"])
           for r in language_id.identify_languages(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), docs).collect()]
    assert sorted(got, key=str) == sorted(brute_languages(pages, langs, model), key=str)


def test_languages_of_a_few_clear_pages(spark):
    """A page's own vote is out of both sides; a tie goes to the language that sorts first."""
    docs = spark.createDataFrame([(1, "the cat and the dog with the house of the man " * 9, "en"), (2, "der hund und die katze von dem haus nicht mit dem mann " * 9, "de")], "doc_id long, text string, lang string")
    pages = [(1, "http://a/", "<p>the cat and the dog with the house</p>"), (2, "http://b/", "<p>der hund und die katze von dem haus</p>"), (3, "http://c/", "")]
    got = {r["page_id"]: (r["lang"], r["text_lang"]) for r in language_id.identify_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert got[1] == ("en", "en") and got[2] == ("de", "de") and got[3] == ("de", None)


def test_registered_domains():
    for host, want in (("www.bbc.co.uk", "bbc.co.uk"), ("co.uk", "co.uk"), ("a.github.io", "a.github.io"), ("x.a.github.io", "a.github.io"), ("10.0.0.1", "10.0.0.1"),
                       ("a.b.example.com", "example.com"), ("com", "com"), ("", ""), ("co.de", "co.de"), ("a.t.co", "t.co")):
        assert language_id._domain(host) == want
