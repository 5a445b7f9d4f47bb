"""Language identification of web pages by Bayesian evidence fusion (operator 1).

Four kinds of evidence are added as log probabilities for each language:

- text: a naive Bayes model over byte trigrams of the page's text (main text if it is declared),
  counted over all labelled ``documents``; neighbouring trigrams are not independent, so the sum is
  scaled down to ``TEXT_WEIGHT`` of its size;
- the language declared in the mark-up, and the address suffix: how often each value comes with a
  language, by grouped counts over the pages (language by text alone), smoothed over all its values;
- the host: its pages' languages, smoothed towards those of the registered domain, and these
  towards those of all pages (``HOST_WEIGHT`` pages each). A page's own vote is taken out.

Trigrams fall into ``CELLS`` cells, which bounds the broadcast model for any corpus: ``CELLS`` numbers
a language. Counts of a large host come from partial sums, and the tables of hosts, domains, suffixes
and mark-up join salted.

Nulls: a null html is an empty text, a null url has an empty host; without text the other evidence
decides, without any labelled document lang and probability are null. Ties go to the language that
sorts first. Repeated rows are identified each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloop.llm.common import blocks, documents, mixed, stored, text_bytes
from labelloop.llm.html_extract import host_of, page_blocks

CELLS, MAX_LANGUAGES = 1 << 16, 512
TEXT_WEIGHT, HOST_WEIGHT, SMOOTH = 0.25, 20.0, 0.5
SALT = 8


def _cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each trigram that lies in one row, and its row; ASCII letters in lower case."""
    x = data.astype(np.uint64)
    x[(x >= 65) & (x <= 90)] += np.uint64(32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:-2] == row[2:]
    return (mixed(code[inside]) >> np.uint64(48)).astype(np.int64), row[:-2][inside]


def _cell_counts(batches):
    names = ["lang", "cell", "c"]
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for block in blocks(batch):
            data, offsets = text_bytes(block)
            cell, row = _cells(data, offsets)
            langs = np.array(block.column("lang").to_pylist(), object)
            for lang in set(langs):
                got = np.bincount(cell[langs[row] == lang], minlength=CELLS)
                held[lang] = held.get(lang, 0) + got
            if len(held) > 32:
                yield from _emit(held, names)
                held = {}
    yield from _emit(held, names)


def _emit(held, names):
    for lang, n in sorted(held.items()):
        cell = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(n[cell])], names)


def text_model(docs: DataFrame, lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages of the labelled documents, and a log probability for each cell and language."""
    rows = documents(docs, "doc_id", "text", F.col(lang_col).cast("string").alias("lang")).filter("lang is not null")
    counts = stored(rows.select("text", "lang").mapInArrow(_cell_counts, "lang string, cell int, c long")
                    .groupBy("lang", "cell").agg(F.sum("c").alias("c")), "cells")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages: is {lang_col} a language?")
    t = counts.toArrow()  # at most CELLS rows a language
    table = np.full((len(langs), CELLS), SMOOTH)
    at = {lang: i for i, lang in enumerate(langs)}
    table[[at[x] for x in t.column("lang").to_pylist()], t.column("cell").to_numpy()] += t.column("c").to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _suffix(host: str) -> str:
    return host.rpartition(".")[2]


# Second levels under which countries register names, and domains whose
# subdomains belong to different owners.
SECOND_LEVELS = frozenset("ac co com edu gob gouv gov govt gub go mil ne net nom or org sch".split())
SHARED_DOMAINS = frozenset("""amazonaws.com appspot.com azurewebsites.net blogspot.com cloudfront.net fandom.com github.io gitlab.io herokuapp.com netlify.app
    pages.dev substack.com tumblr.com vercel.app web.app weebly.com wixsite.com wordpress.com workers.dev""".split())


def _domain(host: str) -> str:
    """The registered domain of a host: one label below the suffix under which names are registered;
    an address of numbers is its own."""
    labels = host.split(".")
    if all(x.isdigit() for x in labels) or ":" in host:
        return host
    suffix = 1
    if len(labels) > 2 and (len(labels[-1]) == 2 and labels[-2] in SECOND_LEVELS or ".".join(labels[-2:]) in SHARED_DOMAINS):
        suffix = 2
    return ".".join(labels[-suffix - 1:])


_EVIDENCE = "page_id long, url string, host string, domain string, suffix string, markup string, score array<double>"


def _evidence(shared, n_langs: int):
    names = [x.split()[0] for x in _EVIDENCE.split(", ")]

    def run(batches):
        for batch in batches:
            for block in blocks(batch, "html"):
                urls = block.column("url").to_pylist()
                texts, marks = [], []
                for source in block.column("html").to_pylist():
                    parts, lang = page_blocks(source)
                    main = [t for chrome, in_main, _, t in parts if in_main and not chrome] or [t for chrome, _, _, t in parts if not chrome]
                    texts.append(" ".join(main))
                    marks.append(re.split(r"[-_]", lang.strip().lower())[0])
                data, offsets = text_bytes(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]))
                cell, row = _cells(data, offsets)
                scores = np.stack([np.bincount(row, shared.value[k, cell], len(texts)) for k in range(n_langs)], axis=1)
                hosts = [host_of(u) for u in urls]
                yield pa.RecordBatch.from_arrays([block.column("page_id"), block.column("url"), pa.array(hosts, pa.string()), pa.array([_domain(h) for h in hosts], pa.string()),
                                                  pa.array([_suffix(h) for h in hosts], pa.string()), pa.array(marks, pa.string()), pa.array(list(scores), pa.list_(pa.float64()))], names)
    return run


def _best(score: Column, langs: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, langs)), F.array_position(score, F.array_max(score)).cast("int"))


def _votes(rows: DataFrame, key: str, langs: list[str]) -> DataFrame:
    """Pages by text language, for each value of ``key``, as an array."""
    n = [F.count_if(F.col("text_lang") == lang) for lang in langs]
    return rows.groupBy(F.col(key).alias(f"v_{key}")).agg(F.array(*n).alias(f"n_{key}"))


def _met(rows: DataFrame, votes: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` with the votes of their value of ``key``; the rows of one value are dealt over ``SALT`` parts."""
    parts = votes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int"))
    return salted.join(parts, (F.col(key) == F.col(f"v_{key}")) & (F.col("salt") == F.col("part"))).drop(f"v_{key}", "salt", "part")


def identify_languages(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lang_col: str = "lang") -> DataFrame:
    """One row for each row of ``pages``: page_id, url, lang, probability, text_lang (by text alone;
    null without text), markup_lang (as declared, may be empty)."""
    langs, table = text_model(docs, lang_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    if not langs:
        none = F.lit(None).cast("string")
        return rows.select("page_id", "url", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("markup_lang"))
    shared = pages.sparkSession.sparkContext.broadcast(table)
    x = rows.mapInArrow(_evidence(shared, len(langs)), _EVIDENCE)
    x = stored(x.withColumn("text_lang", F.when(F.array_min("score") < 0, _best(F.col("score"), langs))), "evidence")
    k = len(langs)
    everything = x.agg(*(F.count_if(F.col("text_lang") == lang) for lang in langs)).first()
    domain, host = (_votes(x, key, langs) for key in ("domain", "host"))
    # the domain of a host is a function of its name; counts of both go along with the host
    hosts = _met(x.select("host", "domain").distinct().join(host, F.col("host") == F.col("v_host")).drop("v_host"), domain, "domain", F.col("host"))
    x = _met(x, hosts.select(F.col("host").alias("v_host"), "n_host", "n_domain"), "host", F.struct("page_id", "url"))
    values = {}
    for key in ("markup", "suffix"):
        votes = _votes(x, key, langs)
        values[key] = votes.count()
        x = _met(x, votes, key, F.struct("page_id", "url"))
    out, voted = [], F.when(F.col("text_lang").isNotNull(), 1).otherwise(0)
    for i, lang in enumerate(langs):
        own = F.when(F.col("text_lang") == lang, 1).otherwise(0)
        n = {key: F.col(f"n_{key}")[i] - own for key in ("host", "domain", "markup", "suffix")}
        size = {key: F.aggregate(f"n_{key}", F.lit(0).cast("long"), lambda a, b: a + b) - voted for key in ("host", "domain")}
        prior = (everything[i] - own + SMOOTH) / (sum(everything) - voted + SMOOTH * k)
        for key in ("domain", "host"):
            prior = (n[key] + HOST_WEIGHT * prior) / (size[key] + HOST_WEIGHT)
        evidence = [F.log((n[key] + SMOOTH) / (everything[i] - own + SMOOTH * values[key])) for key in ("markup", "suffix")]
        out.append(F.col("score")[i] * TEXT_WEIGHT + F.log(prior) + evidence[0] + evidence[1])
    x = x.withColumn("fused", F.array(*out)).withColumn("most", F.array_max("fused"))
    weight = F.aggregate(F.transform("fused", lambda v: F.exp(v - F.col("most"))), F.lit(0.0), lambda a, b: a + b)
    return x.select("page_id", "url", _best(F.col("fused"), langs).alias("lang"), (1 / weight).alias("probability"), "text_lang", F.col("markup").alias("markup_lang"))
