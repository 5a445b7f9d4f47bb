"""Quality rules, line first (operator 10).

Each line with a word is judged on its own; a line that fails is removed, and a document that
loses more than ``MAX_LOST_PERCENT`` of its word characters is rejected, as is one that fails the
base rules (too few words, too many repeated word windows). Rules of a line:

- punctuation: over 10 symbols (``#*$%&|<>``) for 100 characters in words, or more exclamation
  marks than half the words (three at least);
- navigation: two or more separators among ``| > »`` standing as words, or up to three words that
  are all menu words;
- boilerplate: a stock phrase in a line of up to 30 words;
- repetition: equal to an earlier line of the text.

A null text has no words; texts with under ten words, empty ones included, fail the base rules.
Every row gives one row; repeated and null ids are kept as they are.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from labelloop.llm.common import blocks, documents

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
MAX_LOST_PERCENT = 30
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", ">", "»")
MENU = ("home", "about", "contact", "login", "register", "search", "menu", "next", "previous", "top", "share", "help", "faq", "sitemap")
STOCK = ("all rights reserved", "cookie", "privacy policy", "terms of use", "terms of service", "subscribe to", "sign up for",
         "enable javascript", "click here", "skip to content", "powered by", "licensed under", "released under the")

_STOCK = re.compile("|".join(map(re.escape, STOCK)), re.IGNORECASE | re.ASCII)
_SPACES = str.maketrans(dict.fromkeys(SPACE, " "))


def line_words(text: str) -> list[str]:
    """Words between ASCII white space; other spaces belong to words."""
    return [w for w in text.translate(_SPACES).split(" ") if w]


def fails(line: str) -> bool:
    words = line_words(line)
    chars = sum(map(len, words))
    if 100 * sum(line.count(c) for c in SYMBOLS) > 10 * chars:
        return True
    marks = line.count("!")
    if marks >= 3 and 2 * marks > len(words):
        return True
    if sum(w in SEPARATORS for w in words) >= 2:
        return True
    if len(words) <= 3 and all(w.lower() in MENU for w in words):
        return True
    return len(words) <= 30 and _STOCK.search(line) is not None


def judge(text: str) -> tuple:
    words = text.encode().split()  # ASCII white space only
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    grams = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        counts, end = Counter(grams), 0
        for i, g in enumerate(grams):
            if counts[g] > 1:
                repeated += i + WINDOW - max(end, i)
                end = i + WINDOW
    seen, duplicates, lost, kept_lines, removed = set(), 0, 0, [], 0
    for line in text.split("\n"):
        if not line.strip(SPACE):
            kept_lines.append(line)
            continue
        again = line in seen
        seen.add(line)
        duplicates += again
        if again or fails(line):
            removed += 1
            lost += len(line) - sum(line.count(c) for c in SPACE)
        else:
            kept_lines.append(line)
    base_failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    kept = not base_failed and 100 * lost <= MAX_LOST_PERCENT * word_chars
    return n, word_chars, symbols, duplicates, repeated, base_failed, kept, removed, lost, "\n".join(kept_lines)


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "lost_chars", "clean_text"]


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: the base figures, the verdict ``kept``, and the text without the
    lines that failed."""
    types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]

    def run(batches):
        for batch in batches:
            for block in blocks(batch):
                rows = [(i, *judge(t)) for i, t in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)
    return documents(df, id_col, text_col).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, lost_chars long, clean_text string")


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


QUALITY_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
pos AS (SELECT rid, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) >= {WINDOW}),
gram AS (SELECT rid, i, words[i:i + {WINDOW - 1}] AS g FROM pos),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM gram),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range({WINDOW})) AS k) WHERE c > 1 GROUP BY rid),
line AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
full_line AS (SELECT rid, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words,
  row_number() OVER (PARTITION BY rid, line ORDER BY i) AS nth FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
measured AS (SELECT *, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM full_line),
judged AS (SELECT rid, chars, nth,
  nth > 1
  OR 100 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > 10 * chars
  OR (length(regexp_replace(line, '[^!]', '', 'g')) >= 3 AND 2 * length(regexp_replace(line, '[^!]', '', 'g')) > len(words))
  OR len(list_filter(words, lambda x: x IN ({_quoted(SEPARATORS)}))) >= 2
  OR (len(words) <= 3 AND len(list_filter(words, lambda x: lower(x) NOT IN ({_quoted(MENU)}))) = 0)
  OR (len(words) <= 30 AND regexp_matches(line, '(?i){"|".join(STOCK)}')) AS failed FROM measured),
lines AS (SELECT rid, count(*) FILTER (nth > 1) AS dup, count(*) FILTER (failed) AS removed, coalesce(sum(chars) FILTER (failed), 0) AS lost FROM judged GROUP BY rid),
base AS (SELECT w.rid, doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(removed, 0) AS n_lines_removed, coalesce(lost, 0) AS lost_chars
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept,
  n_lines_removed, CAST(lost_chars AS BIGINT) AS lost_chars
FROM base
"""
