"""Main text of web pages with a host suffix array (operator 7).

A page becomes a stream of blocks and tokens. Mark-up says what can be said from one page: scripts,
styles, forms, navigation, page headers and footers, side bars, notices, adverts and comments (by
element, role, or a word of class or id) are chrome, and ``article`` or ``main`` declares the main
text, which is kept whole: an article that others copy is still the article.

Everything else is decided by the host, by a suffix array over the token streams of its pages
(without declared main text but with chrome; copies of a page are one stream, so a copied page is
not taken for boilerplate):

1. A suffix can begin a repeat only if its first ``RUN`` tokens are in ``MIN_PAGES`` different
   streams. Such places form runs, and no repeat goes beyond its run, so there the suffix is cut.
   It is also cut at ``DEPTH`` tokens: longer repeats go on in the suffixes that start inside them.
2. Equal suffixes become one row with a weight: one for each stream and, where a stream holds two
   neighbours in the order, less one at what they share. So the weights below any prefix add up to
   the number of different streams that hold it, however often each does.
3. Spark deals these rows by host and first ``RUN`` tokens and sorts them. Neighbours are compared
   one after the other; what they share is the tree of all repeats, each at its full length, with
   its number of streams.
4. A repeat is boilerplate if at least ``MIN_PAGES`` streams hold it and it is either on one in
   ``SHARE`` streams of the host, or long: ``RUN`` tokens and one more for each doubling of the
   host's streams, since repeats by chance grow like the logarithm of the text. The longest such
   repeat at every place goes; the unique runs of blocks that are not chrome are the main text.

A large host is no group: a bucket holds different continuations of one prefix, not pages, and is
read as a sorted stream; joins back to the pages are salted. Texts of a page move once, when it
meets its places.

Nulls: a null html is an empty page, a null url an empty host. Broken mark-up never raises: open
elements end with their parent, unknown ones are inline. Repeated rows are extracted each.
"""

from __future__ import annotations

import html as html_codes
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloop.llm.common import blocks, stored
from labelloop.session import ship_package

RUN, MIN_PAGES, SHARE, DEPTH, SALT = 6, 3, 8, 64, 8

# Element names and the words of class and id that mark chrome.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "select", "object", "canvas")
TO_THE_END = frozenset(("script", "style", "noscript", "iframe", "textarea"))
CHROME = frozenset("nav aside footer form head title dialog menu button label fieldset option audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul""".split())
CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
ENDS_P = BLOCK - {"br", "body", "html", "head"}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
CONTAINERS = frozenset("div section aside ul ol dl table details figure header footer nav center".split())
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices
    alert sidebar sidebars side menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager comment comments
    disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget widgets
    hidden skip copyright""".split())
BESIDE_MARKS = frozenset("""area article articles bar block body bottom box button buttons col column container content desktop email entry fixed form global group header
    holder icon icons inner item items left link links list main mobile module news outer page panel post posts primary reader region right row secondary
    section site slot sticky stories story text thread top unit user wrap wrapper zone""".split())
ARTICLE_MARKS = frozenset("comment comments related ad promo".split())
PAGE_HEADER = frozenset(("header", "hgroup"))

_OPEN = re.compile(r"<(?:(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)|!--|!\[CDATA\[|[!?/])")
_NAME = re.compile(r"[\s/]*(=?[^\s/>=]*)")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_AFTER_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Source:
    """A page's tags and texts from front to back. Each character is looked at a bounded number of
    times, however broken the page is: an end that was not found once is not looked for again."""

    def __init__(self, html: str):
        self.html, self.gone = html, set()

    def find(self, what: str, at: int) -> int:
        found = -1 if what in self.gone else self.html.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """The attributes from ``at`` on (the first of a name counts), whether the tag closes itself,
        and where it ends. A quote without its end is part of the value."""
        html, out = self.html, {}
        while True:
            m = _NAME.match(html, at)
            at = m.end()
            if at >= len(html) or (not m[1] and html[at] == ">"):
                return out, html[at - 1] == "/", min(at + 1, len(html))
            value, equals = "", _EQUALS.match(html, at)
            if equals:
                at = equals.end()
                quote = html[at:at + 1]
                end = self.find(quote, at + 1) if quote in ("'", '"') else -1
                if end >= 0:
                    value, at = html[at + 1:end], end + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare[0], bare.end()
            out.setdefault(m[1].lower(), value)

    def parts(self):
        """(text, name, is an end tag, attributes, closes itself): a text has no name."""
        html, at = self.html, 0
        while m := _OPEN.search(html, at):
            if m.start() > at:
                yield html[at:m.start()], None, False, None, False
            at, name = m.end(), m["name"]
            if name is None:
                if m[0] == "<!--":
                    if html.startswith((">", "->"), at):
                        at += 1 if html[at] == ">" else 2
                        continue
                    ends = [(i, len(e)) for e in ("-->", "--!>") if (i := self.find(e, at)) >= 0]
                else:
                    e = "]]>" if m[0] == "<![CDATA[" else ">"
                    ends = [(i, len(e))] if (i := self.find(e, at)) >= 0 else []
                at = sum(min(ends)) if ends else len(html)
                continue
            attrs, closed, at = self.attributes(at)
            name = name.lower()
            if name in _AFTER_RAW and not m["end"]:
                end = None if closed and name == "svg" or name in self.gone else _AFTER_RAW[name].search(html, at)
                if end:
                    at = end.end()
                elif not closed:
                    self.gone.add(name)
                    if name in TO_THE_END:
                        at = len(html)
                yield " ", None, False, None, False
                continue
            yield "", name, bool(m["end"]), attrs, closed
        if at < len(html):
            yield html[at:], None, False, None, False


def marked(value: str) -> bool:
    """Whether a word of a class or id says chrome: it is a mark, or is made of marks and of words
    that stand beside them (``ad-slot``, but not ``side-effects``)."""
    for token in value.split():
        parts = [p.lower() for p in _PARTS.findall(token) if len(p) > 1]
        if parts and MARKS.intersection(parts) and all(p in MARKS or p in BESIDE_MARKS for p in parts):
            return True
    return False


def _is_chrome(name: str, attrs: dict[str, str], in_main: bool) -> bool:
    if name in CHROME or (name in PAGE_HEADER and not in_main):
        return True
    if name in ("body", "html", "main"):
        return False
    if name == "article":
        return any(ARTICLE_MARKS.intersection(token.lower() for token in attrs.get(key, "").split()) for key in ("class", "id"))
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in attrs.get("style", "").lower().replace(" ", ""):
        return True
    return name in CONTAINERS and any(marked(attrs.get(key, "")) for key in ("class", "id"))


def page_blocks(html: str) -> tuple[list[tuple[bool, bool, bool, str]], str]:
    """Blocks in page order, (chrome, in declared main text, only links, text), and the declared
    language. The declared main text is that of every outermost ``main``, or, on a page without
    one, of the outermost ``article`` that has most text."""
    out, piece, lang = [], [], ""
    stack: list[tuple[str, bool, int]] = []  # name, chrome, region: with what encloses it
    kinds = [""]  # of each region
    state, links, linked, plain = (False, 0), 0, 0, 0

    def flush():
        nonlocal linked, plain
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                out.append((*state, linked > 0 and plain == 0, text))
            piece.clear()
        linked = plain = 0

    for text, name, is_end, attrs, closed in Source(html).parts():
        if name is None:
            piece.append(html_codes.unescape(text))
            if not text.isspace():
                if links:
                    linked += 1
                else:
                    plain += 1
            continue
        if is_end:
            if name in BLOCK:
                flush()
            if name == "a":
                links = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    new = stack[-1][1:] if stack else (False, 0)
                    if new != state:
                        flush()
                        state = new
                    break
                if stack[i][0] in ("article", "main", "body", "table") and name not in ("article", "main", "body", "html", "div", "section"):
                    break
            continue
        if name in BLOCK:
            flush()
            if name == "body":
                stack.clear()
                state = (False, 0)
            closes = CLOSES.get(name, ())
            while stack and (stack[-1][0] in closes or stack[-1][0] == "p" and name in ENDS_P):
                stack.pop()
            state = stack[-1][1:] if stack else (False, 0)
        if name == "html":
            lang = attrs.get("lang") or attrs.get("xml:lang") or lang
        if name == "a":
            links = 1
        if name in VOID or closed and name not in BLOCK:
            continue
        chrome, region = state[0] or _is_chrome(name, attrs, state[1] > 0), state[1]
        if not chrome and not region and (name in ("article", "main") or attrs.get("role", "").lower() == "main"):
            region = len(kinds)
            kinds.append("article" if name == "article" else "main")
        new = (chrome, region)
        if new != state:
            flush()
            state = new
        stack.append((name, *new))
    flush()
    sizes = [0] * len(kinds)
    for chrome, region, _, text in out:
        if region and not chrome:
            sizes[region] += len(text)
    held = {r for r, size in enumerate(sizes) if size and kinds[r] == "main"}
    if not held and any(sizes):
        held = {sizes.index(max(sizes))}
    return [(chrome, region in held, only, text) for chrome, region, only, text in out], lang


def host_of(url: str) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower().rstrip(".") if m else ""


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def _table(schema: str, rows) -> pa.RecordBatch:
    """Rows as a batch of the columns of ``schema``."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
_PARSED = "page_id long, url string, uid long, host long, declared boolean, text string, stream long, words string, places array<int>"
_COUNTED = "prefix long, stream long"
_PLACED = "uid long, place int, prefix long"
_WEIGHED = "host long, prefix long, tail string, weight long"
_REPEATS = "key long, length int"
_KEYED = "uid long, place int, key long"


def _rows(batches, by: str):
    """The rows of each block of texts."""
    for batch in batches:
        for block in blocks(batch, by):
            yield zip(*(c.to_pylist() for c in block.columns), strict=True)


def _parse(batches):
    """Each page once: its main text if it is declared; else where in its stream main text may be."""
    for rows in _rows(batches, "html"):
        out = []
        for page, url, source in rows:
            parts, _ = page_blocks(source)
            declared = any(main and not chrome for chrome, main, _, _ in parts)
            text = " ".join(t for chrome, main, _, t in parts if main and not chrome) if declared else None
            places, stream = [], []
            for chrome, main, only_links, t in parts:
                if declared and main and not chrome:
                    continue
                words = t.split(" ")
                if not declared and not chrome and not only_links:
                    places += range(len(stream), len(stream) + len(words))
                stream += words
            words = " ".join(stream)
            out.append((page, url, _hash(f"{page}\0{url}\0{source}"), _hash(host_of(url)), declared, text, _hash(words), words, places))
        yield _table(_PARSED, out)


def _prefixes(host: int, words: list[str]) -> list[int]:
    return [_hash(f"{host} {' '.join(words[i:i + RUN])}") for i in range(len(words) - RUN + 1)]


def _counted(batches):
    """The prefixes of the suffixes of each stream."""
    for rows in _rows(batches, "words"):
        yield _table(_COUNTED, list({(p, stream) for host, stream, words in rows for p in _prefixes(host, words.split())}))


def _placed(batches):
    for rows in _rows(batches, "words"):
        yield _table(_PLACED, [(uid, i, p) for uid, host, words in rows for i, p in enumerate(_prefixes(host, words.split()))])


def _tails(words: list[str], hits: list[int]) -> list[tuple[int, list[str]]]:
    """(place, suffix) for each repeated prefix; the suffix ends with the run of places it is in."""
    at = np.sort(np.array(hits, np.int64))
    last = at[np.append(np.diff(at) != 1, True)]
    ends = np.minimum(last[np.searchsorted(last, at)] + RUN, at + DEPTH)
    return [(i, words[i:e]) for i, e in zip(at.tolist(), ends.tolist(), strict=True)]


def _shared(one: list[str], two: list[str]) -> int:
    n = 0
    for a, b in zip(one, two, strict=False):
        if a != b:
            break
        n += 1
    return n


def _tail(words: list[str]) -> str:
    """The suffix as text; every word ends with a space, so that suffixes that share words are neighbours."""
    return " ".join(words) + " "


def _weighed(batches):
    """The suffixes of each stream, less what neighbours of one stream share."""
    for rows in _rows(batches, "words"):
        weights: dict = {}
        for host, words, hits in rows:
            before: list[str] = []
            for tail in sorted(t for _, t in _tails(words.split(), hits)):
                both = _shared(before, tail)
                for part, weight in ((tail, 1), (tail[:both], -1 if both >= RUN else 0)):
                    if weight:
                        key = (host, _tail(part))
                        weights[key] = weights.get(key, 0) + weight
                before = tail
        yield _table(_WEIGHED, [(host, _hash(f"{host} {' '.join(tail.split(' ', RUN)[:RUN])}"), tail, w) for (host, tail), w in weights.items()])


class Bucket:
    """The sorted suffixes of one host and prefix, as the tree of what neighbours share. Texts do not stay."""

    def __init__(self, prefix: int | None, streams: int):
        self.prefix, self.streams, self.before = prefix, streams, []
        self.depth, self.total, self.parent = [0], [0], [0]     # of each node; the root is 0
        self.open, self.keys, self.leaf = [0], [], []

    def _close(self, shared: int):
        """Nodes deeper than ``shared`` have all their suffixes."""
        while self.depth[self.open[-1]] > shared:
            node = self.open.pop()
            if self.depth[self.open[-1]] < shared:
                self._open(shared)
            self.parent[node] = self.open[-1]
            self.total[self.open[-1]] += self.total[node]

    def _open(self, depth: int):
        self.open.append(len(self.depth))
        self.depth.append(depth)
        self.total.append(0)
        self.parent.append(0)

    def add(self, key: int, words: list[str], weight: int):
        self._close(_shared(self.before, words))
        if self.depth[self.open[-1]] < len(words):
            self._open(len(words))
        self.total[self.open[-1]] += weight
        self.keys.append(key)
        self.leaf.append(self.open[-1])
        self.before = words

    def repeats(self) -> list[tuple[int, int]]:
        """(key, length of its longest prefix that is boilerplate) of each suffix that has one."""
        self._close(0)
        long = RUN + self.streams.bit_length()
        best = [0] * len(self.depth)
        for node in sorted(range(1, len(best)), key=self.depth.__getitem__):
            n = self.total[node]
            good = n >= MIN_PAGES and self.depth[node] >= RUN and (n * SHARE >= self.streams or self.depth[node] >= long)
            best[node] = self.depth[node] if good else best[self.parent[node]]
        return [(key, best[node]) for key, node in zip(self.keys, self.leaf, strict=True) if best[node]]


def _compared(batches):
    """The boilerplate among suffixes that come sorted, bucket after bucket."""
    bucket = Bucket(None, 0)
    for rows in _rows(batches, "tail"):
        out = []
        for host, streams, prefix, tail, weight in rows:
            if prefix != bucket.prefix:
                out += bucket.repeats()
                bucket = Bucket(prefix, streams)
            bucket.add(_hash(f"{host} {tail}"), tail.split(), weight)
        yield _table(_REPEATS, out)
    yield _table(_REPEATS, bucket.repeats())


def _keyed(batches):
    for rows in _rows(batches, "words"):
        yield _table(_KEYED, [(uid, i, _hash(f"{host} {_tail(t)}")) for uid, host, words, hits in rows for i, t in _tails(words.split(), hits)])


def _unique_runs(batches):
    """The tokens that no boilerplate covers."""
    for rows in _rows(batches, "words"):
        out = []
        for page, url, words, places, starts, lengths in rows:
            words = words.split()
            covered = np.zeros(len(words), bool)
            for start, length in zip(starts or (), lengths or (), strict=True):
                covered[start:start + length] = True
            out.append((page, url, " ".join(words[p] for p in places if not covered[p])))
        yield _table("page_id long, url string, text string", out)


def _salted(rows: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join; rows of one key are dealt over ``SALT`` parts, ``small`` is repeated as often."""
    parts = small.withColumnRenamed(key, "_key").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    x = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
    return x.join(parts, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_part"))).drop("_key", "_salt", "_part")


def host_repeats(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, hits: places of repeated prefixes), and the suffix array's (key, length): the longest
    boilerplate that begins a suffix."""
    seen = parsed.select("host", "stream", "words").mapInArrow(_counted, _COUNTED).distinct()
    repeated = stored(seen.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_PAGES).select("prefix"), "prefixes")
    places = parsed.select("uid", "host", "words").mapInArrow(_placed, _PLACED)
    hits = stored(_salted(places, repeated, "prefix", "uid").groupBy("uid").agg(F.collect_set("place").alias("hits")), "places")
    streams = parsed.groupBy("host", "stream").agg(F.min("uid").alias("uid"))
    once = hits.join(streams.select("uid").distinct(), "uid")
    pages = parsed.select("uid", "host", "words").join(once, "uid").dropDuplicates(["uid"]).select("host", "words", "hits")
    weighed = stored(pages.mapInArrow(_weighed, _WEIGHED).groupBy("host", "prefix", "tail").agg(F.sum("weight").alias("weight")), "suffixes")
    array = _salted(weighed, streams.groupBy("host").agg(F.count(F.lit(1)).alias("streams")), "host", "tail")
    array = array.select("host", "streams", "prefix", "tail", "weight").repartition("prefix").sortWithinPartitions("prefix", "host", "tail")
    return hits, stored(array.mapInArrow(_compared, _REPEATS), "suffix-array")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row: page_id, url, text (empty if there is none), n_chars (code points)."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    parsed = stored(rows.mapInArrow(_parse, _PARSED), "pages")
    hits, repeats = host_repeats(parsed)
    undeclared = parsed.filter("not declared")
    keyed = undeclared.select("uid", "host", "words").join(hits, "uid").select("uid", "host", "words", "hits").mapInArrow(_keyed, _KEYED)
    found = (_salted(keyed, repeats, "key", "uid").groupBy(F.col("uid").alias("of")).agg(F.collect_set(F.struct("place", "length")).alias("found"))
             .select("of", F.col("found.place").alias("starts"), F.col("found.length").alias("lengths")))
    decided = undeclared.join(found, F.col("uid") == F.col("of"), "left").select("page_id", "url", "words", "places", "starts", "lengths")
    text = parsed.filter("declared").select("page_id", "url", "text").union(decided.mapInArrow(_unique_runs, "page_id long, url string, text string"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
