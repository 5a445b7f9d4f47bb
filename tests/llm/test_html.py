import random

import pyarrow as pa

from labelloop.llm.html_extract import DEPTH, MIN_PAGES, RUN, SHARE, _compared, _hash, _tail, _weighed, extract_main_text, host_of, page_blocks
from tests.llm.conftest import prose, table

SCHEMA = "page_id long, url string, html string, host string, tokens string, n_chars string"


def extract(spark, rows):
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return extract_main_text(pages)


def main_text(html):
    return " ".join(t for chrome, main, _, t in page_blocks(html)[0] if main and not chrome)


def test_declared_main_text():
    html = """<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body>
    <header><a href="/">Site</a></header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
    <article class="post"><header><h1>A  title</h1></header><p>One &lt;two&gt; <b>th</b>ree&nbsp;four<br>five<p>six<!-- no > --><aside>side</aside>
    <div class="ad-slot">buy</div><form><input value="x"><p>form</form><figure><img alt=">"><figcaption>seen</figcaption></figure>
    <section id="comments"><article class="comment"><p>first!</p></article></section><p hidden>gone</p><p style="display: none">gone</p>
    <table><tr><td>a<td>b</tr></table><noscript>no</noscript></article><footer>&copy; x</footer></body></html>"""
    assert main_text(html) == "A title One <two> three four five six seen a b"
    assert page_blocks(html)[1] == "en"


def test_broken_markup_is_read_through():
    for html, want in (("<article><p><b>a<br><p>b</article><footer>c</footer>", "a b"), ("<article>a<nav>b</article>c", "a"), ("<article", ""), ("<main>a &am; < b &#x41;", "a &am; < b A"),
                       ("<article>x<script>y", "x"), ("</p></div><article></nav>k</article>", "k"), ("<ARTICLE><P>Q</P></ARTICLE>", "Q"), ("<article><div><p>a</div>b</article>", "a b")):
        assert main_text(html) == want, html


def test_marks_are_on_containers_only():
    for html, want in (
            ('<article><p>a <svg class="i"/> b</p><p>c</p></article>', "a b c"), ("<article>a<object data=x />b</article>", "a b"), ("<article>a<svg><title>t</title></svg>b</article>", "a b"),
            ('<article><p id="side-effects">The side effects are mild.</p><h2 id="related-work">Related work</h2><div class="side-effects">x</div></article>', "The side effects are mild. Related work x"),
            ("<article><p class=it's>Hello it's here</p></article>", "Hello it's here"), ("<article>a<!-- c --!>b<!-->c<!--->d</article>", "abcd"),
            ("<article>x = <math><mi>a</mi></math> y</article>", "x = a y"), ("<main>real</main><div><article>teaser</article></div>", "real"),
            ("<article>one</article><article>two words more</article>", "two words more"), ("<article>&<b>lt;</b></article>", "&lt;"),
            ('<article>a<div class="ad-slot">b</div><div class="sidebarLeft">c</div><div id="article-comments">d</div><div class="Ad">e</div></article>', "a"),
            ('<article>a<p class="share-price">b</p><div class="copyright-law">c</div></article>', "a b c"), ('<article title="x > y" data-a=\'"\'>a</article>', "a"),
            ('<div role="main">a<article>b</article></div><p>c</p>', "a b"), ("<article>a<br/>b<p/>c</article>", "a b c"), ("<article>a</article", "a"), ('<article><a href="x>y</a> z</article>', "y z")):
        assert main_text(html) == want, html


def test_broken_pages_take_linear_time():
    import time
    for broken in ("<script ", "<svg>", "<a href='", '<a b="', "<!--", "<![CDATA[", "<textarea", "<p", "<", "</", "<a =", "<object", "<div class='ad ", "&am", "<select>x", "<!x"):
        at = time.perf_counter()
        page_blocks("<article>x " + broken * (1_000_000 // len(broken)))
        assert time.perf_counter() - at < 10, broken


def test_hosts():
    assert [host_of(u) for u in ("https://A.b.org:80/x?y", "//c.d/", "mailto:x", "", None, "http://u:p@e.f#g")] == ["a.b.org", "c.d", "", "", "", "e.f"]


def brute_undeclared(streams, mains):
    """Tokens not covered by a run that starts in three different streams of the host."""
    seen = {}
    for s in set(map(tuple, streams)):
        for g in {s[i:i + RUN] for i in range(len(s) - RUN + 1)}:
            seen[g] = seen.get(g, 0) + 1
    out = []
    for s, main in zip(streams, mains, strict=True):
        gone = set()
        for i in range(len(s) - RUN + 1):
            if seen[tuple(s[i:i + RUN])] >= 3:
                gone |= set(range(i, i + RUN))
        out.append(" ".join(s[i] for i in main if i not in gone))
    return out


def test_undeclared_pages_keep_unique_runs(spark):
    rng = random.Random(11)
    top, tail = prose(rng, 9), prose(rng, 7)
    rows, streams, mains = [], [], []
    for i in range(8):
        own, menu = prose(rng, rng.randint(0, 30)), prose(rng, 6)
        shared = top if i % 2 else ""
        rows.append((i, f"http://h.org/{i}", f"<nav>{menu}</nav><div>{shared}</div><div>{own}</div><div>{tail}</div>"))
        parts = [p.split() for p in (menu, shared, own, tail)]
        streams.append(sum(parts, []))
        mains.append(range(len(parts[0]), len(streams[-1])))
    rows += [(50 + i, "http://other.org/", rows[0][2]) for i in range(6)]
    rows += [(90, None, None), (91, "http://h.org/e", ""), (92, "http://h.org/d", f"<article>{top}</article>"), (93, "http://h.org/l", "<ul><li><a href=x>One</a></ul><p>only</p>"), rows[1], (None, "http://h.org/1", rows[1][2])]
    got = table(extract(spark, rows), "page_id", "text")
    want = list(zip(range(8), brute_undeclared(streams, mains), strict=True))
    # copies of one page are one stream: nothing on the other host repeats across pages
    whole = " ".join(streams[0][i] for i in mains[0])
    want += [(50 + i, whole) for i in range(6)] + [(90, ""), (91, ""), (92, top), (93, "only"), (1, want[1][1]), (None, want[1][1])]
    assert got == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in extract(spark, rows).collect())
    assert extract(spark, rows[:1]).limit(0).count() == 0
    assert extract_main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_boilerplate(streams):
    """For each stream the tokens of every repeat, of any length, that is boilerplate on the host."""
    different = set(map(tuple, streams))
    held = {}
    for s in different:
        for g in {s[i:j] for i in range(len(s)) for j in range(i + RUN, len(s) + 1)}:
            held[g] = held.get(g, 0) + 1
    long = RUN + len(different).bit_length()
    gone = {g for g, n in held.items() if n >= MIN_PAGES and (n * SHARE >= len(different) or len(g) >= long)}
    for s in streams:
        lost = set()
        for i in range(len(s)):
            for j in range(i + RUN, len(s) + 1):
                if tuple(s[i:j]) in gone:
                    lost |= set(range(i, j))
        yield [w for i, w in enumerate(s) if i not in lost]


def test_only_long_or_frequent_repeats_of_a_large_host_go(spark):
    rng = random.Random(3)
    phrase, chorus, notice, line, deep = (prose(rng, n) for n in (7, 6, 22, 8, 2 * DEPTH + 9))
    own = [prose(rng, 12) for _ in range(60)]
    texts = [f"{t} {line}" if i < 10 else t for i, t in enumerate(own)]             # on a share of the host
    for i in (20, 21, 22):
        texts[i] = f"a{i} {phrase} b{i}"                                            # an ordinary phrase stays
    for i in (30, 31, 32):
        texts[i] = f"c{i} {notice} d{i}"                                            # long, on three pages
    for i in (40, 41, 42):
        texts[i] = f"e{i} {deep} f{i}"                                              # longer than suffixes are compared
    for i in (50, 51):
        texts[i] = " x ".join([own[i], notice[:60], chorus, notice[:60], chorus, chorus, notice]) + f" y{i}"   # often, but on two pages
    texts += ["the the the the the the the the the the the the the"] * 2 + [texts[30]]
    rows = [(i, f"http://large.org/{i}", f"<p>{t}</p>") for i, t in enumerate(texts)]
    got = dict(table(extract(spark, rows), "page_id", "text"))
    want = [" ".join(x) for x in brute_boilerplate([t.split() for t in texts])]
    assert [got[i] for i in range(len(texts))] == want
    assert got[20] == texts[20] and got[0] == own[0] and got[30] == "c30 d30" and got[40] == "e40 f40" and chorus in got[50]


def test_suffix_tree_counts_streams_once():
    rng = random.Random(8)
    for _ in range(60):
        streams = [[rng.choice("ab") for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 9))]
        streams = [list(s) for s in sorted(set(map(tuple, streams)))]
        held, sums = {}, {}
        for s in streams:
            for g in {tuple(s[i:j]) for i in range(len(s)) for j in range(i + RUN, min(len(s), i + DEPTH) + 1)}:
                held[g] = held.get(g, 0) + 1
            hits = list(range(len(s) - RUN + 1))
            if hits:
                for row in next(_weighed([pa.RecordBatch.from_pylist([{"host": 1, "words": " ".join(s), "hits": hits}])])).to_pylist():
                    sums[row["prefix"], row["tail"]] = sums.get((row["prefix"], row["tail"]), 0) + row["weight"]
        n = len(streams)
        long = RUN + n.bit_length()
        rows = [{"host": 1, "streams": n, "prefix": p, "tail": t, "weight": w} for (p, t), w in sorted(sums.items())]
        batches = [pa.RecordBatch.from_pylist(rows[i:i + 7]) for i in range(0, len(rows), 7)]
        got = {r["key"]: r["length"] for b in _compared(batches) for r in b.to_pylist()}
        for s in streams:
            for i in range(len(s) - RUN + 1):
                best = max((j - i for j in range(i + RUN, len(s) + 1)
                            if (c := held[tuple(s[i:j])]) >= MIN_PAGES and (c * SHARE >= n or j - i >= long)), default=None)
                assert got.get(_hash(f"1 {_tail(s[i:])}")) == best
