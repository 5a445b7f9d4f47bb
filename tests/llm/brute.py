"""Plain versions of the operators, for small inputs."""
import hashlib
import re

import xxhash


def suffix_dedup(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            s = b[p:p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest(), kept))
    return out


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(rows, bits=2):
    prints = [(i, simhash(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [p for p in prints if p[0] is not None]
    for n, (i, a) in enumerate(known):
        for j, b in known[n + 1:]:
            if (a ^ b).bit_count() <= bits and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(i, f"{f:016x}", None if i is None else find(i)) for i, f in prints]


class KneserNey:
    """Interpolated modified Kneser-Ney over bytes, from dictionaries of strings."""

    def __init__(self, texts, order):
        self.order = order
        top = {}
        for t in texts:
            b = bytes(order - 1) + t.encode()
            for i in range(order - 1, len(b)):
                g = b[i - order + 1:i + 1]
                top[g] = top.get(g, 0) + 1
        self.counts = {order: top}
        for n in range(order - 1, 0, -1):
            c = {}
            for g in self.counts[n + 1]:
                c[g[1:]] = c.get(g[1:], 0) + 1
            self.counts[n] = c
        self.discounts, self.contexts = {}, {}
        for n, c in self.counts.items():
            m = [0] + [sum(v == k for v in c.values()) for k in range(1, 5)]
            y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0.5
            self.discounts[n] = [0] + [min(max(k - (k + 1) * y * m[k + 1] / m[k], 0.05), k - 0.05) if m[k] else 0.5 * k for k in range(1, 4)]
            for g, v in c.items():
                self.contexts.setdefault((n, g[:-1]), []).append(v)

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / 256
        seen = self.contexts.get((n, gram[:-1]))
        if not seen:
            return self.p(gram[1:])
        d = self.discounts[n]
        own = self.counts[n].get(gram, 0)
        weight = sum(d[min(v, 3)] for v in seen) / sum(seen)
        return max(own - d[min(own, 3)], 0) / sum(seen) + weight * self.p(gram[1:])

    def log_prob(self, text):
        import math
        b = bytes(self.order - 1) + text.encode()
        return sum(math.log(self.p(b[i - self.order + 1:i + 1])) for i in range(self.order - 1, len(b)))


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def contaminated(text, items, window=15, percent=80):
    """Whether an aligned window of an item agrees with the text in enough words."""
    w = words(text)
    for item in items:
        v = words(item)
        size = min(window, len(v))
        if len(v) < 3:
            continue
        for s in range(len(v) - size + 1):
            for at in range(-size + 1, len(w)):
                same = sum(0 <= at + k < len(w) and v[s + k] == w[at + k] for k in range(size))
                if 100 * same >= percent * size:
                    return True
    return False


def shards(rows, n_shards=8):
    """Longest processing time first, group by group; slots by id (null first), then text."""
    import heapq
    import zlib
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode(), []).append(i)
    heap, shard = [(0, s) for s in range(n_shards)], {}
    for b in sorted(groups, key=lambda b: (-len(groups[b]) * (len(b) + 1), hashlib.sha256(b).digest())):
        load, shard[b] = heapq.heappop(heap)
        heapq.heappush(heap, (load + len(groups[b]) * (len(b) + 1), shard[b]))
    out, slots = [], [0] * n_shards
    for i, b in sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1]).digest())):
        out.append((i, len(b) + 1, zlib.crc32(b), "bytes", shard[b], slots[shard[b]], None))
        slots[shard[b]] += 1
    return out


def merkle(rows):
    """``rows`` (doc_id, source, lang, n_chars, text): every tree as lists of levels."""
    import zlib
    digest = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def levels(row):
        out = [row]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def climb(tree, at, leaf):
        others = []
        for level in tree[:-1]:
            run = level[at - at % 2:at - at % 2 + 2]
            others += run[:at % 2] + run[at % 2 + 1:]
            run[at % 2] = leaf
            leaf, at = digest(*run), at // 2
        return others, leaf

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for k in langs:
        trees[k] = sorted(((r, digest(*map(field, r))) for r in trees[k]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    built = {k: levels([d for _, d in trees[k]]) for k in langs}
    forest = levels([built[k][-1][0] for k in langs])
    out = []
    for n, k in enumerate(langs):
        for at, (r, leaf) in enumerate(trees[k]):
            shown = leaf
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                shown = digest(*map(field, (r[0], r[1], r[2], r[3] + 1, r[4])))
            low, top = climb(built[k], at, shown)
            high, end = climb(forest, n, top)
            out.append((r[0], leaf, built[k][-1][0], forest[-1][0], digest(*low, *high), end, end == forest[-1][0]))
    return out


def runs(words):
    """(start, length, period) of every run, trying each period on all words."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                w = words[i:i + length]
                if not any(w[p:] == w[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(doc_id, text):
    import zlib
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in drop)))
