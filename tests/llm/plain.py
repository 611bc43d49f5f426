"""The operators' results in plain Python, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, percent):
    """{key: (set size, least key reachable)} of (key, text) rows."""
    sets = {i: shingles(t, k) for i, t in rows}
    holders, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for held in holders.values():
        common.update((a, b) for n, b in enumerate(held) for a in held[:n])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def removed(rows, length=100):
    """{key: (n_bytes, n_removed, n_spans, kept_sha256)} of (key, text) rows in order."""
    seen, out = set(), {}
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            piece = data[i:i + length]
            if piece in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[key] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def quality(text):
    text = text or ""
    w = words(text, lower=False)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = {p for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def benchmark_hits(docs, items, k=5, percent=80):
    """{(doc, item): (similarity, start)} of the best windows."""
    out = {}
    prepared = []
    for item, text in items:
        w = (text or "").lower().split()
        if w:
            prepared.append((item, len(w), Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))))
    for doc, text in docs:
        w = (text or "").lower().split()
        for item, n, wanted in prepared:
            for s in range(len(w) - n + 1):
                piece = w[s:s + n]
                have = Counter(tuple(piece[i:i + k]) for i in range(max(1, n - k + 1)))
                common = sum((have & wanted).values())
                union = sum((have | wanted).values())
                if 100 * common >= percent * union and common / union > out.get((doc, item), (0,))[0]:
                    out[doc, item] = (common / union, s)
    return out


def short_document_hits(docs, items, k=5, percent=80):
    """{(doc, item): (similarity, start, words)} of documents with fewer words than the item, each one window."""
    out = {}
    for doc, text in docs:
        w = (text or "").lower().split()
        have = Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))
        for item, passage in items:
            v = (passage or "").lower().split()
            wanted = Counter(tuple(v[i:i + k]) for i in range(max(1, len(v) - k + 1)))
            common, union = sum((have & wanted).values()), sum((have | wanted).values())
            if 0 < len(w) < len(v) and 100 * common >= percent * union:
                out[doc, item] = (common / union, 0, len(w))
    return out


def runs(x, least=12):
    """Sorted (start, length, period) of all runs of a list: every period by itself, with the least period of each stretch."""
    found = {}
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j > i and j - i >= max(p, least - p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i) + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def planted(doc_id, w):
    """The words of a document with the run that its id plants."""
    h, n = crc(doc_id), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def run_digest(doc_id, text):
    w = planted(doc_id, words(text, lower=False))
    found = runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    kept = " ".join(t for i, t in enumerate(w) if i not in gone)
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def audit(docs, labels):
    """{(part, order, step): (kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)} of (doc_id, text, lang) rows."""
    from itertools import permutations

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    firsts = {}
    for i, t, _ in docs:
        firsts.setdefault(t or "", []).append(math.inf if i is None else i)
    masks = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if (math.inf if i is None else i) > min(firsts[t]) else set()
        masks[lang or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, rows in masks.items():
        total = Counter()
        for order in permutations("ABCDE"):
            for step in range(5):
                f, before = order[step], set(order[:step])
                here = [r for r in rows if f in r[0] and not r[0] & before]
                total[f] += len(here)
                out[part, "".join(order), step + 1] = [
                    sum(not r[0] & (before | {f}) for r in rows), len(here), sum(f in r[0] and bool(r[0] & before) for r in rows),
                    sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)]
        for key in out:
            if key[0] == part:
                out[key].append(total[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}
