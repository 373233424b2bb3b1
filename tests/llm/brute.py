"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER))


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_components(texts):
    sets = {}
    for d, t in texts.items():
        w = words(t)
        sets[d] = frozenset([tuple(w)] if w else []) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    u = Union(sets)
    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                u.join(a, b)
    return {d: (len(sets[d]), u.find(d)) for d in sets}


def repeated_bytes(texts, length):
    """text list -> (removed, spans, sha256 of what stays) of each."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def least_cuts(words, width, value):
    """Where a row of words is cut: before each that has the least value of width consecutive ones, the first of equals."""
    return {min(range(i, i + width), key=lambda j: (value(words[j]), j)) for i in range(len(words) - width + 1)}


def sentences(text, long, piece=10, value=None):
    out = []
    for s in punctuated(text, long):
        cuts = sorted(least_cuts([w[0] for w in s], piece, value) - {0}) if len(s) > piece else []
        out += [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]
    return out


def punctuated(text, long):
    spots = [(m.group().encode().translate(LOWER), m.start(), m.end()) for m in re.finditer(r"[^ \t-\r]+", text or "")]
    out, now = [], []
    for i, w in enumerate(spots):
        now.append(w)
        if w[0][-1:] in (b".", b"!", b"?") or i + 1 == len(spots) or "\n" in text[w[2] : spots[i + 1][1]]:
            if len(now) > long:
                part = []
                for x in now:
                    part.append(x)
                    if x[0][-1:] in (b",", b";", b":"):
                        out.append(part)
                        part = []
                out += [part] if part else []
            else:
                out.append(now)
            now = []
    return out


def span_removals(texts, least, least_words, long, piece, value):
    cut = {d: sentences(t, long, piece, value) for d, t in texts.items()}
    found, own = defaultdict(list), {}
    for d, s in cut.items():
        own[d] = []
        for i in range(len(s)):
            n = 0
            for j in range(i, len(s)):
                n += len(s[j])
                if j - i + 1 >= least and n >= least_words:
                    key = tuple(tuple(w[0] for w in x) for x in s[i : j + 1])
                    found[key].append((d, i))
                    own[d].append((i, j + 1, key))
                    break
    gone = {d: set() for d in cut}
    for d, spans in own.items():
        for i, j, key in spans:
            if min(found[key]) != (d, i):
                gone[d] |= set(range(i, j))
    return {d: (len(cut[d]), len(gone[d])) for d in cut}


def tiles(doc, item, least):
    """Greedy string tiling by the textbook: longest free common run first, ties by place in the item, then in the document."""
    used_d, used_i, found = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for t in range(len(item)):
            for a in range(len(doc)):
                n = 0
                while a + n < len(doc) and t + n < len(item) and doc[a + n] == item[t + n] and not used_d[a + n] and not used_i[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, t, a)
        n, t, a = best
        if n < least:
            return found
        used_d[a : a + n] = [True] * n
        used_i[t : t + n] = [True] * n
        found.append((a, t, n))
