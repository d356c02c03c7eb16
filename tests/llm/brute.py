"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def long_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        hit = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        hit = np.cumsum(hit)[:-1] > 0
        edge = np.diff(np.concatenate([[0], hit.astype(int), [0]]))
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        out.append((len(b), int(hit.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def unigram(rows):
    def words(t):
        return [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]

    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, t in rows if not out(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    return {d: (out(d), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for d, t in rows}


def bag(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def near_classes(rows, similarity=0.8):
    bags = {d: bag(t) for d, t in rows}
    up = {d: d for d in bags}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = bags[a], bags[b]
            n = sum((x & y).values())
            if x and y and n >= similarity * (sum(x.values()) + sum(y.values()) - n):
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    return {d: top(d) for d in ids}


def dedup_lines(texts, w=2, long=False):
    """Each text without the lines of runs of w, and (long) the long lines, that stand earlier."""
    seen, out = set(), []
    for t in texts:
        lines = (t or "").split("\n")
        own = [i for i, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for n in range(len(own)):
            if n + w <= len(own):
                key = tuple(lines[i] for i in own[n : n + w])
                gone |= set(range(own[n], own[n + w - 1] + 1)) if key in seen else set()
                seen.add(key)
            x = lines[own[n]]
            if long and (len(WORD.findall(x)) >= 50 or len(x) >= 200):
                gone |= {own[n]} if (x,) in seen else set()
                seen.add((x,))
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t)
    return out


def thue_morse(n, a="s", b="q"):
    """A string and its complement that polynomial hashes modulo a power of two take for equal."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)
