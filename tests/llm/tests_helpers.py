"""Plain versions that several tests share."""

import hashlib
import re


def brute_windows(docs, items):
    """doc_id -> words, words hit, items, digest of their ids, contaminated."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    windows = {}
    for i, t in items:
        w = word.findall(low(t or ""))
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = word.findall(low(t or "")), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if s := windows.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    found |= s
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out
