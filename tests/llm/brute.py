"""Plain Python versions of the text operators' answers, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from base64 import b32encode
from collections import Counter, defaultdict


def blank_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def held_out(doc_id, parts, part):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == part


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def shingles(text, k):
    w = blank_words(ascii_lower(text))
    n = min(k, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()


def components(rows, k, share=80):
    """doc_id -> smallest doc_id reachable; rows: (doc_id, text)."""
    parent = {d: d for d, _ in rows if d is not None}
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a != b and min(len(x), len(y)) * 100 >= share * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= share * (len(x) + len(y) - both):
                    p, q = sorted((find(parent, a), find(parent, b)))
                    parent[q] = p
    return {d: find(parent, d) for d in parent}


def contamination(text, items, window=10):
    """(n_words, n_hit, sorted item ids) of a text against (item_id, text) rows."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    hit, names = set(), set()
    for item, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(body))
        n = min(window, len(w))
        grams = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n and item is not None else set()
        for i in range(len(words) - n + 1 if grams else 0):
            if tuple(words[i:i + n]) in grams:
                hit.update(range(i, i + n))
                names.add(str(item))
    return len(words), len(hit), sorted(names)


def base_scores(rows, train):
    """doc row -> (n_tokens, n_known, base_score); rows and train: texts."""
    end = object()
    tokens = lambda t: [*blank_words(ascii_lower(t)), end]
    count = Counter(w for t in train for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return [(len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for t in rows], n


def base_counts(text):
    w = blank_words(text)
    seen = [x for x in (text or "").split("\n") if blank_words(x)]
    bare = [x.strip(" \t\n\x0b\f\r") for x in seen]
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(seen) - len(set(seen)), len(covered), bare


def digest(payload):
    return b32encode(hashlib.sha1(payload).digest()).decode()


def url_parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (ascii_lower(m[1]), m[2]) if m else ("", "")


def url_rule(host, path, rules):
    fit = [(len(r), r, v) for r, v in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fit)[1:] if fit else (None, None)


def boilerplate(rows, ratio, least):
    """host -> lines; rows: (host, text)."""
    pages = defaultdict(set)
    for host, text in rows:
        pages[host or ""].add(text)
    out = {}
    for host, texts in pages.items():
        count = Counter(x for t in texts if t is not None for x in {y.strip(" \t\n\x0b\f\r") for y in t.split("\n")} if x)
        out[host] = {x for x, c in count.items() if c >= least and c > ratio * len(texts)}
    return out
