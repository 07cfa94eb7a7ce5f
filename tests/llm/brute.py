"""Plain-Python versions of the operators, for small tables."""

import collections
import hashlib
import re

WHITE = re.compile(r"[\x20\x09-\x0D]")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def exact(rows):
    """(doc_id, text) -> {doc_id: (keep_id, group_size, sha256)}"""
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[WHITE.sub("", text or "")].append((-len(text or ""), i))
    return {
        i: (min(members)[1], len(members), hashlib.sha256(norm.encode()).hexdigest())
        for norm, members in groups.items()
        for _, i in members
    }


def shingles(text, k=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near(rows, percent, k=5):
    """(doc_id, text) -> {doc_id: (n_shingles, component_id)}"""
    sets = {i: shingles(text, k) for i, text in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    held = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in held[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def contaminated(rows, items, percent=5, span=13):
    """(doc_id, text), (item_id, text) -> {doc_id: (n_words, n_hit, n_items, sha256, contaminated)}"""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        m = min(span, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[i : i + m])].add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in rows:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    found |= own
        names = sorted(str(x) for x in found)
        out[doc] = (
            len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
            len(hit) > 0 and 100 * len(hit) >= percent * len(w),
        )
    return out
