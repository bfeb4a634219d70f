"""Plain in-memory versions of the corpus operators, to hold their results against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near_components(rows, percent):
    """{id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    have = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            have.setdefault(x, []).append(k)
    seen = set()
    for ks in have.values():
        for a in ks:
            for b in ks:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    (i, s), (j, t) = sets[a], sets[b]
                    if 100 * len(s & t) >= percent * len(s | t):
                        parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(s), root(i)) for i, s in sets}


def repeated_windows(rows, width=20):
    """{id: (n_words, n_removed, kept words)} of rows (id, text) with distinct ids."""
    first = {}
    docs = {i: words(t) for i, t in rows}
    for i in sorted(docs):
        for k in range(len(docs[i]) - width + 1):
            first.setdefault(tuple(docs[i][k : k + width]), (i, k))
    out = {}
    for i, w in docs.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] != (i, k):
                gone.update(range(k, k + width))
        out[i] = (len(w), len(gone), [x for k, x in enumerate(w) if k not in gone])
    return out
