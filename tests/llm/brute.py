"""Plain Python versions of the operators, for small inputs."""

import hashlib
from itertools import combinations

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text):
    return (text or "").encode().split()


def kept_words(docs, width=13):
    """{row number: kept words} of (doc_id, text) rows."""
    first = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - width + 1):
            if doc is not None:
                k = tuple(w[i : i + width])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - width + 1):
            if doc is not None and first[tuple(w[i : i + width])] < doc:
                gone.update(range(i, i + width))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def kept_lines(docs):
    """Text of each (doc_id, text) row without later occurrences of three-line windows."""
    first = {}
    rows = []
    for doc, text in docs:
        ls = (text or "").split("\n")
        at = (-1 if doc is None else doc, text or "")
        rows.append((at, ls))
        for i in range(len(ls) - 2):
            k = tuple(ls[i : i + 3])
            if any(x.strip(" \t\n\x0b\x0c\r") for x in k):
                first[k] = min(first.get(k, (at[0], at[1], i)), (at[0], at[1], i), key=lambda x: (x[0], x[2]))
    out = []
    for at, ls in rows:
        gone = set()
        for i in range(len(ls) - 2):
            f = first.get(tuple(ls[i : i + 3]))
            if f and (f[0], f[2]) != (at[0], i):
                gone.update((i, i + 1, i + 2))
        out.append("\n".join(x for i, x in enumerate(ls) if i not in gone))
    return out


def shingles(text, width=5):
    w = (text or "").encode().translate(_LOWER).split()
    if len(w) >= width:
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def groups(ids, links):
    """{id: least id reachable}"""
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def similar(docs, percent=75):
    sets = {}
    for doc, text in docs:
        sets.setdefault(doc, shingles(text))
    links = [
        (a, b)
        for a, b in combinations(sets, 2)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {d: len(s) for d, s in sets.items()}, groups(sets, links)


def sha(data):
    return hashlib.sha256(data).hexdigest()
