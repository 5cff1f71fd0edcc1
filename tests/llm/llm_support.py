"""Brute-force versions of the operators, and the tables they read."""

import re
import zlib

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def bucket(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def shingle_set(text, size):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_components(docs, size, percent=80):
    """component of each (id, text), by comparing all sets."""
    sets = {i: shingle_set(t, size) for i, t in docs}
    ids = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    linked, holders = [], {}
    for i in ids:
        common = {}
        for x in sets[i]:
            for j in holders.get(x, ()):
                common[j] = common.get(j, 0) + 1
            holders.setdefault(x, []).append(i)
        linked += [(i, j) for j, n in common.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)]
    return components(sets, linked)
