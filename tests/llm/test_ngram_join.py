import re

import numpy as np
import pytest
from lodestrata.llm import ngram_join as nj


def features(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, percent=85):
    sets = [features(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def test_equals_brute_force(docs, texts):
    rows = [(7 * i + 3, t) for i, t in enumerate(texts)] + [(3, None)]
    got = sorted(tuple(r) for r in nj.near_duplicates(docs(rows)).collect())
    assert got == brute(rows)


def test_empty_table_and_null_id(docs):
    assert nj.near_duplicates(docs([])).count() == 0
    got = nj.near_duplicates(docs([(None, "a b c d e"), (4, "a b c d e"), (9, None), (None, "alone here")])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(None, 4), (4, 4), (9, 9), (None, None)], key=str)


@pytest.mark.parametrize("size", [1, 2, 5, 6, 7, 9, 13, 20, 47, 150, 800])
def test_similar_sets_share_a_signature(size):
    rng = np.random.default_rng(size)
    table = nj.bands(85, 1 << 20)
    for _ in range(60):
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        drop = rng.integers(0, size - -(-size * 85 // 100) + 1)
        b = a[drop:]
        room = len(b) * 100 // 85 - size
        b = np.concatenate([b, rng.integers(0, 2**63, rng.integers(0, max(room, 0) + 1), dtype=np.uint64)])
        inter = size - drop
        if 100 * inter >= 85 * (size + len(b) - inter):
            assert np.intersect1d(nj.signatures(a, 85, table), nj.signatures(b, 85, table)).size
