import random

import numpy as np
import xxhash
from pyspark.sql import Row

from tests.llm.helpers import AWKWARD, documents
from tilespark.llm import simhash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest index reachable, by comparing all pairs."""
    a, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_fingerprints_equal_the_definition():
    rng = random.Random(1)
    for t in [t for t in AWKWARD if t is None or len(t) < 100] + ["Aa Bb\x0bCc  dd\tee", "É é Ab", "a\x1cb c"] + [" ".join(rng.choices("abcdef", k=rng.randrange(9))) for _ in range(50)]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_links_keep_all_connectivity(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(40):  # clusters, chains at distance 1 to 4, and singles
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 40])):
            fps.add(x)
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    rows = spark.createDataFrame([Row(fp=int(np.uint64(f).astype(np.int64))) for f in fps])
    for small, block in ((16, 2048), (2, 8)):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in simhash.links(rows, 3, small, block).collect():
            a, b = (int(np.int64(v).astype(np.uint64)) for v in r)
            assert bin(a ^ b).count("1") <= 3
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        assert [fps.index(find(f)) for f in fps] == plain_components(fps)


def test_awkward_documents(spark):
    got = simhash.near_duplicates(documents(spark, AWKWARD, [7, 3, *range(20, 30)])).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got}
    assert by[7].fingerprint == "0" * 16 and by[7].component_id == by[3].component_id == by[20].component_id == 3
    assert by[25].component_id == by[24].component_id == 24
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_a_great_group_of_near_copies_is_one_component(spark):
    base = " ".join(f"w{i}" for i in range(400)).split()
    texts = []
    for i in range(300):
        words = list(base)
        words[i] = "zz"
        texts.append(" ".join(words))
    got = simhash.near_duplicates(documents(spark, texts + [texts[0]] * 50)).collect()
    fps = [int(r.fingerprint, 16) for r in sorted(got, key=lambda r: r.doc_id)]
    assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == plain_components(fps)
