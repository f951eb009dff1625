"""Ranked search: every score and rank against a plain version; awkward rows, parts, ties."""

import math
import re
from collections import Counter

from tests.llm.helpers import AWKWARD, documents
from tilespark.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _plain(docs, items, k):
    tf = [(i, Counter(_terms(t))) for i, t in docs]
    tf = [(i, c, sum(c.values())) for i, c in tf if c]
    n_docs, total = len(tf), sum(n for _, _, n in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(_terms(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c, n in tf:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                found.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def _check(spark, texts, ids, items, k=5, **more):
    found = lexical.search(documents(spark, texts, ids), spark.createDataFrame(items, "item_id long, text string"), k=k, **more)
    got = sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == _plain(list(zip(ids, texts)), items, k)


def test_scores(spark):
    texts = [" ".join(f"w{(i * j) % (7 + j)}" for j in range(1, 5 + i % 11)) + (" Ünï-Çödé W1" if i % 4 == 0 else "") for i in range(120)] + ["w1 w2 w3"] * 40
    items = [(j, " ".join(f"W{(j + x) % 9}" for x in range(1 + j % 5)) + " çödé") for j in range(20)]
    _check(spark, texts, list(range(len(texts))), items, block=16)
    _check(spark, texts, list(range(len(texts))), items, block=7, max_links=10)


def test_awkward_rows(spark):
    texts = [*AWKWARD, "word WORD word", "word", "word"]
    ids = [*range(len(AWKWARD)), None, 3, 3]
    _check(spark, texts, ids, [(1, "word a same"), (1, "text"), (None, "x"), (2, None), (3, ""), (4, "nowhere")], k=3)


def test_empty(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(documents(spark, []), items).collect() == []
    assert lexical.search(documents(spark, ["a"]), items.limit(0)).collect() == []
