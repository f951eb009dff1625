import numpy as np

from tests.llm.helpers import AWKWARD, documents
from tilespark.llm import decontam


def make(spark, seed=0):
    rng = np.random.default_rng(seed)
    syllables = "ba co du fe gi ho ju ka le mi no pu ra se ti vo".split()
    words = np.array(["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(4000)])
    common = words[:20]
    text = lambda n: [str(rng.choice(common)) if rng.random() < 0.4 else str(rng.choice(words)) for _ in range(n)]
    items = [" ".join(text(int(n))) + "." for n in rng.integers(16, 60, 25)]
    clean = [" ".join(text(int(n))) for n in rng.integers(30, 400, 150)]
    leaked, truth = [], set()
    for k in range(50):
        item = items[k % 25].split()
        if k >= 25:  # a paraphrase: some words changed, the end kept
            for j in rng.choice(len(item) - 4, len(item) // 8, replace=False):
                item[j] = str(rng.choice(words))
        body = text(int(rng.integers(0, 300)))
        at = int(rng.integers(0, len(body) + 1))
        leaked.append(" ".join(body[:at] + [w.upper() if k % 3 == 0 else w for w in item] + body[at:]))
        truth.add((len(clean) + k, k % 25))
    docs = documents(spark, clean + leaked + AWKWARD)
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(90, None, 1), (91, "", 1), (0, items[0], 1)], "item_id long, text string, doc_id int")
    return docs, bench, truth


def test_finds_copies_and_paraphrases_and_leaves_clean_documents(spark):
    docs, bench, truth = make(spark)
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert len(truth - got) <= 2 and {d for d, _ in got} <= {d for d, _ in truth}
    assert len(list(decontam._parts(iter([(i, "x" * 90) for i in range(9)]), 200))) == 5


def test_results_depend_neither_on_the_parts_nor_on_the_rank(spark):
    docs, bench, _ = make(spark, 2)
    want = sorted(map(tuple, decontam.leaks(docs, bench).collect()))
    assert len(want) > 40
    for other in ({"rank": 8, "max_bytes": 2500}, {"rank": 40}):
        assert sorted(map(tuple, decontam.leaks(docs, bench, **other).collect())) == want


def test_a_thousand_items_in_one_part_and_in_many(spark):
    rng = np.random.default_rng(8)
    words = np.array(["w" + str(i) for i in range(6000)])
    items = [" ".join(rng.choice(words, int(n))) for n in rng.integers(15, 60, 1000)]
    texts = [" ".join([*rng.choice(words, 30), *(items[k].split() if k < 60 else []), *rng.choice(words, 30)]) for k in range(90)]
    docs, bench = documents(spark, texts).coalesce(2), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted(map(tuple, decontam.leaks(docs, bench).collect()))
    assert {(d, i) for d, i, *_ in want} >= {(k, k) for k in range(60)}
    assert sorted(map(tuple, decontam.leaks(docs, bench, max_bytes=130_000).collect())) == want


def test_candidates_equal_those_of_all_pairs(spark):
    docs, bench, _ = make(spark, 5)
    items = sorted({(r.item_id, r.text) for r in bench.where("text <> ''").collect()})
    vocabulary = decontam.Vocabulary([t for _, t in items])
    codes = decontam.coded(docs, vocabulary)
    idf = np.log((1 + docs.count()) / (1 + decontam.document_frequencies(codes, vocabulary))) + 0.1
    rows = [np.frombuffer(r.codes, vocabulary.dtype) for r in codes.collect()]
    texts = [r.text or "" for r in docs.collect()]
    assert [c[c > 0].tolist() for c in rows] == [vocabulary.item(t).tolist() for t in texts]
    for rank in (8, 64):
        index = decontam.Index([(i, vocabulary.item(t), decontam.answer_start(t)) for i, t in items], idf, 24, 0.35)
        index.project(decontam.randomised_svd(spark.createDataFrame(index.passages(), "codes binary"), idf, rank))
        got = {(row, start, k) for row, start, k, _ in index.candidates(rows)}
        want, near = set(), set()
        for row, c in enumerate(rows):
            for start in range(0, len(c), 12):
                held = set(c[start : start + 24].tolist()) - {0}
                for k, (i, a, b) in enumerate(index.spans):
                    p = set(index.items[i][1][a:b].tolist())
                    share = sum(idf[x] ** 2 for x in p & held) / sum(idf[x] ** 2 for x in p)
                    if share >= 0.35:
                        (near if share < 0.3501 else want).add((row, start, k))
        assert len(want) > 100 and want <= got <= want | near


def test_weighted_lcs_equals_the_plain_recurrence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(0, 12)), rng.integers(0, 5, rng.integers(1, 12))
        w = rng.random(len(a))
        t = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = max(t[i, j + 1], t[i + 1, j], t[i, j] + w[i] if a[i] == b[j] else 0)
        assert abs(decontam.weighted_lcs(a, b, w) - t[-1, -1]) < 1e-9


def test_passages_cover_the_item():
    for n in range(0, 100):
        spans = decontam.passage_spans(n, 24)
        assert {k for a, b in spans for k in range(a, b)} == set(range(n))


def test_empty_tables(spark):
    docs, bench, _ = make(spark)
    assert decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.leaks(docs.limit(5), bench.limit(0)).count() == 0


def test_long_items_are_found_whatever_their_length(spark):
    rng = np.random.default_rng(3)
    words = np.array(["w" + str(i) for i in range(30_000)])
    items = [" ".join(rng.choice(words, n)) for n in (200, 400, 600, 1000, 300, 800)]
    copies, truth = [], set()
    for i, item in enumerate(items):
        for part in (item.split()[60:110], item.split()[-60:]):
            truth.add((len(copies), i))
            copies.append(" ".join([*rng.choice(words, 37), *part, *rng.choice(words, 40)]))
    clean = [" ".join(rng.choice(words, 150)) for _ in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(documents(spark, copies + clean), bench, rank=64).collect()}
    assert got == truth


def test_a_place_that_fails_does_not_hide_another(spark):
    rng = np.random.default_rng(4)
    words = ["w" + str(i) for i in range(5000)]
    item = list(rng.choice(words, 24, replace=False))
    filler = lambda n: list(rng.choice(words, n))
    text = " ".join([*sorted(item), *filler(126), *item, *filler(60)])  # a glossary in phase with the windows, a copy out of phase
    docs = documents(spark, [text] + [" ".join(filler(200)) for _ in range(20)])
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()] == [(0, 0)]


def test_a_short_item_in_a_third_of_the_rows(spark):
    rng = np.random.default_rng(6)
    item = [f"hot{i}" for i in range(15)]
    rare = iter(range(100_000))
    filler = lambda n: [f"rare{next(rare)}" for _ in range(n)]
    texts = [" ".join([*filler(int(rng.integers(20, 60))), *(item if k % 3 == 0 else []), *filler(40)]) for k in range(300)]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontam.leaks(documents(spark, texts), bench).collect()} == set(range(0, 300, 3))
