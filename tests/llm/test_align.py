"""Alignment: all columns against a plain version over tokens; texts of many kinds; pairs beyond the broadcast."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from tests.llm.helpers import AWKWARD, documents
from tilespark.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["<|endoftext|> inside", "tab\tand  two blanks", " leading", "trailing ", "a\n\nb\n", "▁ mark", "<0x0A> as text", "don't   stop", "x = 10**12; y=[1,2]",
       "日本語 テキスト 漢字", "ünï çödé élève naïve", "🙂🙂 emoji 🙂", "no break", "=" * 700, "ab\0cd", "Word,word;word. Word", "line\nline word", "\n"]


@pytest.fixture(scope="module")
def sides():
    return align.ByteLevelSide(A), align.PieceSide(B)


def _plain(texts, sides):
    rows, seen = [], []
    for text in texts:
        tokens = [[(int(i), len(s.bytes[i])) for i in s.text(text)] for s in sides] if text else [[], []]
        if text and any(b"".join(s.bytes[i] for i, _ in t) != b" " + text.encode() for s, t in zip(sides, tokens)):
            tokens = [[], []]
        spans = []
        for t in tokens:
            at, out = 0, []
            for i, n in t:
                out.append((i, at, at + n))
                at += n
            spans.append(out)
        links, j0 = [], 0
        for a, x, y in spans[0]:
            while j0 < len(spans[1]) and spans[1][j0][2] <= x:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][1] < y:
                links.append((a, spans[1][j][0]))
                j += 1
        cuts = {y for _, _, y in spans[0]} & {y for _, _, y in spans[1]}
        groups, part = [], [[], []]
        ends = [iter(s) for s in spans]
        for c in sorted(cuts):
            for k in range(2):
                part[k] = []
                for i, _, y in ends[k]:
                    part[k].append(str(i))
                    if y == c:
                        break
            groups.append(",".join(part[0]) + "|" + ",".join(part[1]))
        seen.append(links)
        rows.append([len(spans[0]), len(spans[1]), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    count = Counter(p for links in seen for p in set(links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [(*r[:4], sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), r[4]) for r, links in zip(rows, seen)]


def _report(spark, texts, **more):
    got = align.report(documents(spark, texts), A, B, **more).collect()
    return [tuple(r)[1:] for r in sorted(got, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("shared", [1 << 20, 3])
def test_equals_plain(spark, sides, shared):
    texts = [*AWKWARD, *ODD, *[f"The word{i} and the other {i * 37} words of it, the same again" for i in range(40)]]
    assert _report(spark, texts, max_shared=shared) == _plain(texts, sides)


def test_text_without_spelling_counts_nothing(spark):
    assert _report(spark, ["▁ mark", None, ""]) == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_repeated_ids_and_empty_table(spark):
    got = align.report(documents(spark, ["a b", "a b", None], [1, 1, None]), A, B).collect()
    assert len(got) == 3
    assert align.report(documents(spark, []), A, B).collect() == []


def test_word_path_equals_whole_texts(sides):
    import pyarrow as pa

    texts = ["Hello world's end, naïve élan.\nNew line of text 12 345", "one", "Ünï—x"]
    bounds, word, found = align.PairEncoder(A, B).encode_all(pa.array(texts))
    for s, (ids, n) in zip(sides, found):
        starts = [0, *n.cumsum()]
        for k, text in enumerate(texts):
            own = [i for w in word[bounds[k] : bounds[k + 1]] for i in ids[starts[w] : starts[w + 1]]]
            assert own == s.text(text).tolist()


def test_words_cut_alike_build_no_set_of_cuts(spark):
    texts = ["the same words again and again", "unlikelihoods of Zürich"]
    docs = documents(spark, texts)
    plan = align.aligned(docs, A, B)._jdf.queryExecution().analyzed().toString()
    assert "zip_with" in plan
    for row in align.aligned(docs, A, B).collect():
        groups = [[part.split(",") for part in g.split("|")] for g in row.groups.split(";")]
        assert [sum(len(g[s]) for g in groups) for s in range(2)] == [row.n_a, row.n_b]
        assert len(row.links) == sum(len(a) + len(b) - 1 for a, b in groups) and row.n_groups == len(groups)
