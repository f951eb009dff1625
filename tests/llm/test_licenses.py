import re

import pytest

from tests.llm.helpers import AWKWARD, documents
from tilespark.llm import licenses

FILL = " ".join(f"word{i}" for i in range(3000))


def plain(text, template):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    w, t = words(text), words(template)
    n = min(5, len(t))
    shingles = lambda x: {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
    return len(shingles(w) & shingles(t)) / len(shingles(t))


def test_containment_equals_brute_force(spark):
    long = licenses.TEMPLATES[3][1]
    cut = " ".join(long.split()[: int(len(long.split()) * 0.9)])
    edited = long.replace("use, copy", "use, reproduce")
    texts = [*AWKWARD, *[t for _, t in licenses.TEMPLATES], FILL + " " + long, FILL[:500] + "\n" + cut + "\n" + FILL, edited, "all rights\nreserved", "ALL RIGHTS RESERVED.", "all rights are reserved",
             "Licensed under the Apache License", " ".join(["spam"] * 4090) + " " + long, FILL * 3 + " " + long + " " + FILL]
    got = {(r.doc_id, r.template): round(r.containment, 9) for r in licenses.scan(documents(spark, texts), licenses.templates_table(spark)).collect()}
    want = {(i, k): round(plain(t, x), 9) for i, t in enumerate(texts) for k, (_, x) in enumerate(licenses.TEMPLATES) if plain(t, x) >= 0.8}
    assert got == want and len(want) > 15


def test_collision_guarantee(spark):
    """Every copy with a fifth of its words changed at random places far apart is still retrieved if it still counts."""
    import random

    rng, texts = random.Random(0), []
    for k in range(60):
        w = licenses.TEMPLATES[3][1].split()
        w[rng.randrange(len(w))] = "changed"
        w[rng.randrange(len(w))] = "altered"
        texts.append(FILL[: rng.randrange(2000)] + " " + " ".join(w) + " " + FILL[: rng.randrange(2000)])
    got = {r.doc_id for r in licenses.scan(documents(spark, texts), licenses.templates_table(spark)).where("template = 3").collect()}
    assert got == {i for i, t in enumerate(texts) if plain(t, licenses.TEMPLATES[3][1]) >= 0.8} and len(got) > 30


def test_no_python_on_the_executors(spark):
    plan = licenses.scan(documents(spark, ["a"]), licenses.templates_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("templates", [0, 1])
def test_empty_tables(spark, templates):
    t = licenses.templates_table(spark).limit(templates)
    assert licenses.scan(documents(spark, []), t).count() == 0
    assert licenses.scan(documents(spark, ["a b c d e f"]), t).count() == 0


def test_long_templates_are_found_wherever_segments_are_cut(spark):
    words = [f"w{i}" for i in range(700)]
    templates = spark.createDataFrame([(0, "long", " ".join(words))], "template int, license string, text string")
    texts = [" ".join([f"x{i}" for i in range(at)] + words + [f"y{i}" for i in range(40)]) for at in (0, 3550, 4000, 4095)]
    for most in (1 << 26, 0):
        got = {r.doc_id: r.containment for r in licenses.scan(documents(spark, texts + AWKWARD), templates, max_index_bytes=most).collect()}
        assert got == dict.fromkeys(range(4), 1.0)
