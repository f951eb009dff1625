"""Personal data by fixed patterns and by bootstrapped contextual extraction.

The fixed patterns (emails, IPv4 addresses, card numbers, phone numbers) give the seeds. Candidates are all other
identifier-like tokens: words of ``SHORTEST`` and more characters that hold a digit, ``@`` or an inner underscore, and runs of such words without
letters, as numbers written in groups. Long candidates of high entropy, as keys and secrets have, are seeds that count ``PRIOR`` only.

The contextual patterns of a seed or candidate are the one or two words before it, those after it, and both sides together,
whatever the token looks like; patterns and instances (distinct tokens) are a bipartite graph. Words are sought within ``REACH``
characters of the token. A pattern enters the graph if ``support`` instances have it and identifier-like tokens stand at
``specific`` of all places of the corpus where its words stand: common words say nothing.

Spark scores the graph in turns. A pattern's belief is the smoothed share of known instances, seeds at first, among its
instances; it is confident at ``confidence`` with ``support`` known instances. A candidate's score is the noisy-or of its confident patterns,
of which ``SHAPE`` depends on how well the instances of its shape score. Candidates that reach ``confidence`` are known
instances from the next turn on, as seeds are, so that patterns met by discovered instances alone come into play. Every
occurrence of a candidate known at the end is a span of kind ``other``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tilespark.functions.naming import unused
from tilespark.functions.storage import materialize
from tilespark.llm.batches import portions

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]")
_MARKER, _SPACE = re.compile("[0-9@_]"), re.compile("[ \t\n\r]")
_SECRET = re.compile("[A-Za-z0-9+/=_-]{16,}")
_LETTER = re.compile(r"[^\W\d_]")
_MARKS = ".,;:!?\"'()[]{}<>#%&*$|~^`"
#: Words on each side of a token that make patterns, the characters in which they are sought, and a candidate's least length.
WORDS, REACH, SHORTEST = 2, 96, 5
#: Part of a candidate's score that its shape decides; what a high-entropy token counts as a seed.
SHAPE, PRIOR = 0.25, 0.9
#: Kinds of patterns: words before, words after, both, for one and two words.
LEFT, RIGHT, BOTH = 1, 3, 5
_BITS = 0xFFFFFFFFFFFFFFFF


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each @ outwards in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans in code points, end exclusive, by kind in the fixed order; each kind's matches don't overlap one another."""
    def octet(part: str) -> bool:
        return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255

    def card(m: re.Match) -> bool:
        digits = _DIGITS.sub("", m[0])
        return 16 <= len(digits) <= 19 and _luhn(digits)

    return {
        "email": _emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if all(map(octet, m.groups()))],
        "card": [m.span() for m in _CARD.finditer(text) if m.end() - m.start() > 15 and card(m)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15] if "+" in text else [],
    }


def _shape(token: str) -> str:
    """Letters to a, digits to 9, runs folded."""
    return re.sub(r"(a)a+|(9)9+", r"\1\2", re.sub("[0-9]", "9", re.sub("[^\\W\\d_]", "a", token)))


def secret_like(token: str) -> bool:
    """16 and more letters, digits and ``+/=_-``, digits and letters among them, of 3 and more bits of entropy a character."""
    if not _SECRET.fullmatch(token) or not _LETTER.search(token) or not re.search("[0-9]", token):
        return False
    return -sum(c / len(token) * math.log2(c / len(token)) for c in Counter(token).values()) >= 3


def _identifier_like(text: str) -> Iterator[tuple[int, int]]:
    """Words between white space that hold a digit, @ or _, in linear time."""
    free = 0
    while mark := _MARKER.search(text, free):
        start = max(free, max(text.rfind(c, free, mark.start()) for c in " \t\n\r") + 1)
        stop = _SPACE.search(text, mark.end())
        free = stop.start() if stop else len(text)
        yield start, free


def _candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Identifier-like words clear of the spans ``taken`` (in order), without outer marks; such words without letters are joined over single blanks."""
    out: list[tuple[int, int]] = []
    bare, end, k, reach = False, -1, 0, 0
    for a, b in _identifier_like(text):
        while k < len(taken) and taken[k][0] < b:
            reach, k = max(reach, taken[k][1]), k + 1
        if reach > a:
            continue
        plain = not _LETTER.search(text, a, b)
        if plain and bare and a == end + 1 and text[end] == " ":
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        bare, end = plain, b
    spans = []
    for a, b in out:
        while a < b and text[a] in _MARKS:
            a += 1
        while b > a and text[b - 1] in _MARKS:
            b -= 1
        if b - a >= SHORTEST:
            spans.append((a, b))
    return spans


def _clean(word: str) -> str:
    return word.lower().strip(_MARKS) or word


def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def _mix(kind: int, *hashes):
    """A pattern's hash from those of its words: Python integers or arrays of unsigned longs."""
    out = kind * 0x9E3779B97F4A7C15 & _BITS
    for h in hashes:
        if isinstance(h, np.ndarray):
            out = (np.uint64(out) ^ h) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
        else:
            out = (out ^ h) * 0xBF58476D1CE4E5B9 & _BITS
            out ^= out >> 29
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _contexts(text: str, a: int, b: int) -> list[int]:
    """The patterns of a token: 1 to ``WORDS`` words before it, after it, and on both sides."""
    hashes = lambda words: [_word_hash(_clean(w)) for w in words]
    left, right = hashes(text[max(0, a - REACH) : a].split()[-WORDS:]), hashes(text[b : b + REACH].split()[:WORDS])
    out = []
    for n in range(1, WORDS + 1):
        if len(left) >= n:
            out.append(_mix(LEFT + n - 1, *left[-n:]))
        if len(right) >= n:
            out.append(_mix(RIGHT + n - 1, *right[:n]))
        if len(left) >= n and len(right) >= n:
            out.append(_mix(BOTH + n - 1, *left[-n:], *right[:n]))
    return [_signed(p) for p in out]


def _all_contexts(texts: pa.Array) -> Iterator[np.ndarray]:
    """The patterns at all places of the texts where a word could stand for a token, kind by kind."""
    cut = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    words = cut.flatten().dictionary_encode()
    table = words.dictionary.to_pylist()
    doc = np.repeat(np.arange(len(cut)), np.diff(cut.offsets.to_numpy()))
    at = words.indices.to_numpy()
    held = np.array([w != "" for w in table], bool)[at] if table else np.zeros(0, bool)
    doc, h = doc[held], np.array([_word_hash(_clean(w)) for w in table], np.uint64)[at[held]]
    same = lambda n: doc[n:] == doc[: max(0, len(doc) - n)]
    with np.errstate(over="ignore"):
        yield _mix(LEFT, h[:-1][same(1)])
        yield _mix(RIGHT, h[1:][same(1)])
        k = same(2)
        yield _mix(LEFT + 1, h[:-2][k], h[1:-1][k])
        yield _mix(RIGHT + 1, h[1:-1][k], h[2:][k])
        yield _mix(BOTH, h[:-2][k], h[2:][k])
        k = same(4)
        yield _mix(BOTH + 1, h[:-4][k], h[1:-3][k], h[3:-1][k], h[4:][k])


def context_counts(docs: DataFrame, patterns: DataFrame, max_shared: int = 1_000_000, chunk: int = 1 << 23) -> DataFrame:
    """``pattern, places``: places of the corpus where the words of ``patterns(pattern)`` stand.

    Up to ``max_shared`` patterns (8 bytes each) are broadcast and others not counted; more are counted all and joined by shuffle.
    """
    shared = None
    if patterns.count() <= max_shared:
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(patterns.toPandas()["pattern"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in portions(batch, chunk):
                for found in _all_contexts(texts):
                    found = found.view(np.int64)
                    if shared is not None:
                        at = np.searchsorted(shared.value, found)
                        found = found[shared.value[np.minimum(at, len(shared.value) - 1)] == found] if len(shared.value) else found[:0]
                    which, n = np.unique(found, return_counts=True)
                    yield pa.record_batch([pa.array(which, pa.int64()), pa.array(n.astype(np.int64), pa.int64())], names=["pattern", "n"])

    counts = docs.select(F.lit(0).alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern long, n long")
    counts = counts.groupBy("pattern").agg(F.sum("n").alias("places"))
    return counts if shared is not None else counts.join(patterns.select("pattern"), "pattern", "left_semi")


SCANNED = ("row_id long, doc_id long, text_hash long, base array<struct<kind:int,start:int,stop:int>>, "
           "tokens array<struct<start:int,stop:int,patterns:array<long>,shape:long,instance:long,seed:boolean,strong:boolean>>")


def _hash(part: str) -> int:
    return _signed(_word_hash(part))


def scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> one row a document with its base spans and identifier-like tokens in context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for doc_id, text_hash, text in zip(batch["doc_id"], batch["text_hash"], batch["text"]):
                text = text if isinstance(text, str) else ""
                found = base_spans(text)
                base = [(k, a, b) for k, kind in enumerate(KINDS) for a, b in found[kind]]
                taken = sorted((a, b) for _, a, b in base)
                spots = [(a, b, True) for a, b in taken]
                spots += [(a, b, False) for a, b in _candidates(text, taken)]
                tokens = [(a, b, _contexts(text, a, b), _hash("shape " + _shape(text[a:b])), _hash(text[a:b]), seed, not seed and secret_like(text[a:b])) for a, b, seed in spots]
                out.append((row, doc_id, text_hash, base, tokens))
                row += 1
            frame = pd.DataFrame(out, columns=["row_id", "doc_id", "text_hash", "base", "tokens"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInPandas(run, SCANNED)


def discovered(scanned: DataFrame, docs: DataFrame, confidence: float = 0.6, support: int = 2, turns: int = 3, specific: float = 0.5) -> DataFrame:
    """``instance``: candidates found by bootstrapping over the whole corpus's pattern-instance graph (repeats of an edge count once)."""
    tokens = scanned.select(F.explode("tokens").alias("t")).select("t.*")
    sides = F.concat(F.transform("patterns", lambda p: F.struct(p.alias("pattern"), F.lit(False).alias("of_shape"))),
                     F.array(F.struct(F.col("shape").alias("pattern"), F.lit(True).alias("of_shape"))))
    edges = tokens.select(F.explode(sides).alias("e"), "instance", "seed", "strong").select("e.*", "instance", "seed", "strong")
    prior = F.max(F.when(F.col("seed"), 1.0).when(F.col("strong"), PRIOR).otherwise(0.0)).alias("prior")
    edges = materialize(edges.groupBy("pattern", "of_shape", "instance").agg(F.max("seed").alias("seed"), prior, F.count("*").alias("n")), "edges")
    # a pattern needs several instances, some of them open and some with a chance to be known, at most of its places
    lexical = edges.where("not of_shape").groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("held"), F.min("seed").alias("closed"))
    lexical = materialize(lexical.where((F.col("instances") >= support) & ~F.col("closed")), "lexical")
    places = context_counts(docs, lexical)
    good = materialize(lexical.join(places, "pattern", "left").where(F.col("held") >= specific * F.coalesce("places", "held")).select("pattern"), "specific")
    edges = materialize(edges.where("not of_shape").join(good, "pattern").unionByName(edges.where("of_shape")), "edges")
    # a seed's text is known wherever it stands, also where no fixed pattern matches
    seeds = edges.where("seed").select("instance").distinct()
    open_ = edges.where("not seed")
    known = materialize(open_.select("instance").distinct().join(seeds, "instance"), "known")
    for _ in range(turns):
        weight = F.when(F.col("known").isNotNull(), 1.0).otherwise(F.col("prior"))
        judged = edges.join(known.withColumn("known", F.lit(1)), "instance", "left").select("pattern", "of_shape", weight.alias("weight"))
        judged = judged.groupBy("pattern", "of_shape").agg((F.sum("weight") / (F.count("*") + 1)).alias("belief"), F.count_if(F.col("weight") > 0).alias("held"))
        sure = F.when(F.col("of_shape"), F.col("belief") > 0).otherwise((F.col("belief") >= confidence) & (F.col("held") >= support))
        patterns = materialize(judged.where(sure).select("pattern", "belief"), "patterns")
        words = 1 - F.exp(F.sum(F.when(~F.col("of_shape"), F.log(F.greatest(1 - F.col("belief"), F.lit(1e-9)))).otherwise(0.0)))
        looks = F.coalesce(F.max(F.when(F.col("of_shape"), F.col("belief"))), F.lit(0.0))
        scores = open_.join(patterns, "pattern").groupBy("instance").agg((words * (1 - SHAPE + SHAPE * looks)).alias("score"))
        known = materialize(scores.where(F.col("score") >= confidence).select("instance").unionByName(known).distinct(), "known")
    return known


def find(docs: DataFrame, confidence: float = 0.6, support: int = 2, turns: int = 3, specific: float = 0.5) -> DataFrame:
    """``docs(doc_id, text)`` -> ``row_id, doc_id, base, more``: fixed spans and discovered spans, one row a document.

    Null and empty texts hold nothing; repeated rows give a result each; an empty table gives an empty one.
    """
    scanned = materialize(scan(docs), "scanned")
    good = discovered(scanned, docs, confidence, support, turns, specific)
    found = scanned.select("row_id", F.explode("tokens").alias("t")).where("not t.seed").select("row_id", "t.start", "t.stop", "t.instance")
    more = found.join(good, "instance").groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("more"))
    return scanned.drop("tokens").join(more, "row_id", "left")


def report(found: DataFrame) -> DataFrame:
    """The digest of ``find``: counts of base spans by kind, hash of the base spans, all spans in order, and counts of discovered and of all spans."""
    text = "concat_ws(':', element_at(array('email','ip','card','phone'), x.kind + 1), x.start, x.stop)"
    base = F.expr(f"transform(base, x -> {text})")
    more = F.expr("transform(coalesce(more, array()), x -> concat_ws(':', 'other', x.start, x.stop))")
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"),
                        F.size(more).cast("long").alias("n_other"), (F.size(base) + F.size(more)).cast("long").alias("n_found"))


_TAGS = tuple(f"<{k.upper()}>" for k in KINDS) + ("<OTHER>",)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Replace (start, stop, kind) spans by tags; where spans overlap, the earliest and then longest counts and covers the rest."""
    out, at = [], 0
    for start, stop, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], _TAGS[kind]]
            at = stop
        elif stop > at:
            at = stop
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, confidence: float = 0.6, support: int = 2, turns: int = 3, specific: float = 0.5) -> DataFrame:
    """``docs`` with every span of its ``text`` replaced by the tag of its kind; all other columns stay, ``n_chars`` is counted anew if there.

    Discovered spans come back by doc_id and the hash of the text (rows equal in both have equal spans); the fixed ones are found
    again where the text is. Null texts stay null, rows without a doc_id are worked on like any other.
    """
    key, digest, extra = (unused(docs.columns, n) for n in ("_id", "_hash", "_more"))
    found = find(docs, confidence, support, turns, specific).where("more is not null")
    more = found.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(digest)).agg(F.first("more").alias(extra))

    @F.pandas_udf("string")
    def redacted(texts: pd.Series, extra: pd.Series) -> pd.Series:
        out = []
        for text, others in zip(texts, extra):
            if isinstance(text, str):
                found = base_spans(text)
                spans = [(a, b, k) for k, kind in enumerate(KINDS) for a, b in found[kind]]
                spans += [(s["start"], s["stop"], len(KINDS)) for s in (others if others is not None else ())]
                text = redact_text(text, spans) if spans else text
            out.append(text)
        return pd.Series(out, dtype=object)

    joined = docs.join(more, docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(digest)), "left")
    new = joined.withColumn("text", redacted(F.col("text").cast("string"), extra))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return new.select(docs.columns)
