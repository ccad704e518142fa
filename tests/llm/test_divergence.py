"""Operator 13 against a plain count over all terms, in blocks of every size, and odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tickframe.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, item string, value long, n long, docs long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def expected(rows, least, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]

        def levels(own):
            total = sum(own[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (own[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = sum((c for (x, _), c in counts.items() if x == lang), Counter())
        p, q = levels(counts[lang, source]), levels(whole)
        pairs = sorted(((-sum(abs(p[t] - levels(counts[lang, s])[t]) for t in kept), s.encode(), s) for x, s in groups if x == lang and s != source))
        out += [(lang, source, "pair", s, -v, i + 1) for i, (v, _, s) in enumerate(pairs)]
        terms = sorted((q[t] - p[t], t.encode(), t) for t in kept if counts[lang, source][t] and p[t] > q[t])[:top]
        out += [(lang, source, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms)]
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    words = ["The", "the", "été", "ÉTÉ", "日本", "naïve", "a", "b", "it's", "x9y", "z\x00z", "ß", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = []
    for i in range(150):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", "ü", None])
        text = rng.choice([None, "", " ", " ".join(rng.choices(words, k=rng.randint(1, 40)))] if rng.random() < 0.2 else [" ".join(rng.choices(words[: 8 + len(source or "") * 6], k=rng.randint(1, 40)))])
        rows.append((i, text, lang, source, "x", 1, 2, 3))
    return [*rows, *rows[:10], (999, None, "xx", "only", "x", 1, 2, 3), (998, "rare words", "xx", "other", "x", 1, 2, 3)]


@pytest.mark.parametrize("settings", [{}, {"block_rows": 7, "least_blocks": 1, "most_cells": 3}, {"broadcast_groups": 0, "least_blocks": 3, "top_terms": 2}])
def test_distances_equal_a_plain_count(spark, settings):
    rows = made(len(settings))
    c = divergence.Divergence(min_docs=4, **settings)
    got = sorted(tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), c).collect())
    assert got == expected(rows, 4, c.top_terms)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[0] == "xx" and r[4] == 0 for r in got)


def test_no_rows_and_one_long_text(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "wort " * 200_000, "de", "a", "", 1, 1, 1), (2, "wort anders", "de", "b", "", 1, 1, 1)]
    got = sorted(tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, SCHEMA), divergence.Divergence(min_docs=1)).collect())
    assert got == expected(rows, 1, 50)
