"""Operators that SQL cannot express against plain brute force, long inputs, and hot groups."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from tickframe.llm import bpe, chat, langid, linededup, mixing, neardup, pii, quality, toxicity
from tickframe.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_id string, owner string, row string"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "a", "b", "c") for r in rows], SCHEMA)


# ---- long inputs


def test_bpe_of_very_long_words_is_nearly_linear():
    from tokenizers import Tokenizer

    with open(tokenizer_path(), encoding="utf-8") as file:
        coder = bpe.Coder(file.read())
    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    for n in (129, 300, 5_000, 40_000):
        for letters in ("abcdefghijklmnop", "ab", "a", "thequickéß日"):
            word = "".join(rng.choices(letters, k=n))
            assert coder.encode(word) == library.encode(word, add_special_tokens=False).ids, (n, letters)
    began = time.time()
    coder.code("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=500_000)))
    assert time.time() - began < 30


def test_personal_data_of_very_long_lines_is_nearly_linear():
    began = time.time()
    assert pii.base_spans("." + "1" * 1_000_000 + "." + "2" * 1000) == []
    assert pii.base_spans("x" * 500_000 + "@" + "y" * 500_000) == []
    many = " ".join(f"word{i} u{i}@mail.example.org" for i in range(10_000))
    spans = pii.base_spans(many)
    assert len(spans) == 10_000 and len(list(pii._beside(many, spans, 10))) == 10_000
    assert time.time() - began < 20


def test_base_spans_equal_the_patterns():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0

    def holds(kind, found):
        digits = re.sub("[^0-9]", "", found)
        return {"email": True, "ip": all(int(x) <= 255 for x in found.split(".")) if kind == "ip" else None, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]

    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choices("0123456789.+-() @ab\n%", k=rng.randint(5, 60)))
        want = sorted(((k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, text) if holds(k, m[0])), key=lambda s: (s[1], list(plain).index(s[0])))
        assert pii.base_spans(text) == want, text


# ---- near-duplicates


def test_hot_group_of_near_copies_gives_few_edges():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 200)
    sets = [np.unique(np.concatenate([base[rng.random(200) > 0.04], rng.integers(0, 1 << 60, 8)])) for _ in range(500)]
    group = {"node": np.arange(500), "component": np.arange(500), "guest": np.zeros(500, bool), "block": np.zeros(500, int), "low": np.zeros(500, int), "high": np.zeros(500, int), "shingles": sets}
    rules = neardup.NearDuplicates()
    edges = neardup.linked_components(group, rules)
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    want = list(range(500))
    for i in range(500):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                old, new = want[i], want[j]
                want = [new if w == old else w for w in want]
    assert len(edges) <= 499
    assert len({(find(i), want[i]) for i in range(500)}) == len(set(want)) == len({find(i) for i in range(500)})


def test_union_estimate():
    rng = np.random.default_rng(5)
    for _ in range(50):
        whole = rng.integers(0, 1 << 40, 150)
        a, b = (np.unique(whole[rng.random(150) > 0.2])[:64] for _ in range(2))
        union = np.union1d(a, b)[:64]
        want = len(np.intersect1d(np.intersect1d(union, a), b)) / len(union)
        assert neardup.union_estimate(a, [b], 64)[0] == pytest.approx(want)


# ---- preferences


def test_preferences_beyond_exact_doubles(spark):
    base = 1 << 60
    rows = [(base + i, 0, "user", f"q{i // 2}") for i in range(8)] + [(-4, 0, "user", "n"), (-3, 0, "user", "n"), (-3, 1, "assistant", "m")]
    made = chat.preference_pairs(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert sorted(r["pair_id"] for r in made) == [-2, *range(base // 2, base // 2 + 4)]


# ---- disclosure by brute force


def test_disclosing_terms_by_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    rows = []
    for i in range(150):
        name = f"m{i % 6}@d{i % 3}.example"
        near = [word() for _ in range(4)] + ([f"firm{i % 3}"] if rng.random() < 0.7 else []) + ([f"clerk{i % 6}"] if rng.random() < 0.5 else [])
        rng.shuffle(near)
        rows.append((i, f"{' '.join(near[:3])} {name} {' '.join(near[3:])}", None, None))
    rules = pii.Disclosure(threshold=0.6, least_contexts=4)
    # Sides are too short for a full half, so no contexts merge: each distinct pair of sides is one.
    seen = defaultdict(set)
    for _, text, _, _ in rows:
        left, name, right = re.match(r"(.*) (\S+@\S+) (.*)", text).groups()
        for entity in (f"email:{name}", f"email-group:{name.split('@')[1]}"):
            seen[entity].add((tuple(left.split()), tuple(right.split())))
    want = set()
    for level in (False, True):
        own = {e: c for e, c in seen.items() if ("-group:" in e) == level}
        total = sum(map(len, own.values()))
        terms = Counter(t for c in own.values() for left, right in c for t in {*left, *right})
        for e, c in own.items():
            both = Counter(t for left, right in c for t in {*left, *right})
            for t, n in both.items():
                if n >= 4 and len(c) < total and math.log(total * n / (len(c) * terms[t])) >= 0.6 * math.log(total / len(c)):
                    want.add((e, t))
    found = {(r["entity"], r["term"]) for r in pii.disclosing_terms(frame(spark, rows), rules).collect()}
    assert found == want and len(want) > 4
    # Every occurrence in a document that holds the entity is a span, near it or not; and no other document's.
    firm = next(t for e, t in sorted(want) if e.startswith("email-group") and t.startswith("firm"))
    entity = next(e for e, t in sorted(want) if t == firm and "group" in e).partition(":")[2]
    far = [*rows, (900, f"x@{entity}\n" + "some filler words here " * 8 + firm, None, None), (901, f"only {firm} here", None, None)]
    out = pii.find_personal_data(frame(spark, far), rules).toPandas().set_index("doc_id")
    joined = pii.find_personal_data(frame(spark, far), pii.Disclosure(threshold=0.6, least_contexts=4, hidden_bytes=-1)).toPandas().set_index("doc_id")
    assert out.loc[900, "terms"] == 1 and out.loc[901, "terms"] == 0
    assert (out.spans.sort_index() == joined.spans.sort_index()).all()


def test_contexts_merge_over_chains(spark):
    """With a reach of 3 a half is one word: contexts are linked by the words next to an entity, and by those after them."""
    rng = random.Random(12)
    sides = []
    for d in range(4):
        # A chain of 40 contexts that share every other nearest word to the left, or to the right; then loose words.
        sides += [(d, ["acme", f"p{d}x{i}", f"l{d}x{i // 2}"], [f"r{d}x{(i + 1) // 2}", f"q{d}x{i}", "acme"]) for i in range(40)]
        sides += [(d, ["firm", *(f"w{rng.randrange(60)}" for _ in range(2))], [*(f"w{rng.randrange(60)}" for _ in range(2)), f"firm{d}"]) for _ in range(25)]
    rows = [(i, f"{' '.join(left)} one@d{d}.example {' '.join(right)}", None, None) for i, (d, left, right) in enumerate(sides)]
    rng.shuffle(rows)
    groups = defaultdict(dict)
    for d, left, right in sides:
        own = groups[d]
        own[tuple(left), tuple(right)] = {("a", left[2]), ("b", left[1]), ("c", right[0]), ("d", right[1])}
    both, n_entity = Counter(), Counter()
    for d, own in groups.items():
        label = {c: k for k, c in enumerate(own)}
        while True:
            pairs = [(x, y) for x in own for y in own if own[x] & own[y] and label[x] < label[y]]
            if not pairs:
                break
            for x, y in pairs:
                label[y] = min(label[x], label[y])
        n_entity[d] = len(set(label.values()))
        for t in {w for left, right in own for w in (*left, *right)}:
            both[d, t] = len({label[c] for c in own if t in (*c[0], *c[1])})
    assert min(n_entity.values()) > 4 and all(both[d, "acme"] == 1 for d in range(4))
    total, terms = sum(n_entity.values()), Counter()
    for (_, t), n in both.items():
        terms[t] += n
    want = {(e, t) for (d, t), n in both.items() if n >= 3 and math.log(total * n / (n_entity[d] * terms[t])) >= 0.5 * math.log(total / n_entity[d]) for e in (f"email:one@d{d}.example", f"email-group:d{d}.example")}
    found = {(r["entity"], r["term"]) for r in pii.disclosing_terms(frame(spark, rows), pii.Disclosure(threshold=0.5, least_contexts=3, reach=3)).collect()}
    assert found == want and {t for _, t in want} >= {f"firm{d}" for d in range(4)}


# ---- languages


def test_languages_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    settings = langid.Centroids(dimension=512)
    model = langid.fit_languages(docs.where("doc_id % 2 = 0"), settings)
    out = langid.predict_languages(docs, model, settings).toPandas().set_index("doc_id")
    for doc_id, text in docs.select("doc_id", "text").limit(60).collect():
        if not text or not any(c.isalpha() for c in text):
            assert out.loc[doc_id, "lang_pred"] == "und"
            continue
        data = b" " + re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode()).strip() + b" "
        counts = [0] * 512
        for order in (1, 2, 3):
            for i in range(len(data) - order + 1):
                mixed = (int.from_bytes(data[i : i + order], "big") + order) * 2654435761 % 2**32
                counts[(mixed ^ mixed >> 15) % 512] += 1
        vector = [math.log1p(c) * w for c, w in zip(counts, model.idf, strict=True)]
        length = math.sqrt(sum(v * v for v in vector))
        cosines = [sum(v * c for v, c in zip(vector, centre, strict=True)) / length for centre in model.vectors.tolist()]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert out.loc[doc_id, "score"] == pytest.approx(min(max(cosines[best], 0), 1), abs=1e-5)
        assert out.loc[doc_id, "lang_pred"] == model.langs[best] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-6
        assert out.loc[doc_id, "rejected"] == (cosines[best] < model.least[best]) or abs(cosines[best] - model.least[best]) < 1e-5


def test_language_sample_is_of_all_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    settings = langid.Centroids(dimension=256, sample=40)
    model = langid.fit_languages(docs, settings)
    assert set(model.langs) == {r["lang"] for r in docs.where("lang IS NOT NULL AND text RLIKE '[a-z]'").select("lang").distinct().collect()}


# ---- Kneser-Ney


def test_kneser_ney_by_brute_force(spark):
    rng = random.Random(6)
    texts = [("".join(rng.choices("abc ", k=40)), int(i % 3 == 0)) for i in range(12)]
    settings = toxicity.KneserNey(order=3)
    labelled = spark.createDataFrame([(y, t) for t, y in texts], "toxic int, text string")
    tables = toxicity.score_tables(toxicity.log_ratios(toxicity.ngram_table(labelled, settings), settings), settings)
    prepare = lambda t: f" {' '.join(t.lower().split())} "
    top = [Counter(s[i : i + 3] for t, y in texts if y == c for s in [prepare(t)] for i in range(len(s) - 2)) for c in (0, 1)]
    # Each lower order counts the distinct n-grams of the next one that it ends.
    two = [Counter(g[1:] for g in grams) for grams in top]
    one = Counter(g[1:] for g in {*two[0], *two[1]})
    d = settings.discount

    def p(c, gram):
        if len(gram) == 1:
            return (one[gram] + d) / (sum(one.values()) + 256 * d) if gram in one else None
        counts = (two if len(gram) == 2 else top)[c]
        own = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        lower = p(c, gram[1:])
        if not own:
            return lower
        total = sum(own.values())
        return max(own.get(gram, 0) - d, 0) / total + d * len(own) / total * lower

    text = "abca bc cab aab ccc"
    s, want = prepare(text), 0.0
    for i in range(1, len(s)):
        gram = s[max(0, i - 2) : i + 1]
        want += math.log(p(1, gram) / p(0, gram))
    assert toxicity.log_ratio(text.encode(), tables, settings) == pytest.approx(want / len(s), abs=1e-5)


def test_toxicity_finds_held_out_texts(spark):
    rng = random.Random(9)
    plain = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(200)]
    bad = ["zuxxo", "qyvvik", "wozzak"]
    rows, labels = [], []
    for i in range(500):
        words = rng.choices(plain, k=rng.randint(20, 120))
        if toxic := i % 5 == 1:
            for w in bad:
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), None, None))
        labels.append((i, 0, int(toxic)))
    out = toxicity.score_toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    held = out[out.held_out].assign(toxic=lambda x: (x.doc_id % 5 == 1).astype(int))
    assert held[held.toxic == 1].predicted.mean() > 0.9 and held[held.toxic == 0].predicted.mean() < 0.05
    # Length alone moves no score: at the centre a text has the same one at any length, and without text, too.
    curve = toxicity.calibrate(np.array([0.1, 0.2, -0.1, -0.3]), np.array([10, 500, 20, 9000]), np.array([1.0, 1, 0, 0]))
    assert np.ptp(curve.score(np.full(3, curve.centre), np.array([3, 100, 30_000]))) == 0
    assert curve.score(np.zeros(2), np.array([0, 1])).max() <= 0.5 + 1e-9


# ---- quality verdict and the pipeline


def js(p, q):
    out = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a > 0 else 0) / 2 + (b * math.log2(b / m) if b > 0 else 0) / 2
    return math.sqrt(min(max(out, 0), 1))


def kind(c):
    if c in " \t\n\x0b\x0c\r":
        return 3
    if ord(c) > 127:
        return 6
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c in ".,;:?!'\"()-" else 5


def class_shares(text):
    counts = Counter(map(kind, text))
    return [counts[k] / max(sum(counts.values()), 1) for k in range(7)]


def lower(word):
    return "".join(c.lower() if c.isascii() else c for c in word)


def brute_quality(rows, rules=quality.QualityRules()):
    """doc_id of the rows that stay, by the definitions of the operator and no code of it."""
    texts = [(r[0], r[1] or "", r[2] or "") for r in rows]
    by_lang, refs = defaultdict(list), {}
    for _, text, lang in texts:
        if text:
            by_lang[lang].append(text)
    for lang, some in by_lang.items():
        words = Counter(lower(w) for t in some for w in WORDS.findall(t))
        total = sum(words.values())
        if total < rules.reference_words:
            continue
        long = [class_shares(t) for t in some if len(WORDS.findall(t)) >= rules.min_words]
        top = sorted(((-n, w.encode()) for w, n in words.items() if n >= rules.min_share * total))[: rules.top_words]
        refs[lang] = {"classes": [sum(x) / max(len(long), 1) for x in zip(*long, strict=True)], "words": [w.decode() for _, w in top], "shares": [-n / total for n, _ in top]}
        refs[lang]["shares"].append(1 - sum(refs[lang]["shares"]))

    def word_distance(text, ref):
        words = Counter(lower(w) for w in WORDS.findall(text))
        n = sum(words.values())
        shares = [words[w] / max(n, 1) for w in ref["words"]]
        return js([*shares, (n - sum(words[w] for w in ref["words"])) / max(n, 1)], ref["shares"])

    for lang, ref in refs.items():
        noise = lambda n: len(ref["words"]) / (8 * math.log(2)) / n  # noqa: B023, E731
        judged = sorted({(len(WORDS.findall(t)), word_distance(t, ref) ** 2) for i, t, x in texts if x == lang and len(WORDS.findall(t)) >= rules.word_words})
        ref["base"], ref["limit"] = 0.0, math.inf
        if len(judged) >= rules.scale_docs and ref["words"]:
            at = lambda v, q: sorted(v)[max(math.ceil(q * len(v)) - 1, 0)]
            ref["base"] = max(at([s - noise(n) for n, s in judged], 0.5), 0.0)
            ratios = [s / (ref["base"] + noise(n)) for n, s in judged]
            ref["limit"] = at(ratios, 0.5) + rules.word_spread * (at(ratios, 0.75) - at(ratios, 0.5)) / 0.6745
    kept = []
    for i, text, _ in texts:
        words = WORDS.findall(text)
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        if len(words) < 10 or 100 * len(covered) > 20 * len(words):
            continue
        best = min(((js(class_shares(text), r["classes"]) + word_distance(text, r), lang) for lang, r in sorted(refs.items())), default=(0, None))[1]
        if best is not None:
            ref = refs[best]
            limit = min(math.sqrt(ref["limit"] * max(ref["base"] + len(ref["words"]) / (8 * math.log(2)) / len(words), 1e-12)), rules.max_word_distance)
            if js(class_shares(text), ref["classes"]) > rules.max_class_distance and sum(map(len, words)) >= rules.class_chars:
                continue
            if word_distance(text, ref) > limit and len(words) >= rules.word_words:
                continue
        kept.append(i)
    return kept


@pytest.fixture(scope="module")
def given(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()]
    rng = random.Random(2)
    rows += [(10_000 + i, " ".join("".join(rng.choices("abcdefghijkl", k=rng.randint(3, 9))) for _ in range(200)) + ".", "en", "src1") for i in range(4)]
    return [*rows, (20_000, None, "en", None), (20_001, "", None, "src1"), (20_002, rows[3][1], "en", "src2")]


def test_quality_verdict_by_brute_force(spark, given):
    assert sorted(r["doc_id"] for r in quality.keep_quality(frame(spark, given)).select("doc_id").collect()) == sorted(brute_quality(given))


def duck(rows):
    c = duckdb.connect()
    c.register("d", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    c.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source FROM d")
    return c


def test_pipeline_by_brute_force(spark, given, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    frame(spark, given).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = set(brute_quality(given))
    rows = [r for r in given if r[0] in kept]
    # Line dedup: keys in two documents or more stay in the first one only.
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = defaultdict(set)
    for i, text, _, _ in rows:
        for line in text.split("\n"):
            holders[key(line)].add(i)
    gone = lambda i, line: len(key(line)) >= 10 and len(holders[key(line)]) > 1 and min(holders[key(line)]) != i
    rows = [(i, "\n".join(x for x in text.split("\n") if not gone(i, x)), lang, source) for i, text, lang, source in rows]
    # Near-duplicates: five-word shingles, all pairs, components by the smallest id.
    sets = {}
    for i, text, _, _ in rows:
        words = [lower(w) for w in WORDS.findall(text)]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    rows = [r for r in rows if root[r[0]] == r[0]]
    # Mixing by its SQL; each document as often as its words are taken, the one at the cut if half of them are.
    mixed = duck(rows).execute(mixing.SQL).fetchdf().set_index("doc_id")
    library = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, text, _, _ in rows:
        size, taken = int(mixed.loc[i, "size"]), int(mixed.loc[i, "taken"])
        ids = library.encode(text, add_special_tokens=False).ids
        digest = (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        want[digest] += math.floor(taken / size + 0.5) if size else 1
    assert Counter(got[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]].itertuples(index=False, name=None)) == +want


def test_stages_take_any_columns_and_odd_rows(spark):
    rows = [(None, "a null id with a line\nthat others have, too", None, None), (5, "a null id with a line\nown", None, "s"), (5, "a null id with a line\nown", None, "s"), (6, None, "en", "s"), (7, "", "en", "s")]
    docs = frame(spark, rows)
    assert neardup.keep_one_each(docs).columns == docs.columns
    assert neardup.keep_one_each(docs).count() == 4
    kept = {(r["doc_id"], r["text"]) for r in linededup.drop_repeated_lines(docs).collect()}
    assert kept == {(None, "that others have, too"), (5, "a null id with a line\nown"), (6, None), (7, "")}
    assert {r["doc_id"] for r in mixing.repeat_by_mix(docs).collect()} >= {6, 7}
    assert mixing.repeat_by_mix(docs.where("false")).count() == 0 and quality.keep_quality(docs.where("false")).count() == 0
    assert bpe.code_texts(docs, tokenizer_path()).count() == 5


def test_blocks_of_near_duplicates_send_a_large_component_to_the_others_only(spark):
    rules = neardup.NearDuplicates(block=50)
    # Key 1: one component of 950 nodes and 10 single nodes. Key 2: 120 single nodes. Key 3: few rows. Key 4: one component alone.
    rows = [(1, i, 7 if i < 950 else i, i % 5 == 0, 10) for i in range(960)] + [(2, i, i, False, 10) for i in range(120)]
    rows += [(3, i, i % 2, False, 10) for i in range(6)] + [(4, i, 1, False, 10) for i in range(9)]
    placed = spark.createDataFrame(rows, "key long, node long, component long, guest boolean, n int")
    groups = defaultdict(list)
    for r in neardup._blocks(placed, rules).collect():
        groups[r.key, r.low, r.high].append(r)
    met = Counter()
    for (key, low, high), own in groups.items():
        a, b = [r for r in own if r.block == low], [r for r in own if r.block == high]
        assert len(a) + len(b) <= 4 * (1 + (low == high)) * rules.block
        pairs = {(min(x.node, y.node), max(x.node, y.node)) for x in a for y in b if x.component != y.component}
        met.update((key, *p) for p in pairs)
    want = {(k, i, j) for k, i, c, *_ in rows for m, j, d, *_ in rows if k == m and i < j and c != d}
    assert set(met) == want and set(met.values()) == {1}
    # All blocks with all blocks would make 960 * 20 rows of key 1.
    assert sum(len(own) for (key, *_), own in groups.items() if key == 1) < 1500
