"""The training-data operators against brute force, on small tables with odd rows."""

import hashlib
import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tickframe.llm import bpe, chat, langid, linededup, mixing, neardup, pii, quality, search, toxicity
from tickframe.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, drop_keys string, key string, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", "y", "z") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(30, 120))) for _ in range(30)]
    out = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(base)]
    for i in range(20):
        edited = base[i % 6].split()
        edited[rng.randrange(len(edited))] = "changed"
        out.append((100 + i, " ".join(edited), "en", "s0"))
    line = "This very common line stands in many documents."
    out += [(200 + i, f"{line}\n{base[i % 3]}\n  {line.upper()} \nown line number {i}", "de", None) for i in range(8)]
    out += [(300, None, None, None), (301, "", "en", "s1"), (302, " \n\t ", "fr", "s9"), (303, "one two", None, "s2"), (304, "one two", "en", "s2"), (305, " ".join(rng.choices(words, k=5000)), "en", "s3"), (306, "Éé ñ 日本\n" * 3, "es", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def duck(rows):
    import pandas as pd

    c = duckdb.connect()
    c.register("d", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    c.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source FROM d")
    return c


def same(df, sql, rows):
    got = df.toPandas()
    want = duck(rows).execute(sql).fetchdf()
    key = lambda x: Counter(tuple(None if v != v else v for v in r) for r in x[list(want.columns)].astype(object).itertuples(index=False))
    assert key(got) == key(want)


def test_line_dedup(docs, rows):
    same(linededup.dedup_lines(docs), linededup.SQL, rows)
    # However the rows are dealt: repeats within a slice, across tasks, or both.
    for parts in (1, 7):
        same(linededup.dedup_lines(docs.repartition(parts, "doc_id")), linededup.SQL, rows)
    kept = linededup.drop_repeated_lines(docs)
    assert kept.schema == docs.schema and kept.count() == len(rows)


def test_line_filter_holds_every_repeated_hash():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    parts = [np.concatenate([hashes[:5000], hashes[5000 + 3000 * k : 8000 + 3000 * k]]) for k in range(3)]
    kinds = [np.where(np.isin(p, hashes[5000:5010]), linededup.AGAIN, linededup.ONCE) for p in parts]
    twice = linededup.twice_seen(list(zip(parts, kinds, strict=True)))
    assert twice.holds(hashes[:5010]).all()
    # Hashes that stand once pass by chance only.
    assert twice.holds(hashes[5010:14_000]).mean() < 0.02 and twice.holds(hashes[14_000:]).mean() < 0.02
    # A hash that stands twice within one part is found there, and no part at all gives an empty filter.
    assert linededup.twice_seen([(np.repeat(hashes[:9], 2), np.zeros(18, np.int8))]).holds(hashes[:9]).all()
    assert not linededup.twice_seen([]).holds(hashes[:9]).any()


def test_lines_of_rows_with_odd_ids(spark):
    """Rows without an id are one document, which comes last; rows that share an id lose the same lines, in any slices."""
    line, other, own = "a line of many rows", "another line there", "a line of no other row"
    rows = [(None, f"{line}\n{own} 1", None, None), (None, f"{line}\n{other}", None, None), (5, f"{line}\nx", None, None), (5, f"{line.upper()}\n{own} 2", None, None), (9, f" {line}\t\n{other}", None, None), (-(2**63), "short", None, None), (2**63 - 1, f"{line}", None, None)]
    for parts in (1, 3, 8):
        kept = sorted(((r["doc_id"] or 0, r["text"]) for r in linededup.drop_repeated_lines(frame(spark, rows).repartition(parts)).collect()), key=str)
        want = [(0, f"{own} 1"), (0, ""), (5, f"{line}\nx"), (5, f"{line.upper()}\n{own} 2"), (9, other), (-(2**63), "short"), (2**63 - 1, "")]
        assert kept == sorted(want, key=str)


def test_mixing(docs, rows):
    same(mixing.mix_sources(docs), mixing.SQL, rows)
    out = mixing.mix_sources(docs).toPandas()
    assert (out.taken <= 3 * out["size"]).all()
    for _, part in out.groupby("source", dropna=False):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 0.5
    assert mixing.repeat_by_mix(docs).schema == docs.schema


def test_near_duplicates(docs, rows):
    rules = neardup.NearDuplicates(words=4)
    same(neardup.near_duplicates(docs, rules), neardup.SQL, rows)
    # Blocks of two classes, and of few hashes, agree.
    for other in (neardup.NearDuplicates(words=4, block=2, broadcast_nodes=-1), neardup.NearDuplicates(words=4, block_hashes=300)):
        same(neardup.near_duplicates(docs, other), neardup.SQL, rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f", "en", "s"), (None, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s")]
    docs = frame(spark, rows)
    assert neardup.near_duplicates(docs).count() == 4
    assert neardup.keep_one_each(docs).count() == 3
    assert mixing.mix_sources(docs).count() == 4
    assert linededup.dedup_lines(docs).count() == 4
    assert quality.assess_quality(docs).count() == 4
    assert langid.identify_languages(docs).count() == 4


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for f in (linededup.dedup_lines, mixing.mix_sources, mixing.repeat_by_mix, neardup.near_duplicates, quality.assess_quality, quality.keep_quality, langid.identify_languages, pii.find_personal_data, search.search_every_fiftieth):
        assert f(none).count() == 0, f
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert chat.preference_digests(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
    assert bpe.code_texts(none, tokenizer_path()).count() == 0


def test_quality_base(docs, rows):
    out = quality.assess_quality(docs).toPandas().set_index("doc_id")
    for i, text, _, _ in rows:
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want = (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)
        assert tuple(out.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]]) == want, i
    assert not (out.kept & out.base_failed).any()


def test_quality_rejects_other_distributions(spark):
    rng = random.Random(1)
    common = "the of and to in is that it for was".split()
    plain = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    rows = [(i, plain(150), "en", "s") for i in range(60)] + [(100, plain(150).upper(), "en", "s"), (101, " ".join(f"{w}###" for w in plain(150).split()), "en", "s")]
    out = quality.assess_quality(frame(spark, rows)).toPandas().set_index("doc_id")
    assert out.loc[range(60), "kept"].all() and not out.loc[[100, 101], "kept"].any()


def test_quality_rejects_absence_of_common_words(spark):
    rng = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    references = quality.language_references(docs)
    odd = [(i, " ".join("".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(3, 9))) for _ in range(300)) + ".", None, None) for i in range(20)]
    out = quality.assess_quality(frame(spark, odd), references=references).toPandas()
    assert not out.base_failed.any() and not out.kept.any()
    kept = quality.assess_quality(docs, references=references).toPandas()
    assert kept[~kept.base_failed].kept.mean() > 0.85


def test_bpe_equals_library(spark, docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    odd = ["İstanbul ΣΑΣ", "it's we'll I'D", "a\x1cb", "<|startoftext|>Hello<|endoftext|>x", "日本語 123 ½", "😀👍🏽", "x\x85y\xa0z", "a" * 2000, None]
    mine = [*rows, *[(1000 + i, t, None, None) for i, t in enumerate(odd)]]
    out = bpe.code_texts(frame(spark, mine), tokenizer_path(), with_output=True).toPandas().set_index("doc_id")
    for i, text, _, _ in mine:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert list(out.loc[i, "ids"]) == ids
        assert out.loc[i, "ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out.loc[i, "decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_personal_data(spark):
    text = "mail a.b@c-d.example.com or x@y, 10.0.0.255 256.1.1.1 card 4111 1111 1111 1111 call +1 (555) 123-4567 é a@b.c@d.e"
    out = pii.find_personal_data(frame(spark, [(1, text, None, None), (2, None, None, None)])).toPandas().set_index("doc_id")
    spans = [(k, m.start(), m.end()) for k in pii.KINDS for m in pii.PATTERNS[k].finditer(text) if pii._holds(k, m[0])]
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0]))))
    assert out.loc[1, "spans"] == want and out.loc[2, "spans"] == ""
    assert out.loc[1, "base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert "4111" not in pii.sanitise(text, want) and "[card]" in pii.sanitise(text, want)


def test_disclosing_terms(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = [(i, f"{word()} {word()} {word()} Zorbax {word()} chief@corp.example {word()} {word()}", None, None) for i in range(12)]
    rows += [(50 + i, f"{word()} {word()} u{i}@mail.example {word()}", None, None) for i in range(40)]
    # One passage, copied: its terms say nothing.
    rows += [(200 + i, "Again here stands plonk beside only@copy.example every time", None, None) for i in range(12)]
    found = {(r["entity"], r["term"]) for r in pii.disclosing_terms(frame(spark, rows)).collect()}
    assert found == {("email:chief@corp.example", "zorbax"), ("email-group:corp.example", "zorbax")}
    assert pii.find_personal_data(frame(spark, rows)).where("terms > 0").count() == 12


def test_copies_take_no_term_away(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    own = [f"{word()} {word()} Zorbax {word()} chief@corp.example {word()} {word()}" for _ in range(12)]
    rows = list(enumerate([*own, *own[:1] * 100, *(f"{word()} {word()} u{i}@mail.example {word()}" for i in range(40))]))
    # Near copies of one passage, each with one word changed, are one context.
    passage = [word() for _ in range(20)]
    for i in range(30):
        edited = passage.copy()
        edited[i % 20] = word()
        rows.append((1000 + i, " ".join([*edited[:10], "only@copy.example", *edited[10:]])))
    found = {(r["entity"], r["term"]) for r in pii.disclosing_terms(frame(spark, [(i, t, None, None) for i, t in rows])).collect()}
    assert found == {("email:chief@corp.example", "zorbax"), ("email-group:corp.example", "zorbax")}


def test_search_is_exact(docs, rows):
    out = search.search_every_fiftieth(docs, search.Bm25(shard=16, docs_per_block=4, first_docs=12, first_tasks=2, widen=2)).toPandas()
    s = search.Bm25()
    terms = {i: search._terms((t or "").encode()) for i, t, _, _ in rows}
    n, average = len(rows), sum(v[2] for v in terms.values()) / len(rows)
    df = Counter(x for v in terms.values() for x in v[0].tolist())
    for q in (i for i, *_ in rows if i % 50 == 0):
        asked, scored = set(terms[q][0].tolist()), []
        for i, (t, c, size) in terms.items():
            norm = s.k1 * (1 - s.b + s.b * size / average)
            total = sum(np.rint(np.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * f * (s.k1 + 1) / (f + norm) / search.UNIT) * search.UNIT for x, f in zip(t.tolist(), c.tolist(), strict=True) if x in asked)
            if total > 0:
                scored.append((-total, i))
        assert out[out.query_id == q].sort_values("rank").doc_id.tolist() == [i for _, i in sorted(scored)[: s.k]]


def test_search_of_long_texts_in_shards_of_few_postings(spark):
    """Texts of 20,000 words beside short ones: shards that end by their postings give the same rows as whole ones."""
    rng = random.Random(21)
    pool = [f"w{i}" for i in range(30_000)]
    rows = [(i, " ".join(rng.choices(pool, k=20_000 if i % 25 == 3 else rng.randrange(3, 60))), None, None) for i in range(200)]
    docs = frame(spark, rows).coalesce(1)
    same_rows = [sorted(map(tuple, search.search_every_fiftieth(docs, settings).collect())) for settings in (search.Bm25(), search.Bm25(shard_postings=9000), search.Bm25(shard_postings=1))]
    assert same_rows[0] == same_rows[1] == same_rows[2] and len(same_rows[0]) >= 30


def test_search_reads_texts_once_and_groups_change_nothing(spark):
    """However many blocks of queries and rounds there are, a text is cut into terms once; alike documents in groups give the same rows."""
    from pyspark.sql.functions import udf

    rng, seen = random.Random(5), spark.sparkContext.accumulator(0)
    pools = [[f"{c}{i}" for i in range(400)] for c in "abc"]
    rows = [(i, " ".join(rng.choices(pools[i % 3], weights=[1 / (j + 1) for j in range(400)], k=rng.randrange(5, 80))), None, None) for i in range(600)]

    def mark(text: str) -> str:
        seen.add(1)
        return text

    plain = frame(spark, rows).coalesce(2)
    asked = plain.where("doc_id % 20 = 0").selectExpr("doc_id AS query_id", "text")
    marked = plain.withColumn("text", udf(mark).asNondeterministic()("text"))
    small = search.Bm25(block_terms=300, first_docs=40, widen=2, group_from=16, together=8, docs_per_block=4)
    got = sorted(map(tuple, search.search(marked, asked, small).collect()))
    assert seen.value == 600
    assert got == sorted(map(tuple, search.search(plain, asked).collect())) and len(got) == 300
    terms = [np.unique(rng.choices(range(50), k=90)) + 50 * (i % 2) for i in range(64)]
    assert [sorted(g.tolist()) for g in search.groups([(t, np.ones(len(t))) for t in terms], 100)] in ([[*range(0, 64, 2)], [*range(1, 64, 2)]], [[*range(1, 64, 2)], [*range(0, 64, 2)]])


def test_search_by_common_terms_only():
    rows = [(np.array([0, 1]), np.array([1.0 + i % 5, 0.5])) for i in range(60)]
    shard = search.Shard(rows, 3, search.Bm25(k=3, docs_per_block=4))
    found, scores = shard.top(np.array([0, 1, 2]))
    best = found[np.lexsort((found, -scores))[:3]]
    assert best.tolist() == [4, 9, 14] and scores.max() == 5.5


def test_search_passes_blocks_over_and_loses_nothing():
    rng = np.random.default_rng(2)
    share = 1 / np.arange(1, 301)
    rows = []
    for i in range(2000):
        terms = np.unique(rng.choice(300, 40, p=share / share.sum()) + 300 * (i % 3))
        rows.append((terms, np.rint(rng.gamma(1.0, np.log(2 + terms % 300)) / search.UNIT) * search.UNIT))
    shard = search.Shard(rows, 900, search.Bm25(k=5))
    dense = np.zeros((2000, 900))
    for i, (terms, impacts) in enumerate(rows):
        dense[i, terms] = impacts
    for q in range(0, 2000, 40):
        query = rows[q][0]
        exact = dense[:, query].sum(axis=1)
        for floor in (0.0, np.partition(exact, -5)[-5]):
            found, scores = shard.top(query, floor)
            want = np.lexsort((np.arange(2000), -exact))[:5]
            assert found[np.lexsort((found, -scores))[:5]].tolist() == want.tolist()
            assert (exact[found] == scores).all() and len(found) < 2000


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (2, 0, "user", None), (3, 0, None, ""), (4, 0, "user", "alone"), (None, 0, "user", "x"), (6, 0, "user", "a"), (7, 0, "user", "a"), (7, 1, "user", "b")]
    made = {r["pair_id"]: r for r in chat.format_preferences(chat.preference_pairs(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    assert set(made) == {0, 1, 3}
    first = made[0]
    assert first["n_prefix"] == 1 and first["prompt"] == "<|user|>\nhi<|end|>\n"
    mask = first["chosen_mask"][0]
    assert mask["learned"] and first["chosen"][mask["start"] : mask["stop"]] == "good"
    assert made[1]["n_prefix"] == 1 and made[1]["chosen"] == ""
    assert made[3]["n_prefix"] == 1 and not made[3]["rejected_mask"][0]["learned"]


def test_language_and_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = langid.identify_languages(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert out.score.between(0, 1).all()
    odd = langid.predict_languages(frame(spark, [(1, None, None, None), (2, "123 !", None, None)]), langid.fit_languages(docs)).toPandas()
    assert set(odd.lang_pred) == {"und"}
    tox = toxicity.score_toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = tox[tox.held_out]
    clean, bad = held[held.toxic == 0], held[held.toxic == 1]
    assert tox.score.between(0, 1).all() and len(tox) == labels.count()
    assert clean.predicted.mean() < 0.05 and bad.score.mean() > clean.score.mean()


def test_toxicity_tables_keep_ngrams_apart(spark):
    rng = np.random.default_rng(4)
    grams = np.unique(rng.integers(97, 110, (60_000, 5)) @ (1 << np.arange(32, -1, -8)))
    ratios = spark.createDataFrame([(5, int(g), 1.0, 1) for g in grams], "order int, gram long, ratio double, n long")
    settings = toxicity.KneserNey()
    tables = toxicity.score_tables(ratios, settings)
    # N-grams of other letters are unseen, whatever their hashes; each seen one gives its own ratio.
    assert toxicity.log_ratio(bytes(rng.integers(110, 123, 50_000).tolist()), tables, settings) == 0
    text = bytes(rng.integers(97, 110, 5_000).tolist())
    held, known = toxicity._codes(np.frombuffer(toxicity._prepare(text), np.uint8).astype(np.int64), 5), set(grams.tolist())
    assert toxicity.log_ratio(text, tables, settings) == pytest.approx(sum(int(c) in known for c in held) / (len(text) + 2), rel=1e-4)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
    assert docs.count() > 0


def test_stages_take_texts_by_small_parts(spark):
    """Python processes are used again, so what a stage holds there at once counts beside the next one's memory."""
    text = " ".join(f"word{i % 997} part{i % 89}" for i in range(4500))
    one = pa.RecordBatch.from_arrays([pa.array(range(120), pa.int64()), pa.array(map(str, range(120))), pa.array([text] * 120)], ["doc_id", "owner", "text"])
    assert 6 << 20 < one.nbytes < 8 << 20
    rules = neardup.NearDuplicates()
    for step in (neardup._sketches(rules), neardup._full_sets(rules), linededup._line_rows, quality._assess({}, quality.QualityRules())):
        assert len(list(step([one]))) >= 4
    some = frame(spark, [(1, text, "en", "a")])
    for stage in (quality.keep_quality, linededup.drop_repeated_lines, neardup.keep_one_each, lambda d: bpe.code_texts(d, tokenizer_path())):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(some)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20


def test_bpe_ids_are_kept_small(spark):
    with open(tokenizer_path(), encoding="utf-8") as file:
        definition = file.read()
    text = " ".join(f"w{i % 50}x" for i in range(1000))
    batch = pa.RecordBatch.from_arrays([pa.array([None, "", *[text] * 100])], ["text"])
    bpe._code_columns(batch, definition, ["ids"])
    tracemalloc.start()
    made = bpe._code_columns(batch, definition, ["ids"])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    bpe._coders.clear()
    assert made["ids"].type == pa.list_(pa.int32()) and [len(x) for x in made["ids"]] == made["n_tokens"].to_pylist() and made["ids"][0].as_py() == []
    assert "decoded" not in made and most < 16 * len(made["ids"].values)
    out = bpe.code_texts(frame(spark, [(1, "one two", "en", "a"), (2, None, "en", "a")]), tokenizer_path(), with_output=True, with_decoded=False)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert {r["doc_id"]: len(r["ids"]) == r["n_tokens"] for r in out.collect()} == {1: True, 2: True}
