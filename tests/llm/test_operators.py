"""Each operator against brute force, on documents with every awkward case."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import common, decontamination, fingerprints, jaccard_join, language_id, line_dedup, packing, secrets, substring_dedup, toxicity, url_filter
from quorumlake.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SYLLABLES = "ba be bi do du fa fe ga go ha he ka ki la lo ma mo na no pa po ra ro sa so ta to va vo".split()


def words(rng, n):
    return [rng.choice(SYLLABLES) + rng.choice(SYLLABLES) + rng.choice(["", "n", "s", "r"]) for _ in range(n)]


def corpus():
    """(doc_id, text): originals, exact and near copies, shared passages and lines, junk, nulls, repeats."""
    rng = random.Random(4)
    passage, line = " ".join(words(rng, 60)), "A common line, found in many documents."
    rows = []
    for i in range(30):
        body = words(rng, rng.choice([3, 12, 80, 200]))
        text = " ".join(body)
        if i % 3 == 0:
            text = f"{text} {passage} {' '.join(words(rng, 5))}"
        if i % 4 == 0:
            text = f"{line}\n{text}\n  {line.upper()}\t"
        rows.append((i, text))
    for i in range(30, 36):
        rows.append((i, rows[3][1]))
    base = words(rng, 150)
    for i in range(36, 42):
        near = list(base)
        near[i] = "changed"
        rows.append((i, " ".join(near)))
    rows += [(50, None), (51, ""), (52, "\n\n \t"), (53, "one"), (54, "one two three four"), (55, "a b c d e " * 12), (56, "ünï çødé ΑΣ 中文 '\u2019s <|endoftext|> x\x1cy\u00a0z")]
    rows += [(57, " ".join(words(rng, 6000))), (None, "a text without an id, of several plain words"), (60, rows[5][1]), (60, rows[5][1])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    more = [(d, t, "x", "y", 0, 1, 2.0, "z", b"q", False) for d, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n long, score double, row string, sid binary, copy boolean"
    return spark.createDataFrame(more, schema).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def bag(rows):
    return Counter(map(repr, rows))


# 1


def test_ids_equal_the_librarys(rows):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(VOCABULARY), packing.Encoder(VOCABULARY)
    for _, text in rows:
        assert np.frombuffer(own(text or ""), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_long_texts_are_cut_at_blanks(monkeypatch, rows):
    own = packing.Encoder(VOCABULARY)
    whole = own(rows[-4][1] or "")
    monkeypatch.setattr(packing, "CHUNK", 100)
    assert own(rows[-4][1] or "") == whole


@pytest.mark.parametrize("seed", range(3))
def test_plans_are_gapless_and_near_the_bound(seed):
    rng = random.Random(seed)
    histogram = Counter(min(512, max(1, int(rng.lognormvariate(4, 1)))) for _ in range(3000))
    made = packing.plan(histogram, 512, 200)
    ranks, used = Counter(), defaultdict(list)
    for p in made.placements:
        assert p.rank == ranks[p.length]
        ranks[p.length] += p.n
        for j in range(p.n):
            used[p.sequence + j // p.each].append((p.offset + j % p.each * p.length, p.length))
    assert ranks == histogram
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(used) == made.sequences <= 1.02 * sum(k * n for k, n in histogram.items()) / 512 + 2


@pytest.mark.parametrize("histogram", [{20: 900, 31: 400, 5: 77}, {1: 5000}, {30: 500, 171: 300, 257: 200}, {512: 3, 1: 1}, {}])
def test_short_pieces_are_priced_in_lots(histogram):
    made = packing.plan(histogram, 512, 200)
    ranks, used = Counter(), defaultdict(int)
    for p in made.placements:
        assert p.rank == ranks[p.length]
        ranks[p.length] += p.n
        for j in range(p.n):
            used[p.sequence + j // p.each] += p.length
    assert ranks == Counter(histogram)
    assert sorted(used) == list(range(made.sequences)) and all(n <= 512 for n in used.values())
    assert not histogram or made.lp_value > 0
    whole = sum(-(-n // (512 // k)) for k, n in histogram.items())  # each length in its own sequences
    assert made.sequences <= whole


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    out = packing.pack_documents(docs, VOCABULARY).collect()
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(doc, i, i * 4096, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for i in range(-(-len(ids) // 4096)) for part in [ids[i * 4096 : (i + 1) * 4096]]]
    assert bag(want) == bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096


def test_knapsack_prices_the_best_multiset():
    value, counts = packing.price(np.array([3.0, 5.0, 8.0]), np.array([2, 3, 5]), 11)
    assert value == pytest.approx(18.0) and int(counts @ np.array([2, 3, 5])) <= 11


# 2


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 8 == 0
        w = words(rng, 40) + (rng.sample(["vilex", "grubon", "snarfy", "mudlo"], 2) if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.toxicity(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    right = [(r.score >= 0.7) == (r.doc_id % 8 == 0) for r in held]
    assert sum(right) / len(right) > 0.95


@pytest.mark.parametrize("every", [2, 3])
def test_toxicity_where_toxic_texts_are_common(spark, every):
    """A third or half of all rows are toxic, and clean texts hold the words of toxic ones now and then."""
    rng = random.Random(13)
    toxic_words = ["vilex", "grubon", "snarfy", "mudlo"]
    rows = [(i, " ".join(words(rng, 40) + (rng.sample(toxic_words, 3) if i % every == 0 else rng.sample(toxic_words, 1) if rng.random() < 0.3 else []))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % every == 0)) for i, _ in rows], "doc_id long, toxic int"))
    got = toxicity.toxicity(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).where("held").collect()
    caught = [r.score >= 0.7 for r in got if r.doc_id % every == 0]
    spared = [r.score < 0.7 for r in got if r.doc_id % every]
    assert sum(caught) > 0.9 * len(caught) and sum(spared) > 0.9 * len(spared)


def test_labels_of_held_out_rows_are_not_learnt(spark):
    rows = [(i, "vilex grubon " + " ".join(words(random.Random(i), 10))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    only = [(i, 1) for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    model = toxicity.train(docs, spark.createDataFrame(only, "doc_id long, toxic int"))
    assert all(r.score == 0 for r in toxicity.toxicity(docs, model).collect())


def test_toxicity_of_awkward_rows(spark, docs, rows, none):
    marks = spark.createDataFrame([(None, 1), (0, None), (1, 0)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, toxicity.train(docs, marks)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(none, toxicity.train(none, marks)).collect() == []


# 3


def test_language_by_fused_evidence(spark):
    tongues = {"aa": "ba be bi bo bu".split(), "zz": "ka ke ki ko ku".split()}
    rng = random.Random(2)
    text = lambda lang, n=30: " ".join("".join(rng.choices(tongues[lang], k=3)) for _ in range(n))
    docs = [(i, text("aa" if i % 2 else "zz"), "aa" if i % 2 else "zz", f"s{i % 3}", 0) for i in range(80)]
    docs += [(100, None, "aa", "s0", 0), (101, "", None, None, 0), (102, "12 34 !!", "aa", "s1", 0), (None, text("aa"), None, "s1", 0)]
    pages = [(i, f"https://w.host{i % 2}.zz/p", f'<html lang="zz"><script>baba</script><p>{text("zz")}</p></html>') for i in range(20)]
    pages += [(20, None, None), (21, "no host", "<p></p>"), (22, "https://w.host1.zz/q", "<html><p>kak</p></html>")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {(r.kind, r.doc_id if r.kind == "document" else r.page_id): r for r in language_id.identify(d, p).collect()}
    assert len(out) == len(docs) + len(pages)
    for i, _, lang, *_ in docs[:80]:
        assert out["document", i].lang == lang and out["document", i].accepted
    assert [out["document", i].accepted for i in (100, 101, 102)] == [False] * 3
    assert out["document", None].lang == "aa"
    assert all(out["page", i].lang == "zz" for i in range(20)) and out["page", 22].lang == "zz"
    assert not out["page", 20].accepted and not out["page", 21].accepted


def test_language_posterior_row_by_row(spark):
    """Every row's language and confidence from the same scores in plain Python."""
    rng = random.Random(21)
    tongue = {"xx": "aeiou", "yy": "bcdfg", "zz": "hjklm"}
    some = lambda k, n=8: " ".join("".join(rng.choices(tongue[k], k=4)) for _ in range(n))
    docs = [(i, some(k := rng.choice("xx yy zz".split())), k, f"s{i % 3}") for i in range(60)] + [(90, "12 34", "xx", "s0"), (91, None, "xx", None), (92, some("xx"), None, None)]
    pages = [(i, f"http://h{i % 4}.d{i % 2}.{'org' if i % 3 else 'net'}/", f'<html lang="{rng.choice(["xx", "yy", "qq"])}"><p>{some(rng.choice(list(tongue)), 2)}</p>') for i in range(30)] + [(80, None, "<p>1</p>"), (81, "nothing", f"<b>{some('yy')}")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    model = language_id.TextModel.train(docs)
    keys = language_id._KEYS
    scored = language_id.score_texts(language_id.document_units(docs), model, keys, False).unionByName(language_id.score_texts(language_id.page_units(pages), model, keys, True))
    rows, names = scored.collect(), model.languages
    held = [r for r in rows if r.post]
    count = lambda some, own: np.sum([r.post for r in some if r is not own] or [np.zeros(3)], axis=0)
    marks = [*names, None]
    says = np.array([[sum(r.post[i] for r in held if r.declared is not None and (r.declared if r.declared in names else None) == d) + (5.0 if d == names[i] else 0.5) for i in range(3)] for d in marks])
    says = np.log(says / says.sum(0))
    want = {}
    for r in rows:
        if not r.post:
            want[r.kind, r.doc_id, r.page_id] = (None, 0.0)
            continue
        prior = np.full(3, 1 / 3)
        for same in (lambda x: True, lambda x: x.suffix == r.suffix, lambda x: (x.suffix, x.domain) == (r.suffix, r.domain), lambda x: (x.suffix, x.domain, x.host) == (r.suffix, r.domain, r.host)):
            near = [x for x in held if same(x) and x is not r]
            prior = (count(near, None) + 10 * prior) / (len(near) + 10)
        logs = np.array(r.logs) + np.log(prior) + (says[marks.index(r.declared if r.declared in names else None)] if r.declared is not None else 0)
        p = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        want[r.kind, r.doc_id, r.page_id] = (names[int(p.argmax())] if p.max() >= 0.5 else None, p.max())
    out = language_id.identify(docs, pages).collect()
    assert len(out) == len(want)
    for r in out:
        lang, sure = want[r.kind, r.doc_id, r.page_id]
        assert r.lang == lang and r.confidence == pytest.approx(sure, abs=1e-6)


def test_language_of_rows_that_were_held_out(spark):
    """A fifth of the labels is hidden; nine in ten of those texts get theirs back."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.where("doc_id % 5 = 0").collect()}
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    got = {r.doc_id: r.lang for r in language_id.identify(hidden).where("doc_id % 5 = 0 AND accepted").collect()}
    right = sum(true[k] == v for k, v in got.items())
    print(f"held-out accuracy {right}/{len(got)} of {len(true)}")
    assert len(got) >= 0.9 * len(true) and right >= 0.9 * len(got)


def test_languages_of_few_texts_are_kept(spark):
    """A language with one or two texts beside large ones, and tables where every language is small."""
    rng = random.Random(14)
    letters = {"aa": "abde", "bb": "klmo", "other": "uvwx", "zz": "prst"}
    text = lambda lang: " ".join("".join(rng.choices(letters[lang], k=4)) for _ in range(60))
    langs = ["aa"] * 60 + ["bb"] * 40 + ["other"] * 2 + ["zz"]
    for some in (langs, langs[-3:]):
        rows = [(i, text(lang), lang, "s0") for i, lang in enumerate(some)] + [(1000, text("other"), None, "s0")]
        out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
        assert [out[i].lang for i in range(len(some))] == some and out[1000].lang == "other" and len(out) == len(rows)


def test_more_than_two_hundred_languages(spark):
    docs = spark.createDataFrame([(i, f"{chr(0x4E00 + i) * 3} {chr(0x4E00 + i) * 4}", f"l{i:03}", "s0") for i in range(210)], "doc_id long, text string, lang string, source string")
    model = language_id.TextModel.train(docs)
    assert len(model.languages) == 210
    assert [int(np.argmax(model.score(chr(0x4E00 + i) * 3))) for i in range(210)] == list(range(210))


def test_language_without_rows_or_labels(none, docs, rows):
    assert language_id.identify(none).collect() == []
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(unlabelled) == len(rows) and not any(r.accepted for r in unlabelled)


def test_whole_text_counts_for_language(monkeypatch):
    text = "".join(random.Random(3).choices("abcdé ", k=5000))
    whole = language_id.trigram_counts(text)
    monkeypatch.setattr(language_id, "CHUNK", 64)
    assert (language_id.trigram_counts(text) == whole).all() and whole.sum() == 5000


# 4


def shingles(text):
    w = (text or "").split()
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    links, above = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                above[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[top(i)].append(doc)
    return [(doc, min((d for d in least[top(i)] if d is not None), default=None), len(least[top(i)]), links[i]) for i, (doc, _) in enumerate(rows)]


def test_jaccard_join_finds_all_links(docs, rows):
    out = jaccard_join.near_duplicates(docs).collect()
    assert bag((r.doc_id, r.class_id, r.class_size, r.n_links) for r in out) == bag(brute_links(rows))


@pytest.mark.parametrize("small,block", [(2, 2), (3, 4)])
def test_jaccard_join_in_small_blocks(monkeypatch, spark, small, block):
    """A group larger than buckets and blocks is split and still compared whole."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(6)
    base = words(rng, 80)
    rows = []
    for i in range(18):
        near = list(base)
        near[rng.randrange(80)] = f"w{i}"
        rows.append((i, " ".join(near)))
    rows += [(100 + i, " ".join(words(rng, 30))) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard_join.near_duplicates(frame).collect()
    assert bag((r.doc_id, r.class_id, r.class_size, r.n_links) for r in out) == bag(brute_links(rows))


def test_jaccard_join_without_rows(none):
    assert jaccard_join.near_duplicates(none).collect() == []


def test_recall_of_runs():
    assert jaccard_join.recall_of(0.8) > 0.9996


def test_rounds_repeat_until_the_target(monkeypatch, spark):
    """With one run a round, rounds go on until nothing new is linked, and no link is missing then."""
    monkeypatch.setattr(jaccard_join, "RUNS", 1)
    monkeypatch.setattr(jaccard_join, "TARGET", 1.0)
    rng, rows, rounds = random.Random(16), [], []
    for g in range(40):
        base = words(rng, 60)
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join([*base[:30], "changed", *base[31:]]))]
    found = jaccard_join.bucket_links
    monkeypatch.setattr(jaccard_join, "bucket_links", lambda distinct, k: rounds.append(k) or found(distinct, k))
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1.0).collect()
    assert len(rounds) > 2
    got, want = ({(r[0], r[1]) for r in x} for x in (((r.doc_id, r.class_id) for r in out), brute_links(rows)))
    assert len(got & want) >= 0.9 * len(want)


def test_links_across_several_hot_passages(monkeypatch, spark):
    """Texts put together from passages that many share: buckets stay large for several levels, and near copies are still found."""
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    rng = random.Random(17)
    passages = [words(rng, 40) for _ in range(6)]
    rows = []
    for i in range(60):
        body = [w for p in rng.sample(passages, 4) for w in p] + words(rng, 60)
        rows.append((i, " ".join(body)))
        if i % 3 == 0:
            body[rng.randrange(200)] = f"w{i}"
            rows.append((1000 + i, " ".join(body)))
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert bag((r.doc_id, r.class_id, r.class_size, r.n_links) for r in out) == bag(brute_links(rows))


def test_jaccard_join_of_null_and_repeated_ids(spark):
    """Near copies without ids, and different texts under one id, are each compared by their own text."""
    rng = random.Random(18)
    base, other = words(rng, 80), words(rng, 80)
    near = lambda w, i: " ".join([*w[:i], f"w{i}", *w[i + 1 :]])
    rows = [(None, near(base, i)) for i in range(5, 70, 5)] + [(3, " ".join(base)), (3, " ".join(other)), (3, near(other, 40)), (4, near(other, 7)), (None, None), (5, "")]
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert bag((r.doc_id, r.class_id, r.class_size, r.n_links) for r in out) == bag(brute_links(rows))


# 5


def brute_repeats(rows, window=20):
    seen, out = set(), {}
    order = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    for known, d, t in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out[d if known else None, t] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return [(d, *out[d, t or ""]) for d, t in rows]


def test_substring_dedup(docs, rows):
    out = substring_dedup.substring_dedup(docs).collect()
    assert bag((r.doc_id, r.n_words, r.n_removed, r.text) for r in out) == bag(brute_repeats(rows))
    assert sum(r.n_removed for r in out) > 500


def test_substring_dedup_of_hot_anchors(monkeypatch, docs, rows):
    monkeypatch.setattr(substring_dedup, "HOT", 1)
    out = substring_dedup.substring_dedup(docs).collect()
    assert bag((r.doc_id, r.n_words, r.n_removed, r.text) for r in out) == bag(brute_repeats(rows))


def test_substring_dedup_without_rows(none):
    assert substring_dedup.substring_dedup(none).collect() == []


@pytest.mark.parametrize("hot", [1, 2_000])
def test_substring_dedup_of_repeated_rows_alone(monkeypatch, spark, hot):
    """Equal rows are one document: none loses its text to the other. A doc_id's different texts are documents in order of their hashes."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(7)
    a, b, c = (" ".join(words(rng, 30)) for _ in range(3))
    rows = [(1, a), (1, a), (None, b), (None, b), (2, "three words only"), (4, f"{c} {a}"), (5, c), (5, f"x {c}"), (5, c)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = bag((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup.substring_dedup(frame).collect())
    want = [(1, 30, 0, a), (1, 30, 0, a), (None, 30, 0, b), (None, 30, 0, b), (2, 3, 0, "three words only"), (4, 60, 30, c)]
    want += [(5, 30, 30, ""), (5, 30, 30, ""), (5, 31, 30, "x")]
    assert got == bag(want)


def test_substring_dedup_of_very_long_texts(spark):
    rng = random.Random(8)
    body = words(rng, 120_000)
    rows = [(1, " ".join(body)), (2, " ".join([*words(rng, 30), *body[70_000:70_050], *words(rng, 30)])), (3, " ".join(body[100:50_000]))]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert bag((r.doc_id, r.n_words, r.n_removed, r.text) for r in out) == bag(brute_repeats(rows))


def test_heavy_anchors_are_salted(monkeypatch, docs, rows):
    monkeypatch.setattr(substring_dedup, "HEAVY", 3)
    monkeypatch.setattr(substring_dedup, "BLOCK", 50)
    out = substring_dedup.substring_dedup(docs).collect()
    assert bag((r.doc_id, r.n_words, r.n_removed, r.text) for r in out) == bag(brute_repeats(rows))


def test_backward_search_counts_and_finds_the_first():
    rng = np.random.default_rng(0)
    text = np.append(rng.integers(1, 4, 300), 0)
    index = substring_dedup.FMIndex(text)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        end = int(rng.integers(n, 300))
        length, low, high = index.matching(text, np.array([end]), n)
        places = [i for i in range(301 - n) if (text[i : i + n] == text[end - n : end]).all()]
        assert length[0] == n and high[0] - low[0] == len(places) and index.earliest(low, high)[0] == places[0]
        assert sorted(index.positions(np.arange(low[0], high[0]))) == places


def test_matching_statistics():
    rng = np.random.default_rng(1)
    text, stream = np.append(rng.integers(1, 5, 200), 0), rng.integers(1, 5, 300)
    length, _, _ = substring_dedup.FMIndex(text).matching(stream, np.arange(1, 301), 9)
    held = {tuple(text[i : i + n]) for n in range(1, 10) for i in range(200 - n + 1)}
    assert [int(x) for x in length] == [max((n for n in range(1, min(9, e) + 1) if tuple(stream[e - n : e]) in held), default=0) for e in range(1, 301)]


def test_equal_windows_are_searched_once(monkeypatch):
    text = np.append(np.tile(np.random.default_rng(2).permutation(60) + 1, 50), 0)
    index, asked, extend = substring_dedup.FMIndex(text), [], substring_dedup.FMIndex.extend
    monkeypatch.setattr(substring_dedup.FMIndex, "extend", lambda self, c, low, high: asked.append(len(c)) or extend(self, c, low, high))
    length, low, high = index.matching(text, np.arange(20, 3_001), 20, 2)
    assert (length == 20).all() and set((high - low).tolist()) == {49, 50}
    assert sum(asked) <= 19 * 60


def test_windows_with_a_single_word_are_not_searched(monkeypatch):
    asked, matching = [], substring_dedup.FMIndex.matching
    monkeypatch.setattr(substring_dedup.FMIndex, "matching", lambda self, text, ends, *more: asked.append(len(ends)) or matching(self, text, ends, *more))
    rng = np.random.default_rng(3)
    body, other = rng.permutation(30).astype(np.uint64), rng.permutation(30).astype(np.uint64)
    segments = [np.append(body, np.uint64(100)), np.concatenate([other, body, np.arange(200, 240, dtype=np.uint64)]), np.append(body[3:], other[:9])]
    seen, want = set(), []
    for k, w in enumerate(segments):
        for i in range(len(w) - 19):
            want += [(k, i)] if tuple(w[i : i + 20]) in seen else []
            seen.add(tuple(w[i : i + 20]))
    of, first, n = substring_dedup.repeated_windows([(w.tobytes(), len(w) - 19) for w in segments])
    assert [(k, a + j) for k, a, m in zip(of, first, n, strict=True) for j in range(m)] == want and len(want) == 19
    assert asked == [11 + 41 + 17]  # of 12, 81 and 17


def test_suffixes_are_in_order():
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, k, n) for k in (2, 3, 50, 1 << 40) for n in (1, 2, 7, 300)] + [np.tile([3, 1, 2], 50)]
    for text in (np.append(t, 0) for t in texts):
        assert substring_dedup.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_word_hashes_part_words_as_split_does():
    rng = random.Random(6)
    texts = [b"", b" \t\n\x0b\x0c\r", b"a\0 a \0a \0\0 \0", "\u00a0x \u0085 \x1c\x1f \u2028é".encode()]
    texts += [b" ".join(bytes(rng.choice(b"ab\0") for _ in range(rng.choice((1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 72, 200)))) for _ in range(300)) for _ in range(5)]
    texts += [b"x" * n + b"y " + b"x" * n + b"y" for n in range(80)]
    h, n = substring_dedup.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert n.tolist() == [len(t.split()) for t in texts] and len(h) == len(words)
    assert len(set(words)) == len(set(h.tolist())) == len(set(zip(words, h.tolist(), strict=True)))
    assert [len(x) for x in substring_dedup.word_hashes([])] == [0, 0]


# 6


def brute_lines(rows):
    held = defaultdict(set)
    lines = lambda t: (t or "").split("\n")
    key = lambda s: "".join(c.lower() if c.isascii() else c for c in s.strip(" \t\n\x0b\x0c\r"))
    rank = lambda d: (d is not None, d or 0)
    for d, t in rows:
        for s in lines(t):
            held[key(s)].add(rank(d))
    out = []
    for d, t in rows:
        kept = [s for s in lines(t) if not (len(key(s)) >= 20 and len(held[key(s)]) >= 3 and max(held[key(s)]) != rank(d))]
        out.append((d, len(lines(t)), len(lines(t)) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("shard_keys,heavy", [(line_dedup.SHARD_KEYS, line_dedup.HEAVY), (2, 3), (1, 10**9)])
def test_line_dedup(monkeypatch, docs, rows, shard_keys, heavy):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    out = line_dedup.line_dedup(docs).collect()
    assert bag((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out) == bag(brute_lines(rows))
    assert sum(r.n_dropped for r in out) > 5


def test_line_dedup_is_reversible(spark, docs, rows):
    some = [r for r in rows if r[0] is not None and r[0] % 2 == 0]
    rest = [r for r in rows if not (r[0] is not None and r[0] % 2 == 0)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    grown = line_dedup.LineIndex.build(frame(rest)).insert(frame(some))
    assert bag(tuple(r) for r in grown.apply(frame(rows)).select("doc_id", "n_lines", "n_dropped", "text").collect()) == bag(brute_lines(rows))
    shrunk = grown.delete(frame(some))
    assert bag(tuple(r) for r in shrunk.apply(frame(rest)).select("doc_id", "n_lines", "n_dropped", "text").collect()) == bag(brute_lines(rest))


def test_deltas_touch_only_crossing_shards(monkeypatch, spark):
    """Filters hold exactly the keys at min_docs after insertions and deletions; an unknown line isn't in them."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    lines = [f"line number {i} of a long enough kind" for i in range(40)]
    rows = [(d, "\n".join(lines[d % 3 :: 3] if d < 6 else lines)) for d in range(8)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    index = line_dedup.LineIndex.build(frame(rows))
    before = {r.shard: bytes(r["filter"]) for r in index.filters.collect()}
    grown = index.insert(frame([(20, "\n".join([lines[0], *["a line that is quite new and long"] * 2])), (21, "a line that is quite new and long"), (22, "A line that is quite new and long ")]))
    after = {r.shard: bytes(r["filter"]) for r in grown.filters.collect()}
    assert len(before) > 4 and sum(before.get(k) != v for k, v in after.items()) == 1
    keys = {r.key_lo for r in grown.counts.where("n_docs >= 3").collect()}
    assert keys - {r.key_lo for r in index.counts.where("n_docs >= 3").collect()} == {line_dedup.key_hash("a line that is quite new and long")[1]}
    back = grown.delete(frame([(20, ""), (21, ""), (22, "")]))
    assert {r.shard: bytes(r["filter"]) for r in back.filters.collect() if np.frombuffer(r["filter"], np.uint16).any()} == before
    assert bag(back.counts.collect()) == bag(index.counts.collect())


def test_line_dedup_without_rows(none):
    assert line_dedup.line_dedup(none).collect() == []


def test_cuckoo_filter_holds_what_it_got():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 20_000)
    made = line_dedup.build_filter(keys)
    assert made.contains(keys).all()
    assert made.contains(rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.001
    made.delete(keys[:10_000])
    assert made.contains(keys[10_000:]).all() and made.contains(keys[:10_000]).mean() < 0.01
    assert line_dedup.CuckooFilter.load(made.dump()).contains(keys[10_000:]).all()


# 7


def word_list(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(rows, items):
    windows = {}
    for k, t in items:
        w = word_list(t)
        n = min(13, len(w))
        windows[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    out = []
    for d, t in rows:
        w = word_list(t)
        hit, met = set(), set()
        for k, some in windows.items():
            for p in some:
                for i in range(len(w) - len(p) + 1):
                    if tuple(w[i : i + len(p)]) == p:
                        hit.update(range(i, i + len(p)))
                        met.add(str(k))
        out.append((d, len(w), len(hit), sorted(met)))
    return out


@pytest.mark.parametrize("block", [decontamination.BLOCK_TERMS, 25])
def test_decontamination(spark, docs, rows, block):
    w = rows[0][1].split()
    items = [(1, " ".join(w[-40:])), (2, "one"), (3, None), (4, ""), (10, " ".join(w[-30:]).upper()), (11, "a b c d e a b c d e a b c d e a"), (12, "not met anywhere"), (13, "One-two, THREE")]
    bench = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, n long")
    out = decontamination.decontaminate(docs, bench, block_terms=block).collect()
    assert bag((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out) == bag(brute_hits(rows, items))


def test_decontamination_without_rows(spark, docs, rows, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontamination.decontaminate(docs, bench).collect()] == [0] * len(rows)
    assert decontamination.decontaminate(none, spark.createDataFrame([(1, "x y")], "item_id long, text string")).collect() == []


def test_proximity_matches_are_not_phrases(spark):
    w = [f"w{i}" for i in range(13)]
    apart = w[:6] + ["zz"] + w[6:]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(apart))], "doc_id long, text string")
    windows = decontamination.item_windows(spark.createDataFrame([(1, " ".join(w))], "item_id long, text string"))
    lookups = decontamination.rarest_terms(windows, decontamination.term_counts(docs, w)).withColumn("term", F.when(F.col("role") == 0, "w0").otherwise("w12")).withColumn("offset", F.when(F.col("role") == 0, 0).otherwise(12))
    found = decontamination.candidates(decontamination.postings(docs, ["w0", "w12"]), lookups, 4)
    assert [(r.doc_id, r.start) for r in decontamination.phrase_matches(found).collect()] == [(1, 0)]
    assert [(r.doc_id, r.gap) for r in decontamination.proximity_matches(found).collect()] == [(2, 1)]


@pytest.mark.parametrize("block", [decontamination.BLOCK_TERMS, 5])
def test_proximity_matches_beside_phrases(spark, block):
    """A passage with a word put in between is a proximity match of its item, and no phrase."""
    w = [f"w{i}" for i in range(13)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join([*w[:6], "zz", *w[6:]])), (3, "else"), (None, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in decontamination.decontaminate(docs, spark.createDataFrame([(7, " ".join(w))], "item_id long, text string"), block_terms=block, near=True).collect()}
    lists = decontamination.rarest_terms(decontamination.item_windows(spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")), decontamination.term_counts(docs, w)).collect()
    offsets = sorted(r.offset for r in lists)
    shift = [o + (o >= 6) - o for o in offsets]
    assert out[1].n_hit == 13 and out[1].near == [] and out[2].n_hit == 0 and out[3].near == [] and out[None].near == []
    assert [(x.item_id, x.gap) for x in out[2].near] == [("7", abs(shift[0] - shift[1]))]


def test_hot_terms_are_salted(monkeypatch, spark):
    monkeypatch.setattr(decontamination, "HEAVY", 2)
    rows = [(i, "the cat and the dog " * 30) for i in range(6)] + [(9, "no such thing"), (9, "the")]
    items = [(1, "the"), (2, "cat and the"), (3, "the dog " * 9)]
    out = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert bag((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out) == bag(brute_hits(rows, items))


# 8


def brute_rule(url):
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", None, None
    authority = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if c.isascii() else c for c in authority)
    path = re.match(r"[^?#]*", rest[len(authority) :])[0]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.shown), default=None)
    return host, path, best and best.shown, best and best.verdict


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://example.com/en/", "http://a.example.com/en/q", "http://xcom/", "http://x.net/es/1", "http://x.net/de/1", "ftp://É.net/fr/", "x://y://z/", "http://h?u/en/", "http://h#f", "http://b.org/p?a=1&b=2"]
    urls += [f"http://site{i}.{('com', 'net')[i % 2]}/{('en', 'es')[i % 2]}/{i}" for i in range(60)] + ["http://b.org/p?a=1&b=2"]
    pages = spark.createDataFrame([(i, u, None, 1.0) for i, u in enumerate(urls)], "page_id long, url string, html string, label double")
    out = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    assert len(out) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert out[i].verdict == verdict if rule else out[i].verdict in ("allow", "block")


def test_every_suffix_keeps_its_statistics(monkeypatch, spark):
    """Features against their definitions, for thousands of suffixes, heavy and rare."""
    rows = [(i, f"http://h{i}.s{i % 2500}/a/{i}?x=1&y=2") for i in range(3000)] + [(5000 + i, f"http://a{i}.net/es/{i}") for i in range(40)] + [(6000 + i, f"https://b{i}.com/{i}") for i in range(40)]
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string"))
    assert got.count() == len(rows) and {r.verdict for r in got.where("rule = 'net/es/'").collect()} == {"block"}
    urls = ["http://a1.b2.org/x/y-z?q=1&r=2#f", "https://é.com/", "", None]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    frame = url_filter.with_features(frame.withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))}))
    for r in frame.collect():
        u = r.url or ""
        n, counts = len(u), Counter(u)
        entropy = -sum(k / n * np.log2(k / n) for k in counts.values()) if n else 0.0
        want = [n, len(r.host), r.path.count("/"), r.host.count(".") + 1, sum(c in "0123456789" for c in u) / max(n, 1), entropy, u.count("&") + 1 if "?" in u else 0, sum(c in "-_%~." for c in u), float(u.startswith("https"))]
        assert [r[f] for f in url_filter.FEATURES[:9]] == pytest.approx(want)


def test_url_filter_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://b.org/"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in url_filter.url_filter(pages).collect()] == ["allow", "allow"]
    assert url_filter.url_filter(pages.where("page_id > 5")).collect() == []


# 9


def test_base_spans():
    text = 'x Password = "abc12345" tOkEn:short api_key=\'k-_.=+/123\' AKIA0123456789AB AKIA12 ' + "0a" * 16 + " " + "0a" * 15 + " passwd= \u017fecret:abcdefgh apikey:12345678"
    got = [(k, text[a:b]) for k, a, b, _ in secrets.base_spans(text)]
    assert got == [("assign", 'Password = "abc12345'), ("assign", "api_key='k-_.=+/123"), ("access", "AKIA0123456789AB"), ("hex", "0a" * 16), ("assign", "apikey:12345678")]


def test_learnt_formats_add_spans(spark):
    rng = random.Random(8)
    hex_ = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    rows = [(i, f"{' '.join(words(rng, 20))} token = \"{hex_(40)}\" mail{i}@mail{i}.example.com 10.20.30.{i} user{i}name.surname.long") for i in range(60)]
    rows += [(100, f"loose {hex_(24)} here"), (101, None), (None, ""), (102, "words only")]
    out = {r.doc_id: r.spans for r in secrets.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == len(rows)
    for i, text in rows[:60]:
        base = [(s.kind, s.start, s.end) for s in out[i] if s.kind != "format"]
        assert base == [s[:3] for s in secrets.base_spans(text)] and len(base) == 2
    assert [s.kind for s in out[100]] == ["format"] and out[101] == [] and out[102] == []


#: The contract's base rules as it writes them.
_NAMED = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def test_secret_scan_query_against_the_contract(spark):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = QUERIES["op9_secret_scan"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(text)
    for r in out:
        t = text[r.doc_id]
        base = [(m.start(), 0, m.end()) for m in _NAMED.finditer(t) if len(m[2]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        shown = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(base)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("format")] == shown
        assert [int(s.split(":")[1]) for s in every] == sorted(int(s.split(":")[1]) for s in every)


def test_many_secrets_in_one_text_take_linear_time():
    text = " ".join(f"token={'ab12' * 5} free{i}text/parts=of_it" for i in range(20_000))
    began = time.perf_counter()
    spans = secrets.base_spans(text)
    found = secrets.candidates(text, spans)
    assert len(spans) == 20_000 and len(found) > 20_000 and time.perf_counter() - began < 5
    assert not any(a < e and s < b for (a, b, _), (_, s, e, _) in zip(found[:50], spans[:50], strict=True))


def test_short_formats_and_values_behind_other_names(spark):
    """Values of a learnt format of 10 letters stand without their keyword, alone or behind an unlisted name."""
    rng = random.Random(15)
    some = lambda: "".join(rng.choices("abcdef", k=10))
    rows = [(i, f"{' '.join(words(rng, 20))} enlightenment everywhere token = '{some()}' mail{i}name 2024010{i % 10} www/paths/documents") for i in range(80)]
    loose = {100: "{}", 101: "session={} end", 102: "www/refs/{}"}
    value = {k: some() for k in loose}
    rows += [(k, t.format(value[k])) for k, t in loose.items()] + [(103, "everywhere enlightenment")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "format"] for r in secrets.secret_scan(frame).collect()}
    assert {k: got[k] for k in loose} == {k: [v] for k, v in value.items()}
    assert got[103] == [] and not any(got[i] for i in range(80))


def test_secret_scan_without_rows(none, docs, rows):
    assert secrets.secret_scan(none).collect() == []
    assert len(secrets.secret_scan(docs).collect()) == len(rows)


def test_merged_states_generalise():
    rng = random.Random(3)
    seen = ["".join(rng.choices("dh", k=20)) for _ in range(400)]
    made = secrets.Automaton.learn(seen)
    tree = secrets.Automaton.prefix_tree(seen)
    fresh = "".join(rng.choices("dh", k=20))
    assert made.log_likelihood(fresh) > tree.log_likelihood(fresh)
    assert made.log_likelihood(fresh) > made.log_likelihood("l" * 20) + 20


# 10


def test_fingerprints(docs, rows):
    out = fingerprints.fingerprint_edits(docs).collect()
    assert len(out) == len(rows)
    texts = defaultdict(list)
    for r in out:
        texts[r.text].append(tuple(r.fingerprint))
    assert all(len(set(v)) == 1 for v in texts.values())
    ids = sorted([(d is not None, d or 0, t or "") for d, t in rows], key=lambda r: r[:2])
    by = {(r.doc_id, r.edited_text): r for r in out}
    for (known, d, t), (_, _, after) in zip(ids, ids[1:] + ids[:1], strict=True):
        cut = len(t) // 2
        edited = t[: len(t) - cut] + after[:cut]
        r = by[d if known else None, edited]
        for other, got in ((edited, r.near_edited), (after, r.near_next)):
            a, b = (fp_shingles(x) for x in (t, other))
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(got - true) < 0.15


def fp_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(9)
    a, b = words(rng, 3000), words(rng, 2000)
    rows = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(a[:1500]))], "a string, b string, half string")
    for c in ("a", "b", "half"):
        rows = fingerprints.with_sketch(rows, c, f"s{c}")
    s = rows.select(fingerprints.distinct_shingles(F.col("sa")).alias("n"), fingerprints.containment(F.col("shalf"), F.col("sa")).alias("inside"), fingerprints.resemblance(F.col("shalf"), F.col("sa")).alias("j"), fingerprints.merged(F.col("sa"), F.col("sb")).alias("m"), "sa", "sb").first()
    assert abs(s.n / 2996 - 1) < 0.3 and s.inside > 0.8 and abs(s.j - 0.5) < 0.15
    parts = spark.createDataFrame([(1, s.sa), (1, s.sb)], "k int, fingerprint array<bigint>")
    assert fingerprints.merge_parts(parts, "k").first().fingerprint == list(s.m)


def test_fingerprints_without_rows_and_of_one(spark, none):
    assert fingerprints.fingerprint_edits(none).collect() == []
    (r,) = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0


def test_fingerprint_neighbours_over_many_buckets(monkeypatch, spark):
    monkeypatch.setattr(fingerprints, "BUCKET", 1)
    ids = sorted(random.Random(2).sample(range(10**9), 300))
    frame = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(frame).where("NOT copy").collect()}
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


@pytest.mark.parametrize("weighed", [True, False])
def test_keyed_join_broadcasts_heavy_keys_once(spark, weighed):
    """Rows of heavy, light and null keys meet as in a plain join, and both parts read one broadcast."""
    left = common.stored(spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id DIV 2 END AS k", "id AS v"), "left")
    right = common.stored(left.groupBy("k").agg(F.count("v").alias("n"), F.max("v").alias("most")), "right")
    own = {} if weighed else {"weighed": False}
    out = common.keyed_join(left, right, "k", "n", 20_000, **own)
    want = left.join(right, "k").select(out.columns)
    assert out.columns == ["k", "v", *["n"] * weighed, "most"]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("BroadcastExchange") == 2 and plan.split("Initial Plan")[0].count("ReusedExchange") == 1
    both = common.keyed_join(left.join(right.select("k", "n"), "k"), right, "k", "n", 20_000)  # left has the weights
    assert sorted(map(tuple, both.select("k", "v", "n", "most").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "v", "n", "most").collect()))
