"""Near-duplicates, repeated strings and passages, decontamination, the two classifiers and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from adfathom.llm import bwt, decontaminate, languages, near_dups, quality, repeats, shared, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def sentence(rng, words, pool=400, language="w"):
    return " ".join(f"{language}{rng.randrange(pool)}" for _ in range(words))


def corpus(seed, n=60):
    """Texts with copies, edited copies, shared passages, repeated words, and odd ones."""
    rng = random.Random(seed)
    passages = [sentence(rng, 60) for _ in range(3)]
    found = []
    for i in range(n):
        kind = rng.randrange(7)
        text = sentence(rng, rng.randrange(5, 160))
        if kind == 0 and found:
            text = rng.choice(found) or ""
        elif kind == 1 and found:
            words = (rng.choice(found) or "").split(" ")
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = "edit"
            text = " ".join(words)
        elif kind == 2:
            text = text + "\n" + rng.choice(passages) + "  " + sentence(rng, 20)
        elif kind == 3:
            text = "again and " * rng.randrange(3, 90)
        found.append(text)
    found += ["", None, "one", "One two  three", "é ñ 字 " * 30, " \n\t", "x" * 5000, "y" * 250 + "x" * 300]
    return [(i * 3, t) for i, t in enumerate(found)]


# --- near-duplicates ---------------------------------------------------------------------------------------


def expected_groups(rows, words, percent):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(low))
        grams = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
        sets.append(grams or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    smallest = {}
    for i in range(len(rows)):
        smallest[top(i)] = min(rows[i][0], smallest.get(top(i), rows[i][0]))
    return sorted((rows[i][0], len(sets[i]), smallest[top(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("words, tile", [(4, 256), (5, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, words, tile):
    monkeypatch.setattr(near_dups, "TILE", tile)
    rows = corpus(words) + [(0, corpus(words)[0][1])]
    docs = spark.createDataFrame(rows, DOCS).withColumn("node", F.lit("mine"))
    got = sorted(tuple(r) for r in near_dups.near_duplicates(docs, words).collect())
    assert got == expected_groups(rows, words, 80)
    kept = near_dups.keep_first(docs, words)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _, c in got if d == c})


def test_chains_of_near_copies_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "TILE", 4)
    rng = random.Random(9)
    words = sentence(rng, 120, 5000).split(" ")
    rows = []
    for i in range(40):  # each differs from the last by a word, the first and the last are far apart
        rows.append((i, " ".join(words)))
        words[(i * 13) % 120] = f"new{i}"
    got = sorted(tuple(r) for r in near_dups.near_duplicates(spark.createDataFrame(rows, DOCS), 4).collect())
    assert got == expected_groups(rows, 4, 80) and {r[2] for r in got} == {0}


def test_a_large_group_of_near_copies_and_strangers(spark, monkeypatch):
    """Copies at about the threshold, of which no hub meets all, in crowded buckets with documents of other groups."""
    monkeypatch.setattr(near_dups, "TILE", 8)
    rng = random.Random(21)
    base = sentence(rng, 200, 4000).split(" ")
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(200), 3 if i % 5 else 9):  # four shingles go with each word
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted(tuple(r) for r in near_dups.near_duplicates(docs, 4).collect())
    assert got == expected_groups(rows, 4, 80)


def test_a_doc_id_that_repeats_with_another_text_keeps_its_links(spark):
    rng = random.Random(22)
    one, two = sentence(rng, 80, 3000), sentence(rng, 80, 3000)
    rows = [(1, one), (1, two), (2, one + " z"), (3, two + " z"), (4, sentence(rng, 80, 3000))]
    got = sorted(tuple(r) for r in near_dups.near_duplicates(spark.createDataFrame(rows, DOCS), 4).collect())
    assert [(d, c) for d, _, c in got] == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_near_duplicates_without_rows_or_ids(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e f g"), (4, "a b c d e f g"), (5, "a b c d e f g"), (None, None)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (4, 4), (5, 4)]
    kept = near_dups.keep_first(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, -1, 4]


def test_least_matches_bounds_the_miss():
    for n in (32, 64, 128):
        least = near_dups.least_matches(n, 80)
        rng = np.random.default_rng(n)
        assert (rng.binomial(n, 0.8, 200_000) < least).mean() < 1e-4
        assert 0 < least < 0.8 * n


# --- repeated strings of bytes -----------------------------------------------------------------------------


def expected_bytes(rows, size):
    seen, out = set(), []
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if raw[i : i + size] in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(raw[i : i + size])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed, size, crowded", [(1, 100, 1024), (2, 40, 1)])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, seed, size, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    monkeypatch.setattr(repeats, "BLOCK", 3000)
    rows = [(d, t) for d, t in corpus(seed)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("start", F.lit(0))
    got = repeats.dedup_bytes(docs, size, keep_bytes=True).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == expected_bytes(rows, size)
    for row in got:
        assert sum(b - a for a, b in row.spans) == row.n_removed
        assert row.kept is None or hashlib.sha256(row.kept).hexdigest() == row.kept_sha256


def test_a_line_of_very_many_documents_is_split_and_stays_exact(spark, monkeypatch):
    """The pieces of one key are more than a block here, so their strings are grouped one by one."""
    monkeypatch.setattr(repeats, "CROWDED", 20)
    monkeypatch.setattr(repeats, "BLOCK", 2000)
    keep, heavy = shared.Scratch.keep, []

    def watched(self, frame, name):
        kept = keep(self, frame, name)
        heavy.extend(kept.collect() if name == "heavy" else [])
        return kept

    monkeypatch.setattr(shared.Scratch, "keep", watched)
    rng = random.Random(8)
    line = sentence(rng, 40)[:131]
    rows = [(i, sentence(rng, 30) + (f" {line} " if i % 3 else " ") + sentence(rng, 30)) for i in range(240)]
    got = repeats.dedup_bytes(spark.createDataFrame(rows, DOCS), 100).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == expected_bytes(rows, 100)
    assert sum(r.n_removed >= 131 for r in got) == 159
    assert heavy


def test_repeated_bytes_without_rows_or_ids(spark):
    assert repeats.dedup_bytes(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "z" * 400), (None, None), (1, "q" * 99)]
    assert [r.n_removed for r in repeats.dedup_bytes(spark.createDataFrame(rows, DOCS)).collect()] == [0, 0, 0]


def test_interval_expansion_finds_long_common_prefixes():
    rng = np.random.default_rng(3)
    for sigma, least in ((2, 5), (4, 3), (30, 2), (1, 8)):
        text = np.concatenate([rng.integers(2, 2 + sigma, 150), [1], rng.integers(2, 2 + sigma, 70), [1, 0]]).astype(np.int16)
        order = bwt.suffix_order(text, len(text))
        suffixes = [tuple(text[i:]) for i in range(len(text))]
        assert order.tolist() == sorted(range(len(text)), key=lambda i: suffixes[i])
        open_ = bwt.short_prefixes(text, order, least)
        for k in range(1, len(text)):
            a, b = suffixes[order[k - 1]], suffixes[order[k]]
            assert open_[k] == (len(a) >= least and a[:least] == b[:least])


# --- repeated passages of words ----------------------------------------------------------------------------


def expected_passages(rows, size):
    split = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for doc in sorted(split):
        for i in range(len(split[doc]) - size + 1):
            first.setdefault(tuple(split[doc][i : i + size]), doc)
    out = []
    for doc, words in split.items():
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            if first[tuple(words[i : i + size])] < doc:
                gone[i : i + size] = [True] * size
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed, size", [(3, 50), (4, 12)])
def test_passages_equal_brute_force(spark, seed, size):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, DOCS).withColumn("window", F.lit(0)).withColumn("_text", F.lit("mine"))
    got = substrings.dedup_report(docs, size).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected_passages(rows, size)
    left = {r.doc_id: r for r in substrings.dedup_texts(docs, size).collect()}
    assert len(left) == len(rows) and left[0]["_text"] == "mine"
    for row in got:
        text = left[row.doc_id].text
        if row.n_removed:
            assert hashlib.sha256(text.encode()).hexdigest() == row.kept_sha256
        else:
            assert text == dict(rows)[row.doc_id]


def test_passages_without_rows_ids_or_with_repeats(spark):
    assert substrings.dedup_report(spark.createDataFrame([], DOCS)).count() == 0
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(7, long), (7, long), (None, long), (9, long + " end")]
    got = substrings.dedup_report(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (7, 0), (7, 0), (9, 80)]


# --- decontamination ---------------------------------------------------------------------------------------


def test_decontamination_catches_passages_and_paraphrases(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.randrange(14, 50), 3000) + ".\n" + sentence(rng, 5, 3000)) for i in range(30)]
    items += [(30, None), (31, " . "), (3, items[3][1])]
    docs = [(i, sentence(rng, 300, 3000)) for i in range(150)] + [(900, None), (901, ""), (None, items[1][1])]
    planted = set()
    for k in range(40):
        doc, item = k * 3, k % 30
        words = items[item][1].split()
        if k % 4 == 0:  # a paraphrase: a quarter of the words replaced, the answer kept
            for j in rng.sample(range(len(words) - 5), len(words) // 4):
                words[j] = "other"
        body = docs[doc][1].split()
        at = rng.randrange(len(body))
        docs[doc] = (doc, " ".join(body[:at] + [w.upper() for w in words] + body[at:]))
        planted.add((doc, item))
    frame = spark.createDataFrame(docs + docs[:2], DOCS).withColumn("_lost", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted and len(got) == len(planted)
    kept = decontaminate.without_benchmark(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in planted}
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0


def test_decontamination_folds_accented_capitals(spark):
    rng = random.Random(8)
    letters = ["ñandú", "façade", "über", "straße", "éclair", "łódź", "жизнь", "οδός", "ırmak", "plain"]
    words = [rng.choice(letters) + chr(97 + i % 26) + rng.choice(letters) for i in range(60)]
    items = [(1, " ".join(words[:30])), (2, " ".join(words[30:]).upper())]
    docs = [(i, sentence(rng, 200)) for i in range(40)]
    docs += [(50, docs[0][1] + " " + items[0][1].upper()), (51, items[0][1]), (52, " ".join(words[30:]) + " " + docs[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), bench).collect()
    assert sorted((r.doc_id, r.item_id, round(r.share, 6)) for r in got) == [(50, 1, 1.0), (51, 1, 1.0), (52, 2, 1.0)]


def test_decontamination_finds_what_the_subsequence_rule_finds(spark):
    rng = random.Random(9)
    rare, common = [f"r{i}" for i in range(400)], [f"c{i}" for i in range(1500)]
    items = []
    for i in range(6):  # twelve rare words among many that stand in other documents too
        words = rng.sample(common, 88) + rare[i * 12 : i * 12 + 12]
        rng.shuffle(words)
        items.append((i, words))
    docs = [(i, " ".join(rng.choices(common, k=300))) for i in range(60)]
    for i, words in items:  # ten of the twelve rare words are replaced
        gone = rng.sample([w for w in words if w in rare], 10)
        docs.append((100 + i, " ".join("other" if w in gone else w for w in words)))
    short = [(10 + i, rng.sample(common, 6)) for i in range(4)]  # short items between words of the other items
    docs += [(200 + i, " ".join(rng.sample(common, 50) + words + rng.sample(common, 50))) for i, words in short]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items + short], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert {(100 + i, i) for i in range(6)} | {(200 + i, i) for i, _ in short} <= got

    # every pair of a passage and an item against the rule itself
    vocabulary = sorted({w for _, words in items + short for w in words})
    number = {w: n for n, w in enumerate(vocabulary)}
    coded = [np.array([number[w] for w in words], np.int64) for _, words in items + short]
    block = decontaminate.Items([i for i, _ in items + short], coded, [w[-2:] for w in coded])
    sequences = [np.array([number[w] for w in t.split() if w in number], np.int64) for _, t in docs]
    counts = np.bincount(np.concatenate([np.unique(s) for s in sequences]), minlength=len(vocabulary))
    block.weigh(counts, len(docs))
    at = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
    pairs = set(zip(*(x.tolist() for x in block.possible(at, np.concatenate(sequences), len(sequences)))))
    for p, sequence in enumerate(sequences):
        share = decontaminate.common_weight(coded, [sequence] * len(coded), block.rarity)
        answer = decontaminate.common_weight(block.answers, [sequence] * len(coded), block.rarity)
        found = (share >= decontaminate.ALONE) | ((share >= decontaminate.WITH_ANSWER) & (answer >= decontaminate.ANSWER))
        assert {(p, i) for i in np.flatnonzero(found).tolist()} <= pairs


def test_decontamination_candidates_come_from_the_latent_space(spark, monkeypatch):
    rng = random.Random(12)
    texts = [sentence(rng, rng.randrange(6, 60), 900) for _ in range(40)]
    coded = [np.unique(t.split(), return_inverse=True) for t in texts]
    vocabulary = np.unique(np.concatenate([words for words, _ in coded]))
    words = [np.searchsorted(vocabulary, kinds)[place] for kinds, place in coded]
    block = decontaminate.Items(list(range(40)), words, [w[-2:] if i % 2 else w[:0] for i, w in enumerate(words)])
    sequences = [rng.choices(range(len(vocabulary)), k=rng.randrange(1, 120)) for _ in range(200)]
    for k in range(60):  # parts of items, in and out of order
        part = words[k % 40].tolist()
        sequences.append(rng.sample(part, max(1, len(part) * rng.randrange(3, 11) // 10)) + sequences[k])
    counts = np.bincount(np.concatenate([np.unique(s) for s in sequences]), minlength=len(vocabulary))
    block.weigh(counts, len(sequences))
    at = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
    flat = np.concatenate(sequences)
    expected = set(zip(*(x.tolist() for x in block.possible(at, flat, len(sequences)))))
    whole = np.eye(len(vocabulary), dtype=np.float32)
    sizes = []
    for rank in (len(vocabulary), len(vocabulary) // 2):  # a space that leaves something out only costs candidates
        p, i, cosine = block.nearest(at, flat, len(sequences), whole[:, :rank])
        assert (np.diff(p) >= 0).all() and len(p) == len(cosine)
        assert expected <= set(zip(p.tolist(), i.tolist()))
        enough = block.enough(p, i, at, flat, len(sequences))
        assert set(zip(p[enough].tolist(), i[enough].tolist())) == expected
        sizes.append(len(p))
    assert len(expected) <= sizes[0] < 40 * len(sequences) // 10 and sizes[0] < sizes[1]

    bench = spark.createDataFrame(list(enumerate(texts[:5])), "item_id long, text string")
    docs = spark.createDataFrame([(i, texts[i] + " " + sentence(rng, 50, 900)) for i in range(10)], DOCS)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(i, i) for i in range(5)}
    weigh = decontaminate.Items.weigh

    def unreachable(items, *counted):
        weigh(items, *counted)
        items.least[:] = np.inf

    monkeypatch.setattr(decontaminate.Items, "weigh", unreachable)
    assert decontaminate.contaminated(docs, bench).count() == 0


def test_decontamination_fits_the_space_to_all_passages(spark, monkeypatch):
    rng = random.Random(13)
    known, odds = [f"k{i}" for i in range(60)], [0.9**i for i in range(60)]
    items = [(i, " ".join(known[i * 12 : i * 12 + 12])) for i in range(5)]
    docs = [(i, " ".join(rng.choices(known, odds, k=rng.randrange(6)) + ["other"])) for i in range(40_000)]
    docs[7] = (None, docs[7][1])
    docs += [docs[8]] * 50 + [(9, items[0][1])]
    real, seen = decontaminate._summed, []

    def summed(passages, shared, basis, both):
        seen.append((shared.value, basis, both, real(passages, shared, basis, both)))
        return seen[-1][-1]

    monkeypatch.setattr(decontaminate, "_summed", summed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), bench)
    assert (9, 0) in {(r.doc_id, r.item_id) for r in found.collect()} and [both for _, _, both, _ in seen] == [False, True]
    block = seen[0][0]
    hashed = decontaminate.plain_words(*next(iter(decontaminate.texts.text_slices(pa.array([" ".join(known)]))))[1:])[0]
    number = dict(zip(known, np.searchsorted(block.vocabulary, hashed).tolist()))
    times = np.zeros((len(docs), len(known)))
    for i, (_, text) in enumerate(docs):
        for w in text.split():
            if w in number:
                times[i, number[w]] += 1
    rarity = np.log((len(docs) + 1) / ((times > 0).sum(axis=0) + 0.5)).clip(0.01)
    vectors = np.where(times > 0, 1 + np.log(np.maximum(times, 1)), 0) * rarity
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    for _, basis, both, total in seen:
        expected = vectors.T @ vectors @ basis
        assert np.allclose(total, basis.T @ expected if both else expected, rtol=1e-4, atol=0.05)
    assert 0 < len(block.often) < len(known)


def test_decontamination_of_items_just_over_the_longest_part(spark):
    rng = random.Random(10)
    items = [(n, sentence(rng, n - 2, 3000, f"l{n}x") + " of the") for n in (128, 129, 130, 140, 257, 300)]
    docs = [(i, sentence(rng, 40, 3000) + " of the " + sentence(rng, 40, 3000)) for i in range(60)]
    docs += [(100 + n, docs[0][1] + " " + text + " " + docs[1][1]) for n, text in items]
    # the last words of an item are no item
    docs += [(1000 + n, docs[2][1] + " " + " ".join(text.split()[-12:])) for n, text in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(100 + n, n) for n, _ in items}
    cut = [len(w) for block in decontaminate.read_items(bench) for w in block.words]
    assert sum(cut) == sum(n for n, _ in items) and min(cut) >= decontaminate.ITEM_WORDS // 2


def test_weighted_common_subsequence():
    rarity = np.array([1.0, 2.0, 3.0, 4.0])
    found = decontaminate.common_weight([np.array([0, 1, 2, 3]), np.array([3, 3])], [np.array([2, 0, 1, 3]), np.array([0])], rarity)
    assert found.tolist() == [0.7, 0.0]


# --- classifiers -------------------------------------------------------------------------------------------

SYLLABLES = {"en": "the ing tion and er on th st".split(), "fr": "eau eux ment oi ai ré ou que".split(), "de": "sch ung ein keit über zu lich".split()}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def test_language_model_on_held_out_texts(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), rng.randrange(20, 60)), lang) for i in range(400)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 !? 34", "fr"), (1003, "a b", None)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    sample = languages.training_rows(docs)
    assert 200 < sample.num_rows < 300
    model = languages.fit(sample)
    found = {r.doc_id: r for r in languages.identify(docs.withColumn("score", F.lit("old")), model).collect()}
    assert sum(found[i].lang_pred == lang for i, _, lang in rows[:400]) >= 396
    assert all(found[i].accepted and 0 <= found[i].score <= 1 for i in range(400))
    for i in (1000, 1001, 1002):
        assert (found[i].lang_pred, found[i].score, found[i].accepted) == ("und", 0.0, False)
    none = languages.fit(languages.training_rows(docs.limit(0)))
    assert languages.identify(docs, none).where("accepted").count() == 0


def test_language_model_rejects_texts_of_no_learned_language(spark):
    rng = random.Random(16)
    rows = [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), rng.randrange(10, 30)), lang) for i in range(2400)]
    rows += [(2400 + i, "on", list(SYLLABLES)[i % 3]) for i in range(48)]  # may be any of the three
    model = languages.fit(languages.training_rows(spark.createDataFrame(rows, DOCS + ", lang string")))
    letters = ["жи зн ст ра ло ка".split(), "kszt owy prz czy dzi wła".split(), list("qxzvkjwy"), list("的一是不了人")]
    foreign = [
        (9000 + i, " ".join("".join(rng.choices(kind, k=rng.randrange(1, 4))) for _ in range(40)))
        for i in range(100)
        for kind in [letters[i % 4]]
    ]
    docs = spark.createDataFrame([r[:2] for r in rows[:2400]] + foreign, DOCS)
    found = {r.doc_id: r.accepted for r in languages.identify(docs, model).collect()}
    assert sum(found[i] for i in range(2400)) >= 2376
    assert sum(found[9000 + i] for i in range(100)) <= 2


def test_a_rare_language_is_in_the_sample_and_learned(spark):
    rng = random.Random(26)
    rows = [(i, prose(rng, lang := "fr" if i % 66 == 0 else ("en", "de")[i % 2], 40), lang) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    learned = docs.where("crc32(cast(doc_id AS string)) % 3 != 1")
    sample = languages.training_rows(docs, limit=400)
    names = sample["lang"].to_pylist()
    assert len(names) == 400
    assert names.count("fr") == learned.where("lang = 'fr'").count() > 400 * 31 / 2000
    found = languages.identify(docs, languages.fit(sample)).where("lang = 'fr'").collect()
    assert sum(r.lang_pred == "fr" for r in found) >= len(found) - 1
    assert len(set(languages.training_rows(docs, limit=2)["lang"].to_pylist())) == 2


def test_language_stage_keeps_columns_named_like_its_own(spark):
    rng = random.Random(27)
    rows = [(i, prose(rng, lang := ("en", "de")[i % 2], 40), lang) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string").withColumn("_Stage_score", F.lit(7)).withColumn("score", F.lit("s"))
    got = corpus_pipeline.language_id(spark, docs, "")
    assert got.dtypes == docs.dtypes
    assert {(r._Stage_score, r.score) for r in got.collect()} == {(7, "s")}


def test_quality_field_on_held_out_texts(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        lines = [prose(rng, "en", 15).capitalize() + "." for _ in range(rng.randrange(1, 8))]
        if not good:
            lines[rng.randrange(len(lines)) :] = ["BUY!! NOW!! " * 6, "win win win win $$$ %%%"]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    rows += [(900, None), (901, ""), (902, "\n\n")]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels + labels[:3] + [(None, 1), (901, None)], "doc_id long, quality int")
    model = quality.fit(quality.training_rows(docs, marks))
    found = {r.doc_id: r.score for r in quality.score_quality(docs.withColumn("score", F.lit(9)), model).collect()}
    assert sum((found[i] >= 0.5) == bool(q) for i, q in labels) >= 294
    assert all(found[i] == 0.0 for i in (900, 901, 902))
    blank = quality.fit(quality.training_rows(docs, marks.limit(0)))
    assert {r.score for r in quality.score_quality(docs.where("doc_id < 9"), blank).collect()} == {0.5}


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(8)
    lengths, moves = [4, 1, 0, 6], rng.normal(size=(2, 2))
    before = np.concatenate(([0], np.cumsum(lengths)))
    emission = rng.normal(size=before[-1])
    good, expected = quality.chain(emission, before, moves)
    total = np.zeros((2, 2))
    for a, b in zip(before[:-1], before[1:]):
        n = b - a
        weights = []
        for code in range(2**n):
            path = [(code >> j) & 1 for j in range(n)]
            score = sum(emission[a + j] * path[j] for j in range(n)) + sum(moves[path[j], path[j + 1]] for j in range(n - 1))
            weights.append((np.exp(score), path))
        z = sum(w for w, _ in weights)
        for j in range(n):
            assert np.isclose(good[a + j], sum(w for w, p in weights if p[j]) / z)
        for w, p in weights if n else []:
            for j in range(n - 1):
                total[p[j], p[j + 1]] += w / z
    assert np.allclose(total, expected)


# --- pipeline ----------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(11)
    passage, item = prose(rng, "en", 60), prose(rng, "fr", 40)
    rows = [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), 90), lang, "s", 0) for i in range(150)]
    rows[20] = (20, rows[5][1] + " more", "en", "s", 0)
    rows[30] = (30, rows[30][1] + " " + passage, "en", "s", 0)
    rows[31] = (31, rows[31][1] + "\n" + passage + "\n" + rows[32][1], "en", "s", 0)
    rows[40] = (40, rows[40][1] + " " + item + " " + rows[41][1], "fr", "s", 0)
    rows += [(200, None, "en", "s", 0), (201, "", "en", "s", 0), (202, "123 !", None, "s", 0), (None, prose(rng, "de", 90), None, None, None)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string, source string, n_chars long").withColumn("accepted", F.lit(1)).withColumn("_letter", F.lit(2))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        now = shared.Scratch(spark, "test").keep(now, name)
        seen[name] = {r.doc_id: r for r in now.collect()}
        if name != "sentencepiece_ids":
            assert now.columns == docs.columns
    everything = {r[0] for r in rows}
    assert set(seen["language_id"]) == everything - {200, 201, 202}
    assert set(seen["near_dedup"]) == set(seen["language_id"]) - {20}
    cut = seen["substring_dedup"]
    assert set(cut) == set(seen["near_dedup"])
    assert cut[31].text == " ".join(rows[31][1].replace(passage, "").split())
    assert cut[31].n_chars == len(cut[31].text) and passage in cut[30].text
    assert set(seen["decontamination"]) == set(cut) - {40}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()} == {
        d: r.ids for d, r in seen["sentencepiece_ids"].items()
    }


def test_pipeline_fits_the_space_of_decontamination_to_all_passages(spark, tmp_path, monkeypatch):
    rng = random.Random(14)
    item = sentence(rng, 20, 1000, "k")
    docs = [(i, f"{rng.choice(item.split())} {sentence(rng, 3)}") for i in range(40_000)] + [(50_000, item)]
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    real, fitted = decontaminate.latent_space, []

    def latent_space(passages, *others):
        fitted.append(passages.count())
        return real(passages, *others)

    monkeypatch.setattr(decontaminate, "latent_space", latent_space)
    kept = dict(corpus_pipeline.STAGES)["decontamination"](spark, spark.createDataFrame(docs, DOCS), str(tmp_path))
    assert kept.count() == 40_000 and fitted == [len(docs)]
