"""Ranked lexical search, byte-level BPE and the filter audit against brute force and the library."""

import base64
import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from adfathom.llm import byte_bpe, filter_audit, lexical, spans, texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- spans -------------------------------------------------------------------------------------------------


def test_equal_spans_are_found_and_others_told_apart():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (0, 1, 2, 7, 8, 9, 63, 64, 65, 66, 200) for _ in range(6)]
    words += [b"x" * 64 + b"y", b"x" * 64 + b"z", b"x" * 65]
    words = [w for w in words * 3]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    owner = np.arange(len(words)) % 2
    same = spans.same_spans(spans.Spans(data), start, end, owner)
    assert all(words[i] == words[j] and owner[i] == owner[j] for i, j in enumerate(same))
    assert len(set(same)) == len(set(zip(words, owner.tolist())))


# --- byte-level BPE ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(RANKS)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


SIGNS = ["'", "s", "t", "re", "ve", "ll", "r", "e", "d", "m", " ", "  ", "\n", "\t", " ", "1", "22", "é", "字", "😀", "!",
         "　", "B", "<|endoftext|>", "\0", "ͅ", "ǅ", "½", "\x1c", "\x85", "̀"]


def test_ids_equal_the_library(vocabulary, library):
    rng = random.Random(2)
    column = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    column += [None, "", "'", "'re", "'r", "s's't", " 's", "\n ", "x" * 5000, "ab" * 40, "a b" * 3000, " " * 700, " " * 300 + "x"]
    seen = 0
    for row, data, offsets in texts.text_slices(pa.array(column, pa.string()), 50_000):
        ids, bounds = byte_bpe.encode_slice(vocabulary, data, offsets)
        decoded = byte_bpe.decode_column(vocabulary, ids, bounds).to_pylist()
        for i in range(len(bounds) - 1):
            text = column[row + i] or ""
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode_ordinary(text), text[:80]
            assert decoded[i] == text.encode()
            seen += 1
    assert seen == len(column)


def test_perfect_hash_is_minimal_and_both_merges_agree(vocabulary):
    keys = np.random.default_rng(3).integers(0, 1 << 63, 3000, np.uint64)
    assert sorted(byte_bpe.PerfectHash(keys).slots(keys)) == list(range(3000))
    assert sorted(vocabulary.entry) == list(range(len(vocabulary.ranks)))
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"aeiou rstln\xc3\xa9") for _ in range(rng.randrange(1, 33))) for _ in range(500)]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces])
    ids, counts = byte_bpe.merge_all(vocabulary, data, np.cumsum(size) - size, np.cumsum(size))
    ends = np.cumsum(counts)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, counts)] == [vocabulary.merged(p) for p in pieces]


def test_documents_keep_their_columns_and_come_back(spark, library):
    long = "Überlange Wörter und " * 40_000
    rows = [(1, "a", None, 5), (2, "b", "", 5), (2, "b", "Hello  world's", 6), (None, None, long, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, ids string, text string, n_tokens int")
    encoded = byte_bpe.encode_documents(docs, RANKS, digest=True)
    assert encoded.columns == ["doc_id", "text", "ids", "n_tokens", "ids_sha256"]
    found = byte_bpe.decode_documents(encoded, RANKS).collect()
    assert len(found) == 4
    for r in found:
        want = library.encode_ordinary(r["text"] or "")
        assert r["ids"] == want and r["n_tokens"] == len(want) and bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(docs.limit(0), RANKS), RANKS).count() == 0
    lists = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode_documents(lists, RANKS).collect()] == [b"", b""]


# --- filter audit ------------------------------------------------------------------------------------------


def audit(docs, labels):
    """Every order applied to every document, one by one."""
    rows, order_of = [], {"A": 0, "B": 1, "C": 2, "D": 3, "E": 4}
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, t, _ in docs)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words),
                 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]
        good, toxic = [any(x[0] == doc_id is not None and x[k] == 1 for x in labels) for k in (1, 2)]
        rows.append((source or "", fails, good, toxic))
    found = {}
    for part in {r[0] for r in rows}:
        of = Counter()
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, name in enumerate(order, 1):
                at = order_of[name]
                gone = [r for r in left if r[1][at]]
                left = [r for r in left if not r[1][at]]
                failing = [r for r in rows if r[0] == part and r[1][at]]
                only = sum(sum(r[1]) == 1 for r in failing)
                of[name] += len(gone)
                found[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), only,
                                                     sum(r[2] for r in gone), sum(r[3] for r in gone), name]
        for key, value in found.items():
            if key[0] == part:
                value[-1] = of[value[-1]]
    return found


def test_audit_equals_every_order_one_by_one(spark):
    rng = random.Random(5)
    pool = ["", None, "a " * 60, "one two # three", "LOUD WORDS", " ".join(f"w{i}" for i in range(60)),
            " ".join(f"W{i}|" for i in range(55)), "é " * 50, "x" * 300 + " " + "x" * 300 + "y", "tab\tline\x0bend"]
    docs = [(i, rng.choice(pool), rng.choice(["one", "two", None, ""])) for i in range(80)]
    docs += [(3, pool[2], "one"), (3, pool[2], "one"), (None, pool[2], "two"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(7, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, failed int, part int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {
        (r["part"], r["filter_order"], r["step"]): [
            r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]
        ]
        for r in filter_audit.interactions(table, marks).collect()
    }
    assert found == audit(docs, labels)
    assert filter_audit.interactions(table.limit(0), marks).count() == 0
    assert filter_audit.interactions(table, marks.limit(0)).count() == len(found)


def test_counts_of_one_pass_equal_patterns():
    rng = random.Random(6)
    column = ["".join(rng.choice("aA é字\t\x0b#|\0😀 ") for _ in range(rng.randrange(40))) for _ in range(500)]
    column += ["", "a", " ", "LONG " * 30_000]
    for row, data, offsets in texts.text_slices(pa.array(column), 4000):
        for i, counts in enumerate(np.array(filter_audit.byte_counts(data, offsets)).T.tolist()):
            text = column[row + i]
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            capitals, symbols = len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text))
            assert counts == [len(words), len(set(words)), capitals, len(text), symbols]


# --- ranked lexical search ---------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranking(docs, items, k):
    held = [(d, Counter(TERM.findall((t or "").translate(SMALL)))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    found = []
    for item, text in items:
        scores = []
        for row, (doc, counts) in enumerate(held):
            score = 0
            for t in set(TERM.findall((text or "").translate(SMALL))) & set(counts):
                m = 50 + (50 * sum(counts.values()) * n_docs) // n_terms
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, row))
        for rank, (score, missing, doc, _) in enumerate(sorted(scores)[:k], 1):
            found.append((item, rank, None if missing else doc, -score))
    return sorted(found, key=str)


@pytest.mark.parametrize("shard", [7, 2_000_000])
def test_search_equals_scores_of_all_documents(spark, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", shard)
    rng = random.Random(7)
    words = ["the", "of", "É", "é", "3x", "rare", "Mid", "mid", "字字", "a_b", "x^y", "lone"] + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, [40, 30] + [3] * 40, k=rng.randrange(0, 30)))) for i in range(150)]
    docs += [(150, docs[3][1]), (3, docs[3][1]), (None, docs[4][1]), (151, None), (152, "... !"), (153, "the " * 9000)]
    items = [(1, "the rare of"), (2, "MID mid lone w1 w2 w3"), (3, None), (4, ""), (5, "nowhere"), (6, "the"), (6, "w5"), (None, "É w9")]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, terms string").repartition(3)
    asked = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, item int")
    for k in (4, 400):
        found = [tuple(r) for r in lexical.rank_documents(table, asked, k).collect()]
        assert sorted(found, key=str) == ranking(docs, items, k)
    assert lexical.rank_documents(table.limit(0), asked).count() == 0
    assert lexical.rank_documents(table, asked.limit(0)).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = [(i, f"w{i % 7} w{i % 3} common") for i in range(60)]
    items = [(i, f"w{i} common") for i in range(9)]
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 16)
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted([tuple(r) for r in lexical.rank_documents(table, asked, 5).collect()], key=str) == ranking(docs, items, 5)


def test_reading_stops_before_the_lists_end():
    """Two documents lead by so much that the long list of a common term is not read to its end."""
    term = np.array([0, 0, *[1] * 5000])
    doc = np.array([3, 5, *range(5000)])
    impact = np.array([90_000, 80_000, *range(6000, 1000, -1)])
    shard = lexical.Shard(term, doc, impact, 5000)
    steps = []
    plain = lexical.stretches

    def counted(first, size):
        steps.append(int(size.sum()))
        return plain(first, size)

    lexical.stretches = counted
    try:
        docs, scores = shard.search(np.array([0, 1]), 2, np.zeros(0, np.int64))
    finally:
        lexical.stretches = plain
    best = sorted(zip(scores.tolist(), docs.tolist()), reverse=True)[:2]
    assert best == [(90_000 + 5997, 3), (80_000 + 5995, 5)]
    assert max(steps) < 5000
