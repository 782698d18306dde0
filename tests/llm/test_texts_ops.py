"""Token files, SentencePiece search, chat formatting, top-k search and texts as arrays."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from adfathom.llm import chat, coder, pieces, shared, texts, token_files, topk

PIECES = public_tokenizers.path("piece_bpe_32k.model")
IDS = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a", "Hello  world\n  foo ", "x" * 300, "tab\tand\r\nline", "字字 和 😀 ñandú", "the  <|endoftext|> end",
    "trailing \n", "\n \n", "nul\0byte", "▁ literal", "word " * 3000, "don't we've  I'll 12345",
]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- coder and files ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("digits", [1, 2, 3, 4])
def test_blocks_come_back_as_they_were(digits):
    rng = np.random.default_rng(digits)
    top = 16**digits
    blocks = [rng.integers(0, top, n) for n in (0, 1, 2, 777, 4096)]
    blocks += [np.zeros(900, int), np.full(50, top - 1), np.minimum(rng.zipf(1.4, 2000), top) - 1]
    codes = coder.encode_blocks(blocks, digits)
    found = coder.decode_blocks(codes, [len(b) for b in blocks], digits)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, found))


def test_a_block_is_coded_alone_and_learns():
    block = np.arange(2000) % 50 * 900
    assert coder.encode_blocks([block]) == coder.encode_blocks([np.arange(70), block, np.zeros(5000, int)])[1:2]
    assert len(coder.encode_blocks([block])[0]) < 800


def test_damage_is_noticed():
    frame = token_files.pack_frames([([1, None], np.array([3, 2]), np.array([5, 6, 7, 5, 5]))])[0]
    docs, ids = token_files.unpack_frames([frame])[0]
    assert docs == [1, None] and [i.tolist() for i in ids] == [[5, 6, 7], [5, 5]]
    for at in (20, len(frame) - 9):
        with pytest.raises(ValueError):
            token_files.unpack_frames([frame[:at] + bytes([frame[at] ^ 1]) + frame[at + 1 :]])


def test_each_id_is_coded_in_one_step(monkeypatch):
    """Not digit by digit: the model learns as often as the longest block has ids."""
    steps, learn = [], coder._Models.learn
    monkeypatch.setattr(coder._Models, "learn", lambda self, *found: (steps.append(0), learn(self, *found)))
    blocks = [np.arange(300) % 7 * 9000, np.arange(120)]
    codes = coder.encode_blocks(blocks)
    assert len(steps) == 300
    assert [b.tolist() for b in coder.decode_blocks(codes, [300, 120])] == [b.tolist() for b in blocks]
    assert len(steps) == 600


def test_ids_without_order_take_little_more_than_the_entropy_of_their_shares():
    """What is given to predictions that hold by chance is not saved again where they fail."""
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 60_000), 3000) - 1
    counts = np.bincount(ids, minlength=3000)
    parts = coder.shares(counts, 4)
    assert parts.sum() == 1 << 16 and parts.min() == 1
    blocks = np.split(ids, 30)
    codes = coder.encode_blocks(blocks, 4, [parts], [0] * 30)
    found = coder.decode_blocks(codes, [2000] * 30, 4, [parts], [0] * 30)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, found))
    chance = counts[counts > 0] / len(ids)
    assert 8 * sum(map(len, codes)) < 1.08 * len(ids) * -(chance * np.log2(chance)).sum()


def test_frames_of_any_size_and_vocabulary_come_back():
    rng = np.random.default_rng(3)
    frames = [
        ([7], np.array([0]), np.zeros(0, np.uint32)),
        ([None, 1, 1], np.array([1, 0, 2]), np.array([9, 9, 9], np.uint32)),
        ([2], np.array([90_000]), rng.permutation(90_000).astype(np.uint32) * 47_000),  # needs five digits
        ([3, 4], np.array([70_000, 5]), rng.integers(0, 50_000, 70_005).astype(np.uint32)),
    ]
    for (docs, sizes, ids), (names, found) in zip(frames, token_files.unpack_frames(token_files.pack_frames(frames))):
        assert names == docs and [len(f) for f in found] == sizes.tolist()
        assert np.array_equal(np.concatenate(found), ids)


class Asked:
    """A tokenizer that notes what it is asked to encode."""

    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, []

    def encode_batch_fast(self, column, **options):
        self.seen += column
        return self.tokenizer.encode_batch_fast(column, **options)


def test_library_is_asked_for_new_words_only():
    library, cached = Tokenizer.from_file(IDS), token_files.CachedTokenizer(IDS)
    cached.encode(["alpha beta (gamma) 12 delta", None, "beta"])
    cached.tokenizer = Asked(cached.tokenizer)
    text = "alpha, beta... 12) delta! beta:gamma"
    assert cached.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(cached.tokenizer.seen) == ["!", ",", "...", ":"]


def test_known_words_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_BYTES", 20_000)
    library, cached = Tokenizer.from_file(IDS), token_files.CachedTokenizer(IDS)
    rng = random.Random(6)
    for size in (50, 100, 200, 2000, 50, 200):
        column = [" ".join("".join(rng.choices("abcd", k=rng.randrange(1, 7))) for _ in range(size)), "x  y" * 500]
        ids, bounds = cached.encode(column)
        found = library.encode_batch_fast(column, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [f.ids for f in found]
        assert cached.known.nbytes + cached.ids.nbytes + cached.ends.nbytes <= 20_016


def test_words_are_cut_where_the_library_cuts():
    """Every string of up to five signs over letters, endings, digits, signs and spaces."""
    library, cached = Tokenizer.from_file(IDS), token_files.CachedTokenizer(IDS)
    column = ["".join(t) for n in range(6) for t in itertools.product(["s", "'", "-", "5", "\u00e9", " ", "\u2009"], repeat=n)]
    rng = random.Random(7)
    signs = ["'ll", "'t", "re", " ", "  ", "\u00b2", "\u3000", "\u5b57", "_", "\x7f", "9", "A", "|>", "<|endoftext", "\U0001f600", "\n", "\u1680"]
    column += ["".join(rng.choices(signs, k=rng.randrange(3, 15))) for _ in range(10_000)]
    ids, bounds = cached.encode(column)
    found = library.encode_batch_fast(column, add_special_tokens=False)
    assert all(ids[a:b].tolist() == f.ids for a, b, f in zip(bounds[:-1], bounds[1:], found))


def test_cached_tokenizer_equals_the_library_on_white_space():
    """Every string of up to five signs over several kinds of white space, and longer ones at random."""
    library, cached = Tokenizer.from_file(IDS), token_files.CachedTokenizer(IDS)
    signs = ["a", " ", "\n", "\t", "\xa0", "\u3000", "\x85", "B."]
    column = ["".join(t) for n in range(6) for t in itertools.product(signs, repeat=n)]
    rng = random.Random(5)
    column += ["".join(rng.choices(signs + ["\x1c", "\u2028"], k=rng.randrange(6, 20))) for _ in range(20_000)]
    for first in range(0, len(column), 5000):
        part = column[first : first + 5000]
        ids, bounds = cached.encode(part)
        found = library.encode_batch_fast(part, add_special_tokens=False)
        assert all(ids[a:b].tolist() == f.ids for a, b, f in zip(bounds[:-1], bounds[1:], found))


def test_cached_tokenizer_equals_the_library():
    library, cached = Tokenizer.from_file(IDS), token_files.CachedTokenizer(IDS)
    rng = random.Random(4)
    column = ODD + ["".join(rng.choice(["a", " ", "\n", "é", "1", ".", "the ", " b"]) for _ in range(60)) for _ in range(200)]
    flat, bounds = cached.encode(column)
    for i, text in enumerate(column):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files_hold_all_documents_in_order(spark):
    rows = [(i * 7 % 40, ODD[i % len(ODD)]) for i in range(40)] + [(3, None), (3, None)]
    folder = f"{shared.Scratch(spark, 'test').folder}/files"
    token_files.write_tokens(documents(spark, rows).withColumn("ids", F.lit(1)), folder, IDS, end=2)
    got = token_files.read_tokens(spark, folder).orderBy("start").collect()
    library, start = Tokenizer.from_file(IDS), 0
    for row, (doc, text) in zip(got, sorted(rows, key=lambda r: (r[0], r[1] or ""))):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc, start, len(ids), ids)
        start += len(ids)
    assert len(got) == len(rows)
    digests = token_files.read_tokens(spark, folder, digest=True).collect()
    assert sorted(r.ids_crc32 for r in digests) == sorted(zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


def test_empty_table_of_documents_gives_empty_files(spark):
    folder = f"{shared.Scratch(spark, 'test').folder}/files"
    token_files.write_tokens(documents(spark, []), folder, IDS)
    assert token_files.read_tokens(spark, folder).count() == 0


# --- SentencePiece -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_search_equals_the_library_on_odd_and_random_texts(library):
    model, rng = pieces.load_model(PIECES), random.Random(1)
    parts = ["the", " ", "  ", "a", "é", "\n", "字", "😀", "▁", "ing", "tion", "Hello", ".", "23", "x" * 70, " " * 19]
    column = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    expected = [library.encode(t) for t in column]
    assert [pieces.encode(model, t) for t in column] == expected
    flat, bounds = pieces.encode_column(model, pa.array(column))
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == expected


def test_streaming_commits_early_and_keeps_little(library):
    model = pieces.load_model(PIECES)
    search, text = pieces.StreamingViterbi(model), "▁" + "▁".join(["internationalisation", "of", "things"] * 500)
    ids, most = [], 0
    for at in range(0, len(text), 7):
        ids += search.push(text[at : at + 7])
        most = max(most, len(search.text))
    assert most < 12 * model.longest and len(ids) > 1000
    assert ids + search.finish() == library.encode(text[1:].replace("▁", " "))


def test_unigram_models_take_the_best_sum():
    model = pieces.PieceModel(PIECES)
    model.kind = pieces.UNIGRAM
    rng = random.Random(2)

    def best(text):
        paths = [(0.0, [])]
        for end in range(1, len(text) + 1):
            options = []
            for start in range(end):
                piece = text[start:end]
                if piece in model.scores or end - start == 1:
                    score = model.scores.get(piece, model.worst)
                    options.append((paths[start][0] + score, -start, paths[start][1] + model.numbers(piece)))
            paths.append((lambda o: (o[0], o[2]))(max(options, key=lambda o: o[:2])))
        return paths[-1][1]

    for _ in range(60):
        word = "▁" + "".join(rng.choice(["in", "ter", "e", "字", "ñ", "st", "ing"]) for _ in range(6))
        search = pieces.StreamingViterbi(model)
        expected = best(word)
        assert search.push(word) + search.finish() == expected
        ids, _ = pieces.search_words(model, [word])
        assert ids.tolist() == expected


def test_encode_and_decode_documents(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (0, ""), (None, "no number")]
    docs = documents(spark, rows).withColumn("ids", F.lit("mine"))
    got = pieces.decode_documents(pieces.encode_documents(docs, PIECES, digest=True), PIECES)
    assert got.columns == ["doc_id", "text", "ids", "n_ids", "ids_crc32", "decoded"]
    for row in got.collect():
        expected = library.encode(row.text or "")
        assert row.ids == expected and row.n_ids == len(expected)
        assert row.decoded == (row.text or "").replace("▁", " ")
        assert row.ids_crc32 == zlib.crc32(np.array(expected, "<u4").tobytes())
    assert pieces.encode_documents(documents(spark, []), PIECES).count() == 0


# --- chat --------------------------------------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string"


def test_chat_round_trip_and_mask(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\|end|>", "<|end|>\n", "\\<|", "a\\\\<s>\\", "<", "|>", "", None, "é字😀<|turn|>", "[\\INST]"]
    rows = [(c, t, ("user", "assistant", None, "<|x")[(c + t) % 4], hard[(c * 3 + t) % len(hard)]) for c in range(9) for t in range(7)]
    rows += [(None, 0, "user", "x"), (5, 0, "assistant", "again"), (5, 0, "assistant", "again"), (6, None, "user", "early")]
    talks = spark.createDataFrame(rows, TALK).withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in chat.chat_digests(chat.format_conversations(talks)).collect()}
    assert len(out) == 10
    for conv, row in out.items():
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))]
        order = spark.createDataFrame([r for r in rows if r[0] == conv], TALK)
        said = chat.format_conversations(order).select(chat.parsed_turns(F.col("formatted")).alias("t")).first().t
        assert sorted((t.role, t.text) for t in said) == sorted(own)
        joined = "".join(f"{t.role}\n{t.text}\n" for t in said)
        loss = "".join(t.text for t in said if t.role == "assistant")
        assert row.n_turns == len(own)
        assert row.turns_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_parts_become_ordered_placeholders(spark):
    part = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,units:double>>"
    rows = [
        (1, 0, "user", [("text", "see <|", None, None), ("image", None, "a.png", 2.0), ("text", "and", None, None), ("audio", None, "b.wav", 1.5)]),
        (1, 1, "assistant", [("document", None, "c.pdf", None), ("hologram", "kept", None, None)]),
        (2, 0, "user", None),
    ]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, part), F.col("parts")).collect()}
    assert got[1].formatted == (
        "<|turn|>user<|text|>see <\\|<|image|>and<|audio|><|end|>\n<|turn|>assistant<|text|><|document|>kept<|end|>\n"
    )
    assert [(a.place, a.turn, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [
        (1, 0, "image", "a.png", 512), (2, 0, "audio", "b.wav", 38), (3, 1, "document", "c.pdf", 600)
    ]
    assert got[1].expanded_tokens == 1150 and got[2].attachments == [] and got[2].expanded_tokens == 0
    span = got[1].loss_spans[0]
    assert got[1].formatted[span.start : span.end] == "<|document|>kept"


def test_chat_of_nothing(spark):
    assert chat.format_conversations(spark.createDataFrame([], TALK)).count() == 0


# --- top-k -------------------------------------------------------------------------------------------------


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "SHARD_ROWS", 11)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 1024]) for i in range(120)]
    rows += [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, []), (None, [1.0] * 6), (505, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows + rows[:5], "id long, vector array<double>").withColumn("score", F.lit(0))
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("id % 10 = 0 OR id > 499")).collect())
    whole = {i: np.floor(np.array(v) * 1024).astype(int) for i, v in rows[:120]}
    expected = []
    for q in range(0, 120, 10):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in whole if i != q)[:10]
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert got == sorted(expected)
    few = topk.top_k(vectors.where("id < 4"), vectors.where("id = 0")).collect()
    assert len(few) == 3
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


# --- arrays ------------------------------------------------------------------------------------------------


def test_words_minima_and_spans():
    column = pa.array(["a  bc\td", None, "", "\x0bé  ", "x" * 50])
    for limit in (1, 10, 1 << 20):
        found = []
        for _, data, offsets in texts.text_slices(column, limit):
            start, end, before = texts.word_bounds(data, offsets)
            words = [data[a:b].tobytes().decode() for a, b in zip(start, end)]
            found += [words[a:b] for a, b in zip(before[:-1], before[1:])]
        assert found == [["a", "bc", "d"], [], [], ["é"], ["x" * 50]]
    values = np.random.default_rng(1).integers(0, 99, 200)
    for width in (1, 2, 5, 69, 200):
        assert texts.sliding_min(values, width).tolist() == [values[i : i + width].min() for i in range(201 - width)]
    assert texts.spans(np.array([1, 1, 0, 0, 1], bool)).tolist() == [[0, 2], [4, 5]]
    assert texts.covered(np.array([0, 3]), 2, 6).tolist() == [True, True, False, True, True, False]


def test_large_components_give_exact_scores(spark):
    rng = random.Random(31)
    rows = [(i, [rng.uniform(-2, 2) * (40_000 if i % 9 == 0 else 1) for _ in range(8)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("id % 6 = 0"), k=5).collect())
    whole = {i: [math.floor(x * 1024) for x in v] for i, v in rows}
    expected = []
    for q in range(0, 60, 6):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        expected += [(q, rank, i, -score) for rank, (score, i) in enumerate(scores[:5], 1)]
    assert got == sorted(expected) and max(r[3] for r in got) > 2**53
