"""Token counts, byte-level BPE and packing against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cases import LONG, TEXTS, as_set, documents
from tokenizers import Tokenizer

from changegate.llm import bpe_core, byte_bpe, packing, queries, token_count

PIECES = [
    " ", "  ", "\n", "\t", "'s", "'re", "'", "a", "the", "Über", "<|endoftext|>", "<|endof", "12", "3", "!!", "…", "日本語", "🎉",
    "́", "\xa0", "\u2003", "aaaaaaaa", "ab" * 20, "\u0558", "\U0001e5d0", "\ua7d2", "<", "|", "\x00", "\x85", "\x1c", "THE", "İ", "ΑΣ",
    "\u212b", "ﬁ", "don't", "<|startoftext|>", "ÀÉ", "ŉ",
]


def samples(n, seed=5):
    pick = random.Random(seed)
    return ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_count.vocabulary_path())


@pytest.fixture(scope="module")
def tik():
    ranks = {t: i for t, i in bpe_core.load_ranks(byte_bpe.vocabulary_path()).ids.items()}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_and_every_prefix_equal_the_library(library):
    counter = token_count.counter(token_count.vocabulary_path())
    size = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    for text in samples(400):
        assert counter.count(text) == size(text)
    for text in [*samples(60, seed=6), "a  \xa0b", "it's", "x <|endoftext|> y"]:
        table = counter.prefix_counts(text)
        assert table == [size(text[:i]) for i in range(len(text) + 1)]
        for budget in (0, 1, 3, 100):
            assert counter.truncate(table, budget) == max(i for i, n in enumerate(table) if n <= budget)
    assert counter.count(LONG) == size(LONG)


def test_token_counts_of_awkward_rows(spark, library):
    got = as_set(token_count.token_counts(documents(spark)))
    want = []
    for i, t in TEXTS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)
    assert as_set(token_count.token_counts(documents(spark, []))) == []


def test_prefix_tables(spark):
    rows = token_count.prefix_tables(documents(spark, [(1, "one two three four"), (2, None)]), budget=2).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["prefix_counts"][-1] == 4 and "one two three four"[: by_id[1]["fits_chars"]] == "one two"
    assert by_id[2]["prefix_counts"] == [0] and by_id[2]["fits_chars"] == 0


def test_tree_encoding_equals_the_library(tik):
    codec = byte_bpe.codec(byte_bpe.vocabulary_path())
    pick = random.Random(2)
    odd = ["a" * 5000, "ab" * 3000, "日本" * 2000, " " * 3000, "".join(pick.choice("abcdefgh") for _ in range(6000))]
    for text in [*samples(400), *odd, LONG]:
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == tik.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()


def test_join_is_associative():
    codec = byte_bpe.codec(byte_bpe.vocabulary_path())
    pick = random.Random(4)
    for _ in range(200):
        word = "".join(pick.choice("theandinger") for _ in range(pick.randint(3, 24))).encode()
        a, b = sorted(pick.sample(range(len(word) + 1), 2))
        x, y, z = (codec.encode_piece(p) if p else [] for p in (word[:a], word[a:b], word[b:]))
        assert codec.join(codec.join(x, y), z) == codec.join(x, codec.join(y, z)) == codec.vocabulary.encode_plain(word)


def test_digests_and_round_trip_of_awkward_rows(spark, tik):
    want = []
    for i, t in TEXTS:
        ids = np.array(tik.encode_ordinary(t or ""), dtype="<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert as_set(byte_bpe.round_trip_digests(documents(spark))) == sorted(want, key=repr)
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(documents(spark)))
    assert as_set(back) == sorted(((i, t or "") for i, t in TEXTS), key=repr)
    assert byte_bpe.round_trip_digests(documents(spark, [])).count() == 0


def test_word_tokenizer_equals_the_library():
    words = packing.tokenizer(packing.vocabulary_path())
    texts = [*samples(600), LONG]
    for text, packed in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        want = words.tokenizer.encode(text, add_special_tokens=False).ids + [packing.END_ID]
        assert np.frombuffer(packed, words.dtype).tolist() == want


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_keys_walk_the_grid(dims, bits):
    cells = np.array(list(np.ndindex(*[1 << bits] * dims)))
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def check_packing(rows, texts, context=packing.CONTEXT):
    """Every id in exactly one piece, sequences gapless, only the last one short."""
    library = Tokenizer.from_file(packing.vocabulary_path())
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i in {i for i, _ in texts}:
        mine = [t for j, t in texts if j == i]
        ids = np.array(library.encode(mine[0] or "", add_special_tokens=False).ids + [packing.END_ID], dtype="<u4")
        assert sum(p["length"] for p in pieces[i]) == len(mine) * len(ids)
        for p in pieces[i]:
            assert p["doc_tokens"] == len(ids) and 0 < p["length"] <= context
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        short += at != context
    assert short <= 1


def test_packing_of_awkward_rows(spark):
    check_packing(packing.pack_documents(documents(spark)).collect(), TEXTS)
    check_packing(packing.pack_documents(documents(spark), context=16).collect(), TEXTS, 16)
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_packing_query_keeps_all_tokens(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_packing(queries.QUERIES["op10_packing"](spark, sf_dir).collect(), texts)


def test_like_documents_are_neighbours():
    ids = [np.array([1, 2, 3] * 50), np.array([900, 901, 902] * 50), np.array([1, 2, 3] * 49 + [4])]
    cells = packing.project(ids).astype(float)
    assert np.abs(cells[0] - cells[2]).sum() < np.abs(cells[0] - cells[1]).sum()
