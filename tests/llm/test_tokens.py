import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vulntide.llm import bpe, tokenfiles, tokens
from vulntide.llm.bpe import WORDS, ChunkCoder, WordEncoder

PIECES = ["a", " ", "  ", "\n", "the", "▁", "é", "é", "日本", "<s>", "<|endoftext|>", "<|end", "'s", "n't", "ß", "Σ", ".", "1", " ", "\x85", "가", "\x00"]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.PIECES))


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(public_tokenizers.path(bpe.WORDS))


def expected(words, text):
    ids = words.encode(text or "", add_special_tokens=False).ids
    decoded = words.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def drawn(n, longest, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices(PIECES, k=draw.randint(0, longest))) for _ in range(n)]


def test_counts_are_the_librarys(spark, odd_docs, documents, pieces):
    for docs in (odd_docs, documents):
        for row in tokens.count_tokens(docs).collect():
            text = row.text or ""
            n = len(pieces.encode(text))
            assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 4096)


def test_counts_of_random_texts(pieces):
    counter = tokens.TokenCounter(public_tokenizers.path(tokens.PIECES))
    texts = drawn(4000, 9, 1)
    assert counter(pa.array(texts)).tolist() == [len(pieces.encode(t)) for t in texts]


def test_whole_tokens_are_proven(pieces):
    counter = tokens.TokenCounter(public_tokenizers.path(tokens.PIECES))
    assert counter.splits and all(n > 10_000 for n in counter.proven)
    for word in random.Random(3).sample(sorted(counter.after_space), 200):
        assert len(pieces.encode(f"x\n {word} \n")) == len(pieces.encode("x\n  \n")) or counter.after_space[word] == 1


def test_clashing_columns_are_replaced(spark, no_docs):
    docs = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, N_TOKENS string, over_limit int")
    (row,) = tokens.count_tokens(docs).collect()
    assert row.n_tokens == 2 and row.over_limit is False
    assert tokens.count_tokens(no_docs).count() == 0
    assert bpe.encode_and_decode(docs.withColumnRenamed("N_TOKENS", "ids_sha256")).first().n_tokens == 2


def test_digests_are_the_librarys(odd_docs, documents, words):
    for docs in (odd_docs, documents):
        for row in bpe.encode_and_decode(docs).collect():
            assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == expected(words, row.text)


def test_chunk_joins_are_repaired(words):
    coder = bpe.ChunkCoder(bpe.WordEncoder(public_tokenizers.path(bpe.WORDS)))
    texts = drawn(40, 3000, 2) + ["".join(random.Random(k).choices(["日", "é", "e", "́", "<|endoftext|>", "'s"], k=4000)) for k in range(6)]
    assert max(len(bpe.chunk_ends(t.encode())) for t in texts) > 3
    assert coder.code(texts) == [expected(words, t) for t in texts]
    # A cut inside a word, a special string or a composed letter disagrees, so it is repaired.
    for whole in ("hello", "x<|endoftext|>y", "é"):
        data = whole.encode()
        for cut in [k for k in range(1, len(data)) if data[k] & 0xC0 != 0x80]:
            parts = [data[:cut], data[cut:]]
            ids, bounds = coder.encoder.encode(pa.array([p.decode() for p in parts]))
            used = {p: (ids[a:b], b"") for p, a, b in zip(parts, bounds, bounds[1:])}
            joined = np.concatenate([i for i, _ in coder.joined(parts, used)])
            assert joined.tolist() == words.encode(whole, add_special_tokens=False).ids


def test_shared_passages_share_chunks():
    draw = random.Random(9)
    passage = " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(4000))
    cut = lambda data: {data[a:b] for a, b in zip([0, *bpe.chunk_ends(data)], bpe.chunk_ends(data))}
    one, two = cut(f"begin {passage} end".encode()), cut(f"another start of it {passage}".encode())
    assert len(one & two) >= len(one) - 4 > 10


def test_files_round_trip(spark, odd_docs, no_docs, words):
    files = tokenfiles.write_token_files(odd_docs, partitions=4)
    rows = tokenfiles.read_token_files(spark, files).collect()
    texts = odd_docs.select("doc_id", "text").collect()
    key = lambda i: (i is not None, i)
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((t.doc_id for t in texts), key=key)
    start = 0
    for row in rows:
        assert row.start == start
        start += row.n_tokens
    want = sorted((key(t.doc_id), len(i), zlib.crc32(np.array(i, "<u4").tobytes()))
                  for t in texts for i in [words.encode(t.text or "", add_special_tokens=False).ids + [1]])
    assert sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == want
    assert files.dtype == "<u2"
    assert tokenfiles.read_token_files(spark, tokenfiles.write_token_files(no_docs)).count() == 0


def _without_spaces(kind, n):
    rng = random.Random(kind)
    ideograph = lambda: chr(rng.randrange(0x4E00, 0x9FA0))
    make = {
        "ideographs": ideograph,
        "sentences": lambda: ideograph() if rng.random() < 0.93 else rng.choice("。，、！"),
        "base 64": lambda: rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
        "thai": lambda: chr(rng.randrange(0xE01, 0xE3B)),
        "code": lambda: rng.choice(["var a=", "function(){", "x.y(1,2);", "'s", "}", "12ab", "<|endoftext|>", "é", "é", "ﬁ", "1º", "a1́"]),
    }[kind]
    return "".join(make() for _ in range(n))


@pytest.mark.parametrize("kind", ["ideographs", "sentences", "base 64", "thai", "code"])
def test_texts_without_white_space_are_coded_in_linear_time(kind):
    text = _without_spaces(kind, 1_000_000)
    while len(text.encode()) > 1_000_000:
        text = text[: len(text) // 2]
    encoder = WordEncoder(public_tokenizers.path(WORDS))
    start = time.process_time()
    ids = encoder.encode_whole(text)
    encoder.decode(ids)
    library = time.process_time() - start
    coder = ChunkCoder(encoder)
    start = time.process_time()
    ((n, ids_sha256, decoded_sha256),) = coder.code([text])
    own = time.process_time() - start
    assert (n, ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    assert decoded_sha256 == hashlib.sha256(encoder.decode(ids).encode()).hexdigest()
    assert own < 3 * library + 0.5 and coder.join_bytes < 1 << 20


@pytest.mark.parametrize("seed", range(6))
def test_any_cut_is_repaired(seed, monkeypatch):
    """Chunks cut at any character, so that most joins have to be mended."""
    rng = random.Random(seed)
    pieces = ["ab", "a", " ", "1", "e", "\u0301", "é", "'s", "'", "l", "<|", "endoftext", "|>", "日", "。", "\n", "ſ", "İ", "-", "한", "\u1100", "\u1161"]
    text = "".join(rng.choice(pieces) for _ in range(400))
    cuts = sorted(rng.sample(range(1, len(text)), 60))
    ends = [len(text[:k].encode()) for k in cuts] + [len(text.encode())]
    monkeypatch.setattr(bpe, "chunk_ends", lambda data: ends)
    encoder = WordEncoder(public_tokenizers.path(WORDS))
    ((n, ids_sha256, _),) = ChunkCoder(encoder).code([text])
    ids = encoder.encode_whole(text)
    assert (n, ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
