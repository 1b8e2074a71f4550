import tracemalloc

import numpy as np
import pyarrow as pa

from vulntide.llm import workers


def runs(texts):
    """Each word's text, of texts without other white space than spaces."""
    return [word for text in texts for word in (text or "").split(" ") if word]


def test_equal_words_have_equal_hashes_in_every_block():
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(1, 9)))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 30_000)) for _ in range(8)]
    long = "y" * (workers.POWERS_KEPT + 7)
    texts += [None, "", " ", long, "a " + long + " b", "z" * (3 * workers.HASH_BLOCK), *texts[:2]]
    flat = workers.FlatText(pa.array(texts))
    assert len(flat.bytes) > 8 * workers.HASH_BLOCK
    alone = {word: workers.FlatText(pa.array([word])).word_hashes()[0] for word in set(runs(texts))}
    assert len(set(alone.values())) == len(alone)
    assert flat.word_hashes().tolist() == [alone[word] for word in runs(texts)]
    assert len(workers.FlatText(pa.array([None, ""], pa.string())).word_hashes()) == 0


def test_hashing_a_batch_takes_and_keeps_little_memory():
    flat = workers.FlatText(pa.array(["word-of-63-letters" * 3 + "ninechars"] * (workers.BATCH_BYTES // 63)))
    assert len(flat.bytes) > 0.99 * workers.BATCH_BYTES
    tracemalloc.start()
    try:
        flat.word_hashes()
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert kept < 12 << 20 and peak < 32 << 20
