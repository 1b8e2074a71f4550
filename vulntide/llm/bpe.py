"""Byte-level BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from .workers import append_columns, per_process

WORDS = "word_bpe_49k.json"

WORD_ENTRIES = 800_000
LONGEST_KEPT = 64

# A chunk ends with the first word that ends at or after a marked byte.
HASH_WINDOW = 16
HASH_BITS = 10
CHUNK_BYTES_KEPT = 6 << 20

# Letters whose normal form, lower case and byte alphabet are known, then ASCII marks
# (no apostrophe: it starts contractions).
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
# Places in UTF-8 at which a text can be cut: ASCII white space, and seams, where one pre-token
# ends and no normal form reaches over: between an ASCII letter and a digit, and between wide
# punctuation and an ideograph.
_BREAK = re.compile(
    rb"[\x20\x09-\x0D]|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    rb"|(?:(?<=\xe3\x80[\x81\x82])|(?<=\xef\xbc[\x81\x8c\x9a\x9b\x9f]))(?=[\xe5-\xe9])"
)
# Bytes of a chunk's end that are searched for its last such place before more are.
TAIL = 64
JOIN_BYTES_KEPT = 16 << 20


def _byte_alphabet() -> dict[int, str]:
    """Byte -> character, the rule of byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts, one distinct white-space separated word at a time.

    ASCII white space never takes part in a token, a special string or a composed
    character, so a text's ids are its words' ids, one after the other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            self.plain = (
                '"type":"Lowercase"' in file.read().replace(" ", "").replace("\n", "")
                and self.library.model.end_of_word_suffix == "</w>"
            )
        self.merge = self.library.model.tokenize
        self.alphabet = _byte_alphabet()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.library.id_to_token(k) or "" for k in range(size)]

    def _part(self, part: str) -> bytes:
        """Ids of a run of letters or of marks, which the table of parts lacks."""
        text = part.lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.alphabet)
        ids = array("I", [t.id for t in self.merge(text)]).tobytes()
        if len(self.parts) > WORD_ENTRIES:
            self.parts.clear()
        if len(part) <= LONGEST_KEPT:
            self.parts[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        found = _PLAIN.fullmatch(word) if self.plain else None
        if not found:
            return self.encode_whole(word).tobytes()
        letters, marks = found.groups()
        ids = (self.parts.get(letters) or self._part(letters)) if letters else b""
        return ids + (self.parts.get(marks) or self._part(marks)) if marks else ids

    def encode_whole(self, text: str) -> np.ndarray:
        """Ids the library gives for ``text`` in one piece."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, and where each text's ids start (one more entry than texts)."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = words.flatten().dictionary_encode()
        at, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        ids = list(map(self.words.get, distinct))
        if len(self.words) > WORD_ENTRIES:
            # The older half goes, but for what the texts still use.
            self.words = dict(islice(self.words.items(), WORD_ENTRIES // 2, None))
        known, learn = self.words, self._word
        for k, found in enumerate(ids):
            if found is None:
                word = distinct[k]
                ids[k] = found = learn(word)
                if len(word) <= LONGEST_KEPT:
                    known[word] = found
        pool = np.frombuffer(b"".join(ids), np.uint32)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        each = size[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        place = np.repeat(start[at] - ends[:-1], each) + np.arange(ends[-1])
        bounds = words.offsets.to_numpy()
        return pool[place], ends[bounds - bounds[0]]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ``ids``, special tokens included, as the library decodes."""
        if self.library.decoder is not None:
            return self.library.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def rolling_marks(data: np.ndarray) -> np.ndarray:
    """Bytes at which the hash of the last ``HASH_WINDOW`` bytes ends in ``HASH_BITS`` zeros.

    A gear hash: each byte's number is shifted once per later byte and falls out of the
    32-bit sum's marked bits after the window. Each doubling sums twice as many bytes.
    """
    gear = (np.arange(256, dtype=np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)
    sums = ((gear ^ (gear >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)[data]
    span = 1
    while span < HASH_WINDOW:
        wider = sums.copy()
        wider[span:] += sums[:-span] << np.uint32(span)
        sums, span = wider, 2 * span
    return np.flatnonzero(sums >> np.uint32(32 - HASH_BITS) == 0)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of a text.

    A chunk ends at the first white space or seam at or after a mark, so equal passages give
    equal chunks wherever they stand, but for those at their ends. A mark with neither within
    four mean chunks ends none: such a run is one piece, encoded once.
    """
    if len(data) < 1 << HASH_BITS:
        return [len(data)] if data else []
    ends, reach = [], 4 << HASH_BITS
    for mark in rolling_marks(np.frombuffer(data, np.uint8)).tolist():
        if ends and mark < ends[-1]:
            continue
        found = _BREAK.search(data, mark, mark + reach)
        end = found.start() if found else 0
        if end and (not ends or end > ends[-1]) and end < len(data):
            ends.append(end)
    return [*ends, len(data)]


class ChunkCoder:
    """Encodes each distinct chunk once, and repairs the joins of the chunks.

    Chunks live in two generations of at most ``CHUNK_BYTES_KEPT`` bytes; a chunk that is
    met again moves to the younger one.
    """

    def __init__(self, encoder: WordEncoder):
        self.encoder = encoder
        self.young: dict[bytes, tuple[np.ndarray, bytes]] = {}
        self.old: dict[bytes, tuple[np.ndarray, bytes]] = {}
        self.held = 0
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        self.join_bytes = 0

    def _keep(self, chunk: bytes, coded: tuple[np.ndarray, bytes]) -> None:
        if self.held > CHUNK_BYTES_KEPT:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[chunk] = coded
        self.held += len(chunk)

    def code(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, SHA-256 of the ids, SHA-256 of the decoded text."""
        cut = []
        for text in texts:
            data = (text or "").encode()
            ends = chunk_ends(data)
            cut.append([data[a:b] for a, b in zip([0, *ends], ends)])
        used: dict[bytes, tuple[np.ndarray, bytes]] = {}
        for chunk in {c for chunks in cut for c in chunks}:
            coded = self.young.get(chunk)
            if coded is None and (coded := self.old.get(chunk)) is not None:
                self._keep(chunk, coded)
            if coded is not None:
                used[chunk] = coded
        new = [c for c in dict.fromkeys(c for chunks in cut for c in chunks) if c not in used]
        if new:
            ids, bounds = self.encoder.encode(pa.array([c.decode() for c in new]))
            for chunk, a, b in zip(new, bounds[:-1], bounds[1:]):
                own = ids[a:b].copy()
                used[chunk] = own, self.encoder.decode(own).encode()
                self._keep(chunk, used[chunk])
        return [self._digest(chunks, used) for chunks in cut]

    def _digest(self, chunks: list[bytes], used: dict) -> tuple[int, str, str]:
        total, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        for ids, decoded in self.joined(chunks, used):
            if len(ids):
                if total:
                    text_hash.update(b" ")
                ids_hash.update(ids.tobytes())
                text_hash.update(decoded)
                total += len(ids)
        return total, ids_hash.hexdigest(), text_hash.hexdigest()

    def joined(self, chunks: list[bytes], used: dict) -> list[tuple[np.ndarray, bytes]]:
        """The coded chunks of a text, with the joins repaired.

        At each join the ends of both sides are encoded in one piece. If that agrees with the
        ends' own ids, the join stands. Chunks whose joins do not are taken together, a whole
        run of them at once, and encoded anew as one; until all joins agree.
        """
        pieces = [(chunk, *used[chunk]) for chunk in chunks]
        while True:
            groups: list[list[tuple[bytes, np.ndarray, bytes]]] = []
            for piece in pieces:
                if groups and not self._agrees(groups[-1][-1][0], piece[0]):
                    groups[-1].append(piece)
                else:
                    groups.append([piece])
            if len(groups) == len(pieces):
                return [(ids, decoded) for _, ids, decoded in pieces]
            pieces = [group[0] if len(group) == 1 else self._anew(group) for group in groups]

    def _anew(self, group: list[tuple[bytes, np.ndarray, bytes]]) -> tuple[bytes, np.ndarray, bytes]:
        whole = b"".join(chunk for chunk, _, _ in group)
        ids = self.encoder.encode_whole(whole.decode())
        return whole, ids, self.encoder.decode(ids).encode()

    def _agrees(self, left: bytes, right: bytes) -> bool:
        """Whether what follows the last cut of ``left``, and what precedes the first of
        ``right``, keep their ids side by side."""
        start, tail = 0, TAIL
        while tail // 4 < len(left):
            # From before the tail, since a seam is known by the byte in front of it.
            cuts = [m.end() for m in _BREAK.finditer(left, max(len(left) - tail, 0)) if m.end() < len(left) or m.end() > m.start()]
            if cuts:
                start = cuts[-1]
                break
            tail *= 4
        found = _BREAK.search(right, 1)
        before, after = left[start:], right[: found.start() if found else len(right)]
        key = before, after
        held = self.joins.get(key)
        if held is None:
            encode = self.encoder.encode_whole
            apart = np.concatenate([encode(before.decode()), encode(after.decode())])
            held = np.array_equal(apart, encode((before + after).decode()))
            if self.join_bytes > JOIN_BYTES_KEPT:
                self.joins.clear()
                self.join_bytes = 0
            self.joins[key] = held
            self.join_bytes += len(before) + len(after)
        return held


def encode_and_decode(
    docs: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of their texts.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded
    text in UTF-8. A null text counts as empty: no ids, the digests of nothing. Rows are
    kept as they are, repeated ones too; columns of these names are replaced; an empty table
    gives an empty table. Texts of any length are encoded whole, in time in proportion, with
    or without white space. No shuffle: chunks are shared by the documents a worker process
    meets.
    """
    path = path or public_tokenizers.path(WORDS)

    def make():
        coder = per_process(("chunks", path), lambda: ChunkCoder(word_encoder(path)))

        def compute(texts: pa.Array) -> list[pa.Array]:
            found = coder.code(texts.to_pylist())
            return [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.string()),
                pa.array([f[2] for f in found], pa.string()),
            ]

        return compute

    fields = [
        StructField("n_tokens", LongType()),
        StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()),
    ]
    return append_columns(docs, text, fields, make, keep)


def word_encoder(path: str) -> WordEncoder:
    """The worker process's encoder for a vocabulary file."""
    return per_process(("words", path), lambda: WordEncoder(path))
