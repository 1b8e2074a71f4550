"""Token counts with a whole-token shortcut."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField

from .workers import append_columns, per_process

PIECES = "piece_bpe_32k.model"
LIMIT = 4096

MARK = "▁"  # stands for a space in the vocabulary
TABLE_ENTRIES = 400_000
LONGEST_KEPT = 64

_NORMAL, _USER_DEFINED = 1, 4
_RUN = re.compile(rf"[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+|\n")


class TokenCounter:
    """Counts of the pieces the library gives, word by word.

    The vocabulary proves the cuts: no piece holds a space mark behind another character,
    and none holds a line feed, so no merge ever reaches over the start of a run of spaces
    or over a line feed, and the tokens of a text are those of its parts. It also proves
    the shortcut: a vocabulary string that the library, alone, gives back as one token
    counts one wherever it stands as a part. Only the other parts are merged.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as messages

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = messages.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        pieces = [p.piece for p in model.pieces if p.type in (_NORMAL, _USER_DEFINED)]
        rules = model.normalizer_spec
        plain = (
            rules.name == "identity"
            and not rules.precompiled_charsmap
            and rules.add_dummy_prefix
            and rules.escape_whitespaces
            and not rules.remove_extra_whitespaces
            and not any(p.type == _USER_DEFINED for p in model.pieces)
        )
        self.splits = plain and not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)
        words = [p[1:] for p in pieces if p[:1] == MARK and len(p) > 1 and MARK not in p[1:]]
        inner = [p for p in pieces if MARK not in p]
        self.feed = len(self.library.encode("\n"))
        # Proven whole tokens, after a space and at the start of a line.
        self.after_space = {w: 1 for w, n in self._spaced(words).items() if n == 1}
        self.after_line = {w: 1 for w, n in self._bare(inner).items() if n == 1}
        self.proven = len(self.after_space), len(self.after_line)

    def _spaced(self, words: list[str]) -> dict[str, int]:
        """Tokens of each word behind a space; the empty word is that space alone."""
        found = dict(zip(words, map(len, self.library.encode(words, num_threads=1))))
        return found | {"": 1} if "" in found else found

    def _bare(self, words: list[str]) -> dict[str, int]:
        found = self.library.encode(["\n" + w for w in words], num_threads=1)
        return {w: len(ids) - self.feed for w, ids in zip(words, found)}

    def _look_up(self, table: dict[str, int], words: list[str], count) -> np.ndarray:
        """Counts of distinct ``words``; those the table lacks are merged and remembered."""
        counts = list(map(table.get, words))
        missing = [w for w, n in zip(words, counts) if n is None]
        if missing:
            found = count(missing)
            if len(table) > TABLE_ENTRIES:
                for word in list(table)[self.proven[table is self.after_line] :]:
                    del table[word]
            table.update((w, n) for w, n in found.items() if len(w) <= LONGEST_KEPT)
            counts = [found[w] if n is None else n for w, n in zip(words, counts)]
        return np.array(counts, np.int64)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.splits:
            return np.array([len(self.library.encode(t)) for t in texts.to_pylist()], np.int64)
        odd = pc.match_substring_regex(texts, f"^ |  |{MARK}").to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        for k in np.flatnonzero(odd):
            out[k] = self._irregular(texts[int(k)].as_py())
        rest = np.flatnonzero(~odd & (pc.binary_length(texts).to_numpy() > 0))
        if len(rest):
            out[rest] = self._regular(texts.take(pa.array(rest)))
        return out

    def _regular(self, texts: pa.Array) -> np.ndarray:
        """Tokens of texts in which spaces stand alone: one part per space."""
        lines = pc.split_pattern(texts, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        coded = words.flatten().dictionary_encode()
        at, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        line_of_doc, word_of_line = lines.offsets.to_numpy(), words.offsets.to_numpy()
        word_of_line = word_of_line - word_of_line[0]
        line_of_doc = line_of_doc - line_of_doc[0]
        bare = np.zeros(len(at), bool)
        bare[word_of_line[:-1]] = True
        bare[word_of_line[line_of_doc[:-1]]] = False  # the library puts a space before a text
        counts = np.zeros(len(at), np.int64)
        for table, count, where in (
            (self.after_space, self._spaced, ~bare),
            (self.after_line, self._bare, bare),
        ):
            used = np.flatnonzero(np.bincount(at[where], minlength=len(distinct)))
            found = np.zeros(len(distinct), np.int64)
            found[used] = self._look_up(table, [distinct[k] for k in used], count)
            counts[where] = found[at[where]]
        sums = np.concatenate([[0], np.cumsum(counts)])[word_of_line[line_of_doc]]
        return np.diff(sums) + np.diff(line_of_doc) - 1

    def _irregular(self, text: str) -> int:
        runs = _RUN.findall(" " + text)
        known, place = np.unique(np.array([r for r in runs if r != "\n"], object), return_inverse=True)
        counts = self._look_up(self.after_line, list(known), self._bare)
        return int(counts[place].sum()) + runs.count("\n")


def count_tokens(
    docs: DataFrame,
    text: str = "text",
    path: str | None = None,
    limit: int = LIMIT,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``).

    A null text counts as empty: no bytes, no tokens. Rows are kept as they are, repeated
    ones too; an empty table gives an empty table. Columns of these names are replaced.
    No shuffle: each task keeps a bounded table of the parts it has merged.
    """
    path = path or public_tokenizers.path(PIECES)

    def make():
        counter = per_process(("counter", path), lambda: TokenCounter(path))

        def compute(texts: pa.Array) -> list[pa.Array]:
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n = counter(texts)
            return [size, pa.array(n), pa.array(n > limit)]

        return compute

    fields = [
        StructField("n_bytes", LongType()),
        StructField("n_tokens", LongType()),
        StructField("over_limit", BooleanType()),
    ]
    return append_columns(docs, text, fields, make, keep)
