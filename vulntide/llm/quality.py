"""Quality rules that clean line by line before they judge the document."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StringType, StructField

from .workers import WORD, FlatText, append_columns, mix

# Base rules.
LEAST_WORDS = 10
WINDOW = 5
MOST_REPEATED = 20  # per cent of the words

# Line rules; a line without words never fails.
SEPARATORS = b"|>"
MOST_SEPARATORS = 0.2  # per word, from three separators
SYMBOLS = b"#*$%&<|>"
MOST_SYMBOLS = 0.5  # per word
MOST_CAPITALS = 0.8  # of at least twenty letters
CAPITALS_FROM = 20
LONG_LINE = 3  # words from which a line has to hold the end of a sentence or clause
LINE_ENDS = b".!?:;,\"')]}"
WIDE_ENDS = ("…", "”", "’", "»", "。", "！", "？", "」")
# Menus down the page: so many lines on end, each of few words and bytes, or without an end.
MENU_LINES = 4
MENU_BYTES = 40
SHORT_ENDS = b".!?:;\"'"
# Menus along a line: so many items of few words, between marks that end no sentence.
MENU_ITEMS = 4
WEAK_ENDS = b",;:()[]{}"
_ITEMS = re.compile(r"[,;:()\[\]{}]+")

# A document goes if it loses more than this share of its words, one short notice aside.
MOST_LOST = 0.5
EXEMPT_WORDS = 20  # of the line with the most words of notices

# Phrases of notices, menus and licences.
BOILERPLATE = (
    r"licensed under|released under the|all rights reserved|copyright (©|\(c\)|\d{4})|"
    r"terms of (use|service)|privacy policy|cookie policy|uses cookies|accept cookies|"
    r"enable javascript|lorem ipsum|click here to|sign up for our|subscribe to our|"
    r"log in to (comment|reply)|skip to (main )?content|powered by wordpress"
)
_BOILERPLATE = re.compile(BOILERPLATE, re.IGNORECASE)
NOTICE_START = 12  # a sentence that names a phrase after so many words is prose about it
_SENTENCE = re.compile(r"\S.*?(?:[.!?…](?=\s)\s*|[。！？]\s*|\Z)", re.DOTALL)
_WORDS = re.compile(WORD)
_COUNTED = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


class Lines:
    """The ``\\n``-split lines of a batch: their bounds, documents and word ranges."""

    def __init__(self, flat: FlatText):
        feeds = np.flatnonzero(flat.bytes == 10)
        self.start = np.sort(np.concatenate([flat.offsets[:-1], feeds + 1]))
        self.end = np.sort(np.concatenate([flat.offsets[1:], feeds]))
        self.doc = np.repeat(np.arange(len(flat)), flat.per_doc(flat.bytes == 10) + 1)
        self.low = np.searchsorted(flat.first, self.start)
        self.high = np.searchsorted(flat.first, self.end)
        self.words = self.high - self.low


def repeated_words(flat: FlatText) -> np.ndarray:
    """Per document: words in windows of ``WINDOW`` words that the text holds twice or more."""
    hashes, at = flat.window_hashes(WINDOW)
    keys = mix(hashes + mix(flat.word_doc()[at].astype(np.uint64)))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    steps = np.zeros(len(flat.first) + 1, np.int64)
    if len(twice):
        found = at[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]
        np.add.at(steps, found, 1)
        np.add.at(steps, found + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(steps)[:-1] > 0)])
    return np.diff(covered[flat.doc_first])


def duplicate_lines(flat: FlatText, lines: Lines) -> np.ndarray:
    """Per document: lines with a word that equal an earlier line."""
    at = np.flatnonzero(lines.words)
    keys = mix(flat.span_hashes(lines.start[at], lines.end[at]) + mix(lines.doc[at].astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    again = order[1:][keys[order][1:] == keys[order][:-1]]
    return np.bincount(lines.doc[at[again]], minlength=len(flat))


def without_notices(line: str) -> str:
    """The line without the sentences that are notices.

    A notice holds a phrase of ``BOILERPLATE`` that starts in its first ``NOTICE_START``
    words; the other sentences of the line stay.
    """
    if not _BOILERPLATE.search(line):
        return line
    found, cut = [sentence[0] for sentence in _SENTENCE.finditer(line)], False
    stay = []
    for sentence in found:
        phrase = _BOILERPLATE.search(sentence)
        if phrase and len(sentence[: phrase.start()].split()) < NOTICE_START:
            cut = True
        else:
            stay.append(sentence)
    return "".join(stay).rstrip() if cut else line


def _line(flat: FlatText, lines: Lines, k: int) -> str:
    return flat.bytes[lines.start[k] : lines.end[k]].tobytes().decode()


def _last_bytes(flat: FlatText, lines: Lines) -> np.ndarray:
    """The last byte of each line's last word (0: no words)."""
    out = np.zeros(len(lines.words), np.uint8)
    at = np.flatnonzero(lines.words)
    out[at] = flat.bytes[flat.last[lines.high[at] - 1] - 1]
    return out


def menu_items(flat: FlatText, lines: Lines, marks: np.ndarray) -> np.ndarray:
    """Lines of ``MENU_ITEMS`` items or more, none with ``LONG_LINE`` words, and no sentence's end."""
    found = (marks >= MENU_ITEMS - 1) & (lines.words < LONG_LINE * (marks + 1))
    found &= ~np.isin(_last_bytes(flat, lines), np.frombuffer(b".!?", np.uint8))
    for k in np.flatnonzero(found):
        line = _line(flat, lines, k)
        items = [len(item.split()) for item in _ITEMS.split(line) if item.strip()]
        found[k] = len(items) >= MENU_ITEMS and max(items) < LONG_LINE and not line.rstrip().endswith(WIDE_ENDS)
    return found


def menu_runs(flat: FlatText, lines: Lines, fails: np.ndarray) -> np.ndarray:
    """Short lines without an end in a run of ``MENU_LINES`` or more such or failed lines."""
    at = np.flatnonzero(lines.words)  # empty lines part no run
    last = _last_bytes(flat, lines)[at]
    short = (lines.words[at] < LONG_LINE) & (lines.end[at] - lines.start[at] <= MENU_BYTES)
    short &= ~np.isin(last, np.frombuffer(SHORT_ENDS, np.uint8))
    for k in np.flatnonzero(short & (last >= 128)):
        short[k] = not _line(flat, lines, at[k]).rstrip().endswith(WIDE_ENDS)
    member = short | fails[at]
    starts = np.ones(len(at), bool)
    starts[1:] = (member[1:] != member[:-1]) | (lines.doc[at][1:] != lines.doc[at][:-1])
    run = np.cumsum(starts) - 1
    out = np.zeros(len(fails), bool)
    out[at] = short & (np.bincount(run)[run] >= MENU_LINES) if len(at) else False
    return out


def failed_lines(
    flat: FlatText, lines: Lines, texts: pa.Array
) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """Lines that break a rule, the words of notices in each other line, and what those leave.

    A line fails without any end of a sentence or clause, as a menu or as part of one, by its
    symbols or by its capitals. Notices (licences, rights, cookies) are cut as well, sentence by sentence. A
    line of notices alone never fails.
    """
    b = flat.bytes

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[lines.end] - total[lines.start]

    def among(values: bytes) -> np.ndarray:
        return np.isin(np.arange(256), np.frombuffer(values, np.uint8))[b]

    separators, symbols = per_line(among(SEPARATORS)), per_line(among(SYMBOLS))
    after_c3 = np.concatenate([[False], b[:-1] == 0xC3]) if len(b) else np.zeros(0, bool)
    upper = ((b >= 65) & (b <= 90)) | (after_c3 & (b <= 0x9E))
    lower = ((b >= 97) & (b <= 122)) | (after_c3 & (b > 0x9E))
    capitals, small = per_line(upper), per_line(lower)
    letters = capitals + small

    spoken = lines.words > 0
    closing = np.concatenate([[0], np.cumsum(among(LINE_ENDS)[flat.last - 1])])
    closes = closing[lines.high] > closing[lines.low]
    for k in np.flatnonzero(spoken & ~closes & (lines.words >= LONG_LINE)):
        line = b[lines.start[k] : lines.end[k]].tobytes().decode()
        closes[k] = any(word.endswith(WIDE_ENDS) for word in line.split())

    fails = spoken & ~closes & (lines.words >= LONG_LINE)
    fails |= menu_items(flat, lines, per_line(among(WEAK_ENDS)))
    fails |= menu_runs(flat, lines, fails)
    fails |= (separators >= 3) & (separators > MOST_SEPARATORS * lines.words)
    fails |= spoken & (symbols > MOST_SYMBOLS * lines.words)
    fails |= (letters >= CAPITALS_FROM) & (capitals > MOST_CAPITALS * letters)
    fails &= spoken
    notices, left = np.zeros(len(fails), np.int64), {}
    suspects = pc.fill_null(pc.match_substring_regex(texts, BOILERPLATE, ignore_case=True), False)
    for doc in np.flatnonzero(suspects.to_numpy(zero_copy_only=False)):
        for k in range(*np.searchsorted(lines.doc, [doc, doc + 1])):
            line = _line(flat, lines, k)
            rest = without_notices(line)
            if rest != line and not (fails[k] and rest):
                notices[k] = lines.words[k] - len(_WORDS.findall(rest))
                fails[k], left[k] = False, rest
    return fails, notices, left


def apply_rules(
    docs: DataFrame, text: str = "text", clean: str | None = "clean_text", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with the rules' figures, ``base_failed``, ``kept``, and the cleaned text.

    New columns: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words,
    base_failed, kept``, and ``clean`` (null: not wanted), the text without the lines that
    break a rule. A document fails the base rules with fewer than ``LEAST_WORDS`` words or
    more than ``MOST_REPEATED`` per cent of them in repeated windows; it is kept if it passes
    them, has words left, and loses no more than ``MOST_LOST`` of its words to failed lines and
    notices, up to ``EXEMPT_WORDS`` of one line's notices aside. A null text has no words, so it fails, and its cleaned text is empty.
    Rows are judged alone: repeated rows get equal verdicts, an empty table stays empty.
    No shuffle; columns of the new names are replaced.
    """

    def make():
        def compute(texts: pa.Array) -> list[pa.Array]:
            texts = texts.cast(pa.string())
            flat = FlatText(texts)
            lines = Lines(flat)
            words = np.diff(flat.doc_first)
            chars = flat.per_doc(~flat.space & (flat.bytes & 0xC0 != 0x80))
            repeats = repeated_words(flat)
            faults, notices, left = failed_lines(flat, lines, texts)
            faulty, noticed = (
                np.bincount(lines.doc, weights=some, minlength=len(flat)).astype(np.int64)
                for some in (lines.words * faults, notices)
            )
            lost, exempt = faulty + noticed, np.zeros(len(flat), np.int64)
            np.maximum.at(exempt, lines.doc, np.minimum(notices, EXEMPT_WORDS))
            own = words - exempt
            base = (words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * words)
            kept = ~base & (lost - exempt <= MOST_LOST * own) & (words > lost)
            out = [
                pa.array(n.astype(np.int64))
                for n in (words, chars, flat.per_doc(_COUNTED[flat.bytes]), duplicate_lines(flat, lines), repeats, lost)
            ]
            out += [pa.array(base), pa.array(kept)]
            if clean:
                out.append(pa.array(_without(flat, lines, faults, left), pa.string()))
            return out

        return compute

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words"]
    fields = [StructField(name, LongType()) for name in counts]
    fields += [StructField(name, BooleanType()) for name in ("base_failed", "kept")]
    if clean:
        fields.append(StructField(clean, StringType()))
    return append_columns(docs, text, fields, make, keep)


def _without(flat: FlatText, lines: Lines, failed: np.ndarray, left: dict[int, str]) -> list[str]:
    """The texts without their failed lines and notices; ``left`` has what notices leave of a line."""
    data = flat.bytes.tobytes()
    bounds = np.searchsorted(lines.doc, np.arange(len(flat) + 1))
    touched = failed.copy()
    touched[list(left)] = True
    spoiled = np.add.reduceat(np.append(touched, False), bounds[:-1]) if len(flat) else []
    out = []
    for doc, (a, z) in enumerate(zip(bounds[:-1], bounds[1:])):
        if not spoiled[doc]:
            out.append(data[flat.offsets[doc] : flat.offsets[doc + 1]].decode())
        else:
            stay = [k for k in range(a, z) if not failed[k] and left.get(k, " ")]
            parts = (left[k].encode() if k in left else data[lines.start[k] : lines.end[k]] for k in stay)
            out.append(b"\n".join(parts).decode())
    return out
