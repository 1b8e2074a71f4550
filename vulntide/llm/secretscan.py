"""Secrets in texts: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from .findings import labelled_findings
from .workers import append_columns

# The bound of the training sample, and the forest.
SAMPLE_ROWS = 20_000
TREES = 30
DEPTH = 8
SEED = 2_718
LEAST_VOTE = 0.5

MASK = "[SECRET]"
CONTEXT = 48

_NAMES = r"passw(?:or)?d|passwd|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key"
# A text without any of these holds no candidate.
_WORTH = f"[0-9]|PRIVATE KEY|(?i:{_NAMES})"
_LONG = r"(?<![A-Za-z0-9+/_\-])(?P<run>[A-Za-z0-9+/_\-]{16,}={0,2})"
_ASSIGNED = (
    rf"(?i:{_NAMES})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?"
    r"(?P<value>[^\s\"'<>,;]{8,})"
)
# A private-key block ends where its alphabet does: header lines and chunks of base 64. A last
# short chunk belongs to it if the block or the text ends there.
_BREAK = r"(?:\s|\\[nr])"
_HEADER = r"(?:Proc-Type|DEK-Info|Comment|Version): [^\n\\]*"
_CHUNK = rf"[A-Za-z0-9+/]{{16,}}={{0,2}}(?={_BREAK}|-----|\Z)"
_PEM = (
    rf"(?P<pem>-----BEGIN [A-Z ]*PRIVATE KEY-----(?P<body>(?:{_BREAK}+(?:{_HEADER}|{_CHUNK}))*"
    rf"(?:{_BREAK}+[A-Za-z0-9+/=]{{1,76}}(?={_BREAK}*(?:-----END|\Z)))?)"
    rf"(?:{_BREAK}*-----END [A-Z ]*PRIVATE KEY-----)?)"
)
_CANDIDATE = re.compile(f"{_PEM}|{_ASSIGNED}|{_LONG}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")

_KEYWORD = re.compile(
    r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth\w*|bearer|credentials?)"
    r"[\"']?\s*[:=]?\s*[\"']?$"
)
_HARMLESS = re.compile(r"(?:commit|sha\d*|md5|checksum|digest|integrity|etag|uuid|guid|revision|blob|base64,|merge|version|isbn|id)\W{0,3}$")
_PREFIX = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|ghs_|sk_live_|sk-|xox[abp]-|AIza|eyJ|glpat-|npm_)")
_BLOCK = re.compile(r"begin [a-z ]*private key-----\s*$")
_PLACE = re.compile(r"(?:[/\\]|https?:|www\.)")

# Words that identifiers, paths and placeholders are made of.
_WORDS = sorted(
    set(
        "about access account action address admin after agent alert allow answer api app apple array asset async auth "
        "back base batch block board body book bool branch build button byte cache call card case chain change char "
        "check child class clear click client clock close code color column commit common config connect content "
        "control copy core count create current data date debug default delete demo detail device dialog document "
        "domain down draft edit element email empty enable error event example export field file filter find first "
        "folder font form format frame from function global graph group handle hash head height help here hidden home "
        "host html icon image import index info init input insert item java join json label language last layer left "
        "length level library light limit line link list load local lock log login main manager map mark match max "
        "media member menu message meta method min mode model module month mouse move name network next node none note "
        "null number object open option order other output owner package page panel param parent part password path "
        "pattern place player please point port position post power print private process product profile project "
        "property proxy public query queue random range read record region release remote render report request reset "
        "result return right root route row rule sample save scale schema scope score screen script search second "
        "section select sender server service session set setting shape share show side sign simple site size sort "
        "source space spec stack start state static status step stop store stream string style submit success support "
        "system table target task team temp template test text theme thread time title token tool total track type "
        "unit update upload user util value version video view web week width window word work world write year your "
        "the and for not you all can has was one our out day get him his how its may new now old see two who did".split()
    ),
    key=len,
    reverse=True,
)
_DICTIONARY = re.compile("|".join(w for w in _WORDS if len(w) > 2))


def features(before: str, candidate: str, after: str) -> list[float]:
    """What the forest sees of a candidate: length, characters, dictionary, path, neighbours."""
    n = len(candidate)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in candidate]
    share = Counter(kinds)
    letters = Counter(candidate)
    low = candidate.lower()
    near = before[-CONTEXT:].lower()
    entropy = -sum(k / n * math.log2(k / n) for k in letters.values())
    return [
        float(min(n, 200)),
        share["d"] / n,
        share["u"] / n,
        share["s"] / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(n - 1, 1),
        entropy,
        len(letters) / n,
        max(letters.values()) / n,
        float(all(c in "0123456789abcdef" for c in low)),
        sum(map(len, _DICTIONARY.findall(low))) / n,
        float(candidate.count("/")),
        float(bool(_PLACE.search(before[-12:]) or after[:1] in "/\\" and after[:1] or re.match(r"\.[a-z]{2,4}\b", after))),
        float(bool(_KEYWORD.search(near))),
        float(bool(_HARMLESS.search(near))),
        float(before[-1:] in "\"'" and before[-1:] != ""),
        float(bool(_PREFIX.match(candidate))),
        float(bool(_BLOCK.search(near))),
    ]


class Forest:
    """The trees of a trained forest as arrays, to score candidates inside a task."""

    def __init__(self, trees: list[list[tuple[int, float, int, int, float]]]):
        self.trees = [tuple(np.array(column) for column in zip(*nodes)) for nodes in trees]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Mean over the trees of a leaf's share of secrets."""
        total = np.zeros(len(rows))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(rows), int)
            while (inner := feature[at] >= 0).any():
                rise = rows[np.arange(len(rows)), np.maximum(feature[at], 0)] > threshold[at]
                at = np.where(inner, np.where(rise, right[at], left[at]), at)
            total += share[at]
        return total / len(self.trees)


def train(findings: DataFrame, sample: int = SAMPLE_ROWS, seed: int = SEED) -> Forest:
    """A random forest from ``before, candidate, after, is_secret``.

    At most ``sample`` findings are used, the first by a hash of their text, so the sample
    and the forest are the same whatever the order of the rows. Findings with a null
    candidate or label are left out.
    """
    known = findings.where("candidate <> '' and is_secret is not null").select(
        F.coalesce("before", F.lit("")), "candidate", F.coalesce("after", F.lit("")), F.col("is_secret").cast("int")
    )
    chosen = known.orderBy(F.xxhash64(*known.columns), *known.columns).limit(sample).collect()
    spark = findings.sparkSession
    rows = [(Vectors.dense(features(b, c, a)), float(y)) for b, c, a, y in chosen]
    data = spark.createDataFrame(rows, ["features", "label"]).coalesce(1)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, subsamplingRate=0.8)
    return Forest([_nodes(tree._java_obj.rootNode()) for tree in forest.fit(data).trees])


def _nodes(root) -> list[tuple[int, float, int, int, float]]:
    """A tree's nodes: feature (-1: leaf), threshold, left, right, share of secrets."""
    out: list = []

    def add(node) -> int:
        at = len(out)
        out.append(None)
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            out[at] = (-1, 0.0, at, at, stats[1] / sum(stats) if len(stats) > 1 else 0.0)
        else:
            split = node.split()
            left, right = add(node.leftChild()), add(node.rightChild())
            out[at] = (split.featureIndex(), split.threshold(), left, right, 0.0)
        return at

    add(root)
    return out


def candidates(text: str) -> Iterator[tuple[tuple[int, int], int, str]]:
    """Span of each candidate, where the part to be judged starts, and that part.

    A run without a digit or without a letter is none, however long it is; what stands
    inside it may still be one.
    """
    at = 0
    while found := _CANDIDATE.search(text, at):
        at = found.end()
        if found["value"]:
            yield found.span("value"), found.start("value"), found["value"]
        elif found["pem"]:
            if found["body"]:
                yield found.span(), found.start("body"), "".join(found["body"].replace("\\n", " ").split())
        elif _DIGIT.search(found["run"]) and _LETTER.search(found["run"]):
            yield found.span(), found.start(), found["run"]
        else:
            at = found.start() + 1


def scan(forest: Forest, text: str) -> tuple[int, list[tuple[int, int]]]:
    """Number of candidates of a text, and the spans of those that are secrets."""
    spans, rows = [], []
    for (a, z), start, judged in candidates(text):
        spans.append((a, z))
        rows.append(features(text[max(start - CONTEXT, 0) : start], judged, text[z : z + 16]))
    if not spans:
        return 0, []
    votes = forest.score(np.array(rows)) >= LEAST_VOTE
    return len(spans), [s for s, vote in zip(spans, votes) if vote]


def redacted(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, z in spans:
        out += [text[at:a], MASK]
        at = z
    return "".join(out) + text[at:]


def scan_secrets(
    docs: DataFrame,
    text: str = "text",
    findings: DataFrame | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``n_candidates, n_secrets, secrets`` and ``redacted_text``.

    Candidates are private-key blocks, values assigned to a key's name, and long runs of
    letters and digits; the forest, trained on ``findings``, removes the false ones. Texts and
    candidates of any length are searched and judged whole. A block ends where its alphabet
    ends, so prose that names one loses nothing.
    ``secrets`` lists the spans as ``start-end`` (code points), parted by commas. A null
    text has no candidates and an empty redacted text. Repeated rows get equal results; an
    empty table stays empty; columns of the new names are replaced. No shuffle: the trained
    forest is a few thousand numbers and travels with the task.
    """
    forest = train(findings if findings is not None else labelled_findings(docs.sparkSession))

    def make():
        def compute(texts: pa.Array) -> list[pa.Array]:
            texts = pc.fill_null(texts.cast(pa.string()), "")
            worth = pc.match_substring_regex(texts, _WORTH).to_numpy(zero_copy_only=False)
            counts, secrets, spans = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [""] * len(texts)
            clean = texts.to_pylist()
            for k in np.flatnonzero(worth):
                counts[k], found = scan(forest, clean[k])
                secrets[k] = len(found)
                if found:
                    spans[k] = ",".join(f"{a}-{z}" for a, z in found)
                    clean[k] = redacted(clean[k], found)
            return [pa.array(counts), pa.array(secrets), pa.array(spans, pa.string()), pa.array(clean, pa.string())]

        return compute

    fields = [
        StructField("n_candidates", LongType()),
        StructField("n_secrets", LongType()),
        StructField("secrets", StringType()),
        StructField("redacted_text", StringType()),
    ]
    return append_columns(docs, text, fields, make, keep)
