"""Main text of web pages by deducing each host's template from equivalence classes."""

from __future__ import annotations

import hashlib
import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .workers import bounded_batches

# Share of a host's pages that a template token has to occur in.
LEAST_SUPPORT = 0.5
# Share of a slot's characters in links from which it is a menu.
MOST_LINKED = 0.5

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title|select|object|canvas)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MAY_HIDE = re.compile(r"hidden|none", re.IGNORECASE)
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)
# Class names that tell a state of the layout, not what the element is.
_STATE = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without|is|hide|show)[-_]\S+", re.IGNORECASE)

# Elements of the markup language, by what they mean here.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
_OUTSIDE = frozenset("head nav header footer aside form button dialog menu input label".split())
_SLOTS = _BLOCKS - {"br", "hr", "html"}
_MAIN = frozenset(("article", "main"))
_CLOSES = {  # an open element that a new one of this name ends
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}

# Words of class, id and role values that name what is not the article.
_ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"overlay|sidebar|side|widget|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|comments?|replies|"
    r"respond|discussion|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|"
    r"complementary|contentinfo|pagination|toolbar|skip)(?=$|[\s_-])",
    re.IGNORECASE,
)
# Of these, what an article's own heading may be called, and what an article may not be.
_HEADING = re.compile(r"(?:^|[\s_-])(?:header|masthead|banner)(?=$|[\s_-])", re.IGNORECASE)
_NO_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:comments?|replies|respond|related|recommended|ads?|advert\w*|sponsor\w*|promo\w*|widget)(?=$|[\s_-])",
    re.IGNORECASE,
)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_BY_MARK, _BY_NAME = 1, 2  # why an element is outside
_MAIN_ROLE = re.compile(r"(?:^|\s)(?:main|article)(?:$|\s)", re.IGNORECASE)


def _hidden(attributes: str) -> bool:
    """Whether a tag has the attribute ``hidden`` or the style ``display: none``."""
    if not _MAY_HIDE.search(attributes):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden" or name.lower() == "style" and _NOT_SHOWN.search("".join(values)):
            return True
    return False


def _says_aside(name: str, marks: list[tuple[str, str]], main: bool) -> bool:
    """Whether classes, id or role name something that is not the article.

    In an article an id is often a heading's words, so there it counts only as a whole, and
    on headings not at all.
    """
    for kind, value in marks:
        if kind == "id" and main:
            if name not in _HEADINGS and (found := _ASIDE.match(value)) and found.end() == len(value):
                return True
            continue
        value = _STATE.sub(" ", value) if kind == "class" else value
        if _ASIDE.search(_HEADING.sub(" ", value) if main else value):
            return True
    return False


class Segment:
    """A run of text: its path of open elements, that of the marked article, and whether it starts a block."""

    __slots__ = ("path", "text", "outside", "main", "linked", "breaks")

    def __init__(self, path: str, text: str, outside: bool, main: str, linked: bool, breaks: bool):
        self.path, self.text, self.outside = path, text, outside
        self.main, self.linked, self.breaks = main, linked, breaks


def parsed(page: str) -> tuple[list[str], list[Segment]]:
    """The tag tokens of a page, each told apart by its path, and its texts in order."""
    tags: list[str] = []
    segments: list[Segment] = []
    # Open elements: name, path, outside the article, path of the main part, in a link.
    stack: list[tuple[str, str, int, str, bool]] = [("", "", 0, "", False)]
    breaks, at = True, 0

    def text(upto: int) -> None:
        nonlocal breaks
        run = page[at:upto]
        if run.strip():
            _, path, outside, main, linked = stack[-1]
            segments.append(Segment(path, references.unescape(run), outside > 0, main, linked, breaks))
            breaks = False
        elif run and segments and not breaks:
            _, path, outside, main, linked = stack[-1]
            segments.append(Segment(path, " ", outside > 0, main, linked, False))

    def pop(names: tuple[str, ...], within: frozenset | None = None) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if within and stack[k][0] in within:
                return

    for found in _TAG.finditer(page):
        text(found.start())
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if found["raw"]:
            tags.append(f"{stack[-1][1]}>{found['raw'].lower()}")
            continue
        if not name:
            continue
        if name in _BLOCKS:
            breaks = True
        if found["close"] or found["close2"]:
            pop((name,), None if name in _BLOCKS else _BLOCKS)
            continue
        if name in _CLOSES:
            pop(_CLOSES[name], frozenset(("ul", "ol", "dl", "table")))
        elif name in _BLOCKS and name != "br":
            pop(("p",), _BLOCKS - {"p", "br"})
        marks = [(k.lower(), (a or b or c).replace(">", " ")) for k, a, b, c in _MARKS.findall(found["rest"] or "")]
        values = " ".join(v for _, v in marks)
        path = f"{stack[-1][1]}>{name}" + "".join(f"[{v}]" for _, v in marks)
        tags.append(path)
        if name in _VOID:
            continue
        _, _, outside, main, linked = stack[-1]
        own = name in _MAIN or any(k == "role" and _MAIN_ROLE.search(v) for k, v in marks)
        own = own and not _NO_ARTICLE.search(values)
        if name in _OUTSIDE and not (name == "header" and main) or _hidden(found["rest"] or ""):
            outside = _BY_NAME
        elif own:
            outside = 0 if outside == _BY_MARK and not main else outside
        elif values and name not in ("html", "body"):
            outside = max(outside, _BY_MARK * _says_aside(name, marks, bool(main)))
        stack.append((name, path, outside, path if own else main, linked or name == "a"))
    text(len(page))
    return tags, segments


def _normal(text: str) -> str:
    return " ".join(text.split())


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()


def _token(segment: Segment) -> str:
    """A text's token: a hash of the text, whatever its length, and its path."""
    return f"={_digest(_normal(segment.text)).hex()}{segment.path}"


def blocks_text(segments: list[Segment], chosen: list[bool]) -> str:
    """The chosen segments: white space made single inside a block, a line per block."""
    blocks: list[list[str]] = []
    cut = True
    for segment, wanted in zip(segments, chosen):
        cut = cut or segment.breaks
        if wanted:
            if cut or not blocks:
                blocks.append([])
            blocks[-1].append(segment.text)
            cut = False
    lines = (_normal("".join(parts)) for parts in blocks)
    return "\n".join(line for line in lines if line)


def tokens(pages: DataFrame) -> DataFrame:
    """``host, token, page, n, content``: how often each page holds each token.

    Tokens are the tags by their path, and, outside the marked surroundings, whole texts by
    their path; in a marked article only those inside a box. ``page`` names a row of the
    table, the same whenever its task runs again; ``content`` is equal for equal pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            hosts, found, rows, counts, contents = [], [], [], [], []
            for k, (host, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                tags, segments = parsed(page)
                held = Counter(tags)
                held.update(_token(s) for s in segments if not s.outside and (not s.main or _boxes(s)))
                hosts += [host] * len(held)
                found += held
                rows += [first + k] * len(held)
                counts += held.values()
                contents += [int.from_bytes(_digest(page)[:8], "big", signed=True)] * len(held)
            first += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hosts, pa.string()),
                    pa.array(found, pa.string()),
                    *(pa.array(column, pa.int64()) for column in (rows, counts, contents)),
                ],
                names=["host", "token", "page", "n", "content"],
            )

    return pages.select("host", "html").mapInArrow(run, "host string, token string, page long, n long, content long")


def templates(pages: DataFrame, support: float = LEAST_SUPPORT) -> DataFrame:
    """``host, host_pages, tokens``: each host's template.

    Tokens of one host with one occurrence vector (the number of times each page holds
    them) form an equivalence class. The vector is never gathered: the exclusive or of a
    hash per page and number stands for it, so a host of any size is summed before the
    shuffle. Classes on at least ``support`` of the host's pages are kept; paths nest them,
    since a token's path holds the tokens around it. A text has to be on two pages that
    differ, since copies of one page do not tell what is constant. ``tokens`` holds
    ``token, class, pages``.
    """
    held = tokens(pages)
    vectors = held.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
        F.count(F.lit(1)).alias("pages"),
        F.sum("n").alias("occurrences"),
        (F.min("content") != F.max("content")).alias("differ"),
    )
    vectors = materialise(vectors, "occurrence-vectors")
    sizes = vectors.groupBy("host").agg(F.max("pages").alias("host_pages"))
    frequent = vectors.join(sizes, "host").where(
        (F.col("pages") >= F.col("host_pages") * support) & (F.col("differ") | ~F.col("token").startswith("="))
    )
    classes = frequent.groupBy("host", "host_pages", "vector").agg(
        F.max("pages").alias("pages"), F.collect_list("token").alias("members")
    )
    named = classes.select("host", "host_pages", F.explode("members").alias("token"), "vector", "pages")
    return named.groupBy("host", "host_pages").agg(
        F.collect_list(F.struct("token", F.col("vector").alias("class"), "pages")).alias("tokens")
    )


def main_text(page: str, template: dict[str, int]) -> str:
    """The text of a page's article slots; ``template`` gives the class of each token.

    If the page marks the article, its slots outside the surroundings are the text, without
    the boxes that the template fills. If not, slots that hold the template's own texts or
    little but links are left out, and all others are taken.
    """
    _, segments = parsed(page)
    if any(s.main and not s.outside for s in segments):
        filled = _filled(segments, template)
        return blocks_text(
            segments, [bool(s.main) and not s.outside and filled.isdisjoint(_boxes(s)) for s in segments]
        )
    free = [not s.outside and not s.main and _token(s) not in template for s in segments]
    slots = [_slot(s.path, template) for s in segments]
    size, linked = Counter(), Counter()
    for s, slot, wanted in zip(segments, slots, free):
        if wanted:
            size[slot] += len(s.text.strip())
            linked[slot] += len(s.text.strip()) * s.linked
    good = {slot for slot in size if size[slot] and linked[slot] <= MOST_LINKED * size[slot]}
    return blocks_text(segments, [wanted and slot in good for wanted, slot in zip(free, slots)])


def _boxes(segment: Segment) -> list[str]:
    """The marked elements around a text inside the marked article, the outermost first."""
    path, out = segment.main, []
    for element in segment.path[len(path) + 1 :].split(">"):
        path = f"{path}>{element}"
        if "[" in element:
            out.append(path)
    return out


def _filled(segments: list[Segment], template: dict[str, int]) -> set[str]:
    """Boxes of a marked article in which every text is the template's.

    A text is the template's if it is of one class with the box or with an element between:
    that element then never stands without it.
    """
    fixed, varied = set(), set()
    for s in segments:
        if s.main and not s.outside and s.text.strip():
            of = template.get(_token(s))
            path, same = s.path, False
            boxes = _boxes(s)
            for box in reversed(boxes):
                while len(path) >= len(box):
                    same = same or of is not None and template.get(path) == of
                    path = path.rpartition(">")[0]
                (fixed if same else varied).add(box)
    return fixed - varied


def _slot(path: str, template: dict[str, int]) -> str:
    """The innermost template element, not of the kind that runs within a line, around a text."""
    while path and not (path in template and _element(path) in _SLOTS):
        path = path.rpartition(">")[0]
    return path


def _element(path: str) -> str:
    return path.rpartition(">")[2].partition("[")[0]


def extract_main_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null html is empty; a page without an article gives an empty text. Pages without a
    url, or with one that names no host, share a template. Repeated rows are pages of their
    own; an empty table gives an empty table; other columns are not read. The template of a
    host joins its pages by host: the engine broadcasts the templates if their stored size
    is below its threshold, and splits a hot host's pages if it shuffles.
    """
    bounded_batches(pages.sparkSession)
    named = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
        named.alias("host"),
    )
    learnt = materialise(templates(rows), "templates")
    lists = learnt.select("host", F.col("tokens.token").alias("tokens"), F.col("tokens.class").alias("classes"))
    joined = rows.join(lists, "host", "left").select("page_id", "url", "html", "host", "tokens", "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, {})
        for batch in batches:
            texts = []
            hosts = batch.column(3).to_pylist()
            for k, page in enumerate(batch.column(2).to_pylist()):
                if known[0] != hosts[k]:
                    known = hosts[k], dict(zip(batch.column(4)[k].as_py() or (), batch.column(5)[k].as_py() or ()))
                texts.append(main_text(page, known[1]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = dict(rows.dtypes)
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
