"""Check and normal form of absolute URLs, after the WHATWG URL standard, as SQL expressions."""

from __future__ import annotations

from .sql import cases, let, mapping, struct, text

# Schemes with a host part that is required, and their default ports.
SPECIAL = r"^(https?|wss?|ftp)\z"
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}

# Characters that each part of a URL holds percent-encoded.
CONTROL_SET = r"\x00-\x1f\x7f-\x{10ffff}"
FRAGMENT_SET = CONTROL_SET + r" \"<>`"
QUERY_SET = CONTROL_SET + r" \"#<>"
SPECIAL_QUERY_SET = QUERY_SET + "'"
PATH_SET = QUERY_SET + r"?`{}"
USERINFO_SET = PATH_SET + r"/:;=@\[\\\]\^|"

# Characters that no host may hold, and further ones that no domain may.
NO_HOST = r"\x00\t\n\r #/:<>?@\[\\\]\^|"
NO_DOMAIN = NO_HOST + r"\x00-\x1f%\x7f\x{fffd}"

# Fixed values of Punycode (RFC 3492).
BASE, TMIN, TMAX, SKEW, DAMP, FIRST_BIAS, FIRST_POINT = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"

# Full-width forms of ASCII and ideographic full stops, beside the characters they mean in a host.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3002\uff61"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + ".."
_UNSEEN = r"[\u00ad\u200b\u2060\ufeff]"

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_DOT = r"(?:\.|%2[eE])"
END, ANY, DIGIT, QUESTION = r"\z", r"\s\S", r"\d", r"\?"

# A web address by name whose path, query and fragment are in normal form. Nearly all are; the
# first pattern's are so as a whole.
_CLEAN = rf"(?![^?#]*/{_DOT}{{1,2}}(?:[/?#]|\z))/[!#-&(-;=?-\[\]-_a-z|~]*\z"
_NORMAL = r"^https?://(?:[a-z0-9][a-z0-9.\-]*[.\-])?[a-z][a-z0-9]*(?=/)" + _CLEAN
_START = r"[hH][tT][tT][pP][sS]?://(?:[a-zA-Z0-9][a-zA-Z0-9.\-]*[.\-])?[a-zA-Z][a-zA-Z0-9]*"
_PLAIN = rf"^{_START}(?:\z|(?=/){_CLEAN})"


def _part(of: str, pattern: str) -> str:
    return f"regexp_extract({of}, {text(pattern)}, 1)"


def _like(of: str, pattern: str) -> str:
    return f"{of} RLIKE {text(pattern)}"


def _trimmed(t: str) -> str:
    # Control characters and spaces at either end, and tabs and newlines anywhere, do not count.
    dropped = "^[\\x00-\\x20]+|[\\x00-\\x20]+\\z|[\\t\\n\\r]"
    return f"regexp_replace({t}, {text(dropped)}, '')"


def percent_encoded(t: str, characters: str) -> str:
    """``t`` with the UTF-8 bytes of some characters, given as a class, as ``%XX``."""
    wanted = f"[{characters}]"
    coded = f"regexp_replace(hex(c), '(..)', '%$1')"
    each = f"array_join(transform(split({t}, ''), c -> if({_like('c', wanted)}, {coded}, c)), '')"
    return f"if({_like(t, wanted)}, {each}, {t})"


def without_dot_segments(path: str) -> str:
    """A path that is empty or begins with a slash, with ``.`` and ``..`` carried out."""
    dots = rf"^{_DOT}{{1,2}}\z"
    level = (
        f"CASE WHEN {_like('s', rf'^{_DOT}{{2}}' + chr(92) + 'z')} THEN slice(done, 1, greatest(size(done) - 1, 0)) "
        f"WHEN {_like('s', rf'^{_DOT}' + chr(92) + 'z')} THEN done ELSE concat(done, array(s)) END"
    )
    # A last segment of dots leaves the slash before it.
    ended = lambda a: f"if({_like(f'element_at({a}, -1)', dots)}, concat({a}, array('')), {a})"
    fold = lambda a: (
        f"concat('/', array_join(aggregate({ended(a)}, CAST(array() AS ARRAY<STRING>), (done, s) -> {level}), '/'))"
    )
    has_dots = rf"/{_DOT}{{1,2}}(?:/|\z)"
    return f"if({_like(path, has_dots)}, {let('segments', f'split(substr({path}, 2), {text('/')})', fold)}, {path})"


def _number(p: str) -> str:
    """A part of an IPv4 address: decimal, octal after 0 or hexadecimal after 0x; null if none."""
    return cases(
        (_like(p, r"^0[xX]\z"), "0L"),
        (_like(p, r"^0[xX][0-9a-fA-F]+\z"), f"try_cast(conv(substr({p}, 3), 16, 10) AS BIGINT)"),
        (_like(p, r"^0[0-7]+\z"), f"try_cast(conv({p}, 8, 10) AS BIGINT)"),
        (_like(p, r"^(?:0|[1-9]\d*)\z"), f"try_cast({p} AS BIGINT)"),
    )


def ipv4(host: str) -> str:
    """Dotted form of an address in one to four numbers, or null."""
    value = (
        "aggregate(numbers, struct(0L AS sum, 0 AS at), (a, n) -> struct(a.sum + "
        "if(a.at = size(numbers) - 1, n, n * shiftleft(1L, 24 - 8 * a.at)) AS sum, a.at + 1 AS at), a -> a.sum)"
    )
    fits = (
        "size(numbers) <= 4 AND forall(numbers, n -> n IS NOT NULL) "
        "AND forall(slice(numbers, 1, size(numbers) - 1), n -> n <= 255) "
        "AND element_at(numbers, -1) < shiftleft(1L, 8 * (5 - size(numbers)))"
    )
    dotted = lambda v: "concat_ws('.', " + ", ".join(f"(shiftright({v}, {s}) & 255)" for s in (24, 16, 8, 0)) + ")"
    parts = f"split(regexp_replace({host}, {text(chr(92) + '.' + chr(92) + 'z')}, ''), {text(chr(92) + '.')})"
    numbers = f"transform({parts}, p -> {_number('p')})"
    return let("numbers", numbers, lambda _: f"if({fits}, {let('whole', value, dotted)}, NULL)")


def ipv6(address: str) -> str:
    """Shortest form of an address, without its brackets, or null."""
    byte = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    tail = rf":{byte}\.{byte}\.{byte}\.{byte}\z"
    octet = lambda k: f"CAST(regexp_extract({address}, {text(tail)}, {k}) AS INT)"
    pair = lambda k: f"hex({octet(k)} * 256 + {octet(k + 1)})"
    plain = (
        f"if({_like(address, tail)}, concat(regexp_replace({address}, {text(tail)}, ':'), "
        f"{pair(1)}, ':', {pair(3)}), {address})"
    )

    def filled(a: str) -> str:
        pieces = lambda side: f"filter(split({side}, ':'), p -> p <> '')"
        left, right = pieces(f"split_part({a}, '::', 1)"), pieces(f"split_part({a}, '::', 2)")
        gap = f"array_repeat('0', 8 - size({left}) - size({right}))"
        return f"if(instr({a}, '::') > 0, concat({left}, {gap}, {right}), split({a}, ':'))"

    def shortest(s: str) -> str:
        # The first of the longest runs of two zeros or more.
        run = lambda n: rf"^((?:[0-9a-f]+:){{0,7}}?)0(?::0){{{n - 1}}}(?::|\z)"
        arms = [(_like(s, run(n)), f"regexp_replace({s}, {text(run(n))}, '$1:')") for n in range(8, 1, -1)]
        return let("cut", cases(*arms, other=s), lambda c: f"if(startswith({c}, ':'), concat(':', {c}), {c})")

    piece = r"[0-9a-f]{1,4}"
    whole = rf"^{piece}(?::{piece}){{7}}\z"
    side = rf"(?:{piece}(?::{piece}){{0,6}})?"
    short = rf"^(?!(?:[^:]*:+){{8}}[^:]){side}::{side}\z"
    joined = lambda a: f"array_join(transform({filled(a)}, p -> regexp_replace(p, '^0+(?=.)', '')), ':')"
    count = lambda a: f"size(filter(split({a}, ':'), p -> p <> '')) <= 7"
    good = lambda a: f"({_like(a, whole)} OR ({_like(a, short)} AND {count(a)}))"
    return let("plain", f"lower({plain})", lambda a: f"if({good(a)}, {let('joined', joined(a), shortest)}, NULL)")


def punycode(label: str) -> str:
    """Punycode of a label that is not all ASCII.

    Characters beyond ASCII are inserted by code point and place. What each adds to the
    running number follows from the character before it in that order, so the numbers come
    from one sorted array; only the bias runs from one to the next.
    """
    points = f"transform(split({label}, ''), c -> ascii(c))"
    basic = f"array_join(filter(split({label}, ''), c -> ascii(c) < {FIRST_POINT}), '')"
    inserted = (
        f"array_sort(filter(transform(points, (p, i) -> struct(p AS point, i AS place, "
        f"size(filter(slice(points, 1, i), q -> q <= p)) AS at)), x -> x.point >= {FIRST_POINT}))"
    )
    before = "get(order, k - 1)"
    steps = (
        f"transform(order, (x, k) -> CAST(x.point - coalesce({before}.point, {FIRST_POINT}) AS BIGINT) "
        f"* (size(points) - size(order) + k + 1) + x.at - coalesce({before}.at + 1, 0))"
    )
    # One number in digits of growing weight; fourteen are enough for any label.
    least = f"least(greatest({BASE} * k - s.bias, {TMIN}), {TMAX})"
    digit = lambda value: f"substr('{DIGITS}', CAST({value} AS INT) + 1, 1)"
    written = let(
        "t", least,
        lambda t: cases(
            ("d.left IS NULL", "d"),
            (f"d.left < {t}", f"struct(CAST(NULL AS BIGINT) AS left, concat(d.out, {digit('d.left')}) AS out)"),
            other=f"struct((d.left - {t}) DIV ({BASE} - {t}) AS left, "
                  f"concat(d.out, {digit(f'{t} + (d.left - {t}) % ({BASE} - {t})')}) AS out)",
        ),
    )
    digits = f"aggregate(sequence(1, 14), struct(n AS left, s.out AS out), (d, k) -> {written}, d -> d.out)"
    limit = (BASE - TMIN) * TMAX // 2
    damped = f"if(s.done = 0, n DIV {DAMP}, n DIV 2)"
    spread = let("half", damped, lambda h: f"{h} + {h} DIV (size(points) - size(order) + s.done + 1)")
    bias = (
        f"aggregate(sequence(1, 10), struct({spread} AS delta, 0L AS k), (b, r) -> if(b.delta > {limit}, "
        f"struct(b.delta DIV {BASE - TMIN} AS delta, b.k + {BASE} AS k), b), "
        f"b -> b.k + {BASE - TMIN + 1} * b.delta DIV (b.delta + {SKEW}))"
    )
    start = f"struct({text('')} AS out, {FIRST_BIAS}L AS bias, 0 AS done)"
    coded = f"aggregate({steps}, {start}, (s, n) -> struct({digits} AS out, {bias} AS bias, s.done + 1 AS done), s -> s.out)"
    in_order = lambda _: let("order", inserted, lambda _: coded)
    return let("basic", basic, lambda b: f"concat(if({b} = '', '', concat({b}, '-')), {let('points', points, in_order)})")


def domain(host: str) -> str:
    """ASCII form of a host's name or IPv4 address, or null."""
    decoded = f"if(instr({host}, '%') > 0, try_url_decode(replace({host}, '+', '%2B')), {host})"
    mapped = f"lower(translate(regexp_replace({decoded}, {text(_UNSEEN)}, ''), {text(_WIDE)}, {text(_NARROW)}))"
    beyond = r"[^\x00-\x7f]"
    label = f"if({_like('l', beyond)}, concat('xn--', {punycode('l')}), l)"
    named = lambda m: f"if({_like(m, beyond)}, array_join(transform(split({m}, {text(chr(92) + '.')}), l -> {label}), '.'), {m})"
    numeric = r"(?:^|\.)(?:\d+|0[xX][0-9a-fA-F]*)\.?\z"
    ascii_form = lambda m: cases(
        (f"{m} = '' OR {_like(m, f'[{NO_DOMAIN}]')}", "NULL"),
        (_like(m, numeric), ipv4(m)),
        other=named(m),
    )
    return let("mapped", mapped, ascii_form)


def _authority(u: str) -> str:
    """``//user:password@host:port`` in normal form, or null if it is none."""
    ports = mapping({s: text(port) for s, port in DEFAULT_PORTS.items()})

    def cut(a: str) -> str:
        place = f"if({u}.file, {a}, {_part(a, r'([^@]*)' + END)})"
        return let("place", place, lambda h: struct(
            user=f"if({u}.file, '', {_part(a, r'^([' + ANY + r']*)@')})",
            host=f"if({u}.file, {h}, {_part(h, r'^(\[[^\]]*\]|[^:]*)')})",
            port=f"if({u}.file, '', {_part(h, r':(' + DIGIT + '*)' + END)})",
            whole=f"{u}.file OR {_like(h, r'^(?:\[[^\]]*\]|[^:\[\]]*)(?::' + DIGIT + '*)?' + END)}",
        ))

    def joined(p: str) -> str:
        encoded = lambda t: percent_encoded(t, USERINFO_SET)
        name, word = _part(f"{p}.user", "^([^:]*)"), _part(f"{p}.user", f"^[^:]*:([{ANY}]*)")
        credentials = (
            f"if({p}.user IN ('', ':'), '', concat({encoded(name)}, "
            f"if({word} = '', '', concat(':', {encoded(word)})), '@'))"
        )
        found = let("found", domain(f"{p}.host"), lambda d: f"if({u}.file AND {d} = 'localhost', '', {d})")
        opaque = f"if({_like(f'{p}.host', f'[{NO_HOST}]')}, NULL, {percent_encoded(f'{p}.host', CONTROL_SET)})"
        host = cases(
            (f"{p}.host = '' AND NOT {u}.special", f"if({p}.user = '' AND {p}.port = '', '', NULL)"),
            (_like(f"{p}.host", r"^\[[^\]]*\]" + END), f"concat('[', {ipv6(f'substr({p}.host, 2, length({p}.host) - 2)')}, ']')"),
            (f"{u}.special OR {u}.file", found),
            other=opaque,
        )
        # A port that is a number too large has no value, so it makes the whole null.
        number = f"try_cast({p}.port AS INT)"
        usual = f"{p}.port = '' OR CAST({number} AS STRING) <=> try_element_at({ports}, {u}.scheme)"
        port = f"if({usual}, '', if({number} <= 65535, concat(':', {number}), NULL))"
        return f"if({p}.whole, concat('//', {credentials}, {host}, {port}), NULL)"

    return let("a", f"{u}.authority", lambda a: let("p", cut(a), joined))


def _path(u: str) -> str:
    """The path in normal form; a URL without a host may have a text instead, as ``mailto:`` has."""

    def clean(path: str) -> str:
        bare = let("bare", let("coded", percent_encoded(path, PATH_SET), without_dot_segments), lambda b: (
            # Two slashes at the start of a path alone would read as a host.
            f"if(NOT {u}.has_host AND startswith({b}, '//'), concat('/.', {b}), {b})"
        ))
        return f"if({u}.has_host OR startswith({path}, '/'), {bare}, {percent_encoded(path, CONTROL_SET)})"

    rooted = f"if(({u}.special OR {u}.file) AND NOT startswith({u}.path, '/'), concat('/', {u}.path), {u}.path)"
    return let("path", rooted, clean)


def _tail(u: str) -> str:
    query, fragment = _part(f"{u}.rest", r"^[^?#]*\?([^#]*)"), _part(f"{u}.rest", f"^[^#]*#([{ANY}]*)")
    return (
        f"if({_like(f'{u}.rest', r'^[^?#]*' + QUESTION)}, concat('?', if({u}.special OR {u}.file, "
        f"{percent_encoded(query, SPECIAL_QUERY_SET)}, {percent_encoded(query, QUERY_SET)})), ''), "
        f"if(instr({u}.rest, '#') > 0, concat('#', {percent_encoded(fragment, FRAGMENT_SET)}), '')"
    )


def _rebuilt(t: str) -> str:
    def scheme(t: str) -> str:
        of = lambda s: struct(scheme=s, special=_like(s, SPECIAL), file=f"{s} = 'file'", t=f"substr({t}, length({s}) + 2)")
        return let("s", f"lower({_part(t, _SCHEME)})", of)

    def slashed(h: str) -> str:
        # Backslashes count as slashes before the query, but not for schemes of other kinds.
        front, back = _part(f"{h}.t", "^([^?#]*)"), _part(f"{h}.t", f"([?#][{ANY}]*)")
        rest = f"if({h}.special OR {h}.file, concat(translate({front}, {text(chr(92))}, '/'), {back}), {h}.t)"
        either = lambda r, special, other: f"if({h}.special, {_part(r, special)}, {_part(r, other)})"
        return let("r", rest, lambda r: struct(
            scheme=f"{h}.scheme", special=f"{h}.special", file=f"{h}.file", rest=r,
            has_host=f"{h}.special OR {h}.file OR startswith({r}, '//')",
            authority=either(r, "^/*([^/?#]*)", "^//([^/?#]*)"),
            path=either(r, "^/*[^/?#]*([^?#]*)", "^(?://[^/?#]*)?([^?#]*)"),
        ))

    built = lambda u: (
        f"if({u}.scheme = '', NULL, "
        f"concat({u}.scheme, ':', if({u}.has_host, {_authority(u)}, ''), {_path(u)}, {_tail(u)}))"
    )
    return let("trimmed", _trimmed(t), lambda t: let("h", scheme(t), lambda h: let("u", slashed(h), built)))


def normalise_url(t: str) -> str:
    """Normal form of an absolute URL, or null when it is none.

    Scheme and host in lower case, no default port, dot segments carried out, every part
    percent-encoded by its own set, names beyond ASCII in Punycode, IPv4 and IPv6 addresses in
    their one form. A name is lower-cased and its full-width ASCII narrowed; other
    compatibility characters, decomposed letters and labels that are Punycode already stay as
    they are, as do drive letters of files.
    """
    start = f"regexp_extract({t}, {text(_START)}, 0)"
    lowered = let("start", start, lambda b: f"concat(lower({b}), if(length({t}) = length({b}), '/', substr({t}, length({b}) + 1)))")
    return cases((_like(t, _NORMAL), t), (_like(t, _PLAIN), lowered), other=_rebuilt(t))
