"""Normal form of URLs: cases by hand, and the standard library beside the expressions."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from vulntide.functions import urls

CASES = {
    "plain": {
        "https://example.org/a?b#c": "https://example.org/a?b#c", "HTTPS://Example.ORG": "https://example.org/",
        " https://example.org/a b\r": "https://example.org/a%20b", "https:\\\\example.org\\x": "https://example.org/x",
        "http://h/?": "http://h/?", "http:///h/x": "http://h/x", "http://": None, "not a url": None, "/path": None, "": None,
    },
    "ports": {
        "http://example.org:80/x": "http://example.org/x", "http://example.org:8080": "http://example.org:8080/",
        "http://h:/": "http://h/", "https://h:0080/": "https://h:80/", "http://h:65536/": None, "http://h:99999999999/": None,
        "http://h:8x/": None,
    },
    "users": {
        "https://me@Example.org/?q=a b": "https://me@example.org/?q=a%20b", "http://u:p@ss@h/": "http://u:p%40ss@h/",
        "http://:@h/": "http://h/", "http://u:@h/": "http://u@h/", "http://@/": None,
    },
    "dots": {
        "http://a/b/../c/./d/..": "http://a/c/", "http://a/../../x": "http://a/x", "http://a/%2e%2E/x/.": "http://a/x/",
        "http://a/b/..?x/../y": "http://a/?x/../y", "http://a/b/...": "http://a/b/...", "foo:/..//x": "foo:/.//x",
        "http://a//b/../": "http://a//",
    },
    "sets": {
        "http://h/a{b}\"": "http://h/a%7Bb%7D%22", "http://h/^|[]~%zz": "http://h/^|[]~%zz", "http://h/?'`": "http://h/?%27`",
        "foo://h/?'": "foo://h/?'", "http://h/#`'": "http://h/#%60'", "http://h/\u00e9\U0001f4a9": "http://h/%C3%A9%F0%9F%92%A9",
    },
    "ipv4": {
        "http://0x7f.1/": "http://127.0.0.1/", "http://2130706433": "http://127.0.0.1/", "http://010.0.0.1/": "http://8.0.0.1/",
        "http://1.2.3.": "http://1.2.0.3/", "http://0x/": "http://0.0.0.0/", "http://256.1.1.1/": None, "http://1.2.3.4.5/": None,
        "http://a.08/": None, "http://4294967296/": None, "http://99999999999999999999/": None, "http://1a.2b/": "http://1a.2b/",
    },
    "ipv6": {
        "http://[::1]/": "http://[::1]/", "http://[::FFFF:1.2.3.4]:80/": "http://[::ffff:102:304]/", "http://[1:2:3]/": None,
        "http://[1::2::3]/": None, "http://[1:2:3:4:5:6:7:8::]/": None, "http://[::1": None, "http://[::1.2.3.256]/": None,
    },
    "names": {
        "https://B\u00fccher.example/": "https://xn--bcher-kva.example/", "http://\u4f8b\u3048\u3002\u30c6\u30b9\u30c8/": "http://xn--r8jz45g.xn--zckzah/",
        "http://\uff27\uff2f.com/": "http://go.com/", "http://ex%41mple.org/": "http://example.org/", "http://fa\u00df.de/": "http://xn--fa-hia.de/",
        "http://a%20b/": None, "http://a<b/": None, "http://\u00ad/": None, "http://a%ffb/": None,
    },
    "others": {
        "mailto:a@b": "mailto:a@b", "javascript:a b": "javascript:a b", "git://Host/a/../b": "git://Host/b", "foo:/a/../b": "foo:/b",
        "foo://h:70000/": None, "foo://a b/": None, "foo:///x": "foo:///x", "file:///a/../b": "file:///b",
        "file://localhost/x": "file:///x", "file:x": "file:///x", "file:\\\\Host\\x": "file://host/x",
    },
}


def normal(spark, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    found = rows.select("k", F.expr(urls.normalise_url("t")).alias("n")).collect()
    return [n for _, n in sorted(found, key=lambda row: row[0])]


@pytest.mark.parametrize("group", CASES)
def test_normal_form(spark, group):
    cases = CASES[group]
    assert dict(zip(cases, normal(spark, cases))) == cases


def test_null(spark):
    assert normal(spark, [None, "http://h"]) == [None, "http://h/"]


def test_normal_form_is_its_own_normal_form_and_needs_no_rebuild(spark):
    draw = random.Random(11)
    pieces = ["a", "b1", "1", ".", "..", "/", "-", "0x1", ":", "@", "%2e", "?", "#", "'", "`", "\u00fc", "X", "xn--a", "^", "[", "\\"]
    values = [draw.choice(["http://", "https://h.org/", "foo:/", "https://"]) + "".join(draw.choices(pieces, k=draw.randint(0, 9))) for _ in range(4000)]
    once = normal(spark, values)
    assert normal(spark, once) == once
    # A space in front sends a URL past the shortcut for those in normal form.
    assert normal(spark, [" " + v for v in values]) == once
    assert sum(v == n for v, n in zip(values, once)) > 100


def test_punycode_is_that_of_the_standard_library(spark):
    draw = random.Random(5)
    letters = "abz09-\u00fc\u00e9\u00df\u0436\u4e2d\u6587\u65e5\uac00\u0e17\U0001f4a9"
    labels = ["".join(draw.choices(letters, k=draw.randint(1, 60))) for _ in range(2000)]
    labels = [label for label in labels if not label.isascii()] + ["\u4e2d" * 300, "a" * 200 + "\u00fc"]
    rows = spark.createDataFrame([(label, label.encode("punycode").decode()) for label in labels], "l string, e string")
    assert rows.where(f"NOT e <=> {urls.punycode('l')}").count() == 0


def test_ipv6_is_that_of_the_standard_library(spark):
    draw = random.Random(6)
    pieces = lambda: [draw.choice([0, 0, 0, draw.getrandbits(16), draw.getrandbits(4)]) for _ in range(8)]
    written = [":".join(draw.choice(["%x", "%04X"]) % p for p in pieces()) for _ in range(2000)]
    short = [ipaddress.IPv6Address(w).compressed for w in written]
    rows = spark.createDataFrame(list(zip(written + short, short + short)), "a string, e string")
    assert rows.where(f"NOT e <=> {urls.ipv6('a')}").count() == 0


def test_very_long_url(spark):
    path = "/a/../" * 3000
    assert normal(spark, ["http://h" + path, "http://" + "a." * 30000 + "b/"])[0].count("a") == 0
