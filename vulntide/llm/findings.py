"""Labelled findings to train the secret classifier on, made by rule from a seed."""

from __future__ import annotations

import random
import string
import uuid

from pyspark.sql import DataFrame, SparkSession

FINDINGS = 6000
SEED = 314_159

_SCHEMA = "before string, candidate string, after string, is_secret int"
_HEX = "0123456789abcdef"
_BASE64 = string.ascii_letters + string.digits + "+/"
_SAFE = string.ascii_letters + string.digits + "_-"
_ALNUM = string.ascii_letters + string.digits
_PARTS = (
    "config user data image page session index report table order build module client server test main core "
    "service login view model cache query result event stream value field name file list item time event"
).split()


def labelled_findings(spark: SparkSession, rows: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """``before, candidate, after, is_secret``: a finding, its neighbourhood and its label.

    Half are secrets of common forms in assignments, headers and prose. The other half look
    alike and are none: digests, commit ids, identifiers, paths, versions, placeholders.
    """
    draw = random.Random(seed)
    made = []
    for k in range(rows):
        before, candidate, after = (_secret if k % 2 else _harmless)(draw)
        if draw.random() < 0.1:
            before, candidate = before.upper(), candidate.upper()
        made.append((before, candidate, after, k % 2))
    return spark.createDataFrame(made, _SCHEMA).coalesce(1)


def _text(draw: random.Random, letters: str, n: int) -> str:
    return "".join(draw.choices(letters, k=n))


def _prose(draw: random.Random) -> str:
    words = (_word(draw, draw.randint(2, 11)) for _ in range(draw.randint(1, 5)))
    return " ".join(words) + draw.choice((" ", ". ", ", ", "\n"))


def _word(draw: random.Random, n: int) -> str:
    """A word of consonants and vowels in turn."""
    return "".join(draw.choice("bcdfghlmnprstvy" if k % 2 else "aeiou") for k in range(n))


def _block(draw: random.Random) -> str:
    kind = draw.choice(("", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "))
    return f"-----BEGIN {kind}PRIVATE KEY-----" + draw.choice(("\n", " ", "\n\n"))


def _secret(draw: random.Random) -> tuple[str, str, str]:
    if draw.random() < 0.08:
        return _prose(draw) + _block(draw), "MII" + _text(draw, _BASE64, draw.choice((1, 5, 60, 400, 1600))), draw.choice(("", "\n")) + _prose(draw)
    if draw.random() < 0.08:
        chosen = _word(draw, draw.randint(5, 9)) + _text(draw, string.digits, draw.randint(1, 4))
        chosen += draw.choice(("", _word(draw, draw.randint(3, 7)))) + draw.choice("!@#%$&*?")
        lead = draw.choice(("password: ", "password = \"", "passwd=", "pwd: ", "secret: "))
        return _prose(draw) + lead, chosen, draw.choice((" ", "\n", '"')) + _prose(draw)
    body = draw.choice(
        (
            lambda: _text(draw, _HEX, draw.choice((32, 40, 40, 48, 64))),
            lambda: _text(draw, _HEX, 40),
            lambda: _text(draw, _BASE64, draw.choice((24, 32, 40, 44, 64))),
            lambda: _text(draw, _SAFE, draw.randint(20, 64)),
            lambda: "AKIA" + _text(draw, string.ascii_uppercase + string.digits, 16),
            lambda: draw.choice(("ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "glpat-", "npm_")) + _text(draw, _ALNUM, draw.randint(24, 40)),
            lambda: "AIza" + _text(draw, _SAFE, 35),
            lambda: "eyJ" + _text(draw, _SAFE, draw.randint(30, 80)),
            lambda: _text(draw, _ALNUM + "!@#%", draw.randint(12, 20)),
        )
    )()
    key = draw.choice(
        "token secret password passwd api_key apikey access_key secret_key auth_token client_secret private_key "
        "credential bearer authorization access_token".split()
    )
    sign = draw.choice((" = ", "=", ": ", ":", " ", " = "))
    quote = draw.choice(('"', '"', "'", ""))
    return _prose(draw) + key + sign + quote, body, quote + draw.choice((" ", "\n", ";", "", " and")) + _prose(draw)


def _harmless(draw: random.Random) -> tuple[str, str, str]:
    part = lambda: draw.choice(_PARTS)
    forms = (
        lambda: (draw.choice(("commit ", "Merge ", "revision ", "fixes ", "sha1 ", "blob ")), _text(draw, _HEX, 40)),
        lambda: (draw.choice(("sha256:", "md5 ", "checksum: ", "digest ", "integrity ", "etag: ")), _text(draw, _HEX, draw.choice((32, 64)))),
        lambda: (draw.choice(("id: ", "uuid=", "request ", "trace ", "node ", '"')), str(uuid.UUID(int=draw.getrandbits(128)))),
        lambda: (draw.choice(("in ", "/", "see ", "open ")), "/".join(part() for _ in range(draw.randint(3, 6))) + str(draw.randint(1, 99))),
        lambda: (draw.choice(("https://example.com/", "http://", "www.")), "/".join(part() + _text(draw, string.digits, 2) for _ in range(3))),
        lambda: (draw.choice((" ", "def ", "class ", "var ", "import ")), "_".join(part() for _ in range(draw.randint(2, 4))) + "_v" + str(draw.randint(1, 12))),
        lambda: (" ", "".join(part().title() for _ in range(draw.randint(3, 5))) + str(draw.randint(1, 9))),
        lambda: (draw.choice(("version ", "at ", "on ")), f"20{draw.randint(10, 29)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}T{draw.randint(0, 23):02}-30-{draw.randint(10, 59)}Z"),
        lambda: (draw.choice(("token = \"", "password: ", "api_key=", "secret: '")), draw.choice(("your_api_key_here_1", "xxxxxxxxxxxxxxxxxxx1", "CHANGE_ME_PLEASE_123", "example_token_value_1", "0000000000000000000a", "insert_password_here1", "test_password_12345"))),
        lambda: (draw.choice(("the secret: ", "password: ", "token = ", "Secret: ", "credentials: ")), (part() + part() + part())[: draw.randint(8, 14)]),
        lambda: (draw.choice(("the secret: ", "password: ", "token = ", "Secret: ", "credentials: ")), _word(draw, draw.randint(8, 14))),
        lambda: (draw.choice(("password ", "secret ", "token ", "The key ")), "-".join(part() for _ in range(3)) + "-" + str(draw.randint(1, 99))),
        lambda: (draw.choice(("IMG_", "file ", "photo ")), f"IMG_20{draw.randint(10, 24)}0{draw.randint(1, 9)}1{draw.randint(0, 9)}_{draw.randint(100000, 235959)}"),
        lambda: ("data:image/png;base64,", _text(draw, _BASE64, draw.randint(40, 100))),
        lambda: (draw.choice(("part no ", "isbn ", "model ", "serial ")), _text(draw, string.ascii_uppercase, 3) + "-" + _text(draw, string.digits, 13)),
        lambda: (_block(draw), draw.choice((part(), _word(draw, draw.randint(2, 12)), part() + part() + part(), "x" * draw.randint(3, 40), "yourkeygoeshere"))),
        lambda: (_prose(draw), _prose(draw).split()[0].replace(".", "") * 4 + str(draw.randint(1, 99))),
    )
    lead, body = draw.choice(forms)()
    return _prose(draw) + lead, body, draw.choice(("", " ", '"', ".png", ".html", "/", "\n")) + _prose(draw)
