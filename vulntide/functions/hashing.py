"""Issue hashes, identifiers and hex text."""

from __future__ import annotations

from .sql import text

# Accepted forms of identifiers. ``\z`` rather than ``$``, which would also
# match before a final line end.
HEX_64 = r"^[0-9a-fA-F]{64}\z"
COMMIT_HASH = r"^[0-9a-fA-F]{40}\z"
UUID = (
    r"^(([0-9a-fA-F]{32})|((urn:uuid:)?"
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}))\z"
)


def issue_hash(application: str, package: str, version: str, advisory: str) -> str:
    """SHA-256 over the raw SHA-256 digests of the four parts, as lower-case hex."""
    digests = [f"unhex(sha2({part}, 256))" for part in (application, package, version, advisory)]
    return f"sha2(concat({', '.join(digests)}), 256)"


# Issue hash of a finding row.
FINDING_HASH = issue_hash(
    "application_name", "affected_package", "installed_version", "advisory_id"
)


def canonical_hex(t: str) -> str:
    """Lower-case hex of a 64-digit hash in either case, or null."""
    return f"if({t} RLIKE {text(HEX_64)}, lower({t}), NULL)"


def _hyphenate(digits: str) -> str:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "concat_ws('-', " + ", ".join(f"substr({digits}, {at}, {n})" for at, n in cuts) + ")"


def is_uuid(t: str) -> str:
    return f"{t} RLIKE {text(UUID)}"


def canonical_uuid(t: str) -> str:
    """Lower-case hyphenated form of a plain, hyphenated or URN UUID, or null."""
    digits = f"lower(regexp_replace({t}, '^urn:uuid:|-', ''))"
    return f"if({is_uuid(t)}, {_hyphenate(digits)}, NULL)"


def derived_uuid(*parts: str) -> str:
    """UUID-shaped id that depends only on its inputs, so a retried task repeats it."""
    return _hyphenate(f"md5(concat_ws(':', {', '.join(parts)}))")
