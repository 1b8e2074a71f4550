"""Reading JSON documents whose fields may have any type."""

from __future__ import annotations

from .sql import let, mapping, text

# Names of JSON shapes.
SHAPES = {"VOID": "missing", "STRING": "string", "ARRAY": "array", "OBJECT": "object"}


def field(value: str, path: str) -> str:
    """The value at a path, itself a variant; null when the path does not exist."""
    return f"try_variant_get({value}, '{path}', 'variant')"


def as_string(value: str, path: str = "$") -> str:
    return f"try_variant_get({value}, '{path}', 'string')"


def elements_of(value: str) -> str:
    return f"try_variant_get({value}, '$', 'array<variant>')"


def fields_of(document: str, names: list[str]) -> str:
    """All named fields of an object in one pass, each still a variant."""
    shape = ", ".join(f"{name}: variant" for name in names)
    return f"try_variant_get({document}, '$', 'struct<{shape}>')"


def kind(value: str) -> str:
    """``missing`` (absent or JSON null), ``string``, ``array``, ``object`` or ``other``."""
    shape = f"substring_index(coalesce(schema_of_variant({value}), 'VOID'), '<', 1)"
    names = mapping({shape_name: text(name) for shape_name, name in SHAPES.items()})
    return f"coalesce(try_element_at({names}, {shape}), 'other')"


def present(value: str) -> str:
    """True when the path exists, JSON null included."""
    return f"schema_of_variant({value}) IS NOT NULL"


def parse_document(t: str) -> str:
    """Variant of a JSON document, or null when the text is not exactly one document.

    ``try_parse_json`` alone ignores whatever follows the first value. The text is parsed
    as the first of two array elements, the second being its own digest, so text that
    ends early, runs on or closes the array itself cannot pass.
    """
    pair = f"try_parse_json(concat('[', {t}, ',\"', md5({t}), '\"]'))"
    return let(
        "d",
        pair,
        lambda d: (
            f"if({as_string(d, '$[1]')} = md5({t}) AND NOT ({present(field(d, '$[2]'))}), "
            f"{field(d, '$[0]')}, NULL)"
        ),
    )
