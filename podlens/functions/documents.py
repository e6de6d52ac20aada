"""Strict parsing of JSON text.

The JSON parser stops after the first value and ignores what follows, so ``{"a":1} x`` would pass
as an object. Text is therefore parsed as the first of two members, ``{"p": text, "s": seal}``.
Anything but white space behind the value breaks the document, adds a member, or hides the seal,
which is a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from podlens.functions.variants import FIELDS, bind

SEAL = "_seal"
# The parser is lenient about these two by default.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def document(text: Column, fields_type: str = FIELDS) -> Column:
    """The sealed document of a text, whose value is read as ``fields_type`` in the same pass."""
    sealed = F.concat(
        F.lit('{"p":'), text, F.lit(f',"s":{{"{SEAL}":'), F.xxhash64(text).cast("string"), F.lit("}}")
    )
    return F.from_json(sealed, f"map<string,{fields_type}>", STRICT)


def struct_type(keys: tuple[str, ...] | list[str]) -> str:
    """Type that reads only the listed keys of an object, each as a VARIANT."""
    return f"struct<{', '.join(f'{key}: variant' for key in (*keys, SEAL))}>"


def document_value(doc: Column, text: Column) -> Column:
    """What a document holds; NULL when the whole text is not one value of its type."""
    seal = doc["s"][SEAL].try_cast("bigint")
    return F.when((F.size(doc) == 2) & (seal == F.xxhash64(text)), doc["p"])


def document_fields(doc: Column, text: Column) -> Column:
    """The fields of the object a document holds. Of a repeated key the last entry counts."""

    def unique(fields: Column) -> Column:
        repeated = F.size(F.array_distinct(F.map_keys(fields))) < F.size(fields)
        return F.when(repeated, F.map_concat(fields)).otherwise(fields)

    return bind(document_value(doc, text), unique)


def parse_object(text: Column) -> Column:
    """Fields of the JSON object in ``text``; NULL when the whole text is not one object."""
    return bind(document(text), lambda doc: document_fields(doc, text))


def parse_document(text: Column) -> Column:
    """VARIANT of the JSON value in ``text``; NULL when the whole text is not one value."""

    def value(doc: Column) -> Column:
        seal = F.try_variant_get(doc["s"], f"$.{SEAL}", "bigint")
        return F.when((F.size(doc) == 2) & (seal == F.xxhash64(text)), doc["p"])

    return bind(document(text, "variant"), value)
