"""JSON checks where the JSON type decides (P5, P7, T1, q21).

``from_json`` coerces numbers into STRING fields and reads a lone object as
a one-element array, and Spark's JSON parsers ignore text after the first
value. Checks that depend on the JSON type therefore parse to VARIANT and
look at ``schema_of_variant``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

LIST_RE = r"(?s)\[.*\]"
# Texts that a false number, boolean, object or list has (or a true string).
FALSY_RE = r"^(-?[0.]+([eE][+-]?[0-9]+)?|false|\{\s*\}|\[\s*\])$"


def c_(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vtype(v) -> Column:
    return F.schema_of_variant(c_(v))


def field(v, name: str) -> Column:
    """VARIANT of key ``name``; SQL NULL when the key is absent."""
    return F.try_variant_get(c_(v), f"$.{name}", "variant")


def vstring(v) -> Column:
    return F.try_variant_get(c_(v), "$", "string")


def truthy(v) -> Column:
    """Python truthiness of a JSON value: null, '', 0, false, {} and [] are
    false; an absent key (SQL NULL) is false too. The value's text decides
    unless it looks like one of these; only then its type is asked for."""
    v = c_(v)
    text, t = vstring(v), vtype(v)
    numeric = t.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return (F.when(v.isNull() | text.isNull() | (text == ""), F.lit(False))
            .when(~text.rlike(FALSY_RE), F.lit(True))
            .when(t == "VOID", F.lit(False))
            .when(t == "STRING", F.coalesce(vstring(v) != "", F.lit(False)))
            .when(t == "BOOLEAN", F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(False)))
            .when(numeric, F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(False)))
            .when(t == "OBJECT<>", F.lit(False))
            .when(t.startswith("OBJECT"), F.lit(True))
            .when(t.startswith("ARRAY"), F.coalesce(F.array_size(F.try_variant_get(v, "$", "array<variant>")) > 0,
                                                    F.lit(False)))
            .otherwise(F.lit(False)))


def list_text(content) -> Column:
    """Text from the first '[' to the last ']', else the whole text."""
    c = c_(content)
    m = F.regexp_extract(c, LIST_RE, 0)
    return F.when(m == "", c).otherwise(m)


def one_value(raw) -> Column:
    """The VARIANT of a text that is exactly one JSON value, else NULL.

    Spark's parsers stop after the first value. The text is therefore parsed as
    the first element of a list that ends with the text's own hash: the hash is
    the second and last element only if the text neither ends the list nor
    holds anything but one value."""
    raw = c_(raw)
    mark = F.xxhash64(raw).cast("string")
    wrapped = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(',"'), mark, F.lit('"]')))
    items = F.try_variant_get(wrapped, "$", "array<variant>")
    sound = (F.size(items) == 2) & (F.try_variant_get(wrapped, "$[1]", "string") == mark)
    return F.when(F.coalesce(sound, F.lit(False)), F.try_variant_get(wrapped, "$[0]", "variant"))


def is_one_value(raw) -> Column:
    """True where :func:`one_value` finds a value, by one parse: the list ends with
    a mark made for this expression, which no text can hold, so that it is the
    second element only if the text is one value."""
    mark = uuid.uuid4().hex
    wrapped = F.try_parse_json(F.concat(F.lit("["), c_(raw), F.lit(f',"{mark}"]')))
    return F.coalesce(F.try_variant_get(wrapped, "$[1]", "string") == mark, F.lit(False))


def begins_object(raw) -> Column:
    """True where a text that is one JSON value is an object."""
    raw = c_(raw)
    return F.coalesce(raw.startswith("{") | (F.substring(F.ltrim(raw, F.lit(" \t\n\r")), 1, 1) == "{"), F.lit(False))


def is_object(v) -> Column:
    """True where a VARIANT is a JSON object."""
    return F.coalesce(vtype(v).startswith("OBJECT"), F.lit(False))


def is_json_list(raw) -> Column:
    """True when ``raw`` is exactly one JSON value and that value is a list
    (text after the value, a lone object or two lists fail, as in Python)."""
    return F.coalesce(vtype(one_value(raw)).startswith("ARRAY"), F.lit(False))


def list_items(raw) -> Column:
    """The elements of a JSON list as ARRAY<VARIANT>."""
    return F.try_variant_get(F.try_parse_json(c_(raw)), "$", "array<variant>")
