"""Content-addressed identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGESTS = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512)}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def joined_digest(*parts: Column | str, separator: str = "||", algorithm: str = "sha256") -> Column:
    """Hex digest of the parts as text; a null part makes it null."""
    pieces = [x for p in parts for x in (_c(p).cast("string"), F.lit(separator))][:-1]
    return _DIGESTS[algorithm](F.concat(*pieces))


def fact_id(subject="subject_id", relation="relation_type", obj="object_id", valid_from="valid_from", **options) -> Column:
    return joined_digest(subject, relation, obj, valid_from, **options)


def family_key(subject="subject_id", relation="relation_type", obj="object_id", **options) -> Column:
    return joined_digest(subject, relation, obj, F.lit("FAMILY"), **options)


def content_hash_id(text: Column | str) -> Column:
    """HASH: and 16 hex digits of the text without case, punctuation and runs of white space."""
    plain = F.regexp_replace(F.trim(F.lower(_c(text))), r"(?U)[^\w\s]", "")
    return F.concat(F.lit("HASH:"), F.substring(F.sha2(F.regexp_replace(plain, r"(?U)\s+", "_"), 256), 1, 16))


def no_cui_id(text: Column | str, label: Column | str) -> Column:
    return F.concat(F.lit("NOCUI_"), F.substring(joined_digest(text, label), 1, 16))


def text_id(text: Column | str) -> Column:
    """Twelve hex digits for a text that came without an id."""
    return F.substring(F.md5(_c(text)), 1, 12)


def response_key(prompt: Column | str) -> Column:
    return F.substring(F.sha2(_c(prompt), 256), 1, 16)
