"""Deterministic ids and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanledger.functions.text import bound

# Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
NIL = "00000000-0000-0000-0000-000000000000"


def uuid5(namespace: Column | str, name: Column) -> Column:
    """Name-based UUID (version 5) of ``name`` inside ``namespace``, as text.

    Never NULL (no name or namespace gives the nil id): joins on ids then need no
    not-null filter, which Catalyst would push down as a second copy of the hashing.
    """
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    digest = F.sha1(F.concat(F.unhex(F.replace(ns, F.lit("-"), F.lit(""))), name.cast("binary")))
    # the variant nibble keeps its two low bits under binary 10
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    text = F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )
    return F.coalesce(text, F.lit(NIL))


def url_uuid5(*parts: Column | str) -> Column:
    """UUID over the parts joined by a colon, in the URL namespace."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return uuid5(URL_NAMESPACE, F.concat_ws(":", *cols))


# an id in this form is told by 16 bytes
UUID = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def packed(identifier: Column) -> Column:
    """The id in fewer bytes, for joins and groupings that move ids only to give them back by ``unpacked``.

    A mark and 16 bytes for a UUID, a mark and the text for any other string; equal where the ids are.
    """
    def made(text: Column) -> Column:
        short = F.concat(F.unhex(F.lit("00")), F.unhex(F.replace(text, F.lit("-"), F.lit(""))))
        return F.when(text.rlike(UUID), short).otherwise(F.concat(F.unhex(F.lit("01")), text.cast("binary")))

    return bound(identifier, made)


def unpacked(short: Column) -> Column:
    """The id that ``packed`` made short."""
    # the bytes behind the mark, in a UUID's five parts
    parts = [F.hex(F.substring(short, at, n)) for at, n in ((2, 4), (6, 2), (8, 2), (10, 2), (12, 6))]
    uuid = F.lower(F.concat(parts[0], *(x for part in parts[1:] for x in (F.lit("-"), part))))
    plain = F.substring(short, 2, 2147483647).cast("string")
    return F.when(F.substring(short, 1, 1) == F.unhex(F.lit("00")), uuid).otherwise(plain)


def signature(*parts: Column) -> Column:
    """128 bits of the parts, for keys that are only compared; nulls are equal to each other alone.

    Equal parts have equal signatures; others share one with a chance of 3e-39 a pair.
    """
    # hashing skips nulls, so each part tells whether it is one
    told = [x for p in parts for x in (p, p.isNull())]
    return F.struct(F.xxhash64(F.lit(1), *told).alias("one"), F.xxhash64(F.lit(2), *told).alias("two"))


def chunk_uuid(document_id: Column, index: Column) -> Column:
    return uuid5(document_id, index.cast("string"))


def fact_uuid(tenant: Column, claim: Column) -> Column:
    return url_uuid5(tenant, claim)


def assertion_uuid(
    tenant: Column, fact_id: Column, document_id: Column, chunk_id: Column, spans: Column
) -> Column:
    """``spans`` is an array of structs start_offset, end_offset, quote."""
    signature = F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", s["start_offset"].cast("string"), s["end_offset"].cast("string"), s["quote"]
            ),
        ),
        ";",
    )
    return url_uuid5(tenant, fact_id, document_id, chunk_id, signature)


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))
