"""Deterministic ids: digests over length-prefixed parts, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def little_endian(n: Column) -> Column:
    """A whole number as eight bytes, least first."""
    h = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substr(h, F.lit(i), F.lit(2)) for i in range(15, 0, -2))))


def digest(first: Column, second: Column) -> Column:
    """sha256 in hex over the byte length of first, first and second: no two pairs share their input."""
    b = F.encode(first, "UTF-8")
    return F.sha2(F.concat(little_endian(F.octet_length(b)), b, F.encode(second, "UTF-8")), 256)


def idempotency_key(run: Column, node: Column) -> Column:
    return digest(run, node)


def child_run_id(kind: str, parent: Column, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), digest(parent, name))


def branch_run_id(parent: Column, name: Column, index: Column) -> Column:
    """The id of one item's run under a fan-out: a digest over the lengths and texts of parent and step, and the item's place."""
    p, n = F.encode(parent, "UTF-8"), F.encode(name, "UTF-8")
    whole = F.concat(little_endian(F.octet_length(p)), p, little_endian(F.octet_length(n)), n, little_endian(index))
    return F.concat(F.lit("fan:"), F.sha2(whole, 256))


def digest_text(first: str, second: str) -> str:
    """``digest`` for one pair, on the driver."""
    b = first.encode()
    return hashlib.sha256(len(b).to_bytes(8, "little") + b + second.encode()).hexdigest()
