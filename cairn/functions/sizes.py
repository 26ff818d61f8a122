"""Bytes that parts of a message take on the wire, as column arithmetic.

A string is two bytes of length and its UTF-8; a list is two bytes of count and
its entries; an address is a tag, four or sixteen bytes and a port; a version
has eight bytes.  Null counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNT, TAG, VERSION, PORT = 2, 1, 8, 2


def octets(c: str | Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def string(c: str | Column) -> Column:
    return octets(c) + COUNT


def address(ip: str | Column | None = None) -> Column:
    """A socket address: an ``ip`` with a colon is of version 6; none at all, or null, is of version 4."""
    four, six = TAG + 4 + PORT, TAG + 16 + PORT
    if ip is None:
        return F.lit(four)
    ip = F.col(ip) if isinstance(ip, str) else ip
    return F.when(F.contains(ip, F.lit(":")), six).otherwise(four)


def node_id(node: str | Column, ip: str | Column | None = None) -> Column:
    return string(node) + address(ip)


def key_value(key: str | Column, value: str | Column) -> Column:
    """A key, its value and version."""
    return string(key) + string(value) + VERSION


def node_header(node: str | Column, ip: str | Column | None = None) -> Column:
    """What a node costs in a delta besides its rows."""
    return node_id(node, ip) + COUNT


def digest_entry(node: str | Column, ip: str | Column | None = None) -> Column:
    return node_id(node, ip) + VERSION


def host(addr: str | Column) -> Column:
    """The host of ``host:port``; brackets of version 6 fall."""
    return F.regexp_extract(addr, r"^\[?(.*?)\]?:\d+$", 1)


def port(addr: str | Column) -> Column:
    """The port of ``host:port``, null where there is none."""
    return F.expr(f"try_cast(nullif(regexp_extract({addr}, ':([0-9]+)$', 1), '') AS int)") if isinstance(addr, str) else F.nullif(F.regexp_extract(addr, r":(\d+)$", 1), F.lit("")).cast("int")
