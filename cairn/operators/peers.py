"""Whom a gossip round talks to.  Addresses are (addr); draws are hashes of a seed, so a round can be repeated."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Live peers that a round talks to.
FANOUT = 3


class Round(NamedTuple):
    """Addresses: chosen live peers, and a dead and a seed one where the draw says so."""

    chosen: DataFrame
    dead: DataFrame
    seed: DataFrame


def node_id(addr: str | Column) -> Column:
    """A node's name: its address and a random part, new in every query."""
    addr = F.col(addr) if isinstance(addr, str) else addr
    return F.format_string("svr:%s-%s", addr, F.uuid())


def addresses(nodes: DataFrame, self_addr: str | None = None) -> DataFrame:
    """Distinct addresses, without one's own."""
    rows = nodes.select("addr").distinct()
    return rows if self_addr is None else rows.where(F.col("addr") != self_addr)


def seeds(literal: DataFrame, resolved: DataFrame) -> DataFrame:
    """Distinct seeds of both, without empty ones."""
    return literal.select("addr").union(resolved.select("addr")).where("addr <> ''").distinct()


def _drawn(rows: DataFrame, seed: int, what: str, n: int) -> DataFrame:
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}{what}"), "addr").cast("binary")), "addr").limit(n)  # the feature: n peers


def chance(live: int, dead: int) -> float:
    """Chance that a dead peer or a seed is talked to."""
    return dead / (live + 1)


def unit_draw(seed: int, what: str) -> Column:
    """A number from 0 up to 1 that follows from the seed."""
    digits = F.substring(F.md5(F.lit(f"{seed}{what}").cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


def select(peers: DataFrame, live: DataFrame, dead: DataFrame, seed_addrs: DataFrame, seed: int, n: int = FANOUT) -> Round:
    """The round's peers: ``n`` live ones (of all peers while none is live), and one dead and one seed by chance.

    The seed is left out when one is among the chosen and live peers are at
    least as many as seeds.  Only counts come to the driver.
    """
    n_live, n_dead, n_seeds = (x.select("addr").distinct().count() for x in (live, dead, seed_addrs))
    chosen = _drawn((live if n_live else peers).select("addr").distinct(), seed, "", n)
    p = chance(n_live, n_dead)
    one = lambda rows, what: _drawn(rows.select("addr").distinct(), seed, what, 1).where(F.lit(p) > unit_draw(seed, f"{what}?"))
    met = chosen.join(seed_addrs.select("addr").distinct(), "addr", "left_semi")
    needed = n_live < n_seeds or met.isEmpty()
    return Round(chosen, one(dead, "dead"), one(seed_addrs, "seed") if needed else seed_addrs.select("addr").limit(0))
