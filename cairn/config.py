"""Defaults of a cluster and its rounds."""

from __future__ import annotations

from dataclasses import dataclass, field

from .operators.liveness import LivenessConfig
from .operators.peers import FANOUT
from .operators.replica import MTU


@dataclass(frozen=True)
class GossipConfig:
    """Seconds and bytes; ``seeds`` are ``host:port``, empty ones count for nothing."""

    cluster_id: str = "default-cluster"
    address: str = "localhost:10000"
    interval: float = 1.0
    seeds: tuple[str, ...] = ()
    seed_refresh: float = 60.0
    mtu: int = MTU
    fanout: int = FANOUT
    liveness: LivenessConfig = field(default_factory=LivenessConfig)

    def __post_init__(self) -> None:
        if self.interval <= 0 or self.mtu <= 0 or self.fanout < 1:
            raise ValueError("interval, mtu and fanout are positive")
        object.__setattr__(self, "seeds", tuple(dict.fromkeys(s for s in self.seeds if s)))
