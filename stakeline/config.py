"""Every constant a delegation report depends on, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta, timezone

from stakeline.functions.times import naive

# Block explorers by chain.
EXPLORERS = {
    "Ethereum": "https://etherscan.io/address/",
    "Base": "https://basescan.org/address/",
    "Optimism": "https://optimistic.etherscan.io/address/",
    "Arbitrum": "https://arbiscan.io/address/",
}

# Prefix of the per-chain threshold columns.
CHAIN_PREFIX = {
    "Ethereum": "eth",
    "Base": "base",
    "Optimism": "optimism",
    "Arbitrum": "arbitrum",
}


@dataclass(frozen=True)
class Config:
    """Report parameters.

    ``as_of`` is the moment a report describes, in UTC unless it says otherwise; ``None`` means now. The link prefixes are the
    pages the HTML columns point to and belong to whoever publishes the report. ``history_period`` is
    that of ``Tables.balance_history``.
    """

    as_of: str | datetime | None = None
    # The defaults from here to ``label_category``, and the caption.
    chains: tuple[str, ...] = ("Ethereum", "Base", "Optimism", "Arbitrum")
    decimals: int = 18
    dust: float = 1e-12
    ks: tuple[int, ...] = (1000, 5000, 10000, 20000)
    edges: tuple[int, ...] = (100, 500, 1000, 2000, 5000, 10000, 25000)
    last_edge_label: int = 50000
    top_n: int = 1000
    majority: float = 0.5
    quorum: float = 21_000_000
    lookback: str = "1 day"
    history_period: str = "MONTH"
    votes_chain: str = "Ethereum"
    label_category: str = "institution"
    explorers: dict[str, str] = field(default_factory=lambda: dict(EXPLORERS))
    delegate_page: str = "https://example.org/delegate?address="
    breakdown_page: str = "https://example.org/breakdown?delegate="
    vote_page: str = "https://example.org/vote?address="
    breakdown_caption: str = "🔗 ✨"

    @property
    def backdated(self) -> bool:
        """Whether ``as_of`` lies over a minute in the past, so that events after it may exist."""
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        return self.as_of is not None and naive(self.as_of) < now - timedelta(minutes=1)

    def at(self) -> Config:
        """The same parameters with ``as_of`` fixed, so that all jobs of a report share one clock."""
        if self.as_of is not None:
            return self
        return replace(self, as_of=datetime.now(timezone.utc).replace(tzinfo=None))


def k_label(k: int) -> str:
    """1000 -> ``1k``; 100 -> ``100``."""
    return f"{k // 1000}k" if k % 1000 == 0 else str(k)
