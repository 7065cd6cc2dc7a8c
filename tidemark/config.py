"""Asset profiles and settings."""

from __future__ import annotations

from dataclasses import dataclass

# Names, words and limits of the recorded markets.
RECORDER_VERSION = "hourly-segment-rotation-v1"
FAMILIES = ("chainlink", "binance", "quotes", "meta", "heartbeat")


@dataclass(frozen=True)
class AssetProfile:
    asset: str
    slug_prefix: str
    keywords: tuple[str, ...]
    five_minute_words: tuple[str, ...] = ("5m", "5-minute", "5 minute", "five minute")


BTC = AssetProfile("BTC", "btc-updown-5m-", ("bitcoin", "btc"))
ETH = AssetProfile("ETH", "eth-updown-5m-", ("ethereum", "eth"))
PROFILES = (BTC, ETH)


@dataclass(frozen=True)
class Settings:
    target_seconds: int = 300
    upcoming_seconds: int = 1800
    sample_limit: int = 8
    page_limit: int = 200
    max_pages: int = 4
    quote_ttl_seconds: float = 1.0
    heartbeat_seconds: int = 5
    sample_chars: int = 500

    def __post_init__(self):
        floors = (("upcoming_seconds", 300), ("sample_limit", 1), ("page_limit", 20), ("max_pages", 1),
                  ("quote_ttl_seconds", 0.2), ("heartbeat_seconds", 1))
        for name, least in floors:
            if getattr(self, name) < least:
                object.__setattr__(self, name, least)


SETTINGS = Settings()
