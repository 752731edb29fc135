"""A service of 260 posts a query, 60 of them within one second, that fails on every third call."""

CALLS = [0]


def records(query: str) -> list[dict]:
    return [{"id": f"{query}{i}", "created_utc": 5000 if 100 <= i < 160 else 1000 + 20 * i + (10_000 if i >= 160 else 0)} for i in range(260)]


def fetch(query: str, after: int, before: int, limit: int) -> list[dict]:
    CALLS[0] += 1
    if CALLS[0] % 3 == 0:
        raise OSError("busy")
    found = [r for r in records(query) if after <= r["created_utc"] < before]
    return sorted(found, key=lambda r: (-r["created_utc"], r["id"]))[:limit]


def closes(symbols: list[str], start: str, end: str) -> list[tuple]:
    """Two closes of each symbol, which tell the size of the request, and a gap."""
    return [(s, day, price) for s in symbols for day, price in ((start, len(symbols)), (end, len(symbols)), (end, None))]
