"""Transports for the paged source (S12-S17) and for prices by chunks of symbols (S20), over the standard library alone.

Each transport is called with (query, after, before, limit, settings) and returns records that have id and created_utc (0 where
the service gives no time).  Settings: url, always; key, where the service wants one; waits, seconds before each repeat of a
request that came too fast (30 and 90).  A service that has run out of credit gives no more records; other failures are errors,
which the paged source repeats.  Only the first (`archive_posts`) pages backwards: give the others the option budget=1."""

from __future__ import annotations

import base64
import datetime as dt
import importlib
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What services call the fields, in order of preference.
TIMES = ("created_utc", "createdUtc", "created", "createdAt", "created_at", "date", "time")
LISTS = ("items", "posts", "results", "tweets", "data")
TWEET_IDS = ("id", "tweetId", "id_str", "restId")
TWEET_TEXTS = ("text", "fullText", "content")
LIKES = ("likeCount", "likes", "favoriteCount", "favorites")
HANDLES = ("handle", "username", "screenName")


def first(record: dict, names: Sequence[str], default: object = "") -> object:
    return next((record[n] for n in names if record.get(n) not in (None, "")), default)


def seconds(value: object) -> int:
    """Seconds since 1970 of such seconds, or of an ISO date or time; 0 if neither."""
    try:
        return int(float(value))
    except (TypeError, ValueError):
        pass
    try:
        at = dt.datetime.fromisoformat(str(value))
    except ValueError:
        return 0
    return int((at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)).timestamp())


def call(url: str, settings: dict, params: dict | None = None, body: dict | None = None, auth: str | None = None) -> dict:
    """The JSON answer; {} if the service is out of credit (402) or still too busy (429) after the waits."""
    headers = {"User-Agent": settings.get("agent", "python"), "Accept": "application/json"}
    if auth:
        headers["Authorization"] = auth
    data = None
    if body is not None:
        data, headers["Content-Type"] = json.dumps(body).encode(), "application/json"
    for wait in (0, *settings.get("waits", (30, 90))):
        time.sleep(wait)
        try:
            target = f"{url}?{urllib.parse.urlencode(params)}" if params else url
            with urllib.request.urlopen(urllib.request.Request(target, data, headers), timeout=settings.get("timeout", 60)) as answer:
                return json.load(answer) or {}
        except urllib.error.HTTPError as e:
            if e.code == 402:
                return {}
            if e.code != 429:
                raise
    return {}


def listed(answer: dict) -> list[dict]:
    """The first list in the answer that isn't empty."""
    return [r for r in first(answer, [n for n in LISTS if isinstance(answer.get(n), list) and answer[n]], []) if isinstance(r, dict)]


def dated(record: dict) -> dict:
    return record | {"id": str(first(record, ("id", "postId", "name"))), "created_utc": seconds(first(record, TIMES, 0))}


def archive_posts(query: str, after: int, before: int, limit: int, settings: dict) -> list[dict]:
    """A page of an archive's posts of one community, newest first."""
    answer = call(settings["url"], settings, {"subreddit": query, "after": after, "before": before, "limit": limit})
    return [dated(r) for r in listed(answer)]


def community_posts(query: str, after: int, before: int, limit: int, settings: dict) -> list[dict]:
    """Query is "community new" or "community top": its newest posts, or the most popular of the window."""
    name, order = query.rsplit(" ", 1)
    days = (before - after) / 86400
    window = "day" if days <= 1 else "week" if days <= 7 else "month" if days <= 31 else "year"
    top = {"timeframe": window, "t": window} if order == "top" else {}
    answer = call(settings["url"], settings, body={"subreddit": name, "sort": order, "limit": limit} | top, auth=f"Bearer {settings['key']}")
    return [dated({"subreddit": name} | r) for r in listed(answer)]


def listing(query: str, after: int, before: int, limit: int, settings: dict) -> list[dict]:
    """The newest posts of several communities ("a+b") by OAuth; settings also has token_url, secret and, for a password
    grant, user and password."""
    grant = {"grant_type": "password", "username": settings["user"], "password": settings["password"]} if settings.get("password") else {"grant_type": "client_credentials"}
    basic = base64.b64encode(f"{settings['key']}:{settings['secret']}".encode()).decode()
    asked = urllib.request.Request(settings["token_url"], urllib.parse.urlencode(grant).encode(), {"Authorization": f"Basic {basic}", "User-Agent": settings.get("agent", "python")})
    with urllib.request.urlopen(asked, timeout=settings.get("timeout", 60)) as answer:
        token = json.load(answer)["access_token"]
    answer = call(f"{settings['url']}/r/{query}/new", settings, {"limit": min(limit, 100)}, auth=f"bearer {token}")
    return [dated(c["data"]) for c in (answer.get("data") or {}).get("children", []) if c.get("data")]


def flat_tweet(t: dict) -> dict | None:
    """id, created_at, text, author, likes; None without a numeric id, which an address names best."""
    found = re.search(r"/status/(\d+)", str(t.get("url") or t.get("tweetUrl") or ""))
    key = found[1] if found else next((str(t[n]) for n in TWEET_IDS if str(t.get(n, "")).isdigit()), "")
    if not key:
        return None
    who, counts = t.get("author") or "", t.get("counts") if isinstance(t.get("counts"), dict) else {}
    at = first(t, TIMES[3:], "")
    return {"id": key, "created_at": at, "created_utc": seconds(at), "text": first(t, TWEET_TEXTS), "author": str(first(who, HANDLES) if isinstance(who, dict) else who), "likes": first(t, LIKES, first(counts, LIKES, 0))}


def found_tweets(query: str, after: int, before: int, limit: int, settings: dict) -> list[dict]:
    """Query is "Top text" or "Latest text"; the text may come from `cashtag_queries`."""
    product, words = query.split(" ", 1)
    answer = call(settings["url"], settings, body={"query": words, "product": product, "count": limit}, auth=f"Bearer {settings['key']}")
    return [r for r in map(flat_tweet, listed(answer)) if r]


def recent_tweets(query: str, after: int, before: int, limit: int, settings: dict) -> list[dict]:
    """The search whose authors come in a list beside the tweets."""
    params = {"query": query, "max_results": min(100, max(10, limit)), "tweet.fields": "created_at,public_metrics,author_id", "expansions": "author_id", "user.fields": "username"}
    answer = call(settings["url"], settings, params, auth=f"Bearer {settings['key']}")
    names = {u["id"]: u.get("username", "") for u in (answer.get("includes") or {}).get("users", [])}
    rows = []
    for t in answer.get("data") or []:
        at = t.get("created_at", "")
        rows.append({"id": str(t["id"]), "created_at": at, "created_utc": seconds(at), "text": t.get("text", ""), "author": names.get(t.get("author_id"), ""), "likes": (t.get("public_metrics") or {}).get("like_count", 0)})
    return rows


def symbol_stream(query: str, after: int, before: int, limit: int, settings: dict) -> list[dict]:
    """The messages of one symbol; an unknown symbol has none.  The url has {symbol} in it."""
    try:
        answer = call(settings["url"].format(symbol=urllib.parse.quote(query)), settings)
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return []
        raise
    return [dated(m) for m in answer.get("messages") or []]


def cashtag_queries(symbols: Sequence[str], size: int = 6, since: dt.date | None = None) -> list[str]:
    """The symbols, sorted, by `size` in a query."""
    names = sorted(set(symbols))
    tail = " lang:en -is:retweet" + (f" since:{since.isoformat()}" if since else "")
    return [f"({' OR '.join('$' + n for n in names[i : i + size])}){tail}" for i in range(0, len(names), size)]


class Chunk(InputPartition):
    def __init__(self, symbols: list[str]) -> None:
        self.symbols = symbols


class ChunkedPrices(DataSource):
    """S20.  Options: fetch ("module:function", called with a list of symbols, start and end, returning (symbol, ISO day, close)),
    symbols (a JSON list), start, end, chunk (50).  A task per chunk; rows without a close are left out."""

    @classmethod
    def name(cls) -> str:
        return "chunked_prices"

    def schema(self) -> str:
        return "symbol string, date date, px_last double"

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(dict(self.options))


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[Chunk]:
        names, size = list(dict.fromkeys(json.loads(self.options["symbols"]))), int(self.options.get("chunk", 50))
        return [Chunk(names[i : i + size]) for i in range(0, len(names), size)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        module, function = self.options["fetch"].split(":")
        fetch = getattr(importlib.import_module(module), function)
        for symbol, day, close in fetch(partition.symbols, self.options["start"], self.options["end"]):
            if close is not None:
                yield symbol, dt.date.fromisoformat(day), float(close)
