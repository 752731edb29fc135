import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pages_stub
import pytest

from crowdlens.sources import normalise, paged, services

BUSY = {"left": 0}


class Service(BaseHTTPRequestHandler):
    """Answers as the services do, from made-up records."""

    def log_message(self, *args):
        pass

    def say(self, answer, code=200):
        body = json.dumps(answer).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        url = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query).items()}
        if url.path == "/archive":
            found = [r for r in pages_stub.records(q["subreddit"]) if int(q["after"]) <= r["created_utc"] < int(q["before"])]
            return self.say({"data": sorted(found, key=lambda r: (-r["created_utc"], r["id"]))[: int(q["limit"])]})
        if url.path == "/r/a+b/new":
            return self.say({"data": {"children": [{"data": {"id": "l1", "created_utc": 1.7e9, "title": self.headers["Authorization"]}}]}})
        if url.path == "/recent":
            return self.say({"data": [{"id": "17", "created_at": "2024-01-05T00:00:00Z", "text": q["query"], "author_id": "9", "public_metrics": {"like_count": 3}}, {"id": "18"}], "includes": {"users": [{"id": "9", "username": "ann"}]}})
        if url.path == "/stream/GME.json":
            return self.say({"messages": [{"id": 5, "created_at": "2024-01-05T10:00:00Z", "body": "up", "user": {"username": "bob"}}]})
        self.say({}, 404)

    def do_POST(self):
        text = self.rfile.read(int(self.headers["Content-Length"])).decode()
        if self.path == "/token":
            return self.say({"access_token": parse_qs(text)["grant_type"][0]})
        if self.path == "/spent":
            return self.say({}, 402)
        body = json.loads(text)
        if self.path == "/tweets":
            if BUSY["left"]:
                BUSY["left"] -= 1
                return self.say({}, 429)
            return self.say({"tweets": [{"url": "https://x/a/status/77", "author": {"handle": "ann"}, "createdAt": "2024-01-05", "fullText": body["product"] + body["query"], "counts": {"likes": 4}}, {"id": "none"}]})
        self.say({"posts": [{"postId": "p1", "createdUtc": "1704412800", "postTitle": body.get("t", "-"), "author": {"username": "cy"}, "upvotes": "7"}]})


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_archive_is_paged_to_its_end_through_spark(spark, url):
    spark.dataSource.register(paged.PagedPosts)
    df = spark.read.format("paged_posts").options(fetch="crowdlens.sources.services:archive_posts", settings=json.dumps({"url": f"{url}/archive"}), queries='["a", "b"]', after="0", before="1000000", wait="0").load()
    assert sorted(r.id for r in df.collect()) == sorted(r["id"] for q in "ab" for r in pages_stub.records(q))


def test_community_posts_reach_the_posts_schema(spark, url):
    got = services.community_posts("Stocks top", 0, 7 * 86400, 100, {"url": f"{url}/posts", "key": "k"})
    row = normalise.aliased_posts(spark.createDataFrame([(json.dumps(r),) for r in [*got, {"id": "bad"}]], "raw string")).collect()
    assert [tuple(r) for r in row] == [("p1", dt.date(2024, 1, 5), "cy", 7, "stocks", "week", "", 0, "reddit")]
    assert services.community_posts("a new", 0, 1, 9, {"url": f"{url}/spent", "key": "k"}) == []


def test_listing_uses_the_token(url):
    settings = {"url": url, "token_url": f"{url}/token", "key": "k", "secret": "s"}
    assert [(r["id"], r["created_utc"], r["title"]) for r in services.listing("a+b", 0, 1, 100, settings)] == [("l1", 1_700_000_000, "bearer client_credentials")]
    assert services.listing("a+b", 0, 1, 100, settings | {"user": "u", "password": "p"})[0]["title"] == "bearer password"


def test_tweets_wait_while_the_service_is_busy(url):
    settings = {"url": f"{url}/tweets", "key": "k", "waits": [0, 0]}
    BUSY["left"] = 2
    assert services.found_tweets("Top $GME", 0, 1, 10, settings) == [{"id": "77", "created_at": "2024-01-05", "created_utc": 1704412800, "text": "Top$GME", "author": "ann", "likes": 4}]
    BUSY["left"] = 3
    assert services.found_tweets("Top $GME", 0, 1, 10, settings) == []


def test_recent_tweets_find_their_authors(url):
    got = services.recent_tweets("q", 0, 1, 10, {"url": f"{url}/recent", "key": "k"})
    assert [(r["id"], r["author"], r["likes"], r["created_utc"]) for r in got] == [("17", "ann", 3, 1704412800), ("18", "", 0, 0)]


def test_stream_of_a_symbol(spark, url):
    settings = {"url": url + "/stream/{symbol}.json"}
    got = services.symbol_stream("GME", 0, 1, 30, settings)
    assert [(r["id"], r["body"]) for r in got] == [("5", "up")] and services.symbol_stream("NONE", 0, 1, 30, settings) == []


def test_cashtag_queries():
    got = services.cashtag_queries(["B", "A", "B", "C"], 2, dt.date(2024, 1, 5))
    assert got == ["($A OR $B) lang:en -is:retweet since:2024-01-05", "($C) lang:en -is:retweet since:2024-01-05"]


def test_prices_come_by_chunks(spark):
    spark.dataSource.register(services.ChunkedPrices)
    spark.sparkContext.addPyFile(pages_stub.__file__)
    df = spark.read.format("chunked_prices").options(fetch="pages_stub:closes", symbols=json.dumps([f"s{i}" for i in range(7)] + ["s0"]), start="2024-01-05", end="2024-01-06", chunk="3").load()
    rows = df.collect()
    assert df.rdd.getNumPartitions() == 3 and len(rows) == 14 and {r.px_last for r in rows} == {1.0, 3.0}
