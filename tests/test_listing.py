import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from strataline.sources import listing


def repo(k, user="ann"):
    return {"name": f"r{k}", "owner": {"login": user}, "full_name": f"{user}/r{k}", "private": k % 2 == 0, "default_branch": "main", "html_url": f"https://host/{user}/r{k}", "more": {"x": k}}


def record(folder, name, pages):
    for k, items in enumerate(pages, 1):
        (folder / f"{name}-{k}.json").write_text(json.dumps(items))


def test_recorded_pages(spark, tmp_path):
    record(tmp_path, "ann", [[repo(0), repo(1)], [repo(2), repo(3)], [repo(3)]])
    record(tmp_path, "bob", [[repo(7, "bob")], [repo(8, "bob")]])  # a short page ends a listing
    record(tmp_path, "none", [[]])
    record(tmp_path, "odd", [{"message": "no list"}])
    record(tmp_path, "even", [[repo(1, "even"), {"name": 5}], []])
    pages = listing.read_listings(spark, f"file://{tmp_path}/{{listing}}-{{page}}.json", ["ann", "bob", "none", "odd", "even", "gone"], per_page=2, tries=2, wait=0).cache()
    rows = listing.repositories(pages).orderBy("listing", "page", "at").collect()
    assert [(r["listing"], r["page"], r["at"], r["name"], r["owner"]) for r in rows] == [("ann", 1, 0, "r0", "ann"), ("ann", 1, 1, "r1", "ann"), ("ann", 2, 0, "r2", "ann"), ("ann", 2, 1, "r3", "ann"), ("bob", 1, 0, "r7", "bob"), ("even", 1, 0, "r1", "even"), ("even", 1, 1, "5", None)]
    errors = {r["listing"]: r["error"] for r in pages.where("error is not null").collect()}
    assert set(errors) == {"odd", "gone"} and errors["odd"] == "no list of items" and errors["gone"].startswith("request failed")
    assert pages.rdd.getNumPartitions() == 6


@pytest.fixture
def service():
    asked, lock = Counter(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlparse(self.path)
            q = parse_qs(at.query)
            key = (at.path, int(q["page"][0]))
            with lock:
                asked[key] += 1
                n = asked[key]
            status = 200
            if at.path == "/flaky" and key[1] == 2 and n < 3:
                status = 502
            elif at.path in ("/down", "/absent", "/locked"):
                status = {"/down": 503, "/absent": 404, "/locked": 401}[at.path]
            if self.headers.get("Authorization") != "token t":
                status = 401
            first, per = (key[1] - 1) * int(q["per_page"][0]), int(q["per_page"][0])
            items = [{"name": f"b{k}", "commit": {"sha": f"{k:040x}"}, "protected": k == 0} for k in range(first, min(first + per, 6))]
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(items if status == 200 else {}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_failures_of_a_service(spark, service):
    base, asked = service
    template = base + "/{listing}?per_page={per_page}&page={page}"
    given = {"per_page": 3, "wait": 0, "headers": {"Authorization": "token t"}}
    pages = listing.read_listings(spark, template, ["fine", "flaky", "down", "absent", "locked"], **given).collect()
    rows = spark.createDataFrame(pages, listing.ITEMS)
    got = listing.branches(rows).orderBy("listing", "page", "at").collect()
    assert [(r["listing"], r["name"], r["protected"]) for r in got] == [(n, f"b{k}", k == 0) for n in ("fine", "flaky") for k in range(6)] and got[1]["sha"] == f"{1:040x}"
    assert {r["listing"]: r["error"] for r in pages if r["error"]} == {"down": "request failed with 503", "absent": "not found", "locked": "token is invalid or expired"}
    # six items in pages of three end with an empty page; only failures that may pass are asked again
    assert asked["/fine", 3] == 1 and asked["/flaky", 2] == 3 and asked["/down", 1] == 3 and asked["/absent", 1] == 1 and asked["/locked", 1] == 1


def test_known_pages_are_tasks(spark, service):
    base, asked = service
    pages = listing.read_listings(spark, base + "/{listing}?per_page={per_page}&page={page}", ["fine"], per_page=2, wait=0, headers={"Authorization": "token t"}, pages={"fine": 3})
    assert pages.rdd.getNumPartitions() == 3
    assert [r["name"] for r in listing.branches(pages).orderBy("page", "at").collect()] == [f"b{k}" for k in range(6)] and ("/fine", 4) not in asked


def test_no_listings(spark):
    assert listing.read_listings(spark, "file:///nowhere/{listing}{page}", []).isEmpty()
