"""Paged listings of a hosting service as a Spark data source.

A listing (the repositories of a user, the branches of a repository) is read page by page until a page is shorter than
`per_page`. A page that fails for a passing reason is asked for again; a listing that fails for good gives an error row
after the items that it had, so that one listing never fails the others. Each listing is a task; where the number of its
pages is known, each page is one. Pages are asked for by the address that a template gives, which may name recorded
files as well as a service.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship

TIMEOUT, PER_PAGE, TRIES, WAIT = 30, 50, 3, 1.0
ITEMS = "listing string, page int, at int, item string, error string"
#: What a status says; any other means that the service failed, and is asked again.
FAILURES = {400: "bad request", 401: "token is invalid or expired", 404: "not found"}
REPOSITORY = "struct<name: string, owner: struct<login: string>, full_name: string, private: boolean, default_branch: string, html_url: string>"
BRANCH = "struct<name: string, commit: struct<sha: string>, protected: boolean>"


def fetched(address: str, headers: dict[str, str], tries: int, wait: float) -> list:
    """The items of a page; ValueError with what went wrong after as many tries as it deserves, waiting twice as long each time."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(address, headers=headers), timeout=TIMEOUT) as got:
                items = json.loads(got.read())
            if not isinstance(items, list):
                raise ValueError("no list of items")
            return items
        except urllib.error.HTTPError as e:
            said = FAILURES.get(e.code)
            if said:
                raise ValueError(said) from e
            said = f"request failed with {e.code}"
        except (OSError, json.JSONDecodeError) as e:
            said = f"request failed: {getattr(e, 'reason', e)}"
        if k + 1 < tries:
            time.sleep(wait * 2**k)
    raise ValueError(said)


class Pages(InputPartition):
    def __init__(self, listing: str, first: int, last: int | None):
        self.listing, self.first, self.last = listing, first, last


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.template, self.listings = options["template"], json.loads(options["listings"])
        self.per_page, self.tries, self.wait = int(options.get("per_page", PER_PAGE)), int(options.get("tries", TRIES)), float(options.get("wait", WAIT))
        self.headers = json.loads(options.get("headers", "{}"))
        self.pages = json.loads(options.get("pages", "{}"))

    def partitions(self) -> list[Pages]:
        out = []
        for name in self.listings:
            known = self.pages.get(name)
            out += [Pages(name, 1, None)] if known is None else [Pages(name, p, p) for p in range(1, known + 1)]
        return out or [Pages("", 1, 0)]

    def read(self, partition: Pages):
        page = partition.first
        while partition.last is None or page <= partition.last:
            address = self.template.replace("{listing}", partition.listing).replace("{page}", str(page)).replace("{per_page}", str(self.per_page))
            try:
                items = fetched(address, self.headers, self.tries, self.wait)
            except ValueError as e:
                yield (partition.listing, page, None, None, str(e))
                return
            for at, item in enumerate(items):
                yield (partition.listing, page, at, json.dumps(item), None)
            if len(items) < self.per_page:
                return
            page += 1


class Listings(DataSource):
    """Options: template, with {listing}, {page} and {per_page}; listings, a JSON list; per_page; tries; wait (seconds); headers, a JSON object; pages, a JSON object of numbers of pages that are known."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))


def read_listings(spark: SparkSession, template: str, listings: list[str], **options) -> DataFrame:
    """listing, page, at (the place in the page), item (JSON) and error of each listing; see Listings for the options."""
    ship(spark).dataSource.register(Listings)
    given = {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}
    return spark.read.format("paged_listing").options(template=template, listings=json.dumps(listings), **given).load()


def items_of(pages: DataFrame, kind: str) -> DataFrame:
    """The items as columns, an item that two pages gave (the listing grew meanwhile) once: in the order of its first place. Items that are no objects of the kind are nulls."""
    good = pages.where("error is null and item is not null")
    once = good.groupBy("listing", "item").agg(F.min(F.struct("page", "at")).alias("place"))
    return once.select("listing", "place.*", F.from_json("item", kind).alias("i")).select("listing", "page", "at", "i.*")


def repositories(pages: DataFrame) -> DataFrame:
    return items_of(pages, REPOSITORY).select("listing", "page", "at", "name", F.col("owner.login").alias("owner"), "full_name", "private", "default_branch", "html_url")


def branches(pages: DataFrame) -> DataFrame:
    return items_of(pages, BRANCH).select("listing", "page", "at", "name", F.col("commit.sha").alias("sha"), "protected")
