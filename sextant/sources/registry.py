"""A registry's listing, page by page, as a Python data source.

Every partition is a range of pages, fetched one after the other with a pause between
requests; a page that fails is tried again after ever longer waits. A page without records
ends its range, and records past the total that the registry states don't appear.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What a response holds of a record. Fixed values.
RECORD = "nregistro string, nombre string, pactivos string, atcs array<struct<codigo: string, nivel: int>>, docs array<struct<tipo: int, url: string, secc: boolean>>"
#: Where a response has its records, and how many there are in all. Fixed values.
RECORDS, TOTAL = "resultados", "totalFilas"


class RegistryError(Exception):
    """A page couldn't be fetched."""


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


def registry_source(fetch: Callable[[int], str], name: str = "registry_pages") -> type[DataSource]:
    """A data source ``name`` over ``fetch``, which gives a page's response, an empty text for none, or raises OSError.

    Options: pages (the last one), range (pages of a partition, 20), attempts (3), pause
    (seconds between requests, 0.5) and wait (seconds before the second attempt, doubled for
    each further one, 2). Rows: page, place (in the page, from 0), total, record (JSON).
    """

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.pages, self.range, self.attempts = int(options["pages"]), int(options.get("range", 20)), int(options.get("attempts", 3))
            self.pause, self.wait = float(options.get("pause", 0.5)), float(options.get("wait", 2))

        def partitions(self):
            return [Pages(at, min(at + self.range - 1, self.pages)) for at in range(1, self.pages + 1, self.range)]

        def read(self, partition) -> Iterator[tuple]:
            for page in range(partition.first, partition.last + 1):
                if page > partition.first:
                    time.sleep(self.pause)
                found = json.loads(self.response(page) or "{}")
                records = found if isinstance(found, list) else found.get(RECORDS) or []
                total = None if isinstance(found, list) else found.get(TOTAL)
                if not records:
                    return
                for place, record in enumerate(records):
                    yield page, place, total, json.dumps(record)

        def response(self, page: int) -> str:
            for attempt in range(1, self.attempts + 1):
                try:
                    return fetch(page)
                except OSError as error:
                    if attempt == self.attempts:
                        raise RegistryError(f"page {page} after {attempt} attempts: {error}") from error
                    time.sleep(self.wait * 2 ** (attempt - 1))

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "page int, place int, total long, record string"

        def reader(self, schema):
            return Reader(self.options)

    return Source


def read_registry(spark: SparkSession, fetch: Callable[[int], str], pages: int, **options) -> DataFrame:
    """The records (page, place and those of ``RECORD``) of a registry's pages, for ``registry_records``; see ``registry_source``."""
    source = registry_source(fetch)
    spark.dataSource.register(source)
    rows = spark.read.format(source.name()).options(pages=pages, **options).load()
    return rows.select("page", "place", F.from_json("record", RECORD).alias("r")).select("page", "place", "r.*")
