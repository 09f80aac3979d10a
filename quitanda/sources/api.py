"""Paged JSON API as a Spark data source.

``spark.read.format("paged_json").schema(ddl).option("url", ".../vendas?page={page}&size={size}&since={since}")``.
Pages are spread over ``partitions`` tasks; each task reads every n-th page until it meets an empty one, or up
to the number of ``pages`` where the API declares it. An error, a missing page included, fails the load.
"""

from __future__ import annotations

import json
from urllib.request import urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        raise ValueError("give the schema of the records with .schema(...)")

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(schema, self.options)


class _PageReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = schema.names
        self.url = options["url"]
        self.size = int(options.get("page_size", "500"))
        self.since = options.get("since", "")
        self.records = options.get("records")
        self.tasks = int(options.get("partitions", "8"))
        self.pages = int(options["pages"]) if "pages" in options else None

    def partitions(self):
        return [InputPartition(i) for i in range(self.tasks)]

    def page(self, number: int) -> list[dict]:
        url = self.url.format(page=number, size=self.size, since=self.since)
        with urlopen(url, timeout=60) as answer:
            body = json.load(answer)
        return body[self.records] if self.records else body

    def read(self, partition):
        number = partition.value
        while (self.pages is None or number < self.pages) and (rows := self.page(number)):
            for r in rows:
                yield tuple(r.get(n) for n in self.names)
            number += self.tasks


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
