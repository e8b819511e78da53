"""Harvested metadata: saved OAI-PMH pages, and a live reader that follows resumption tokens."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = ("title", "creator", "type", "date", "rights", "language", "identifier", "description")
SCHEMA = "header struct<identifier:string,status:string>, " + ", ".join(f"{f} array<string>" for f in FIELDS)
OAI, DC = "{http://www.openarchives.org/OAI/2.0/}", "{http://purl.org/dc/elements/1.1/}"


def dc_values(values):
    """An array's values, trimmed, blanks dropped."""
    return F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")


def parse_page(xml: str) -> tuple[list[dict], str | None]:
    """(records, resumption token or None) of a ListRecords page."""
    root = ET.fromstring(xml)
    records = []
    for r in root.iter(f"{OAI}record"):
        h = r.find(f"{OAI}header")
        row = {"header": {"identifier": None if h is None else h.findtext(f"{OAI}identifier"), "status": None if h is None else h.get("status")}}
        for f in FIELDS:
            row[f] = [e.text.strip() for e in r.iter(f"{DC}{f}") if e.text and e.text.strip()]
        records.append(row)
    token = root.find(f".//{OAI}resumptionToken")
    return records, (token.text or "").strip() or None if token is not None else None


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """Records of saved pages, one XML file each; files are read and parsed where they lie."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [r for xml in p["value"] for r in parse_page(xml)[0]]
            yield pd.DataFrame(rows, columns=["header", *FIELDS])

    return spark.read.text(path, wholetext=True).mapInPandas(run, SCHEMA)


def http_get(url: str, params: dict, retries: int = 5, wait: float = 1.0) -> str:
    """GET with retries on connection errors, 429 and 5xx, waiting twice as long each time."""
    import time
    from urllib.error import HTTPError, URLError
    from urllib.parse import urlencode
    from urllib.request import urlopen

    for k in range(retries):
        try:
            with urlopen(f"{url}?{urlencode(params)}", timeout=60) as r:
                return r.read().decode("utf-8", "replace")
        except HTTPError as e:
            if e.code not in (429, 500, 502, 503, 504) or k == retries - 1:
                raise
        except URLError:
            if k == retries - 1:
                raise
        time.sleep(wait * 2**k)
    raise RuntimeError("unreachable")


def pages(url: str, date_from: str | None, date_until: str | None, get: Callable[[str, dict], str] = http_get) -> Iterator[list[dict]]:
    """Pages of records; the date range goes to the server."""
    params = {"verb": "ListRecords", "metadataPrefix": "oai_dc"} | ({"from": date_from} if date_from else {}) | ({"until": date_until} if date_until else {})
    while params:
        records, token = parse_page(get(url, params))
        if records:
            yield records
        params = {"verb": "ListRecords", "resumptionToken": token} if token else None


class Year(InputPartition):
    def __init__(self, year: int):
        self.value = year


class OaiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.first, self.last = options["url"], int(options["first_year"]), int(options["last_year"])

    def partitions(self):
        return [Year(y) for y in range(self.first, self.last + 1)]

    def read(self, partition: Year):
        for records in pages(self.url, f"{partition.value}-01-01", f"{partition.value}-12-31"):
            for r in records:
                yield ((r["header"]["identifier"], r["header"]["status"]), *[r[f] for f in FIELDS])


class OaiSource(DataSource):
    """spark.dataSource.register(OaiSource); spark.read.format("oai").option("url", ...)
    .option("first_year", ...).option("last_year", ...).load(): one task for each year of datestamps."""

    @classmethod
    def name(cls) -> str:
        return "oai"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return OaiReader(self.options)
