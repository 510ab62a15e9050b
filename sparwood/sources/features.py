"""A paged feature server (GeoJSON over HTTP) as a Spark data source: one partition per page.

Options: url, typename, pageSize (1000), cql (a filter text), attempts (3). The schema is given by the reader; column
``geometry`` receives the feature's geometry as GeoJSON text, ``page_no`` its page. The number of features that the
server announces is fetched when the read is planned; a page that comes back short of it fails the task.

Filters on columns go to the server: comparisons, IN, IS NULL and what negates these, as far as a filter text can say them exactly;
Spark keeps the others. An annulus around a place is asked for by the option of that name (:func:`annulus_text`).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not,
)
from pyspark.sql.types import StructType

from ..session import drop_stored, stored


def fetch(url: str, attempts: int = 3, wait: float = 1.0) -> bytes:
    """Body of a page; time-outs, lost connections and server errors are tried again after 1, 2, ... seconds."""
    for i in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=60) as page:
                return page.read()
        except urllib.error.HTTPError as e:
            if e.code < 500 or i == attempts - 1:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if i == attempts - 1:
                raise
        time.sleep(wait * 2**i)
    raise ValueError("attempts must be positive")


def page_url(options: dict, start: int, count: int) -> str:
    query = {"service": "WFS", "request": "GetFeature", "typeNames": options["typename"], "outputFormat": "application/json", "startIndex": start, "count": count}
    if options.get("cql"):
        query["cql_filter"] = options["cql"]
    return options["url"] + "?" + urllib.parse.urlencode(query)


def annulus_text(geometry: str, x: float, y: float, outer: float, inner: float = 0.0) -> str:
    """Filter text: within outer of a place and beyond inner, the northing first as servers want it; without inner the whole disc."""
    if inner >= outer:
        raise ValueError("the inner radius must be smaller than the outer one")
    at = f"POINT({y:.3f} {x:.3f})"
    text = f"DWITHIN({geometry}, {at}, {outer:g}, meters)"
    return f"{text} AND BEYOND({geometry}, {at}, {inner:g}, meters)" if inner else text


def _literal(v) -> str | None:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)) and v == v:
        return repr(v)
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else None


def filter_text(f: Filter) -> str | None:
    """A filter as text for the server; None if it can't be said."""
    if isinstance(f, Not):
        inner = filter_text(f.child)
        return inner and f"NOT ({inner})"
    name = getattr(f, "attribute", ())
    if len(name) != 1 or name[0] in ("geometry", "page_no"):
        return None
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{name[0]} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL"
    if isinstance(f, In):
        values = [_literal(v) for v in f.value]
        return f"{name[0]} IN ({','.join(values)})" if values and None not in values else None
    sign = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}.get(type(f))
    value = _literal(f.value) if sign else None
    return f"{name[0]} {sign} {value}" if value else None


class Page(InputPartition):
    def __init__(self, no: int, start: int, count: int):
        self.no, self.start, self.count = no, start, count


class FeatureReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)
        self.size = int(options.get("pagesize", options.get("pageSize", 1000)))
        self.attempts = int(options.get("attempts", 3))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Sends to the server what it can be told; the others, which are given back, are left to Spark."""
        for f in filters:
            if text := filter_text(f):
                self.options["cql"] = f"({self.options['cql']}) AND {text}" if self.options.get("cql") else text
            else:
                yield f

    def partitions(self) -> list[Page]:
        total = int(json.loads(fetch(page_url(self.options, 0, 1), self.attempts))["totalFeatures"])
        return [Page(i, s, min(self.size, total - s)) for i, s in enumerate(range(0, total, self.size))] or [Page(0, 0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.count:
            return
        features = json.loads(fetch(page_url(self.options, partition.start, partition.count), self.attempts))["features"]
        if len(features) != partition.count:
            raise RuntimeError(f"page {partition.no} has {len(features)} features instead of {partition.count}")
        for f in features:
            p = f.get("properties") or {}
            own = {"geometry": json.dumps(f["geometry"]) if f.get("geometry") else None, "page_no": partition.no}
            yield tuple(own[c.name] if c.name in own else p.get(c.name) for c in self.schema)


class FeatureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "features"

    def schema(self) -> str:
        return "geometry string, page_no int"

    def reader(self, schema: StructType) -> FeatureReader:
        return FeatureReader(schema, self.options)


def read_features(spark: SparkSession, url: str, typename: str, schema: str, **options: str) -> DataFrame:
    spark.dataSource.register(FeatureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("features").schema(schema).options(url=url, typename=typename, **options).load()


def keyed_features(ids: DataFrame, url: str, typename: str, schema: str, key: str, batch: int = 500, attempts: int = 3) -> DataFrame:
    """Rows of the given ids (column key), asked for by the tasks that hold them, so many at a time; no ids, no request and no rows."""
    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            values = rows[key].tolist()
            for i in range(0, len(values), batch):
                options = {"url": url, "typename": typename, "cql": f"{key} IN ({','.join(map(str, values[i : i + batch]))})", "pagesize": 1000, "attempts": attempts}
                reader = FeatureReader(fields, options)
                yield pd.DataFrame([r for page in reader.partitions() for r in reader.read(page)], columns=fields.names)

    return ids.select(key).dropna().distinct().mapInPandas(run, fields)


def counted(df: DataFrame, expected: int) -> DataFrame:
    """The rows, if their number is the one announced; else an error."""
    if (n := df.count()) != expected:
        raise RuntimeError(f"{n} rows instead of {expected}")
    return df


def layers(spark: SparkSession, path: str) -> DataFrame:
    """Name, title and abstract of a capabilities document's layers (JSON list), sorted by name."""
    return spark.read.json(path, multiLine=True).select("name", "title", "abstract").orderBy("name")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns asked for; an error names those that are missing."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def publish(df: DataFrame, path: str) -> None:
    """Write, unless there is nothing to publish, which is an error and leaves no file; rows are worked out once."""
    ready = stored(df, "publish")
    try:
        if ready.isEmpty():
            raise RuntimeError("nothing to publish")
        ready.write.mode("error").parquet(path)
    finally:
        drop_stored(ready)


def write_layers(layers: DataFrame, path: str) -> None:
    """A server's layers, some tens, as one readable JSON file; its folder is made."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps([r.asDict(recursive=True) for r in layers.collect()], indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def labelled(df: DataFrame, classifier: DataFrame, code: str, label: str) -> DataFrame:
    """Label of a code from a classifier table (kood, kirjeldus); unknown codes get null. Small classifiers are broadcast by size."""
    c = classifier.select(F.col("kood").alias(code), F.col("kirjeldus").alias(label)).dropDuplicates([code])
    return df.drop(label).join(c, code, "left")
