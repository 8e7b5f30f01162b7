"""REST scan as a Python data source: one partition per endpoint, read page by page.

    spark.dataSource.register(StationApi)
    spark.read.format("station_api").option("endpoints", json.dumps([{"path": "locations", "params": {...}}])).load()

Rows are (endpoint, key, body, error), a row per page; ``sources.station_json`` flattens the bodies.
"""
from __future__ import annotations

import json
import urllib.parse
import urllib.request
from datetime import date, timedelta

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual)


class Endpoint(InputPartition):
    def __init__(self, path: str, params: dict, key: str | None):
        self.path, self.params, self.key = path, params, key


class StationApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "station_api"

    def schema(self) -> str:
        return "endpoint STRING, key STRING, body STRING, error STRING"

    def reader(self, schema):
        return StationApiReader(self.options)


class StationApiReader(DataSourceReader):
    """Options: ``endpoints`` (JSON list of {path, params, key}), ``base``, ``timeout``, ``api_key``, ``on_error``.

    An endpoint with a ``limit`` is read page by page until a page is empty (a server may give fewer results a page than
    asked for) or repeats the one before. ``base`` is needed. ``on_error`` is raise, or row: an endpoint that fails then
    ends in a row without body that holds the error.
    """

    def __init__(self, options):
        self.base = options.get("base", "").rstrip("/")
        self.timeout = float(options.get("timeout", "25"))
        self.api_key = options.get("api_key", "")
        self.error_rows = options.get("on_error", "raise") == "row"
        self.endpoints = json.loads(options.get("endpoints", "[]"))

    def partitions(self):
        return [Endpoint(e["path"], e.get("params", {}), e.get("key")) for e in self.endpoints]

    def read(self, part):
        if part is None:  # no endpoint
            return
        try:
            for body, _ in self._pages(part.path, part.params):
                yield (part.path, part.key, body, None)
        except Exception as e:
            if not self.error_rows:
                raise
            yield (part.path, part.key, None, f"{type(e).__name__}: {e}")

    def _pages(self, path: str, params: dict):
        """(body, results) of each page; the first one also if it is empty."""
        page, before = 1, None
        while True:
            body = self._get(path, params if page == 1 else {**params, "page": page})
            results = json.loads(body).get("results") or [] if params.get("limit") else None
            if page > 1 and (not results or body == before):
                return
            yield body, results
            if not results:
                return
            page, before = page + 1, body

    def _get(self, path: str, params: dict) -> str:
        if not self.base:
            raise ValueError("the option base, the address of the API, is needed")
        url = f"{self.base}/{path.lstrip('/')}"
        if params:
            url += "?" + urllib.parse.urlencode(params)
        headers = {"Accept": "application/json"}
        if self.api_key:
            headers["X-API-Key"] = self.api_key
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=self.timeout) as r:
            return r.read().decode("utf-8")


class SensorRange(InputPartition):
    def __init__(self, sensor: int, first: str | None, last: str | None):
        self.sensor, self.first, self.last = sensor, first, last


class SensorDays(DataSource):
    """Daily values of sensors: (sensor_id, day, body, error), a row per result. Filters on sensor_id and day choose the
    endpoints and go to the server (``spark.sql.python.filterPushdown.enabled``); Spark keeps all others."""

    @classmethod
    def name(cls) -> str:
        return "sensor_days"

    def schema(self) -> str:
        return "sensor_id BIGINT, day DATE, body STRING, error STRING"

    def reader(self, schema):
        return SensorDaysReader(self.options)


class SensorDaysReader(StationApiReader):
    """Options besides those of ``StationApiReader``: ``sensors`` (JSON list of ids), ``date_from`` and ``date_to`` (both
    inclusive), ``days`` of a partition (30), ``limit`` of a page (100). A range with both ends is read in parts."""

    def __init__(self, options):
        super().__init__(options)
        self.sensors = [int(s) for s in json.loads(options.get("sensors", "[]"))]
        self.first = date.fromisoformat(options["date_from"]) if options.get("date_from") else None
        self.last = date.fromisoformat(options["date_to"]) if options.get("date_to") else None
        self.days, self.limit = int(options.get("days", "30")), int(options.get("limit", "100"))

    def pushFilters(self, filters):
        for f in filters:
            name, value = f.attribute, getattr(f, "value", None)
            if name == ("sensor_id",) and isinstance(f, (EqualTo, In)):
                wanted = set(value) if isinstance(f, In) else {value}
                self.sensors = [s for s in self.sensors if s in wanted]
            elif name == ("day",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    least = value + timedelta(days=isinstance(f, GreaterThan))
                    self.first = max(self.first or least, least)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    most = value - timedelta(days=isinstance(f, LessThan))
                    self.last = min(self.last or most, most)
            else:
                yield f

    def partitions(self):
        if self.first and self.last:
            starts = [self.first + timedelta(days=i) for i in range(0, (self.last - self.first).days + 1, self.days)]
            ranges = [(s, min(s + timedelta(days=self.days - 1), self.last)) for s in starts]
        else:
            ranges = [(self.first, self.last)]
        return [SensorRange(s, a and a.isoformat(), b and b.isoformat()) for s in self.sensors for a, b in ranges]

    def read(self, part):
        if part is None:  # no sensor or no day
            return
        params = {k: v for k, v in (("date_from", part.first), ("date_to", part.last)) if v} | {"limit": self.limit}
        try:
            for _, results in self._pages(f"sensors/{part.sensor}/days", params):
                for r in results or []:
                    stamp = (((r.get("period") or {}).get("datetimeFrom") or {}).get("utc") or "")[:10]
                    day = date.fromisoformat(stamp) if stamp else None
                    # What is pushed is not checked again by Spark; a server may round a range up.
                    if (part.first or part.last) and (day is None or (part.first or stamp) > stamp or (part.last or stamp) < stamp):
                        continue
                    yield (part.sensor, day, json.dumps(r), None)
        except Exception as e:
            if not self.error_rows:
                raise
            yield (part.sensor, None, None, f"{type(e).__name__}: {e}")


def location_endpoint(lat: float, lon: float, radius: int = 25_000, limit: int = 100, iso: str | None = "IN") -> dict:
    params = {"coordinates": f"{lat},{lon}", "radius": radius, "limit": limit}
    if iso:
        params["iso"] = iso
    return {"path": "locations", "params": params}


def latest_endpoints(location_ids: list[int]) -> list[dict]:
    return [{"path": f"locations/{i}/latest", "params": {"limit": 100}, "key": str(i)} for i in location_ids]


def day_endpoints(sensor_ids: list[int], date_from: str, date_to: str) -> list[dict]:
    params = {"date_from": date_from, "date_to": date_to, "limit": 100}
    return [{"path": f"sensors/{i}/days", "params": params, "key": str(i)} for i in sensor_ids]


def measurement_endpoints(sensor_ids: list[int], datetime_from: str) -> list[dict]:
    """The time filter goes to the server; ``readings.since`` applies it again."""
    params = {"datetime_from": datetime_from, "limit": 1000}
    return [{"path": f"sensors/{i}/measurements", "params": params, "key": str(i)} for i in sensor_ids]
