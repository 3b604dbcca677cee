"""HTTP candle sources as Python data sources: one input partition per (symbol, window), retried, throttled, quarantined.

    spark.dataSource.register(PriceApi); spark.dataSource.register(ChartApi)
    spark.read.format("price_api").options(base_url=..., requests=json, ...).load()

`requests` is a JSON list of {"symbol", "epic", "start", "end"}, UTC ISO text without an offset. A request
that fails for good yields one row whose `error` is set and whose bar is NULL; healthy rows have a NULL error.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRY_STATUS = (500, 502, 504)
ISO = "%Y-%m-%dT%H:%M:%S"


def fetch(request: urllib.request.Request, timeout: float = 15, retries: int = 3, backoff: float = 0.5) -> tuple[bytes, dict[str, str]]:
    """Body and headers. 500, 502, 504 and connection errors are tried again, waiting backoff * 2^n."""
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return reply.read(), dict(reply.headers)
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_STATUS or attempt == retries:
                raise
        except urllib.error.URLError:
            if attempt == retries:
                raise
        time.sleep(backoff * 2**attempt)
    raise AssertionError("unreachable")


def open_session(base_url: str, api_key: str, identifier: str, password: str, **retry: float) -> tuple[str, str]:
    """Two session tokens; driver-side, never part of a plan."""
    if not (api_key and identifier and password):
        raise ValueError("missing credentials")
    body = json.dumps({"identifier": identifier, "password": password}).encode()
    request = urllib.request.Request(f"{base_url}/session", body, {"X-CAP-API-KEY": api_key, "Content-Type": "application/json"}, method="POST")
    headers = {k.upper(): v for k, v in fetch(request, **retry)[1].items()}
    return headers["CST"], headers["X-SECURITY-TOKEN"]


def clamp(start: dt.datetime, end: dt.datetime, now: dt.datetime, hours: int = 16) -> tuple[dt.datetime, dt.datetime] | None:
    """The part of a window that the source still serves, None if nothing is left."""
    oldest = now - dt.timedelta(hours=hours)
    start = oldest + dt.timedelta(minutes=1) if start < oldest else start
    end = min(end, now)
    return (start, end) if start < end else None


@dataclass
class Request(InputPartition):
    symbol: str
    epic: str
    start: str
    end: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.o = options

    def partitions(self) -> list[InputPartition]:
        hours, out = self.o.get("history_hours"), []
        now = dt.datetime.strptime(self.o["now"], ISO) if "now" in self.o else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        for r in json.loads(self.o["requests"]):
            span = dt.datetime.strptime(r["start"], ISO), dt.datetime.strptime(r["end"], ISO)
            if hours:
                span = clamp(*span, now, int(hours))
            if span:
                out.append(Request(r["symbol"], r.get("epic", r["symbol"]), *(t.strftime(ISO) for t in span)))
        return out

    def _get(self, path: str, params: dict[str, str], headers: dict[str, str]) -> bytes:
        time.sleep(float(self.o.get("pause", "0.2")))
        url = f"{self.o['base_url']}{path}?{urllib.parse.urlencode(params)}"
        return fetch(urllib.request.Request(url, headers=headers), float(self.o.get("timeout", "15")), int(self.o.get("retries", "3")), float(self.o.get("backoff", "0.5")))[0]

    def body(self, r: Request) -> bytes:
        raise NotImplementedError

    def read(self, r: Request) -> Iterator[tuple]:
        try:
            yield r.symbol, self.body(r).decode(), None
        except Exception as e:  # any failure of one request is data, as in the quarantine contract above
            yield r.symbol, None, f"{type(e).__name__}: {e}"


class _PriceReader(_Reader):
    def body(self, r: Request) -> bytes:
        params = {"resolution": "MINUTE", "max": self.o.get("max", "1000"), "from": r.start, "to": r.end}
        return self._get(f"/prices/{urllib.parse.quote(r.epic)}", params, {"X-SECURITY-TOKEN": self.o.get("token", ""), "CST": self.o.get("cst", "")})


class _ChartReader(_Reader):
    def body(self, r: Request) -> bytes:
        stamps = [str(int(dt.datetime.strptime(t, ISO).replace(tzinfo=dt.timezone.utc).timestamp())) for t in (r.start, r.end)]
        return self._get(f"/chart/{urllib.parse.quote(r.symbol)}", {"interval": "1m", "period1": stamps[0], "period2": stamps[1]}, {})


class PriceApi(DataSource):
    """Source A: bid/ask minute prices behind a session token. Rows: symbol, payload, error."""

    @classmethod
    def name(cls) -> str:
        return "price_api"

    def schema(self) -> str:
        return "symbol string, payload string, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return _PriceReader(dict(self.options))


class ChartApi(PriceApi):
    """Source B: open charts, epoch-stamped column arrays."""

    @classmethod
    def name(cls) -> str:
        return "chart_api"

    def reader(self, schema: object) -> DataSourceReader:
        return _ChartReader(dict(self.options))


CHART_SCHEMA = "timestamp array<bigint>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>"


def chart_bars(payloads: DataFrame) -> DataFrame:
    """Column-array payloads to source B bars (symbol, Datetime instant, Open..Volume)."""
    p = payloads.where(F.col("payload").isNotNull()).select("symbol", F.from_json("payload", CHART_SCHEMA).alias("p"))
    zipped = p.select("symbol", F.explode(F.arrays_zip(*[F.col(f"p.{c}").alias(c) for c in ("timestamp", "open", "high", "low", "close", "volume")])).alias("b"))
    return zipped.select(
        "symbol", F.timestamp_seconds("b.timestamp").alias("Datetime"),
        *[F.col(f"b.{c}").alias(c.capitalize()) for c in ("open", "high", "low", "close", "volume")],
    )


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(healthy payloads, quarantined requests)."""
    return rows.where(F.col("error").isNull()).drop("error"), rows.where(F.col("error").isNotNull()).select("symbol", "error")
