"""Bounded downloads: hosts are asked no faster than a rate, and no answer is read beyond a size or a time.

Addresses are dealt to tasks by host, so that one task keeps a host's pace. A host with very many addresses
may be dealt over `slots` tasks, each of which keeps a `slots`-th of its rate. Reasons are values, not
exceptions: one bad address does not fail a task.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "url string, status int, content binary, skip_reason string, seconds double"
_ARROW = pa.schema([("url", pa.string()), ("status", pa.int32()), ("content", pa.binary()), ("skip_reason", pa.string()), ("seconds", pa.float64())])


@dataclass(frozen=True)
class Limits:
    most_bytes: int = 50_000_000
    seconds: float = 60.0  # for a whole answer
    per_second: float = 1.0  # requests to a host
    slots: int = 1  # tasks that may ask one host
    tries: int = 3  # for answers 429 and 5xx and broken connections
    wait: float = 1.0  # before the second try; it doubles
    agent: str = "corpusmill"


def fetch(url: str, limits: Limits) -> tuple[int | None, bytes | None, str | None]:
    """(status, content, reason) of one address; reading stops at the first byte too many."""
    import urllib.error
    import urllib.request

    if not url.lower().startswith(("http://", "https://")):
        return None, None, "download_bad_address"
    began, status, reason = time.monotonic(), None, None
    for k in range(limits.tries):
        if k:
            time.sleep(limits.wait * 2 ** (k - 1))
        left = limits.seconds - (time.monotonic() - began)
        if left <= 0:
            return status, None, "download_too_slow"
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": limits.agent}), timeout=left) as answer:
                status = answer.status
                if int(answer.headers.get("Content-Length") or 0) > limits.most_bytes:
                    return status, None, "download_too_large"
                content = bytearray()
                while part := answer.read1(1 << 16):
                    content += part
                    if len(content) > limits.most_bytes:
                        return status, None, "download_too_large"
                    if time.monotonic() - began > limits.seconds:
                        return status, None, "download_too_slow"
                return status, bytes(content), None
        except urllib.error.HTTPError as e:
            status, reason = e.code, "download_refused"
            if e.code != 429 and e.code < 500:
                break
        except TimeoutError:
            reason = "download_too_slow"
        except Exception as e:  # noqa: BLE001  whatever a host answers is a reason, not a failure of the task
            reason = "download_too_slow" if isinstance(getattr(e, "reason", None), TimeoutError) else "download_failed"
    return status, None, reason


def download(addresses: DataFrame, url: str = "url", limits: Limits = Limits(), tasks: int | None = None) -> DataFrame:
    """url, status, content, skip_reason and seconds of each distinct address. Null addresses are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: dict[tuple[str, int], float] = {}  # when a host may be asked again
        gap = limits.slots / limits.per_second
        for b in batches:
            for address, host, slot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                now = time.monotonic()
                begin = max(now, free.get((host, slot), 0.0))
                time.sleep(begin - now)
                free[host, slot] = begin + gap
                status, content, reason = fetch(address, limits)
                yield pa.RecordBatch.from_pylist([{"url": address, "status": status, "content": content, "skip_reason": reason, "seconds": time.monotonic() - begin}], schema=_ARROW)

    a = addresses.select(F.col(url).alias("url")).where("url is not null").distinct()
    a = a.withColumn("host", F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit(""))).withColumn("slot", F.pmod(F.xxhash64("url"), F.lit(limits.slots)).cast("int"))
    n = tasks or addresses.sparkSession.sparkContext.defaultParallelism
    return a.repartition(n, "host", "slot").mapInArrow(run, RESULT)
