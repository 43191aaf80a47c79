"""Several collectors until a deadline: what came is kept, what didn't is named."""

from __future__ import annotations

import concurrent.futures as cf
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

STATUS = "source string, status string, n_docs int, error string"


class Partial(Exception):
    """Rows that were collected before a failure."""

    def __init__(self, rows: list[tuple], reason: str):
        super().__init__(reason)
        self.rows = rows


def poll(spark: SparkSession, jobs: dict[str, Callable[[], list[tuple]]], budget: float, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, status): status is complete, partial, timeout or error. Collectors run side by side on the driver, as they wait
    for networks; rows of a late one are not taken."""
    pool = cf.ThreadPoolExecutor(max(1, len(jobs)))
    end = time.monotonic() + max(0.0, budget)
    futures = {name: pool.submit(job) for name, job in jobs.items()}
    rows, status = [], []
    for name, f in futures.items():
        try:
            got = f.result(max(0.0, end - time.monotonic()))
            rows += got
            status.append((name, "complete", len(got), None))
        except cf.TimeoutError:
            f.cancel()
            status.append((name, "timeout", None, None))
        except Partial as e:
            rows += e.rows
            status.append((name, "partial", len(e.rows), str(e)))
        except Exception as e:  # one collector's failure isn't the others'
            status.append((name, "error", None, type(e).__name__))
    pool.shutdown(wait=False, cancel_futures=True)
    return spark.createDataFrame(rows, schema), spark.createDataFrame(status, STATUS)
