"""Runs experiment jobs side by side: each in a fair-scheduler pool of its own, with a timing record, skipped where it is done."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from gleanset.sources import results
from gleanset.sources.timing import Timing, read_text


@dataclass(frozen=True)
class Job:
    """``work`` is called with the session and the job's timing record; it returns the rows to write and the metrics."""

    name: str
    work: Callable[[SparkSession, Timing], tuple[DataFrame, dict]]


def status(spark: SparkSession, root: str, name: str) -> str | None:
    """What a job's record says (running, completed, failed); None where it never started."""
    text = read_text(spark, f"{root}/{name}/timing.json")
    return json.loads(text)["status"] if text else None


def run_one(spark: SparkSession, job: Job, root: str, force: bool = False, final_only: bool = False) -> dict:
    """One job's row of the summary. Rows and metrics are written before the record says completed, so that a job
    that was lost half-way is run again. ``final_only`` writes the metrics and no rows."""
    path = f"{root}/{job.name}"
    if not force and status(spark, root, job.name) == "completed":
        return {"job": job.name, "status": "skipped", "seconds": 0.0, "error": None}
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", job.name)
    timing = Timing(spark, f"{path}/timing.json")
    try:
        with timing:
            with timing.phase("work"):
                rows, metrics = job.work(spark, timing)
            with timing.phase("write"):
                results.write_output(rows, path, {"job": job.name, **metrics}, arrays=not final_only, overwrite=True)
    except Exception as e:  # a failed job is counted, the others go on
        return {"job": job.name, "status": "failed", "seconds": timing.record()["seconds"], "error": f"{type(e).__name__}: {e}"[:2000]}
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
    return {"job": job.name, "status": "completed", "seconds": timing.record()["seconds"], "error": None}


def run_jobs(spark: SparkSession, jobs: Iterable[Job], root: str, parallel: int = 4, **options) -> DataFrame:
    """(job, status, seconds, error) of all jobs, ``parallel`` of them at a time; see ``run_one`` for the options.

    Names must differ. Pools share the cluster evenly where spark.scheduler.mode is FAIR.
    """
    jobs = list(jobs)
    names = [j.name for j in jobs]
    if len(set(names)) < len(names):
        raise ValueError("job names must differ")
    one = inheritable_thread_target(spark)(lambda j: run_one(spark, j, root, **options))
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        found = list(pool.map(one, jobs))
    return spark.createDataFrame([(r["job"], r["status"], r["seconds"], r["error"]) for r in found], "job string, status string, seconds double, error string")
