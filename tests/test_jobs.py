import json
import time

import pytest

from gleanset.plans import jobs
from gleanset.sources import results
from gleanset.sources.timing import Timing, read_text


def test_phases_nest_and_count_their_jobs(spark, tmp_path):
    path = str(tmp_path / "timing.json")
    with Timing(spark, path, heartbeat=0.05) as t:
        with t.phase("outer"):
            spark.range(10).count()
            with t.phase("inner"):
                spark.range(10).count()
            now = json.loads(read_text(spark, path))
            assert now["status"] == "running" and now["active"] == ["outer"] and now["phases"]["inner"]["count"] == 1
            before = now["heartbeat"]
            time.sleep(0.5)
            assert json.loads(read_text(spark, path))["heartbeat"] > before
        t.add("inner", 1.5)
        with pytest.raises(RuntimeError, match="innermost"):
            t.finish("outer")
    end = json.loads(read_text(spark, path))
    assert end["status"] == "completed" and end["phases"]["inner"]["count"] == 2 and end["phases"]["inner"]["seconds"] >= 1.5
    assert end["phases"]["outer"]["jobs"].get("succeeded", 0) >= 1 and end["phases"]["inner"]["jobs"].get("succeeded", 0) >= 1
    assert [e["event"] for e in end["events"]] == ["start", "start", "finish", "finish", "duration"]
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".tmp")] == []


def test_a_phase_that_dies_reads_failed(spark, tmp_path):
    path = str(tmp_path / "timing.json")
    with pytest.raises(ValueError, match="broken"), Timing(spark, path) as t, t.phase("bad"):
        raise ValueError("broken")
    end = json.loads(read_text(spark, path))
    assert end["status"] == "failed" and end["error"] == "broken" and end["active"] == [] and end["phases"]["bad"]["count"] == 1
    assert read_text(spark, str(tmp_path / "none.json")) is None


def test_jobs_fail_finish_and_are_skipped(spark, tmp_path):
    calls = []

    def good(s, timing):
        calls.append("good")
        with timing.phase("count"):
            n = s.range(7).count()
        return s.range(n), {"accuracy": 0.5}

    def bad(s, timing):
        calls.append("bad")
        raise ValueError("no data")

    root = str(tmp_path)
    of = lambda df: {r.job: (r.status, r.error) for r in df.collect()}
    made = [jobs.Job("good", good), jobs.Job("bad", bad)]
    assert of(jobs.run_jobs(spark, made, root, 2)) == {"good": ("completed", None), "bad": ("failed", "ValueError: no data")}
    assert results.read_metadata(spark, f"{root}/good") == {"job": "good", "accuracy": 0.5} and spark.read.parquet(f"{root}/good/rows").count() == 7
    assert jobs.status(spark, root, "bad") == "failed" and jobs.status(spark, root, "never") is None
    assert of(jobs.run_jobs(spark, made, root, 2))["good"][0] == "skipped" and sorted(calls) == ["bad", "bad", "good"]
    assert of(jobs.run_jobs(spark, made[:1], root, force=True))["good"][0] == "completed"
    only = jobs.run_one(spark, jobs.Job("small", good), root, final_only=True)
    assert only["status"] == "completed" and not (tmp_path / "small" / "rows").exists()
    with pytest.raises(ValueError, match="differ"):
        jobs.run_jobs(spark, [made[0], made[0]], root)
