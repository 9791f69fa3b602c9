"""Running experiments one after another: isolated by job tags, with limits of time and memory, resumable.

    python -m depscope.plans.runner FILE [--experiment NAME]... [--force] [--dry-run]
"""

from __future__ import annotations

import argparse
import csv
import io
import json
import os
import sys
import threading
import time
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from depscope.operators.reliability import ReliabilityConfig, reliability
from depscope.operators.sampling import with_row_ids
from depscope.plans.experiments import ConfigError, Run, expand_runs, load_experiments
from depscope.plans.score import score
from depscope.sources.readers import read_results, violation_rows
from depscope.sources.sinks import flat_results


def measure(df: DataFrame, run: Run) -> dict:
    """The measures of a run's dependency, as a dictionary."""
    e = run.experiment
    out = {}
    plain = [m for m in e.measures if m != "reliability"]
    if plain:
        rows = score(df, e.fd, plain).collect()
        out |= rows[0].asDict() if rows else {}
    if "reliability" in e.measures:
        if e.mode == "clean":
            listed = violation_rows(df.sparkSession.createDataFrame([(e.violations,)], "listed string"), "listed")
            out |= reliability(with_row_ids(df), e.fd, ReliabilityConfig.clean(), given=listed, id_col="row_id").first().asDict()
        else:
            out |= reliability(df, e.fd).first().asDict()
    return {k: v for k, v in out.items() if k != "fd_id"}


def memory_in_use(spark: SparkSession) -> int:
    """Bytes of heap that the driver uses now, and the highest that each executor has reported."""
    jvm = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    used = jvm.totalMemory() - jvm.freeMemory()
    if not spark.sparkContext.master.startswith("local"):
        listed = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        for i in range(listed.size()):
            peak = listed.apply(i).peakMemoryMetrics()
            if listed.apply(i).id() != "driver" and peak.isDefined():
                used += peak.get().getMetricValue("JVMHeapMemory")
    return used


class Watch(threading.Thread):
    """Looks at a run's time and memory and cancels its jobs when a limit is passed; ``over`` says which."""

    def __init__(self, spark: SparkSession, run: Run, pause: float = 0.2):
        super().__init__(daemon=True)
        self.spark, self.run_, self.pause = spark, run, pause
        self.over, self.peak, self.ended = None, 0, threading.Event()
        self.until = time.monotonic() + run.timeout

    def run(self) -> None:
        while not self.ended.is_set():
            self.peak = max(self.peak, memory_in_use(self.spark))
            if self.run_.memory_limit is not None and self.peak > self.run_.memory_limit:
                self.over = self.over or "MEMORY_LIMIT"
            elif time.monotonic() >= self.until:
                self.over = self.over or "TIMEOUT"
            if self.over:  # again and again: a run may start further jobs
                self.spark.interruptTag(self.run_.run_id)
            self.ended.wait(min(self.pause, max(0.01, self.until - time.monotonic())))

    def stop(self) -> None:
        self.ended.set()
        self.join()


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def execute(spark: SparkSession, run: Run, table: Callable[[str], DataFrame]) -> dict:
    """The record of a run; status is SUCCESS, FAILED, TIMEOUT, MEMORY_LIMIT or INTERRUPTED.

    Beyond a limit its jobs are cancelled. An interrupt from the keyboard ends the run and is
    recorded, for the caller to stop.
    """
    e = run.experiment
    record = {"run_id": run.run_id, "experiment": e.name, "repetition": run.repetition, "timeout": run.timeout, "memory_limit": run.memory_limit, "args": e.args, "started_at_utc": _now()}
    record |= {"command": ["score", e.table, "|".join(e.fd.lhs), e.fd.rhs, e.mode, *e.measures], "tags": {k: str(v) for k, v in e.tags.items()}, "metrics": {}}
    before = {k: spark.conf.get(k, None) for k in e.environment}
    watch = Watch(spark, run)
    began = time.monotonic()
    spark.addTag(run.run_id)
    watch.start()
    try:
        for k, v in e.environment.items():
            spark.conf.set(k, v)
        found = measure(table(e.table), run)
        record |= {"status": "SUCCESS", "metrics": {k: str(v) for k, v in found.items()}}
    except KeyboardInterrupt:
        spark.interruptTag(run.run_id)
        record |= {"status": "INTERRUPTED", "error": "interrupted"}
    except Exception as error:  # a run that fails is a result; the next one goes on
        record |= {"status": "FAILED", "error": str(error)[:2000]}
    finally:
        watch.stop()
        spark.removeTag(run.run_id)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if watch.over and record["status"] != "INTERRUPTED":
        record |= {"status": watch.over, "metrics": {}}
    codes = {"SUCCESS": 0, "INTERRUPTED": 130}
    return record | {"exit_code": codes.get(record["status"], 1), "peak_memory_mb": watch.peak / 2**20, "wall_time_ms": (time.monotonic() - began) * 1000, "ended_at_utc": _now()}


def _put(to: Path, text: str) -> Path:
    """Write a file in one step."""
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_name(to.name + ".part")
    part.write_text(text, encoding="utf-8")
    os.replace(part, to)
    return to


def save(record: dict, folder: Path) -> Path:
    """Write result.json of a run in one step."""
    return _put(folder / "runs" / record["run_id"] / "result.json", json.dumps(record, indent=2, sort_keys=True, default=str))


def rebuild_results(spark: SparkSession, folder: Path) -> Path:
    """results.csv from all results there are, one line a run; unreadable results are left out."""
    flat = flat_results(read_results(spark, str(folder)).orderBy("run_id"))
    text = io.StringIO()
    lines = csv.writer(text, lineterminator="\n")
    lines.writerow(flat.columns)
    lines.writerows(flat.toLocalIterator())
    return _put(folder / "results.csv", text.getvalue())


def run_all(spark: SparkSession, runs: list[Run], folder: str, table: Callable[[str], DataFrame], *, force: bool = False) -> list[dict]:
    """Execute runs without a result (all, if ``force``) and return their records.

    results.csv is rebuilt after each. An interrupted run has no result, so that it is made again, and
    is the last.
    """
    out = []
    for run in runs:
        if force or not (Path(folder) / "runs" / run.run_id / "result.json").exists():
            record = execute(spark, run, table)
            out.append(record)
            if record["status"] == "INTERRUPTED":
                break
            save(record, Path(folder))
            rebuild_results(spark, Path(folder))
    return out


def main(args: list[str] | None = None) -> int:
    """0: all runs of the file have a result; 2: the file or the arguments are wrong; 130: interrupted."""
    parser = argparse.ArgumentParser(prog="depscope.plans.runner")
    parser.add_argument("file")
    parser.add_argument("--experiment", action="append", default=[])
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    said = parser.parse_args(args)
    try:
        experiments, settings = load_experiments(said.file)
        if unknown := set(said.experiment) - {e.name for e in experiments}:
            raise ConfigError(f"no experiment {', '.join(sorted(unknown))}")
        chosen = [e for e in experiments if not said.experiment or e.name in said.experiment]
        runs = expand_runs(chosen, settings.get("repetitions", 1), settings.get("timeout", "12h"), settings.get("memory_limit"))
    except (ConfigError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    if said.dry_run:
        print("\n".join(r.run_id for r in runs))
        return 0
    spark = SparkSession.builder.getOrCreate()
    base = settings.get("working_directory", ".")

    def table(path: str) -> DataFrame:
        full = path if "://" in path else str(Path(base) / path)
        return spark.read.parquet(full) if ".parquet" in path else spark.read.csv(full, header=True)

    records = run_all(spark, runs, settings.get("results_directory", "results"), table, force=said.force)
    for record in records:
        print(record["run_id"], record["status"])
    return 130 if any(r["status"] == "INTERRUPTED" for r in records) else 0


if __name__ == "__main__":
    sys.exit(main())
