"""Stages that write their results: chosen, skipped where done, forced, or only listed."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """run gives what is written as Parquet to out; every path of needs must exist before."""

    name: str
    out: str
    run: Callable[[SparkSession], DataFrame]
    needs: tuple[str, ...] = ()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system its scheme names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def run_stages(spark: SparkSession, stages: Iterable[Stage], only: set[str] | None = None, force: bool = False, dry_run: bool = False) -> list[tuple[str, str]]:
    """(name, ran | skipped | planned) per chosen stage, in order. A stage is done once its output was committed whole."""
    stages, said = list(stages), []
    if only and (unknown := only - {s.name for s in stages}):
        raise ValueError(f"no such stage: {', '.join(sorted(unknown))}")
    for s in stages:
        if only and s.name not in only:
            continue
        if not force and exists(spark, f"{s.out}/_SUCCESS"):
            said.append((s.name, "skipped"))
        elif dry_run:
            said.append((s.name, "planned"))
        else:
            if missing := [p for p in s.needs if not exists(spark, p)]:
                raise FileNotFoundError(f"{s.name} needs {', '.join(missing)}")
            s.run(spark).write.mode("overwrite").parquet(s.out)
            said.append((s.name, "ran"))
    return said


def best_epoch(log: DataFrame, monitor: str) -> DataFrame:
    """epoch and monitor of the best row of a training log; the earlier epoch wins a tie."""
    return log.where(f"{monitor} is not null").orderBy(log[monitor].desc(), "epoch").select("epoch", monitor).limit(1)
