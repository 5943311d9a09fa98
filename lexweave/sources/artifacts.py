"""Folders of artifacts that are whole or absent: each step is written beside what stands, and counts once a manifest names it.

Under the folder: ``_manifests/<number>.json`` and a folder for each step's version. A manifest states every step and its
version, the largest number counts, and it appears by one rename of a finished file. A writer that dies leaves a version that
no manifest names: readers never see it, the next commit of the step removes it, and a run goes on after the last step
that was committed. Two writers of one folder can't both take a number; the later one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.plans.session import remove

MANIFESTS = "_manifests"


class Conflict(RuntimeError):
    """Another writer has committed to the folder meanwhile."""


class Artifacts:
    """The steps under ``path``, in any store that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str = "") -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names(MANIFESTS) if n.removesuffix(".json").isdigit()]

    def manifest(self) -> dict[str, dict]:
        """Step -> its version and facts, as last committed; none for a folder that isn't there."""
        numbers = self._numbers()
        if not numbers:
            return {}
        stream = self._fs.open(self._at(f"{MANIFESTS}/{max(numbers):08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))["steps"]
        finally:
            stream.close()

    def _publish(self, steps: dict[str, dict], after: int) -> None:
        draft, final = self._at(f"{MANIFESTS}/draft-{uuid.uuid4()}"), self._at(f"{MANIFESTS}/{after + 1:08d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps({"steps": steps}, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"{self.path}: manifest {after + 1} is there already")
        for n in self._numbers():
            if n < after:  # the one before stays for readers that have just listed it
                self._fs.delete(self._at(f"{MANIFESTS}/{n:08d}.json"), False)

    def commit(self, step: str, write: Callable[[str], None], **facts) -> None:
        """``write`` fills a new folder; then the step, with its facts, is that folder. What it was before goes afterwards."""
        number = max(self._numbers(), default=0)
        steps = self.manifest()
        version = f"{step}-{uuid.uuid4()}"
        write(f"{self.path}/{version}")
        self._publish(steps | {step: {"version": version, **facts}}, number)
        for name in self._names():
            if name.startswith(f"{step}-") and name != version and len(name) == len(version):
                remove(self.spark, f"{self.path}/{name}")

    def has(self, step: str, **facts) -> bool:
        """Whether the step is committed with these facts."""
        found = self.manifest().get(step)
        return found is not None and all(found.get(k) == v for k, v in facts.items())

    def folder(self, step: str) -> str:
        """Where the step's rows are; a LookupError before its first commit."""
        found = self.manifest().get(step)
        if found is None:
            raise LookupError(f"{self.path} has no {step}")
        return f"{self.path}/{found['version']}"

    def facts(self, step: str) -> dict:
        return {k: v for k, v in self.manifest()[step].items() if k != "version"}

    def resume(self, steps: list[tuple[str, Callable[[DataFrame | None], DataFrame]]], **facts) -> DataFrame:
        """Runs the steps in order, each on the rows of the one before (None for the first), written as Parquet. Steps that an
        earlier run with the same facts has committed are not run again; once one is run, all later ones are."""
        done, last = True, None
        for name, make in steps:
            done = done and self.has(name, **facts)
            if not done:
                rows = make(last)
                self.commit(name, rows.write.parquet, **facts)
            last = self.spark.read.parquet(self.folder(name))
        return last
