"""Incremental rescans: a stream of files in, changes of findings out, with digest and findings of each path kept as state.

A file that comes again with the same text costs a hash. A changed file takes its old findings back and gives its new
ones, a deleted file takes its findings back and is forgotten, and a path that isn't heard of for `ttl_ms` is forgotten
too (its findings stay as they were reported). The sum of all changes is what a full scan of the present files finds.

State is kept by path in RocksDB and checkpointed with the query; set
`spark.sql.streaming.stateStore.providerClass` to STATE_STORE.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.registry import BlockDetector, Registry, confidence

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FINDING = "detector string, start int, `end` int, score double, explanation string"
CHANGES = f"path string, seq long, sign int, {FINDING}, confidence string, error string"


class _Rescan(StatefulProcessor):
    """Digest and findings by path."""

    def __init__(self, detectors: list[type[BlockDetector]], ttl_ms: int | None) -> None:
        self._detectors, self._ttl = detectors, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        found = "array<struct<detector:string,start:int,`end`:int,score:double,explanation:string,error:string>>"
        self._state = handle.getValueState("file", f"digest string, found {found}", self._ttl)
        self._ready = [d() for d in self._detectors]

    def _find(self, text: str) -> list[tuple]:
        out: list[tuple] = []
        for detector in self._ready:
            try:
                out += [(detector.name, start, end, float(score), why, None) for start, end, score, why in detector.spans(text, None)]
            except Exception as problem:  # noqa: BLE001
                out.append((detector.name, 0, len(text), 0.0, f"detector error: {problem}", str(problem)))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        last = max(rows, key=lambda r: r["seq"])  # of several versions in one batch the latest counts
        before = self._state.get() if self._state.exists() else None
        digest = None if last["text"] is None else hashlib.sha256(last["text"].encode()).hexdigest()
        old = [tuple(x) for x in before[1]] if before else []
        if before and before[0] == digest:
            self._state.update((digest, old))  # heard of again
            return
        new = [] if last["text"] is None else self._find(last["text"])
        if last["text"] is None:
            self._state.clear()
        else:
            self._state.update((digest, new))
        for sign, found in ((-1, old), (1, new)):
            for detector, start, end, score, why, error in found:
                yield Row(path=key[0], seq=last["seq"], sign=sign, detector=detector, start=start, end=end, score=score, explanation=why, confidence=confidence(score), error=error)

    def close(self) -> None:
        pass


def rescan(files: DataFrame, registry: Registry, *names: str, ttl_ms: int | None = None) -> DataFrame:
    """CHANGES of a stream of files (path, text, seq): sign 1 adds a finding, -1 takes one back.

    A null text is a deleted file; seq orders the versions of a path. names: block detectors of the registry; one that
    raises on a text gives one finding with the error. Null paths are left out.
    """
    detectors = [registry.create(n) for n in names]
    for d in detectors:
        if not isinstance(d, type):
            raise TypeError("only block detectors run inside a stream")
    given = files.filter(F.col("path").isNotNull()).select("path", "text", F.col("seq").cast("long").alias("seq"))
    return given.groupBy("path").transformWithState(
        statefulProcessor=_Rescan(detectors, ttl_ms), outputStructType=CHANGES, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )


def present(changes: DataFrame) -> DataFrame:
    """The findings that hold after all changes (a table that the stream wrote), each with how often it holds."""
    key = [c for c in changes.columns if c not in ("seq", "sign")]
    return changes.groupBy(*key).agg(F.sum("sign").alias("n")).filter("n > 0")
