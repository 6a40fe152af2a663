"""The solver loop: stop test, history, logging, checkpoints; steps define the mathematics.

What a step changes in the state is written as one table to the shared folder (or to `folder`), so plans stay short, a lost
executor costs one step at most, and a fit with a folder can be resumed.
"""

from __future__ import annotations

import logging
import threading
import uuid
from enum import Enum, auto

from pyspark.sql import DataFrame, SparkSession

from fluxgrid.plans.grid import Grid
from fluxgrid.solvers.state import StateFolder
from fluxgrid.solvers.stop import Criterion, MaxIter, Memorize
from fluxgrid.sources.store import save, shared_dir

log = logging.getLogger("fluxgrid.solvers")


class Mode(Enum):
    BLOCK = auto()
    MANUAL = auto()
    ASYNC = auto()


class Solver:
    """fit(...) runs to the end (BLOCK), in a thread (ASYNC) or step by step through steps() (MANUAL)."""

    def __init__(self, folder: str | None = None, stop_rate: int = 1, writeback_rate: int | None = None, verbosity: int | None = None, log_var: tuple[str, ...] = ()):
        if stop_rate < 1 or (writeback_rate is not None and writeback_rate % stop_rate):
            raise ValueError("stop_rate is positive and divides writeback_rate")
        self.folder, self.stop_rate, self.writeback_rate, self.verbosity, self.log_var = folder, stop_rate, writeback_rate, verbosity, tuple(log_var)
        self.state: dict = {}
        self.history: list[dict[str, float]] = []

    # -- what solvers define --------------------------------------------------------------------------------------------
    def init(self, **kwargs) -> None:
        raise NotImplementedError

    def step(self) -> None:
        raise NotImplementedError

    def default_stop(self) -> Criterion:
        raise NotImplementedError

    def objective(self) -> Grid:
        raise NotImplementedError

    def solution(self, which: str = "primal") -> Grid:
        return self.state["x"]

    # -- the loop -------------------------------------------------------------------------------------------------------
    def fit(self, stop: Criterion | None = None, mode: Mode = Mode.BLOCK, track_objective: bool = False, max_iter: int | None = None, resume: bool = False, **kwargs) -> "Solver":
        """resume: goes on from the last step that an earlier fit with the same folder has saved, given the same arguments."""
        self.state, self.history, self.idx, self.running, self.error = {}, [], 0, True, None
        self.criterion = stop or (MaxIter(max_iter) if max_iter is not None else self.default_stop())
        self.track = track_objective
        if track_objective:
            self.criterion = self.criterion | Memorize("objective")
        self.criterion.clear()
        self.init(**kwargs)
        spark = next(v for v in self.state.values() if isinstance(v, Grid)).spark
        self.files = StateFolder(spark, f"{self.folder.rstrip('/')}/_state" if self.folder else f"{shared_dir(spark)}/solver-{uuid.uuid4().hex}")
        if not (resume and self._resume()):
            self.state = self.files.save(self.state, 0, [])
        if mode is Mode.MANUAL:
            return self
        self.worker = threading.Thread(target=self._run, daemon=True)
        self.worker.start()
        if mode is Mode.BLOCK:
            self.wait()
        return self

    def _resume(self) -> bool:
        if not self.folder:
            raise ValueError("only a fit with a folder can be resumed")
        last = self.files.manifest()
        if last is None:
            return False
        self.state |= self.files.load(last)
        self.idx, self.history = last["idx"], last["history"]
        before = self.files.manifest(self.idx - 1) if self.stop_rate == 1 else None
        self.criterion.restore(len(self.history), self.files.load(before, adopt=False) if before else None)
        return True

    def _run(self) -> None:
        try:
            while self._advance():
                pass
        except Exception as e:  # kept for whoever waits
            self.error = e

    def wait(self) -> "Solver":
        self.worker.join()
        if self.error:
            raise self.error
        return self

    def stop(self) -> None:
        self.running = False

    def busy(self) -> bool:
        return self.worker.is_alive()

    def steps(self, n: int | None = None):
        """The state after each step of a MANUAL fit."""
        while (n is None or n > 0) and self._advance():
            yield self.state
            n = None if n is None else n - 1

    def _advance(self) -> bool:
        """Stop test, then one step."""
        if not self.running:
            return False
        if self.idx % self.stop_rate == 0:
            if self.track:
                self.state["objective"] = self.objective()
            done = self.criterion.stop(self.state)
            self.files.hold()
            self.history.append({"iteration": self.idx, **self.criterion.info()})
            if self.verbosity and self.idx % self.verbosity == 0:
                log.info("%s", self.history[-1])
            if self.folder and (done or (self.writeback_rate and self.idx % self.writeback_rate == 0)):
                self.writeback()
            if done:
                self.running = False
                return False
        self.idx += 1
        self.step()
        self.state = self.files.save(self.state, self.idx, self.history, skip=("objective",))
        return True

    def held(self, x: Grid) -> Grid:
        """Cuts lineage within a step."""
        return self.files.keep(x, self.idx)

    def wide(self, df: DataFrame, shape, **columns: str) -> None:
        """Sets variables of the state to columns of one table."""
        self.state.update(self.files.wide(df, self.idx, shape, columns))

    def writeback(self) -> None:
        chosen = self.log_var or tuple(k for k, v in self.state.items() if isinstance(v, Grid))
        save(self.folder, {k: self.state[k].df for k in chosen if isinstance(self.state.get(k), Grid)} | {"history": self.stats(next(v for v in self.state.values() if isinstance(v, Grid)).spark)[0]})

    def stats(self, spark: SparkSession) -> tuple[DataFrame, dict]:
        """The history as a table, and the chosen variables."""
        names = sorted({k for h in self.history for k in h} - {"iteration"})
        rows = [(int(h["iteration"]), *(float(h.get(n, float("nan")) or 0.0) for n in names)) for h in self.history]
        schema = ", ".join(["iteration long", *(f"`{n}` double" for n in names)])
        return spark.createDataFrame(rows, schema), {k: self.state.get(k) for k in self.log_var}
