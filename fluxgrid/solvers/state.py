"""The tables of a solver's state, with a manifest for each step, so that a fit can go on where it ended.

A step writes what it has changed as one table; variables that it left alone stay where they are. Then its manifest (JSON:
where each variable lies, the iteration, the history) is written, and then go the tables that neither this manifest nor
the one before names, so that files take two steps' room. A fit that is killed at any time finds a whole manifest.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.plans.grid import Grid, axes_of


class StateFolder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.entries: dict[str, tuple[Grid, dict]] = {}
        self.before: set[str] = set()
        self.held: set[str] = set()
        self.made: dict[int, tuple[Grid, dict]] = {}
        self.count = 0

    # -- files ----------------------------------------------------------------------------------------------------------
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _delete(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    # -- during a step --------------------------------------------------------------------------------------------------
    def keep(self, x: Grid, idx: int) -> Grid:
        """x as a table. If it becomes a variable of the state, that is its place; else it goes when the step has been saved."""
        name, self.count = f"work-{idx}-{self.count}", self.count + 1
        df = self._write(x.df.select(*x.keys, "v"), name)
        out = self._column(df, "v", x.shape)
        self.made[id(out)] = out, {"table": name, "column": "v", "shape": list(x.shape), "columns": df.schema.json()}
        return out

    def wide(self, df: DataFrame, idx: int, shape, columns: dict[str, str]) -> dict[str, Grid]:
        """Several variables of one shape as columns of one table, which is their place in the state."""
        name, out = f"wide-{idx}", {}
        df = self._write(df, name)
        for variable, column in columns.items():
            out[variable] = self._column(df, column, shape)
            self.entries[variable] = (out[variable], {"table": name, "column": column, "shape": list(shape), "columns": df.schema.json()})
        return out

    @staticmethod
    def _column(df: DataFrame, column: str, shape) -> Grid:
        return Grid(df.select("s", *axes_of(len(shape)), F.col(column).alias("v")), tuple(shape))

    # -- after a step ---------------------------------------------------------------------------------------------------
    def save(self, state: dict, idx: int, history: list, skip: tuple[str, ...] = ()) -> dict:
        """The state, read from its tables."""
        grids = {k: v for k, v in state.items() if isinstance(v, Grid) and k not in skip}
        placed = {id(g): (g, e) for g, e in [*self.entries.values(), *self.made.values()]}
        new = {k: v for k, v in grids.items() if id(v) not in placed}
        name = f"step-{idx}"
        if new:
            own = {id(v): k for k, v in new.items()}  # a signal that is two variables is written once
            parts = [new[k].df.select(F.lit(k).alias("variable"), *new[k].keys, "v") for k in own.values()]
            both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            # The tasks of a union have one variable each, so its files are skipped by their statistics when another is read.
            table = self._write(both, name)
            for i, k in own.items():
                entry = {"table": name, "variable": k, "shape": list(new[k].shape), "columns": both.schema.json()}
                placed[i] = self._column(table.where(F.col("variable") == k), "v", new[k].shape), entry
        self.entries = {k: placed[id(v)] for k, v in grids.items()}
        scalars = {k: v for k, v in state.items() if v is None or isinstance(v, bool | int | float | str)}
        text = json.dumps({"idx": idx, "variables": {k: e for k, (_, e) in self.entries.items()}, "scalars": scalars, "history": history})
        fs, path = self._path(f"manifest-{idx}.json")
        out = fs.create(path, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        now = {e["table"] for _, e in self.entries.values()}
        fs, top = self._path("")
        keep = now | self.before | self.held | {f"manifest-{idx}.json", f"manifest-{idx - 1}.json"}
        for status in fs.listStatus(top):
            if status.getPath().getName() not in keep:
                fs.delete(status.getPath(), True)
        self.before, self.made = now, {}
        return state | {k: g for k, (g, _) in self.entries.items()}

    def hold(self) -> None:
        """The tables of the state as it is now stay until this is called again (what a stop test compares with)."""
        self.held = {e["table"] for _, e in self.entries.values()}

    # -- going on -------------------------------------------------------------------------------------------------------
    def manifest(self, idx: int | None = None) -> dict | None:
        """The last manifest, or that of an iteration."""
        fs, top = self._path("")
        if not fs.exists(top):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        found = [int(n[9:-5]) for n in names if n.startswith("manifest-")]
        at = max(found, default=None) if idx is None else idx if idx in found else None
        if at is None:
            return None
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/manifest-{at}.json").first()[0])

    def load(self, manifest: dict, adopt: bool = True) -> dict:
        """The state that a manifest names."""
        from pyspark.sql.types import StructType

        out = dict(manifest["scalars"])
        for k, e in manifest["variables"].items():
            table = self.spark.read.schema(StructType.fromJson(json.loads(e["columns"]))).parquet(f"{self.root}/{e['table']}")
            table = table.where(F.col("variable") == e["variable"]) if "variable" in e else table
            out[k] = self._column(table, e.get("column", "v"), e["shape"])
            if adopt:
                self.entries[k] = (out[k], e)
        if adopt:
            self.before = {e["table"] for e in manifest["variables"].values()}
        return out
