"""Published generations of tables: written beside each other, activated by one small file."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Generations:
    """``root/gen=<id>/<table>`` and numbered pointers ``root/active/<number>.json``, on any file system that Spark reads.

    A generation is published when its pointer has its name, by one rename to a name that isn't taken; before, readers
    see the pointer before it, and at no time none. The pointer of the highest number counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _numbers(self) -> list[int]:
        path = self._path("active")
        fs = path.getFileSystem(self.conf)
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def active(self) -> dict | None:
        numbers = self._numbers()
        return self._pointer(numbers[-1]) if numbers else None

    def _pointer(self, number: int) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(str(self._path(f"active/{number}.json"))).collect()))

    def stage(self, generation: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/gen={generation}/{name}")

    def _point(self, value: dict) -> None:
        number = (self._numbers() or [0])[-1] + 1
        temporary, path = self._path(f"active/.{number}.{uuid.uuid4().hex}"), self._path(f"active/{number}.json")
        fs = path.getFileSystem(self.conf)
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(temporary, path):
            raise ValueError(f"pointer {number} was taken by another writer")

    def activate(self, generation: str, tables: list[str], source: str) -> None:
        """Points to the generation, if it has all tables. ``source`` is the snapshot that they all come from."""
        for name in tables:
            path = self._path(f"gen={generation}/{name}/_SUCCESS")
            if not path.getFileSystem(self.conf).exists(path):
                raise ValueError(f"generation {generation} has no complete table {name}")
        before = self.active()
        self._point({"generation": generation, "tables": sorted(tables), "source": source, "previous": before and before["generation"], "previous_pointer": before})

    def rollback(self) -> None:
        before = self.active()
        if not before or not before["previous_pointer"]:
            raise ValueError("there is no generation before this one")
        self._point(before["previous_pointer"])

    def read(self, table: str) -> DataFrame:
        now = self.active()
        if now is None:
            raise ValueError("no generation is active")
        return self.spark.read.parquet(f"{self.root}/gen={now['generation']}/{table}")
