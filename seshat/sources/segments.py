"""Stores that grow by segments: each run writes what has changed, reads merge, and a compaction folds segments together."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.staging import few
from .generations import Generations

#: Segments of a store before those after the first are folded into one; the share of the first segment's rows that they
#: have together when all become one, and the rows that they have at least before that alone is a reason.
MOST, SHARE, LEAST = 8, 0.25, 10_000

#: Parts of a segment: its rows, the owners that it has rows of (with a hash of what they were made from), and the owners
#: whose rows in earlier segments it replaces or drops.
PARTS = ("rows", "owners", "gone")


def digests(tables: Mapping[str, DataFrame]) -> dict[str, tuple[int, str]]:
    """(number of rows, digest) of each table, in one job: the same for the same rows in any order and partitioning, repeated
    rows counted."""
    sums = lambda df: [F.coalesce(F.sum(F.xxhash64(F.lit(k), F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"s{k}") for k in (1, 2)]
    each = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), *sums(df)) for name, df in tables.items()]
    return {r["name"]: (r["n"], f"{r['s1']}:{r['s2']}") for r in reduce(DataFrame.union, each).collect()}


class TamperedError(ValueError):
    """A written component isn't what its manifest says."""


class SegmentStore(Generations):
    """``root/segments/<store>/<id>/<part>``; a pointer names each store's segments, with a manifest of every part.

    A store's rows belong to owners (a document, a file). A row holds if no later segment has its owner among ``gone``, so a
    changed owner costs its own rows and nothing else is written again. A run publishes all stores by one pointer; a store
    whose stage has failed stays with the segments that it had, and is named with its error, so that others can be read.
    """

    def __init__(self, spark: SparkSession, root: str, owner: Sequence[str]):
        super().__init__(spark, root)
        self.owner = list(owner)
        self._seen: set[str] = set()
        self._own: set[str] = set()

    def stores(self) -> dict[str, dict]:
        now = self.active()
        return now["stores"] if now else {}

    def segments(self, name: str) -> list[dict]:
        return self.stores().get(name, {}).get("segments", [])

    def _part(self, segment: Mapping, part: str) -> DataFrame:
        return self._read(segment["path"], part, segment["manifest"][part]["schema"])

    def _read(self, path: str, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{self.root}/{path}/{part}")

    def folder(self, name: str) -> str:
        """Where a new segment of the store goes, relative to the root."""
        return f"segments/{name}/{uuid.uuid4().hex}"

    def write(self, name: str, rows: DataFrame, owners: DataFrame, gone: DataFrame | None = None, *, path: str | None = None, others: Sequence[str] = ()) -> dict:
        """A segment's entry: its rows, owners (owner columns and hash) and gone (owner columns), written and described.

        ``others`` are tables that the caller has written beside them, below ``path``."""
        path = path or self.folder(name)
        parts = {"rows": rows, "owners": owners.select(*self.owner, "hash"), "gone": (owners.where("false") if gone is None else gone).select(*self.owner)}
        for part, df in parts.items():
            df.write.parquet(f"{self.root}/{path}/{part}")
        self._own.add(path)
        schemas = {part: df.schema.json() for part, df in parts.items()}
        for part in others:
            files = self._listed(path, part)[0]
            schemas[part] = (self.spark.read.parquet(f"{self.root}/{path}/{part}").schema if files else StructType([])).json()
        return {"path": path, "manifest": self._described(path, schemas)}

    def _described(self, path: str, schemas: Mapping[str, str]) -> dict:
        listed = {part: self._listed(path, part) for part in schemas}
        sums = digests(some) if (some := {part: self._read(path, part, schema) for part, schema in schemas.items() if listed[part][0]}) else {}
        each = lambda part: sums.get(part, (0, "0:0"))
        return {part: {"rows": each(part)[0], "digest": each(part)[1], "files": listed[part][0], "bytes": listed[part][1], "schema": schema} for part, schema in schemas.items()}

    def _listed(self, path: str, part: str) -> tuple[int, int]:
        folder = self._path(f"{path}/{part}")
        fs = folder.getFileSystem(self.conf)
        if not fs.exists(folder):
            return 0, 0
        files, found = fs.listFiles(folder, True), []
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().startswith("part-"):
                found.append(f.getLen())
        return len(found), sum(found)

    def written_bytes(self, segments: Sequence[Mapping]) -> int:
        return sum(m["bytes"] for s in segments for m in s["manifest"].values())

    def publish(self, source: str, new: Mapping[str, Sequence[Mapping]], *, sources: Mapping[str, str] | None = None, failed: Mapping[str, str] | None = None) -> None:
        """Points to the stores: those in ``new`` with their segments, all others as they are.

        Stores that were made from another source than this run's are refused. Failed stores keep their segments, their
        source and the error. New segments are held against their manifests first: row by row, but for those that this object
        has just written and described, whose files are listed again.
        """
        if odd := {n: s for n, s in (sources or {}).items() if s != source}:
            raise ValueError(f"stores of other sources than {source}: {odd}")
        before = self.stores()
        known = {s["path"] for b in before.values() for s in b["segments"]}
        for name, segments in new.items():
            for segment in segments:
                if segment["path"] not in known | self._own:
                    self.verify_segment(name, segment)
            self._first_read(name, segments)
        stores = dict(before)
        for name, segments in new.items():
            stores[name] = {"segments": list(segments), "source": source, "error": None}
        for name, error in (failed or {}).items():
            stores[name] = {**before.get(name, {"segments": [], "source": None}), "error": error}
        numbers = self._numbers()
        self._point({"source": source, "stores": stores, "previous": numbers[-1] if numbers else None})

    def rollback(self) -> None:
        """Points to what the active pointer replaced; refused where there is nothing."""
        now = self.active()
        if not now or now["previous"] is None:
            raise ValueError("there is no generation before this one")
        self._point(self._pointer(now["previous"]))

    def verify_segment(self, name: str, segment: Mapping) -> None:
        """An error if a part's rows, read in full, aren't those of the manifest."""
        manifest = segment["manifest"]
        found = self._described(segment["path"], {part: own["schema"] for part, own in manifest.items()})
        for part, own in manifest.items():
            if found[part] != own:
                raise TamperedError(f"{name}: {segment['path']}/{part} isn't what its manifest says")

    def verify(self, name: str) -> None:
        for segment in self.segments(name):
            self.verify_segment(name, segment)

    def _first_read(self, name: str, segments: Sequence[Mapping]) -> None:
        """Files and bytes of each part against the manifest, once for each segment; ``verify`` reads the rows as well."""
        for segment in segments:
            if segment["path"] not in self._seen:
                for part, own in segment["manifest"].items():
                    if self._listed(segment["path"], part) != (own["files"], own["bytes"]):
                        raise TamperedError(f"{name}: {segment['path']}/{part} isn't as it was written")
                self._seen.add(segment["path"])

    def merged(self, name: str, segments: Sequence[Mapping], part: str = "rows") -> DataFrame:
        """Rows of segments that no later one of them has taken away."""
        if not segments:
            raise ValueError(f"store {name} has no segment")
        self._first_read(name, segments)
        rows = reduce(DataFrame.unionByName, (self._part(s, part).withColumn("seshat_segment", F.lit(k)) for k, s in enumerate(segments)))
        later = [self._part(s, "gone").select(*(F.col(c).alias(f"seshat_{c}") for c in self.owner), F.lit(k).alias("seshat_by")) for k, s in enumerate(segments) if k and s["manifest"]["gone"]["rows"]]
        if later:
            number = sum(s["manifest"]["gone"]["rows"] for s in segments[1:])
            last = reduce(DataFrame.union, later).groupBy(*(f"seshat_{c}" for c in self.owner)).agg(F.max("seshat_by").alias("seshat_by"))
            same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"seshat_{c}")) for c in self.owner))
            rows = rows.join(few(last, number), same & (F.col("seshat_segment") < F.col("seshat_by")), "left_anti")
        return rows.drop("seshat_segment")

    def read(self, table: str) -> DataFrame:
        if not self.segments(table):
            raise ValueError(f"store {table} is not published" + (f": {e}" if (e := self.stores().get(table, {}).get("error")) else ""))
        return self.merged(table, self.segments(table))

    def owners(self, name: str) -> DataFrame | None:
        """(owner columns, hash) of a store as it is published; None if it never was."""
        return self.merged(name, self.segments(name), "owners") if self.segments(name) else None

    def is_due(self, segments: Sequence[Mapping]) -> bool:
        """Whether ``folded`` would fold these segments."""
        return len(segments) > MOST or len(segments) > 1 and self._later(segments) > max(LEAST, SHARE * segments[0]["manifest"]["rows"]["rows"])

    @staticmethod
    def _later(segments: Sequence[Mapping]) -> int:
        return sum(s["manifest"][part]["rows"] for s in segments[1:] for part in ("rows", "gone"))

    def folded(self, name: str, segments: Sequence[Mapping]) -> list[dict]:
        """The same rows in fewer segments: all in one, or the first and one of all others, if that is much smaller.

        The segment of the others keeps whatever they have taken away, as it may be the first segment's.
        """
        whole = self._later(segments) > SHARE * segments[0]["manifest"]["rows"]["rows"]
        fold = segments if whole else segments[1:]
        gone = None if whole else reduce(DataFrame.union, (self._part(s, "gone").select(*self.owner) for s in fold)).distinct()
        one = self.write(name, self.merged(name, fold), self.merged(name, fold, "owners"), gone)
        return [one] if whole else [segments[0], one]
