"""Publishing a set of tables as versions (K1, K6, E1): all of a version or nothing of it can be read.

A version is built stage by stage under `versions/<version>`. A stage writes its table, reads it back, and compares the
rows' number and checksum with those of what it was given; only then does it leave a record of itself, whose last step is
one rename. When every stage has one, the manifest, which holds all of them, is put beside the versions by a rename too.
Readers go by manifests alone: a build that is killed, wherever, changes nothing that can be read, and the next one with
the same version and inputs goes on behind the last stage that has a record.

A stage whose name or key has changed is built again, and so is what follows if its result is another.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .files import remove_folder


@dataclass(frozen=True)
class Stage:
    """build: takes the session and the tables of the stages before it by name. key: what else the result depends on (parameters,
    versions of inputs); a stage is taken over from an earlier attempt only if it is the same."""

    name: str
    build: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    key: str = ""


@dataclass(frozen=True)
class Written:
    stage: str
    key: str
    after: tuple[str, ...]
    path: str
    rows: int
    checksum: str
    schema: str


def _row(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def _sums(row: Column) -> list[Column]:
    """The number of rows and sums of two 64-bit hashes, which do not depend on the rows' order."""
    return [F.count("*").alias("n"), *[F.coalesce(F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")), F.lit(0)).alias(f"s{seed}") for seed in (1, 2)]]


def _told(n: int, *totals: int) -> tuple[int, str]:
    return n, "-".join(f"{int(t) % 2**64:016x}" for t in totals)


def checksum(df: DataFrame) -> tuple[int, str]:
    """The number of rows and a checksum that does not depend on their order."""
    return _told(*df.agg(*_sums(_row(df))).first())


class Store:
    """A folder that Spark reads and writes; names are made final by renames within it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def put(self, name: str, value: dict) -> None:
        """Writes a small file under another name and renames it; it is there whole or not at all."""
        part = f"{name}.part"
        out = self._fs.create(self._path(f"{self.root}/{part}"), True)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True, indent=1), "utf-8"))
        finally:
            out.close()
        if self.exists(name):
            self._fs.delete(self._path(f"{self.root}/{name}"), False)
        if not self._fs.rename(self._path(f"{self.root}/{part}"), self._path(f"{self.root}/{name}")):
            raise OSError(f"cannot rename {part} in {self.root}")

    def get(self, name: str) -> dict:
        lines = self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()
        return json.loads(lines["value"])

    def remove(self, name: str) -> None:
        remove_folder(self.spark, f"{self.root}/{name}")


def _record(store: Store, version: str, stage: Stage, after: tuple[str, ...]) -> Written | None:
    name = f"versions/{version}/{stage.name}.json"
    if not store.exists(name):
        return None
    held = store.get(name)
    found = Written(**{**held, "after": tuple(held["after"])})
    return found if (found.key, found.after) == (stage.key, after) else None


def publish(spark: SparkSession, root: str, version: str, stages: list[Stage], notes: dict[str, str] | None = None) -> dict:
    """Builds what is missing of a version and publishes it; returns its manifest. A version that is published already
    stays as it is."""
    store = Store(spark, root)
    if len({s.name for s in stages}) != len(stages):
        raise ValueError("stages need names of their own")
    if f"{version}.json" in store.names("manifests"):
        return store.get(f"manifests/{version}.json")
    tables: dict[str, DataFrame] = {}
    written: list[Written] = []
    for stage in stages:
        after = tuple(w.checksum for w in written)
        found = _record(store, version, stage, after)
        if found is None:
            path = f"versions/{version}/{stage.name}"
            store.remove(f"{path}.json")
            df = stage.build(spark, dict(tables))
            # What is given is summed up as it is written: it is computed once.
            seen = Observation()
            df.withColumn("__row", _row(df)).observe(seen, *_sums(F.col("__row"))).drop("__row").write.mode("overwrite").parquet(f"{root}/{path}")
            back = spark.read.parquet(f"{root}/{path}")
            given, there = _told(*[seen.get[c] for c in ("n", "s1", "s2")]), checksum(back.select(*[F.col(f"`{c}`") for c in df.columns]))
            if given != there:
                raise OSError(f"stage {stage.name} of {version}: {there[0]} rows with checksum {there[1]} were read back, {given[0]} with {given[1]} written")
            found = Written(stage.name, stage.key, after, path, *there, back.schema.json())
            store.put(f"{path}.json", asdict(found))
        written.append(found)
        tables[stage.name] = spark.read.parquet(f"{root}/{found.path}")
    manifest = {"version": version, "notes": notes or {}, "stages": [asdict(w) for w in written]}
    store.put(f"manifests/{version}.json", manifest)
    return manifest


def versions(spark: SparkSession, root: str) -> list[str]:
    """Those that are published."""
    return [n.removesuffix(".json") for n in Store(spark, root).names("manifests") if n.endswith(".json")]


def read_version(spark: SparkSession, root: str, version: str, table: str, verify: bool = False) -> DataFrame:
    """A table of a published version; verify compares its rows with the manifest first."""
    store = Store(spark, root)
    if version not in versions(spark, root):
        raise ValueError(f"no version {version} in {root}")
    (one,) = [s for s in store.get(f"manifests/{version}.json")["stages"] if s["stage"] == table]
    df = spark.read.parquet(f"{root}/{one['path']}")
    if verify and checksum(df) != (one["rows"], one["checksum"]):
        raise OSError(f"table {table} of {version} is not what was published")
    return df


def remove_unpublished(spark: SparkSession, root: str) -> list[str]:
    """Removes what builds have left of versions that are not published; their names."""
    store, kept = Store(spark, root), set(versions(spark, root))
    left = [v for v in store.names("versions") if v not in kept]
    for v in left:
        store.remove(f"versions/{v}")
    return left
