"""Tables of immutable versions: each version is a manifest that names data files and deletion vectors.

    table/data/<fragment>/*.parquet                     rows added by one commit (a fragment)
    table/deleted/<id>/*.parquet                        the deletion vectors of one commit: keys of rows that no longer hold, with their fragment and the columns that are carried
    table/versions/<number>.json                        {"fragments": {fragment: [deletion vectors]}, "ranges": {fragment: [least, greatest first key]}, "properties": {...}}

A version exists once its manifest does, which is created exclusively: of two writers one fails and may try again, and a job that dies leaves only files no manifest names.
All fragments of a read are one scan, whatever their number; a commit looks for replaced rows only in fragments whose range of keys it meets.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    fragments: dict[str, list[str]] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, list[str]] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class VersionedTable:
    """keys: the columns that identify a row; rows with a null key are refused. carried: columns that deletion vectors keep beside the keys, so that a difference need not look masked rows up."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], carried: list[str] | None = None) -> None:
        self.spark, self.path, self.schema, self.keys, self.carried = spark, path.rstrip("/"), schema, keys, carried or []
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("versions")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("versions"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """Of a version, by default the newest; version 0 is the empty table."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if version == 0:
            return Manifest()
        stream = self._fs.open(self._at("versions", f"{version:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        said = json.loads(text)
        return Manifest(version, said["fragments"], said["properties"], said.get("ranges", {}))

    def _write_manifest(self, m: Manifest) -> None:
        body = json.dumps({"fragments": m.fragments, "ranges": m.ranges, "properties": m.properties})
        # written aside first, so that a manifest is whole as soon as it can be seen
        aside, final = self._at("versions", f".{uuid.uuid4().hex}"), self._at("versions", f"{m.version:012d}.json")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.isAbsolute() and aside.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(aside, final, none)  # fails if the version is there
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(final):
                raise Conflict(f"version {m.version} exists") from e
            raise

    def _scan(self, paths: list[str], names: list[str], pattern: str) -> DataFrame:
        """One scan of some folders, with the fragment that each file belongs to, as its path tells."""
        schema = T.StructType([f for f in self.schema.fields if f.name in names])
        df = self.spark.read.schema(schema).parquet(*paths)
        return df.withColumn("_fragment", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))

    def _none(self, names: list[str]) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([*(f for f in self.schema.fields if f.name in names), T.StructField("_fragment", T.StringType())]))

    def rows(self, fragments: dict[str, list[str]]) -> DataFrame:
        """The rows that hold of some fragments, with the fragment's name in _fragment. Only these files are read, and only fragments with deletion vectors are joined with them."""
        names = [f.name for f in self.schema.fields]
        whole, masked = [f for f, v in fragments.items() if not v], {f: v for f, v in fragments.items() if v}
        scan = lambda some: self._scan([f"{self.path}/data/{f}" for f in some], names, r"/data/([^/]+)/")
        parts = [scan(whole)] if whole else []
        if masked:
            parts.append(scan(list(masked)).join(self.masks(masked).select(*self.keys, "_fragment"), [*self.keys, "_fragment"], "left_anti").select(*names, "_fragment"))
        return reduce(DataFrame.unionByName, parts) if parts else self._none(names)

    def masks(self, vectors: dict[str, list[str]]) -> DataFrame:
        """The rows (keys, carried columns, _fragment) in some deletion vectors of each fragment: one scan of the commits that wrote them."""
        names = [*self.keys, *self.carried]
        wanted = sorted({v for vs in vectors.values() for v in vs})
        if not wanted:
            return self._none(names)
        schema = T.StructType([*(f for f in self.schema.fields if f.name in names), T.StructField("_fragment", T.StringType())])
        df = self.spark.read.schema(schema).parquet(*[f"{self.path}/deleted/{v}" for v in wanted])
        pair = F.concat(F.regexp_extract(F.col("_metadata.file_path"), r"/deleted/([^/]+)/", 1), F.lit("/"), "_fragment")
        return df.filter(pair.isin([f"{v}/{f}" for f, vs in vectors.items() for v in vs])).select(*names, "_fragment")

    def read(self, version: int | None = None) -> DataFrame:
        return self.rows(self.manifest(version).fragments).drop("_fragment")

    def _range(self, rows: DataFrame) -> list[str] | None:
        """The least and greatest first key, as text that compares as the keys do; null for no rows or other kinds of keys."""
        if not isinstance(self.schema[self.keys[0]].dataType, T.LongType | T.IntegerType | T.StringType | T.DateType):
            return None
        r = rows.agg(F.min(self.keys[0]).alias("a"), F.max(self.keys[0]).alias("z")).first()
        return None if r["a"] is None else [self._text(r["a"]), self._text(r["z"])]

    @staticmethod
    def _text(key: object) -> str:
        return f"{key + (1 << 63):020d}" if isinstance(key, int) else str(key)

    def _write_vectors(self, lost: DataFrame, name: str) -> list[str]:
        """Deletion vectors of rows (keys, carried, _fragment); returns the fragments that have one."""
        lost.select(*self.keys, *self.carried, "_fragment").write.parquet(f"{self.path}/deleted/{name}")
        there = self.spark.read.schema("_fragment string").parquet(f"{self.path}/deleted/{name}").distinct()
        return sorted(r["_fragment"] for r in there.collect())  # names that the manifest holds anyway

    def commit(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, properties: dict[str, str] | None = None, base: Manifest | None = None) -> Manifest:
        """A new version: rows of upserts replace those with equal keys, keys in deletes go. Of repeated keys in upserts any one is kept.
        Properties are part of the same commit and carry over."""
        base = base or self.manifest()
        fragments, ranges = {k: list(v) for k, v in base.fragments.items()}, dict(base.ranges)
        name = uuid.uuid4().hex
        out = [f.name for f in self.schema.fields]
        mine = None
        if upserts is not None:
            upserts.dropna(subset=self.keys).dropDuplicates(self.keys).select(*out).write.parquet(f"{self.path}/data/{name}")
            upserts = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{name}")
            mine = self._range(upserts)
        # a fragment whose keys all lie outside of what is replaced is not read
        met = fragments if deletes is not None else {f: v for f, v in fragments.items() if mine is not None and (f not in ranges or (ranges[f][0] <= mine[1] and mine[0] <= ranges[f][1]))}
        gone = [d.select(*self.keys) for d in (upserts, deletes) if d is not None]
        if gone and met:
            lost = self.rows(met).join(reduce(DataFrame.unionByName, gone).distinct(), self.keys, "left_semi")
            for fragment in self._write_vectors(lost, name):
                fragments[fragment].append(name)
        if upserts is not None and mine is not None or upserts is not None and not isinstance(self.schema[self.keys[0]].dataType, T.LongType | T.IntegerType | T.StringType | T.DateType):
            fragments[name] = []
            if mine is not None:
                ranges[name] = mine
        made = Manifest(base.version + 1, fragments, {**base.properties, **(properties or {})}, ranges)
        self._write_manifest(made)
        return made

    def replay(self, rows: DataFrame, order: str, steps: list[int], prop: str, keep: int | None = None) -> list[Manifest]:
        """Versions 1, 2, ... of an empty table, one for each of steps, as if the rows (schema, order) of each step had been committed one after the other: a fragment for each step, and a deletion
        vector on it for each later step that holds some of its keys again. All fragments and all vectors are one write each. prop: the property that names the step. (key, order) must be unique;
        the steps are few (a manifest each), so that the rows of one key are too. Steps not listed are left out. keep: manifests are written of so many last versions only, as if the others had expired."""
        if self.versions():
            raise Conflict("the table has versions")
        out = [f.name for f in self.schema.fields]
        known = rows.dropna(subset=[*self.keys, order]).filter(F.col(order).isin(steps))
        later = F.lead(order).over(Window.partitionBy(*self.keys).orderBy(order))
        named = known.select(*out, F.concat(F.lit("step-"), F.col(order).cast("string")).alias("_fragment"), F.concat(F.lit("step-"), later.cast("string")).alias("_by"))
        names = [*out, "_fragment", "_by"]
        log = f"{self.path}/log-{uuid.uuid4().hex}"
        named.write.parquet(log)  # read three times
        named = self.spark.read.schema(named.schema).parquet(log).select(*names)
        vectors: dict[str, list[str]] = {}
        for r in named.filter("_by IS NOT NULL").select("_by", "_fragment").distinct().collect():  # pairs of steps
            vectors.setdefault(r["_by"], []).append(r["_fragment"])
        there = set()
        for folder, by, df in (("data", "_fragment", named.drop("_by")), ("deleted", "_by", named.filter("_by IS NOT NULL").select(*self.keys, *self.carried, "_by", "_fragment"))):
            aside = f"new-{uuid.uuid4().hex}"
            df.hint("rebalance", by).write.partitionBy(by).parquet(f"{self.path}/{aside}")  # a step with most of the rows is split over several files
            self._fs.mkdirs(self._at(folder))
            for s in self._fs.listStatus(self._at(aside)):
                n = s.getPath().getName()
                if n.startswith(by + "="):
                    self._fs.rename(s.getPath(), self._at(folder, n[len(by) + 1 :]))
                    there.add((folder, n[len(by) + 1 :]))
            self._fs.delete(self._at(aside), True)
        self._fs.delete(self._at(log.rsplit("/", 1)[-1]), True)
        made: list[Manifest] = []
        fragments: dict[str, list[str]] = {}
        for k, step in enumerate(steps, 1):
            fragments = {f: [*v, f"step-{step}"] if f in vectors.get(f"step-{step}", []) else list(v) for f, v in fragments.items()}
            if ("data", f"step-{step}") in there:
                fragments[f"step-{step}"] = []
            m = Manifest(k, fragments, {prop: str(step)})
            if keep is None or k > len(steps) - keep:
                self._write_manifest(m)
            made.append(m)
        return made

    def rewrite(self, base: Manifest | None = None, some: list[str] | None = None) -> Manifest:
        """Compaction of some fragments, by default all: they become one, without deletion vectors. The records do not change, so a diff over it is empty."""
        base = base or self.manifest()
        old = {f: v for f, v in base.fragments.items() if some is None or f in some}
        name = uuid.uuid4().hex
        self.rows(old).drop("_fragment").write.parquet(f"{self.path}/data/{name}")
        kept = {f: v for f, v in base.fragments.items() if f not in old}
        ranges = {f: r for f, r in base.ranges.items() if f in kept}
        own = self._range(self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{name}"))
        made = Manifest(base.version + 1, {**kept, name: []}, dict(base.properties), {**ranges, **({name: own} if own else {})})
        self._write_manifest(made)
        return made

    def compacted(self, most_fragments: int = 64, most_vectors: int = 16) -> Manifest:
        """Compaction by rule: beyond most_fragments all fragments become one; else those with more than most_vectors deletion vectors do. Otherwise nothing is written."""
        base = self.manifest()
        if len(base.fragments) > most_fragments:
            return self.rewrite(base)
        worn = [f for f, v in base.fragments.items() if len(v) > most_vectors]
        return self.rewrite(base, worn) if worn else base

