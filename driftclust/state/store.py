"""State tables as Parquet segments under a versioned manifest.

A manifest names the segments of every table. A commit writes its segments first and then the next manifest, which only one
writer can create; readers see the last manifest. A job that fails or is overtaken leaves segments that no manifest names, which
``vacuum`` deletes. Items, vectors, places
and events only grow by segments (the latest place of an item counts); clusters, exemplars and barred pairs, which are small next to the items,
are replaced.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftclust.schema import TABLES
from driftclust.session import shared_folder
from driftclust.state.files import Files

#: Segments of a table from which a commit puts them together.
MANY = 64


class Conflict(RuntimeError):
    """Another writer committed first."""


class StateStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, url: str) -> StateStore:
        """``memory://`` (a folder of its own, for tests and evaluation), or a path or URL of a folder that driver and executors share."""
        if url == "memory://":
            return cls(spark, f"{shared_folder(spark)}/driftclust-state-{uuid.uuid4().hex}")
        scheme = url.split("://", 1)[0] if "://" in url else ""
        if scheme in ("sqlite", "postgres", "postgresql", "memory"):
            raise ValueError(f"no store for {url!r}: state is kept in folders; give a path or a URL that Spark can write")
        return cls(spark, url)

    # --- reading ------------------------------------------------------------------------------------------------

    def version(self) -> int:
        names = [n for n in self.files.names("_manifest") if n.endswith(".json")]
        return int(names[-1].removesuffix(".json")) if names else 0

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if not v:
            return {"version": 0, "tables": {}, "meta": {}, "max_seq": 0, "max_event_seq": 0, "batches": []}
        return json.loads(self.files.read(f"_manifest/{v:012d}.json"))

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.manifest())

    def transaction(self) -> Transaction:
        return Transaction(self, self.manifest())

    # --- locks --------------------------------------------------------------------------------------------------

    def _lock_state(self, name: str) -> tuple[int, dict]:
        """A lock's last turn and who has it. Turns are files that are made once and never changed."""
        turns = self.files.names(f"_locks/{name}")
        return (int(turns[-1].removesuffix(".json")), json.loads(self.files.read(f"_locks/{name}/{turns[-1]}"))) if turns else (0, {"owner": None, "expires": 0.0})

    def _next_turn(self, name: str, turn: int, owner: str | None, expires: float) -> bool:
        if not self.files.publish(f"_locks/{name}/{turn + 1:012d}.json", json.dumps({"owner": owner, "expires": expires})):
            return False
        for old in self.files.names(f"_locks/{name}"):
            if int(old.removesuffix(".json")) < turn:
                self.files.delete(f"_locks/{name}/{old}")
        return True

    def acquire_lock(self, name: str, owner: str, now: datetime, ttl: timedelta) -> bool:
        """A lock for its owner, who may take it again; free for others once its time is over. Whoever makes the next turn has it, and
        only one can."""
        turn, held = self._lock_state(name)
        if held["owner"] not in (None, owner) and held["expires"] > now.timestamp():
            return False
        return self._next_turn(name, turn, owner, (now + ttl).timestamp())

    def release_lock(self, name: str, owner: str) -> None:
        turn, held = self._lock_state(name)
        if held["owner"] == owner:
            self._next_turn(name, turn, None, 0.0)

    def vacuum(self, older_than: timedelta = timedelta(days=1)) -> int:
        """Delete what no version of the last day or so can need: segments that the last manifest doesn't name, old manifests, results,
        drafts and scratch folders, where nothing was written for ``older_than``. The number of entries deleted. Readers of a version
        hold it for less than that time."""
        named = {p for paths in self.manifest()["tables"].values() for p in paths}
        seconds, gone = older_than.total_seconds(), 0
        last = self.version()
        for folder in (*TABLES, "_results", "_stage", "_new", "_manifest"):
            for entry in self.files.older(folder, seconds):
                if f"{folder}/{entry}" not in named and not (folder == "_manifest" and int(entry.removesuffix(".json")) >= last):
                    self.files.delete(f"{folder}/{entry}")
                    gone += 1
        return gone

    def truncate(self) -> None:
        for name in (*TABLES, "_manifest", "_locks", "_new", "_results", "_stage"):
            self.files.delete(name)


class Snapshot:
    """The tables of one version; what is committed later isn't seen."""

    def __init__(self, store: StateStore, manifest: dict):
        self.store, self.manifest, self.spark = store, manifest, store.spark

    def table(self, name: str) -> DataFrame:
        paths = [f"{self.store.path}/{p}" for p in self.manifest["tables"].get(name, [])]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*paths)

    def places(self, of: DataFrame | None = None) -> DataFrame:
        """Where each item stands now: its place of the highest version, combined on the map side. ``of``: only items with an id in that frame;
        few ids are sent to the places, which then aren't shuffled."""
        rows = self.table("places")
        if of is not None:
            rows = rows.join(of.select("id").distinct(), "id", "left_semi")
        latest = rows.groupBy("id").agg(F.max_by(F.struct("status", "cluster_id", "locked", "score"), "version").alias("p"))
        return latest.select("id", "p.*")

    def vectors(self) -> DataFrame:
        """The vectors of the store's model."""
        model = self.meta("model_id")
        rows = self.table("vectors")
        return rows.where(F.col("model_id") == model).select("id", "embedding") if model else rows.select("id", "embedding")

    def items(self) -> DataFrame:
        """Items with their places."""
        return self.table("items").join(self.places(), "id")

    def meta(self, key: str, default: str | None = None) -> str | None:
        return self.manifest["meta"].get(key, default)

    def events(self, after: int = 0, limit: int | None = None) -> DataFrame:
        rows = self.table("events").where(F.col("seq") > after).orderBy("seq")
        return rows.limit(limit) if limit is not None else rows


class Transaction(Snapshot):
    """A snapshot with changes that ``commit`` makes visible together."""

    def __init__(self, store: StateStore, manifest: dict):
        super().__init__(store, json.loads(json.dumps(manifest)))
        self.number = manifest["version"] + 1

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{name}/v={self.number:012d}-{uuid.uuid4().hex[:8]}"
        df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name])).write.parquet(f"{self.store.path}/{path}")
        return path

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add rows; what comes back is read from the files written, so its lineage is short."""
        path = self._write(name, df)
        self.manifest["tables"].setdefault(name, []).append(path)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.store.path}/{path}")

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """All rows anew. ``df`` may read the table it replaces."""
        self.manifest["tables"][name] = [self._write(name, df)]
        return self.table(name)

    def add_clusters(self, rows: DataFrame) -> DataFrame:
        """New clusters; ValueError, and nothing is added, where an id is there already or comes twice."""
        again = rows.groupBy("id").count().where("count > 1").select("id").unionAll(rows.join(self.table("clusters"), "id", "left_semi").select("id")).limit(1).collect()
        if again:
            raise ValueError(f"cluster {again[0].id} is there already")
        return self.append("clusters", rows)

    def update_clusters(self, rows: DataFrame) -> DataFrame:
        """Clusters anew by their ids; KeyError, and nothing changes, where an id is unknown. ``rows`` may read the table."""
        known = self.table("clusters")
        unknown = rows.join(known, "id", "left_anti").select("id").limit(1).collect()
        if unknown:
            raise KeyError(unknown[0].id)
        return self.replace("clusters", known.join(rows, "id", "left_anti").select(*TABLES["clusters"].names).unionByName(rows.select(*TABLES["clusters"].names)))

    def set_places(self, rows: DataFrame) -> None:
        """New places of items (id, status, cluster_id, locked, score)."""
        self.append("places", rows.withColumn("version", F.lit(self.number)))

    def set_meta(self, key: str, value: str) -> None:
        self.manifest["meta"][key] = value

    def number_events(self, rows: DataFrame, order: list) -> None:
        """Append events (type, ts, cluster_id, item_id, data) with sequence numbers in the given order."""
        from driftclust.operators.dedupe import numbered

        ranked = rows.withColumn("__order", F.struct(*order))
        made = self.append("events", numbered(ranked, "__order", self.manifest["max_event_seq"]))
        self.manifest["max_event_seq"] = made.agg(F.coalesce(F.max("seq"), F.lit(self.manifest["max_event_seq"]))).first()[0]

    def compact(self) -> None:
        """Put the segments of tables that have many together; of places only the latest are kept."""
        for name, paths in list(self.manifest["tables"].items()):
            if len(paths) > MANY:
                self.replace(name, self.places().withColumn("version", F.lit(self.number)) if name == "places" else self.table(name))

    def commit(self) -> int:
        """Make the changes visible; Conflict if another writer was faster, and then nothing has changed."""
        self.manifest["version"] = self.number
        name = f"_manifest/{self.number:012d}.json"
        if self.store.version() >= self.number or not self.store.files.publish(name, json.dumps(self.manifest, sort_keys=True)):
            raise Conflict(f"version {self.number} was committed by another writer")
        return self.number
