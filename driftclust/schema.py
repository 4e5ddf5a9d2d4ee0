"""Names and types of the state tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "vector": T.ArrayType(T.FloatType()),
    "map": T.MapType(T.StringType(), T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


OPEN, CLOSED, ARCHIVED, MERGED = CLUSTER_STATUSES = ("open", "closed", "archived", "merged")
ASSIGNED, BUFFERED, ORPHANED = ITEM_STATUSES = ("assigned", "buffered", "orphaned")
EVENT_TYPES = ("cluster.opened", "item.assigned", "cluster.closed", "cluster.reopened", "cluster.merged", "cluster.archived", "cluster.split", "cluster.relabeled", "item.orphaned", "item.moved")
STRATEGIES = ("central", "random", "recent", "mixed")

INPUT = _schema("id string, text string, ts timestamp, metadata map")
#: What never changes about an item.
ITEMS = _schema("id string, seq bigint, text string, ts timestamp, metadata map")
#: Vectors by item and model; a migration writes new ones.
VECTORS = _schema("id string, embedding vector, model_id string, version bigint")
#: Where an item stands; the latest version of an id counts.
PLACES = _schema("id string, status string, cluster_id string, locked boolean, score double, version bigint")
CLUSTERS = _schema("id string, status string, threshold double, size bigint, first_seen timestamp, last_seen timestamp, opened_at timestamp, label string, closed_at timestamp, merged_into string, status_locked boolean, label_size bigint, seen_count bigint")
EXEMPLARS = _schema("cluster_id string, pos int, item_id string, embedding vector")
EVENTS = _schema("seq bigint, type string, ts timestamp, cluster_id string, item_id string, data string")
NO_MERGE = _schema("a string, b string")
TABLES = {"items": ITEMS, "vectors": VECTORS, "places": PLACES, "clusters": CLUSTERS, "exemplars": EXEMPLARS, "events": EVENTS, "no_merge": NO_MERGE}
