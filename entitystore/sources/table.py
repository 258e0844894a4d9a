"""Entity tables: versioned, entity-keyed rows in partitioned Parquet.

<base>/<tenant>/<table>/xact=<id>/interval=<name>/interval_start=<iso>/shard=<n>/*.parquet

A commit stages whole new slices of the shards that its operations touch under its own directory and
publishes them together.  Scans choose slices from the manifest, so predicates on interval, start and shard
prune before Spark plans, and read with the schema that the manifest holds, so no footers are merged.
Snapshots and copies name the files of their source and copy nothing.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..functions import intervals
from ..functions.predicates import Predicate
from ..functions.sharding import ShardId, ShardStrategy, hashed
from ..operators import stats
from ..plans import fold
from ..types import ColumnId, EntityIdTypeError, code_of
from .manifest import Manifests, Token, TransactionError, check, new_token, record

SLICE = ("interval", "interval_start", "shard")
PLACES = ("xact", *SLICE)
OWN = ("_version", "_instance_id")
#: Rows of a file that a compaction aims at hold so many bytes.
FILE_BYTES = 128 << 20
#: Slices that a task writes side by side; only those beyond are sorted first.
WRITERS = 16


class ConsistencyError(RuntimeError):
    """A write would leave columns of an entity at different versions."""


def tenants(spark: SparkSession, base: str) -> list[str]:
    """Tenants of a store; names that begin with an underscore are its own."""
    return [t for t in Manifests(spark, base).children(base) if not t.startswith("_")]


def tables(spark: SparkSession, base: str, tenant: str) -> list[str]:
    m = Manifests(spark, base)
    return [t for t in m.children(f"{base}/{tenant}") if m.exists(f"{base}/{tenant}/{t}/_manifests")]


def table_exists(spark: SparkSession, base: str, tenant: str, name: str) -> bool:
    return name in tables(spark, base, tenant)


def drop_table(spark: SparkSession, base: str, tenant: str, name: str) -> None:
    """Deletes a table with its files; none: nothing happens."""
    Manifests(spark, base).delete(f"{base}/{tenant}/{name}")


def drop_tenant(spark: SparkSession, base: str, tenant: str) -> None:
    Manifests(spark, base).delete(f"{base}/{tenant}")


def _meets(predicate: Predicate | None, start: str) -> bool:
    """Whether a bucket's start, as text or, for operands that are instants, as an instant in UTC, passes."""
    if predicate is None:
        return True
    if not any(isinstance(v, dt.date) for v in predicate.values):
        return predicate.test(start)

    def naive(v: dt.date) -> dt.datetime:
        v = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
        return v.astimezone(dt.UTC).replace(tzinfo=None) if v.tzinfo else v

    return Predicate(predicate.op, tuple(map(naive, predicate.values)), predicate.ignore_case, predicate.strict).test(naive(dt.datetime.fromisoformat(start)))


class EntityTable:
    """A table of entities.

    shards or strategy: how ids are dealt out.  retain: versions to keep after each commit (None: all).
    capture: a predicate on rows of requests to log, a Column, or True for all.
    """

    def __init__(self, spark: SparkSession, base: str, tenant: str, name: str, key: str = "entity_id", shards: int = 10, strategy: ShardStrategy | None = None, compression: str = "zstd", retain: int | None = None, capture: Column | bool | None = None):
        self.spark, self.key, self.compression = spark, key, compression
        self.base, self.tenant, self.name, self.path = base, tenant, name, f"{base}/{tenant}/{name}"
        self.strategy, self.retain, self.capture = strategy or hashed(shards), retain, capture
        self.manifests = Manifests(spark, self.path)
        self._token: Token | None = None

    # -- catalog --------------------------------------------------------------------------------

    def exists(self) -> bool:
        return bool(self.manifests.numbers())

    def create(self) -> int:
        """Publishes an empty table if there is none; the version number."""
        number, state = self.manifests.latest()
        if not number:
            self.manifests.publish(number := 1, state | {"properties": {"key": self.key}})
        return number

    def slices(self, interval: Predicate | None = None, start: Predicate | None = None, shard: int | None = None) -> list[dict]:
        """The table's slices; single intervals ignore the predicate on starts, whose operands are texts or instants."""
        out = []
        for s in self.manifests.latest()[1]["slices"]:
            if interval and not interval.test(s["interval"]):
                continue
            if s["interval"] != intervals.SINGLE and not _meets(start, s["interval_start"]):
                continue
            if shard is None or s["shard"] == shard:
                out.append(s)
        return out

    def _bucket(self, interval: str, ts: str | dt.datetime, offset: int = 0) -> str:
        """The start of the bucket of an instant."""
        return self.spark.range(1).select(intervals.start(interval, F.lit(ts).cast("timestamp"), offset)).first()[0]

    def _at(self, interval: str, ts: str | dt.datetime) -> list[dict]:
        start = self._bucket(interval, ts)
        return [s for s in self.slices(Predicate("=", (interval,))) if s["interval_start"] == start]

    def intervals(self) -> list[str]:
        return sorted({s["interval"] for s in self.slices()})

    def interval_starts(self, interval: str, predicate: Predicate | None = None) -> list[str]:
        return sorted({s["interval_start"] for s in self.slices(Predicate("=", (interval,)), predicate)})

    def find_shards(self, interval: str, ts: str | dt.datetime, column: str | None = None) -> list[int]:
        """Shards of the bucket that an instant lies in, those that have a column of exactly that name if one is given."""
        return sorted(s["shard"] for s in self._at(interval, ts) if column is None or column in s["columns"])

    def shard_ids(self, interval: Predicate | None = None, start: Predicate | None = None) -> list[ShardId]:
        return sorted(ShardId(self.tenant, self.name, s["interval"], s["interval_start"], s["shard"]) for s in self.slices(interval, start))

    def find_shard(self, value: object) -> int:
        """The shard of an entity id."""
        return self.spark.range(1).select(self.strategy(self._id(value))).first()[0]

    def find_shard_id(self, interval: str, ts: str | dt.datetime, value: object) -> ShardId:
        return ShardId(self.tenant, self.name, interval, self._bucket(interval, ts), self.find_shard(value))

    def has(self, interval: str | None = None, start: str | None = None, shard: int | None = None, column: str | None = None) -> bool:
        """Whether there is a slice of an interval, a bucket of it, a shard of that, with a column; what is not given is any."""
        return any(
            (interval is None or s["interval"] == interval) and (start is None or s["interval_start"] == start) and (shard is None or s["shard"] == shard) and (column is None or column in s["columns"])
            for s in self.slices()
        )

    def shard_exists(self, shard: ShardId) -> bool:
        return (shard.tenant, shard.table) == (self.tenant, self.name) and self.has(shard.interval, shard.start, shard.shard)

    def column_ids(self, interval: str | None = None, ts: str | dt.datetime | None = None, shard: int | None = None) -> list[ColumnId]:
        """Columns of the table, of a bucket or of a shard of it: the union over slices, the entity id's among them."""
        chosen = self.slices() if interval is None else self._at(interval, ts)
        types = {n: t for s in chosen if shard is None or s["shard"] == shard for n, t in s["columns"].items() if n not in OWN}
        return [ColumnId(n, code_of(t)) for n, t in sorted(types.items())]

    def columns(self) -> list[str]:
        """All columns that any slice has."""
        return [c.name for c in self.column_ids()] + [c for c in OWN if any(c in s["columns"] for s in self.slices())]

    def column_id(self, name: str) -> ColumnId | None:
        """A column by its name in any case; the same case first."""
        ids = self.column_ids()
        return next((c for c in ids if c.name == name), next((c for c in ids if c.name.lower() == name.lower()), None))

    def entity_id_column(self) -> ColumnId | None:
        """The column that holds entity ids, as the table was written; None before the first write."""
        p = self.manifests.latest()[1]["properties"]
        return ColumnId(p["key"], code_of(p["key_type"])) if "key_type" in p else None

    def shard_metadata(self, interval: str, ts: str | dt.datetime, columns: list[str] | None = None, shard: int | None = None) -> DataFrame:
        """Statistics of numeric columns by shard of a bucket: rows, entities, zone map, cardinality, nulls."""
        rows = self._read([s for s in self._at(interval, ts) if shard is None or s["shard"] == shard])
        numeric = [c for c, t in rows.dtypes if t in ("int", "bigint", "float", "double") and c not in (*SLICE, *OWN, self.key)]
        return stats.column_metadata(rows, columns or numeric, self.key)

    # -- reading --------------------------------------------------------------------------------

    def scan(self, interval: Predicate | None = None, start: Predicate | None = None, shard: int | None = None, empty_as_null: bool = False) -> DataFrame:
        """Rows of the chosen slices; a column that a slice lacks reads as null."""
        rows = self._read(self.slices(interval, start, shard))
        if empty_as_null:
            rows = rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c, t in rows.dtypes if t == "string" and c not in SLICE})
        return rows

    def scan_column(self, name: str, interval: Predicate | None = None, start: Predicate | None = None, shard: int | None = None, limit: int | None = None) -> DataFrame:
        """shard and a column in the order of shards and ids; the first ``limit`` rows of it if one is given."""
        rows = self.scan(interval, start, shard)
        have = rows.withColumn(name, F.lit(None).cast("string")) if name not in rows.columns else rows
        if limit is None:
            return have.select("shard", name)
        return have.orderBy("shard", self.key).limit(limit).select("shard", name)

    def fixed_column(self, name: str, value: object, interval: Predicate | None = None, start: Predicate | None = None, shard: int | None = None) -> DataFrame:
        """The key of each row and a column of one value."""
        return self.scan(interval, start, shard).select(self.key, F.lit(value).alias(name))

    def _schema(self, chosen: list[dict]) -> StructType:
        types = {n: t for s in self.manifests.latest()[1]["slices"] for n, t in s["columns"].items()} | {n: t for s in chosen for n, t in s["columns"].items()}
        return StructType([StructField(n, _parse_datatype_string(t)) for n, t in types.items()])

    def _read(self, chosen: list[dict]) -> DataFrame:
        schema = self._schema(chosen)
        places = StructType([StructField("interval", _parse_datatype_string("string")), StructField("interval_start", _parse_datatype_string("string")), StructField("shard", _parse_datatype_string("int"))])
        if not chosen:
            known = schema if schema.fields else StructType([StructField(n, _parse_datatype_string(t)) for n, t in ((self.key, "string"), ("_version", "bigint"), ("_instance_id", "string"))])
            return self.spark.createDataFrame([], StructType(known.fields + places.fields))
        parts = []
        groups: dict[tuple | None, list[dict]] = {}  # slices under their own name, and copies by the name they go by
        for s in chosen:
            groups.setdefault(tuple(s[c] for c in SLICE) if s.get("source") else None, []).append(s)
        full = StructType(schema.fields + [StructField("xact", _parse_datatype_string("string"))] + places.fields)
        for name, part in groups.items():
            paths = [self._dir(s) for s in part]
            rows = self.spark.read.schema(full).option("basePath", self.path).parquet(*paths).drop("xact")
            if name:
                rows = rows.withColumns({c: F.lit(v) for c, v in zip(SLICE, name, strict=True)})
            parts.append(rows.select(*schema.names, *SLICE))
        return reduce(DataFrame.unionByName, parts)

    def _dir(self, s: dict) -> str:
        s = s.get("source") or s
        return f"{self.path}/xact={s['xact']}/interval={s['interval']}/interval_start={s['interval_start'].replace(':', '%3A')}/shard={s['shard']}"

    def _id(self, value: object) -> Column:
        return F.lit(value).cast("string" if isinstance(value, str) else "bigint")

    def entity(self, value: object, interval: Predicate | None = None, start: Predicate | None = None) -> DataFrame:
        """Rows of one entity; only its shard is read."""
        return self.entities([value], interval, start)

    def entities(self, values: list, interval: Predicate | None = None, start: Predicate | None = None) -> DataFrame:
        """Rows of some entities; only their shards are read."""
        ids = [self._id(v) for v in values]
        shards = {r[0] for r in self.spark.range(1).select(F.explode(F.array(*map(self.strategy, ids)))).collect()}  # one a value asked for
        return self._read([s for s in self.slices(interval, start) if s["shard"] in shards]).where(F.col(self.key).isin(*ids))

    # -- transactions ---------------------------------------------------------------------------

    def begin(self) -> Token:
        self._idle()
        self._baseline = self.manifests.latest()
        self._token, self._pending = new_token(self._baseline[1].get("record", {})), []
        return self._token

    def _idle(self) -> None:
        if self._token:
            raise ValueError("a transaction is under way")

    def _need(self) -> None:
        if not self._token:
            raise TransactionError("no transaction is under way")

    def _add(self, op: str, rows: DataFrame, interval: str, ts: str | dt.datetime | Column, columns: list[str]) -> None:
        kind = dict(rows.dtypes)[self.key]
        if kind not in ("string", "bigint", "int"):
            raise EntityIdTypeError(f"entity ids can't be {kind}")
        rows = rows.withColumn(self.key, F.col(self.key).cast("bigint")) if kind == "int" else rows
        rows = rows.withColumn("_version", F.col("_version").cast("bigint"))
        at = ts if isinstance(ts, Column) else F.lit(ts)
        self._pending.append((op, interval, columns, rows.withColumn("interval_start", intervals.start(interval, at.cast("timestamp")))))

    def write(self, rows: DataFrame, interval: str, ts: str | dt.datetime | Column, version: str = "_version", empty: DataFrame | None = None) -> None:
        """Rows of whole entities: key, version, other columns.  Rows of one entity and bucket in one call share a version.

        ts: an instant, or a column of rows that says each row's.  empty: key and version of entities
        that have no rows; they are stored as one row of nulls.
        """
        self._need()
        rows = rows.withColumnRenamed(version, "_version")
        columns = [c for c in rows.columns if c not in (*SLICE, *OWN)]
        if empty is not None:
            empty = empty.select(self.key, F.col(version).alias("_version"))
            rows = rows.unionByName(empty.join(rows.select(self.key), self.key, "left_anti"), allowMissingColumns=True)
        self._add("write", rows, interval, ts, columns)

    def delete(self, ids: DataFrame, interval: str, ts: str | dt.datetime | Column, version: str = "_version") -> None:
        """Deletes entities that are stored at these versions or lower; in a table that lacks them nothing happens."""
        self._need()
        self._add("delete", ids.select(self.key, F.col(version).alias("_version"), *([] if not isinstance(ts, Column) else [ts.alias("_ts")])), interval, F.col("_ts") if isinstance(ts, Column) else ts, [])

    def change(self, rows: DataFrame, interval: str, ts: str | dt.datetime | Column, op: str = "op", position: str = "position", version: str = "_version") -> None:
        """Writes and deletes in the order of a column ``position``: rows of whole entities with op (write or delete), key, version, other columns.

        Rows of one entity and bucket that share a position are one operation.
        """
        self._need()
        rows = rows.withColumnsRenamed({version: "_version", op: "_op", position: "_at"})
        self._add("change", rows, interval, ts, [c for c in rows.columns if c not in (*SLICE, *OWN, "_op", "_at")])

    def rollback(self) -> None:
        self._need()
        token, self._token = self._token, None
        self.manifests.delete(f"{self.path}/xact={token.target}")

    def commit(self) -> int:
        """Publishes all pending operations of all slices together; the new version number."""
        self._need()
        number, state = self._baseline
        before = state.get("record", {})
        try:
            check(self._token, before)
            old = {tuple(s[c] for c in SLICE): s for s in state["slices"]}
            kinds = {dict(p[3].dtypes)[self.key] for p in self._pending if p[0] != "delete" or old}
            if kinds:
                kinds |= {state["properties"].get("key_type", next(iter(kinds)))}
            if len(kinds) > 1:
                raise EntityIdTypeError("entity ids of a table are all strings or all integers")
            if "key" in state["properties"] and state["properties"]["key"] != self.key:
                raise EntityIdTypeError(f"entity ids of this table are in {state['properties']['key']}")
            new = old | self._stage(old) if self._pending else old
            self._log()
            kept = [s for s in new.values() if s["xact"]]
            typed = {"key_type": kinds.pop()} if kinds and kept else {}
            self.manifests.publish(number + 1, {"slices": kept, "properties": state["properties"] | {"key": self.key} | typed, "record": record(self._token, before)})
        except Exception:
            self.rollback()
            raise
        self._token = None
        if self.retain:
            self.vacuum(self.retain)
        return number + 1

    def _told(self) -> list[DataFrame]:
        """Each call's rows with their interval, kind and pos, the order of operations."""
        out = []
        for i, (op, interval, _, df) in enumerate(self._pending):
            at = F.col("_at").cast("bigint") if op == "change" else F.lit(0).cast("bigint")
            kind = F.col("_op") if op == "change" else F.lit(op)
            out.append(df.withColumns({"interval": F.lit(interval), "_pos": F.struct(F.lit(i).alias("call"), at.alias("at")), "_kind": kind, "_call": F.lit(i)}).drop("_op", "_at", "_ts"))
        return out

    def _lone(self, heads: DataFrame, seen: list[Row]) -> bool:
        """Whether all is written, and each entity once a bucket at one version: then no row of this transaction gives way to another.

        What is the same all over each slice differs in no entity; only by what is not, entities are looked at.
        """
        slices: dict[tuple, list[Row]] = {}
        for r in seen:
            slices.setdefault((r.interval, r.interval_start, r.shard), []).append(r)
        if any(r.kind != "write" or r.n_version < r.n or r.n_at < r.n for r in seen):
            return False
        vary = [c for c in ("call", "at", "version") if any(min(r[f"{c}_min"] for r in x) < max(r[f"{c}_max"] for r in x) for x in slices.values())]
        if not vary:
            return True
        by = ["entity_id", *(["interval", "interval_start"] if len({k[:2] for k in slices}) > 1 else [])]
        spans = heads.groupBy(*by).agg(*(f(c).alias(f"{c}_{n}") for c in vary for n, f in (("min", F.min), ("max", F.max))))
        return spans.where(reduce(lambda a, b: a | b, (F.col(f"{c}_min") < F.col(f"{c}_max") for c in vary))).isEmpty()

    def _operations(self) -> tuple[DataFrame, DataFrame | None]:
        """One row an operation (entity, interval, bucket, version, pos, op, n), and the rows of writes with their pos."""
        heads, rows = [], []
        for (op, *_), told in zip(self._pending, self._told(), strict=True):
            heads.append(told.groupBy(F.col(self.key).alias("entity_id"), "interval", "interval_start", "_pos", "_kind").agg(F.max("_version").alias("version")).select("entity_id", "interval", "interval_start", "version", F.col("_pos").alias("pos"), F.col("_kind").alias("op")))
            if op != "delete":
                rows.append(told.where("_kind = 'write'").drop("_kind"))
        return reduce(DataFrame.unionByName, heads), reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows) if rows else None

    def _stage(self, old: dict) -> dict:
        """Writes the new slices of the shards that operations touch; slices by (interval, start, shard), those left empty without a transaction."""
        by = ["entity_id", "interval", "interval_start"]
        ops, rows = self._operations()
        heads = reduce(DataFrame.unionByName, (t.select(F.col(self.key).alias("entity_id"), "interval", "interval_start", F.col("_kind").alias("kind"), "_pos.call", "_pos.at", F.col("_version").alias("version")) for t in self._told()))
        spans = (f(c).alias(f"{c}_{n}") for c in ("at", "version") for n, f in (("min", F.min), ("max", F.max)))
        each = heads.groupBy("interval", "interval_start", self.strategy(F.col("entity_id")).alias("shard"), "kind", "call").agg(F.count("*").alias("n"), F.count("at").alias("n_at"), F.count("version").alias("n_version"), *spans)
        seen = each.withColumns({"call_min": F.col("call"), "call_max": F.col("call")}).collect()  # a row a slice, kind and call
        touched: dict[tuple, set[str]] = {}
        for r in seen:
            touched.setdefault((r[0], r[1], r[2]), set()).update(self._pending[r.call][2] if r.kind == "write" else ())
        here = [old[k] for k in touched if k in old]
        if not here and rows is None:
            return {}
        if not here and self._lone(heads, seen):
            out = rows.where(F.col(self.key).isNotNull() & F.col("interval_start").isNotNull()).drop("_pos", "_call")
            return self._put(out, old, touched, {"_instance_id": F.lit(self._token.target)})
        stored = self._read(here) if here else None
        known = stored.groupBy(F.col(self.key).alias("entity_id"), "interval", "interval_start").agg(F.max("_version").alias("version")) if here else None
        left = fold.live(ops, known, by)
        parts = []
        if rows is not None:
            if here:
                self._whole(left, known, old, touched)
            won = left.where("pos is not null").select(F.col("entity_id").alias(self.key), "interval", "interval_start", F.col("pos").alias("_pos"), F.col("version").alias("_version"))
            parts.append(rows.join(won, [self.key, "interval", "interval_start", "_pos", "_version"]).drop("_pos", "_call").withColumn("_instance_id", F.lit(self._token.target)))
        if here:
            parts.append(stored.drop("shard").join(left.where("pos is null").select(F.col("entity_id").alias(self.key), "interval", "interval_start"), [self.key, "interval", "interval_start"], "left_semi"))
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        types = dict(out.dtypes)
        for s in here:
            for n, t in s["columns"].items():
                if types.get(n, t) != t:
                    raise TypeError(f"column {n} is {t}, not {types[n]}")
        return self._put(out, old, touched)

    def _put(self, out: DataFrame, old: dict, touched: dict, same: dict[str, Column] | None = None) -> dict:
        """Writes rows of the touched slices; the new slices.  same: columns of one value, which are added behind the shuffle."""
        types = {n: t for n, t in out.dtypes if n not in SLICE} | {"_instance_id": "string"}
        self._write(out.withColumn("shard", self.strategy(F.col(self.key))), self._token.target, same)
        made = {}
        for k, columns in touched.items():
            have = self.manifests.children(self._dir(dict(zip(SLICE, k, strict=True)) | {"xact": self._token.target}))
            names = columns | set(old[k]["columns"] if k in old else ()) | {self.key, *OWN}
            if have or k in old:
                made[k] = dict(zip(SLICE, k, strict=True)) | {"xact": self._token.target if have else None, "columns": {n: types.get(n) or old[k]["columns"][n] for n in sorted(names)}}
        return made

    def _whole(self, left: DataFrame, known: DataFrame, old: dict, touched: dict) -> None:
        """An entity that is stored already must be written with all columns of its shard: else they would be at different versions."""
        lacking = []
        for i, (op, interval, columns, _) in enumerate(self._pending):
            for k in touched:
                if op != "delete" and k in old and k[0] == interval and set(old[k]["columns"]) - {*columns, *OWN, self.key}:
                    lacking.append((i, *k))
        if not lacking:
            return
        short = self.spark.createDataFrame(lacking, "call int, interval string, interval_start string, shard int")
        again = left.where("pos is not null").join(known.drop("version"), ["entity_id", "interval", "interval_start"], "left_semi").withColumns({"call": F.col("pos.call"), "shard": self.strategy(F.col("entity_id"))})
        wrong = again.join(F.broadcast(short), ["call", "interval", "interval_start", "shard"], "left_semi").select("entity_id", "interval", "interval_start", "shard", "version")
        if wrong.take(1):
            where = f"{self.path}/_errors/{self._token.target}"
            wrong.write.parquet(where)
            raise ConsistencyError(f"stored entities are written without columns that their shards have; see {where}")

    def errors(self) -> list[str]:
        """Places of the reports that failed commits have left."""
        return [f"{self.path}/_errors/{x}" for x in self.manifests.children(f"{self.path}/_errors")]

    def _write(self, out: DataFrame, xact: str, same: dict[str, Column] | None = None) -> None:
        """Rows of a slice are split over tasks if they are many.  A task writes its few slices side by side, so that it need not sort its rows."""
        dealt = out.hint("rebalance", *map(F.col, SLICE)).withColumns({"xact": F.lit(xact)} | (same or {}))
        conf, name = self.spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
        before = conf.get(name)
        conf.set(name, WRITERS)
        try:
            dealt.write.mode("append").option("compression", self.compression).partitionBy(*PLACES).parquet(self.path)
        finally:
            conf.set(name, before)

    # -- requests -------------------------------------------------------------------------------

    def _log(self) -> None:
        if self.capture is None or self.capture is False:
            return
        for op, interval, _, df in self._pending:
            rows = df if self.capture is True else df.where(self.capture)
            capture(rows.withColumn("interval", F.lit(interval)), f"{self.base}/{self.tenant}/_capture/{self.name}", op)

    def captured(self) -> DataFrame:
        """The log of requests: _kind, _day and request (JSON)."""
        return self.spark.read.text(f"{self.base}/{self.tenant}/_capture/{self.name}").select("_kind", "_day", F.col("value").alias("request"))

    def clean_capture(self, before: dt.date) -> list[str]:
        """Deletes the log's days before a date."""
        root, gone = f"{self.base}/{self.tenant}/_capture/{self.name}", []
        for kind in self.manifests.children(root):
            days = [d for d in self.manifests.children(f"{root}/{kind}") if d.startswith("_day=") and d.removeprefix("_day=") < before.isoformat()]
            gone += [f"{root}/{kind}/{d}" for d in days]
        for d in gone:
            self.manifests.delete(d)
        return gone

    # -- slices ---------------------------------------------------------------------------------

    def _publish(self, number: int, state: dict, slices: list[dict], token: Token | None = None) -> int:
        before = state.get("record", {})
        self.manifests.publish(number + 1, state | {"slices": slices, "record": record(token or new_token(before, auto=True), before)})
        return number + 1

    def _copy(self, source: list[dict], interval: str, start: str, shard: int | None = None) -> int:
        """Names the files of slices in another bucket too; shards that are there already stay as they are."""
        self._idle()
        number, state = self.manifests.latest()
        have = {s["shard"] for s in state["slices"] if (s["interval"], s["interval_start"]) == (interval, start)}
        made = []
        for s in source:
            at = s["shard"] if shard is None else shard
            if at not in have:
                made.append(s | {"interval": interval, "interval_start": start, "shard": at, "source": s.get("source") or {c: s[c] for c in PLACES}})
        return self._publish(number, state, state["slices"] + made) if made else number

    def snapshot(self, interval: str, ts: str | dt.datetime) -> int:
        """Copies the single interval to a bucket."""
        return self._copy(self.slices(Predicate("=", (intervals.SINGLE,))), interval, self._bucket(interval, ts))

    def copy_previous(self, interval: str, ts: str | dt.datetime) -> int:
        """Copies the bucket before to the bucket of ts."""
        before = self._bucket(interval, ts, -1)
        return self._copy([s for s in self.slices(Predicate("=", (interval,))) if s["interval_start"] == before], interval, self._bucket(interval, ts))

    def copy_shard(self, to: ShardId, source: ShardId) -> int:
        """Copies one slice to another; to itself, from none, or over one that is there, nothing happens."""
        chosen = [s for s in self.slices() if (s["interval"], s["interval_start"], s["shard"]) == (source.interval, source.start, source.shard)]
        return self._copy(chosen, to.interval, to.start, to.shard)

    def drop(self, interval: str | None = None, start: str | None = None) -> int:
        """Removes slices of an interval, of one bucket of it, or all."""
        self._idle()
        number, state = self.manifests.latest()
        keep = [s for s in state["slices"] if not ((interval is None or s["interval"] == interval) and (start is None or s["interval_start"] == start))]
        return self._publish(number, state, keep)

    def fragmentation(self, interval: str, start: str) -> dict[int, int]:
        """Of each shard of a bucket: the share of its files, in whole per cent, that a rewrite would save."""
        out = {}
        for s in self.slices(Predicate("=", (interval,))):
            if s["interval_start"] == start:
                sizes = self.manifests.sizes(self._dir(s))
                out[s["shard"]] = 100 * (len(sizes) - max(1, -(-sum(sizes) // FILE_BYTES))) // max(1, len(sizes))
        return out

    def compact(self, interval: str, start: str, trigger: int = 0) -> int:
        """Rewrites the slices of a bucket whose fragmentation is ``trigger`` per cent or more into few files each."""
        self._idle()
        number, state = self.manifests.latest()
        worn = {shard for shard, f in self.fragmentation(interval, start).items() if f >= trigger}
        here = [s for s in state["slices"] if (s["interval"], s["interval_start"]) == (interval, start) and s["shard"] in worn]
        if not here:
            return number
        token = new_token(state.get("record", {}), auto=True)
        try:
            self._write(self._read(here), token.target)
            made = [{c: s[c] for c in (*SLICE, "columns")} | {"xact": token.target} for s in here]
            return self._publish(number, state, [s for s in state["slices"] if s not in here] + made, token)
        except Exception:
            self.manifests.delete(f"{self.path}/xact={token.target}")
            raise

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes manifests but the last ``keep`` and the directories that none of these names."""
        numbers = self.manifests.numbers()
        used = {(s.get("source") or s)["xact"] for n in numbers[-keep:] for s in self.manifests.read(n)["slices"]} | ({self._token.target} if self._token else set())
        for n in numbers[:-keep]:
            self.manifests.delete(f"{self.manifests.path}/{n:010d}.json")
        gone = [d for d in self.manifests.children(self.path) if d.startswith("xact=") and d.removeprefix("xact=") not in used]
        for d in gone:
            self.manifests.delete(f"{self.path}/{d}")
        return gone


def capture(rows: DataFrame, path: str, kind: str) -> None:
    """Appends a request's rows to a JSON log by kind and day."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value"), F.lit(kind).alias("_kind"), F.current_date().alias("_day")).write.mode("append").partitionBy("_kind", "_day").text(path)
