"""Facts written to disk: an append-only log, and beside it the current value of each passport and key.

    folder/log/v=N/key=K/            the rows of write N
    folder/current/v=N/key=K/bucket=B/    the current rows of one key and bucket of passports, as of write N
    folder/ledger/N.json             what is valid after write N

A write appends to the log, folds its rows into the buckets that they touch, writes these anew, and is valid once its
ledger entry has its name.  Until then nobody reads any of it, and a write that failed is done again over the same
folders.  The ledger remembers the last batch of each stream, so a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.durations import SpecError
from ..operators import facts as fact_ops
from ..operators import identity

BUCKETS = 8
FIELDS = {"id": "long", "passport_id": "long", "value": "string", "type": "string", "num": "double", "at": "timestamp", "source": "string", "external_id": "string", "observed_at": "timestamp"}
COLUMNS = [*FIELDS, "key"]
#: Rows of one passport and key in one write, at most, when they come without ids.
_PER_BATCH = 1 << 24
#: Rows that a task folds, about.
_FOLDED = 600_000


def _sizes(rows: DataFrame) -> dict[tuple[str, int], int]:
    """Rows of each key and bucket: keys times buckets at most."""
    return {(r["key"], r["bucket"]): r["n"] for r in rows.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()}


class FactStore:
    """A fact log with its current values in a folder that all executors reach.

    Rows are (passport_id, key, value, observed_at) and, where they have them, id, type, num, at, source and external_id.  Of
    several rows of one instant the one with the larger id is newer; rows without ids get one in the order of writing.  A key's
    current values lie in `buckets` parts by passport, so that a small write reads and writes little; choose as many as make parts
    of some hundred megabytes.  rewrite() puts the log's writes together.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._path, self._fs = spark._jvm.org.apache.hadoop.fs.Path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- the ledger

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.folder}/{folder}")
        return [x.getPath().getName() for x in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def state(self) -> dict:
        """{n, streams: {name: last batch}, log: [writes], current: {key: {bucket: write}}} after the last valid write."""
        done = [int(x[:-5]) for x in self._names("ledger") if x.endswith(".json") and x[:-5].isdigit()]
        if not done:
            return {"n": 0, "streams": {}, "log": [], "current": {}}
        stream = self._fs.open(self._path(f"{self.folder}/ledger/{max(done)}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        """Give the entry its name; another writer's entry of that number is an error."""
        hidden, name = (self._path(f"{self.folder}/ledger/{x}") for x in (f"_{state['n']}.tmp", f"{state['n']}.json"))
        out = self._fs.create(hidden, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(hidden, name):
            raise RuntimeError(f"write {state['n']} was made by somebody else meanwhile")

    # ---- reading

    def _read(self, what: str, paths: Iterable[str]) -> DataFrame:
        """The rows of some folders below log or current, each v=N or a folder in it; no other folder is listed."""
        bucket = ", bucket int" if what == "current" else ""
        schema = ", ".join(f"{c} {t}" for c, t in FIELDS.items()) + f", v long, key string{bucket}"
        paths = [f"{self.folder}/{what}/{x}" for x in dict.fromkeys(paths)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{what}").parquet(*paths)

    def _folder_of(self, key: str) -> str:
        return f"key={self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(key)}"

    def log(self, key: str | None = None) -> DataFrame:
        """The log; of rows with one source, key and external_id the newest write counts.  A key reads its folders only."""
        state = self.state()
        paths = [f"v={v}" for v in state["log"]]
        if key is not None:
            paths = [p for x in paths if self._fs.exists(self._path(f"{self.folder}/log/{(p := f'{x}/{self._folder_of(key)}')}"))]
        rows = self._read("log", paths)
        if not state.get("replaced"):
            return rows.select(COLUMNS)
        named = rows.filter("external_id IS NOT NULL").groupBy("source", "key", "external_id").agg(F.max_by(F.struct(*[c for c in COLUMNS if c not in ("source", "key", "external_id")]), F.struct("v", "id")).alias("r"))
        return rows.filter("external_id IS NULL").select(COLUMNS).unionByName(named.select("source", "key", "external_id", "r.*").select(COLUMNS))

    def current(self, *keys: str) -> DataFrame:
        """One row for each passport and key: its newest value.  Keys given read their folders only."""
        state = self.state()
        held = {k: b for k, b in state["current"].items() if not keys or k in keys}
        return self._current(held).select(COLUMNS)

    def _current(self, held: dict[str, dict[str, int]]) -> DataFrame:
        """The rows of these keys' buckets; a key that one write made whole is one folder."""
        paths = []
        for key, buckets in held.items():
            name, versions = self._folder_of(key), set(buckets.values())
            if len(versions) == 1 and len(buckets) > 1:
                paths.append(f"v={next(iter(versions))}/{name}")
            else:
                paths += [f"v={v}/{name}/bucket={b}" for b, v in buckets.items()]
        return self._read("current", paths)

    # ---- writing

    def _shaped(self, rows: DataFrame, n: int) -> DataFrame:
        for column in ("passport_id", "key", "value", "observed_at"):
            if column not in rows.columns:
                raise SpecError(f"facts: rows need a column {column}")
        whole = F.col("passport_id").isNotNull() & F.col("key").isNotNull() & F.col("observed_at").isNotNull()
        rows = rows.filter(F.when(whole, True).otherwise(F.raise_error(F.lit("facts: a row has no passport_id, key or observed_at")).cast("boolean")))
        number = F.expr("try_cast(value AS double)")
        given = {"type": F.when(F.col("value").isNull(), "string").otherwise(fact_ops.exprs.value_type(F.col("value"))), "num": F.when(F.col("value").rlike(fact_ops.exprs.NUMERIC), number), "at": F.try_to_timestamp("value"), "source": F.lit("unknown"), "external_id": F.lit(None)}
        order = W.partitionBy("passport_id", "key").orderBy("observed_at", "value")
        given["id"] = F.row_number().over(order) + F.lit(n * _PER_BATCH)
        rows = rows.withColumns({c: e for c, e in given.items() if c not in rows.columns})
        return rows.select(*[F.col(c).cast(t) for c, t in FIELDS.items()], F.col("key").cast("string"))

    def record(self, rows: DataFrame, batch: int | None = None, stream: str = "", resolve: str | None = None, force: bool = False, merges: DataFrame | None = None, keys: Iterable[str] | None = None) -> bool:
        """Write facts; false if the stream's batch was written before.

        Rows that restate the current value are left out unless `force`.  A row whose external_id its source has written for the key is
        an error, or with resolve="skip" left out, or with "replace" put in the place of the other.  Ids that merges
        (absorbed, survivor) have absorbed are those of their survivors.

        With `keys`, the only ones that the rows may have, the log gets each key's rows on their own and as they lie, without a shuffle or
        sort: for rows whose plan leaves out the other keys, as of a union of one table for each key.
        """
        if resolve not in (None, "skip", "replace"):
            raise SpecError(f"facts: resolve must be skip or replace, not {resolve!r}")
        state = self.state()
        if batch is not None and batch <= state["streams"].get(stream, -1):
            return False
        n = state["n"] + 1
        rows = self._shaped(rows if merges is None else identity.resolve(rows, merges), n)
        if not force:
            rows = fact_ops.news(rows, self.current())
        if state.get("named"):
            rows = self._settled(rows, resolve)
        if keys is None:
            rows.hint("rebalance", "key").write.mode("overwrite").partitionBy("key").parquet(f"{self.folder}/log/v={n}")  # few files, and a frequent key in several
        else:
            self._append(rows, n, list(dict.fromkeys(keys)))
        written = self._read("log", [f"v={n}"])
        named = bool(state.get("named")) or not written.filter("external_id IS NOT NULL").isEmpty()
        replaced = bool(state.get("replaced")) or (named and resolve == "replace")
        log = {**state, "log": [*state["log"], n], "named": named, "replaced": replaced}
        if replaced and resolve == "replace":
            return self._again(log, n, batch, stream, written)
        self._fold(log, n, written, keep=True)
        return self._done(log, n, batch, stream)

    def _append(self, rows: DataFrame, n: int, keys: list[str]) -> None:
        """Write the rows of each key into its folder of the log."""
        self._fs.delete(self._path(f"{self.folder}/log/v={n}"), True)  # of a write that failed
        if not rows.filter(F.coalesce(~F.col("key").isin(keys), F.lit(True))).isEmpty():
            raise SpecError(f"facts: rows have other keys than {', '.join(keys)}")
        for key in keys:
            rows.filter(F.col("key") == key).drop("key").write.mode("overwrite").parquet(f"{self.folder}/log/v={n}/{self._folder_of(key)}")

    def _settled(self, rows: DataFrame, resolve: str | None) -> DataFrame:
        names = ["source", "key", "external_id"]
        known = self.log().filter("external_id IS NOT NULL").select(*names).distinct().withColumn("_known", F.lit(True))
        if resolve == "replace":
            return rows
        if resolve == "skip":
            return rows.join(known, names, "left_anti").select(COLUMNS)
        checked = F.when(F.col("_known"), F.raise_error(F.lit("facts: an external_id is there already, resolve it by skip or replace")).cast("boolean")).otherwise(True)
        return rows.join(known, names, "left").filter(checked).select(COLUMNS)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("passport_id"), F.lit(self.buckets)).cast("int")

    def _fold(self, state: dict, n: int, rows: DataFrame, keep: bool) -> None:
        """Write the buckets that the rows touch, with what they held if `keep`, and enter them into the state.

        Rows are shuffled once, by bucket and in large buckets by slices of its passports; each task folds what it gets and writes it.
        """
        rows = rows.select(COLUMNS).withColumn("bucket", self._bucket())
        sizes = _sizes(rows)
        if not sizes:
            return
        touched = sorted(sizes)
        current = {k: dict(b) for k, b in state["current"].items()}
        held = {k: {str(b): current[k][str(b)] for x, b in touched if x == k and str(b) in current[k]} for k in {k for k, _ in touched} if k in current}
        held = {k: b for k, b in held.items() if b}
        if keep and held:
            before = self._current(held).select(*COLUMNS, "bucket")
            sizes = {x: size + more.get(x, 0) for more in [_sizes(before)] for x, size in sizes.items()}
            rows = rows.unionByName(before)
        slices: dict[str, int] = {}
        for (key, _), size in sizes.items():
            slices[key] = max(slices.get(key, 1), -(-size // _FOLDED))
        large = {k: m for k, m in slices.items() if m > 1}
        if large:
            of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in large.items() for x in pair]), F.col("key")), F.lit(1))
            rows = rows.withColumn("slice", F.pmod(F.hash("passport_id"), of))
            dealt = rows.repartition(sum(slices[key] for key, _ in touched), "key", "bucket", "slice")
        else:
            dealt = rows.withColumn("slice", F.lit(0)).repartition("key", "bucket")
        row = F.struct(*[c for c in FIELDS if c != "passport_id"])
        newest = dealt.groupBy("key", "bucket", "slice", "passport_id").agg(F.max_by(row, F.struct("observed_at", "id")).alias("r")).select("passport_id", "key", "bucket", "r.*")
        newest.write.mode("overwrite").partitionBy("key", "bucket").parquet(f"{self.folder}/current/v={n}")
        for k, b in touched:
            current.setdefault(k, {})[str(b)] = n
        state["current"] = current

    def _done(self, state: dict, n: int, batch: int | None, stream: str) -> bool:
        streams = state["streams"] if batch is None else {**state["streams"], stream: batch}
        self._commit({**state, "n": n, "streams": streams})
        return True

    def _again(self, state: dict, n: int, batch: int | None, stream: str, written: DataFrame) -> bool:
        """After a replacement the newest row may be an older one: fold the keys that it touches from the log."""
        keys = [r["key"] for r in written.select("key").distinct().collect()]
        reading = FactStore(self.spark, self.folder, self.buckets)
        reading.state = lambda: state
        whole = reading.log().filter(F.col("key").isin(keys))
        state["current"] = {k: b for k, b in state["current"].items() if k not in keys}
        self._fold(state, n, whole, keep=False)
        return self._done(state, n, batch, stream)

    def record_one(self, **fact) -> bool:
        """Write one fact given by its columns; without observed_at it is observed now."""
        row = {k: v for k, v in fact.items() if k in COLUMNS}
        schema = ", ".join(f"{c} {t}" for c, t in {**FIELDS, "key": "string"}.items() if c in row)
        rows = self.spark.createDataFrame([tuple(row[f.split()[0]] for f in schema.split(", "))], schema)
        options = {k: v for k, v in fact.items() if k not in COLUMNS}
        return self.record(rows if "observed_at" in row else rows.withColumn("observed_at", F.current_timestamp()), **options)

    def record_many(self, passports: DataFrame, key: str, value: str, observed_at: str | None = None, **options) -> bool:
        """Write one fact for each of many passports, at one instant; ids that are one after merges get one row."""
        at = F.current_timestamp() if observed_at is None else F.lit(observed_at).cast("timestamp")
        merges = options.pop("merges", None)
        people = passports.select("passport_id") if merges is None else identity.resolve(passports.select("passport_id"), merges)
        return self.record(people.distinct().select("passport_id", F.lit(key).alias("key"), F.lit(value).alias("value"), at.alias("observed_at")), **options)

    def sink(self, stream: DataFrame, checkpoint: str, name: str, **options):
        """Write a stream of facts batch by batch; a batch that the engine sends again is not written twice."""
        write = lambda rows, batch: self.record(rows, batch=batch, stream=name, **options)
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

    # ---- upkeep

    def rewrite(self, rows: DataFrame) -> None:
        """Put rows in the place of the whole log and derive the current values from them."""
        state = self.state()
        n = state["n"] + 1
        rows.select(COLUMNS).hint("rebalance", "key").write.mode("overwrite").partitionBy("key").parquet(f"{self.folder}/log/v={n}")
        made = {**state, "log": [n], "current": {}, "replaced": False}
        self._fold(made, n, self._read("log", [f"v={n}"]), keep=False)
        self._done(made, n, None, "")

    def rebuild(self) -> None:
        self.rewrite(self.log())

    def repoint(self, merges: DataFrame) -> None:
        """Give the facts of absorbed passports to their survivors."""
        self.rewrite(identity.resolve(self.log(), merges))

    def erase(self, people: DataFrame) -> None:
        self.rewrite(identity.erase(self.log(), people))

    def drift(self) -> DataFrame:
        """(passport_id, key, held, expected) where the current values are not those of the log."""
        newest = F.max_by("value", F.struct("observed_at", "id"))
        truth = self.log().groupBy("passport_id", "key").agg(newest.alias("expected"), F.lit(1).alias("_there"))
        held = self.current().select("passport_id", "key", F.col("value").alias("held"), F.lit(1).alias("_here"))
        both = held.join(truth, ["passport_id", "key"], "full_outer")
        return both.filter(~(F.col("held").eqNullSafe(F.col("expected")) & F.col("_here").eqNullSafe(F.col("_there")))).select("passport_id", "key", "held", "expected")

    def vacuum(self) -> int:
        """Remove folders that no valid entry refers to, and entries but the last; the number of folders removed."""
        state = self.state()
        used = {"log": set(state["log"]), "current": {v for b in state["current"].values() for v in b.values()}}
        gone = [f"{what}/{x}" for what, versions in used.items() for x in self._names(what) if x.startswith("v=") and int(x[2:]) not in versions]
        for x in [*gone, *(f"ledger/{x}" for x in self._names("ledger") if x != f"{state['n']}.json")]:
            self._fs.delete(self._path(f"{self.folder}/{x}"), True)
        return len(gone)
