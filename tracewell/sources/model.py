"""The event model over the parquet tables: passports, exposures, sessions, facts, chunks, merges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import sessionize

EVENT_NOW = "2024-01-31"
ORDER_NOW = "2001-08-02"
#: Keys of the fact log.
FACT_KEYS = ("order_status", "order_total", "order_priority", "segment", "acctbal", "nation", "first_purchase_at")


def _case(on, pairs: dict, other=None):
    out = None
    for value, label in pairs.items():
        out = F.when(on == value, label) if out is None else out.when(on == value, label)
    return out.otherwise(F.lit(other))


@dataclass
class Model:
    """Lazy views; each reads only the tables and columns that a query needs."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def passports(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("id"))

    @cached_property
    def events(self) -> DataFrame:
        """Exposures without content: no join."""
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("passport_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            _case(kind, {"click": "web", "view": "web", "signup": "crm", "purchase": "mail"}, "voip").alias("channel"),
            _case(kind, {"view": "exposure", "click": "expression", "purchase": "conversion", "signup": "observation"}, "conversation").alias("direction"),
            _case(F.col("event_id") % 4, {0: "video", 1: "page", 2: "text"}).alias("source"),
            F.nullif((F.col("event_id") % 7) * 100, F.lit(0)).alias("dwell_ms"),
            kind.alias("attr_event"),
            F.col("value").alias("attr_value"),
            F.get_json_object("props", "$.k").alias("attr_k"),
            F.to_json(F.struct(kind.alias("event"), F.col("value").alias("value"), F.get_json_object("props", "$.k").alias("k"))).alias("meta"),
        )

    @cached_property
    def exposures(self) -> DataFrame:
        """Events with the page that they were about, its id and the digest of its address."""
        n = self.table("pages").count()
        pages = self.table("pages").select("page_id", F.col("url").alias("content_url"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("content_id"), F.sha2("url", 256).alias("content_hash"))
        return self.events.join(pages, F.col("id") % F.lit(max(n, 1)) == F.col("page_id"), "left").drop("page_id")

    def visits(self, gap: str = "24 hours") -> DataFrame:
        """Events with their session's number, id and campaign."""
        numbered = sessionize(self.events, gap)
        source = _case(F.col("session_seq") % 4, {0: "google", 1: "meta", 2: "newsletter"})
        return numbered.withColumn("session_id", F.concat_ws("-", "passport_id", "session_seq")).withColumn("utm_source", source)

    @cached_property
    def facts(self) -> DataFrame:
        """The fact log; a filter on key leaves only that key's branch."""
        orders, customer = self.table("orders"), self.table("customer")

        def branch(df, key, pid, value, kind, at, fid, num=None, when=None):
            return df.select(
                F.col(fid).cast("long").alias("id"), F.col(pid).alias("passport_id"), F.lit(key).alias("key"), value.cast("string").alias("value"), F.lit(kind).alias("type"),
                (F.lit(None) if num is None else num).cast("double").alias("num"), (F.lit(None) if when is None else when).cast("timestamp").alias("at"), at.cast("timestamp").alias("observed_at"),
            )

        day = F.col("o_orderdate")
        start = F.lit("1995-01-01")
        nation = customer.join(F.broadcast(self.table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows by definition
        bought = self.table("events").filter(F.col("event_type") == "purchase").groupBy("user_id").agg(F.min(F.col("ts").cast("timestamp")).alias("first"))
        parts = [
            branch(orders, "order_status", "o_custkey", F.col("o_orderstatus"), "string", day, "o_orderkey"),
            branch(orders, "order_total", "o_custkey", F.col("o_totalprice"), "number", day, "o_orderkey", num=F.col("o_totalprice")),
            branch(orders, "order_priority", "o_custkey", F.col("o_orderpriority"), "string", day, "o_orderkey"),
            branch(customer, "segment", "c_custkey", F.col("c_mktsegment"), "string", start, "c_custkey"),
            branch(customer, "acctbal", "c_custkey", F.col("c_acctbal"), "number", start, "c_custkey", num=F.col("c_acctbal")),
            branch(nation, "nation", "c_custkey", F.col("n_name"), "string", start, "c_custkey"),
            branch(bought, "first_purchase_at", "user_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "date", F.col("first"), "user_id", when=F.col("first")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def chunks(self) -> DataFrame:
        docs, vectors = self.table("documents"), self.table("embeddings")
        # digests before the join: a query that needs no text sends none through its shuffle
        docs = docs.select("doc_id", F.sha2(F.col("text"), 256).alias("content_hash"), F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"))
        return docs.join(vectors, F.col("doc_id") == F.col("vec_id")).select(*docs.columns, "embedding")

    @cached_property
    def merges(self) -> DataFrame:
        ids = self.passports.filter("id BETWEEN 1 AND 999")
        return ids.select(F.col("id").alias("absorbed"), F.floor(F.col("id") / 10).alias("survivor"))
