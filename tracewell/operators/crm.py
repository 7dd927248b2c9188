"""What other systems tell: notes, observations and events, with sets that replace what they sent before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs

EXPOSURE = ("passport_id", "ts", "channel", "direction", "source", "content_id", "text", "meta", "plugin")


def claims_of(customers: DataFrame, country: str | None = None) -> DataFrame:
    """(row, type, name, value) of what a customer (row, source, email, phone, external_id) is known by."""
    mail = F.struct(F.lit("email").alias("type"), F.lit("address").alias("name"), F.lower("email").alias("value"))
    phone = F.struct(F.lit("phone").alias("type"), F.lit("e164").alias("name"), exprs.e164(F.col("phone"), country).alias("value"))
    user = F.struct(F.lit("user").alias("type"), F.col("source").alias("name"), F.concat("source", F.lit(":"), F.col("external_id").cast("string")).alias("value"))
    return customers.select("row", F.explode(F.array(mail, phone, user)).alias("c")).select("row", "c.*").filter("value IS NOT NULL AND value <> ''")


def _exposures(rows: DataFrame, direction: Column, content: Column, text: Column, meta: Column) -> DataFrame:
    given = {"channel": F.lit("crm"), "direction": direction, "content_id": content, "text": text, "meta": F.to_json(meta), "plugin": F.lit("crm")}
    return rows.select("passport_id", F.coalesce("ts", F.current_timestamp()).alias("ts"), "source", *[c.alias(k) for k, c in given.items()]).select(*EXPOSURE)


def notes(rows: DataFrame) -> DataFrame:
    """Exposures of notes (passport_id, source, kind, id, body, ts, ref_kind, ref_id); without a body there is none.

    A note that refers to a record names its entity, `kind:id`, under which the record's facts stand.
    """
    ref = F.when(F.col("ref_kind").isNotNull(), F.struct(F.col("ref_kind").alias("kind"), F.col("ref_id").cast("string").alias("external_id"), F.concat_ws(":", "ref_kind", F.col("ref_id").cast("string")).alias("entity")))
    content = F.concat_ws(":", "source", F.lit("fact"), "kind", F.col("id").cast("string"))
    return _exposures(rows.filter("body <> ''"), F.lit("observation"), content, F.col("body"), F.struct("kind", ref.alias("ref")))


def observations(rows: DataFrame) -> DataFrame:
    """Exposures of what a client saw (passport_id, source, kind, id, body, ts), marked as the client's word."""
    rows = rows.withColumn("source", F.coalesce("source", F.lit("client")))
    content = F.concat_ws(":", "source", F.lit("obs"), "kind", F.col("id").cast("string"))
    return _exposures(rows.filter("body <> ''"), F.lit("observation"), content, F.col("body"), F.struct("kind", F.lit(True).alias("client")))


def events(rows: DataFrame) -> DataFrame:
    """Exposures of events (passport_id, source, event, external_id, text, ts, direction, attrs); without a name there is none.

    attrs is a map of texts; a key `event` in it gives way to the event's name.
    """
    meta = F.map_concat(F.create_map(F.lit("event"), F.col("event")), F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, v: k != "event"))
    return _exposures(rows.filter("event <> ''"), F.coalesce("direction", F.lit("expression")), F.col("external_id").cast("string"), F.coalesce(F.nullif("text", F.lit("")), F.col("event")), meta)


def replaced(held: DataFrame, scopes: DataFrame) -> DataFrame:
    """The held exposures that stay when scopes (passport_id, source, prefix) are sent anew.

    What this plugin wrote for the passport and source with a content_id that begins with the prefix goes; nobody else's rows do.  Rows
    meet the scopes of their own passport and source only.
    """
    some = scopes.filter("prefix <> ''").select(F.col("passport_id").alias("_p"), F.col("source").alias("_s"), F.col("prefix").alias("_x")).distinct()
    same = (F.col("passport_id") == F.col("_p")) & (F.col("source") == F.col("_s")) & F.startswith(F.col("content_id"), F.col("_x")) & (F.col("plugin") == "crm")
    return held.join(some, same, "left_anti")


def ingest_events(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """The exposures after incoming events, whose column `replace` says by a prefix what they are all of; none replaces nothing.

    A set sent twice is there once.  A set without a named event replaces nothing, as an empty one does.
    """
    scopes = incoming.filter("event <> '' AND replace IS NOT NULL").select("passport_id", "source", F.col("replace").alias("prefix"))
    return replaced(held, scopes).select(*EXPOSURE).unionByName(events(incoming))


def note_stats(exposures: DataFrame, since: str | None = None) -> DataFrame:
    """One row: notes, and observations by clients, that came since an instant (created_at)."""
    rows = exposures.filter("plugin = 'crm'")
    if since is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    client = F.get_json_object("meta", "$.client")
    return rows.agg(F.count_if(client.isNull()).alias("notes"), F.count_if(client.isNotNull()).alias("observations"))


# ---- events of readers, typed from JSON ----------------------------------------------------------------

# The kinds of engagement, and of what type each field is: + must be there, ? may be null.
FIELDS = {
    "section": {"text": "text+", "id": "string?", "url": "url?", "ts": "moment", "dwell_ms": "count", "meta": "object"},
    "text": {"text": "text+", "id": "string?", "kind": "paragraph|heading", "level": "level?", "length_chars": "count", "url": "url?", "ts": "moment", "ms_spent": "count", "partial": "flag"},
    "video": {"id": "string?", "kind": "video", "src": "url?", "url": "url?", "duration_s": "amount?", "total_watched_s": "amount", "completion_pct": "percent?", "ms_spent": "count", "muted": "flag", "partial": "flag", "ts": "moment", "start_s": "amount", "end_s": "amount"},
    "image": {"id": "string?", "kind": "image", "src": "url?", "url": "url?", "alt": "string?", "width": "count?", "height": "count?", "ts": "moment", "ms_spent": "count", "partial": "flag", "description": "string"},
    "link": {"id": "string?", "text": "text+", "href": "string?", "ts": "moment"},
}
MOST_EVENTS = 500


def _field(body: Column, name: str, rule: str) -> Column:
    """Null if the field keeps its rule, else its name."""
    value = F.try_variant_get(body, f"$.{name}", "variant")
    kind = F.schema_of_variant(value)
    text, number = F.try_variant_get(body, f"$.{name}", "string"), F.try_variant_get(body, f"$.{name}", "double")
    is_text, is_number = kind == "STRING", kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    whole = is_number & (number == F.floor(number))
    plain = rule.rstrip("+?")
    good = {
        "text": lambda: is_text & (text != ""), "string": lambda: is_text, "url": lambda: is_text & text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"),
        "moment": lambda: is_text | is_number, "count": lambda: whole & (number >= 0), "amount": lambda: is_number & (number >= 0),
        "percent": lambda: is_number & number.between(0, 100), "level": lambda: whole & number.between(1, 6), "flag": lambda: kind == "BOOLEAN",
        "object": lambda: F.startswith(kind, F.lit("OBJECT")),
    }
    keeps = good[plain]() if plain in good else is_text & text.isin(plain.split("|"))
    keeps = F.coalesce(keeps, F.lit(False))
    if rule.endswith("?"):
        keeps = keeps | (kind == "VOID")
    return F.when(value.isNull() if rule.endswith("+") else value.isNotNull() & ~keeps, name).when(F.lit(rule.endswith("+")) & ~keeps, name)


def parsed(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """The rows with place, kind, the typed fields of each event of a JSON envelope {events: [...]}, and reject: why it counts for nothing.

    An event is {type: "engagement.KIND", ...fields} or {kind, data}.  An envelope that is no JSON, has no list, or none or more than
    MOST_EVENTS events, is one rejected row.
    """
    envelope = F.try_parse_json(payload)
    items = F.try_variant_get(envelope, "$.events", "array<variant>")
    fault = F.when(envelope.isNull(), "no JSON").when(items.isNull(), "no events").when(~F.size(items).between(1, MOST_EVENTS), "number of events")
    each = rows.withColumns({"_items": items, "reject": fault})
    each = each.select("*", F.posexplode_outer(F.when(F.col("reject").isNull(), F.col("_items"))).alias("place", "_item")).drop("_items")
    typed = F.try_variant_get("_item", "$.type", "string")
    kind = F.when(typed.isNotNull(), F.regexp_extract(typed, r"^engagement\.(\w+)$", 1)).otherwise(F.try_variant_get("_item", "$.kind", "string"))
    body = F.when(typed.isNotNull(), F.col("_item")).otherwise(F.try_variant_get("_item", "$.data", "variant"))
    each = each.withColumns({"kind": kind, "_body": body})
    known = F.col("kind").isin(*FIELDS)
    faults = F.lit(None).cast("string")
    for name, fields in FIELDS.items():
        wrong = F.array_compact(F.array(*[_field(F.col("_body"), f, rule) for f, rule in fields.items()]))
        if name == "video":
            nowhere = F.coalesce(*[F.try_variant_get("_body", f"$.{f}", "string") for f in ("src", "url", "intervals")]).isNull()
            wrong = F.when(nowhere, F.concat(wrong, F.array(F.lit("src")))).otherwise(wrong)
        faults = F.when(F.col("kind") == name, F.array_join(wrong, ",")).otherwise(faults)
    get = lambda name, kind: F.try_variant_get("_body", f"$.{name}", kind).alias(name)
    reject = F.coalesce("reject", F.when(~F.coalesce(known, F.lit(False)), "kind"), F.nullif(faults, F.lit("")))
    given = [get(n, "string") for n in ("id", "text", "url", "src", "href")] + [get(n, "long") for n in ("dwell_ms", "ms_spent", "length_chars")] + [get(n, "double") for n in ("duration_s", "total_watched_s", "completion_pct")] + [get("partial", "boolean")]
    return each.select(*[c for c in rows.columns if c != payload], "place", F.when(known, F.col("kind")).alias("kind"), *given, reject.alias("reject"))
