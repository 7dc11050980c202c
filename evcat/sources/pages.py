"""Page scans: rendered pages to raw payload columns, and skipping of unchanged pages."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evcat import config as C
from evcat.functions import html as H
from evcat.functions import rules as R
from evcat.functions import text as T
from evcat.operators.ordered import add_previous
from evcat.session import broadcast_if_small, cut, is_small

RAW_COLUMNS = (
    "source_id", "page_url", "place", "external_id", "payload", "raw_payload_json", "cleaned_text", "json_ld", "fetched_at",
)
Adapter = Callable[[DataFrame], DataFrame]


def generic_adapter(pages: DataFrame) -> DataFrame:
    """One raw event per page: metadata and visible text, no external id.

    Map-only; the page body does not leave this step.
    """
    html = F.col("html_or_json")
    read = pages.select(
        "source_id",
        F.col("url").alias("page_url"),
        "fetched_at",
        H.best_image(html, F.col("url")).alias("poster"),
        H.meta_description(html).alias("meta"),
        H.json_ld_text(html).alias("json_ld"),
        T.clean_text(html, C.MAX_EXTRACTION_CHARS).alias("visible"),
    )
    read = read.withColumn(
        "cleaned_text",
        H.extraction_text(F.col("page_url"), F.col("meta"), F.col("poster"), F.col("json_ld"), F.col("visible")),
    )
    given = {
        "canonical_url": F.col("page_url"),
        "poster_url": F.col("poster"),
        "_cleaned_text": F.col("cleaned_text"),
        "_meta_description": F.col("meta"),
        "_json_ld": F.col("json_ld"),
    }
    payload = F.struct(
        *[given.get(f, F.lit(None).cast("string")).alias(f) for f in R.PAYLOAD_FIELDS]
    )
    stored = F.to_json(F.struct(*[v.alias(k) for k, v in given.items()]))
    return read.select(
        "source_id",
        "page_url",
        F.lit(0).alias("place"),
        F.lit(None).cast("string").alias("external_id"),
        payload.alias("payload"),
        stored.alias("raw_payload_json"),
        "cleaned_text",
        "json_ld",
        "fetched_at",
    )


def static_adapter(pages: DataFrame) -> DataFrame:
    """One raw event per object in the ``results`` (else ``events``) list of a JSON page."""
    lists = F.from_json("html_or_json", "results array<variant>, events array<variant>")
    items = pages.withColumn("_lists", lists).select(
        "source_id",
        F.col("url").alias("page_url"),
        "fetched_at",
        F.posexplode(
            F.coalesce(F.when(F.size("_lists.results") > 0, F.col("_lists.results")), F.col("_lists.events"))
        ).alias("place", "_item"),
    )
    objects = items.filter(F.schema_of_variant("_item").startswith("OBJECT")).withColumn("raw_payload_json", F.to_json("_item"))
    return _with_payload(objects, "raw_payload_json", "payload").select(
        "source_id",
        "page_url",
        "place",
        T.first_filled(F.col("payload._id"), F.col("payload.id")).alias("external_id"),
        "payload",
        "raw_payload_json",
        F.col("payload._cleaned_text").alias("cleaned_text"),
        F.col("payload._json_ld").alias("json_ld"),
        "fetched_at",
    )


def _with_payload(items: DataFrame, text: str, name: str) -> DataFrame:
    """Add the payload of JSON objects. Payload values that are JSON lists or objects stay JSON text in their column."""
    parsed = items.withColumn(name, F.from_json(text, R.PAYLOAD_SCHEMA))
    # An explicit null is a value of its own here; the schema reader cannot tell it from an absent member.
    nulled = F.col(f"{name}.is_free").isNull() & F.array_contains(F.json_object_keys(text), "is_free")
    return parsed.withColumn(name, F.col(name).withField("is_free", F.when(nulled, "null").otherwise(F.col(f"{name}.is_free"))))


ADAPTERS: dict[str, Adapter] = {"generic": generic_adapter, "static": static_adapter}


def register_adapter(platform: str, adapter: Adapter) -> None:
    """Add a page reader: pages (with source columns) in, ``RAW_COLUMNS`` out."""
    ADAPTERS[platform] = adapter


def adapter_name(platform: Column) -> Column:
    """Name of the adapter that reads a platform; unknown platforms use the generic one."""
    return F.when(platform.isin(*ADAPTERS), platform).otherwise("generic")


def adapters_in_use(sources: DataFrame) -> list[str]:
    """At most one name per registered adapter."""
    return [r[0] for r in sources.select(adapter_name(F.col("platform"))).distinct().collect()]


def raw_events_of(pages: DataFrame, names: list[str] | None = None, packed: bool = False) -> DataFrame:
    """Read each page with the adapter of its ``platform``.

    ``names`` lists the adapters in use: every adapter reads the pages once, so one that no source
    needs costs nothing. ``packed`` rows are to be moved: they leave out what ``unpacked`` reads from their JSON again.
    """
    parts = []
    for name in names or list(ADAPTERS):
        part = ADAPTERS[name](pages.filter(adapter_name(F.col("platform")) == name)).select(*RAW_COLUMNS)
        again = ADAPTERS[name] is static_adapter
        if packed and again:
            part = part.withColumns({c: F.lit(None).cast(part.schema[c].dataType) for c in _READ_AGAIN})
        parts.append(part.withColumn("_again", F.lit(again)) if packed else part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# What a static item's columns take from its payload, each with the member it comes from.
_READ_AGAIN = {"payload": None, "cleaned_text": "_cleaned_text", "json_ld": "_json_ld"}


def unpacked(raw: DataFrame) -> DataFrame:
    """``packed`` rows with all ``RAW_COLUMNS``."""
    read = _with_payload(raw.withColumn("_text", F.when(F.col("_again"), F.col("raw_payload_json"))), "_text", "_payload")
    found = {c: F.col("_payload") if member is None else F.col("_payload")[member] for c, member in _READ_AGAIN.items()}
    return read.withColumns({c: F.when(F.col("_again"), v).otherwise(F.col(c)) for c, v in found.items()}).drop("_again", "_text", "_payload")


# --- Change detection -----------------------------------------------------------------------
def fingerprints(pages: DataFrame) -> DataFrame:
    """(source_id, url, fetched_at, url_hash, page_hash): all that change detection needs."""
    return pages.select(*print_columns())


def print_columns() -> list[Column]:
    return [
        F.col("source_id"),
        F.col("url"),
        F.col("fetched_at"),
        T.content_hash(F.col("url")).alias("url_hash"),
        T.content_hash(F.col("html_or_json")).alias("page_hash"),
    ]


def fetch_error(pages: DataFrame) -> Column:
    """Why the fetch of a page failed; null when it did not."""
    given = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    status = F.when(F.col("status_code") >= 400, F.concat(F.lit("status "), F.col("status_code").cast("string"))) if "status_code" in pages.columns else F.lit(None)
    return F.coalesce(F.when(F.trim(given) != "", given), status, F.when(F.col("html_or_json").isNull(), "no body"))


def with_errors(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Fingerprints of all pages with two more columns: why the fetch failed, and why the page could not be read. One pass over the bodies.

    A fetch failed when ``pages`` has an ``error`` text for it (optional column), a status of 400 and more, or no body. A page of a static source cannot
    be read when it is no JSON; a page of an unknown source or platform is read by the generic adapter, which reads any text.
    """
    kinds = broadcast_if_small(sources.groupBy(F.col("id").alias("source_id")).agg(F.min(adapter_name(F.col("platform"))).alias("_adapter")))
    fetch = fetch_error(pages)
    body = F.col("html_or_json")
    unread = F.when((F.col("_adapter") == "static") & F.try_parse_json(body).isNull(), "page is no JSON")
    hashed = pages.join(kinds, "source_id", "left").withColumns({"fetch_error": fetch, "read_error": F.when(fetch.isNull(), unread)})
    return hashed.select(*print_columns(), "fetch_error", "read_error")


def latest_snapshots(snapshots: DataFrame, version: str = C.SNAPSHOT_VERSION) -> DataFrame:
    """Last stored hash per source and URL. A new version finds none, so every page is read once."""
    return (
        snapshots.filter(F.col("schema_version") == version)
        .groupBy("source_id", "url_hash")
        .agg(F.max_by("page_hash", "stored_at").alias("stored_hash"))
    )


def judged_prints(
    prints: DataFrame, snapshots: DataFrame, sources: DataFrame, version: str = C.SNAPSHOT_VERSION, once: bool = False, written: bool = False
) -> DataFrame:
    """Fingerprints with ``changed``: whether the content differs from the one before.

    Bodies are not shuffled: only hashes are compared, in half the bytes of their text, and the hash of a URL is made again from it. The one before is the previous fetch of the
    same URL in this batch, else the stored snapshot; ``once`` says that a batch holds every URL at
    most once and saves the ordering step, ``written`` that prints come from files. Sources with ``always_refresh`` pass in any case.
    """
    always = sources.select(
        F.col("id").alias("source_id"),
        (F.get_json_object("config_json", "$.always_refresh") == "true").alias("always"),
    )
    if once:
        ordered = prints.withColumn("_prev", F.lit(None).cast("string"))
    else:
        packed = prints.withColumn("page_hash", F.unhex("page_hash")).drop("url_hash")
        ordered = add_previous(packed, ["source_id", "url"], ["fetched_at", "page_hash"], "page_hash", "_prev", written)
        ordered = ordered.withColumns({c: F.lower(F.hex(c)) for c in ("page_hash", "_prev")}).withColumn("url_hash", T.content_hash(F.col("url")))
    joined = ordered.join(latest_snapshots(snapshots, version), ["source_id", "url_hash"], "left").join(
        always, "source_id", "left"
    )
    before = F.coalesce("_prev", "stored_hash")
    keep = F.coalesce("always", F.lit(False)) | before.isNull() | (before != F.col("page_hash"))
    return joined.select(*prints.columns, F.coalesce(keep, F.lit(False)).alias("changed"))


def changed_prints(
    prints: DataFrame, snapshots: DataFrame, sources: DataFrame, version: str = C.SNAPSHOT_VERSION, once: bool = False
) -> DataFrame:
    """Fingerprints of pages whose content differs from the one before."""
    return judged_prints(prints, snapshots, sources, version, once).filter("changed").drop("changed")


PAGE_KEY = ("source_id", "url", "fetched_at")


def changed_pages(pages: DataFrame, judged: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pages to read, and the keys to read only, where pages could not be chosen yet.

    A page is read when its key is one of a changed page. That is nearly the same as not being lost: the keys where it is not, of unchanged pages and of
    pages lost and changed under one key, are broadcast when there are few, as on a first run, and the changed keys need not be joined.
    """
    flags = judged.select(*PAGE_KEY, "changed", F.lit(False).alias("lost")).unionByName(lost.select(*PAGE_KEY, F.lit(False).alias("changed"), F.lit(True).alias("lost")))
    known = [F.col(c).isNotNull() for c in PAGE_KEY]
    per_key = flags.filter(known[0] & known[1] & known[2]).groupBy(*PAGE_KEY).agg(F.max("changed").alias("_changed"), F.max("lost").alias("_lost"), F.min("lost").alias("_gone"))
    per_key = cut(per_key)
    other = per_key.filter("(_changed AND _lost) OR NOT (_changed OR _gone)").select(*PAGE_KEY, "_changed")
    if not is_small(other):
        return pages, per_key.filter("_changed").select(*PAGE_KEY)
    chosen = pages.filter(known[0] & known[1] & known[2]).join(F.broadcast(other), list(PAGE_KEY), "left")
    return chosen.filter(F.coalesce("_changed", fetch_error(pages).isNull())).select(*pages.columns), None


def snapshot_rows(prints: DataFrame, version: str = C.SNAPSHOT_VERSION) -> DataFrame:
    """Snapshot rows to append for changed pages (hash only; the body stays in the page table)."""
    return prints.select(
        "source_id",
        "url_hash",
        F.lit(version).alias("schema_version"),
        "page_hash",
        F.lit(None).cast("string").alias("body"),
        F.col("fetched_at").alias("stored_at"),
    )


def with_bodies(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Put page bodies into snapshot rows, for stores that keep content as well."""
    bodies = pages.select(
        "source_id", T.content_hash(F.col("url")).alias("url_hash"), F.col("fetched_at").alias("stored_at"),
        T.content_hash(F.col("html_or_json")).alias("page_hash"), F.col("html_or_json").alias("_body"),
    )
    keys = ["source_id", "url_hash", "page_hash", "stored_at"]
    return rows.join(bodies, keys, "left").withColumn("body", F.col("_body")).select(*rows.columns)
