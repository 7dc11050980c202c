"""Page expressions: metadata, images, JSON-LD, page kind."""
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from evcat import config as C
from evcat.functions import text as T


def _first_match(c: Column, pattern: str) -> Column:
    """First capture, or null without a match (captures here are never empty)."""
    return T.blank_to_null(F.regexp_extract(c, pattern, 1))


def _all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def meta_description(html: Column) -> Column:
    found = F.coalesce(*[_first_match(html, p) for p in C.META_DESCRIPTION])
    return F.left(T.strip_ws(found), F.lit(C.MAX_META_DESCRIPTION_CHARS))


def meta_images(html: Column) -> Column:
    """All og/twitter image addresses, grouped by tag kind in order of preference."""
    return F.transform(F.concat(*[_all_matches(html, p) for p in C.META_IMAGES]), T.strip_ws)


def first_meta_image(html: Column) -> Column:
    order = (0, 2, 1)  # og:image, twitter:image, og:image:url
    return T.strip_ws(F.coalesce(*[_first_match(html, C.META_IMAGES[i]) for i in order]))


def json_ld_blocks(html: Column) -> Column:
    """Non-empty JSON-LD script bodies in page order."""
    return F.filter(F.transform(_all_matches(html, C.JSON_LD_SCRIPT), T.strip_ws), lambda b: b != "")


def json_ld_text(html: Column) -> Column:
    joined = F.array_join(json_ld_blocks(html), "\n\n")
    return T.blank_to_null(F.left(joined, F.lit(C.MAX_JSON_LD_CHARS)))


def json_ld_has_event(json_ld: Column) -> Column:
    """A valid block, among the first six, has ``"@type": "Event"`` at any depth.

    Quotes inside JSON strings are escaped, so the pattern cannot match inside a value.
    """
    pattern = r'"@type"\s*:\s*("Event"|\[[^\]]*"Event"[^\]]*\])'
    blocks = F.filter(F.transform(F.split(json_ld, "\n\n"), T.strip_ws), lambda b: b != "")
    found = F.exists(
        F.slice(blocks, 1, C.MAX_JSON_LD_BLOCKS), lambda b: b.rlike(pattern) & F.try_parse_json(b).isNotNull()
    )
    return F.coalesce(found, F.lit(False))


def _image_values(value: object) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        address = value.get("url") or value.get("@id")
        return [address] if isinstance(address, str) else []
    if isinstance(value, list):
        return [address for item in value for address in _image_values(item)]
    return []


def _block_images(block: str) -> list[str]:
    try:
        data = json.loads(block)
    except ValueError:
        return []
    found: list[str] = []
    for node in data if isinstance(data, list) else [data]:
        if isinstance(node, dict):
            graph = node.get("@graph")
            members = [m for m in graph if isinstance(m, dict)] if isinstance(graph, list) else []
            found += [address for n in [node, *members] for address in _image_values(n.get("image"))]
    return found


@F.pandas_udf(ArrayType(StringType()))
def _images_of_blocks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for blocks in batches:
        yield blocks.map(
            lambda bs: None if bs is None else [a for b in bs for a in _block_images(b)], na_action=None
        )


def json_ld_images(html: Column) -> Column:
    """Image addresses of the first six JSON-LD blocks.

    Images nest without a fixed depth, which column expressions cannot follow; only blocks that
    mention an image are sent to the Arrow batch function, all other pages send null.
    """
    blocks = F.filter(F.slice(json_ld_blocks(html), 1, C.MAX_JSON_LD_BLOCKS), lambda b: F.contains(b, F.lit('"image"')))
    return F.coalesce(_images_of_blocks(F.when(F.size(blocks) > 0, blocks)), F.array().cast("array<string>"))


def looks_like_image(u: Column) -> Column:
    def usable(low: Column) -> Column:
        return (low != "") & ~low.startswith("data:") & ~T.any_contains(low, C.VIDEO_EXTENSIONS)

    return T.let(F.lower(u), usable)


def image_score(u: Column) -> Column:
    def points(cond: Column, n: int) -> Column:
        return F.when(cond, n).otherwise(0)

    def score(low: Column) -> Column:
        raster = F.lit(False)
        for ext in C.IMAGE_EXTENSIONS:
            raster = raster | low.endswith(ext)
        return (
            F.when(low.startswith("https://"), 5).when(low.startswith("http://"), 2).otherwise(0)
            + points(T.any_contains(low, C.IMAGE_GOOD_WORDS), 6)
            + points(T.any_contains(low, C.IMAGE_BIG_SIZES), 4)
            + points(T.any_contains(low, C.IMAGE_BAD_WORDS), -10)
            + points(raster, 2)
            + points(low.endswith(".svg"), -2)
        )

    return T.let(F.lower(u), score)


def best_of_images(candidates: Column, page_url: Column) -> Column:
    """Best-scored usable candidate; the first one wins a tie."""
    absolute = F.transform(
        F.filter(candidates, lambda u: u != ""),
        lambda u: T.strip_tracking(T.absolute_url(u, T.url_origin(page_url))),
    )
    usable = F.array_distinct(F.filter(absolute, looks_like_image))
    ranked = F.transform(usable, lambda u, i: F.struct(image_score(u).alias("s"), (-i).alias("i"), u.alias("u")))
    return F.array_max(ranked).getField("u")


def best_image(html: Column, page_url: Column) -> Column:
    return best_of_images(F.concat(json_ld_images(html), meta_images(html)), page_url)


def _json_string(value: Column) -> Column:
    """A string as JSON text; null as null."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))


def _json_object(members: dict[str, Column]) -> Column:
    """JSON object of the non-null members (JSON text each), with a blank after every colon and comma."""
    given = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}": '), v)) for k, v in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *given), F.lit("}"))


def extraction_text(page_url: Column, meta: Column, poster: Column, json_ld: Column, visible: Column) -> Column:
    """JSON metadata line (when there is any) above the visible text, cut to the extraction limit."""
    metadata = _json_object({"meta_description": _json_string(meta), "poster_url": _json_string(poster), "json_ld": _json_string(json_ld)})
    block = _json_object({"page_url": _json_string(page_url), "metadata": metadata})
    has_meta = meta.isNotNull() | poster.isNotNull() | json_ld.isNotNull()
    return F.left(F.when(has_meta, F.concat_ws("\n\n", block, visible)).otherwise(visible), F.lit(C.MAX_EXTRACTION_CHARS))


def page_kind(url: Column, json_ld: Column, cleaned: Column) -> Column:
    """``detail``, ``listing`` or ``noise``; the first rule that applies decides."""

    def decide(parts: Column) -> Column:
        host, path, depth = parts["host"], parts["path"], parts["depth"]

        def on(name: str) -> Column:
            return F.contains(host, F.lit(name))

        def has(part: str) -> Column:
            return F.contains(path, F.lit(part))

        return (
            F.when(json_ld_has_event(json_ld), "detail")
            .when(on("lu.ma") & (depth == 1) & (F.length(path) > 2), "detail")
            .when(on("gdg.community.dev") & has("/events/details/"), "detail")
            .when(on("commudle.com") & has("/events/") & has("/communities/"), "detail")
            .when(
                on("unstop.com") & (has("/hackathons/") | has("/competitions/")),
                F.when(depth >= 3, "detail").otherwise("listing"),
            )
            .when(on("meetup.com"), F.when(has("/events/"), "detail").otherwise("listing"))
            .when(on("gdg.community.dev") | on("community.cncf.io"), "listing")
            .when(on("commudle.com") & ~has("/events/"), "listing")
            .when(on("fossunited.org") & path.startswith("/c/"), F.when(depth <= 2, "listing").otherwise("detail"))
            .when(F.length(T.strip_ws(cleaned)) < 200, "noise")
            .otherwise("detail")
        )

    def place(path: Column) -> Column:
        depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
        return F.struct(T.url_authority(url).alias("host"), path.alias("path"), depth.alias("depth"))

    return T.let(T.let(T.url_path(url), place), decide)


def valid_title(title: Column) -> Column:
    def valid(t: Column) -> Column:
        return F.length(t).between(4, 600) & ~F.lower(t).isin(*C.TITLE_LABELS) & ~t.rlike(C.JUNK_TITLE)

    return F.coalesce(T.let(T.strip_ws(title), valid), F.lit(False))
