"""Packaging: HTML pages from rows, inlined images, size reports, self-describing sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

# Media types of image endings.
MEDIA = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".avif": "image/avif", ".svg": "image/svg+xml"}


def packages(rows: DataFrame, package: str, order: str, text: str, language: str = "en") -> DataFrame:
    """(package, html): sections in order, and a manifest block with their digests."""
    lines = F.transform(F.split(text, "\n"), lambda p: F.concat(F.lit("<p>"), T.escape_html(p), F.lit("</p>")))
    section = F.concat(F.lit('<section data-id="'), F.col(order).cast("string"), F.lit('">'), F.array_join(lines, ""), F.lit("</section>"))
    manifest = F.struct(F.col(order).cast("string").alias("id"), T.sha256_base64(F.col(text)).alias("sha256"))
    per = rows.select(F.col(package), F.col(order), section.alias("s"), manifest.alias("m")).groupBy(package).agg(F.sort_array(F.collect_list(F.struct(order, "s", "m"))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["s"]), "\n")
    listed = T.escape_json(F.to_json(F.transform("x", lambda x: x["m"])))
    title = T.escape_html(F.col(package).cast("string"))
    page = F.concat(
        F.lit(f'<!DOCTYPE html>\n<html lang="{language}">\n<head>\n<meta charset="utf-8">\n<title>'), title, F.lit('</title>\n</head>\n<body>\n<main id="content">\n'), body,
        F.lit('\n</main>\n<script type="application/manifest+json" id="manifest">'), listed, F.lit("</script>\n</body>\n</html>\n"),
    )
    return per.select(package, page.alias("html"))


def data_block(kind: str, name: str, text, attributes: dict | None = None):
    """A data block as an HTML element."""
    more = "".join(f' {k}="{v}"' for k, v in (attributes or {}).items())
    return F.concat(F.lit(f'<script type="{kind}" id="{name}"{more}>'), text, F.lit("</script>"))


def size_report(sizes: DataFrame) -> DataFrame:
    """(part, bytes, share in percent)."""
    return sizes.withColumn("share", F.round(F.col("bytes") * 100.0 / F.sum("bytes").over(Window.partitionBy()), 3))


def inline_images(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """``wanted`` (..., src) with ``data``, a data URL of the file (stem, content), or a ``warning``."""
    ending = F.lower(F.regexp_extract("src", r"(\.[A-Za-z0-9]+)$", 1))
    media = F.try_element_at(F.create_map(*[F.lit(x) for p in MEDIA.items() for x in p]), ending)
    joined = wanted.withColumn("_stem", F.regexp_replace("src", r"\.[A-Za-z0-9]+$", "")).withColumn("_media", media).join(files, F.col("_stem") == F.col("stem"), "left")
    good = F.col("_media").isNotNull() & F.col("content").isNotNull()
    data = F.when(good, F.concat(F.lit("data:"), F.col("_media"), F.lit(";base64,"), T.base64(F.col("content"))))
    warning = F.when(~good, F.concat(F.lit("image not found or unsupported: "), F.col("src")))
    return joined.select(*wanted.columns, data.alias("data"), warning.alias("warning"))


def settle_size(render: Callable[[int, str], str], rounds: int = 5) -> tuple[str, int]:
    """A page that states its own size: ``render(total, padding)`` is repeated until the number is true, then padded."""
    size = lambda s: len(s.encode())
    total = 0
    page = render(total, "")
    for _ in range(rounds):
        if size(page) == total:
            break
        total = size(page)
        page = render(total, "")
    if size(page) > total:
        total = size(page) + 1
        page = render(total, "")
    if size(page) < total:
        page = render(total, " " * (total - size(page)))
    return page, total
