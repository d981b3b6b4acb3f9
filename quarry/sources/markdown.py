"""Markdown scan: front matter and blocks of Markdown files.

A small block parser: ATX headings with ``{#id}``, paragraphs, lists, quotes, fences, tables and raw HTML blocks. Not
CommonMark: no setext headings, reference links, nested lists or inline parsing beyond stripping of common marks.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import html as H

FRONT = re.compile(r"\A---\r?\n([\s\S]*?)\r?\n---\r?\n")
HEADING = re.compile(r"^(#{1,6})\s+(.*?)(?:\s+#+)?\s*$")
ITEM = re.compile(r"^\s{0,3}(?:[-*+]|\d{1,9}[.)])\s+(.*)$")
FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
RULE = re.compile(r"^\s{0,3}([-*_])(?:\s*\1){2,}\s*$")
ID = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$")
EXPLICIT = re.compile(r"\s*\{#([^}]*)\}\s*$")
BLOCK_SCHEMA = "struct<meta:map<string,string>,blocks:array<struct<tag:string,level:int,id:string,text:string>>>"


def front_matter(source: str) -> tuple[dict[str, str], str]:
    """(``key: value`` pairs, rest of the text)."""
    m = FRONT.match(source)
    if not m:
        return {}, source
    pairs = (line.partition(":") for line in m[1].splitlines() if ":" in line and not line.startswith((" ", "#")))
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}, source[m.end() :]


def inline(text: str) -> str:
    """Text without images, link targets, emphasis marks and code ticks."""
    text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", "", text)
    text = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"(\*\*|__)(.+?)\1", r"\2", text)
    text = re.sub(r"(?<![\w*])[*_](\S.*?)[*_](?![\w*])", r"\1", text)
    text = re.sub(r"`([^`]*)`", r"\1", text)
    if "<" in text:
        text = H.text_of(H.parse(text))
    return " ".join(text.split())


def figure_text(html: str) -> str:
    """Caption of a figure, else its images' alternative texts and its drawings' titles."""
    tree = H.parse(html)
    caption = " ".join(H.text_of(c) for c in H.find(tree, "figcaption"))
    if caption.strip():
        return " ".join(caption.split())
    alts = [dict(i.attributes).get("alt", "") for i in H.find(tree, "img")]
    titles = ["".join(x for x in t.children if isinstance(x, str)) for t in H.find(tree, "title")]
    return " ".join(" ".join(alts + titles).split())


def parse(source: str) -> tuple[dict[str, str], list[tuple[str, int | None, str | None, str]]]:
    """(front matter, blocks (tag, level, id, text)); ValueError on an invalid explicit id."""
    meta, body = front_matter(source)
    out: list[tuple[str, int | None, str | None, str]] = []
    lines = body.splitlines()
    k = 0

    def take(until) -> list[str]:
        nonlocal k
        start = k
        while k < len(lines) and not until(lines[k]):
            k += 1
        return lines[start:k]

    while k < len(lines):
        line = lines[k]
        if not line.strip() or RULE.match(line):
            k += 1
        elif m := FENCE.match(line):
            k += 1
            mark = m[1]
            code = take(lambda x, mark=mark: x.strip().startswith(mark[0] * len(mark)))
            k += 1
            out.append(("pre", None, None, " ".join("\n".join(code).split())))
        elif m := HEADING.match(line):
            k += 1
            title, own = m[2], None
            if e := EXPLICIT.search(title):
                own, title = e[1], title[: e.start()]
                if not ID.match(own):
                    raise ValueError(f"invalid section id {{#{own}}}")
            out.append((f"h{len(m[1])}", len(m[1]), own, inline(title)))
        elif line.lstrip().startswith("<"):
            raw = "\n".join(take(lambda x: not x.strip()))
            tag = re.match(r"\s*<([a-zA-Z0-9]+)", raw)
            if tag and tag[1].lower() == "figure":
                out.append(("figure", None, None, figure_text(raw)))
            else:
                out.append(("p", None, None, " ".join(H.text_of(H.parse(raw)).split())))
        elif line.lstrip().startswith(">"):
            quote = take(lambda x: not x.lstrip().startswith(">"))
            out.append(("blockquote", None, None, inline(" ".join(q.lstrip()[1:] for q in quote))))
        elif "|" in line and k + 1 < len(lines) and re.match(r"^\s*\|?[\s:|-]+\|[\s:|-]*$", lines[k + 1]):
            rows = take(lambda x: "|" not in x)
            for r in [rows[0], *rows[2:]]:
                out.append(("tr", None, None, inline(" ".join(r.strip().strip("|").split("|")))))
        elif ITEM.match(line):
            item: list[str] = []
            while k < len(lines) and lines[k].strip():
                if m := ITEM.match(lines[k]):
                    if item:
                        out.append(("li", None, None, inline(" ".join(item))))
                    item = [m[1]]
                else:
                    item.append(lines[k].strip())
                k += 1
            out.append(("li", None, None, inline(" ".join(item))))
        else:
            para = take(lambda x: not x.strip() or HEADING.match(x) or FENCE.match(x))
            out.append(("p", None, None, inline(" ".join(para))))
    return meta, [b for b in out if b[3]]


def scan(files: DataFrame, key: str, text: str = "value") -> DataFrame:
    """(key, meta, pos, tag, level, id, text) of whole Markdown texts."""

    @F.pandas_udf("meta map<string,string>, blocks array<struct<tag:string,level:int,id:string,text:string>>")
    def run(sources: pd.Series) -> pd.DataFrame:
        parsed = [parse(s or "") for s in sources]
        return pd.DataFrame({"meta": [m for m, _ in parsed], "blocks": [[dict(zip(("tag", "level", "id", "text"), b, strict=True)) for b in bs] for _, bs in parsed]})

    d = files.select(F.col(key), run(F.col(text)).alias("d"))
    return d.select(key, F.col("d.meta").alias("meta"), F.posexplode("d.blocks").alias("pos", "b")).select(key, "meta", "pos", "b.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole files."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path")).select("path", "value")
