"""Scan of JATS article files, one row per file, malformed ones kept apart."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from kairograph.functions.text import parse_pub_date, pmcid

_STRINGS = ("path", "parse_error", "pmid", "given_pmcid", "doi", "title", "abstract", "journal", "year", "month", "day")
_PARSED = StructType(
    [StructField(c, StringType()) for c in _STRINGS]
    + [StructField(c, ArrayType(StringType())) for c in ("authors", "keywords")]
    + [StructField("body_sections", ArrayType(StructType([StructField("ord", IntegerType()), StructField("name", StringType()), StructField("text", StringType())])))]
    + [StructField("references", ArrayType(StructType([StructField(c, StringType()) for c in ("id", "title", "authors", "journal", "year")])))]
)
_NAMES = _PARSED.names


def _text(node: ET.Element | None) -> str:
    """All text below a node, inline markup in its order, tidied."""
    if node is None:
        return ""
    flat = re.sub(r"\s+", " ", "".join(node.itertext()))
    return re.sub(r"\(\s*\)", "", re.sub(r"\[\s*\]", "", flat)).strip()


def _abstract(root: ET.Element) -> str:
    node = root.find(".//abstract")
    if node is None:
        return ""
    parts = []
    for sec in node.findall("sec"):
        name, body = _text(sec.find("title")), " ".join(x for x in map(_text, sec.findall("p")) if x)
        parts.append(f"{name}: {body}" if name else body)
    return " ".join(x for x in parts if x) or _text(node)


def _sections(root: ET.Element) -> list[dict]:
    body = root.find(".//body")
    if body is None:
        return []
    found: dict[str, str] = {}
    for sec in body.findall(".//sec"):
        name = _text(sec.find("title")).lower() or "unnamed"
        text = " ".join(x for x in map(_text, sec.findall("p")) if x)
        if text:
            found[name] = f"{found[name]} {text}" if name in found else text
    if not found:
        text = " ".join(x for x in map(_text, body.iter("p")) if x)
        found = {"unnamed": text} if text else {}
    return [{"ord": k, "name": n, "text": t} for k, (n, t) in enumerate(found.items(), 1)]


def _references(root: ET.Element) -> list[dict]:
    out = []
    for ref in root.findall(".//ref-list/ref"):
        names = [" ".join(x for x in (_text(n.find("surname")), _text(n.find("given-names"))) if x) for n in ref.findall(".//name")]
        out.append({"id": ref.get("id", ""), "title": _text(ref.find(".//article-title")), "authors": "; ".join(n for n in names if n), "journal": _text(ref.find(".//source")), "year": _text(ref.find(".//year"))})
    return out


def parse_article(path: str, data: bytes) -> dict:
    """The columns of one file; ``parse_error`` says why it has none."""
    row: dict = dict.fromkeys(_NAMES) | {"path": path}
    try:
        root = ET.fromstring(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    except (ET.ParseError, OSError, EOFError) as e:
        return row | {"parse_error": str(e) or type(e).__name__}
    ids = {n.get("pub-id-type"): _text(n) for n in root.findall(".//article-meta/article-id")}
    date = next((d for d in root.findall(".//article-meta/pub-date") if d.find("year") is not None), None)
    part = lambda k: _text(date.find(k)) or None if date is not None else None
    people = [" ".join(x for x in (_text(n.find("given-names")), _text(n.find("surname"))) if x) for n in root.findall(".//contrib-group/contrib/name")]
    return row | {
        "pmid": ids.get("pmid"), "given_pmcid": ids.get("pmc") or ids.get("pmcid"), "doi": ids.get("doi"), "title": _text(root.find(".//article-meta//article-title")), "abstract": _abstract(root),
        "journal": _text(root.find(".//journal-title")), "year": part("year"), "month": part("month"), "day": part("day"), "authors": [p for p in people if p],
        "keywords": [k for k in map(_text, root.findall(".//kwd-group/kwd")) if k], "body_sections": _sections(root), "references": _references(root),
    }


def scan(spark: SparkSession, directory: str, pattern: str = "*.{xml,xml.gz,nxml}", max_papers: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(papers, quarantine) of a folder of article files; with ``max_papers`` that many of the smallest paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory).select("path", "content")
    if max_papers is not None:
        files = files.orderBy("path").limit(max_papers)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([parse_article(p, bytes(c)) for p, c in zip(f["path"], f["content"])], columns=_NAMES, dtype=object)

    parsed = files.mapInPandas(run, _PARSED)
    bad = parsed.filter("parse_error is not null").select("path", "parse_error")
    good = parsed.filter("parse_error is null").withColumns({"pmcid": pmcid(F.coalesce("given_pmcid", F.lit("")), "path"), "publication_date": parse_pub_date("year", "month", "day")})
    full = F.array_join(F.transform("body_sections", lambda s: s["text"]), "\n\n").alias("full_text")
    shown = ["pmid", "pmcid", "doi", "title", "abstract", full, "journal", "publication_date", "authors", "keywords", "body_sections", "references", F.col("path").alias("source_file")]
    return good.select(*shown), bad
