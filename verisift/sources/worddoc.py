"""Markdown to blocks, blocks to right-to-left Word documents, and worksheets."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Twentieths of a point: A4 and its margins.
PAGE, MARGIN = (11906, 16838), 1418


def _kind(line: Column) -> Column:
    """Kind of a trimmed line: h1 to h4, num, bul, quote, row, rule, blank, or p."""
    heading = F.concat(F.lit("h"), F.length(F.regexp_extract(line, r"^(#{1,4})\s", 1)).cast("string"))
    row = line.startswith("|") & line.endswith("|")
    separator = line.rlike(r"^\|+(\s*(:?-{2,}:?)?\s*\|)*\s*(:?-{2,}:?)?\s*\|*$")
    return (
        F.when(line == "", "blank").when(line.isin("---", "***", "___"), "rule").when(line.rlike(r"^#{1,4}\s+"), heading)
        .when(line.rlike(r"^[0-9]+[.)]\s+"), "num").when(line.rlike(r"^[-*•]\s+"), "bul").when(line.startswith(">"), "quote")
        .when(row & separator, "separator").when(row, "row").otherwise("p")
    )


def _said(kind: Column, line: Column) -> Column:
    cells = F.filter(F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    return (
        F.when(kind.startswith("h"), F.regexp_replace(line, r"^#{1,4}\s+", "")).when(kind == "num", F.regexp_replace(line, r"^([0-9]+)[.)]\s+", "$1. "))
        .when(kind == "bul", F.regexp_replace(line, r"^[-*•]\s+", "")).when(kind == "quote", F.regexp_replace(line, "^[> ]+", ""))
        .when(kind == "row", F.array_join(cells, " — ")).when(kind == "rule", "").otherwise(line)
    )


def markdown_blocks(text) -> Column:
    """array<struct<kind, text>>: lines of a paragraph are joined, separators of tables and empty lines drop out."""
    line = F.transform(F.split(col(text), r"\r\n|[\n\r\f\u000b\u0085\u2028\u2029]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kinds = F.transform(line, lambda x: F.struct(_kind(x).alias("kind"), x.alias("text")))
    none = F.array().cast("array<struct<kind:string,text:string>>")

    def add(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        more = F.struct(F.lit("p").alias("kind"), F.concat(last["text"], F.lit(" "), x["text"]).alias("text"))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(more))
        one = F.array(F.struct(x["kind"].alias("kind"), _said(x["kind"], x["text"]).alias("text")))
        return F.when((x["kind"] == "p") & (F.size(acc) > 0) & (last["kind"] == "p"), joined).otherwise(F.concat(acc, one))

    return F.filter(F.aggregate(kinds, none, add), lambda b: ~b["kind"].isin("blank", "separator"))


def block_rows(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return docs.select(*keys, F.posexplode(markdown_blocks(text)).alias("position", "b")).select(*keys, "position", "b.kind", "b.text")


def _esc(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _runs(text: str, bold: bool, points: int, color: str = "") -> str:
    out = []
    for i, part in enumerate(re.split(r"\*\*(.+?)\*\*", text)):
        if part:
            strong = "<w:b/><w:bCs/>" if bold or i % 2 else ""
            tint = f'<w:color w:val="{color}"/>' if color else ""
            out.append(f'<w:r><w:rPr>{strong}{tint}<w:sz w:val="{2 * points}"/><w:szCs w:val="{2 * points}"/><w:rtl/></w:rPr><w:t xml:space="preserve">{_esc(part)}</w:t></w:r>')
    return "".join(out)


def _paragraph(runs: str, align: str = "both", indent: int = 0, before: int = 0, keep: bool = False, border: bool = False) -> str:
    """Properties in the order that the schema wants: keepNext, pBdr, bidi, spacing, ind, jc."""
    parts = ["<w:keepNext/>" if keep else "", '<w:pBdr><w:bottom w:val="single" w:sz="6" w:space="4" w:color="808080"/></w:pBdr>' if border else "", "<w:bidi/>"]
    parts += [f'<w:spacing w:before="{before}" w:after="120"/>', f'<w:ind w:start="{indent}"/>' if indent else "", f'<w:jc w:val="{align}"/>']
    return f"<w:p><w:pPr>{''.join(parts)}</w:pPr>{runs}</w:p>"


def docx(blocks: list, title: str, notice: str | None = None, author: str = "") -> bytes:
    """A Word package: every paragraph and run is right-to-left, numbers are written out, a draft carries a banner."""
    body = [_paragraph(_runs(notice, True, 14, "B00000"), "center", border=True)] if notice else []
    for b in blocks:
        kind, text = b["kind"], b["text"]
        if kind == "h1":
            body.append(_paragraph(_runs(text, True, 18), "center", before=240, keep=True))
        elif kind.startswith("h"):
            body.append(_paragraph(_runs(text, True, 16 if kind == "h2" else 15), "start", before=200, keep=True))
        elif kind == "rule":
            body.append(_paragraph("", border=True))
        else:
            body.append(_paragraph(_runs(f"• {text}" if kind == "bul" else text, False, 14), indent={"num": 340, "bul": 340, "quote": 567, "row": 170}.get(kind, 0)))
    edges = " ".join(f'w:{side}="{MARGIN}"' for side in ("top", "right", "bottom", "left"))
    section = f'<w:sectPr><w:pgSz w:w="{PAGE[0]}" w:h="{PAGE[1]}"/><w:pgMar {edges} w:header="709" w:footer="709" w:gutter="0"/><w:bidi/></w:sectPr>'
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    kinds = {"word/document.xml": "document.main", "word/styles.xml": "styles", "word/settings.xml": "settings"}
    overrides = "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{k}+xml"/>' for p, k in kinds.items())
    relations = lambda pairs: f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{t}" Target="{x}"/>' for i, (t, x) in enumerate(pairs, 1)) + "</Relationships>"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{overrides}<Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>',
        "_rels/.rels": relations([(f"{_OFFICE}/officeDocument", "word/document.xml"), (f"{_PACKAGE}/relationships/metadata/core-properties", "docProps/core.xml")]),
        "docProps/core.xml": f'<cp:coreProperties xmlns:cp="{_PACKAGE}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{_esc(title)}</dc:title><dc:creator>{_esc(author)}</dc:creator></cp:coreProperties>',
        "word/_rels/document.xml.rels": relations([(f"{_OFFICE}/styles", "styles.xml"), (f"{_OFFICE}/settings", "settings.xml")]),
        "word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{"".join(body)}{section}</w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{_W}"><w:docDefaults><w:rPrDefault><w:rPr><w:lang w:bidi="ar"/></w:rPr></w:rPrDefault></w:docDefaults></w:styles>',
        "word/settings.xml": f'<w:settings xmlns:w="{_W}"><w:defaultTabStop w:val="720"/><w:themeFontLang w:val="ar" w:bidi="ar"/></w:settings>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in files.items():
            z.writestr(zipfile.ZipInfo(name), head + xml)
    return out.getvalue()


def word_documents(docs: DataFrame, id_col: str, text: str = "text", title: str = "title", notice: str | None = None) -> DataFrame:
    """id, docx (bytes) of each Markdown document."""

    def write(batches):
        for batch in batches:
            yield pd.DataFrame({id_col: batch[id_col], "docx": [docx(b, t or "", notice) for b, t in zip(batch["blocks"], batch["title"])]})

    rows = docs.select(id_col, markdown_blocks(text).alias("blocks"), F.col(title).alias("title"))
    return rows.mapInPandas(write, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, docx binary")


def releasable(docs: DataFrame, reports: DataFrame, id_col: str) -> DataFrame:
    """Documents whose gate report has passed with nothing left to adjudicate; only these may be exported as final."""
    return docs.join(reports.where("passed and not needs_adjudication").select(id_col), id_col, "left_semi")


def worksheets(items: DataFrame, id_col: str, order: str, fields: dict[str, str], answer: str = "answer") -> DataFrame:
    """A Markdown sheet for each document: a section for each item with its fields (name: column) and an open answer."""
    lines = [F.concat(F.lit(f"- **{name}:** `"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("`")) for name, c in fields.items()]
    section = F.concat_ws("\n", F.concat(F.lit("### "), F.col(order).cast("string")), *lines, F.lit(f"- **{answer}:** "))
    return items.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, section.alias("s")))), lambda x: x["s"]), "\n\n").alias("sheet"))


def read_worksheets(sheets: DataFrame, id_col: str, fields: dict[str, str], answer: str = "answer") -> DataFrame:
    """The items of filled-in sheets: id, item, the fields, answer (empty if nothing was written)."""
    parts = F.split(F.col("sheet"), "(?m)^### ")
    rows = sheets.select(id_col, F.posexplode(parts).alias("__n", "__s")).where("__n > 0")
    # Names of fields are given by the caller, as literal text.
    value = lambda name: F.regexp_extract("__s", rf"\*\*\Q{name}\E:\*\* `([^`]*)`", 1)
    return rows.select(id_col, F.regexp_extract("__s", r"^[^\n]*", 0).alias("item"), *[value(n).alias(c) for n, c in fields.items()], F.trim(F.regexp_extract("__s", rf"\*\*\Q{answer}\E:\*\*[ \t]*([^\n]*)", 1)).alias("answer"))

