"""Registered parsers of office files, over files that are made of the tables, each with the SQL it must equal."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import documents as sources
from .catalog import query
from .queries import table

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(paragraphs: list[tuple[str | None, str]], styles: dict[str, str]) -> bytes:
    """A word file of (style id, text); styles: names by id."""
    said = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for s, t in paragraphs)
    named = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in styles.items())
    return packed({"word/document.xml": f"<w:document {_W}><w:body>{said}</w:body></w:document>", "word/styles.xml": f"<w:styles {_W}>{named}</w:styles>"})


def xlsx(sheets: list[tuple[str, list[list[str]]]]) -> bytes:
    """A workbook whose sheets lie in files in the opposite order, as relationships tell."""
    parts, n = {}, len(sheets)
    for i, (_, rows) in enumerate(sheets):
        cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in row) + "</row>" for row in rows)
        parts[f"xl/worksheets/sheet{n - i}.xml"] = f"<worksheet {_S}><sheetData>{cells}</sheetData></worksheet>"
    parts["xl/workbook.xml"] = f"<workbook {_S}><sheets>" + "".join(f'<sheet name="{escape(name)}" sheetId="{i + 1}" r:id="r{i}"/>' for i, (name, _) in enumerate(sheets)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{n - i}.xml"/>' for i in range(n)) + "</Relationships>"
    return packed(parts)


def _sections(files: DataFrame, extension: str) -> DataFrame:
    named = files.select("id", F.concat(F.col("id").cast("string"), F.lit(f".{extension}")).alias("file_name"), F.lit(None).cast("string").alias("mime_type"), "content")
    return sources.parsed(named).select("id", F.explode("sections").alias("s")).select("id", "s.position", "s.level", "s.title", "s.content")


_WORDS = r"trim(regexp_replace(coalesce(text, ''), '[\x00-\x20]+', ' ', 'g'))"


@query("docx_sections", rf"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n, {_WORDS} AS said FROM conversations)
SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS INTEGER) AS position, CAST(CASE i WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS INTEGER) AS level, 'turn ' || i AS title, said AS content FROM t WHERE said <> ''""")
def docx_sections(spark, sf_dir) -> DataFrame:
    """Conversations as word files: the first turn under a title, the second under a subtitle, others under third headings whose style has an id of its own."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x20]+", " ")).alias("said"))
    turns = c.groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "said"))), lambda x: x["said"]).alias("said"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            files = [docx([p for i, t in enumerate(said) for p in ((("Title", "Subtitle")[i] if i < 2 else "x9", f"turn {i + 1}"), (None, t))], {"x9": "heading 3", "Title": "Title"}) for said in pdf["said"]]
            yield pd.DataFrame({"id": pdf["id"], "content": files})

    return _sections(turns.mapInPandas(run, "id long, content binary"), "docx")


@query("xlsx_sections", """WITH n AS (SELECT c_nationkey AS id, c_mktsegment AS sheet, 'Sheet: ' || c_mktsegment || chr(10) || string_agg(c_name || chr(9) || c_custkey, chr(10) ORDER BY c_custkey) AS content FROM customer GROUP BY 1, 2)
SELECT CAST(id AS BIGINT) AS id, CAST(row_number() OVER (PARTITION BY id ORDER BY sheet) - 1 AS INTEGER) AS position, 1 AS level, sheet AS title, content FROM n""")
def xlsx_sections(spark, sf_dir) -> DataFrame:
    """Customers as workbooks: a file a nation, a sheet a market segment."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("id"), F.col("c_mktsegment").alias("sheet"), "c_custkey", "c_name")
    rows = c.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sheet", "c_custkey", "c_name"))).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            files = []
            for own in pdf["rows"]:
                sheets: dict[str, list] = {}
                for r in own:
                    sheets.setdefault(r["sheet"], []).append([r["c_name"], " ", str(r["c_custkey"])])
                files.append(xlsx(list(sheets.items())))
            yield pd.DataFrame({"id": pdf["id"], "content": files})

    return _sections(rows.mapInPandas(run, "id long, content binary"), "xlsx")
