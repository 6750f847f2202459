"""Document folders, sitemaps and event lines in; CSV and replaced partitions out."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoints

#: Extensions that are read, and event kinds that are taken.
PLAIN = ("txt", "md", "markdown")
EMPTY = ("pptx", "ppt")
EVENT_TYPES = ["signup", "purchase", "error", "view", "click"]


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def docx_text(content: bytes) -> str:
    """The text of every paragraph, joined by blanks."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter() if _name(t.tag) == "t") for p in root.iter() if _name(p.tag) == "p")
    return " ".join(filter(None, paragraphs))


def xlsx_text(content: bytes) -> str:
    """``Sheet: name`` and the rows of every sheet, cells joined by tabs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter() if _name(t.tag) == "t") for item in root if _name(item.tag) == "si"]
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        lines = []
        for sheet in (s for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _name(s.tag) == "sheet"):
            lines.append(f"Sheet: {sheet.get('name')}")
            target = next(links[v] for k, v in sheet.attrib.items() if _name(k) == "id").lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for row in (r for r in root.iter() if _name(r.tag) == "row"):
                cells = []
                for cell in row:
                    value = "".join(t.text or "" for t in cell.iter() if _name(t.tag) in ("v", "t"))
                    cells.append(shared[int(value)] if cell.get("t") == "s" and value else value)
                lines.append("\t".join(cells))
    return "\n".join(lines)


READERS = {"docx": docx_text, "xlsx": xlsx_text} | {e: lambda x: x.decode("utf-8", "replace") for e in PLAIN} | {e: lambda x: "" for e in EMPTY}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, extension, text, error) of every file below ``path``.

    A file of another kind, or one that can't be read, has a null text and
    says why; one bad file doesn't end the job.
    """

    @F.pandas_udf("text string, error string")
    def extract(extensions: pd.Series, contents: pd.Series) -> pd.DataFrame:
        def one(extension: str, content: bytes) -> tuple[str | None, str | None]:
            if extension not in READERS:
                return None, f"unsupported extension {extension!r}"
            try:
                return READERS[extension](content), None
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration, IndexError, ValueError) as e:
                return None, f"unreadable {extension}: {type(e).__name__}"

        return pd.DataFrame([one(*x) for x in zip(extensions, contents, strict=True)], columns=["text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", extension.alias("extension"), extract(extension, "content").alias("x")).select("path", "extension", "x.text", "x.error")


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc) of every ``url`` element."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path).select(F.trim("loc").alias("loc")).filter("loc <> ''")


def parse_events(lines: DataFrame, col: str = "value") -> DataFrame:
    """Events of JSON lines, of a stream or a table; unknown kinds and broken lines are left out."""
    e = F.from_json(col, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").alias("e")
    rows = lines.select(e).select("e.*").filter(F.col("event_type").isin(EVENT_TYPES))
    return rows.withColumn("had_error", F.col("event_type") == "error")


def write_csv(rows: DataFrame, path: str, cut: dict[str, int] | None = None) -> None:
    """CSV with a header, all values quoted and quotes doubled; ``cut`` shortens columns."""
    for name, most in (cut or {}).items():
        rows = rows.withColumn(name, F.substring(name, 1, most))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').mode("overwrite").csv(path)


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Write ``rows`` by partition; partitions that are not in them stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def pack_key(document: Column, index: Column) -> Column:
    return document * 100_000 + index


def user_pattern(pattern: str | None) -> str | None:
    """A Java pattern: /…/ with flags is kept, a bare one ignores case, a blank one is none."""
    if not pattern or not pattern.strip():
        return None
    found = re.fullmatch(r"([/#~])(.*)\1([imsu]*)", pattern.strip(), re.S)
    if not found:
        return f"(?i){pattern.strip()}"
    flags = "".join(sorted(set(found[3]) & set("ims")))
    return f"(?{flags}){found[2]}" if flags else found[2]


def write_feedback_csv(rows: DataFrame, path: str) -> None:
    """Ratings as CSV; answers are cut to 200 characters."""
    write_csv(rows, path, {"answer": 200})


def write_submissions_csv(rows: DataFrame, path: str, fields: list[str], data: str = "data") -> None:
    """Form submissions as CSV: their own columns, then a column for each field of their JSON data, empty where it is missing."""
    others = [c for c in rows.columns if c != data]
    values = F.from_json(data, "map<string,string>")
    write_csv(rows.select(*others, *(F.coalesce(F.element_at(values, f), F.lit("")).alias(f) for f in fields)), path)


def write_markdown(chunks: DataFrame, path: str, doc: str = "doc_id", index: str = "chunk_index", text: str = "content") -> None:
    """One text a document, its chunks in order with blank lines between, in files below ``doc=…``."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    chunks.groupBy(doc).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("value")).write.mode("overwrite").partitionBy(doc).text(path)


def upsert_vectors(rows: DataFrame, path: str, tenant: str = "tenant_id", doc: str = "doc_id", index: str = "chunk_index") -> None:
    """Vectors under their packed ids; the tenants in ``rows`` are replaced by old rows of other documents and these."""
    new = rows.withColumn("id", pack_key(F.col(doc), F.col(index)))
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):  # a table that can't be read is an error
        replace_partitions(new, path, tenant)
        return
    old = spark.read.parquet(path)
    kept = old.join(new.select(tenant, doc).distinct(), [tenant, doc], "left_anti").join(new.select(tenant).distinct(), tenant, "left_semi")
    ensure_checkpoints(spark)
    replace_partitions(kept.unionByName(new).checkpoint(), path, tenant)  # read before it is overwritten
