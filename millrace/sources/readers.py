"""Readers: delimited text, JSON, documents, directories, rules."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.text import loader_clean

NOTHING = ["", "NA", "N/A", "null", "Null", "NULL"]
MOST_BYTES = 64 << 20


def sniff(spark: SparkSession, path: str, lines: int = 200) -> tuple[str, str]:
    """(delimiter, encoding) of a file, told from its first lines."""
    for encoding in ("utf-8", "iso-8859-1"):
        rows = [r.value for r in spark.read.option("encoding", encoding).text(path).limit(lines).collect()]
        if encoding == "utf-8" and any("�" in (r or "") for r in rows):
            continue
        sample = "\n".join(rows)
        try:
            return csv.Sniffer().sniff(sample, ",;\t|").delimiter, encoding
        except csv.Error:
            return max(",;\t|", key=sample.count), encoding
    return ",", "iso-8859-1"


def clean_header(name: str) -> str:
    return name.replace(chr(0xFEFF), "").replace(chr(0xA0), " ").strip()


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", clean_header(name).lower()).strip("_")


def parse_dates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns as timestamps; what can't be read is null."""
    return df.withColumns({c: F.try_to_timestamp(F.col(f"`{c}`").cast("string")) for c in cols if c in df.columns})


def load_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, dates: Sequence[str] = (), limit: int | None = None, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """A delimited file: delimiter and encoding as told or sniffed, missing tokens null, headers trimmed, dates parsed.

    With a ``schema`` one pass is enough; without, Spark reads twice to infer
    the types.
    """
    if delimiter is None or encoding is None:
        found = sniff(spark, path)
        delimiter, encoding = delimiter or found[0], encoding or found[1]
    reader = spark.read.option("sep", delimiter).option("encoding", encoding).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    if schema is not None:
        df = reader.schema(schema).option("enforceSchema", False).option("nullValue", "NA").csv(path)
    else:
        texts = reader.csv(path)
        df = texts.toDF(*(clean_header(c) for c in texts.columns))
        df = df.select(*(F.when(F.trim(f"`{c}`").isin(NOTHING), None).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns))
        df = infer_types(df, skip=dates)
    df = parse_dates(df, dates)
    return df.limit(limit) if limit is not None else df


def infer_types(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """String columns as longs or doubles where every value can be one; told by one aggregation."""
    cols = [c for c in df.columns if c not in skip]
    if not cols:
        return df
    checks = [F.struct(F.count(f"`{c}`").alias("n"), F.count(F.col(f"`{c}`").try_cast("long")).alias("l"), F.count(F.col(f"`{c}`").try_cast("double")).alias("d")).alias(f"c{k}") for k, c in enumerate(cols)]
    facts = df.agg(*checks).first()
    out = {}
    for k, c in enumerate(cols):
        f = facts[f"c{k}"]
        if f["n"] and f["l"] == f["n"]:
            out[c] = F.col(f"`{c}`").try_cast("long")
        elif f["n"] and f["d"] == f["n"]:
            out[c] = F.col(f"`{c}`").try_cast("double")
    return df.withColumns(out) if out else df


def load_tabular(spark: SparkSession, path: str, most: int = 100_000) -> DataFrame:
    """csv, tsv or xlsx by its extension, headers in snake case, column ``date`` parsed, ``most`` rows."""
    if path.lower().endswith((".xlsx", ".xls")):
        df = load_xlsx(spark, path)
    else:
        df = load_csv(spark, path, delimiter="\t" if path.lower().endswith(".tsv") else None)
    df = df.toDF(*(snake(c) for c in df.columns))
    return parse_dates(df, ["date"]).limit(most)


def load_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema).option("mode", "FAILFAST") if schema else reader).json(path)


def load_jsonl(spark: SparkSession, path: str, schema: str, comment: str | None = None, lenient: bool = False) -> DataFrame:
    """An object a line by a DDL schema; blank lines and comments are skipped.

    Broken lines raise, or are left out if ``lenient``.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    if comment:
        lines = lines.where(~F.ltrim("value").startswith(comment))
    if not lenient:
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    read = lines.select(F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return read.where("_corrupt_record is null").drop("_corrupt_record")


def scan(spark: SparkSession, path: str, suffixes: Sequence[str] = (), most: int = MOST_BYTES) -> DataFrame:
    """(path, modificationTime, length, content) of the files below a folder, without those that are too large."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffixes:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
    return reader.load(path).where(F.col("length") <= most)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs and, as tab-separated lines, tables of a word-processing document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def words(node: ET.Element) -> str:
        return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in node.iter())

    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            out.append(words(node))
        elif node.tag == f"{_W}tbl":
            out += ["\t".join(" ".join(words(p) for p in cell.iter(f"{_W}p")) for cell in row.iter(f"{_W}tc")) for row in node.iter(f"{_W}tr")]
    return "\n".join(out)


def xlsx_rows(data: bytes, sheet: int | str = 0) -> list[list[str | None]]:
    """Cells of one sheet as strings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        if isinstance(sheet, str):
            listed = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
            sheet = listed.index(sheet)
        root = ET.fromstring(z.read(sheets[sheet]))
    rows: list[list[str | None]] = []
    for row in root.iter(f"{_S}row"):
        cells: list[str | None] = []
        for c in row.findall(f"{_S}c"):
            at = 0
            for ch in re.sub(r"[^A-Z]", "", c.get("r", "")):
                at = at * 26 + ord(ch) - 64
            value = c.findtext(f"{_S}v")
            if c.get("t") == "s" and value is not None:
                value = shared[int(value)]
            elif c.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
            cells += [None] * max(0, (at or len(cells) + 1) - 1 - len(cells)) + [value]
        rows.append(cells)
    return rows


def pdf_text(data: bytes) -> str:
    """Text of a PDF by the library that is installed; without one, an error that says so."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the package pypdf") from e
    return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def ocr_text(data: bytes, lang: str = "eng") -> str:
    """Text of an image, empty without an OCR engine."""
    try:
        import pytesseract
        from PIL import Image
    except ImportError:
        return ""
    return re.sub(r"\n{3,}", "\n\n", pytesseract.image_to_string(Image.open(io.BytesIO(data)), lang=lang, config="--psm 6")).strip()


def _plain(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _joined(data: bytes, delimiter: str, most: int = 500) -> str:
    return "\n".join(" | ".join(row) for _, row in zip(range(most), csv.reader(io.StringIO(_plain(data)), delimiter=delimiter)))


def _json_lines(data: bytes) -> str:
    import json

    out = []
    for line in _plain(data).splitlines():
        try:
            value = json.loads(line)
        except ValueError:
            continue
        if isinstance(value, dict):
            out.append(str(value.get("text") or value.get("content") or value.get("body") or ""))
    return "\n".join(x for x in out if x)


LOADERS = {
    ".txt": _plain,
    ".md": _plain,
    ".html": _plain,
    ".json": _plain,
    ".csv": lambda d: _joined(d, ","),
    ".tsv": lambda d: _joined(d, "\t"),
    ".jsonl": _json_lines,
    ".docx": docx_text,
    ".xlsx": lambda d: "\n".join(" | ".join(c or "" for c in row) for row in xlsx_rows(d)[:300]),
    ".pdf": pdf_text,
    ".png": ocr_text,
    ".jpg": ocr_text,
}


def load_texts(files: DataFrame) -> DataFrame:
    """(path, kind, ok, chars, text, error) of ``scan``'s files, each by the loader of its extension; a broken file is a row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                kind = "." + path.rpartition(".")[2].lower()
                try:
                    text, error = LOADERS[kind](bytes(content)), None
                except Exception as e:  # noqa: BLE001 - one file must not end the job; its row carries the error
                    text, error = None, f"{type(e).__name__}: {e}"[:300]
                rows.append((path, kind, text, error))
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "error"])

    read = files.select("path", "content").mapInPandas(run, "path string, kind string, text string, error string")
    return read.withColumn("text", loader_clean(F.col("text"))).select("path", "kind", F.col("error").isNull().alias("ok"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), "text", "error")


def load_xlsx(spark: SparkSession, path: str, sheet: int | str = 0, dates: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """One sheet of a workbook with its first row as headers; the file is one task's work, as its format demands."""
    data = spark.read.format("binaryFile").load(path).select("content").first()
    rows = xlsx_rows(bytes(data.content), sheet)
    if not rows:
        raise ValueError("the sheet is empty")
    names = [clean_header(c or f"column_{k}") for k, c in enumerate(rows[0])]
    body = [tuple((row + [None] * len(names))[: len(names)]) for row in rows[1:]]
    df = spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names))
    df = parse_dates(infer_types(df, skip=dates), dates)
    return df.limit(limit) if limit is not None else df


def load_triples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object, source, confidence, updated_at) of a CSV file; incomplete rows are left out."""
    df = load_csv(spark, path, delimiter=",", encoding="utf-8")
    have = {c.lower(): c for c in df.columns}
    col = lambda n, t: (F.col(f"`{have[n]}`") if n in have else F.lit(None)).cast(t).alias(n)
    rows = df.select(col("subject", "string"), col("predicate", "string"), col("object", "string"), col("source", "string"), F.coalesce(col("confidence", "double"), F.lit(1.0)).alias("confidence"), col("updated_at", "timestamp"))
    return rows.where("trim(subject) <> '' and trim(predicate) <> '' and trim(object) <> ''")


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(key, alias) of a JSON object of lists; of equal aliases the first key stays in ``resolve``."""
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    one = spark.createDataFrame([(text,)], "t string").select(F.explode(F.from_json("t", "map<string,array<string>>")).alias("key", "list"))
    return one.select("key", F.explode("list").alias("alias"))


def load_kg_documents(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of documents (tenant_id, entity_key, doc_id, page, chunk_id, text) from JSON with a list of chunks each."""
    schema = "tenant_id string, entity_name string, entity_namespace string, doc_id string, chunks array<struct<text:string,page:int,chunk_id:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    key = F.concat(F.lower(F.coalesce("entity_namespace", F.lit("org"))), F.lit(":"), F.lower(F.trim("entity_name")))
    return rows.select("tenant_id", key.alias("entity_key"), "doc_id", F.explode("chunks").alias("c")).select("tenant_id", "entity_key", "doc_id", "c.page", "c.chunk_id", "c.text")


def load_eval_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(question, references, meta) of JSON lines; answers stand in for references; rows without a question are left out."""
    rows = load_jsonl(spark, path, "question string, references array<string>, answers array<string>, answer string, meta map<string,string>", lenient=True)
    refs = F.coalesce("references", "answers", F.when(F.col("answer").isNotNull(), F.array("answer")), F.array().cast("array<string>"))
    return rows.where("trim(question) <> ''").select("question", refs.alias("references"), "meta")
