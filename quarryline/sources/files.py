"""Files as DataFrames: contents with digests, archives, office documents, tab-separated tables, gold-standard JSON."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Allowed extensions, and the first bytes that some must have.
EXTENSIONS = ("pdf", "docx", "txt", "md", "xlsx", "xls", "zip")
MAGIC = {"pdf": "255044462D", "docx": "504B", "xlsx": "504B", "zip": "504B", "xls": "D0CF11E0"}
#: Limits on archives.
MOST_ENTRIES, MOST_BYTES, MOST_RATIO = 500, 1000 << 20, 100
#: Bytes of an upload, by default.
MOST_UPLOAD = 200 << 20


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, ext, size, sha256, problem, content; unknown and mismatched files have a problem.

    The binaryFile source gives no row for an empty file; contents from elsewhere that are empty have a problem too.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return raw.select("path", ext.alias("ext"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), problem(ext, F.col("content")).alias("problem"), "content")


def problem(ext: Column, content: Column) -> Column:
    starts = F.lit(None).cast("string")
    for e, magic in MAGIC.items():
        starts = F.when((ext == e) & ~F.hex(content).startswith(magic), "signature").otherwise(starts)
    plain = F.when(ext.isin("txt", "md") & F.hex(F.substring(content, 1, 16)).rlike("^(..)*?00"), "signature")
    return F.when(F.octet_length(content) == 0, "empty").when(~ext.isin(*EXTENSIONS), "extension").otherwise(F.coalesce(starts, plain))


#: What reading a broken archive or part can raise.
BROKEN = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, ValueError, AttributeError, EOFError, NotImplementedError, RuntimeError, OSError)


def uploads(spark: SparkSession, path: str, most: int = MOST_UPLOAD) -> DataFrame:
    """files whose size is judged before their contents are read: what is too large has a problem and no content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = found.filter(F.col("length") > most).select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), F.col("length").alias("size"), F.lit(None).cast("string").alias("sha256"), F.lit("size").alias("problem"), F.lit(None).cast("binary").alias("content"))
    return files(spark, path).filter(F.col("size") <= most).unionByName(large)


def _entries(content: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """Name, content, problem of an archive's usable entries; one problem stands for the archive, or for the rest of it."""
    try:
        yield from _sound_entries(content)
    except BROKEN:
        yield "", None, "corrupt"


def _sound_entries(content: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_BYTES:
            yield "", None, "too large"
            return
        for i in infos:
            ext = i.filename.rpartition(".")[2].lower()
            if i.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", i.filename) or re.match("[A-Za-z]:", i.filename):
                yield i.filename, None, "path"
            elif i.flag_bits & 1:
                yield i.filename, None, "encrypted"
            elif ext == "zip":
                yield i.filename, None, "nested archive"
            elif i.file_size > MOST_RATIO * max(1, i.compress_size):
                yield i.filename, None, "ratio"
            elif ext in EXTENSIONS:
                yield re.split(r"[/\\]", i.filename)[-1], z.read(i), None


def expanded(archives: DataFrame) -> DataFrame:
    """path, name, content, problem of the entries of archives(path, content); names lose their folders."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, *e) for e in _entries(content)], columns=["path", "name", "content", "problem"])

    return archives.select("path", "content").mapInPandas(work, "path string, name string, content binary, problem string")


WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


Part = tuple[str, int, int, int, str, str | None]
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"
EMBED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"
RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def _docx(content: bytes) -> list[Part]:
    """kind, sequence, row, column, text, note of a body's paragraphs, table cells (the first row is the header) and images, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
        names = z.namelist()
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")).iter(RELATION)} if "word/_rels/document.xml.rels" in names else {}
    out: list[Part] = []
    for n, part in enumerate(body):
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD}t"))
        if part.tag == f"{WORD}p" and text(part).strip():
            out.append(("paragraph", n, 0, 0, text(part), None))
        elif part.tag == f"{WORD}tbl":
            out += [("cell", n, r, c, text(cell), "header" if r == 0 else "data") for r, row in enumerate(part.iter(f"{WORD}tr")) for c, cell in enumerate(row.findall(f"{WORD}tc"))]
        images = [links[e.get(EMBED)].rpartition("/")[2] for e in part.iter(DRAWING) if e.get(EMBED) in links]
        out += [("image", n, 0, k, name, text(part) or None) for k, name in enumerate(images)]
    return out


def _place(reference: str) -> tuple[int, int]:
    """Row and column from 0 of a cell's name."""
    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", reference).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(row) - 1, column - 1


def _xlsx(content: bytes) -> list[Part]:
    """kind, sheet, row, column, text, note: each sheet's name and all its text, its non-empty cells (formulas by their stored value, the
    formula as note), and its merged ranges with their place."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        titles = [e.get("name") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet")] if "xl/workbook.xml" in z.namelist() else []
        out: list[Part] = []
        for sheet, name in enumerate(names):
            root, cells = ElementTree.fromstring(z.read(name)), []
            for cell in root.iter(f"{SHEET}c"):
                row, column = _place(cell.get("r"))
                value, formula = cell.find(f"{SHEET}v"), cell.find(f"{SHEET}f")
                text = "".join(t.text or "" for t in cell.iter(f"{SHEET}t")) if cell.get("t") == "inlineStr" else value.text if value is not None else None
                if text is not None or formula is not None:
                    shown = shared[int(text)] if cell.get("t") == "s" else text or ""
                    cells.append(("cell", sheet, row, column, shown, f"={formula.text}" if formula is not None and formula.text else None))
            lines: dict[int, dict[int, str]] = {}
            for _, _, row, column, text, _ in cells:
                lines.setdefault(row, {})[column] = text
            whole = "\n".join("\t".join(v for _, v in sorted(line.items())) for _, line in sorted(lines.items()))
            out += [("sheet", sheet, 0, 0, whole, titles[sheet] if sheet < len(titles) else name.rpartition("/")[2]), *cells]
            out += [("merged", sheet, *_place(m.get("ref").partition(":")[0]), m.get("ref"), None) for m in root.iter(f"{SHEET}mergeCell")]
    return out


def office_parts(found: DataFrame) -> DataFrame:
    """path, kind, sequence, row, column, text, note of documents and workbooks among found(path, ext, content).

    A file that cannot be read has one row of kind problem, so that it fails alone.
    """

    def read(ext: str, content: bytes | None) -> list[Part]:
        try:
            return (_docx if ext == "docx" else _xlsx)(content or b"")
        except BROKEN:
            return [("problem", 0, 0, 0, "corrupt", None)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, ext, content in zip(batch["path"], batch["ext"], batch["content"], strict=True):
                yield pd.DataFrame([(path, *r) for r in read(ext, content)], columns=["path", "kind", "sequence", "row", "column", "text", "note"])

    chosen = found.filter(F.col("ext").isin("docx", "xlsx")).select("path", "ext", "content")
    return chosen.mapInPandas(work, "path string, kind string, sequence int, row int, column int, text string, note string")


def manifest_entries(archives: DataFrame) -> DataFrame:
    """path, sequence_no, content: every entry's name of archives(path, content) as a block, folders left out; a broken one has none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if not n.endswith("/")]
                except BROKEN:
                    names = []
                yield pd.DataFrame([(path, i, n) for i, n in enumerate(names)], columns=["path", "sequence_no", "content"])

    return archives.select("path", "content").mapInPandas(work, "path string, sequence_no int, content string")


def text_blocks(found: DataFrame) -> DataFrame:
    """path, sequence_no, content of the texts among found(path, ext, content): paragraphs, and sentences after an ideographic stop."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    parts = found.filter(F.col("ext").isin("txt", "md")).select("path", F.posexplode(F.split(text, r"\n\s*\n|(?<=。)\s*")).alias("sequence_no", "part"))
    return parts.select("path", "sequence_no", F.regexp_replace("part", r"^\s+|\s+$", "").alias("content")).filter("content != ''")


def parsed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks (path, sequence_no, content) of found(path, ext, problem, content) by their formats, and path, status, error of every file.

    Text, Markdown, documents, workbooks and archives are read here. A PDF needs a reader that is not here and is partial; old
    workbooks must be converted first; other formats have no parser; a file with a problem or without a readable part failed.
    """
    good = found.filter("problem is null")
    parts = office_parts(good)
    office = parts.filter(F.col("kind").isin("paragraph", "sheet")).select("path", F.col("sequence").alias("sequence_no"), F.col("text").alias("content"))
    blocks = text_blocks(good).unionByName(office).unionByName(manifest_entries(good.filter("ext = 'zip'")))
    broken = parts.filter("kind = 'problem'").select("path", F.lit(True).alias("_broken")).distinct()
    ext = F.col("ext")
    error = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(ext == "xls", "legacy_xls_requires_conversion")
        .when(~ext.isin("pdf", "docx", "txt", "md", "xlsx", "zip"), "unsupported_parser")
        .when(F.col("_broken"), "corrupt")
    )
    status = F.when(error.isNotNull(), "failed").when(ext == "pdf", "partial").otherwise("completed")
    return blocks, found.join(broken, "path", "left").select("path", status.alias("status"), error.alias("error"))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", nullValue="\\N", emptyValue="", header=True, quote="\b")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", nullValue="\\N", header=True, quote="\b", schema=schema)


GOLD = ("documents", "fields", "numbers", "associations", "tables", "translations")


def backup_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size and sha256 of a backup's files, to be written beside them and compared before they are read again."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return found.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def gold_section(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """The records of a section of a gold-standard file; ``gold_issues`` tells which break its rules."""
    if section not in GOLD:
        raise ValueError(section)
    whole = spark.read.schema(f"`{section}` array<{schema}>").json(path, multiLine=True)
    return whole.select(F.inline(section))


def gold_issues(records: DataFrame) -> DataFrame:
    """id, issue of a section's records: an id that repeats, and one that is missing or empty (counted)."""
    named = records.filter("id is not null and id != ''")
    twice = named.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate").alias("issue"))
    blank = records.filter("id is null or id = ''").agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(None).cast("string").alias("id"), F.concat(F.lit("without id: "), F.col("n").cast("string")).alias("issue"))
    return twice.unionByName(blank)
