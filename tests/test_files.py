import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarryline.operators import layout as L
from quarryline.sources import files as S

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
X = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    return zipped({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{p("one")}{p(" ")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl>{p("two")}</w:body></w:document>'})


def xlsx():
    return zipped({"xl/sharedStrings.xml": f'<sst xmlns="{X}"><si><t>Title</t></si></sst>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{X}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>1</v></c><c r="B2"><f>A2+2</f><v>3</v></c></row></sheetData></worksheet>'})


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for name, content in {"a.docx": docx(), "b.xlsx": xlsx(), "c.txt": b"text", "d.pdf": b"no pdf", "e.txt": b"", "f.exe": b"MZ", "g.md": b"a\x00b", "h.zip": zipped({"x/one.txt": "1", "../two.txt": "2", "in.zip": "PK", "pic.png": "p", "big.txt": "0" * 1_000_000})}.items():
        (d / name).write_bytes(content)
    return S.files(spark, str(d))


def test_problems(found):
    got = {r.path.rpartition("/")[2]: r.problem for r in found.select("path", "problem").collect()}
    assert {k: got[k] for k in ("c.txt", "d.pdf", "g.md")} == {"c.txt": None, "d.pdf": "signature", "g.md": "signature"}
    assert "e.txt" not in got
    assert found.filter("problem = 'extension'").count() == 1


def test_office_parts(found):
    rows = [(r.kind, r.sequence, r.row, r.column, r.text) for r in S.office_parts(found).collect()]
    assert [r for r in rows if r[-1] in ("one", "two", "a", "b")] == [("paragraph", 0, 0, 0, "one"), ("cell", 2, 0, 0, "a"), ("cell", 2, 0, 1, "b"), ("paragraph", 3, 0, 0, "two")]
    assert [r[2:] for r in rows if r[-1] in ("Title", "1", "3")] == [(0, 0, "Title"), (1, 0, "1"), (1, 1, "3")]


def test_broken_files_fail_alone(spark):
    rows = [("a.docx", "docx", b"PK not a zip"), ("b.docx", "docx", docx()), ("c.xlsx", "xlsx", zipped({"xl/worksheets/sheet1.xml": "<open"})), ("d.zip", "zip", b"PK"), ("e.zip", "zip", zipped({"x/": "", "x/one.txt": "1", "two.png": "2"}))]
    d = spark.createDataFrame([(*r, None) for r in rows], "path string, ext string, content binary, problem string")
    parts = S.office_parts(d).collect()
    assert [(r.path, r.kind, r.text) for r in parts if r.kind == "problem"] == [("a.docx", "problem", "corrupt"), ("c.xlsx", "problem", "corrupt")]
    assert {r.text for r in parts if r.path == "b.docx"} == {"one", "a", "b", "two"}
    assert [(r.path, r.problem) for r in S.expanded(d.filter("ext = 'zip'")).filter("problem is not null").collect()] == [("d.zip", "corrupt")]
    assert [(r.path, r.content) for r in S.manifest_entries(d.filter("ext = 'zip'")).collect()] == [("e.zip", "x/one.txt"), ("e.zip", "two.png")]


def test_dispatch_and_status(spark, found):
    more = spark.createDataFrame([("z/old.xls", "xls", b"", None), ("z/scan.pdf", "pdf", b"%PDF", None), ("z/n.docx", "docx", b"PK", None), ("z/x.exe", "exe", b"", None), ("z/t.md", "md", "\ufeff# A\n\n甲。乙".encode(), None)], "path string, ext string, content binary, problem string")
    blocks, state = S.parsed(found.select("path", "ext", "content", "problem").unionByName(more))
    got = {r.path.rpartition("/")[2]: (r.status, r.error) for r in state.collect()}
    assert got == {"a.docx": ("completed", None), "b.xlsx": ("completed", None), "c.txt": ("completed", None), "d.pdf": ("failed", "signature"), "f.exe": ("failed", "extension"), "g.md": ("failed", "signature"), "h.zip": ("completed", None), "old.xls": ("failed", "legacy_xls_requires_conversion"), "scan.pdf": ("partial", None), "n.docx": ("failed", "corrupt"), "x.exe": ("failed", "unsupported_parser"), "t.md": ("completed", None)}
    text = {}
    for r in blocks.orderBy("path", "sequence_no").collect():
        text.setdefault(r.path.rpartition("/")[2], []).append(r.content)
    assert text["t.md"] == ["# A", "甲。", "乙"] and text["a.docx"] == ["one", "two"] and text["b.xlsx"] == ["Title\n1\t3"] and text["c.txt"] == ["text"] and "x/one.txt" in text["h.zip"]


def test_images_formulas_and_merged_ranges(spark):
    R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    A = "http://schemas.openxmlformats.org/drawingml/2006/main"
    doc = zipped({"word/document.xml": f'<w:document xmlns:w="{W}" xmlns:a="{A}" xmlns:r="{R}"><w:body><w:p><w:r><w:t>Figure 1</w:t><a:blip r:embed="i1"/></w:r></w:p></w:body></w:document>', "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="i1" Target="media/p.png"/></Relationships>'})
    book = zipped({"xl/workbook.xml": f'<workbook xmlns="{X}"><sheets><sheet name="Data"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{X}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>T</t></is></c></row><row r="2"><c r="AB2"><f>A1+2</f><v>3</v></c></row></sheetData><mergeCells><mergeCell ref="B1:C2"/></mergeCells></worksheet>'})
    d = spark.createDataFrame([("a", "docx", doc), ("b", "xlsx", book)], "path string, ext string, content binary")
    got = {(r.path, r.kind): (r.row, r.column, r.text, r.note) for r in S.office_parts(d).collect() if r.text != "T"}
    assert got[("a", "image")] == (0, 0, "p.png", "Figure 1") and got[("b", "cell")] == (1, 27, "3", "=A1+2") and got[("b", "merged")] == (0, 1, "B1:C2", None) and got[("b", "sheet")] == (0, 0, "T\n3", "Data")


def test_uploads_have_a_largest_size(spark, tmp_path):
    (tmp_path / "s.txt").write_bytes(b"x")
    (tmp_path / "l.txt").write_bytes(b"x" * 50)
    assert {(r.path.rpartition("/")[2], r.problem, r.content is None) for r in S.uploads(spark, str(tmp_path), 10).collect()} == {("s.txt", None, False), ("l.txt", "size", True)}


def test_gold_ids(spark):
    d = spark.createDataFrame([("a",), ("a",), ("b",), ("",), (None,)], "id string")
    assert sorted(map(str, map(tuple, S.gold_issues(d).collect()))) == ["('a', 'duplicate')", "(None, 'without id: 2')"]


def test_backup_manifest_finds_changes(spark, tmp_path):
    from quarryline.operators import evaluation as E

    S.write_tsv(spark.createDataFrame([(1, "a")], "i long, t string").coalesce(1), str(tmp_path / "t"))
    stated = S.backup_manifest(spark, str(tmp_path / "t"))
    kept = spark.createDataFrame(stated.collect(), stated.schema)
    assert E.manifest_problems(kept, S.backup_manifest(spark, str(tmp_path / "t"))).count() == 0
    part = next((tmp_path / "t").glob("part-*"))
    part.write_text(part.read_text().replace("a", "b"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert [r.problem for r in E.manifest_problems(kept, S.backup_manifest(spark, str(tmp_path / "t"))).collect()] == ["digest"]


def test_partitions_are_replaced(spark, tmp_path):
    from quarryline.operators import tables as R

    rows = spark.range(10).select("id", (F.col("id") % 3).alias("run"))
    R.appended(rows, str(tmp_path / "r"), "run")
    R.overwritten(spark.createDataFrame([(77, 1)], "id long, run long"), str(tmp_path / "r"), "run")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [0, 2, 3, 5, 6, 8, 9, 77]


def test_archives(found):
    got = {r.name: r.problem for r in S.expanded(found.filter("ext = 'zip'")).collect()}
    assert got == {"one.txt": None, "../two.txt": "path", "in.zip": "nested archive", "big.txt": "ratio"}


def test_tsv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"'), (2, None)], "i long, t string")
    S.write_tsv(rows, str(tmp_path / "t"))
    assert sorted(map(tuple, S.read_tsv(spark, str(tmp_path / "t"), "i long, t string").collect())) == [(1, 'a "b"'), (2, None)]


def test_gold_section(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"numbers": [{"id": "n1", "value": 1.5, "unit": "g"}], "fields": []}')
    assert S.gold_section(spark, str(tmp_path / "g.json"), "numbers", "struct<id:string,value:double,unit:string>").first()["value"] == 1.5
    assert S.gold_section(spark, str(tmp_path / "g.json"), "fields", "struct<id:string>").count() == 0


def test_table_structure(spark):
    text = [["Measurement", None], ["Yield (g/L)", "Temperature (℃)"], ["4.2", "30"]]
    cells = spark.createDataFrame([(1, r, c, t) for r, row in enumerate(text) for c, t in enumerate(row)], "table_id int, row int, column int, text string")
    assert L.header_rows(cells).first()["header_rows"] == 2
    assert {r.column: (r.path, r.unit) for r in L.header_paths(cells).collect()} == {0: (["Measurement", "Yield (g/L)"], "g/L"), 1: (["Temperature (℃)"], "℃")}
    assert L.row_texts(cells).first()["text"] == "Measurement / Yield (g/L): 4.2 | Temperature (℃): 30"
    boxes = spark.createDataFrame([(1, 0, 0, [0.0, 0.0, 2.0, 1.0]), (1, 0, 1, [0.0, 0.0, 2.0, 1.0]), (1, 1, 0, [0.0, 1.0, 1.0, 2.0])], "table_id int, row int, column int, box array<double>")
    assert [tuple(r) for r in L.merged_cells(boxes).collect()] == [(1, 0, 0, 1, 2)]
    one = spark.createDataFrame([(20.0, 40.0, 220.0, 80.0)], "x0 double, y0 double, x1 double, y1 double")
    assert tuple(L.scaled(one, (1000, 2000), (500, 1000)).first()) == (10, 20, 110, 40)
    lines = spark.createDataFrame([(1, 1, "a"), (1, 2, " "), (1, 3, "b")], "p int, o int, text string")
    assert [r.sequence_no for r in L.numbered_blanks(lines, "p", "o").orderBy(F.col("o")).collect()] == [1, 3]
