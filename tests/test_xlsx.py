"""Spreadsheets: round trips, row ranges, and files as other programs write them."""

import datetime as dt
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF_185, GOLDEN_185
from stocklens.plans.retail import Retail
from stocklens.sources import tables, xlsx


def test_written_values_come_back_typed_and_as_text(spark, tmp_path):
    xlsx.register(spark)
    odd = ["plain", " kept  space ", "<&>\"'", "tab\tnew\nline\rreturn", "_x0041_", "bell\x07", "é 你 😀", "", None, "45000"]
    rows = [(i, i * 1.1 if i % 4 else None, s, i % 2 == 0, dt.datetime(2024, 2, 29, 13, 5, 7) + dt.timedelta(days=i), dt.date(1999, 1, 1)) for i, s in enumerate(odd)]
    df = spark.createDataFrame(rows, "id long, v double, s string, b boolean, t timestamp_ntz, d date").repartition(3)
    df.write.format("xlsx").mode("append").option("rows", 2).save(f"{tmp_path}/t")
    got = spark.read.format("xlsx").schema(df.schema).load(f"{tmp_path}/t").orderBy("id").collect()
    assert [tuple(r) for r in got] == rows
    text = spark.read.format("xlsx").option("columns", "t,s,v").load(f"{tmp_path}/t")
    assert text.columns == ["v", "s", "t"] and [f.dataType.simpleString() for f in text.schema] == ["string"] * 3
    by = {r.t: r for r in text.collect()}
    assert by["2024-03-01 13:05:07"].v == "1.1" and by["2024-02-29 13:05:07"].v is None
    df.filter("id < 2").write.format("xlsx").mode("overwrite").save(f"{tmp_path}/t")
    assert spark.read.format("xlsx").load(f"{tmp_path}/t").count() == 2


@pytest.mark.parametrize("size", [50, 333, 10_000])
def test_row_ranges_read_every_row_once(spark, tmp_path, size):
    xlsx.register(spark)
    spark.range(1000).select("id", F.repeat(F.lit("x"), 500).alias("s")).coalesce(1).write.format("xlsx").mode("append").save(f"{tmp_path}/t")
    df = spark.read.format("xlsx").option("rows", size).load(f"{tmp_path}/t")
    assert sorted(int(r.id) for r in df.collect()) == list(range(1000))
    assert df.rdd.getNumPartitions() == max(1, -(-1000 // size))


@pytest.mark.parametrize("chunk", [7, 64, 300, 1 << 18])
def test_rows_are_read_in_whole_stretches(spark, tmp_path, monkeypatch, chunk):
    """Every range and every size of what is read at once gives the same rows; only sheets with
    comments or CDATA need the event parser."""
    monkeypatch.setattr(xlsx, "CHUNK", chunk)
    text = ["sheetData row", "&lt;row r=&quot;3&quot;&gt; &lt;/sheetData&gt;", "", "x" * 500, "_x0041_ row"] * 4
    row = lambda r, t: f'<x:row r="{r}"><x:c><x:v>{r}</x:v></x:c><x:c t="inlineStr"><x:is><x:t>{t}</x:t></x:is></x:c></x:row>'
    rows = "".join(row(r + 2, t) for r, t in enumerate(text))
    head = '<x:dimension ref="A1:B21"/><x:sheetData>' + row(1, "s")
    workbook(f"{tmp_path}/a.xlsx", f"{head}{rows}</x:sheetData><x:after><x:row/></x:after>")
    workbook(f"{tmp_path}/b.xlsx", f"{head}{rows}<!-- <x:row r=\"99\"> --></x:sheetData>")
    workbook(f"{tmp_path}/c.xlsx", f"{head}{rows.replace('>sheetData row<', '><![CDATA[sheetData row]]><')}</x:sheetData>")
    want = [(str(r + 2), t.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("_x0041_", "A")) for r, t in enumerate(text)]
    pull = ElementTree.XMLPullParser
    for name in "abc":
        if name == "a":
            monkeypatch.setattr(ElementTree, "XMLPullParser", None)
        book = xlsx.Workbook(str(tmp_path), f"{tmp_path}/{name}.xlsx")
        for size in (1, 6, 19, 100):
            got = [tuple(str(v) for _, v in book.cells(e)) for n in range(2, 22, size) for e in book.rows(n, n + size)]
            assert got == want
        monkeypatch.setattr(ElementTree, "XMLPullParser", pull)


def workbook(path, sheet, strings="", styles="", book=""):
    main = 'xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<x:workbook {main} xmlns:r="urn:r">{book}<x:sheets><x:sheet name="A" sheetId="1" r:id="q1"/>'
                                      '<x:sheet name="B" sheetId="2" r:id="q2"/></x:sheets></x:workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="q2" Target="worksheets/other.xml"/>'
                                                 '<Relationship Id="q1" Target="/xl/worksheets/first.xml"/></Relationships>')
        z.writestr("xl/worksheets/first.xml", f"<x:worksheet {main}>{sheet}</x:worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<x:sst {main}>{strings}</x:sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<x:styleSheet {main}>{styles}</x:styleSheet>")


def test_files_of_other_programs(spark, tmp_path):
    """Prefixed tags, shared strings with runs, gaps, errors, formulas, date styles, no row numbers."""
    xlsx.register(spark)
    strings = ("<x:si><x:t>id</x:t></x:si><x:si><x:t>name</x:t></x:si><x:si><x:t>when</x:t></x:si>"
               "<x:si><x:r><x:t>two </x:t></x:r><x:r><x:t>runs</x:t></x:r><x:rPh><x:t>hint</x:t></x:rPh></x:si>")
    styles = '<x:numFmts><x:numFmt numFmtId="170" formatCode="[$-409]d/m/yyyy"/><x:numFmt numFmtId="171" formatCode="0.00&quot; days&quot;"/></x:numFmts>' \
             '<x:cellXfs><x:xf numFmtId="0"/><x:xf numFmtId="170"/><x:xf numFmtId="171"/><x:xf numFmtId="14"/></x:cellXfs>'
    head = '<x:c r="A{0}" t="s"><x:v>0</x:v></x:c><x:c r="B{0}" t="s"><x:v>1</x:v></x:c><x:c r="D{0}" t="s"><x:v>2</x:v></x:c><x:c r="E{0}" t="s"><x:v>1</x:v></x:c>'
    body = ('<x:row r="3">' + head.format(3) + '</x:row><x:row r="4"><x:c r="A4"><x:f>1+1</x:f><x:v>2</x:v></x:c><x:c r="B4" t="s"><x:v>3</x:v></x:c><x:c r="D4" s="1"><x:v>45000.5</x:v></x:c></x:row>'
            '<x:row r="9"><x:c r="A9" t="e"><x:v>#N/A</x:v></x:c><x:c r="B9" t="str"><x:v>formula text</x:v></x:c><x:c r="D9" s="3"><x:v>60</x:v></x:c><x:c r="E9" t="b"><x:v>1</x:v></x:c></x:row>'
            '<x:row r="10"><x:c r="B10" s="2"><x:v>3.5</x:v></x:c></x:row>')
    workbook(f"{tmp_path}/a.xlsx", f'<x:dimension ref="A3:E10"/><x:sheetData>{body}</x:sheetData><x:after/>', strings, styles)
    for rows in (2, 100):
        df = spark.read.format("xlsx").option("rows", rows).load(f"{tmp_path}/a.xlsx")
        assert df.columns == ["id", "name", "_2", "when"]
        assert [tuple(r) for r in df.collect()] == [("2", "two runs", None, "2023-03-15 12:00:00"), (None, "formula text", None, None), (None, "3.5", None, None)]
    plain = '<x:row><x:c t="inlineStr"><x:is><x:t>id</x:t></x:is></x:c></x:row><x:row><x:c><x:v>1</x:v></x:c></x:row><x:row/>'
    workbook(f"{tmp_path}/b.xlsx", f"<x:sheetData>{plain}</x:sheetData>", book='<x:workbookPr date1904="1"/>')
    assert [tuple(r) for r in spark.read.format("xlsx").schema("id timestamp_ntz, none string").load(f"{tmp_path}/b.xlsx").collect()] == [
        (dt.datetime(1899, 12, 31), None), (None, None)]
    workbook(f"{tmp_path}/c.xlsx", "<x:sheetData/>")
    assert spark.read.format("xlsx").schema("id string").load(f"{tmp_path}/c.xlsx").count() == 0


def test_retail_sources_from_workbooks(spark, tmp_path):
    """The golden client from spreadsheets; invoice dates as bare day numbers, debts missing."""
    xlsx.register(spark)
    day = lambda s: (dt.datetime.fromisoformat(s) - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.format("xlsx").mode("append").save(f"{tmp_path}/{name}")
    put("products", [(int(p), n, float(b), float(s), st, 185, "no") for p, n, b, s, st, *_ in GOLDEN_185],
        "id long, name string, buyPrice double, salePrice double, quantity double, client_id long, extra string")
    put("sale_invoices", [(k + 1, day(g[7]), float(g[6]), 185) for k, g in enumerate(GOLDEN_185)], "id long, created_at double, totalPrice double, client_id long")
    put("sale_invoices_details", [(k + 1, g[0], k + 1, float(g[5]), float(g[6]), 0.0, None) for k, g in enumerate(GOLDEN_185)],
        "id long, product_id string, invoice_id long, quantity double, totalPrice double, buyPrice double, created_at timestamp_ntz")
    r = Retail.from_source(spark, str(tmp_path), AS_OF_185, client_ids=[185], fmt="xlsx")
    got = {row.product_id: (row.sales_quantity, row.sales_amount, str(row.last_sale_date)) for row in r.product_flow.collect()}
    assert got == {g[0]: (float(g[5]), float(g[6]), g[7]) for g in GOLDEN_185} and r.deferreds.count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_spreadsheet(spark, f"{tmp_path}/none", "products")


def test_columns_are_written_and_read_as_single_cells_are(tmp_path, monkeypatch):
    """Arrow batches give the bytes and rows that cells written and parsed one by one give; of a range
    only its own rows are inflated; many ranges share tasks."""
    import pyarrow as pa
    from pyspark.sql import types as T
    monkeypatch.setattr(xlsx, "STRETCH", 40)
    n = 500
    odd = [0.0, -0.0, 1.0, -2.5, 1e-5, 1e10, 123456789.123, 1e16, 1e300, float("inf"), float("nan"), 0.1, None]
    text = ["plain", "", " padded ", "a&b<c>", "_x0041_", "bell\x07", "é 😀", "45000", None]
    when = [dt.datetime(2024, 2, 29, 13, 5, 7), dt.datetime(1900, 2, 28), dt.datetime(1900, 3, 1, 0, 0, 0, 500_000), dt.datetime(9999, 12, 31), dt.datetime(1700, 1, 1), None]
    data = {"i": [None if i % 7 == 3 else i - 9 for i in range(n)], "x": [odd[i % 13] if i < 200 else i * 1.25 for i in range(n)],
            "s": [text[i % 9] if i < 300 else f"t{i}" for i in range(n)], "b": [[True, False, None][i % 3] for i in range(n)],
            "d": [dt.date(1999, 1, 1) + dt.timedelta(days=i) for i in range(n)], "t": [when[i % 6] if i < 100 else when[0] + dt.timedelta(minutes=i) for i in range(n)]}
    kinds = {"i": pa.int64(), "x": pa.float64(), "s": pa.string(), "b": pa.bool_(), "d": pa.date32(), "t": pa.timestamp("us")}
    schema = T.StructType([T.StructField(c, k) for c, k in zip(data, (T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.DateType(), T.TimestampNTZType()), strict=True)])
    table = pa.table({c: pa.array(v, kinds[c]) for c, v in data.items()})
    xlsx.BatchWriter(f"{tmp_path}/b", schema, 200, False).write(iter(table.to_batches(max_chunksize=70)))
    xlsx.Writer(f"{tmp_path}/r", schema, 200, False).write(zip(*data.values(), strict=True))

    def sheets(folder):
        return sorted(zipfile.ZipFile(f).read("xl/worksheets/sheet1.xml") for f in xlsx.workbooks(folder))
    assert sheets(f"{tmp_path}/b") == sheets(f"{tmp_path}/r") and len(sheets(f"{tmp_path}/b")) == 3

    columns = T.StructType([T.StructField(c, T.StringType()) for c in ("t", "x", "i", "s", "b", "d")])
    reader = xlsx.Reader(f"{tmp_path}/b", columns, 30)
    by_row = sorted(map(repr, (r for at, *ends in (r for p in reader.partitions() for r in p.ranges) for r in reader.tuples(xlsx.Workbook("", at), *ends))))
    for tasks in (1, 4, 1_000):
        monkeypatch.setattr(xlsx, "TASKS", tasks)
        parts = reader.partitions()
        assert len(parts) <= tasks
        got = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert sorted(map(repr, got)) == by_row and len(got) == n
    book = xlsx.Workbook("", next(r[0] for p in reader.partitions() for r in p.ranges if r[1] == 152))
    from_mark = []
    monkeypatch.setattr(xlsx.Inflated, "read", lambda self, size, read=xlsx.Inflated.read: from_mark.append(read(self, size)) or from_mark[-1])
    assert [e.get("r") for e in book.rows(150, 153)] == ["150", "151", "152"]
    assert 110 < int(xlsx.ROW.match(from_mark[0])[1]) <= 150      # the stretch that holds row 150


def test_plain_cells_of_other_programs_are_read_as_columns(tmp_path):
    """Empty, formula, error, boolean and date cells in plain rows; row by row or as columns."""
    from pyspark.sql import types as T
    row = '<row r="{0}" spans="1:4"><c s="1"><v>{0}.25</v></c><c t="{1}"><v>{2}</v></c><c/><c t="inlineStr"/></row>'
    cells = [("n", "5 "), ("b", "1"), ("b", "0"), ("e", "#N/A"), ("str", "text"), ("d", "2024-01-01"), ("n", "1E5"), ("str", ""), ("inlineStr", "lost")]
    body = "".join(row.format(i + 2, *c) for i, c in enumerate(cells)) + '<row r="60"><c s="1"><v>60</v></c></row><row r="61"><c s="1"></c><c><v>7</v></c></row>'
    head = '<row r="1">' + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in "abcd") + "</row>"
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = f"{tmp_path}/a.xlsx"
    workbook(path, f'<dimension ref="A1:D61"/><sheetData>{head}{body}</sheetData>', styles='<x:cellXfs><x:xf numFmtId="0"/><x:xf numFmtId="22"/></x:cellXfs>')
    with zipfile.ZipFile(path) as z:
        parts = {f: z.read(f) for f in z.namelist()}
    parts["xl/worksheets/first.xml"] = parts["xl/worksheets/first.xml"].replace(b"x:worksheet", b"worksheet").replace(b"xmlns:x=", b"xmlns=")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f, b in parts.items():
            z.writestr(f, b)
    assert main.encode() in parts["xl/worksheets/first.xml"]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("b", "a", "d", "c", "none")])
    reader = xlsx.Reader(path, schema, 100)
    book = xlsx.Workbook("", path)
    stretch, = book.stretches(2)
    assert book.columns(stretch, 1 << 40, {0: 0}, 1) is not None
    got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert got == list(reader.tuples(book, 2, 1 << 40)) and len(got) == 11
    assert [r[0] for r in got] == ["5", "true", "false", None, "text", "2024-01-01", "1E5", None, "", None, "7"]
    assert got[0][1:] == ("1900-01-01 06:00:00", "", None, None) and got[9][1] is None
