"""Workbooks in many stretches against what was written into them."""

import random
import zipfile

import pytest

from tidemark.operators.fits import Refused
from tidemark.plans.pipeline import create
from tidemark.sources.readers import read_excel
from tidemark.sources.workbooks import is_date, moment, read_workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(at):
    return ("" if at < 26 else letters(at // 26 - 1)) + chr(65 + at % 26)


def cell(n, at, value, words):
    """value: None; a str (shared); ("inline", s), ("date", serial), ("bool", b), ("error", s); a number."""
    where = f'r="{letters(at)}{n}"'
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    if value is None:
        return f'<c {where} s="1"/>'
    if isinstance(value, str):
        return f'<c {where} t="s"><v>{words.setdefault(value, len(words))}</v></c>'
    if isinstance(value, tuple):
        kind, v = value
        return {
            "inline": f'<c {where} t="inlineStr"><is><t>{escape(str(v))}</t></is></c>', "date": f'<c {where} s="1"><v>{v}</v></c>', "clock": f'<c {where} s="2"><v>{v}</v></c>',
            "bool": f'<c {where} t="b"><v>{int(v) if kind == "bool" else 0}</v></c>', "error": f'<c {where} t="e"><f>1/0</f><v>{v}</v></c>',
        }[kind]
    return f"<c {where}><v>{value}</v></c>"


def write(path, sheets, prefix="", late=False):
    """sheets: name to {row number: cells}."""
    words: dict[str, int] = {}
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{n}" x:odd="1">{"".join(cell(n, at, v, words) for at, v in enumerate(cells))}</row>\n' for n, cells in rows.items())
            text = f'<?xml version="1.0"?>\n<worksheet xmlns="{MAIN}" xmlns:x="urn:odd"><dimension ref="A1"/><sheetData>{body}</sheetData></worksheet>'
            if prefix:
                text = text.replace("xmlns=", f"xmlns:{prefix}=").replace("</", "</#").replace("<", f"<{prefix}:").replace(f"<{prefix}:/#", f"</{prefix}:").replace(f"<{prefix}:?", "<?")
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", text)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si><r><t>{escape(w[:1])}</t></r><r><t>{escape(w[1:])}</t></r><rPh><t>no</t></rPh></si>" for w in words) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="[$-409]h:mm&quot;x&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><workbookPr date1904="{int(late)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="s{i}" Type="{RELS}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
                   + f'<Relationship Id="w" Type="{RELS}/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="f" Type="{RELS}/styles" Target="/xl/styles.xml"/></Relationships>')


def test_each_cell_is_what_the_sheet_types(spark, tmp_path):
    rows = {1: ["name", "age", "born", "adult", "note"], 2: ["Zoë & Café", 22.5, ("date", 42053), ("bool", True), ("inline", "22.0")], 3: ["Bob", ("error", "#DIV/0!"), None, ("bool", False)], 5: ["Ann", "x", ("clock", 42053.75), None, "1E-2"], 6: [3, 0.01, None, 2e20, 1e-7]}
    want = [
        ("Zoë & Café", "22.5", "2015-02-18T00:00:00.0000000", "True", "22.0"), ("Bob", "#DIV/0!", None, "False", None), (None,) * 5,
        ("Ann", "x", "2015-02-18T18:00:00.0000000", None, "1E-2"), ("3", "0.01", None, "2E+20", "1E-07"),
    ]
    for prefix in ("", "m"):
        path = tmp_path / f"people {prefix}.xlsx"
        write(path, {"people": rows, "pets": {1: ["kind", "legs"], 2: ["cat", 4]}}, prefix)
        assert [tuple(r) for r in read_excel(spark, str(path)).collect()] == want
        assert [tuple(r) for r in read_excel(spark, str(path), "pets").collect()] == [("cat", "4")]
        with pytest.raises(Refused, match="has no sheet called 'fish'. Its sheets are: people, pets"):
            read_excel(spark, str(path), "fish")
    born = create().read_excel(path=str(path)).declare(columns=[{"name": "born", "kind": "timestamp"}, {"name": "name", "kind": "text"}]).build().run(spark).df
    assert [str(r.born) for r in born.where("name = 'Ann'").collect()] == ["2015-02-18 18:00:00"]


@pytest.mark.parametrize("stretch", [70, 1000, 40_000, 1 << 24])
def test_stretches_say_what_the_sheet_says(spark, tmp_path, stretch):
    rng = random.Random(stretch)
    some = [None, "a", "b<c", "", 1.5, -3, ("date", 60), ("bool", True), ("inline", "<row r='1'>")]
    rows, n = {3: ["k", "v", *"cde"]}, 3
    for _ in range(40 if stretch < 100 else 1500):
        n += rng.choice((1, 1, 1, 2, 4))
        rows[n] = [n, *rng.choices(some, k=rng.randrange(5))]
    write(tmp_path / "t.xlsx", {"s": rows})
    df = read_workbooks(spark, str(tmp_path / "t.xlsx"), stretch=stretch)
    assert stretch >= 1 << 20 or df.rdd.getNumPartitions() > 2
    told = {None: None, ("date", 60): "1900-02-28T00:00:00.0000000", ("bool", True): "True", ("inline", "<row r='1'>"): "<row r='1'>", 1.5: "1.5", -3: "-3"}
    want = [tuple(str(c) if at == 0 else told.get(c, c) for at, c in enumerate(rows.get(i, []) + [None] * (5 - len(rows.get(i, []))))) if i in rows else (None,) * 5 for i in range(4, n + 1)]
    assert [tuple(r) for r in df.collect()] == want


def test_what_is_no_workbook_or_no_table_is_refused(spark, tmp_path):
    write(tmp_path / "blank.xlsx", {"blank": {}})
    with pytest.raises(Refused, match="The sheet 'blank' of .* has no header row"):
        read_excel(spark, str(tmp_path / "blank.xlsx"))
    write(tmp_path / "t.xlsx", {"s": {1: ["a"], 2: [1], 7: [1, 2]}})
    (tmp_path / "cut.xlsx").write_bytes((tmp_path / "t.xlsx").read_bytes()[:700])
    with pytest.raises(Refused, match="cut.xlsx cannot be read as an Excel workbook"):
        read_excel(spark, str(tmp_path / "cut.xlsx"))
    with pytest.raises(Exception, match="row 7 of .* has more than 1 cells"):
        read_excel(spark, str(tmp_path / "t.xlsx")).collect()
    write(tmp_path / "twice.xlsx", {"s": {1: ["a", "a"]}})
    with pytest.raises(Refused, match="columns of one name: a"):
        read_excel(spark, str(tmp_path / "twice.xlsx"))
    write(tmp_path / "only.xlsx", {"s": {1: ["a", "b"]}})
    assert read_excel(spark, str(tmp_path / "only.xlsx")).collect() == []


def test_a_folder_of_workbooks(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"{i}.xlsx", {"s": {1 + i: ["a", "b"], 3 + i: [i, "x"]}}, late=i == 2)
    assert [tuple(r) for r in read_excel(spark, str(tmp_path)).collect()] == [(None, None), ("0", "x"), (None, None), ("1", "x"), (None, None), ("2", "x")]
    write(tmp_path / "3.xlsx", {"s": {1: ["b", "a"]}})
    with pytest.raises(Refused, match="different columns"):
        read_excel(spark, str(tmp_path))


def test_formats_and_moments():
    assert is_date("yyyy\\-mm\\-dd") and is_date("[h]:mm") and not is_date('0.00"days"') and not is_date("General") and not is_date("#,##0_h;[Red]0")
    assert moment(1, False)[:10] == "1900-01-01" and moment(61, False)[:10] == "1900-03-01" and moment(0, True)[:10] == "1904-01-01"
    assert moment(42053.5000001, False) == "2015-02-18T12:00:00.0090000"
