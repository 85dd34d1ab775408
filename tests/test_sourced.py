import io
import zipfile

from monthloom import session
from monthloom.functions import names
from monthloom.operators import lookup, tokens
from monthloom.plans import wide
from monthloom.sources import tables


def _workbook(path, rows):
    """A workbook of one sheet: texts shared, numbers stored, one cell inline; None is a missing cell."""
    shared, lines = [], []
    for i, row in enumerate(rows):
        cells = []
        for j, v in enumerate(row):
            at = f'{chr(65 + j)}{i + 1}'
            if isinstance(v, str) and v.startswith("="):
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{v[1:]}</t></is></c>')
            elif isinstance(v, str):
                shared.append(v)
                cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
        lines.append(f'<row r="{i + 1}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{t}</t></si>" for t in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>")
    path.write_bytes(raw.getvalue())


def test_excel(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", [["code", "n", "note"], ["ATL", 5, None], [None, "x", "=inline"], ["SFO", 7, "end"]])
    _workbook(tmp_path / "b.xlsx", [["code", "n", "note"]])
    got = tables.excel(spark, str(tmp_path), "code string, n int, note string").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("ATL", 5, None), (None, None, "inline"), ("SFO", 7, "end")], key=str)
    assert tables.excel(spark, str(tmp_path / "a.xlsx"), "code string", sheet=2).count() == 0


def test_html_rows(spark):
    pages = [("p", "<table><tr><th>A</th></tr><TR class='x'><td> 1,234 </td><td><b>x</b> &amp; y</td></TR><tr></tr></table>"), ("q", None), ("r", "")]
    got = tables.html_rows(spark.createDataFrame(pages, "k string, h string"), "k", "h").collect()
    assert [(r.k, r.row, list(r.cells)) for r in got] == [("p", 0, ["A"]), ("p", 1, ["1,234", "x & y"])]


def test_column_names():
    assert wide.class_column("Air Carrier\tIFR Itinerant") == "ifritnr_air_carrier" and wide.class_column("General Aviation\tVFR Overflight") == "vfrovrflt_gen_aviation"
    assert wide.class_column("Civil Local") == "local_civil" and wide.class_column("n words") == "n words"
    assert wide.discovered(["a_ct", "a_ct_all", "b", "lwc_ct"], having=["ct"], without=["lwc"], not_ending=["_all"]) == ["a_ct"]
    assert wide.discovered([]) == []


def test_located(spark):
    states = spark.createDataFrame([("TX", "Texas"), ("TX", "Tejas"), ("ME", "Maine")], "c string, f string")
    rows = ["Port A, TX, United States", "Port B, TX", "Port C, France", "Port D, Somewhere, USA", "Port E, Q, ME", "one", None, "a,b,c,d"]
    got = {r.p: (r.city, r.state, r.country) for r in names.located(spark.createDataFrame([(x,) for x in rows], "p string"), "p", states, "c", "f").collect()}
    assert got["Port A, TX, United States"] == ("port a", "Tejas", "United States") and got["Port B, TX"] == ("port b", "Tejas", "United States")
    assert got["Port C, France"] == ("port c", None, "France") and got["Port D, Somewhere, USA"] == ("port d", "Somewhere", "United States")
    assert got["Port E, Q, ME"] == ("port e", "Q", "United States") and got["one"] == got[None] == (None, None, None) and got["a,b,c,d"] == (None, None, "d")


def test_expansion_with_a_long_table(spark):
    table = spark.createDataFrame([(f"w{i}", f"full {i}") for i in range(200)], "word string, fullform string")
    df = spark.createDataFrame([(1, "w1 x w199"), (2, None), (3, ""), (4, "w5 w5")], "id int, t string").repartition(3)
    long = {r.id: r.o for r in tokens.expanded(df, "t", table, "o").collect()}
    assert long == {1: "full 1 x full 199", 2: None, 3: "", 4: "full 5 full 5"}
    assert {r.id: r.o for r in tokens.expanded(df, "t", table.filter("word in ('w1', 'w199', 'w5')"), "o").collect()} == long


def test_words_kept_only(spark):
    df = spark.createDataFrame([("a", "x y x"), ("a", "z"), ("b", None)], "k string, t string")
    only = spark.createDataFrame([("x",), ("q",), ("x",)], "word string")
    assert [tuple(r) for r in tokens.word_counts(df, "t", ["k"], only=only).collect()] == [("a", "x", 2)]


def test_full_forms_fan_out(spark):
    v = spark.createDataFrame([("a", 1), ("b", 2)], "word string, ct long")
    d = spark.createDataFrame([("m", "a", "1"), ("m", "a", "2"), ("m", "a", "2"), ("n", "a", "3"), ("n", "a", "4")], "dict string, acronym string, fullform string")
    got = {tuple(r) for r in tokens.with_all_forms(v, d, ["m", "n"]).collect()}
    assert got == {("a", 1, x, y) for x in "12" for y in "34"} | {("b", 2, None, None)}


def test_small_counts_bytes_too(spark, monkeypatch):
    df = spark.range(10).selectExpr("id", "repeat('x', 1000) as t", "array(id) as a")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(session.small(df)) and not hinted(session.small(df, 9))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 5_000)
    assert not hinted(session.small(df))


def test_duplicates_of_a_hot_value(spark, monkeypatch):
    df = spark.range(30_000).selectExpr("id", "if(id < 29999, 'hot', 'once') as t").unionByName(spark.createDataFrame([(-1, None), (-2, None)], "id long, t string"))
    for limit in (200_000, 0):
        monkeypatch.setattr(session, "BROADCAST_ROWS", limit)
        got = {(r.t, r.duplicated): r["count"] for r in lookup.duplicate_flag(df, "t").groupBy("t", "duplicated").count().collect()}
        assert got == {("hot", True): 29_999, ("once", False): 1, (None, True): 2}


def test_scope(spark):
    df = spark.createDataFrame([(20 * 12 + 5,), (2019 * 12 + 10,), (2019 * 12 + 11,), (2019 * 12 + 12,), (None,)], "m int")
    assert [r.m for r in wide.in_scope(df, "m").collect()] == [2019 * 12 + 10]


def test_stats_with_codes_flags_and_idents(spark):
    df = spark.createDataFrame([("a", "x y", 2, True, False, 1), ("a", None, 0, None, True, None)], "k string, t string, c int, f boolean, g boolean, tower_ident_ct int")
    r = tokens.document_stats(df, ["k"], "t", codes="c", flags=["f", "g"], idents=["tower_ident_ct"]).first()
    assert (r.n_docs, r.n_words, r.avg_codes, r.n_f, r.n_g, r.n_any_flag, r.tower_ident_ct, r.n_idents) == (2, 2, 1.0, 1, 1, 2, 1, 1)
