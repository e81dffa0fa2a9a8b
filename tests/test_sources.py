import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.sources import sniff
from quern.sources.readers import null_variants, read_any, write_output


def put(tmp_path, text, name="f.csv", encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def test_clean_csv(spark, tmp_path):
    df, report = read_any(spark, put(tmp_path, "alpha,beta\n1,x\n2,y\n"))
    assert report.metrics["csv_mode"] == "strict" and not report.warnings
    assert dict(df.dtypes)["alpha"] == "bigint" and df.count() == 2


def test_ragged_csv(spark, tmp_path):
    df, report = read_any(spark, put(tmp_path, "id,name,score\n1,a,1\n2,b,2,x,y\n3,c\n4,d,4\n5,e,5\n"))
    assert (df.count(), report.metrics["csv_mode"], report.metrics["malformed_lines"]) == (5, "tolerant", 2)
    assert df.where("id = '3'").first()["score"] is None


def test_open_quote(spark, tmp_path):
    df, report = read_any(spark, put(tmp_path, 'id,t\n1,"broken quote here\n2,fine\n3,too\n'))
    assert report.metrics["csv_mode"] == "tolerant-unquoted" and df.count() == 3
    assert df.where("id = '1'").first()["t"] == '"broken quote here'


@pytest.mark.parametrize("encoding", ["utf-16", "utf-16-le", "utf-32", "latin-1", "utf-8-sig"])
def test_encodings(spark, tmp_path, encoding):
    df, _ = read_any(spark, put(tmp_path, "città,n\nperché,1\nnoël,2\n", encoding=encoding))
    assert set(df.columns) >= {"città", "n"} and sorted(r["n"] for r in df.collect()) == [1, 2]


@pytest.mark.parametrize(("text", "want"), [("a,b\n1.0,x\n", True), ("nome,valore\nanna,10\n", True), ("1,2\n3,4\n", False)])
def test_headers(text, want):
    assert sniff.detect_header(text.splitlines(), ",") is want


def test_preamble(spark, tmp_path):
    df, _ = read_any(spark, put(tmp_path, "Some title of a table\nYear,Jan,Feb,Mar\n1880,1,2,3\n1881,1,2,***\n1882,4,5,6\n"))
    assert df.count() == 3 and df.where("Mar IS NULL").count() == 1


def test_delimiters():
    assert sniff.detect_delimiter(["id;name, surname;score", "1;a, b;2", "2;c, d;3"]) == ";"


def test_excel(spark, tmp_path):
    p = tmp_path / "b.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" r:id="r1"/><sheet name="two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>')
        for n, v in (("a", "id"), ("b", "rev")):
            z.writestr(f"xl/worksheets/{n}.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>{v}</t></is></c></row><row><c r="A2"><v>1</v></c></row><row><c r="A3"><v>2</v></c></row></sheetData></worksheet>')
    df, report = read_any(spark, str(p))
    assert report.warnings and sorted(r["id"] for r in df.collect()) == [1, 2]
    from quern.config import CleanConfig

    with pytest.raises(ValueError, match="no sheet"):
        read_any(spark, str(p), CleanConfig(excel_sheet="none"))


def test_sql_and_round_trip(spark, tmp_path):
    spark.range(5).createOrReplaceTempView("five")
    df, _ = read_any(spark, ":memory:", query="SELECT id FROM five WHERE id > 1")
    assert df.count() == 3
    for name in ("o.parquet", "o.csv", "o.json"):
        assert read_any(spark, write_output(df, str(tmp_path / name)))[0].count() == 3


def test_null_variants():
    assert {"na", "NA", "Na"} <= set(null_variants(("na",)))


cells = st.text(st.characters(codec="utf-8", exclude_characters="\r\n\x00", exclude_categories=["Cs"]), max_size=6)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(cells, min_size=1, max_size=5), min_size=1, max_size=10), st.sampled_from(sniff.DELIMITERS), st.sampled_from(["utf-8", "utf-16", "latin-1"]))
def test_sniffing_never_fails(tmp_path, rows, separator, encoding):
    p = tmp_path / "x.csv"
    p.write_bytes("\n".join(separator.join(r) for r in rows).encode(encoding, "replace"))
    got = sniff.profile_source(p)
    assert got.separator in sniff.DELIMITERS or got.fmt != "csv"
