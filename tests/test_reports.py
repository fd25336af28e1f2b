"""Report files of several separators in one folder."""

import pytest

from tracewell.sources import catalog


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text('Sp Name,TABLE_NAME\nx,"T;1;2;3"\ny,n/a\n')
    (tmp_path / "b.csv").write_text('sp_name;Table Name\n"p,q";T2\n"r,s,t";T3\n')
    (tmp_path / "c.tsv").write_text("SP_NAME\tother\nz\t1, 2; 3\n")
    (tmp_path / "d.csv").write_text("sp_name\nalone\n")
    (tmp_path / "e.csv").write_text("")
    return str(tmp_path)


def test_separators_are_told_apart(spark, folder):
    layouts = {r.file.rsplit("/", 1)[-1]: r.separator for r in catalog.file_layouts(spark, folder).collect()}
    assert {k: layouts[k] for k in ("a.csv", "b.csv", "c.tsv")} == {"a.csv": ",", "b.csv": ";", "c.tsv": "\t"} and "e.csv" not in layouts
    got = sorted((r.sp_name, r.table_name, r.other) for r in catalog.report_read(spark, folder).collect())
    assert got == [("alone", "", ""), ("p,q", "T2", ""), ("r,s,t", "T3", ""), ("x", "T;1;2;3", ""), ("y", "", ""), ("z", "", "1, 2; 3")]


def test_no_report(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert catalog.report_read(spark, str(tmp_path)).count() == 0
