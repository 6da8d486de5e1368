"""Quoted line breaks in delimited files."""

import pytest

from seatmetrics.sources import files


@pytest.mark.parametrize("mark, encoding", [(b"", "utf-8"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le")])
@pytest.mark.parametrize("cell", ["first\nsecond", 'say ""x"",\nthen', "one\n\nthree"])
def test_quoted_line_break_stays_in_its_cell(spark, tmp_path, mark, encoding, cell):
    path = tmp_path / "usage.csv"
    path.write_bytes(mark + f'Feature,Note,In Use\na,"{cell}",1\nb,plain,2\n'.encode(encoding))
    rows = sorted(tuple(r) for r in files.read_delimited(spark, str(path)).collect())
    assert rows == [("a", cell.replace('""', '"'), "1", 2), ("b", "plain", "2", 3)]


@pytest.mark.parametrize(
    "text, want",
    [("a,b\n1,2\n", False), ('"a","b ""c"", d"\n"1",\n', False), ('a,"b\nc"\n', True), ('a"b,"x\ny",c"d\n', True), ('5",1,"x\ny",6"\n', True)],
)
def test_only_proven_files_are_split(spark, tmp_path, text, want):
    path = tmp_path / "f.csv"
    path.write_text(text)
    assert files.breaks_in_cells(spark, str(path), ",") == want
    path.write_text(text.replace(",", "|"))
    assert files.breaks_in_cells(spark, str(path), "|") == want
