import csv
import io

import pandas as pd
import pytest

from titlesieve.operators.columns import find_title_column, map_columns, require_columns, to_canonical
from titlesieve.plans.flows import deduplicate_export
from titlesieve.sources.readers import NULL_TOKENS, describe_source, read_papers, resolve_source
from titlesieve.sources.writers import export_nonempty, write_csv, write_triage

HEADER = ["Authors", "Title", "Year", "Source title", "Abstract", "DOI"]
ROWS = [
    ["Ann; Bob", "Plain title", "2020", "Journal", "Text", "10.1/a"],
    ["Ann", 'Quoted "title", with comma', "2020.0", "Journal", "Two\nlines\n\nand a blank one", "10.1/b"],
    ["", "None", "", "NA", "null", "n/a"],
    ["  Ann ", "  outer blanks ", " 2019 ", "back\\slash", "quote at end\"", "'"],
    ["Ann", "Plain title", "2021.9", "Journal", "Ünïcödé — 文", "10.1/c"],
]


def write_text(path, header, rows, bom=False):
    buffer = io.StringIO()
    csv.writer(buffer).writerows([header, *rows])
    path.write_text(buffer.getvalue(), encoding="utf-8-sig" if bom else "utf-8", newline="")
    return str(path)


def cells(df, columns):
    return [[row[c] for c in columns] for row in sorted(df.collect(), key=lambda row: row.row_id)]


def as_pandas_reads(path):
    pdf = pd.read_csv(path, dtype=str)
    return list(pdf.columns), pdf.astype(object).where(pdf.notna(), None).values.tolist()


@pytest.mark.parametrize("bom", [False, True])
def test_reads_like_pandas(spark, tmp_path, bom):
    path = write_text(tmp_path / "a.csv", HEADER, ROWS, bom)
    columns, expected = as_pandas_reads(path)
    df = read_papers(spark, path)
    assert df.columns == ["row_id", *columns]
    assert cells(df, columns) == expected
    assert [row.row_id for row in df.orderBy("row_id").collect()] == list(range(len(ROWS)))


def test_null_tokens(spark, tmp_path):
    rows = [[str(i), token] for i, token in enumerate(NULL_TOKENS)] + [["x", "Nan"]]
    path = write_text(tmp_path / "a.csv", ["key", "Title"], rows)
    df = read_papers(spark, path, row_id=False)
    assert [row.Title for row in df.where("Title IS NOT NULL").collect()] == ["Nan"]
    assert as_pandas_reads(path)[1][-1] == ["x", "Nan"]
    assert read_papers(spark, path, null_tokens=("NA",), row_id=False).where("Title = 'null'").count() == 1


def test_repeated_headers(spark, tmp_path):
    path = write_text(tmp_path / "a.csv", ["Title", "Year", "Title"], [["a", "1", "b"]])
    df = read_papers(spark, path)
    assert df.columns == ["row_id", *as_pandas_reads(path)[0]] == ["row_id", "Title", "Year", "Title.1"]
    assert cells(df, df.columns) == [[0, "a", "1", "b"]]


def test_written_files_read_back_the_same(spark, tmp_path):
    source = write_text(tmp_path / "a.csv", HEADER, ROWS)
    df = read_papers(spark, source)
    write_csv(df.orderBy("row_id").coalesce(1).drop("row_id"), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert as_pandas_reads(part) == as_pandas_reads(source)
    assert cells(read_papers(spark, str(tmp_path / "out")), HEADER) == cells(df, HEADER)


def test_ids_follow_file_order(spark, tmp_path):
    """Files of very different sizes, which Spark packs into tasks by size."""
    expected = []
    for number, size in enumerate([3, 4000, 1, 0, 900, 20]):
        rows = [[f"{number}-{i}", "x" * 50] for i in range(size)]
        write_text(tmp_path / f"{number}.csv", ["Title", "pad"], rows)
        expected += [row[0] for row in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        for multi_line in (True, False):
            df = read_papers(spark, str(tmp_path), multi_line=multi_line)
            rows = sorted(df.collect(), key=lambda row: row.row_id)
            assert [row.row_id for row in rows] == list(range(len(expected)))
            assert [row.Title for row in rows] == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_source_choice(spark, tmp_path):
    assert resolve_source(spark, str(tmp_path / "nowhere")) is None
    assert resolve_source(spark, str(tmp_path)) is None
    write_text(tmp_path / "scopus_export_2.csv", HEADER, ROWS)
    first = write_text(tmp_path / "scopus_export_1.csv", HEADER, ROWS)
    write_text(tmp_path / "other.csv", HEADER, ROWS)
    assert resolve_source(spark, str(tmp_path)) == f"file:{first}"
    best = write_text(tmp_path / "processed_papers.csv", HEADER, ROWS)
    assert resolve_source(spark, str(tmp_path)) == f"file:{best}"


def test_description(spark, tmp_path):
    df = read_papers(spark, write_text(tmp_path / "a.csv", HEADER, ROWS))
    row = describe_source(df, df.where("row_id < 2")).first()
    assert (row.total, row.filtered, row.title_column, row["columns"]) == (5, 2, "Title", HEADER)


def test_column_roles(spark, tmp_path):
    df = read_papers(spark, write_text(tmp_path / "a.csv", HEADER, ROWS))
    assert find_title_column(df) == "Title"
    assert map_columns(df) == {
        "title": "Title", "authors": "Authors", "year": "Year", "abstract": "Abstract", "doi": "DOI",
        "source": "Source title",
    }
    assert map_columns(df, "last")["title"] == "Source title"
    assert find_title_column(df.select("Authors", "Year")) == "Authors"
    with pytest.raises(ValueError):
        map_columns(df.select("Authors"))
    with pytest.raises(ValueError):
        require_columns(df.select("Authors"))
    bare, title, abstract = require_columns(df.select("Source title"))
    assert (title, abstract, bare.first().Abstract) == ("Source title", "Abstract", None)
    canonical = to_canonical(df, map_columns(df)).orderBy("row_id").collect()
    assert [row.year for row in canonical] == [2020, 2020, None, 2019, 2021]
    assert {row.source for row in canonical} == {row["Source title"] for row in df.collect()}


def test_exports(spark, tmp_path):
    df = read_papers(spark, write_text(tmp_path / "a.csv", HEADER, ROWS))
    with pytest.raises(ValueError):
        export_nonempty(df.where("row_id > 99"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    export_nonempty(df, str(tmp_path / "deep" / "er" / "all"), order_by="row_id")
    assert read_papers(spark, str(tmp_path / "deep" / "er" / "all"), row_id=False).count() == 5


def test_triage_folders(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, "keep"), (1, "reject"), (2, None), (3, "keep")], "row_id long, nlp_decision string"
    )
    write_triage(df, str(tmp_path / "t"))
    kept = read_papers(spark, str(tmp_path / "t" / "decision=keep"), row_id=False)
    assert sorted(row.row_id for row in kept.collect()) == ["0", "3"]
    assert read_papers(spark, str(tmp_path / "t"), row_id=False).count() == 4


def test_deduplicate_job(spark, tmp_path):
    source = write_text(tmp_path / "a.csv", HEADER, ROWS)
    report = deduplicate_export(spark, source, str(tmp_path / "out"))
    assert tuple(report.first()) == (5, 1, 4)
    titles = [c[0] for c in cells(read_papers(spark, str(tmp_path / "out")), ["Title"])]
    assert titles == ["Plain title", 'Quoted "title", with comma', None, "  outer blanks "]


def test_awkward_headers(spark, tmp_path):
    header = ["Title", "title", "a.b", "c`d", "e f;{}()=", ""]
    path = write_text(tmp_path / "a.csv", header, [["1", "2", "3", "4", "5", "6"]])
    df = read_papers(spark, path)
    assert df.columns == ["row_id", "Title", "title.1", "a.b", "c`d", "e f;{}()=", "Unnamed: 5"]
    assert tuple(df.first()) == (0, "1", "2", "3", "4", "5", "6")
    taken = write_text(tmp_path / "b.csv", ["Row_ID", "Title"], [["7", "x"]])
    with pytest.raises(ValueError):
        read_papers(spark, taken)
    assert tuple(read_papers(spark, taken, row_id=False).first()) == ("7", "x")


def test_triage_files_keep_the_verdict(spark, frame, tmp_path):
    rows = [(0, "keep", "a"), (1, "reject", "b"), (2, None, "c")]
    write_triage(frame("row_id long, nlp_decision string, title string", rows), str(tmp_path / "t"))
    back = read_papers(spark, str(tmp_path / "t"), row_id=False)
    assert back.columns == ["row_id", "nlp_decision", "title"]
    assert sorted((int(r.row_id), r.nlp_decision, r.title) for r in back.collect()) == rows


def test_nulls_in_one_column(spark, frame, tmp_path):
    write_csv(frame("title string", [("a",), (None,), ("b",)]), str(tmp_path / "one"))
    got = [row.title for row in read_papers(spark, str(tmp_path / "one"), row_id=False).collect()]
    assert sorted(got, key=str) == [None, "a", "b"]


def test_headers_in_other_order_and_surplus_cells_fail(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("Title,Year\nx,1\n")
    (folder / "b.csv").write_text("Year,Title\n2,y\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_papers(spark, str(folder)).collect()
    ragged = tmp_path / "ragged.csv"
    ragged.write_text("Title,Year\na,1\nb,2,extra,more\n")
    with pytest.raises(Exception, match="more cells than headers"):
        read_papers(spark, str(ragged)).collect()
    short = tmp_path / "short.csv"
    short.write_text("Title,Year\na\nb,2\n")
    assert sorted((r.Title, r.Year) for r in read_papers(spark, str(short)).collect()) == [("a", None), ("b", "2")]


@pytest.mark.parametrize("multi_line", [True, False])
def test_a_row_too_wide_fails_whatever_is_selected(spark, tmp_path, multi_line):
    (tmp_path / "x.csv").write_text("Title,Year\na,1\nb,2,extra,more\n,3,x\n")
    papers = read_papers(spark, str(tmp_path / "x.csv"), row_id=False, multi_line=multi_line)
    for use in (papers.select("Year"), papers.select("Title"), papers):
        with pytest.raises(Exception, match="more cells than headers"):
            use.collect()
    with pytest.raises(Exception, match="more cells than headers"):
        papers.count()


def test_repeated_headers_are_compared_between_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title,Title,Year\nx,y,1\n")
    (tmp_path / "b.csv").write_text("Title,Title,Year\nv,w,2\n")
    assert read_papers(spark, str(tmp_path), row_id=False).count() == 2
    (tmp_path / "c.csv").write_text("Year,Title,Title\n3,t,u\n")
    with pytest.raises(ValueError, match="different headers"):
        read_papers(spark, str(tmp_path), row_id=False)
