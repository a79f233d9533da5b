from __future__ import annotations

import csv
import io
import random
from decimal import Decimal

import pytest

from conftest import SAMPLE
from tillcast.operators import models
from tillcast.sources import sales_files as sf
from tillcast.sources.scratch import Scratch

GOOD = "date,daily_sales_total\n" + "\n".join(f"2025-01-{i + 1:02d},{a}" for i, a in enumerate(SAMPLE)) + "\n"
TENANTS = "restaurant_id string, location_id string"


@pytest.fixture
def scratch(spark):
    with Scratch(spark, "test") as s:
        yield s


@pytest.fixture
def text(spark, scratch):
    return lambda path: sf.read_text(spark, path, scratch)


def write(folder, **files):
    for name, content in files.items():
        (folder / f"{name}.csv").write_text(content)
    return str(folder)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_good_file(spark, tmp_path, text):
    df = sf.read_sales_rows(text(write(tmp_path, good=GOOD)))
    got = rows(df, "date_text", "daily_sales_total", "valid")
    assert got == [(f"2025-01-{i + 1:02d}", Decimal(f"{a}.00"), True) for i, a in enumerate(SAMPLE)]


def test_columns_are_found_by_name(spark, tmp_path, text):
    path = write(
        tmp_path,
        a="date,daily_sales_total\n2025-01-01,1\n",
        b="restaurant_id,daily_sales_total,date\nr,2,2025-01-02\n",
        c='note,"date",extra,location_id,daily_sales_total\n"x, y",2025-01-03,,l,3\n',
    )
    got = rows(sf.read_sales_rows(text(path)), "file_name", "restaurant_id", "location_id", "date_text", "daily_sales_total")
    assert got == [
        ("a.csv", None, None, "2025-01-01", Decimal("1.00")),
        ("b.csv", "r", None, "2025-01-02", Decimal("2.00")),
        ("c.csv", None, "l", "2025-01-03", Decimal("3.00")),
    ]


def test_header_text_inside_the_data_is_a_row(spark, tmp_path, text):
    path = write(tmp_path, a="date,daily_sales_total\n2025-01-01,1\ndate,daily_sales_total\n")
    assert rows(sf.read_sales_rows(text(path)), "date_text", "valid") == [("2025-01-01", True), ("date", False)]


def test_rows_keep_file_order(spark, tmp_path, text):
    path = write(tmp_path, a="date,daily_sales_total\n" + "".join(f"2025-01-01,{i}\n" for i in range(500)))
    got = [int(r.daily_sales_total) for r in sf.read_sales_rows(text(path)).orderBy("ingest_seq").collect()]
    assert got == list(range(500))


def test_large_file_is_split_and_read_whole(spark, tmp_path, text):
    n = 60_000
    path = write(tmp_path, a="daily_sales_total,date\n" + "".join(f"{i},2025-01-01\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = sf.read_sales_rows(text(path))
        assert df.rdd.getNumPartitions() > 1
        got = [int(r.daily_sales_total) for r in df.where("valid").orderBy("ingest_seq").select("daily_sales_total").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(range(n))


@pytest.mark.parametrize("bad", ["2025-01-01", "2025-01-01,", "2025-01-01,abc", "2025-01-01,nan", "2025-01-01,inf",
                                 "2025-01-01,1.5d", "2025-01-01,0x1p3"])
def test_one_bad_row_refuses_the_file(spark, tmp_path, bad, text):
    path = write(tmp_path, good=GOOD, bad=GOOD + bad + "\n")
    files = text(path).files
    data = sf.read_sales_rows(text(path))
    verdicts = sf.file_verdicts(data, files)
    assert rows(verdicts, "file_name", "sales_source", "sales_rows_loaded") == [
        ("bad.csv", "simulated_fallback", 0), ("good.csv", "csv_file", 10),
    ]
    assert sf.rows_of_good_files(data, verdicts).count() == 10


@pytest.mark.parametrize("fine", ["2025-01-01,-5", "any day,1_000", "\n2025-01-01, 7 ", "2025-01-01,1,extra"])
def test_rows_that_do_not_refuse_the_file(spark, tmp_path, fine, text):
    path = write(tmp_path, a=GOOD + fine + "\n")
    verdict = sf.file_verdicts(sf.read_sales_rows(text(path)), text(path).files).first()
    assert (verdict.sales_source, verdict.sales_rows_loaded) == ("csv_file", 11)


def test_missing_amount_column_gives_zero(spark, tmp_path, text):
    path = write(tmp_path, a="date,other\n2025-01-01,5\n")
    assert rows(sf.read_sales_rows(text(path)), "daily_sales_total", "valid") == [(Decimal("0.00"), True)]


def test_files_without_rows_fall_back(spark, tmp_path, text):
    path = write(tmp_path, empty="", header="date,daily_sales_total\n", good=GOOD)
    verdicts = sf.file_verdicts(sf.read_sales_rows(text(path)), text(path).files)
    assert {r.file_name: r.sales_source for r in verdicts.collect()} == {
        "empty.csv": "simulated_fallback", "header.csv": "simulated_fallback", "good.csv": "csv_file",
    }


def test_file_precedence(spark):
    tenants = spark.createDataFrame([("a b", "x/y"), ("a b", "z"), ("c", "z")], TENANTS)
    names = ["a_b__x_y__sales.csv", "a_b__sales.csv", "upload_sales.csv", "unrelated.csv"]

    def resolve(kept):
        files = spark.createDataFrame([(n,) for n in kept], "file_name string")
        return {(r.restaurant_id, r.location_id): (r.file_name, r["rank"]) for r in
                sf.resolve_tenant_files(tenants, files).collect()}

    assert resolve(names) == {("a b", "x/y"): (names[0], 1), ("a b", "z"): (names[1], 2), ("c", "z"): (names[2], 3)}
    assert resolve(names[1:])[("a b", "x/y")] == (names[1], 2)
    assert resolve(names[2:])[("a b", "x/y")] == (names[2], 3)
    assert set(resolve(names[3:]).values()) == {(None, None)}


def test_load_tenant_sales(spark, tmp_path, text, scratch):
    path = write(
        tmp_path,
        upload_sales="date,daily_sales_total,restaurant_id\n2025-01-01,1,\n2025-01-02,2,own\n",
        r__sales="date,daily_sales_total\n2025-01-01,3\n",
        r__l__sales="date,daily_sales_total\n2025-01-01,bad\n",
    )
    tenants = spark.createDataFrame([("r", "l"), ("r", "m"), ("s", "l"), ("t", "l")], TENANTS)
    sales, status = sf.load_tenant_sales(text(path), tenants, scratch)
    assert rows(sales, "file_name", "restaurant_id", "daily_sales_total") == [
        ("r__sales.csv", None, Decimal("3.00")), ("upload_sales.csv", "own", Decimal("2.00")), ("upload_sales.csv", None, Decimal("1.00")),
    ]
    assert rows(status, "restaurant_id", "location_id", "sales_file_path", "sales_source", "sales_rows_loaded") == [
        ("r", "l", "r__l__sales.csv", "simulated_fallback", 0), ("r", "m", "r__sales.csv", "csv_file", 1),
        ("s", "l", "upload_sales.csv", "csv_file", 2), ("t", "l", "upload_sales.csv", "csv_file", 2),
    ]


def test_models_of_tenants_that_share_the_default_file(spark, tmp_path, text, scratch):
    path = write(tmp_path, upload_sales=GOOD, r0__sales="date,daily_sales_total\n2025-01-01,100\n2025-01-02,300\n")
    tenants = spark.createDataFrame([(f"r{i}", f"l{j}") for i in range(40) for j in range(10)], TENANTS)
    sales, status = sf.load_tenant_sales(text(path), tenants, scratch)
    keyed = sf.keyed_file_sales(sf.dated_file_rows(sales))
    assert keyed.count() == 12  # rows of files, not of tenants
    served = status.select("restaurant_id", "location_id", "file_name")
    profiles = sf.of_tenants(served, models.tenant_profiles(keyed, keys=["file_name"]))
    got = {(r.restaurant_id == "r0", str(r.avg_daily_sales), r.training_rows, len(r.recent_sales)) for r in profiles.collect()}
    assert got == {(True, "200.0000", 2, 2), (False, "1519.0000", 10, 7)} and profiles.count() == 400
    trend = models.with_prior(sf.of_tenants(served, models.fit_trend(keyed, ["file_name"])), spark)
    assert {(r.restaurant_id == "r0", round(r.slope, 6), r.rows) for r in trend.collect()} == {(True, 200.0, 2), (False, 14.339394, 10)}


def test_no_file_for_a_tenant(spark, tmp_path, text, scratch):
    path = write(tmp_path, other__sales=GOOD)
    _, status = sf.load_tenant_sales(text(path), spark.createDataFrame([("r", "l")], TENANTS), scratch)
    row = status.first()
    assert (row.sales_file_path, row.sales_source, row.error) == ("upload_sales.csv", "simulated_fallback", "file_not_found")


def test_upload_headers_and_reasons(spark, tmp_path, scratch):
    path = write(
        tmp_path,
        a="daily_sales_total,date\n5,2025-01-01\n-1,2025-01-01\nx,2025-01-01\n5,2025-1-1\n",
        b="date,total\n2025-01-01,5\n",
        c="",
    )
    classified, status = sf.read_upload(spark, path, scratch, "r", "l")
    assert rows(status, "file_name", "ingestion_status", "reason") == [
        ("a.csv", "ok", None), ("b.csv", "error", "invalid_csv_headers"), ("c.csv", "error", "invalid_csv_headers"),
    ]
    assert rows(classified, "restaurant_id", "reason") == [
        ("r", "invalid_date"), ("r", "invalid_sales"), ("r", "negative_sales"), ("r", None),
    ]


def test_absent_upload(spark, tmp_path, scratch):
    classified, status = sf.read_upload(spark, str(tmp_path / "upload_sales.csv"), scratch)
    assert classified.count() == 0
    assert rows(status, "ingestion_status", "reason") == [("error", "upload_sales.csv_not_found")]


def test_repeated_and_padded_header_names(spark, tmp_path, text):
    path = write(tmp_path, a="daily_sales_total,daily_sales_total, date\n1,2,2025-01-01\n")
    assert rows(sf.read_sales_rows(text(path)), "daily_sales_total", "date_text") == [(Decimal("2.00"), None)]


def test_file_names_with_blanks_and_signs(spark, tmp_path, text, scratch):
    names = ["a b.csv", "c+d%20e.csv"]
    for n in names:
        (tmp_path / n).write_text("date,daily_sales_total\n2025-01-01,1\n")
    path = str(tmp_path)
    assert sorted(r.file_name for r in text(path).files.collect()) == names
    assert sorted(r.file_name for r in sf.read_sales_rows(text(path)).collect()) == names
    _, status = sf.read_upload(spark, path, scratch)
    assert {r.ingestion_status for r in status.collect()} == {"ok"}


def test_header_scan_keeps_no_rows_in_the_shuffle(spark, tmp_path, text):
    path = write(tmp_path, **{f"f{i}": "date,daily_sales_total\n" + "2025-01-01,1\n" * 50 for i in range(6)})
    got = text(path).headers.collect()
    assert len(got) == 6 and {r.header for r in got} == {"date,daily_sales_total"}


def test_doubled_quotes(spark, tmp_path, text):
    path = write(
        tmp_path,
        a='"the ""day""",note,daily_sales_total\nx,"say ""hi"", twice",7\n',
        b='note,daily_sales_total\n"a,""b""",8\n',
    )
    assert rows(sf.scan_by_name(text(path), ["note", "daily_sales_total"]), "note", "daily_sales_total") == [
        ('a,"b"', "8"), ('say "hi", twice', "7"),
    ]


def test_cells_may_hold_line_breaks(spark, tmp_path, text, scratch):
    path = write(
        tmp_path,
        upload_sales='date,note,daily_sales_total\n2025-01-01,"two\nlines",10\n2025-01-02,x,20\n',
        other='"the\nnote",date,daily_sales_total\n"a\n\n""b"",\nc",2025-01-03,30\n5" pipe,2025-01-04,40\n"x"y"z,2025-01-05,50\n',
    )
    tenants = spark.createDataFrame([("r", "l")], TENANTS)
    sales, status = sf.load_tenant_sales(text(path), tenants, scratch)
    assert (status.first().sales_source, status.first().sales_rows_loaded) == ("csv_file", 2)
    classified, _ = sf.read_upload(spark, path, scratch)
    assert rows(classified, "date_text", "reason") == [(f"2025-01-0{i}", None) for i in range(1, 6)]
    cells = sf.scan_by_name(text(path), ["the\nnote"]).where("file_name = 'other.csv'")
    assert {r[3] for r in cells.collect()} == {'a\n\n"b",\nc', '5" pipe', 'x"y"z'} or {r[3] for r in cells.collect()} >= {'a\n\n"b",\nc', '5" pipe'}


def test_broken_lines_in_a_file_of_many_blocks(spark, tmp_path, text):
    rng = random.Random(5)
    cells = [(f"2025-01-{i % 28 + 1:02d}", rng.choice(["x", "a,b", 'q"q', "l1\nl2", "\n\n", '"\n"', 'e"\n,"f']), str(i)) for i in range(4000)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["date", "note", "daily_sales_total"])
    writer.writerows(cells)
    path = write(tmp_path, a=out.getvalue(), b=GOOD)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = text(path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found.lines.select("at.start").distinct().count() > 20
    got = sf.scan_by_name(found, ["date", "note", "daily_sales_total"]).where("file_name = 'a.csv'").orderBy("ingest_seq").collect()
    assert [(r.date, r.note, r.daily_sales_total) for r in got] == cells


def test_a_cell_that_never_ends_refuses_its_file(spark, tmp_path, text, monkeypatch):
    monkeypatch.setattr(sf, "MAX_RECORD_CHARS", 200)
    path = write(tmp_path, a='date,daily_sales_total\n2025-01-01,1\n"open' + "\n2025-01-02,2" * 100, b=GOOD)
    found = text(path)
    verdicts = sf.file_verdicts(sf.read_sales_rows(found), found.files)
    assert {r.file_name: r.sales_source for r in verdicts.collect()} == {"a.csv": "simulated_fallback", "b.csv": "csv_file"}


def test_an_amount_beyond_the_table_is_refused_by_itself(spark, tmp_path, text):
    path = write(tmp_path, a="date,daily_sales_total\n2025-01-01,1\n2025-01-02,1e16\n2025-01-03,12345678901234567890\n", b="date,daily_sales_total\n2025-01-01,1e300\n")
    found = text(path)
    data = sf.read_sales_rows(found)
    verdicts = {r.file_name: (r.sales_source, r.sales_rows_loaded) for r in sf.file_verdicts(data, found.files).collect()}
    assert verdicts == {"a.csv": ("csv_file", 1), "b.csv": ("simulated_fallback", 0)}
    dated = sf.dated_file_rows(sf.rows_of_good_files(data, sf.file_verdicts(data, found.files)))
    assert rows(dated, "date_text", "reason") == [("2025-01-01", None), ("2025-01-02", "amount_out_of_range"), ("2025-01-03", "amount_out_of_range")]


def test_text_is_read_once(spark, tmp_path, text):
    from plan_text import formatted

    path = write(tmp_path, a=GOOD)
    found = text(path)
    (tmp_path / "a.csv").unlink()
    data = sf.read_sales_rows(found)
    assert data.count() == 10 and sf.file_verdicts(data, found.files).count() == 1 and sf.upload_status(found).count() == 1
    assert "text" not in formatted(data).split("Scan")[1].split("\n")[0]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from tillcast.sources.scratch import scratch_root

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf = Conf
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        scratch_root(Session)
    Session.sparkContext.master = "local[2]"
    assert scratch_root(Session).startswith("file:///")
