"""CSV records with line breaks in quotes, read in splits, and lossless reads."""

import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablelens.sources import csv_records, files

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    old, old_open = spark.conf.get(SPLIT), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(SPLIT, "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set(SPLIT, old)
    spark.conf.set("spark.sql.files.openCostInBytes", old_open)


def written(rows, ending="\n"):
    text = io.StringIO()
    csv.writer(text, lineterminator=ending).writerows(rows)
    return text.getvalue()


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, small_splits, ending):
    rows = [(i, f'line one of {i}\nsays "hi, {i}"\n\nend' if i % 3 else f"plain {i}", "x" * (i % 90)) for i in range(600)]
    rows[300] = (300, "\n".join(f'row {k}, "quoted"' for k in range(400)), "a record longer than several splits")
    path = tmp_path / "big.csv"
    path.write_text(written([("k", "text", "pad"), *rows], ending), newline="")
    df = files.read_csv(spark, str(path))
    assert csv_records.records(spark, str(path)).rdd.getNumPartitions() > 20
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(k, t, p or None) for k, t, p in rows]


def test_several_files_and_a_header_with_a_break(spark, tmp_path, small_splits):
    for part in range(3):
        rows = [(part * 100 + i, f"a\nb{i}" if i % 2 else "c") for i in range(100)]
        (tmp_path / f"part{part}.csv").write_text(written([("k", "two\nlines"), *rows]))
    df = files.read_csv(spark, str(tmp_path))
    assert df.columns == ["k", "two\nlines"] and df.count() == 300
    assert {r[0] for r in df.collect()} == set(range(300))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text('ab",\n', max_size=6), min_size=1, max_size=4), min_size=1, max_size=6))
def test_states_agree_with_a_csv_writer(rows):
    text = written(rows)
    lines = text.split("\n")[:-1]
    inside, count = False, 0
    for line in lines:
        inside = csv_records.ends_inside(line, inside)
        count += not inside
    assert not inside and count == len(rows)


def test_quotes_inside_unquoted_fields_do_not_open_one(spark, tmp_path):
    assert not csv_records.ends_inside('5" pipe,b', False)
    (tmp_path / "q.csv").write_text('k,v\n1,5" pipe\n2,"a\nb"\n3,6"x\n')
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "q.csv")).collect()) == [(1, '5" pipe'), (2, "a\nb"), (3, '6"x')]


@pytest.mark.parametrize("record", ["3,4" + "," * 17 + "X", "3,4,", '3,"4,5",6', "3" + "," * 400 + "X"])
@pytest.mark.parametrize("extra", ["", '5,"a\nb"\n'])
def test_records_with_too_many_fields_raise_at_any_distance(spark, tmp_path, record, extra):
    (tmp_path / "long.csv").write_text(f"a,b\n1,2\n{extra}{record}\n")
    with pytest.raises(ValueError, match="header has 2"):
        files.read_csv(spark, str(tmp_path / "long.csv"))


def test_short_records_and_empty_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text('a,b,c\n1,"x\ny"\n\n2,z,3\n')
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "s.csv")).collect()) == [(1, "x\ny", None), (2, "z", 3)]
    (tmp_path / "h.csv").write_text('a,"b\nc"\n')
    assert files.read_csv(spark, str(tmp_path / "h.csv")).count() == 0
