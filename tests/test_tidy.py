"""Row rules, periods, sex classes and sources on small hand-made tables."""

import datetime as dt
import gzip
import os

import pytest
from pyspark.sql import functions as F

from resight.operators import clean, histories as H, periods, reshape, sex, stats
from resight.operators.schema import FINAL_COLUMNS, RAW_COLUMNS, STRATA_SCHEMA, STRATA_BY_SEX
from resight.plans import tidy as T
from resight.sources import sectioned, sheets, statistics

D = dt.date


def sheet(**kw):
    base = dict(Return_Yr="2013", SPECIES="salmon", TagDate="7-Oct-13", TagReach="Reach 2", Tag1="A1", Sex="Male", FL="70", SampleRate="1")
    return {c: kw.get(c, base.get(c)) for c in RAW_COLUMNS}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in RAW_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in RAW_COLUMNS))


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_flags_and_check(spark):
    df = frame(spark, [
        sheet(RecapTag1="A1", RecapDate="14-Oct-13", RecapReach="Reach 1"),
        sheet(Tag1=None),
        sheet(Tag1=None, Tag2="B", RecapReach="somewhere"),
        sheet(SPECIES=None),
    ])
    out = T.formatted(df, "here", ["salmon"])
    assert rows_of(out, "Tagged", "Recap", "check", "TagState", "RecapState") == sorted(
        [(1, 1, -1, 2, 1), (0, None, 1, 2, None), (1, 0, 1, 2, None)], key=str
    )
    assert out.columns[:3] == ["Location", "Return_Yr", "Species"]


def test_sex_rules(spark):
    cases = [  # Sex, SampleRate, Max_Rate, Comments, FL -> class
        (None, "1", 1.0, None, None, "Adult"), ("Unk", "1", 1.0, None, None, "Adult"), ("Female", "1", 9.0, "jacks", "40", "Female"),
        ("Jack", "1", 1.0, None, "80", "Jack"), ("Male", "1", 3.0, None, "80", "Jack"), ("Male", "2", 3.0, "jacks", "80", "Jack"),
        ("Male", "2", 3.0, None, "40", "Male"), ("Male", None, 3.0, None, "60", "Male"), ("Male", "1", 1.0, None, "59", "Jack"),
        ("Male", "1", 1.0, None, None, "Male"), ("Male", None, 3.0, None, "50", "Need.Another.Category"), ("Male", "1", 1.0, None, "100", "Male"),
    ]
    df = spark.createDataFrame(cases, "Sex string, SampleRate string, Max_Rate double, Comments string, FL string, want string")
    assert sex.classify_sex(df).where("Sex_Temp != want").collect() == []
    # compared as text, 100 is below 59
    lexical = sex.classify_sex(df, compare="lexical").where("FL = '100'").first()
    assert lexical.Sex_Temp == "Jack"


def dates(spark):
    rows = [("2013", D(2013, 10, 6)), ("2013", D(2013, 10, 8)), ("2013", D(2013, 10, 13)), ("2013", D(2013, 11, 5)), ("2014", D(2014, 10, 9)), ("2014", D(2013, 11, 5))]
    return spark.createDataFrame(rows, "Return_Yr string, Date_Maiden date").withColumn("Date_Recap", F.lit(None).cast("date"))


def test_periods(spark):
    master, by_date = periods.create_periods(dates(spark))
    got = rows_of(master, "Year", "Period", "Date_Min", "Date_Mid", "Days_Btw_Periods", "MidDate_Btw_Periods")
    # 6 and 8 October share a week; its middle is a day before the last date
    assert got[0] == (2013, 1, D(2013, 10, 6), D(2013, 10, 7), None, D(2013, 10, 10))
    assert got[1] == (2013, 2, D(2013, 10, 13), D(2013, 10, 13), 6.0, D(2013, 10, 13) + dt.timedelta(days=12))
    # years follow one another in one sequence: 23 days, then 0, then 338; the median closes it
    assert [r[4] for r in got] == [None, 6.0, 23.0, 0.0, 338.0]
    assert got[-1][5] == D(2014, 10, 9) + dt.timedelta(days=7)
    within = periods.period_gaps(master.drop("Days_Btw_Periods", "MidDate_Btw_Periods", "Year_Period"), within_year=True)
    assert [r[0] for r in rows_of(within.where("Year = 2014 and Period = 1"), "Days_Btw_Periods")] == [None]
    assert by_date.count() == 6


def test_date_in_two_years(spark):
    df = dates(spark)
    _, by_date = periods.create_periods(df)
    assert periods.attach_periods(df, by_date).count() == 6
    # without the year, the shared date matches twice for both of its rows
    assert periods.attach_periods(df, by_date, by_year=False).count() == 8


def test_range_lookup_takes_first_period(spark):
    p = spark.createDataFrame([(2013, 1, D(2013, 1, 2), D(2013, 12, 30)), (2013, 2, D(2013, 5, 1), D(2013, 5, 6))], "Year int, Period int, Date_Min date, Date_Max date")
    d = spark.createDataFrame([(2013, D(2013, 5, 3)), (2013, D(2013, 1, 1)), (2013, D(2013, 9, 9))], "Year int, Date date")
    assert rows_of(periods.assign_period(d, p), "Date", "Period") == [(D(2013, 1, 1), None), (D(2013, 5, 3), 1), (D(2013, 9, 9), 1)]


def test_ratios_fill_missing_periods(spark):
    rows = [("2013", 1, "2013_1", "Male", 1)] * 3 + [("2013", 1, "2013_1", "Female", 1)] + [("2013", 2, "2013_2", "Male", 0)]
    df = spark.createDataFrame(rows, "Return_Yr string, Period_Cap int, Year_Period string, Sex_Temp string, Tagged int")
    p = spark.createDataFrame([(2013, 1, "2013_1"), (2013, 2, "2013_2")], "Year int, Period int, Year_Period string")
    per, total = sex.sex_ratios(df, p)
    want = [("2013_1", 0.75, 0.25, 0.0), ("2013_2", 0.75, 0.25, 0.0)]
    assert rows_of(per, "Year_Period", "Prop_Sex_Male", "Prop_Sex_Female", "Prop_Sex_Jack") == want
    assert total.first().Count_Jack is None
    everyone, _ = sex.sex_ratios(df, p, bio="all", groups="jack_female_male")
    assert rows_of(everyone.where("Year_Period = '2013_2'"), "Prop_Sex_Male", "Prop_Sex_Female") == [(1.0, 0.0)]


def test_imputation_keeps_calls(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "Female").otherwise("Adult").alias("Sex_Temp"), F.lit(0.4).alias("Prop_Sex_Male"), F.lit(0.6).alias("Prop_Sex_Female"), F.lit(0.0).alias("Prop_Sex_Jack"))
    out = sex.impute_category(df, 298, ["id"])
    assert out.where("Sex_Temp = 'Female' and Sex_final != 'Female'").count() == 0
    assert out.where("Sex_final = 'Jack'").count() == 0
    assert out.repartition(7).exceptAll(out).count() == 0


def test_strata(spark):
    lut = spark.createDataFrame(STRATA_BY_SEX, STRATA_SCHEMA)
    df = spark.createDataFrame([("Jack",), ("Female",), (None,)], "Sex_final string")
    assert rows_of(sex.attach_strata(df, lut, 4), "Sex_final", "Strata_Name") == sorted([("Female", "Pooled"), ("Jack", None), (None, None)], key=str)


def write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_folder_of_sheets(spark, tmp_path):
    write(tmp_path / "y2013.csv", "Return_Yr,SPECIES,Tag1,Comments\n2013,salmon,A1,\"big, old\"\n2013,,,\n")
    write(tmp_path / "y2014.csv", "Tag1,Crew,Return_Yr\nB1,x,2014\n")
    cols = ["Return_Yr", "SPECIES", "Tag1", "Comments"]
    got = rows_of(sheets.read_csv_dir(spark, str(tmp_path), cols), *cols)
    assert got == sorted([("2013", "salmon", "A1", "big, old"), ("2013", None, None, None), ("2014", None, "B1", None)], key=str)
    assert set(sheets.read_csv_dir(spark, str(tmp_path)).columns) == {*cols, "Crew"}
    names = {r["file"]: r["columns"] for r in sheets.column_report(spark, str(tmp_path)).collect()}
    assert names["y2014.csv"] == "Tag1, Crew, Return_Yr"
    diff = {r["file"]: r["extra_columns"] for r in sheets.column_diff(spark, str(tmp_path)).collect()}
    assert diff == {"y2013.csv": "", "y2014.csv": "Crew"}


def test_quotes_in_sheets(spark, tmp_path):
    write(tmp_path / "q.csv", '"Return_Yr","Comments, all",Tag1\n2013,"said ""no"", twice\nthen left",A\n')
    df = sheets.read_csv_dir(spark, str(tmp_path), multiline=True)
    assert df.columns == ["Return_Yr", "Comments, all", "Tag1"]
    assert tuple(df.first()) == ("2013", 'said "no", twice\nthen left', "A")


def test_unreadable_file_is_skipped(spark, tmp_path):
    write(tmp_path / "a.csv", "Return_Yr,Tag1\n2013,A1\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("Return_Yr,Tag1\n2014,B1\n")
    whole = (tmp_path / "b.csv.gz").read_bytes()
    (tmp_path / "c.csv.gz").write_bytes(b"\x1f\x8b" + os.urandom(40))
    (tmp_path / "b.csv.gz").write_bytes(whole)
    layouts = [(["Return_Yr", "Tag1"], [str(tmp_path / n) for n in ("a.csv", "b.csv.gz", "c.csv.gz")])]
    df = sheets.read_csv_tolerant(spark, str(tmp_path), layouts=layouts)
    assert rows_of(df, "source_file", "Return_Yr", "Tag1") == [("a.csv", "2013", "A1"), ("b.csv.gz", "2014", "B1")]


SECTIONS = "$s{0}\n3{0}{0}\n$n{0}{0}\n0{0}1{0}0\n0{0}4{0}2\n$age{0}{0}\n,,1{0}{0}\n1{0}0{0}0\n0{0}0{0}7\n,,2{0}{0}\n5{0}6{0}\n"


@pytest.mark.parametrize("sep", [",", "\t"])
def test_sectioned(spark, tmp_path, sep):
    write(tmp_path / "m.txt", SECTIONS.format(sep).replace("$n", "\n$n"))
    got = rows_of(sectioned.read_sectioned(spark, str(tmp_path / "m.txt"), sep), "section", "slice", "row", "col", "value")
    want = [("s", 0, 1, 1, 3.0)]
    want += [("n", 0, 1, 1, 0.0), ("n", 0, 1, 2, 1.0), ("n", 0, 1, 3, 0.0), ("n", 0, 2, 1, 0.0), ("n", 0, 2, 2, 4.0), ("n", 0, 2, 3, 2.0)]
    want += [("age", 1, 1, 1, 1.0), ("age", 1, 1, 2, 0.0), ("age", 1, 1, 3, 0.0), ("age", 1, 2, 1, 0.0), ("age", 1, 2, 2, 0.0), ("age", 1, 2, 3, 7.0)]
    want += [("age", 2, 1, 1, 5.0), ("age", 2, 1, 2, 6.0)]
    assert got == sorted(want, key=str)


def test_sectioned_over_many_splits(spark, tmp_path):
    """The section is carried across input splits."""
    lines = ["$first"] + [str(i) for i in range(1, 3001)] + ["$second"] + [str(-i) for i in range(1, 2001)]
    write(tmp_path / "big.txt", "\n".join(lines) + "\n")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "1000")
        spark.conf.set(keys[1], "0")
        df = sectioned.read_sectioned(spark, str(tmp_path / "big.txt"))
        assert spark.read.text(str(tmp_path / "big.txt")).rdd.getNumPartitions() > 5
        bad = df.where(F.col("row") * F.when(F.col("section") == "first", 1).otherwise(-1) != F.col("value"))
        assert df.count() == 5000 and bad.count() == 0
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)


def test_tidy_table(spark, tmp_path):
    rows = [
        sheet(RecapTag1="A1", RecapDate="14-Oct-13", RecapReach="Reach 3"),
        sheet(Tag1="A2", RecapTag1="A2", RecapDate="7-Oct-13"),
        sheet(Tag1=None, Sex=None),
        sheet(Return_Yr="2014", TagDate="10-Oct-14", Sex="Female", Tag1="C1"),
    ]
    df = T.tidy(frame(spark, rows), "here", ["salmon"])
    assert df.columns == FINAL_COLUMNS
    # the same-day recapture goes, the rest stay
    assert rows_of(df, "Tag1", "Period_Cap", "Period_Recap", "days_between_capture") == sorted(
        [("A1", 1, 2, 7.0), (None, 1, None, None), ("C1", 1, None, None)], key=str
    )
    path = sheets.write_final(df, str(tmp_path), "today")
    assert path.endswith("combined-2013_2014-today")
    assert sheets.read_final(spark, path).exceptAll(df).count() == 0


def test_row_index_is_a_permutation_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit(1).alias("same"))
    got = clean.row_index(df.repartition(6), ["x"]).select("Index", "x").collect()
    assert all(r.Index == r.x + 1 for r in got) and len(got) == 1000
    ties = clean.row_index(df.repartition(6), ["same"]).agg(F.min("Index"), F.max("Index"), F.count_distinct("Index")).first()
    assert tuple(ties) == (1, 1000, 1000)


def test_reach_index(spark):
    df = spark.createDataFrame([("b", "a"), ("a", "z"), ("c", None)], "TagReach string, RecapReach string")
    assert rows_of(H.reach_index(df), "TagReach", "t_l", "r_l") == [("a", 1, None), ("b", 2, 1), ("c", 3, None)]


def test_stats_folder_prunes_years(spark, tmp_path):
    df = spark.createDataFrame([(2013, 1), (2014, 2)], "year int, n int")
    path = statistics.write_js_stats(df, str(tmp_path / "s"))
    got = statistics.read_js_stats(spark, path, [2014])
    assert [r.n for r in got.collect()] == [2]
    assert "PartitionFilters" in got._jdf.queryExecution().toString()


def test_shapes(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "k string, x int, y int")
    long = reshape.to_long(df, ["k"], ["x", "y"])
    assert rows_of(reshape.to_wide(long, ["k"], "variable", ["x", "y"], "value"), "k", "x", "y") == [("a", 1, 2), ("b", 3, 4)]
    nested = spark.createDataFrame([("a", [[1, 2], [3]])], "k string, v array<array<int>>")
    assert rows_of(reshape.melt_array(nested, ["k"], "v", 2), "dim1", "dim2", "value") == [(1, 1, 1), (1, 2, 2), (2, 1, 3)]
    both = reshape.append(df.select("k", "x"), df.select("k", "y"))
    assert both.columns == ["k", "x", "y"] and both.count() == 4
    assert reshape.column_setdiff(df, df.drop("x")) == ["x"]
    cells = spark.createDataFrame([(1, 2, 0), (2, 1, 5), (1, 1, 3)], "r int, c int, value int")
    assert rows_of(reshape.nonzero_cells(cells, "value", "r", "c"), "r", "c", "value") == [(1, 1, 3), (1, 2, None)]


def test_collapse_groups_ignores_bad_numbers(spark):
    df = spark.createDataFrame([(2013, "m", "2013-10-01", "3"), (2013, "f", "2013-10-01", "x"), (2013, "j", "2013-10-01", "4")], "year int, grp string, date string, seen string")
    assert stats.collapse_groups(df, values=("seen",)).first().seen == 7.0


def test_like_rows_have_draws_of_their_own(spark):
    rows = [sheet(Tag1="T" + str(i), Sex=s, FL="70") for i, s in enumerate(["Male", "Female"] * 5)]
    rows += [sheet(Tag1=None, Sex="Unknown", FL=None)] * 1000 + [sheet(Tag1=None, Sex="Unknown", FL=None, Comments="x")] * 500
    out = T.tidy(frame(spark, rows), "here", ["salmon"]).where("Tag1 is null and FL is null")
    n = {r.Sex_final: r["count"] for r in out.groupBy("Sex_final").count().collect()}
    assert sum(n.values()) == 1500 and abs(n["Male"] - 750) < 120


def test_ties_are_numbered_once_each(spark):
    df = spark.createDataFrame([("a", "x")] * 50 + [("a", "y")] * 3 + [("b", None)] * 2 + [(None, "z")], "k string, v string")
    got = {}
    for r in clean.number_ties(df, ["k"], ["v"]).collect():
        got.setdefault(r.k, []).append(r.Row_No)
    assert {k: sorted(v) for k, v in got.items()} == {"a": list(range(1, 54)), "b": [1, 2], None: [1]}


def test_rows_with_tags_of_their_own_are_numbered_where_they_lie(spark, monkeypatch):
    """Same numbers as by gathering all rows; the number of looked-up hashes does not matter."""
    rows = [(f"T{i}", None, "x") for i in range(40)] + [("T1", None, "y"), ("T2", None, "x"), (None, "U", "z"), (None, None, "x"), (None, None, "y"), (None, None, "y"), (None, None, None)]
    df = spark.createDataFrame(rows, "Tag1 string, Tag2 string, v string")
    want = rows_of(clean.number_ties(df, ["Tag1", "Tag2"], ["v"]), "Tag1", "Tag2", "v", "Row_No")
    assert len(want) == len(rows)
    shuffled = []
    for most in (1000, 0):
        monkeypatch.setattr(clean, "BROADCAST_ROWS", most)
        got = clean.number_ties(df, ["Tag1", "Tag2"], ["v"], telling=("Tag1", "Tag2"))
        assert rows_of(got, "Tag1", "Tag2", "v", "Row_No") == want
        shuffled.append("left_anti" in got._jdf.queryExecution().toString().lower().replace("leftanti", "left_anti"))
    assert shuffled == [True, False]


def test_checks_are_counted_once(spark, monkeypatch):
    passes = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(x):
        passes.add(1)
        return x

    checks = spark.createDataFrame([(2013, 7, 6, -1), (2013, 7, 1, -1), (2013, 7, None, -1)], "Return_Yr int, TagState int, RecapState int, check int")
    got = stats.check_breakdown(checks.withColumn("TagState", seen.asNondeterministic()("TagState")), (1, 6)).collect()
    assert [r.asDict() for r in got] == [{"Return_Yr": 2013, "TagState": 7, "recap_1": 1, "recap_6": 1}] and passes.value == 3


def test_na_cells_are_missing(spark, tmp_path):
    for name, head, line in (("a", "Return_Yr,Tag1,RecapTag1,FL", "2013,NA,NA, NA "), ("b", "Return_Yr,Tag1", "2014,"), ("c", "FL,Tag1", "60,T9")):
        (tmp_path / f"{name}.csv").write_text(f"{head}\n{line}\n")
    got = rows_of(sheets.read_csv_dir(spark, str(tmp_path), ["Return_Yr", "Tag1", "RecapTag1", "FL"]), "Return_Yr", "Tag1", "RecapTag1", "FL")
    assert got == sorted([("2013", None, None, None), ("2014", None, None, None), (None, "T9", None, "60")], key=str)
    assert rows_of(sheets.column_report(spark, str(tmp_path)), "file", "columns")[1] == ("b.csv", "Return_Yr, Tag1")
    final = spark.createDataFrame([tuple([None] * len(FINAL_COLUMNS))], sheets.FINAL_SCHEMA).withColumn("Return_Yr", F.lit(2013))
    path = sheets.write_final(final, str(tmp_path / "out"), "run")
    row = sheets.read_final(spark, path).first()
    assert row.Return_Yr == 2013 and row.Tag1 is None and row.FL is None
    assert any("NA" in open(p.path).read() for p in os.scandir(path) if p.name.endswith(".csv"))


def test_no_reach_is_dropped(spark):
    hist = spark.createDataFrame([(1, 1, True, 10), (1, 6, True, 30), (1, None, True, 60), (2, 7, False, 5)], "t_l int, r_l int, tag boolean, n long")
    row = H.transition_table(hist).where("t_l = 1").first()
    assert (row.to_1, row.to_6, row.to_none, row.share_to_1) == (10, 30, 60, 0.1)
    with pytest.raises(ValueError):
        H.transition_table(hist, locations=(1, 2))
    checks = spark.createDataFrame([(2013, 7, 6, -1), (2013, 7, 1, -1), (2013, 7, 1, 1)], "Return_Yr int, TagState int, RecapState int, check int")
    assert stats.check_breakdown(checks).first().asDict() == {"Return_Yr": 2013, "TagState": 7, "recap_1": 1, "recap_6": 1}


def test_headers_through_the_file_system_that_spark_uses(spark, tmp_path):
    """An empty file, a damaged one and an unknown scheme are left out."""
    folder = tmp_path / "sheets"
    folder.mkdir()
    spark.createDataFrame([("2013", "A1")], "Return_Yr string, Tag1 string").coalesce(1).write.option("header", True).csv(f"{folder}/a")
    write(folder / "a" / "empty.csv", "")
    heads = sheets.header_lines(spark, f"{folder}/*").collect()
    assert [h.header for h in heads] == ["Return_Yr,Tag1"]
    one = heads[0].file_path
    # a checksum that does not fit makes the file unreadable
    data = folder / "a" / heads[0].file
    data.write_bytes(data.read_bytes().replace(b"Return", b"Reture"))
    assert sheets.header_lines(spark, f"{folder}/*").count() == 0
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    assert sheets._head(spark, hadoop, one.replace("file:", "nowhere:")) is None
