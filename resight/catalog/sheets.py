"""Queries of the wrangling side: sources, row rules, periods, sex classes, the tidy table."""

from __future__ import annotations

from pyspark.sql import functions as F

from resight.catalog import blocks  # noqa: F401
from resight.catalog.base import CTES, big, cte, num, query
from resight.operators import clean, periods, reshape, sex, stats
from resight.operators.schema import FINAL_COLUMNS, RAW_COLUMNS
from resight.plans import tidy as T, views as V
from resight.session import new_folder, settle
from resight.sources import sectioned, sheets, statistics

SPECIES = ["BUILDING", "AUTOMOBILE", "MACHINERY"]
SPECIES_SQL = "('BUILDING','AUTOMOBILE','MACHINERY')"

cte("sheets", "", """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS Return_Yr, c_mktsegment AS SPECIES, l_linestatus AS Run,
  CAST(o_orderdate AS DATE) AS day, 'Reach ' || (cn.n_regionkey + 1) AS TagReach, cn.n_regionkey + 1 AS TagState,
  CASE WHEN o_orderstatus <> 'P' THEN l_orderkey || '-' || l_partkey END AS Tag1, CAST(NULL AS VARCHAR) AS Tag2,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Female' WHEN '2-HIGH' THEN 'Male' WHEN '3-MEDIUM' THEN 'Jack'
    WHEN '4-NOT SPECIFIED' THEN 'Unknown' END AS Sex,
  CASE WHEN l_partkey % 13 <> 0 THEN CAST(CAST(l_quantity AS INTEGER) + 30 AS VARCHAR) END AS FL, l_returnflag AS Mark,
  CASE WHEN l_partkey % 7 = 0 THEN '88' WHEN l_partkey % 7 < 5 THEN (3 + l_partkey % 3) || '' || (1 + l_suppkey % 2) END AS ScaleAge,
  CASE WHEN again THEN CAST(l_shipdate AS DATE) END AS ship,
  CASE WHEN again THEN l_orderkey || '-' || l_partkey END AS RecapTag1, CAST(NULL AS VARCHAR) AS RecapTag2,
  CASE WHEN again THEN 'Reach ' || (sn.n_regionkey + 1) END AS RecapReach, CASE WHEN again THEN sn.n_regionkey + 1 END AS RecapState,
  CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber // 3 AS VARCHAR) END AS SampleRate,
  CASE l_returnflag WHEN 'R' THEN 'jacks' WHEN 'A' THEN 'ok' END AS Comments
FROM (SELECT *, o_orderstatus <> 'P' AND datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 0 AND 120 AS again
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
""")
cte("raw", "sheets", """
SELECT Return_Yr, SPECIES, Run, strftime(day, '%-d-%b-%y') AS TagDate, TagReach, Tag1, Tag2, Sex, FL, Mark, ScaleAge,
  strftime(ship, '%-d-%b-%y') AS RecapDate, RecapTag1, RecapTag2, RecapReach, SampleRate, Comments FROM sheets
""")
cte("fmt", "sheets", f"""
SELECT 'site' AS Location, Return_Yr, CAST(Return_Yr AS INTEGER) AS yr, SPECIES AS Species, Run, Sex, FL, Mark, ScaleAge, Tag1, Tag2, RecapTag1, RecapTag2,
  SampleRate, Comments, day AS Date_Maiden, ship AS Date_Recap, TagState, RecapState,
  CASE WHEN TagState > RecapState THEN -1 ELSE 1 END AS "check",
  CASE WHEN Tag1 IS NOT NULL OR Tag2 IS NOT NULL THEN 1 ELSE 0 END AS Tagged,
  CASE WHEN Tag1 IS NULL AND Tag2 IS NULL THEN NULL WHEN RecapTag1 IS NOT NULL OR RecapTag2 IS NOT NULL THEN 1 ELSE 0 END AS Recap
FROM sheets WHERE SPECIES IN {SPECIES_SQL}
""")
cte("fmt_all", "sheets", CTES["fmt"][1].replace(f"WHERE SPECIES IN {SPECIES_SQL}", ""))
cte("dates_all", "fmt_all", """
SELECT DISTINCT Year, Date FROM (SELECT yr AS Year, Date_Maiden AS Date FROM fmt_all UNION ALL SELECT yr, Date_Recap FROM fmt_all)
WHERE Date IS NOT NULL
""")
cte("dates", "fmt", """
SELECT DISTINCT Year, Date FROM (SELECT yr AS Year, Date_Maiden AS Date FROM fmt UNION ALL SELECT yr, Date_Recap FROM fmt)
WHERE Date IS NOT NULL
""")
cte("weeks", "dates", """
SELECT *, CASE WHEN Date_Min = Date_Max THEN Date_Min ELSE Date_Max - 1 END AS Date_Mid FROM (
  SELECT Year, CAST(strftime(Date, '%U') AS INTEGER) AS week, count(DISTINCT Date) AS n_surveys, min(Date) AS Date_Min, max(Date) AS Date_Max
  FROM dates GROUP BY 1, 2)
""")
cte("numbered", "weeks", "SELECT *, row_number() OVER (PARTITION BY Year ORDER BY Date_Mid, week) AS Period FROM weeks")
cte("master", "numbered", """
SELECT g.*, Year || '_' || Period AS Year_Period, COALESCE(
    Date_Mid + CAST(round_even(CAST(lead(Days) OVER (ORDER BY Year, Date_Mid, Period) AS DOUBLE) / 2, 0) AS INTEGER),
    Date_Mid + CAST(floor((SELECT median(datediff('day', pm, m)) FROM (SELECT Date_Mid m, lag(Date_Mid) OVER (ORDER BY Year, Date_Mid, Period) pm FROM numbered)) / 2) AS INTEGER)
  ) AS MidDate
FROM (SELECT *, datediff('day', lag(Date_Mid) OVER (ORDER BY Year, Date_Mid, Period), Date_Mid) AS Days FROM numbered) g
""")
cte("pmap", "dates numbered", """
SELECT d.Year, d.Date, min(p.Period) AS Period FROM dates d
LEFT JOIN numbered p ON d.Year = p.Year AND d.Date BETWEEN p.Date_Min AND p.Date_Max GROUP BY 1, 2
""")
cte("per", "fmt pmap", """
SELECT f.*, a.Period AS Period_Cap, b.Period AS Period_Recap,
  Return_Yr || '_' || COALESCE(CAST(a.Period AS VARCHAR), 'NA') AS Year_Period,
  Return_Yr || '_' || COALESCE(CAST(b.Period AS VARCHAR), 'NA') AS Year_Period_Recap,
  CASE WHEN Recap = 1 THEN datediff('day', Date_Maiden, Date_Recap) END AS days
FROM fmt f LEFT JOIN pmap a ON f.yr = a.Year AND f.Date_Maiden = a.Date LEFT JOIN pmap b ON f.yr = b.Year AND f.Date_Recap = b.Date
""")
cte("rates", "per", "SELECT Year_Period, max(COALESCE(TRY_CAST(SampleRate AS DOUBLE), 1)) AS Max_Rate FROM per GROUP BY 1")


def _rules(rate, length, one, cut):
    return f"""CASE WHEN Sex IS NULL OR Sex IN ('Adult','Unknown','unknown','UNK','Unk') THEN 'Adult'
  WHEN Sex = 'Female' THEN 'Female' WHEN Sex = 'Jack' THEN 'Jack'
  WHEN {rate} = {one} AND Max_Rate > 1 THEN 'Jack'
  WHEN Comments IN ('JACKS','Jacks','jacks','jack card') THEN 'Jack'
  WHEN {rate} > {one} THEN 'Male' WHEN {length} > {cut} THEN 'Male'
  WHEN Max_Rate = 1 AND {length} <= {cut} THEN 'Jack' WHEN Max_Rate = 1 AND {length} IS NULL THEN 'Male'
  ELSE 'Need.Another.Category' END"""


RULES = _rules("TRY_CAST(SampleRate AS DOUBLE)", "TRY_CAST(FL AS DOUBLE)", "1", "59")
cte("cls", "per rates", f"SELECT p.*, r.Max_Rate, {RULES} AS Sex_Temp FROM per p LEFT JOIN rates r USING (Year_Period)")
cte("counts", "cls", """
SELECT yr AS Year, Period_Cap AS Period, Year_Period, Sex_Temp, count(*) AS n FROM cls
WHERE Tagged = 1 AND Sex_Temp IN ('Female','Male') GROUP BY 1, 2, 3, 4
""")
WIDE = ", ".join(
    f"COALESCE(sum(n) FILTER (Sex_Temp = '{c}'), 0) / sum(n) AS Prop_Sex_{c}, sum(n) FILTER (Sex_Temp = '{c}') AS Count_{c}"
    for c in ("Jack", "Female", "Male")
)
cte("props", "counts master", f"""
SELECT Year, Period, Year_Period, {WIDE} FROM counts GROUP BY 1, 2, 3
UNION ALL BY NAME
SELECT Year, Period, Year_Period, t.* FROM (SELECT Year, Period, Year_Period FROM master WHERE Year_Period NOT IN (SELECT Year_Period FROM counts)) m,
  (SELECT {WIDE} FROM counts) t
""")
KEY = " || ':' || ".join(
    f"COALESCE(CAST({c} AS VARCHAR), 'NA')" for c in T.DRAW_KEYS
)


def _u(seed, key):
    return f"CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 13)) AS BIGINT) / 4503599627370496.0"


TIE = " || ':' || ".join(f"COALESCE(CAST({c} AS VARCHAR), 'NA')" for c in T.TIE_ORDER)
cte("imp", "cls props", f"""
SELECT c.*, COALESCE(Prop_Sex_Male, 0) pm, COALESCE(Prop_Sex_Female, 0) pf, COALESCE(Prop_Sex_Jack, 0) pj,  CAST({_u(298, KEY + " || ':' || Row_No")} AS DOUBLE) AS u
FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(T.DRAW_KEYS)} ORDER BY md5({TIE})) AS Row_No FROM cls) c LEFT JOIN props p USING (Year_Period)
""")
cte("done", "imp", """
SELECT *, CASE WHEN pm + pf + pj > 0 THEN CASE WHEN u * (pm + pf + pj) < pm THEN 'Male' WHEN u * (pm + pf + pj) < pm + pf THEN 'Female' ELSE 'Jack' END END AS Sex_Interpol,
 CASE WHEN Sex_Temp IN ('Male','Female','Jack') THEN Sex_Temp ELSE
  CASE WHEN pm + pf + pj > 0 THEN CASE WHEN u * (pm + pf + pj) < pm THEN 'Male' WHEN u * (pm + pf + pj) < pm + pf THEN 'Female' ELSE 'Jack' END END END AS Sex_final
FROM imp
""")
FINAL = f"""SELECT Location, {big('yr', 'Return_Yr')}, Species, Run, Sex AS Sex_original, Sex_final,
  CAST(Date_Maiden AS VARCHAR) AS Date_Cap, CAST(Date_Recap AS VARCHAR) AS Date_Recap, {big('Period_Cap', 'Period_Cap')}, {big('Period_Recap', 'Period_Recap')},
  Year_Period AS Year_Period_Cap, Year_Period_Recap, {num('days', 'days_between_capture')}, {num('FL', 'FL')}, Mark, ScaleAge, Tag1, Tag2, RecapTag1, RecapTag2,
  {big('TagState', 'TagState')}, {big('RecapState', 'RecapState')}, {big('"check"', '"check"')}
FROM done WHERE (days > 0 OR Date_Recap IS NULL) AND Sex_final IN ('Jack','Female','Male')"""
cte("final", "done", FINAL)


def raw(spark, d):
    return V.cap_sheets(spark, d)


def fmt(spark, d):
    return T.formatted(raw(spark, d), "site", SPECIES)


def everything(spark, d):
    """The standardised rows of all segments."""
    return T.formatted(raw(spark, d), "site", [*SPECIES, "FURNITURE", "HOUSEHOLD"])


def per(spark, d):
    return T.with_periods(settle(fmt(spark, d)))


def cls(spark, d):
    rows, master = per(spark, d)
    return T.classified(rows), master


def tidy(spark, d):
    return T.tidy(raw(spark, d), "site", SPECIES)


# ---- sources and sinks


def staged(spark, d):
    """The sheets as two CSV layouts: one lacks Comments and has an extra column in front, the other writes NA for nothing."""
    folder = new_folder(spark, "sheets")
    df = settle(raw(spark, d))
    odd = F.col("Return_Yr").cast("int") % 2 == 1
    df.where(~odd).write.option("header", True).option("nullValue", "NA").csv(f"{folder}/even")
    df.where(odd).select(F.lit("A").alias("Crew"), *[c for c in df.columns if c != "Comments"]).write.option("header", True).csv(f"{folder}/odd")
    # a sheet without any line can't be read either
    empty = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/odd/lost.csv")
    empty.getFileSystem(spark._jsc.hadoopConfiguration()).create(empty).close()
    return f"{folder}/*"


RAW_SQL = ", ".join(c if c != "Comments" else "CASE WHEN CAST(Return_Yr AS INTEGER) % 2 = 0 THEN Comments END AS Comments" for c in RAW_COLUMNS)


@query("read_csv_dir", "raw", f"SELECT {RAW_SQL} FROM raw")
def _(spark, d):
    return sheets.read_csv_dir(spark, staged(spark, d), RAW_COLUMNS)


@query("read_csv_tolerant", "raw", f"SELECT {RAW_SQL} FROM raw")
def _(spark, d):
    df = sheets.read_csv_tolerant(spark, staged(spark, d), RAW_COLUMNS)
    return df.where(F.col("source_file").isNotNull()).select(*RAW_COLUMNS)


ODD_COLUMNS = ["Crew"] + [c for c in RAW_COLUMNS if c != "Comments"]


@query("column_report", "raw", f"""SELECT DISTINCT CASE WHEN CAST(Return_Yr AS INTEGER) % 2 = 0 THEN '{", ".join(RAW_COLUMNS)}' ELSE '{", ".join(ODD_COLUMNS)}' END AS columns FROM raw""")
def _(spark, d):
    return sheets.column_report(spark, staged(spark, d)).select("columns").distinct()


@query("column_diff", "raw", "SELECT DISTINCT CASE WHEN CAST(Return_Yr AS INTEGER) % 2 = 0 THEN '' ELSE 'Crew' END AS extra_columns FROM raw")
def _(spark, d):
    return sheets.column_diff(spark, staged(spark, d)).select("extra_columns").distinct()


@query("read_lookup", "", f"SELECT {big('c_custkey', 'key')}, c_name AS name, {num('c_acctbal', 'balance')} FROM customer")
def _(spark, d):
    path = new_folder(spark, "lookup")
    V.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(path)
    return sheets.read_lookup(spark, path, "key long, name string, balance double")


STAT_COLS = ("seen", "marked", "first_seen", "recap_later", "recap_now", "at_risk")


@query("read_sectioned", "js", " UNION ALL ".join(
    f"SELECT '{c}' AS section, 0::BIGINT AS slice, {big('t_k', 'row')}, 1::BIGINT AS col, {num(c, 'value')}, grp FROM js" for c in STAT_COLS))
def _(spark, d):
    cells = V.event_stats(spark, d).unpivot(["grp", "t_k"], list(STAT_COLS), "section", "value").select(
        "grp", "section", F.lit(0).alias("slice"), F.col("t_k").alias("row"), F.lit(1).alias("col"), "value"
    )
    path = sectioned.write_sectioned(cells, new_folder(spark, "sections"), "grp")
    got = sectioned.read_sectioned(spark, f"{path}/*")
    # the file's folder names its group
    return got.select("section", "slice", "row", "col", "value", F.regexp_extract("source_file", "grp=([a-z]+)", 1).alias("grp"))


@query("read_js_stats", "js", f"SELECT grp, {big('t_k', 't_k')}, {', '.join(big(c, c) for c in STAT_COLS)}, {big('t_yr', 'year')} FROM js")
def _(spark, d):
    path = new_folder(spark, "stats")
    statistics.write_js_stats(V.event_stats(spark, d).withColumnRenamed("t_yr", "year"), path)
    return statistics.read_js_stats(spark, path, [2024])


@query("write_final", "final", f"SELECT {big('Return_Yr', 'Return_Yr')}, Sex_final, count(*)::BIGINT AS n FROM final GROUP BY 1, 2")
def _(spark, d):
    path = sheets.write_final_parquet(tidy(spark, d), new_folder(spark, "final"))
    return spark.read.parquet(path).groupBy("Return_Yr", "Sex_final").count().withColumnRenamed("count", "n")


@query("read_final", "final", "SELECT * FROM final")
def _(spark, d):
    path = sheets.write_final(tidy(spark, d), new_folder(spark, "final"), "run")
    return sheets.read_final(spark, path)


@query("write_summary", "", f"SELECT param, {num('avg(value)', 'mean')} FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'phi' WHEN 1 THEN 'p' ELSE 'nsuper' END AS param, value FROM events) GROUP BY 1")
def _(spark, d):
    from resight.operators.summary import draw_means

    path = sheets.write_summary(draw_means(V.draws(spark, d), ["param"]), new_folder(spark, "summary"), "site", "all", 2024, "sst")
    return spark.read.option("header", True).schema("param string, mean double").csv(path)


# ---- row rules

@query("filter_species", "raw", f"SELECT * FROM raw WHERE SPECIES IN {SPECIES_SQL}")
def _(spark, d):
    return clean.filter_species(raw(spark, d), SPECIES)


STD = f"""Location, Return_Yr, Species, Run, Sex, FL, Mark, ScaleAge, Tag1, Tag2, RecapTag1, RecapTag2, SampleRate, Comments,
CAST(Date_Maiden AS VARCHAR) AS Date_Maiden, CAST(Date_Recap AS VARCHAR) AS Date_Recap, {big('TagState', 'TagState')}, {big('RecapState', 'RecapState')}, {big('"check"', '"check"')}"""


@query("standardize", "fmt", f"SELECT {STD} FROM fmt")
def _(spark, d):
    return clean.standardize(clean.filter_species(raw(spark, d), SPECIES), "site")


@query("movement_check", "sheets", f"SELECT {big('CASE WHEN TagState > RecapState THEN -1 ELSE 1 END', '\"check\"')}, count(*)::BIGINT AS n FROM sheets GROUP BY 1")
def _(spark, d):
    df = clean.standardize(raw(spark, d), "site").drop("check")
    return clean.movement_check(df).groupBy("check").count().withColumnRenamed("count", "n")


@query("tag_flags", "fmt_all", f"SELECT {big('Tagged', 'Tagged')}, {big('Recap', 'Recap')}, count(*)::BIGINT AS n FROM fmt_all GROUP BY 1, 2")
def _(spark, d):
    return reshape.count_by(everything(spark, d), ["Tagged", "Recap"])


@query("days_between", "fmt_all", f"SELECT {num('days', 'days_between_capture')}, count(*)::BIGINT AS n FROM (SELECT CASE WHEN Recap = 1 THEN datediff('day', Date_Maiden, Date_Recap) END AS days FROM fmt_all) GROUP BY 1")
def _(spark, d):
    return reshape.count_by(clean.days_between(everything(spark, d)), ["days_between_capture"])


@query("year_period", "per", "SELECT Year_Period, Year_Period_Recap, count(*)::BIGINT AS n FROM per GROUP BY 1, 2")
def _(spark, d):
    return reshape.count_by(per(spark, d)[0], ["Year_Period", "Year_Period_Recap"])


@query("classify_sex", "cls", "SELECT Tag1, Return_Yr, Sex, SampleRate, FL, Comments, Sex_Temp FROM cls")
def _(spark, d):
    return cls(spark, d)[0].select("Tag1", "Return_Yr", "Sex", "SampleRate", "FL", "Comments", "Sex_Temp")


@query("classify_sex_lexical", "per", f"""SELECT Sex_Temp, count(*)::BIGINT AS n FROM (SELECT {_rules("SampleRate", "FL", "'1'", "'59'")} AS Sex_Temp
FROM per JOIN (SELECT Year_Period, CAST(max(COALESCE(SampleRate, '1')) AS DOUBLE) AS Max_Rate FROM per GROUP BY 1) USING (Year_Period)) GROUP BY 1""")
def _(spark, d):
    rows, _ = per(spark, d)
    rows = sex.attach_max_rate(rows, sex.max_rate_by_period(rows, "lexical"))
    return reshape.count_by(sex.classify_sex(rows, compare="lexical"), ["Sex_Temp"])


@query("final_filter", "final", f"SELECT Sex_final, {num('days_between_capture', 'days_between_capture')}, count(*)::BIGINT AS n FROM final GROUP BY 1, 2")
def _(spark, d):
    return reshape.count_by(tidy(spark, d), ["Sex_final", "days_between_capture"])


@query("final_select", "final", "SELECT * FROM final")
def _(spark, d):
    return tidy(spark, d)


@query("ocean_age", "fmt_all", f"""SELECT ScaleAge, {big("CASE WHEN ScaleAge IS NULL OR ScaleAge IN ('9','88') THEN -1 ELSE CAST(substr(ScaleAge, 1, 1) AS INTEGER) - CAST(substr(ScaleAge, 2, 1) AS INTEGER) END", 'oa')}, count(*)::BIGINT AS n FROM fmt_all GROUP BY 1, 2""")
def _(spark, d):
    return reshape.count_by(clean.ocean_age(everything(spark, d)), ["ScaleAge", "oa"])


@query("recode_sex", "fmt_all", "SELECT CASE WHEN Sex IS NULL OR Sex IN ('Unknown','Adult') THEN '-1' ELSE Sex END AS Sex, count(*)::BIGINT AS n FROM fmt_all GROUP BY 1")
def _(spark, d):
    return reshape.count_by(clean.recode_sex(everything(spark, d)), ["Sex"])


@query("row_index", "fmt_all", f"SELECT {big('row_number() OVER (ORDER BY Date_Maiden, COALESCE(Tag1, chr(0)), COALESCE(FL, chr(0)))', '\"Index\"')}, CAST(Date_Maiden AS VARCHAR) AS Date_Maiden, Tag1, FL FROM fmt_all")
def _(spark, d):
    return clean.row_index(everything(spark, d), ["Date_Maiden", "Tag1", "FL"]).select("Index", "Date_Maiden", "Tag1", "FL")


# ---- periods

@query("union_dates", "dates", f"SELECT {big('Year', 'Year')}, CAST(Date AS VARCHAR) AS Date FROM dates")
def _(spark, d):
    return periods.union_dates(fmt(spark, d))


WEEK_COLS = f"{big('Year', 'Year')}, {big('week', 'week')}, n_surveys::BIGINT AS n_surveys, CAST(Date_Min AS VARCHAR) AS Date_Min, CAST(Date_Max AS VARCHAR) AS Date_Max, CAST(Date_Mid AS VARCHAR) AS Date_Mid"


@query("survey_weeks", "weeks", f"SELECT {WEEK_COLS} FROM weeks")
def _(spark, d):
    return periods.survey_weeks(periods.union_dates(fmt(spark, d)))


@query("period_numbers", "numbered", f"SELECT {WEEK_COLS}, {big('Period', 'Period')} FROM numbered")
def _(spark, d):
    return periods.period_numbers(periods.survey_weeks(periods.union_dates(fmt(spark, d))))


@query("period_gaps", "master", f"SELECT {WEEK_COLS}, {big('Period', 'Period')}, Year_Period, {num('Days', 'Days_Btw_Periods')}, CAST(CAST(MidDate AS DATE) AS VARCHAR) AS MidDate_Btw_Periods FROM master")
def _(spark, d):
    return per(spark, d)[1]


@query("sort_periods", "master", f"SELECT {big('Year', 'Year')}, {big('Period', 'Period')} FROM master")
def _(spark, d):
    return periods.sort_periods(per(spark, d)[1]).select("Year", "Period")


@query("manual_periods", "", f"""SELECT {big('yr', 'Year')}, {big('pn', 'Period')}, count(*)::BIGINT AS n_surveys, CAST(min(day) AS VARCHAR) AS Date_Min, CAST(max(day) AS VARCHAR) AS Date_Max,
{big("CAST(strftime(min(day), '%U') AS INTEGER)", 'week')}, CAST(CASE WHEN min(day) = max(day) THEN min(day) ELSE max(day) - 1 END AS VARCHAR) AS Date_Mid
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS yr, month(o_orderdate) AS pn, c_mktsegment AS proj FROM orders JOIN customer ON o_custkey = c_custkey)
WHERE yr = 1997 AND proj = 'BUILDING' GROUP BY yr, pn""")
def _(spark, d):
    o = V.table(spark, d, "orders").join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lut = o.select(
        F.to_date("o_orderdate").alias("Survey_Date"), F.month("o_orderdate").cast("double").alias("Period_Num"),
        F.col("c_mktsegment").alias("ui_project_name"), F.year("o_orderdate").cast("double").alias("ui_return_year"),
    ).distinct()
    return periods.manual_periods(lut, 1997, "BUILDING")


@query("assign_period", "pmap", f"SELECT {big('Year', 'Year')}, CAST(Date AS VARCHAR) AS Date, {big('Period', 'Period')} FROM pmap")
def _(spark, d):
    return periods.create_periods(fmt(spark, d))[1]


@query("attach_periods", "per", f"SELECT Tag1, CAST(Date_Maiden AS VARCHAR) AS Date_Maiden, {big('Period_Cap', 'Period_Cap')}, {big('Period_Recap', 'Period_Recap')} FROM per")
def _(spark, d):
    return per(spark, d)[0].select("Tag1", "Date_Maiden", "Period_Cap", "Period_Recap")


# ---- sex classes and strata

@query("max_rate_by_period", "rates", f"SELECT Year_Period, {num('Max_Rate', 'Max_Rate')} FROM rates")
def _(spark, d):
    return sex.max_rate_by_period(per(spark, d)[0])


@query("attach_max_rate", "cls", f"SELECT Year_Period, {num('Max_Rate', 'Max_Rate')}, count(*)::BIGINT AS n FROM cls GROUP BY 1, 2")
def _(spark, d):
    rows, _ = per(spark, d)
    return reshape.count_by(sex.attach_max_rate(rows, sex.max_rate_by_period(rows)), ["Year_Period", "Max_Rate"])


PROP_COLS = ", ".join(num(f"Prop_Sex_{c}", f"Prop_Sex_{c}") + ", " + big(f"Count_{c}", f"Count_{c}") for c in ("Jack", "Female", "Male"))


@query("sex_ratios", "props", f"SELECT {big('Year', 'Year')}, {big('Period', 'Period')}, Year_Period, {PROP_COLS} FROM props")
def _(spark, d):
    return sex.sex_ratios(*cls(spark, d))[0]


@query("sex_ratios_total", "counts", f"SELECT 'Total' AS Year_Period, {PROP_COLS} FROM (SELECT {WIDE} FROM counts)")
def _(spark, d):
    return sex.sex_ratios(*cls(spark, d))[1]


@query("missing_periods", "cls master", "SELECT Year_Period FROM master WHERE Year_Period NOT IN (SELECT Year_Period FROM cls WHERE Sex_Temp = 'Male' AND Max_Rate = 1)")
def _(spark, d):
    rows, master = cls(spark, d)
    return periods.missing_periods(master, rows.where((F.col("Sex_Temp") == "Male") & (F.col("Max_Rate") == 1))).select("Year_Period")


@query("share_within", "cls", f"SELECT Year_Period, Sex_Temp, count(*)::BIGINT AS Count, {num('count(*) / sum(count(*)) OVER (PARTITION BY Year_Period)', 'Prop_Sex')} FROM cls GROUP BY 1, 2")
def _(spark, d):
    return sex.class_shares(cls(spark, d)[0])


@query("attach_sex_props", "imp", f"SELECT Year_Period, {num('pm', 'Prop_Sex_Male')}, {num('pf', 'Prop_Sex_Female')}, {num('pj', 'Prop_Sex_Jack')}, count(*)::BIGINT AS n FROM imp GROUP BY 1, 2, 3, 4")
def _(spark, d):
    rows, master = cls(spark, d)
    out = sex.attach_sex_props(rows, sex.sex_ratios(rows, master)[0])
    return reshape.count_by(out, ["Year_Period", "Prop_Sex_Male", "Prop_Sex_Female", "Prop_Sex_Jack"])


@query("impute_category", "done", "SELECT Tag1, Year_Period, Sex_Temp, Sex_Interpol, Sex_final FROM done")
def _(spark, d):
    rows, master = cls(spark, d)
    return T.imputed(rows, master, 298, "tagged", "female_male").select("Tag1", "Year_Period", "Sex_Temp", "Sex_Interpol", "Sex_final")


@query("attach_strata", "done", """SELECT Sex_final, CASE Sex_final WHEN 'Jack' THEN 'Jacks' WHEN 'Female' THEN 'Adult' WHEN 'Male' THEN 'Adult' END AS Strata_Name, count(*)::BIGINT AS n FROM done GROUP BY 1, 2""")
def _(spark, d):
    rows, master = cls(spark, d)
    done = T.imputed(rows, master, 298, "tagged", "female_male")
    return reshape.count_by(sex.attach_strata(done, T.strata_lookup(spark), 2), ["Sex_final", "Strata_Name"])


# ---- checks

@query("distinct_values", "sheets", "SELECT DISTINCT SPECIES FROM sheets")
def _(spark, d):
    return reshape.distinct_values(raw(spark, d), "SPECIES")


@query("count_by", "cls", "SELECT Return_Yr, Sex_Temp, count(*)::BIGINT AS n FROM cls GROUP BY 1, 2")
def _(spark, d):
    return reshape.count_by(cls(spark, d)[0], ["Return_Yr", "Sex_Temp"])


@query("check_breakdown", "final", f"""SELECT {big('Return_Yr', 'Return_Yr')}, {big('TagState', 'TagState')},
{', '.join(f'CASE WHEN count(*) FILTER (RecapState = {k}) > 0 THEN count(*) FILTER (RecapState = {k}) END::BIGINT AS recap_{k}' for k in range(1, 6))}
FROM final WHERE "check" = -1 GROUP BY 1, 2""")
def _(spark, d):
    return stats.check_breakdown(tidy(spark, d), (1, 2, 3, 4, 5))


@query("tidy_by_location", "final", f"SELECT loc AS Location, {', '.join(chr(34) + c + chr(34) for c in FINAL_COLUMNS if c != 'Location')} FROM final, (SELECT unnest(['east', 'west']) AS loc)")
def _(spark, d):
    """Two locations with the same sheets: each must come out as it does on its own."""
    both = raw(spark, d).withColumn("Location", F.explode(F.array(F.lit("east"), F.lit("west"))))
    return T.tidy(both, None, SPECIES)


@query("check_total", "final", 'SELECT count(*)::BIGINT AS n FROM final WHERE "check" = -1')
def _(spark, d):
    return stats.check_total(tidy(spark, d))


@query("sex_by_year", "cls", "SELECT Return_Yr, " + ", ".join(
    f"CASE WHEN count(*) FILTER (Sex_Temp = '{c}') > 0 THEN count(*) FILTER (Sex_Temp = '{c}') END::BIGINT AS {c.replace('.', '_')}"
    for c in ("Adult", "Female", "Jack", "Male", "Need.Another.Category")) + " FROM cls GROUP BY 1")
def _(spark, d):
    return stats.sex_by_year(cls(spark, d)[0])


@query("column_setdiff", "raw", "SELECT DISTINCT SampleRate, Comments FROM raw")
def _(spark, d):
    df = raw(spark, d)
    kept = reshape.column_setdiff(df, df.drop("SampleRate", "Comments"))
    return df.select(*kept).distinct()


@query("reach_index", "fmt sheets", f"""SELECT TagReach, RecapReach, {big('a.k', 't_l')}, {big('b.k', 'r_l')}, count(*)::BIGINT AS n
FROM sheets LEFT JOIN (SELECT DISTINCT TagReach x, dense_rank() OVER (ORDER BY TagReach) k FROM sheets) a ON TagReach = a.x
LEFT JOIN (SELECT DISTINCT TagReach x, dense_rank() OVER (ORDER BY TagReach) k FROM sheets) b ON RecapReach = b.x GROUP BY ALL""")
def _(spark, d):
    from resight.operators.histories import reach_index

    return reshape.count_by(reach_index(raw(spark, d)), ["TagReach", "RecapReach", "t_l", "r_l"])


@query("biodata_counts", "fmt_all", "SELECT " + big("TagState", "TagState") + ", Return_Yr, " + ", ".join(
    f"count(*) FILTER ({t})::BIGINT AS ex_{n}, count({t})::BIGINT AS tot_{n}, {num(f'count(*) FILTER ({t}) / nullif(count({t}), 0)', f'p_{n}')}"
    for n, t in {"female": "Sex = 'Female'", "clip": "Mark = 'A'", "long": "TRY_CAST(FL AS DOUBLE) > 59", "age3": "ScaleAge LIKE '3%'"}.items()) + " FROM fmt_all GROUP BY TagState, Return_Yr")
def _(spark, d):
    classes = {
        "female": F.col("Sex") == "Female", "clip": F.col("Mark") == "A",
        "long": F.expr("try_cast(FL as double) > 59"), "age3": F.col("ScaleAge").startswith("3"),
    }
    return stats.biodata_counts(everything(spark, d), ["TagState", "Return_Yr"], classes)
