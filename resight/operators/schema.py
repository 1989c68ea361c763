"""Column sets of the survey tables."""

from __future__ import annotations

# The columns kept from a raw sheet.
RAW_COLUMNS = [
    "Return_Yr", "SPECIES", "Run", "TagDate", "TagReach", "Tag1", "Tag2", "Sex", "FL", "Mark", "ScaleAge",
    "RecapDate", "RecapTag1", "RecapTag2", "RecapReach", "SampleRate", "Comments",
]

# The columns and types of the tidy table.
FINAL_SCHEMA = (
    "Location string, Return_Yr int, Species string, Run string, Sex_original string, Sex_final string, "
    "Date_Cap date, Date_Recap date, Period_Cap int, Period_Recap int, Year_Period_Cap string, "
    "Year_Period_Recap string, days_between_capture double, FL double, Mark string, ScaleAge string, "
    "Tag1 string, Tag2 string, RecapTag1 string, RecapTag2 string, TagState int, RecapState int, check int"
)
FINAL_COLUMNS = [part.split()[0] for part in FINAL_SCHEMA.split(", ")]

# Which stratum a sex class belongs to under each grouping strategy.
STRATA_SCHEMA = "Grouping_Strategy_Num double, Sex_final string, Strata_Name string, Strata_Num double"
STRATA_BY_SEX = [
    (1.0, "Jack", "Pooled", 1.0),
    (1.0, "Female", "Pooled", 1.0),
    (1.0, "Male", "Pooled", 1.0),
    (2.0, "Jack", "Jacks", 1.0),
    (2.0, "Female", "Adult", 2.0),
    (2.0, "Male", "Adult", 2.0),
    (3.0, "Jack", "Jack", 1.0),
    (3.0, "Female", "Female", 2.0),
    (3.0, "Male", "Male", 3.0),
    (4.0, "Female", "Pooled", 1.0),
    (4.0, "Male", "Pooled", 1.0),
    (5.0, "Female", "Female", 1.0),
    (5.0, "Male", "Male", 2.0),
]
