"""Golden fixed-width records, fail-closed negatives and single cleaning rules."""

import pytest
from pyspark.sql import functions as F

from quotalens.functions import cleaning
from quotalens.functions.fields import FIELD, FIELDS, OUTPUT_COLUMNS, RECORD_LENGTH, forbidden_features
from quotalens.operators.features import check_features
from quotalens.plans.audit import evaluation_table, extract
from quotalens.sources import sinks
from quotalens.sources.fixed_width import read_lines
from quotalens.sources.tables import fingerprint

# Six records: weeks, grams, admitted, race, entry month, residence, plurality.
GOLDEN = [
    ("40", "3200", "Y", "01", "03", "1", "1"), ("36", "2400", "N", "31", "00", "4", "2"), ("99", "9999", "U", "99", "99", "2", "1"),
    ("37", "2500", "N", "02", "10", "3", "3"), ("17", "0227", "Y", "06", "01", "1", "1"), ("47", "8165", "N", "30", "04", "2", "1"),
]


def line(year="2022", **values):
    chars = [" "] * RECORD_LENGTH
    base = {"birth_year": year, "birth_month": "07", "mother_age": "30", "child_sex": "F", "mother_bmi": "25.0"}
    for name, text in {**base, **values}.items():
        f = FIELD[name]
        chars[f.start - 1:f.end] = text.ljust(f.width)
    return "".join(chars)


def golden(year="2022"):
    names = ("gestation_oe_weeks", "birth_weight_g", "admit_nicu", "mother_race", "prenatal_care_month", "residence_status", "plurality")
    return [line(year, **dict(zip(names, g))) for g in GOLDEN]


def write(folder, lines, end="\n"):
    path = f"{folder}/raw.txt"
    with open(path, "wb") as f:
        f.write("".join(x + end for x in lines).encode("utf-8"))
    return path


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("year", [2022, 2023])
def test_golden(spark, folder, end, year):
    parsed = cleaning.parse_strict(read_lines(spark, write(folder, golden(str(year)), end)), year)
    rows = cleaning.accepted(parsed).orderBy("pos").collect()
    assert [c for c in parsed.columns if c not in ("pos", "faults")] == list(OUTPUT_COLUMNS)
    assert [r.target_preterm for r in rows] == [0, 1, None, 0, 1, 0]
    assert [r.target_lbw for r in rows] == [0, 1, None, 0, 1, 0]
    assert [r.target_nicu for r in rows] == [1, 0, None, 0, 1, 0]
    assert [r.mother_race for r in rows] == ["01", "31", None, "02", "06", "30"]
    assert [r.prenatal_care_month for r in rows] == [3, 0, None, 10, 1, 4]
    assert [r.is_us_resident for r in rows] == [1, 0, 1, 1, 1, 1]
    assert [r.is_singleton for r in rows] == [1, 0, 1, 0, 1, 1]


@pytest.mark.parametrize("bad, field, error", [
    (golden()[0][:-1], "record", "record length"), (golden()[0] + " ", "record", "record length"), ("", "record", "record length"),
    (line("2021"), "record", "record year"), ("é" + golden()[0][1:], "record", "not ASCII"),
    (line(mother_race="32"), "mother_race", "invalid category code"), (line(wic_benefits="X"), "wic_benefits", "invalid boolean code"),
    (line(birth_month="1d"), "birth_month", "not a number"), (line(mother_age="11"), "mother_age", "below minimum"),
    (line(mother_bmi="70.0"), "mother_bmi", "above maximum"), (line(mother_weight_pre="nan"), "mother_weight_pre", "not a number"),
    (line(mother_bmi="1e99"), "mother_bmi", "above maximum"), (line(mother_weight_pre="1.5"), "mother_weight_pre", "not an integer"),
])
def test_bad_records_stop_the_extraction(spark, folder, bad, field, error):
    path = write(folder, [golden()[0], bad])
    parsed = cleaning.parse_strict(read_lines(spark, path), 2022)
    assert [(r.field, r.error) for r in cleaning.rejects(parsed).collect()] == [(field, error)]
    with pytest.raises(ValueError, match="rejected"):
        extract(spark, path, 2022, f"{folder}/out", 2)


def test_extract_publishes_once(spark, folder):
    path = write(folder, golden(), "\r\n")
    expected = fingerprint(cleaning.accepted(cleaning.parse_strict(read_lines(spark, path), 2022)).drop("pos"), OUTPUT_COLUMNS).first().asDict()
    with pytest.raises(ValueError, match="observed 6 rows"):
        extract(spark, path, 2022, f"{folder}/out", 7)
    with pytest.raises(ValueError, match="fingerprint"):
        extract(spark, path, 2022, f"{folder}/out", 6, {"xor_hash": 1})
    record = extract(spark, path, 2022, f"{folder}/out", 6, expected)
    assert record["status"] == "PASS" and spark.read.parquet(f"{folder}/out").count() == 6
    with pytest.raises(FileExistsError):
        extract(spark, path, 2022, f"{folder}/out", 6)
    with pytest.raises(ValueError):
        extract(spark, path, 2024, f"{folder}/other", 6)


def test_lenient(spark, folder):
    path = write(folder, ["", line(plurality="5", prenatal_care_month="00", diab_pre="Y"), line()[:300], line(mother_bmi="x")])
    evaluation_table(spark, path, f"{folder}/eval")
    rows = spark.read.parquet(f"{folder}/eval").orderBy("pos").collect()
    assert len(rows) == 3
    assert (rows[0].is_singleton, rows[0].prenatal_care_month, rows[0].diab_pre) == ("0", "0", "1")
    assert rows[1].diab_pre is None and rows[1].mother_bmi == "25.0" and rows[2].mother_bmi == "x"


def test_text_rules(spark):
    cases = [("25.0", "25"), ("25.5", "25.5"), (" 30.0\t", "30"), ("99.9", ""), ("", ""), (None, "")]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, raw string")
    f = FIELD["mother_bmi"]
    text = cleaning.render(f, cleaning.clean(f, cleaning.normalized(F.col("raw"))))
    assert [r[0] for r in rows.orderBy("i").select(text).collect()] == [want for _, want in cases]


def test_numbers_are_plain_decimals(spark):
    texts = ["1d", "nan", "Infinity", "0x1", "", "1e2", "+3.", ".5", "007", "1_0", "--1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(cleaning.number(F.col("t"))).collect()] == [None, None, None, None, None, 100.0, 3.0, 0.5, 7.0, None, None]


def test_normalize_frame_windows_and_guards(spark):
    schema = "is_us_resident string, mother_race string, prenatal_care_month string, gestation_oe_weeks string, birth_weight_g string, admit_nicu string"
    good = spark.createDataFrame([("1", "01", "3", "36", "2400", "1"), ("1", "31", None, "48", "200", None), ("1", None, "0", None, None, "0")], schema)
    rows = cleaning.normalize_frame(good).collect()
    assert [(r.target_preterm, r.target_lbw, r.target_nicu, r.mother_race) for r in rows] == [(1.0, 1.0, 1.0, 1.0), (None, None, None, 31.0), (None, None, 0.0, None)]
    for race in ("x", "32", "1.5"):
        with pytest.raises(Exception):
            cleaning.normalize_frame(spark.createDataFrame([("1", race, "3", "36", "2400", "1")], schema)).collect()


@pytest.mark.parametrize("counted", [1, 1 << 17])
def test_line_profile_is_that_of_the_parsed_lines(spark, monkeypatch, counted):
    monkeypatch.setattr(cleaning, "_COUNTED", counted)
    lines = [
        *golden(), *golden("2023"), None, "", line()[:-1], line() + " ", "é" + line()[1:], line() + "\r", line() + "\r\r", line() + "\n", "\t" + line()[1:],
        line(mother_age="3\t"), line(mother_age="\x1f9"), line(mother_age="3\0"), line(mother_age="\0"), line(mother_bmi=" 1e1"), line(mother_bmi=".nan"),
        line(mother_bmi="99.9"), line(mother_bmi="12.9"), line(mother_bmi="+20."), line(birth_weight_g="9e9"), line(birth_weight_g=" 300"), line(prior_live_births="1."),
        line(prior_live_births="-1"), line(diab_pre="1"), line(diab_pre="y"), line(diab_pre="U"), line(mother_race="1"), line(mother_race="32"), line(birth_year="2022", an_seiz="\r"),
    ]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "pos long, value string").repartition(3)
    want = sinks.field_profile(cleaning.parse_strict(df, 2022))
    got = sinks.line_profile(df, 2022)
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert sorted(got.collect()) == sorted(want.collect())
    none = df.where("pos < 0")
    assert sorted(sinks.line_profile(none, 2022).collect()) == sorted(sinks.field_profile(cleaning.parse_strict(none, 2022)).collect())


def test_line_profile_judges_each_distinct_text_once(spark):
    """What is judged grows with the texts that occur, not with the lines."""
    texts = cleaning.field_texts(spark.createDataFrame([(x,) for x in 50 * golden()], "value string"), 2022)
    rows = texts.collect()
    assert len(rows) < 34 * 6 and sum(r.n for r in rows) == 34 * 300


def test_layout():
    assert len(FIELDS) == 34 and len(OUTPUT_COLUMNS) == 40
    assert max(f.end for f in FIELDS) <= RECORD_LENGTH
    spans = sorted((f.start, f.end) for f in FIELDS)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert {"birth_weight_g", "prenatal_visits", "target_lbw", "mother_age"} <= forbidden_features()
    assert not {"wic_benefits", "cigarettes_1_tri", "mother_bmi"} & forbidden_features()
    with pytest.raises(ValueError):
        check_features(["mother_bmi", "birth_weight_g"])
