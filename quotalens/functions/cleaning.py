"""Record cleaning as Column expressions: missing codes, domains, ranges, derived columns.

A value is NULL when it is missing or faulty; faults are kept apart, and reports name the field and the kind of
fault, never the value.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalens.functions.fields import (
    DERIVED, EVALUATION_COLUMNS, FIELD, FIELDS, RECORD_LENGTH, SOURCE_ALIASES, Field,
)

# Characters stripped from both ends of a raw value.
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
_RARE_BLANKS = _BLANKS.replace(" ", "").replace("\n", "")


def normalized(raw: Column) -> Column:
    """NULL becomes the empty text; surrounding whitespace of every kind goes."""
    return F.coalesce(F.btrim(raw.cast("string"), F.lit(_BLANKS)), F.lit(""))


def number(text: Column) -> Column:
    """The text as double, NULL unless it is a plain decimal number.

    Only digits, signs, a point and an exponent may occur: the cast alone would also take '1d', 'nan' and 'Infinity'.
    """
    plain = F.translate(text, "0123456789+-.eE", "") == ""
    return F.when(plain, text.try_cast("double"))


def is_missing(field: Field, text: Column) -> Column:
    return text.isin("", *field.missing)


def clean(field: Field, text: Column, value: Column | None = None) -> Column:
    """Cleaned value of a normalized text, NULL when it is missing or breaks the field's domain.

    ``value``: the text as a number, for number fields whose cast was already done.
    """
    if field.kind == "boolean":
        return F.when(text.isin("Y", "1"), 1).when(text.isin("N", "0"), 0).cast("int")
    if field.kind == "category":
        return F.when(text.isin(*field.allowed) & ~text.isin(*field.missing), text) if field.missing else F.when(
            text.isin(*field.allowed), text)
    v = number(text) if value is None else value
    inside = v.between(field.low, field.high)
    if field.missing:
        inside = inside & ~text.isin(*field.missing)
    if field.kind == "int":
        return F.when(inside & (v == F.floor(v)), v.cast("int"))
    return F.when(inside, F.bround(v, field.decimals))


def fault_kind(name: Column, text: Column) -> Column:
    """What is wrong with a faulty text of the named field."""
    def of(*kinds: str) -> Column:
        return name.isin(*[f.name for f in FIELDS if f.kind in kinds])

    lows = F.create_map(*[F.lit(x) for f in FIELDS if f.low is not None for x in (f.name, f.low)])
    v = number(text)
    odd = F.when(v.isNull(), "not a number").when(F.abs(v) == F.lit(float("inf")), "non-finite number")
    return (
        F.when(of("boolean"), "invalid boolean code")
        .when(of("category"), "invalid category code")
        .otherwise(
            odd.when(of("int") & (v != F.floor(v)), "not an integer").when(v < lows[name], "below minimum").otherwise("above maximum"))
    )


def render(field: Field, value: Column) -> Column:
    """Canonical text of a cleaned value: no leading zeros on integers, no trailing zeros on decimals, blank if unknown."""
    text = value.cast("string")
    if field.kind.startswith("float"):
        text = F.when(value.isNotNull(), F.regexp_replace(F.format_string(f"%.{field.decimals}f", value), r"\.?0+$", ""))
    return F.coalesce(text, F.lit(""))


def code_flag(text: Column, ones: Iterable[str], zeros: Iterable[str]) -> Column:
    """1 / 0 / NULL from two code sets."""
    return F.when(text.isin(*ones), 1).when(text.isin(*zeros), 0).cast("int")


def below(value: Column, limit: float) -> Column:
    """1 / 0 / NULL for ``value < limit``."""
    return (value < F.lit(limit)).cast("int")


def derived_columns() -> dict[str, Column]:
    """Population flags and labels from cleaned columns; unknown stays NULL."""
    made = {
        "is_us_resident": code_flag(F.col("residence_status"), "123", "4"),
        "is_singleton": code_flag(F.col("plurality"), "1", "234"),
        "target_preterm": below(F.col("gestation_oe_weeks"), 37),
        "target_nicu": F.col("admit_nicu"),
        "target_lbw": below(F.col("birth_weight_g"), 2500),
        "target_gdm": F.col("diab_gest"),
    }
    return {name: made[name] for name in DERIVED}


def source_names(year: int) -> dict[str, str]:
    """Output name -> name in that year's source. Only the years with a known layout are accepted."""
    if year not in SOURCE_ALIASES:
        raise ValueError("only the layouts of 2022 and 2023 are known")
    return {name: SOURCE_ALIASES[year].get(name, name) for name in FIELD}


def _rare_blanks(line: Column) -> Column:
    """Whether whitespace other than spaces is left in the line."""
    found = F.lit(False)
    for blank in _RARE_BLANKS:
        found = found | F.contains(line, F.lit(blank))
    return found


def _payload(line: Column) -> Column:
    """The line without its line end, rare whitespace turned into spaces."""
    one = F.endswith(line, F.lit("\r")) & ~F.endswith(line, F.lit("\r\r"))
    text = F.when(one, F.substring(line, 1, F.length(line) - 1)).when(
        F.endswith(line, F.lit("\r")) | F.endswith(line, F.lit("\n")), F.rtrim(line, F.lit("\r\n"))).otherwise(line)
    return text


def cut_lines(
    lines: DataFrame, keep: Sequence[str], fields: Sequence[Field] = FIELDS, line: str = "value", lenient: bool = False
) -> DataFrame:
    """Raw field texts of every line, with ``_length`` and ``_ascii`` of the line itself.

    A line is cut as bytes, at the offset of a field instead of walking the characters before it. That is right for
    ASCII lines; the strict layout refuses others, and the lenient one cuts them by characters. Leniently, a line too
    short for a field gives an empty text.
    """
    ready = lines.select(*keep, _payload(F.col(line)).alias("_text"))
    spaces = F.translate("_text", _RARE_BLANKS, " " * len(_RARE_BLANKS))
    ready = ready.withColumn("_line", F.when(_rare_blanks(F.col("_text")), spaces).otherwise(F.col("_text")))
    ready = ready.select(
        *keep, "_line", F.col("_line").cast("binary").alias("_bytes"), F.length("_line").alias("_length"),
        (F.octet_length("_line") == F.length("_line")).alias("_ascii"),
    )
    cut = []
    for f in fields:
        piece = F.substring(F.col("_bytes"), f.start, f.width).cast("string")
        if lenient:
            piece = F.when(F.col("_ascii"), piece).otherwise(F.substring(F.col("_line"), f.start, f.width))
            piece = F.when(F.col("_length") >= f.end, piece).otherwise("")
        cut.append(F.trim(piece).alias(f.name))
    return ready.select(*keep, "_length", "_ascii", *cut)


def record_fault(year: int) -> Column:
    """Error kind of a whole line under the strict layout, NULL when it is fine."""
    return (
        F.when(F.col("_length") != RECORD_LENGTH, "record length")
        .when(~F.col("_ascii"), "not ASCII")
        .when(F.col("birth_year") != str(year), "record year")
    )


def harmonize(raw: DataFrame, keep: Sequence[str] = (), record_error: Column | None = None) -> DataFrame:
    """Clean all fields of raw text columns, add derived columns and ``faults``.

    ``faults`` lists ``struct(field, text)`` of values that are neither missing nor valid; an empty list means the
    record is accepted. Texts, numbers and values are computed in turn, each once. The task number among the texts
    keeps the optimizer from pushing a filter on ``faults`` below them, where it would repeat all the cleaning.
    """
    whole = F.lit(None).cast("string") if record_error is None else record_error
    numbers = [f for f in FIELDS if f.kind in ("int", "float")]
    texts = raw.select(*keep, whole.alias("_record"), *[F.col(f.name).alias(f"t_{f.name}") for f in FIELDS])
    cast = texts.withColumns({f"v_{f.name}": number(F.col(f"t_{f.name}")) for f in numbers})
    cast = cast.withColumn("_task", F.spark_partition_id())
    values = cast.withColumns({
        f.name: clean(f, F.col(f"t_{f.name}"), F.col(f"v_{f.name}") if f in numbers else None) for f in FIELDS
    })
    faults = F.array_compact(F.array(*[
        F.when(F.col(f.name).isNull() & ~is_missing(f, F.col(f"t_{f.name}")),
               F.struct(F.lit(f.name).alias("field"), F.col(f"t_{f.name}").alias("text")))
        for f in FIELDS
    ]))
    whole_record = F.array(F.struct(F.lit("record").alias("field"), F.col("_record").alias("text")))
    found = F.when(F.col("_record").isNotNull(), whole_record).when(F.col("_task") >= 0, faults)
    return values.select(*keep, *FIELD, *[c.alias(n) for n, c in derived_columns().items()], found.alias("faults"))


def parse_strict(lines: DataFrame, year: int, keep: Sequence[str] = ("pos",), line: str = "value") -> DataFrame:
    """Fixed-width lines to the harmonized table plus ``faults``; a line with a whole-record fault is not judged by field."""
    source_names(year)
    return harmonize(cut_lines(lines, keep, line=line), keep, record_fault(year))


#: Lines whose field texts a task counts in one go.
_COUNTED = 1 << 17


def field_texts(lines: DataFrame, year: int, line: str = "value") -> DataFrame:
    """(field_no, text, n): how often each text stands in each field of the lines that the strict layout judges by field.

    Such lines are ASCII and of one length, so a batch is a matrix of bytes, and a field's text, four bytes at most, is a number.
    """
    source_names(year)
    end = max(f.end for f in FIELDS)
    text = F.col("_text")
    whole = (F.octet_length(text) == RECORD_LENGTH) & (F.length(text) == RECORD_LENGTH)
    # A line that is NULL has no fault as a whole, and no field of it is known. Lines are not filtered: the optimizer would repeat their making.
    head = F.when(text.isNull(), F.lit(b"")).when(whole, F.substring(text.cast("binary"), 1, end))
    heads = lines.select(_payload(F.col(line)).alias("_text")).select(head.alias("head"))
    blanks = bytes.maketrans(_RARE_BLANKS.encode(), b" " * len(_RARE_BLANKS))
    year_start, year_bytes = FIELD["birth_year"].start - 1, np.frombuffer(str(year).encode(), np.uint8)
    places, most = [(i, f.start - 1, f.width) for i, f in enumerate(FIELDS, start=1)], _COUNTED

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            for (i, _, width), parts in zip(places, zip(*held)):
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                raw = codes.astype("<u4").tobytes()
                texts = [raw[at:at + width].decode("ascii") for at in range(0, len(raw), 4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(texts), pa.int32()), pa.array(texts, pa.string()), pa.array(n, pa.int64())], names=["field_no", "text", "n"])

        for batch in batches:
            known = batch.column(0).drop_null().to_pylist()
            rows = np.frombuffer(b"".join(known).translate(blanks), np.uint8).reshape(-1, end)
            rows = rows[(rows[:, year_start:year_start + len(year_bytes)] == year_bytes).all(1)]
            unknown = known.count(b"")
            if unknown:
                rows = np.concatenate([rows, np.full((unknown, end), 0x20, np.uint8)])
            if not len(rows):
                continue
            codes = []
            for _, start, width in places:
                code = rows[:, start].astype(np.uint32)
                for k in range(1, width):
                    code |= rows[:, start + k].astype(np.uint32) << np.uint32(8 * k)
                codes.append(code)
            held.append(codes)
            size += len(rows)
            if size >= most:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()

    found = heads.mapInArrow(count, "field_no int, text string, n long")
    return found.groupBy("field_no", F.trim("text").alias("text")).agg(F.sum("n").alias("n"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("faults") == 0).drop("faults")


def rejects(parsed: DataFrame, keep: Sequence[str] = ("pos",)) -> DataFrame:
    """One row per fault: where and what kind, never the value."""
    kind = F.when(F.col("field") == "record", F.col("text")).otherwise(fault_kind(F.col("field"), F.col("text")))
    return parsed.where(F.size("faults") > 0).select(*keep, F.inline("faults")).select(*keep, "field", kind.alias("error"))


def parse_lenient(lines: DataFrame, keep: Sequence[str] = ("pos",), line: str = "value") -> DataFrame:
    """The 15-column evaluation table: blank lines skipped, short lines padded with missing, no range checks."""
    wanted = [FIELD[c] for c in EVALUATION_COLUMNS if c in FIELD] + [FIELD["residence_status"], FIELD["plurality"]]
    raw = cut_lines(lines, keep, wanted, line, lenient=True).where("_length > 0")

    def mapped(name: str) -> Column:
        text = F.col(name)
        whole = F.translate(text, "0123456789", "") == ""
        other = F.when(whole, text.try_cast("int").cast("string")).otherwise(text) if name == "prenatal_care_month" else text
        return F.when(~is_missing(FIELD[name], text), F.when(text == "Y", "1").when(text == "N", "0").otherwise(other))

    made = {
        "is_us_resident": code_flag(F.col("residence_status"), "123", "4").cast("string"),
        "is_singleton": code_flag(F.col("plurality"), "1", "2345").cast("string"),
    }
    return raw.select(*keep, *[(made[c] if c in made else mapped(c)).alias(c) for c in EVALUATION_COLUMNS])


#: Windows in which a source value is plausible enough to give a label.
PLAUSIBLE = {"gestation_oe_weeks": (17, 47), "birth_weight_g": (227, 8165)}


def normalize_frame(df: DataFrame) -> DataFrame:
    """Numeric columns cast strictly, missing label columns derived inside their plausibility windows.

    A text that is no number fails the query, as does a non-integer or out-of-codebook category.
    """
    numeric = [
        c for c in df.columns
        if c in EVALUATION_COLUMNS or c in ("target_preterm", "target_nicu", "target_lbw")
    ]
    out = df.withColumns({c: F.col(c).cast("double") for c in numeric})
    made = {}
    if "target_preterm" not in df.columns:
        low, high = PLAUSIBLE["gestation_oe_weeks"]
        weeks = F.col("gestation_oe_weeks")
        made["target_preterm"] = F.when(weeks.between(low, high), below(weeks, 37)).cast("double")
    if "target_lbw" not in df.columns:
        low, high = PLAUSIBLE["birth_weight_g"]
        grams = F.col("birth_weight_g")
        made["target_lbw"] = F.when(grams.between(low, high), below(grams, 2500)).cast("double")
    if "target_nicu" not in df.columns:
        made["target_nicu"] = F.col("admit_nicu")
    out = out.withColumns(made) if made else out
    race = F.col("mother_race")
    valid = race.isNull() | (race.between(1, 31) & (race == F.floor(race)))
    return out.withColumn("mother_race", F.when(valid, race).otherwise(
        F.raise_error(F.lit("category codes must be integers 1..31")).cast("double")))
