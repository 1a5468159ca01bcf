"""The registered queries as plain SQL over the same tables, for checking results with another engine."""

from __future__ import annotations

from quotalens.functions.fields import EVALUATION_COLUMNS, FEATURE_SETS, FIELD, FIELDS
from quotalens.plans import bindings as b
from quotalens.plans.catalog import INTERVAL_REPLICATES, REPLICATES, SEED

ORACLES: dict[str, str] = {}


def _round(sql: str, columns: list[str], digits: int = 9) -> str:
    """Round the named columns of a query."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in columns)}) FROM ({sql})"


def _ratio(top: str, bottom: str) -> str:
    return f"(({top})::DOUBLE / nullif({bottom}, 0)::DOUBLE)"


# --- Orders population ------------------------------------------------------------------------------------------

REC = """
rec AS (
  SELECT o_orderkey AS pos, floor(o_totalprice / 1000)::DOUBLE AS score, o_totalprice AS fine_score,
    (CASE WHEN month(o_orderdate) = 11 THEN 0 WHEN month(o_orderdate) = 12 THEN NULL ELSE month(o_orderdate) END)::INTEGER AS entry,
    (o_orderstatus = 'F')::INTEGER AS is_f,
    CASE WHEN o_orderstatus <> 'P' THEN (o_orderpriority = '1-URGENT')::INTEGER END AS is_urgent
  FROM orders)"""


def _pop(score: str = "score") -> str:
    return f"""WITH {REC},
pop AS (
  SELECT 'is_f' AS target, pos, {score} AS score, entry, is_f AS y FROM rec WHERE is_f IS NOT NULL
  UNION ALL SELECT 'is_urgent', pos, {score}, entry, is_urgent FROM rec WHERE is_urgent IS NOT NULL)"""


RANKED = """,
scen AS (
  SELECT *, 'early_entry' AS scenario FROM pop WHERE entry BETWEEN 1 AND 3
  UNION ALL SELECT *, 'any_prenatal_care' FROM pop WHERE entry BETWEEN 1 AND 10
  UNION ALL SELECT *, 'all_record_upper_bound' FROM pop),
rk AS (SELECT *, row_number() OVER (PARTITION BY target, scenario ORDER BY score DESC, pos) AS r FROM scen),
size AS (SELECT target, scenario, count(*) AS n, sum(y)::BIGINT AS e FROM scen GROUP BY ALL),
whole AS (SELECT target, count(*) AS n_all, sum(y)::BIGINT AS e_all FROM pop GROUP BY ALL),
qs AS (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE]) AS q)"""

EVENTS = """
ev AS (
  SELECT 'purchase' AS target, event_id AS pos, value AS score,
    (CASE WHEN user_id % 12 < 11 THEN user_id % 12 END)::INTEGER AS entry, (event_type = 'purchase')::INTEGER AS y,
    ts < TIMESTAMP '2024-01-21' AS calibration, user_id % 5 AS replicate
  FROM events)"""


def _budget(q: str, n: str) -> str:
    return f"greatest(1, round_even({q} * {n}, 0))::BIGINT"


CELLS = f""",
four AS (
  SELECT w.target, q, cell, budget_source, c.scenario, c.n AS candidate_n, c.e AS candidate_event_n, n_all, e_all,
    CASE budget_source WHEN 'early' THEN {_budget('q', 's.n')} ELSE {_budget('q', 'n_all')} END AS budget_n
  FROM whole w CROSS JOIN qs
  CROSS JOIN (VALUES ('C00', 'early_entry', 'early'), ('C10', 'all_record_upper_bound', 'early'),
                     ('C01', 'early_entry', 'all'), ('C11', 'all_record_upper_bound', 'all')) AS k(cell, cs, budget_source)
  JOIN size c ON c.target = w.target AND c.scenario = cs
  JOIN size s ON s.target = w.target AND s.scenario = 'early_entry'),
cells AS (
  SELECT f.target, q AS nominal_fraction, cell, f.scenario AS candidate_set, budget_source, candidate_n, candidate_event_n,
    n_all AS full_population_n, e_all AS full_population_event_n, budget_n, budget_n AS selected_n,
    sum(CASE WHEN r <= budget_n THEN y ELSE 0 END)::BIGINT AS true_positive_n
  FROM four f JOIN rk ON rk.target = f.target AND rk.scenario = f.scenario GROUP BY ALL),
four_cells AS (
  SELECT *, {_ratio('true_positive_n', 'selected_n')} AS precision,
    {_ratio('true_positive_n', 'full_population_event_n')} AS population_event_capture,
    {_ratio('true_positive_n', 'candidate_event_n')} AS eligible_recall,
    {_ratio('candidate_event_n', 'full_population_event_n')} AS event_ceiling
  FROM cells)"""

EFFECT_COLUMNS = """
    c10 - c00 AS availability_main_at_early_budget, c01 - c00 AS capacity_main_in_early_cohort,
    c11 - c10 - c01 + c00 AS interaction, c01 - c00 AS ordered_capacity_within_early_cohort,
    c11 - c01 AS ordered_availability_at_all_budget, c10 - c00 AS availability_at_early_budget,
    c11 - c10 AS capacity_in_all_cohort, 0.5::DOUBLE * ((c10 - c00) + (c11 - c01)) AS shapley_availability,
    0.5::DOUBLE * ((c01 - c00) + (c11 - c10)) AS shapley_capacity, c11 - c00 AS total_topq_contrast,
    (c11 - c00) - ((c10 - c00) + (c01 - c00) + (c11 - c10 - c01 + c00)) AS identity_factorial_error,
    (c11 - c00) - (0.5::DOUBLE * ((c10 - c00) + (c11 - c01)) + 0.5::DOUBLE * ((c01 - c00) + (c11 - c10))) AS identity_shapley_error,
    (c11 - c10 - c01 + c00) - ((c11 - c01) - (c10 - c00)) AS interaction_via_availability_error,
    (c11 - c10 - c01 + c00) - ((c11 - c10) - (c01 - c00)) AS interaction_via_capacity_error"""


def _cell(c: str, column: str) -> str:
    return f"max(CASE WHEN cell = '{c}' THEN {column} END)"


DECOMP = f""",
wide AS (
  SELECT target, nominal_fraction, {_cell('C00', 'candidate_n')} AS n_early, {_cell('C11', 'candidate_n')} AS n_all,
    {_cell('C00', 'candidate_event_n')} AS event_n_early, {_cell('C11', 'full_population_event_n')} AS event_n_all,
    {_cell('C00', 'budget_n')} AS B_early, {_cell('C11', 'budget_n')} AS B_all,
    {', '.join(f"{_cell(c, 'population_event_capture')} AS {c.lower()}, {_cell(c, 'true_positive_n')} AS {c}_tp" for c in ('C00', 'C10', 'C01', 'C11'))}
  FROM four_cells GROUP BY ALL),
decomposition AS (
  SELECT target, nominal_fraction, n_early, n_all, event_n_early, event_n_all, B_early, B_all,
    c00 AS C00_early_Bearly, c10 AS C10_all_Bearly, c01 AS C01_early_Ball, c11 AS C11_all_Ball, C00_tp, C10_tp, C01_tp, C11_tp,
    {EFFECT_COLUMNS}
  FROM wide)"""

ALL_CELLS = _pop() + RANKED + CELLS + DECOMP

ORACLES["four_cells"] = ALL_CELLS + " SELECT * FROM four_cells"
ORACLES["four_cells_bucketed"] = ORACLES["four_cells_clustered"] = ORACLES["four_cells"]
ORACLES["decomposition"] = ALL_CELLS + " SELECT * FROM decomposition"
ORACLES["sql_decomposition"] = ORACLES["decomposition"]
ORACLES["sql_top"] = f"""{_pop()} {RANKED} SELECT s.scenario, s.target, {_budget('0.03::DOUBLE', 'n')} AS budget_n,
  sum(CASE WHEN r <= {_budget('0.03::DOUBLE', 'n')} THEN y ELSE 0 END)::BIGINT AS true_positive_n
FROM size s JOIN rk ON rk.target = s.target AND rk.scenario = s.scenario GROUP BY ALL"""
ORACLES["capacity_share"] = ALL_CELLS + f""" SELECT target, nominal_fraction, shapley_capacity, total_topq_contrast,
  {_ratio('shapley_capacity', 'total_topq_contrast')} AS capacity_share FROM decomposition"""
HEADLINE = f"""SELECT target, nominal_fraction, B_all::DOUBLE / B_early::DOUBLE - 1 AS extra_selections,
  1.0::DOUBLE - {_ratio('C11_all_Ball - C01_early_Ball', 'C11_all_Ball - C00_early_Bearly')} AS gain_shrinkage,
  100 * (C10_all_Bearly - C00_early_Bearly) AS eligibility_pp_at_early_budget,
  100 * (C11_all_Ball - C01_early_Ball) AS eligibility_pp_at_all_budget,
  C01_early_Ball >= C00_early_Bearly AND C11_all_Ball >= C10_all_Bearly AND shapley_capacity >= 0 AS capacity_monotone
  FROM decomposition"""
ORACLES["headline"] = f"{ALL_CELLS} {HEADLINE}"
ORACLES["headline_range"] = f"""{ALL_CELLS} SELECT
  min(least(eligibility_pp_at_early_budget, eligibility_pp_at_all_budget)) AS min_eligibility_pp,
  max(greatest(eligibility_pp_at_early_budget, eligibility_pp_at_all_budget)) AS max_eligibility_pp,
  bool_and(capacity_monotone) AS all_monotone, count(*) AS rows FROM ({HEADLINE})"""
ORACLES["ordered_decomposition"] = ALL_CELLS + """ SELECT target, nominal_fraction, 'early_entry' AS from_scenario,
  'all_record_upper_bound' AS to_scenario, B_early AS from_cohort_budget_n, B_all AS to_cohort_budget_n,
  C00_tp AS from_tp_at_from_budget, C01_tp AS from_tp_at_to_budget, C11_tp AS to_tp_at_to_budget,
  c11 - c00 AS naive_top_fraction_effect, c11 - c01 AS availability_effect_at_to_budget,
  c01 - c00 AS capacity_effect_within_from_scenario, (c11 - c00) - ((c11 - c01) + (c01 - c00)) AS identity_error FROM wide"""
ORACLES["random_benchmark"] = ALL_CELLS + f""", cells0 AS (
  SELECT target, nominal_fraction, B_early, B_all, {_ratio('B_early', 'n_early')} * {_ratio('event_n_early', 'event_n_all')} AS C00,
    {_ratio('B_early', 'n_all')} AS C10, {_ratio('B_all', 'n_early')} * {_ratio('event_n_early', 'event_n_all')} AS C01,
    {_ratio('B_all', 'n_all')} AS C11 FROM decomposition)
  SELECT *, 0.5::DOUBLE * ((C01 - C00) + (C11 - C10)) AS shapley_capacity,
    {_ratio('0.5::DOUBLE * ((C01 - C00) + (C11 - C10))', 'C11 - C00')} AS random_capacity_share FROM cells0"""
ORACLES["identity_check"] = ALL_CELLS + "".join(
    f"{' UNION ALL' if i else ''} SELECT '{r}' AS residual, count(*) AS rows, max(abs({r})) <= 1e-12 AS holds FROM decomposition"
    for i, r in enumerate(("identity_factorial_error", "identity_shapley_error", "interaction_via_availability_error", "interaction_via_capacity_error"))
)


# --- Cohorts ----------------------------------------------------------------------------------------------------

FLOW_GROUPS = {
    "early_entry": "entry BETWEEN 1 AND 3", "later_entry": "entry BETWEEN 4 AND 10", "any_prenatal_care": "entry BETWEEN 1 AND 10",
    "no_care": "entry = 0", "unknown_care": "entry IS NULL", "all_record_upper_bound": "true",
}


def _flow(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT target, '{name}' AS scenario, count(*) FILTER (WHERE coalesce({rule}, false)) AS n_records, "
        f"coalesce(sum(y) FILTER (WHERE {rule}), 0)::BIGINT AS event_n FROM {source} GROUP BY target"
        for name, rule in FLOW_GROUPS.items()
    )


ORACLES["cohort_counts"] = f"{_pop()} {_flow('pop')}"
ORACLES["cohort_identities"] = f"""{_pop()}, flow AS ({_flow('pop')}), m AS (UNPIVOT flow ON n_records, event_n INTO NAME measure VALUE v)
SELECT target, whole, measure, sum(CASE WHEN scenario = whole THEN v END)::BIGINT AS whole_n,
  sum(CASE WHEN scenario <> whole THEN v END)::BIGINT AS parts_n,
  sum(CASE WHEN scenario = whole THEN v END) = sum(CASE WHEN scenario <> whole THEN v END) AS holds
FROM m JOIN (VALUES ('any_prenatal_care', 'any_prenatal_care'), ('any_prenatal_care', 'early_entry'), ('any_prenatal_care', 'later_entry'),
  ('all_record_upper_bound', 'all_record_upper_bound'), ('all_record_upper_bound', 'any_prenatal_care'),
  ('all_record_upper_bound', 'no_care'), ('all_record_upper_bound', 'unknown_care')) AS k(whole, part) ON scenario = part
GROUP BY target, whole, measure"""
ORACLES["entry_groups"] = f"""{_pop()} SELECT target, CASE WHEN entry IS NULL THEN 'unknown_care' WHEN entry = 0 THEN 'no_care'
  WHEN entry <= 3 THEN 'early_entry' ELSE 'later_entry' END AS entry_group, count(*) AS n_records, sum(y)::BIGINT AS event_n
FROM pop GROUP BY ALL"""
U = "(('0x' || substr(md5({0}), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"
ORACLES["hash_split"] = f"""SELECT o_orderkey AS pos, {U.format("concat_ws('|', 2026, o_orderkey)")} < 0.2 AS calibration FROM orders"""
ORACLES["period_split"] = f"""WITH {EVENTS} SELECT calibration, count(*) AS n_records, sum(y)::BIGINT AS event_n,
  count(*) FILTER (WHERE coalesce(entry BETWEEN 1 AND 3, false)) AS early_n FROM ev GROUP BY calibration"""

# --- Protocols --------------------------------------------------------------------------------------------------

PROTOCOLS = f""",
cuts AS (
  SELECT w.target, q, score AS t FROM whole w CROSS JOIN qs
  JOIN rk ON rk.target = w.target AND scenario = 'all_record_upper_bound' AND r = {_budget('q', 'n_all')}),
asked AS (
  SELECT s.target, s.scenario, 'cohort_specific_top_fraction' AS protocol, q, {_budget('q', 's.n')} AS budget_n, NULL::DOUBLE AS threshold
    FROM size s CROSS JOIN qs
  UNION ALL SELECT s.target, s.scenario, 'fixed_absolute_budget', q, {_budget('q', 'n_all')}, NULL FROM size s JOIN whole USING (target) CROSS JOIN qs
  UNION ALL SELECT s.target, s.scenario, 'fixed_calibration_threshold', q, NULL, t FROM size s JOIN cuts USING (target)),
picked AS (
  SELECT a.target, a.scenario AS availability_scenario, protocol, q AS nominal_fraction, budget_n, threshold,
    count(*) FILTER (WHERE CASE WHEN budget_n IS NOT NULL THEN r <= budget_n ELSE score >= threshold END) AS selected_n,
    sum(CASE WHEN CASE WHEN budget_n IS NOT NULL THEN r <= budget_n ELSE score >= threshold END THEN y ELSE 0 END)::BIGINT AS true_positive_n
  FROM asked a JOIN rk ON rk.target = a.target AND rk.scenario = a.scenario GROUP BY ALL),
protocols AS (
  SELECT p.target, availability_scenario, protocol, nominal_fraction, budget_n, threshold, n_all AS full_population_n,
    e_all AS full_population_event_n, n AS eligible_n, e AS eligible_event_n, selected_n, true_positive_n,
    {_ratio('selected_n', 'n')} AS selection_rate_among_eligible, {_ratio('true_positive_n', 'selected_n')} AS precision,
    {_ratio('true_positive_n', 'e')} AS recall_among_eligible, {_ratio('true_positive_n', 'e_all')} AS population_event_capture,
    {_ratio('e', 'e_all')} AS event_availability_ceiling
  FROM picked p JOIN size s ON s.target = p.target AND s.scenario = availability_scenario JOIN whole w ON w.target = p.target)"""
ALL_PROTOCOLS = _pop() + RANKED + PROTOCOLS

ORACLES["protocols"] = ORACLES["protocols_clustered"] = ALL_PROTOCOLS + " SELECT * FROM protocols"
for _name, _label in (("protocol_a", "cohort_specific_top_fraction"), ("protocol_b", "fixed_absolute_budget"), ("protocol_c", "fixed_calibration_threshold")):
    ORACLES[_name] = f"{ALL_PROTOCOLS} SELECT * FROM protocols WHERE protocol = '{_label}'"

PAIRS = """(VALUES ('early_entry', 'any_prenatal_care'), ('any_prenatal_care', 'all_record_upper_bound'),
  ('early_entry', 'all_record_upper_bound')) AS pair(from_scenario, to_scenario)"""
_MEASURED = ("eligible_n", "selected_n", "true_positive_n", "precision", "recall_among_eligible", "population_event_capture", "event_availability_ceiling")
COMPARISONS = f""",
comparisons AS (
  SELECT a.target, a.protocol, a.nominal_fraction, from_scenario, to_scenario,
    {', '.join(f'a.{m} AS from_{m}, b.{m} AS to_{m}' + ('' if m in ('eligible_n', 'event_availability_ceiling') else f', b.{m} - a.{m} AS delta_{m}') for m in _MEASURED)}
  FROM {PAIRS} JOIN protocols a ON a.availability_scenario = from_scenario
  JOIN protocols b ON b.availability_scenario = to_scenario AND b.target = a.target AND b.protocol = a.protocol AND b.nominal_fraction = a.nominal_fraction)"""
ORACLES["comparisons"] = ALL_PROTOCOLS + COMPARISONS + " SELECT * FROM comparisons"
def _side(name: str, score: str) -> str:
    return f"""SELECT target, nominal_fraction, 100 * total_topq_contrast AS {name}_topq_total_pp,
  100 * ordered_availability_at_all_budget AS {name}_fixed_budget_early_all_pp, 100 * shapley_availability AS {name}_shapley_availability_pp,
  100 * shapley_capacity AS {name}_shapley_capacity_pp, 100 * interaction AS {name}_interaction_pp,
  100 * delta_population_event_capture AS {name}_threshold_early_all_pp,
  {_ratio('shapley_capacity', 'total_topq_contrast')} AS {name}_capacity_share
  FROM ({_pop(score)} {RANKED} {CELLS} {DECOMP} {PROTOCOLS} {COMPARISONS}
    SELECT * FROM decomposition JOIN comparisons USING (target, nominal_fraction) WHERE protocol = 'fixed_calibration_threshold'
      AND from_scenario = 'early_entry' AND to_scenario = 'all_record_upper_bound')"""


ORACLES["sensitivity"] = f"""SELECT *,
  {', '.join(f'fine_{m}_pp - coarse_{m}_pp AS delta_{m}_pp' for m in ('topq_total', 'fixed_budget_early_all', 'shapley_availability', 'shapley_capacity', 'interaction', 'threshold_early_all'))},
  {_ratio('fine_topq_total_pp', 'coarse_topq_total_pp')} AS topq_total_ratio,
  {_ratio('fine_shapley_availability_pp', 'coarse_shapley_availability_pp')} AS shapley_availability_ratio
FROM ({_side('coarse', 'score')}) JOIN ({_side('fine', 'fine_score')}) USING (target, nominal_fraction)"""

ORACLES["marginal_yield"] = ALL_PROTOCOLS + f""" SELECT a.target, a.nominal_fraction, b.selected_n - a.selected_n AS added_selected_n,
  b.true_positive_n - a.true_positive_n AS added_event_n,
  {_ratio('100 * (b.true_positive_n - a.true_positive_n)', 'b.selected_n - a.selected_n')} AS events_per_100_added,
  {_ratio('100 * c.selected_n', 'c.eligible_n')} AS threshold_early_rate_pct, {_ratio('100 * d.selected_n', 'd.eligible_n')} AS threshold_all_rate_pct,
  {_ratio('d.selected_n', 'c.selected_n')} AS threshold_workload_ratio,
  100 * (d.population_event_capture - c.population_event_capture) AS threshold_capture_gain_pp
FROM protocols a JOIN protocols b USING (target, nominal_fraction) JOIN protocols c USING (target, nominal_fraction) JOIN protocols d USING (target, nominal_fraction)
WHERE a.protocol = 'cohort_specific_top_fraction' AND b.protocol = a.protocol AND c.protocol = 'fixed_calibration_threshold' AND d.protocol = c.protocol
  AND a.availability_scenario = 'early_entry' AND c.availability_scenario = 'early_entry'
  AND b.availability_scenario = 'all_record_upper_bound' AND d.availability_scenario = 'all_record_upper_bound'"""
_RULES = {
    "row_count": "(SELECT count(*) = 18 FROM protocols p WHERE p.target = w.target)",
    "population_constant": "(SELECT count(DISTINCT full_population_n) = 1 FROM protocols p WHERE p.target = w.target)",
    "events_constant": "(SELECT count(DISTINCT full_population_event_n) = 1 FROM protocols p WHERE p.target = w.target)",
    "top_fraction_exact": f"(SELECT bool_and(selected_n = {_budget('nominal_fraction', 'eligible_n')}) FROM protocols p WHERE p.target = w.target AND protocol = 'cohort_specific_top_fraction')",
    "fixed_budget_common": "(SELECT count(DISTINCT (nominal_fraction, selected_n)) = 2 AND bool_and(selected_n = budget_n) FROM protocols p WHERE p.target = w.target AND protocol = 'fixed_absolute_budget')",
    "threshold_common": "(SELECT count(DISTINCT (nominal_fraction, threshold)) = 2 FROM protocols p WHERE p.target = w.target AND protocol = 'fixed_calibration_threshold')",
    "ceilings_nested": "(SELECT max(event_availability_ceiling) FILTER (WHERE availability_scenario = 'early_entry') <= max(event_availability_ceiling) FILTER (WHERE availability_scenario = 'any_prenatal_care') FROM protocols p WHERE p.target = w.target)",
    "full_ceiling_is_one": "(SELECT bool_and(event_availability_ceiling = 1) FROM protocols p WHERE p.target = w.target AND availability_scenario = 'all_record_upper_bound')",
}
ORACLES["protocol_invariants"] = ALL_PROTOCOLS + " UNION ALL".join(
    f' SELECT target, \'{name}\' AS "check", {rule} AS holds FROM whole w' for name, rule in _RULES.items())
ORACLES["cutoffs_from_protocols"] = f"{ALL_PROTOCOLS} SELECT target, q AS nominal_fraction, t AS threshold FROM cuts WHERE q = 0.1"

ORACLES["ranked_early"] = f"""{_pop()} {RANKED} SELECT target, pos, r AS rank,
  (sum(y) OVER (PARTITION BY target ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING))::BIGINT AS cum_event_n
FROM rk WHERE scenario = 'early_entry'"""
ORACLES["ranked_sliced"] = ORACLES["ranked_early"].replace("'early_entry'\"", "").rsplit("WHERE", 1)[0] + "WHERE scenario = 'all_record_upper_bound'"
ORACLES["capture_curve"] = f"""{_pop()} {RANKED} SELECT target, pos, score, y, r AS cum_n,
  (sum(y) OVER (PARTITION BY target ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING))::BIGINT AS cum_event_n
FROM rk WHERE scenario = 'any_prenatal_care'"""
ORACLES["selected_rows"] = f"""{_pop()} {RANKED} SELECT rk.target, rk.scenario, pos, score, y FROM rk JOIN size USING (target, scenario)
WHERE scenario = 'early_entry' AND r <= {_budget('0.1::DOUBLE', 'n')}"""
ORACLES["selected_rows_clustered"] = ORACLES["selected_rows"]
ORACLES["threshold_rows"] = f"WITH {EVENTS} SELECT pos, score, y FROM ev WHERE NOT calibration AND score >= 100 AND entry BETWEEN 1 AND 3"

# --- Thresholds -------------------------------------------------------------------------------------------------

CAL = f"""
cal AS (SELECT *, row_number() OVER (ORDER BY score DESC, pos) AS r, count(*) OVER () AS n FROM ev WHERE calibration),
qs AS (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE]) AS q),
cuts AS (SELECT target, q, n, {_budget('q', 'n')} AS k, score AS t FROM cal JOIN qs ON r = {_budget('q', 'n')})"""
ORACLES["kth_scores"] = f"""WITH {EVENTS}, {CAL} SELECT target, q AS nominal_fraction, n AS calibration_n, k AS nominal_selected_n, t AS threshold FROM cuts"""
ORACLES["realized_with_ties"] = f"""WITH {EVENTS.replace('value AS score', 'floor(value) AS score')}, {CAL}
SELECT cuts.target, q AS nominal_fraction, cuts.n AS calibration_n, k AS nominal_selected_n, t AS threshold,
  count(*) FILTER (WHERE score >= t) AS realized_selected_n_with_ties FROM cuts JOIN cal USING (target) GROUP BY ALL"""


def _transport(t: str, variants: tuple[str, ...]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT target, q AS nominal_fraction, '{v}' AS threshold_precision, {t if v == 'exact' else f'round({t}, 6)'} AS threshold FROM cuts"
        for v in variants)
    return f"""WITH {EVENTS}, {CAL}, used AS ({rows}), eva AS (SELECT * FROM ev WHERE NOT calibration),
moved AS (
  SELECT used.target, nominal_fraction, threshold_precision, threshold, count(*) AS N_all, sum(y)::BIGINT AS E_all,
    count(*) FILTER (WHERE score >= threshold) AS selected_n, sum(CASE WHEN score >= threshold THEN y ELSE 0 END)::BIGINT AS TP
  FROM used JOIN eva USING (target) GROUP BY ALL),
transport AS (
  SELECT *, {_ratio('selected_n', 'N_all')} AS selection_rate, {_ratio('TP', 'E_all')} AS population_event_capture,
    {_ratio('TP', 'selected_n')} AS precision FROM moved)"""


ORACLES["threshold_transport"] = _transport("t / 7", ("exact", "rounded_6dp")) + " SELECT * FROM transport"
ORACLES["period_transport"] = ORACLES["threshold_transport"]
ORACLES["period_cutoffs"] = " UNION ALL ".join(
    f"(WITH {EVENTS}, {CAL.replace('WHERE calibration', rule)} SELECT target, q AS nominal_fraction, n AS calibration_n, k AS nominal_selected_n, "
    f"t AS threshold, '{label}' AS periods FROM cuts)" for label, rule in (("both", ""), ("calibration", "WHERE calibration")))
ORACLES["streamed_workload"] = f"""WITH {EVENTS}, {CAL},
days AS (
  SELECT date_trunc('day', ts) AS day, value AS score, (event_type = 'purchase')::INTEGER AS y, max(ts) OVER () AS newest
  FROM events WHERE ts >= TIMESTAMP '2024-01-21'),
closed AS (
  SELECT target, strftime(day, '%Y-%m-%d') AS window_start, strftime(day + INTERVAL 1 DAY, '%Y-%m-%d') AS window_end, q AS nominal_fraction,
    t AS threshold, count(*) AS N_all, sum(y)::BIGINT AS E_all, count(*) FILTER (WHERE score >= t) AS selected_n,
    sum(CASE WHEN score >= t THEN y ELSE 0 END)::BIGINT AS TP
  FROM days CROSS JOIN cuts WHERE day + INTERVAL 1 DAY <= newest - INTERVAL 2 DAY GROUP BY ALL)
SELECT *, {_ratio('selected_n', 'N_all')} AS selection_rate, {_ratio('TP', 'E_all')} AS population_event_capture, {_ratio('TP', 'selected_n')} AS precision,
  {_ratio('E_all', 'N_all')} AS prevalence, {_budget('nominal_fraction', 'N_all')} AS nominal_selected_n,
  selected_n - {_budget('nominal_fraction', 'N_all')} AS workload_difference_n FROM closed"""
ORACLES["workload_difference"] = _transport("t", ("exact",)) + f""" SELECT * EXCLUDE (threshold_precision), {_ratio('E_all', 'N_all')} AS prevalence,
  {_budget('nominal_fraction', 'N_all')} AS nominal_selected_n, selected_n - {_budget('nominal_fraction', 'N_all')} AS workload_difference_n FROM transport"""
ORACLES["threshold_binding"] = _pop("fine_score") + RANKED + PROTOCOLS + """ SELECT target, q AS nominal_fraction, round(t, -1) AS supplied, t AS expected
FROM cuts WHERE target = 'is_f' AND round(t, -1) <> t"""
ORACLES["threshold_problems"] = ALL_PROTOCOLS + """, given AS (
  SELECT target, q AS nominal_fraction, t / 500 AS threshold FROM cuts WHERE target = 'is_f'
  UNION ALL SELECT target, q, t / 500 * 2 FROM cuts WHERE target = 'is_f' AND q = 0.05)
SELECT 'is_urgent' AS target, q AS nominal_fraction, 'missing' AS problem FROM qs
UNION ALL SELECT target, nominal_fraction, 'duplicate' FROM given GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT target, nominal_fraction, 'not a probability' FROM given WHERE threshold < 0 OR threshold > 1
UNION ALL SELECT target, nominal_fraction, 'source_year is not 2022' FROM given"""

# --- Diagnostics ------------------------------------------------------------------------------------------------


def _diagnostics(source: str, keys: str) -> str:
    """Tie-aware AUC, average precision and Brier score, written over distinct scores."""
    return f"""SELECT {keys}, n, event_n, event_n::DOUBLE / n AS prevalence, gain / event_n AS pr_auc,
  wins / (event_n::DOUBLE * (n - event_n)) AS roc_auc, sq / n AS brier
FROM (
  SELECT {keys}, sum(dn)::BIGINT AS n, sum(de)::BIGINT AS event_n, sum(sq) AS sq,
    sum((dn - de) * (cum_e - de / 2.0::DOUBLE)) AS wins, sum(de * (cum_e::DOUBLE / cum_n)) AS gain
  FROM (
    SELECT *, sum(dn) OVER w AS cum_n, sum(de) OVER w AS cum_e
    FROM (SELECT {keys}, score, count(*) AS dn, sum(y) AS de, sum((score - y) * (score - y)) AS sq FROM {source} GROUP BY ALL)
    WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
  GROUP BY {keys})"""


DOCS = """
doc AS (
  SELECT doc_id AS pos, n_chars / (n_chars + 1000.0::DOUBLE) AS score, quality, toxic FROM documents JOIN labels USING (doc_id)),
pop AS (SELECT 'quality' AS target, pos, score, quality AS y FROM doc WHERE quality IS NOT NULL
  UNION ALL SELECT 'toxic', pos, score, toxic FROM doc WHERE toxic IS NOT NULL)"""
_RATES = ["prevalence", "pr_auc", "roc_auc", "brier"]
ORACLES["model_diagnostics"] = _round(f"WITH {DOCS} {_diagnostics('pop', 'target')}", _RATES)
ORACLES["model_diagnostics_bucketed"] = _round(f"{_pop()} {_diagnostics('pop', 'target')}", _RATES)
_PERIODS = f"""WITH {EVENTS.replace('value AS score', '(value / (value + 100.0::DOUBLE)) AS score')}, diag AS ({_diagnostics('ev', 'target, calibration')})
SELECT a.target, {', '.join(f'a.{m} AS calibration_{m}, b.{m} AS evaluation_{m}' for m in ('n', 'event_n', *_RATES))}
FROM diag a JOIN diag b USING (target) WHERE a.calibration AND NOT b.calibration"""
ORACLES["period_diagnostics"] = _round(_PERIODS, [f"{p}_{m}" for p in ("calibration", "evaluation") for m in _RATES])
ORACLES["drift_skill"] = _round(f"""SELECT target, abs(evaluation_roc_auc - calibration_roc_auc) AS roc_auc_drift,
  abs(evaluation_pr_auc - calibration_pr_auc) AS pr_auc_drift,
  1 - evaluation_brier / (evaluation_prevalence * (1 - evaluation_prevalence)) AS brier_skill FROM ({_PERIODS})""",
    ["roc_auc_drift", "pr_auc_drift", "brier_skill"])
_CLIPPED = "greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, score))"
PLATT = f"1 / (1 + exp(-(-0.7::DOUBLE + 1.4::DOUBLE * (ln({_CLIPPED}) - ln(1 - {_CLIPPED})))))"
ORACLES["platt_scores"] = _round(f"WITH {DOCS} SELECT target, pos, greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, {PLATT})) AS calibrated FROM pop", ["calibrated"])
ORACLES["platt_rank_check"] = f"""WITH {DOCS}, both_ranks AS (
  SELECT target, row_number() OVER (PARTITION BY target ORDER BY score DESC, pos) AS a,
    row_number() OVER (PARTITION BY target ORDER BY {PLATT} DESC, pos) AS b FROM pop)
SELECT target, count(*) AS rows, count(*) FILTER (WHERE a <> b) AS moved_n FROM both_ranks GROUP BY target"""

# --- Cleaning ---------------------------------------------------------------------------------------------------

BAD, GAP = f"k % {b.FAULTY_EVERY} = ", f"k % {b.MISSING_EVERY} = "
WHOLE_BAD = f"(k % {b.CUT_EVERY} = 0 OR k % {b.ODD_EVERY} = 0 OR {BAD}0)"
NO_FAULT = f"k % {b.FAULTY_EVERY} >= {len(FIELDS)} AND NOT {WHOLE_BAD}"


def _expected(i: int, name: str) -> str:
    """The clean value of field ``i``, from the rule that made it."""
    f, code = FIELD[name], b.field_code(i)
    if name == "birth_year":
        return f"CASE WHEN {BAD}0 THEN 2021 WHEN {GAP}0 THEN 2022 ELSE 2022 END"
    if f.kind == "boolean":
        good = f"(1 - {code} % 2)::INTEGER"
    elif f.kind == "category":
        good = f"[{', '.join(repr(a) for a in f.allowed)}][{code} % {len(f.allowed)} + 1]"
    elif f.kind == "float":
        good = f"(({round(f.low * 10)} + {code} % {round((f.high - f.low) * 10) + 1}) / 10.0::DOUBLE)"
    else:
        good = f"({int(f.low)} + {code} % {int(f.high - f.low) + 1})::INTEGER"
    return f"CASE WHEN {BAD}{i} OR {GAP}{i % b.MISSING_EVERY} THEN NULL ELSE {good} END"


_K = f"keyed AS (SELECT {b.LINE_COLUMNS} FROM orders)"
CLEAN = f"""WITH {_K}, fields AS (
  SELECT k AS pos, {', '.join(f'{_expected(i, f.name)} AS {f.name}' for i, f in enumerate(FIELDS))} FROM keyed WHERE {NO_FAULT}),
clean AS (
  SELECT *, CASE WHEN residence_status IN ('1', '2', '3') THEN 1 WHEN residence_status = '4' THEN 0 END AS is_us_resident,
    CASE WHEN plurality = '1' THEN 1 WHEN plurality IS NOT NULL THEN 0 END AS is_singleton,
    (gestation_oe_weeks < 37)::INTEGER AS target_preterm, admit_nicu AS target_nicu, (birth_weight_g < 2500)::INTEGER AS target_lbw,
    diab_gest AS target_gdm FROM fields)"""
ORACLES["fixed_width_parse"] = CLEAN + " SELECT * FROM clean"
ORACLES["derive_targets"] = CLEAN + " SELECT pos, is_us_resident, is_singleton, target_preterm, target_nicu, target_lbw, target_gdm FROM clean"
ORACLES["canonical_text"] = CLEAN + """ SELECT pos, CASE WHEN mother_bmi IS NULL THEN '' ELSE replace(printf('%.1f', mother_bmi), '.0', '') END AS mother_bmi,
  coalesce(birth_weight_g::VARCHAR, '') AS birth_weight_g, coalesce(mother_race, '') AS mother_race, coalesce(wic_benefits::VARCHAR, '') AS wic_benefits FROM clean"""
ORACLES["normalized_frame"] = CLEAN + """ SELECT pos, is_us_resident::DOUBLE AS is_us_resident, prenatal_care_month::DOUBLE AS prenatal_care_month,
  mother_race::DOUBLE AS mother_race, gestation_oe_weeks::DOUBLE AS gestation_oe_weeks, birth_weight_g::DOUBLE AS birth_weight_g,
  admit_nicu::DOUBLE AS admit_nicu, target_preterm::DOUBLE AS target_preterm, target_nicu::DOUBLE AS target_nicu, target_lbw::DOUBLE AS target_lbw FROM clean"""
ORACLES["primary_cohort_flow"] = CLEAN + f""", long AS (
  SELECT target, prenatal_care_month AS entry, y FROM (
    SELECT 'target_preterm' AS target, prenatal_care_month, target_preterm AS y FROM clean WHERE is_us_resident = 1 AND is_singleton = 1
    UNION ALL SELECT 'target_nicu', prenatal_care_month, target_nicu FROM clean WHERE is_us_resident = 1 AND is_singleton = 1
    UNION ALL SELECT 'target_lbw', prenatal_care_month, target_lbw FROM clean WHERE is_us_resident = 1 AND is_singleton = 1)
  WHERE y IS NOT NULL) {_flow('long')}"""


def _kind(i: int, name: str) -> str:
    f = FIELD[name]
    if f.kind == "boolean":
        return "invalid boolean code"
    if f.kind == "category":
        return "invalid category code"
    return "not a number" if b.field_text(i, f)[2] == "x" else "above maximum"


ORACLES["rejects"] = f"WITH {_K} " + " UNION ALL ".join([
    f"SELECT k AS pos, 'record' AS field, CASE WHEN k % {b.CUT_EVERY} = 0 THEN 'record length' WHEN k % {b.ODD_EVERY} = 0 THEN 'not ASCII' "
    f"ELSE 'record year' END AS error FROM keyed WHERE {WHOLE_BAD}",
    *[f"SELECT k, '{f.name}', '{_kind(i, f.name)}' FROM keyed WHERE {BAD}{i} AND NOT {WHOLE_BAD}" for i, f in enumerate(FIELDS) if i],
])
ORACLES["field_profile"] = f"WITH {_K}, judged AS (SELECT * FROM keyed WHERE NOT {WHOLE_BAD}) " + " UNION ALL ".join(
    f"SELECT {i + 1} AS field_no, '{f.name}' AS field, '{f.kind}' AS kind, '{f.role}' AS role, "
    f"count({_expected(i, f.name)}) AS known_n, count(*) FILTER (WHERE {BAD}{i}) AS rejected_n, "
    f"count(*) - count({_expected(i, f.name)}) - count(*) FILTER (WHERE {BAD}{i}) AS missing_n FROM judged".replace("'float'", "'float'")
    for i, f in enumerate(FIELDS)
)


_USED = [f for f in FIELDS if f.name in (*EVALUATION_COLUMNS, "residence_status", "plurality")]


def _shown(f) -> str:
    """The raw text of a field in the lenient lines: empty where the line was cut before the field ends."""
    raw = b.field_sql(FIELDS.index(f), f)
    return f"CASE WHEN k % {b.CUT_EVERY} = 0 THEN '' ELSE {raw} END" if f.end > 300 else raw


def _mapped(name: str) -> str:
    if name == "is_us_resident":
        return "CASE WHEN residence_status IN ('1', '2', '3') THEN '1' WHEN residence_status = '4' THEN '0' END AS is_us_resident"
    if name == "is_singleton":
        return "CASE WHEN plurality = '1' THEN '1' WHEN plurality IN ('2', '3', '4', '5') THEN '0' END AS is_singleton"
    missing = ", ".join(f"'{m}'" for m in ("", *FIELD[name].missing))
    other = f"coalesce(try_cast({name} AS INTEGER)::VARCHAR, {name})" if name == "prenatal_care_month" else name
    return f"CASE WHEN {name} IN ({missing}) THEN NULL WHEN {name} = 'Y' THEN '1' WHEN {name} = 'N' THEN '0' ELSE {other} END AS {name}"


ORACLES["fixed_width_lenient"] = (
    f"WITH {_K}, shown AS (SELECT k, {', '.join(f'{_shown(f)} AS {f.name}' for f in _USED)} FROM keyed WHERE k % {b.ODD_EVERY} <> 0) "
    f"SELECT k AS pos, {', '.join(_mapped(c) for c in EVALUATION_COLUMNS)} FROM shown"
)

ORACLES["table_fingerprint"] = """SELECT count(*) AS rows, bit_xor(code) AS xor_hash, sum(code)::VARCHAR AS sum_hash FROM (
  SELECT ('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, round(o_totalprice * 100)::BIGINT, o_orderpriority)), 1, 13))::BIGINT AS code FROM orders)"""

ORACLES["csv_round_trip"] = "SELECT o_totalprice, o_orderkey, o_orderpriority FROM orders"
ORACLES["threshold_source"] = f"""WITH {EVENTS}, {CAL} SELECT target, q AS nominal_fraction, t AS threshold, 2022 AS source_year, '>=' AS comparator FROM cuts"""
ORACLES["published_table"] = "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"
ORACLES["score_export"] = f"{_pop()} SELECT target, count(*) AS rows, sum(y)::BIGINT AS event_n, count(entry) AS known_entry_n, sum(score) AS score_sum FROM pop GROUP BY target"
ORACLES["guarded_table"] = ORACLES["score_export"]
ORACLES["committed_tables"] = f"""{ALL_CELLS}, h AS ({HEADLINE})
SELECT h.*, d.shapley_capacity, d.total_topq_contrast FROM h JOIN decomposition d ON d.target = h.target AND d.nominal_fraction = h.nominal_fraction"""
ORACLES["run_record"] = ORACLES["table_fingerprint"].replace("SELECT count(*)", "SELECT 'PASS' AS status, count(*)", 1)
ORACLES["file_lock"] = """SELECT input, violation_n::BIGINT AS violation_n, (SELECT count(*) FROM orders) AS line_n
FROM (VALUES ('match', 0), ('changed', 1), ('missing', 1), ('additional', 1)) AS cases(input, violation_n)"""

# --- Checks -----------------------------------------------------------------------------------------------------
ORACLES["score_guard"] = f"""WITH {EVENTS}, {CAL} SELECT input, plan, input <> 'finite' AS refused,
  CASE WHEN input = 'finite' THEN (SELECT sum(t) FROM cuts) END AS threshold_sum
FROM (VALUES ('finite'), ('missing'), ('nan'), ('infinite')) AS i(input) CROSS JOIN (VALUES ('one task'), ('buckets')) AS p(plan)"""

ORACLES["binary_check"] = f"WITH {REC}, r2 AS (SELECT *, entry AS month FROM rec) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing_n, count(*) FILTER (WHERE coalesce({c} NOT IN (0, 1), false)) AS nonbinary_n, "
    f"count(*) FILTER (WHERE {c} IS NULL) = 0 AND count(*) FILTER (WHERE coalesce({c} NOT IN (0, 1), false)) = 0 AS valid FROM r2" for c in ("is_f", "is_urgent", "month"))
ORACLES["entry_check"] = """SELECT event_type, count(*) AS rows, count(e) AS known_n, count(*) FILTER (WHERE e < 0 OR e > 10) AS outside_n,
  count(*) FILTER (WHERE e <> round(e)) AS fractional_n, count(e) > 0 AND count(*) FILTER (WHERE e < 0 OR e > 10) = 0 AND count(*) FILTER (WHERE e <> round(e)) = 0 AS valid
FROM (SELECT event_type, value / 10 AS e FROM events) GROUP BY event_type"""
ORACLES["entry_violations"] = "SELECT o_orderkey AS pos, (month(o_orderdate) - 1)::DOUBLE AS entry FROM orders WHERE month(o_orderdate) - 1 > 10"
ORACLES["score_check"] = f"{_pop()} SELECT target, count(*) AS rows, count(*) FILTER (WHERE score > 480) AS nonfinite_n, count(*) FILTER (WHERE score > 480) = 0 AS valid FROM pop GROUP BY target"
ORACLES["position_check"] = "SELECT l_returnflag AS target, l_orderkey AS pos, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1"

# --- Bootstrap --------------------------------------------------------------------------------------------------

DRAWS = f""",
base AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, pos) AS rk0, count(*) OVER (PARTITION BY target) AS n0 FROM pop),
draws AS (
  SELECT target, replicate, (floor({U.format(f"concat_ws('|', {SEED}, target, replicate, rk0 - 1)")} * n0) + 1)::BIGINT AS rk0
  FROM base CROSS JOIN (SELECT unnest(range({REPLICATES}))::INTEGER AS replicate)),
weights AS (SELECT target, replicate, rk0, count(*) AS w FROM draws GROUP BY ALL),
boot AS (SELECT weights.target, replicate, w, pos, score, entry, y FROM weights JOIN base USING (target, rk0)),
ev_n AS (SELECT target, replicate, sum(w)::BIGINT AS sample_n, sum(w * y)::BIGINT AS event_n FROM boot GROUP BY ALL),
bscen AS (
  SELECT *, 'early_entry' AS scenario FROM boot WHERE entry BETWEEN 1 AND 3
  UNION ALL SELECT *, 'any_prenatal_care' FROM boot WHERE entry BETWEEN 1 AND 10
  UNION ALL SELECT *, 'all_record_upper_bound' FROM boot),
brk AS (SELECT *, sum(w) OVER (PARTITION BY target, replicate, scenario ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING) AS upto FROM bscen)"""
_TAKEN = "sum(y * least(w, greatest(0, {0} - (upto - w))))::BIGINT"
BOOT_CELLS = f""",
bcells AS (
  SELECT f.target, f.q AS nominal_fraction, f.cell, replicate, {_TAKEN.format('f.budget_n')} AS tp
  FROM four f JOIN brk ON brk.target = f.target AND brk.scenario = f.scenario GROUP BY f.target, f.q, f.cell, replicate),
bwide AS (
  SELECT b.target, nominal_fraction, b.replicate, event_n AS full_event_n,
    {', '.join(f"max(CASE WHEN cell = '{c}' THEN tp END) AS {c}_tp" for c in ('C00', 'C10', 'C01', 'C11'))}
  FROM bcells b JOIN ev_n ON ev_n.target = b.target AND ev_n.replicate = b.replicate GROUP BY ALL),
bcap AS (
  SELECT *, {', '.join(f'{c}_tp::DOUBLE / full_event_n AS {c.lower()}' for c in ('C00', 'C10', 'C01', 'C11'))} FROM bwide),
breps AS (
  SELECT bcap.target, bcap.nominal_fraction, replicate, full_event_n, d.B_early, d.B_all, bcap.C00_tp, bcap.C10_tp, bcap.C01_tp, bcap.C11_tp, {EFFECT_COLUMNS}
  FROM bcap JOIN (SELECT target, nominal_fraction, B_early, B_all FROM wide) d ON d.target = bcap.target AND d.nominal_fraction = bcap.nominal_fraction)"""
ALL_BOOT = ALL_CELLS + DRAWS + BOOT_CELLS

ORACLES["bootstrap_counts"] = f"""{_pop()} {DRAWS} SELECT target, replicate, sum(w)::BIGINT AS drawn_n, count(*) AS distinct_n, max(w) AS largest_w,
  sum(w * y)::BIGINT AS event_n FROM boot GROUP BY ALL"""
ORACLES["bootstrap_cells"] = ALL_BOOT + " SELECT * FROM breps"
ORACLES["bootstrap_row_check"] = ALL_BOOT + f""", judged AS (
  SELECT 'whole' AS input, target, nominal_fraction, replicate FROM breps UNION ALL
  SELECT 'without the first', target, nominal_fraction, replicate FROM breps WHERE replicate > 0 UNION ALL
  SELECT 'one twice', target, nominal_fraction, greatest(replicate, 1) FROM breps)
SELECT input, target, nominal_fraction, count(*) AS rows, count(DISTINCT replicate) AS distinct_replicates,
  count(*) = {REPLICATES} AND count(DISTINCT replicate) = {REPLICATES} AS holds FROM judged GROUP BY ALL"""
_EFFECTS = (
    "shapley_capacity", "shapley_availability", "interaction", "total_topq_contrast", "availability_at_early_budget",
    "ordered_availability_at_all_budget", "capacity_share", "availability_main_at_early_budget", "capacity_main_in_early_cohort",
)
INTERVALS = f""", intervals AS (
  SELECT target, nominal_fraction, count(*) AS replicates,
    {', '.join(f'quantile_cont({e}, 0.025) AS {e}_lower, quantile_cont({e}, 0.975) AS {e}_upper' for e in _EFFECTS)}
  FROM (SELECT *, {_ratio('shapley_capacity', 'total_topq_contrast')} AS capacity_share FROM breps) GROUP BY ALL)"""
ORACLES["bootstrap_intervals"] = _round(f"{ALL_BOOT} {INTERVALS} SELECT * FROM intervals", [f"{e}_{s}" for e in _EFFECTS for s in ("lower", "upper")])
_REPORTED = (
    "total_topq_contrast", "availability_main_at_early_budget", "capacity_main_in_early_cohort", "interaction",
    "shapley_availability", "shapley_capacity", "ordered_availability_at_all_budget",
)
_REPORT_COLUMNS = [
    (f"{src}{e}{low}", f"{e}_{label}{pp}", pp) for e in _REPORTED
    for src, low, label in (("d.", "", "point"), ("i.", "_lower", "ci_lower"), ("i.", "_upper", "ci_upper")) for pp in ("", "_pp")
]
_CORNERS = ("C00_early_Bearly", "C10_all_Bearly", "C01_early_Ball", "C11_all_Ball")
ORACLES["audit_report"] = _round(f"""{ALL_BOOT} {INTERVALS} SELECT d.target, d.nominal_fraction, d.B_early AS B_early_point, d.B_all AS B_all_point,
  {', '.join(f'd.{c}' for c in _CORNERS)}, {', '.join(f"{'100 * ' if pp else ''}{src} AS {name}" for src, name, pp in _REPORT_COLUMNS)}
FROM decomposition d JOIN intervals i ON i.target = d.target AND i.nominal_fraction = d.nominal_fraction""", [*_CORNERS, *[n for _, n, _ in _REPORT_COLUMNS]])

BOOT_PROTOCOLS = f""",
bsize AS (SELECT target, replicate, scenario, sum(w)::BIGINT AS n FROM bscen GROUP BY ALL),
basked AS (
  SELECT target, replicate, scenario, 'cohort_specific_top_fraction' AS protocol, q, {_budget('q', 'n')} AS budget_n, NULL::DOUBLE AS threshold FROM bsize CROSS JOIN qs
  UNION ALL SELECT target, replicate, scenario, 'fixed_absolute_budget', q, {_budget('q', 'sample_n')}, NULL FROM bsize JOIN ev_n USING (target, replicate) CROSS JOIN qs
  UNION ALL SELECT target, replicate, scenario, 'fixed_calibration_threshold', q, NULL, t FROM bsize JOIN cuts USING (target)),
bpicked AS (
  SELECT a.target, a.replicate, a.scenario, protocol, q,
    CASE WHEN budget_n IS NOT NULL THEN budget_n ELSE sum(CASE WHEN score >= threshold THEN w ELSE 0 END)::BIGINT END AS selected_n,
    CASE WHEN budget_n IS NOT NULL THEN {_TAKEN.format('coalesce(budget_n, 0)')} ELSE sum(CASE WHEN score >= threshold THEN w * y ELSE 0 END)::BIGINT END AS true_positive_n
  FROM basked a JOIN brk ON brk.target = a.target AND brk.replicate = a.replicate AND brk.scenario = a.scenario
  GROUP BY a.target, a.replicate, a.scenario, protocol, q, budget_n),
bcapture AS (
  SELECT p.*, sample_n, event_n, true_positive_n::DOUBLE / event_n AS population_event_capture
  FROM bpicked p JOIN ev_n ON ev_n.target = p.target AND ev_n.replicate = p.replicate),
bpairs AS (
  SELECT a.target, a.replicate, a.sample_n AS bootstrap_sample_n, a.event_n AS bootstrap_event_n, a.protocol, a.q AS nominal_fraction, from_scenario, to_scenario,
    {', '.join(f'a.{m} AS from_{m}, b.{m} AS to_{m}, b.{m} - a.{m} AS delta_{m}' for m in ('selected_n', 'true_positive_n', 'population_event_capture'))}
  FROM {PAIRS} JOIN bcapture a ON a.scenario = from_scenario
  JOIN bcapture b ON b.scenario = to_scenario AND b.target = a.target AND b.replicate = a.replicate AND b.protocol = a.protocol AND b.q = a.q)"""
ALL_BOOT_PROTOCOLS = ALL_PROTOCOLS + COMPARISONS + DRAWS + BOOT_PROTOCOLS
ORACLES["bootstrap_protocols"] = ALL_BOOT_PROTOCOLS + " SELECT * FROM bpairs"
_C, _T, _S = "delta_population_event_capture", "delta_true_positive_n", "delta_selected_n"
ORACLES["bootstrap_summary"] = _round(f"""{ALL_BOOT_PROTOCOLS}, stats AS (
  SELECT target, protocol, nominal_fraction, from_scenario, to_scenario, count(*) AS replicates, avg({_C}) AS bootstrap_mean_{_C}, stddev_samp({_C}) AS bootstrap_se_{_C},
    avg({_T}) AS bootstrap_mean_{_T}, avg({_S}) AS bootstrap_mean_{_S},
    quantile_cont({_C}, 0.025) AS ci_lower_{_C}, quantile_cont({_C}, 0.975) AS ci_upper_{_C},
    quantile_cont({_T}::DOUBLE, 0.025) AS ci_lower_{_T}, quantile_cont({_T}::DOUBLE, 0.975) AS ci_upper_{_T} FROM bpairs GROUP BY ALL)
SELECT stats.*, c.{_C} AS point_{_C}, c.{_T} AS point_{_T}, c.{_S} AS point_{_S}
FROM stats JOIN comparisons c USING (target, protocol, nominal_fraction, from_scenario, to_scenario)""", [
    f"bootstrap_mean_{_C}", f"bootstrap_se_{_C}", f"bootstrap_mean_{_T}", f"bootstrap_mean_{_S}", f"ci_lower_{_C}", f"ci_upper_{_C}",
    f"ci_lower_{_T}", f"ci_upper_{_T}", f"point_{_C}"])

for _name in ("bootstrap_intervals", "audit_report", "bootstrap_summary"):
    ORACLES[_name] = ORACLES[_name].replace(f"range({REPLICATES})", f"range({INTERVAL_REPLICATES})")

# --- Condition grid ---------------------------------------------------------------------------------------------

_SETS = [
    (share, name, f"{name} < {round(share * values)}") for share in b.GRID_SHARES for name, (_, values) in b.GRID_ATTRIBUTES.items()
]
_L = "availability_target_fraction, availability_relation"
GRID = f"""WITH {EVENTS},
gev AS (
  SELECT user_id % 5 AS replicate, event_id AS pos, (event_type = 'purchase')::INTEGER AS y, ts < TIMESTAMP '2024-01-21' AS calibration, value,
    {', '.join(f'{sql} AS {name}' for name, (sql, _) in b.GRID_ATTRIBUTES.items())} FROM events),
gpop AS (
  SELECT * EXCLUDE (value), 'good' AS model_quality, value AS score FROM gev
  UNION ALL SELECT * EXCLUDE (value), 'weak', floor(value / 40) FROM gev),
geval AS (SELECT * FROM gpop WHERE NOT calibration),
gq AS (SELECT unnest([{', '.join(f'{q}::DOUBLE' for q in b.GRID_FRACTIONS)}]) AS q),
gcal AS (
  SELECT *, row_number() OVER (PARTITION BY replicate, model_quality ORDER BY score DESC, pos) AS r,
    count(*) OVER (PARTITION BY replicate, model_quality) AS n FROM gpop WHERE calibration),
gk AS (SELECT DISTINCT replicate, model_quality, n, q, least(n, greatest(0, round_even(q * n, 0)))::BIGINT AS k FROM gcal CROSS JOIN gq),
gcut AS (
  SELECT gk.replicate, gk.model_quality, q, k, CASE WHEN k <= 0 THEN 'inf'::DOUBLE WHEN k >= gk.n THEN '-inf'::DOUBLE ELSE score END AS t
  FROM gk LEFT JOIN gcal ON gcal.replicate = gk.replicate AND gcal.model_quality = gk.model_quality AND r = k),
gwhole AS (SELECT replicate, model_quality, count(*) AS n_all, sum(y)::BIGINT AS e_all FROM geval GROUP BY ALL),
gset AS ({' UNION ALL '.join(f"SELECT *, {s}::DOUBLE AS availability_target_fraction, '{r}' AS availability_relation FROM geval WHERE {rule}" for s, r, rule in _SETS)}),
gsize AS (SELECT replicate, model_quality, {_L}, count(*) AS n, sum(y)::BIGINT AS e FROM gset GROUP BY ALL),
gcond AS (
  SELECT s.*, n_all, e_all, q, least(n, greatest(0, round_even(q * n, 0)))::BIGINT AS b_avail, least(n_all, greatest(0, round_even(q * n_all, 0)))::BIGINT AS b_all
  FROM gsize s JOIN gwhole USING (replicate, model_quality) CROSS JOIN gq),
grk AS (SELECT *, row_number() OVER (PARTITION BY replicate, model_quality, {_L} ORDER BY score DESC, pos) AS r FROM gset),
gark AS (SELECT *, row_number() OVER (PARTITION BY replicate, model_quality ORDER BY score DESC, pos) AS r FROM geval),
gin AS (
  SELECT c.replicate, c.model_quality, {', '.join(f'c.{x}' for x in _L.split(', '))}, c.q, sum(CASE WHEN r <= b_avail THEN y ELSE 0 END)::BIGINT AS t00,
    sum(CASE WHEN r <= b_all THEN y ELSE 0 END)::BIGINT AS t01, count(*) FILTER (WHERE score >= t) AS s_c, sum(CASE WHEN score >= t THEN y ELSE 0 END)::BIGINT AS t_c
  FROM gcond c JOIN grk USING (replicate, model_quality, {_L}) JOIN gcut ON gcut.replicate = c.replicate AND gcut.model_quality = c.model_quality AND gcut.q = c.q GROUP BY ALL),
gall AS (
  SELECT c.replicate, c.model_quality, {', '.join(f'c.{x}' for x in _L.split(', '))}, c.q, sum(CASE WHEN r <= b_avail THEN y ELSE 0 END)::BIGINT AS t10,
    sum(CASE WHEN r <= b_all THEN y ELSE 0 END)::BIGINT AS t11, count(*) FILTER (WHERE score >= t) AS s_d, sum(CASE WHEN score >= t THEN y ELSE 0 END)::BIGINT AS t_d
  FROM gcond c JOIN gark USING (replicate, model_quality) JOIN gcut ON gcut.replicate = c.replicate AND gcut.model_quality = c.model_quality AND gcut.q = c.q GROUP BY ALL),
g AS (
  SELECT *, q AS nominal_fraction, t00::DOUBLE / e_all AS c00, t10::DOUBLE / e_all AS c10, t01::DOUBLE / e_all AS c01, t11::DOUBLE / e_all AS c11
  FROM gcond JOIN gin USING (replicate, model_quality, {_L}, q) JOIN gall USING (replicate, model_quality, {_L}, q)
  JOIN (SELECT replicate, model_quality, q, t FROM gcut) USING (replicate, model_quality, q)),
geffects AS (
  SELECT replicate, model_quality, {_L}, nominal_fraction, n AS realized_available_n, e AS available_event_n, n_all AS full_population_n,
    e_all AS full_population_event_n, b_avail AS budget_available_top_fraction, b_all AS budget_all_top_fraction,
    n::DOUBLE / n_all AS realized_available_fraction, e::DOUBLE / e_all AS event_availability_ceiling,
    c00 AS c00_capture, c10 AS c10_capture, c01 AS c01_capture, c11 AS c11_capture,
    c11 - c00 AS naive_top_fraction_effect, c11 - c01 AS availability_effect_at_all_budget, c01 - c00 AS capacity_effect_within_available_subset,
    c10 - c00 AS availability_main_effect, c01 - c00 AS capacity_main_effect, (c11 - c00) - (c11 - c01) AS distortion_top_fraction_minus_fixed_budget,
    0.5::DOUBLE * ((c10 - c00) + (c11 - c01)) AS shapley_availability_effect, 0.5::DOUBLE * ((c01 - c00) + (c11 - c10)) AS shapley_capacity_effect,
    c11 - c10 - c01 + c00 AS interaction_effect, c11 - c00 AS total_four_cell_effect,
    t11 - t00 AS naive_delta_true_positive_n, t11 - t01 AS availability_delta_true_positive_n, t01 - t00 AS capacity_delta_true_positive_n,
    t10 - t00 AS availability_main_delta_true_positive_n, t01 - t00 AS capacity_main_delta_true_positive_n, t11 - t10 - t01 + t00 AS tp_interaction_n,
    0::BIGINT AS tp_factorial_identity_error, 0::BIGINT AS tp_identity_error,
    (c11 - c00) - (c11 - c01) - (c01 - c00) AS identity_error,
    (c11 - c00) - (c10 - c00) - (c01 - c00) - (c11 - c10 - c01 + c00) AS factorial_identity_error,
    (c11 - c00) - (0.5::DOUBLE * ((c10 - c00) + (c11 - c01))) - (0.5::DOUBLE * ((c01 - c00) + (c11 - c10))) AS shapley_identity_error
  FROM g)"""
ORACLES["grid_thresholds"] = GRID + " SELECT replicate, model_quality, q AS nominal_fraction, t AS threshold, k AS calibration_target_selected_n FROM gcut"
ORACLES["grid_availability"] = GRID + f""" SELECT replicate, model_quality, {_L}, n AS realized_available_n, n::DOUBLE / n_all AS realized_available_fraction,
  e_all AS full_population_event_n, e AS available_event_n, e::DOUBLE / e_all AS event_availability_ceiling FROM gsize JOIN gwhole USING (replicate, model_quality)"""
ORACLES["grid_audit"] = ORACLES["grid_audit_scaled"] = GRID + " SELECT * FROM geffects"


def _grid_row(protocol: str, scenario: str, threshold: str, n: str, e: str, selected: str, tp: str) -> str:
    return f"""SELECT replicate, model_quality, {_L}, nominal_fraction, '{protocol}' AS protocol, '{scenario}' AS scenario, {threshold} AS threshold,
  n_all AS full_population_n, e_all AS full_population_event_n, {n} AS eligible_n, {e} AS eligible_event_n, {_ratio(n, 'n_all')} AS eligible_fraction,
  {selected} AS selected_n, {tp} AS true_positive_n, {_ratio(tp, selected)} AS precision, {_ratio(tp, e)} AS recall_among_eligible,
  {_ratio(tp, 'e_all')} AS population_event_capture, {_ratio(e, 'e_all')} AS event_availability_ceiling FROM g"""


GRID_PROTOCOLS = ", gprot AS (" + " UNION ALL ".join([
    _grid_row("cohort_specific_top_fraction", "available_subset", "NULL::DOUBLE", "n", "e", "b_avail", "t00"),
    _grid_row("cohort_specific_top_fraction", "all_population", "NULL::DOUBLE", "n_all", "e_all", "b_all", "t11"),
    _grid_row("fixed_absolute_budget", "available_subset", "NULL::DOUBLE", "n", "e", "b_all", "t01"),
    _grid_row("fixed_absolute_budget", "all_population", "NULL::DOUBLE", "n_all", "e_all", "b_all", "t11"),
    _grid_row("fixed_calibration_threshold", "available_subset", "t", "n", "e", "s_c", "t_c"),
    _grid_row("fixed_calibration_threshold", "all_population", "t", "n_all", "e_all", "s_d", "t_d"),
]) + ")"
ORACLES["grid_protocols"] = GRID + GRID_PROTOCOLS + " SELECT * FROM gprot"
_GM = ("eligible_n", "selected_n", "true_positive_n", "population_event_capture")
GRID_PAIRS = f""", gpairs AS (
  SELECT a.replicate, a.model_quality, {', '.join(f'a.{x}' for x in _L.split(', '))}, a.nominal_fraction, a.protocol, a.scenario AS from_scenario, b.scenario AS to_scenario,
    {', '.join(f'a.{m} AS from_{m}, b.{m} AS to_{m}' + ('' if m == 'eligible_n' else f', b.{m} - a.{m} AS delta_{m}') for m in _GM)}, a.threshold
  FROM gprot a JOIN gprot b USING (replicate, model_quality, {_L}, nominal_fraction, protocol)
  WHERE a.scenario = 'available_subset' AND b.scenario = 'all_population')"""
ORACLES["grid_comparisons"] = GRID + GRID_PROTOCOLS + GRID_PAIRS + " SELECT * FROM gpairs"
_GRID_RULES = (
    "six_protocol_rows", "events_constant", "subset_size_constant", "population_is_everybody", "top_fraction_exact", "fixed_budget_exact",
    "threshold_common", "three_comparison_rows", "tp_identity", "tp_factorial_identity", "ordered_identity", "factorial_identity",
    "shapley_identity", "distortion_is_capacity",
)


def _bad_grid(name: str) -> str:
    keys = f"replicate, model_quality, {_L}, nominal_fraction"
    groups = {
        "six_protocol_rows": "count(*) <> 6", "events_constant": "count(DISTINCT full_population_event_n) <> 1",
        "subset_size_constant": "count(DISTINCT CASE WHEN scenario = 'available_subset' THEN eligible_n END) <> 1",
        "population_is_everybody": "bool_or(scenario = 'all_population' AND eligible_n <> full_population_n)",
        "top_fraction_exact": "bool_or(protocol = 'cohort_specific_top_fraction' AND selected_n <> round_even(nominal_fraction * eligible_n, 0))",
        "fixed_budget_exact": "bool_or(protocol = 'fixed_absolute_budget' AND selected_n <> round_even(nominal_fraction * full_population_n, 0))",
        "threshold_common": "count(DISTINCT CASE WHEN protocol = 'fixed_calibration_threshold' THEN threshold END) <> 1",
    }
    if name in groups:
        return f"(SELECT count(*) FROM (SELECT 1 FROM gprot GROUP BY {keys} HAVING {groups[name]}))"
    if name == "three_comparison_rows":
        return f"(SELECT count(*) FROM (SELECT 1 FROM gpairs GROUP BY {keys} HAVING count(*) <> 3))"
    rule = {
        "tp_identity": "tp_identity_error <> 0", "tp_factorial_identity": "tp_factorial_identity_error <> 0", "ordered_identity": "abs(identity_error) > 1e-12",
        "factorial_identity": "abs(factorial_identity_error) > 1e-12", "shapley_identity": "abs(shapley_identity_error) > 1e-12",
        "distortion_is_capacity": "abs(distortion_top_fraction_minus_fixed_budget - capacity_effect_within_available_subset) > 1e-12",
    }[name]
    return f"(SELECT count(*) FROM geffects WHERE {rule})"


ORACLES["grid_invariants"] = GRID + GRID_PROTOCOLS + GRID_PAIRS + " UNION ALL".join(
    f' SELECT \'{n}\' AS "check", {_bad_grid(n)} AS broken_groups' for n in _GRID_RULES)


def _stats(m: str) -> str:
    return (f"avg({m}::DOUBLE) AS mean_{m}, coalesce(stddev_samp({m}::DOUBLE), 0) AS sd_{m}, quantile_cont({m}::DOUBLE, 0.025) AS q025_{m}, "
            f"quantile_cont({m}::DOUBLE, 0.975) AS q975_{m}")


def _stat_names(measures: tuple[str, ...]) -> list[str]:
    return [f"{s}_{m}" for m in measures for s in ("mean", "sd", "q025", "q975")]


ORACLES["grid_comparison_summary"] = _round(GRID + GRID_PROTOCOLS + GRID_PAIRS + f""" SELECT model_quality, {_L}, nominal_fraction, protocol,
  {', '.join(_stats(m) for m in (_C, _S, _T))}, count(*) AS replicates FROM gpairs GROUP BY ALL""", ["availability_target_fraction", *_stat_names((_C, _S, _T))])
_GRID_MEASURES = (
    "realized_available_fraction", "event_availability_ceiling", "naive_top_fraction_effect", "availability_effect_at_all_budget",
    "capacity_effect_within_available_subset", "availability_main_effect", "capacity_main_effect", "distortion_top_fraction_minus_fixed_budget",
    "shapley_availability_effect", "shapley_capacity_effect", "interaction_effect", "total_four_cell_effect", "naive_delta_true_positive_n",
    "availability_delta_true_positive_n", "capacity_delta_true_positive_n",
)
_ERRORS = ("identity_error", "factorial_identity_error", "shapley_identity_error")
_OPPOSITE = "sign({0}) <> sign({1}) AND {0} <> 0 AND {1} <> 0"
GRID_SUMMARY = f""", gstat AS (
  SELECT model_quality, {_L}, nominal_fraction, {', '.join(_stats(m) for m in _GRID_MEASURES)}, count(*) AS replicates,
    avg(({_OPPOSITE.format('naive_top_fraction_effect', 'availability_effect_at_all_budget')})::INTEGER::DOUBLE) AS sign_reversal_replicate_fraction,
    max(abs(interaction_effect)) AS max_abs_interaction_replicate, avg(abs(interaction_effect)) AS mean_abs_interaction,
    {', '.join(f'max(abs({e})) AS max_abs_{e}' for e in _ERRORS)}, max(abs(tp_identity_error)) AS max_abs_tp_identity_error
  FROM geffects GROUP BY ALL),
gsum AS (
  SELECT *, {_OPPOSITE.format('mean_naive_top_fraction_effect', 'mean_availability_effect_at_all_budget')} AS naive_fixed_budget_sign_reversal,
    q975_availability_effect_at_all_budget < 0 AS fixed_budget_interval_below_zero, q025_availability_effect_at_all_budget > 0 AS fixed_budget_interval_above_zero,
    q975_shapley_availability_effect < 0 AS shapley_availability_interval_below_zero, q975_shapley_capacity_effect < 0 AS shapley_capacity_interval_below_zero,
    q975_interaction_effect < 0 AS interaction_interval_below_zero, q025_interaction_effect > 0 AS interaction_interval_above_zero FROM gstat)"""
_SUMMED = [*_stat_names(_GRID_MEASURES), "sign_reversal_replicate_fraction", "max_abs_interaction_replicate", "mean_abs_interaction", *[f"max_abs_{e}" for e in _ERRORS]]
ORACLES["grid_summary"] = _round(GRID + GRID_SUMMARY + " SELECT * FROM gsum", _SUMMED)
_TABLED = (
    "naive_top_fraction_effect", "availability_effect_at_all_budget", "availability_main_effect", "capacity_main_effect", "shapley_availability_effect",
    "shapley_capacity_effect", "interaction_effect", "distortion_top_fraction_minus_fixed_budget",
)
_SHOWN = [f"{s}_{e}" for e in _TABLED for s in ("mean", "q025", "q975")]
_FLAGS = (
    "naive_fixed_budget_sign_reversal", "fixed_budget_interval_below_zero", "fixed_budget_interval_above_zero", "shapley_availability_interval_below_zero",
    "shapley_capacity_interval_below_zero", "interaction_interval_below_zero", "interaction_interval_above_zero",
)
_TABLE = GRID + GRID_SUMMARY + f""" SELECT row_number() OVER (ORDER BY {_L}, model_quality, nominal_fraction)::INTEGER AS condition_id, model_quality, {_L},
  nominal_fraction, {', '.join([*_SHOWN, *_FLAGS])}, sign_reversal_replicate_fraction, max_abs_interaction_replicate FROM gsum"""
_TABLE = _round(_TABLE, [*_SHOWN, "sign_reversal_replicate_fraction", "max_abs_interaction_replicate"])
ORACLES["condition_table"] = _TABLE
ORACLES["sign_reversals"] = f"SELECT * FROM ({_TABLE}) WHERE naive_fixed_budget_sign_reversal"
ORACLES["intervals_below_zero"] = f"""SELECT * FROM ({_TABLE}) WHERE fixed_budget_interval_below_zero OR shapley_availability_interval_below_zero
  OR shapley_capacity_interval_below_zero OR interaction_interval_below_zero"""

# --- Features ---------------------------------------------------------------------------------------------------

FEATURES = f"""
feat AS (
  SELECT o_orderkey AS pos, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS acctbal, floor(o_totalprice / 1000) AS price,
    (CASE WHEN month(o_orderdate) < 12 THEN month(o_orderdate) END)::DOUBLE AS month,
    (CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey END)::DOUBLE AS nation
  FROM orders JOIN customer ON o_custkey = c_custkey),
train AS (SELECT * FROM feat WHERE NOT ({U.format("concat_ws('|', 2026, pos)")} < 0.2))"""
ORACLES["feature_medians"] = _round(f"WITH {FEATURES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS known_n, quantile_cont({c}, 0.5) AS quantile FROM train" for c in ("acctbal", "price", "month")), ["quantile"])
ORACLES["feature_modes"] = f"WITH {FEATURES} " + " UNION ALL ".join(
    f"(SELECT '{c}' AS feature, {c} AS mode, count(*) AS n FROM train WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)" for c in ("nation", "price"))
ORACLES["feature_parameters"] = f"WITH {FEATURES} " + " UNION ALL ".join([*[
    f"SELECT '{c}' AS feature, m AS fill, round(avg(coalesce({c}, m)), 6) AS mean, round(stddev_pop(coalesce({c}, m)), 6) AS scale "
    f"FROM train CROSS JOIN (SELECT quantile_cont({c}, 0.5) AS m FROM train) GROUP BY m" for c in ("acctbal", "price", "month")],
    "SELECT 'nation', (SELECT nation FROM train WHERE nation IS NOT NULL GROUP BY nation ORDER BY count(*) DESC, nation LIMIT 1), NULL, count(DISTINCT nation)::DOUBLE FROM train"])
_F = b.FROZEN
ORACLES["frozen_transform"] = f"WITH {FEATURES} SELECT pos, matrix_column, x::DOUBLE AS x FROM (" + " UNION ALL ".join([*[
    f"SELECT pos, {i} AS matrix_column, ((coalesce({c}, {m}::DOUBLE) - {mean}::DOUBLE) / {scale}::DOUBLE)::FLOAT AS x FROM feat"
    for i, (c, m, mean, scale) in enumerate(zip(_F.numeric, _F.medians, _F.means, _F.scales))],
    f"SELECT pos, ({len(_F.numeric)} + coalesce(nation, {_F.mode}))::INTEGER, 1::FLOAT FROM feat WHERE coalesce(nation, {_F.mode}) < {len(_F.categories)}"]) + ") WHERE x <> 0"

ORACLES["feature_table"] = CLEAN + f" SELECT pos, {', '.join(FEATURE_SETS['landmark_strict'])} FROM clean"
ORACLES["score_reload"] = f"""WITH {FEATURES} SELECT 'is_f' AS target, unnest([0.05::DOUBLE, 0.1::DOUBLE]) AS nominal_fraction,
  (SELECT count(*) FROM feat) - (SELECT count(*) FROM train) AS calibration_n, 0::BIGINT AS changed_n, 0::BIGINT AS out_of_range_n, true AS reaches_nominal"""
