"""The audit as SQL table functions, for users who only write SQL.

:func:`register_audit` takes a population stored in ranking order and makes temporary functions whose bodies are SQL:

* ``audit_flow()``: records and events of every scenario
* ``audit_top(q)``: true positives of the first q of every scenario and of the whole population's budget
* ``audit_cells(q)``: the four cells
* ``audit_decomposition(q)``: effects and residuals

They read the histogram and rank only the slices in which a budget runs out; there is no Python worker in their plans.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quotalens.names import ALL, EARLY
from quotalens.operators.decompose import CELLS, EFFECTS, RESIDUALS
from quotalens.operators.ranking import Worklist

_BUDGET = "CAST(greatest(1, rint(q * {0})) AS BIGINT)"


def _ratio(top: str, bottom: str) -> str:
    return f"try_divide(CAST({top} AS DOUBLE), CAST({bottom} AS DOUBLE))"


def _function(name: str, columns: str, body: str, parameters: str = "q DOUBLE") -> str:
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}"


def audit_functions(names: tuple[str, ...], prefix: str, narrow: str = EARLY, wide: str = ALL) -> list[str]:
    """The statements, in order. ``names`` are the scenarios in the order of the views' columns."""
    each = " UNION ALL ".join(
        f"SELECT target, '{name}' AS scenario, _bucket, n{i} AS n, e{i} AS e FROM {prefix}_histogram" for i, name in enumerate(names))
    member = " ".join(f"WHEN '{name}' THEN in{i}" for i, name in enumerate(names))
    flow = f"""SELECT target, scenario, sum(n) AS n, sum(e) AS e FROM ({each}) GROUP BY target, scenario"""
    whole = f"SELECT target, sum(full_n) AS full_n, sum(full_e) AS full_e FROM {prefix}_histogram GROUP BY target"
    top = f"""WITH size AS (SELECT * FROM {prefix}_flow()), whole AS ({whole}),
      asked AS (
        SELECT s.target, s.scenario, 'own' AS budget_of, {_BUDGET.format('s.n')} AS budget_n FROM size s
        UNION ALL SELECT s.target, s.scenario, 'narrow', {_BUDGET.format('o.n')} FROM size s JOIN size o ON o.target = s.target AND o.scenario = '{narrow}'
        UNION ALL SELECT s.target, s.scenario, 'whole', {_BUDGET.format('w.full_n')} FROM size s JOIN whole w ON w.target = s.target),
      upto AS (
        SELECT target, scenario, _bucket, n, (sum(n) OVER w) - n AS n_before, (sum(e) OVER w) - e AS e_before FROM ({each})
        WINDOW w AS (PARTITION BY target, scenario ORDER BY _bucket)),
      edge AS (
        SELECT a.target, a.scenario, a.budget_of, a.budget_n, u._bucket, a.budget_n - u.n_before AS need, u.e_before
        FROM asked a JOIN upto u ON u.target = a.target AND u.scenario = a.scenario AND a.budget_n > u.n_before AND a.budget_n <= u.n_before + u.n),
      part AS (SELECT DISTINCT target, scenario, _bucket FROM edge),
      ranked AS (
        SELECT p.target, p.scenario, p._bucket, r.y, row_number() OVER (PARTITION BY p.target, p.scenario, p._bucket ORDER BY r.score DESC, r.pos) AS place
        FROM {prefix}_rows r JOIN part p ON p.target = r.target AND p._bucket = r._bucket WHERE CASE p.scenario {member} END)
      SELECT e.target, e.scenario, e.budget_of, e.budget_n, CAST(max(e.e_before) + sum(CASE WHEN k.place <= e.need THEN k.y ELSE 0 END) AS BIGINT)
      FROM edge e JOIN ranked k ON k.target = e.target AND k.scenario = e.scenario AND k._bucket = e._bucket
      GROUP BY e.target, e.scenario, e.budget_of, e.budget_n"""
    cells = " UNION ALL ".join(
        f"SELECT '{cell}' AS cell, '{wide if of_wide else narrow}' AS scenario, '{'whole' if by_wide else 'narrow'}' AS budget_of"
        for cell, (of_wide, by_wide) in CELLS.items())
    cell_rows = f"""WITH kind AS ({cells}), whole AS ({whole})
      SELECT t.target, q, k.cell, k.scenario, t.budget_n, s.n, s.e, w.full_n, w.full_e, t.true_positive_n, {_ratio('t.true_positive_n', 'w.full_e')}
      FROM kind k JOIN {prefix}_top(q) t ON t.scenario = k.scenario AND t.budget_of = k.budget_of
      JOIN {prefix}_flow() s ON s.target = t.target AND s.scenario = t.scenario JOIN whole w ON w.target = t.target"""

    def at(cell: str, column: str) -> str:
        return f"max(CASE WHEN cell = '{cell}' THEN {column} END)"

    counts = [("n_early", "C00", "candidate_n"), ("n_all", "C11", "candidate_n"), ("event_n_early", "C00", "candidate_event_n"),
              ("event_n_all", "C11", "full_population_event_n"), ("B_early", "C00", "budget_n"), ("B_all", "C11", "budget_n"),
              *[(f"{c}_tp", c, "true_positive_n") for c in CELLS]]
    base = ", ".join([f"{at(c, column)} AS {name}" for name, c, column in counts] + [f"{at(c, 'population_event_capture')} AS {c}" for c in CELLS])
    renamed = {"C00": "C00_early_Bearly", "C10": "C10_all_Bearly", "C01": "C01_early_Ball", "C11": "C11_all_Ball"}
    effects = f"""SELECT target, q, {', '.join(n for n, _, _ in counts)}, {', '.join(renamed)}, {', '.join(EFFECTS)}, {', '.join(RESIDUALS)} FROM (
      SELECT *, {', '.join(f'{e} AS {n}' for n, e in RESIDUALS.items())} FROM (
        SELECT *, {', '.join(f'{e} AS {n}' for n, e in EFFECTS.items())} FROM (SELECT target, {base} FROM {prefix}_cells(q) GROUP BY target)))"""
    columns = ["target STRING", "nominal_fraction DOUBLE", *[f"{n} BIGINT" for n, _, _ in counts], *[f"{n} DOUBLE" for n in renamed.values()],
               *[f"{n} DOUBLE" for n in (*EFFECTS, *RESIDUALS)]]
    return [
        _function(f"{prefix}_flow", "target STRING, scenario STRING, n BIGINT, e BIGINT", flow, ""),
        _function(f"{prefix}_top", "target STRING, scenario STRING, budget_of STRING, budget_n BIGINT, true_positive_n BIGINT", top),
        _function(f"{prefix}_cells", "target STRING, nominal_fraction DOUBLE, cell STRING, candidate_set STRING, budget_n BIGINT, candidate_n BIGINT, "
                  "candidate_event_n BIGINT, full_population_n BIGINT, full_population_event_n BIGINT, true_positive_n BIGINT, "
                  "population_event_capture DOUBLE", cell_rows),
        _function(f"{prefix}_decomposition", ", ".join(columns), effects),
    ]


def register_audit(spark: SparkSession, work: Worklist, prefix: str = "audit") -> None:
    """Views over a stored population (grouped by ``target``, records of weight one) and the functions above, for this session."""
    if not work.stored or work.by != ("target",):
        raise ValueError("the SQL functions need a stored population grouped by target")
    if any("'" in name for name in work.names):
        raise ValueError("scenario names must not hold quotes")
    work.rows.createOrReplaceTempView(f"{prefix}_rows")
    work.hist.createOrReplaceTempView(f"{prefix}_histogram")
    for statement in audit_functions(work.names, prefix):
        spark.sql(statement)
