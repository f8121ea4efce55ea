"""The same reports in DuckDB SQL, written independently of the Spark operators."""

from __future__ import annotations

from tallysmith.functions.stats import Z95
from tallysmith.functions.text import REFUSAL_PATTERN, SILENT_E_PATTERN, STOP_WORDS, VOWELS, WORD_PATTERN
from tallysmith.plans.catalog import ITEM_BAND, REVIEW_TARGETS, TYPE_SPLIT
from tallysmith.sources.facts import EVAL_JUDGES, MODELS, PANEL_JUDGES

ORACLES: dict[str, str] = {}

TYPES = ("recall", "conceptual", "applied")
# Values of the test tables' dimensions; SQL needs the columns of a pivot spelled out.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def rnd(expr: str, digits: int) -> str:
    """Half-even on the scaled double, like the report rounding."""
    return f"(round_even(CAST({expr} AS DOUBLE) * 1e{digits}, 0) / 1e{digits} + 0e0)"


def mean(expr: str, digits: int) -> str:
    """Rounding of means of doubles: a few more digits first."""
    return rnd(rnd(expr, digits + 6), digits)


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def ratio(part: str, whole: str) -> str:
    return f"(CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0))"


ANSWERS = """answers AS (
  SELECT r.*, concat('model_', mid) AS model, concat('Q', l_partkey) AS question_id, p_brand AS area,
    concat(p_brand, '-', p_type) AS standard,
    CASE p_size % 3 WHEN 0 THEN 'recall' WHEN 1 THEN 'conceptual' ELSE 'applied' END AS question_type
  FROM (
    SELECT *, l_suppkey % 5 AS mid, CAST(row_number() OVER (
      PARTITION BY l_suppkey % 5, l_partkey
      ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_shipdate) AS INTEGER) AS run
    FROM lineitem) r
  JOIN part ON l_partkey = p_partkey)"""

EV = ANSWERS + """, ev AS (
  SELECT model, question_id, run, area, standard, question_type, l_partkey AS pk, mid,
    CASE WHEN l_discount = 0 THEN 0 WHEN l_quantity > 4 + 4 * mid THEN 1 ELSE 0 END AS binary_score,
    CASE WHEN question_type = 'recall' THEN NULL
      WHEN l_discount = 0 OR l_returnflag = 'A' THEN 0e0
      WHEN l_returnflag = 'N' THEN 0.5e0 ELSE 1e0 END AS rubric_score,
    CASE WHEN l_discount = 0 THEN 1 ELSE 0 END AS is_refusal
  FROM answers)"""

RESP = ANSWERS + """, resp0 AS (
  SELECT model, question_id, run, area, standard, question_type,
    CAST(20 + 3 * l_quantity AS BIGINT) AS prompt_tokens,
    CAST(floor(l_extendedprice / 1000) AS BIGINT) AS completion_tokens,
    CAST(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END AS BIGINT) AS reasoning_tokens,
    2 + 100 * l_tax AS response_fk_grade, 100 - l_quantity AS response_reading_ease
  FROM answers), resp AS (
  SELECT *, prompt_tokens + completion_tokens + reasoning_tokens AS total_tokens FROM resp0)"""

EV_RESP = EV + RESP[len(ANSWERS):]


# --- accuracy -------------------------------------------------------------------------------------------

def board(ev: str) -> str:
    return f"""SELECT m.model, {mean('a.macro', 4)} AS macro_accuracy,
      {rnd(ratio('m.c', 'm.n'), 4)} AS micro_accuracy, {mean('a.rubric', 4)} AS rubric_macro,
      {rnd(ratio('m.r', 'm.n'), 4)} AS refusal_rate, m.n AS n_items
    FROM (SELECT model, count(*) AS n, sum(binary_score) AS c, sum(is_refusal) AS r FROM {ev} GROUP BY 1) m
    JOIN (SELECT model, avg(acc) AS macro, avg(rub) AS rubric FROM (
      SELECT model, area, avg(binary_score) AS acc, avg(rubric_score) AS rub FROM {ev} GROUP BY 1, 2) GROUP BY 1) a
    ON m.model = a.model"""


ORACLES["leaderboard"] = f"""WITH {EV_RESP}, b AS ({board('ev')}), r AS (
  SELECT model, {mean('avg(response_fk_grade)', 2)} AS mean_response_fk_grade,
    {rnd('avg(total_tokens)', 1)} AS mean_total_tokens, {rnd('avg(reasoning_tokens)', 1)} AS mean_reasoning_tokens
  FROM resp GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY macro_accuracy DESC, b.model) AS INTEGER) AS rank, b.*, r.* EXCLUDE (model)
FROM b LEFT JOIN r ON b.model = r.model"""


def accuracy(group: list[str], ev: str = "ev") -> str:
    keys = ", ".join(["model", *group])
    n, c = "CAST(n AS DOUBLE)", "CAST(c AS DOUBLE)"
    z, z2 = repr(Z95), repr(Z95 * Z95)
    centre = f"(({c} + {z2} / 2e0) / ({n} + {z2}))"
    half = f"({z} * sqrt({c} * ({n} - {c}) / {n} + {z2} / 4e0) / ({n} + {z2}))"
    return f"""SELECT {keys}, n, {rnd(ratio('c', 'n'), 4)} AS binary_accuracy,
      {rnd(centre + ' - ' + half, 4)} AS wilson_low, {rnd(centre + ' + ' + half, 4)} AS wilson_high,
      {rnd('rub', 4)} AS rubric_mean, {rnd('ref', 4)} AS refusal_rate, {mean('sd', 4)} AS run_acc_std
    FROM (SELECT {keys}, count(*) AS n, sum(binary_score) AS c, avg(rubric_score) AS rub, avg(is_refusal) AS ref
      FROM {ev} GROUP BY ALL)
    JOIN (SELECT {keys}, stddev_pop(acc) AS sd FROM (
      SELECT {keys}, run, avg(binary_score) AS acc FROM {ev} GROUP BY ALL) GROUP BY ALL) USING ({keys})"""


for _name, _group in {
    "overall": [], "by_area": ["area"], "by_type": ["question_type"],
    "by_area_type": ["area", "question_type"], "by_standard": ["standard"],
}.items():
    ORACLES[f"accuracy_{_name}"] = f"WITH {EV} {accuracy(_group)}"

ORACLES["distinct_counts"] = f"""WITH {EV} SELECT count(DISTINCT model) AS n_model,
  count(DISTINCT question_id) AS n_question_id, count(DISTINCT area) AS n_area,
  count(DISTINCT standard) AS n_standard, count(DISTINCT run) AS n_run FROM ev"""

ORACLES["distinct_roll_ups"] = f"""WITH {EV} """ + " UNION ALL ".join(
    f"""SELECT '{c}' AS level, {c} AS name, count(DISTINCT model) AS n_model, count(DISTINCT question_id) AS n_question_id,
  count(DISTINCT area) AS n_area, count(DISTINCT standard) AS n_standard, count(DISTINCT run) AS n_run FROM ev GROUP BY 2"""
    for c in ("area", "question_type", "model")
)


# --- first run and majority vote ------------------------------------------------------------------------

def first_ens(group: list[str]) -> str:
    keys = ", ".join(["model", *group])
    return f"""SELECT {keys}, {rnd('max(first_acc)', 3)} AS first_run_accuracy,
      {rnd('avg(vote)', 3)} AS ensemble_accuracy, count(*) AS n_questions
    FROM (SELECT {keys}, question_id, CASE WHEN avg(binary_score) >= 0.5 THEN 1 ELSE 0 END AS vote
      FROM ev GROUP BY ALL)
    LEFT JOIN (SELECT {keys}, avg(binary_score) AS first_acc FROM ev WHERE run = 1 GROUP BY ALL) USING ({keys})
    GROUP BY {keys}"""


def ranked(group: list[str]) -> str:
    part = f"PARTITION BY {', '.join(group)}" if group else ""
    return f"""SELECT *, CAST(row_number() OVER ({part}
      ORDER BY ensemble_accuracy DESC NULLS LAST, first_run_accuracy DESC NULLS LAST, model) AS INTEGER) AS rank
    FROM ({first_ens(group)})"""


GAIN = rnd("ensemble_accuracy - first_run_accuracy", 3)
AREAS = """areas AS (SELECT DISTINCT p_brand AS area, concat('Area ', substr(p_brand, 7)) AS area_title,
  CAST(substr(p_brand, 7) AS INTEGER) AS ordinal FROM part)"""
STANDARDS = """standards AS (SELECT DISTINCT concat(p_brand, '-', p_type) AS standard,
  concat('Parts of kind ', p_type) AS standard_text, p_brand AS area,
  concat(lpad(substr(p_brand, 7), 3, '0'), p_type) AS ordinal FROM part)"""

ORACLES["teacher_overall"] = f"""WITH {EV} SELECT rank, model, first_run_accuracy, ensemble_accuracy,
  {GAIN} AS ensemble_gain, n_questions FROM ({ranked([])})"""
ORACLES["teacher_by_area"] = f"""WITH {EV}, {AREAS} SELECT r.*, area_title, ordinal
  FROM ({ranked(['area'])}) r LEFT JOIN areas USING (area)"""
ORACLES["teacher_by_standard"] = f"""WITH {EV}, {STANDARDS} SELECT r.*, standard_text, s.area, ordinal
  FROM ({ranked(['standard'])}) r LEFT JOIN standards s USING (standard)"""


def best(key: str, carry: str = "", dims: str = "", join: str = "") -> str:
    names = "string_agg(model, ', ' ORDER BY first_run_accuracy DESC NULLS LAST, model)"
    tiers = f"""SELECT *, dense_rank() OVER (PARTITION BY {key} ORDER BY ensemble_accuracy DESC) AS tier
      FROM ({first_ens([key])})"""
    top, nxt = "max(ensemble_accuracy) FILTER (tier = 1)", "max(ensemble_accuracy) FILTER (tier = 2)"
    return f"""WITH {EV}{dims}, t AS ({tiers}), p AS (
      SELECT {key}, {names} FILTER (tier = 1) AS best_models, count(*) FILTER (tier = 1) AS n_tied,
        {top} AS ensemble_accuracy, {names} FILTER (tier = 2) AS runner_up_models, {nxt} AS runner_up_ensemble,
        {rnd(f'({top}) - ({nxt})', 3)} AS gap FROM t GROUP BY {key})
    SELECT p.*{carry} FROM p {join}"""


ORACLES["best_by_type"] = best("question_type")
ORACLES["best_by_area"] = best("area", ", area_title", f", {AREAS}", "LEFT JOIN areas USING (area)")
ORACLES["best_by_standard"] = best(
    "standard", ", standard_text, s.area", f", {STANDARDS}", "LEFT JOIN standards s USING (standard)"
)


def single_ens(col: str, values, extra: list[str]) -> str:
    cells = ", ".join(
        f"""max(first_run_accuracy) FILTER ({col} = '{v}') AS "{v} (single)",
        max(ensemble_accuracy) FILTER ({col} = '{v}') AS "{v} (ens)\""""
        for v in values
    )
    keys = ", ".join([*extra, "model"])
    return f"WITH {EV} SELECT {keys}, {cells} FROM ({first_ens([*extra, col])}) GROUP BY {keys}"


ORACLES["single_ens_by_type_pivot"] = single_ens("question_type", TYPES, [])
ORACLES["standard_detail"] = single_ens("question_type", TYPES, ["standard"])
ORACLES["type_area_detail"] = single_ens("area", BRANDS, ["question_type"])
_cells = ", ".join(f"max(ensemble_accuracy) FILTER (area = '{b}') AS \"{b}\"" for b in BRANDS)
ORACLES["ensemble_area_matrix"] = f"WITH {EV} SELECT model, {_cells} FROM ({first_ens(['area'])}) GROUP BY 1"
ORACLES["stability"] = f"""WITH {EV} SELECT model, first_run_accuracy AS single, ensemble_accuracy AS ensemble,
  {GAIN} AS ensemble_gain, run_acc_std, refusal_rate
FROM ({ranked([])}) LEFT JOIN (SELECT model, run_acc_std, refusal_rate FROM ({accuracy([])})) USING (model)"""
ORACLES["overall_table"] = f"""WITH {EV_RESP}, b AS ({board('ev')}), r AS (
  SELECT model, {mean('avg(response_fk_grade)', 2)} AS mean_response_fk_grade,
    {rnd('avg(total_tokens)', 1)} AS mean_total_tokens FROM resp GROUP BY 1)
SELECT rank, k.model, first_run_accuracy AS single, ensemble_accuracy AS ensemble, {GAIN} AS ensemble_gain,
  n_questions, macro_accuracy, micro_accuracy, refusal_rate, mean_response_fk_grade, mean_total_tokens
FROM ({ranked([])}) k LEFT JOIN b USING (model) LEFT JOIN r USING (model)"""


# --- items ----------------------------------------------------------------------------------------------

def item_scores(vote: bool) -> str:
    score = "CASE WHEN avg(binary_score) >= 0.5 THEN 1 ELSE 0 END" if vote else "avg(binary_score)"
    return f"""SELECT question_id, area, question_type, avg(s) AS f, stddev_pop(s) AS d FROM (
      SELECT question_id, area, question_type, model, {score} AS s FROM ev GROUP BY ALL) GROUP BY ALL"""


for _name, _vote in {"item_stats": False, "ensemble_item_stats": True}.items():
    ORACLES[_name] = f"""WITH {EV} SELECT question_id, area, question_type, {mean('f', 3)} AS fraction_correct,
      {mean('d', 3)} AS discrimination, CAST(f >= 0.95e0 AS INTEGER) AS trivial, CAST(f <= 0.05e0 AS INTEGER) AS broken
    FROM ({item_scores(_vote)})"""
ORACLES["psychometrics"] = f"""WITH {EV} SELECT area, question_type, count(*) AS n_items,
  {mean('avg(f)', 3)} AS mean_difficulty, {mean('avg(d)', 3)} AS mean_discrimination,
  {rnd('avg(CAST(f >= 0.95e0 AS INTEGER))', 3)} AS pct_trivial,
  {rnd('avg(CAST(f <= 0.05e0 AS INTEGER))', 3)} AS pct_broken
FROM ({item_scores(True)}) GROUP BY 1, 2"""


# --- significance ---------------------------------------------------------------------------------------

PAIRS = """votes AS (
  SELECT model, question_id, CASE WHEN avg(binary_score) >= 0.5 THEN 1 ELSE 0 END AS v FROM ev GROUP BY 1, 2),
complete AS (SELECT question_id FROM votes GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT model) FROM ev)),
pairs AS (
  SELECT a.model AS model_a, b.model AS model_b, count(*) AS n_items,
    CAST(sum(a.v) AS BIGINT) AS correct_a, CAST(sum(b.v) AS BIGINT) AS correct_b,
    count(*) FILTER (a.v = 1 AND b.v = 0) AS discordant_b, count(*) FILTER (a.v = 0 AND b.v = 1) AS discordant_c
  FROM votes a JOIN votes b ON a.question_id = b.question_id AND a.model < b.model
  WHERE a.question_id IN (SELECT question_id FROM complete) GROUP BY 1, 2)"""

# Exact branch: log-gamma binomial tail. Asymptotic branch: continued fraction of the normal tail.
EXACT_P = """least(1e0, 2e0 * list_sum(list_transform(
  range(0, CAST(least(discordant_b, discordant_c) AS BIGINT) + 1),
  lambda k: exp(lgamma(discordant_b + discordant_c + 1e0) - lgamma(k + 1e0)
    - lgamma(discordant_b + discordant_c - k + 1e0) - (discordant_b + discordant_c) * ln(2e0)))))"""
X = "sqrt(power(abs(discordant_b - discordant_c) - 1, 2) / CAST(discordant_b + discordant_c AS DOUBLE))"
TAIL = f"""list_reduce(list_transform(range(400, 0, -1), lambda k: CAST(k AS DOUBLE)),
  lambda acc, k: {X} + k / acc, {X} + 20e0)"""
# Near zero the fraction converges slowly, so the alternating-free series is used there.
SERIES = f"""(1e0 - sqrt(2e0 / pi()) * exp(-power({X}, 2) / 2e0) * list_sum(list_transform(range(0, 80), lambda k:
  exp((2 * k + 1) * ln(greatest({X}, 1e-300)) - list_sum(list_transform(range(0, k + 1), lambda j: ln(2e0 * j + 1)))))))"""
ASYMPTOTIC_P = f"CASE WHEN {X} < 3 THEN {SERIES} ELSE 2e0 * exp(-power({X}, 2) / 2e0) / sqrt(2e0 * pi()) / ({TAIL}) END"

TESTS = f"""tests AS (SELECT *, CASE WHEN discordant_b + discordant_c < 25 THEN {EXACT_P}
    ELSE {ASYMPTOTIC_P} END AS p FROM pairs),
holm AS (SELECT *, least(1e0, max(p * f) OVER (ORDER BY p, model_a, model_b ROWS UNBOUNDED PRECEDING)) AS h FROM (
  SELECT *, count(*) OVER () - row_number() OVER (ORDER BY p, model_a, model_b) + 1 AS f FROM tests)),
sig AS (SELECT model_a, model_b, {rnd(ratio('correct_a', 'n_items'), 4)} AS acc_a,
  {rnd(ratio('correct_b', 'n_items'), 4)} AS acc_b, CAST(correct_a > correct_b AS INTEGER) AS a_better_b,
  discordant_b, discordant_c, {rnd('p', 9)} AS p_value, {rnd('h', 9)} AS p_holm,
  CAST(h < 0.05e0 AS INTEGER) AS "significant_0.05" FROM holm)"""

ORACLES["mcnemar_counts"] = f"WITH {EV}, {PAIRS} SELECT * FROM pairs"
ORACLES["significance"] = f"WITH {EV}, {PAIRS}, {TESTS} SELECT * FROM sig"
EXACT_BY_STANDARD = f"""votes AS (
  SELECT standard, model, question_id, CASE WHEN avg(binary_score) >= 0.5 THEN 1 ELSE 0 END AS v FROM ev GROUP BY ALL),
complete AS (SELECT question_id FROM votes GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT model) FROM ev)),
c AS (SELECT a.standard, a.model AS model_a, b.model AS model_b,
    count(*) FILTER (a.v = 1 AND b.v = 0) AS discordant_b, count(*) FILTER (a.v = 0 AND b.v = 1) AS discordant_c
  FROM votes a JOIN votes b ON a.question_id = b.question_id AND a.standard = b.standard AND a.model < b.model
  WHERE a.question_id IN (SELECT question_id FROM complete) GROUP BY ALL),
e AS (SELECT *, {rnd(f"CASE WHEN discordant_b + discordant_c < 25 THEN {EXACT_P} ELSE {ASYMPTOTIC_P} END", 9)} AS p_value
  FROM c)"""
ORACLES["mcnemar_exact"] = f"WITH {EV}, {EXACT_BY_STANDARD} SELECT * FROM e"
ORACLES["holm_adjust"] = f"""WITH {EV}, {EXACT_BY_STANDARD} SELECT * EXCLUDE (f), {rnd(
    'least(1e0, max(p_value * f) OVER (ORDER BY p_value, standard, model_a, model_b ROWS UNBOUNDED PRECEDING))', 9)} AS p_holm
FROM (SELECT *, count(*) OVER () - row_number() OVER (ORDER BY p_value, standard, model_a, model_b) + 1 AS f FROM e)"""

WINS = """wins AS (SELECT CASE WHEN a_better_b = 1 THEN model_a ELSE model_b END AS w,
  CASE WHEN a_better_b = 1 THEN model_b ELSE model_a END AS l FROM sig WHERE "significant_0.05" = 1),
names AS (SELECT model_a AS model FROM sig UNION SELECT model_b FROM sig)"""
ORACLES["win_counts"] = f"""WITH {EV}, {PAIRS}, {TESTS}, {WINS}
SELECT model, (SELECT count(*) FROM wins WHERE w = model) AS wins FROM names"""
_marks = ", ".join(
    f"""CASE WHEN model = '{m}' THEN '—' WHEN EXISTS (SELECT 1 FROM wins WHERE w = model AND l = '{m}')
    THEN '✓' ELSE '·' END AS {m}""" for m in MODELS
)
ORACLES["win_matrix"] = f"WITH {EV}, {PAIRS}, {TESTS}, {WINS} SELECT model, {_marks} FROM names"


# --- judge panel ----------------------------------------------------------------------------------------

PANEL = """panel AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS question_id, o_orderpriority AS area, concat('C', o_custkey % 40) AS standard,
    o_orderstatus AS question_type, strftime(o_orderdate, '%Y-%m-%d') AS day,
    CAST(o_totalprice > 60000 AS INTEGER) AS judge_a,
    CAST(o_orderstatus <> 'P' OR o_totalprice > 120000 AS INTEGER) AS judge_b,
    CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_custkey % 10 <> 0 AS INTEGER) END AS judge_c
  FROM orders),
lab AS (SELECT *, CASE WHEN judge_a + judge_b + coalesce(judge_c, 0) >= 1.5 THEN 1 ELSE 0 END AS majority_label,
  CASE WHEN judge_a <> judge_b OR judge_a <> judge_c OR judge_b <> judge_c THEN 1 ELSE 0 END AS human_review_flag
  FROM panel)"""
JCOLS = "judge_a, judge_b, judge_c"
DOUBT = "(human_review_flag = 1 OR majority_label = 0)"

ORACLES["task_crossjoin"] = """SELECT CAST(o_orderkey AS VARCHAR) AS question_id, j AS judge
FROM orders CROSS JOIN (SELECT unnest(['a', 'b', 'c']) AS j)"""
ORACLES["run_tasks"] = """SELECT concat('Q', p_partkey) AS question_id, CAST(r AS INTEGER) AS run
FROM part CROSS JOIN (SELECT unnest([1, 2, 3]) AS r)"""
ORACLES["pending_tasks"] = """SELECT event_id, j AS judge FROM events CROSS JOIN (SELECT unnest(['a', 'b', 'c']) AS j)
WHERE NOT (event_id % 3 = 0 AND j IN ('a', 'b'))"""
_says = ", ".join(
    f"CASE WHEN judge_{j} IS NOT NULL THEN concat('{j} says ', judge_{j}) END AS rationale_{j}" for j in PANEL_JUDGES
)
ORACLES["panel_wide"] = f"WITH {PANEL} SELECT question_id, {JCOLS}, {_says} FROM panel"
ORACLES["panel_majority"] = f"WITH {PANEL} SELECT question_id, area, {JCOLS}, majority_label, human_review_flag FROM lab"
ORACLES["auto_drop"] = f"""WITH {PANEL} SELECT question_id, area, standard, question_type, majority_label, {JCOLS},
  CASE human_review_flag WHEN 1 THEN 'judge_disagreement' ELSE 'unanimous_incorrect' END AS drop_reason
FROM lab WHERE {DOUBT}"""
ORACLES["auto_drop_kept"] = f"WITH {PANEL} SELECT question_id, area, {JCOLS} FROM lab WHERE NOT {DOUBT}"
ORACLES["review_queue"] = f"""WITH {PANEL} SELECT question_id, area, standard, question_type, {JCOLS},
  CAST(NULL AS INTEGER) AS human_score, CAST(NULL AS VARCHAR) AS human_notes FROM lab WHERE human_review_flag = 1"""
ORACLES["lost_areas"] = f"""WITH {PANEL}, d AS (SELECT concat_ws(' ', day, question_type, standard) AS area, {DOUBT} AS doubt FROM lab)
SELECT area, count(*) AS n_items FROM d WHERE area NOT IN (SELECT area FROM d WHERE NOT doubt) GROUP BY 1"""
ORACLES["all_judged"] = f"""WITH {PANEL} SELECT question_id, area, {JCOLS}, majority_label,
  CASE WHEN {DOUBT} THEN NULL ELSE human_review_flag END AS human_review_flag,
  CASE WHEN NOT {DOUBT} THEN NULL WHEN human_review_flag = 1 THEN 'judge_disagreement'
    ELSE 'unanimous_incorrect' END AS drop_reason
FROM lab"""

LONG = EV + """, long AS (
  SELECT model, question_id, run, j AS judge, concat(j, ' on ', question_id) AS rationale, rubric_score AS rubric, is_refusal,
    CASE WHEN (pk + CAST(substr(j, 2) AS BIGINT)) % 7 = 0 THEN 1 - binary_score ELSE binary_score END AS b
  FROM ev CROSS JOIN (SELECT unnest(['j0', 'j1', 'j2']) AS j) WHERE (pk + run) % 31 <> 0)"""
BASE = "SELECT model, question_id, run, area, standard, question_type FROM ev"
ORACLES["eval_assemble_single"] = f"""WITH {LONG} SELECT e.*, b AS binary_score, rubric AS rubric_score, is_refusal,
  CASE WHEN b IS NOT NULL THEN 0 END AS human_review_flag, rationale
FROM ({BASE}) e LEFT JOIN (SELECT * FROM long WHERE judge = 'j0') USING (model, question_id, run)"""
_jb = ", ".join(f"max(b) FILTER (judge = '{j}') AS judge_{j}_binary" for j in EVAL_JUDGES)
TRIPLE = LONG + f""", triple AS (SELECT e.*, v.* EXCLUDE (model, question_id, run) FROM ({BASE}) e LEFT JOIN (
  SELECT model, question_id, run, CASE WHEN avg(b) >= 0.5 THEN 1 ELSE 0 END AS binary_score,
    avg(rubric) AS rubric_score, max(is_refusal) AS is_refusal,
    CASE WHEN count(DISTINCT b) > 1 THEN 1 ELSE 0 END AS human_review_flag, {_jb}
  FROM long GROUP BY 1, 2, 3) v USING (model, question_id, run))"""
ORACLES["eval_assemble_triple"] = f"WITH {TRIPLE} SELECT * FROM triple"

REPLY = """reply AS (
  SELECT event_id, user_id, event_id % 6 AS shape, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS score FROM events)"""
ORACLES["eval_score_replies"] = f"""WITH {REPLY}, t AS (
  SELECT event_id, concat('Q', user_id) AS question_id, event_id % 5 IN (1, 2, 3) AS refused, p_partkey IS NULL AS missing,
    p_size % 3 <> 0 AS graded, shape < 3 AND score = 1 AS yes,
    CASE WHEN shape < 3 THEN concat('k ', k) WHEN shape = 4 THEN 'text' ELSE '' END AS why
  FROM reply LEFT JOIN part ON user_id = p_partkey AND p_partkey % 11 <> 0)
SELECT question_id, event_id AS run, 'j0' AS judge, CAST(NOT missing AND NOT refused AND yes AS INTEGER) AS binary,
  CASE WHEN missing OR NOT graded THEN NULL WHEN NOT refused AND yes THEN 1e0 ELSE 0e0 END AS rubric,
  CAST(missing OR refused AS INTEGER) AS is_refusal,
  CASE WHEN missing THEN 'no gold row' WHEN refused THEN 'refusal/empty/error' ELSE why END AS rationale FROM t"""


# --- agreement ------------------------------------------------------------------------------------------

def reliability(src: str, panel: str, cols: list[str]) -> str:
    ones = " + ".join(cols)
    r = float(len(cols))
    differ = " OR ".join(f"{a} <> {b}" for i, a in enumerate(cols) for b in cols[i + 1:])
    return f"""SELECT panel, n AS n_items, {len(cols)} AS n_judges,
      {mean('CASE WHEN pe = 1 THEN CASE WHEN pbar = 1 THEN 1e0 END ELSE (pbar - pe) / (1e0 - pe) END', 3)} AS fleiss_kappa,
      {rnd('raw', 3)} AS raw_agreement, {rnd('flag', 3)} AS flag_rate
    FROM (SELECT *, p1 * p1 + (1 - p1) * (1 - p1) AS pe FROM (
      SELECT panel, count(k) AS n, avg((k * (k - 1) + ({r} - k) * ({r} - k - 1)) / ({r} * ({r} - 1))) AS pbar,
        sum(k) / (count(k) * {r}e0) AS p1, avg(CASE WHEN k IN (0, {len(cols)}) THEN 1e0 WHEN k IS NOT NULL THEN 0e0 END) AS raw,
        avg(flag) AS flag
      FROM (SELECT {panel} AS panel, CAST({ones} AS DOUBLE) AS k, CASE WHEN {differ} THEN 1e0 ELSE 0e0 END AS flag FROM {src})
      GROUP BY 1))"""


ORACLES["judge_reliability"] = f"WITH {PANEL} {reliability('lab', chr(39) + 'ground_truth' + chr(39), [f'judge_{j}' for j in PANEL_JUDGES])}"
_eval_panel = "concat('eval:', model)"
ORACLES["eval_panel_reliability"] = f"WITH {TRIPLE} {reliability('triple', _eval_panel, [f'judge_{j}_binary' for j in EVAL_JUDGES])}"

AGREE = """agree AS (
  SELECT a.j AS ja, b.j AS jb, count(*) AS items, 100e0 * count(*) FILTER (a.s = b.s) / count(*) AS pct
  FROM lj a JOIN lj b ON a.question_id = b.question_id AND a.j < b.j GROUP BY 1, 2)"""
LONG_PANEL = """lj AS (SELECT question_id, substr(col, 7) AS j, s, majority_label AS m
  FROM (UNPIVOT lab ON judge_a, judge_b, judge_c INTO NAME col VALUE s))"""
ORACLES["pairwise_agreement"] = f"""WITH {PANEL}, {LONG_PANEL}, {AGREE}
SELECT ja AS "judge A", jb AS "judge B", {rnd('pct', 1)} AS "agree %", items FROM agree"""
_cell = ", ".join(
    f"""CASE WHEN j = '{m}' THEN '—' ELSE (SELECT concat(CAST(round_even(pct, 0) AS INTEGER), '%') FROM agree
    WHERE (ja = j AND jb = '{m}') OR (jb = j AND ja = '{m}')) END AS {m}""" for m in PANEL_JUDGES
)
ORACLES["agreement_matrix"] = f"""WITH {PANEL}, {LONG_PANEL}, {AGREE}
SELECT j AS judge, {_cell} FROM (SELECT DISTINCT j FROM lj)"""
ORACLES["judge_pass_rates"] = f"""WITH {PANEL}, {LONG_PANEL} SELECT j AS judge, count(*) AS "items scored",
  {rnd(ratio('100 * sum(s)', 'count(*)'), 1)} AS "said correct %",
  {rnd(ratio('100 * count(*) FILTER (s = m)', 'count(*)'), 1)} AS "agreed w/ majority %" FROM lj GROUP BY 1"""
ORACLES["self_preference"] = f"""WITH {LONG}, m AS (SELECT judge, model, avg(b) AS mean_b,
    (CAST(substr(judge, 2) AS INTEGER) % 2) = (CAST(substr(model, 7) AS INTEGER) % 2) AS same FROM long GROUP BY 1, 2),
s AS (SELECT judge, avg(mean_b) FILTER (same) AS a, avg(mean_b) FILTER (NOT same) AS o FROM m GROUP BY 1)
SELECT judge, {mean('a', 4)} AS mean_score_same_family, {mean('o', 4)} AS mean_score_other_family,
  {mean('a - o', 4)} AS self_preference_delta FROM s"""


# --- calibration ----------------------------------------------------------------------------------------

_arms = " UNION ALL ".join(
    f"SELECT question_id, area, question_type, '{j}' AS judge, judge_{j} AS llm_score FROM lab" for j in PANEL_JUDGES
)
ORACLES["judge_long_unpivot"] = f"WITH {PANEL} {_arms}"
SHEET = f"""{PANEL}, {EV}, sheet AS (
  SELECT 'groundtruth' AS source, question_id AS item_id, '' AS run, '' AS model, area, question_type,
    judge_a AS llm_a, judge_b AS llm_b, judge_c AS llm_c, CAST(NULL AS INTEGER) AS llm_j0 FROM lab
  UNION ALL SELECT 'response', question_id, CAST(run AS VARCHAR), model, area, question_type, NULL, NULL, NULL,
    binary_score FROM ev)"""
ORACLES["calibration_sheet"] = f"WITH {SHEET} SELECT * FROM sheet"
ORACLES["calibration_sample"] = f"""WITH {SHEET}, r AS (SELECT *, row_number() OVER (
    PARTITION BY source, area, question_type
    ORDER BY md5(concat_ws('|', source, item_id, run, model, '42')), source, item_id, run, model) AS rn FROM sheet)
SELECT * EXCLUDE (rn), CAST(NULL AS INTEGER) AS human_score, CAST(NULL AS VARCHAR) AS human_notes FROM r WHERE rn <= 3"""


def versus_human(source: str, group: str) -> str:
    po = ratio("count(*) FILTER (llm = human)", "count(*)")
    p1 = f"({ratio('sum(llm)', 'count(*)')} * {ratio('sum(human)', 'count(*)')})"
    p0 = f"({ratio('count(*) FILTER (llm = 0)', 'count(*)')} * {ratio('count(*) FILTER (human = 0)', 'count(*)')})"
    kappa = f"""CASE WHEN {p0} + {p1} = 1 THEN CASE WHEN {po} = 1 THEN 1e0 END
      ELSE ({po} - ({p0} + {p1})) / (1e0 - ({p0} + {p1})) END"""
    fc = ratio("count(*) FILTER (llm = 1 AND human = 0)", "greatest(1, count(*) FILTER (human = 0))")
    fi = ratio("count(*) FILTER (llm = 0 AND human = 1)", "greatest(1, count(*) FILTER (human = 1))")
    return f"""SELECT {source} AS source, judge, count(*) AS n, {rnd(po, 3)} AS accuracy, {mean(kappa, 3)} AS cohen_kappa,
      {rnd(fc, 3)} AS false_correct_rate, {rnd(fi, 3)} AS false_incorrect_rate FROM h GROUP BY {group}"""


ORACLES["judge_vs_human"] = f"""WITH d AS (SELECT lang, quality AS human, CAST(n_chars > 500 AS INTEGER) AS a,
    CAST(len(text) - len(replace(text, chr(10), '')) > 2 AS INTEGER) AS b FROM documents JOIN labels USING (doc_id)),
h AS (SELECT lang, human, 'len' AS judge, a AS llm FROM d UNION ALL SELECT lang, human, 'lines', b FROM d)
{versus_human("'__all__'", 'judge')} UNION ALL {versus_human('lang', 'lang, judge')}"""


# --- human overrides ------------------------------------------------------------------------------------

OVER = EV + """, ov AS (SELECT * EXCLUDE (binary_score, pk, mid),
  CASE WHEN pk % 50 = 7 AND run = 1 THEN 1 - binary_score ELSE binary_score END AS binary_score
  FROM ev WHERE pk % 100 <> 13)"""
ORACLES["human_overrides"] = f"WITH {OVER} SELECT * FROM ov"
ORACLES["overridden_leaderboard"] = f"""WITH {OVER}, b AS ({board('ov')})
SELECT CAST(row_number() OVER (ORDER BY macro_accuracy DESC, model) AS INTEGER) AS rank, * FROM b"""


def syllables(words: str) -> str:
    groups = f"len(regexp_extract_all(w, '[{VOWELS}]+'))"
    return f"""coalesce(list_sum(list_transform({words}, lambda w: greatest(1, {groups}
      - CASE WHEN {groups} > 1 AND regexp_matches(w, '{SILENT_E_PATTERN}') THEN 1 ELSE 0 END))), 0)"""


def reading_counts(text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '{WORD_PATTERN}')"
    sentences = f"""greatest(1, len(list_filter(regexp_split_to_array({text}, '[.!?]+'),
      lambda s: len(regexp_extract_all(s, '{WORD_PATTERN}')) > 2)))"""
    return f"len({words}) AS w, {sentences} AS s, CAST({syllables(words)} AS INTEGER) AS y"


GRADE = "CASE WHEN w > 0 THEN 0.39e0 * (CAST(w AS DOUBLE) / s) + 11.8e0 * (CAST(y AS DOUBLE) / w) - 15.59e0 ELSE 0e0 END"
EASE = "CASE WHEN w > 0 THEN 206.835e0 - 1.015e0 * (CAST(w AS DOUBLE) / s) - 84.6e0 * (CAST(y AS DOUBLE) / w) ELSE 0e0 END"

EDITED = f"""q AS (SELECT p_partkey AS position, concat('Q', p_partkey) AS question_id, p_brand AS area,
    concat(p_brand, '-', p_type) AS standard,
    CASE p_size % 3 WHEN 0 THEN 'recall' WHEN 1 THEN 'conceptual' ELSE 'applied' END AS question_type,
    p_retailprice, p_type,
    CASE WHEN p_partkey % 20 = 3 THEN concat(p_name, ' and why does it change?') ELSE p_name END AS question FROM part),
g AS (SELECT *, {reading_counts('question')} FROM q),
edited AS (SELECT position, question_id, area, standard, question_type, question,
    CASE WHEN position % 10 = 4 THEN concat('Answer ', p_type) ELSE p_type END AS reference_answer,
    CASE WHEN position % 20 = 3 THEN {rnd(GRADE, 2)} ELSE p_retailprice END AS fk_grade,
    position % 30 = 3 AS keep, position % 30 = 4 AS dropped, position % 20 = 3 OR position % 10 = 4 AS changed FROM g)"""
ORACLES["gt_edit_apply"] = f"WITH {EDITED} SELECT * FROM edited"
ORACLES["gt_edit_apply_validated"] = f"WITH {EDITED} SELECT * FROM edited WHERE NOT dropped"


# --- coverage -------------------------------------------------------------------------------------------

ITEMS = """items AS (SELECT c_custkey AS position, r_name AS area, n_name AS standard, c_mktsegment AS question_type,
    c_acctbal / 1000 AS fk_grade, n_nationkey, r_regionkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
dim AS (SELECT r_name AS area, n_name AS standard, n_nationkey AS ordinal, r_regionkey
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
LOW, HIGH = ITEM_BAND
_n = ", ".join(f"count(*) FILTER (question_type = '{s}') AS n_{s}" for s in SEGMENTS)
_n0 = ", ".join(f"coalesce(n_{s}, 0) AS n_{s}" for s in SEGMENTS)
QUALITY = ITEMS + f""", quality AS (SELECT area, coalesce(n, 0) AS n_questions, {_n0}, standards_total, standards_covered,
    {mean('coalesce(g, 0)', 2)} AS mean_fk_grade, {rnd('coalesce(b, 0)', 3)} AS frac_in_band
  FROM (SELECT area, count(*) AS standards_total, count(*) FILTER (EXISTS (
      SELECT 1 FROM items i WHERE i.area = dim.area AND i.standard = dim.standard)) AS standards_covered
    FROM dim GROUP BY 1)
  LEFT JOIN (SELECT area, count(*) AS n, {_n}, avg(fk_grade) AS g,
    avg(CASE WHEN fk_grade BETWEEN {LOW} AND {HIGH} THEN 1e0 ELSE 0e0 END) AS b FROM items GROUP BY 1) USING (area))"""
ORACLES["dataset_quality"] = f"WITH {QUALITY} SELECT * FROM quality"
ORACLES["quality_summary"] = f"""WITH {QUALITY} SELECT CAST(sum(n_questions) AS BIGINT) AS total_questions,
  count(DISTINCT area) AS areas, concat(min(standards_covered), '/', max(standards_total)) AS min_coverage,
  {mean('avg(frac_in_band)', 3)} AS mean_frac_in_band FROM quality"""
ORACLES["quality_warnings"] = f"""WITH {QUALITY} SELECT area, n_questions,
  concat(standards_covered, '/', standards_total) AS coverage, CAST(n_questions < 300 AS INTEGER) AS below_quota,
  CAST(standards_covered < standards_total AS INTEGER) AS uncovered_standards
FROM quality WHERE n_questions < 300 OR standards_covered < standards_total"""
ORACLES["cell_counts"] = f"WITH {ITEMS} SELECT area, standard, question_type, count(*) AS n FROM items GROUP BY 1, 2, 3"
_c = ", ".join(f"count(question_type) FILTER (question_type = '{s}') AS {s}" for s in SEGMENTS)
ORACLES["coverage_rollup"] = f"""WITH {ITEMS}, filled AS (SELECT d.area, d.standard, question_type
  FROM dim d LEFT JOIN items i ON d.area = i.area AND d.standard = i.standard)
SELECT area, standard, {_c}, count(question_type) AS total FROM filled GROUP BY 1, 2
UNION ALL SELECT area, 'Subtotal', {_c}, count(question_type) FROM filled GROUP BY 1
UNION ALL SELECT 'All areas', 'Total', {_c}, count(question_type) FROM filled"""
_sum = ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in SEGMENTS)
ORACLES["composition_total"] = f"""WITH {ITEMS}, comp AS (SELECT area, concat('Region ', area) AS title, count(*) AS questions,
  count(DISTINCT standard) AS standards, {_c}, {mean('avg(fk_grade)', 2)} AS "mean FK" FROM items GROUP BY 1)
SELECT * FROM comp UNION ALL
SELECT 'TOTAL', '', CAST(sum(questions) AS BIGINT), CAST(sum(standards) AS BIGINT), {_sum}, NULL FROM comp"""
_targets = " ".join(f"WHEN '{t}' THEN {n}" for t, n in REVIEW_TARGETS.items())
PICKED = ITEMS + f""", turns AS (SELECT *,
    row_number() OVER (PARTITION BY area, question_type, standard ORDER BY position) AS turn,
    min(position) OVER (PARTITION BY area, question_type, standard) AS seen FROM items),
picked AS (SELECT position, area, standard, question_type, fk_grade,
    CAST(row_number() OVER (PARTITION BY area, question_type ORDER BY turn, seen) AS INTEGER) AS pick FROM turns
  QUALIFY row_number() OVER (PARTITION BY area, question_type ORDER BY turn, seen) <= CASE question_type {_targets} END)"""
ORACLES["review_round_robin"] = f"WITH {PICKED} SELECT * FROM picked"
ORACLES["review_coverage"] = f"WITH {PICKED} SELECT area, standard, question_type, count(*) AS count FROM picked GROUP BY 1, 2, 3"
ORACLES["review_coverage_pivot"] = f"WITH {PICKED} SELECT area, standard, {_c}, count(*) AS total FROM picked GROUP BY 1, 2"
ORACLES["reject_funnel"] = f"""WITH {ITEMS} SELECT CASE WHEN fk_grade < 0 THEN 'reading grade'
  WHEN position % 7 = 0 THEN 'like another question' WHEN position % 11 = 0 THEN 'found unfit' ELSE 'other' END AS bucket,
  count(*) AS rejected FROM items GROUP BY 1"""


# --- usage ----------------------------------------------------------------------------------------------

def tokens(group: list[str]) -> str:
    keys = ", ".join(["model", *group])
    cells = []
    for col, label in {"prompt": "input", "completion": "output", "reasoning": "reasoning", "total": "total"}.items():
        cells.append(f"{rnd(f'avg({col}_tokens)', 1)} AS {label}_mean")
        cells.append(f"{mean(f'coalesce(stddev_samp({col}_tokens), 0)', 1)} AS {label}_sd")
    return f"""WITH {RESP} SELECT {keys}, count(*) AS n, {', '.join(cells)}, {big('sum(total_tokens)')} AS total_sum,
      {rnd('avg(CASE WHEN reasoning_tokens > 0 THEN 1 ELSE 0 END)', 3)} AS reasoning_available_frac
    FROM resp GROUP BY {keys}"""


ORACLES["token_usage_by_model"] = tokens([])
ORACLES["token_usage_by_area"] = tokens(["area"])
ORACLES["token_usage_by_type"] = tokens(["question_type"])
ORACLES["reading_level"] = f"""WITH {RESP}, m AS (SELECT model, area, question_type, avg(response_fk_grade) AS g,
  avg(response_reading_ease) AS e, count(*) AS n FROM resp GROUP BY 1, 2, 3)
SELECT model, area, question_type, {mean('g', 2)} AS mean_fk_grade, {mean('e', 2)} AS mean_reading_ease, n,
  {mean('CASE WHEN g < 5 THEN 5e0 - g WHEN g > 9 THEN g - 9e0 ELSE 0e0 END', 2)} AS dist_from_band FROM m"""
ORACLES["reading_level_model"] = f"""WITH {RESP} SELECT model, {mean('avg(response_fk_grade)', 2)} AS mean_response_fk_grade,
  '5.0–9.0' AS target_band FROM resp GROUP BY 1"""
ORACLES["usage_stats"] = f"""WITH {RESP} SELECT count(*) AS responses, {big('sum(total_tokens)')} AS total_tokens,
  {big('sum(completion_tokens)')} AS completion_tokens, {big('sum(reasoning_tokens)')} AS reasoning_tokens,
  CAST(0 AS BIGINT) AS errors FROM resp"""
ORACLES["stage_progress"] = f"""WITH {LONG}, {PANEL}, q AS (SELECT count(*) AS n FROM part), s AS (
  SELECT 0 AS step, 'generate' AS stage, n AS done, 2 * n AS total FROM q
  UNION ALL SELECT 1, 'validate', (SELECT count(judge_a) + count(judge_b) + count(judge_c) FROM lab), 3 * (SELECT count(*) FROM orders)
  UNION ALL SELECT 2, 'benchmark', (SELECT count(*) FROM ev), 15 * n FROM q
  UNION ALL SELECT 3, 'evaluate', (SELECT count(*) FROM long), 45 * n FROM q)
SELECT *, {rnd('least(1e0, done / CAST(total AS DOUBLE))', 4)} AS pct FROM s"""


# --- text and replies -----------------------------------------------------------------------------------

_stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
NORMAL = f"""list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains([{_stop}], w))"""
ORACLES["normalize_text"] = f"SELECT doc_id, array_to_string({NORMAL}, ' ') AS normalized FROM documents"
ORACLES["readability"] = f"""WITH c AS (SELECT doc_id, {reading_counts('text')} FROM documents)
SELECT doc_id, CAST(w AS INTEGER) AS words, CAST(s AS INTEGER) AS sentences, y AS syllables,
  {rnd(GRADE, 2)} AS fk_grade, {rnd(EASE, 2)} AS reading_ease FROM c"""
_refusal = REFUSAL_PATTERN.replace("'", "''")
ORACLES["refusal_flag"] = f"""WITH r AS (SELECT conv_id, turn, CASE conv_id % 11
    WHEN 0 THEN concat('I can''t do that. ', text) WHEN 1 THEN concat('  As an AI, ', text)
    WHEN 2 THEN concat('Ice can''t melt. ', text) WHEN 3 THEN concat('i am unable to ', text)
    WHEN 4 THEN concat(' ', chr(10), ' ') WHEN 5 THEN concat('I wont. ', text)
    WHEN 6 THEN concat('Icannoth ', text) WHEN 7 THEN NULL ELSE text END AS response FROM conversations)
SELECT conv_id, turn, CAST(turn = 9 OR response IS NULL OR trim(response, ' ' || chr(9) || chr(10) || chr(13)) = ''
  OR regexp_matches(trim(response), '{_refusal}') AS INTEGER) AS is_refusal FROM r"""
ORACLES["json_verdicts"] = f"""WITH {REPLY}, f AS (SELECT event_id, k, score, shape, shape IN (0, 1, 2, 4) AS ok FROM reply)
SELECT event_id, CAST(ok AS INTEGER) AS is_object, CAST(ok AND score = 1 AS INTEGER) AS score,
  CASE WHEN event_id % 2 = 0 THEN CASE WHEN ok AND score = 1 THEN 1e0 ELSE 0e0 END END AS rubric,
  CASE WHEN shape < 3 THEN concat('k ', k) WHEN shape = 4 THEN 'text' ELSE '' END AS rationale FROM f"""
ORACLES["prompt_text"] = """SELECT concat('Q', p_partkey) AS question_id, concat('Level: ',
  CASE p_size % 3 WHEN 0 THEN 'recall' WHEN 1 THEN 'conceptual' ELSE 'applied' END,
  '. Question: ', p_name, ' Answer: ', p_type, ' ($5, $unknown)') AS prompt FROM part"""
ORACLES["model_settings"] = f"""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN {rnd('s_acctbal / 10000', 2)}
    WHEN 2 THEN 0.7e0 END AS temperature,
  CASE WHEN s_suppkey % 4 < 2 THEN s_suppkey + s_nationkey ELSE 9 END AS total_tokens, s_suppkey % 4 < 2 AS ticked
FROM supplier"""


# --- quotas ---------------------------------------------------------------------------------------------

_split = ", ".join(f"('{t}', {n})" for t, n in TYPE_SPLIT.items())
PLAN = ITEMS + f""", plan AS (SELECT area, standard, question_type, ordinal,
    quota // size + CAST(place < quota % size AS BIGINT) AS target
  FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY ordinal) - 1 AS place, count(*) OVER (PARTITION BY area) AS size
    FROM dim) CROSS JOIN (VALUES {_split}) t(question_type, quota)),
need AS (SELECT p.*, coalesce(have, 0) AS have, target - coalesce(have, 0) AS need FROM plan p LEFT JOIN (
  SELECT area, standard, question_type, count(*) AS have FROM items GROUP BY 1, 2, 3) USING (area, standard, question_type))"""
ORACLES["quota_plan"] = f"WITH {PLAN} SELECT area, standard, question_type, ordinal, CAST(target AS BIGINT) AS target FROM plan"
ORACLES["slot_need"] = f"""WITH {PLAN} SELECT area, standard, question_type, ordinal, CAST(target AS BIGINT) AS target, have,
  CAST(need AS BIGINT) AS need FROM need"""
ORACLES["redistribute_once"] = f"""WITH {PLAN}, s AS (SELECT area, standard, question_type, ordinal, target * 3 AS target, have,
    ordinal < 5 AS stuck, ordinal >= 20 AS was FROM need),
g AS (SELECT *, max(CASE WHEN stuck THEN greatest(target - have, 0) END) OVER w AS shortfall,
    count(*) FILTER (NOT stuck AND NOT was) OVER w AS k,
    row_number() OVER (PARTITION BY area, question_type, NOT stuck AND NOT was ORDER BY ordinal) - 1 AS i
  FROM s WINDOW w AS (PARTITION BY area, question_type)),
n AS (SELECT *, CASE WHEN stuck THEN have WHEN was THEN target
    ELSE target + shortfall // k + CAST(i < shortfall % k AS BIGINT) END AS t FROM g)
SELECT area, standard, question_type, ordinal, CAST(t AS BIGINT) AS target, have, stuck OR was AS capped,
  CAST(t - have AS BIGINT) AS need FROM n"""
ORACLES["areas_below_quota"] = f"""WITH {PLAN} SELECT area, CAST(sum(have) AS BIGINT) AS have FROM need
GROUP BY 1 HAVING sum(have) < 300"""
ORACLES["id_allocation"] = f"""WITH {ITEMS}, f AS (SELECT area, max(position % 900) + 1 AS first FROM items
  WHERE position % 17 = 0 GROUP BY 1),
n AS (SELECT area, standard, position, coalesce(first, 1) + row_number() OVER (PARTITION BY area ORDER BY position) - 1 AS num
  FROM items LEFT JOIN f USING (area))
SELECT area, standard, position, concat(area, '-', CASE WHEN num < 1000 THEN lpad(CAST(num AS VARCHAR), 3, '0')
  ELSE CAST(num AS VARCHAR) END) AS question_id FROM n"""


# --- near duplicates ------------------------------------------------------------------------------------

TOKENS = f"list_sort(list_distinct({NORMAL}))"
ORACLES["token_set_overlap"] = f"""WITH t AS (SELECT conv_id, turn, {TOKENS} AS a FROM conversations),
p AS (SELECT x.conv_id, x.turn, x.a, y.a AS b, list_filter(x.a, lambda w: list_contains(y.a, w)) AS common
  FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.turn = y.turn - 1),
l AS (SELECT *, len(common) AS n, length(array_to_string(common, ' ')) AS sect, CAST(len(common) > 0 AS INTEGER) AS gap,
  length(array_to_string(list_filter(a, lambda w: NOT list_contains(common, w)), ' ')) AS la,
  length(array_to_string(list_filter(b, lambda w: NOT list_contains(common, w)), ' ')) AS lb FROM p)
SELECT conv_id, turn, CAST(n AS INTEGER) AS n_common, CAST(sect AS INTEGER) AS sect,
  CAST(sect + gap + la AS INTEGER) AS size_a, CAST(sect + gap + lb AS INTEGER) AS size_b,
  {rnd("""CASE WHEN len(a) = 0 OR len(b) = 0 OR n = 0 THEN 0e0 WHEN la = 0 OR lb = 0 THEN 100e0
    ELSE greatest(100e0 - 100e0 * (gap + la) / (2 * sect + gap + la), 100e0 - 100e0 * (gap + lb) / (2 * sect + gap + lb)) END""", 6)} AS quick_ratio
FROM l"""
_NAME_TOKENS = TOKENS.replace("text", "p_name")
ORACLES["subset_duplicates"] = f"""WITH t AS (SELECT p_partkey AS position, p_name AS question, {_NAME_TOKENS} AS a FROM part)
SELECT x.position, x.question, y.question AS next_question FROM t x JOIN t y ON y.position = x.position + 1
WHERE len(list_intersect(x.a, y.a)) > 0 AND (list_has_all(x.a, y.a) OR list_has_all(y.a, x.a))"""
ORACLES["token_set_copies"] = f"""WITH t AS (SELECT p_brand AS area, p_partkey,
  array_to_string(list_sort(list_distinct({NORMAL.replace('text', 'p_name')})), ' ') AS tokens FROM part)
SELECT area, tokens, min(p_partkey) AS first_position, count(*) AS copies FROM t GROUP BY 1, 2 HAVING count(*) > 1"""
ORACLES["live_progress"] = f"""WITH {EV} SELECT model, count(*) AS done, CAST(sum(binary_score) AS BIGINT) AS "right",
  CAST(sum(is_refusal) AS BIGINT) AS refusals, (SELECT 3 * count(*) FROM part) AS total,
  {rnd('least(1e0, count(*) / CAST((SELECT 3 * count(*) FROM part) AS DOUBLE))', 4)} AS pct FROM ev GROUP BY 1"""
ORACLES["incremental_append"] = "SELECT event_id, event_type, value FROM events"

# Longest common subsequence by rows of the usual table. Lists of one number stand in for the numbers that are
# folded over, because a fold keeps to the type of its elements.
LCS = """list_reduce(
  list_prepend(list_transform(range(0, len(y) + 1), lambda j: 0),
    list_transform(range(1, len(x) + 1), lambda i: [ord(x[i])])),
  lambda above, c: list_reduce(
    list_prepend([0], list_transform(range(1, len(y) + 1), lambda j: [CAST(j AS INTEGER)])),
    lambda row, j: list_append(row, CASE WHEN ord(y[j[1]]) = c[1] THEN above[j[1]] + 1
      ELSE greatest(row[-1], above[j[1] + 1]) END)))[-1]"""
NAME_TOKENS = f"list_sort(list_distinct({NORMAL.replace('text', 'p_name')}))"
# Similarity of all distinct names: full token-set ratio.
NAMES = f"""names AS (SELECT DISTINCT array_to_string({NAME_TOKENS}, ' ') AS name, {NAME_TOKENS} AS t FROM part),
sides AS (
  SELECT a.name AS p, b.name AS q, list_sort(list_intersect(a.t, b.t)) AS i,
    array_to_string(list_filter(a.t, lambda w: NOT list_contains(b.t, w)), ' ') AS x,
    array_to_string(list_filter(b.t, lambda w: NOT list_contains(a.t, w)), ' ') AS y
  FROM names a, names b WHERE len(a.t) > 0 AND len(b.t) > 0),
sized AS (
  SELECT *, len(array_to_string(i, ' ')) AS s, len(array_to_string(i, ' ')) + CAST(len(i) > 0 AS INTEGER) + len(x) AS na,
    len(array_to_string(i, ' ')) + CAST(len(i) > 0 AS INTEGER) + len(y) AS nb FROM sides),
alike AS (
  SELECT p, list(q) AS near FROM sized
  WHERE (s > 0 AND (x = '' OR y = ''))
    OR (s > 0 AND greatest(100 - 1e2 * (na - s) / (s + na), 100 - 1e2 * (nb - s) / (s + nb)) >= 88)
    OR (x <> '' AND y <> '' AND 100 - 1e2 * (len(x) + len(y) - 2 * {LCS}) / (na + nb) >= 88)
  GROUP BY p)"""
ORACLES["greedy_dedupe"] = f"""WITH RECURSIVE {NAMES},
q AS (SELECT p_partkey, p_brand, p_name, array_to_string({NAME_TOKENS}, ' ') AS name FROM part),
turn AS (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY first) AS r
  FROM (SELECT p_brand, name, min(p_partkey) AS first FROM q WHERE name <> '' GROUP BY 1, 2)),
walk AS (
  SELECT p_brand, 0 AS r, CAST([] AS VARCHAR[]) AS kept FROM (SELECT DISTINCT p_brand FROM turn)
  UNION ALL
  SELECT w.p_brand, w.r + 1, CASE WHEN len(list_intersect(w.kept, a.near)) > 0 THEN w.kept ELSE list_append(w.kept, t.name) END
  FROM walk w JOIN turn t ON t.p_brand = w.p_brand AND t.r = w.r + 1 JOIN alike a ON a.p = t.name),
final AS (SELECT p_brand, arg_max(kept, r) AS kept FROM walk GROUP BY 1)
SELECT p_partkey AS position, q.p_brand AS area, p_name AS question,
  CAST(q.name = '' OR (t.first = p_partkey AND list_contains(f.kept, q.name)) AS INTEGER) AS kept
FROM q LEFT JOIN turn t ON t.p_brand = q.p_brand AND t.name = q.name LEFT JOIN final f ON f.p_brand = q.p_brand"""
ORACLES["generation_accept"] = f"""WITH RECURSIVE {NAMES},
q AS (
  SELECT p_partkey, p_brand AS area, concat(p_brand, '-', p_type) AS standard, p_name, CASE p_size % 3 WHEN 0 THEN 'recall'
    WHEN 1 THEN 'conceptual' ELSE 'applied' END AS question_type, array_to_string({NAME_TOKENS}, ' ') AS name FROM part),
place AS (
  SELECT area, standard, row_number() OVER (PARTITION BY area ORDER BY standard) - 1 AS i, count(*) OVER (PARTITION BY area) AS n
  FROM (SELECT DISTINCT area, standard FROM q)),
slot AS (
  SELECT area, standard, question_type, 12 // n + CAST(i < 12 % n AS INTEGER) AS need
  FROM place, (SELECT unnest(['recall', 'conceptual', 'applied']) AS question_type)),
turn AS (
  SELECT q.*, need, concat(standard, '|', question_type) AS slot,
    row_number() OVER (PARTITION BY area ORDER BY p_partkey) AS r
  FROM q JOIN slot USING (area, standard, question_type)),
walk AS (
  SELECT area, 0 AS r, CAST([] AS VARCHAR[]) AS kept, CAST([] AS VARCHAR[]) AS slots, '' AS outcome FROM turn GROUP BY 1
  UNION ALL
  SELECT area, r, CASE WHEN outcome = 'accepted' THEN list_append(kept, name) ELSE kept END,
    CASE WHEN outcome = 'accepted' THEN list_append(slots, slot) ELSE slots END, outcome
  FROM (
    SELECT w.area, w.r + 1 AS r, w.kept, w.slots, t.name, t.slot,
      CASE WHEN len(list_filter(w.slots, lambda s: s = t.slot)) >= t.need THEN 'slot_full'
        WHEN t.name <> '' AND len(list_intersect(w.kept, a.near)) > 0 THEN 'duplicate' ELSE 'accepted' END AS outcome
    FROM walk w JOIN turn t ON t.area = w.area AND t.r = w.r + 1 LEFT JOIN alike a ON a.p = t.name))
SELECT p_partkey AS position, area, standard, question_type, p_name AS question, outcome
FROM turn JOIN walk USING (area, r)"""


# Longer texts: a row of the table as bits, 62 places to a word, changed by an addition for each letter of x.
_LETTERS = "'abcdefghijklmnopqrstuvwxyz0123456789 '"
_FULL = (1 << 62) - 1
MASKS = f"""list_transform(range(0, greatest((len(y) + 61) // 62, 1)), lambda w: list_transform(range(1, 38), lambda k:
  CAST(list_sum(list_transform(range(1, 63), lambda i: CASE WHEN substr(y, w * 62 + i, 1) = substr({_LETTERS}, k, 1)
    THEN CAST(1 AS BIGINT) << CAST(i - 1 AS INTEGER) ELSE 0 END)) AS BIGINT)))"""
_SUM = "p[1] + (p[1] & p[2]) + acc[1]"
BIT_LCS = f"""list_sum(list_transform(list_reduce(
  list_prepend(list_transform(masks, lambda m: CAST({_FULL} AS BIGINT)),
    list_transform(range(1, len(x) + 1), lambda i: list_transform(masks, lambda m: m[instr({_LETTERS}, substr(x, i, 1))]))),
  lambda v, h: list_reduce(
    list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, len(v) + 1), lambda w: [v[w], h[w]])),
    lambda acc, p: list_append(list_prepend(({_SUM}) >> 62, acc[2:]), (({_SUM}) & {_FULL}) | (p[1] & xor(p[1] & p[2], {_FULL}))))[2:]
), lambda w: 62 - bit_count(w)))"""


def _ratio(best: str) -> str:
    return f"""CASE WHEN s > 0 AND (x = '' OR y = '') THEN 100e0 WHEN x = '' OR y = '' THEN 0e0 ELSE greatest({best},
    100 - 1e2 * (len(x) + len(y) - 2 * {BIT_LCS}) / (na + nb)) END"""


_SIDES = """i, array_to_string(list_filter(a, lambda w: NOT list_contains(i, w)), ' ') AS x,
  array_to_string(list_filter(b, lambda w: NOT list_contains(i, w)), ' ') AS y, len(array_to_string(i, ' ')) AS s"""
_SIZES = f"""*, s + CAST(s > 0 AS INTEGER) + len(x) AS na, s + CAST(s > 0 AS INTEGER) + len(y) AS nb, {MASKS} AS masks"""
_COMMON = "CASE WHEN s > 0 THEN greatest(100 - 1e2 * (na - s) / (s + na), 100 - 1e2 * (nb - s) / (s + nb)) ELSE 0e0 END"
ORACLES["token_set_pairs"] = f"""WITH t AS (SELECT conv_id, turn, {TOKENS} AS a FROM conversations),
p AS (SELECT x.conv_id, x.turn, x.a, y.a AS b, list_filter(x.a, lambda w: list_contains(y.a, w)) AS i
  FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.turn = y.turn - 1),
l AS (SELECT conv_id, turn, len(a) = 0 OR len(b) = 0 AS empty, {_SIDES} FROM p),
m AS MATERIALIZED (SELECT {_SIZES} FROM l)
SELECT conv_id, turn, {rnd(f"CASE WHEN empty THEN 0e0 ELSE {_ratio(_COMMON)} END", 6)} AS ratio FROM m"""
ORACLES["question_bank_dedupe"] = f"""WITH RECURSIVE q AS (SELECT item_id, {TOKENS} AS t FROM benchmark),
names AS (SELECT array_to_string(t, ' ') AS name, t, min(item_id) AS first FROM q WHERE len(t) > 0 GROUP BY ALL),
p AS (SELECT a.name AS left_name, b.name AS right_name, a.t AS a, b.t AS b, list_filter(a.t, lambda w: list_contains(b.t, w)) AS i
  FROM names a JOIN names b ON a.first > b.first),
l AS (SELECT left_name, right_name, {_SIDES} FROM p),
m AS MATERIALIZED (SELECT {_SIZES} FROM l),
alike AS (SELECT left_name, list(right_name) AS near FROM m WHERE {_ratio(_COMMON)} >= 88 GROUP BY 1),
turn AS (SELECT *, row_number() OVER (ORDER BY first) AS r FROM names),
walk AS (
  SELECT 0 AS r, CAST([] AS VARCHAR[]) AS kept
  UNION ALL
  SELECT w.r + 1, CASE WHEN len(list_intersect(w.kept, a.near)) > 0 THEN w.kept ELSE list_append(w.kept, t.name) END
  FROM walk w JOIN turn t ON t.r = w.r + 1 LEFT JOIN alike a ON a.left_name = t.name),
final AS (SELECT arg_max(kept, r) AS kept FROM walk)
SELECT item_id AS position, CAST(len(t) = 0 OR (n.first = item_id AND list_contains(f.kept, n.name)) AS INTEGER) AS kept
FROM q LEFT JOIN names n USING (t) CROSS JOIN final f"""


# --- exchange files ---------------------------------------------------------------------------------------

ORACLES["csv_round_trip"] = f"""SELECT concat_ws('-', conv_id, turn) AS question_id, CAST(NULL AS VARCHAR) AS area,
  CASE WHEN turn % 7 <> 3 THEN concat('say "', text, '",', chr(10), 'then, stop') END AS question,
  CASE WHEN turn % 5 <> 1 THEN {rnd('conv_id / 8e0', 6)} END AS fk_grade FROM conversations"""
ORACLES["csv_optional"] = """SELECT 'there' AS source, CAST(doc_id AS VARCHAR) AS question_id,
  CAST(quality AS VARCHAR) AS human_score, CAST(NULL AS VARCHAR) AS human_notes FROM labels"""
ORACLES["csv_per_model"] = f"""WITH {EV} SELECT model, standard, count(*) AS answers,
  {big("sum(CASE WHEN run % 4 <> 0 THEN binary_score ELSE 0 END)")} AS "right", {big('sum(is_refusal)')} AS refusals,
  count(rubric_score) AS rubrics FROM ev GROUP BY 1, 2"""
ORACLES["reply_items"] = """WITH t AS (SELECT conv_id, turn, text AS t FROM conversations WHERE turn % 4 < 3)
SELECT conv_id, turn, CAST(p AS INTEGER) AS place, CASE p WHEN 0 THEN trim(t) ELSE trim(concat('b ', t)) END AS question,
  CASE p WHEN 0 THEN concat('a', turn) ELSE 'yes' END AS answer FROM t, (SELECT unnest([0, 1]) AS p)"""
