"""The stages end to end with an offline client, and the operators on small hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from compare import rows_scanned
from tallysmith import __main__ as command
from tallysmith.operators import accuracy, agreement, ensemble, overrides, panel, quota
from tallysmith.operators.asking import Reply, Transient, ask, shares
from tallysmith.plans import stages
from tallysmith.plans.report import Author, Grid, Heading, Link, Words, html_table, markdown_table, render, standards_blocks
from tallysmith.sources import dimension, schemas, settings, tables
from tallysmith.sources.settings import Settings, SettingsError

NAMES = ["neutron", "proton", "molecule", "isotope", "crystal", "polymer", "fossil", "magnet", "photon", "glacier", "comet"]


def offline_client():
    """Replies by the purpose of the prompt; nested, so that it travels with the job."""
    names = NAMES

    def client(model, system, prompt, temperature):
        import re

        if prompt.startswith("Write"):
            n, kind, standard = re.match(r"Write (\d+) (\w+) questions on (\S+):", prompt).groups()
            offset = sum(map(ord, standard + kind))
            questions = [
                {"question": f"How does {names[(offset + i) % 11]} {kind} {standard} {i * 7919} behave?", "answer": "It moves."}
                for i in range(int(n))
            ]
            return Reply("```json\n" + json.dumps({"items": questions}) + "\n```", "stop", 10, 20)
        if prompt.startswith("Is this question"):
            return Reply('{"appropriate": true}')
        if prompt.startswith("Is the answer"):
            bad = model == "mini" and "isotope" in prompt
            return Reply(json.dumps({"score": 0 if bad else 1, "rationale": "checked"}))
        if prompt.startswith("Grade"):
            wrong = "by mini" in prompt and "neutron" in prompt
            return Reply("Verdict: " + json.dumps({"binary": 0 if wrong else 1, "rubric": 0.5, "rationale": "ok"}))
        if "comet" in prompt:
            return Reply("I cannot answer this.", "stop", 20, 5)
        return Reply(f"An answer by {model}.", "stop", 20, 30, 8 if model == "mini" else 0)

    return client


TREE = {
    f"A{i}": {"title": f" Area {i} ", "description": "some\n text", "standards": [
        {"code": f"A{i}-1", "text": " first "}, {"code": f"A{i}-2", "text": "second"}]}
    for i in range(2)
}

SETTINGS = {
    "models": {"fast": {"model": "fast-v1", "family": "f"}, "mini": {"model": "mini-v1", "family": "m", "temperature": 1}},
    "generator_model": "fast", "eval_judge": "fast", "gt_judges": ["fast", "mini"], "eval_judges": ["fast", "mini"],
    "benchmark_models": ["fast", "mini"], "eval_mode": "triple", "questions_per_area": 6,
    "question_type_split": {"recall": 2, "conceptual": 2, "applied": 2}, "runs_per_model": 2,
    "appropriateness": {"fk_grade_range": [-99.0, 99.0]}, "grading": {"rubric_for": ["conceptual", "applied"]},
    "validation": {"auto_drop_disagreements": True}, "generation": {"max_rounds": 3},
}


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("workspace"))
    space = stages.Workspace(spark, folder, Settings(SETTINGS), dimension.tree(spark, TREE, 2), offline_client())
    stages.run(space, "all")
    return space


def report(ws, name):
    return ws.spark.read.option("header", True).csv(ws.path(f"reports/{name}"))


def test_ground_truth(ws):
    rows = ws.items().read().collect()
    assert len(rows) == 12 and len({r.question_id for r in rows}) == 12
    assert {r.question_id for r in rows} == {f"A{a}-{n:03d}" for a in range(2) for n in range(1, 7)}
    assert {r.question_type for r in rows} == {"recall", "conceptual", "applied"}
    assert all(r.generator_model == "fast-v1" and r.fk_grade is not None for r in rows)


def test_validation_drops_disagreements(ws):
    questions = {r.question_id: r.question for r in ws.items().read().collect()}
    doubted = {q for q, text in questions.items() if "isotope" in text}
    kept = {r.question_id for r in ws.read("ground_truth_validated").collect()}
    assert kept == set(questions) - doubted
    assert {r.question_id for r in stages.judged(ws).collect()} == set(questions)


def test_responses_and_verdicts(ws):
    kept = ws.read("ground_truth_validated").count()
    assert ws.read("responses").count() == kept * 2 * 2
    rows = ws.read("eval_triple").collect()
    assert len(rows) == kept * 4
    for r in rows:
        assert r.binary_score in (0, 1) and r.is_refusal in (0, 1) and r.rubric_score in (None, 0.0, 0.5, 1.0)
        assert (r.is_refusal == 1) == r.response.startswith("I cannot")
        assert (r.rubric_score is None) == (r.question_type == "recall")


def test_reports(ws):
    board = report(ws, "leaderboard").collect()
    assert {"rank", "macro_accuracy", "micro_accuracy", "mean_total_tokens", "mean_reasoning_tokens"} <= set(board[0].asDict())
    assert all(0 <= float(r.macro_accuracy) <= 1 for r in board)
    tokens = {r.model: r for r in report(ws, "token_usage_by_model").collect()}
    assert float(tokens["mini"].reasoning_mean) > 0 and float(tokens["fast"].reasoning_mean) == 0
    assert {r.panel for r in report(ws, "judge_reliability").collect()} == {"ground_truth", "eval:fast", "eval:mini"}
    text = "\n".join(r.value for r in ws.spark.read.text(ws.path("reports/findings")).collect())
    for part in ("# What the models can do", "* [Ranking](#ranking)", "All models", "| A0-1 |", "## Tables", "Agreement of the judges"):
        assert part in text
    text = "\n".join(r.value for r in ws.spark.read.text(ws.path("reports/provenance")).collect())
    for part in ("fast wrote 12 questions", "Questions by area", "Dropped questions by reason", "ground_truth"):
        assert part in text


def test_second_run_asks_nothing(ws):
    def forbidden(model, system, prompt, temperature):
        raise AssertionError("asked again")

    again = stages.Workspace(ws.spark, ws.folder, ws.settings, ws.tree, forbidden)
    before = (ws.read("responses").count(), ws.read("eval_long_triple").count(), ws.read("gt_judge_long").count())
    stages.run(again, "validate,benchmark,evaluate")
    assert before == (ws.read("responses").count(), ws.read("eval_long_triple").count(), ws.read("gt_judge_long").count())
    done = {r.stage: (r.done, r.total, r.pct) for r in stages.progress(ws).collect()}
    assert done["generate"] == (12, 12, 1.0) and done["validate"] == (24, 24, 1.0)
    # The same from running totals, again after a replaced table, and without reading the tables a second time.
    look = lambda: {r.stage: (r.done, r.total, r.pct) for r in stages.progress(ws, live=True).collect()}
    assert look() == done
    with rows_scanned(ws.spark) as read:
        assert look() == done
    assert read.rows <= 50
    tables.replace(ws.read("responses").limit(1), ws.path("live_copy"))
    assert stages.live_totals(ws, "live_copy").first()["rows"] == 1
    tables.replace(ws.read("responses").limit(3), ws.path("live_copy"))
    assert stages.live_totals(ws, "live_copy", ["total_tokens"]).first()["rows"] == 3


def test_failed_calls_keep_what_was_stored(ws, tmp_path):
    """Answers are stored in slices; the next run asks for the rest only."""
    asked = ws.spark.sparkContext.accumulator(0)

    def failing(model, system, prompt, temperature):
        if "photon" in prompt:
            raise SystemExit("lost")
        return Reply("fine")

    small = Settings({**SETTINGS, "concurrency": {"flush_rows": 4, "max_parallel_requests": 2}})
    space = stages.Workspace(ws.spark, str(tmp_path), small, ws.tree, failing)
    questions = ws.items().read()
    questions.write.parquet(space.path("ground_truth"))
    photons = questions.filter("question LIKE '%photon%'").count()
    if photons:
        with pytest.raises(Exception):
            stages.run(space, "benchmark")

    def counting(model, system, prompt, temperature):
        asked.add(1)
        return Reply("fine")

    before = space.read("responses").count() if tables.exists(ws.spark, space.path("responses")) else 0
    space.client = counting
    stages.run(space, "benchmark")
    total = questions.count() * 2 * 2
    assert space.read("responses").count() == total and asked.value == total - before


def test_calls_are_shared_out():
    assert shares(10_000, 8, 4) == (4, 2) and shares(10_000, 8, 100) == (8, 1) and shares(3, 8, 100) == (1, 8)
    assert all(t * e <= 8 for t, e in (shares(n, 8, c) for n in (0, 1, 33, 500, 10**6) for c in (1, 3, 7, 64)))


def test_many_calls_use_several_tasks(spark):
    def client(model, system, prompt, temperature):
        import os

        return Reply(str(os.getpid()))

    tasks = spark.range(2_000).select(
        F.lit("m").alias("model"), F.lit("").alias("system"), F.col("id").cast("string").alias("prompt"),
        F.lit(None).cast("double").alias("temperature"),
    )
    answered = ask(tasks, client, parallel=4)
    assert answered.rdd.getNumPartitions() == 4 and answered.select("text").distinct().count() > 1


def test_labels_come_back(ws, tmp_path):
    """Sheets that people filled in change scores and questions."""
    import shutil

    folder = tmp_path / "copy"
    shutil.copytree(ws.folder, folder)
    space = stages.Workspace(ws.spark, str(folder), ws.settings, ws.tree, ws.client)
    (folder / "labels").mkdir()
    before = {(r.model, r.question_id, r.run): r.binary_score for r in stages.trials(space).collect()}
    (model, question, run), score = next(iter(sorted(before.items())))
    gone = max(q for _, q, _ in before)
    (folder / "labels" / "flags_eval.csv").write_text(
        f"model,question_id,run,human_score,human_notes\n{model},{question},{run},{score},\n{model},{question},{run},{1 - score},no\n"
    )
    (folder / "labels" / "flags_groundtruth.csv").write_text(f"question_id,human_score,human_notes\n{gone},0,bad\n")
    after = {(r.model, r.question_id, r.run): r.binary_score for r in stages.trials(space).collect()}
    assert after == {k: 1 - score if k == (model, question, run) else v for k, v in before.items() if k[1] != gone}
    (folder / "labels" / "edits.csv").write_text(
        f"question_id,question,reference_answer,keep,drop\n{question},New words?,It moves.,1,\n{gone},x,y,,1\n"
    )
    stages.run(space, "review")
    raw = {r.question_id: r.question for r in space.read("ground_truth").collect()}
    kept = {r.question_id for r in space.read("ground_truth_validated").collect()}
    assert raw[question] == "New words?" and gone in raw and gone not in kept and question in kept


def test_command_line(capsys):
    command.main(["--list"])
    lines = capsys.readouterr().out.splitlines()
    assert [line.split()[0] for line in lines] == list(stages.REGISTRY) and "groundtruth" in lines[0]
    with pytest.raises(SystemExit):
        command.main(["folder"])
    with pytest.raises(ValueError):
        command.main(["folder", "--settings", "s", "--tree", "t", "--stage", "nothing"])


def test_stage_names():
    def names(request):
        return [s.work.__name__ for s in stages.plan(request)]

    assert names("groundtruth") == ["generate", "quality", "validate"]
    assert names("benchmark, evaluate") == ["benchmark", "evaluate"]
    assert names("all") == ["generate", "quality", "validate", "benchmark", "evaluate", "calibrate", "analyze"]
    with pytest.raises(ValueError):
        stages.plan("nothing")


def test_ask_turns_failures_into_rows(spark):
    def client(model, system, prompt, temperature):
        if prompt == "flaky":
            raise Transient("later")
        if prompt == "broken":
            raise KeyError("x")
        return Reply(f" {model} {temperature} ", "stop", 3, 4)

    tasks = spark.createDataFrame([(p,) for p in ("fine", "flaky", "broken")], "prompt string").selectExpr(
        "'m' AS model", "'' AS system", "prompt", "CAST(NULL AS DOUBLE) AS temperature")
    rows = {r.prompt: r for r in ask(tasks, client, attempts=2, backoff=0.0).collect()}
    assert rows["fine"].text == "m None" and rows["fine"].total_tokens == 7 and rows["fine"].ok
    assert not rows["flaky"].ok and not rows["broken"].ok and "KeyError" in rows["broken"].error


def test_overrides(spark):
    columns = "model string, question_id string, run int, binary_score int"
    ev = spark.createDataFrame([("m", "Q1", 1, 1), ("m", "Q2", 1, 1), ("m", "Q3", 1, 0)], columns)
    labels = spark.createDataFrame([("m", "Q1", 1, "0", 1), ("m", "Q3", 1, "", 2)],
                                   "model string, question_id string, run int, human_score string, position int")
    rejected = spark.createDataFrame([("Q2", "0"), ("Q3", None)], "question_id string, human_score string")
    got = {r.question_id: r.binary_score for r in overrides.apply_overrides(ev, labels, rejected).collect()}
    assert got == {"Q1": 0, "Q3": 0}


def test_auto_drop(spark):
    items = spark.createDataFrame([(f"Q{i}", "A") for i in range(3)], "question_id string, area string")
    verdicts = [("Q0", "a", 1), ("Q0", "b", 1), ("Q1", "a", 1), ("Q1", "b", 0), ("Q2", "a", 0), ("Q2", "b", 0)]
    long = spark.createDataFrame(verdicts, "question_id string, judge string, score int").withColumn("rationale", F.lit(""))
    labelled = panel.validated(items, long, ["a", "b"])
    kept, dropped = panel.auto_drop(labelled)
    assert [r.question_id for r in kept.collect()] == ["Q0"]
    assert {r.question_id: r.drop_reason for r in dropped.collect()} == {"Q1": "judge_disagreement", "Q2": "unanimous_incorrect"}
    stats = agreement.panel_reliability(panel.all_judged(kept, dropped), ["judge_a", "judge_b"], F.lit("p")).first()
    assert (stats.n_items, stats.flag_rate) == (3, 0.333)


def teacher_trials(spark):
    scores = {"A": (0, 1, 1), "B": (1, 0, 0), "C": (0, 1, 1)}
    rows = [(m, q, r + 1, "X", "X-1", "recall", s, None, 0) for m, t in scores.items() for q in ("Q1", "Q2") for r, s in enumerate(t)]
    return spark.createDataFrame(rows, "model string, question_id string, run int, area string, standard string, "
                                       "question_type string, binary_score int, rubric_score double, is_refusal int")


def test_first_run_and_ties(spark):
    ev = teacher_trials(spark)
    ranked = {r.model: (r.rank, r.first_run_accuracy, r.ensemble_accuracy) for r in ensemble.overall_ranking(ev).collect()}
    assert ranked == {"A": (1, 0.0, 1.0), "C": (2, 0.0, 1.0), "B": (3, 1.0, 0.0)}
    best = ensemble.best_pick(ensemble.first_run_and_ensemble(ev, ["area"]), "area").first()
    assert (best.best_models, best.n_tied, best.runner_up_models, best.gap) == ("A, C", 2, "B", 1.0)
    table = accuracy.accuracy_table(ev, []).filter("model = 'A'").first()
    assert (table.n, table.rubric_mean, table.run_acc_std) == (6, None, 0.4714)


def test_redistribute_in_order(spark):
    """Two stuck slots: the second gives on what it got from the first."""
    slot = "area string, standard string, question_type string, ordinal int, target long, have long, stuck boolean, capped boolean"
    rows = [("A", s, "r", i, 10, h, k, c) for i, (s, h, k, c) in enumerate(
        [("a", 3, True, False), ("b", 10, False, True), ("c", 4, True, False), ("d", 10, False, False), ("e", 9, False, False)])]
    got = {r.standard: (r.target, r.capped) for r in quota.redistribute(spark.createDataFrame(rows, slot)).collect()}
    # a gives 7 to c, d, e: 3, 2, 2. c then misses 10 + 3 - 4 = 9 and gives d 5, e 4.
    assert got == {"a": (3, True), "b": (10, True), "c": (4, True), "d": (17, False), "e": (16, False)}
    alone = spark.createDataFrame([("A", "a", "r", 0, 5, 1, True, False)], slot)
    assert [(r.target, r.capped) for r in quota.redistribute(alone).collect()] == [(1, True)]


def test_ids_go_on_in_pieces(spark):
    new = spark.range(50).select(F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("area"), F.col("id").alias("position"))
    old = spark.createDataFrame([("A", "A-007"), ("A", "A-x"), ("C", "C-100")], "area string, question_id string")
    got = quota.allocate_ids(new, old, "position", width=4).orderBy("position").collect()
    expected = {"A": 7, "B": 0}
    for row in got:
        expected[row.area] += 1
        assert row.question_id == f"{row.area}-{expected[row.area]:03d}"


def test_csv_sources(spark, tmp_path):
    folder = tmp_path / "eval"
    folder.mkdir()
    (folder / "m_1_single.csv").write_text('question_id,run,response,binary_score\nQ1,1,"two\nlines, ""quoted""",1\nQ2,x,,oops\n')
    (folder / "m2_single.csv").write_text("question_id,run,response,binary_score\nQ1,1,a,1.0\n")
    (folder / "m2_triple.csv").write_text("question_id,run,response,binary_score\nQ9,1,a,1\n")
    rows = tables.read_trials(spark, str(folder), "single", stages.schemas.EVAL).orderBy("model", "question_id").collect()
    assert [(r.model, r.question_id, r.run, r.binary_score, r.is_refusal) for r in rows] == [
        ("m2", "Q1", 1, 1, 0), ("m_1", "Q1", 1, 1, 0), ("m_1", "Q2", None, 0, 0)]
    assert rows[1].response == 'two\nlines, "quoted"'
    with pytest.raises(FileNotFoundError):
        tables.read_per_model(spark, str(folder), "_none", stages.schemas.EVAL)
    assert tables.read_csv_or_empty(spark, str(folder / "no.csv"), stages.schemas.EVAL).count() == 0
    assert tables.write_report(spark.range(0).toDF("x"), str(tmp_path / "r")) is False
    assert tables.write_report(spark.range(2).toDF("x"), str(tmp_path / "r")) is True
    moved = tables.backup(spark, str(tmp_path / "r"))
    assert "/kept/r/" in moved and not tables.exists(spark, str(tmp_path / "r")) and tables.exists(spark, moved)


def test_dimension_and_settings(spark):
    tree = dimension.tree(spark, TREE, 2)
    assert [(r.area, r.area_title, r.description) for r in dimension.areas(tree).orderBy("ordinal").collect()] == [
        ("A0", "Area 0", "some text"), ("A1", "Area 1", "some text")]
    assert [r.standard for r in dimension.standards(tree).orderBy("ordinal").collect()] == ["A0-1", "A0-2", "A1-1", "A1-2"]
    blocks = standards_blocks(dimension.areas(tree), dimension.standards(tree))
    assert [b.words for b in blocks if isinstance(b, Heading)] == ["A0: Area 0", "A1: Area 1"]
    assert "| A1-2 | second |" in render("Standards", blocks)
    with pytest.raises(ValueError):
        dimension.tree(spark, TREE, 12)
    with pytest.raises(ValueError):
        dimension.tree(spark, {"A": {"standards": []}}, 1)
    for change in ({"eval_judge": "ghost"}, {"questions_per_area": 7}, {"eval_mode": "double"}):
        with pytest.raises(SettingsError):
            Settings({**SETTINGS, **change}).check()
    left = Settings(SETTINGS).without_model("fast")
    assert (left.get("eval_judge"), left.get("gt_judges")) == ("mini", ["mini"])
    left.check()
    full = Settings(SETTINGS)
    models, roles = full.model_table(spark), full.role_table(spark)
    assert settings.unregistered(roles, models).count() == 0 and settings.in_use(roles, models).count() == 2
    names = settings.key_names(spark.createDataFrame([("K1",), ("K2",)], "key_name string"), spark.createDataFrame([("K2",)], "key_name string"))
    assert {(r.key_name, r.stored) for r in names.collect()} == {("K1", False), ("K2", True)}
    assert settings.overlay({"a": {"x": "1", "y": "2"}}, {"a": {"y": "3"}, "b": 1}) == {"a": {"x": "1", "y": "3"}}
    assert settings.lost_placeholders("$a ${b}", ["a", "b", "c"]) == ["c"]


def test_markdown(spark):
    df = spark.createDataFrame([("a|b\nc", None), ("d", 1.5)], "x string, y double")
    assert markdown_table(df, "x") == "| x | y |\n| --- | --- |\n| a\\|b c |  |\n| d | 1.5 |"
    assert markdown_table(df.limit(0)) == "*nothing to report*"
    assert html_table(df, "x").endswith("<tr><td>d</td><td>1.5</td></tr></table>")
    with pytest.raises(ValueError):
        markdown_table(df, most=1)
    text = render("T", [Heading("One two"), Words("w"), Grid("Cap", ["x"], [(1,)])])
    assert "* [One two](#one-two)" in text and "1: Cap" in text and "| 1 |" in text
    written = {}
    author = Author(lambda name, table: written.setdefault(name, name), shown=1)
    assert author.table("Long one", df) == Link("Long one", "long-one") and written
    with pytest.raises(ValueError):
        Author(shown=1).table("Long", df)


def test_edited_templates_keep_their_placeholders(spark, tmp_path):
    def space(templates):
        given = Settings({**SETTINGS, "templates": templates})
        return stages.Workspace(spark, str(tmp_path), given, dimension.tree(spark, TREE, 2))

    new = "Fit for $area_title? $question"
    assert space({"appropriate": new}).templates == {**stages.TEMPLATES, "appropriate": new}
    assert space(None).templates == stages.TEMPLATES
    with pytest.raises(SettingsError, match=r"\$question"):
        space({"appropriate": "Fit for $area_title?"})
    with pytest.raises(SettingsError, match="no templates called"):
        space({"other": "x"})


def test_sheets_need_their_columns(spark, tmp_path):
    space = stages.Workspace(spark, str(tmp_path), Settings(SETTINGS), dimension.tree(spark, TREE, 2))
    spark.createDataFrame([("Q1", "1")], "id string, human_score string").write.option("header", True).csv(space.path("labels/flags_groundtruth.csv"))
    with pytest.raises(ValueError, match="no column question_id"):
        space.sheet("flags_groundtruth", schemas.ITEM_FLAGS, ["question_id", "human_score"])
    assert space.sheet("flags_eval", schemas.EVAL_FLAGS).count() == 0


def test_the_first_table_that_is_there(spark, tmp_path):
    space = stages.Workspace(spark, str(tmp_path), Settings(SETTINGS), dimension.tree(spark, TREE, 2))
    with pytest.raises(FileNotFoundError):
        space.first_of("better", "plain")
    spark.range(1).write.parquet(space.path("plain"))
    assert space.first_of("better", "plain").count() == 1
    spark.range(2).write.parquet(space.path("better"))
    assert space.first_of("better", "plain").count() == 2
