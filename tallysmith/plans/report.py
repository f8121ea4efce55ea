"""Reports as lists of blocks, rendered as Markdown, and single tables as Markdown or HTML."""

from __future__ import annotations

import html
import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysmith.operators import accuracy, ensemble, items, significance, usage
from tallysmith.operators.common import checkpointed

EMPTY = "*nothing to report*"

#: Rows that are shown in a document; a longer table is written as a file and linked.
SHOWN = 2_000


@dataclass(frozen=True)
class Heading:
    words: str
    level: int = 2


@dataclass(frozen=True)
class Words:
    words: str


@dataclass(frozen=True)
class Grid:
    """A table with its caption."""

    caption: str
    columns: Sequence[str]
    rows: Sequence[Sequence]


@dataclass(frozen=True)
class Link:
    """A table that is too long to be shown, and where it was written."""

    caption: str
    target: str


Block = Heading | Words | Grid | Link


def plain(value) -> str:
    """A value in one line; missing ones are empty."""
    missing = value is None or isinstance(value, float) and math.isnan(value)
    return "" if missing else " ".join(str(value).split())


def grid_text(columns: Sequence[str], rows: Iterable[Sequence]) -> str:
    """Pipe table; pipes inside values are escaped."""

    def line(values: Iterable[str]) -> str:
        return f"| {' | '.join(v.replace('|', chr(92) + '|') for v in values)} |"

    body = [line(map(plain, row)) for row in rows]
    return "\n".join([line(columns), line("---" for _ in columns), *body]) if body else EMPTY


def slug(words: str) -> str:
    return "-".join("".join(c if c.isalnum() else " " for c in words.lower()).split())


def render(title: str, blocks: Sequence[Block], at: datetime | None = None) -> str:
    """The blocks in order under a title, an overview of the headings, and an index of the tables at the end."""
    made = (at or datetime.now(timezone.utc)).isoformat(timespec="minutes")
    head = [f"# {title}", f"As of {made}."]
    head += [f"{'  ' * (b.level - 2)}* [{b.words}](#{slug(b.words)})" for b in blocks if isinstance(b, Heading)]
    body, index = [], []
    for block in blocks:
        match block:
            case Heading(words, level):
                body.append(f"{'#' * level} {words}")
            case Words(words):
                body.append(words)
            case Grid(caption, columns, rows):
                index.append(caption)
                body.append(f"{grid_text(columns, rows)}\n\n{len(index)}: {caption}")
            case Link(caption, target):
                index.append(caption)
                body.append(f"{len(index)}: {caption}, see `{target}`")
    tail = ["## Tables", *(f"{n}: {caption}" for n, caption in enumerate(index, 1))] if index else []
    return "\n\n".join([*head, *body, *tail]) + "\n"


def _rows(df: DataFrame, order: Sequence, most: int) -> list:
    return (df.orderBy(*order) if order else df).limit(most + 1).collect()


class Author:
    """Turns report tables into blocks. ``write(name, table)`` stores what is too long and returns its place."""

    def __init__(self, write: Callable[[str, DataFrame], str] | None = None, shown: int = SHOWN):
        self.write, self.shown = write, shown

    def table(self, caption: str, df: DataFrame, *order) -> Block:
        rows = _rows(df, order, self.shown)
        if len(rows) <= self.shown:
            return Grid(caption, df.columns, rows)
        if self.write is None:
            raise ValueError(f"{caption}: more than {self.shown} rows, and nowhere to write them")
        return Link(caption, self.write(slug(caption), df))


def markdown_table(df: DataFrame, *order, most: int = SHOWN) -> str:
    """A report as text; refuses anything that is not report-sized."""
    return grid_text(df.columns, _report_rows(df, order, most))


def html_table(df: DataFrame, *order, most: int = SHOWN) -> str:
    """A report as a bordered HTML table; missing values stay empty."""

    def cells(tag: str, values: Iterable) -> str:
        return "<tr>" + "".join(f"<{tag}>{html.escape(plain(v), quote=False)}</{tag}>" for v in values) + "</tr>"

    body = "".join(cells("td", row) for row in _report_rows(df, order, most))
    return f'<table border="1">{cells("th", df.columns)}{body}</table>'


def _report_rows(df: DataFrame, order: Sequence, most: int) -> list:
    rows = _rows(df, order, most)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write the table with write_report instead")
    return rows


def standards_blocks(areas: DataFrame, standards: DataFrame) -> list[Block]:
    """What is asked about: every area with its description and its standards."""
    listed = standards.groupBy("area").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "standard", "standard_text"))).alias("members")
    )
    joined = areas.join(listed, "area", "left").orderBy("ordinal").collect()  # a row per area
    blocks: list[Block] = []
    for row in joined:
        members = [(m["standard"], m["standard_text"]) for m in row["members"] or ()]
        blocks += [Heading(f"{row['area']}: {row['area_title']}"), Words(plain(row["description"]) or "-")]
        blocks.append(Grid(f"Standards of {row['area']}", ["standard", "text"], members))
    return blocks


def provenance(
    author: Author, judged: DataFrame, areas: DataFrame, reliability: DataFrame | None, rejects: DataFrame | None,
    generator: str, judges: Sequence[str], band: tuple[float, float], threshold: float,
) -> str:
    """Where the questions come from: counts, composition, rejected candidates and agreement of the judges.

    ``judged`` has every judged question, automatically dropped ones included (``drop_reason``, NULL if kept).
    """
    kept = F.col("drop_reason").isNull()
    counts = judged.agg(F.count("*").alias("judged"), F.count_if(kept).alias("kept")).first()
    by_type = judged.groupBy("question_type").agg(F.count("*").alias("judged"), F.count_if(kept).alias("kept"))
    by_area = areas.select("area", "area_title", "ordinal").join(
        judged.groupBy("area").agg(F.count("*").alias("judged"), F.count_if(kept).alias("kept")), "area", "left"
    )
    reasons = judged.filter(~kept).groupBy("drop_reason").agg(F.count("*").alias("questions"))
    blocks: list[Block] = [
        Heading("Size"),
        Words(f"{generator} wrote {counts['judged']} questions that {len(judges)} judges ({', '.join(judges)}) scored; "
              f"{counts['kept']} of them are kept."),
        author.table("Questions by type", by_type, "question_type"),
        author.table("Questions by area", by_area.drop("ordinal"), "area"),
        Heading("Checks"),
        Words(f"Reading grade from {band[0]} to {band[1]}; token-set ratio below {threshold} within an area."),
        author.table("Dropped questions by reason", reasons, "drop_reason"),
    ]
    if rejects is not None:
        kind = F.regexp_extract("reason", r"^[a-z_]+", 0).alias("check")
        blocks.append(author.table("Rejected candidates", rejects.groupBy(kind).agg(F.count("*").alias("candidates")), "check"))
    if reliability is not None:
        blocks.append(author.table("Agreement of the judges", reliability, "panel"))
    return render("Origin of the questions", blocks)


def findings(
    trials: DataFrame, responses: DataFrame | None, areas: DataFrame, standards: DataFrame,
    reliability: DataFrame | None = None, band: tuple[float, float] = (5.0, 9.0), author: Author | None = None,
) -> str:
    """The full findings document. Missing inputs leave out their part.

    Everything that compares votes starts from one written table with a row per model and question.
    """
    author = author or Author()
    counts = trials.agg(
        F.count_distinct("model").alias("models"), F.count_distinct("question_id").alias("questions"),
        F.count_distinct("run").alias("runs"),
    ).first()
    votes = checkpointed(ensemble.votes(trials))
    ranking = ensemble.overall_ranking(votes)
    models = [r["model"] for r in ranking.orderBy("rank").collect()]  # a row per model
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    area_names = [r["area"] for r in areas.orderBy("ordinal").select("area").collect()]
    named_areas = areas.select("area", "area_title", "ordinal")
    types = ensemble.QUESTION_TYPES
    table = author.table

    def scores(*group: str) -> DataFrame:
        return ensemble.first_run_and_ensemble(votes, list(group))

    tests = checkpointed(significance.significance(votes))
    wins = significance.win_counts(tests)
    by_type, by_area, by_standard = scores("question_type"), scores("area"), scores("standard")
    labels = standards.select("standard", "area", "standard_text", "ordinal")
    blocks: list[Block] = [
        Words(f"{counts['models']} models, {counts['questions']} questions, up to {counts['runs']} runs of each. "
              "single: accuracy of run 1; ensemble: accuracy of the majority over the runs. Refusals are wrong answers."),
        Heading("Ranking"),
        table("All models", ensemble.overall_table(trials, accuracy.leaderboard(trials, responses)), "rank"),
        table("Spread over the runs", ensemble.stability(trials), place),
        Heading("Which differences hold"),
    ]
    if wins.filter("wins > 0").isEmpty():
        blocks.append(Words("None is significant after correction."))
    else:
        blocks += [
            table("Row beats column", significance.win_matrix(tests, models), place),
            table("Models beaten", wins, place),
        ]
    best_area = ensemble.best_pick(by_area, "area").join(named_areas, "area", "left")
    best_standard = ensemble.best_pick(by_standard, "standard").join(labels.drop("standard_text"), "standard", "left")
    blocks += [
        Heading("By type of question"),
        table("Accuracy by type", ensemble.single_ensemble_pivot(by_type, "question_type", types), place),
        table("Best of each type", ensemble.best_pick(by_type, "question_type"), "question_type"),
        Heading("By area"),
        table("Ensemble accuracy by area", ensemble.ensemble_matrix(by_area, "area", area_names), place),
        table("Best of each area", best_area, "ordinal"),
    ]
    by_both = scores("question_type", "area")
    cross = ensemble.single_ensemble_pivot(by_both, "area", area_names, ["question_type"])
    blocks += [
        table("Accuracy by type and area", cross, "question_type", place),
        Heading("By standard"),
        table("Best of each standard", best_standard, "ordinal"),
    ]
    detail = ensemble.single_ensemble_pivot(scores("standard", "question_type"), "question_type", types, ["standard"])
    detail = labels.join(detail, "standard").drop("area")
    blocks += [
        table("Every standard", detail, "ordinal", place),
        Heading("Questions"),
        table("Difficulty and discrimination", items.psychometrics(trials).join(
            areas.select("area", "ordinal"), "area", "left"), "ordinal", "question_type"),
        Heading("Responses"),
    ]
    if responses is None:
        blocks.append(Words("No responses are stored."))
    else:
        blocks += [
            table("Reading grade", usage.reading_level_by_model(responses, *band), place),
            table("Tokens", usage.token_stats(responses, []), place),
        ]
    if reliability is not None:
        blocks += [Heading("Judges"), table("Agreement of the judges", reliability, "panel")]
    return render("What the models can do", blocks)
