"""Cleaning a whole table: impute, drop duplicates, cap outliers, tidy text, with a log of every change.

Each step sees the result of the one before, so the fits run in order:

* fit 1 on the input: missing counts, then medians and modes of the columns that need them,
* the imputed table without duplicates is written once (the only wide shuffle),
* fit 2 on that table: quartiles, outlier counts, text frequencies, each a scan of a few columns,
* one projection applies caps and text rules.

The fitted model is plain data and can be applied to further rows of the same schema.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from tablewise.constants import (
    ACTION_DUPLICATES,
    ACTION_MEDIAN,
    ACTION_MODE,
    ACTION_OUTLIERS,
    ACTION_STRIP,
    ACTION_TITLE,
    ACTION_UNKNOWN,
    REPORT_TOP_ACTIONS,
)
from tablewise.operators.clean import (
    Bounds,
    MissingFit,
    TextFit,
    capped,
    capped_in_type,
    drop_duplicate_rows,
    fit_bounds,
    fit_few_valued,
    fit_missing,
    outlier_aggregates,
    replace_columns,
    tidied,
)
from tablewise.operators.profile import distinct_sketches, few_valued
from tablewise.operators.quantiles import aggregate_row
from tablewise.operators.roles import categorical_columns, numeric_columns
from tablewise.sources.staging import stage

ACTION_SCHEMA = (
    "seq int, column_name string, action_type string, n_affected long, description string, justification string"
)


@dataclass
class CleaningOptions:
    exclude: tuple[str, ...] = ()       # columns never capped, such as identifiers
    skip_zero_iqr: bool = False         # leave columns alone whose quartiles are equal
    impute_dates: bool = True           # fill date texts with the most common date, like any category
    date_columns: tuple[str, ...] = ()  # the date texts meant by ``impute_dates``
    quantile_limits: dict[str, int] = field(default_factory=dict)   # direct_rows and budget of the quantiles
    reusable: bool = False              # fit fills of complete columns too, for ``CleaningModel.transform``


@dataclass(frozen=True)
class Action:
    column: str
    action_type: str
    n_affected: int
    description: str
    justification: str


def _action(name: str, texts: tuple[str, str, str], n_affected: int, note: str = "", **values) -> Action:
    kind, description, justification = texts
    return Action(name, kind, n_affected, description.format(**{"n": n_affected, **values}) + note, justification)


@dataclass
class CleaningModel:
    """Everything the fits found."""

    missing: MissingFit
    bounds: dict[str, Bounds]       # of the columns that had outliers
    texts: dict[str, TextFit]
    quiet_bounds: dict[str, Bounds] = field(default_factory=dict)    # of those that had none, for further rows

    def impute(self, df: DataFrame) -> DataFrame:
        return replace_columns(df, self.missing.expressions(df))

    def cap_and_tidy(self, df: DataFrame) -> DataFrame:
        expressions: dict[str, Column] = {c: capped(c, b) for c, b in self.bounds.items()}
        expressions.update({c: tidied(c, f) for c, f in self.texts.items() if f.n_spaced or f.title_case})
        return replace_columns(df, expressions)

    def transform(self, df: DataFrame) -> DataFrame:
        """Clean further rows with what was fitted here. Every bounded column is capped, also one without outliers
        in the fitted table, which keeps its type. Values that only the further rows lack are filled if the
        model was fitted with ``CleaningOptions(reusable=True)``."""
        imputed = self.impute(df)
        imputed = replace_columns(imputed, self.missing.spare_expressions(imputed))
        unique = drop_duplicate_rows(imputed)
        quiet = {c: capped_in_type(unique, c, b) for c, b in self.quiet_bounds.items() if c in unique.columns}
        return self.cap_and_tidy(replace_columns(unique, quiet))


@dataclass
class CleaningResult:
    cleaned: DataFrame
    model: CleaningModel
    actions: list[Action]
    rows_before: int
    rows_after: int
    columns_before: list[str]
    issues: list[tuple[str, str, int]] = field(default_factory=list)   # column, issue, count
    warning: str | None = None

    def _spark(self) -> SparkSession:
        return self.cleaned.sparkSession

    def action_log(self) -> DataFrame:
        """seq, column_name, action_type, n_affected, description, justification."""
        rows = [
            (i, a.column, a.action_type, a.n_affected, a.description, a.justification)
            for i, a in enumerate(self.actions, start=1)
        ]
        return self._spark().createDataFrame(rows, ACTION_SCHEMA)

    def top_actions(self, n: int = REPORT_TOP_ACTIONS) -> DataFrame:
        return self.action_log().orderBy("seq").limit(n)

    def issue_table(self) -> DataFrame:
        """column_name, issue, n: what was found wrong, whether or not it was changed."""
        return self._spark().createDataFrame(self.issues, "column_name string, issue string, n long")

    def report(self) -> DataFrame:
        """One row: shape before and after, number of actions and of issues."""
        row = (self.rows_before, len(self.columns_before), self.rows_after, len(self.cleaned.columns),
               len(self.actions), len(self.issues))
        return self._spark().createDataFrame(
            [row], "rows_before long, columns_before int, rows_after long, columns_after int, n_actions int, "
            "n_issues int"
        )


def _missing_actions(df: DataFrame, fit: MissingFit) -> list[Action]:
    actions = []
    for c in [c for c in numeric_columns(df) if c in fit.medians]:
        if fit.medians[c] is None:
            actions.append(_action(c, ACTION_MEDIAN, 0, " (no value to take it from: left missing)", n=fit.missing[c]))
        else:
            actions.append(_action(c, ACTION_MEDIAN, fit.missing[c]))
    for c in [c for c in df.columns if c in fit.modes]:
        n, value = fit.missing[c], fit.modes[c]
        if n < fit.rows:
            actions.append(_action(c, ACTION_MODE, n, value=value))
        else:
            actions.append(_action(c, ACTION_UNKNOWN, 0 if value is None else n, n=n))
    return actions


def _text_actions(texts: dict[str, TextFit]) -> list[Action]:
    actions = []
    for c, f in texts.items():
        if f.n_spaced:
            actions.append(_action(c, ACTION_STRIP, f.n_spaced))
        if f.title_case and f.n_titled < f.n_stripped:
            actions.append(_action(c, ACTION_TITLE, f.n_stripped - f.n_titled, before=f.n_stripped, after=f.n_titled))
    return actions


def clean_table(df: DataFrame, options: CleaningOptions | None = None) -> CleaningResult:
    """Fit and apply the whole cleaning. Errors are raised, not swallowed."""
    options = options or CleaningOptions()
    keep_missing = () if options.impute_dates else options.date_columns
    missing = fit_missing(df, [c for c in df.columns if c not in keep_missing], options.reusable, **options.quantile_limits)
    actions = _missing_actions(df, missing)
    issues = [(c, "missing", n) for c, n in missing.missing.items()]

    imputed = replace_columns(df, missing.expressions(df))
    unique = stage(drop_duplicate_rows(imputed), "unique-rows")

    numbers = [c for c in numeric_columns(unique) if c not in options.exclude]
    rows = unique.count()   # from the footers of the written table
    # A number column is complete by now, or was empty from the start.
    present = {c: 0 if missing.medians.get(c, 0) is None else rows for c in numbers}
    if rows < missing.rows:
        actions.append(_action("all", ACTION_DUPLICATES, missing.rows - rows))
        issues.append(("all", "duplicate", missing.rows - rows))

    bounds = fit_bounds(unique, numbers, counts=present, **options.quantile_limits)
    if options.skip_zero_iqr:
        bounds = {c: b for c, b in bounds.items() if b.q1 < b.q3}
    texts = [c for c in categorical_columns(unique) if c not in keep_missing]
    # One pass counts the outliers and sketches the distinct values of the texts.
    counts = aggregate_row(unique, outlier_aggregates(bounds) + distinct_sketches(texts))
    outliers = dict(zip(bounds, counts))
    few = few_valued(texts, counts[len(bounds):])
    quiet = {c: b for c, b in bounds.items() if not outliers[c]}
    bounds = {c: b for c, b in bounds.items() if outliers[c]}
    for c, b in bounds.items():
        n = outliers[c]
        actions.append(_action(c, ACTION_OUTLIERS, n, "" if b.q1 < b.q3 else " (the quartiles are equal)"))
        issues.append((c, "outlier", n))

    tidy = fit_few_valued(unique, rows, few)
    actions += _text_actions(tidy)

    model = CleaningModel(missing, bounds, tidy, quiet)
    result = CleaningResult(model.cap_and_tidy(unique), model, actions, missing.rows, rows, df.columns, issues)
    if rows == 0:
        result.cleaned = df
        result.warning = "Cleaning returned an empty table, using the original instead"
    return result
