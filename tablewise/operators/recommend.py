"""From written chart recommendations to a chart plan, for a table (doc_id, text) of many texts.

Everything happens inside the row of a text: its lines, sections, mentioned columns and chart stay arrays
of that row until they are exploded. There is no shuffle and no join, so a long text or a popular
document id cannot skew anything. The described table enters as lists of its column names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.constants import (
    BUBBLE_MIN_NUMERIC,
    CATEGORY_MAX_DISTINCT,
    CHART_WORDS,
    COLOUR_MAX_DISTINCT,
    CROSSTAB_MAX_GROUPS,
    CROSSTAB_MAX_VALUES,
    HEATMAP_MIN_NUMERIC,
    LINE_GROUP_MAX_DISTINCT,
    PIE_MAX_DISTINCT,
    RADAR_MAX_FEATURES,
    RADAR_MIN_FEATURES,
    SECTION_LINE_LENGTH,
    SECTION_MIN_LENGTH,
    TREEMAP_MAX_DISTINCT,
)
from tablewise.functions.text import strip
from tablewise.operators.dates import category_facts
from tablewise.operators.profile import sql_text
from tablewise.operators.roles import categorical_columns, datetime_columns, numeric_columns

INDEX = "index"
FEW_NAMES = 40          # so many names are looked for one by one
FRAGMENT = 3            # characters of a name that lead to it
FRAGMENT_BUCKETS = 8    # buckets per name


@dataclass(frozen=True)
class TableFacts:
    """What a plan needs to know of the described table."""

    numbers: list[str]
    categories: list[str]
    dates: list[str]
    distinct: dict[str, int]      # of the categories; a missing one has too many for any chart

    def at_most(self, limit: int) -> list[str]:
        return [c for c in self.categories if self.distinct.get(c, limit + 1) <= limit]


def table_facts(df: DataFrame) -> TableFacts:
    categories = categorical_columns(df)
    facts = category_facts(df, categories)
    return TableFacts(numeric_columns(df), categories, datetime_columns(df) + list(facts.dates), facts.distinct)


def numbered_sections(texts: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, section (from 1), description.

    A line that starts with 1. to 9. opens a section; later lines are appended with a space. Blank lines
    and everything before the first section are left out. ``10.`` does not open a section.
    """
    stripped = F.transform(F.split(text, "\n"), strip)
    lines = texts.select(F.col(doc).alias("doc_id"), F.filter(stripped, lambda x: x != "").alias("lines"))
    starts = lines.selectExpr(
        "doc_id", "lines",
        f"""filter(if(size(lines) > 0, sequence(0, size(lines) - 1), array()),
                   i -> rlike(lines[i], '^[1-9][.]') and length(lines[i]) > {SECTION_LINE_LENGTH}) as starts""",
    )
    sections = starts.selectExpr(
        "doc_id",
        """posexplode(transform(starts, (s, k) ->
               array_join(slice(lines, s + 1, coalesce(get(starts, k + 1), size(lines)) - s), ' ')))
           as (position, description)""",
    )
    return sections.selectExpr("doc_id", "position + 1 as section", "description")


def chart_types(sections: DataFrame) -> DataFrame:
    """Add plot_type: the first chart in match order with a word in the text, NULL without one.
    Sections that are too short are left out."""
    lowered = F.col("_low")
    kind = None
    for plot_type, words in CHART_WORDS:
        found = lowered.contains(words[0])
        for word in words[1:]:
            found = found | lowered.contains(word)
        kind = F.when(found, plot_type) if kind is None else kind.when(found, plot_type)
    long = sections.where(F.length("description") >= SECTION_MIN_LENGTH)
    return long.withColumn("_low", F.lower("description")).withColumn("plot_type", kind).drop("_low")


def _list(names: list[str]) -> str:
    return f"array({', '.join(sql_text(n) for n in names)})" if names else "cast(array() as array<string>)"


def _mentioned(names: list[str]) -> str:
    """Names that are part of the lower-case text ``low``, in the order of the table.

    A few names are looked for one by one. Of many, only those are that a fragment points to: every name of at least
    ``FRAGMENT`` ASCII characters stands in a hashed bucket under its rarest fragment, the fragments of the text are looked
    up in the buckets, and the names found there are confirmed. So a text costs its own length, not the number of names.
    """
    if not names:
        return _list([])
    lowered = f"array({', '.join(f'lower({sql_text(n)})' for n in names)})"
    if len(names) <= FEW_NAMES:
        return f"filter({_list(names)}, (c, i) -> contains(low, {lowered}[i]))"
    places = [i for i, n in enumerate(names) if n.isascii() and len(n) >= FRAGMENT]
    fragments = {i: {names[i].lower()[k:k + FRAGMENT] for k in range(len(names[i]) - FRAGMENT + 1)} for i in places}
    common = Counter(f for own in fragments.values() for f in own)
    size = FRAGMENT_BUCKETS * len(names)
    buckets: list[list[str]] = [[] for _ in range(size)]
    for i, own in fragments.items():
        rarest = min(own, key=lambda f: (common[f], f))
        buckets[zlib.crc32(rarest.encode()) % size].append(str(i))
    plain = [str(i) for i in range(len(names)) if i not in fragments]
    table = sql_text(";".join(",".join(b) for b in buckets))
    found = (f"flatten(transform(array_distinct(regexp_extract_all(low, '(?s)(?=(.{{{FRAGMENT}}}))', 1)), "
             f"f -> split(split({table}, ';')[int(crc32(f) % {size})], ',')))")
    hits = (f"filter(array_distinct(concat(split({sql_text(','.join(plain))}, ','), {found})), "
            f"c -> c != '' and contains(low, {lowered}[int(c)]))")
    return f"transform(array_sort(transform({hits}, c -> int(c))), c -> {_list(names)}[c])"


def column_mentions(sections: DataFrame, facts: TableFacts) -> DataFrame:
    """doc_id, section, column_name, role, rnk: columns whose name is part of the text, per role in
    the order of the table. A date held as text counts as a category and as a date."""
    roles = (("numeric", facts.numbers), ("categorical", facts.categories), ("datetime", facts.dates))
    structs = ", ".join(
        f"transform({_mentioned(names)}, (c, i) -> "
        f"named_struct('column_name', c, 'role', '{role}', 'rnk', i + 1))"
        for role, names in roles
    )
    lowered = sections.withColumn("low", F.lower("description"))
    return lowered.selectExpr("doc_id", "section", f"inline(concat({structs}))")


@dataclass(frozen=True)
class _Rule:
    """SQL for the columns of one chart type and the condition that it can be drawn."""

    needs: str
    x: str = "null"
    y: str = "null"
    group: str = "null"
    variant: str = "null"

    def struct(self) -> str:
        return (f"case when {self.needs} then named_struct('x', string({self.x}), 'y', string({self.y}), "
                f"'group_col', string({self.group}), 'variant', string({self.variant})) end")


def _rules(facts: TableFacts) -> dict[str, _Rule]:
    """m_num, m_cat and m_date are the mentioned columns; ``within(limit)`` are the mentioned categories
    with at most that many values."""
    def within(limit: int) -> str:
        return f"filter(m_cat, c -> array_contains({_list(facts.at_most(limit))}, c))"

    def first(array: str) -> str:
        return f"get({array}, 0)"

    def number(i: int) -> str:
        return sql_text(facts.numbers[i]) if len(facts.numbers) > i else "null"

    def numbers_at_least(n: int) -> str:
        return "true" if len(facts.numbers) >= n else "false"

    has_category = "true" if facts.categories else "false"
    other_category = f"get(filter(m_cat, c -> c != {first('m_cat')}), 0)"
    grouped = (f"array_contains({_list(facts.at_most(CROSSTAB_MAX_GROUPS))}, {other_category}) and "
               f"array_contains({_list(facts.at_most(CROSSTAB_MAX_VALUES))}, {first('m_cat')})")
    first_date = sql_text(facts.dates[0]) if facts.dates else "null"
    along = f"coalesce({first('m_date')}, {first('m_cat')}, {first_date}, '{INDEX}')"
    line_group = f"get(filter({within(LINE_GROUP_MAX_DISTINCT)}, c -> c != {along}), 0)"
    radar_features = (f"slice(if(size(m_num) < {RADAR_MIN_FEATURES}, {_list(facts.numbers)}, m_num), 1, "
                      f"{RADAR_MAX_FEATURES})")
    first_category = sql_text(facts.categories[0]) if facts.categories else "null"
    levels = within(TREEMAP_MAX_DISTINCT)
    levels = f"if(size({levels}) > 0, {levels}, {_list(facts.categories[:2])})"

    a_number, colour = "size(m_num) > 0", first(within(COLOUR_MAX_DISTINCT))
    by_category = _Rule(a_number, x=first(within(CATEGORY_MAX_DISTINCT)), y=first("m_num"))
    line = _Rule(a_number, x=along, y=first("m_num"), group=line_group)
    pie = within(PIE_MAX_DISTINCT)
    return {
        "histogram": _Rule(a_number, x=first("m_num")),
        "bar": _Rule("size(m_cat) > 0", x=first("m_cat"), group=f"if({grouped}, {other_category}, null)"),
        "pie": _Rule(f"size({pie}) > 0", x=first(pie)),
        "scatter": _Rule("size(m_num) > 1", x="get(m_num, 0)", y="get(m_num, 1)", group=colour),
        "box": by_category,
        "line": line,
        "area": replace(line, variant=f"case when {line_group} is null then 'simple' "
                                      "when contains(low, 'stack') then 'stacked' else 'share' end"),
        "heatmap": _Rule(numbers_at_least(HEATMAP_MIN_NUMERIC)),
        "bubble": _Rule(numbers_at_least(BUBBLE_MIN_NUMERIC), x=number(0), y=number(1), group=colour,
                        variant=f"concat('size=', {number(2)})"),
        "violin": by_category,
        "radar": _Rule(f"{numbers_at_least(RADAR_MIN_FEATURES)} and {has_category}",
                       x=f"array_join({radar_features}, ', ')",
                       group=f"coalesce({first(within(CATEGORY_MAX_DISTINCT))}, {first_category})"),
        "treemap": _Rule(has_category, x=f"array_join({levels}, ' > ')",
                         y=f"coalesce({first('m_num')}, {number(0)})"),
    }


def chart_plan(typed: DataFrame, facts: TableFacts) -> DataFrame:
    """doc_id, section, plot_type, x, y, group_col, variant: the charts that can be drawn.

    ``typed`` is the result of ``chart_types``. Several columns in x are joined (radar features by a comma,
    treemap levels by '>'); the size of a bubble is in its variant.
    """
    mentioned = typed.where("plot_type is not null").withColumn("low", F.lower("description")).selectExpr(
        "doc_id", "section", "plot_type", "low", f"{_mentioned(facts.numbers)} as m_num",
        f"{_mentioned(facts.categories)} as m_cat", f"{_mentioned(facts.dates)} as m_date",
    )
    cases = " ".join(f"when '{t}' then {rule.struct()}" for t, rule in _rules(facts).items())
    # A generator drops the charts that cannot be drawn; a filter would be pushed down and decide twice.
    return mentioned.selectExpr(
        "doc_id", "section", "plot_type", f"inline(filter(array(case plot_type {cases} end), p -> p is not null))"
    )
