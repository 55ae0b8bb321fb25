"""The same results in plain SQL, for an independent engine. Keys are those of the queries."""

from __future__ import annotations

from workload.inputs import (
    CSV_SQL,
    DATES_SQL,
    DIRTY_COLUMNS,
    DIRTY_SQL,
    RECOMMENDATIONS_SQL,
    SALES_SQL,
    UNTIDY_SQL,
)

LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
LINEITEM_NUMBERS = [c for c, t in LINEITEM.items() if t in ("bigint", "int", "double")]
DIRTY_NUMBERS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"]
DIRTY_TEXTS = ["l_returnflag", "l_linestatus", "note"]


def union(parts: list[str]) -> str:
    return "\nunion all ".join(parts)


def title(text: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({text}), '[a-z]+|[^a-z]+'), "
            "lambda p: upper(p[1]) || p[2:]), '')")


# --- profile --------------------------------------------------------------------------------------


def describe(source: str, columns: list[str], places: int) -> str:
    def quantile(c: str, q: float) -> str:
        return f"round(quantile_cont(cast({c} as double), {q}), {places})"

    return union([
        f"select '{c}' as column_name, count({c}) as cnt, round(avg({c}), {places}) as mean, "
        f"round(stddev_samp({c}), {places}) as std, round(cast(min({c}) as double), {places}) as min, "
        f"{quantile(c, 0.25)} as q25, {quantile(c, 0.5)} as q50, {quantile(c, 0.75)} as q75, "
        f"round(cast(max({c}) as double), {places}) as max from {source}"
        for c in columns
    ])


def quantiles(source: str, columns: list[str], probs: tuple[float, ...]) -> str:
    return union([
        f"select '{c}' as column_name, cast({q} as double) as q, "
        f"round(quantile_cont(cast({c} as double), {q}), 6) as value from {source}"
        for c in columns for q in probs
    ])


def value_counts(source: str, columns: list[str]) -> str:
    return union([
        f"select '{c}' as column_name, {c} as value, count(*) as n from {source} where {c} is not null group by {c}"
        for c in columns
    ])


def top_values(source: str, columns: list[str], k: int) -> str:
    return f"""with counts as ({value_counts(source, columns)})
select column_name, value, n, cast(rnk as int) as rnk from (
  select *, row_number() over (partition by column_name order by n desc, value) as rnk from counts)
where rnk <= {k}"""


def missing(where: str = "") -> str:
    parts = union([
        f"select '{c}' as column_name, count(*) - count({c}) as n_missing from dirty" for c in DIRTY_COLUMNS
    ])
    return f"with {DIRTY_SQL} select * from ({parts}) {where}"


def correlation(source: str, columns: list[str], prefix: str = "") -> str:
    def pair(x: str, y: str) -> str:
        if x == y:
            return f"case when min({x}) < max({x}) then 1.0::double end"
        return f"case when isnan(corr({x}, {y})) then null else round(corr({x}, {y}), 6) end"

    return prefix + union([
        f"select '{x}' as col_x, '{y}' as col_y, {pair(x, y)} as r from {source}" for x in columns for y in columns
    ])


_COLUMN_INFO_TYPES = {**LINEITEM, "note": "string"}
_CATEGORICAL_TYPES = ("string",)


def role(dtype: str) -> str:
    if dtype in _CATEGORICAL_TYPES:
        return "categorical"
    return "datetime" if dtype.startswith("timestamp") else "numeric"


# --- cleaning -------------------------------------------------------------------------------------

_MODE = ("(select {c} from dirty where {c} is not null group by {c} order by count(*) desc, {c} limit 1)")

# imputed, without duplicates, then the bounds and text facts of that table
CLEAN_SQL = f"""with {DIRTY_SQL},
imputed as (select l_orderkey, l_partkey, l_linenumber,
  coalesce(l_quantity, (select median(l_quantity) from dirty)) as l_quantity, l_extendedprice,
  coalesce(l_returnflag, {_MODE.format(c='l_returnflag')}) as l_returnflag, l_linestatus,
  coalesce(note, 'Unknown') as note from dirty),
uniq as (select distinct * from imputed),
sizes as (select (select count(*) from dirty) as n_before, count(*) as n_after from uniq),
quartiles as ({union([
    f"select '{c}' as c, quantile_cont(cast({c} as double), 0.25) as q1, "
    f"quantile_cont(cast({c} as double), 0.75) as q3 from uniq" for c in DIRTY_NUMBERS])}),
bounds as (select c, q1 - 3 * (q3 - q1) as lo, q3 + 3 * (q3 - q1) as hi, q1, q3 from quartiles),
outliers as ({union([
    f"select '{c}' as c, count(*) as n from uniq, bounds b where b.c = '{c}' and ({c} < lo or {c} > hi)"
    for c in DIRTY_NUMBERS])}),
words as ({union([
    f"select '{c}' as c, {c} as v, count(*) as n from uniq group by {c}" for c in DIRTY_TEXTS])}),
texts as (select c, count(*) as n_unique, sum(case when length(v) <> length(trim(v)) then n else 0 end) as n_spaced,
  count(distinct trim(v)) as n_stripped, count(distinct {title('trim(v)')}) as n_titled from words group by c),
rules as (select c, n_spaced, n_stripped, n_titled, n_unique <= least(100, n_after // 10) as eligible,
  n_unique <= least(100, n_after // 10) and n_stripped < least(50, n_after // 20) as titled
  from texts, sizes)
"""


def _capped(c: str, dtype: str) -> str:
    lo, hi = (f"(select {end} from bounds where c = '{c}')" for end in ("lo", "hi"))
    value = f"case when {c} < {lo} then {lo} when {c} > {hi} then {hi} else {c} end"
    return f"round({value}, 6) as {c}" if dtype == "double" else f"cast({value} as {dtype}) as {c}"


def _tidied(c: str) -> str:
    return (f"case when (select titled from rules where c = '{c}') then {title(f'trim({c})')} "
            f"when (select eligible from rules where c = '{c}') then trim({c}) else {c} end as {c}")


CLEANED_SELECT = "select " + ", ".join(
    [_capped(c, {"l_orderkey": "bigint", "l_partkey": "bigint", "l_linenumber": "int"}.get(c, "double"))
     for c in DIRTY_NUMBERS] + [_tidied(c) for c in DIRTY_TEXTS]
) + " from uniq"


def _actions() -> str:
    parts = []

    def add(column: str, kind: str, n: str, description: str, why: str, source: str, order: int) -> None:
        parts.append(
            f"select {order} as o, '{column}' as column_name, '{kind}' as action_type, cast({n} as bigint) as n_affected, "
            f"{description} as description, '{why}' as justification from {source}"
        )

    order = 0
    for c in DIRTY_NUMBERS:
        order += 1
        add(c, "fill_missing", "n", "concat('Filled ', n, ' missing values with median')",
            "Median is robust to outliers",
            f"(select count(*) - count({c}) as n from dirty) where n > 0", order)
    for c in DIRTY_TEXTS:
        order += 1
        add(c, "fill_missing", "n", f"""concat('Filled ', n, ' missing values with mode: ''', {_MODE.format(c=c)}, '''')""",
            "Mode represents the most common value",
            f"(select count(*) - count({c}) as n, count({c}) as k from dirty) where n > 0 and k > 0", order)
        add(c, "fill_missing", "n", "concat('Filled ', n, ' missing values with ''Unknown''')",
            "No mode available, using standard placeholder",
            f"(select count(*) - count({c}) as n, count({c}) as k from dirty) where n > 0 and k = 0", order)
    order += 1
    add("all", "remove_duplicates", "n_before - n_after",
        "concat('Removed ', n_before - n_after, ' duplicate rows')",
        "Duplicate rows can skew analysis results", "sizes where n_after < n_before", order)
    for c in DIRTY_NUMBERS:
        order += 1
        add(c, "handle_outliers", "n",
            "concat('Capped ', n, ' outliers to 3×IQR boundaries', "
            "case when q1 < q3 then '' else ' (the quartiles are equal)' end)",
            "Extreme values can distort statistical analysis",
            f"outliers join bounds using (c) where c = '{c}' and n > 0", order)
    for c in DIRTY_TEXTS:
        order += 1
        add(c, "standardize_text", "n_spaced", "concat('Stripped whitespace from ', n_spaced, ' values')",
            "Remove inconsistent whitespace for better matching",
            f"rules where c = '{c}' and eligible and n_spaced > 0", order)
        order += 1
        add(c, "standardize_text", "n_stripped - n_titled",
            "concat('Standardized text case, reducing unique values from ', n_stripped, ' to ', n_titled)",
            "Consistent case improves grouping of similar values",
            f"rules where c = '{c}' and titled and n_titled < n_stripped", order)
    return union(parts)


_ISSUES = union(
    [f"select '{c}' as column_name, 'missing' as issue, count(*) - count({c}) as n from dirty"
     for c in DIRTY_COLUMNS]
    + ["select 'all', 'duplicate', n_before - n_after from sizes"]
    + ["select c, 'outlier', n from outliers"]
)


def _profile_rows(source: str, suffix: str) -> str:
    return union([
        f"select '{c}' as column_name, count(*) - count({c}) as n_missing_{suffix}, "
        f"count(distinct {c}) as n_unique_{suffix}, "
        + (", ".join(f"round(cast({f}({c}) as double), 4) as {a}_{suffix}" for f, a in
                     (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")))
           if c in DIRTY_NUMBERS else
           ", ".join(f"cast(null as double) as {a}_{suffix}" for a in ("mean", "std", "min", "max")))
        + f" from {source}"
        for c in DIRTY_COLUMNS
    ])


def bounds_of(source: str, columns: list[str]) -> str:
    return union([
        f"select '{c}' as column_name, quantile_cont(cast({c} as double), 0.25) as q1, "
        f"quantile_cont(cast({c} as double), 0.75) as q3 from {source}" for c in columns
    ])


def outlier_count(source: str, c: str) -> str:
    return (f"select '{c}' as column_name, count(*) filter (where {c} < q1 - 3 * (q3 - q1) or {c} > q3 + 3 * (q3 - q1)) "
            f"as n_outliers from {source}, ({bounds_of(source, [c])})")


def eligibility(columns: list[str], source: str) -> str:
    """Facts of each text column and the two rules."""
    words = union([f"select '{c}' as c, {c} as v from {source} where {c} is not null" for c in columns])
    return f"""facts as (select c as column_name, count(distinct v) as n_unique,
    count(distinct v) <= least(100, (select count(*) from {source}) // 10) as eligible,
    count(distinct v) <= least(100, (select count(*) from {source}) // 10)
      and count(distinct trim(v)) < least(50, (select count(*) from {source}) // 20) as title_case
  from ({words}) group by c)"""


def _tidy_from_facts(c: str, with_title: bool) -> str:
    titled = f"when (select title_case from facts where column_name = '{c}') then {title(f'trim({c})')} " if with_title else ""
    return f"case {titled}when (select eligible from facts where column_name = '{c}') then trim({c}) else {c} end as {c}"


_TITLE_ORDERS = """tidy_orders as (select o_orderkey,
  case when o_orderkey % 2 = 0 then concat(' ', o_orderpriority) else lower(o_orderpriority) end as o_orderpriority,
  lower(o_orderstatus) as o_orderstatus from orders)"""

# --- dates ----------------------------------------------------------------------------------------

_PARSED = "try_strptime({c}, '%m/%d/%Y')"


def sample_detect(columns: list[str]) -> str:
    parts = union([
        f"""select '{c}' as column_name, count(*) as n_sampled, count({_PARSED.format(c='v')}) as n_parsed,
  count({_PARSED.format(c='v')}) >= 3 as is_date
  from (select {c} as v from src where {c} is not null order by o_orderkey limit 5)""" for c in columns
    ])
    return f"""with {DATES_SQL}, src as (select * from dates join (select o_orderkey, o_orderstatus from orders)
  using (o_orderkey)) {parts}"""


def rate_detect(columns: list[str]) -> str:
    return f"with {DATES_SQL} " + union([
        f"select '{c}' as column_name, round(avg(case when {_PARSED.format(c=c)} is null then 0.0 else 1.0 end), 6) as rate, "
        f"avg(case when {_PARSED.format(c=c)} is null then 0.0 else 1.0 end) >= 0.8 as is_date from dates"
        for c in columns
    ])


# --- charts ---------------------------------------------------------------------------------------


def box(values: str, prefix: str) -> str:
    """``values`` gives group_value, y."""
    return f"""{prefix}v as (select * from ({values}) where group_value is not null and y is not null),
q as (select group_value, count(*) as n, quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.5) as median,
  quantile_cont(y, 0.75) as q3 from v group by group_value),
j as (select v.*, q.n, q.q1, q.median, q.q3, y between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
  from v join q using (group_value))
select group_value, n, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
  round(min(case when inside then y end), 6) as whisker_lo, round(max(case when inside then y end), 6) as whisker_hi,
  count(*) filter (where not inside) as n_outliers,
  round(median - 1.57 * (q3 - q1) / sqrt(n), 6) as notch_lo, round(median + 1.57 * (q3 - q1) / sqrt(n), 6) as notch_hi
from j group by group_value, n, q1, median, q3"""


_AREA = """daily as (select date_trunc('day', ts) as x, event_type as group_value, sum(value) as y
  from events group by 1, 2)"""

_TREEMAP = """with nodes as (
  select cast(2 - grouping(p_type) - grouping(p_brand) as int) as level, p_type as h1, p_brand as h2,
    sum(p_retailprice) as total, count(*) as n, sum(p_retailprice * p_retailprice) / sum(p_retailprice) as colour
  from part where p_type is not null and p_brand is not null group by rollup (p_type, p_brand))
select c.level, c.h1, c.h2, round(c.total, 4) as total, c.n, round(c.colour, 4) as colour,
  round(case when c.level = 0 then 1.0::double else c.total / p.total end, 4) as pct_parent,
  round(c.total / r.total, 4) as pct_root
from nodes c
left join nodes p on p.level = c.level - 1 and (c.level = 1 or p.h1 = c.h1)
join nodes r on r.level = 0"""

_VIOLIN = """with v as (select l_returnflag as group_value, l_extendedprice as y from lineitem
  where l_returnflag is not null and l_extendedprice is not null),
r as (select min(y) as lo, max(y) as hi from v),
bins as (select group_value, least(floor((y - lo) / ((hi - lo) / 100)) + 1, 100) as bin, count(*) as n
  from v, r group by 1, 2),
s as (select group_value, count(*) as total, 1.06 * stddev_samp(y) * pow(count(*), -0.2) as h from v group by 1),
g as (select k, lo + k * ((hi - lo) / 49) as grid from range(50) t(k), r)
select group_value, round(grid, 4) as grid, round(sum(n * exp(-0.5 * pow((grid - (lo + (bin - 0.5) * ((hi - lo) / 100))) / h, 2))
  / (total * h * sqrt(2 * pi()))), 10) as density
from bins join s using (group_value), g, r where h > 0 group by group_value, grid"""

_RADAR = """with top as (select p_brand from part group by p_brand order by count(*) desc, p_brand limit 6),
many as (select count(distinct p_brand) > 6 as more from part),
kept as (select * from part where (select not more from many) or p_brand in (select p_brand from top)),
""" + "long as (" + union([
    f"select p_brand as group_value, '{f}' as feature, cast({f} as double) as v from kept"
    for f in ("p_partkey", "p_size", "p_retailprice")
]) + """),
ranges as (select feature, min(v) as lo, max(v) as hi from long group by feature)
select group_value, feature, round(avg(v), 6) as mean,
  round(case when hi > lo then (avg(v) - lo) / (hi - lo) else 0 end, 6) as scaled
from long join ranges using (feature) where group_value is not null group by group_value, feature, lo, hi"""

# The standard charts of the events table. Its categories in order: event_type, props.
_MANIFEST = """with u as (select count(distinct event_type) as a, count(distinct props) as b from events),
pick as (select
  case when a between 2 and 10 then 'event_type' when b between 2 and 10 then 'props' end as pie,
  case when a between 2 and 6 then 'event_type' when b between 2 and 6 then 'props' end as colour,
  case when a between 2 and 5 then 'event_type' when b between 2 and 5 then 'props' end as grp, a from u),
entries as (
  select 1 as o, 'histogram' as plot_type, 'Distribution of event_id' as title, 'event_id' as x, null as y, null as group_col
  from pick union all
  select 2, 'bar', 'Top values for event_type', 'event_type', null, null from pick where a > 0 union all
  select 3, 'pie', concat('Composition of ', pie), pie, null, null from pick where pie is not null union all
  select 4, 'scatter', concat('Relationship between user_id and event_id', ' by ' || colour), 'event_id', 'user_id', colour
  from pick union all
  select 5, 'box', concat('Box Plot of event_id', ' by ' || colour), colour, 'event_id', null from pick union all
  select 6, 'line', concat('Trend of event_id over time', ' by ' || grp), 'ts', 'event_id', grp from pick union all
  select 7, 'heatmap', 'Correlation Heatmap', null, null, null from pick)
select cast(row_number() over (order by o) as int) as seq, plot_type, title, x, y, group_col from entries"""

# --- written recommendations ----------------------------------------------------------------------

_SECTIONS = f"""with {RECOMMENDATIONS_SQL},
pieces as (select doc_id, string_split(text, chr(10)) as parts from texts),
lines as (select doc_id, unnest(parts) as raw, generate_subscripts(parts, 1) as pos from pieces),
kept as (select doc_id, pos, trim(raw) as line from lines where trim(raw) <> ''),
marked as (select *, sum(case when regexp_matches(line, '^[1-9][.]') and length(line) > 3 then 1 else 0 end)
  over (partition by doc_id order by pos rows unbounded preceding) as section from kept),
sections as (select doc_id, cast(section as int) as section, string_agg(line, ' ' order by pos) as description
  from marked where section > 0 group by doc_id, section)"""

# Fixed value: words per chart, in match order.
_WORDS = (
    ("histogram", "histogram|distribution"),
    ("bar", "bar chart|bar graph|counts|frequency"),
    ("pie", "pie chart|composition|breakdown|proportion"),
    ("scatter", "scatter|relationship|correlation"),
    ("box", "box plot|boxplot|box-and-whisker"),
    ("line", "line chart|line graph|trend|time series"),
    ("area", "area chart|area graph|cumulative|stacked area"),
    ("heatmap", "heatmap|heat map|correlation matrix"),
    ("bubble", "bubble chart|bubble plot"),
    ("violin", "violin plot|violin"),
    ("radar", "radar chart|radar plot|spider chart|spider plot"),
    ("treemap", "treemap|tree map"),
)
_TYPED = _SECTIONS + """,
typed as (select *, case """ + " ".join(
    f"when regexp_matches(lower(description), '{w}') then '{t}'" for t, w in _WORDS
) + """ end as plot_type from sections where length(description) >= 10)"""

# Columns of the described table: role, position in the role, distinct values of a category.
_SALES_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")
_SALES_CATEGORIES = ("l_returnflag", "l_linestatus", "tax_bucket", "ship_text")
_COLUMNS = f""",
{SALES_SQL},
text_dates as (select 'ship_text' as name from sales having
  avg(case when try_strptime(ship_text, '%m/%d/%Y') is null then 0.0 else 1.0 end) >= 0.8),
cols as ({union(
    [f"select '{c}' as name, 'numeric' as role, {i} as pos, null::bigint as k" for i, c in enumerate(_SALES_NUMBERS)]
    + [f"select '{c}', 'categorical', {i}, count(distinct {c}) from sales" for i, c in enumerate(_SALES_CATEGORIES)]
    + ["select 'l_shipdate', 'datetime', 0, null", "select name, 'datetime', 1, null from text_dates"]
)}),
mentions as (select doc_id, section, name, role, pos, k from {{source}} cross join cols
  where contains(lower(description), lower(name)))"""

_PLAN = _TYPED + _COLUMNS.format(source="typed") + """,
m as (select doc_id, section,
  list(name order by pos) filter (where role = 'numeric') as nums,
  list(name order by pos) filter (where role = 'categorical') as cats,
  list(k order by pos) filter (where role = 'categorical') as ks,
  min_by(name, pos) filter (where role = 'datetime') as d,
  min_by(name, pos) filter (where role = 'categorical' and k <= 10) as cat10,
  list(name order by pos) filter (where role = 'categorical' and k <= 5) as cats5,
  list(name order by pos) filter (where role = 'categorical' and k <= 20) as cats20
  from mentions group by doc_id, section),
t as (select typed.doc_id, typed.section, description, plot_type, nums, cats, ks, d, cat10, cats20,
  coalesce(len(nums), 0) as n_nums, coalesce(d, cats[1], 'l_shipdate') as along,
  list_filter(coalesce(cats5, []), lambda c: c <> coalesce(d, cats[1], 'l_shipdate'))[1] as line_group
  from typed left join m using (doc_id, section) where plot_type is not null)
select doc_id, section, plot_type,
  case when plot_type in ('histogram', 'scatter') then nums[1] when plot_type = 'bar' then cats[1]
    when plot_type in ('pie', 'box', 'violin') then cat10 when plot_type in ('line', 'area') then along
    when plot_type = 'bubble' then 'l_quantity'
    when plot_type = 'radar' then case when n_nums >= 3 then array_to_string(nums[1:5], ', ')
      else 'l_quantity, l_extendedprice, l_discount' end
    when plot_type = 'treemap' then coalesce(array_to_string(cats20, ' > '), 'l_returnflag > l_linestatus') end as x,
  case when plot_type = 'scatter' then nums[2] when plot_type in ('box', 'violin', 'line', 'area') then nums[1]
    when plot_type = 'bubble' then 'l_extendedprice'
    when plot_type = 'treemap' then coalesce(nums[1], 'l_quantity') end as y,
  case when plot_type = 'bar' then case when ks[1] <= 10 and ks[2] <= 5 then cats[2] end
    when plot_type in ('scatter', 'bubble') then cat10 when plot_type in ('line', 'area') then line_group
    when plot_type = 'radar' then coalesce(cat10, 'l_returnflag') end as group_col,
  case when plot_type = 'area' then case when line_group is null then 'simple'
      when contains(lower(description), 'stack') then 'stacked' else 'share' end
    when plot_type = 'bubble' then 'size=l_discount' end as variant
from t where case when plot_type = 'histogram' then nums[1] is not null when plot_type = 'bar' then cats[1] is not null
  when plot_type = 'pie' then cat10 is not null when plot_type = 'scatter' then nums[2] is not null
  when plot_type in ('box', 'violin', 'line', 'area') then nums[1] is not null else true end"""


# --- all of them ----------------------------------------------------------------------------------

ORACLES: dict[str, str] = {
    "q_csv_ingest": CSV_SQL,
    "q_normalize_missing": """select l_orderkey, l_linenumber,
  case when l_orderkey % 5 = 0 then null else l_quantity end as l_quantity,
  case when l_orderkey % 7 in (0, 1, 2) then null else l_returnflag end as l_returnflag,
  case when l_orderkey % 3 = 0 then null else l_linestatus end as l_linestatus from lineitem""",
    "q_preview": "select * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey limit 5",
    "q_column_roles": union([
        f"select {i}::int as position, '{c}' as column_name, '{t}' as dtype, '{role(t)}' as role, "
        f"count({c}) as non_null from lineitem" for i, (c, t) in enumerate(LINEITEM.items())
    ]),
    "q_date_sample_detect": sample_detect(["often", "seldom", "o_orderstatus"]),
    "q_date_rate_detect": rate_detect(["often", "seldom"]),
    "q_date_materialize": f"with {DATES_SQL} select *, {_PARSED.format(c='often')} as often_date from dates",
    "q_convert_types": f"""with {DATES_SQL} select o_orderkey, {_PARSED.format(c='often')} as often, seldom,
  case when o_orderkey % 9 = 0 then null else o_orderkey / 4 end as mostly_number from dates""",
    "q_row_index": "select event_id as key, value as y, row_number() over (order by event_id) - 1 as row_index from events",
    "q_topk_member_filter": """select * from part where p_brand in (
  select p_brand from part group by p_brand order by count(*) desc, p_brand limit 6)""",
    "q_dropna_key": f"with {DATES_SQL} select * from dates where often is not null",
    "q_shape": f"select count(*) as n_rows, {len(LINEITEM)}::int as n_cols from lineitem",
    "q_describe": describe("lineitem", LINEITEM_NUMBERS, 4),
    "q_describe_missing": f"with {DIRTY_SQL} {describe('dirty', DIRTY_NUMBERS, 4)}",
    "q_short_stats": union([
        f"select '{c}' as column_name, round(min({c})::double, 2) as min, round(max({c})::double, 2) as max, "
        f"round(avg({c}), 2) as mean, round(stddev_samp({c}), 2) as std from lineitem" for c in LINEITEM_NUMBERS[:3]
    ]),
    "q_topk_values": top_values("part", ["p_name", "p_brand", "p_type"], 5),
    "q_value_counts": value_counts("part", ["p_name", "p_brand", "p_type"]),
    "q_bar_top10": top_values("part", ["p_brand"], 10),
    "q_missing_counts": missing(),
    "q_missing_positive": missing("where n_missing > 0"),
    "q_column_info": f"with {DIRTY_SQL} " + union([
        f"select '{c}' as column_name, '{_COLUMN_INFO_TYPES[c]}' as dtype, count({c}) as non_null, "
        f"count(*) - count({c}) as n_null, count(distinct {c}) as n_unique from dirty" for c in DIRTY_COLUMNS
    ]),
    "q_nunique": union([
        f"select '{c}' as column_name, count(distinct {c}) as n_unique from customer"
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    ]),
    "q_mode": union([
        f"select '{c}' as column_name, (select {c} from orders where {c} is not null group by {c} "
        f"order by count(*) desc, {c} limit 1) as mode_value" for c in ("o_orderstatus", "o_orderpriority")
    ]),
    "q_quantiles": quantiles("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"], (0.25, 0.5, 0.75)),
    "q_group_means": f"""with {DIRTY_SQL} select l_returnflag as group_value, round(avg(l_quantity), 4) as l_quantity,
  round(avg(l_extendedprice), 4) as l_extendedprice from dirty where l_returnflag is not null group by l_returnflag""",
    "q_correlation": correlation("lineitem", LINEITEM_NUMBERS),
    "q_correlation_constant": correlation(
        "(select *, 3.5::double as same from dirty)", ["l_quantity", "l_extendedprice", "l_linenumber", "same"],
        f"with {DIRTY_SQL} "),
    "q_impute_median": f"""with {DIRTY_SQL} select l_orderkey, l_linenumber,
  coalesce(l_quantity, (select median(l_quantity) from dirty)) as l_quantity from dirty""",
    "q_impute_mode": f"""with {DIRTY_SQL} select l_orderkey, l_linenumber,
  coalesce(l_returnflag, {_MODE.format(c='l_returnflag')}) as l_returnflag from dirty""",
    "q_impute_unknown": f"with {DIRTY_SQL} select l_orderkey, l_linenumber, coalesce(note, 'Unknown') as note from dirty",
    "q_dedupe": f"with {DIRTY_SQL} select distinct * from dirty",
    "q_dedupe_documents": "select distinct text, lang, source, n_chars from documents",
    "q_outlier_bounds": f"""select column_name, round(q1, 6) as q1, round(q3, 6) as q3,
  round(q1 - 3 * (q3 - q1), 6) as lower_bound, round(q3 + 3 * (q3 - q1), 6) as upper_bound
  from ({bounds_of('events', ['event_id', 'user_id', 'value'])})""",
    "q_outlier_counts": union([outlier_count("events", c) for c in ("event_id", "user_id", "value")]
                              + [outlier_count("documents", "n_chars")]),
    "q_cap_outliers": f"""with b as ({bounds_of('events', ['value'])}),
e as (select q1 - 3 * (q3 - q1) as lo, q3 + 3 * (q3 - q1) as hi from b)
select event_id, user_id, event_type,
  round(case when value < lo then lo when value > hi then hi else value end, 6) as value from events, e""",
    "q_text_eligibility": f"""with {UNTIDY_SQL}, {eligibility(['p_name', 'p_type', 'p_brand'], 'untidy')}
select * from facts""",
    "q_strip_text": f"""with {UNTIDY_SQL}, {eligibility(['p_name', 'p_type', 'p_brand'], 'untidy')}
select p_partkey, {', '.join(_tidy_from_facts(c, False) for c in ('p_name', 'p_type', 'p_brand'))} from untidy""",
    "q_title_case": f"""with {_TITLE_ORDERS}, {eligibility(['o_orderpriority', 'o_orderstatus'], 'tidy_orders')}
select o_orderkey, {', '.join(_tidy_from_facts(c, True) for c in ('o_orderpriority', 'o_orderstatus'))} from tidy_orders""",
    "q_cleaning_actions": f"""{CLEAN_SQL}, log as ({_actions()})
select cast(row_number() over (order by o) as int) as seq, column_name, action_type, n_affected, description, justification
from log""",
    "q_cleaning_issues": f"{CLEAN_SQL} select * from ({_ISSUES}) where n > 0",
    "q_cleaning_report": f"""{CLEAN_SQL} select n_before as rows_before, {len(DIRTY_COLUMNS)}::int as columns_before,
  n_after as rows_after, {len(DIRTY_COLUMNS)}::int as columns_after,
  (select count(*)::int from ({_actions()})) as n_actions,
  (select count(*)::int from ({_ISSUES}) where n > 0) as n_issues from sizes""",
    "q_clean_table": f"{CLEAN_SQL} {CLEANED_SELECT}",
    "q_before_after": f"""{CLEAN_SQL}, cleaned as ({CLEANED_SELECT}),
b as ({_profile_rows('dirty', 'before')}), a as ({_profile_rows('cleaned', 'after')})
select * from b join a using (column_name)""",
    "q_histogram": """with r as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
c as (select cast(least(floor((l_extendedprice - lo) / ((hi - lo) / 30)) + 1, 30) as int) as bin, count(*) as n
  from lineitem, r group by 1)
select 'l_extendedprice' as column_name, bin, round(r.lo + (bin - 1) * ((r.hi - r.lo) / 30), 6) as lo,
  round(r.lo + bin * ((r.hi - r.lo) / 30), 6) as hi, n from c, r""",
    "q_crosstab": f"""with {DIRTY_SQL} select l_linestatus as value,
  count(*) filter (where l_returnflag = 'A') as "A", count(*) filter (where l_returnflag = 'N') as "N",
  count(*) filter (where l_returnflag = 'R') as "R" from dirty
  where l_linestatus is not null and l_returnflag is not null group by 1""",
    "q_composition": """with c as (select p_type as value, count(*) as n from part where p_type is not null group by 1)
select value, n, round(n / sum(n) over (), 6) as pct from c""",
    "q_composition_other": f"""with {SALES_SQL},
c as (select tax_bucket as value, count(*) as n from sales group by 1),
k as (select *, row_number() over (order by n desc, value) as rnk, count(*) over () as m from c),
f as (select case when m <= 8 or rnk <= 7 then value else 'Other' end as value, sum(n)::bigint as n from k group by 1)
select value, n, round(n / sum(n) over (), 6) as pct from f""",
    "q_composition_plain": f"""with {SALES_SQL}, c as (select tax_bucket as value, count(*) as n from sales group by 1)
select value, n, round(n / sum(n) over (), 6) as pct from c""",
    "q_scatter_points": f"""with {DIRTY_SQL} select l_quantity as x, l_extendedprice as y, l_returnflag as colour
from dirty where l_quantity is not null and l_extendedprice is not null""",
    "q_scatter_density": f"""with {DIRTY_SQL},
v as (select l_quantity as x, l_extendedprice as y from dirty where l_quantity is not null and l_extendedprice is not null),
r as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from v)
select cast(least(floor((x - x0) / ((x1 - x0) / 40)) + 1, 40) as int) as xbin,
  cast(least(floor((y - y0) / ((y1 - y0) / 40)) + 1, 40) as int) as ybin, count(*) as n from v, r group by 1, 2""",
    "q_scatter_refline": """select min(l_quantity) as x0, min(l_extendedprice) as y0, max(l_quantity) as x1,
  max(l_extendedprice) as y1 from lineitem""",
    "q_box_stats": box("select l_returnflag as group_value, l_extendedprice as y from dirty", f"with {DIRTY_SQL}, "),
    "q_box_stats_ungrouped": box("select 'all' as group_value, value as y from events", "with "),
    "q_line_series": "select ts as x, event_type as group_value, value as y from events",
    "q_line_bucketed": """select date_trunc('day', ts)::timestamp as bucket, event_type as group_value, count(value) as n,
  round(avg(value), 6) as avg_y, round(min(value), 6) as min_y, round(max(value), 6) as max_y from events group by 1, 2""",
    "q_area": """select date_trunc('day', ts)::timestamp as x, 'all' as group_value, round(sum(value), 4) as y
from events group by 1""",
    "q_area_stacked": f"""with {_AREA} select x::timestamp as x, group_value, round(y, 4) as y,
  round(sum(y) over (partition by x order by group_value rows unbounded preceding), 4) as y_top from daily""",
    "q_area_share": f"""with {_AREA} select x::timestamp as x, group_value, round(y, 4) as y,
  round(y / sum(y) over (partition by x), 4) as share from daily""",
    "q_bubble_points": """select event_id::double as x, user_id::double as y, event_type as colour,
  round(value / (select max(value) from events), 6) as size from events""",
    "q_violin_density": _VIOLIN,
    "q_radar": _RADAR,
    "q_treemap": _TREEMAP,
    "q_standard_manifest": _MANIFEST,
    "q_numbered_sections": _SECTIONS + " select * from sections",
    "q_chart_type": _TYPED + " select * from typed",
    "q_column_mentions": _SECTIONS + _COLUMNS.format(source="sections") + """
select doc_id, section, name as column_name, role,
  cast(row_number() over (partition by doc_id, section, role order by pos) as int) as rnk from mentions""",
    "q_chart_plan": _PLAN,
}
ORACLES["q_quantiles_searched"] = ORACLES["q_quantiles"]
ORACLES["q_clean_table_searched"] = ORACLES["q_clean_table"]
ORACLES["q_box_stats_searched"] = ORACLES["q_box_stats"]
ORACLES["q_odd_names"] = ORACLES["q_crosstab"]
ORACLES["q_csv_long_ids"] = "select o_orderkey + 1790000000000000000 as id, o_orderpriority from orders"
ORACLES["q_csv_multiline"] = """select o_orderkey as id, o_orderstatus || chr(10) || '"' || o_orderpriority || '"' as note
from orders"""
ORACLES["q_quantiles_hot_key"] = """with k as (select case when l_orderkey % 3 = 0 then 1152921504606847677
  else l_orderkey * 1000003 + 1152921504606846976 end as key from lineitem),
p as (select unnest([0.1, 0.5, 0.9]::double[]) as q),
v as (select q, case q when 0.1 then (select quantile_cont(key::double, 0.1) from k)
  when 0.5 then (select quantile_cont(key::double, 0.5) from k)
  else (select quantile_cont(key::double, 0.9) from k) end as value from p)
select q, round(value / 1e5) as value, (select count(*) from k where key::double < value) as n_below,
  (select count(*) from k where key::double <= value) as n_up_to from v"""
ORACLES["q_csv_stray_quotes"] = """select o_orderkey as id, (o_orderkey % 40) || '" pipe' as size,
  case when o_orderkey % 3 = 0 then o_orderpriority || ' 5" x 3"' else o_orderstatus end as note from orders"""
ORACLES["q_topk_unique_text"] = """with n as (select case when l_orderkey % 5 = 0 then 'standard ' || l_linenumber
  else 'note ' || l_orderkey || '-' || l_linenumber || '-' || l_partkey end as value, count(*) as n from lineitem group by 1)
select 'note' as column_name, value, n, cast(row_number() over (order by n desc, value) as int) as rnk from n
  qualify rnk <= 4"""
ORACLES["q_correlation_missing"] = correlation("dirty", DIRTY_NUMBERS, f"with {DIRTY_SQL} ")
ORACLES["q_bubble_bins"] = """with r as (select min(l_quantity) as x0, max(l_quantity) as x1, min(l_tax) as y0,
  max(l_tax) as y1, max(l_extendedprice) as most from lineitem)
select cast(least(floor((l_quantity - x0) / ((x1 - x0) / 40)) + 1, 40) as int) as xbin,
  cast(least(floor((l_tax - y0) / ((y1 - y0) / 40)) + 1, 40) as int) as ybin, l_returnflag as colour, count(*) as n,
  round(avg(l_extendedprice) / any_value(most), 6) as size from lineitem, r group by 1, 2, 3"""
ORACLES["q_date_formats"] = """select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as iso_zone,
  strftime(o_orderdate, '%-m/%-d/%Y %-I:%M %p') as us_time, strftime(o_orderdate, '%-m/%-d/%y') as short_year,
  strftime(o_orderdate, '%Y%m%d') as compact, upper(strftime(o_orderdate, '%B %-d, %Y')) as name,
  strftime(o_orderdate, '%-d.%-m.%Y') as dotted,
  date_trunc('second', o_orderdate::timestamp) as iso_zone_date, date_trunc('minute', o_orderdate::timestamp) as us_time_date,
  date_trunc('day', o_orderdate)::timestamp as short_year_date, date_trunc('day', o_orderdate)::timestamp as compact_date,
  date_trunc('day', o_orderdate)::timestamp as name_date, date_trunc('day', o_orderdate)::timestamp as dotted_date
from orders"""
ORACLES["q_before_after_texts"] = "with before as (select text, lang, source from documents), " + f"""
after as (select distinct * from before), sides as ({union([
    f"select '{c}' as column_name, '{side}' as side, count(*) - count({c}) as n_missing, count(distinct {c}) as n_unique "
    f"from {side}" for c in ("text", "lang", "source") for side in ("before", "after")])})
select b.column_name, b.n_missing as n_missing_before, a.n_missing as n_missing_after,
  b.n_unique as n_unique_before, a.n_unique as n_unique_after, {", ".join(
    f"null::double as {c}_{side}" for c in ("mean", "std", "min", "max") for side in ("before", "after"))}
from sides b join sides a using (column_name) where b.side = 'before' and a.side = 'after'"""


def _transformed(c: str, dtype: str) -> str:
    """A value of an odd order moved into the bounds of the even ones; whole numbers to whole numbers."""
    lo, hi = (f"(select {end} from bounds where c = '{c}')" for end in ("lo", "hi"))
    if dtype != "double":
        return f"cast(greatest(ceil({lo}), least(floor({hi}), {c})) as {dtype}) as {c}"
    return f"round(greatest({lo}, least({hi}, {c})), 6) as {c}"


_MODEL_COLUMNS = {"l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double"}
_FILLED = ", ".join("coalesce(l_quantity, (select median(l_quantity) from even)) as l_quantity" if c == "l_quantity" else c
                    for c in _MODEL_COLUMNS)
ORACLES["q_model_transform"] = f"""with {DIRTY_SQL}, even as (select * from dirty where l_orderkey % 2 = 0),
fitted as (select distinct {_FILLED} from even),
bounds as (select c, q1 - 3 * (q3 - q1) as lo, q3 + 3 * (q3 - q1) as hi from ({union([
    f"select '{c}' as c, quantile_cont(cast({c} as double), 0.25) as q1, quantile_cont(cast({c} as double), 0.75) as q3 "
    f"from fitted" for c in _MODEL_COLUMNS])})),
rest as (select distinct {_FILLED} from dirty where l_orderkey % 2 = 1)
select {", ".join(_transformed(c, t) for c, t in _MODEL_COLUMNS.items())} from rest"""


def _bins(source: str, c: str, seq: int) -> str:
    return f"""select {seq} as seq, 'histogram' as plot_type, bin::varchar as key, count(*)::double as value
from (select cast(least(floor(({c} - lo) / ((hi - lo) / 30)) + 1, 30) as int) as bin from {source},
  (select min({c})::double as lo, max({c})::double as hi from {source})) group by bin"""


ORACLES["q_standard_charts"] = f"""{_bins('events', 'event_id', 1)}
union all select 2, 'bar', event_type, count(*)::double from events group by event_type
union all select 3, 'pie', event_type, round(count(*) / sum(count(*)) over (), 4) from events group by event_type
union all select 4, 'scatter', event_id || '|' || event_type, user_id::double from events
union all select 5, 'box', event_type, round(quantile_cont(event_id::double, 0.5), 4) from events group by event_type
union all select 6, 'line', strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || event_type, event_id::double from events
union all select 7, 'heatmap', col_x || '|' || col_y, round(r, 4)
  from ({correlation('events', ['event_id', 'user_id', 'value'])})"""
ORACLES["q_recommended_charts"] = f"""with {SALES_SQL}, k as (select tax_bucket as value, count(*) as n,
  row_number() over (order by count(*) desc, tax_bucket) as rnk, count(*) over () as m from sales group by 1)
{_bins('sales', 'l_extendedprice', 1)}
union all select 2, 'pie', case when m <= 8 or rnk <= 7 then value else 'Other' end,
  round(sum(n) / (select count(*) from sales), 4) from k group by 3
union all select 3, 'box', l_returnflag, round(quantile_cont(l_quantity, 0.5), 4) from sales group by l_returnflag"""


def _m4(points: str, pixels: int, at: str) -> str:
    """The four points of each pixel column, by sorting."""
    ends = {"first": "x, y", "last": "x desc, y desc", "low": "y, x", "high": "y desc, x"}
    ranks = ", ".join(f"row_number() over (partition by group_value, pixel order by {o}) as {e}" for e, o in ends.items())
    picked = ", ".join(f"max({c}) filter ({e} = 1) as {e}_{c}" for e in ends for c in ("x", "y"))
    return f"""with p as ({points}), a as (select *, {at}::double as place from p where x is not null and y is not null),
r as (select min(place) as lo, max(place) as hi from a),
b as (select *, cast(least(floor((place - lo) / (hi - lo) * {pixels}), {pixels - 1}) as int) as pixel from a, r),
k as (select *, {ranks} from b)
select group_value, pixel, count(*) as n, {picked} from k group by group_value, pixel"""


ORACLES["q_line_m4"] = _m4("select ts as x, event_type as group_value, value as y from events", 200, "epoch_us(x)")
ORACLES["q_line_m4_positions"] = _m4("""select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_extendedprice) - 1 as x, 'all' as group_value, l_extendedprice as y from lineitem""", 300, "x")


def _quadtree(source: str, levels: int) -> str:
    z = " + ".join(f"(((xbin >> {i}) & 1) << {2 * i}) + (((ybin >> {i}) & 1) << {2 * i + 1})" for i in range(levels))
    cells = 2 ** levels
    return f"""v as ({source}), r as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from v),
c as (select cast(least(floor((x - x0) / ((x1 - x0) / {cells})), {cells - 1}) as bigint) as fx,
  cast(least(floor((y - y0) / ((y1 - y0) / {cells})), {cells - 1}) as bigint) as fy, s from v, r),
l as (select cast(level as int) as level, fx >> ({levels} - level) as xbin, fy >> ({levels} - level) as ybin, s
  from c, range(0, {levels + 1}) t(level)),
tree as (select level, {z} as z, cast(xbin as int) as xbin, cast(ybin as int) as ybin, count(*) as n,
  round(avg(s), 6) as mean_size from l group by level, xbin, ybin)"""


ORACLES["q_scatter_quadtree"] = f"with {DIRTY_SQL}, " + _quadtree(
    "select l_quantity as x, l_extendedprice as y, l_partkey::double as s from dirty "
    "where l_quantity is not null and l_extendedprice is not null", 7) + " select * from tree"
ORACLES["q_scatter_quadtree_view"] = "with " + _quadtree(
    "select l_partkey::double as x, l_extendedprice as y, 0 as s from lineitem", 8) + """
select level, z, xbin, ybin, n from tree where level = 7 and xbin >> 5 = 1 and ybin >> 5 = 2"""
