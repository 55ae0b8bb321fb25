"""The one grammar of dates against the formats one by one."""

import random

from pyspark.sql import functions as F

from tablewise.functions.dates import DATE_FORMATS, parse_date, with_date_mask
from tablewise.operators.dates import category_facts

TIMES = [""] * 8 + [" 10:20", "T1:02:03", " 25:00", " 1:02 PM", " 13:02 PM", "T10:20:30.123456Z", " 10:20+05:30", " 0:10 am",
                    " 12:10 am", " 10:20+25:00", " 10:20:61", " 9:5", "T"]
NAMES = ["Jan", "january", "FEB", "Sept.", "sep", "Dec.", "foo", "June", "Juni", "May"]


def values():
    rng = random.Random(1)

    def number():
        return rng.choice([str(rng.randint(0, 32)), f"{rng.randint(0, 13):02d}", str(rng.randint(1800, 2100)),
                           f"{rng.randint(0, 99):02d}", str(rng.randint(0, 99999))])

    out = [None, "", "2020-01-02\n", "2020-01-02 ", " 2020-01-02", "abc", "12345678", "20201301", "20200230", "20200229",
           "19991231", "29/2/1900", "29/2/2000", "2/29/00", "0000-02-29", "١٢/٣/٢٠٢٠", "x" * 50, "1/2/2020" + " " * 40]
    for _ in range(12_000):
        mark = rng.choice("-/.")
        out.append(number() + mark + number() + (mark if rng.random() < .95 else "/") + number() + rng.choice(TIMES))
    for _ in range(3_000):
        gap = rng.choice([" ", "-"])
        out.append(rng.choice([f"{rng.choice(NAMES)} {number()}{rng.choice([',', ''])} {number()}",
                               f"{number()}{gap}{rng.choice(NAMES)}{rng.choice([gap, ' '])}{number()}"]))
    return out + [str(rng.randint(18_000_000, 21_000_000)) for _ in range(1_000)]


def test_one_grammar_reads_what_the_formats_read(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values())], "i int, v string")
    masks = {r["i"]: r["mask"] for r in with_date_mask(df, "v", ["i"]).collect()}
    seen = 0
    for k, fmt in enumerate(DATE_FORMATS):
        read = {r["i"] for r in df.where(parse_date(F.col("v"), fmt).isNotNull()).select("i").collect()}
        seen |= (1 << k) * bool(read)
        assert read == {i for i, m in masks.items() if m >> k & 1}, fmt.name
    assert seen == (1 << len(DATE_FORMATS)) - 1


def test_few_and_many_values_agree(spark):
    rows = [(f"{i % 12 + 1}/{i % 28 + 1}/20{i % 30:02d}", None if i % 5 == 0 else f"{i % 28 + 1}.{i % 12 + 1}.2001", f"t{i}")
            for i in range(3000)]
    df = spark.createDataFrame(rows, "`a b` string, `_v` string, `i` string")
    many = category_facts(df)
    assert {c: (f.name, r) for c, (f, r) in many.formats.items() if r} == {"a b": ("M/d/yyyy", 1.0), "_v": ("d.M.yyyy", 0.8)}
    few = category_facts(df.limit(40))
    assert {c: f.name for c, (f, r) in few.formats.items() if r} == {"a b": "M/d/yyyy", "_v": "d.M.yyyy"}


def test_one_expression_for_all_columns(spark):
    """The plan holds the grammar once, however many columns there are."""
    def patterns(columns: int) -> int:
        wide = spark.range(10).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(columns)])
        long = wide.select(F.posexplode(F.array(*wide.columns)).alias("i", "value"))
        plan = with_date_mask(long, "value", ["i"])._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("?i:jan")

    assert patterns(40) == patterns(1) <= 4
