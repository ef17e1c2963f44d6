"""Cleaning against its plain-Python meaning on arbitrary text."""

import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from riskloom.functions import clean

TEXT = st.text(
    alphabet=st.one_of(st.sampled_from(list("NAna/ \t\n\r\u00a0\u3000Q123405.-")), st.characters(codec="utf-8")),
    max_size=8,
).filter(lambda t: "\x00" not in t)
BATCHES = st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=60)
quick = settings(
    max_examples=8, deadline=None, database=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)


def run(spark, values, *exprs):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    rows = df.orderBy("i").select(*[e(F.col("v")).alias(f"c{n}") for n, e in enumerate(exprs)]).collect()
    return [tuple(r) for r in rows]


def meant(value):
    if value is None:
        return (None, None, None, None)
    stripped = value.strip()
    blank = None if stripped == "" else value
    any_case = None if stripped.upper() in ("", "NA", "N/A") else value
    cased = None if stripped in ("", "NA", "N/A") else value
    return (blank, any_case, cased, stripped)


@quick
@given(BATCHES)
def test_blank_and_na(spark, values):
    got = run(
        spark, values, clean.clean_blank, clean.clean_na, lambda c: clean.clean_na(c, ignore_case=False), clean.strip
    )
    assert got == [meant(v) for v in values]


@quick
@given(st.lists(st.from_regex(r"\A\s{0,2}Q[0-9]\s{0,2}[0-9]{3,4}.{0,3}\Z"), min_size=1, max_size=40))
def test_quarters(spark, values):
    def expected(value):
        match = re.match(r"Q([1-4])[ \t\n\x0b\x0c\r]+([0-9]{4})", value.strip())
        if not match or int(match[2]) == 0:
            return None
        month, day = {"1": (3, 31), "2": (6, 30), "3": (9, 30), "4": (12, 31)}[match[1]]
        return f"{match[2]}-{month:02d}-{day}"

    got = [r[0] for r in run(spark, values, lambda c: clean.quarter_end(c).cast("string"))]
    assert [g for g, v in zip(got, values) if v.isascii() and "Q" in v and not re.search("0000", v)] == [
        expected(v) for v in values if v.isascii() and "Q" in v and not re.search("0000", v)
    ]
