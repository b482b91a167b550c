"""The guard of ad-hoc statements: what Spark brings itself runs, what was registered doesn't, whatever its name."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from gradeloom.operators import adhoc

GOOD = [
    "SELECT a FROM t -- a note", "SELECT a FROM t;", "VALUES (1), (2)", "SELECT * FROM range(3)", "SELECT * FROM explode(array(1, 2))", "SELECT a, e FROM t LATERAL VIEW explode(c) x AS e", "SELECT inline(array(struct(1 AS p, 2 AS q)))",
    "SELECT b, count(*) n, max(a) FILTER (WHERE a > 1) m FROM t GROUP BY ROLLUP(b) HAVING count(*) > 0 ORDER BY 1 LIMIT 3", "SELECT a, sum(a) OVER (PARTITION BY b ORDER BY a ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) s, lag(a) OVER (ORDER BY a) FROM t",
    "SELECT transform(c, x -> x + 1) FROM t WHERE a IN (SELECT a FROM t) AND EXISTS (SELECT 1 FROM t u WHERE u.a = t.a)", "WITH q AS (SELECT a FROM t) SELECT * FROM q UNION ALL SELECT a FROM t",
    "SELECT a::string, b LIKE 'x%', nvl(b, 'z'), left(b, 1), CASE WHEN a = 1 THEN 'o' END, now() - interval 1 day, date_add(current_date(), a), lpad(b, 3, 'x'), ceil(1.25, 1), ceil(a), date_part('year', now()), to_json(struct(a)) FROM t",
    "SELECT percentile_approx(a, 0.5), mode(a), listagg(b), try_sum(a), count_if(a > 1), max_by(a, b), bool_or(a > 1), median(a), stddev(a), collect_list(b), regexp_replace(max(b), 'x', 'y') FROM t", "SELECT * FROM t PIVOT (sum(a) FOR b IN ('x', 'y'))", "SELECT * FROM t UNPIVOT (v FOR k IN (a))",
]


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([(1, "x", [1, 2]), (2, "y", [3])], "a int, b string, c array<int>")


@pytest.mark.parametrize("sql", GOOD)
def test_built_in_expressions_run(spark, t, sql):
    assert adhoc.guarded(spark, sql, {"t": t}).count() >= 1


class Folder:
    def eval(self):
        import os

        yield (os.getcwd(),)


@pytest.fixture(scope="module")
def other(spark):
    """A session of its own, in which functions are registered."""
    session = spark.newSession()
    session.udf.register("py_scalar", lambda x: x, "int")
    session.udf.register("upper", F.pandas_udf(lambda s: s, "string"))  # under a built-in function's name

    def total(s: pd.Series) -> int:
        return int(s.sum())

    session.udf.register("py_total", F.pandas_udf(total, IntegerType()))
    session.udtf.register("py_rows", F.udtf(Folder, returnType="folder string"))
    return session


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT py_scalar(a) FROM t", "SELECT upper(b) FROM t", "SELECT py_total(a) FROM t", "SELECT py_total(a) OVER (PARTITION BY b) FROM t", "SELECT * FROM py_rows()", "SELECT a FROM t, LATERAL py_rows()", "SELECT a FROM t WHERE a IN (SELECT py_scalar(a) FROM t)",
        "SELECT transform(c, x -> py_scalar(x)) FROM t", "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT try_reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT input_file_name() FROM t", "SELECT current_user()",
        "SELECT nvl(py_scalar(a), 1) FROM t", "SELECT left(upper(b), 1) FROM t", "SELECT a FROM t ORDER BY py_scalar(a)", "SELECT count(*) FROM t GROUP BY py_scalar(a)", "SELECT 1; DROP TABLE t", "SELECT ((a FROM t",
    ],
)
def test_registered_and_reflecting_functions_dont_run(other, sql):
    with pytest.raises(adhoc.Refused) as refused:
        adhoc.guarded(other, sql, {"t": other.createDataFrame([(1, "x", [1, 2])], "a int, b string, c array<int>")})
    assert str(refused.value).strip() not in ("", "not a statement:")
