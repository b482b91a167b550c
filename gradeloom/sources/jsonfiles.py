"""Nested JSON files: page dumps and graded tasks, read with explicit schemas and written in one form.

A file that doesn't fit its schema is a row with a reason. Written files are UTF-8, indented by one space and end with
a line feed; reading and writing a file of that form gives the same bytes."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names and shapes of the fields of a page dump and of a graded task. Numbers in mixed lists are read as text.
PAGE = (
    "numer int, szerokosc double, wysokosc double, znaki array<array<string>>, kreski array<array<double>>, kreski_kandydujace array<array<double>>, "
    "tabele array<struct<bbox:array<double>,wiersze:array<array<string>>>>, ksztalty array<array<string>>"
)
GRADED = (
    "exam_form string, session string, year int, task string, max_points int, content_source string, task_text string, "
    "answers array<struct<kind:string,text:string,intent:string,author:string,grading:struct<grader:string,points:int,criteria:array<struct<points:int,met:boolean,quote:string,note:string>>,justification:string>>>"
)


def read(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """path, reason and the schema's fields: a row for each file; reason says why a file has none."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("_text"))
    return parse(files, "_text", schema)


def parse(files: DataFrame, text: str, schema: str) -> DataFrame:
    """Texts as the schema's fields with reason: "no JSON", or "other shape" for a field of another type or a required field that lacks."""
    whole = F.from_json(F.col(text), f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    parsed = files.withColumn("_r", whole)
    any_json = F.try_parse_json(F.col(text))
    first = schema.split()[0]
    reason = F.when(F.col(text).isNull() | any_json.isNull(), "no JSON").when(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull() | F.col(f"_r.{first}").isNull(), "other shape")
    told = parsed.withColumn("reason", reason)
    names = [f.name for f in told.schema["_r"].dataType.fields if f.name != "_corrupt"]
    others = [c for c in files.columns if c != text]
    return told.select(*others, "reason", *[F.when(F.col("reason").isNull(), F.col(f"_r.{n}")).alias(n) for n in names])


def characters(pages: DataFrame, key: str) -> DataFrame:
    """The characters of page dumps: page (key and number), n, c, x0, x1, y0, y1, size."""
    rows = pages.where("reason is null").select(F.struct(key, "numer").alias("page"), F.posexplode("znaki").alias("n", "z"))
    number = lambda k: F.get("z", F.lit(k)).cast("double")
    return rows.select("page", F.col("n").cast("long").alias("n"), F.get("z", F.lit(0)).alias("c"), *[number(k + 1).alias(c) for k, c in enumerate(("x0", "x1", "y0", "y1", "size"))])


def bars(pages: DataFrame, key: str) -> DataFrame:
    """The rules of page dumps that may be bars of fractions and lie in no table: page, x0, x1, y."""
    rows = pages.where("reason is null").select(F.struct(key, "numer").alias("page"), F.explode("kreski_kandydujace").alias("b"), F.coalesce("tabele", F.array().cast("array<struct<bbox:array<double>,wiersze:array<array<string>>>>")).alias("tabele"))
    side = lambda t, k: F.get(t["bbox"], F.lit(k))
    x0, x1, y = (F.get("b", F.lit(k)) for k in range(3))
    inside = F.exists("tabele", lambda t: (x0 >= side(t, 0) - 2) & (x1 <= side(t, 2) + 2) & y.between(side(t, 1) - 2, side(t, 3) + 2))
    return rows.where(~inside).select("page", x0.alias("x0"), x1.alias("x1"), y.alias("y"))


def _indented(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=1) + "\n")


def canonical(row: Column) -> Column:
    """A struct as a file's text; nulls are kept, fields in the schema's order."""
    return F.pandas_udf(_indented, "string")(F.to_json(row, {"ignoreNullFields": "false"}))


def write(files: DataFrame, path: str, text: str, root: str) -> DataFrame:
    """Writes each row's text to the file root/path and returns path, n_bytes; run it by an action.

    A file appears whole or not at all: it is written under another name and then renamed. A task that runs again writes the same bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            sizes = []
            for name, content in zip(batch["path"], batch["text"], strict=True):
                raw, target = content.encode(), posixpath.join(base, name)
                store.create_dir(posixpath.dirname(target), recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(raw)
                store.move(part, target)
                sizes.append(len(raw))
            yield pd.DataFrame({"path": batch["path"], "n_bytes": sizes})

    return files.select(F.col(path).alias("path"), F.col(text).alias("text")).where("text is not null").mapInPandas(run, "path string, n_bytes long")


def report(rows: DataFrame, columns: list[str], order: list[str], kind: str) -> DataFrame:
    """line: a report's lines in order, its head first; kind: tsv, csv, markdown, json (a record on a line) or text (padded columns).

    The same rows give the same lines, whatever their order and partitions."""
    cell = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    if kind == "tsv":
        head, line = F.lit("\t".join(columns)), F.concat_ws("\t", *[F.regexp_replace(cell[c], r"[\t\r\n]+", " ") for c in columns])
    elif kind == "csv":
        quoted = [F.when(cell[c].rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(cell[c], F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell[c]) for c in columns]
        head, line = F.lit(",".join(columns)), F.concat_ws(",", *quoted)
    elif kind == "markdown":
        head = F.lit("| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns))
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.regexp_replace(cell[c], r"[\r\n]+", " "), F.lit("|"), F.lit("\\|")) for c in columns]), F.lit(" |"))
    elif kind == "json":
        head, line = None, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    elif kind == "text":
        wide = rows.agg(*[F.greatest(F.max(F.length(cell[c])), F.lit(len(c))).alias(c) for c in columns]).first()
        width = {c: (wide[c] or len(c)) for c in columns}
        head, line = F.lit("  ".join(c.ljust(width[c]) for c in columns).rstrip()), F.rtrim(F.concat_ws("  ", *[F.rpad(cell[c], width[c], " ") for c in columns]))
    else:
        raise ValueError(f"no such kind of report: {kind}")
    body = rows.select(F.lit(1).alias("_part"), F.struct(*order, line.alias("_l")).alias("_o"), line.alias("line"))
    if head is None:
        return body.orderBy("_o").select("line")
    first = rows.sparkSession.range(1).select(F.lit(0).alias("_part"), F.lit(None).cast(body.schema["_o"].dataType).alias("_o"), head.alias("line"))
    return first.unionByName(body).orderBy("_part", "_o").select("line")


def write_report(lines: DataFrame, target: str) -> int:
    """Writes a report's lines to one file and returns their number: lines stream through the driver, the file appears whole."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(target)
    store.create_dir(posixpath.dirname(path), recursive=True)
    part, n = f"{path}.{uuid.uuid4().hex}.part", 0
    with store.open_output_stream(part) as out:
        for row in lines.toLocalIterator():
            out.write(f"{row.line}\n".encode())
            n += 1
    store.move(part, path)
    return n
