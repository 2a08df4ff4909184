"""Formula and document conversion at scale: plain-Python grammars in Arrow batches and table functions.

A batch converts each distinct text once. What cannot be read is a row with an error, not a failed job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from folioframe.functions import formulas, prose, symbols

FORMATS = tuple(x for x in formulas.WRITERS if x != "typst_bare")


def convert_formulas(df: DataFrame, text: str, source: str = "latex", targets: tuple[str, ...] = FORMATS, display: bool = True) -> DataFrame:
    """df's rows once a target: adds output_format, result and error. Each text is parsed once for all targets."""
    if source not in formulas.READERS or not set(targets) <= set(FORMATS):
        raise ValueError(f"unknown format: {source} to {targets}")
    keep = [c for c in df.columns if c != text]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            done = {}
            for t in set(texts):
                try:
                    tree = None if t is None else formulas.READERS[source](t)
                    done[t] = [(None if tree is None else formulas.WRITERS[x](tree, display), None) for x in targets]
                except (formulas.FormulaError, RecursionError) as e:
                    done[t] = [(None, str(e))] * len(targets)
            rows = [i for i in range(len(texts)) for _ in targets]
            made = [x for t in texts for x in done[t]]
            columns = [batch.column(i).take(pa.array(rows)) for i in range(batch.num_columns - 1)]
            formats = pa.array([x for _ in texts for x in targets], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, formats, pa.array([r for r, _ in made], pa.string()), pa.array([e for _, e in made], pa.string())], [*keep, "output_format", "result", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text) + ", output_format string, result string, error string"
    return df.select(*keep, text).mapInArrow(run, schema.removeprefix(", "))


def register(spark) -> None:
    """The SQL function folioframe_convert(text, source, target), in Arrow batches; null for what cannot be read."""
    @pandas_udf("string")
    def convert(text: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
        def one(t, s, o):
            try:
                return formulas.convert(t, s, o)
            except (formulas.FormulaError, RecursionError):
                return None

        done = {k: None if k[0] is None else one(*k) for k in set(zip(text, source, target, strict=True))}
        return pd.Series([done[k] for k in zip(text, source, target, strict=True)], dtype="object")

    spark.udf.register("folioframe_convert", convert)


@udtf(returnType="node int, parent int, depth int, ordinal int, kind string, value string")
class FormulaNodes:
    """The tree of a LaTeX formula as pre-order rows."""

    def eval(self, latex: str) -> Iterator[tuple]:
        if latex is not None:
            yield from formulas.nodes(formulas.from_latex(latex))


@udtf(returnType="ord int, kind string, level int, text string, display boolean")
class MarkdownBlocks:
    """The blocks of a Markdown text in order."""

    def eval(self, text: str) -> Iterator[tuple]:
        for i, (kind, level, body, display) in enumerate(prose.from_markdown(text or "")):
            yield i, kind, level, body, display


@udtf(returnType="ord int, kind string, level int, text string, display boolean")
class LatexBlocks:
    """Formulas and paragraphs of a LaTeX text in order."""

    def eval(self, text: str) -> Iterator[tuple]:
        for i, (kind, level, body, display) in enumerate(prose.from_latex_document(text or "")):
            yield i, kind, level, body, display


def expand(df: DataFrame, key: str, text: str, table_function) -> DataFrame:
    """(key, the table function's columns) for every row."""
    spark = df.sparkSession
    name = "folioframe_" + table_function.func.__name__.lower() if hasattr(table_function, "func") else "folioframe_rows"
    spark.udtf.register(name, table_function)
    return spark.sql(f"SELECT t.key AS {key}, r.* FROM {{df}} t, LATERAL {name}(t.body) r", df=df.select(F.col(key).alias("key"), F.col(text).alias("body")))


def symbol_table(spark) -> DataFrame:
    """(latex, unicode, typst, class): a dimension table of fixed size, for broadcast joins."""
    return spark.createDataFrame(symbols.rows(), "latex string, unicode string, typst string, class string")


def name_symbols(df: DataFrame, text: str) -> DataFrame:
    """df with the array `symbols` of the characters that the LaTeX commands of a text stand for, in order."""
    known = F.create_map(*[F.lit(x) for latex, character, _, _ in symbols.rows() for x in (latex, character)])
    commands = F.regexp_extract_all(F.col(text), F.lit(r"\\[A-Za-z]+"), F.lit(0))
    return df.withColumn("symbols", F.filter(F.transform(commands, lambda c: F.try_element_at(known, c)), lambda c: c.isNotNull()))


def color_hex(color):
    """Six hexadecimal digits of a colour name or code column; black if it is neither."""
    bare = F.regexp_replace(F.trim(color), "^#", "")
    named = F.create_map(*[F.lit(x) for pair in symbols.COLORS.items() for x in pair])
    return F.when(bare.rlike("^[0-9A-Fa-f]{6}$"), F.upper(bare)).otherwise(F.coalesce(F.try_element_at(named, F.lower(bare)), F.lit("000000")))
