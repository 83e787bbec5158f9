"""Answers that must have a declared form: parsed, checked field by field, and sent back to a model with what is wrong."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from weft.functions.text import parsed_json
from weft.operators.hooks import Writer


def checked(answer: Column, form: StructType) -> Column:
    """A struct (success, data, error_type, errors) of an answer against a flat ``form``.

    error_type is parse_failed where no JSON is found (see :func:`parsed_json`: plain, fenced, in other text), schema_failed
    where it is no object or a field does not fit, else null. ``errors`` has (field, error): missing, for a field that may not be null; or not <type>, for
    a value that can't be cast to it. data holds what fits, null elsewhere; other fields are passed over. A null answer fails to parse.
    """
    json = parsed_json(answer)
    v = F.try_parse_json(json)
    of = lambda f, kind: F.try_variant_get(v, f"$.{f.name}", kind)
    entry = lambda name, error: F.struct(F.lit(name).alias("field"), F.lit(error).alias("error"))
    wrong = [
        F.when(of(f, "variant").isNull() | F.is_variant_null(of(f, "variant")), F.lit(None) if f.nullable else entry(f.name, "missing")).when(
            of(f, f.dataType.simpleString()).isNull(), entry(f.name, f"not {f.dataType.simpleString()}")
        )
        for f in form
    ]
    shape = F.schema_of_variant(v).startswith("OBJECT")
    errors = F.when(json.isNull(), F.array().cast("array<struct<field:string,error:string>>")).when(~shape, F.array(entry("", "not an object"))).otherwise(F.filter(F.array(*wrong), lambda x: x.isNotNull()))
    data = F.struct(*[of(f, f.dataType.simpleString()).alias(f.name) for f in form])
    kind = F.when(json.isNull(), "parse_failed").when(F.size(errors) > 0, "schema_failed")
    return F.struct(kind.isNull().alias("success"), F.when(shape, data).alias("data"), kind.alias("error_type"), errors.alias("errors"))


def asked(write: Writer) -> Column:
    """The model as a function of a column that is asked for the rows that aren't null only."""

    def call(prompts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(prompts), dtype=object)
        some = prompts.notna()
        if some.any():
            out[some.to_numpy()] = list(write(prompts[some].reset_index(drop=True)))
        return out

    return F.pandas_udf(call, StringType())


def structured(rows: DataFrame, answer: str, form: StructType, write: Writer | None = None, attempts: int = 1) -> DataFrame:
    """``rows`` with ``checked`` (see :func:`checked`), ``repaired`` and ``attempts`` made.

    An answer that fails is sent to the model, with its errors, at most ``attempts`` times; the first
    that passes counts, else the answer at hand with its own errors stands. Without a model answers stay as they are. Columns of
    these names are replaced. Narrow: a row is checked and repaired where it is.
    """
    out = rows.withColumn("checked", checked(F.col(answer), form)).withColumn("repaired", F.lit(False)).withColumn("attempts", F.lit(0))
    for k in range(attempts if write is not None else 0):
        failed = ~F.col("checked.success")
        said = F.concat_ws("; ", F.transform("checked.errors", lambda e: F.concat(e["field"], F.lit(": "), e["error"])))
        prompt = F.concat(F.lit("Correct this JSON. "), F.col("checked.error_type"), F.lit(": "), said, F.lit("\n"), F.coalesce(F.col(answer), F.lit("")))
        out = out.withColumn("_new", asked(write)(F.when(failed, prompt)))
        out = out.withColumn("_check", checked(F.col("_new"), form))
        better = failed & F.col("_check.success")
        out = out.withColumn("attempts", F.when(failed, k + 1).otherwise(F.col("attempts"))).withColumn("repaired", F.col("repaired") | better)
        out = out.withColumn("checked", F.when(better, F.col("_check")).otherwise(F.col("checked"))).drop("_new", "_check")
    return out
