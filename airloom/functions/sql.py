"""The index arithmetic as SQL functions, for queries written in SQL.

``register(spark)`` creates temporary functions that Catalyst inlines; they are not Python UDFs.
"""
from __future__ import annotations

from pyspark.sql import SparkSession

from .. import constants as K


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def definitions() -> dict[str, str]:
    unit = "lower(trim(coalesce(u, '')))"
    factor = "CASE p " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in K.PPB_FACTORS.items()) + " END"
    convert = (
        f"CASE WHEN p = 'co' THEN CASE WHEN {unit} IN ({_list(K.MG_UNITS)}) THEN v "
        f"WHEN {unit} = 'ppm' OR ({unit} = 'ppb' AND v < {K.CO_PPB_IS_PPM_BELOW}) THEN v * {K.CO_PPM_FACTOR}D "
        f"WHEN {unit} = 'ppb' THEN v * {K.PPB_FACTORS['co']}D ELSE v / 1000D END "
        f"WHEN {unit} IN ({_list(K.MG_UNITS)}) THEN v * 1000D "
        f"WHEN {unit} = 'ppb' THEN v * coalesce({factor}, 1D) "
        f"WHEN {unit} = 'ppm' AND {factor} IS NOT NULL THEN v * {factor} * 1000D ELSE v END"
    )
    curves = []
    for name, b in K.BREAKPOINTS.items():
        steps = "WHEN c <= 0 THEN 0D " + " ".join(
            f"WHEN c <= {b[i]} THEN {(K.INDEX_STEPS[i] - K.INDEX_STEPS[i - 1]) / (b[i] - b[i - 1])!r}D * (c - {b[i - 1]}D) "
            f"+ {K.INDEX_STEPS[i - 1]}D" for i in range(1, len(b)))
        curves.append(f"WHEN '{name}' THEN CASE {steps} WHEN c IS NULL THEN NULL ELSE 500D END")
    bands = " ".join(f"WHEN i <= {hi} THEN '{b}'" for b, hi, _ in K.BANDS[:-1])
    return {
        "to_index_unit": f"(p STRING, v DOUBLE, u STRING) RETURNS DOUBLE RETURN {convert}",
        "sub_index": f"(p STRING, c DOUBLE) RETURNS DOUBLE RETURN CASE p {' '.join(curves)} ELSE -1D END",
        "index_band": f"(i DOUBLE) RETURNS STRING RETURN CASE WHEN i IS NULL THEN NULL {bands} ELSE '{K.BANDS[-1][0]}' END",
    }


def register(spark: SparkSession) -> None:
    for name, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
