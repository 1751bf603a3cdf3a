"""Small constant relations built JVM-side.

``spark.createDataFrame(list)`` plans as a Python RDD scan (Python workers at
run time), and composing one ``lit`` per value costs a py4j round trip each.
Here the rows become one ``inline(array(named_struct(...)))`` SQL expression
over a one-row range: one call to build, folded by Catalyst like any constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _sql_literal(v, dt: T.DataType) -> str:
    if v is None:
        return f"CAST(NULL AS {dt.simpleString()})"
    if isinstance(dt, T.ArrayType):
        inner = ", ".join(_sql_literal(x, dt.elementType) for x in v)
        return f"CAST(array({inner}) AS {dt.simpleString()})"
    if isinstance(dt, T.StringType):
        esc = str(v).replace("\\", "\\\\").replace("'", "\\'")
        return f"'{esc}'"
    if isinstance(dt, T.BooleanType):
        return "true" if v else "false"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        text = v.isoformat(sep=" ")
    elif isinstance(dt, T.DateType):
        text = v.isoformat()
    elif isinstance(dt, (T.FloatType, T.DoubleType)):
        text = repr(float(v))            # round-trips exactly
    else:
        text = str(v)                    # integers, decimals
    return f"CAST('{text}' AS {dt.simpleString()})"


def literal_frame(spark: SparkSession, rows, schema: T.StructType | str) -> DataFrame:
    """A DataFrame holding ``rows`` (tuples in ``schema`` order).

    Naive ``datetime`` values for a ``timestamp`` column are read in the session
    time zone (``createDataFrame`` would use the Python process's local zone).
    """
    st = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
    base = spark.range(0, 1, 1, 1)
    if not rows:
        return base.where("false").selectExpr(
            *[f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in st.fields])
    structs = ", ".join(
        "named_struct(" + ", ".join(f"'{f.name}', {_sql_literal(v, f.dataType)}"
                                    for v, f in zip(r, st.fields)) + ")"
        for r in rows)
    return base.selectExpr(f"inline(array({structs}))")
