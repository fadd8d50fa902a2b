"""One-row evaluation of column expressions."""

from pyspark.sql import functions as F


def evaluate(spark, cases, *columns):
    """Runs columns over rows of named values and returns them as tuples."""
    names = list(cases[0])
    schema = ", ".join(f"{n} {'bigint' if isinstance(cases[0][n], int) else 'string'}" for n in names)
    rows = [(i, *[c[n] for n in names]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, f"_at int, {schema}")
    out = df.select("_at", *[c.alias(f"c{i}") for i, c in enumerate(columns)]).orderBy("_at").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in out]


def apply(spark, function, *values):
    """``function`` of a string column, for each value."""
    return evaluate(spark, [{"v": v} for v in values], function(F.col("v")))
