"""Personal and health data in values and in column names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions import patterns as P
from sparkassay.functions import values as V
from sparkassay.operators.quality import metric_row, ratio, total


def contamination_of(df: DataFrame, patterns: dict[str, str], columns: Sequence[str] | None = None) -> Column:
    scanned = V.string_columns(df) if columns is None else [c for c in columns if c in df.columns]
    if not scanned:
        return F.lit(0.0)
    texts = [V.text(df, c) for c in scanned]
    return ratio(
        total([F.count_if(P.any_found(t, patterns)) for t in texts]), total([F.count(t) for t in texts])
    )


def pii_contamination_rate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of the present text cells in which personal data is found."""
    return metric_row(df, "pii_contamination_rate", contamination_of(df, P.PII_PATTERNS, columns))


def pii_phi_contamination_rate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of the present text cells in which health data is found."""
    return metric_row(df, "pii_phi_contamination_rate", contamination_of(df, P.PHI_PATTERNS, columns))


def violation_of(df: DataFrame, fields: Sequence[str] | None = None) -> Column:
    listed = V.names_containing(df.columns, P.REGULATED_NAME_WORDS) if fields is None else list(fields)
    held = [c for c in listed if c in df.columns]
    if not held:
        return F.lit(0.0)
    return ratio(total([F.count_if(V.present(df, c)) for c in held]), F.count("*") * len(listed))


def pii_phiviolation_rate(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Present cells of regulated fields / (rows x listed fields, absent ones included)."""
    return metric_row(df, "pii_phiviolation_rate", violation_of(df, fields))


def raw_pii_fields(df: DataFrame) -> list[str]:
    return V.names_containing(df.columns, P.PII_NAME_WORDS)


def raw_pii_field_count(df: DataFrame) -> DataFrame:
    """Number of column names that contain a word for personal data."""
    return metric_row(df, "raw_pii_field_count", F.lit(len(raw_pii_fields(df))))


def raw_pii_field_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table `(table, fields, present_cells)`: columns named like personal data, and how many
    cells of them hold a value."""
    out = None
    for name, df in tables.items():
        fields = raw_pii_fields(df)
        cells = total([F.lit(0).cast("long"), *(F.count_if(V.present(df, c)) for c in fields)])
        one = df.agg(cells.alias("present_cells")).select(
            F.lit(name).alias("table"), F.lit(len(fields)).cast("long").alias("fields"), "present_cells"
        )
        out = one if out is None else out.unionAll(one)
    return out


def pattern_counts(df: DataFrame, columns: Sequence[str], patterns: dict[str, str]) -> DataFrame:
    """Rows `(column, pattern, cells, matching, rate)` for every column and pattern; one scan."""
    scanned = [c for c in columns if c in df.columns]
    cells = []
    for c in scanned:
        t = V.text(df, c)
        for name, pattern in patterns.items():
            cells.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(name).alias("pattern"),
                    F.count(t).alias("cells"),
                    F.count_if(P.found(t, name, pattern)).alias("matching"),
                )
            )
    if not cells:
        return df.sparkSession.createDataFrame(
            [], "column string, pattern string, cells bigint, matching bigint, rate double"
        )
    counted = df.agg(F.array(*cells).alias("counts")).select(F.inline("counts"))
    return counted.withColumn("rate", ratio(F.col("matching"), F.col("cells")))


def detect_identifiers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows `(column, identifier, cells, matching, rate)` for national, contact and web identifiers."""
    return pattern_counts(df, columns, P.IDENTIFIER_PATTERNS).withColumnRenamed("pattern", "identifier")


def pii_risk_fields(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows `(table, column, by_name, matching)`: columns that look sensitive by their name or in
    which personal data is found."""
    out = None
    for table, df in tables.items():
        named, texts = raw_pii_fields(df), V.string_columns(df)
        cells = [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(c in named).alias("by_name"),
                (F.count_if(P.any_found(V.text(df, c), P.PII_PATTERNS)) if c in texts else F.lit(0))
                .cast("long")
                .alias("matching"),
            )
            for c in df.columns
            if c in named or c in texts
        ]
        if not cells:
            continue
        one = df.agg(F.array(*cells).alias("found")).select(F.lit(table).alias("table"), F.inline("found"))
        out = one if out is None else out.unionAll(one)
    if out is None:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table string, column string, by_name boolean, matching bigint")
    return out.where(F.col("by_name") | (F.col("matching") > 0))


def governance_flags(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows `(regulation, table, column, signal, matching)`: regulations with an explicit signal in
    a column's name (matching is NULL) or in its values (matching counts the cells)."""
    out = None
    for table, df in tables.items():
        texts = V.string_columns(df)
        cells = []
        for c in df.columns:
            for signal, regulations in P.REGULATION_SIGNALS.items():
                by_name = signal in c.lower()
                by_value = c in texts and signal in P.PII_PATTERNS
                for regulation in regulations:
                    head = [F.lit(regulation).alias("regulation"), F.lit(c).alias("column"), F.lit(signal).alias("signal")]
                    if by_name:
                        cells.append(F.struct(*head, F.lit(None).cast("long").alias("matching")))
                    elif by_value:
                        hits = F.count_if(P.found(V.text(df, c), signal, P.PII_PATTERNS[signal]))
                        cells.append(F.struct(*head, hits.alias("matching")))
        if not cells:
            continue
        one = df.agg(F.array(*cells).alias("flags")).select(F.lit(table).alias("table"), F.inline("flags"))
        out = one if out is None else out.unionAll(one)
    if out is None:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame(
            [], "regulation string, table string, column string, signal string, matching bigint"
        )
    return out.where("matching IS NULL OR matching > 0").select("regulation", "table", "column", "signal", "matching")
