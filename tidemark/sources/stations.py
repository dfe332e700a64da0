"""Station reports: one quoted record per line, "value,quality" fields in tenths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Missing markers of the report format.
SENTINELS = (9999, 99999, -9999)


def parse_report_lines(df: DataFrame, header, line="value", keep=("DATE", "TMP", "DEW", "SLP")) -> DataFrame:
    """Drop lines with an odd quote count, header lines and short records; keep the named fields."""
    quotes = F.length(F.regexp_replace(line, '[^"]', ""))
    n = len(header)
    rec = F.from_csv(line, ", ".join(f"f{i} STRING" for i in range(n)), {"quote": '"', "mode": "PERMISSIVE"})
    ok = df.where((quotes % 2 == 0) & ~F.col(line).startswith(",".join(f'"{h}"' for h in header[:2])))
    parsed = ok.withColumn("_f", rec).where(F.col(f"_f.f{n - 1}").isNotNull())
    others = [c for c in df.columns if c != line]
    return parsed.select(*others, *[F.col(f"_f.f{header.index(k)}").alias(k) for k in keep])


def read_reports(spark: SparkSession, path: str, header) -> DataFrame:
    return parse_report_lines(spark.read.text(path), header)


def decode(field, scale=10.0) -> Column:
    """First part of "value,quality" divided by ``scale``; sentinels and bad text become null."""
    head = F.trim(F.get(F.split(field, ","), F.lit(0)))
    v = F.when(head.rlike(r"^[+-]?[0-9]+$"), head).try_cast("int")
    return F.when(~v.isin(*SENTINELS), v / F.lit(float(scale)))
