"""Sinks (SNK01-SNK06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


#: Rows of an Excel sheet below its header.
SHEET_ROWS = 1_048_575


def rules_json(rules: DataFrame, path: str, include_inactive: bool = False) -> None:
    """SNK01: rules as JSON lines; conditions and metadata are JSON strings."""
    kept = rules if include_inactive else rules.where("is_active")
    kept.withColumn("conditions", F.to_json("conditions")).write.mode("overwrite").json(path)


def upserted(custom: DataFrame, added: DataFrame) -> DataFrame:
    """SNK02: custom (system, term, code, display) with added's rows in place of equal terms'."""
    return custom.join(added.select("system", "term"), ["system", "term"], "left_anti").unionByName(added)


def synonyms_json(sets: DataFrame, path: str) -> None:
    """SNK03: (set_key, synonyms) as JSON objects of one set, one a line."""
    sets.select(F.to_json(F.map_from_arrays(F.array("set_key"), F.array("synonyms")))).write.mode("overwrite").text(path)


def results(flat: DataFrame, path: str) -> None:
    """SNK04: flattened results as CSV and JSON beside each other."""
    flat.write.mode("overwrite").option("header", True).csv(f"{path}.csv")
    flat.write.mode("overwrite").json(f"{path}.json")


def quoted_csv(flat: DataFrame, path: str) -> None:
    """SNK05: CSV with all values quoted and confidences to three decimals."""
    flat.withColumn("confidence", F.format_string("%.3f", F.col("confidence"))).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def documents(exported: DataFrame, path: str, fmt: str) -> None:
    """SNK06: exported documents as json or csv; Excel goes through the driver and is for small batches."""
    if fmt not in ("json", "csv", "xlsx"):
        raise ValueError(f"unsupported export format: {fmt}")
    if fmt == "xlsx":
        rows = exported.limit(SHEET_ROWS + 1).toPandas()
        if len(rows) > SHEET_ROWS:
            raise ValueError(f"more than {SHEET_ROWS} rows do not fit an Excel sheet")
        rows.to_excel(path, index=False)
    elif fmt == "csv":
        exported.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        exported.write.mode("overwrite").json(path)
