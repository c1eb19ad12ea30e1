"""Figures of a run, observed while its results are written: no second job over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from folioscope.functions.tables import DOCUMENT_TYPES
from folioscope.operators.correct import changed_characters

#: Columns of seconds by stage.
SECONDS = ("classify_time", "ocr_time", "processing_time")


def observed(results: DataFrame) -> tuple[DataFrame, Observation]:
    """The results of pipeline.run(), and what their first action then tells: files that went well and failed, files and first name of each type, characters read, characters
    that cleaning changed, seconds of each stage. Counts are zero, and names null, where there are no rows."""
    ok = F.col("error").isNull()
    kind = F.col("classification")["document_type"]
    names = [t for t, *_ in DOCUMENT_TYPES]
    groups = {t: ok & (kind == t) for t in names} | {"other": ok & ~F.coalesce(kind.isin(names), F.lit(False)), "error": ~ok}
    metrics = [F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.length("ocr_text")), F.lit(0)).alias("characters"), F.coalesce(F.sum(changed_characters(F.col("ocr_text"), F.col("clean_ocr_text"))), F.lit(0)).alias("changed_characters")]
    for name, holds in groups.items():
        metrics += [F.count_if(holds).alias(f"n_{name}"), F.min(F.when(holds, F.col("file_name"))).alias(f"first_{name}")]
    metrics += [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in SECONDS if c in results.columns]
    told = Observation()
    return results.observe(told, *metrics), told


def types(metrics: dict) -> list[tuple[str, int]]:
    """(name, files) of the types that occur, most frequent first, equals in the order of their first file."""
    english = {t: en for t, _, en, _ in DOCUMENT_TYPES} | {"other": "Unknown", "error": "Error"}
    found = [(-n, metrics[f"first_{t}"], english[t]) for t in english if (n := metrics.get(f"n_{t}"))]
    return [(name, -n) for n, _, name in sorted(found)]


def summary(metrics: dict, seconds: float) -> str:
    """How many files went well, the types by frequency, and what it took."""
    kinds = "".join(f"\n   {name}: {n}" for name, n in types(metrics))
    spent = ", ".join(f"{c} {metrics[c]:.1f}s" for c in SECONDS if c in metrics)
    return f"{metrics['ok']} ok | {metrics['failed']} failed | {seconds:.1f}s\nTYPES:{kinds}\nTEXT: {metrics['characters']} characters, {metrics['changed_characters']} changed\nTIME: {spent}"
