"""Configuration loaders (S5): source and taxonomy files are small; they are
read on the driver with the installed YAML parser and become DataFrames that
joins broadcast after a size check."""
from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

SOURCE_COLUMNS = ("id", "name", "kind", "priority", "schedule", "mode", "list_url", "homepage", "enabled")


def load_yaml(path: str | Path) -> dict:
    p = Path(path)
    if not p.exists():
        return {}
    with p.open(encoding="utf-8") as fh:
        return yaml.safe_load(fh) or {}


def load_sources(spark: SparkSession, path: str | Path) -> DataFrame:
    """Source dimension: id, name, kind (default aggregate), priority (40),
    schedule (fast), mode (html), URLs, enabled (true)."""
    doc = load_yaml(path)
    rows = []
    for s in doc.get("sources", []) or []:
        rows.append((s["id"], s.get("name", s["id"]), s.get("kind", "aggregate"), int(s.get("priority", 40)),
                     s.get("schedule", "fast"), s.get("mode", "html"), s.get("list_url", ""), s.get("homepage", ""),
                     bool(s.get("enabled", True))))
    schema = ("id string, name string, kind string, priority int, schedule string, mode string, list_url string, "
              "homepage string, enabled boolean")
    return spark.createDataFrame(rows, schema)


def load_taxonomy(path: str | Path) -> dict:
    """Taxonomy mapping (types, fields, audiences, exclude_phrases); order kept."""
    doc = load_yaml(path)
    return {k: doc.get(k, {} if k != "exclude_phrases" else []) for k in ("types", "fields", "audiences", "exclude_phrases")}


def taxonomy_rows(spark: SparkSession, taxonomy: dict) -> DataFrame:
    """The taxonomy as a dimension (group, tag_id, keyword, type_ord, kw_ord)."""
    rows = []
    for t_ord, (tid, cfg) in enumerate(taxonomy.get("types", {}).items()):
        for k_ord, kw in enumerate(cfg.get("keywords", []) or []):
            rows.append(("types", tid, kw, t_ord, k_ord))
    for group in ("fields", "audiences"):
        for t_ord, (tid, kws) in enumerate(taxonomy.get(group, {}).items()):
            for k_ord, kw in enumerate(kws or []):
                rows.append((group, tid, kw, t_ord, k_ord))
    for k_ord, kw in enumerate(taxonomy.get("exclude_phrases", []) or []):
        rows.append(("exclude_phrases", "", kw, 0, k_ord))
    return spark.createDataFrame(rows, "group string, tag_id string, keyword string, type_ord int, kw_ord int")
