"""Sweep manifests: validated on the driver (they are a page long), expanded to work units as a DataFrame."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = ("benches", "configs", "seeds", "budget_usd")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A JSON manifest, or YAML where PyYAML is installed; read through Spark, so any store will do."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def problems(manifest: dict) -> list[str]:
    """What is wrong with a manifest; an empty list for a good one."""
    found = [f"missing {k}" for k in REQUIRED if k not in manifest]
    for k in ("benches", "configs", "seeds"):
        if k in manifest and (not isinstance(manifest[k], list) or not manifest[k]):
            found.append(f"{k} must be a list with entries")
    ids = [c.get("id") for c in manifest.get("configs", []) if isinstance(c, dict)]
    if len(ids) != len(set(ids)) or None in ids:
        found.append("configs need distinct ids")
    if any(not isinstance(s, int) for s in manifest.get("seeds", [])):
        found.append("seeds must be whole numbers")
    if not isinstance(manifest.get("budget_usd", 0), int | float) or manifest.get("budget_usd", 0) < 0:
        found.append("budget_usd must be a number of 0 or more")
    return found


def work_units(manifest: dict, tasks: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(bench, task_id) tasks x the manifest's configs and seeds, capped per cell, less what is done.

    The axes are short lists, so the grid is two explodes and no join.
    """
    configs = F.array(*(F.lit(c["id"]) for c in manifest["configs"]))
    seeds = F.array(*(F.lit(s) for s in manifest["seeds"]))
    cap = manifest.get("max_tasks")
    wanted = tasks.filter(F.col("bench").isin(manifest["benches"]))
    if cap is not None:
        rank = F.row_number().over(Window.partitionBy("bench").orderBy("task_id"))
        wanted = wanted.withColumn("_rn", rank).filter(F.col("_rn") <= cap).drop("_rn")
    units = wanted.select("bench", "task_id", F.explode(configs).alias("config_id")).select("*", F.explode(seeds).alias("seed"))
    return units if done is None else units.join(done, ["bench", "config_id", "seed", "task_id"], "left_anti")
