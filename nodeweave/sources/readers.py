"""Readers of tables, trajectories, splits and array files, and writers of small reports."""

from __future__ import annotations

import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeweave.functions.scalar import normalised


def csv_table(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV table with a header; columns are found by name whatever their order, and only those asked for are parsed."""
    from pyspark.sql.types import StructType

    names = spark.read.csv(path, header=True).columns
    kinds = {f.name: f.dataType for f in StructType.fromDDL(schema).fields}
    missing = [c for c in kinds if c not in names]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    rows = spark.read.csv(path, header=True, enforceSchema=False)
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items() if columns is None or c in columns])


class Trajectory:
    """A folder of material.csv, faces.csv, diagnostics.csv and a frame_000000.csv a step that diagnostics lists."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        missing = [n for n in ("material.csv", "faces.csv", "diagnostics.csv") if not self._exists(n)]
        if missing:
            raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
        sites = csv_table(spark, f"{self.folder}/material.csv", "node_id long, u_x double, u_y double, u_z double")
        self.sites = sites.select(F.col("node_id").alias("id"), normalised(F.array("u_x", "u_y", "u_z")).alias("pos"))
        self.diagnostics = csv_table(spark, f"{self.folder}/diagnostics.csv", "step long, time double")

    def _exists(self, name: str) -> bool:
        jvm, path = self.spark._jvm, f"{self.folder}/{name}"
        return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(path))

    def frames(self) -> DataFrame:
        """(step, time, id, pos, velocity) of every listed frame, in one scan."""
        rows = self.spark.read.csv(f"{self.folder}/frame_*.csv", header=True, schema=None)
        step = F.regexp_extract(F.input_file_name(), r"frame_(\d+)\.csv", 1).cast("long")
        num = lambda c: F.col(c).cast("double")
        rows = rows.select(step.alias("step"), F.col("node_id").cast("double").cast("long").alias("id"), F.array(*map(num, "xyz")).alias("pos"), F.array(*map(num, "uvw")).alias("velocity"))
        return rows.join(F.broadcast(self.diagnostics), "step")  # a row a frame

    def frame(self, index: int) -> DataFrame:
        """(id, pos, velocity) of the index-th listed frame; one file is read."""
        step = self.diagnostics.orderBy("time", "step").collect()[index]["step"]
        rows = csv_table(self.spark, f"{self.folder}/frame_{step:06d}.csv", "node_id long, x double, y double, z double, u double, v double, w double")
        return rows.select(F.col("node_id").alias("id"), F.array("x", "y", "z").alias("pos"), F.array("u", "v", "w").alias("velocity"))


def checked_split(splits: DataFrame, one_based: bool = True) -> DataFrame:
    """(split, id) of saved split ids, counted from 0; raises if an id is negative, repeats in its split, or is in two."""
    out = splits.select("split", (F.col("id") - (1 if one_based else 0)).cast("long").alias("id"))
    bad = out.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min("split").alias("a"), F.max("split").alias("b")).where("id < 0 OR c > 1")
    found = bad.orderBy("id").limit(1).collect()
    if found:
        r = found[0]
        raise ValueError(f"split id {r['id']} is " + ("negative" if r["id"] < 0 else "in two splits" if r["a"] != r["b"] else "repeated"))
    return out


def selected_rows(fields: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of a field table that ids name, once each."""
    return fields.join(ids.select(key).distinct(), key, "left_semi")


def npz_points(spark: SparkSession, path: str, name: str = "points") -> DataFrame:
    """(file, id, pos) of an array (n, dim) in each .npz file of a path: a task reads a file."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for file, content in zip(b["path"], b["content"]):
                x = np.asarray(np.load(io.BytesIO(content), allow_pickle=False)[name], float)
                for lo in range(0, len(x), 65536):
                    yield pd.DataFrame({"file": file, "id": np.arange(lo, min(lo + 65536, len(x))), "pos": list(x[lo : lo + 65536])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, id long, pos array<double>")


def report(rows: DataFrame, form: str, most: int = 10_000) -> str:
    """A small table as text: markdown, jsonl, csv or latex. Refused above `most` rows, as it is made on the driver."""
    got, names = rows.limit(most + 1).collect(), rows.columns
    if len(got) > most:
        raise ValueError(f"a report of more than {most} rows")
    text = lambda v: "" if v is None else f"{v:.6e}" if isinstance(v, float) else str(v)
    if form == "jsonl":
        return "".join(json.dumps(r.asDict(), default=str) + "\n" for r in got)
    if form == "csv":
        import csv

        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([names, *[["" if v is None else v for v in r] for r in got]])
        return out.getvalue()
    if form == "latex":
        lines = [" & ".join(map(text, r)) + r" \\" for r in [names, *got]]
        return "\n".join([rf"\begin{{tabular}}{{{'r' * len(names)}}}", *lines, r"\end{tabular}"]) + "\n"
    if form != "markdown":
        raise ValueError(form)
    return "\n".join("| " + " | ".join(r) + " |" for r in [names, ["---"] * len(names), *[list(map(text, r)) for r in got]]) + "\n"
