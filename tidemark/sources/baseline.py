"""The ratchet's baseline: a strict, sorted, tab-separated file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "# gate baseline v1"
COLUMNS = "path\tsignal\thigh\twatch"
# The signals that a baseline may hold, sorted.
SIGNALS = ("cognitive", "container_size", "cyclomatic", "file_cycle", "file_size", "logical_lines", "nesting", "package_cycle",
           "parameters", "stable_dependency")
SCHEMA = "path string, signal string, high long, watch long"


def parse(text: str, version: str = VERSION) -> list[tuple[str, str, int, int]]:
    """Rows of a baseline; ValueError names the first line that breaks a rule."""
    if "\r" in text:
        raise ValueError("line endings must be LF")
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    if lines[:2] != [version, COLUMNS]:
        raise ValueError(f"line {1 if lines[:1] != [version] else 2}: not a baseline header")
    rows: list[tuple[str, str, int, int]] = []
    for n, line in enumerate(lines[2:], 3):
        parts = line.split("\t")
        if len(parts) != 4 or not parts[0]:
            raise ValueError(f"line {n}: four values are needed, the path not empty")
        path, signal, high, watch = parts
        if signal not in SIGNALS:
            raise ValueError(f"line {n}: unknown signal {signal!r}")
        if not (high.isascii() and high.isdigit() and watch.isascii() and watch.isdigit()):
            raise ValueError(f"line {n}: counts must be whole numbers")
        if rows and rows[-1][:2] >= (path, signal):
            raise ValueError(f"line {n}: {'repeated' if rows[-1][:2] == (path, signal) else 'not sorted'}")
        rows.append((path, signal, int(high), int(watch)))
    return rows


def read(spark: SparkSession, path: str) -> DataFrame:
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(parse(text), SCHEMA)


def write(rows: DataFrame, path: str, version: str = VERSION) -> None:
    """The baseline of a snapshot as one file, sorted and written by Spark: only the head and the name of the part file pass
    through the driver."""
    import glob
    import os
    import shutil
    import tempfile

    kept = rows.where((F.col("high") > 0) | (F.col("watch") > 0))
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, version), (1, COLUMNS)], "part int, value string").select("part", F.lit("").alias("path"), F.lit("").alias("signal"), "value")
    body = kept.select(F.lit(2).alias("part"), "path", "signal", F.concat_ws("\t", "path", "signal", F.col("high").cast("string"), F.col("watch").cast("string")).alias("value"))
    folder = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(path)))  # beside the file, which is local to the driver
    try:
        head.union(body).orderBy("part", "path", "signal").select("value").coalesce(1).write.mode("overwrite").text(f"file://{folder}/out")
        os.replace(glob.glob(f"{folder}/out/part-*")[0], path)
    finally:
        shutil.rmtree(folder)


def render(rows: DataFrame, version: str = VERSION) -> str:
    """The baseline of a snapshot: one row per path and signal, those without counts left out."""
    kept = rows.where((F.col("high") > 0) | (F.col("watch") > 0)).select("path", "signal", "high", "watch")
    body = sorted(kept.collect(), key=lambda r: (r.path.encode(), r.signal))
    return "".join(f"{x}\n" for x in [version, COLUMNS, *("\t".join(map(str, r)) for r in body)])
