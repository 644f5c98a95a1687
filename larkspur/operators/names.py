"""Which of many names stand in texts and files: one automaton over all names, run once over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names up to which they are sent to all tasks: about 200 MB of automaton.
MOST_NAMES = 1_000_000
PACKED = r"(?i)\.(gz|zip|bz2|xz|zst|7z|lz4|snappy)$"
#: Folders of tools, which hold nobody's notes.
TOOLS = r"/(\.git|\.venv|venv|node_modules|__pycache__|\.mypy_cache|\.pytest_cache|\.ruff_cache)/"


def named_in(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """key and name of each name (as it stands in names) in a text (or its UTF-8, less what isn't), whatever the case of its letters, once for a row of texts. Names may overlap, and stand inside words.

    Nulls and empty names are in no text. Each task builds the automaton once. More than MOST_NAMES names are an error: they'd have to be asked for in parts.
    """
    wanted = names.select("name").where("name is not null and trim(name) <> ''").distinct()
    found = [r.name for r in wanted.limit(MOST_NAMES + 1).toLocalIterator()]
    if len(found) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    kind = texts.schema[key].dataType
    if not found:
        return texts.sparkSession.createDataFrame([], f"{key} {kind.simpleString()}, name string")
    shared = texts.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_folded: dict[str, list[str]] = {}
        for name in shared.value:
            by_folded.setdefault(name.lower(), []).append(name)
        automaton = ahocorasick.Automaton()
        for folded, spelt in by_folded.items():
            automaton.add_word(folded, spelt)
        automaton.make_automaton()
        for batch in batches:
            at, said = [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                if isinstance(x, bytes):
                    x = x.decode("utf-8", "ignore")
                if x:
                    here = {id(spelt): spelt for _, spelt in automaton.iter(x.lower())}
                    for spelt in here.values():
                        at += [i] * len(spelt)
                        said += spelt
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(said, pa.string())], names=[key, "name"])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind.simpleString()}, name string")


def still_named(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """path and name of files under path that still hold a name; of packed files, which aren't searched, the path and no name. Tools' folders are left out.

    Files are read by lines, which no name spans: Spark cuts large files into parts and holds a line at a time, so no file has to fit in memory.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    lines = reader.text(path).where(~F.col("_metadata.file_path").rlike(PACKED) & ~F.col("_metadata.file_path").rlike(TOOLS)).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    packed = reader.format("binaryFile").load(path).select("path").where(F.col("path").rlike(PACKED) & ~F.col("path").rlike(TOOLS))
    plain = lambda df: df.withColumn("path", F.regexp_replace(F.try_url_decode("path"), "^file:/+", "file:/"))
    return plain(named_in(lines, names, "path", "value").distinct().unionByName(packed.select("path", F.lit(None).cast("string").alias("name"))))
