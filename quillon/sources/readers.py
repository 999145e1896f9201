"""Readers: tables, named sources, snapshots, records, logs, reports, binary files."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import concatenated


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named_sources(spark: SparkSession, sources: dict[str, str], label: str = "source_name") -> DataFrame:
    """All Parquet sources that can be read, one after the other, each row with its source's name; fails only if none can."""
    frames, errors = [], []
    for name, path in sources.items():
        try:
            frames.append(spark.read.parquet(path).withColumn(label, F.lit(name)))
        except AnalysisException as e:
            errors.append(f"{name}: {e.getCondition()}")
    if not frames:
        raise ValueError("no source can be read: " + "; ".join(errors))
    return concatenated(frames)


def with_retries(read: Callable[[], DataFrame], attempts: int = 5, first_wait: float = 2.0, longest: float = 60.0) -> DataFrame:
    """read(), again after twice the wait each time it fails."""
    for k in range(attempts):
        try:
            return read()
        except AnalysisException:
            if k == attempts - 1:
                raise
            time.sleep(min(longest, first_wait * 2**k))
    raise ValueError("attempts must be at least 1")


def first_readable(*reads: Callable[[], DataFrame]) -> DataFrame:
    """The first of several readers that doesn't fail (batch before stream, binary before text)."""
    for read in reads[:-1]:
        try:
            return read()
        except AnalysisException:
            continue
    return reads[-1]()


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records by the path's ending: json (a list), jsonl, csv with a header, parquet, orc, txt. Pickles are refused."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    readers: dict[str, Callable[[], DataFrame]] = {
        "json": lambda: spark.read.option("multiLine", True).json(path),
        "jsonl": lambda: spark.read.json(path),
        "csv": lambda: spark.read.option("header", True).option("inferSchema", True).csv(path),
        "parquet": lambda: spark.read.parquet(path),
        "orc": lambda: spark.read.orc(path),
        "txt": lambda: spark.read.text(path),
    }
    if kind not in readers:
        raise ValueError(f"unknown record format: {kind}")
    return readers[kind]()


def files(spark: SparkSession, folder: str, endings: tuple[str, ...], recursive: bool = True) -> DataFrame:
    """path, name, caption (the stem, underscores as blanks), length and content of the files with one of the endings."""
    glob = "*.{" + ",".join(e.lstrip(".") for e in endings) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return found.select("path", name.alias("name"), F.replace(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")).alias("caption"), "length", "content")


def listing(found: DataFrame, n: int | None = None) -> DataFrame:
    """Files by path, the first n of them."""
    found = found.orderBy("path")
    return found if n is None else found.limit(n)


def float_arrays(found: DataFrame) -> DataFrame:
    """path and embedding of every array of .npz archives (path, content), each flattened and named path:key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for rows in frames:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    for key in arrays.files:
                        yield pd.DataFrame({"path": [f"{path}:{key}"], "embedding": [np.asarray(arrays[key], np.float32).reshape(-1).tolist()]})

    return found.select("path", "content").mapInPandas(run, "path string, embedding array<float>")


def snapshot(spark: SparkSession, folder: str, names: tuple[str, ...], key: str, metadata: str = "metadata") -> DataFrame:
    """The first of the named snapshots of a folder that is there, with the folder's metadata by key where it has any."""
    found = first_readable(*[lambda n=n: spark.read.parquet(f"{folder}/{n}") for n in names])
    try:
        known = spark.read.parquet(f"{folder}/{metadata}")
    except AnalysisException:
        return found
    return found.join(known.select(key, *[c for c in known.columns if c not in found.columns]), key, "left")


def over_http(url: str, seconds: float) -> bytes:
    """The body at a url; any status but 200 is an error."""
    from urllib.request import urlopen

    with urlopen(url, timeout=seconds) as got:
        if got.status != 200:
            raise OSError(f"status {got.status}")
        return got.read()


def fetched(urls: DataFrame, there: DataFrame | None = None, get: Callable[[str, float], bytes] = over_http, seconds: float = 30.0, tasks: int = 4) -> DataFrame:
    """url, content and error of each distinct url that isn't `there` (url) yet. tasks: how many fetch at once. A url that fails has its error."""
    wanted = urls.select("url").where("url IS NOT NULL").distinct()
    if there is not None:
        wanted = wanted.join(there.select("url"), "url", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for url in rows["url"]:
                try:
                    content, error = get(url, seconds), None
                except OSError as e:
                    content, error = None, str(e)
                yield pd.DataFrame({"url": [url], "content": [content], "error": [error]})

    return wanted.repartition(tasks).mapInPandas(run, "url string, content binary, error string")


def float_vectors(found: DataFrame) -> DataFrame:
    """path and embedding of files (path, content) that hold raw little-endian 32-bit floats or an .npy array."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for rows in frames:
            vectors = []
            for content in rows["content"]:
                whole = np.load(io.BytesIO(content), allow_pickle=False) if content[:6] == b"\x93NUMPY" else np.frombuffer(content, "<f4")
                vectors.append(np.asarray(whole, np.float32).reshape(-1).tolist())
            yield pd.DataFrame({"path": rows["path"], "embedding": vectors})

    return found.where(~F.contains(F.lower("path"), F.lit("metadata"))).select("path", "content").mapInPandas(run, "path string, embedding array<float>")


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a prompts file that aren't empty or comments."""
    return spark.read.text(path).select(F.trim("value").alias("prompt")).where((F.col("prompt") != "") & ~F.startswith("prompt", F.lit("#")))


def log_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """event and numbers of log lines about rates, batch sizes and adjustments."""
    t = F.col(text)
    rate, size = F.regexp_extract(t, r"Processing rate: ([0-9.]+) samples/sec", 1), F.regexp_extract(t, r"Processing batch of size ([0-9]+)", 1)
    old, new = (F.regexp_extract(t, r"Adjusting batch size from ([0-9]+) to ([0-9]+)", k) for k in (1, 2))
    event = F.when(rate != "", "rate").when(size != "", "batch").when(old != "", "adjust")
    number = lambda s: F.when(s != "", s.cast("double"))
    return lines.select(t.alias("line"), event.alias("event"), number(rate).alias("rate"), number(size).alias("size"), number(old).alias("old_size"), number(new).alias("new_size")).where("event IS NOT NULL")


def report_blocks(text: DataFrame, key: str, column: str = "value") -> DataFrame:
    """Scores of a similarity report: a block per query (Query: ...), a line per hit (1. name (Score: 0.12) [MATCH])."""
    blocks = text.select(key, F.posexplode(F.split(F.col(column), r"(?m)^Query: ")).alias("block", "body")).where("block > 0")
    head = F.trim(F.regexp_extract("body", r"^([^\n]*)", 1))
    lines = blocks.select(key, "block", head.alias("query"), F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^\s*([0-9]+\..*\(Score: -?[0-9.]+\).*)$"), F.lit(1))).alias("line"))
    return lines.select(
        key,
        "block",
        "query",
        F.regexp_extract("line", r"^([0-9]+)\.", 1).cast("int").alias("rank"),
        F.trim(F.regexp_extract("line", r"^[0-9]+\.\s*(.*?)\s*\(Score:", 1)).alias("item"),
        F.regexp_extract("line", r"\(Score: (-?[0-9.]+)\)", 1).cast("double").alias("score"),
        F.contains("line", F.lit("MATCH")).alias("is_match"),
    )


def json_fields(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Fields of a JSON column by path, with null where missing: name -> $.path."""
    return df.withColumns({name: F.get_json_object(column, path) for name, path in fields.items()})


def synthetic(spark: SparkSession, n: int, size: int, seed: int = 7) -> DataFrame:
    """n unit vectors (vec_id, embedding) that only depend on seed and id."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda j: F.pmod(F.xxhash64("id", j, F.lit(seed)), F.lit(2001)).cast("double") / 1000 - 1)
    from ..functions.vectors import normalize

    return spark.range(n).select(F.col("id").alias("vec_id"), normalize(raw).alias("embedding"))
