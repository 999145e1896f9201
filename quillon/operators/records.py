"""Records: column discovery, defaults, unions, upserts, sampling, reshaping, ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Names under which sources hold an image or a text: fixed values, the first present counts.
IMAGE_NAMES = ["image", "img", "pixel_values", "image_data", "picture"]
TEXT_NAMES = ["text", "caption", "sentence", "description", "label"]


def first_present(df: DataFrame, names: list[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def caption(df: DataFrame) -> Column:
    """The text of a record: the first text column there is, else "A <fine_label>", else "Unknown"."""
    found = [F.col(n).cast("string") for n in TEXT_NAMES if n in df.columns]
    if "fine_label" in df.columns:
        found.append(F.concat(F.lit("A "), F.col("fine_label").cast("string")))
    return F.coalesce(*found, F.lit("Unknown"))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns filled where null, and added where missing."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def absolute(path: Column | str, root: str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def payload(df: DataFrame, vectors: list[str]) -> Column:
    """All other columns as JSON."""
    return F.to_json(F.struct(*[c for c in df.columns if c not in vectors]))


def concatenated(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stacked(frames: dict[str, DataFrame], label: str = "model") -> DataFrame:
    """All frames, each row with the name of its own."""
    return concatenated([df.withColumn(label, F.lit(name)) for name, df in frames.items()])


def interleaved(frames: list[DataFrame], ordinal: str) -> DataFrame:
    """Rows of all frames with seq, which takes one of each in turn."""
    n = len(frames)
    return concatenated([df.withColumn("seq", F.col(ordinal) * n + k) for k, df in enumerate(frames)])


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the latest. An aggregation, so hot keys are combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(table: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The table after the changes: the latest change of a key replaces its row."""
    fresh = latest(changes, key, order)
    return table.join(fresh.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def ids(df: DataFrame, order: list[str], name: str = "id", prefix: str = "") -> DataFrame:
    """Ids from 0 on in the given order. The rows are written once in ranges of the order, each knowing its range and its place there, and
    numbered from the sizes of the ranges before; so all ids come from one division into ranges, and no task holds all rows."""
    spread = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "ranges")
    sizes = spread.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_f"))
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_s", "_f")  # a row a partition
    number = F.col("_m") - F.col("_f") + F.col("_s")
    out = spread.join(F.broadcast(starts), "_p").withColumn(name, F.concat(F.lit(prefix), number.cast("string")) if prefix else number)
    return out.drop("_p", "_m", "_s", "_f")


def missing_ids(df: DataFrame, key: str, source: str) -> DataFrame:
    """Null ids replaced by a hash of the source column."""
    return df.withColumn(key, F.coalesce(F.col(key).cast("string"), F.md5(F.col(source).cast("string"))))


def shuffled_head(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in an order that only depends on key and seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def row_at(df: DataFrame, ordinal: str, k: int) -> DataFrame:
    return df.where(F.col(ordinal) == k)


def zipped(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Both sides by ordinal; complete: whether both have it."""
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), ordinal, "full_outer")
    return both.withColumn("complete", F.col("_l").isNotNull() & F.col("_r").isNotNull()).drop("_l", "_r")


def wide(df: DataFrame, rows: str, columns: str, value: str, names: list | None = None) -> DataFrame:
    """A pivot that keeps the first value of each cell (the least, so that it is defined)."""
    return df.groupBy(rows).pivot(columns, names).agg(F.min(value)) if names else df.groupBy(rows).pivot(columns).agg(F.min(value))


def long(df: DataFrame, keys: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def with_prompts(entries: DataFrame, prompts: list[tuple[str, str]]) -> DataFrame:
    """Every entry with every one of a few prompts (name, prompt)."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("prompt")) for n, p in prompts])
    return entries.select("*", F.explode(rows).alias("_p")).select(*entries.columns, "_p.*")


def existing(df: DataFrame, key: str, listing: DataFrame) -> DataFrame:
    """df with exists: whether its key is listed."""
    seen = listing.select(F.col(key)).distinct().withColumn("_x", F.lit(True))
    return df.join(seen, key, "left").withColumn("exists", F.coalesce("_x", F.lit(False))).drop("_x")


def blank_arrays(df: DataFrame) -> DataFrame:
    """Arrays of numbers as the text "[n float values]"."""
    return df.select(*[F.format_string("[%d float values]", F.size(c)).alias(c) if t.startswith("array<") and t[6:-1] in ("float", "double") else F.col(c) for c, t in df.dtypes])


def _lines(df: DataFrame, order: list[str], top: list[str], left: str, between: str, right: str) -> DataFrame:
    line = F.concat(F.lit(left), F.concat_ws(between, *[F.coalesce(F.col(c).cast("string"), F.lit("N/A")) for c in df.columns]), F.lit(right))
    head = df.sparkSession.createDataFrame([(k - len(top) + 1, t) for k, t in enumerate(top)], "line_no long, line string")
    return head.union(ids(df, order, "line_no").select((F.col("line_no") + 1).alias("line_no"), line.alias("line")))


def markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """line_no and line of a markdown table: head and rule at -1 and 0, rows from 1 on; null: N/A."""
    return _lines(df, order, ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)], "| ", " | ", " |")


def latex(df: DataFrame, order: list[str]) -> DataFrame:
    """line_no and line of the body of a LaTeX table, in the same order."""
    return _lines(df, order, [" & ".join(df.columns) + r" \\", r"\hline"], "", " & ", r" \\")


def rows_at(df: DataFrame, ordinal: str, asked: DataFrame) -> DataFrame:
    """The row at each asked ordinal; found: whether it lies within bounds."""
    return asked.join(df.withColumn("_there", F.lit(True)), ordinal, "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")


def with_payload(df: DataFrame, fields: dict[str, Column], payload: Column) -> DataFrame:
    """entry: the fields as a map of strings, with the payload's (a map) over them where both have a key."""
    own = F.create_map(*[x for name, c in fields.items() for x in (F.lit(name), c.cast("string"))])
    extra = F.coalesce(payload, F.create_map().cast("map<string,string>"))
    return df.withColumn("entry", F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(extra, k)), extra))
