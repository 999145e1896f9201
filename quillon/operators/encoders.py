"""Encoders, scorers and generators as pluggable vectorised functions, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_after

Encoder = Callable[[list[str]], np.ndarray]
_encoders: dict[str, Callable[[], Encoder]] = {}
_default: list[str] = []


def hashing_encoder(size: int = 64) -> Encoder:
    """Texts as unit vectors of hashed words: the stand-in for a neural encoder."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = hashlib.md5(w.encode()).digest()
                out[k, int.from_bytes(h[:4], "little") % size] += 1 if h[4] & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def register(name: str, make: Callable[[], Encoder], default: bool = False) -> None:
    """Makes an encoder known; make is called once a task. Registering a name again replaces it."""
    _encoders[name] = make
    if default or not _default:
        _default[:] = [name]


def unregister(name: str) -> None:
    _encoders.pop(name, None)
    if _default == [name]:
        _default[:] = [next(iter(_encoders))] if _encoders else []


def models() -> list[str]:
    return sorted(_encoders)


register("hashing", hashing_encoder, default=True)


def encode(df: DataFrame, key: str, text: str, model: str | None = None, batch: int = 32) -> DataFrame:
    """key and embedding of each text. The encoder sees `batch` texts at a time; a null text, or one the encoder fails on, gets the zero vector."""
    make = _encoders[model or _default[0]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = make()
        size = own([""]).shape[1]
        for rows in frames:
            out: list[list[float]] = []
            for k in range(0, len(rows), batch):
                part = rows[text].iloc[k : k + batch]
                try:
                    found = np.where(part.isna().to_numpy()[:, None], 0.0, own(part.fillna("").tolist()))
                except ValueError:
                    found = np.zeros((len(part), size))
                out.extend(found.tolist())
            yield pd.DataFrame({key: rows[key], "embedding": out})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<double>")


def score_pairs(pairs: DataFrame, left: str, right: str, scorer: Callable[[list[str], list[str]], np.ndarray]) -> DataFrame:
    """pairs with score: a cross-encoder's view of both texts."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(scorer(a.fillna("").tolist(), b.fillna("").tolist()))

    return pairs.withColumn("score", score(left, right))


def generated(rows: DataFrame, image: str, prompt: str, generate: Callable[[list, list[str]], list[str]]) -> DataFrame:
    """rows with output: what a generator says to (image, prompt), without the prompt that it repeats; where it fails, "Error: " and why."""

    @F.pandas_udf("string")
    def said(images: pd.Series, prompts: pd.Series) -> pd.Series:
        try:
            return pd.Series(generate(images.tolist(), prompts.fillna("").tolist()))
        except (ValueError, RuntimeError) as e:
            return pd.Series([f"Error: {e}"] * len(prompts))

    missing = F.when(F.col(image).isNull(), F.lit("No image available for processing"))
    return rows.withColumn("output", missing.otherwise(answer_after(said(image, prompt), F.coalesce(prompt, F.lit("")))))


def overlap_scorer(left: list[str], right: list[str]) -> np.ndarray:
    """Share of common words: the stand-in for a cross-encoder."""
    sets = [(set(a.lower().split()), set(b.lower().split())) for a, b in zip(left, right, strict=True)]
    return np.array([len(a & b) / len(a | b) if a | b else 0.0 for a, b in sets])


def timed(frames: Iterator[pd.DataFrame], work: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Applies work batch by batch and yields a telemetry row (batch_size, processing_time) for each."""
    import time

    for rows in frames:
        began = time.perf_counter()
        work(rows)
        yield pd.DataFrame({"batch_size": [len(rows)], "processing_time": [time.perf_counter() - began]})


def projected(df: DataFrame, vec: str, k: int = 2) -> DataFrame:
    """df with its principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    fit = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows := df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>"))))
    return fit.transform(rows).withColumn("components", vector_to_array("_p")).drop("_v", "_p")

