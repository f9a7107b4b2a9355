"""Descriptions of images by a model, with retries; the model is a plug-in, a stand-in serves tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quirefold.config import ATTEMPTS, DESCRIPTION_LENGTHS, FIRST_SEED
from quirefold.functions import text as t

Model = Callable[[bytes, int], str]


def stand_in() -> Model:
    """A deterministic model: a text whose length and words follow from the image's bytes and the seed."""

    def describe(image: bytes, seed: int) -> str:
        digest = hashlib.sha256(image + seed.to_bytes(4, "little")).digest()
        words = ["diagram", "table", "chart", "photo", "figure", "label", "arrow", "panel"]
        return "**" + " ".join(words[b % len(words)] for b in digest * (1 + digest[0] % 3))[: 40 + 8 * digest[1]] + "** #"

    return describe


def data_uri(content: Column, kind: str = "jpeg") -> Column:
    """An encoded image as a data URI; re-encoding belongs to the model's own reader."""
    return F.concat(F.lit(f"data:image/{kind};base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def attempts(images: DataFrame, make_model: Callable[[], Model] = stand_in, tries: int = ATTEMPTS) -> DataFrame:
    """``images(image, content)`` -> ``(image, attempt, seed, description)``: tries until a length fits, the model loaded once a task."""
    low, high = DESCRIPTION_LENGTHS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            rows = []
            for name, content in zip(batch["image"], batch["content"]):
                for k in range(tries):
                    text = model(bytes(content), FIRST_SEED + k)
                    rows.append((name, k + 1, FIRST_SEED + k, text))
                    if low <= len(text) <= high:
                        break
            yield pd.DataFrame(rows, columns=["image", "attempt", "seed", "description"])

    made = images.select("image", "content").mapInPandas(run, "image string, attempt int, seed int, description string")
    return made.withColumn("description", t.clean_description(F.col("description")))
