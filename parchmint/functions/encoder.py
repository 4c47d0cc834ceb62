"""Sentence encoders as Column functions: a model is loaded once in each worker, and sentences come in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH = 64


def encoder(load: Callable[[], Callable[[list[str]], list]], batch: int = BATCH) -> Callable[[Column], Column]:
    """A function of a column of sentences to one of vectors. load() gives a function of a list of sentences to vectors."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for part in parts:
            values = part.fillna("").tolist()
            out: list = []
            for i in range(0, len(values), batch):
                out += [[float(x) for x in v] for v in encode(values[i : i + batch])]
            yield pd.Series(out)

    return run


def sentence_transformer(name: str = "paraphrase-multilingual-MiniLM-L12-v2", batch: int = BATCH) -> Callable[[Column], Column]:
    """The encoder of that name; the library sentence_transformers must be on the executors."""

    def load():
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError("this encoder needs the library sentence_transformers") from e
        model = SentenceTransformer(name)
        return lambda values: model.encode(values, batch_size=batch, convert_to_numpy=True)

    return encoder(load, batch)
