"""Embedding providers: how texts become vectors inside tasks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from lodestone.config import DTYPES, EmbeddingConfig
from lodestone.errors import NavigationError

IMPLEMENTATION = 1


class EmbeddingProvider(Protocol):
    """Made once per task; ``embed`` gets texts of similar length together."""

    fingerprint: str

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


ProviderFactory = Callable[[EmbeddingConfig], EmbeddingProvider]


def fingerprint(config: EmbeddingConfig, implementation: str) -> str:
    """Changes with everything that changes the vectors of a text."""
    facts = {"implementation": implementation, **asdict(config)}
    return hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()


# What the known kinds of model runtimes allow.
POOLED_RUNTIMES = ("transformers", "transformers-core", "direct-ort")
STATIC_RUNTIME = "static-ort"
PLAIN_TEXT_MODELS = ("bge-small-zh", "granite-embedding")


@dataclass(frozen=True)
class RuntimeOptions:
    """Options of a model runtime, filled in and checked against each other."""

    runtime: str
    model: str
    pooling: str | None = None
    dtype: str | None = None
    document_prefix: str = ""
    query_prefix: str = ""

    def __post_init__(self):
        def check(ok: bool, message: str) -> None:
            if not ok:
                raise NavigationError("INVALID_CONFIG", message)

        static = self.runtime == STATIC_RUNTIME
        check(
            self.pooling is None or self.runtime in POOLED_RUNTIMES,
            f"pooling is only supported by {', '.join(POOLED_RUNTIMES)}",
        )
        plain = any(name in self.model.lower() for name in PLAIN_TEXT_MODELS)
        pooling = self.pooling or ("cls" if plain else "mean")
        check(pooling in ("mean", "cls"), "pooling must be mean or cls")
        dtype = self.dtype or ("int8" if static else "q8")
        check(dtype in DTYPES, f"dtype must be one of {', '.join(DTYPES)}")
        if static:
            check(dtype == "int8", f"{STATIC_RUNTIME} requires dtype int8")
            check(
                not self.document_prefix and not self.query_prefix,
                f"{STATIC_RUNTIME} requires empty prefixes",
            )
        object.__setattr__(self, "pooling", pooling)
        object.__setattr__(self, "dtype", dtype)


class HashingProvider:
    """Deterministic vectors from hashed words; stands in for a model."""

    dimension = 64

    def __init__(self, config: EmbeddingConfig):
        self.fingerprint = fingerprint(config, f"hashing-{IMPLEMENTATION}")

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        vectors = np.zeros((len(texts), self.dimension))
        for row, text in enumerate(texts):
            for word in text.lower().split() or [""]:
                digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
                number = int.from_bytes(digest, "big")
                vectors[row, number % self.dimension] += 1 if number >> 63 else -1
            if not vectors[row].any():
                vectors[row, 0] = 1.0
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def embed_column(
    factory: ProviderFactory, config: EmbeddingConfig, text: Column, prefix: str
) -> Column:
    """Vectors of a text column, in batches of texts of similar length."""

    @pandas_udf("array<float>")
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = factory(config)
        for batch in batches:
            texts = [prefix + (value or "") for value in batch]
            order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), i))
            vectors: list = [None] * len(texts)
            for first in range(0, len(order), config.batch_size):
                part = order[first : first + config.batch_size]
                made = provider.embed([texts[i] for i in part])
                if len(made) != len(part):
                    raise NavigationError(
                        "EMBEDDING_COUNT_MISMATCH",
                        f"Expected {len(part)} vectors, received {len(made)}.",
                    )
                for place, vector in zip(part, made, strict=True):
                    vectors[place] = np.asarray(vector, dtype=np.float32)
            yield pd.Series(vectors, index=batch.index)

    return embedded(text)
