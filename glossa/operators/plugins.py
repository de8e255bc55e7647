"""Plug-ins by name: readers, writers, tokenizers, token factories, feature factories, scorers; and readers as table functions."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import evaluate, features
from glossa.sources import readers, writers

KINDS: dict[str, dict[str, Callable]] = {
    "reader": dict(readers.READERS),
    "writer": dict(writers.WRITERS),
    "tokenizer": {"plain": lambda c: T.tokens(c), "rich": lambda c: T.tokens(c, T.RICH_TOKEN), "space": T.whitespace_tokens},
    "token": {"word": lambda w, i: w, "indexed": lambda w, i: F.struct((i + 1).alias("idx"), w.alias("word")), "shaped": lambda w, i: F.struct(w.alias("word"), T.shape_dan2(w).alias("shape"))},
    "features": features.REGISTRY,
    "scorer": {"entities": evaluate.entity_scores, "labels": evaluate.label_scores, "accuracy": evaluate.token_accuracy},
}


def register(kind: str, name: str, f: Callable) -> None:
    """Adds a plug-in under a name; a name that is taken raises."""
    if name in KINDS[kind]:
        raise ValueError(f"there is a {kind} named {name}")
    KINDS[kind][name] = f


def named(kind: str, name: str) -> Callable:
    """A plug-in by its registered name, or any function by `module:function`."""
    if name in KINDS[kind]:
        return KINDS[kind][name]
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"no {kind} named {name}; there are {sorted(KINDS[kind])}")
    return getattr(importlib.import_module(module), function)


def read(df: DataFrame, reader: str, **options) -> DataFrame:
    return named("reader", reader)(df, **options)


def write_lines(df: DataFrame, writer: str, **options) -> DataFrame:
    return named("writer", writer)(df, **options)


def tokenise(docs: DataFrame, tokenizer: str = "plain", token: str = "word", text: str = "text") -> DataFrame:
    """(doc_id, pos, tok): tokens made by a tokenizer and a token factory, both by name."""
    make: Callable[[Column, Column], Column] = named("token", token)
    words = named("tokenizer", tokenizer)(F.col(text))
    return docs.select("doc_id", F.posexplode(F.transform(words, make)).alias("pos", "tok"))


def table_function(name: str, make: Callable[[str], Iterator[tuple]], schema: str):
    """An iterator over objects read from a text as a table function of that name's text argument: `SELECT ... FROM t, LATERAL name(t.text)`."""

    @F.udtf(returnType=schema)
    class Reader:
        def eval(self, text: str):
            if text is not None:
                yield from make(text)

    def install(spark: SparkSession) -> None:
        spark.udtf.register(name, Reader)

    return install
