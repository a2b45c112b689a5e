"""Places for a user's own functions: embedding of texts, generation of articles, and the loop that improves them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.hashing import hash_embedding
from storyloom.sources.shared import cut

#: From a list of texts to a matrix with a row for each.
Embedder = Callable[[list[str]], np.ndarray]
#: From rows (as a pandas frame) to the same rows with new texts.
Provider = Callable[[pd.DataFrame], pd.DataFrame]

_PROVIDERS: dict[str, Provider] = {}


def embed(items: DataFrame, text: Column, embedder: Embedder | None = None, id_col: str = "item_id") -> DataFrame:
    """``id, v``: the vector of each text. Without an embedder, the stand-in that hashes the text (native)."""
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    if embedder is None:
        return rows.select("id", hash_embedding(F.col("text")).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                made = np.asarray(embedder(b["text"].tolist()), float)
                yield pd.DataFrame({"id": b["id"], "v": list(made)})

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>")


def register(name: str, provider: Provider) -> None:
    """Make a provider known by name."""
    _PROVIDERS[name] = provider


def provider(name: str) -> Provider:
    try:
        return _PROVIDERS[name]
    except KeyError:
        raise ValueError(f"no provider named {name!r}; there are {sorted(_PROVIDERS)}") from None


def generate(rows: DataFrame, make: Provider) -> DataFrame:
    """The rows after the provider, batch by batch; it must keep their columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield make(b)[list(b.columns)] if len(b) else b

    return rows.mapInPandas(run, rows.schema)


def improve(rows: DataFrame, key: str, make: Provider, score: Callable[[DataFrame], Column], least: float = 75.0, rounds: int = 3) -> DataFrame:
    """The best version of each row after ``rounds`` generations at most, with ``score`` and ``iterations``.

    A row whose score reaches ``least`` isn't generated again; among versions of equal score the earliest stays.
    """
    best = cut(rows.withColumns({"score": score(rows).cast("double"), "iterations": F.lit(0)}), "best")
    for k in range(1, rounds + 1):
        if best.filter(F.col("score") < least).limit(1).count() == 0:
            break
        made = generate(best.filter(F.col("score") < least).select(rows.columns), make)
        new = made.withColumns({"score": score(made).cast("double"), "iterations": F.lit(k)})
        columns = [c for c in best.columns if c != key]
        old, fresh = best.select(key, F.struct(*columns).alias("_o")), new.select(key, F.struct(*columns).alias("_n"))
        kept = F.when(F.col("_n").isNotNull() & (F.col("_n.score") > F.col("_o.score")), F.col("_n")).otherwise(F.col("_o"))
        best = cut(old.join(fresh, key, "left").select(key, kept.alias("_k")).select(key, "_k.*").select(best.columns), "best")
    return best


def _template(b: pd.DataFrame) -> pd.DataFrame:
    """A provider that writes no text of its own: white space squeezed in all texts."""
    out = b.copy()
    for c in out.columns:
        if out[c].map(lambda x: isinstance(x, str)).any():
            out[c] = out[c].map(lambda x: " ".join(x.split()) if isinstance(x, str) else x)
    return out


register("plain", _template)
