"""What Spark has no exact expression for: case folding, NFKC, difflib's ratio, HTML references, JSON tails.

Arrow batches in, Arrow batches out; texts are Python objects in parts of SLICE_BYTES. Ratios are computed once for each distinct pair of a batch.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

#: Bytes of text that are Python objects at once, about; a longer text stands alone.
SLICE_BYTES = 2_000_000


def by_slices(x: pa.Array, one: Callable[[str], str]) -> pa.Array:
    """one of each text, null for null, so that a worker's memory beside its batch follows neither its rows nor their lengths."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(x), 0), np.int64)
    cuts = np.nonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES, prepend=-1))[0].tolist()
    parts = (x.slice(a, b - a) for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True)) if len(x) else ()
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if s is None else one(s) for s in part.to_pylist()], pa.string()) for part in parts)])


@F.arrow_udf(StringType())
def casefold(x: pa.Array) -> pa.Array:
    return by_slices(x, lambda s: " ".join(s.split()).casefold())


@F.arrow_udf(StringType())
def folded_title_key(x: pa.Array) -> pa.Array:
    return by_slices(x, lambda s: re.sub("[^a-z0-9]+", " ", s.casefold()).strip())


def row_key(excerpt: Column, source: Column, target: Column) -> Column:
    """The exact key of a row: excerpt and both titles, case folded."""
    return F.struct(casefold(excerpt).alias("excerpt_key"), folded_title_key(source).alias("source_key"), folded_title_key(target).alias("target_key"))


@F.arrow_udf(StringType())
def entity_title(x: pa.Array) -> pa.Array:
    return by_slices(x, lambda s: " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", s).casefold())))


@F.arrow_udf(StringType())
def unescaped(x: pa.Array) -> pa.Array:
    return by_slices(x, lambda s: html.unescape(s))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio with a before b (it is not symmetric); null if either is null."""
    known: dict[tuple[str, str], float] = {}
    matcher = SequenceMatcher()

    def ratio(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if (got := known.get((x, y))) is None:
            matcher.set_seqs(x, y)
            got = known[x, y] = matcher.ratio()
        return got

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """A bound that needs lengths only: ratio <= 2 min / (sum)."""
    la, lb = F.char_length(a), F.char_length(b)
    return 2.0 * F.least(la, lb) >= F.lit(threshold) * (la + lb)


def is_similar(a: Column, b: Column, threshold: float = 0.8, strict: bool = True) -> Column:
    """Whether the lower-cased strings' ratio is above (strict) or at least the threshold."""
    x, y = F.lower(a), F.lower(b)
    score = F.when(may_reach(x, y, threshold), sequence_ratio(x, y)).otherwise(F.lit(0.0))
    return score > threshold if strict else score >= threshold


def similar_to_any(titles: Sequence[str], threshold: float = 0.8):
    """A function of a string column: whether its lower-cased ratio with one of the titles is above the threshold."""
    lowered = [t.lower() for t in titles]

    def near(x: str | None) -> bool | None:
        if x is None:
            return None
        x = x.lower()
        return any(2 * min(len(x), len(t)) > threshold * (len(x) + len(t)) and SequenceMatcher(None, x, t).ratio() > threshold for t in lowered)

    @F.pandas_udf(BooleanType())
    def compare(x: pd.Series) -> pd.Series:
        return x.map(near)

    return compare


def _last_object(text: str, wanted) -> str | None:
    decoder = json.JSONDecoder()
    for at in range(len(text) - 1, -1, -1):
        if text[at] == "{":
            try:
                value, _ = decoder.raw_decode(text, at)
            except ValueError:
                continue
            if wanted(value):
                return json.dumps(value, ensure_ascii=False)
    return None


@F.pandas_udf(StringType())
def last_action(x: pd.Series) -> pd.Series:
    """The last JSON object in a text that has an action with a name."""
    return x.map(lambda s: None if s is None else _last_object(s, lambda v: isinstance(v, dict) and isinstance(v.get("action"), dict) and "name" in v["action"]))


@F.pandas_udf(StringType())
def last_json_block(x: pd.Series) -> pd.Series:
    """The last balanced {...} of a text, by counting braces from its end."""

    def block(s: str | None) -> str | None:
        if s is None or (end := s.rfind("}")) < 0:
            return None
        depth = 0
        for at in range(end, -1, -1):
            depth += (s[at] == "}") - (s[at] == "{")
            if depth == 0:
                return s[at : end + 1]
        return None

    return x.map(block)
