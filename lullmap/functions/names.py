"""Stable names for series and artifacts as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters a name may hold, names a file system reserves, lengths.
UNSAFE = r"[^A-Za-z0-9._-]+"
EDGES = r"^[._-]+|[._-]+$"
RESERVED = r"^(?i:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\..*)?$"
RUN_SUFFIX = r"-\d{10}(?:-[0-9a-f]{8})?$"
NAMESPACE_MAX, STEM_MAX = 32, 80
EMPTY_NAMESPACE, EMPTY_STEM = "site", "id"
HASH_LEN = 8


@F.pandas_udf(StringType())
def _folded(raw: pd.Series) -> pd.Series:
    return raw.map(lambda t: None if t is None else t.casefold())


@F.pandas_udf(StringType())
def _idna_folded(raw: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            text = text.encode("idna").decode("ascii")
        except UnicodeError:
            pass
        return text.casefold()

    return raw.map(one)


def fold_non_ascii(df, column: str, out: str, idna: bool):
    """Add the case-folded (and IDNA-encoded) form of a column.

    ASCII text is folded by Spark; other text goes to Python in Arrow batches (in which the
    ASCII rows are null), because Spark has neither IDNA nor full case folding. ``encode("idna")`` also rejects labels
    of an odd length, which keeps ASCII text unchanged either way.
    """
    plain = F.col(column).rlike(r"^\p{ASCII}*$")
    fold = _idna_folded if idna else _folded
    other = fold(F.when(~plain, F.col(column)))
    return df.withColumn(out, F.when(plain, F.lower(column)).otherwise(other))


def _short(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, HASH_LEN)


def _canonical(df: DataFrame, raw: str, folded: str, out: str, empty: str, longest: int) -> DataFrame:
    """Add a safe name of ``folded``, with a hash of ``raw`` when anything changed or the name is too long.

    Each step is a column that the next ones use several times: nested in one expression, the
    patterns would be copied for every use, more than compiled code can hold.
    """
    kept, named, safe, marked = map(F.col, ("__kept", "__named", "__safe", "__marked"))
    steps = {
        "__kept": F.regexp_replace(F.regexp_replace(folded, UNSAFE, "_"), EDGES, ""),
        "__named": F.when(kept == "", F.lit(empty)).otherwise(kept),
        "__safe": F.when(named.rlike(RESERVED), F.concat(F.lit("_"), named)).otherwise(named),
        "__marked": F.when(
            (F.col(folded) != F.col(raw)) | (safe != F.col(folded)), F.concat(safe, F.lit("_"), _short(F.col(raw)))
        ).otherwise(safe),
        out: F.when(
            F.length(marked) > longest,
            F.concat(F.substring(marked, 1, longest - HASH_LEN - 1), F.lit("_"), _short(marked)),
        ).otherwise(marked),
    }
    for name, step in steps.items():
        df = df.withColumn(name, step)
    return df.drop("__kept", "__named", "__safe", "__marked")


def canonical_namespace(df: DataFrame, folded: str, out: str) -> DataFrame:
    """Add the safe site name of an already folded text, hashed when anything was replaced."""
    return _canonical(df, folded, folded, out, EMPTY_NAMESPACE, NAMESPACE_MAX)


def canonical_stem(df: DataFrame, raw: str, folded: str, out: str) -> DataFrame:
    """Add the safe id of a text, hashed from the original when case or characters changed."""
    return _canonical(df, raw, folded, out, EMPTY_STEM, STEM_MAX)


def strip_run_suffix(c: Column) -> Column:
    """Name without its per-run ``-<10 digits>[-<8 hex>]`` tail, unless nothing is left."""
    bare = F.regexp_replace(c, RUN_SUFFIX, "")
    return F.when(bare == "", c).otherwise(bare)


def identity_key(namespace: Column, stem: Column) -> Column:
    """``<namespace>_<stem>``, or the stem alone without a namespace."""
    return F.when(
        namespace.isNotNull() & (namespace != ""), F.concat_ws("_", namespace, stem)
    ).otherwise(stem)


def path_key(path: Column, stem: Column) -> Column:
    """``<stem>_<first 8 of sha256(path)>``."""
    return F.concat_ws("_", stem, F.substring(F.sha2(path, 256), 1, HASH_LEN))
