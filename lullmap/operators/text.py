"""Table jobs over names, addresses and text output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullmap.functions import failures, names, urls


def with_canonical_url(df: DataFrame, url: str, out: str = "url_key") -> DataFrame:
    """Add the key shared by all addresses of one resource."""
    split = df.withColumn("__parts", urls.url_parts(F.col(url)))
    return split.withColumn(out, urls.canonical_url(F.col(url), F.col("__parts"))).drop("__parts")


def dedupe_by_url(df: DataFrame, url: str, order: Sequence[str]) -> DataFrame:
    """One row per canonical address, the first by ``order``; adds ``url_key``.

    The first row is found by an aggregate that combines before the exchange, so a heavily
    repeated address costs no more than any other.
    """
    row = F.struct(*df.columns)
    return (
        with_canonical_url(df, url)
        .groupBy("url_key")
        .agg(F.min_by(row, F.struct(*order)).alias("r"))
        .select("url_key", "r.*")
    )


def redact(df: DataFrame, column: str, hits: str = "hits", secrets: Sequence[str] = ()) -> DataFrame:
    """Replace secrets in a text column and count the places changed."""
    clean = urls.redact_text(F.col(column), secrets)
    gone = lambda c: F.length(c) - F.length(F.replace(c, F.lit(urls.HIDDEN), F.lit("")))
    count = lambda c: F.call_function("div", gone(c), F.lit(len(urls.HIDDEN))).cast("int")
    before, after = count(F.col(column)), count(F.col("__clean"))
    return (
        df.withColumn("__clean", clean)
        .withColumn(hits, F.coalesce(F.greatest(F.lit(0), after - before), F.lit(0)))
        .withColumn(column, F.col("__clean"))
        .drop("__clean")
    )


def with_identity(
    df: DataFrame, name: str, namespace: str | None = None, out: str = "identity"
) -> DataFrame:
    """Add the stable identity of a name: run suffix removed, made safe, namespaced."""
    stem = df.withColumn("__stem", names.strip_run_suffix(F.col(name)))
    stem = names.fold_non_ascii(stem, "__stem", "__folded", idna=False)
    # Both are folded first: Spark joins all projections below a Python step into one expression.
    if namespace:
        stem = names.fold_non_ascii(stem, namespace, "__site", idna=True)
    stem = names.canonical_stem(stem, "__stem", "__folded", "__key")
    site: Column = F.lit(None).cast("string")
    if namespace:
        stem = names.canonical_namespace(stem, "__site", "__space")
        site = F.when(F.col(namespace) != "", F.col("__space"))
    return stem.withColumn(out, names.identity_key(site, F.col("__key"))).drop(
        "__stem", "__folded", "__key", "__site", "__space"
    )


def identity_collisions(df: DataFrame, name: str, namespace: str | None = None) -> DataFrame:
    """Identities shared by several distinct names: how many, and the first and last of them."""
    raw = [c for c in (namespace, name) if c]
    distinct = with_identity(df.select(*raw).distinct(), name, namespace)
    return (
        distinct.groupBy("identity")
        .agg(
            F.count(F.lit(1)).alias("names"),
            F.min(name).alias("first_name"),
            F.max(name).alias("last_name"),
        )
        .filter(F.col("names") > 1)
    )


def artifact_keys(df: DataFrame, path: str, out: str = "artifact") -> DataFrame:
    """Add ``<stem>_<hash>`` of a file path; equal stems in different folders stay apart."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")
    staged = df.withColumn("__name", stem)
    staged = staged.withColumn("__stem", names.strip_run_suffix(F.col("__name")))
    staged = names.fold_non_ascii(staged, "__stem", "__folded", idna=False)
    staged = names.canonical_stem(staged, "__stem", "__folded", "__key")
    return staged.withColumn(out, names.path_key(F.col(path), F.col("__key"))).drop("__name", "__stem", "__folded", "__key")


def with_failure_class(
    runs: DataFrame, text: str, code: str | None = None, rules=failures.TEXT_RULES
) -> DataFrame:
    """Add ``failure``: ``out_of_memory`` by exit code or marker, else the first text rule."""
    named = failures.classify_text(F.col(text), rules)
    if code:
        named = F.when(
            failures.out_of_memory(F.col(code), F.col(text)), F.lit("out_of_memory")
        ).otherwise(named)
    message = F.when(F.col("failure") == failures.GENERIC, failures.generic_message(F.col(text)))
    return runs.withColumn("failure", named).withColumn("message", message)


def failure_breakdown(
    runs: DataFrame, text: str, code: str | None = None, by: Sequence[str] = (), rules=failures.TEXT_RULES
) -> DataFrame:
    """Number of runs by failure class."""
    return (
        with_failure_class(runs, text, code, rules)
        .groupBy(*by, "failure")
        .agg(F.count(F.lit(1)).alias("runs"))
    )


def listing_urls(df: DataFrame, url: str) -> DataFrame:
    """Rows whose address is a listing, with its ``family``, ``name`` and ``tab``."""
    found = df.withColumn("__l", urls.classify_listing_url(F.col(url)))
    return found.filter(F.col("__l").isNotNull()).select(*df.columns, "__l.*")
