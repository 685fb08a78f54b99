"""Encoders of log rows into numeric features, with a fitted vocabulary."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.functions.expr import flag, known, list_items, list_stats, missing, number_or_zero, one_hot, zero_activity

_WHO = ("ts", "uid", "orig_h", "orig_p", "resp_h", "resp_p")
#: Fixed values, per log type: columns that no model sees, numbers (each with a mark where it is missing), flags and categories.
DROPPED = {
    "CONN": (*_WHO, "tunnel_parents", "ip_proto", "history"),
    "DNS": (*_WHO, "trans_id", "query"),
    "SSL": (*_WHO, "server_name", "last_alert", "next_protocol", "cert_chain_fps", "client_cert_chain_fps", "ssl_history"),
    "HTTP": (*_WHO, "method", "host", "uri", "referrer", "version", "user_agent", "origin", "status_msg", "username", "password", "orig_fuids", "orig_filenames", "orig_mime_types", "resp_fuids", "resp_filenames", "resp_mime_types"),
}
NUMBERS = {"CONN": ("duration", "orig_bytes", "resp_bytes", "missed_bytes", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes"), "DNS": ("rtt", "qclass", "qtype", "rcode", "Z")}
FLAGS = {"CONN": ("local_orig", "local_resp"), "DNS": ("AA", "TC", "RD", "RA", "rejected"), "SSL": ("resumed", "established", "sni_matches_cert")}
CATEGORIES = {"CONN": ("proto", "service", "conn_state"), "DNS": ("proto", "qclass_name", "qtype_name", "rcode_name"), "SSL": ("version", "cipher", "curve")}
#: Most values of a column that are made columns of their own; beyond, ``encode_sparse`` keeps every value.
MAX_WIDE = 1000


def fit_vocabulary(df: DataFrame, columns: list[str] | str, most: int = MAX_WIDE) -> dict[str, list[str]]:
    """Every value of each column, in order of name; a column with more than ``most`` is an error.

    ``columns`` may be a log type: its categories, as far as the rows have them.
    """
    out = {}
    for c in [c for c in CATEGORIES.get(columns, ()) if c in df.columns] if isinstance(columns, str) else columns:
        values = sorted(r["v"] for r in df.select(known(F.col(c)).alias("v")).distinct().limit(most + 1).collect())
        if len(values) > most:
            raise ValueError(f"column {c} has more than {most} values: use encode_sparse")
        out[c] = values
    return out


def encode_sparse(df: DataFrame, columns: list[str], fitted: PipelineModel | None = None) -> tuple[DataFrame, PipelineModel]:
    """Add ``<column>_hot``, a sparse one-hot vector over all values of the column, however many; unknown ones are all zeros."""
    ready = df.withColumns({f"__{c}": known(F.col(c).cast("string")) for c in columns})
    if fitted is None:
        index = StringIndexer(inputCols=[f"__{c}" for c in columns], outputCols=[f"__{c}_at" for c in columns], handleInvalid="keep", stringOrderType="alphabetAsc")
        hot = OneHotEncoder(inputCols=[f"__{c}_at" for c in columns], outputCols=[f"{c}_hot" for c in columns], dropLast=True)
        fitted = Pipeline(stages=[index, hot]).fit(ready)
    return fitted.transform(ready).drop(*(f"__{c}{x}" for c in columns for x in ("", "_at"))), fitted


def _encode(df: DataFrame, kind: str, categories: dict[str, list[str]], keep: tuple[str, ...]) -> DataFrame:
    """Rows as ``logs.read_log`` types them, or with every column as text, in numbers; columns that are not there are left out."""
    numbers, flags = ([c for c in names.get(kind, ()) if c in df.columns] for names in (NUMBERS, FLAGS))
    out = df.withColumns({f"{c}_missing": missing(F.nullif(F.col(c).cast("string"), F.lit("-"))) for c in numbers}) if numbers else df
    out = out.withColumns({c: number_or_zero(F.col(c).cast("string")) for c in numbers} | {c: flag(F.col(c)) for c in flags})
    hot = [x for c, values in categories.items() for x in one_hot(known(F.col(c)), values, c)]
    return out.select("*", *hot).drop(*(c for c in DROPPED[kind] if c not in keep), *categories)


def encode_conn(df: DataFrame, categories: dict[str, list[str]], keep: tuple[str, ...] = (), complete: bool = False, activity: bool = False) -> DataFrame:
    """Connection rows; with ``complete`` only those whose byte counts are known, with ``activity`` a mark where both are 0."""
    whole = df.dropna(subset=["orig_bytes", "resp_bytes"]) if complete else df
    ready = whole.withColumn("zero_activity", zero_activity(F.col("orig_bytes"), F.col("resp_bytes"))) if activity else whole
    return _encode(ready, "CONN", categories, keep)


def _items(df: DataFrame, c: str) -> Column:
    """A list column, an array or text, as an array; none where it is unset."""
    kind = df.schema[c].dataType
    return F.coalesce(F.col(c), F.array().cast(kind)) if isinstance(kind, T.ArrayType) else list_items(F.nullif(F.col(c), F.lit("-")))


def encode_dns(df: DataFrame, categories: dict[str, list[str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """DNS rows: answers become counts, times to live their statistics."""
    answers, ttls = _items(df, "answers"), _items(df, "TTLs")
    stats = list_stats(ttls)
    ready = df.withColumns({
        "answers_count": F.size(answers),
        "answers_unique_count": F.size(F.array_distinct(answers)),
        "answers_has_ipv6": F.coalesce(F.exists(answers, lambda x: F.contains(x, F.lit(":"))), F.lit(False)).cast("int"),
        "ttls_mean": stats["mean"],
        "ttls_std": stats["std"],
        "ttls_count": stats["count"],
        "answers_ttls_mismatch": (F.size(answers) != F.size(ttls)).cast("int"),
    }).drop("answers", "TTLs")
    return _encode(ready, "DNS", categories, keep)


def encode_ssl(df: DataFrame, categories: dict[str, list[str]], keep: tuple[str, ...] = ()) -> DataFrame:
    return _encode(df, "SSL", categories, keep)


def encode_http(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """HTTP rows lose their identifiers and free text; nothing else is encoded."""
    return df.drop(*(c for c in DROPPED["HTTP"] if c not in keep))


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """The training columns in their order; ones that are missing are 0."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(0).alias(c) for c in columns))
