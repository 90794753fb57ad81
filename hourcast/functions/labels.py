"""Label, id, path and hash scalars (A43–A55) as Column expressions.

Only Unicode NFKD folding needs Python (Spark SQL has no normalisation
function); it runs as an Arrow-batched pandas UDF and everything after it is
a JVM regex expression.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.functions.timecols import _c


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """NFKD, then drop every non-ASCII code point (vectorised over a batch)."""
    def fold(v):
        if v is None:
            return None
        return unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii")
    return s.map(fold)


def slug_ascii(text: str | Column, max_len: int = 64, default: str = "counter") -> Column:
    """NFKD ASCII fold, runs outside ``[A-Za-z0-9-_]`` -> ``_``, collapse,
    trim ``_``, cut to ``max_len``, ``default`` when empty."""
    folded = ascii_fold(_c(text))
    s = F.regexp_replace(folded, r"[^A-Za-z0-9\-_]+", "_")
    s = F.regexp_replace(s, "_+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    s = F.substring(s, 1, max_len)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def slug_label(text: str | Column) -> Column:
    """Like A43 but only alphanumerics survive, no cut, no default."""
    folded = ascii_fold(_c(text))
    s = F.regexp_replace(folded, "[^A-Za-z0-9]+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def slug_id(text: str | Column, max_len: int = 48) -> Column:
    """Trim, runs outside ``[a-zA-Z0-9_.-]`` -> ``-``, trim ``-._``,
    ``unknown`` when empty, cut to ``max_len``."""
    stripped = F.regexp_replace(_c(text), r"^\s+|\s+$", "")
    s = F.regexp_replace(stripped, r"[^a-zA-Z0-9_.\-]+", "-")
    s = F.regexp_replace(s, r"^[-._]+|[-._]+$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(F.substring(s, 1, max_len))


def blank_to_null(c: str | Column) -> Column:
    """Trimmed blank -> null."""
    return F.nullif(F.trim(_c(c)), F.lit(""))


def first_present(*cols: str | Column, default: str = "NA") -> Column:
    """First non-blank value of a priority chain, else ``default``."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(default))


def split_site_orientation(counter_id: str | Column, strict_empty: bool = False):
    """``site_orientation`` -> (site, orientation) with ``NA`` defaults.

    ``strict_empty`` is the second variant where an empty part is also ``NA``.
    """
    parts = F.split(_c(counter_id), "_")
    site = F.element_at(parts, 1)
    orient = F.try_element_at(parts, F.lit(2))
    if strict_empty:
        site = F.coalesce(F.nullif(site, F.lit("")), F.lit("NA"))
        orient = F.coalesce(F.nullif(orient, F.lit("")), F.lit("NA"))
    else:
        orient = F.coalesce(orient, F.lit("NA"))
    return site, orient


def relative_to(path: str | Column, root: str) -> tuple[Column, Column]:
    """(relative path, error) — absolute paths must live under ``root``."""
    p = _c(path)
    prefix = root.rstrip("/") + "/"
    is_abs = p.startswith("/")
    inside = p.startswith(prefix)
    rel = (F.when(~is_abs, p).when(inside, F.substring(p, F.lit(len(prefix) + 1), F.length(p))))
    err = F.when(is_abs & ~inside, F.lit("outside_root"))
    return rel, err


URI_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def local_path_error(path: str | Column, allow_absolute: bool = False) -> Column:
    """Non-empty, no scheme, not absolute (unless allowed), no ``..`` part."""
    p = _c(path)
    err = (F.when(p.isNull(), F.lit(None))
           .when(p == "", F.lit("empty_path"))
           .when(p.rlike(URI_SCHEME), F.lit("scheme_not_allowed")))
    if not allow_absolute:
        err = err.when(p.startswith("/"), F.lit("absolute_path"))
    return err.when(F.array_contains(F.split(p, "/"), ".."), F.lit("parent_traversal"))


def object_uri_error(uri: str | Column) -> Column:
    """``s3://bucket/key`` without credentials; the raw authority is tested
    (``parse_url(.., 'HOST')`` drops a ``user@`` part)."""
    u = _c(uri)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return (F.when(u.isNull(), F.lit(None))
            .when(u == "", F.lit("empty_uri"))
            .when(scheme != "s3", F.lit("scheme_not_s3"))
            .when((authority == "") | (F.trim(authority) != authority), F.lit("missing_bucket"))
            .when((path == "") | (path == "/"), F.lit("missing_key"))
            .when(authority.contains("@"), F.lit("credentials_in_uri")))


def idempotency_key(job_id, job_type, run_id, counter_id, dag_id, task_id, try_number) -> Column:
    """``job_id=<id>`` when given, else the ``|``-joined request fields."""
    # Names and order of the key's fields, and their separator.
    fields = F.concat_ws("|",
                         F.concat(F.lit("job_type="), _c(job_type)),
                         F.concat(F.lit("run_id="), _c(run_id)),
                         F.concat(F.lit("counter_id="), _c(counter_id)),
                         F.concat(F.lit("dag_id="), F.coalesce(_c(dag_id), F.lit(""))),
                         F.concat(F.lit("task_id="), F.coalesce(_c(task_id), F.lit(""))),
                         F.concat(F.lit("try_number="),
                                  F.coalesce(_c(try_number), F.lit(0)).cast("string")))
    jid = blank_to_null(job_id)
    return F.when(jid.isNotNull(), F.concat(F.lit("job_id="), jid)).otherwise(fields)


def job_id(job_id_col, job_type, counter_id, key: Column) -> Column:
    """Given id, else ``job-{type}-{counter}-{sha256(key)[:12]}``."""
    digest = F.substring(F.sha2(key, 256), 1, 12)
    built = F.concat_ws("-", F.lit("job"), slug_id(job_type), slug_id(counter_id), digest)
    return F.coalesce(blank_to_null(job_id_col), built)
