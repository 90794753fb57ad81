"""Line scan over document text.

Each document is split into lines with ``posexplode`` (parallel across
documents, whole texts), allow-listed terms are blanked, and a single regex
flags candidate lines.  Word boundaries follow Python's Unicode ``\\b``
(letters, digits and ``_`` are word characters) and are written without
look-arounds so the same pattern runs in Java and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms that are allowed (external dataset column names).
ALLOWED_TERMS = ["date_et_heure_de_comptage", "comptage_horaire",
                 "nom_du_site_de_comptage", "orientation_compteur"]
# The flagged word patterns, matched case-insensitively.
FLAGGED_WORDS = [r"Vérif(?:ie|iez|ication)", r"droits?", r"écriture", r"lecture",
                 r"inaccessible", r"compteurs?", r"prédictions?", r"installés?",
                 r"depuis", r"uniquement"]

WORD = r"[\p{L}\p{N}_]"
LINE_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"
SPACE = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def flag_pattern(words=FLAGGED_WORDS, java: bool = True) -> str:
    """Case-insensitive alternation between non-word characters.

    Java needs the ``u`` flag for Unicode case folding (É/é); RE2 folds
    Unicode under ``i`` alone and rejects ``u``.
    """
    alt = "|".join(words)
    flags = "(?iu)" if java else "(?i)"
    return f"{flags}(^|[^\\p{{L}}\\p{{N}}_])({alt})($|[^\\p{{L}}\\p{{N}}_])"


def strip_text(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def sanitize(c: Column, allowed=ALLOWED_TERMS) -> Column:
    for term in allowed:
        c = F.replace(c, F.lit(term), F.lit(""))
    return c


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, *[c for c in docs.columns if c not in (id_col, text_col)],
                       F.posexplode(F.split(F.col(text_col), LINE_BREAK)).alias("_pos", "line")) \
        .withColumn("line_no", (F.col("_pos") + 1).cast("bigint")).drop("_pos")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words=FLAGGED_WORDS) -> DataFrame:
    """All lines with a ``flagged`` column and the ``path:line: text`` finding."""
    ln = lines(docs, id_col, text_col)
    flagged = sanitize(F.col("line")).rlike(flag_pattern(words))
    finding = F.concat_ws(": ", F.concat_ws(":", F.col(id_col).cast("string"),
                                            F.col("line_no").cast("string")),
                          strip_text(F.col("line")))
    return ln.withColumns({"flagged": flagged, "finding": finding})
