"""Column expressions for cleaning search hits and formatting results.

All are built-in Spark expressions (JVM side, inside whole-stage codegen);
no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
PUBMED_ID_PATTERN = r"pubmed\.ncbi\.nlm\.nih\.gov/(\d+)/?"
PUBMED_SOURCE = "pubmed.ncbi.nlm.nih.gov"
TITLE_SUFFIX = " - PubMed"
ABSTRACT_HEADING = "## Abstract\n\n"
# Body runs lazily up to the next "\n## " heading or the end of the text.
ABSTRACT_PATTERN = r"(?s)## Abstract\n\n(.*?)(?=\n## |\z)"
DESCRIPTION_MIN_CHARS = 80          # fallback needs strictly more characters
ABSTRACT_METADATA_LIMIT = 500
MAX_RESULTS_PER_QUERY = 20
LOW_CONFIDENCE = 0.5
HEALTHY_NOISE_PCT = 15.0
DEFAULT_TOP_K = 5
# ---------------------------------------------------------------------------

# Characters Python's str.strip() removes (str.isspace), as a regex class that
# both Java regex and RE2 accept.
_WS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
       r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
STRIP_PATTERN = rf"^{_WS}+|{_WS}+\z"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Python ``str.strip()`` semantics (all Unicode whitespace, both ends)."""
    return F.regexp_replace(_c(x), STRIP_PATTERN, "")


def canonical_url(url) -> Column:
    """Drop everything from the first ``?`` (a ``#`` fragment is kept)."""
    return F.substring_index(_c(url), "?", 1)


def extract_id(url, pattern: str = PUBMED_ID_PATTERN) -> Column:
    """First match of ``pattern`` group 1 in the canonical URL; '' when absent."""
    return F.regexp_extract(canonical_url(url), pattern, 1)


def extract_abstract(content, description) -> Column:
    """Abstract under the ``## Abstract`` heading, stripped; else the stripped
    description when longer than 80 characters; else NULL.

    A heading with an empty body yields '' and does not fall back."""
    c = F.coalesce(_c(content), F.lit(""))
    d = py_strip(F.coalesce(_c(description), F.lit("")))
    body = py_strip(F.regexp_extract(c, ABSTRACT_PATTERN, 1))
    return (F.when(c.contains(ABSTRACT_HEADING), body)
             .when(F.length(d) > DESCRIPTION_MIN_CHARS, d)
             .otherwise(F.lit(None).cast("string")))


def strip_title_suffix(title, suffix: str = TITLE_SUFFIX) -> Column:
    """``title.removesuffix(suffix).strip()`` — suffix removal before strip."""
    t = F.coalesce(_c(title), F.lit(""))
    cut = F.when(t.endswith(suffix), t.substr(F.lit(1), F.length(t) - F.lit(len(suffix))))
    return py_strip(cut.otherwise(t))


def truncate(x, n: int) -> Column:
    return F.substring(_c(x), 1, n)


def ascii_safe(x) -> Column:
    """Every non-ASCII code point becomes '?'."""
    return F.regexp_replace(_c(x), r"[^\x{00}-\x{7F}]", "?")


def cluster_label(cluster, style: str = "long") -> Column:
    """-1 -> NOISE; else ``Cluster n`` (long) or ``n`` (short); NULL -> '?'."""
    c = _c(cluster)
    named = (F.concat(F.lit("Cluster "), c.cast("string")) if style == "long"
             else c.cast("string"))
    return (F.when(c.isNull(), F.lit("?"))
             .when(c == -1, F.lit("NOISE"))
             .otherwise(named))


def default_str(x, default: str = "?") -> Column:
    return F.coalesce(_c(x), F.lit(default))


def display_name(name, cluster_id) -> Column:
    """Name from a lookup table, else ``Cluster <id>``."""
    return F.coalesce(_c(name), F.concat(F.lit("Cluster "), _c(cluster_id).cast("string")))


def fmt4(x) -> Column:
    """Score with 4 decimals as text (``:.4f``)."""
    return F.format_string("%.4f", _c(x))
