"""Text functions: normalisation, document keys, occurrences, overlap, budgets and rounding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The normaliser's patterns and replacements, in the order in which they apply.
# Heading marks go; an image leaves its path, a link its text and its target; emphasis, strike-out
# and code marks go.
STEPS = (
    (r"(?m)^[ \t]*#+[ \t]*", ""),
    (r"!\[[^\]\n]*\]\(([^)\n]*)\)", r"\1"),
    (r"\[([^\]\n]*)\]\(([^)\n]*)\)", r"\1\2"),
    (r"\*\*|~~|`", ""),
)
# Characters and what they become: dashes, quotes, full-width letters and digits.
FOLD = {
    **dict.fromkeys("—–‑‐−", "-"),
    **dict.fromkeys("“”„", '"'),
    **dict.fromkeys("‘’", "'"),
    **{chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)},
}
SPACE = r"[\s 　 -   ]+"


def _java(replacement: str) -> str:
    return replacement.replace("\\", "$")


def normalize_text(c: Column | str) -> Column:
    """The normalised text in expressions only: null and "" give "", no white space, lower case.

    Compatibility forms other than full-width ASCII are folded by normalize_exact() alone.
    """
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    for pattern, replacement in STEPS:
        c = F.regexp_replace(c, pattern, _java(replacement))
    c = F.translate(c, "".join(FOLD), "".join(FOLD.values()))
    return F.lower(F.regexp_replace(c, SPACE, ""))


def normalize_python(text: str | None) -> str:
    """The same on a Python string, with Unicode's compatibility folding (NFKC)."""
    import re

    out = text or ""
    for pattern, replacement in STEPS:
        out = re.sub(pattern, replacement, out)
    out = unicodedata.normalize("NFKC", out.translate(str.maketrans(FOLD)))
    return re.sub(r"\s+", "", out.translate(str.maketrans(FOLD))).lower()


@F.pandas_udf(StringType())
def normalize_exact(texts):  # noqa: ANN001, ANN201
    """normalize_python() over Arrow batches, for corpora with other compatibility forms."""
    return texts.map(normalize_python)


def normalize_sql(c: str) -> str:
    """normalize_text() in DuckDB SQL."""
    out = f"coalesce({c}, '')"
    for pattern, replacement in STEPS:
        options = "gm" if pattern.startswith("(?m)") else "g"
        out = f"regexp_replace({out}, '{pattern.removeprefix('(?m)')}', '{replacement}', '{options}')" if options == "g" else f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    keys, values = ("".join(x).replace("'", "''") for x in (FOLD, FOLD.values()))
    return f"lower(regexp_replace(translate({out}, '{keys}', '{values}'), '[\\s\\x{{00a0}}\\x{{3000}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}]+', '', 'g'))"


def document_key(c: Column | str) -> Column:
    """A document's name without folders and extension, trimmed, in lower case."""
    c = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]+$", "")))


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text without overlap; 0 for an empty or null part."""
    n = F.length(part)
    count = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.when(n > 0, n)
    return F.coalesce(count.cast("bigint"), F.lit(0).cast("bigint"))


def grams(c: Column, n: int = 2) -> Column:
    """The distinct character n-grams of a normalised text."""
    last = F.length(c) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def lexical_overlap(question: Column, span: Column, n: int = 2) -> Column:
    """The share of the span's character n-grams that the question has; null for a span without any."""
    own = grams(span, n)
    return F.try_divide(F.size(F.array_intersect(own, grams(question, n))), F.size(own))


def within_budget(content: Column, before: Column, budget: Column) -> Column:
    """What of a chunk is credited when `before` normalised characters are spent; a chunk on the border is cut."""
    return F.left(content, F.greatest(budget - before, F.lit(0)).cast("int"))


def rounded(c: Column, places: int = 4) -> Column:
    """Rounding for reports: each metric is rounded before it is averaged on. Half away from zero on decimals' shortest form."""
    return F.round(c, places)


def python_round(value: float | None, places: int = 4) -> float | None:
    """Rounding by a double's exact value, as reports print it."""
    return None if value is None else round(value, places)


def non_ascii(c: Column) -> Column:
    """Whether a name has a character outside of ASCII."""
    return c.rlike(r"[^\x00-\x7F]")
