"""Spans of regular expressions in texts, as Spark expressions.

split() gives the gaps and regexp_extract_all() the matches of the same leftmost scan, and the
lengths of both, added up, give the places in code points. The patterns are written so that the
regular expression engine neither retries a run of characters from each of its places nor recurses
on repeated groups: possessive quantifiers, and lookbehinds that begin a run at its first character.
Texts are read in time linear in their length; only the list of one text's good matches is copied as it
grows, which is quadratic in their number, with a very small constant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<a:int,b:int,v:string>>"


def spans(text: Column, pattern: str, good: Callable[[Column], Column] | None = None, where: Column | None = None) -> Column:
    """array<struct<a, b, v>> of the matches; good drops failing ones; texts where `where` is false have none."""
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("n"), hit.alias("v")),
    )

    def step(acc: Column, x: Column) -> Column:
        here = F.struct((acc["at"] + x["gap"]).alias("a"), (acc["at"] + x["gap"] + x["n"]).alias("b"), x["v"].alias("v"))
        ok = x["v"].isNotNull() if good is None else x["v"].isNotNull() & good(x["v"])
        return F.struct((acc["at"] + x["gap"] + F.coalesce(x["n"], F.lit(0))).alias("at"), F.when(ok, F.concat(acc["out"], F.array(here))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(SPAN)
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return found if where is None else F.when(where, found).otherwise(none)


def tagged(kind: Column | str, found: Column) -> Column:
    """array<struct<a, b, kind>> of spans."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.transform(found, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), k.alias("kind")))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined, of tagged spans in the given order."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))))


def free(span: Column, taken: Column) -> Column:
    """Whether a span overlaps none of those taken."""
    return ~F.exists(taken, lambda t: (t["a"] < span["b"]) & (span["a"] < t["b"]))
