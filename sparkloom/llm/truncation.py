"""Texts that were cut off before their end."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkloom.session import cut

FALSE_DISCOVERIES = 0.01
REACH, GUARD = 200, 16  # neighbouring lengths, and how near ones don't count, as a limit may spread over them
_BLANKS = " \t\r\n\x0b\x0c "
_CLOSERS = r"""(["'”’»)\]*_]|&quot;|&gt;)*"""
_USUAL, _USUAL_DOTS = 0.005, 0.03  # share of its form from which a wording is usual


def with_ending(df: DataFrame, text: str) -> DataFrame:
    """`df` with what its text ends in: the columns form and tail.

    `form` is blank (nothing but blanks), cut (a broken character or escape, or a mark of omission), code (inside a code block), fence (the end
    of one), signature, status, record, reference, dots, sentence or open (none of these: inside a word or sentence); null for a null text. `tail` is
    what makes the closing forms comparable over the corpus: the last word of a signature or status line, the first two words
    of a line that ends in dots. The pieces that several tests look at are columns of their own, so each is made once.
    """
    whole, last, end = F.col("_whole"), F.col("_last"), F.col("_end")
    form = (
        F.when(whole.isNull(), None)
        .when(F.length(whole) == 0, "blank")
        .when(end.rlike(r"(�|\\(u[0-9a-fA-F]{0,3})?|&(#?[0-9]{0,6}|[a-zA-Z]{1,6}))$"), "cut")
        .when(end.rlike(r"(…|\[\.\.\.\]|\[…\])$"), "cut")
        .when(F.col("_fences") % 2 == 1, "code")
        .when(end.endswith("```"), "fence")
        .when(end.endswith("..."), "dots")
        .when(last.rlike(r"^(--|—|–)\s*\S+, \S+.*\w$"), "signature")
        .when(last.rlike(r"^(\w+=\S+ +)+\w+=\S+$"), "status")
        .when(last.rlike(r"^(\{.*\}|\[.*\])$"), "record")
        .when(last.rlike(r"^\p{Lu}[\p{L}]+( \p{L}+)? ?: \S+$") & ~end.rlike(r"[.,;:]$"), "reference")
        .when(end.rlike(r"(^|\s)[0-9]+\.$"), "open")
        .when(end.rlike(rf"[.?!]{_CLOSERS}$") & ~(last.rlike(r"^([-*] )?\([^)]*$") | last.rlike(r'^([-*] )?"[^"]*$')), "sentence")
        .otherwise("open")
    )
    tail = F.when(F.col("form").isin("signature", "status"), F.substring_index(last, " ", -1)).when(F.col("form") == "dots", F.substring_index(last, " ", 2))
    pieces = df.withColumn("_whole", F.rtrim(F.col(text), F.lit(_BLANKS)))
    fences = F.length(whole) - F.length(F.replace(whole, F.lit("```"), F.lit("``")))
    pieces = pieces.withColumns({"_last": F.trim(F.substring_index(whole, "\n", -1)), "_end": F.right(whole, F.lit(64)), "_fences": fences})
    return pieces.withColumn("form", form).withColumn("tail", tail).drop("_last", "_end", "_fences")


def _upper_tail(n: pd.Series, mean: pd.Series) -> pd.Series:
    """Chance of a Poisson number of at least n."""
    out = np.ones(len(n))
    for i, (k, m) in enumerate(zip(n, mean)):
        if k > m:
            term, total, j = 1.0, 1.0, k
            while term > 1e-12 * total:
                j += 1
                term *= m / j
                total += term
            out[i] = min(1.0, math.exp(k * math.log(m) - m - math.lgamma(k + 1)) * total)
    return pd.Series(out)


def length_limits(lengths: DataFrame, group: list[str], length: str, alpha: float = FALSE_DISCOVERIES) -> DataFrame:
    """Lengths at which texts of a group end far more often than at neighbouring lengths: (group..., length, n, at_risk, expected, p).

    The hazard of a length is the share of the texts that long or longer (those at risk) that end there. Window functions give, per length,
    the endings within REACH lengths either side, but for the GUARD nearest, and the texts at risk summed over all these lengths; the quotient is
    the neighbouring hazard, which times the texts at risk makes the expected number, a Poisson tail the p-value. Where the longest texts end the hazard rises
    to 1 without a limit, so the expected number is not below the mean number of endings per length on the side that has more. A length without
    neighbours at risk is not tested. Within each group the lengths found are those of Benjamini and Hochberg's procedure at `alpha`.
    Groups may be null. The windows run over different lengths, not over texts, so a large group is no matter.
    """
    by = W.partitionBy(*group)
    at = F.col(length).cast("long")
    counts = lengths.where(F.col(length).isNotNull()).groupBy(*group, length).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.withColumns({"total": F.sum("n").over(by), "tests": F.count(F.lit(1)).over(by)})
    n, total = F.col("n"), F.col("total")

    def up_to(offset: int) -> tuple[Column, Column]:
        """Endings, and texts at risk summed over all lengths from 0, up to this length + offset, at lengths without endings too."""
        shorter = by.orderBy(length).rangeBetween(W.unboundedPreceding, offset)
        ended, chars = (F.coalesce(F.sum(x).over(shorter), F.lit(0)) for x in (n, n * (at + 1)))
        return ended, chars + F.greatest(at + offset + 1, F.lit(0)) * (total - ended)

    (n0, r0), (n1, r1), (n2, r2), (n3, r3) = (up_to(x) for x in (-REACH - 1, -GUARD - 1, GUARD, REACH))
    near = totals.withColumns({"at_risk": F.sum("n").over(by.orderBy(F.desc(length))), "below": n1 - n0, "above": n3 - n2, "exposed": r1 - r0 + r3 - r2})
    tail = F.pandas_udf(_upper_tail, "double")
    # half an ending more keeps the rates above 0
    hazard = F.col("at_risk") * (F.col("below") + F.col("above") + 0.5) / F.col("exposed")
    endings = (F.greatest("below", "above") + 0.5) / F.lit(float(REACH - GUARD))
    tested = near.where("exposed > 0").withColumn("expected", F.greatest(hazard, endings))
    tested = tested.where("n >= 2 AND n > expected").withColumn("p", tail(F.col("n").cast("double"), "expected")).where(F.col("p") <= alpha)
    ranked = tested.withColumn("rank", F.row_number().over(by.orderBy("p", length)))
    ranked = ranked.withColumn("ok", F.max(F.when(F.col("p") <= F.col("rank") * alpha / F.col("tests"), F.col("rank"))).over(by))
    return ranked.where("rank <= ok").select(*group, F.col(length).alias("length"), "n", "at_risk", "expected", "p")


def marked_texts(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Per row: key, source, chars, bytes, form and tail of the ending, and for endings that need a second look a digest of the text without
    regard to blanks. Null texts have null lengths and form."""
    t = F.col("_text")
    seen = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("_text")).withColumns({"chars": F.length(t), "bytes": F.octet_length(t)})
    seen = with_ending(seen, "_text")
    same = F.md5(F.array_join(F.split(F.ltrim(F.col("_whole"), F.lit(_BLANKS)), r"\s+"), " "))
    return seen.withColumn("digest", F.when(F.col("form").isin("dots", "signature", "status"), same)).drop("_text", "_whole")


def text_lengths(df: DataFrame, text: str, source: str) -> DataFrame:
    """Per row: source, chars, bytes and form, which here only tells blank texts from others (null for null), so nothing is searched for patterns."""
    t = F.col("_text")
    form = F.when(F.length(F.rtrim(t, F.lit(_BLANKS))) == 0, "blank").when(t.isNotNull(), "text")
    return df.select(F.col(source).alias("source"), F.col(text).alias("_text")).select("source", F.length(t).alias("chars"), F.octet_length(t).alias("bytes"), form.alias("form"))


def limits_of_sources(marked: DataFrame, alpha: float = FALSE_DISCOVERIES) -> DataFrame:
    """`length_limits` of the texts of each source that aren't blank, in characters and in bytes (unit), by one set of windows."""
    both = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")]))
    lengths = marked.where("form IS NOT NULL AND form <> 'blank'").select("source", both.alias("l")).select("source", "l.unit", "l.length")
    return length_limits(lengths, ["unit", "source"], "length", alpha)


def find_truncated(df: DataFrame, key: str, text: str, source: str, alpha: float = FALSE_DISCOVERIES) -> DataFrame:
    """(key, source, truncated, at_limit) of every row.

    Method: discrete length hazards per source, in characters and in bytes, tested against neighbouring hazards with
    false-discovery control (`length_limits`). at_limit says that the text has such a length. Endings inside a word, sentence or code
    block are truncated at any length, as transfers also break elsewhere. Endings that may be the author's or a cut's
    - dots, or a closing line with an unusual last word - are truncated at a limit unless their
    wording is usual in the corpus, and elsewhere only if an equal text, blanks aside, is truncated at a limit. Statistics are over all rows,
    and all rules are shares or tests, so they are alike at every size.

    Null, empty and blank texts are not truncated. A null source is a source. Repeated rows count each. An empty table gives an empty one.
    """
    rows = cut(marked_texts(df, key, text, source))
    limits = cut(limits_of_sources(rows, alpha).select("unit", F.col("source").alias("s"), "length"))
    for unit in ("chars", "bytes"):
        t = limits.where(F.col("unit") == unit).select("s", F.col("length").alias(f"limit_{unit}"))
        rows = rows.join(t, F.col("source").eqNullSafe(F.col("s")) & (F.col(unit) == F.col(f"limit_{unit}")), "left").drop("s")
    at = (F.col("limit_chars").isNotNull() | F.col("limit_bytes").isNotNull()).alias("at_limit")
    rows = rows.select("key", "source", "form", "tail", "digest", at)
    # wordings with a share of their form; by the shares, at most 200 of a form
    counted = rows.where(F.col("tail").isNotNull() & ((F.col("form") != "dots") | ~F.col("at_limit"))).groupBy("form", "tail").agg(F.count(F.lit(1)).alias("n"))
    form_total = F.sum("n").over(W.partitionBy("form"))
    counted = counted.withColumns({"common": F.col("n") / form_total >= F.when(F.col("form") == "dots", _USUAL_DOTS).otherwise(_USUAL)})
    usual = counted.where("common").select("form", "tail", F.lit(True).alias("usual"))
    rows = rows.join(F.broadcast(usual), ["form", "tail"], "left")
    sure = F.col("form").isin("cut", "code", "open")
    doubtful = F.col("digest").isNotNull() & F.col("usual").isNull()
    rows = rows.select("key", "source", "digest", "at_limit", F.coalesce(sure | (doubtful & F.col("at_limit")), F.lit(False)).alias("sure"), F.coalesce(doubtful, F.lit(False)).alias("doubtful"))
    copies = rows.where("doubtful AND sure").select(F.col("digest").alias("d"), F.lit(True).alias("copy")).distinct()
    doubt = rows.where("doubtful").join(copies, F.col("digest") == F.col("d"), "left").select("key", "source", F.coalesce("copy", F.lit(False)).alias("truncated"), "at_limit")
    return rows.where("NOT doubtful").select("key", "source", F.col("sure").alias("truncated"), "at_limit").unionByName(doubt)
