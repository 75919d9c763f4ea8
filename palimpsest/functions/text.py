"""Text scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import dims


def normalised(text: Column) -> Column:
    """Underscores to spaces, lower case, only ``[a-z0-9 ]``, single spaces."""
    kept = F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), "_", " ")), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def predicate_key(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), " ", "_")


def verb_lemma(word: Column) -> Column:
    """A suffix lemmatizer: ied to y, then eed, ed, es, s."""
    w = F.lower(word)
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return (
        F.when(w.endswith("ied") & (F.length(w) > 4), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("eed"), w)
        .when(w.endswith("ed") & (F.length(w) > 4), cut(2))
        .when(w.rlike("(sh|ch|x|z|ss)es$"), cut(2))
        .when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3), cut(1))
        .otherwise(w)
    )


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the sets of lower-case tokens; 0 if either is empty."""
    x, y = F.array_distinct(words(F.coalesce(a, F.lit("")))), F.array_distinct(words(F.coalesce(b, F.lit(""))))
    common = F.size(F.array_intersect(x, y)).cast("double")
    return F.when((F.size(x) == 0) | (F.size(y) == 0) | (common == 0), F.lit(0.0)).otherwise(2 * common / (F.size(x) + F.size(y)))


def contains_keyword(answer: Column, keywords: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(keywords, lambda k: low.contains(F.lower(k)))


def is_situational(query: Column) -> Column:
    return dims.starts_with_any(F.lower(F.trim(query)), dims.SITUATIONAL_PREFIXES)


def safety_class(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name, terms in reversed(dims.SAFETY_TERMS.items()):
        out = F.when(dims.contains_any(low, terms), F.lit(name)).otherwise(out)
    return out


def negated(text: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(F.lower(F.regexp_replace(text, r"[^\w' ]", " ")), r"\s+"), F.array(*map(F.lit, dims.NEGATIONS))), F.lit(False)) | F.coalesce(F.lower(text).rlike(r"n't\b"), F.lit(False))
