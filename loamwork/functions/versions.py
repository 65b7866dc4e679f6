"""Version numbers and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version(c: Column) -> Column:
    """Three integers, missing ones 0, of a text that begins with a number (after v, ^ or ~); null otherwise."""
    digits = F.regexp_extract_all(F.regexp_extract(F.trim(c), r"^[<>=]*\s*[v^~]*(\d+(?:\.\d+)?(?:\.\d+)?)", 1), F.lit(r"(\d+)"), 1)
    n = lambda i: F.coalesce(F.get(digits, F.lit(i)).try_cast("int"), F.lit(0))
    return F.when(F.size(digits) > 0, F.array(n(0), n(1), n(2)))


def in_range(v: Column, rule: Column) -> Column:
    """Whether a version fits a rule: '*', '>=a', '<a', a prefix such as 2 or 2.1, an exact number, or several joined by '||' or blanks for 'and'."""

    def one(r: Column) -> Column:
        bound, have = version(r), version(v)
        parts = F.size(F.regexp_extract_all(F.regexp_extract(r, r"^[v^~]*(\d+(?:\.\d+)?(?:\.\d+)?)", 1), F.lit(r"(\d+)"), 1))
        prefix = F.slice(have, F.lit(1), F.least(F.greatest(parts, F.lit(1)), F.lit(3))) == F.slice(bound, F.lit(1), F.least(F.greatest(parts, F.lit(1)), F.lit(3)))
        return F.when(r.isin("*", ""), True).when(r.startswith(">="), have >= bound).when(r.startswith("<="), have <= bound).when(r.startswith(">"), have > bound).when(r.startswith("<"), have < bound).otherwise(F.coalesce(prefix, F.lit(False)))

    # a bound may stand apart from its sign
    tidy = F.regexp_replace(F.trim(rule), r"([<>]=?)\s+", "$1")
    return F.coalesce(F.exists(F.split(tidy, r"\s*\|\|\s*"), lambda alt: F.forall(F.split(F.trim(alt), r"\s+"), one)), F.lit(False))


def named_version(c: Column) -> Column:
    """The version that ends a name such as model-4.1 or gpt4-1.2, as three integers; null without one."""
    return version(F.regexp_extract(c, r"(?:^|[-_ v@])(\d+(?:\.\d+){0,2})[^0-9.]*$", 1))


def framework_fits(framework: Column, v: Column, rule: Column) -> Column:
    """Whether framework and version fit alternatives such as 'next@>=14 // nuxt@*', joined by '//' or '||'; a rule without a name fits any framework."""

    def one(r: Column) -> Column:
        name, bound = F.regexp_extract(r, r"^([^@]*)@", 1), F.regexp_replace(r, r"^[^@]*@", "")
        return ((name == "") | (name == framework)) & in_range(v, bound)

    return F.coalesce(F.exists(F.split(F.trim(rule), r"\s*(?://|\|\|)\s*"), lambda r: one(F.trim(r))), F.lit(False))
