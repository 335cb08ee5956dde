"""Relevance of venues to a cuisine scope: keyword scopes on the driver, stamps and tag audits as Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """What is searched: cuisine slugs, a pattern for them and one for their rivals. Invalid scopes match nothing."""

    slugs: tuple[str, ...]
    on: str
    rival: str
    valid: bool = True


def resolve(term: str | None, lexicon: dict[str, list[str]], categories: dict[str, list[str]]) -> Scope:
    """A cuisine, else a category, else invalid; no term is a scope without slugs that matches every row.

    Rivals are the keywords of all other cuisines less the scope's own and less what is part of one of them.
    """
    if not term:
        return Scope((), "", "")
    t = term.strip().lower()
    slugs = (t,) if t in lexicon else tuple(s for s in categories.get(t, []) if s in lexicon)
    if not slugs:
        return Scope((), "", "", False)
    own = sorted({k for s in slugs for k in lexicon[s]})
    rest = sorted({k for s, ks in lexicon.items() if s not in slugs for k in ks} - set(own))
    rest = [k for k in rest if not any(k in o for o in own)]
    pattern = lambda ks: r"\b(" + "|".join(map(re.escape, ks)) + r")" if ks else ""
    return Scope(slugs, pattern(own), pattern(rest))


def text_of(*cols: str) -> Column:
    return F.lower(F.concat_ws(" ", *cols))


def match_strength(scope: Scope, slugs: Column, name: Column, evidence: Column) -> Column:
    """1 for a tag or a name on the scope, 0.5 for types or description, 0 for none; null without a scope."""
    if not scope.slugs:
        return F.lit(None if scope.valid else 0.0).cast("double")
    tagged = F.arrays_overlap(slugs, F.array(*[F.lit(s) for s in scope.slugs]))
    return F.when(F.coalesce(tagged, F.lit(False)), 1.0).when(F.coalesce(F.lower(name).rlike(scope.on), F.lit(False)), 1.0).when(F.coalesce(evidence.rlike(scope.on), F.lit(False)), 0.5).otherwise(0.0)


def audited_tags(tags: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """(id, slug, hits, kept) for tags (id, slug, category, name, description): per id and category of three tags or more
    only the one with most keyword hits stays (a hit in the name counts 1, in the description 0.5; ties by slug)."""
    hits = F.lit(0.0)
    for slug, words in lexicon.items():
        found = lambda c: F.size(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b(" + "|".join(words) + r")"), 0)))  # noqa: E731, B023
        hits = F.when(F.col("slug") == slug, found(F.col("name")) + 0.5 * found(F.col("description"))).otherwise(hits)
    t = tags.withColumn("hits", hits)
    best = t.groupBy("id", "category").agg(F.count("*").alias("n"), F.min_by("slug", F.struct((-F.col("hits")).alias("h"), F.col("slug"))).alias("best"))
    return t.join(best, ["id", "category"]).select("id", "slug", "hits", ((F.col("n") < 3) | (F.col("slug") == F.col("best"))).alias("kept"))
