"""Rule classification without a shuffle: rules are compiled into one projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkcurate.functions.text import any_pattern, fold_case, gated, let
from linkcurate.rules import CATEGORY_PATTERNS, KEYWORD_FALLBACK

Rules = Mapping[str, Sequence[str]]


def rule_scores(corpus: Column, rules: Rules = CATEGORY_PATTERNS) -> Column:
    """Array of `struct(score, neg_rank, category)` for the categories that match.

    A score is the number of non-overlapping matches of all patterns of the
    category. Matching ignores case. A pattern is counted only in texts that
    hold one of its required words.
    """
    ranked = [(rank, category, p) for rank, (category, ps) in enumerate(rules.items()) for p in ps]

    def scored(folded: Column) -> Column:
        def scores(gates: list[Column]) -> Column:
            total: dict[int, Column] = {}
            for gate, (rank, _, pattern) in zip(gates, ranked, strict=True):
                matches = F.when(gate, F.regexp_count(folded, F.lit(any_pattern(pattern)))).otherwise(0)
                total[rank] = total[rank] + matches if rank in total else matches
            return F.filter(
                F.array(*[
                    F.struct(
                        total[rank].cast("int").alias("score"), F.lit(-rank).alias("neg_rank"),
                        F.lit(category).alias("category"),
                    )
                    for rank, category in {(r, c): None for r, c, _ in ranked}
                ]),
                lambda s: s["score"] > 0,
            )

        return gated(folded, [p for _, _, p in ranked], scores)

    return let(fold_case(corpus), scored)


def best_category(scores: Column) -> Column:
    """Highest score, the earlier rule on a tie; NULL without any match."""
    return F.array_max(scores)["category"]


def keyword_category(
    corpus: Column, fallback: Sequence[tuple[str, Sequence[str]]] = tuple(KEYWORD_FALLBACK), default: str = "other"
) -> Column:
    chosen = None
    for category, words in fallback:
        hit = corpus.contains(words[0])
        for word in words[1:]:
            hit = hit | corpus.contains(word)
        chosen = F.when(hit, category) if chosen is None else chosen.when(hit, category)
    return F.lit(default) if chosen is None else chosen.otherwise(default)


def classify(corpus: Column, rules: Rules = CATEGORY_PATTERNS, **kwargs) -> Column:
    """Category of a text: best rule score, else keywords, else `other`."""
    return let(
        corpus,
        lambda c: F.coalesce(best_category(rule_scores(c, rules)), keyword_category(c, **kwargs)),
    )


def item_type(category: Column, kind: Column | None = None) -> Column:
    job = category == "jobs"
    if kind is not None:
        job = job | (F.lower(kind) == "job")
    return F.when(job, F.lit("job")).otherwise(F.lit("knowledge"))
