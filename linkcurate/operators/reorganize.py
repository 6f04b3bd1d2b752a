"""Sorting unsorted notes into their categories."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcurate.functions.classify import classify
from linkcurate.functions.notes import classifier_corpus
from linkcurate.functions.quality import is_dead_stub
from linkcurate.rules import CATEGORY_PATTERNS
from linkcurate.sources.tables import materialize


@dataclass(frozen=True)
class Reorganisation:
    """Plan of a reorganisation; nothing is written until its frames are."""

    judged: DataFrame    # file_path, file_name, url, fate ('deleted' | 'moved' | 'kept'), category
    moves: DataFrame     # source_path, target_path, category, url
    deleted: DataFrame   # file_path
    counters: DataFrame  # processed, reclassified, moved, failed_cleaned


def judge(notes: DataFrame, rules: Mapping[str, list[str]] = CATEGORY_PATTERNS) -> DataFrame:
    """Fate of each unsorted parsed note: dead stub, new category, or stays."""
    stub = is_dead_stub(F.col("is_failed"), F.col("content"))
    judged = notes.select(
        "file_path", "file_name", "url", stub.alias("_stub"),
        F.when(~stub, classify(classifier_corpus(), rules)).alias("category"),
    )
    fate = F.when(F.col("_stub"), "deleted").when(F.col("category") != "other", "moved").otherwise("kept")
    return judged.select("file_path", "file_name", "url", fate.alias("fate"), "category")


def reorganise(
    notes: DataFrame, vault: str, rules: Mapping[str, list[str]] = CATEGORY_PATTERNS, unsorted: str = "other"
) -> Reorganisation:
    """Plan where the parsed notes of the folder `unsorted` belong."""
    judged = materialize(judge(notes.filter(F.col("category") == unsorted), rules), "judged")
    target = F.concat(F.lit(vault.rstrip("/") + "/"), F.col("category"), F.lit("/"), F.col("file_name"))
    moves = judged.filter(F.col("fate") == "moved").select(
        F.col("file_path").alias("source_path"), target.alias("target_path"), "category", "url"
    )
    moved = F.count_if(F.col("fate") == "moved")
    counters = judged.agg(
        F.count("*").alias("processed"), moved.alias("reclassified"), moved.alias("moved"),
        F.count_if(F.col("fate") == "deleted").alias("failed_cleaned"),
    )
    return Reorganisation(judged, moves, judged.filter(F.col("fate") == "deleted").select("file_path"), counters)


def files_after(files: DataFrame, plan: Reorganisation) -> DataFrame:
    """Note files once the plan is carried out (paths are unique on both sides).

    Decided on paths only: of several notes that move to one path the last by
    source path remains, and it replaces a note that is there. Contents meet
    small tables of paths and are never grouped.
    """
    winners = plan.moves.groupBy("target_path").agg(F.max("source_path").alias("file_path"), F.max_by("category", "source_path").alias("_to"))
    moved = files.join(winners, "file_path").select(F.col("target_path").alias("file_path"), "file_name", F.col("_to").alias("category"), "content")
    gone = plan.judged.filter(F.col("fate") != "kept").select("file_path")
    replaced = gone.union(winners.select("target_path"))
    rest = files.join(replaced, "file_path", "left_anti")
    return rest.select("file_path", "file_name", "category", "content").unionByName(moved)
