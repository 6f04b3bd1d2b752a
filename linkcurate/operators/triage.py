"""From captured text to a categorised item, by a user's model or by rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkcurate.functions.classify import classify, item_type
from linkcurate.functions.feeds import parse_answer
from linkcurate.functions.quality import has_visuals
from linkcurate.functions.render import instructions, model_request
from linkcurate.functions.text import head
from linkcurate.rules import CATEGORY_PATTERNS, MODEL_TILES, TAXONOMY
from linkcurate.schemas import MODEL_ANSWER, TRIAGE

# --- Fixed values: placeholder texts of the triage step.
SUMMARY_PLACEHOLDER = "Summary generated from visual analysis."
UNTITLED = "Untitled Document"
FAILED_INSIGHTS = [
    "Manual inspection required at source URL.",
    "Scraper flagged login wall or insufficient text.",
]
FAILED_TAGS = ["failed_scrape", "manual_review"]
FAILED_REASON_DEFAULT = "Short text / login wall"
JOB_ADDRESS = "linkedin.com/jobs"

COLUMNS = TRIAGE.fieldNames()
# A model gets the request text and the paths of the first images.
Model = Callable[[str, list[str]], str | None]
_ANSWERED = T.StructType([
    T.StructField("provider", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("error", T.StringType()),
])


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_guarded(failed: Column, tiles: Column) -> Column:
    """Failed captures without images never reach a model."""
    return F.coalesce(failed, F.lit(False)) & ~has_visuals(tiles)


def failed_items(scraped: DataFrame, date_str: Column) -> DataFrame:
    """Fixed triage rows for guarded captures."""
    reason = F.coalesce(F.nullif("failure_reason", F.lit("")), F.lit(FAILED_REASON_DEFAULT))
    return scraped.filter(is_guarded(F.col("failed_scrape"), F.col("visual_tiles"))).select(
        "url",
        F.concat(F.lit("Failed Scrape - "), F.col("title")).alias("title"),
        F.lit("other").alias("category"),
        F.lit("knowledge").alias("item_type"),
        F.concat(
            F.lit("Automated scraping could not extract clean content. Reason: "), reason, F.lit(".")
        ).alias("summary"),
        _texts(FAILED_INSIGHTS).alias("insights"),
        _texts(FAILED_TAGS).alias("tags"),
        F.array().cast("array<string>").alias("code_snippets"),
        F.col("text").alias("original_text"),
        F.array().cast(TRIAGE["visual_tiles"].dataType).alias("visual_tiles"),
        date_str.alias("date_str"),
    )


def model_images(tiles: Column, count: int = MODEL_TILES) -> Column:
    """Paths of the tiles a model is shown."""
    return F.coalesce(
        F.transform(F.slice(tiles, 1, count), lambda t: t["path"]), F.array().cast("array<string>")
    )


@dataclass(frozen=True)
class BatchModel:
    """A model that is set up once per worker and answers requests in batches.

    `setup` gets the instructions (see `functions.render.instructions`) and returns a function from a list of (request, image paths)
    to as many answers; an answer may be an exception, for a request that failed. It runs on the executors, so it must be picklable.
    """

    setup: Callable[[str], Callable[[list[tuple[str, list[str]]]], Sequence[str | BaseException | None]]]
    batch: int = 16
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


_READY: dict[tuple[str, str], Callable] = {}


def _answerer(model: Model | BatchModel, instructions: str) -> Callable[[list[tuple[str, list[str]]]], list[str | BaseException | None]]:
    """Answers for a list of requests, an exception where one failed. A batch that raises as a whole fails for all of it."""
    if not isinstance(model, BatchModel):
        def one(request: tuple[str, list[str]]) -> str | BaseException | None:
            try:
                return model(*request)
            except Exception as e:  # a user's model may raise anything
                return e

        return lambda requests: [one(x) for x in requests]

    def batches(requests: list[tuple[str, list[str]]]) -> list[str | BaseException | None]:
        out: list[str | BaseException | None] = []
        for i in range(0, len(requests), model.batch):
            some = requests[i : i + model.batch]
            try:
                ready = _READY.get((model.key, instructions))
                if ready is None:
                    ready = _READY[model.key, instructions] = model.setup(instructions)
                answers = list(ready(some))
                if len(answers) != len(some):
                    raise ValueError(f"{len(answers)} answers to {len(some)} requests")
            except Exception as e:
                answers = [e] * len(some)
            out += answers
        return out

    return batches


def ask_model(
    request: Column, images: Column, primary: Model | BatchModel, fallback: Model | BatchModel | None = None, name: str = "primary",
    *, taxonomy: Mapping[str, str] = TAXONOMY,
) -> Column:
    """`struct(provider, response, error)` of a user's model for each request.

    The fallback is asked once, only where the primary raises. One failing request never stops the job. Only these two columns travel
    to Python, in Arrow batches; a `BatchModel` is set up once per worker and gets the instructions with the taxonomy.
    """
    text = instructions(taxonomy)
    providers = [(name, primary)] + ([("fallback", fallback)] if fallback is not None else [])

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        asked = [(provider, _answerer(model, text)) for provider, model in providers]
        for requests, shown in batches:
            rows = [(r, list(paths)) for r, paths in zip(requests, shown, strict=True)]
            found: list[tuple[str | None, str | None, str | None]] = [(None, None, None)] * len(rows)
            open_ = list(range(len(rows)))
            for provider, answers in asked:
                left = []
                for i, answer in zip(open_, answers([rows[i] for i in open_]), strict=True):
                    if isinstance(answer, BaseException):
                        found[i] = (None, None, f"{type(answer).__name__}: {answer}")
                        left.append(i)
                    else:
                        found[i] = (provider, answer, found[i][2])
                open_ = left
            yield pd.DataFrame(found, columns=_ANSWERED.fieldNames())

    # Types are given by the hints of the inner function; a model need not answer the same twice.
    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, _ANSWERED).asNondeterministic()(request, images)


def first_answer(answers: Mapping[str, Column]) -> Column:
    """`struct(provider, response)` of the first provider that answered; NULL means it raised, an empty answer is one."""
    pair = [
        F.when(response.isNotNull(), F.struct(F.lit(name).alias("provider"), response.alias("response")))
        for name, response in answers.items()
    ]
    return F.coalesce(*pair)


def rule_answer(rules: Mapping[str, list[str]] = CATEGORY_PATTERNS, corpus_head: int | None = None) -> Column:
    """What the rules know about a capture, in the shape of a model's answer.

    They see the whole text, or its first `corpus_head` characters.
    """
    text = F.col("text") if corpus_head is None else head(F.col("text"), corpus_head)
    corpus = F.lower(F.concat_ws("\n", "title", "url", text))
    nothing = F.lit(None)
    values = {"category": classify(corpus, rules)}
    return F.struct(*[
        values.get(f.name, nothing).cast(f.dataType).alias(f.name) for f in MODEL_ANSWER.fields
    ])


def _or(*texts: Column) -> Column:
    """First text that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def _filled(values: Column, default: Column) -> Column:
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, values).otherwise(default)


def normalise(
    scraped: DataFrame, answer: Column, date_str: Column, taxonomy: Mapping[str, str] = TAXONOMY, *keep: str
) -> DataFrame:
    """Triage rows from captures and parsed answers; empty answers count as missing.

    Job-board links are always jobs. A category outside the taxonomy (case
    matters) becomes `other`.
    """
    preset = F.col("url").contains(JOB_ADDRESS)
    with_answer = scraped.withColumn("_a", answer)
    given = F.col("_a.category")
    category = F.when(preset, F.lit("jobs")).when(given.isin(list(taxonomy)), given).otherwise(F.lit("other"))
    kind = F.when(preset, F.lit("job")).otherwise(F.coalesce(F.col("_a.type"), F.lit("knowledge")))
    none = F.array().cast("array<string>")
    return with_answer.withColumn("_c", category).select(
        "url",
        F.coalesce(_or(F.col("_a.title"), F.col("title")), F.lit(UNTITLED)).alias("title"),
        F.col("_c").alias("category"),
        item_type(F.col("_c"), kind).alias("item_type"),
        F.coalesce(_or(F.col("_a.summary")), F.lit(SUMMARY_PLACEHOLDER)).alias("summary"),
        _filled(F.col("_a.insights"), none).alias("insights"),
        _filled(F.col("_a.tags"), F.array("_c")).alias("tags"),
        _filled(F.col("_a.code_snippets"), none).alias("code_snippets"),
        F.col("text").alias("original_text"),
        "visual_tiles",
        date_str.alias("date_str"),
        *keep,
    )


def triage(
    scraped: DataFrame,
    date_str: Column,
    *,
    model: Model | BatchModel | None = None,
    fallback: Model | BatchModel | None = None,
    rules: Mapping[str, list[str]] = CATEGORY_PATTERNS,
    taxonomy: Mapping[str, str] = TAXONOMY,
) -> DataFrame:
    """Triage captures: guarded ones by the fixed row, the others by model or rules.

    Adds to the triage columns the `error` of a capture that no model answered.
    """
    failed = failed_items(scraped, date_str)
    open_ = scraped.filter(~is_guarded(F.col("failed_scrape"), F.col("visual_tiles")))
    if model is None:
        open_ = open_.withColumn("_a", rule_answer(rules)).withColumn("error", F.lit(None).cast("string"))
    else:
        images = model_images(F.col("visual_tiles"))
        asked = open_.withColumn("_r", ask_model(model_request(), images, model, fallback, taxonomy=taxonomy))
        unanswered = F.when(F.col("_r.provider").isNull(), F.col("_r.error"))
        open_ = asked.withColumn("_a", parse_answer(F.col("_r.response"))).withColumn("error", unanswered)
    answered = normalise(open_, F.col("_a"), date_str, taxonomy, "error")
    return failed.select(*COLUMNS, F.lit(None).cast("string").alias("error")).unionByName(answered)
