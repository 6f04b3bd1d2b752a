"""Models that answer in batches: one set-up per worker, instructions with the taxonomy, failures request by request."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from linkcurate.functions import render
from linkcurate.operators import triage
from linkcurate.rules import TAXONOMY
from linkcurate.schemas import MODEL_ANSWER

NO_IMAGES = "cast(array() as array<string>)"


def ask(spark, n, parts, *models, **more):
    rows = spark.range(0, n, 1, parts).select("id", F.concat(F.lit("request "), "id").alias("request"))
    answer = triage.ask_model(F.col("request"), F.expr(NO_IMAGES), *models, **more)
    return {r.id: r.a for r in rows.select("id", answer.alias("a")).collect()}


def test_one_set_up_per_worker_and_batches(spark):
    folder = tempfile.mkdtemp(prefix="linkcurate-")

    def setup(instructions):
        with open(f"{folder}/{os.getpid()}", "a") as out:
            out.write("set up\n")

        def answer(requests):
            assert len(requests) <= 7
            return [f"{len(requests)} {text}" for text, _ in requests]

        return answer

    got = ask(spark, 200, 12, triage.BatchModel(setup, batch=7))
    assert all(a.provider == "primary" and a.response.endswith(f"request {i}") for i, a in got.items())
    assert any(a.response.startswith("7 ") for a in got.values())
    made = os.listdir(folder)
    assert 0 < len(made) <= 12 and all(open(f"{folder}/{x}").read() == "set up\n" for x in made)


def test_fallback_answers_what_the_first_could_not(spark):
    def setup(instructions):
        return lambda requests: [ValueError("odd") if int(t.split()[1]) % 2 else t for t, _ in requests]

    got = ask(spark, 20, 2, triage.BatchModel(setup), lambda text, images: "second " + text)
    assert [got[2].provider, got[3].provider] == ["primary", "fallback"]
    assert got[3].response == "second request 3" and got[3].error == "ValueError: odd" and got[2].error is None


def test_a_batch_that_raises_or_answers_too_little_fails_whole(spark):
    def raising(instructions):
        def answer(requests):
            raise RuntimeError("gone")
        return answer

    got = ask(spark, 3, 1, triage.BatchModel(raising))
    assert {(a.provider, a.response, a.error) for a in got.values()} == {(None, None, "RuntimeError: gone")}
    got = ask(spark, 3, 1, triage.BatchModel(lambda instructions: lambda requests: ["one"]))
    assert {a.error for a in got.values()} == {"ValueError: 1 answers to 3 requests"}


def test_a_set_up_that_raises_fails_its_requests(spark):
    def setup(instructions):
        raise OSError("no weights")

    got = ask(spark, 3, 1, triage.BatchModel(setup), lambda text, images: "ok")
    assert {(a.provider, a.response, a.error) for a in got.values()} == {("fallback", "ok", "OSError: no weights")}


def test_instructions_name_every_category_and_field(spark):
    text = render.instructions()
    assert all(f"- **{name}**: {guide}" in text for name, guide in TAXONOMY.items())
    assert all(f'"{name}"' in text for name in MODEL_ANSWER.fieldNames())
    got = ask(spark, 1, 1, triage.BatchModel(lambda said: lambda requests: [said]), taxonomy={"only": "this one"})
    assert "- **only**: this one" in got[0].response and "research" not in got[0].response
