import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from linkcurate.functions import classify, feeds, notes, quality, render
from linkcurate.operators import compendium, extract, reminders, reorganize, tiles, triage
from linkcurate.plans.jobs import compendium as compile_notes
from linkcurate.rules import LOGIN_PATTERNS
from linkcurate.schemas import NOTE_FILES, SCRAPED, TRIAGE


def scraped(spark, **fields):
    row = dict(
        url="https://example.com/a", title="Title", text="x" * 300, source_type="web", failed_scrape=False,
        failure_reason=None, code_snippets=[], visual_tiles=[],
    ) | fields
    return spark.createDataFrame([Row(**row)], SCRAPED)


TILE = dict(path="/vault/attachments/post_01_tile_00.jpg", index=0, width=1280, height=1568)


def test_integrity(one):
    wall = "Please Sign In to LinkedIn to view this post. Create an account or log in with your email."
    got = one(quality.integrity, wall, "y" * 199, "y" * 200, None)
    assert [g.failed for g in got] == [True, True, False, True]
    assert got[0].reason == f"Detected login wall pattern matching '{LOGIN_PATTERNS[0]}'"
    assert got[1].reason == "Text length too short (199 chars < 200 chars)"
    inside = "z" * 1493 + " login " + "z" * 500   # the word ends at character 1,499
    outside = "z" * 1500 + " login " + "z" * 500
    assert [g.failed for g in one(quality.integrity, inside, outside)] == [True, False]
    assert one(quality.integrity_reason, "x" * 300 + " ВОЙТИ").endswith("пароль)\\b'")


def test_usable(spark):
    def usable(**fields):
        return scraped(spark, **fields).select(
            quality.is_usable(F.col("failed_scrape"), F.col("text"), F.col("visual_tiles")), quality.has_visuals(F.col("visual_tiles"))
        ).first()

    assert tuple(usable(text="Short caption", visual_tiles=[TILE])) == (True, True)
    assert tuple(usable(text="Short caption")) == (False, False)
    assert tuple(usable(failed_scrape=True, visual_tiles=[TILE])) == (False, True)


def test_note_failed_and_stub(one):
    def failed(c):
        return quality.note_failed(c, F.lit("t"))

    assert one(failed, "a" * 99 + "   ", "a" * 100, "b" * 200 + "#failed_scrape") == [True, False, True]
    stub = one(lambda c: quality.is_dead_stub(F.lit(True), c), "a" * 299, "a" * 300)
    assert stub == [True, False]


def triage_row(spark, **fields):
    row = dict(
        url="https://x.com/tech_expert/status/987654321", title="Next-Gen Flowchart", category="workflows", item_type="knowledge",
        summary="A diagram of event-driven pipelines.", insights=["Clusters in regions", "Cold storage"],
        tags=["workflows", "#multi agent", "e-t-l"], code_snippets=[" docker run "], original_text="Check this:",
        visual_tiles=[TILE, TILE | {"index": 1, "path": "/v/t_01.jpg"}], date_str="2025-09-20",
    ) | fields
    return spark.createDataFrame([Row(**row)], TRIAGE)


def test_note_markdown(spark):
    assert triage_row(spark).select(render.note_markdown()).first()[0] == (
        "---\nurl: https://x.com/tech_expert/status/987654321\ndate: 2025-09-20\ncategory: workflows\ntype: knowledge\n---\n\n"
        "# Next-Gen Flowchart\n\n## AI Summary\nA diagram of event-driven pipelines.\n\n## Key Insights\n- Clusters in regions\n- Cold storage"
        "\n\n## Code Snippets\n```\ndocker run\n```\n\n## Visual Snapshots\n![Visual Snapshot 1](../attachments/post_01_tile_00.jpg)\n\n"
        "![Visual Snapshot 2](../attachments/t_01.jpg)\n\n## Tags\n#workflows #multi_agent #e_t_l\n\n---\n## Original Source\nCheck this:\n"
    )
    bare = triage_row(spark, insights=[], code_snippets=[], visual_tiles=[], tags=[]).select(render.note_markdown()).first()[0]
    assert "## Key Insights\n- No specific insights extracted.\n\n## Tags\n\n\n---" in bare


def files(spark, *rows):
    return spark.createDataFrame(
        [(p, p.rsplit("/", 1)[1], p.rsplit("/", 2)[1], c) for p, c in rows], NOTE_FILES
    )


def test_render_then_parse(spark):
    content = triage_row(spark).select(render.note_markdown()).first()[0]
    frame = files(spark, ("/vault/workflows/n.md", content))
    note = notes.parse_notes(frame).first()
    assert (note.title, note.url, note.summary) == (
        "Next-Gen Flowchart", "https://x.com/tech_expert/status/987654321", "A diagram of event-driven pipelines.",
    )
    assert note.insights == ["Clusters in regions", "Cold storage"]
    assert note.tags[-3:] == ["workflows", "multi_agent", "e_t_l"] and not note.is_failed
    assert notes.parse_notes(frame, front_matter_url=False).first().url is None


def test_parse_quirks(one):
    section = "## AI Summary\nfirst\n### sub\n## Key Insights\n* a\n•b\n\n- No specific insights here\n\r\n- c"
    assert one(notes.summary, section) == "first"
    assert one(notes.insights, section) == ["a", "b", "c"]
    assert one(notes.tags, "#a #a x#1 http://h/p#frag") == ["a", "a", "1", "frag"]
    assert one(notes.source_link, "**Source URL**: [t](https://h.org/x)", "url: https://h.org") == ["https://h.org/x", None]
    assert one(lambda c: notes.note_title(c, F.lit("a.b.md")), "text\n#  Head \nx", "no heading") == ["Head", "a.b"]
    assert one(lambda c: notes.front_matter(c, "url"), 'url: "https://q"', "a\n" * 30 + "url: late") == ["https://q", None]
    long = "## Original Source\n" + "e" * 2501
    assert one(notes.excerpt, long) == "e" * 2500 + notes.CONTINUED


def test_classifier(one, spark):
    rules = {"b": [r"\btwo\b"], "a": [r"\bone\b", r"\buno\b"]}
    best = lambda c: classify.classify(c, rules)
    assert one(best, "one two", "one uno two", "none", "see github.com", "a podcast", "linkedin.com") == [
        "b", "a", "other", "repositories", "workflows", "jobs",
    ]
    assert one(lambda c: F.size(classify.rule_scores(c)), "вакансия", "ваканс", "toon 🎒x", "toon 🎒 ") == [0, 1, 1, 0]
    assert one(classify.classify, "llama and qwen, an arxiv benchmark", "hiring a qa engineer") == ["ML", "jobs"]


def test_failed_capture_row(spark):
    row = triage.triage(
        scraped(spark, failed_scrape=True, failure_reason="Detected login wall", title="Sign In", text="Sign in."), F.lit("2025-09-20")
    ).first()
    assert (row.category, row.title, row.item_type) == ("other", "Failed Scrape - Sign In", "knowledge")
    assert row.tags == ["failed_scrape", "manual_review"] and "Detected login wall" in row.summary
    shown = triage.triage(scraped(spark, failed_scrape=True, visual_tiles=[TILE]), F.lit("d")).first()
    assert not shown.title.startswith("Failed")


ANSWER = {"title": "T", "category": "agents", "type": "knowledge", "summary": "S", "insights": ["i"], "tags": ["t"], "code_snippets": []}


def answered(spark, answer, **fields):
    raw = answer if isinstance(answer, str) else json.dumps(answer)
    return triage.triage(scraped(spark, **fields), F.lit("2025-09-20"), model=lambda request, images: raw).first()


def test_model_answers(spark):
    row = answered(spark, ANSWER, visual_tiles=[TILE])
    assert (row.title, row.category, len(row.visual_tiles), row.insights) == ("T", "agents", 1, ["i"])
    assert answered(spark, f"```json\n{json.dumps(ANSWER)}\n```").title == "T"
    assert answered(spark, f"Sure! {json.dumps(ANSWER)} ok").category == "agents"
    junk = answered(spark, "no json")
    assert (junk.title, junk.category, junk.tags, junk.summary) == ("Title", "other", ["other"], triage.SUMMARY_PLACEHOLDER)
    odd = answered(spark, ANSWER | {"category": "ml", "title": "", "tags": []})
    assert (odd.category, odd.title, odd.tags) == ("other", "Title", ["other"])
    job = answered(spark, ANSWER | {"category": "tools"}, url="https://linkedin.com/jobs/view/9")
    assert (job.category, job.item_type) == ("jobs", "job")
    assert answered(spark, ANSWER | {"type": "JOB"}).item_type == "job"


def test_model_fallback(spark):
    def down(request, images):
        raise TimeoutError("down")

    frame = spark.createDataFrame([("r", ["a", "b", "c", "d"])], "request string, paths array<string>")
    tiles = F.transform("paths", lambda p: F.struct(p.alias("path")))

    def ask(*models):
        return frame.select(triage.ask_model(F.col("request"), triage.model_images(tiles), *models).alias("a")).first().a

    both = ask(down, lambda request, images: f"{request}:{','.join(images)}")
    assert (both.provider, both.response, both.error) == ("fallback", "r:a,b,c", "TimeoutError: down")
    none = ask(down)
    assert (none.provider, none.response, none.error) == (None, None, "TimeoutError: down")
    row = triage.triage(scraped(spark), F.lit("d"), model=down).first()
    assert (row.category, row.error) == ("other", "TimeoutError: down")


def test_request_and_block(spark):
    request = scraped(spark, text="", visual_tiles=[TILE]).select(render.model_request()).first()[0]
    assert request == (
        "URL: https://example.com/a\nSource Type: web\nTitle: Title\nAttached Visual Screenshot Tiles: 1 image(s).\n\n"
        "CONTENT TO ANALYZE:\n[Visual Document - See attached screenshot tiles]\n"
    )
    block = spark.range(1).select(render.taxonomy_block()).first()[0].split("\n")
    assert len(block) == 20 and block[0].startswith("- **research**: Academic papers")


def test_videos_and_papers(spark):
    videos = spark.createDataFrame([
        ("https://youtu.be/bkFnPiMHzcE?si=t", '{"title": "Empowering Assistants", "author_name": "Podcast"}', "Welcome. [music] We explore."),
        ("https://youtu.be/aaaaaaaaaaa", '{"title": "fourteen chars"}', None),
        ("https://youtu.be/bbbbbbbbbbb", '{"title": "fifteen chars.."}', ""),
    ], "url string, metadata string, transcript string")
    got = {r.url[-11:]: r for r in extract.capture_videos(videos).collect()}
    first = next(r for r in got.values() if r.title == "Empowering Assistants")
    assert first.text == (
        "# Video Title: Empowering Assistants\n# Channel / Creator: Podcast\n# URL: https://www.youtube.com/watch?v=bkFnPiMHzcE\n"
        "\n## Full Spoken Transcript:\nWelcome. We explore."
    )
    assert got["aaaaaaaaaaa"].failed_scrape and not got["bbbbbbbbbbb"].failed_scrape
    xml = (
        "<feed><title>q</title><entry>\n<title>Large\nModels</title><summary> We present. </summary>"
        "<author><name>Dr. Jane Doe</name></author>\n<author>\n<name>Dr. John Smith</name></author></entry></feed>"
    )
    papers = spark.createDataFrame([("https://arxiv.org/abs/2405.12345", xml), ("https://arxiv.org/abs/1.2", "<x/>")], "url string, xml string")
    full, empty = extract.capture_papers(papers).collect()
    assert full.text == (
        "# Title: Large Models\n# Authors: Dr. Jane Doe, Dr. John Smith\n# ArXiv ID: 2405.12345\n\n## Abstract:\nWe present."
    )
    assert empty.title == "ArXiv Paper 1.2" and "# Authors: Unknown" in empty.text and not full.failed_scrape


def test_repository_capture(spark):
    text = "# Tool\nA framework.\n" + "Detailed documentation. " * 30
    responses = spark.createDataFrame(
        [("https://github.com/o/r", 0, 404, text), ("https://github.com/o/r", 1, 200, "tiny"), ("https://github.com/o/r", 2, 200, text)],
        "url string, pos int, status int, text string",
    )
    row = extract.capture_repositories(responses).first()
    assert (row.source_type, row.title, row.failed_scrape) == ("github", "GitHub - o/r", False)


@pytest.mark.parametrize("height, count", [(1568, 1), (1569, 2), (3500, 3), (9000, 6)])
def test_tiles(spark, height, count):
    image = spark.createDataFrame([("https://h.org/a/b", 1280, height)], "url string, width int, height int")
    grid = tiles.tile_grid(image).orderBy("index").collect()
    assert len(grid) == count and grid[-1].bottom == height
    if height == 3500:
        assert [r.tile_height for r in grid] == [1568, 1568, 364]
    manifest = tiles.tile_arrays(image, "/v/attachments").first().visual_tiles
    assert len(manifest) == min(count, 5) and manifest[0].path.endswith("_tile_00.jpg")


def test_reminders(spark):
    items = spark.createDataFrame(
        [("https://linkedin.com/jobs/view/999", "Senior Developer", "job", "Requires SQL"), ("https://a", "b", "knowledge", "")],
        "url string, title string, item_type string, summary string",
    )
    (row,) = reminders.job_reminders(items, F.lit("2025-12-31 23:10:00").cast("timestamp")).collect()
    assert row.summary == "💼 Review Job: Senior Developer" and "https://linkedin.com/jobs/view/999" in row.description
    assert row.start.dateTime == "2026-01-01T09:00:00" and row.end.dateTime == "2026-01-01T09:30:00"
    assert [tuple(a) for a in row.reminders.overrides] == [("popup", 15), ("email", 60)]


def test_clock(spark):
    frame = spark.createDataFrame([(61.9,), (7200.0,)], "s double")
    assert [r[0] for r in frame.select(render.clock(F.col("s"))).collect()] == ["01m 01s", "120m 00s"]


def test_compendium(spark):
    body = "# N\n**Source URL**: [t](https://h.org/x)\n## AI Summary\nsum\n## Key Insights\n" + "".join(f"- i{i}\n" for i in range(7))
    body += "## Tags\n#a #b #c #d #e #f\n\n## Original Source\n" + "s" * 2501
    frame = files(
        spark, ("/v/tools/b.md", body), ("/v/tools/a.md", body), ("/v/agents/c.md", body), ("/v/big_data/d.md", body),
        ("/v/other/e.md", "short"), ("/v/NOTEBOOKLM_X.md", body),
    )
    lines = compile_notes(frame, F.lit("2025-10-01 08:05:00").cast("timestamp"))
    ordered = [r.line for r in lines.orderBy(*compendium.ORDER).collect()]
    assert ordered[2].endswith("2025-10-01 08:05 UTC | **Total Analyzed Sources**: 4 notes across 3 domains")
    assert [x for x in ordered if x.startswith("| **")][0].startswith("| **TOOLS** | `/tools` | 2 | Developer Tooling")
    heads = [x for x in ordered if x.startswith("# Chapter")]
    assert heads == [
        "# Chapter 1: TOOLS (2 Document Sources)", "# Chapter 2: AGENTS (1 Document Sources)", "# Chapter 3: BIG_DATA (1 Document Sources)",
    ]
    assert "*Technical domain analysis and synthesized notes.*\n" in ordered
    first = ordered[ordered.index("## N"):]
    first = first[: first.index("---\n")]
    assert first[2] == "- **Category Path**: `vault/tools/a.md`" and first[3] == "- **Tags**: #a #b #c #d #e"
    assert [x for x in first if x.startswith("- i")] == [f"- i{i}" for i in range(6)]
    assert first[-2] == "```text\n" + "s" * 2500 + notes.CONTINUED + "\n```"


def test_write_compendium(spark, tmp_path):
    frame = files(spark, *[(f"/v/tools/{i:03d}.md", f"# Note {i}\n" + "text " * 40) for i in range(40)])
    lines = compile_notes(frame, F.lit("2025-10-01 08:05:00").cast("timestamp"))
    compendium.write_compendium(lines, str(tmp_path / "out"))
    document = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    expected = "\n".join(r.line for r in lines.orderBy(*compendium.ORDER).collect()) + "\n"
    assert document == expected


def test_reorganise(spark):
    filler = "plain words " * 30
    frame = files(
        spark, ("/v/other/ml.md", "# Llama and qwen\n" + filler), ("/v/other/dead.md", "#failed_scrape"),
        ("/v/other/failed_long.md", "#failed_scrape " + filler), ("/v/other/keep.md", "# Nothing\n" + filler), ("/v/ML/ml.md", "older"),
    )
    plan = reorganize.reorganise(notes.parse_notes(frame.filter("category = 'other'")), "/v")
    assert [tuple(r) for r in plan.moves.collect()] == [("/v/other/ml.md", "/v/ML/ml.md", "ML", None)]
    assert tuple(plan.counters.first()) == (4, 1, 1, 1)
    after = {r.file_path: r for r in reorganize.files_after(frame, plan).collect()}
    assert set(after) == {"/v/ML/ml.md", "/v/other/failed_long.md", "/v/other/keep.md"}
    assert after["/v/ML/ml.md"].content.startswith("# Llama") and after["/v/ML/ml.md"].category == "ML"
