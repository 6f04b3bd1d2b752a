import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkcurate.operators import assemble, joins, links as link_ops, registry, resolve, stats
from linkcurate.plans import jobs
from linkcurate.schemas import CHECKPOINTS, MESSAGES, NOTE_FILES, REGISTRY
from linkcurate.sources.messages import cutoff, message_scan
from linkcurate.sources.notes import note_scan, read_notes
from linkcurate.sources.tables import KeyedTable, shared_folder
from linkcurate.sources.vault import Vault, export_notes
from linkcurate.streaming import ingest as streams


def at(day, hour=0):
    return dt.datetime(2025, 9, day, hour)


def record(url, path="/v/tools/a.md", category="tools", title="T", kind="knowledge", message=None, when=at(1)):
    return (url, title, path, category, kind, message, when, "")


def records(spark, *rows):
    return spark.createDataFrame(list(rows), REGISTRY)


def messages(spark, *rows):
    return spark.createDataFrame(list(rows), MESSAGES)


def files(spark, *rows):
    return spark.createDataFrame(
        [(p, p.rsplit("/", 1)[1], p.rsplit("/", 2)[1], c) for p, c in rows], NOTE_FILES
    )


def by_url(frame):
    return {r.url: r for r in frame.collect()}


def test_message_scan(spark):
    feed = messages(spark, (1, at(1), "a"), (2, at(2), "b"), (3, at(3), ""), (4, at(4), "c"), (5, None, "d"), (6, at(5), None))
    ids = lambda f: sorted(r.message_id for r in f.collect())
    assert ids(message_scan(feed, limit=4)) == [4, 5]          # texts are tested after the limit
    assert ids(message_scan(feed, cutoff("2025-09-02"))) == [2, 4, 5]
    assert ids(message_scan(feed, cutoff("2025-09-04"), 5)) == [4, 5]


def test_cutoff_reaches_the_scan(spark, tmp_path):
    messages(spark, (1, at(1), "a")).write.parquet(str(tmp_path / "m"))
    plan = message_scan(spark.read.parquet(str(tmp_path / "m")), cutoff("2025-09-02"), 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in text and "TakeOrderedAndProject" in text


def test_one_link_across_messages(spark):
    text = "https://a.org/x and https://a.org/x, https://b.org/y"
    hits = link_ops.message_links(messages(spark, (1, at(1), text), (2, at(2), text), (3, at(3), "https://a.org/x")))
    assert hits.count() == 5
    old, new = by_url(link_ops.one_per_url(hits, "oldest")), by_url(link_ops.one_per_url(hits, "newest"))
    assert (old["https://a.org/x"].message_id, new["https://a.org/x"].message_id, old["https://a.org/x"].hits) == (1, 3, 3)
    assert link_ops.distinct_urls(hits).count() == 2
    with pytest.raises(ValueError):
        link_ops.one_per_url(hits, "any")


def test_upsert(spark):
    old = records(spark, record("u1", message=7), record("u2", message=8))
    new = records(
        spark, record("u1", "/v/ML/n.md", "ML", "New", message=None, when=at(3)), record("u3", message=9, when=at(2)),
        record("u3", "/v/ML/z.md", "ML", "Later", message=None, when=at(4)),
    )
    got = by_url(registry.upsert(old, new))
    assert len(got) == 3 and got["u2"].telegram_message_id == 8
    assert (got["u1"].telegram_message_id, got["u1"].title, got["u1"].category) == (7, "New", "ML")
    assert (got["u3"].telegram_message_id, got["u3"].title) == (9, "Later")
    assert got["u1"].content_hash == ""
    again = registry.upsert(registry.upsert(old, new), new)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in got.values()}


def stored_files(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_keyed_table_rewrites_only_the_buckets_of_a_batch(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), REGISTRY, "url", 16, keep=("telegram_message_id",)).create()
    assert table.read().count() == 0
    table.merge(records(spark, *[record(f"https://a.org/{i}", message=i) for i in range(200)]), 0)
    before = stored_files(tmp_path / "t")
    assert len({p.parent for p in before}) == 16
    for batch in range(1, 6):
        table.merge(records(spark, record("https://a.org/7", title=f"T{batch}"), record("https://a.org/new", title=f"N{batch}")), batch)
    buckets = {f"bucket={b}" for b in table.touched(spark.createDataFrame([("https://a.org/7",), ("https://a.org/new",)], "url string"))}
    after = stored_files(tmp_path / "t")
    assert {p for p in before if p.parent.name not in buckets} == {p for p in after if p.parent.name not in buckets}
    assert all(after[p] == before[p] for p in before if p.parent.name not in buckets)
    assert len([p for p in after if p.parent.name in buckets]) <= len(buckets)  # no file is left of earlier batches
    got = by_url(table.read())
    assert len(got) == 201 and (got["https://a.org/7"].title, got["https://a.org/7"].telegram_message_id, got["https://a.org/new"].title) == ("T5", 7, "N5")
    some = table.touched(spark.createDataFrame([("https://a.org/7",)], "url string"))
    assert "https://a.org/7" in by_url(table.read(buckets=some)) and table.read(buckets=[]).count() == 0


def test_keyed_table_as_of_earlier_batches_and_run_twice(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), REGISTRY, "url", 4, keep=("telegram_message_id",)).create()
    table.merge(records(spark, record("a", title="0", message=5), record("b", title="0")), 0)
    for _ in range(3):
        table.merge(records(spark, record("a", title="1"), record("c", title="1")), 1)
        assert {r.url: r.title for r in table.read().collect()} == {"a": "1", "b": "0", "c": "1"}
        assert {r.url: (r.title, r.telegram_message_id) for r in table.read(1).collect()} == {"a": ("0", 5), "b": ("0", None)}
    table.merge(records(spark), 2)
    assert table.read().count() == 3
    table.merge(records(spark, record("a", title="3", message=9)), 3)
    assert {r.url: (r.title, r.telegram_message_id) for r in table.read().collect()} == {"a": ("3", 9), "b": ("0", None), "c": ("1", None)}
    assert by_url(table.read(3))["a"].title == "1"


def test_lookup_and_report(spark):
    table = records(spark, record("u1", category="agents"), record("u2", category="jobs", kind="job"))
    urls = spark.createDataFrame([("u1",), ("u1",), ("x",)], "url string")
    got = by_url(registry.lookup(urls, table))
    assert (got["u1"].hits, got["u1"].category, got["x"].category) == (2, "agents", None)
    assert [r.url for r in registry.registered(urls, table).collect()] == ["u1"]
    report = {r.category: (r.total, r.jobs) for r in stats.registry_report(table).collect()}
    assert report == {None: (2, 1), "agents": (1, 0), "jobs": (1, 1)}
    assert [r.category for r in stats.category_counts(table).collect()] == ["agents", "jobs"]
    assert registry.registry_scan(records(spark, *[record(f"u{i}", when=at(i + 1)) for i in range(5)])).first().url == "u4"


def test_checkpoints(spark):
    log = spark.createDataFrame([("id", "1", at(1)), ("id", "45678", at(2)), ("url", "u", at(1))], CHECKPOINTS)
    assert registry.read_checkpoint(log, "id").first().value == "45678"
    assert registry.read_checkpoint(log, "none").count() == 0
    newer = spark.createDataFrame([("id", "3", at(1))], CHECKPOINTS)
    assert {r.key: r.value for r in registry.upsert_checkpoints(log, newer).collect()} == {"id": "3", "url": "u"}


def test_reprocess_candidates(spark):
    table = records(
        spark, record("u1", category="other"), record("u2", title="It FAILED"), record("https://youtu.be/x", when=at(9)),
        record("u3"), record("u4", title=None),
    )
    assert [r.url for r in registry.reprocess_candidates(table).collect()] == ["https://youtu.be/x", "u1", "u2"]
    assert registry.reprocess_candidates(table, 1).count() == 1


def test_resolve_paths(spark):
    table = records(
        spark, record("https://h.org/kept", "/v/tools/kept.md"), record("https://h.org/moved", "/v/drafts/old.md"),
        record("https://h.org/named", "/v/drafts/named.md"), record("https://h.org/gone", "/v/drafts/gone.md"),
        record("https://h.org/a", "/v/drafts/x.md"),
    )
    vault = files(
        spark, ("/v/tools/kept.md", "url: https://h.org/kept"), ("/v/agents/new.md", 'x\nurl: "https://h.org/moved"\n'),
        ("/v/ML/named.md", "no address"), ("/v/ML/Title.md", ""), ("/v/tools/ab.md", "url: https://h.org/ab"),
        ("/v/tools/late.md", "\n" * 30 + "url: https://h.org/gone"),
    )
    items = spark.createDataFrame(
        [(f"https://h.org/{n}", c, "Title") for n, c in
         [("kept", "ML"), ("moved", "ML"), ("named", "ML"), ("gone", "hooks"), ("new1", "ML"), ("new2", "hooks"), ("new3", "hooks"), ("a", "hooks")]],
        "url string, category string, title string",
    )
    got = {u.rsplit("/", 1)[1]: (r.target_path, r.is_overwrite) for u, r in by_url(resolve.resolve_paths(items, table, vault, "/v")).items()}
    assert got == {
        "kept": ("/v/tools/kept.md", True), "moved": ("/v/agents/new.md", True), "named": ("/v/ML/named.md", True),
        "gone": ("/v/hooks/Title.md", False), "new1": ("/v/ML/Title.md", True), "new2": ("/v/hooks/Title.md", False),
        "new3": ("/v/hooks/Title.md", False), "a": ("/v/tools/ab.md", True),
    }
    exact = by_url(resolve.resolve_paths(items, table, vault, "/v", mode="exact"))
    assert exact["https://h.org/a"].target_path == "/v/hooks/Title.md"


@pytest.mark.parametrize("mode", ["prefix", "exact"])
def test_moved_by_address_same_on_both_ways(spark, monkeypatch, mode):
    urls = spark.createDataFrame([(f"https://h.org/{i}",) for i in range(30)], "url string")
    vault = files(spark, *[(f"/v/t/{i}.md", f"a\nurl: https://h.org/{i * 7}/tail{i}\nurl: 'https://h.org/{i}'\n") for i in range(40)])
    small = {tuple(r) for r in resolve.moved_by_address(urls, vault, mode).collect()}
    monkeypatch.setattr(resolve, "is_small", lambda rows: False)
    assert small == {tuple(r) for r in resolve.moved_by_address(urls, vault, mode).collect()} and len(small) == 30


def test_moved_by_prefix_equals_a_plain_search(spark):
    rng = random.Random(3)
    parts = ["http://h.org", "https://h.org", "https://h.org.uk", "https://www.a.com", "https://www.a.co", "nothing"]
    made = [rng.choice(parts) + "".join(rng.choice(["", "/x", "/xy", "?q=1", "/é"]) for _ in range(rng.randint(0, 3))) for _ in range(120)]
    quoted = [rng.random() < 0.3 for _ in made]
    vault = files(spark, *[(f"/v/t/{i:03d}.md", "url: " + (f'"{a}"' if q else a) + "\n") for i, (a, q) in enumerate(zip(made, quoted))])
    lost = sorted({rng.choice(made)[: rng.randint(11, 30)] for _ in range(80)} | {"https://h.org", "https://www.a.co"})
    got = {r.url: r.moved_path for r in resolve.moved_by_address(spark.createDataFrame([(u,) for u in lost], "url string"), vault).collect()}
    want = {}
    for u in lost:
        hits = [f"/v/t/{i:03d}.md" for i, (a, q) in enumerate(zip(made, quoted)) if a == u or (not q and a.startswith(u) and len(u) >= resolve.SHORTEST_URL)]
        if hits:
            want[u] = min(hits)
    assert got == want and len(want) > 30


def test_sync_moves_and_differences(spark):
    table = records(
        spark, record("u1", "/v/other/a.md", "other"), record("u2", "/v/other/a.md", "other"), record("u3", "/v/other/my a.md", "other"),
        record("u4", "/v/other/gone.md", "other"),
    )
    vault = files(spark, ("/v/jobs/a.md", ""), ("/v/ML/a.md", ""), ("/v/ML/new.md", ""))
    got = by_url(registry.sync_with_notes(table, vault))
    assert (got["u1"].file_path, got["u2"].category, got["u2"].item_type) == ("/v/jobs/a.md", "jobs", "job")
    assert got["u3"].file_path == "/v/other/my a.md" and got["u4"].category == "other"
    assert {r.file_path: r.records for r in registry.missing_files(table, vault).collect()}["/v/other/a.md"] == 2
    assert registry.unregistered_files(table, vault).count() == 3
    moves = spark.createDataFrame(
        [("/v/other/a.md", "/v/tools/a.md", "tools", None), ("/v/other/zz.md", "/v/ML/zz.md", "ML", "u4")],
        "source_path string, target_path string, category string, url string",
    )
    after = by_url(registry.apply_moves(table, moves))
    assert (after["u1"].file_path, after["u4"].file_path, after["u3"].file_path) == ("/v/tools/a.md", "/v/ML/zz.md", "/v/other/my a.md")


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti", "inner"])
def test_hot_keys_join_like_any_other(spark, how):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 10 == 1 else f"k{i % 40}") for i in range(3000)]
    left = spark.createDataFrame(rows, "id int, k string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 40, 2)], "k string, v int")
    assert [r.k for r in joins.hot_keys(left, "k", share=4, min_rows=10).collect()] == ["hot"]
    salted = joins.join_unique(left, right, "k", "id", how, small_bytes=-1, share=4, min_rows=10, salts=7)
    plain = left.join(right, "k", how)
    columns = plain.columns
    assert sorted(map(str, salted.select(columns).collect())) == sorted(map(str, plain.collect()))


def test_text_parts(spark):
    pieces = spark.createDataFrame(
        [("v", i, t) for i, t in enumerate([" b ", "", "c", "  ", "d", "e"])] + [("w", 3, "x")], "k string, pos int, text string"
    )
    parts = assemble.text_parts(pieces, ["k"], part_rows=2)
    assert {(r.k, r.part): r.text for r in parts.collect()} == {("v", 0): "b", ("v", 1): "c", ("v", 2): "d e", ("w", 1): "x"}
    assert {r.k: r.text for r in assemble.whole_texts(parts, ["k"]).collect()} == {"v": "b c d e", "w": "x"}


def test_thread_separator(one):
    links = ["https://x.com/a", "https://h.org/?from=twitter.com", "https://linkedin.com/feed", "https://h.org"]
    assert one(assemble.thread_separator, *links) == ["\n\n---\n\n", "\n\n---\n\n", "\n\n", None]


def test_model_errors_are_counted(spark):
    def picky(request, images):
        if "https://a.org/x" in request:
            raise ValueError("no")
        return '{"category": "tools"}'

    feed = messages(spark, (1, at(10), "https://a.org/x https://c.org/z"))
    done = run(
        spark, feed, records(spark), files(spark), material(spark, "https://a.org/x", "https://c.org/z"), model=picky
    )
    assert tuple(done.outcomes.first()) == (2, 0, 0)  # answered by default values, and named in errors
    assert [tuple(r) for r in done.errors.collect()] == [("https://a.org/x", "ValueError: no", False)]
    assert {r.category for r in done.results.collect()} == {"other", "tools"}


def test_tracks_and_candidates(spark):
    tracks = spark.createDataFrame([("v", "fr", 0), ("v", "uk", 1), ("w", "ja", 4), ("w", "ko", 2)], "video_id string, lang string, pos int")
    assert {r.video_id: r.lang for r in assemble.preferred_tracks(tracks).collect()} == {"v": "uk", "w": "ko"}
    got = assemble.first_usable(spark.createDataFrame(
        [("u", 0, 404, "x" * 99), ("u", 1, 200, "x" * 50), ("u", 2, 200, "y" * 51)], "url string, pos int, status int, text string"
    )).first()
    assert (got.pos, got.text[0]) == (2, "y")


PAGE = "<title>{0}</title><article><p>Llama and qwen: {0}. " + "Plain words follow here. " * 20 + "</p></article>"


def material(spark, *urls):
    return jobs.Fetched(pages=spark.createDataFrame([(u, PAGE.format(u[-1])) for u in urls], "url string, html string"))


def run(spark, feed, table, vault, fetched, **options):
    return jobs.ingest(feed, table, vault, fetched, "/v", now=F.lit("2025-10-01 10:00:00").cast("timestamp"), **options)


def test_batch_ingest(spark):
    feed = messages(spark, (101, at(10), "https://a.org/x https://b.org/y"), (102, at(11), "again https://a.org/x"))
    done = run(spark, feed, records(spark), files(spark), material(spark, "https://a.org/x"))
    got = by_url(done.results)
    assert got["https://a.org/x"].target_path == "/v/ML/x.md"
    assert got["https://a.org/x"].is_overwrite and not got["https://b.org/y"].is_overwrite  # x was written at its newer hit
    assert got["https://b.org/y"].title == "Failed Scrape - Untitled Document"
    assert by_url(done.updates)["https://a.org/x"].telegram_message_id == 101
    note = {r.file_path: r.content for r in done.notes.collect()}["/v/ML/x.md"]
    assert "date: 2025-09-10\ncategory: ML" in note and "Llama and qwen: x." in note
    assert tuple(done.outcomes.first()) == (2, 1, 0) and done.reminders.count() == 0
    assert {r.key: r.value for r in done.checkpoint_updates().collect()} == {
        "last_processed_message_id": "101", "last_processed_url": "https://b.org/y",
    }


def test_second_session_has_nothing_to_do(spark):
    feed = messages(spark, (1, at(10), "https://a.org/x"), (2, at(11), "https://a.org/x https://c.org/z"))
    fetched = material(spark, "https://a.org/x", "https://c.org/z")
    first = run(spark, feed, records(spark), files(spark), fetched, session=True)
    assert by_url(first.updates)["https://a.org/x"].telegram_message_id == 2
    table, vault = first.registry_after(records(spark)), first.notes
    second = run(spark, feed, table, vault, fetched, session=True)
    assert second.results.count() == 0 and tuple(second.outcomes.first()) == (0, 3, 0)
    lost = run(spark, feed, table, vault.filter("file_path like '%x.md'"), fetched, session=True)
    assert [r.url for r in lost.results.collect()] == ["https://c.org/z"]
    redo = run(spark, feed, table, vault, fetched, session=True, reprocess=True)
    assert redo.results.filter("is_overwrite").count() == 2


def test_reprocess_failed(spark):
    table = records(spark, record("https://a.org/x", "/v/other/f.md", "other", message=5), record("https://c.org/z", "/v/tools/z.md"))
    done = jobs.reprocess_failed(
        table, files(spark, ("/v/other/f.md", "")), material(spark, "https://a.org/x"), "/v",
        now=F.lit("2025-10-01 10:00:00").cast("timestamp"),
    )
    (row,) = done.results.collect()
    assert (row.url, row.category, row.target_path) == ("https://a.org/x", "ML", "/v/other/f.md")   # stored path wins
    assert done.updates.first().telegram_message_id == 5
    assert "date: 2025-10-01" in done.notes.first().content


def test_reorganize_and_sync_jobs(spark):
    vault = files(spark, ("/v/other/n.md", "# Llama\n" + "plain words " * 20))
    moved = jobs.reorganize(vault, records(spark, record("u", "/v/other/n.md", "other")), "/v")
    assert moved.registry.first().file_path == "/v/ML/n.md" and moved.files.first().category == "ML"
    assert jobs.sync_registry(records(spark, record("u", "/v/other/n.md", "other")), moved.files).first().category == "ML"


def test_note_files_on_disk(spark, tmp_path):
    rows = files(
        spark, (f"{tmp_path}/tools/My note + 50%.md", "a\nb\n"), (f"{tmp_path}/ML/ж.md", "c"), (f"{tmp_path}/NOTEBOOKLM_K.md", "d"),
    )
    assert export_notes(rows).count() == 3 and export_notes(rows).count() == 3
    back = read_notes(spark, str(tmp_path))
    assert {(r.file_path, r.content) for r in back.collect()} == {(r.file_path, r.content) for r in rows.collect()}
    assert {r.file_name for r in note_scan(back).collect()} == {"My note + 50%.md", "ж.md"}
    assert note_scan(back, "ML").count() == 1


def test_attempts_at_the_same_time_leave_whole_files(spark, tmp_path):
    path = f"{tmp_path}/tools/one.md"
    rows = files(spark, *[(path, f"{i} " * 200_000) for i in range(8)]).repartition(8)
    assert export_notes(rows).count() == 8
    whole = Path(path).read_text()
    assert len(set(whole.split())) == 1 and len(whole.split()) == 200_000 and [p.name for p in Path(path).parent.iterdir()] == ["one.md"]


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    days = [(i, at(1 + i % 9, i % 20), f"https://h{i % 7}.org/p and https://a.org/{i % 5}") for i in range(60)]
    for part in range(3):
        messages(spark, *days[part * 20:part * 20 + 20]).coalesce(1).write.mode("append").parquet(source)
    fetched = material(spark, "https://a.org/1", "https://a.org/2")
    vault = Vault.at(spark, str(tmp_path / "vault"))
    now = F.lit("2025-10-01 10:00:00").cast("timestamp")
    counted = []
    work = streams.ingest_batch(
        vault, lambda: fetched, "/v", now=now, on_done=lambda done, batch: counted.append(tuple(done.outcomes.first()))
    )

    def go():
        query = (
            streams.stream_files(spark, source, files_per_trigger=1).writeStream.foreachBatch(work)
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        assert streams.run_for(query, 120)

    go()
    feed = spark.read.parquet(source)
    urls = {r.url for r in link_ops.distinct_urls(link_ops.message_links(feed)).collect()}
    table = vault.registry.read()
    assert {r.url for r in table.collect()} == urls and table.count() == len(urls)
    assert len(counted) == 3 and sum(c[0] for c in counted) == len(urls) and sum(c[0] + c[1] for c in counted) == 120
    batch = by_url(run(spark, feed, records(spark), files(spark), fetched, session=True).results)
    assert {r.url: r.category for r in table.collect()} == {u: r.category for u, r in batch.items()}

    go()   # nothing new: the query resumes after the last file
    assert len(counted) == 3


def test_batches_may_run_twice(spark, tmp_path):
    vault = Vault.at(spark, str(tmp_path / "vault"))
    now = F.lit("2025-10-01 10:00:00").cast("timestamp")
    work = streams.ingest_batch(vault, lambda: material(spark, "https://a.org/1"), "/v", now=now)
    parts = [
        messages(spark, *[(10 * b + i, at(1 + b, i), f"https://a.org/{b + i}") for i in range(3)]) for b in range(3)
    ]

    def state():
        return [sorted(map(str, t.read().collect())) for t in (vault.registry, vault.notes, vault.checkpoints)]

    for number, part in enumerate(parts[:2]):
        work(part, number)
    once = state()
    assert len(once[0]) == 4 and len(once[2]) == 2
    work(parts[1], 1)
    assert state() == once
    work(parts[1].limit(0), 2)   # an empty batch
    assert state() == once
    work(parts[2], 3)
    assert len(state()[0]) == 5


def test_bounded_stream_dedupe_and_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    messages(spark, *[(i, at(1 + i), "https://a.org/x https://b.org/y") for i in range(5)]).write.parquet(source)
    stream = streams.stream_files(spark, source)
    out = str(tmp_path / "out")
    links = streams.first_links(streams.link_stream(stream, cutoff("2025-09-03")), "30 days")
    query = (
        links.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "s1"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 2
    counts = []
    query = (
        streams.running_counts(streams.link_stream(stream)).writeStream.outputMode("complete")
        .foreachBatch(lambda rows, _: counts.append({r.source_type: r.n for r in rows.collect()}))
        .option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert counts[-1] == {"web": 10}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_page_stands_in_for_missing_material_and_repeats_count_once(spark):
    links = ["https://github.com/o/r", "https://arxiv.org/abs/2401.00001", "https://github.com/o/good", "https://a.org/x"]
    fetched = jobs.Fetched(
        pages=spark.createDataFrame([(u, PAGE.format("p")) for u in [*links, links[3]]], "url string, html string"),
        readmes=spark.createDataFrame([(links[0], 0, 404, ""), (links[2], 0, 200, "A readme of its own. " * 40)], "url string, pos int, status int, text string"),
    )
    done = jobs.ingest_links(
        spark.createDataFrame([(u,) for u in [*links, links[0], None, ""]], "url string"), records(spark), files(spark), fetched, "/v",
        now=F.lit("2025-10-01 10:00:00").cast("timestamp"),
    )
    got = by_url(done.items)
    assert set(got) == set(links) and done.results.count() == 4
    assert all("Llama and qwen: p." in got[u].original_text for u in (links[0], links[1], links[3]))
    assert got[links[2]].original_text.startswith("A readme of its own.")


def test_bounded_stream_dedupe_keeps_old_messages(spark, tmp_path):
    for i, day in enumerate((30, 10, 1)):
        messages(spark, (i, at(day), f"https://a.org/{i} https://a.org/0")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(messages(spark, (1, at(1), "")).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = streams.first_links(streams.link_stream(stream), "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out")
    query.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = [r.url for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == [f"https://a.org/{i}" for i in range(3)]


def test_repeated_keys_and_named_references(spark, one):
    from linkcurate.functions import feeds, html

    row = one(feeds.parse_answer, '{"title":"a","title":"b","category":"tools"}')
    assert (row.title, row.category) == ("b", "tools")
    assert one(html.unescape, "a &mdash; &eacute; &copy;&amp;lt; &#233;&#x41;; &nosuch; &comma; & &") == "a — é ©&lt; éA; &nosuch; , & &"
