"""Steps that a job or an input runs once, whatever reads them."""

import datetime
import hashlib
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from linkcurate.functions import text
from linkcurate.plans import inputs, jobs
from linkcurate.schemas import NOTE_FILES, REGISTRY
from linkcurate.sources import notes as note_source
from linkcurate.sources.notes import note_scan, read_notes
from linkcurate.sources.tables import balanced


@pytest.fixture
def folder(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    urls = ["https://a.example.org/1", "http://b.example.com/2", "http://c.example.net/3"]
    pages = [(i, u, f"<html><title>T{i}</title><p>{'words and more ' * 30}</p></html>") for i, u in enumerate(urls)]
    events = [(i, day + datetime.timedelta(seconds=i), "view" if i % 2 else "error", None if i == 5 else '{"k": 1}') for i in range(9)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_registry_is_stored(spark, folder):
    found = inputs.page_registry(spark, folder)
    assert not any("events.parquet" in f for f in found.inputFiles())
    assert not any("events.parquet" in f for f in inputs.page_files(spark, folder).inputFiles())
    again = inputs._records(inputs.links(spark, folder), [".org", ".com"], "other")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))
    assert found.dtypes == again.dtypes


def test_material_is_parsed_once(spark, monkeypatch):
    """Triage reads captures that are stored, so its two filters do not parse the pages again."""
    seen = []
    triage = jobs.triage
    monkeypatch.setattr(jobs, "triage", lambda scraped, *args, **kwargs: seen.append(scraped) or triage(scraped, *args, **kwargs))
    messages = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), "see http://b.example.com/2 and http://c.example.com/3")], "message_id long, date timestamp, text string")
    pages = spark.createDataFrame([("http://b.example.com/2", f"<title>T</title><p>{'words and more ' * 30}</p>")], "url string, html string")
    done = jobs.ingest(messages, spark.createDataFrame([], REGISTRY), spark.createDataFrame([], NOTE_FILES), jobs.Fetched(pages=pages), "/vault", now=F.lit("2025-01-01").cast("timestamp"))
    assert seen[0].inputFiles() and all("/captures-" in f for f in seen[0].inputFiles())
    assert {r.url: r.title for r in done.items.collect()} == {"http://b.example.com/2": "T", "http://c.example.com/3": "Failed Scrape - Untitled Document"}


def test_stutters_need_no_word_list(one, spark):
    """Runs are folded by one pattern; only ı and ſ, which it would equate to i and s, need the list of words."""
    plan = spark.range(1).select(text.fold_stutters(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan
    given = ["So so SO end end", "ſo so So", "ı i I İ", "it it_ it it", "éso so so", "so so\x1cSO so-so", "sſ ss ss", "да  Да\nдА x"]
    want = ["So end", "ſo so", "ı i", "it it_ it", "éso so", "so so-so".replace("so so", "so", 1), "sſ ss", "да x"]
    want[5] = "so-so"
    assert one(text.fold_stutters, *given) == want


def test_notes_are_read_as_bytes(spark, tmp_path):
    """A note file costs no job configuration of its own; contents and names stay as they are."""
    told = {"a/x + y%20.md": "ünï\n\ntext\r\n".encode(), "bad.md": b"\xff\xfe ok", "a/.hidden.md": b"no", "a/other.txt": b"no", "a/d.md.1.writing": b"no"}
    for name, content in told.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    read = read_notes(spark, str(tmp_path))
    assert "binaryfile" in read._jdf.queryExecution().executedPlan().toString().lower()
    got = {r.file_path: (r.file_name, r.category, bytes(r.b)) for r in read.withColumn("b", F.col("content").cast("binary")).collect()}
    assert got == {f"{tmp_path}/{n}": (n.split("/")[-1], f"{tmp_path}/{n}".split("/")[-2], c) for n, c in told.items() if n.endswith(".md") and "hidden" not in n}


def _rows(read):
    return sorted((r.file_path, r.file_name, r.category, bytes(r.b)) for r in read.withColumn("b", F.col("content").cast("binary")).collect())


def test_large_vaults_are_listed_by_executors(spark, tmp_path, monkeypatch):
    """Above a number of files the driver's plan names none of them; the rows are those of Spark's reader."""
    monkeypatch.setattr(note_source, "HELD_BYTES", 10)
    told = {
        "a/x + y%20.md": "ünï\n\ntext\r\n".encode(), "a/_k=v.md": b"kept", "b/c/d/deep #?&.md": b"long " * 10, "bad.md": b"\xff\xfe ok", "_u=1/x.md": b"kept", "dir.md/ж.md": b"c",
        "a/.hidden.md": b"no", "a/_under.md": b"no", "a/_metadata.md": b"no", "a/empty.md": b"", "a/other.txt": b"no", "a/d.md.1.writing": b"no", "a/up.MD": b"no", ".h/x.md": b"no", "_u/x.md": b"no",
    }
    for name, content in told.items():
        (tmp_path / "v" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "v" / name).write_bytes(content)
    (tmp_path / "v/linked").symlink_to(tmp_path / "v/a")
    (tmp_path / "v/gone.md").symlink_to(tmp_path / "v/nowhere")
    (tmp_path / "v/nothing").mkdir()
    vault = str(tmp_path / "v")
    want = _rows(read_notes(spark, vault))
    assert len(want) == 8 and {r[3] for r in want} == {c for c in told.values() if c not in (b"", b"no")}
    for given in (vault, f"{vault}/", f"file://{vault}"):
        large = read_notes(spark, given, few=15)  # of 16 files that are not hidden
        assert "binaryfile" not in large._jdf.queryExecution().executedPlan().toString().lower()
        assert large.schema == read_notes(spark, given).schema and _rows(large) == want
    assert "binaryfile" in read_notes(spark, vault, few=16)._jdf.queryExecution().executedPlan().toString().lower()
    by_store = note_source.note_list(spark, f"file://{vault}").collect()  # as in a store that has an address
    assert sorted((r.path, r.size) for r in by_store) == sorted((f"file://{r[0]}", len(r[3])) for r in want)


def test_large_vaults_are_read_as_far_as_asked_for(spark, tmp_path):
    for name in ("a/1.md", "a/2.md", "b/3.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    large = read_notes(spark, str(tmp_path), few=0)
    shutil.rmtree(tmp_path / "b")  # listed, no longer there
    assert {r.file_name for r in large.select("file_name").collect()} == {"1.md", "2.md", "3.md"}
    assert {r.content for r in note_scan(large, "a").collect()} == {"a/1.md", "a/2.md"}


@pytest.mark.parametrize("few", [0, 9])
def test_other_vaults_are_left_to_sparks_reader(spark, tmp_path, few):
    """A pattern of folders, one file, and a folder that is not there."""
    for name in ("a1/1.md", "a2/2.md", "b/3.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    assert {r.content for r in read_notes(spark, f"{tmp_path}/a*", few).collect()} == {"a1/1.md", "a2/2.md"}
    assert [r.content for r in read_notes(spark, f"{tmp_path}/b/3.md", few).collect()] == ["b/3.md"]
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_notes(spark, f"{tmp_path}/none", few)


def test_stored_notes_hold_no_second_copy_of_the_text(spark, tmp_path):
    docs = [(1, "One. Two.\n\nThree", "en", "src1"), (2, None, "de", "src2"), (3, "", "fr", "src3"), (4, "Four", "es", "src4")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert "original_text" not in inputs.notes(spark, str(tmp_path)).columns
    got = {r.telegram_message_id: r.content_hash for r in inputs.note_registry(spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t, _, _ in docs}


def test_a_row_group_is_spread(spark, tmp_path, monkeypatch):
    """One task reads a whole row group, so a file of one fills one split of many; a table spread already is left alone."""
    rows = pa.table({"i": list(range(4000)), "x": [hashlib.sha256(str(i).encode()).hexdigest() for i in range(4000)]})
    pq.write_table(rows, f"{tmp_path}/one.parquet")
    pq.write_table(rows, f"{tmp_path}/many.parquet", row_group_size=50)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        cores = spark.sparkContext.defaultParallelism
        one = spark.read.parquet(f"{tmp_path}/one.parquet")
        assert one.rdd.getNumPartitions() >= cores
        spread = balanced(one)
        held = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
        assert len(held) >= cores and max(held) * cores <= 1.5 * 4000
        assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, one.collect()))
        many = spark.read.parquet(f"{tmp_path}/many.parquet")
        assert balanced(many) is many
        empty = one.limit(0)
        assert balanced(empty) is empty
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_gates_know_whole_words_between_hyphens(one):
    pattern = r"\b(?:ci/cd|multi-agent|github\s*-\s*|agents?-x)\b"
    assert text.required_words(pattern) == [("agent", False), ("ci", True), ("github", True), ("multi", True)]
    given = ["CI/CD", "a multi-agent", "githubs - x", "GitHub\t- x", "precise", "multiples", "agents-x", "agenten", "\u212a", "GıTHUB -x", None]
    words = [f"w{i}" for i in range(text.FEW_WORDS + 1)]
    many = rf"\b(?:{'|'.join(words)})\b"
    got = one(lambda x: text.gated(text.fold_case(x), [pattern, many], lambda g: g[0]), *given)
    assert got == [True, True, False, True, False, False, True, True, False, True, None]
    assert one(text.fold_case, *given) == ["ci/cd", "a multi-agent", "githubs - x", "github\t- x", "precise", "multiples", "agents-x", "agenten", "k", "github -x", None]


def test_words_are_looked_up_in_distinct_pieces(one, spark):
    """A text is split at every sign only once its repeated pieces are gone, and no word is lost by that."""
    words = [f"w{i}" for i in range(text.FEW_WORDS + 1)]
    patterns = [rf"\b(?:{'|'.join(words)})\b", r"\b(?:two\s+parts|courses?)\b"]
    gates = lambda x: text.gated(text.fold_case(x), patterns, lambda g: F.array(*g))
    given = ["w3 w3 w3", "x w3,x w3", "(W7)\nend", "w33 w\u00e33", "two  two\tparts", "intercourse", " ", "", None]
    assert one(gates, *given) == [[True, False], [True, False], [True, False], [False, False], [False, True], [False, True], [False, False], [False, False], [None, None]]
    plan = spark.range(1).select(gates(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(split(" in plan
