"""The library's input tables derived from the driver's tables, in Spark and in SQL.

Each input is defined twice, as a function over `(spark, folder)` and as a
common table expression of `CTES`; both cover their tables completely.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcurate.functions.classify import item_type
from linkcurate.functions.notes import file_name
from linkcurate.functions.render import note_markdown, note_path
from linkcurate.functions.text import SPACES
from linkcurate.functions.urls import authority
from linkcurate.operators.links import message_links, one_per_url
from linkcurate.rules import TAXONOMY
from linkcurate.schemas import TILE
from linkcurate.sources.messages import message_stream as stream_files
from linkcurate.sources.tables import balanced, materialize

VAULT = "/vault"
NOTE_DAY = "2025-09-20"
CATEGORIES = list(TAXONOMY)

# Ranked pseudo-word rules that hit the synthetic prose; hints and tools tie on purpose.
PROSE_RULES = {
    "jobs": [r"\b(?:the|and)\b", r"\b(?:that|with)\b"],
    "agents": [r"\b(?:und|der|die)\b"],
    "ML": [r"\b(?:que|des|les)\b"],
    "hints": [r"\b(?:para|los|por)\b"],
    "tools": [r"\b(?:para|los|por)\b"],
    "cases": [r"\b(?:of|to|in)\b", r"\b(?:for|on)\b"],
}
# Routes by parts of the synthetic hosts.
HOST_ROUTES = [("blog", ["blog."]), ("mobile", ["m."]), ("spam", ["spam-farm", "cheap-pills"]), ("org", [".org"])]


@cache
def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@cache
def documents(spark: SparkSession, folder: str) -> DataFrame:
    return balanced(table(spark, folder, "documents"))


@cache
def pages(spark: SparkSession, folder: str) -> DataFrame:
    return balanced(table(spark, folder, "pages"))


def _text_of(events: DataFrame, page_urls: DataFrame, number: Column) -> DataFrame:
    again = F.concat("event_type", F.lit(" "), "url", F.lit(", again "), "url", F.lit("! "), "props")
    keyed = events.withColumn("page_id", F.pmod(F.col("event_id"), number))
    return keyed.join(page_urls, "page_id").select(
        F.col("event_id").alias("message_id"), F.col("ts").alias("date"), again.alias("text"), "event_type"
    )


@cache
def messages(spark: SparkSession, folder: str) -> DataFrame:
    page_urls = table(spark, folder, "pages").select("page_id", "url")
    return _text_of(balanced(table(spark, folder, "events")), page_urls, page_urls.select(F.count("*")).scalar())


def message_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same messages as a stream over the event files."""
    page_urls = table(spark, folder, "pages").select("page_id", "url")
    events = stream_files(spark, folder, schema=table(spark, folder, "events").schema, file_glob="event*.parquet")
    return _text_of(events, page_urls, F.lit(page_urls.count())).withColumn("date", F.col("date").cast("timestamp"))


@cache
def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that exist for the registered .org pages, as files."""
    rows = _of_hosts(page_registry(spark, folder), [".org"])
    return rows.select(
        "file_path", file_name(F.col("file_path")).alias("file_name"), "category",
        F.concat(F.lit("---\nurl: "), "url", F.lit("\n---\n")).alias("content"),
    )


def links(spark: SparkSession, folder: str) -> DataFrame:
    return message_links(messages(spark, folder))


@cache
def triaged(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as triage rows: category from the source, tags from language and label."""
    labelled = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    categories = F.array(*[F.lit(c) for c in CATEGORIES])
    place = F.substring("source", 4, 10).cast("int") + 1
    first = F.nullif(F.regexp_extract("text", r"^[^.\n]*", 0), F.lit(""))
    doc = F.col("doc_id").cast("string")
    tile = F.struct(
        F.concat(F.lit("/vault/attachments/doc_"), doc, F.lit("_tile_00.jpg")).alias("path"),
        F.lit(0).alias("index"), F.lit(1280).alias("width"), F.lit(900).alias("height"),
    )
    return labelled.select(
        "doc_id", "lang", "source", "quality",
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), doc).alias("url"),
        F.concat(doc, F.lit(" "), F.coalesce(first, F.lit("Untitled"))).alias("title"),
        F.element_at(categories, place).alias("category"),
        F.col("text").alias("summary"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("insights"),
        F.array(
            F.col("lang"), F.col("source"),
            F.concat(F.lit("quality-label "), F.coalesce(F.col("quality").cast("string"), F.lit("none"))),
        ).alias("tags"),
        F.when(F.col("lang") == "de", F.array(F.concat(F.lit(" print("), doc, F.lit(") "))))
        .otherwise(F.array().cast("array<string>")).alias("code_snippets"),
        F.col("text").alias("original_text"),
        F.when(F.col("toxic") == 1, F.array(tile)).otherwise(F.array()).cast(f"array<{TILE.simpleString()}>").alias("visual_tiles"),
        F.lit(NOTE_DAY).alias("date_str"),
    ).withColumn("item_type", item_type(F.col("category")))


@cache
def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Rendered notes as files of a vault, with the document they come from; stored once, as a vault is."""
    rows = triaged(spark, folder)
    path = note_path(VAULT, F.col("category"), F.col("title"))
    files = rows.select(
        path.alias("file_path"), file_name(path).alias("file_name"), "category",
        note_markdown().alias("content"), "doc_id", "lang", "quality", "url", "title", F.sha2("original_text", 256).alias("content_hash"),
    )
    return materialize(files, "notes")


@cache
def page_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the links to .org and .com hosts, oldest message first; stored once, as a registry is, so that jobs do not extract the links at each use."""
    return materialize(_records(links(spark, folder), [".org", ".com"], "other"), "registry")


def page_updates(spark: SparkSession, folder: str) -> DataFrame:
    """An update for every hit of a link to a .net or .com host; errors carry no message id."""
    found = message_links(messages(spark, folder), "event_type")
    return _rows(_of_hosts(found, [".net", ".com"]), "tools", F.col("event_type") != "error")


def _of_hosts(rows: DataFrame, ends: list[str]) -> DataFrame:
    host = authority(F.col("url"))
    keep = host.endswith(ends[0])
    for end in ends[1:]:
        keep = keep | host.endswith(end)
    return rows.filter(keep)


def _rows(rows: DataFrame, category: str, numbered: Column) -> DataFrame:
    return rows.select(
        "url",
        F.concat(F.lit("Page "), F.col("message_id").cast("string")).alias("title"),
        F.concat(F.lit(f"/vault/{category}/"), F.md5("url"), F.lit(".md")).alias("file_path"),
        F.lit(category).alias("category"),
        F.lit("knowledge").alias("item_type"),
        F.when(numbered, F.col("message_id")).alias("telegram_message_id"),
        F.col("date").alias("processed_at"),
        F.sha2("url", 256).alias("content_hash"),
    )


def _records(rows: DataFrame, ends: list[str], category: str) -> DataFrame:
    return _rows(one_per_url(_of_hosts(rows, ends)), category, F.lit(True))


@cache
def note_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the labelled notes; those not in English still point to `drafts`."""
    rows = notes(spark, folder).filter(F.col("quality").isNotNull())
    english = F.col("lang") == "en"
    return rows.select(
        "url", "title",
        F.when(english, F.col("file_path")).otherwise(F.concat(F.lit("/vault/drafts/"), "file_name")).alias("file_path"),
        F.when(english, F.col("category")).otherwise(F.lit("drafts")).alias("category"),
        item_type(F.col("category")).alias("item_type"),
        F.col("doc_id").alias("telegram_message_id"),
        (F.lit("2025-09-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("doc_id"))).alias("processed_at"),
        "content_hash",
    )


@cache
def vault_files(spark: SparkSession, folder: str) -> DataFrame:
    """The notes as files; the Spanish ones lost their front-matter address."""
    return notes(spark, folder).withColumn(
        "content",
        F.when(F.col("lang") == "es", F.replace("content", F.lit("url: "), F.lit("link: "))).otherwise(F.col("content")),
    )


# --- The same inputs in SQL -------------------------------------------------

def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


SQL_SPACES = " || ".join(f"chr({ord(c)})" for c in SPACES)


def sql_strip(x: str) -> str:
    return f"trim({x}, {SQL_SPACES})"


def sql_squeeze(x: str) -> str:
    blanks = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    return sql_strip(rf"regexp_replace({blanks}, '\n\s*\n+', chr(10) || chr(10), 'g')")


def sql_safe_name(x: str, size: int = 80) -> str:
    bare = rf"""regexp_replace({x}, '[\\/*?:"<>|#\[\]^~`]', '', 'g')"""
    name = sql_strip(rf"regexp_replace({bare}, '[\s_]+', ' ', 'g')")
    name = f"CASE WHEN {name} = '' THEN 'untitled_note' ELSE {name} END"
    return (
        f"CASE WHEN length({name}) > {size} THEN regexp_replace(substr({name}, 1, {size}), ' [^ ]*$', '') "
        f"ELSE {name} END"
    )


SQL_LINK = r"""(?i)https?://(?:[a-z0-9-]+\.)+[a-z]{2,}(?::\d+)?(?:/[^\s<>''"`()]*)*"""
SQL_HOST = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"


def sql_section(heading: str, content: str = "content") -> str:
    return sql_strip(rf"regexp_extract({content}, '(?s)##\s+{heading}\s*\n(.*?)(?:\n##|\z)', 1)")


_TAGS = "list_filter(tags, lambda t: t <> '')"
_TAG_LINE = f"array_to_string([('#' || translate(ltrim(t, '#'), ' -', '__')) FOR t IN {_TAGS}], ' ')"
SQL_CONTENT = sql_strip(
    "'---\nurl: ' || url || '\ndate: ' || date_str || '\ncategory: ' || category || '\ntype: ' || item_type"
    " || '\n---\n\n# ' || title || '\n\n## AI Summary\n' || summary || '\n\n## Key Insights\n'"
    " || CASE WHEN len(insights) > 0 THEN array_to_string(['- ' || i FOR i IN insights], chr(10))"
    " ELSE '- No specific insights extracted.' END"
    " || CASE WHEN len(code_snippets) > 0 THEN '\n\n## Code Snippets\n' || array_to_string("
    f"['```\n' || {sql_strip('s')} || '\n```' FOR s IN code_snippets], chr(10) || chr(10)) ELSE '' END"
    " || CASE WHEN len(tile_paths) > 0 THEN '\n\n## Visual Snapshots\n' || array_to_string("
    "['![Visual Snapshot 1](../attachments/' || regexp_extract(p, '[^/]*$') || ')' FOR p IN tile_paths], chr(10) || chr(10)) ELSE '' END"
    f" || '\n\n## Tags\n' || {_TAG_LINE} || '\n\n---\n## Original Source\n' || original_text || '\n'"
) + " || chr(10)"

# Name, tables it builds on, body. Order matters: later ones use earlier ones.
CTES: dict[str, tuple[list[str], str]] = {
    "messages": ([], """
        SELECT e.event_id AS message_id, e.ts AS date, e.event_type,
               e.event_type || ' ' || p.url || ', again ' || p.url || '! ' || e.props AS text
        FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)"""),
    "links": (["messages"], rf"""
        SELECT message_id, date, event_type, url,
               CAST(row_number() OVER (PARTITION BY message_id ORDER BY min(i)) - 1 AS INTEGER) AS pos
        FROM (SELECT message_id, date, event_type, rtrim(unnest(us), '.,!?:;)') AS url,
                     generate_subscripts(us, 1) AS i
              FROM (SELECT *, regexp_extract_all(text, '{SQL_LINK}') AS us FROM messages))
        GROUP BY message_id, date, event_type, url"""),
    "oldest": (["links"], """
        SELECT url, arg_min(message_id, (date, message_id, pos)) AS message_id, min(date) AS date,
               arg_min(pos, (date, message_id, pos)) AS pos, count(*) AS hits
        FROM links GROUP BY url"""),
    "newest": (["links"], """
        SELECT url, arg_max(message_id, (date, message_id, pos)) AS message_id, max(date) AS date,
               arg_max(pos, (date, message_id, pos)) AS pos, count(*) AS hits
        FROM links GROUP BY url"""),
    "triaged": ([], f"""
        SELECT d.doc_id, lang, source, quality,
               'https://' || source || '.example.org/' || lang || '/' || d.doc_id AS url,
               d.doc_id || ' ' || coalesce(nullif(regexp_extract(text, '^[^.\n]*'), ''), 'Untitled') AS title,
               {sql_list(CATEGORIES)}[CAST(substr(source, 4) AS INTEGER) + 1] AS category,
               CASE WHEN source = 'src{CATEGORIES.index("jobs")}' THEN 'job' ELSE 'knowledge' END AS item_type,
               text AS summary,
               list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS insights,
               [lang, source, 'quality-label ' || coalesce(CAST(quality AS VARCHAR), 'none')] AS tags,
               CASE WHEN lang = 'de' THEN [' print(' || d.doc_id || ') '] ELSE [] END AS code_snippets,
               text AS original_text,
               CASE WHEN toxic = 1 THEN ['/vault/attachments/doc_' || d.doc_id || '_tile_00.jpg'] ELSE [] END AS tile_paths,
               '{NOTE_DAY}' AS date_str
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""),
    "notes": (["triaged"], f"""
        SELECT '{VAULT}/' || category || '/' || file_name AS file_path, *
        FROM (SELECT {sql_safe_name('title')} || '.md' AS file_name, category,
                     {SQL_CONTENT} AS content, doc_id, lang, quality, url, title, summary, insights, original_text
              FROM triaged)"""),
    "page_registry": (["oldest"], f"""
        SELECT url, 'Page ' || message_id AS title, '/vault/other/' || md5(url) || '.md' AS file_path,
               'other' AS category, 'knowledge' AS item_type, message_id AS telegram_message_id,
               date AS processed_at, sha256(url) AS content_hash
        FROM oldest WHERE {SQL_HOST} LIKE '%.org' OR {SQL_HOST} LIKE '%.com'"""),
    "page_updates": (["links"], f"""
        SELECT url, 'Page ' || message_id AS title, '/vault/tools/' || md5(url) || '.md' AS file_path,
               'tools' AS category, 'knowledge' AS item_type,
               CASE WHEN event_type <> 'error' THEN message_id END AS telegram_message_id,
               date AS processed_at, sha256(url) AS content_hash
        FROM links WHERE {SQL_HOST} LIKE '%.net' OR {SQL_HOST} LIKE '%.com'"""),
    "note_registry": (["notes"], """
        SELECT url, title,
               CASE WHEN lang = 'en' THEN file_path ELSE '/vault/drafts/' || file_name END AS file_path,
               CASE WHEN lang = 'en' THEN category ELSE 'drafts' END AS category,
               CASE WHEN category = 'jobs' THEN 'job' ELSE 'knowledge' END AS item_type,
               doc_id AS telegram_message_id,
               TIMESTAMP '2025-09-01 00:00:00' + to_seconds(doc_id) AS processed_at,
               sha256(original_text) AS content_hash
        FROM notes WHERE quality IS NOT NULL"""),
    "vault_files": (["notes"], """
        SELECT * REPLACE (CASE WHEN lang = 'es' THEN replace(content, 'url: ', 'link: ') ELSE content END AS content)
        FROM notes"""),
}


def with_ctes(names: list[str], body: str) -> str:
    """A statement over the named inputs and all they build on."""
    wanted: set[str] = set()

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        wanted.add(name)

    for name in names:
        need(name)
    parts = [f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in CTES if name in wanted]
    return f"WITH {', '.join(parts)}\n{body}" if parts else body
