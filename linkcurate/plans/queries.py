"""Named queries over the driver's tables, each with its SQL twin where one exists."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkcurate.functions import feeds, html, notes as note_fields, quality, render, text, urls
from linkcurate.functions.classify import classify, rule_scores
from linkcurate.operators import (
    assemble, compendium, extract, links as link_ops, registry, reminders, reorganize, resolve, stats, tiles, triage,
)
from linkcurate.plans import inputs, jobs
from linkcurate.plans.inputs import (
    CATEGORIES, HOST_ROUTES, PROSE_RULES, SQL_HOST, VAULT, sql_list, sql_safe_name, sql_section, sql_squeeze,
    sql_strip, sql_text, with_ctes,
)
from linkcurate.rules import (
    CATEGORY_PATTERNS, CHAPTER_THEME_DEFAULT, DOMAIN_THEMES, KEYWORD_FALLBACK, LOGIN_PATTERNS, PROMO_PATTERNS, ROUTES,
    SOUND_TAGS, TABLE_THEME_DEFAULT,
)
from linkcurate.schemas import REGISTRY
from linkcurate.sources.messages import cutoff, message_scan
from linkcurate.sources.notes import note_scan, read_notes
from linkcurate.sources.tables import KeyedTable, materialize, shared_folder
from linkcurate.sources.vault import Vault, export_notes
from linkcurate.streaming import ingest as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *needs: str) -> Callable[[Query], Query]:
    """Register a query under its function name, with SQL over the named inputs."""
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = with_ctes(list(needs), sql)
        return function

    return add


def moment(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_moment(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


def sql_routes(host: str, routes, default: str = "web") -> str:
    cases = " ".join(
        f"WHEN {' OR '.join(f'contains({host}, {sql_text(p)})' for p in parts)} THEN {sql_text(name)}"
        for name, parts in routes
    )
    return f"CASE {cases} ELSE {sql_text(default)} END"


# --- Messages and links -------------------------------------------------------

@query(
    f"""SELECT {sql_routes(f"lower({SQL_HOST})", HOST_ROUTES)} AS source_type, count(*) AS links,
               CAST(sum(hits) AS BIGINT) AS hits
        FROM newest GROUP BY 1""", "newest",
)
def links_by_source(spark, folder):
    once = link_ops.one_per_url(inputs.links(spark, folder), "newest")
    route = urls.source_type(F.col("url"), HOST_ROUTES)
    return once.groupBy(route.alias("source_type")).agg(
        F.count("*").alias("links"), F.sum("hits").alias("hits")
    )


@query(
    """SELECT message_id, text FROM (SELECT * FROM messages ORDER BY date DESC, message_id DESC LIMIT 2000)
       WHERE date >= TIMESTAMP '2024-01-25' AND text <> ''""", "messages",
)
def message_scan_newest(spark, folder):
    since = F.lit("2024-01-25").cast("timestamp_ntz")
    return message_scan(inputs.messages(spark, folder), since, 2000).select("message_id", "text")


@query(
    "SELECT message_id, text FROM messages WHERE date >= TIMESTAMP '2024-01-10' AND text <> ''", "messages",
)
def message_scan_cutoff(spark, folder):
    since = F.lit("2024-01-10").cast("timestamp_ntz")
    return message_scan(inputs.messages(spark, folder), since).select("message_id", "text")


@query("SELECT message_id, text FROM messages WHERE date >= TIMESTAMP '2024-01-20' AND text <> ''", "messages")
def message_scan_since_day(spark, folder):
    """The cutoff as a day in text, as a caller gives it."""
    return message_scan(inputs.messages(spark, folder), cutoff("2024-01-20")).select("message_id", "text")


@query("SELECT message_id, pos, url FROM links", "links")
def message_links(spark, folder):
    return inputs.links(spark, folder).select("message_id", "pos", "url")


# Hosts of 200 labels, of an empty label, and one that two dots end.
_HOSTS = ("at https://", ".example.org/p?q=1, http://a..b.com/x,http://c.org/y HTTPS://up.Example.NET:80/z https://end.org.. and https://1.2 ")


@query(
    f"""SELECT doc_id, unnest(list_distinct([rtrim(u, '.,!?:;)') FOR u IN regexp_extract_all(
            {sql_text(_HOSTS[0])} || repeat('l' || doc_id || '.', 200) || source || {sql_text(_HOSTS[1])} || text, '{inputs.SQL_LINK}')])) AS url FROM documents""",
)
def long_host_links(spark, folder):
    label = F.concat(F.lit("l"), "doc_id", F.lit("."))
    said = F.concat(F.lit(_HOSTS[0]), F.repeat(label, F.lit(200)), "source", F.lit(_HOSTS[1]), "text")
    return inputs.documents(spark, folder).select("doc_id", F.explode(urls.extract_urls(said)).alias("url"))


@query("SELECT DISTINCT url FROM links", "links")
def distinct_urls(spark, folder):
    return link_ops.distinct_urls(inputs.links(spark, folder))


@query(f"SELECT url, message_id, {sql_moment('date')} AS date, pos, hits FROM oldest", "oldest")
def links_oldest(spark, folder):
    return link_ops.one_per_url(inputs.links(spark, folder), "oldest").withColumn("date", moment("date"))


@query(f"SELECT url, message_id, {sql_moment('date')} AS date, pos, hits FROM newest", "newest")
def links_newest(spark, folder):
    return link_ops.one_per_url(inputs.links(spark, folder), "newest").withColumn("date", moment("date"))


SQL_PATH = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_DIGITS = [f"(strpos('0123456789abcdef', substr(md5({SQL_HOST}), {i}, 1)) - 1) * {16 ** (5 - i)}" for i in range(1, 6)]
SQL_BUCKET = f"CAST(({' + '.join(_DIGITS)}) % 100000 AS INTEGER)"
# The named characters that the pages of the tables hold; the ampersand comes last so nothing is decoded twice.
SQL_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&copy ", "© "), ("&#00000065;", "A"), ("&amp;", "&"))


@query(
    f"""SELECT page_id, {SQL_HOST} AS host, {SQL_PATH} AS path,
               {sql_routes(f"lower({SQL_HOST})", ROUTES)} AS source_type,
               {sql_routes(f"lower({SQL_HOST})", HOST_ROUTES)} AS host_route,
               {sql_safe_name(f"CASE WHEN {SQL_PATH} = '' THEN 'page' ELSE translate({SQL_PATH}, '/', '_') END", 30)} AS slug
        FROM pages""",
)
def url_parts(spark, folder):
    url = F.col("url")
    return inputs.table(spark, folder, "pages").select(
        "page_id", urls.authority(url).alias("host"), urls.path(url).alias("path"),
        urls.source_type(url).alias("source_type"), urls.source_type(url, HOST_ROUTES).alias("host_route"),
        urls.slug(url).alias("slug"),
    )


# Links of the known sites, one of each per page.
_SITE_LINKS = [
    "https://youtu.be/%s?si=t", "https://www.youtube.com/watch?v=%s", "https://arxiv.org/abs/2405.%s",
    "https://github.com/%s/tree/main", "https://x.com/%s", "https://www.linkedin.com/jobs/view/%s", "https://netflix.com/%s",
]
_SITE_VALUES = ["key", "key", "number", "repo", "key", "number", "key"]


def site_links(spark, folder):
    page = inputs.table(spark, folder, "pages").select(
        "page_id", F.substring(F.md5("url"), 1, 11).alias("key"), (F.col("page_id") + 10000).cast("string").alias("number"),
        F.concat(F.lit("org"), "page_id", F.lit("/name"), "page_id").alias("repo"),
    )
    built = [F.format_string(shape, value) for shape, value in zip(_SITE_LINKS, _SITE_VALUES, strict=True)]
    return page.select("page_id", F.explode(F.array(*built)).alias("url"))


SQL_SITE_LINKS = f"""SELECT page_id, unnest([{', '.join(
    sql_text(shape.split('%s')[0]) + ' || ' + value + ' || ' + sql_text(shape.split('%s')[1])
    for shape, value in zip(_SITE_LINKS, _SITE_VALUES, strict=True)
)}]) AS url FROM (SELECT page_id, substr(md5(url), 1, 11) AS key, CAST(page_id + 10000 AS VARCHAR) AS number,
                         'org' || page_id || '/name' || page_id AS repo FROM pages)"""
_ROUTED = sql_routes(f"lower({SQL_HOST})", ROUTES)
_VIDEO = r"nullif(regexp_extract(url, '(?:v=|/|youtu\.be/|embed/|shorts/)([a-zA-Z0-9_-]{11})', 1), '')"
_PAPER = r"nullif(regexp_extract(url, 'arxiv\.org/(?:abs|pdf)/([0-9]+\.[0-9]+(?:v[0-9]+)?)', 1), '')"
_PARTS = f"list_filter(string_split({SQL_PATH}, '/'), lambda p: p <> '')"
_REPO = f"CASE WHEN len({_PARTS}) >= 2 THEN {_PARTS}[1] || '/' || {_PARTS}[2] END"


@query(
    f"""SELECT page_id, url, {_ROUTED} AS route,
               CASE WHEN {_ROUTED} = 'youtube' AND {_VIDEO} IS NULL THEN 'web'
                    WHEN {_ROUTED} = 'arxiv' AND {_PAPER} IS NULL THEN 'web'
                    WHEN {_ROUTED} = 'github' AND {_REPO} IS NULL THEN 'web' ELSE {_ROUTED} END AS source_type,
               {_VIDEO} AS video_id, {_PAPER} AS paper_id, {_REPO} AS repository,
               'https://raw.githubusercontent.com/' || ({_REPO}) || '/HEAD/README.md|https://raw.githubusercontent.com/'
               || ({_REPO}) || '/main/README.md|https://raw.githubusercontent.com/' || ({_REPO}) || '/master/README.md' AS readmes
        FROM ({SQL_SITE_LINKS})""",
)
def link_ids(spark, folder):
    url = F.col("url")
    return site_links(spark, folder).select(
        "page_id", "url", urls.source_type(url).alias("route"), urls.effective_source(url).alias("source_type"),
        urls.video_id(url).alias("video_id"), urls.paper_id(url).alias("paper_id"),
        urls.repository(url).alias("repository"), joined(urls.readme_candidates(url)).alias("readmes"),
    )


@query(f"SELECT page_id, {SQL_BUCKET} AS bucket FROM pages")
def host_buckets(spark, folder):
    return inputs.table(spark, folder, "pages").select("page_id", urls.host_bucket(F.col("url")).alias("bucket"))


# --- Text ---------------------------------------------------------------------

@query(
    f"""SELECT doc_id, {sql_safe_name('text')} AS name80, {sql_safe_name('text', 50)} AS name50,
               '{VAULT}/' || lang || '/' || {sql_safe_name('text')} || '.md' AS path
        FROM documents""",
)
def safe_file_names(spark, folder):
    body = F.col("text")
    return inputs.documents(spark, folder).select(
        "doc_id", text.safe_file_name(body).alias("name80"), text.safe_file_name(body, 50).alias("name50"),
        render.note_path(VAULT, F.col("lang"), body).alias("path"),
    )


def spoken(body: Column) -> Column:
    """A document with sound tags, turn marks and promotion around it."""
    return F.concat(
        F.lit("[music] >> "), body, F.lit(" > > [Applause from the hall]\t Don't forget to like and subscribe! Then "),
        F.lit("follow us on telegram.\n \n\n\nFor sponsorships: @promo_bot and link in the description below.\nEnd"),
    )


SQL_SPOKEN = (
    "'[music] >> ' || text || ' > > [Applause from the hall]\t Don''t forget to like and subscribe! Then '"
    " || 'follow us on telegram.\n \n\n\nFor sponsorships: @promo_bot and link in the description below.\nEnd'"
)


def sql_transcript(x: str) -> str:
    """Stutters are folded over the list of words and gaps: a word goes when it repeats the one before."""
    tagged = rf"regexp_replace({x}, '(?i)\[(?:{'|'.join(SOUND_TAGS)})[^\]]*\]', ' ', 'g')"
    turned = rf"regexp_replace({tagged}, '>\s*>\s*', ' ', 'g')"
    tokens = rf"regexp_extract_all({turned}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"
    repeat = (
        r"coalesce(regexp_full_match({t}[{i}], '[a-zA-Z]+') AND regexp_full_match({t}[{i} - 1], '\s+')"
        r" AND lower({t}[{i}]) = lower({t}[{i} - 2]), false)"
    )
    here, after = repeat.format(t="ts.t", i="i"), repeat.format(t="ts.t", i="(i + 1)")
    kept = f"list_filter(ts.t, lambda w, i: NOT ({here} OR {after}))"
    return sql_squeeze(f"(SELECT array_to_string({kept}, '') FROM (SELECT {tokens} AS t) ts)")


def sql_promo(x: str) -> str:
    for pattern in PROMO_PATTERNS:
        x = f"regexp_replace({x}, {sql_text('(?i)' + pattern)}, '', 'g')"
    return sql_squeeze(x)


@query(f"SELECT doc_id, {sql_transcript(SQL_SPOKEN)} AS text FROM documents")
def transcripts_cleaned(spark, folder):
    return inputs.documents(spark, folder).select("doc_id", text.clean_transcript(spoken(F.col("text"))).alias("text"))


@query(f"SELECT doc_id, {sql_promo(SQL_SPOKEN)} AS text FROM documents")
def promotion_cleaned(spark, folder):
    return inputs.documents(spark, folder).select("doc_id", text.clean_promo(spoken(F.col("text"))).alias("text"))


@query(f"""SELECT doc_id, {sql_promo('t')} AS text
           FROM (SELECT doc_id, {sql_transcript(SQL_SPOKEN)} AS t FROM documents)""")
def spoken_cleaned(spark, folder):
    return inputs.documents(spark, folder).select("doc_id", text.clean_spoken(spoken(F.col("text"))).alias("text"))


_RUN = "So so SO "


@query(f"SELECT doc_id, {sql_transcript(f'repeat({sql_text(_RUN)}, 700) || text')} AS text FROM documents")
def stutters_folded(spark, folder):
    run = F.concat(F.repeat(F.lit(_RUN), F.lit(700)), "text")
    return inputs.documents(spark, folder).select("doc_id", text.clean_transcript(run).alias("text"))


# Two frequent words as login words, so that the window and the order of the rules matter.
PROSE_WALLS = [r"\b(?:sign\s*in|log\s*in|login|log\s*on)\b", r"\bthe\s+that\b", r"\bund\s+der\b", r"\bque\s+des\b"]


def sql_ascii(x: str) -> str:
    """Non-ASCII letters as z, because the SQL engine's word boundaries know ASCII only."""
    return rf"regexp_replace({x}, '[\x{{C0}}-\x{{24F}}]', 'z', 'g')"


def sql_integrity(x: str, patterns: list[str]) -> str:
    start = sql_ascii(f"substr({sql_strip(x)}, 1, 1500)")
    walls = " ".join(
        f"WHEN regexp_matches({start}, {sql_text('(?i)' + p)}) THEN "
        + sql_text(f"Detected login wall pattern matching '{p}'")
        for p in patterns
    )
    size = f"length({sql_strip(x)})"
    return f"CASE {walls} WHEN {size} < 200 THEN 'Text length too short (' || {size} || ' chars < 200 chars)' END"


@query(
    f"""SELECT doc_id, reason IS NOT NULL AS failed, reason, default_reason
        FROM (SELECT doc_id, {sql_integrity('text', PROSE_WALLS)} AS reason,
                     {sql_integrity("CASE WHEN lang = 'de' THEN 'Please Sign In. ' || text ELSE text END", LOGIN_PATTERNS)} AS default_reason
              FROM documents)""",
)
def integrity_checked(spark, folder):
    body = F.col("text")
    walled = F.when(F.col("lang") == "de", F.concat(F.lit("Please Sign In. "), body)).otherwise(body)
    return inputs.documents(spark, folder).select(
        "doc_id", quality.integrity(body, PROSE_WALLS).alias("c"), quality.integrity_reason(walled).alias("default_reason")
    ).select("doc_id", "c.failed", "c.reason", "default_reason")


@query(
    f"""SELECT d.doc_id, coalesce(toxic, 0) = 0 AND (coalesce(quality, 0) = 1 OR length({sql_strip('text')}) >= 200) AS usable
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def usable_documents(spark, folder):
    rows = inputs.documents(spark, folder).join(inputs.table(spark, folder, "labels"), "doc_id", "left")
    illustrated = F.when(F.col("quality") == 1, F.array(F.lit("tile"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "doc_id", quality.is_usable(F.col("toxic") == 1, F.col("text"), illustrated).alias("usable")
    )


@query(
    f"""SELECT d.doc_id, failed, failed AND n < 300 AS stub
        FROM (SELECT doc_id, length({sql_strip('text')}) < 100 OR contains(text, '#failed_scrape') AS failed, length(text) AS n
              FROM documents) d""",
)
def failed_notes(spark, folder):
    body = F.col("text")
    failed = quality.note_failed(body, F.col("source"))
    return inputs.documents(spark, folder).select(
        "doc_id", failed.alias("failed"), quality.is_dead_stub(failed, body).alias("stub")
    )


# --- Pages --------------------------------------------------------------------

_BLOCKS = "|".join(html.BLOCK_TAGS)


def sql_unescape(x: str) -> str:
    for name, char in SQL_ENTITIES:
        x = f"replace({x}, {sql_text(name)}, {sql_text(char)})"
    return x


# Noise of the test pages' own markup, and of the default fragments; attributes are written with double quotes there.
SQL_AD = r"""regexp_matches(piece, '\s(?:class|id)="[^"]*\bad\b')"""
SQL_CLUTTER = r"""(regexp_matches(piece, '\s(?:class|id)="[^"]*(?:cookie|consent|banner)')
    OR regexp_matches(piece, '\sclass="[^"]*(?:modal-backdrop|popup|signup-prompt)') OR regexp_matches(piece, '\sid="[^"]*layers'))"""


def sql_bare_pages(source: str, noise: str) -> str:
    """page_id, url, html and bare: the markup without the elements that hold noise, each up to where as many of its name are open as before it."""
    return rf"""
    WITH pieces AS (
        SELECT page_id, i, piece, lower(regexp_extract(piece, '^/?([a-zA-Z][^\s/>]*)', 1)) AS name
        FROM (SELECT page_id, unnest(x) AS piece, generate_subscripts(x, 1) AS i
              FROM (SELECT page_id, string_split(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<') AS x FROM {source}))
    ), tags AS (
        SELECT *, CASE WHEN i = 1 OR name = '' OR name IN {sql_in(html.VOID_TAGS)} THEN 0 WHEN starts_with(piece, '/') THEN -1 ELSE 1 END AS step,
               i > 1 AND (name IN {sql_in(html.DROPPED_TAGS)} OR {noise}) AND NOT starts_with(piece, '/') AS noise FROM pieces
    ), nested AS (
        SELECT *, sum(step) OVER (PARTITION BY page_id, name ORDER BY i) AS open FROM tags
    ), gone AS (
        SELECT s.page_id, s.i AS first, min(e.i) AS last
        FROM nested s JOIN nested e ON e.page_id = s.page_id AND e.name = s.name AND e.i > s.i AND e.step = -1 AND e.open = s.open - 1
        WHERE s.noise GROUP BY s.page_id, s.i
    ), kept AS (
        SELECT t.page_id, t.i, CASE WHEN t.i = 1 THEN t.piece WHEN max(g.last) = t.i THEN regexp_extract(t.piece, '(?s)>(.*)$', 1) ELSE '<' || t.piece END AS piece
        FROM tags t LEFT JOIN gone g ON g.page_id = t.page_id AND t.i BETWEEN g.first AND g.last
        GROUP BY t.page_id, t.i, t.piece HAVING count(g.last) = 0 OR max(g.last) = t.i
    )
    SELECT p.page_id, p.url, p.html, coalesce(k.bare, '') AS bare FROM {source} p
    LEFT JOIN (SELECT page_id, string_agg(piece, '' ORDER BY i) AS bare FROM kept GROUP BY page_id) k ON k.page_id = p.page_id"""


def sql_in(names) -> str:
    return f"({', '.join(sql_text(x) for x in names)})"


def sql_page_text(x: str) -> str:
    x = f"""regexp_replace({x}, '(?is)<a\\s[^>]*?\\bhref="([^"]+)"[^>]*>(.*?)</a\\s*>', '[\\2](\\1)', 'g')"""
    x = rf"regexp_replace({x}, '(?is)</?(?:{_BLOCKS})(?:[\s/][^>]*)?>', chr(10), 'g')"
    x = rf"regexp_replace({x}, '(?is)</?t[dh](?:[\s/][^>]*)?>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)</?[a-zA-Z!][^>]*>', '', 'g')"
    return sql_squeeze(sql_unescape(x))


AD_CLUTTER = {"class_or_id": [r"\bad\b"], "class_only": [], "id_only": []}


def sql_captured_pages(source: str, noise: str) -> str:
    return f"""
    SELECT page_id, url, coalesce(nullif({sql_strip(sql_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, ''), 'Article Note') AS title,
           {sql_page_text('bare')} AS text FROM ({sql_bare_pages(source, noise)})"""


SQL_CAPTURED_PAGES = sql_captured_pages("pages", SQL_AD)
CAPTURE_COLUMNS = ("url", "title", "text", "failed_scrape", "failure_reason")


def sql_captures(source: str, noise: str) -> str:
    return f"""SELECT url, title, text, reason IS NOT NULL AS failed_scrape, reason AS failure_reason
        FROM (SELECT *, {sql_integrity('text', LOGIN_PATTERNS)} AS reason FROM ({sql_captured_pages(source, noise)}))"""


@query(sql_captures("pages", SQL_CLUTTER))
def pages_captured(spark, folder):
    return extract.capture_pages(inputs.pages(spark, folder)).select(*CAPTURE_COLUMNS)


# Banners with nested elements of their own name, links, a table, references of many digits and without a semicolon.
_BAR = '<div class="top cookie-bar"><div>of </div><div><div> ours</div></div> accept all</div>'
_ROW = '<table><tr><th>Address</th><td><a title="x" href="', '">the <i>page</i></a></td></tr></table>&#00000065;&copy 2<div id="layers2"><span>x</span></div>'


@query(sql_captures(
    f"(SELECT page_id, url, replace(html, '<article>', {sql_text(_BAR)} || '<article>' || {sql_text(_ROW[0])} || url || {sql_text(_ROW[1])}) AS html FROM pages)", f"({SQL_AD} OR {SQL_CLUTTER})"
))
def pages_with_banners(spark, folder):
    bar, (before, after) = F.lit(_BAR), _ROW
    added = F.concat(bar, F.lit("<article>"), F.lit(before), "url", F.lit(after))
    pages = inputs.pages(spark, folder).withColumn("html", F.replace("html", F.lit("<article>"), added))
    clutter = {"class_or_id": [r"\bad\b", "cookie", "consent", "banner"]}
    return extract.capture_pages(pages, strip_kwargs=clutter).select(*CAPTURE_COLUMNS)


# --- Notes --------------------------------------------------------------------

@query("SELECT file_path, content FROM notes", "notes")
def notes_rendered(spark, folder):
    return inputs.notes(spark, folder).select("file_path", "content")


_HEADING = r"regexp_extract(content, '(?m)^#\s+.+$')"
_STEM = r"regexp_replace(file_name, '\.[^.]+$', '')"
_BULLETLESS = sql_strip(r"regexp_replace(l, '^[-*•]\s*', '')")
_INSIGHTS = (
    f"list_filter([{_BULLETLESS} FOR l IN string_split({sql_section('Key Insights')}, chr(10))],"
    " lambda l: l <> '' AND NOT starts_with(l, 'No specific insights'))"
)
_FRONT = r"""nullif(regexp_extract(array_to_string(string_split(content, chr(10))[1:30], chr(10)), '(?m)^{field}: ["'']?(.*?)["'']?$', 1), '')"""
SQL_PARSED = rf"""
    SELECT file_path, file_name, category, content, {sql_strip(rf"substr({_HEADING}, 2)")} AS title,
           coalesce(nullif(regexp_extract(content, '\*\*Source URL\*\*:\s*\[.*?\]\((https?://[^)]+)\)', 1), ''), {_FRONT.format(field='url')}) AS url,
           {sql_section('AI Summary')} AS summary, {_INSIGHTS} AS insights,
           regexp_extract_all(content, '#([a-zA-Z0-9_\-/]+)', 1) AS tags,
           contains(content, '#failed_scrape') OR length({sql_strip('content')}) < 100 AS is_failed
    FROM notes"""


@query(
    f"""SELECT file_path, title, url, summary, array_to_string(insights, '|') AS insights,
               array_to_string(tags, '|') AS tags, is_failed FROM ({SQL_PARSED})""", "notes",
)
def notes_parsed(spark, folder):
    parsed = note_fields.parse_notes(inputs.notes(spark, folder).select("file_path", "file_name", "category", "content"))
    return parsed.select(
        "file_path", "title", "url", "summary", joined("insights").alias("insights"), joined("tags").alias("tags"), "is_failed"
    )


@query(
    f"""SELECT file_path, array_to_string(string_split(content, chr(10))[1:30], chr(10)) AS head,
               {_FRONT.format(field='date')} AS date, {_FRONT.format(field='type')} AS type,
               string_split(file_path, '/')[-2] AS folder
        FROM notes WHERE NOT starts_with(file_name, 'NOTEBOOKLM')""", "notes",
)
def note_heads(spark, folder):
    content = F.col("content")
    return note_scan(inputs.notes(spark, folder)).select(
        "file_path", note_fields.note_head(content).alias("head"), note_fields.front_matter(content, "date").alias("date"),
        note_fields.front_matter(content, "type").alias("type"), note_fields.folder_name(F.col("file_path")).alias("folder"),
    )


_SOURCE = sql_section("Original Source")
SQL_EXCERPT = (
    f"CASE WHEN length({_SOURCE}) > 2500 THEN substr({_SOURCE}, 1, 2500) || chr(10) || "
    f"'... [Source content continued in individual note] ...' ELSE {_SOURCE} END"
)


@query(f"SELECT file_path, {SQL_EXCERPT} AS excerpt FROM notes", "notes")
def note_excerpts(spark, folder):
    return inputs.notes(spark, folder).select("file_path", note_fields.excerpt(F.col("content")).alias("excerpt"))


# --- Classification -----------------------------------------------------------

SQL_CORPUS = (
    f"lower(title || chr(10) || {_STEM} || chr(10) || coalesce(url, '') || chr(10) || summary || chr(10)"
    f" || array_to_string(insights, ' ') || chr(10) || substr(content, 1, 2000))"
)


def sql_scores(rules: dict[str, list[str]], corpus: str) -> str:
    scored = []
    for rank, (category, patterns) in enumerate(rules.items()):
        total = " + ".join(f"len(regexp_extract_all({corpus}, {sql_text('(?i)' + p)}))" for p in patterns)
        scored.append(f"{{'score': {total}, 'neg_rank': {-rank}, 'category': {sql_text(category)}}}")
    return f"list_filter([{', '.join(scored)}], lambda s: s.score > 0)"


def sql_best(scores: str) -> str:
    return f"list_max({scores}).category"


def sql_keywords(corpus: str) -> str:
    return sql_routes(corpus, KEYWORD_FALLBACK, "other")


def sql_classified(rules: dict[str, list[str]]) -> str:
    return f"""
    SELECT *, coalesce({sql_best(sql_scores(rules, 'ascii_corpus'))}, {sql_keywords('corpus')}) AS target
    FROM (SELECT *, {sql_ascii('corpus')} AS ascii_corpus
          FROM (SELECT *, {SQL_CORPUS} AS corpus FROM ({SQL_PARSED})))"""


@query(
    f"""SELECT doc_id, s.category AS category, CAST(s.score AS INTEGER) AS score
        FROM (SELECT doc_id, unnest({sql_scores(PROSE_RULES, 'corpus')}) AS s
              FROM (SELECT doc_id, {sql_ascii('lower(text)')} AS corpus FROM documents))""",
)
def rule_scores_by_document(spark, folder):
    scores = F.explode(rule_scores(F.lower("text"), PROSE_RULES))
    return inputs.documents(spark, folder).select("doc_id", scores.alias("s")).select("doc_id", "s.category", "s.score")


@query(
    f"""SELECT doc_id, coalesce({sql_best(sql_scores(PROSE_RULES, 'corpus'))}, 'other') AS category
        FROM (SELECT doc_id, {sql_ascii('lower(text)')} AS corpus FROM documents)""",
)
def documents_classified(spark, folder):
    category = classify(F.lower("text"), PROSE_RULES)
    return inputs.documents(spark, folder).select("doc_id", category.alias("category"))


# Letters with two lower-case forms, or that share an upper-case letter: such patterns run on every text.
GREEK_RULES = {"words": ["λογοσ", "λογος"], "units": ["µtorrent"]}
_SPELLED = {"de": " ΛΟΓΟΣ λόγος", "fr": " λογος Λογοσ", "es": " µTorrent", "en": " ΜTORRENT μtorrent"}


@query(
    f"""SELECT doc_id, len(regexp_extract_all(x, '(?i)λογοσ')) + len(regexp_extract_all(x, '(?i)λογος')) AS words, len(regexp_extract_all(x, '(?i)µtorrent')) AS units
        FROM (SELECT doc_id, text || CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _SPELLED.items())} ELSE '' END AS x FROM documents)""",
)
def letters_of_two_forms(spark, folder):
    added = F.coalesce(F.create_map(*[F.lit(x) for kv in _SPELLED.items() for x in kv])[F.col("lang")], F.lit(""))
    scores = rule_scores(F.concat("text", added), GREEK_RULES)
    score = lambda name: F.coalesce(F.get(F.filter("scores", lambda s: s["category"] == name), F.lit(0))["score"], F.lit(0)).cast("bigint").alias(name)
    return inputs.documents(spark, folder).select("doc_id", scores.alias("scores")).select("doc_id", score("words"), score("units"))


@query(f"SELECT file_path, target AS category FROM ({sql_classified(CATEGORY_PATTERNS)})", "notes")
def notes_classified(spark, folder):
    files = inputs.notes(spark, folder).select("file_path", "file_name", "category", "content")
    return note_fields.parse_notes(files).select("file_path", classify(note_fields.classifier_corpus()).alias("category"))


# --- Reorganising -------------------------------------------------------------

SQL_JUDGED = f"""
    SELECT *, CASE WHEN is_failed AND length(content) < 300 THEN 'deleted' WHEN target <> 'other' THEN 'moved' ELSE 'kept' END AS fate
    FROM ({sql_classified(PROSE_RULES)}) WHERE category = 'other' AND NOT starts_with(file_name, 'NOTEBOOKLM')"""


def _unsorted_plan(spark, folder):
    files = inputs.notes(spark, folder).select("file_path", "file_name", "category", "content")
    return reorganize.reorganise(note_fields.parse_notes(note_scan(files, "other")), VAULT, PROSE_RULES)


@query(
    f"""SELECT file_path AS source_path, '{VAULT}/' || target || '/' || file_name AS target_path, target AS category, url
        FROM ({SQL_JUDGED}) WHERE fate = 'moved'""", "notes",
)
def reorganised_moves(spark, folder):
    return _unsorted_plan(spark, folder).moves


@query(
    f"""SELECT CASE WHEN fate = 'moved' THEN '{VAULT}/' || target || '/' || file_name ELSE file_path END AS file_path, file_name,
               CASE WHEN fate = 'moved' THEN target ELSE category END AS category, md5(content) AS content
        FROM (SELECT * FROM ({SQL_JUDGED}) UNION ALL
              SELECT *, 'kept' AS fate FROM ({sql_classified(PROSE_RULES)}) WHERE category <> 'other' OR starts_with(file_name, 'NOTEBOOKLM'))
        WHERE fate <> 'deleted'""", "notes",
)
def reorganised_files(spark, folder):
    """All notes once the plan is carried out; file names are unique, so no two meet on one path."""
    files = inputs.notes(spark, folder).select("file_path", "file_name", "category", "content")
    after = reorganize.files_after(files, _unsorted_plan(spark, folder))
    return after.select("file_path", "file_name", "category", F.md5("content").alias("content"))


@query(
    f"""SELECT count(*) AS processed, count(*) FILTER (fate = 'moved') AS reclassified,
               count(*) FILTER (fate = 'moved') AS moved, count(*) FILTER (fate = 'deleted') AS failed_cleaned
        FROM ({SQL_JUDGED})""", "notes",
)
def reorganised_counters(spark, folder):
    return _unsorted_plan(spark, folder).counters


def _note_moves(spark, folder):
    """Every German note moves to the next category; French records are known by link only."""
    rows = inputs.notes(spark, folder).filter(F.col("lang").isin("de", "fr"))
    target = F.concat(F.lit(f"{VAULT}/big_data/"), "file_name")
    source = F.when(F.col("lang") == "de", F.col("file_path")).otherwise(
        F.concat(F.lit(f"{VAULT}/unknown/x-"), "file_name")
    )
    return rows.select(
        source.alias("source_path"), target.alias("target_path"), F.lit("big_data").alias("category"),
        F.when(F.col("lang") == "fr", F.col("url")).alias("url"),
    )


@query(
    """SELECT r.url, CASE WHEN lang IN ('de', 'fr') THEN '/vault/big_data/' || file_name ELSE r.file_path END AS file_path,
              CASE WHEN lang IN ('de', 'fr') THEN 'big_data' ELSE r.category END AS category,
              CASE WHEN lang IN ('de', 'fr') THEN 'knowledge' ELSE item_type END AS item_type
       FROM note_registry r JOIN notes n ON n.url = r.url""", "note_registry", "notes",
)
def registry_after_moves(spark, folder):
    after = registry.apply_moves(inputs.note_registry(spark, folder), _note_moves(spark, folder))
    return after.select("url", "file_path", "category", "item_type")


@query(
    """SELECT r.url, n.file_path, n.category, CASE WHEN n.category = 'jobs' THEN 'job' ELSE 'knowledge' END AS item_type
       FROM note_registry r JOIN notes n ON n.url = r.url""", "note_registry", "notes",
)
def registry_synced(spark, folder):
    files = note_scan(inputs.notes(spark, folder))
    return registry.sync_with_notes(inputs.note_registry(spark, folder), files).select(
        "url", "file_path", "category", "item_type"
    )


# --- Registry -----------------------------------------------------------------

_REGISTRY_COLUMNS = (
    "url, title, file_path, category, item_type, telegram_message_id, "
    f"{sql_moment('processed_at')} AS processed_at, content_hash"
)
SQL_UPSERTED = """
    SELECT coalesce(u.url, r.url) AS url, coalesce(u.title, r.title) AS title, coalesce(u.file_path, r.file_path) AS file_path,
           coalesce(u.category, r.category) AS category, coalesce(u.item_type, r.item_type) AS item_type,
           coalesce(u.telegram_message_id, r.telegram_message_id) AS telegram_message_id,
           coalesce(u.processed_at, r.processed_at) AS processed_at, coalesce(u.content_hash, r.content_hash) AS content_hash
    FROM page_registry r FULL JOIN (
        SELECT url, arg_max(title, processed_at) AS title, arg_max(file_path, processed_at) AS file_path,
               arg_max(category, processed_at) AS category, arg_max(item_type, processed_at) AS item_type,
               max(processed_at) AS processed_at, arg_max(content_hash, processed_at) AS content_hash,
               arg_max(telegram_message_id, processed_at) FILTER (telegram_message_id IS NOT NULL) AS telegram_message_id
        FROM page_updates GROUP BY url) u ON u.url = r.url"""


def _upserted(spark, folder):
    return registry.upsert(inputs.page_registry(spark, folder), inputs.page_updates(spark, folder))


@query(f"SELECT {_REGISTRY_COLUMNS} FROM ({SQL_UPSERTED})", "page_registry", "page_updates")
def registry_upserted(spark, folder):
    return _upserted(spark, folder).withColumn("processed_at", moment("processed_at"))


@query(f"SELECT {_REGISTRY_COLUMNS} FROM ({SQL_UPSERTED})", "page_registry", "page_updates")
def registry_in_batches(spark, folder):
    """The same updates, merged into a stored table by batches in the order of time."""
    place = f"{shared_folder(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    table = KeyedTable(spark, place, REGISTRY, "url", 16, keep=("telegram_message_id",)).create()
    table.merge(inputs.page_registry(spark, folder), 0)
    moments = materialize(inputs.page_updates(spark, folder).withColumn("at", F.unix_micros(F.col("processed_at").cast("timestamp"))), "updates")
    edges = moments.select(F.percentile_approx("at", F.array(*[F.lit(i / 8) for i in range(1, 8)]), F.lit(1000))).first()[0] or []
    for batch, (low, high) in enumerate(zip([None, *edges], [*edges, None]), 1):
        part = moments if low is None else moments.filter(F.col("at") > low)
        part = part if high is None else part.filter(F.col("at") <= high)
        table.merge(registry.last_updates(part), batch)
    return table.read().withColumn("processed_at", moment("processed_at"))


@query(f"SELECT {_REGISTRY_COLUMNS} FROM note_registry", "note_registry")
def registry_newest_first(spark, folder):
    return registry.registry_scan(inputs.note_registry(spark, folder)).withColumn("processed_at", moment("processed_at"))


@query(
    """SELECT a.url, hits, title, file_path, category, telegram_message_id
       FROM (SELECT url, count(*) AS hits FROM links GROUP BY url) a LEFT JOIN page_registry r ON r.url = a.url""",
    "links", "page_registry",
)
def registry_lookup(spark, folder):
    found = registry.lookup(inputs.links(spark, folder), inputs.page_registry(spark, folder))
    return found.select("url", "hits", "title", "file_path", "category", "telegram_message_id")


@query("SELECT DISTINCT url FROM links WHERE url IN (SELECT url FROM page_registry)", "links", "page_registry")
def registered_links(spark, folder):
    return registry.registered(inputs.links(spark, folder), inputs.page_registry(spark, folder))


@query(
    """SELECT url, category FROM notes WHERE url NOT IN (
           SELECT url FROM note_registry WHERE file_path IN (SELECT file_path FROM notes))""", "notes", "note_registry",
)
def links_to_process(spark, folder):
    rows = inputs.notes(spark, folder)
    todo = registry.skip_processed(rows.select("url", "category"), inputs.note_registry(spark, folder), rows)
    return todo.select("url", "category")


@query(
    """SELECT count(*) FILTER (r.url IS NULL AND message_id % 7 <> 3) AS processed,
              CAST(coalesce(sum(CASE WHEN r.url IS NULL AND message_id % 7 <> 3 THEN hits - 1 WHEN r.url IS NOT NULL THEN hits END), 0) AS BIGINT) AS skipped,
              CAST(coalesce(sum(hits) FILTER (r.url IS NULL AND message_id % 7 = 3), 0) AS BIGINT) AS failed
       FROM newest l LEFT JOIN page_registry r ON r.url = l.url""", "newest", "page_registry",
)
def session_outcomes(spark, folder):
    once = link_ops.one_per_url(inputs.links(spark, folder), "newest")
    records = inputs.page_registry(spark, folder)
    todo = registry.skip_processed(once, records, records.select("file_path"))
    return stats.session_outcomes(todo, once, todo.filter("message_id % 7 = 3"))


@query(
    f"""SELECT category, count(*) AS total, count(*) FILTER (item_type = 'job') AS jobs
        FROM note_registry GROUP BY ROLLUP (category)""", "note_registry",
)
def registry_report(spark, folder):
    return stats.registry_report(inputs.note_registry(spark, folder))


@query("SELECT category, count(*) AS n FROM note_registry GROUP BY category", "note_registry")
def category_distribution(spark, folder):
    return stats.category_counts(inputs.note_registry(spark, folder))


@query(
    """SELECT file_path, count(*) AS records FROM note_registry
       WHERE file_path NOT IN (SELECT file_path FROM notes) GROUP BY file_path""", "note_registry", "notes",
)
def registry_missing_files(spark, folder):
    return registry.missing_files(inputs.note_registry(spark, folder), inputs.notes(spark, folder))


@query(
    "SELECT file_path FROM notes WHERE file_path NOT IN (SELECT file_path FROM note_registry)", "note_registry", "notes",
)
def unregistered_notes(spark, folder):
    return registry.unregistered_files(inputs.note_registry(spark, folder), inputs.notes(spark, folder))


@query(
    """SELECT url, category, title FROM note_registry
       WHERE category = 'other' OR contains(lower(title), 'failed') OR contains(url, 'youtube.com')
          OR contains(url, 'youtu.be') OR contains(url, 'arxiv.org') ORDER BY processed_at DESC, url LIMIT 10""",
    "note_registry",
)
def reprocess_candidates(spark, folder):
    return registry.reprocess_candidates(inputs.note_registry(spark, folder), 10).select("url", "category", "title")


_CHECKPOINT_LOG = "SELECT event_type AS key, CAST(event_id AS VARCHAR) AS value, ts AS updated_at FROM events"


def _checkpoint_log(spark, folder):
    return inputs.table(spark, folder, "events").select(
        F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"), F.col("ts").alias("updated_at")
    )


@query(
    f"""SELECT key, arg_max(value, updated_at) AS value, {sql_moment('max(updated_at)')} AS updated_at
        FROM ({_CHECKPOINT_LOG}) GROUP BY key""",
)
def checkpoints_upserted(spark, folder):
    log = _checkpoint_log(spark, folder)
    stored = log.filter(F.col("key") != "view").groupBy("key").agg(
        F.min_by("value", "updated_at").alias("value"), F.min("updated_at").alias("updated_at")
    )
    return registry.upsert_checkpoints(stored, log).withColumn("updated_at", moment("updated_at"))


@query(f"SELECT key, arg_max(value, updated_at) AS value FROM ({_CHECKPOINT_LOG}) WHERE key = 'click' GROUP BY key")
def checkpoint_read(spark, folder):
    return registry.read_checkpoint(_checkpoint_log(spark, folder), "click")


# --- Paths --------------------------------------------------------------------

def _items(spark, folder):
    """Notes to place again; French items ask for another category."""
    return inputs.notes(spark, folder).select(
        "url", "title", F.when(F.col("lang") == "fr", F.lit("hooks")).otherwise(F.col("category")).alias("category")
    )


_LOST = "(SELECT url, file_path FROM note_registry WHERE file_path NOT IN (SELECT file_path FROM vault_files))"
_ADDRESSES = r"""(SELECT file_path, regexp_extract(content, '(?m)^url: (\S+)$', 1) AS address FROM vault_files)"""


@query(
    f"""SELECT i.url, CASE WHEN k.url IS NULL THEN i.default_path WHEN s.file_path IS NOT NULL THEN k.file_path
                           ELSE coalesce(m.path, b.path, i.default_path) END AS target_path,
               CASE WHEN k.url IS NULL THEN d.file_path IS NOT NULL WHEN s.file_path IS NOT NULL THEN true
                    ELSE coalesce(m.path, b.path, d.file_path) IS NOT NULL END AS is_overwrite
        FROM (SELECT url, '{VAULT}/' || CASE WHEN lang = 'fr' THEN 'hooks' ELSE category END || '/' || file_name AS default_path
              FROM notes) i
        LEFT JOIN note_registry k ON k.url = i.url
        LEFT JOIN vault_files s ON s.file_path = k.file_path
        LEFT JOIN vault_files d ON d.file_path = i.default_path
        LEFT JOIN (SELECT l.url, min(a.file_path) AS path FROM {_LOST} l JOIN {_ADDRESSES} a ON starts_with(a.address, l.url)
                   WHERE a.address <> '' GROUP BY l.url) m ON m.url = i.url
        LEFT JOIN (SELECT l.url, min(v.file_path) AS path FROM {_LOST} l
                   JOIN vault_files v ON v.file_name = regexp_extract(l.file_path, '[^/]*$') GROUP BY l.url) b ON b.url = i.url""",
    "notes", "note_registry", "vault_files",
)
def resolved_paths(spark, folder):
    placed = resolve.resolve_paths(
        _items(spark, folder), inputs.note_registry(spark, folder), inputs.vault_files(spark, folder), VAULT
    )
    return placed.select("url", "target_path", "is_overwrite")


@query(
    f"""SELECT l.url, a.file_path AS moved_path FROM {_LOST} l JOIN {_ADDRESSES} a ON a.address = l.url""",
    "notes", "note_registry", "vault_files",
)
def moved_notes_exact(spark, folder):
    files = inputs.vault_files(spark, folder)
    records = inputs.note_registry(spark, folder)
    lost = records.join(files.select("file_path"), "file_path", "left_anti").select("url")
    return resolve.moved_by_address(lost, files, "exact")


# --- Compendium ---------------------------------------------------------------

def sql_theme(default: str) -> str:
    cases = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in DOMAIN_THEMES.items())
    return f"CASE category {cases} ELSE {sql_text(default)} END"


def sql_some(condition: str, *lines: str) -> str:
    return f"CASE WHEN {condition} THEN [{', '.join(lines)}] ELSE [] END"


GENERATED = "2025-10-01 12:30:00"
_NOTE_LINES = " || ".join([
    "['## ' || title]",
    sql_some("coalesce(url, '') <> ''", "'- **Source URL**: ' || url"),
    "['- **Category Path**: `vault/' || category || '/' || file_name || '`']",
    sql_some("len(tags) > 0", "'- **Tags**: ' || array_to_string(['#' || t FOR t IN tags[1:5]], ' ')"),
    "['']",
    sql_some("summary <> '' AND NOT contains(summary, 'Summary generated from visual analysis')", "'### Executive Summary'", "summary", "''"),
    "CASE WHEN len(insights) > 0 THEN ['### Core Takeaways & Key Insights'] || ['- ' || i FOR i IN insights[1:6]] || [''] ELSE [] END",
    sql_some("excerpt <> ''", "'### Source Excerpt / Dialogue'", "'```text\n' || excerpt || '\n```'", "''"),
    "['---\n']",
])


@query(
    f"""WITH valid AS (SELECT *, {SQL_EXCERPT} AS excerpt FROM ({SQL_PARSED}) WHERE NOT is_failed AND NOT starts_with(file_name, 'NOTEBOOKLM')),
        chapters AS (SELECT category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, category) AS chapter
                     FROM valid GROUP BY category),
        lines AS (
            SELECT 0 AS section, 0 AS chapter, '' AS file_path,
                   ['# 🧠 Personal Intelligence & Engineering Knowledge Base',
                    '> **Master Knowledge Compendium for NotebookLM Synthesis & Audio Deep Dives**',
                    '> **Generated**: 2025-10-01 12:30 UTC | **Total Analyzed Sources**: ' || sum(n) || ' notes across ' || count(*) || ' domains',
                    '', '---', '', '## 📖 Executive Table of Contents & Knowledge Domains', '',
                    '| Domain | Folder | Notes Count | Key Themes |', '|---|---|---|---|'] AS ls FROM chapters
            UNION ALL SELECT 1, chapter, '', ['| **' || upper(category) || '** | `/' || category || '` | ' || n || ' | ' || {sql_theme(TABLE_THEME_DEFAULT)} || ' |'] FROM chapters
            UNION ALL SELECT 2, 0, '', ['\n---\n']
            UNION ALL SELECT 3, chapter, '', ['# Chapter ' || chapter || ': ' || upper(category) || ' (' || n || ' Document Sources)',
                                              '*' || {sql_theme(CHAPTER_THEME_DEFAULT)} || '*\n'] FROM chapters
            UNION ALL SELECT 3, chapter, file_path, {_NOTE_LINES} FROM valid JOIN chapters USING (category))
        SELECT section, CAST(chapter AS INTEGER) AS chapter, file_path, CAST(i - 1 AS INTEGER) AS line_no, line
        FROM (SELECT section, chapter, file_path, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM lines)""".replace("WITH valid", ", valid", 1),
    "notes",
)
def compendium_lines(spark, folder):
    files = inputs.notes(spark, folder).select("file_path", "file_name", "category", "content")
    generated = F.lit(GENERATED).cast("timestamp_ntz")
    return compendium.compendium_lines(note_fields.parse_notes(note_scan(files)), generated)


@query(
    f"""SELECT category, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, category) AS INTEGER) AS chapter,
               {sql_theme(TABLE_THEME_DEFAULT)} AS theme
        FROM ({SQL_PARSED}) WHERE NOT is_failed GROUP BY category""", "notes",
)
def catalog_chapters(spark, folder):
    files = inputs.notes(spark, folder).select("file_path", "file_name", "category", "content")
    numbered = compendium.chapters(compendium.catalog(note_fields.parse_notes(files)))
    return numbered.withColumn("theme", compendium.theme(F.col("category"), TABLE_THEME_DEFAULT))


@query(
    r"""SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars,
               CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines,
               round(sum(strlen(text)) / 1024, 1) AS kilobytes FROM documents""",
)
def document_stats(spark, folder):
    return stats.document_stats(inputs.documents(spark, folder))


# --- Pieces of text -----------------------------------------------------------

@query(
    f"""SELECT conv_id, string_agg({sql_strip('text')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS text
        FROM conversations WHERE {sql_strip('text')} <> '' GROUP BY ALL""",
)
def threads_assembled(spark, folder):
    turns = inputs.table(spark, folder, "conversations")
    return assemble.joined_texts(turns, ["conv_id"], "turn", separator=assemble.POST_SEPARATOR)


@query(
    f"""SELECT conv_id, role, string_agg({sql_strip('text')}, ' ' ORDER BY turn) AS text
        FROM conversations WHERE {sql_strip('text')} <> '' GROUP BY ALL""",
)
def transcripts_assembled(spark, folder):
    turns = inputs.table(spark, folder, "conversations")
    parts = assemble.text_parts(turns, ["conv_id", "role"], "turn", part_rows=4)
    return assemble.whole_texts(parts, ["conv_id", "role"])


@query(
    """SELECT source AS video_id, arg_min(lang, (coalesce(nullif(list_position(['de', 'fr', 'en'], lang), 0), 4), doc_id)) AS lang,
              arg_min(doc_id, (coalesce(nullif(list_position(['de', 'fr', 'en'], lang), 0), 4), doc_id)) AS pos
       FROM documents GROUP BY source""",
)
def preferred_tracks(spark, folder):
    tracks = inputs.table(spark, folder, "documents").select(
        F.col("source").alias("video_id"), "lang", F.col("doc_id").alias("pos")
    )
    return assemble.preferred_tracks(tracks, ["de", "fr", "en"])


@query(
    """SELECT source AS url, min(doc_id) AS pos, arg_min(text, doc_id) AS text FROM documents
       WHERE lang <> 'en' AND length(text) > 50 GROUP BY source""",
)
def first_usable_candidates(spark, folder):
    responses = inputs.table(spark, folder, "documents").select(
        F.col("source").alias("url"), F.col("doc_id").alias("pos"),
        F.when(F.col("lang") == "en", 404).otherwise(200).alias("status"), "text",
    )
    return assemble.first_usable(responses)


# --- Tiles and reminders ------------------------------------------------------

@query(
    """SELECT p_partkey, i AS index, i * 1568 AS top, least((i + 1) * 1568, height) AS bottom,
              least((i + 1) * 1568, height) - i * 1568 AS tile_height
       FROM (SELECT p_partkey, p_size * 200 AS height,
                    unnest(range(CAST(greatest(ceil(p_size * 200 / 1568), 1) AS INTEGER)))::INTEGER AS i FROM part)""",
)
def tile_grid(spark, folder):
    images = inputs.table(spark, folder, "part").select(
        "p_partkey", F.lit(1280).alias("width"), (F.col("p_size") * 200).alias("height")
    )
    return tiles.tile_grid(images).select("p_partkey", "index", "top", "bottom", "tile_height")


@query(
    rf"""SELECT url, path, index, 1280 AS width, least(height - index * 1568, 1568) AS height
         FROM (SELECT url, '/vault/attachments/' || slug || '_' || {SQL_BUCKET} || '_tile_0' || i || '.jpg' AS path, i AS index, height
               FROM (SELECT url, {sql_safe_name(f"CASE WHEN {SQL_PATH} = '' THEN 'page' ELSE translate({SQL_PATH}, '/', '_') END", 30)} AS slug,
                            length(html) AS height,
                            unnest(range(CAST(least(greatest(ceil(length(html) / 1568), 1), 5) AS INTEGER)))::INTEGER AS i FROM pages))""",
)
def tile_manifest(spark, folder):
    images = inputs.table(spark, folder, "pages").select(
        "url", F.lit(1280).alias("width"), F.length("html").alias("height")
    )
    rows = tiles.tile_manifest(images, f"{VAULT}/attachments")
    return rows


@query(
    """SELECT url, '💼 Review Job: ' || title AS summary,
              'Review Job Opportunity:\n\nTitle: ' || title || '\nURL: ' || url || '\nNotes: ' || summary || '\n\n---\nGenerated by linkcurate' AS description,
              '2025-10-02T09:00:00 UTC' AS start, '2025-10-02T09:30:00 UTC' AS "end", 'popup:15|email:60' AS alerts
       FROM triaged WHERE item_type = 'job'""", "triaged",
)
def job_reminders(spark, folder):
    rows = reminders.job_reminders(inputs.triaged(spark, folder), F.lit("2025-10-01 17:45:00").cast("timestamp"))
    alerts = F.transform("reminders.overrides", lambda a: F.concat(a["method"], F.lit(":"), a["minutes"].cast("string")))
    return rows.select(
        "url", "summary", "description",
        F.concat_ws(" ", "start.dateTime", "start.timeZone").alias("start"),
        F.concat_ws(" ", "end.dateTime", "end.timeZone").alias("end"), joined(alerts).alias("alerts"),
    )


# --- Fetched material ---------------------------------------------------------

def _videos(spark, folder):
    """Documents as videos: German ones have no transcript, Spanish ones no metadata."""
    meta = F.to_json(F.struct(F.col("source").alias("title"), F.col("lang").alias("author_name")))
    return inputs.documents(spark, folder).select(
        "doc_id",
        F.concat(F.lit("https://youtu.be/"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 11), F.lit("?si=x")).alias("url"),
        F.when(F.col("lang") != "es", meta).alias("metadata"),
        F.when(F.col("lang") != "de", spoken(F.col("text"))).alias("transcript"),
    )


@query(
    f"""SELECT url, title, {sql_strip("'# Video Title: ' || title || '\n# Channel / Creator: ' || author || '\n# URL: https://www.youtube.com/watch?v=' || key || CASE WHEN coalesce(t, '') <> '' THEN '\n\n## Full Spoken Transcript:\n' || t ELSE '\n\n" + feeds.NO_TRANSCRIPT_NOTE + "' END")} AS text,
               CASE WHEN coalesce(t, '') = '' AND length(title) < 15 THEN 'No transcript or description available for YouTube video' END AS failure_reason
        FROM (SELECT 'https://youtu.be/' || key || '?si=x' AS url, key, {sql_promo('s')} AS t,
                     CASE WHEN lang = 'es' THEN 'YouTube Video / Podcast' ELSE source END AS title,
                     CASE WHEN lang = 'es' THEN 'YouTube Channel' ELSE lang END AS author
              FROM (SELECT substr(md5(CAST(doc_id AS VARCHAR)), 1, 11) AS key, lang, source,
                           CASE WHEN lang <> 'de' THEN {sql_transcript(SQL_SPOKEN)} END AS s FROM documents))""",
)
def videos_captured(spark, folder):
    return extract.capture_videos(_videos(spark, folder)).select("url", "title", "text", "failure_reason")


def _papers(spark, folder):
    """Documents as feed entries; German ones lack the title, French ones the authors."""
    body = F.col("text")
    return inputs.documents(spark, folder).select(
        F.concat(F.lit("https://arxiv.org/abs/2405."), F.col("doc_id") + 10000).alias("url"),
        F.concat(
            F.lit("<feed><title>feed</title><entry>\n"),
            F.when(F.col("lang") != "de", F.concat(F.lit("<title>\n"), "source", F.lit("\nof\n"), "lang", F.lit("</title>"))).otherwise(F.lit("")),
            F.lit("<summary>  "), body, F.lit("\n</summary>"),
            F.when(F.col("lang") != "fr", F.concat(F.lit("<author>\n <name>A "), "source", F.lit("</name></author><author><name>B "), "lang", F.lit("</name></author>"))).otherwise(F.lit("")),
            F.lit("</entry></feed>"),
        ).alias("xml"),
    )


@query(
    f"""SELECT url, title, {sql_strip("'# Title: ' || title || '\n# Authors: ' || authors || '\n# ArXiv ID: ' || id || '\n\n## Abstract:\n' || " + sql_strip('text'))} AS text
        FROM (SELECT 'https://arxiv.org/abs/2405.' || (doc_id + 10000) AS url, '2405.' || (doc_id + 10000) AS id, text,
                     CASE WHEN lang = 'de' THEN 'ArXiv Paper 2405.' || (doc_id + 10000) ELSE source || ' of ' || lang END AS title,
                     CASE WHEN lang = 'fr' THEN 'Unknown' ELSE 'A ' || source || ', B ' || lang END AS authors
              FROM documents)""",
)
def papers_captured(spark, folder):
    return extract.capture_papers(_papers(spark, folder)).select("url", "title", "text")


@query(
    f"""SELECT url, 'GitHub - org/' || split_part(url, '/', 5) AS title, {sql_strip('text')} AS text, {sql_integrity('text', LOGIN_PATTERNS)} AS failure_reason
        FROM (SELECT 'https://github.com/org/' || source || '-' || lang || '/tree/main' AS url, arg_min(text, doc_id) AS text
              FROM documents WHERE length(text) > 50 GROUP BY source, lang)""",
)
def repositories_captured(spark, folder):
    responses = inputs.documents(spark, folder).select(
        F.concat(F.lit("https://github.com/org/"), "source", F.lit("-"), "lang", F.lit("/tree/main")).alias("url"),
        F.col("doc_id").alias("pos"), F.lit(200).alias("status"), "text",
    )
    return extract.capture_repositories(responses).select("url", "title", "text", "failure_reason")


def _threads(spark, folder):
    """Conversations as posts: a system turn means an illustrated one."""
    turns = inputs.table(spark, folder, "conversations").withColumn(
        "url", F.concat(F.lit("https://x.com/user/status/"), "conv_id")
    )
    texts = assemble.whole_texts(
        assemble.text_parts(turns, ["url"], "turn", separator=assemble.POST_SEPARATOR), ["url"], assemble.POST_SEPARATOR
    )
    marked = turns.groupBy("url").agg(F.bool_or(F.col("role") == "system").alias("shown"))
    tile = F.struct(F.lit("/a/t.jpg").alias("path"), F.lit(0).alias("index"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    return marked.join(texts, "url", "left").select(
        "url", F.lit("x").alias("source_type"), F.lit("").alias("title"), "text",
        F.when(F.col("shown"), F.array(tile)).otherwise(F.array()).cast("array<struct<path:string,index:int,width:int,height:int>>").alias("visual_tiles"),
    )


@query(
    f"""SELECT url, 'X Document' AS title, coalesce(text, '') AS text, CASE WHEN NOT shown THEN {sql_integrity("coalesce(text, '')", LOGIN_PATTERNS)} END AS failure_reason
        FROM (SELECT 'https://x.com/user/status/' || conv_id AS url, bool_or(role = 'system') AS shown,
                     string_agg({sql_strip('text')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) FILTER ({sql_strip('text')} <> '') AS text
              FROM conversations GROUP BY conv_id)""",
)
def threads_captured(spark, folder):
    return extract.capture_threads(_threads(spark, folder)).select("url", "title", "text", "failure_reason")


# --- Triage -------------------------------------------------------------------

def _responses(spark, folder):
    """Documents with a model's answer: plain, fenced, wrapped in chatter, or junk, by language."""
    answer = F.to_json(F.struct(
        F.when(F.col("source") == "src1", F.lit("")).otherwise(F.col("source")).alias("title"),
        F.when(F.col("source") == "src2", F.lit("ml")).when(F.col("source") == "src3", F.lit("jobs")).otherwise(F.lit("agents")).alias("category"),
        F.when(F.col("source") == "src4", F.lit("Job")).otherwise(F.lit("knowledge")).alias("type"),
        F.col("text").alias("summary"),
        F.array("lang", "source").alias("insights"),
        F.when(F.col("source") == "src5", F.array().cast("array<string>")).otherwise(F.array("lang")).alias("tags"),
    ))
    response = (
        F.when(F.col("lang") == "en", answer)
        .when(F.col("lang") == "de", F.concat(F.lit("```json\n"), answer, F.lit("\n```\n")))
        .when(F.col("lang") == "fr", F.concat(F.lit("Here it is: "), answer, F.lit(" Done.")))
        .otherwise(F.concat(F.lit("sorry "), F.col("source")))
    )
    site = F.when(F.col("source") == "src7", F.lit("https://www.linkedin.com/jobs/")).otherwise(F.lit("https://a.example.org/"))
    short = F.length(text.strip(F.col("text"))) < 200
    return inputs.documents(spark, folder).select(
        "doc_id", "lang", "source", F.concat(site, "doc_id").alias("url"), F.concat(F.lit("Doc "), "doc_id").alias("title"),
        "text", F.lit("web").alias("source_type"), short.alias("failed_scrape"),
        F.when(short, F.lit("too short")).alias("failure_reason"), F.array().cast("array<string>").alias("code_snippets"),
        F.array().cast("array<struct<path:string,index:int,width:int,height:int>>").alias("visual_tiles"), response.alias("response"),
    )


_JUNK = "lang = 'es'"
SQL_ANSWERS = f"""
    SELECT doc_id, lang, source, text, length({sql_strip('text')}) < 200 AS failed,
           CASE WHEN source = 'src7' THEN 'https://www.linkedin.com/jobs/' ELSE 'https://a.example.org/' END || doc_id AS url,
           CASE WHEN {_JUNK} THEN NULL WHEN source = 'src1' THEN '' ELSE source END AS title,
           CASE WHEN {_JUNK} THEN NULL WHEN source = 'src2' THEN 'ml' WHEN source = 'src3' THEN 'jobs' ELSE 'agents' END AS category,
           CASE WHEN {_JUNK} THEN NULL WHEN source = 'src4' THEN 'Job' ELSE 'knowledge' END AS type,
           CASE WHEN {_JUNK} THEN NULL ELSE text END AS summary,
           CASE WHEN {_JUNK} THEN NULL ELSE lang || '|' || source END AS insights,
           CASE WHEN {_JUNK} OR source = 'src5' THEN NULL ELSE lang END AS tags
    FROM documents"""


@query(f"SELECT doc_id, title, category, type, summary, insights, coalesce(tags, CASE WHEN {_JUNK} THEN NULL ELSE '' END) AS tags FROM ({SQL_ANSWERS})")
def answers_parsed(spark, folder):
    parsed = _responses(spark, folder).select("doc_id", feeds.parse_answer(F.col("response")).alias("a"))
    return parsed.select(
        "doc_id", "a.title", "a.category", "a.type", "a.summary", joined("a.insights").alias("insights"), joined("a.tags").alias("tags")
    )


SQL_NORMALISED = f"""
    SELECT *, CASE WHEN final_category = 'jobs' OR contains(url, 'linkedin.com/jobs') OR lower(type) = 'job' THEN 'job' ELSE 'knowledge' END AS item_type
    FROM (SELECT *, CASE WHEN contains(url, 'linkedin.com/jobs') THEN 'jobs' WHEN category IN {tuple(CATEGORIES)} THEN category ELSE 'other' END AS final_category
          FROM ({SQL_ANSWERS}))"""
SQL_TRIAGED = f"""
    SELECT url, CASE WHEN failed THEN 'Failed Scrape - Doc ' || doc_id ELSE coalesce(nullif(title, ''), 'Doc ' || doc_id) END AS title,
           CASE WHEN failed THEN 'other' ELSE final_category END AS category,
           CASE WHEN failed THEN 'knowledge' ELSE item_type END AS item_type,
           CASE WHEN failed THEN 'Automated scraping could not extract clean content. Reason: too short.'
                ELSE coalesce(nullif(summary, ''), 'Summary generated from visual analysis.') END AS summary,
           CASE WHEN failed THEN {sql_text('|'.join(triage.FAILED_INSIGHTS))} ELSE coalesce(insights, '') END AS insights,
           CASE WHEN failed THEN 'failed_scrape|manual_review' ELSE coalesce(tags, final_category) END AS tags
    FROM ({SQL_NORMALISED})"""


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select(
        "url", "title", "category", "item_type", "summary", joined("insights").alias("insights"), joined("tags").alias("tags")
    )


@query(SQL_TRIAGED)
def answers_triaged(spark, folder):
    day = F.lit(inputs.NOTE_DAY)
    rows = _responses(spark, folder)
    failed = triage.failed_items(rows, day)
    answered = triage.normalise(rows.filter(~F.col("failed_scrape")), feeds.parse_answer(F.col("response")), day)
    return _flat(failed.unionByName(answered))


def _echo_setup(instructions: str) -> Callable:
    """A stand-in for a user's model that is down for job links; it reads the categories from its instructions."""
    names = [line[4:].split("**")[0] for line in instructions.splitlines() if line.startswith("- **")]

    def answer(request: str, images: list[str]) -> str | BaseException:
        if "linkedin.com" in request:
            return ConnectionError("primary is down")
        return '{"title": "%s", "category": "%s"}' % (request.split("\n")[2].removeprefix("Title: "), names[11])

    return lambda requests: [answer(*x) for x in requests]


def _fallback_model(request: str, images: list[str]) -> str:
    return '{"title": "second opinion", "category": "agents"}'


@query(
    f"""SELECT url, CASE WHEN failed THEN 'Failed Scrape - Doc ' || doc_id WHEN source = 'src7' THEN 'second opinion' ELSE 'Doc ' || doc_id END AS title,
               CASE WHEN failed THEN 'other' WHEN source = 'src7' THEN 'jobs' ELSE 'tools' END AS category
        FROM ({SQL_ANSWERS})""",
)
def model_triaged(spark, folder):
    rows = triage.triage(
        _responses(spark, folder), F.lit(inputs.NOTE_DAY), model=triage.BatchModel(_echo_setup), fallback=_fallback_model
    )
    return rows.select("url", "title", "category")


@query(
    """SELECT doc_id, CASE WHEN lang <> 'en' OR source = 'src1' THEN 'first' WHEN source <> 'src9' THEN 'second' END AS provider,
              CASE WHEN lang <> 'en' THEN lang WHEN source = 'src1' THEN '' WHEN source <> 'src9' THEN source END AS response FROM documents""",
)
def provider_fallback(spark, folder):
    first = F.when(F.col("lang") != "en", F.col("lang")).when(F.col("source") == "src1", F.lit(""))
    second = F.when(F.col("source") != "src9", F.col("source"))
    chosen = triage.first_answer({"first": first, "second": second})
    return inputs.table(spark, folder, "documents").select("doc_id", chosen.alias("c")).select(
        "doc_id", "c.provider", "c.response"
    )


@query(
    """SELECT url, 'URL: ' || url || '\nSource Type: web\nTitle: ' || title
              || CASE WHEN len(tile_paths) > 0 THEN '\nAttached Visual Screenshot Tiles: 1 image(s).' ELSE '' END
              || '\n\nCONTENT TO ANALYZE:\n' || CASE WHEN original_text <> '' THEN substr(original_text, 1, 10000)
                 ELSE '[Visual Document - See attached screenshot tiles]' END || '\n' AS request
       FROM triaged""", "triaged",
)
def model_requests(spark, folder):
    rows = inputs.triaged(spark, folder).withColumn("source_type", F.lit("web")).withColumnRenamed("original_text", "text")
    return rows.select("url", render.model_request().alias("request"))


# --- Small formats ------------------------------------------------------------

@query(
    """SELECT event_id, printf('%02dm %02ds', CAST(trunc(value) AS BIGINT) // 60, CAST(trunc(value) AS BIGINT) % 60) AS clock,
              strftime(ts, '%Y-%m-%d') AS day, sha256(props) AS content_hash FROM events""",
)
def event_formats(spark, folder):
    return inputs.table(spark, folder, "events").select(
        "event_id", render.clock(F.col("value")).alias("clock"), render.note_date(F.col("ts").cast("timestamp")).alias("day"),
        F.sha2("props", 256).alias("content_hash"),
    )


# --- Jobs ---------------------------------------------------------------------

def _now() -> Column:
    return F.lit(GENERATED).cast("timestamp")


def _fetched(spark, folder) -> jobs.Fetched:
    return jobs.Fetched(pages=inputs.pages(spark, folder), clutter=AD_CLUTTER)


def sql_ingested(todo: str, day: str) -> str:
    """Triage rows and paths of the links in `todo` whose material is their page."""
    corpus = "lower(page_title || chr(10) || url || chr(10) || original_text)"
    return f"""
    SELECT *, CASE WHEN category = 'jobs' THEN 'job' ELSE 'knowledge' END AS item_type,
           '{VAULT}/' || category || '/' || {sql_safe_name('title')} || '.md' AS target_path
    FROM (SELECT *, CASE WHEN reason IS NOT NULL THEN 'Failed Scrape - ' || page_title ELSE page_title END AS title,
                 CASE WHEN reason IS NOT NULL THEN 'other' ELSE rule_category END AS category,
                 CASE WHEN reason IS NOT NULL THEN 'Automated scraping could not extract clean content. Reason: ' || reason || '.'
                      ELSE 'Summary generated from visual analysis.' END AS summary,
                 CASE WHEN reason IS NOT NULL THEN {sql_list(triage.FAILED_INSIGHTS)} ELSE [] END AS insights,
                 CASE WHEN reason IS NOT NULL THEN {sql_list(triage.FAILED_TAGS)} ELSE [rule_category] END AS tags,
                 CAST([] AS VARCHAR[]) AS code_snippets, CAST([] AS VARCHAR[]) AS tile_paths, {day} AS date_str
          FROM (SELECT *, coalesce({sql_best(sql_scores(PROSE_RULES, sql_ascii(corpus)))}, {sql_keywords(corpus)}) AS rule_category
                FROM (SELECT t.*, coalesce(p.title, 'Untitled Document') AS page_title, coalesce(p.text, '') AS original_text,
                             CASE WHEN p.url IS NULL THEN {sql_text(extract.NOT_CAPTURED)} ELSE {sql_integrity('p.text', LOGIN_PATTERNS)} END AS reason
                      FROM ({todo}) t LEFT JOIN ({SQL_CAPTURED_PAGES}) p ON p.url = t.url)))"""


def _results(done: jobs.Ingested) -> DataFrame:
    return done.results.select("url", "title", "category", "type", "target_path", "is_overwrite")


_WORKED = "date DESC NULLS FIRST, message_id DESC, pos, url"


def sql_results(todo: str, day: str, again: str = "false", order: str = _WORKED) -> str:
    return f"""SELECT url, title, category, item_type AS type, target_path,
                      {again} OR row_number() OVER (PARTITION BY target_path ORDER BY {order}) > 1 AS is_overwrite
               FROM ({sql_ingested(todo, day)})"""


_DAY = "strftime(date, '%Y-%m-%d')"
_SQL_TODAY = f"'{GENERATED[:10]}'"


@cache
def _batch(spark, folder) -> jobs.Ingested:
    return jobs.ingest(
        inputs.messages(spark, folder), inputs.page_registry(spark, folder), inputs.notes(spark, folder),
        _fetched(spark, folder), VAULT, now=_now(), rules=PROSE_RULES,
    )


@query(sql_results("SELECT * FROM oldest", _DAY, "hits > 1"), "oldest")
def ingest_batch_results(spark, folder):
    return _results(_batch(spark, folder))


@query(
    f"""SELECT target_path AS file_path, {inputs.SQL_CONTENT} AS content FROM (
            SELECT * FROM ({sql_ingested("SELECT * FROM oldest", _DAY)})
            QUALIFY row_number() OVER (PARTITION BY target_path ORDER BY date, message_id, pos DESC, url DESC) = 1)""", "oldest",
)
def ingest_batch_notes(spark, folder):
    return _batch(spark, folder).notes.select("file_path", "content")


@cache
def _session(spark, folder) -> jobs.Ingested:
    return jobs.ingest(
        inputs.messages(spark, folder), inputs.page_registry(spark, folder), inputs.page_files(spark, folder),
        _fetched(spark, folder), VAULT, session=True, now=_now(), rules=PROSE_RULES,
    )


_UNSKIPPED = f"SELECT * FROM newest WHERE {SQL_HOST} NOT LIKE '%.org'"


@query(sql_results(_UNSKIPPED, _DAY), "newest")
def ingest_session_results(spark, folder):
    return _results(_session(spark, folder))


@cache
def _failing(spark, folder) -> jobs.Ingested:
    """The same session where fetching every seventh page raised."""
    pages = inputs.pages(spark, folder)
    errors = pages.filter("page_id % 7 = 3").select("url", F.concat(F.lit("TimeoutError: page "), "page_id").alias("error"))
    return jobs.ingest(
        inputs.messages(spark, folder), inputs.page_registry(spark, folder), inputs.page_files(spark, folder),
        jobs.Fetched(pages=pages, clutter=AD_CLUTTER, errors=errors), VAULT, session=True, now=_now(), rules=PROSE_RULES,
    )


SQL_RAISED = "(SELECT url, min(page_id) AS page_id FROM pages WHERE page_id % 7 = 3 GROUP BY url)"


@query(
    f"""SELECT count(*) FILTER (todo AND e.url IS NULL) AS processed,
               CAST(coalesce(sum(CASE WHEN NOT todo THEN hits WHEN e.url IS NULL THEN hits - 1 END), 0) AS BIGINT) AS skipped,
               CAST(coalesce(sum(hits) FILTER (todo AND e.url IS NOT NULL), 0) AS BIGINT) AS failed
        FROM (SELECT *, {SQL_HOST} NOT LIKE '%.org' AS todo FROM newest) n LEFT JOIN {SQL_RAISED} e ON e.url = n.url""", "newest",
)
def ingest_session_outcomes(spark, folder):
    return _failing(spark, folder).outcomes


@query(
    f"""SELECT n.url, 'TimeoutError: page ' || page_id AS error, true AS failed
        FROM newest n JOIN {SQL_RAISED} e ON e.url = n.url WHERE {SQL_HOST.replace('url', 'n.url')} NOT LIKE '%.org'""", "newest",
)
def ingest_session_errors(spark, folder):
    return _failing(spark, folder).errors


@query(
    f"SELECT category, count(*) AS n FROM ({sql_ingested(_UNSKIPPED, _DAY)}) GROUP BY category", "newest",
)
def ingest_session_categories(spark, folder):
    return stats.category_counts(_session(spark, folder).items)


@query(
    f"""SELECT coalesce(r.url, t.url) AS url, coalesce(t.title, r.title) AS title, coalesce(t.target_path, r.file_path) AS file_path,
               coalesce(t.category, r.category) AS category, coalesce(t.message_id, r.telegram_message_id) AS telegram_message_id,
               coalesce(sha256(t.original_text), r.content_hash) AS content_hash
        FROM page_registry r FULL JOIN ({sql_ingested(_UNSKIPPED, _DAY)}) t ON t.url = r.url""", "newest", "page_registry",
)
def ingest_session_registry(spark, folder):
    after = _session(spark, folder).registry_after(inputs.page_registry(spark, folder))
    return after.select("url", "title", "file_path", "category", "telegram_message_id", "content_hash")


@query(
    sql_results("SELECT url, telegram_message_id AS message_id FROM page_registry WHERE category = 'other'", _SQL_TODAY, order="message_id DESC, url"),
    "page_registry",
)
def reprocess_failed_results(spark, folder):
    done = jobs.reprocess_failed(
        inputs.page_registry(spark, folder), inputs.notes(spark, folder), _fetched(spark, folder), VAULT,
        now=_now(), rules=PROSE_RULES,
    )
    return _results(done)


# Links of all sources, one per conversation; its turns are posts, snippets, readme candidates or the text of a page or paper.
SQL_SOURCED = """
    SELECT conv_id, conv_id % 6 AS kind, CASE conv_id % 6
        WHEN 0 THEN 'https://x.com/u/status/' || conv_id WHEN 1 THEN 'https://www.linkedin.com/posts/p' || conv_id
        WHEN 2 THEN 'https://www.youtube.com/watch?v=' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 11) WHEN 3 THEN 'https://github.com/org/r' || conv_id
        WHEN 4 THEN 'https://site' || conv_id % 7 || '.example.org/p/' || conv_id ELSE 'https://arxiv.org/abs/2405.' || (10000 + conv_id) END AS url"""
_HTML = ("<html><head><title>Page ", "</title></head><body><nav>menu</nav><div class='cookie-bar'><div>we</div> accept</div><p>", "</p></body></html>")


@cache
def _all_sources(spark, folder) -> tuple[DataFrame, jobs.Fetched]:
    turns = inputs.table(spark, folder, "conversations")
    view = turns.selectExpr("*", SQL_SOURCED.split("SELECT conv_id, ", 1)[1].replace("conv_id % 6 AS kind, ", "", 1).replace("VARCHAR", "STRING").strip())
    view = view.withColumn("kind", F.expr("conv_id % 6"))
    def kind(*which):
        return view.filter(F.col("kind").isin(*which))

    first = kind(3, 4, 5).groupBy("conv_id", "kind", "url").agg(F.min_by("text", "turn").alias("text"))
    once = view.select("conv_id", "kind", "url").distinct()
    track = kind(2).filter("conv_id % 4 <> 0").withColumn("track", F.min("turn").over(Window.partitionBy("conv_id", "role")))
    language = F.when(F.col("role") == "user", "fr").when(F.col("role") == "assistant", "de").otherwise("xx")
    html_ = F.concat(F.lit(_HTML[0]), "conv_id", F.lit(_HTML[1]), "text", F.lit(_HTML[2]))
    messages = once.select(
        F.col("conv_id").alias("message_id"), (F.lit("2025-10-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("conv_id"))).alias("date"),
        F.concat(F.lit("see "), "url").alias("text"),
    )
    return messages, jobs.Fetched(
        posts=kind(0, 1).select("url", F.col("turn").alias("pos"), "text", F.when(F.col("turn") == 1, F.concat(F.lit("Post "), "conv_id")).alias("title")),
        tracks=track.select("url", language.alias("lang"), F.col("track").alias("pos")).distinct(),
        snippets=track.select("url", "track", F.col("turn").alias("pos"), "text"),
        video_metadata=once.filter("kind = 2 AND conv_id % 9 <> 2").select("url", F.to_json(F.struct(F.concat(F.lit("Talk "), "conv_id").alias("title"), F.lit("Channel").alias("author_name"))).alias("metadata")),
        readmes=kind(3).select("url", F.col("turn").alias("pos"), F.when(F.col("conv_id") % 4 == 1, 404).otherwise(200).alias("status"), "text"),
        pages=first.filter("kind IN (3, 4)").select("url", html_.alias("html")),
        papers=first.filter("kind = 5").select("url", F.concat(F.lit("<entry><title>Paper "), "conv_id", F.lit("</title><summary>"), "text", F.lit("</summary></entry>")).alias("xml")),
        images=once.filter("kind IN (0, 4)").select("url", F.lit(1280).alias("width"), (F.col("conv_id") % 9 * 1000 + 1).cast("int").alias("height")),
        attachments=f"{VAULT}/attachments",
        errors=once.filter("conv_id % 13 = 5").select("url", F.lit("ConnectionError: reset").alias("error")),
    )


@cache
def _all_ingested(spark, folder) -> jobs.Ingested:
    messages, fetched = _all_sources(spark, folder)
    return jobs.ingest(messages, inputs.page_registry(spark, folder), inputs.notes(spark, folder), fetched, VAULT, now=_now(), rules=PROSE_RULES)


def sql_all_ingested() -> str:
    stripped = sql_strip("text")
    joined_turns = lambda separator: f"string_agg({stripped}, {separator} ORDER BY turn) FILTER ({stripped} <> '')"
    rule = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    video = sql_strip(
        "'# Video Title: ' || title || '\n# Channel / Creator: ' || author || '\n# URL: ' || url || CASE WHEN coalesce(t, '') <> '' THEN '\n\n## Full Spoken Transcript:\n' || t ELSE '\n\n"
        + feeds.NO_TRANSCRIPT_NOTE + "' END"
    )
    page_reason = f"CASE WHEN length(body) >= 200 OR tiles = 0 THEN {sql_integrity('body', LOGIN_PATTERNS)} END"
    return f"""
    WITH turns AS (
        SELECT *, (min(turn) OVER (PARTITION BY conv_id, role)) AS track FROM ({SQL_SOURCED}, turn, role, text FROM conversations)
    ), sized AS (
        SELECT conv_id, kind, url, CASE WHEN kind IN (0, 4) THEN CAST(least(greatest(ceil((conv_id % 9 * 1000 + 1) / 1568), 1), 5) AS INTEGER) ELSE 0 END AS tiles,
               arg_min(text, turn) AS first_text, max(CASE WHEN turn = 1 THEN 'Post ' || conv_id END) AS post_title,
               CASE WHEN kind = 0 THEN {joined_turns(rule)} ELSE {joined_turns("chr(10) || chr(10)")} END AS thread,
               arg_min(text, turn) FILTER (conv_id % 4 <> 1 AND length(text) > 50) AS readme
        FROM turns GROUP BY conv_id, kind, url
    ), threads AS (
        SELECT *, coalesce(post_title, CASE kind WHEN 0 THEN 'X Document' ELSE 'Linkedin Document' END) AS title, coalesce(thread, '') AS body FROM sized WHERE kind IN (0, 1)
    ), spoken AS (
        SELECT conv_id, {joined_turns("' '")} AS text FROM turns t
        WHERE kind = 2 AND conv_id % 4 <> 0 AND track = (SELECT arg_min(u.track, (CASE u.role WHEN 'assistant' THEN 4 WHEN 'user' THEN 6 ELSE 7 END, u.track)) FROM turns u WHERE u.conv_id = t.conv_id)
        GROUP BY conv_id
    ), videos AS (
        SELECT s.*, CASE WHEN s.conv_id % 9 <> 2 THEN 'Talk ' || s.conv_id ELSE 'YouTube Video / Podcast' END AS title,
               CASE WHEN s.conv_id % 9 <> 2 THEN 'Channel' ELSE 'YouTube Channel' END AS author, {sql_promo('c')} AS t
        FROM sized s LEFT JOIN (SELECT conv_id, {sql_transcript('text')} AS c FROM spoken) p ON p.conv_id = s.conv_id WHERE kind = 2
    ), paged AS (
        SELECT *, {sql_squeeze('first_text')} AS body FROM sized WHERE kind IN (3, 4)
    ), repositories AS (
        SELECT *, {sql_strip('readme')} AS own, {sql_integrity('readme', LOGIN_PATTERNS)} AS own_reason FROM paged WHERE kind = 3
    ), captured AS (
        SELECT conv_id, url, title, {sql_strip('body')} AS text, tiles, CASE WHEN tiles = 0 THEN {sql_integrity('body', LOGIN_PATTERNS)} END AS reason FROM threads
        UNION ALL
        SELECT conv_id, url, title, {video}, 0, CASE WHEN coalesce(t, '') = '' AND length(title) < 15 THEN 'No transcript or description available for YouTube video' END
        FROM videos WHERE conv_id % 9 <> 2 OR conv_id % 4 <> 0
        UNION ALL
        SELECT conv_id, url, 'Untitled Document', '', 0, {sql_text(extract.NOT_CAPTURED)} FROM videos WHERE conv_id % 9 = 2 AND conv_id % 4 = 0
        UNION ALL
        SELECT conv_id, url, CASE WHEN own IS NOT NULL AND own_reason IS NULL THEN 'GitHub - org/r' || conv_id ELSE 'Page ' || conv_id END,
               CASE WHEN own IS NOT NULL AND own_reason IS NULL THEN own ELSE body END, 0,
               CASE WHEN own IS NOT NULL AND own_reason IS NULL THEN NULL ELSE {sql_integrity('body', LOGIN_PATTERNS)} END FROM repositories
        UNION ALL
        SELECT conv_id, url, 'Page ' || conv_id, body, CASE WHEN length(body) >= 200 THEN 0 ELSE tiles END, {page_reason} FROM paged WHERE kind = 4
        UNION ALL
        SELECT conv_id, url, 'Paper ' || conv_id, {sql_strip("'# Title: Paper ' || conv_id || '\n# Authors: Unknown\n# ArXiv ID: 2405.' || (10000 + conv_id) || '\n\n## Abstract:\n' || " + sql_strip('first_text'))}, 0, NULL FROM sized WHERE kind = 5
    ), ruled AS (
        SELECT *, lower(title || chr(10) || url || chr(10) || text) AS corpus, reason IS NOT NULL AND tiles = 0 AS guarded FROM captured WHERE conv_id % 13 <> 5
    )
    SELECT url, CASE WHEN guarded THEN 'Failed Scrape - ' || title ELSE title END AS title, text AS original_text, tiles AS n_tiles,
           CASE WHEN guarded THEN 'other' ELSE coalesce({sql_best(sql_scores(PROSE_RULES, sql_ascii('corpus')))}, {sql_keywords('corpus')}) END AS category FROM ruled"""


@query(sql_all_ingested())
def ingest_all_sources(spark, folder):
    items = _all_ingested(spark, folder).items
    return items.select("url", "title", "original_text", F.size("visual_tiles").alias("n_tiles"), "category")


@query(
    f"""SELECT count(*) FILTER (conv_id % 13 <> 5) AS processed, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (conv_id % 13 = 5) AS failed
        FROM (SELECT DISTINCT conv_id FROM conversations)""",
)
def ingest_all_outcomes(spark, folder):
    return _all_ingested(spark, folder).outcomes


@query("SELECT file_name, category, content FROM notes", "notes")
def notes_read_back(spark, folder):
    """Notes written as files by the executors, and read from the folder tree again."""
    place = f"{shared_folder(spark).rstrip('/').removeprefix('file://')}/notes-{uuid.uuid4().hex}"
    moved = inputs.notes(spark, folder).withColumn("file_path", F.concat(F.lit(place), "file_path"))
    export_notes(moved).count()
    return read_notes(spark, place).select("file_name", "category", "content")


@query(
    f"""SELECT url, list_aggregate([printf('{VAULT}/attachments/%d_%02d.jpg', page_id, i) FOR i IN range(least(page_id % 7, 3))], 'string_agg', '|') AS shown
        FROM pages WHERE page_id % 7 > 0""",
)
def images_shown(spark, folder):
    """Of the tiles of a page a model is shown the first three."""
    tile = lambda i: F.struct(
        F.format_string(f"{VAULT}/attachments/%s_%02d.jpg", "page_id", i).alias("path"), i.cast("int").alias("index"), F.lit(1).alias("width"), F.lit(1).alias("height")
    )
    rows = inputs.pages(spark, folder).filter("page_id % 7 > 0")
    tiles_ = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("page_id") % 7 - 1), tile)
    return rows.select("url", joined(triage.model_images(tiles_)).alias("shown"))


@query(
    f"""SELECT url, title, category, item_type AS type, target_path FROM ({sql_ingested("SELECT DISTINCT url, CAST(NULL AS TIMESTAMP) AS date FROM pages", _SQL_TODAY)})""",
)
def ingest_given_links(spark, folder):
    """Links given by the caller, some of them twice, without a feed."""
    given = inputs.pages(spark, folder).select("url")
    done = jobs.ingest_links(
        given.unionByName(given.limit(10)), inputs.page_registry(spark, folder), inputs.notes(spark, folder), _fetched(spark, folder), VAULT, now=_now(), rules=PROSE_RULES
    )
    return _results(done).drop("is_overwrite")


_RECENT = f"""SELECT url, arg_min(message_id, (date, message_id, pos)) AS message_id, min(date) AS date, arg_min(pos, (date, message_id, pos)) AS pos
    FROM links WHERE message_id IN (SELECT message_id FROM messages WHERE date >= TIMESTAMP '2024-01-10' ORDER BY date DESC, message_id DESC LIMIT 500) GROUP BY url"""


@query(
    f"""SELECT url, CASE WHEN reason IS NULL THEN 'second opinion' ELSE title END AS title, CASE WHEN reason IS NULL THEN 'agents' ELSE category END AS category
        FROM ({sql_ingested(_RECENT, _DAY)})""", "links",
)
def ingest_newest_with_model(spark, folder):
    """A batch over the 500 newest messages since a day, triaged by a model whose first provider is down."""
    def down(instructions: str) -> Callable:
        return lambda requests: [ConnectionError("down") for _ in requests]

    done = jobs.ingest(
        inputs.messages(spark, folder), inputs.page_registry(spark, folder), inputs.notes(spark, folder), _fetched(spark, folder), VAULT,
        since=cutoff("2024-01-10"), limit=500, now=_now(), model=triage.BatchModel(down), fallback=_fallback_model,
    )
    return done.results.select("url", "title", "category")


# --- Streams ------------------------------------------------------------------

def _run(spark, stream: DataFrame, batch: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> str:
    """Run a stream over all its files; returns the folder it wrote to."""
    place = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    writer = writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", f"{place}/rows")
    writer.start().awaitTermination()
    return place


def _rows(spark, stream: DataFrame) -> DataFrame:
    schema = stream.schema
    return spark.read.schema(schema).parquet(f"{_run(spark, stream)}/rows")


@query("SELECT message_id, pos, url FROM links", "links")
def stream_links(spark, folder):
    return _rows(spark, streams.link_stream(inputs.message_stream(spark, folder)).select("message_id", "pos", "url"))


@query("SELECT message_id, pos, url FROM links", "links")
def stream_resumed(spark, folder):
    """The same stream stopped before it began, by a time budget of no seconds, and resumed from its checkpoint until the end."""
    place = f"{shared_folder(spark).rstrip('/')}/resumed-{uuid.uuid4().hex}"
    links = streams.link_stream(inputs.message_stream(spark, folder)).select("message_id", "pos", "url")
    writer = links.writeStream.option("checkpointLocation", f"{place}/state").format("parquet").option("path", f"{place}/rows")
    streams.run_for(writer.trigger(processingTime="1 hour").start(), 0.001)
    for _ in range(2):  # the second run finds nothing new
        if not streams.run_for(writer.trigger(availableNow=True).start(), 3600):
            raise TimeoutError("the stream did not end")
    return spark.read.schema(links.schema).parquet(f"{place}/rows")


@query("SELECT DISTINCT url FROM links", "links")
def stream_first_links(spark, folder):
    return _rows(spark, streams.first_links(streams.link_stream(inputs.message_stream(spark, folder))).select("url"))


@query("SELECT DISTINCT url FROM links", "links")
def stream_first_links_bounded(spark, folder):
    links = streams.link_stream(inputs.message_stream(spark, folder))
    return _rows(spark, streams.first_links(links, "90 days").select("url"))


@query(
    f"""SELECT {sql_routes(f"lower({SQL_HOST})", HOST_ROUTES)} AS source_type, count(*) AS n FROM links GROUP BY 1""", "links",
)
def stream_counts(spark, folder):
    counts = streams.running_counts(
        streams.link_stream(inputs.message_stream(spark, folder)), urls.source_type(F.col("url"), HOST_ROUTES)
    )
    place = f"{shared_folder(spark).rstrip('/')}/counts-{uuid.uuid4().hex}"
    _run(spark, counts, lambda rows, _: rows.write.mode("overwrite").parquet(place), "complete")
    return spark.read.schema(counts.schema).parquet(place)


@query(
    f"""SELECT url, title, target_path AS file_path, category, item_type, message_id AS telegram_message_id
        FROM ({sql_ingested("SELECT * FROM newest", _DAY)})""", "newest",
)
def stream_ingested_registry(spark, folder):
    vault = Vault.at(spark, f"{shared_folder(spark).rstrip('/')}/vault-{uuid.uuid4().hex}")
    work = streams.ingest_batch(vault, lambda: _fetched(spark, folder), VAULT, now=_now(), rules=PROSE_RULES)
    _run(spark, inputs.message_stream(spark, folder), work)
    return vault.registry.read().select("url", "title", "file_path", "category", "item_type", "telegram_message_id")
