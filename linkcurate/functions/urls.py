"""Link extraction, splitting and routing as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkcurate.functions.text import SPACE_CLASS, safe_file_name
from linkcurate.rules import README_BRANCHES, ROUTES

# A dotted host of any number of labels as one run of its characters, a port, and a path. Two dots in a row end a host: what
# stands before them is a candidate of its own, without port and path. No group is repeated, so Java's matcher never goes deep.
_HOST = r"[a-zA-Z0-9-][a-zA-Z0-9.-]*\.[a-zA-Z]{2,}"
LINK = (
    rf"(?iU)https?://(?:(?![a-zA-Z0-9.-]*\.\.){_HOST}(?::\d+)?"
    rf"""(?:/[^{SPACE_CLASS}<>'"`()]*)?"""
    r"|[a-zA-Z0-9-][a-zA-Z0-9.-]*?(?=\.\.))"
)
_WHOLE = rf"(?is)^https?://{_HOST}(?::[0-9]+)?(?:/.*)?"
TRAILING = ".,!?:;)"

_SCHEME = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?"
VIDEO_ID = r"(?:v=|/|youtu\.be/|embed/|shorts/)([a-zA-Z0-9_-]{11})"
PAPER_ID = r"arxiv\.org/(?:abs|pdf)/([0-9]+\.[0-9]+(?:v[0-9]+)?)"


def extract_urls(text: Column) -> Column:
    """Distinct links of one text in first-seen order; never NULL."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), lambda u: F.regexp_extract(u, _WHOLE, 0))
    found = F.transform(F.filter(whole, lambda u: u != ""), lambda u: F.rtrim(u, F.lit(TRAILING)))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def authority(url: Column) -> Column:
    """Host with user info and port, '' when there is none."""
    return F.regexp_extract(url, _SCHEME + r"//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """The path without parameters, query and fragment."""
    whole = F.regexp_extract(url, _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(whole, ";[^/]*$", "")


def _in_host(host: Column, part: str, strict: bool) -> Column:
    if not strict:
        return host.contains(part)
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")
    return (bare == part) | bare.endswith("." + part)


def source_type(
    url: Column,
    routes: Sequence[tuple[str, Sequence[str]]] = tuple(ROUTES),
    *,
    force_visual: bool = False,
    strict: bool = False,
    default: str = "web",
) -> Column:
    """Route a link by its host, first matching route wins.

    The test is a substring of the host, so `netflix.com` takes the `x.com`
    route; `strict` compares whole domain suffixes instead. `force_visual`
    switches the code-host route off.
    """
    host = F.lower(authority(url))
    route = None
    for name, parts in routes:
        if force_visual and name == "github":
            continue
        hit = _in_host(host, parts[0], strict)
        for part in parts[1:]:
            hit = hit | _in_host(host, part, strict)
        route = F.when(hit, name) if route is None else route.when(hit, name)
    return F.lit(default) if route is None else route.otherwise(default)


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, VIDEO_ID, 1), F.lit(""))


def watch_url(video: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video)


def paper_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, PAPER_ID, 1), F.lit(""))


def repository(url: Column) -> Column:
    """`owner/name` of a repository link, NULL with fewer than two path parts."""
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), "/"))


def readme_candidates(url: Column, branches: Sequence[str] = tuple(README_BRANCHES)) -> Column:
    """Raw readme addresses to try, in order; NULL when not a repository."""
    repo = repository(url)
    return F.when(
        repo.isNotNull(),
        F.array(*[
            F.concat(F.lit("https://raw.githubusercontent.com/"), repo, F.lit(f"/{b}/README.md"))
            for b in branches
        ]),
    )


def effective_source(url: Column, **kwargs) -> Column:
    """The route after its id check: links without a usable id go to the web route."""
    route = source_type(url, **kwargs)
    return (
        F.when((route == "youtube") & video_id(url).isNull(), F.lit("web"))
        .when((route == "arxiv") & paper_id(url).isNull(), F.lit("web"))
        .when((route == "github") & repository(url).isNull(), F.lit("web"))
        .otherwise(route)
    )


def slug(url: Column) -> Column:
    """Short file-name stem from the path of a link."""
    flat = F.translate(path(url), "/", "_")
    return safe_file_name(F.when(flat == "", F.lit("page")).otherwise(flat), 30)


def host_bucket(url: Column) -> Column:
    """A stable number below 100000 for the host, from the first five hexadecimal digits of its MD5."""
    return (F.conv(F.left(F.md5(authority(url)), F.lit(5)), 16, 10).cast("int") % 100000).cast("int")
