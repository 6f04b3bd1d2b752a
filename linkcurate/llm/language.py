"""Language identification by fusing evidence as Bayes has it.

log P(language | all) = text log-likelihood (hashed byte trigrams, tempered) + log P(declared language | language) + log prior of the
host, up to a constant. The host's prior is smoothed towards that of its domain, this towards its address suffix, and this
towards all rows. Priors and the reliability of declarations are grouped aggregations of the text posteriors of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructType

from linkcurate.llm.common import apart, small, stored
from linkcurate.llm.hashing import LOWER

_BITS = 15
#: Bytes that carry language: ASCII letters and everything beyond ASCII; runs of all others count as one space.
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


_WINDOW = 1 << 18


def trigrams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all parts in a row, and the place of each part's first (one entry more than parts)."""
    data = LOWER[np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)]
    owner = np.repeat(np.arange(len(parts) + 1), [len(p) + 1 for p in parts] + [1])
    letter = _LETTER[data]
    keep = letter | np.concatenate([[True], letter[:-1] | (owner[1:] != owner[:-1])])
    data, owner = np.where(letter, data, 32)[keep].astype(np.uint32), owner[keep]
    codes = ((data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)
    inside = (owner[:-2] == owner[2:]) & (data[1:-1] != 32)
    return codes[inside], np.searchsorted(owner[:-2][inside], np.arange(len(parts) + 1))


def _windows(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts (their numbers and bytes) in groups of about `_WINDOW` bytes; a longer text in parts that share a character between words.

    Trigrams are centred on letters, so such parts have the trigrams of the whole. Only a run of `_WINDOW` letters is cut inside.
    """
    which: list[int] = []
    parts: list[bytes] = []
    held = 0
    for i, text in enumerate(texts):
        data, start = (text or "").encode("utf-8", "surrogatepass"), 0
        while True:
            end = len(data)
            if end - start > _WINDOW:
                blank = max(data.rfind(b" ", start + 1, start + _WINDOW), data.rfind(b"\n", start + 1, start + _WINDOW))
                end = blank + 1 if blank > 0 else start + _WINDOW
            which.append(i)
            parts.append(data[start:end])
            held += end - start
            if held > _WINDOW:
                yield which, parts
                which, parts, held = [], [], 0
            if end == len(data):
                break
            start = end - 1 if data[end - 1] in b" \n" else end
    if parts:
        yield which, parts


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # log P(trigram | language), one row per trigram

    def likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log-likelihoods (one row per text) and numbers of trigrams."""
        sums, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for which, parts in _windows(texts):
            codes, first = trigrams(parts)
            np.add.at(sizes, which, np.diff(first))
            for k in range(0, len(self.languages), 8):  # a few languages at a time: memory does not grow with their number
                table = self.table[:, k : k + 8]
                total = np.zeros((len(codes) + 1, table.shape[1]))
                np.cumsum(table[codes], axis=0, out=total[1:])
                np.add.at(sums[:, k : k + 8], which, total[first[1:]] - total[first[:-1]])
        return sums, sizes


def fit_text_model(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = 300, languages: int | None = None) -> TextModel:
    """Trigram counts of at most `rows_per_language` whole texts for each label (None: all; else the `languages` most frequent).

    Rows are taken by the least hash of their key; the first look reads keys and labels only.
    """
    known = labelled.where(F.col(lang).isNotNull() & (F.col(lang) != "")).groupBy(lang).count().orderBy(F.desc("count"), lang)
    names = sorted(r[0] for r in (known if languages is None else known.limit(languages)).collect())
    if not names:
        return TextModel([], np.zeros((1 << _BITS, 0)))
    order = Window.partitionBy("l").orderBy("h", "k")
    some = labelled.where(F.col(lang).isin(names) if languages else F.col(lang) != "").select(F.col(key).alias("k"), F.col(lang).alias("l"), F.xxhash64(key).alias("h"))
    some = some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows_per_language).select("k", "l").distinct()
    rows = labelled.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).cast("string").alias("text")).join(F.broadcast(some), ["k", "l"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(names)}
        for batch in small(batches, 50):
            of = np.array([place[x] for x in batch.column("l").to_pylist()], np.int64)
            for which, parts in _windows(batch.column("text").to_pylist()):
                codes, first = trigrams(parts)
                at, n = np.unique(np.repeat(of[which], np.diff(first)) << _BITS | codes, return_counts=True)
                yield pa.record_batch([pa.array(at), pa.array(n)], ["at", "n"])

    counts = np.zeros(len(names) << _BITS)
    for r in rows.select("l", "text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r.at] = r.n
    counts = counts.reshape(len(names), -1).T + 0.05
    return TextModel(names, np.log(counts / counts.sum(axis=0, keepdims=True)))


def _levels(host: Column) -> tuple[Column, Column]:
    """Domain (last two labels) and address suffix (last label; none without a dot) of a host."""
    labels = F.split(F.lower(F.coalesce(host, F.lit(""))), r"\.")
    n = F.size(labels)
    return F.when(n >= 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(F.element_at(labels, -1)), F.when(n >= 2, F.element_at(labels, -1)).otherwise("")


def identify(
    rows: DataFrame, model: TextModel, *, text: str = "text", declared: str = "lang", host: str = "source", strength: float = 20.0,
    evidence: int = 60, least_posterior: float = 0.5, broadcast_rows: int = 50_000,
) -> DataFrame:
    """`rows` with `language`, `posterior` and `identified` added (replacing columns of these names); all rows stay.

    A text counts for at most `evidence` independent trigrams, so that the other evidence can speak against it. `strength` is the
    weight, in rows, of a parent in the smoothing. A row is identified if its text has letters and the best language has at
    least `least_posterior`; null, empty and letterless texts have no language and posterior 0. Null or unknown declarations
    say nothing; rows with a null host share one. Host priors are broadcast if they have at most `broadcast_rows` rows.
    """
    names = model.languages
    if not names:
        return rows.drop("language", "posterior", "identified").withColumns({"language": F.lit(None).cast("string"), "posterior": F.lit(0.0), "identified": F.lit(False)})
    rows, name, back = apart(rows.drop("language", "posterior", "identified"))
    text, declared, host = name[text], name[declared], name[host]
    scored = _scored(rows, model, text, evidence)
    n = len(names)
    sums = [F.sum(F.when(F.col("__letters"), F.col("__share")[i])).alias(f"s{i}") for i in range(n)]
    hosts = F.lower(F.coalesce(F.col(host).cast("string"), F.lit("")))
    value = F.when(F.col(declared).isin(names), F.col(declared)).otherwise("")
    # One pass over all texts; copies and popular hosts meet in the combining aggregation.
    seen = scored.select(hosts.alias("host"), value.alias("declared"), _softmax(F.col("__text")).alias("__share"), "__letters").groupBy("host", "declared").agg(*sums)
    seen = stored(seen, "language-counts").fillna(0.0)
    total = seen.groupBy("declared").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]).collect()
    by_value = {r.declared: np.array([r[f"s{i}"] for i in range(n)], float) for r in total}
    overall = sum(by_value.values(), np.zeros(n))
    base = (overall + 1) / (overall + 1).sum()
    named = np.array([by_value.get(x, np.zeros(n)) for x in names]) + 0.5
    says = {x: np.log(named[i] / named.sum(axis=0)).tolist() for i, x in enumerate(names)}
    priors = stored(_priors(seen, base, strength, n), "language-priors")
    if priors.count() <= broadcast_rows:
        priors = F.broadcast(priors)
    log_declared = rows.sparkSession.createDataFrame(list(says.items()), "__declared string, __says array<double>")
    none = F.array_repeat(F.lit(0.0), n)
    joined = scored.withColumn("__host", hosts).join(priors, "__host", "left").join(F.broadcast(log_declared), F.col(declared) == F.col("__declared"), "left")
    fused = F.zip_with(F.zip_with("__text", F.coalesce("__says", none), lambda a, b: a + b), "__prior", lambda a, b: a + F.log(b))
    best = F.array_max(F.zip_with(_softmax(F.col("__fused")), F.array(*map(F.lit, names)), lambda p, x: F.struct(p.alias("p"), x.alias("x"))))
    done = joined.withColumn("__fused", fused).withColumn("__best", best)
    return done.select(
        *back, F.when(F.col("__letters"), F.col("__best.x")).alias("language"), F.when(F.col("__letters"), F.col("__best.p")).otherwise(0.0).alias("posterior"),
        (F.col("__letters") & (F.col("__best.p") >= least_posterior)).alias("identified"),
    )


def _softmax(x: Column) -> Column:
    """Largest value, powers and their sum are computed once."""
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    total = lambda powers: F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
    powers = once(F.array_max(x), lambda most: F.transform(x, lambda v: F.exp(v - most)))
    return once(powers, lambda p: once(total(p), lambda s: F.transform(p, lambda v: v / s)))


def _scored(rows: DataFrame, model: TextModel, text: str, evidence: int) -> DataFrame:
    schema = StructType(list(rows.schema.fields)).add("__text", ArrayType(DoubleType())).add("__letters", BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sums, sizes = model.likelihoods(batch.column(text).to_pylist())
            sums *= (np.minimum(sizes, evidence) / np.maximum(sizes, 1))[:, None]
            offsets = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * len(model.languages))
            added = [pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1))), pa.array(sizes > 0)]
            yield pa.record_batch([*batch.columns, *added], [*batch.schema.names, "__text", "__letters"])

    return rows.mapInArrow(run, schema)


def _priors(seen: DataFrame, base: np.ndarray, strength: float, n: int) -> DataFrame:
    """Smoothed P(language | host) for every host; suffix and domain are sums over their hosts."""
    domain, suffix = _levels(F.col("host"))
    hosts = seen.groupBy("host").agg(F.array(*[F.sum(f"s{i}") for i in range(n)]).alias("n")).withColumns({"domain": domain, "suffix": suffix})
    add = lambda level: hosts.groupBy(level).agg(F.array(*[F.sum(F.col("n")[i]) for i in range(n)]).alias(f"n_{level}"))

    def smoothed(counts: Column, parent: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, parent, lambda c, p: (c + strength * p) / (total + strength))

    hosts = hosts.join(add("domain"), "domain").join(add("suffix"), "suffix")
    hosts = hosts.withColumn("__s", smoothed(F.col("n_suffix"), F.array(*map(F.lit, base.tolist())))).withColumn("__d", smoothed(F.col("n_domain"), F.col("__s")))
    return hosts.select(F.col("host").alias("__host"), smoothed(F.col("n"), F.col("__d")).alias("__prior"))


def page_evidence(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """`pages` with text (markup, scripts and styles taken out), lang (of the markup) and host (of the address)."""
    page = F.coalesce(F.col(html).cast("string"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*+>", " ")
    return pages.withColumns({
        "text": bare, "lang": F.lower(F.regexp_extract(page, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)),
        "host": F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)),
    })
