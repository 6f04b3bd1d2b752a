"""Personal data: high-recall generators propose spans, boosted trees and calibrated thresholds select redactions. All in the JVM.

Base spans follow fixed rules and always stay. Generators add spans that the rules miss: addresses written with words or
brackets for their signs, numbers grouped by other signs. Each gets format and context features, gradient-boosted trees
score it, and a threshold per kind, set on held-out examples, decides. The trees are turned into an expression, so documents
are read once, in one projection without a shuffle.

The trees are fitted on `train_rows` examples made by functions of a row number: telephone numbers, cards, addresses and the
numbers, dates, versions and phrases that look like them, with words around them. No document is needed for it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkcurate.llm.common import apart, once

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Groups that repeat are possessive, which changes no match here and needs no stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20|\x20?@\x20?)", r"(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)"
#: The generators of further spans, by kind.
PROPOSED = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "ip": r"(?<![0-9A-Za-z])[0-9]{1,3}+(?:\x20?[\[({]\x20?(?:\.|dot)\x20?[\])}]\x20?[0-9]{1,3}+){3}",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}(?:[._/:‐-― ][0-9]{2,7}+){2,4}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+(])\(?[0-9]{2,5}+(?:\)?[\x20./‐-― -]{1,2}[0-9]{2,5}+){1,5}+(?![0-9A-Za-z])",
}
#: Words near a span, as features.
NEAR = {
    "near_phone": r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|téléphone|teléfono|ring)\b",
    "near_card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b",
    "near_mail": r"(?i)\b(?:mail|e-mail|email|contact|write|reach|kontakt|correo)\b",
    "near_host": r"(?i)\b(?:ip|host|server|address|login|client|peer)\b",
    "near_other": r"(?i)\b(?:order|version|isbn|id|no|nr|date|ref|page|since|until|price|total|build|chapter|section)\b",
}
FEATURES = (
    "kind", "digits", "groups", "longest", "shortest", "first", "luhn", "octets", "at_sign", "at_bracket", "dots", "dot_words", "last_label",
    "opens", "slashes", "left_joined", "right_joined", *NEAR,
)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, joined: Callable[[Column, Column], Column]) -> Column:
    """All entries before each (not negative) joined, 0 before the first, in two levels of square-root size, so that long arrays stay cheap."""
    def level(x: Column, part: Callable[[Column], Column]) -> Column:
        done = F.aggregate(x, F.struct(F.lit(0).alias("held"), F.expr("cast(array() as array<int>)").alias("all")), lambda a, v: F.struct(
            joined(a["held"], part(v)).alias("held"), F.concat(a["all"], F.array(a["held"])).alias("all")
        ))
        return done["all"]

    def run(x: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(x) / step).cast("int") - 1)), lambda i: F.slice(x, i * step + 1, step))
        total = lambda v: F.aggregate(v, F.lit(0), joined)
        return _bound(cut, lambda parts: F.flatten(F.zip_with(parts, level(parts, total), lambda part, start: F.transform(level(part, lambda v: v), lambda s: joined(s, start)))))

    return _bound(values, run)


def _starts(lengths: Column) -> Column:
    return _before(lengths, lambda a, b: a + b)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, left, right>> of all matches; places count code points, the end is exclusive."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)

    def placed(pieces: Column) -> Column:
        # Pieces: text before match i, match i, text after it.
        lengths = F.transform(pieces, lambda p: F.length(p["before"]) + F.length(p["value"]))
        return F.zip_with(pieces, _starts(lengths), lambda p, s: F.struct(
            (s + F.length(p["before"])).alias("start"), (s + F.length(p["before"]) + F.length(p["value"])).alias("end"),
            p["value"].alias("value"), F.right(p["before"], F.lit(24)).alias("left"), F.left(p["after"], F.lit(8)).alias("right"),
        ))

    def pieces(parts: Column) -> Column:
        n = F.size(parts) - 1
        return F.zip_with(F.arrays_zip(F.slice(parts, 1, n).alias("before"), found.alias("value")), F.slice(parts, 2, n), lambda p, after: F.struct(
            p["before"].alias("before"), p["value"].alias("value"), after.alias("after")
        ))

    return F.when(F.regexp_instr(text, F.lit(pattern)) > 0, _bound(_bound(between, pieces), placed)).otherwise(F.array().cast(_SPAN))


_SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Of at most 19 digits."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(19), F.length(digits))))
    doubled = F.transform(places, lambda i: F.substr(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _octets(value: Column) -> Column:
    """Four numbers of at most 255, leading zeros allowed."""
    parts = F.transform(F.filter(F.split(value, "[^0-9]+"), lambda x: x != ""), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    return (F.size(parts) == 4) & F.forall(parts, lambda x: (F.length(x) <= 3) & (F.left(x, F.lit(3)).cast("int") <= 255))


def base_spans(text: Column) -> Column:
    """array<struct<start, order, kind, end>> of all base spans, ascending."""
    text = F.coalesce(text, F.lit(""))
    size = lambda x: F.length(_digits(x["value"]))
    valid = {
        "email": lambda x: F.lit(True), "ip": lambda x: _octets(x["value"]),
        "card": lambda x: size(x).between(14, 19) & _luhn(_digits(x["value"])), "phone": lambda x: size(x).between(10, 15),
    }
    found = [F.transform(F.filter(_matches(text, BASE[k]), valid[k]), _named(k)) for k in KINDS]
    return F.array_sort(F.concat(*found))


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def features(kind: str | Column, value: Column, left: Column, right: Column) -> dict[str, Column]:
    digits = _digits(value)
    sizes = F.transform(F.filter(F.split(value, "[^0-9]+"), lambda x: x != ""), lambda x: F.length(x))
    lower = F.lower(value)
    of = {
        "kind": F.lit(KINDS.index(kind)) if isinstance(kind, str) else kind, "digits": F.length(digits), "groups": F.size(sizes),
        "longest": F.coalesce(F.array_max(sizes), F.lit(0)), "shortest": F.coalesce(F.array_min(sizes), F.lit(0)),
        "first": F.coalesce(F.element_at(F.concat(sizes, F.array(F.lit(0))), 1), F.lit(0)),
        "luhn": F.length(digits).between(13, 19) & _luhn(digits), "octets": _octets(value), "at_sign": F.instr(value, "@") > 0,
        "at_bracket": F.regexp_instr(lower, F.lit(r"[\[({] ?at ?[\])}]")) > 0, "dots": F.length(value) - F.length(F.replace(value, F.lit("."), F.lit(""))),
        "dot_words": F.size(F.split(lower, r"[\[({ ]dot[\])} ]")) - 1, "last_label": F.length(F.regexp_extract(lower, "([a-z]+)$", 1)),
        "opens": F.left(value, F.lit(1)) == "(", "slashes": F.regexp_instr(value, F.lit("[/:_]")) > 0,
        "left_joined": F.regexp_instr(left, F.lit(r"[A-Za-z0-9=\"'#$]$")) > 0, "right_joined": F.regexp_instr(right, F.lit("^[A-Za-z0-9%]")) > 0,
        **{k: F.regexp_instr(left, F.lit(p)) > 0 for k, p in NEAR.items()},
    }
    return {k: of[k].cast("double") for k in FEATURES}


def _examples(spark: SparkSession, rows: int) -> DataFrame:
    """kind, value, left, right, label: made from row numbers, all kinds of spans and look-alikes in equal parts."""
    d = lambda i, n: F.expr(f"lpad(cast(pmod(xxhash64(id, {i}), {10 ** n}) as string), {n}, '0')")
    pick = lambda i, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.expr(f"cast(pmod(xxhash64(id, {i}), {len(xs)}) + 1 as int)"))
    octet = lambda i: F.expr(f"cast(pmod(xxhash64(id, {i}), 256) as string)")
    user, host, top = F.concat(pick(1, "anna", "j.smith", "info", "max", "li", "otto77"), d(2, 2)), pick(3, "mail", "example", "post", "corp", "uni-x"), pick(4, "com", "org", "net", "de", "fr", "es")
    at, dot = pick(5, " at ", " (at) ", "[at]", " [at] ", "(at)", "{at}"), pick(6, " dot ", "[dot]", ".", " (dot) ", ".")
    body = F.concat(pick(7, "4", "5", "37", "6011"), d(8, 11))
    digit = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x.cast("string")), lambda x: _luhn(F.concat(body, x))), 1)
    card = F.rpad(F.concat(body, digit), 16, "0")
    four = lambda x, sign: F.concat_ws(sign, *[F.substr(x, F.lit(1 + 4 * i), F.lit(4)) for i in range(4)])
    sign = F.expr("element_at(array('.', '/', ':', '_'), cast(pmod(xxhash64(id, 9), 4) + 1 as int))")
    grouped = F.concat(F.substr(card, F.lit(1), F.lit(4)), sign, F.substr(card, F.lit(5), F.lit(4)), sign, F.substr(card, F.lit(9), F.lit(4)), sign, F.substr(card, F.lit(13), F.lit(4)))
    sep = pick(10, "-", ".", " ", "-")
    plain, call, pay, write, log, other = (
        pick(11, "the story of ", "and then ", "we saw ", "Ein Haus mit ", "la casa de ", "it was "), pick(12, "call me: ", "tel ", "phone: ", "my number is ", "fax ", "and then ", "reach "),
        pick(13, "card ", "visa: ", "credit card no ", "paid with ", "and then "), pick(14, "mail ", "write to ", "contact: ", "reach me ", "and then ", "it was "),
        pick(15, "host ", "login from ", "ip ", "server ", "and then "), pick(16, "order ", "version ", "ISBN ", "since ", "page ", "total ", "ref no "),
    )
    wrong = F.concat(body, F.expr("cast(pmod(xxhash64(id, 17), 10) as string)"))
    made = [
        ("email", F.concat(user, at, host, dot, top), write, 1), ("phone", F.concat(d(20, 3), sep, d(21, 3), sep, d(22, 4)), call, 1),
        ("phone", F.concat(F.lit("("), d(20, 3), F.lit(") "), d(21, 3), F.lit("-"), d(22, 4)), F.when(F.expr("id % 3 = 0"), plain).otherwise(call), 1),
        ("phone", F.concat(F.lit("00"), d(20, 2), F.lit(" "), d(21, 3), F.lit(" "), d(22, 4), F.lit(" "), d(23, 2)), call, 1),
        ("ip", F.concat_ws("[.]", *map(octet, (30, 31, 32, 33))), log, 1), ("ip", F.concat_ws(" dot ", *map(octet, (30, 31, 32, 33))), log, 1),
        ("card", grouped, pay, 1),
        ("email", F.concat(pick(40, "look", "meet", "sit", "stay", "arrive"), F.lit(" at "), pick(41, "the", "noon", "home", "a", "once"), F.lit("."), pick(42, "Then", "And", "The", "It", "Everyone")), plain, 0),
        ("email", F.concat(pick(40, "look", "meet", "sit"), F.lit(" at "), pick(41, "the", "a", "one"), F.lit(" dot "), pick(42, "plot", "matrix", "product")), plain, 0),
        ("phone", F.concat(F.lit("20"), d(50, 2), F.lit("-"), d(51, 2), F.lit("-"), d(52, 2)), other, 0),
        ("phone", F.concat(F.lit("19"), d(50, 2), F.lit("-"), F.lit("20"), d(51, 2)), plain, 0), ("phone", F.concat(d(50, 2), F.lit("."), d(51, 4)), plain, 0),
        ("phone", F.concat(d(50, 3), F.lit(" "), d(51, 3)), other, 0), ("phone", F.concat(d(50, 3), F.lit("-"), d(51, 5), F.lit("-"), d(52, 3), F.lit("-"), d(53, 2)), other, 0),
        ("ip", F.concat_ws("[.]", d(60, 3), *map(octet, (31, 32)), F.lit("999")), plain, 0),
        ("card", F.concat(F.lit("20"), d(70, 2), F.lit("/"), d(71, 2), F.lit("/"), d(72, 2)), plain, 0), ("card", F.concat(F.substr(wrong, F.lit(1), F.lit(4)), F.lit("."), F.substr(wrong, F.lit(5), F.lit(4)), F.lit("."), F.substr(wrong, F.lit(9), F.lit(3))), other, 0),
        ("card", F.concat(d(70, 4), F.lit(":"), d(71, 2), F.lit(":"), d(72, 2)), other, 0), ("card", F.concat(d(70, 4), F.lit("_"), d(71, 6), F.lit("_"), d(72, 4)), other, 0),
    ]
    several = F.explode(F.array(*[F.struct(F.lit(KINDS.index(k)).alias("kind"), v.alias("value"), c.alias("left"), F.lit(y).cast("double").alias("label")) for k, v, c, y in made]))
    return spark.range(-(-rows // len(made))).select("id", several.alias("x")).select("id", "x.*").withColumn("right", F.lit(" "))


class Selector:
    """Fitted trees as an expression, and the threshold of each kind."""

    def __init__(self, spark: SparkSession, train_rows: int, trees: int, precision: float) -> None:
        made = _examples(spark, train_rows)
        made = made.select("id", "kind", "label", *[v.alias(f"f_{k}") for k, v in features(F.col("kind"), F.col("value"), F.col("left"), F.col("right")).items()])
        made = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(made).repartition(2, "id").cache()
        fit, held = made.where("id % 2 = 0"), made.where("id % 2 = 1")
        model = GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.3, seed=7).fit(fit)
        self.trees = [(w, _parsed(t.toDebugString)) for w, t in zip(model.treeWeights, model.trees)]
        scored = model.transform(held).select("kind", "label", vector_to_array("probability")[1].alias("p"))
        # The lowest score above which held-out examples of the kind have the asked precision.
        order = Window.partitionBy("kind").orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        right = scored.withColumn("precision", F.avg("label").over(order)).where(f"precision >= {precision} AND label = 1").groupBy("kind").agg(F.min("p").alias("p"))
        least = {r.kind: r.p for r in right.collect()}
        self.thresholds = {k: max(0.5, least.get(i, 2.0)) for i, k in enumerate(KINDS)}
        made.unpersist()

    @staticmethod
    def of(spark: SparkSession, train_rows: int = 8000, trees: int = 12, precision: float = 0.99) -> Selector:
        return once(("personal data", train_rows, trees, precision), lambda: Selector(spark, train_rows, trees, precision))

    def score(self, of: dict[str, Column]) -> Column:
        margin = None
        for weight, tree in self.trees:
            part = F.lit(weight) * _expression(tree, of)
            margin = part if margin is None else margin + part
        return 1 / (1 + F.exp(-2 * margin))

    def _chosen(self, kind: str) -> Callable[[Column], Column]:
        return lambda x: self.score(features(kind, x["value"], x["left"], x["right"])) >= self.thresholds[kind]

    def spans(self, text: Column, base: Column) -> Column:
        """Selected spans besides the base ones, none overlapping a base span, ascending."""
        found = []
        for kind in KINDS:
            found.append(F.transform(F.filter(_matches(text, PROPOSED[kind]), self._chosen(kind)), _named(kind)))
        return F.filter(F.array_sort(F.concat(*found)), lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def _parsed(text: str):
    """A tree's printed form as nested (feature, bound, at most, above) or a value."""
    lines = iter([x.strip() for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)])

    def node(line: str):
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node(next(lines))
        next(lines)  # the Else line
        return int(feature), float(bound), low, node(next(lines))

    return node(next(lines))


def _expression(tree, of: dict[str, Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, bound, low, high = tree
    return F.when(of[FEATURES[feature]] <= bound, _expression(low, of)).otherwise(_expression(high, of))


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", train_rows: int = 8000, trees: int = 12, precision: float = 0.99) -> DataFrame:
    """key, base and spans (base and selected) per row: arrays of struct(start, order, kind, end), ascending.

    Null texts have none; null and repeated keys keep a row each; other columns play no part.
    """
    chosen = Selector.of(docs.sparkSession, train_rows, trees, precision)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    with_base = docs.select(F.col(key), content.alias("text"), base_spans(content).alias("base"))
    return with_base.select(F.col(key), "base", F.array_sort(F.concat("base", chosen.spans(F.col("text"), F.col("base")))).alias("spans"))


def digest(found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans; spans are written kind:start:end, comma-joined."""
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    is_kind = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(key, *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, text: str = "text", train_rows: int = 8000, trees: int = 12, precision: float = 0.99) -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in brackets; all rows and columns stay, null texts too.

    Of spans that overlap, the later start only removes what the earlier one left.
    """
    chosen = Selector.of(docs.sparkSession, train_rows, trees, precision)
    docs, name, back = apart(docs)
    content = F.col(name[text]).cast("string")
    rows = docs.withColumn("__base", base_spans(content))
    rows = rows.withColumn("__spans", F.array_sort(F.concat("__base", chosen.spans(F.coalesce(content, F.lit("")), F.col("__base")))))

    def rebuilt(spans: Column) -> Column:
        # Before span i stands the text from the furthest end so far; the last entry is the rest.
        return _bound(_before(F.concat(F.transform(spans, lambda s: s["end"]), F.array(F.lit(0))), lambda a, b: F.greatest(a, b)), lambda ends: joined(spans, ends))

    def joined(spans: Column, ends: Column) -> Column:
        parts = F.zip_with(spans, F.slice(ends, 1, F.size(spans)), lambda s, done: F.concat(
            F.substr(content, done + 1, F.greatest(F.lit(0), s["start"] - done)), F.when(s["start"] >= done, F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        ))
        return F.concat(F.array_join(parts, ""), F.substr(content, F.element_at(ends, -1) + 1, F.length(content)))

    cleaned = F.when(F.size("__spans") > 0, _bound(F.col("__spans"), rebuilt)).otherwise(F.col(name[text]))
    return rows.withColumn(name[text], cleaned).select(*back)
