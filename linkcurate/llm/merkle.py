"""A Merkle manifest of a data set, with a witness for every row.

Every group of rows (a source) is a tree whose nodes have up to `ARITY` children; the roots of the groups, in order, are the leaves
of one more tree. A tree is built by appending: leaves arrive in order, an open subtree keeps the nodes it has so far and the
partial witnesses of the leaves below them, and each completion of a run extends those witnesses by the siblings met there.

Appends are dealt in aligned blocks of ARITY ** height leaves. A block is appended to by one task; its root is a leaf of the
next level, where roots are appended in the same way, and its witness there continues the witness of every leaf of the block.
So no tree passes one task, however many rows one group has, and a group of many rows is as many blocks.

Digests are SHA-256. Node digests and witnesses are kept as 32 bytes each; a digest that enters another is written as lowercase hex.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkcurate.llm.common import stored

ARITY = 3
SIZE = 32
PATH = "lefts array<binary>, rights array<binary>"


def digest(*parts: Column) -> Column:
    """SHA-256 (32 bytes) of the parts, each as `-` if null, else the number of its UTF-8 bytes, `:` and the bytes."""
    framed = [F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in parts]
    return F.unhex(F.sha2(F.concat(*framed), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


class _Appender:
    """One block: leaves go in by `append`, `close` gives the block's root and each leaf's witness from its own level up."""

    def __init__(self) -> None:
        self.open: list[list[tuple[bytes, list[int]]]] = [[]]
        self.paths: list[tuple[list[bytes], list[bytes]]] = []

    def append(self, leaf: bytes) -> None:
        self.paths.append(([], []))
        self._add(0, leaf, [len(self.paths) - 1])

    def _add(self, level: int, node: bytes, below: list[int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, below))
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _ in run]
        for i, (_, below) in enumerate(run):
            left, right = b"".join(nodes[:i]), b"".join(nodes[i + 1 :])
            for leaf in below:
                self.paths[leaf][0].append(left)
                self.paths[leaf][1].append(right)
        self._add(level + 1, _parent(b"".join(nodes)), [leaf for _, below in run for leaf in below])

    def close(self, height: int) -> bytes:
        """Complete the open runs below `height`, at which one node is left."""
        for level in range(height):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        return self.open[height][0][0]


def _parent(nodes: bytes) -> bytes:
    return hashlib.sha256(nodes.hex().encode()).digest()


def _height(leaves: int) -> int:
    height = 0
    while ARITY**height < leaves:
        height += 1
    return height


def _ranked(rows: DataFrame, tree: str, order: list[Column], name: str) -> DataFrame:
    """`rows` with `at`, the number of the row in its tree by `order`, from 0; written once.

    Rows are range-sorted, so a large tree spans many tasks. A task numbers the rows of each of its trees; only its first tree can
    have begun in an earlier one, so one offset per task is all that is missing.
    """
    columns = rows.columns
    part = rows.repartitionByRange(F.col(tree), *order).sortWithinPartitions(F.col(tree), *order).withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, first = None, 0, True
        for batch in batches:
            nth, begun = [], []
            for key in batch.column(tree).to_pylist():
                if key != last:
                    first, n, last = last is None, 0, key
                nth.append(n)
                begun.append(first)
                n += 1
            yield pa.record_batch([*batch.columns, pa.array(nth, pa.int64()), pa.array(begun, pa.bool_())], [*batch.schema.names, "nth", "first"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema)
    sorted_rows = stored(part.mapInArrow(number, f"{schema}, nth long, first boolean"), name)
    # One row per task: its first tree, its last tree, and how many rows of the last it has.
    one = F.struct(F.col(tree).alias("t"), (F.col("nth") + 1).alias("n"))
    tasks = sorted_rows.groupBy("part").agg(F.min(tree).alias("low"), F.max(one).alias("high"))
    ends = Window.partitionBy("high.t").orderBy("part")
    reached = tasks.select("part", "low", F.col("high.t").alias("t"), F.sum("high.n").over(ends).alias("n"))
    # A tree that goes on from an earlier task is the last one of the task just before. One row per task meets in this window.
    reached = reached.withColumn("before", F.lag(F.struct("t", "n")).over(Window.orderBy("part")))
    offsets = reached.where("before.t = low").select("part", F.col("before.n").alias("offset"))
    # At most one row of two numbers per task.
    found = sorted_rows.join(F.broadcast(offsets), "part", "left")
    at = F.col("nth") + F.when(F.col("first"), F.coalesce("offset", F.lit(0))).otherwise(0)
    return found.select(*columns, at.alias("at"))


def _appended(nodes: DataFrame, height: int, name: str) -> DataFrame:
    """`nodes` (tree, at, digest and more) with block, lefts, rights (the witness up to the block's root) and root (in a block's first row)."""
    full = ARITY**height
    dealt = nodes.withColumn("block", F.expr(f"at div {full}")).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    names = dealt.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        done: list[tuple] = []
        waiting = 0
        block, last = _Appender(), None

        def finish() -> None:
            leaves = len(block.paths)
            root = block.close(height if last[1] else _height(leaves))
            done.extend((*path, None if i else root) for i, path in enumerate(block.paths))

        def ready(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal done, held, waiting
            while held and (len(done) >= len(held[0]) if not final else True):
                batch = held.pop(0)
                rows, done = done[: len(batch)], done[len(batch) :]
                waiting -= len(batch)
                new = [pa.array([r[i] for r in rows], pa.list_(pa.binary())) for i in (0, 1)] + [pa.array([r[2] for r in rows], pa.binary())]
                yield pa.record_batch([*batch.columns, *new], [*names, "lefts", "rights", "root"])

        for whole in batches:
            for i in range(0, len(whole), 2000):
                batch = whole.slice(i, 2000)
                held.append(batch)
                waiting += len(batch)
                for tree, number, node in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "digest"))):
                    if (tree, number) != last:
                        if last is not None:
                            finish()
                        block, last = _Appender(), (tree, number)
                    block.append(node)
                yield from ready(False)
        if last is not None:
            finish()
        yield from ready(True)

    return stored(dealt.mapInArrow(run, f"{schema}, {PATH}, root binary"), name)


def grow(rows: DataFrame, tree: str, order: list[Column], leaf: str, *, height: int = 5) -> DataFrame:
    """`rows` with `at` (the place in its tree by `order`), `root` of its tree and its witness `lefts`, `rights`.

    Per level from the leaf up, the witness holds the digests (32 bytes each) of the siblings to the left and to the right. `tree`
    must not be null and may hold any share of the rows; blocks of ARITY ** height rows are appended to by one task each.
    """
    carried = [x for x in rows.columns if x not in (tree, leaf)]
    packed = rows.select(F.col(tree).alias("tree"), F.col(leaf).alias("digest"), F.struct(F.lit(0).alias("_"), *carried).alias("row"), *[x.alias(f"o{i}") for i, x in enumerate(order)])
    ranked = _ranked(packed, "tree", [F.col(f"o{i}") for i in range(len(order))], "ranked").select("tree", "at", "digest", "row")
    levels = [_appended(ranked, height, "appended")]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        blocks = levels[-1].where("root IS NOT NULL").select("tree", F.col("block").alias("at"), F.col("root").alias("digest"))
        levels.append(_appended(blocks, height, "appended"))
    # Of the last level every tree is one block. Witnesses are continued downwards, block by block: a block is never a hot key.
    top = levels[-1].where("root IS NOT NULL").select("tree", "root")
    above = levels[-1].drop("root").join(top, "tree")
    for level in reversed(levels[:-1]):
        upper = above.select("tree", F.col("at").alias("block"), F.col("lefts").alias("l"), F.col("rights").alias("r"), "root")
        joined = level.drop("root").join(upper, ["tree", "block"])
        above = joined.withColumns({"lefts": F.concat("lefts", "l"), "rights": F.concat("rights", "r")}).drop("l", "r")
    return above.select(F.col("tree").alias(tree), F.col("digest").alias(leaf), *[F.col(f"row.{x}").alias(x) for x in carried], "at", "root", "lefts", "rights")


def folded(rows: DataFrame, leaf: str, name: str = "folded") -> DataFrame:
    """`rows` (with a witness in lefts and rights) with `name`, the root that the digests in column `leaf` give with their witness."""
    columns = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, lefts, rights in zip(*(batch.column(c).to_pylist() for c in (leaf, "lefts", "rights"))):
                for left, right in zip(lefts, rights):
                    node = _parent(left + node + right)
                out.append(node)
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], [*columns, name])

    return rows.mapInArrow(run, f"{schema}, `{name}` binary")


def manifest(leaves: DataFrame, *, key: str = "doc_id", group: str = "source", leaf: str = "leaf", height: int = 5) -> DataFrame:
    """`leaves` (key, group, leaf: 32 bytes, and more) with subroot, root and the whole witness of each row: lefts, rights.

    Leaves of a group ascend by key (null keys first); rows of one key by their digest, so equal rows may change places
    without any difference. Groups ascend bytewise, a null group first and apart from the empty one. A group of one leaf is that leaf;
    an empty table gives no row. Other columns are carried and take no part; one named like a result gives way to it.
    """
    named = [x for x in leaves.columns if x not in (key, group, leaf, "subroot", "root", "lefts", "rights")]
    tree = F.when(F.col(group).isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), F.encode(F.col(group).cast("string"), "UTF-8")))
    rows = leaves.select(
        tree.alias("__tree"), F.col(leaf).alias("__leaf"), F.col(key).alias("__key"), F.struct(F.lit(0).alias("_"), F.col(group).alias("__group"), *named).alias("__rest"),
        F.monotonically_increasing_id().alias("__at"),
    )
    rows = stored(rows, "leaves")
    grown = grow(rows, "__tree", [F.col("__key"), F.col("__leaf"), F.col("__at")], "__leaf", height=height)
    groups = grown.where("at = 0").select("__tree", F.col("root").alias("__sub"), F.unhex(F.lit("00")).alias("__one"))
    all_groups = grow(groups, "__one", [F.col("__tree")], "__sub", height=height)
    upper = all_groups.select("__tree", F.col("root").alias("__root"), F.col("lefts").alias("__l"), F.col("rights").alias("__r"))
    # A group may hold any share of the rows; its one row of `upper` meets them by (group, lot), so no lot is large.
    lots = grown.withColumn("__lot", F.expr(f"at div {4 * ARITY ** height}"))
    of_lot = lots.groupBy("__tree", "__lot").agg(F.lit(1).alias("_")).drop("_").join(upper, "__tree")
    joined = lots.join(of_lot, ["__tree", "__lot"])
    return joined.select(
        F.col("__key").alias(key), F.col("__rest.__group").alias(group), F.col("__leaf").alias(leaf), *[F.col(f"__rest.{x}").alias(x) for x in named],
        F.col("root").alias("subroot"), F.col("__root").alias("root"), F.concat("lefts", "__l").alias("lefts"), F.concat("rights", "__r").alias("rights"),
    )


def proof_digest() -> Column:
    """SHA-256 (hex) of a witness: its siblings as hex text, level by level, left to right."""
    levels = F.zip_with("lefts", "rights", lambda a, b: hexed(F.concat(a, b)))
    return F.sha2(F.array_join(levels, ""), 256)


def leaves_of(docs: DataFrame, text: Column) -> Column:
    """The leaf of a row of documents with `text` in place of its text."""
    return digest(*[F.col(x) for x in ("doc_id", "source", "lang", "n_chars")], text)


def checked(docs: DataFrame) -> DataFrame:
    """Manifest of `docs` (doc_id, source, lang, n_chars, text), each row verified after some rows were tampered with.

    Tampering deletes the line feeds of the text where 2 divides the crc32 of the decimal doc_id; null texts and rows of a null
    doc_id stay as they are. The tampered (else the original) leaf is folded with the original witness.
    """
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", leaves_of(docs, F.col("text")).alias("leaf"), leaves_of(docs, tampered).alias("met"))
    found = folded(manifest(leaves), "met", "folded")
    return found.select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        proof_digest().alias("proof_sha256"), hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


#: Levels are formed and folded by recursive queries; crc32 by its table.
SQL_TWIN = r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS t
), rows0 AS MATERIALIZED (
  SELECT doc_id, source,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS crc,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, replace(text, chr(10), '') AS bare
  FROM documents CROSS JOIN crc_table
), hashed AS MATERIALIZED (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(bare) || ':' || bare, '-'))
      ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS met
  FROM rows0
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM hashed
), nodes AS (
  SELECT tree, 0 AS lvl, place, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY tree, lvl, place // 3
), subroots AS MATERIALIZED (
  SELECT tree, lvl AS height, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, place, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY lvl, place // 3
), paths AS MATERIALIZED (
  SELECT tree, lvl, place, place // 3 AS run, h FROM nodes WHERE n > 1
  UNION ALL
  SELECT s.tree, s.height + t.lvl, t.place, t.place // 3, t.h FROM tops t JOIN subroots s ON t.place // 3 = s.place // pow(3, t.lvl + 1)::BIGINT WHERE t.n > 1
), steps AS MATERIALIZED (
  SELECT l.tree, l.place AS leaf_place, p.lvl,
    coalesce(string_agg(p.h, '' ORDER BY p.place) FILTER (p.place < CASE WHEN p.lvl < s.height THEN l.place // pow(3, p.lvl)::BIGINT ELSE s.place // pow(3, p.lvl - s.height)::BIGINT END), '') AS lefts,
    coalesce(string_agg(p.h, '' ORDER BY p.place) FILTER (p.place > CASE WHEN p.lvl < s.height THEN l.place // pow(3, p.lvl)::BIGINT ELSE s.place // pow(3, p.lvl - s.height)::BIGINT END), '') AS rights
  FROM leaves l JOIN subroots s USING (tree) JOIN paths p ON p.tree = l.tree
    AND p.run = CASE WHEN p.lvl < s.height THEN l.place // pow(3, p.lvl + 1)::BIGINT ELSE s.place // pow(3, p.lvl - s.height + 1)::BIGINT END
  GROUP BY l.tree, l.place, p.lvl
), folds AS (
  SELECT tree, place, 0 AS lvl, met AS h FROM leaves
  UNION ALL
  SELECT f.tree, f.place, f.lvl + 1, sha256(s.lefts || f.h || s.rights) FROM folds f JOIN steps s ON s.tree = f.tree AND s.leaf_place = f.place AND s.lvl = f.lvl
), last_fold AS (
  SELECT tree, place, max_by(h, lvl) AS folded_root FROM folds GROUP BY tree, place
), proofs AS (
  SELECT tree, leaf_place, sha256(string_agg(lefts || rights, '' ORDER BY lvl)) AS proof FROM steps GROUP BY tree, leaf_place
)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = r.h AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN last_fold f ON f.tree = l.tree AND f.place = l.place
LEFT JOIN proofs p ON p.tree = l.tree AND p.leaf_place = l.place CROSS JOIN (SELECT h FROM tops WHERE n = 1) r
"""
