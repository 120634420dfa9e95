"""A manifest of a data set as Merkle trees, with a proof for every document.

Every row is a leaf; the leaves of a language, in order of doc_id, make a tree, and the roots of these
trees make the last one. Leaves are not sorted to find their places. A language's ids are a
bitmap of 64-bit words, of which only those that are not empty exist; each task makes its own words, and
they are merged by OR. A directory counts the bits before each block of words and before each
word. The place of an id is what the directory says plus the bits below its own.

Trees are reduced by slots: ``SLOTS`` neighbours of a level meet in one group, an array in which a
node's place is its key, and leave as one node ten levels further up, until each tree has one. Then
the groups are gone through from the root down: each hands its nodes the siblings from there to the root,
and the last ones hand every document its proof. A group has at most ``SLOTS`` rows, however large a language is.

Words in which an id repeats can't tell its rows apart; the rows of these words alone are put in order by
id and leaf, in sampled ranges. Repeated rows are leaves of their own, equal ones in any order. Rows
with a null id come first in their language; a null language is a tree of its own, before the empty string. Null values
are ``-`` in the leaf. An empty table has no rows. Texts of any length are hashed where they are read; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm.common import workspace, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 10
#: Neighbours that one group reduces.
SLOTS = 1 << LEVELS
#: Bits of an id below the number of its word, and of that number below the number of its block.
WORD_BITS, BLOCK_BITS = 6, 12
#: Rows without an id lie in a word before all others.
NO_WORD = -(1 << 60)


# --- leaves ---------------------------------------------------------------------------


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def _leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*(_field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``tree``, ``doc_id``, ``leaf`` and ``shown`` of every row.

    ``shown`` is the leaf, or where ``tampered`` holds that of the row with one more in ``n_chars``.
    """
    lang = F.col("lang").cast("string")
    tree = F.when(lang.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), lang))
    more = _leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)
    shown = F.lit(None).cast("string") if tampered is None else F.when(tampered, more)
    rows = docs.select(tree.alias("tree"), "doc_id", _leaf().alias("leaf"), shown.alias("shown"))
    return rows.withColumn("shown", F.coalesce("shown", "leaf"))


# --- places ---------------------------------------------------------------------------


def totals_before(df: DataFrame, group: str, order: list[str], value: str, folder: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of its ``group`` that come earlier.

    Rows are dealt to sampled ranges, whose totals are a small table; no group has to fit one task.
    """
    ranged = df.repartitionByRange(group, *order).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, folder)
    sums = ranged.groupBy(group, "range").agg(F.sum(value).alias("total"))
    earlier = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(group, "range", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("begin"))
    within = Window.partitionBy(group, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(begins, [group, "range"])
        .withColumn("before", (F.col("begin") + F.col("inside")).cast("long"))
        .drop("range", "begin", "inside")
    )


def with_word(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of its id's ``word`` and the id's ``bit`` in it."""
    number = F.col("doc_id").cast("long")
    return rows.withColumns(
        {
            "word": F.coalesce(F.shiftright(number, WORD_BITS), F.lit(NO_WORD)),
            "bit": number.bitwiseAND((1 << WORD_BITS) - 1).cast("int"),
        }
    )


def bitmaps(rows: DataFrame, folder: str) -> DataFrame:
    """Each tree's words of ids: ``bits``, ``rows`` with these ids and ``before`` them, ``nodes`` of the tree."""
    words = rows.groupBy("tree", "word").agg(
        F.expr("coalesce(bit_or(shiftleft(1L, bit)), 0L)").alias("bits"), F.count(F.lit(1)).alias("rows")
    )
    words = written(words.withColumn("block", F.shiftright("word", BLOCK_BITS)), f"{folder}/words")
    blocks = written(words.groupBy("tree", "block").agg(F.sum("rows").alias("rows")), f"{folder}/blocks")
    trees = written(blocks.groupBy("tree").agg(F.sum("rows").alias("nodes")), f"{folder}/trees")
    directory = totals_before(blocks, "tree", ["block"], "rows", f"{folder}/ranges").select(
        "tree", "block", F.col("before").alias("begin")
    )
    within = Window.partitionBy("tree", "block").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        words.withColumn("inside", F.coalesce(F.sum("rows").over(within), F.lit(0)))
        .join(directory.join(trees, "tree"), ["tree", "block"])
        .select("tree", "word", "bits", "rows", (F.col("begin") + F.col("inside")).alias("before"), "nodes")
    )
    return written(counted, f"{folder}/directory")


def places(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` (tree, doc_id, leaf and more, fixed) with ``place``, from 0 within its tree, and its ``nodes``."""
    located = with_word(rows)
    words = bitmaps(located, f"{folder}/bitmaps")
    found = located.join(words, ["tree", "word"])
    one_row_each = F.col("rows") == F.bit_count("bits")
    kept = [*rows.columns, "place", "nodes"]
    ranked = found.where(one_row_each).withColumn(
        "place", F.expr("before + bit_count(bits & ~shiftleft(-1L, bit))")
    )
    repeated = words.where(~one_row_each)
    if repeated.isEmpty():
        return ranked.select(*kept)
    # The salt only spreads rows that are equal.
    several = (
        found.where(~one_row_each)
        .withColumnRenamed("before", "start")
        .withColumns({"one": F.lit(1), "salt": F.rand(1)})
    )
    in_order = totals_before(
        several, "tree", ["word", "doc_id", "leaf", "salt"], "one", f"{folder}/repeated"
    ).withColumnRenamed("before", "nth")
    skipped = totals_before(
        repeated.select("tree", "word", "rows"), "tree", ["word"], "rows", f"{folder}/skipped"
    ).select("tree", "word", "before")
    numbered = in_order.join(skipped, ["tree", "word"]).withColumn(
        "place", F.col("start") + F.col("nth") - F.col("before")
    )
    return ranked.select(*kept).unionByName(numbered.select(*kept))


# --- trees ----------------------------------------------------------------------------

NODES = "tree string, place bigint, digest string, nodes bigint"
PATHS = "tree string, place bigint, path array<string>, subroot string, root string"


def joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def climbed(slots: list[str], nodes: int) -> list[list[str]]:
    """The nodes of each level of a group, from its ``slots`` up; a lone one is hashed alone.

    ``nodes`` are those of the whole level: a small group of a large level climbs as far as the others.
    """
    levels = [slots]
    for _ in range(min(LEVELS, (nodes - 1).bit_length())):
        below = levels[-1]
        levels.append([joined(below[k : k + 2]) for k in range(0, len(below), 2)])
    return levels


def _levels(rows: pa.Table) -> list[list[str]]:
    slots = [""] * len(rows)
    for place, digest in zip(rows.column("place").to_pylist(), rows.column("digest").to_pylist()):
        slots[place % SLOTS] = digest
    return climbed(slots, rows.column("nodes")[0].as_py())


def _reduce(key: tuple, rows: pa.Table) -> pa.Table:
    nodes = rows.column("nodes")[0].as_py()
    return pa.table(
        {
            "tree": pa.array([key[0].as_py()], pa.string()),
            "place": pa.array([key[1].as_py()], pa.int64()),
            "digest": pa.array(_levels(rows)[-1], pa.string()),
            "nodes": pa.array([-(-nodes // SLOTS)], pa.int64()),
        }
    )


def _group() -> Column:
    return F.shiftright("place", LEVELS).alias("group")


def reduced(nodes: DataFrame, folder: str) -> list[DataFrame]:
    """``nodes`` (written) and the nodes ``LEVELS`` further up each time, until every tree has one."""
    levels = [nodes]
    while not levels[-1].where("nodes > 1").isEmpty():
        up = levels[-1].select("tree", "place", "digest", "nodes").groupBy("tree", _group()).applyInArrow(_reduce, NODES)
        levels.append(written(up, f"{folder}-{len(levels)}"))
    return levels


def _hand_down(keep: list[str]) -> Callable:
    """A function of a group's nodes and its own path: theirs, siblings from the lowest up.

    A left sibling is written after ``<``, a right one after ``>``, and none as ``|``.
    """

    def run(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        columns = {c: rows.column(c) for c in keep}
        paths: list[list[str]] = []
        if len(rows):
            levels, rest = _levels(rows)[:-1], above.column("path")[0].as_py()
            for place in rows.column("place").to_pylist():
                at, own = place % SLOTS, []
                for level in levels:
                    other = at ^ 1
                    own.append("|" if other >= len(level) else "<>"[other > at] + level[other])
                    at >>= 1
                paths.append(own + rest)
        columns["path"] = pa.array(paths, pa.list_(pa.string()))
        for c in ("subroot", "root"):
            value = above.column(c)[0].as_py() if len(rows) else None
            columns[c] = pa.array([value] * len(rows), pa.string())
        return pa.table(columns)

    return run


def handed_down(nodes: DataFrame, above: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``nodes`` with ``path``, ``subroot`` and ``root``, from the paths one step above."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), PATHS[PATHS.index("path") :]])
    own = nodes.select(*dict.fromkeys(["tree", "place", "digest", "nodes", *keep]))
    parent = above.withColumn("group", F.col("place"))
    return (
        own.groupBy("tree", _group())
        .cogroup(parent.groupBy("tree", "group"))
        .applyInArrow(_hand_down(keep), schema)
    )


def _paths(levels: list[DataFrame], top: DataFrame, folder: str) -> DataFrame:
    """Paths of the nodes on the second lowest level, from those on the highest."""
    for k in range(len(levels) - 2, 0, -1):
        top = written(handed_down(levels[k], top, ["tree", "place"]), f"{folder}-{k}")
    return top


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id``, ``leaf``, ``shown`` (see :func:`leaves`), ``subroot``, ``root`` and ``path`` of every row.

    ``path`` has the siblings from the leaf to the root; :func:`folded` and :func:`siblings` read it.
    """
    folder = workspace(docs.sparkSession, "merkle")
    rows = written(leaves(docs, tampered), f"{folder}/leaves")
    nodes = written(places(rows, folder).withColumnRenamed("leaf", "digest"), f"{folder}/nodes")
    levels = reduced(nodes, f"{folder}/level")
    # The trees' roots, numbered in order of the languages, are the leaves of one more tree.
    subroots = levels[-1].select("tree", "digest").withColumns({"name": F.lit(""), "one": F.lit(1)})
    numbered = totals_before(subroots, "name", ["tree"], "one", f"{folder}/subroot-ranges")
    forest = numbered.select(
        F.col("name").alias("tree"),
        F.col("before").alias("place"),
        "digest",
        subroots.agg(F.count(F.lit(1))).scalar().alias("nodes"),
        F.col("tree").alias("language"),
    )
    forest = written(forest, f"{folder}/forest")
    upper = reduced(forest, f"{folder}/upper")
    root = upper[-1].select(
        "tree", "place", F.expr("array() :: array<string>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root")
    )
    if len(upper) > 1:
        above = _paths(upper, root, f"{folder}/upper-path")
        own = handed_down(upper[0], above, ["language", "digest"])
    else:
        own = forest.select(
            "language", "digest", F.expr("array() :: array<string>").alias("path"), F.col("digest").alias("root")
        )
    top = own.select(
        F.col("language").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"), "root"
    )
    top = written(top, f"{folder}/subroots")
    kept = ["doc_id", "digest", "shown"]
    if len(levels) > 1:
        proofs = handed_down(levels[0], _paths(levels, top, f"{folder}/path"), kept)
    else:
        proofs = nodes.select("tree", *kept).join(top.drop("place"), "tree")
    return proofs.select("doc_id", F.col("digest").alias("leaf"), "shown", "subroot", "root", "path")


def siblings(path: Column) -> Column:
    """The digests in a path, one after the other."""
    return F.concat_ws("", F.transform(path, lambda s: F.substring(s, 2, 64)))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def up(digest: Column, step: Column) -> Column:
        other = F.substring(step, 2, 64)
        left, right = F.concat(other, digest), F.concat(digest, other)
        return F.sha2(F.when(step.startswith("<"), left).otherwise(right), 256)

    return F.aggregate(path, leaf, up)
