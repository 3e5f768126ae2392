"""Merkle manifest of a dataset by an exchange of subtrees.

Every row is a leaf; leaves of a source form a tree, and the sources' roots form one more.
A superblock is a run of leaves under one node some levels up. First each superblock is
reduced to that node; the tree above, far smaller, is proved the same way, superblock by
superblock. Then leaves are cogrouped with the outer nodes that their superblock's proofs
need, and one function finishes the local reduction, joins the proofs and folds them. No
task sees more than a superblock and one path to the root.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.stage import staged
from .common import documents, rank_in_group, with_row_id

#: Nodes that form the next node.
FAN = 3
#: Levels inside a superblock: 3**9 leaves at most.
LEVELS = 9
#: What a leaf holds, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Stands for the node itself among its siblings; no digest holds it.
OWN = "*"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def framed(value: Column) -> Column:
    """``-`` for a missing value, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


# ---- inside a superblock -------------------------------------------------------------

def reduced(nodes: list[str], alone: bool, fan: int, levels: int) -> list[list[str]]:
    """The levels over some neighbouring nodes, themselves first. A group's first superblock
    (``alone``) ends where one node is left; a later one goes up all levels, as the group
    has other nodes on each."""
    out = [nodes]
    for _ in range(levels):
        now = out[-1]
        if alone and len(now) == 1:
            break
        out.append([digest(*now[i:i + fan]) for i in range(0, len(now), fan)])
    return out


def path_of(tree: list[list[str]], at: int, fan: int) -> list[str]:
    """Per level the run that a node is in, with OWN in its place."""
    out = []
    for level in tree[:-1]:
        first = at // fan * fan
        run = level[first:first + fan]
        run[at - first] = OWN
        out.append("".join(run))
        at //= fan
    return out


def fold(node: str, path: list[str]) -> str:
    for run in path:
        node = digest(run.replace(OWN, node))
    return node


def siblings(path: list[str]) -> str:
    return "".join(path).replace(OWN, "")


def _ordered(block: pa.Table) -> pa.Table:
    return block.sort_by("pos")


def tops(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """(grp, pos, node) of the superblocks' nodes, from (grp, block, pos, node)."""

    def top(block: pa.Table) -> pa.Table:
        block = _ordered(block)
        first = block["block"][0].as_py()
        tree = reduced(block["node"].to_pylist(), first == 0, fan, levels)
        return pa.table({"grp": block["grp"][:1], "pos": pa.array([first], pa.int64()), "node": tree[-1]})

    return nodes.select("grp", "block", "pos", "node").groupBy("grp", "block").applyInArrow(
        top, "grp string, pos bigint, node string")


# ---- the tree above ------------------------------------------------------------------

def in_blocks(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(fan**levels)).cast("bigint"))


def outer(blocks: DataFrame, fan: int, levels: int) -> DataFrame:
    """(grp, pos, path, top) for nodes (grp, pos, node), positions without gaps: the path from
    a node to the root of its group, and that root. Staged."""
    if not blocks.where(F.col("pos") > 0).limit(1).count():
        nothing = F.array().cast("array<string>")
        return blocks.select("grp", "pos", nothing.alias("path"), F.col("node").alias("top"))
    nodes = in_blocks(blocks, fan, levels)
    above = outer(staged(tops(nodes, fan, levels)), fan, levels).withColumnRenamed("pos", "block")

    def paths(block: pa.Table, over: pa.Table) -> pa.Table:
        block = _ordered(block)
        rest, root = over["path"][0].as_py(), over["top"][0].as_py()
        tree = reduced(block["node"].to_pylist(), block["block"][0].as_py() == 0, fan, levels)
        found = [path_of(tree, i, fan) + rest for i in range(block.num_rows)]
        return pa.table({
            "grp": block["grp"], "pos": block["pos"], "path": pa.array(found, pa.list_(pa.string())),
            "top": pa.array([root] * block.num_rows, pa.string())})

    return staged(nodes.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(
        paths, "grp string, pos bigint, path array<string>, top string"))


def over_sources(upper: DataFrame, fan: int, levels: int) -> DataFrame:
    """Continues paths that end at a source's root up to the root of all sources:
    (grp, block, path, subroot, root). Sources stand in byte order of their group key."""
    subroots = upper.where(F.col("pos") == 0).select("grp", F.col("top").alias("node"))
    ordered = with_row_id(subroots.repartitionByRange("grp").sortWithinPartitions("grp"))
    one = F.lit("").alias("_all")
    ranked = rank_in_group(ordered.select("grp", "node", "_rid", one), ["_all"], "pos")
    ranked = staged(ranked.select("grp", "node", "pos"))
    above = outer(ranked.select(F.lit("").alias("grp"), "pos", "node"), fan, levels)
    sources = ranked.select("grp", "pos").join(above.drop("grp"), "pos").select(
        "grp", F.col("path").alias("_rest"), F.col("top").alias("root"))
    return upper.join(staged(sources), "grp").select(
        "grp", F.col("pos").alias("block"), F.concat("path", "_rest").alias("path"),
        F.col("top").alias("subroot"), "root")


# ---- the manifest --------------------------------------------------------------------

def numbered(rows: DataFrame) -> DataFrame:
    """Places of leaves in their group, by ``ord`` (missing first), then digest. Equal leaves
    are spread by where they were read, so that many of them do not meet in one task."""
    order = ["grp", "ord", "leaf", "_spread"]
    rows = rows.withColumn("_spread", F.monotonically_increasing_id())
    ordered = with_row_id(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_spread"))
    return rank_in_group(ordered, ["grp"], "pos").drop("_rid")


def manifest(docs: DataFrame, shown: Callable[[list[Column]], Column] | None = None,
             fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id",
             paths: bool = True, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """A row per document: key, leaf, subroot, root, proof_sha256, folded_root, verified, and
    with ``paths`` the proof itself.

    A leaf is the sha256 of the ``fields``, each ``-`` if missing, else its byte count, a
    colon and the value. Leaves of a group ascend by key, missing keys first, repeated keys
    by digest; every ``fan`` neighbours become a node until one is left, a lone leaf being
    its own root. The groups' roots, a missing group first, then by bytes, form the root in
    the same way. The proof lists the other nodes of each run from the leaf to the root
    with ``*`` in the node's own place; its digest leaves the stars out.

    ``shown`` gives, from the fields, the leaf that someone presents now (the original
    one where it is null or not given); that leaf is folded with the original proof, and is
    verified if it gives the root. Equal rows are leaves each. Other columns take no part.
    An empty table gives an empty table.
    """
    cols = [F.col(c) for c in fields]
    grp = F.coalesce(F.concat(F.lit("s"), F.col(group)), F.lit(""))
    now = F.lit(None).cast("string") if shown is None else shown(cols)
    rows = docs.select(grp.alias("grp"), F.col(key).cast("bigint").alias("ord"),
                       leaf(cols).alias("leaf"), now.alias("shown"))
    placed = staged(in_blocks(numbered(rows), fan, levels).withColumnRenamed("leaf", "node"))
    upper = outer(staged(tops(placed, fan, levels)), fan, levels)
    needed = over_sources(upper, fan, levels)

    def finish(block: pa.Table, over: pa.Table) -> pa.Table:
        block = _ordered(block)
        leaves, presented = block["node"].to_pylist(), block["shown"].to_pylist()
        rest, subroot, root = (over[c][0].as_py() for c in ("path", "subroot", "root"))
        tree = reduced(leaves, block["block"][0].as_py() == 0, fan, levels)
        proofs, folded, found = [], [], []
        for i, (own, other) in enumerate(zip(leaves, presented)):
            path = path_of(tree, i, fan) + rest
            proofs.append(digest(siblings(path)))
            folded.append(fold(own if other is None else other, path))
            if paths:
                found.append(path)
        n = block.num_rows
        text = lambda xs: pa.array(xs, pa.string())
        out = {key: block["ord"], "leaf": text(leaves), "subroot": text([subroot] * n), "root": text([root] * n),
               "proof_sha256": text(proofs), "folded_root": text(folded),
               "verified": pa.array([f == root for f in folded], pa.bool_())}
        if paths:
            out["proof"] = pa.array(found, pa.list_(pa.string()))
        return pa.table(out)

    schema = (f"`{key}` bigint, leaf string, subroot string, root string, proof_sha256 string, "
              "folded_root string, verified boolean" + (", proof array<string>" if paths else ""))
    return placed.groupBy("grp", "block").cogroup(needed.groupBy("grp", "block")).applyInArrow(finish, schema)


def without_line_ends(fields: list[Column]) -> Column:
    """The leaf of a document whose text lost its line ends, where 2 divides the crc32 of
    its id; null where nothing was changed, as for a missing id."""
    doc_id, text = fields[0], fields[-1]
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(hit, leaf([*fields[:-1], F.replace(text, F.lit("\n"), F.lit(""))]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir), without_line_ends, paths=False)


_BITS = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {0})"
_PART = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(
    _PART.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{0}")) + ")"
SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('s' || source, '') AS grp, {_LEAF.format('text')} AS leaf,
         CASE WHEN xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                   lambda c, x: {_BITS.format('xor(c, x)')}, 4294967295), 4294967295) % 2 = 0
              THEN {_LEAF.format("replace(text, chr(10), '')")} END AS shown
  FROM documents),
numbered AS (
  SELECT *, row_number() OVER () AS id,
         row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY grp) AS n FROM leaves),
nodes AS (
  SELECT grp, 0 AS lvl, pos, leaf AS h, n FROM numbered
  UNION ALL
  SELECT grp, lvl + 1, pos // {FAN}, sha256(string_agg(h, '' ORDER BY pos)), (n + {FAN - 1}) // {FAN}
  FROM nodes WHERE n > 1 GROUP BY grp, lvl, pos // {FAN}, n),
subroots AS (
  SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS lvl, pos, h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // {FAN}, sha256(string_agg(h, '' ORDER BY pos)), (n + {FAN - 1}) // {FAN}
  FROM upper_nodes WHERE n > 1 GROUP BY lvl, pos // {FAN}, n),
runs AS (
  SELECT grp, lvl, pos // {FAN} AS run, list(h ORDER BY pos) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT lvl, pos // {FAN} AS run, list(h ORDER BY pos) AS hs FROM upper_nodes WHERE n > 1 GROUP BY ALL),
climb AS (
  SELECT id, grp, 0 AS lvl, pos, coalesce(shown, leaf) AS f, '' AS proof FROM numbered
  UNION ALL
  SELECT c.id, c.grp, c.lvl + 1, c.pos // {FAN},
         sha256(array_to_string(list_concat(list_concat(hs[1:c.pos % {FAN}], [f]), hs[c.pos % {FAN} + 2:]), '')),
         proof || array_to_string(list_concat(hs[1:c.pos % {FAN}], hs[c.pos % {FAN} + 2:]), '')
  FROM climb c JOIN runs r ON r.grp = c.grp AND r.lvl = c.lvl AND r.run = c.pos // {FAN}),
arrived AS (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1),
upper_climb AS (
  SELECT a.id, 0 AS lvl, s.pos, a.f, a.proof FROM arrived a JOIN subroots s ON s.grp = a.grp
  UNION ALL
  SELECT c.id, c.lvl + 1, c.pos // {FAN},
         sha256(array_to_string(list_concat(list_concat(hs[1:c.pos % {FAN}], [f]), hs[c.pos % {FAN} + 2:]), '')),
         proof || array_to_string(list_concat(hs[1:c.pos % {FAN}], hs[c.pos % {FAN} + 2:]), '')
  FROM upper_climb c JOIN upper_runs r ON r.lvl = c.lvl AND r.run = c.pos // {FAN}),
done AS (SELECT * FROM upper_climb QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1)
SELECT n.doc_id, n.leaf, s.h AS subroot, t.h AS root, sha256(d.proof) AS proof_sha256, d.f AS folded_root,
       d.f = t.h AS verified
FROM numbered n JOIN done d ON d.id = n.id JOIN subroots s ON s.grp = n.grp
JOIN (SELECT h FROM upper_nodes WHERE n = 1) t ON true
"""
