"""Operator 11, Merkle manifest of a dataset: every document a leaf, a tree per language, their subroots a tree again.

The tree is built from runs of `fan_out` consecutive nodes, level by level, in blocks of `fan_out ** LEVELS` nodes: a
block is one group, so no group grows with the data, and each pass shrinks a level's nodes by the block's size. While a
parent's hash takes in its children one by one, it keeps a copy of the hash state before each child's slot. To fold a
leaf that may have changed, the copy before its slot is resumed with the replacement and the siblings to its right
only; what lies to the left is never hashed again. The states of levels above a block are resumed from copies that the
block's task makes once for all its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import materialise

#: Columns whose values make a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT = 8
#: Levels of one block: 512 leaves at a fan-out of 8.
LEVELS = 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hex sha256 over the fields, each `-` if null, else its UTF-8 byte count, a colon and the value."""

    def printed(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(printed, fields)), 256)


class Parent:
    """A node over at most `fan_out` children: its digest and copies of the hash state before each child's slot."""

    def __init__(self, children: Sequence[bytes]):
        self.children, self.states, state = children, [], hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child in the slot."""
        state = self.states[slot].copy()
        state.update(replacement)
        state.update(b"".join(self.children[slot + 1 :]))
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.children[:slot]) + b"".join(self.children[slot + 1 :])


def block_tree(nodes: list[bytes], levels: int, fan_out: int) -> list[list[Parent]]:
    """Parents of a block's nodes, level by level; the last level holds one parent, if there is a level."""
    tree = []
    for _ in range(levels):
        tree.append([Parent(nodes[i : i + fan_out]) for i in range(0, len(nodes), fan_out)])
        nodes = [p.digest for p in tree[-1]]
    return tree


def with_positions(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """The written table with `pos` (from 0, without gaps, among the rows of a key in the given order) and `n`, their number.

    Rows are dealt to tasks by ranges of (key, order, row), so that neither a frequent key nor rows equal in all of
    `order` meet in one task; only the counts of (task, key) go through a window, one row for each task of a key.
    """
    columns = df.columns
    ranges = df.withColumn("__row", F.monotonically_increasing_id())
    ranges = ranges.repartitionByRange(key, *order, "__row").sortWithinPartitions(key, *order, "__row").drop("__row")
    dealt = materialise(ranges.withColumns({"__at": F.monotonically_increasing_id(), "__part": F.spark_partition_id()}), name)
    counts = dealt.groupBy(key, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    by_key = Window.partitionBy(key)
    before = F.sum("__n").over(by_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(key, "__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(by_key).alias("n"))
    joined = dealt.join(counts, [key, "__part"])
    return joined.select(*columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("pos"), "n")


def levels_left(n: Column, fan_out: int, levels: int) -> Column:
    """Levels of the block above a key's n nodes: until one node is left, `levels` at most."""
    return sum((F.when(n > fan_out**k, 1).otherwise(0) for k in range(levels)), F.lit(0))


def tier_up(nodes: DataFrame, key: str, fan_out: int, levels: int) -> DataFrame:
    """(key, pos, n, node) of the blocks above nodes (key, pos, n, node)."""
    size = fan_out**levels

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        digests = [d.encode() for d in table["node"].to_pylist()]
        tree = block_tree(digests, table["levels"][0].as_py(), fan_out)
        root = tree[-1][0].digest if tree else digests[0]
        return pa.table({key: table[key][:1], "pos": table["block"][:1], "n": table["blocks"][:1], "node": pa.array([root.decode()])})

    blocks = nodes.select(
        key, "pos", "node", F.floor(F.col("pos") / size).alias("block"), F.ceil(F.col("n") / size).alias("blocks"), levels_left(F.col("n"), fan_out, levels).alias("levels")
    )
    return blocks.groupBy(key, "block").applyInArrow(build, f"{key} string, pos long, n long, node string")


PATH = "array<struct<left:string,right:string>>"


def with_path(nodes: DataFrame, above: DataFrame, key: str, fan_out: int, levels: int) -> DataFrame:
    """(key, pos, path, root) of nodes: what stands left and right of each on the way up, from its own level to the root.

    above: (key, pos, path, root) of the blocks over them.
    """
    size = fan_out**levels

    def descend(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        digests = [d.encode() for d in table["node"].to_pylist()]
        tree = block_tree(digests, table["levels"][0].as_py(), fan_out)
        rest = upper["path"][0].as_py()
        paths = []
        for i in range(len(digests)):
            path, at = [], i
            for parents in tree:
                children, slot = parents[at // fan_out].children, at % fan_out
                path.append({"left": b"".join(children[:slot]).decode(), "right": b"".join(children[slot + 1 :]).decode()})
                at //= fan_out
            paths.append(path + rest)
        out = {key: table[key], "pos": table["pos"], "path": pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))}
        return pa.table(out | {"root": pa.array([upper["root"][0].as_py()] * len(digests), pa.string())})

    own = nodes.select(key, "pos", "node", F.floor(F.col("pos") / size).alias("block"), levels_left(F.col("n"), fan_out, levels).alias("levels"))
    upper = above.withColumnRenamed("pos", "block")
    return own.groupBy(key, "block").cogroup(upper.groupBy(key, "block")).applyInArrow(descend, f"{key} string, pos long, path {PATH}, root string")


def tiers(nodes: DataFrame, key: str, fan_out: int, levels: int, name: str) -> list[DataFrame]:
    """Written node tables from `nodes` up to the one with a node for each key."""
    found, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        found.append(materialise(tier_up(found[-1], key, fan_out, levels), f"{name}-{len(found)}"))
        most = -(-most // fan_out**levels)
    return found


def fold_leaves(leaves: DataFrame, blocks: DataFrame, fan_out: int, levels: int) -> DataFrame:
    """Leaves with subroot, root, proof_sha256 and folded_root; blocks: (key, pos, path, root, subroot) of the blocks over them."""
    size = fan_out**levels
    kept = [f for f in leaves.schema.fields if f.name not in ("key", "pos", "n", "changed")]

    def fold(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        digests = [d.encode() for d in table["leaf"].to_pylist()]
        tree = block_tree(digests, table["levels"][0].as_py(), fan_out)
        path = [(s["left"].encode(), s["right"].encode()) for s in upper["path"][0].as_py()]
        resumed = [(hashlib.sha256(left), right) for left, right in path]  # the states before the slots of this block
        beyond = b"".join(left + right for left, right in path)
        around = [beyond]  # by node of the level in hand, from the top down: the siblings of all levels above it
        for parents in reversed(tree[1:]):
            around = [p.siblings(k) + rest for p, rest in zip(parents, around, strict=True) for k in range(len(p.children))]
        proofs, folded = [], []
        for i, value in enumerate(table["changed"].to_pylist()):
            node, at = value.encode(), i
            for parents in tree:
                node, at = parents[at // fan_out].fold(at % fan_out, node), at // fan_out
            for state, right in resumed:
                state = state.copy()
                state.update(node)
                state.update(right)
                node = state.hexdigest().encode()
            own = tree[0][i // fan_out].siblings(i % fan_out) + around[i // fan_out] if tree else beyond
            proofs.append(hashlib.sha256(own).hexdigest())
            folded.append(node.decode())
        out = {f.name: table[f.name] for f in kept}
        for name in ("subroot", "root"):
            out[name] = pa.array([upper[name][0].as_py()] * len(digests), pa.string())
        return pa.table(out | {"proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})

    dealt = leaves.withColumns({"block": F.floor(F.col("pos") / size), "levels": levels_left(F.col("n"), fan_out, levels)}).drop("n")
    upper = blocks.withColumnRenamed("pos", "block")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return (
        dealt.groupBy("key", "block")
        .cogroup(upper.groupBy("key", "block"))
        .applyInArrow(fold, f"{kind}, subroot string, root string, proof_sha256 string, folded_root string")
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


def merkle_manifest(docs: DataFrame, changed: Column | None = None, fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs.

    `changed`: the text to verify a row by, over docs' columns; the manifest is always of the text itself. A language's
    leaves are ordered by (doc_id, nulls first, leaf), languages bytewise with null first. Rows equal in all fields are
    leaves of their own. A lone leaf is its language's subroot, a lone subroot the root; where no siblings are, the proof
    is the digest of nothing. Columns besides the five fields are not read, whatever their names. An empty table has no rows.
    """
    text = F.col("text") if changed is None else changed
    fields = [F.col(c) for c in FIELDS]
    key = F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0"))  # orders null first and no language equals it
    leaves = docs.select("doc_id", "lang", key.alias("key"), leaf_digest(fields).alias("leaf"), leaf_digest([*fields[:-1], text]).alias("changed"))
    leaves = with_positions(leaves, "key", ["doc_id", "leaf"], "leaves")

    own = tiers(leaves.select("key", "pos", "n", F.col("leaf").alias("node")), "key", fan_out, levels, "nodes")
    subroots = own[-1].select(F.col("key").alias("lang_key"), F.col("node"), F.lit("all").alias("tree"))
    subroots = with_positions(subroots, "tree", ["lang_key", "node"], "subroots")
    top = tiers(subroots.select("tree", "pos", "n", "node"), "tree", fan_out, levels, "subroot-nodes")

    paths = top[-1].select("tree", "pos", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("node").alias("root"))
    for nodes in reversed(top[:-1]):
        paths = with_path(nodes, paths, "tree", fan_out, levels)
    placed = subroots.join(paths, ["tree", "pos"])
    paths = placed.select(F.col("lang_key").alias("key"), F.lit(0).cast("long").alias("pos"), "path", "root")
    for nodes in reversed(own[1:-1]):
        paths = with_path(nodes, paths, "key", fan_out, levels)
    of_key = placed.select(F.col("lang_key").alias("key"), F.col("node").alias("subroot"))
    blocks = materialise(paths.join(of_key, "key"), "paths")
    return fold_leaves(leaves, blocks, fan_out, levels)


def _crc_divides(text: str, n: int) -> str:
    """DuckDB condition: the crc32 of a short ASCII text is divisible by n. Each byte is taken in, then shifted out bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)] || [-1, -1, -1, -1, -1, -1, -1, -1]))"
    state = "CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END"
    return f"xor(list_reduce([4294967295::BIGINT] || {steps}::BIGINT[], lambda s, x: {state}), 4294967295::BIGINT) % {n} = 0"


def oracle_sql(levels: int = 8) -> str:
    """DuckDB SQL: the tree level by level (a level that has one node keeps it), then each leaf's way up beside its siblings."""

    def printed(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def digest(text: str) -> str:
        return f"sha256({' || '.join(printed(c) for c in FIELDS[:-1])} || {printed(text)})"

    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    sql = [
        f"""marked AS (SELECT doc_id, lang, {digest("text")} AS leaf,
  {digest(f"CASE WHEN {_crc_divides('doc_id::VARCHAR', 3)} THEN {lowered} ELSE text END")} AS changed FROM documents)""",
        """leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS pos FROM marked)""",
        """a0 AS (SELECT lang AS k, pos, leaf AS node FROM leaves)""",
        """f0 AS (SELECT doc_id, lang AS k, leaf, pos, pos AS slot, changed AS node, '' AS proof FROM leaves)""",
    ]

    def climb(a: str, f: str, depth: int) -> None:
        for i in range(depth):
            run = f"(SELECT k, pos // {FAN_OUT} AS pos, list(node ORDER BY pos) AS nodes, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM {a}{i}) GROUP BY k, pos // {FAN_OUT})"
            sql.append(f"""{a}{i + 1} AS (SELECT k, pos, CASE WHEN n > 1 THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS node FROM {run})""")
            sql.append(f"""{f}{i + 1} AS (SELECT t.* EXCLUDE (slot, node, proof), t.slot // {FAN_OUT} AS slot,
  CASE WHEN r.n > 1 THEN sha256(array_to_string(r.nodes[1:t.slot % {FAN_OUT}] || [t.node] || r.nodes[t.slot % {FAN_OUT} + 2:], '')) ELSE t.node END AS node,
  CASE WHEN r.n > 1 THEN t.proof || array_to_string(r.nodes[1:t.slot % {FAN_OUT}] || r.nodes[t.slot % {FAN_OUT} + 2:], '') ELSE t.proof END AS proof
  FROM {f}{i} t JOIN {run} r ON r.k IS NOT DISTINCT FROM t.k AND r.pos = t.slot // {FAN_OUT})""")

    climb("a", "f", levels)
    sql.append(f"langs AS (SELECT k AS lang, node AS subroot, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS pos FROM a{levels})")
    sql.append("b0 AS (SELECT 0 AS k, pos, subroot AS node FROM langs)")
    sql.append(f"g0 AS (SELECT t.doc_id, t.leaf, l.subroot, 0 AS k, l.pos AS slot, t.node, t.proof FROM f{levels} t JOIN langs l ON l.lang IS NOT DISTINCT FROM t.k)")
    climb("b", "g", 3)
    return (
        "WITH " + ",\n".join(sql) + """
SELECT doc_id, leaf, subroot, b3.node AS root, sha256(proof) AS proof_sha256, g3.node AS folded_root, g3.node = b3.node AS verified FROM g3, b3"""
    )
