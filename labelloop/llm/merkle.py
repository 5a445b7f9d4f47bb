"""Merkle manifest of a table, with a version for each presented row (operator 12).

Each row is a leaf: the SHA-256 of its fields. Leaves of one group (a language) ascend by id; two
neighbours become the hash of their digests in hex, a last one alone the hash of its own, until one
is left, the subroot. Subroots, by group, become the root the same way.

A tree is cut into aligned blocks of 1,024 nodes. Going up, a block becomes one node of the next
level, so a level of blocks is one shuffle and there are log_1024(rows) of them. Going down, each
block gets the siblings above it, which all of its leaves share. A leaf block then is a persistent
tree: the row that is presented for a leaf makes a version that copies the ancestors within the
block and shares all other nodes, and goes on above the block with the siblings from there. No task
holds more than a block and its few dozen siblings, whatever the size of a group; all steps are
written to the shared scratch folder.

Nulls: a null field is hashed as ``-``; a null id comes first in its group, a null group before all
others. Rows with one id are leaves each, ordered by their digest; repeated rows are equal leaves
side by side. An empty table has no rows and no root.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloop.llm.common import sql_crc32, stored
from labelloop.llm.components import SALT
from labelloop.session import ship_package
from labelloop.sources.tables import numbered

HEIGHT = 10
_NODES = "tree string, at long, digest binary, n long"
_PATHS = "tree string, at long, path binary, top binary"
_ROWS = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, n_copied int, proof array<string>"


def field(col: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    value = col.cast("string")
    return F.when(col.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def joined(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


class Version:
    """A node and what is below it: (digest, left, right), never changed; leaves have neither."""

    @staticmethod
    def of(digests: list[str], levels: int):
        """The tree over the digests, ``levels`` high."""
        row = [(d, None, None) for d in digests]
        for _ in range(levels):
            row = [(joined(a[0], b[0]), a, b) if b else (joined(a[0]), a, None) for a, b in zip(row[::2], [*row[1::2], None], strict=False)]
        return row[0]

    @staticmethod
    def siblings(root, levels: int, at: int) -> list[tuple[str, str]]:
        """From leaf ``at`` upwards, the side of the sibling (``L``, ``R``, or ``-`` and none)."""
        found, node = [], root
        for level in reversed(range(levels)):
            _, left, right = node
            if at >> level & 1:
                found.append(("L", left[0]))
                node = right
            else:
                found.append(("R", right[0]) if right else ("-", ""))
                node = left
        return found[::-1]

    @staticmethod
    def changed(root, levels: int, at: int, digest: str):
        """A root that has ``digest`` at leaf ``at``: copies of the ancestors, all else is shared."""
        above, node = [], root
        for level in reversed(range(levels)):
            above.append(node)
            node = node[2] if at >> level & 1 else node[1]
        node = (digest, None, None)
        for level, (_, left, right) in enumerate(reversed(above)):
            left, right = (left, node) if at >> level & 1 else (node, right)
            node = (joined(left[0], right[0]) if right else joined(left[0]), left, right)
        return node


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    """What a node becomes above: its copied ancestors, level by level."""
    for side, other in path:
        digest = joined(other, digest) if side == "L" else joined(digest, other)
    return digest


def packed(path: list[tuple[str, str]]) -> bytes:
    return b"".join(side.encode() + bytes.fromhex(d) for side, d in path)


def unpacked(data: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(data):
        side = chr(data[at])
        size = 0 if side == "-" else 32
        out.append((side, data[at + 1:at + 1 + size].hex()))
        at += 1 + size
    return out


def _levels(nodes: int, height: int) -> int:
    """How high a block is: the whole height, or up to one node in a tree that is one block."""
    return height if nodes > 1 << height else (nodes - 1).bit_length()


def _block(t: pa.Table, height: int) -> tuple[pa.Table, list[str], int]:
    t = t.sort_by("at")
    return t, [d.hex() for d in t.column("digest").to_pylist()], _levels(t.column("n")[0].as_py(), height)


class Blocks:
    """What is done with one aligned block of ``2 ** height`` nodes, and with a level of them."""

    def __init__(self, height: int):
        self.height = height

    def of(self, nodes: DataFrame):
        return nodes.groupBy("tree", F.shiftright("at", self.height).alias("block"))

    def up(self):
        height = self.height

        def run(t: pa.Table) -> pa.Table:
            t, digests, levels = _block(t, height)
            at, n = t.column("at")[0].as_py(), t.column("n")[0].as_py()
            return pa.table({"tree": t.column("tree").slice(0, 1), "at": pa.array([at >> height], pa.int64()),
                             "digest": [bytes.fromhex(Version.of(digests, levels)[0])], "n": pa.array([-(-n >> height)], pa.int64())})
        return run

    def down(self):
        height = self.height

        def run(t: pa.Table, above: pa.Table) -> pa.Table:
            t, digests, levels = _block(t, height)
            root, path, top = Version.of(digests, levels), above.column("path")[0].as_py(), above.column("top")[0].as_py()
            return pa.table({"tree": t.column("tree"), "at": t.column("at"), "path": [packed(Version.siblings(root, levels, i)) + path for i in range(len(digests))],
                             "top": pa.array([top] * len(digests), pa.binary())})
        return run

    def verify(self):
        height = self.height

        def run(t: pa.Table, above: pa.Table) -> pa.Table:
            t, digests, levels = _block(t, height)
            root, up, top = Version.of(digests, levels), unpacked(above.column("path")[0].as_py()), above.column("top")[0].as_py().hex()
            shown = [d.hex() if d else own for d, own in zip(t.column("shown").to_pylist(), digests, strict=True)]
            ends: dict[str, str] = {}  # versions with one block root share all copies above it
            proofs, folds = [], []
            for i, digest in enumerate(shown):
                version = Version.changed(root, levels, i, digest)
                if version[0] not in ends:
                    ends[version[0]] = folded(version[0], up)
                folds.append(ends[version[0]])
                proofs.append([d for _, d in Version.siblings(root, levels, i) + up if d])
            copied = [levels + len(up) if a != b else 0 for a, b in zip(shown, digests, strict=True)]
            return pa.table({"doc_id": t.column("doc_id"), "leaf": digests, "subroot": [top] * len(digests), "proof_sha256": [joined(*p) for p in proofs],
                             "folded_root": folds, "n_copied": pa.array(copied, pa.int32()), "proof": pa.array(proofs, pa.list_(pa.string()))})
        return run

    def raised(self, nodes: DataFrame, most: int) -> list[DataFrame]:
        """The levels of blocks over ``nodes`` until every tree is one node; ``most``: nodes of the largest."""
        levels = [nodes.select("tree", "at", "digest", "n")]
        while most > 1:
            levels.append(stored(self.of(levels[-1]).applyInArrow(self.up(), _NODES), "merkle-up"))
            most = -(-most >> self.height)
        return levels

    def lowered(self, levels: list[DataFrame], paths: DataFrame) -> DataFrame:
        """``paths`` of the nodes of the last level, brought down to those of the first."""
        for nodes in reversed(levels[:-1]):
            paths = stored(self.of(nodes).cogroup(paths.groupBy("tree", F.col("at").alias("block"))).applyInArrow(self.down(), _PATHS), "merkle-down")
        return paths


def merkle_manifest(df: DataFrame, presented: dict[str, Column] | None = None, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                    id_col: str = "doc_id", group_col: str = "lang", height: int = HEIGHT) -> DataFrame:
    """One row for each row of ``df``: doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified, n_copied (nodes that the version copied), proof (siblings from the leaf to the root).

    ``presented``: columns that hold other values when the row is shown again (null: the row
    itself is shown); the version made from them ends in ``folded_root``, and is verified if that
    is the root."""
    spark = df.sparkSession
    ship_package(spark)
    blocks = Blocks(height)
    presented = {c: v.cast(df.schema[c].dataType) for c, v in (presented or {}).items()}
    differs = F.lit(False)
    for c, v in presented.items():
        differs = differs | ~F.col(c).eqNullSafe(v)
    leaves = stored(df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("tree"),
        leaf_digest([F.col(c) for c in fields]).alias("digest"), F.when(differs, leaf_digest([presented.get(c, F.col(c)) for c in fields])).alias("shown")), "merkle-leaves")
    ordered = numbered(leaves.orderBy("tree", "doc_id", "digest"), "place", 0, "merkle-order")
    trees = stored(ordered.groupBy("tree").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n")), "merkle-trees")
    most, n_trees = trees.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    starts = trees.select(F.col("tree").alias("of_tree"), "start", "n", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    nodes = (ordered.join(starts, (F.col("tree") == F.col("of_tree")) & (F.col("place") % SALT == F.col("part")))
             .select("tree", (F.col("place") - F.col("start")).alias("at"), "digest", "n", "doc_id", "shown"))
    levels = blocks.raised(nodes, max(most, 2))
    subroots = stored(numbered(levels[-1].select("tree", "digest").orderBy("tree"), "at", 0, "merkle-subroots"), "merkle-subroots")
    forest = blocks.raised(subroots.select(F.lit("").alias("tree"), "at", "digest", F.lit(n_trees).cast("long").alias("n")), n_trees)
    root = forest[-1].first()
    root = F.lit(root["digest"].hex() if root else None).cast("string")
    paths = blocks.lowered(forest, forest[-1].select("tree", "at", F.lit(b"").alias("path"), F.col("digest").alias("top")))
    tops = (subroots.join(paths.select("at", "path"), "at").select("tree", F.lit(0).cast("long").alias("at"), "path", F.col("digest").alias("top")))
    paths = blocks.lowered(levels[1:], tops)
    rows = blocks.of(nodes).cogroup(paths.groupBy("tree", F.col("at").alias("block"))).applyInArrow(blocks.verify(), _ROWS)
    return rows.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", F.col("folded_root").eqNullSafe(root).alias("verified"), "n_copied", "proof")


def _sql_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_sql_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


# Whole levels of the trees and of the forest of their roots, and every leaf's siblings.
MERKLE_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_sql_leaf("n_chars")} AS leaf,
    CASE WHEN {sql_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_sql_leaf("(n_chars + 1)")} END AS tampered FROM documents),
leaves AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, tree, leaf, coalesce(tampered, leaf) AS shown,
  row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM raw),
up AS (SELECT 0 AS level, tree, pos, leaf AS digest, n FROM leaves
  UNION ALL SELECT level + 1, tree, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY level, tree, pos // 2, n),
subroots AS MATERIALIZED (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, pos, digest, n FROM subroots
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
  SELECT l.k, m.level, CASE WHEN m.other % 2 = 1 THEN 'R' ELSE 'L' END || coalesce(o.digest, '') AS step
  FROM leaves l JOIN (SELECT level, tree, pos, pos + 1 - 2 * (pos % 2) AS other FROM up WHERE n > 1) m ON m.tree = l.tree AND m.pos = l.pos >> m.level
  LEFT JOIN up o ON o.tree = l.tree AND o.level = m.level AND o.pos = m.other
  UNION ALL
  SELECT l.k, 1000 + m.level, CASE WHEN m.other % 2 = 1 THEN 'R' ELSE 'L' END || coalesce(o.digest, '')
  FROM leaves l JOIN subroots r ON r.tree = l.tree JOIN (SELECT level, pos, pos + 1 - 2 * (pos % 2) AS other FROM top WHERE n > 1) m ON m.pos = r.pos >> m.level
  LEFT JOIN top o ON o.level = m.level AND o.pos = m.other),
path AS (SELECT k, list(step ORDER BY level) AS steps FROM steps GROUP BY k),
done AS (SELECT l.doc_id, l.leaf, r.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root,
    sha256(coalesce(array_to_string(list_transform(p.steps, lambda s: s[2:]), ''), '')) AS proof_sha256,
    list_reduce(list_prepend(l.shown, coalesce(p.steps, [])), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
  FROM leaves l JOIN subroots r ON r.tree = l.tree LEFT JOIN path p ON p.k = l.k)
SELECT *, folded_root = root AS verified FROM done
"""
