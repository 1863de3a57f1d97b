"""The prefix trie of conversations by truncation peeling.

A sequence of turns is known by the exclusive or of hashes of its turns with
their places, so stripping the last turn needs no text. Peeling begins at the
greatest depth: conversations that end there meet the nodes that are left
from below, equal ones become one node with its totals, and its last turn is stripped.

A task peels a fragment, a subtree of a bounded number of turns. What lies
above the fragments, few nodes at every size, is peeled in the same way from the
fragments' totals. A first turn that very many conversations share is thus
only a node with many fragments.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakewright.operators.ranking import positions
from lakewright.session import cut_lineage

from .mixing import n_tokens

#: Turns in a fragment: at least this, or this share of all; so at most SHARES nodes of one depth lie above the fragments.
FRAGMENT, SHARES = 1 << 10, 1 << 14
#: Turns that are peeled at once, in as many fragments as they make.
AT_ONCE = 1 << 17
#: Ids in a block of the ids that are hashed.
IDS = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """What the trie reads of each turn: `conv`, `turn`, two hashes `a` and `b` of role and text, `words`. Rows without a conversation go."""
    said, by = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    return conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), F.xxhash64(by, said).alias("a"),
        F.xxhash64(F.lit(1), said, by).alias("b"), n_tokens(text).alias("words"))


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the one of the round number below them: (`conv`, `len`, `depth`, `a`, `b`, `words`), (`conv`, `len`).

    The first h = crc32(conv) % `most` turns are those of conversation conv - conv % `every`, as many as it
    has; its own turns after its first h follow. Turns are ordered by `turn`, null first; equal
    ones by their hashes. A conversation may have no turns then.
    """
    placed = cut_lineage(positions(turns, ["conv"], ["turn", "a", "b"], "p"), "placed")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    # No more than most - 1 turns each.
    heads = (placed.where((F.col("p") < most) & (F.pmod("conv", F.lit(every)) == 0)).groupBy(F.col("conv").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("p", "a", "b", "words"))).alias("head")))
    none = F.array().cast(heads.schema["head"].dataType)
    convs = (placed.groupBy("conv").agg(F.count("*").alias("n")).withColumn("base", F.col("conv") - F.pmod("conv", F.lit(every)))
             .join(heads, "base", "left").withColumn("h", h).withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")))
             .withColumn("len", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    convs = cut_lineage(convs.select("conv", "h", "head", "len"), "conversations")
    borrowed = convs.select("conv", "len", F.posexplode("head").alias("at", "turn")).select(
        "conv", "len", (F.col("at") + 1).cast("long").alias("depth"), "turn.a", "turn.b", "turn.words")
    own = placed.join(convs.select("conv", "len", "h", F.size("head").alias("lead")), "conv").where(F.col("p") > F.col("h")).select(
        "conv", "len", (F.col("lead") + F.col("p") - F.col("h")).alias("depth"), "a", "b", "words")
    return borrowed.unionByName(own), convs.select("conv", "len")


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, in the form of `rebuilt`."""
    placed = cut_lineage(positions(turns, ["conv"], ["turn", "a", "b"], "depth"), "placed")
    convs = placed.groupBy("conv").agg(F.count("*").alias("len"))
    return placed.join(convs, "conv").select("conv", "len", "depth", "a", "b", "words"), convs


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def paths(rows: DataFrame) -> DataFrame:
    """Each row with its node, `u` and `v`, and `x` and `y`, by which that differs from its parent; the root is 0, 0.

    Ranges of conversation and depth together: a range begins with what the
    conversation that is cut there has in the ranges before it.
    """
    termed = rows.withColumn("x", F.xxhash64("depth", "a", "b")).withColumn("y", F.xxhash64(F.lit(2), "b", "a", "depth")).drop("a", "b")
    ranged = cut_lineage(termed.repartitionByRange("conv", "depth").withColumn("part", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One conversation for each range at most.
    carried = (ranged.groupBy("conv", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
               .select("conv", "part", F.bit_xor("x").over(earlier).alias("cu"), F.bit_xor("y").over(earlier).alias("cv")).where("cu is not null"))
    so_far = Window.partitionBy("part", "conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.withColumn("u", F.bit_xor("x").over(so_far)).withColumn("v", F.bit_xor("y").over(so_far))
            .join(F.broadcast(carried), ["part", "conv"], "left")
            .withColumn("u", _xor(F.col("u"), F.coalesce("cu", F.lit(0)))).withColumn("v", _xor(F.col("v"), F.coalesce("cv", F.lit(0))))
            .select("conv", "len", "depth", "words", "x", "y", "u", "v"))


_BLOCKS = "u long, v long, len long, first long, n long, ids string"
_ENDS = "u long, v long, len long, conv long, n long, sha string"


def end_digests(ends: DataFrame) -> DataFrame:
    """For every node (`u`, `v`, at depth `len`) that conversations end at: the smallest (`conv`), their number, the digest of their ids.

    Ids are sorted by ranges of node and id, so a node's ids may lie in many tasks;
    then blocks of them pass, in order, through one running digest.
    """
    def pack(batches):
        last, ids, held = None, [], []
        for batch in batches:
            for u, v, n, conv in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "len", "conv"))):
                if ids and ((u, v) != last[:2] or len(ids) == IDS):
                    held.append((*last, ids[0], len(ids), ",".join(map(str, ids))))
                    ids = []
                last = u, v, n
                ids.append(conv)
            if held:
                yield _rows(held, _BLOCKS)
                held = []
        if ids:
            yield _rows([(*last, ids[0], len(ids), ",".join(map(str, ids)))], _BLOCKS)

    def digest(batches):
        last, done = None, []
        for batch in batches:
            for u, v, length, first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "len", "first", "n", "ids"))):
                if last != (u, v):
                    if last:
                        done.append((*last, *about, total, running.hexdigest()))
                    last, about, total, running = (u, v), (length, first), 0, hashlib.sha256()
                running.update((b"," if total else b"") + ids.encode())
                total += n
            if done:
                yield _rows(done, _ENDS)
                done = []
        if last:
            yield _rows([*done, (*last, *about, total, running.hexdigest())], _ENDS)

    sorted_ = ends.repartitionByRange("u", "v", "conv").sortWithinPartitions("u", "v", "conv")
    return (sorted_.select("u", "v", "len", "conv").mapInArrow(pack, _BLOCKS)
            .repartition("u", "v").sortWithinPartitions("u", "v", "first").mapInArrow(digest, _ENDS))


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array(c, pa.string() if kind == "string" else pa.int64()) for c, (_, kind) in zip(zip(*rows), fields)],
                           names=[name for name, _ in fields])


_NODES = ("u long, v long, pu long, pv long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, ends_sha256 string")
_FRAGMENT = "ku", "kv", "conv", "len", "depth", "words", "x", "y", "u", "v", "n", "sha"


def peel(rows: dict[str, np.ndarray]) -> list[tuple]:
    """Nodes of whole fragments; the top of each has its parent's key and no parent.

    rows: `_FRAGMENT` columns of the paths of distinct conversations, from their fragments' tops down; n (conversations) and sha at the last turn.
    """
    order = np.lexsort((rows["depth"], rows["conv"]))
    conv, length, depth, words, x, y, u, v, n, sha = (rows[c][order] for c in _FRAGMENT[2:])
    top = np.ones(len(conv), bool)
    top[1:] = conv[1:] != conv[:-1]
    ends_at = np.flatnonzero(depth == length)
    ends_at = ends_at[np.argsort(-depth[ends_at], kind="stable")]
    ended_depth, at = -depth[ends_at], 0  # ascending
    out: list[tuple] = []
    empty = np.empty(0, np.int64)
    # The nodes of the depth below: a row of a member, and totals.
    left = {k: empty for k in ("row", "n", "least", "children", "leaves", "saved", "sha")}
    level = int(depth.max())
    while True:
        stop = int(np.searchsorted(ended_depth, -level, "right"))
        new, at = ends_at[at:stop], stop
        # Strip the last turn: the row before it.
        row = np.concatenate([left["row"] - 1, new])
        if not len(row):
            if at == len(ends_at):
                return out
            level = int(depth[ends_at[at]])
            continue
        survivors = len(left["row"])
        by_key = np.lexsort((v[row], u[row]))
        key_u, key_v = u[row][by_key], v[row][by_key]
        first = np.ones(len(row), bool)
        first[1:] = (key_u[1:] != key_u[:-1]) | (key_v[1:] != key_v[:-1])
        starts = np.flatnonzero(first)
        group = np.empty(len(row), np.int64)
        group[by_key] = np.cumsum(first) - 1

        def total(below: np.ndarray, own: np.ndarray, add=np.add) -> np.ndarray:
            return add.reduceat(np.concatenate([below, own])[by_key], starts)

        zeros = np.zeros(len(new), np.int64)
        merged = {
            "row": row[by_key][starts], "n": total(left["n"], n[new]), "least": total(left["least"], conv[new], np.minimum),
            "children": total(np.ones(survivors, np.int64), zeros), "leaves": total(left["leaves"], zeros),
            "saved": total(left["saved"], zeros), "sha": total(np.full(survivors, -1), new, np.maximum)}
        merged["leaves"] = np.where(merged["children"] == 0, 1, merged["leaves"])
        merged["saved"] += (merged["n"] - 1) * words[merged["row"]]
        if survivors:
            out.append((left, merged["least"][group[:survivors]]))
        done = top[merged["row"]]
        if done.any():
            out.append(({k: a[done] for k, a in merged.items()}, None))
        left = {k: a[~done] for k, a in merged.items()}
        level -= 1


def _peeled(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    order = np.lexsort((rows["depth"], rows["conv"]))
    depth, x, y, u, v, sha = (rows[c][order] for c in ("depth", "x", "y", "u", "v", "sha"))
    found = peel(rows)
    nodes = {k: np.concatenate([f[k] for f, _ in found]) for k in found[0][0]}
    inner = np.concatenate([np.full(len(f["row"]), p is not None) for f, p in found])
    parent = np.concatenate([np.zeros(len(f["row"]), np.int64) if p is None else p for f, p in found])
    at = nodes["row"]
    return pa.record_batch([
        *(pa.array(c) for c in (u[at], v[at], u[at] ^ x[at], v[at] ^ y[at], nodes["least"], depth[at])), pa.array(parent, mask=~inner),
        *(pa.array(nodes[k]) for k in ("n", "children", "leaves", "saved")),
        pa.array([sha[s] if s >= 0 else NO_ENDS for s in nodes["sha"].tolist()], pa.string())],
        names=[f.split()[0] for f in _NODES.split(", ")])


def _peel_fragments(most: int):
    """Task: rows sorted by fragment come in; many whole fragments are peeled at once."""
    def task(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= max(2 * most, AT_ONCE):
                table = pa.Table.from_batches(held).combine_chunks()
                ku, kv = (table.column(c).to_numpy() for c in ("ku", "kv"))
                same = (ku == ku[-1]) & (kv == kv[-1])
                whole = int(np.argmax(same))  # sorted: the last fragment may go on
                if whole:
                    yield _peeled(_arrays(table.slice(0, whole)))
                    held = table.slice(whole).to_batches()
                    n = table.num_rows - whole
        if n:
            yield _peeled(_arrays(pa.Table.from_batches(held)))

    return task


def _arrays(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: np.array(table.column(c).to_pylist(), object) if c == "sha" else table.column(c).to_numpy() for c in _FRAGMENT}


_UPPER = "u long, v long, x long, y long, depth long, words long, n long, least long, kids long, leaves long, saved long, sha string"


def _peel_upper(batches):
    """Task: the nodes above the fragments come by descending depth, each with the totals of what lies directly below it."""
    below: dict[tuple, list] = {}
    done = []
    for batch in batches:
        for u, v, x, y, depth, words, n, least, kids, leaves, saved, sha in zip(*(batch.column(f.split()[0]).to_pylist() for f in _UPPER.split(", "))):
            children = below.pop((u, v), [])
            n += sum(c[7] for c in children)
            least = min([c[4] for c in children] + [least] * (least is not None))
            kids, leaves = kids + len(children), leaves + sum(c[9] for c in children)
            saved += sum(c[10] for c in children) + (n - 1) * words
            done += [(*c[:6], least, *c[7:]) for c in children]
            node = (u, v, u ^ x, v ^ y, least, depth, None, n, kids, leaves if kids else 1, saved, sha or NO_ENDS)
            if depth:
                below.setdefault(node[2:4], []).append(node)
            else:
                done.append(node)
        if done:
            yield _rows(done, _NODES)
            done = []


def trie_nodes(rows: DataFrame, convs: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """One row per node of the trie of conversations (`rows` and `convs` as from `rebuilt` or `plain`), the root (depth 0) included.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 (of the ids, in order, of the conversations that end there). No conversations give no row.
    A node's turns are the first `depth` ones of conversation conv_id.
    """
    every = cut_lineage(paths(rows), "paths")
    ended = every.where("depth = len").select("u", "v", "len", "conv").unionByName(
        convs.where("len = 0").select(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"), F.col("len").cast("long").alias("len"), "conv"))
    ends = cut_lineage(end_digests(ended), "ends")
    # Of equal conversations one goes on.
    path = cut_lineage(every.join(ends.select("conv"), "conv", "left_semi"), "distinct")
    most = max(fragment, path.count() // SHARES)
    large = cut_lineage(path.groupBy("u", "v").agg(
        F.sum(F.col("len") - F.col("depth") + 1).alias("below"), *[F.first(c).alias(c) for c in ("x", "y", "depth", "words")])
        .where(F.col("below") > most).drop("below"), "large")
    small = cut_lineage(path.join(large, ["u", "v"], "left_anti"), "small")
    tops = small.groupBy("conv").agg(F.min_by(F.struct("u", "v"), "depth").alias("k")).select("conv", F.col("k.u").alias("ku"), F.col("k.v").alias("kv"))
    at_end = F.col("depth") == F.col("len")
    pieces = (small.join(tops, "conv").join(ends.select("conv", "n", "sha"), "conv")
              .withColumn("n", F.when(at_end, F.col("n")).otherwise(0)).withColumn("sha", F.when(at_end, F.col("sha"))))
    peeled = cut_lineage(pieces.select(*_FRAGMENT).repartition("ku", "kv").sortWithinPartitions("ku", "kv")
                         .mapInArrow(_peel_fragments(most), _NODES), "peeled")

    hanging = peeled.where("parent_conv_id is null")
    totals = hanging.groupBy(F.col("pu").alias("u"), F.col("pv").alias("v")).agg(
        F.sum("n_convs").alias("tn"), F.min("conv_id").alias("tleast"), F.count("*").alias("kids"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    root = convs.agg(F.count("*").alias("c")).where("c > 0").select(
        *[F.lit(0).cast("long").alias(c) for c in ("u", "v", "x", "y", "depth", "words")])
    upper = (large.unionByName(root).join(totals, ["u", "v"], "left").join(ends.select("u", "v", "conv", "n", "sha"), ["u", "v"], "left")
             .select("u", "v", "x", "y", "depth", "words", (F.coalesce("tn", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"),
                     F.least("tleast", "conv").alias("least"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kids", "leaves", "saved")], "sha"))
    above = cut_lineage(upper.repartition(1).sortWithinPartitions(F.desc("depth")).mapInArrow(_peel_upper, _NODES), "upper")
    parents = above.select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("conv_id").alias("parent"))
    hung = hanging.join(parents, ["pu", "pv"]).withColumn("parent_conv_id", F.col("parent"))
    columns = [f.split()[0] for f in _NODES.split(", ")][4:]
    return (peeled.where("parent_conv_id is not null").select(*columns).unionByName(hung.select(*columns))
            .unionByName(above.select(*columns)))


def conversation_trie(conversations: DataFrame, every: int = 20, most: int = 4, fragment: int = FRAGMENT) -> DataFrame:
    """`trie_nodes` of the rebuilt conversations of a table conv_id, turn, role, text.

    Null roles and texts count as empty, rows without conv_id take no part, repeated rows are turns each; other
    columns are not read. What is shuffled are hashes and numbers, never texts.
    """
    return trie_nodes(*rebuilt(turn_rows(conversations), every, most), fragment)
