"""A prefix trie of conversations, built as a burst trie.

A turn is TURN bytes: a hash of its role and text, and the length of its text. A rebuilt conversation is the string of its turns,
and equal ones are one row that carries their number and smallest id. Containers hold such rows under a trie head, at first all of
them. A container of more than LEAST_BURST rows, or BURST_BYTES, bursts: its common prefix becomes a chain of nodes, and its rows
are dealt out to new containers by their next turn. The others are sorted and swept into nodes, with a stack of the current
path; the sums over the subtrees of burst heads are then added up from the last round of bursts to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, table

#: Bytes of a turn: 16 of a hash, and the length of its text in 8.
TURN = 24
#: Turns of another conversation that a rebuilt one starts with: h below MOST_HEAD + 1, from the next smaller multiple of EVERY.
EVERY, MOST_HEAD = 5, 8
#: Rows, and bytes, of a container that doesn't burst.
LEAST_BURST, BURST_BYTES = 4096, 1 << 25
#: Ids of one piece of a node's list.
PIECE = 1 << 14
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, e1 long, e2 long, container binary"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq binary): the turns of each conversation in order. Null turns come first; turns that tie are in the order of the
    MD5 of their role's length, a colon, role and text. Rows without a conv_id belong to no conversation. Texts are not gathered,
    only their TURN bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.concat(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", code.alias("code"))
    in_order = F.sort_array(F.collect_list(F.struct("turn", "code")))  # nulls first
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(in_order, lambda t: t["code"]), "")).alias("seq"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq): the first h turns of the conversation at the next smaller multiple of EVERY, then its own after its first h."""
    own = materialize(turns(conversations), "turns")
    heads = own.filter(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("__p"), F.expr(f"substring(seq, 1, {TURN * MOST_HEAD})").alias("__head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)).cast("int")
    both = own.withColumns({"__p": F.col("conv_id") - F.col("conv_id") % EVERY, "__h": h}).join(heads, "__p", "left")
    first = F.expr(f"substring(coalesce(__head, X''), 1, {TURN} * __h)")
    rest = F.expr(f"substring(seq, {TURN} * __h + 1)")
    return both.select("conv_id", F.concat(first, rest).alias("seq"))


def _prefix(turns_: Column) -> Column:
    """A hash of the first turns_ turns of seq."""
    part = F.substring("seq", F.lit(1), turns_ * TURN)
    return F.unhex(F.concat(F.lpad(F.hex(F.xxhash64(part)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), part)), 16, "0")))


def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Turns that two strings of turns have in common at their start."""

    def one(x: bytes, y: bytes) -> int:
        low, high = 0, min(len(x), len(y)) // TURN
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if x[: mid * TURN] == y[: mid * TURN] else (low, mid - 1)
        return low

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int64")


class _Node:
    """A node of the current path; children wait in `below` until its smallest member is known."""

    __slots__ = ("below", "children", "depth", "end", "leaves", "least", "members", "saved")

    def __init__(self, depth: int):
        self.depth, self.least, self.members, self.children, self.leaves, self.saved, self.end, self.below = depth, None, 0, 0, 0, 0, (None, None), []


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers, from rows (container, at, parent, seq, n, least, e1, e2) in the order of container and seq."""
    out: list[tuple] = []
    path: list[_Node] = []
    now, parent, last = None, None, b""

    def close(down_to: int) -> None:
        """Ends the nodes of the path beyond its first down_to."""
        while len(path) > down_to:
            node = path.pop()
            if not node.children:
                node.leaves = 1
            node.saved += (node.members - 1) * int.from_bytes(last[(node.depth - 1) * TURN + 16 : node.depth * TURN], "big") if node.depth else 0
            for least, *rest in node.below:
                out.append((least, rest[0], node.least, *rest[1:]))
            row = (node.least, node.depth, node.members, node.children, node.leaves, node.saved, *node.end, None)
            if path:
                up = path[-1]
                up.below.append(row)
                up.children += 1
                up.leaves += node.leaves
                up.saved += node.saved
            else:
                out.append((node.least, node.depth, parent, *row[2:8], now))

    def emit() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * 10
        out.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:9]), pa.array(cols[9], pa.binary())], [f.split()[0] for f in NODE.split(", ")])

    for batch in batches:
        for container, at, up, seq, n, least, e1, e2 in zip(*(c.to_pylist() for c in batch.columns)):
            if container != now:
                close(0)
                now, parent, last = container, up, b""
            if path:
                same = 0
                most = min(len(last), len(seq)) // TURN
                for node in path:
                    if node.depth > most or last[same * TURN : node.depth * TURN] != seq[same * TURN : node.depth * TURN]:
                        break
                    same = node.depth
                close(sum(node.depth <= same for node in path))
            for depth in range(path[-1].depth + 1 if path else at + 1, len(seq) // TURN + 1):
                path.append(_Node(depth))
            for node in path:
                node.members += n
                node.least = least if node.least is None else min(node.least, least)
            path[-1].end = (e1, e2)
            last = seq
            if len(out) >= 1 << 14:
                yield emit()
    close(0)
    yield emit()


def _ends(members: DataFrame) -> DataFrame:
    """(e1, e2, ends): the SHA-256 of each sequence's ids in order, from members (e1, e2, conv_id).

    Ids are range-sorted and joined to pieces by the tasks of that sort, so that the one task that a hash needs, since it is
    sequential, takes pieces and not ids.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        done: list[tuple] = []
        for batch in batches:
            for e1, e2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (e1, e2) != now or len(ids) >= PIECE:
                    if ids:
                        done.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids = (e1, e2), []
                ids.append(conv)
            if ids and len(done) >= 1 << 12:
                yield rows(done)
                done = []
        if ids:
            done.append((*now, ids[0], ",".join(map(str, ids))))
        yield rows(done)

    def rows(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done)) if done else [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["e1", "e2", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for e1, e2, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (e1, e2) != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (e1, e2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield out(done)
        yield out([(*now, sha.hexdigest())] if now is not None else [])

    def out(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done)) if done else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["e1", "e2", "ends"])

    ranged = members.select("e1", "e2", "conv_id").orderBy("e1", "e2", "conv_id").mapInArrow(pieces, "e1 long, e2 long, first long, ids string")
    again = ranged.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "first").select("e1", "e2", "ids")
    return again.mapInArrow(hashes, "e1 long, e2 long, ends string")


def nodes(conversations: DataFrame, burst: int = LEAST_BURST, burst_bytes: int = BURST_BYTES) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 of the conversations that end there.

    Null roles and texts are empty ones; repeated rows of a conversation are turns of their own; rows without a conv_id are left out.
    Conversations without turns are members of the root, and end there. Extra columns don't matter. An empty table gives no rows.
    """
    members = materialize(rebuilt(conversations).withColumns({"e1": F.xxhash64("seq"), "e2": F.xxhash64(F.lit("second"), "seq")}), "rebuilt")
    rows = members.groupBy("e1", "e2").agg(F.first("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    rows = rows.withColumns({"container": F.lit(b""), "at": F.lit(-1).cast("long"), "parent": F.lit(None).cast("long"), "head": F.lit(None).cast("binary")})
    now = materialize(rows, "sequences")
    still, bursts = [], []
    while True:
        totals = {"rows": F.count(F.lit(1)), "bytes": F.sum(F.length("seq")), "members": F.sum("n"), "smallest": F.min("least"), "low": F.min("seq"), "high": F.max("seq")}
        sizes = now.groupBy("container").agg(*(v.alias(k) for k, v in totals.items()), F.min("at").alias("at"), F.min("parent").alias("parent"), F.min("head").alias("head"))
        large = sizes.filter((F.col("rows") > 1) & ((F.col("rows") > burst) | (F.col("bytes") > burst_bytes)))
        chain = F.substring("low", F.lit(1), F.col("common").cast("int") * TURN)
        heads = materialize(large.withColumn("common", F.pandas_udf(_common, "long")("low", "high")).select("container", "at", "parent", "head", "members", "smallest", "common", chain.alias("chain")), "heads")
        still.append(now.join(heads.select("container"), "container", "left_anti"))
        if heads.isEmpty():
            break
        dealt = now.select("container", "e1", "e2", "seq", "n", "least").join(heads.select("container", "common", "smallest"), "container")
        here = F.length("seq") == F.col("common") * TURN  # one row at most, since rows differ
        bursts.append((heads, dealt.filter(here).select("container", "e1", "e2")))
        below = dealt.filter(~here).select("e1", "e2", "seq", "n", "least", _prefix(F.col("common").cast("int") + 1).alias("container"), F.col("common").alias("at"), F.col("smallest").alias("parent"), F.col("container").alias("head"))
        now = materialize(below, "sequences")
    settled = still[0]
    for s in still[1:]:
        settled = settled.unionByName(s)
    settled = settled.select("container", "at", "parent", "seq", "n", "least", "e1", "e2")
    swept = materialize(settled.repartition("container").sortWithinPartitions("container", "seq").mapInArrow(sweep, NODE), "nodes")
    found, tops = swept.drop("container"), swept.filter("container is not null").select("container", "n_leaves", "saved_tokens")
    parents = [s.select("container", "head").filter("head is not null").distinct() for s in still]
    burst_nodes = []
    for turn in reversed(range(len(bursts))):
        heads, ended = bursts[turn]
        under = tops.join(parents[turn + 1], "container").select(F.col("head").alias("container"), "n_leaves", "saved_tokens")
        if burst_nodes:
            under = under.unionByName(burst_nodes[-1][1])
        sums = under.groupBy("container").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        length = F.conv(F.hex(F.substring("chain", (F.col("depth").cast("int") - 1) * TURN + 17, F.lit(8))), 16, 10).cast("long")
        step = F.when(F.col("depth") > 0, (F.col("members") - 1) * length).otherwise(0)
        onward = Window.partitionBy("container").orderBy(F.desc("depth"))  # a chain is the turns of one conversation at most
        full = heads.join(sums, "container").join(ended, "container", "left").withColumn("depth", F.explode(F.sequence(F.col("at") + 1, F.col("common"))))
        chained = materialize(full.withColumn("saved", F.col("below") + F.sum(step).over(onward)), "chains")
        depth, saved = F.col("depth"), F.col("saved")
        leaf = depth == F.col("common")
        rows_ = chained.select(
            F.col("smallest").alias("conv_id"), depth, F.when(depth == F.col("at") + 1, F.col("parent")).otherwise(F.col("smallest")).alias("parent_conv_id"), F.col("members").alias("n_convs"),
            F.when(leaf, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.when(leaf, F.col("e1")).alias("e1"), F.when(leaf, F.col("e2")).alias("e2"),
        )
        top = chained.filter(depth == F.col("at") + 1).filter("head is not null").select(F.col("head").alias("container"), "n_leaves", saved.alias("saved_tokens"))
        burst_nodes.append((rows_, top))
    for rows_, _ in burst_nodes:
        found = found.unionByName(rows_)
    named = found.join(_ends(members), ["e1", "e2"], "left")
    return named.select(*(c.split()[0] for c in NODE.split(", ")[:7]), F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(table(spark, sf_dir, "conversations"))


#: Nodes by the whole text of their path; sums over subtrees by giving each node to all nodes above it.
OP13_SQL = """
with t as (
  select conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) s from conversations where conv_id is not null group by 1
), c as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) tab
), h as (
  select conv_id, s, conv_id - conv_id % 5 p, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295) % 9 h from t, c
), b as (
  select x.conv_id, list_concat(coalesce(y.s[1 : x.h], []), x.s[x.h + 1 : ]) s from h x left join t y on y.conv_id = x.p
), k as (
  select conv_id, len(s) n, list_transform(generate_series(0, len(s)), lambda d: sha256(s[1 : d]::varchar)) k, list_transform(s, lambda x: strlen(x.t)) z from b
), p as (
  select conv_id, n, unnest(generate_series(0, n)) d, k, z from k
), g as (
  select d, k[d + 1] key, case when d > 0 then k[d] end up, case when d > 0 then z[d] else 0 end z, conv_id, n = d ended, k[1 : d + 1] above from p
), m as (
  select d, key, min(up) up, min(conv_id) conv_id, count(*) n_convs, min(z) z, any_value(above) above,
    sha256(coalesce(string_agg(case when ended then conv_id::varchar end, ',' order by conv_id), '')) ends from g group by d, key
), ch as (
  select up key, count(*) n_children from m where up is not null group by 1
), u as (
  select key, unnest(above) anc, (n_convs - 1) * z saved from m
), leaf as (
  select u.anc key, sum(u.saved) saved_tokens, count(*) filter (ch.key is null) n_leaves from u left join ch using (key) group by 1
)
select m.conv_id, m.d depth, q.conv_id parent_conv_id, m.n_convs, coalesce(ch.n_children, 0)::bigint n_children, leaf.n_leaves::bigint n_leaves, leaf.saved_tokens::bigint saved_tokens, m.ends ends_sha256
from m left join m q on q.key = m.up left join ch on ch.key = m.key join leaf on leaf.key = m.key
"""

ORACLE: dict[str, str] = {"op13_prefix_trie": OP13_SQL}
QUERIES = {"op13_prefix_trie": op13_prefix_trie}
