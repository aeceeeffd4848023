"""Prefix trie of conversations, rolled up by pointer jumping.

A turn is a 128-bit digest of its role and text.  A prefix is the sum, in four lanes, of
hashes of its turns' digests with their places; sums run over a conversation's turns by
ranges (``operators/order.py``), so a conversation of any length is cut over tasks.  Equal
prefixes are one node, and the sums before and after a turn are the node's edge to its
parent.  What a node passes up reaches all ancestors in doubling rounds: after round k a
node holds the sums of its descendants at distances below 2**k, and a pointer to its
ancestor at that distance.  Rounds follow the logarithm of the deepest node.

Defined cases: rows without a conversation's id take no part; a null role or text is an
empty one; a null turn sorts first; equal turns are ordered by digest (equal rows are
interchangeable); an empty table gives no nodes.  Texts of any length are only hashed.
Other columns are ignored.  A node shared by a third of all conversations is counted before
the shuffle; the joins to such a node are plain shuffles, which Spark's skewed join splits.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered, running
from .common import materialise

#: Ids of one node that are joined to one string; longer lists are strings hashed in order.
BLOCK_IDS = 8_192
LANES = ("_s0", "_s1", "_s2", "_s3")


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, chars): every turn's place from 0, digest and code points."""
    who, what = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat_ws("|", F.length(who).cast("string"), who, what).cast("binary")))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(what).cast("long").alias("chars"))
    return materialise(numbered(rows, ["turn", "digest"], "pos", ("conv",)).drop("turn"), "trie-turns")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv, n): how many turns each conversation has."""
    return turns.groupBy("conv").agg(F.count("*").alias("n"))


def grafted(turns: DataFrame, donor: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``heads`` turns are those of another.

    ``donor`` and ``heads`` are expressions of ``conv``; ``heads`` is at most ``most``, and
    few conversations share a donor.  Returns the new turns and (conv, n); a conversation
    that keeps no turn has n = 0.
    """
    convs = lengths(turns).select("conv", "n", donor.alias("donor"), heads.cast("long").alias("heads"))
    first = turns.where(F.col("pos") < most).groupBy(F.col("conv").alias("donor")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("first"))
    taken = F.coalesce(F.slice("first", F.lit(1), F.col("heads").cast("int")), F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>"))
    joined = convs.join(first.hint("merge"), "donor", "left").select("conv", "heads", "n", taken.alias("lead"))
    joined = materialise(joined.select("conv", "heads", "lead", (F.size("lead") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))).cast("long").alias("n")), "trie-grafts")
    lead = joined.select("conv", F.explode("lead").alias("x")).select("conv", "x.*")
    shift = joined.select("conv", "heads", (F.size("lead") - F.col("heads")).alias("by"))
    own = turns.join(shift.hint("merge"), "conv").where(F.col("pos") >= F.col("heads")).select("conv", (F.col("pos") + F.col("by")).alias("pos"), "digest", "chars")
    return lead.unionByName(own), joined.select("conv", "n")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", depth.cast("string"), *(s.cast("string") for s in sums)).cast("binary")))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, key, parent, chars): each turn's prefix, and the prefix before it."""
    low = F.lit(0xFFFFFFFF)
    halves = [F.xxhash64(F.lit(k), "pos", "digest") for k in (1, 2)]
    lanes = [lane for h in halves for lane in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32))]
    rows = turns.select("*", *(lane.alias(f"_h{k}") for k, lane in enumerate(lanes)))
    sums = running(rows, ["pos"], {s: F.col(f"_h{k}") for k, s in enumerate(LANES)}, ("conv",))
    before, after = [F.col(s) for s in LANES], [F.col(s) + F.col(f"_h{k}") for k, s in enumerate(LANES)]
    depth = F.col("pos") + 1
    return materialise(sums.select("conv", depth.alias("depth"), _key(depth, after).alias("key"), _key(F.col("pos"), before).alias("parent"), "chars"), "trie-prefixes")


def _digest_lists(batches):
    """Rows sorted by key and block: one digest a key, blocks fed in order."""
    now, state, done = None, None, []
    for batch in batches:
        for key, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(part.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done])], names=["key", "ends_sha256"])
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def id_digests(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of each key's ids, ascending and joined by commas.

    SHA-256 takes its input in order, so a key's strings pass one task; ids are joined to
    strings of a bounded length before, and a string at a time is in memory.
    """
    placed = numbered(members.select("key", "conv"), ["conv"], "_i", ("key",))
    block = F.floor(F.col("_i") / F.lit(BLOCK_IDS))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    parts = placed.groupBy("key", block.alias("block")).agg(ids.alias("ids"))
    return parts.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_digest_lists, "key binary, ends_sha256 string")


def rollup(nodes: DataFrame, deepest: int) -> DataFrame:
    """(conv_id, depth, n_leaves, saved) of (conv_id, depth, parent_conv_id, leaf, own): sums over each node's subtree.

    A node is named by its smallest member and depth; ``up`` is its ancestor 2**k above.
    """
    t = nodes.select("conv_id", "depth", F.col("parent_conv_id").alias("up"), F.col("leaf").cast("long").alias("n_leaves"), F.col("own").alias("saved"))
    reach = 1
    while reach <= deepest:
        sent = t.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("conv_id"), (F.col("depth") - reach).alias("depth")).agg(F.sum("n_leaves").alias("more"), F.sum("saved").alias("more_saved"))
        t = t.join(sent.hint("merge"), ["conv_id", "depth"], "left").select("conv_id", "depth", "up", (F.col("n_leaves") + F.coalesce("more", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        if 2 * reach <= deepest:
            # Rows that have no ancestor twice as far keep a key of their own that nothing has: they meet no hot key.
            far = F.col("depth") >= 2 * reach
            ends = t.where(F.col("depth") >= reach).select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"), F.col("up").alias("_u"))
            keyed = t.withColumn("_c", F.when(far, F.col("up")).otherwise(F.col("conv_id"))).withColumn("_d", F.when(far, F.col("depth") - reach).otherwise(-1 - F.col("depth")))
            t = keyed.join(ends.hint("merge"), ["_c", "_d"], "left").select("conv_id", "depth", F.col("_u").alias("up"), "n_leaves", "saved")
        t = materialise(t, "trie-round")
        reach *= 2
    return t.select("conv_id", "depth", "n_leaves", "saved")


def build(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a distinct prefix of the conversations, the empty one included.

    ``turns``: (conv, pos, digest, chars); ``convs``: (conv, n), every conversation once.
    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, members but one times the last text's code points) and
    ends_sha256 (of the members that end there).
    """
    seen = prefixes(turns)
    none = _key(F.lit(0), [F.lit(0)] * len(LANES))
    own = seen.groupBy("key", "parent", "depth", "chars").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    top = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = top.select(none.alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "conv_id", "n_convs")
    nodes = materialise(own.unionByName(root), "trie-nodes")
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    # The root's own key replaces a null parent: nothing is joined to it twice, and no null key gathers rows.
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.join(kids.hint("merge"), "key", "left").join(above.hint("merge"), "parent", "left")
    tree = materialise(
        linked.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own")), "trie-tree"
    ).withColumn("leaf", F.col("n_children") == 0)
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    sums = rollup(tree, deepest)
    last = convs.where("n > 0").select("conv", F.col("n").alias("depth"))
    ended = seen.join(last.hint("merge"), ["conv", "depth"]).select("key", "conv").unionByName(convs.where("n = 0").select(none.alias("key"), "conv"))
    out = tree.join(sums.hint("merge"), ["conv_id", "depth"]).join(id_digests(ended).hint("merge"), "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations as they are; see :func:`build`."""
    turns = turns_of(conversations, conv, turn, role, text)
    return build(turns, lengths(turns))


def grafted_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that take their first turns, as many as a hash of the id says, from the hundred's first."""
    turns = turns_of(conversations)
    new, convs = grafted(turns, F.col("conv") - F.col("conv") % 100, F.crc32(F.col("conv").cast("string").cast("binary")) % 6, 5)
    return build(new, convs)


SQL = """
WITH RECURSIVE turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || '|' || coalesce(role, '') || '|' || coalesce(text, ''))) - 1 AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, count(*) AS n, c - c % 100 AS donor, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)) AS b FROM turns GROUP BY c),
crc(c, e, v) AS (SELECT c, 0, 4294967295::BIGINT FROM convs UNION ALL
  SELECT crc.c, e + 1, list_reduce([xor(v, b[e + 1]::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) FROM crc JOIN convs USING (c) WHERE e < len(b)),
heads AS (SELECT convs.*, xor(v, 4294967295) % 6 AS h FROM convs JOIN crc ON crc.c = convs.c AND e = len(b)),
sized AS (SELECT a.c, a.n, a.donor, a.h, least(a.h, coalesce(d.n, 0)) AS m FROM heads a LEFT JOIN heads d ON d.c = a.donor),
built AS (SELECT s.c, t.i AS pos, role, text FROM sized s JOIN turns t ON t.c = s.donor AND t.i < s.h UNION ALL SELECT s.c, t.i - s.h + s.m, role, text FROM sized s JOIN turns t ON t.c = s.c AND t.i >= s.h),
pre AS (SELECT c, pos + 1 AS d, length(text) AS chars, md5(string_agg(md5(CAST(length(role) AS VARCHAR) || '|' || role || '|' || text), ',') OVER (PARTITION BY c ORDER BY pos)) AS k FROM built),
member AS (SELECT c, d, k, chars FROM pre UNION ALL SELECT c, 0, '', 0 FROM sized),
node AS (SELECT k, d, min(c) AS r, count(*) AS n, max(chars) AS chars FROM member GROUP BY k, d),
edge AS (SELECT node.*, up.k AS pk, up.d AS pd FROM node LEFT JOIN member up ON up.c = node.r AND up.d = node.d - 1),
kids AS (SELECT pk AS k, pd AS d, count(*) AS kids FROM edge WHERE pk IS NOT NULL GROUP BY ALL),
own AS (SELECT edge.*, coalesce(kids, 0) AS kids FROM edge LEFT JOIN kids USING (k, d)),
sums AS (SELECT m.k, m.d, sum(CASE WHEN own.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((own.n - 1) * own.chars) AS saved FROM own JOIN member m ON m.c = own.r AND m.d <= own.d GROUP BY ALL),
ends AS (SELECT k, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, max(d) AS d FROM member GROUP BY c) JOIN member USING (c, d) GROUP BY ALL)
SELECT CAST(own.r AS BIGINT) AS conv_id, CAST(own.d AS BIGINT) AS depth, CAST(p.r AS BIGINT) AS parent_conv_id, CAST(own.n AS BIGINT) AS n_convs, CAST(kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM own LEFT JOIN node p ON p.k = own.pk AND p.d = own.pd JOIN sums ON sums.k = own.k AND sums.d = own.d LEFT JOIN ends ON ends.k = own.k AND ends.d = own.d
"""
