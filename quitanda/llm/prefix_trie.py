"""Prefix trie of conversations as balanced parentheses, shard by shard.

Conversations are sequences of turns. In sorted order each one shares a prefix with the one before it,
so the trie of a run of them is a string of parentheses: close what is not shared, open what is new.
Over that string blocks of excess minima and maxima find the closing parenthesis of every node, which
delimits its subtree; the rank of leaf pairs ``()`` counts leaves, and running sums over the nodes in
preorder give members and savings.

A shard is such a run. Only nodes on the paths to its first and to its last conversation, its spines,
can go on in a neighbouring shard. All other nodes are final. The spines, with what hangs below them
added up, are the sequences of the next round; rounds go on until one shard has everything left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quitanda.llm.common import broadcast_if_small, list_column
from quitanda.session import materialize

GROUP = 20  # conversations that take their first turns from the first of them
HEAD = 4  # of which each takes less than so many
SHARD_TURNS = 200_000
LEAST = 8  # sequences of a shard that is not the last
BLOCK = 64  # parentheses whose excess bounds are kept
ROWS = 2_000_000  # spine nodes that are broadcast
NONE = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()

SPINE = "seq array<long>, words array<long>, n array<long>, low array<long>, kids array<long>, leaves array<long>, saved array<long>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SHARD = f"kind int, part long, no long, {NODE}, key binary, parent_key binary, ids binary, {SPINE}"
FINAL, ENDS, OPEN = range(3)


# --- balanced parentheses -------------------------------------------------------------------------

def _levels(excess: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(minima, maxima) of blocks, then of pairs of blocks, and so on to one."""
    n = -(-len(excess) // BLOCK)
    padded = np.full(n * BLOCK, excess[-1])
    padded[:len(excess)] = excess
    low, high = padded.reshape(n, BLOCK).min(1), padded.reshape(n, BLOCK).max(1)
    out = [(low, high)]
    while len(low) > 1:
        if len(low) % 2:
            low, high = np.r_[low, low[-1]], np.r_[high, high[-1]]
            out[-1] = (low, high)
        low, high = low.reshape(-1, 2).min(1), high.reshape(-1, 2).max(1)
        out.append((low, high))
    return out


def find_close(excess: np.ndarray, opened: np.ndarray) -> np.ndarray:
    """Place of the parenthesis that closes each of the ``opened`` ones: the next of excess one less."""
    want, out = excess[opened] - 1, np.full(len(opened), -1)

    def scan(who, at):
        """Look from ``at`` to the end of its block; those not found there."""
        left = []
        while len(who):
            inside = at < len(excess)
            hit = inside & (excess[np.where(inside, at, 0)] == want[who])
            out[who[hit]] = at[hit]
            who, at = who[~hit], at[~hit] + 1
            over = at % BLOCK == 0
            left.append(who[over])
            who, at = who[~over], at[~over]
        return np.concatenate(left) if left else who

    start = opened + 1
    fresh = start % BLOCK != 0
    beyond = np.sort(np.r_[scan(np.flatnonzero(fresh), start[fresh]), np.flatnonzero(~fresh)])
    levels = _levels(excess)
    found_at, block = np.full(len(opened), -1), np.zeros(len(opened), np.int64)
    who, b = beyond, opened[beyond] // BLOCK + 1
    b = np.where(fresh[beyond], b, start[beyond] // BLOCK)
    for k, (low, high) in enumerate(levels):
        odd = (b % 2 == 1) | (k == len(levels) - 1)
        i = np.flatnonzero(odd)
        hit = i[(low[b[i]] <= want[who[i]]) & (want[who[i]] <= high[b[i]])]
        found_at[who[hit]], block[who[hit]] = k, b[hit]
        on = np.ones(len(who), bool)
        on[hit] = False
        who, b = who[on], (b[on] + odd[on]) >> 1
    for k in range(len(levels) - 1, 0, -1):  # down again, to the left where it has what is wanted
        at = np.flatnonzero(found_at == k)
        left = 2 * block[at]
        low, high = levels[k - 1]
        inside = (low[left] <= want[at]) & (want[at] <= high[left])
        block[at] = np.where(inside, left, left + 1)
        found_at[at] = k - 1
    scan(beyond, block[beyond] * BLOCK)
    return out


def range_min(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of each non-empty ``values[first:end]``, from minima over lengths that are powers of two."""
    table = [values]
    while 2 << len(table) - 1 <= len(values):
        step = 1 << len(table) - 1
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    out = np.empty(len(first), np.int64)
    size = end - first
    level = np.frexp(size)[1] - 1
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][first[at]], table[k][end[at] - (1 << int(k))])
    return out


class Trie:
    """The trie of sorted sequences given as flat pairs of turn hashes.

    Nodes are numbered in preorder, 0 is the root; ``node`` is the node of each turn, ``tip`` the node at
    which each sequence ends.
    """

    def __init__(self, turns: np.ndarray, lens: np.ndarray):
        m, total = len(lens), len(turns)
        start = np.cumsum(lens) - lens
        index = np.arange(total) - np.repeat(start, lens)
        owner = np.repeat(np.arange(m), lens)
        # turns shared with the sequence before
        same = np.zeros(total, bool)
        back = np.flatnonzero((owner > 0) & (index < lens[np.maximum(owner - 1, 0)]))
        there = start[owner[back] - 1] + index[back]
        same[back] = (turns[back] == turns[there]).all(1)
        differs = np.where(same, total, index)
        shared = lens.copy()
        some = np.flatnonzero(lens > 0)
        if len(some):
            shared[some] = np.minimum(np.minimum.reduceat(differs, start[some]), lens[some])
        shared[0] = 0
        fresh = index >= np.repeat(shared, lens)
        number = np.where(fresh, np.cumsum(fresh), 0)
        # a shared turn has the node of the same turn of the last sequence that made one
        order = np.lexsort((owner, index))
        base = index[order] * (total + 1)
        self.node = np.empty(total, np.int64)
        self.node[order] = np.maximum.accumulate(base + number[order]) - base
        self.depth = np.r_[0, index[fresh] + 1]
        self.first_turn = np.r_[-1, np.flatnonzero(fresh)]  # a turn that stands for the node
        self.tip = np.zeros(m, np.int64)
        self.tip[some] = self.node[start[some] + lens[some] - 1]
        # parentheses
        runs = np.empty(2 * m, np.int64)
        runs[0::2] = lens - shared
        runs[0] += 1
        runs[1::2] = np.r_[lens[:-1] - shared[1:], lens[-1] + 1]
        step = np.repeat(np.tile([1, -1], m), runs)
        excess = np.cumsum(step)
        opened = np.flatnonzero(step > 0)
        close = find_close(excess, opened)
        self.end = np.arange(len(opened)) + (close - opened + 1) // 2  # the subtree of v: v to end[v]
        pair = (step > 0) & (np.r_[step[1:], 0] < 0)
        self.leaf = pair[opened]
        rank = np.r_[0, np.cumsum(pair)]
        self.leaf_pairs = rank[close + 1] - rank[opened]
        # parents: the last node before of one depth less
        n = len(opened)
        key = np.sort(self.depth * n + np.arange(n))
        up = np.searchsorted(key, (self.depth - 1) * n + np.arange(n)) - 1
        self.parent = np.where(self.depth > 0, key[np.maximum(up, 0)] % n, -1)

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` over the subtree of every node."""
        upto = np.r_[0, np.cumsum(values)]
        return upto[self.end] - upto[:-1]


def path_keys(path: np.ndarray) -> list[bytes]:
    """One key per prefix of a sequence of turn hashes, the empty one first."""
    state, out = xxhash.xxh3_128(), []
    out.append(state.digest())
    for turn in path:
        state.update(turn.tobytes())
        out.append(state.digest())
    return out


def _id_text(ids) -> bytes:
    return ",".join(map(str, ids)).encode()


def shard_rows(part: int, no: int, seqs: list[np.ndarray], words: list[np.ndarray], local: dict[str, list] | None,
               ids: list[int] | None, last: bool) -> Iterator[pa.RecordBatch]:
    """All that a shard gives: final nodes, ends that may go on elsewhere, and its spines.

    ``local`` has what each spine node brings from the round before (``n``, ``low``, ``kids``, ``leaves``,
    ``saved``; the root's first), ``ids`` the conversations of the first round.
    """
    lens = np.array([len(s) // 2 for s in seqs], np.int64)
    turns = np.concatenate(seqs).reshape(-1, 2)
    flat_words = np.concatenate(words)
    trie = Trie(turns, lens)
    size = len(trie.depth)
    start = np.cumsum(lens) - lens
    word = np.zeros(size, np.int64)
    word[1:] = flat_words[trie.first_turn[1:]]

    n, kids, leaves, saved = (np.zeros(size, np.int64) for _ in range(4))
    low = np.full(size, NONE)
    if local is None:
        np.add.at(n, trie.tip, 1)
        np.minimum.at(low, trie.tip, np.array(ids, np.int64))
    else:
        # a sequence brings one value for the root and one per turn
        at = np.insert(trie.node, start, 0) if len(trie.node) else np.zeros(len(lens), np.int64)
        for target, name in ((n, "n"), (kids, "kids"), (leaves, "leaves"), (saved, "saved")):
            np.add.at(target, at, np.concatenate(local[name]))
        np.minimum.at(low, at, np.concatenate(local["low"]))

    spine = np.zeros(size, bool)
    paths = []
    if not last:
        for i in dict.fromkeys((0, len(lens) - 1)):
            path = np.r_[0, trie.node[start[i]:start[i] + lens[i]]]
            paths.append((i, path, spine[path].copy()))
            spine[path] = True
    final = ~spine
    members = trie.below(n)
    smallest = range_min(low, np.arange(size), trie.end)
    own = np.bincount(trie.parent[1:], minlength=size)
    childless = trie.leaf & (kids == 0)
    if local is None:
        all_leaves = trie.leaf_pairs
    else:
        all_leaves = trie.below(leaves + childless)
    savings = trie.below(saved + (members - 1) * word)

    shown = np.flatnonzero(final)
    hashes = {}
    if ids is not None:
        cut = np.flatnonzero(np.r_[True, trie.tip[1:] != trie.tip[:-1]])
        for a, b in zip(cut.tolist(), np.r_[cut[1:], len(lens)].tolist()):
            hashes[int(trie.tip[a])] = _id_text(ids[a:b])
    keys: dict[int, bytes] = {}
    for i in [i for i, _, _ in paths] if local is None else range(len(lens)):
        path = np.r_[0, trie.node[start[i]:start[i] + lens[i]]]
        keys |= zip(path.tolist(), path_keys(turns[start[i]:start[i] + lens[i]]))
    over = trie.parent[shown]
    pending = (over >= 0) & spine[over]
    if local is None:
        ends = [hashlib.sha256(hashes[v]).hexdigest() if v in hashes else NO_ENDS for v in shown.tolist()]
    else:
        ends = [None] * len(shown)  # put together from the first round's parts
    yield _batch(len(shown), kind=[FINAL] * len(shown), conv_id=smallest[shown], depth=trie.depth[shown],
                 parent_conv_id=pa.array(smallest[over], mask=(over < 0) | pending), n_convs=members[shown], n_children=(kids + own)[shown],
                 n_leaves=all_leaves[shown], saved_tokens=savings[shown], ends_sha256=ends,
                 key=[keys.get(v) for v in shown.tolist()], parent_key=[keys[p] if wait else None for p, wait in zip(over.tolist(), pending.tolist())])
    if not paths:
        return
    some = [v for v in np.flatnonzero(spine).tolist() if v in hashes]
    yield _batch(len(some), kind=[ENDS] * len(some), part=[part] * len(some), no=[no] * len(some), key=[keys[v] for v in some],
                 ids=[hashes[v] for v in some])
    # what hangs below a spine node and is final is added up in it
    hang = shown[pending]
    to = trie.parent[hang]
    for target, values in ((n, members[hang]), (kids, np.ones(len(hang), np.int64)), (leaves, all_leaves[hang]), (saved, savings[hang])):
        np.add.at(target, to, values)
    np.minimum.at(low, to, smallest[hang])
    for order, (i, path, known) in enumerate(paths):  # a node of both paths brings its own only once
        own_of = {name: np.where(known, nothing, values[path]) for name, values, nothing in (
            ("n", n, 0), ("low", low, NONE), ("kids", kids, 0), ("leaves", leaves, 0), ("saved", saved, 0))}
        yield _batch(1, kind=[OPEN], part=[part], no=[2 * no + order],
                     **{name: list_column([v], pa.int64()) for name, v in {"seq": seqs[i], "words": words[i], **own_of}.items()})


def _batch(count: int, **cols) -> pa.RecordBatch:
    """Rows of a shard's result; columns not given are null."""
    out = []
    for name, kind in (c.split() for c in SHARD.split(", ")):
        kind = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[kind]
        held = cols.get(name)
        out.append(pa.nulls(count, kind) if held is None else held if isinstance(held, pa.Array) else pa.array(held, kind))
    return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in SHARD.split(", ")])


# --- Spark ----------------------------------------------------------------------------------------

def sequences(turns: DataFrame, group: int = GROUP, head: int = HEAD) -> DataFrame:
    """(conv_id, seq, words): the rebuilt conversations as flat pairs of turn hashes, and words per turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn"), F.xxhash64(text("role"), text("text")).alias("h1"), F.xxhash64(F.lit(1), text("text"), text("role")).alias("h2"),
            F.regexp_count(text("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).alias("t"))
    # Of a turn 32 bytes are kept, whatever its text; a conversation is one row.
    convs = materialize(one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")), "trie-conversations")
    first = F.col("conv_id") - F.col("conv_id") % group
    heads = convs.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, head - 1).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int")
    left = F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1)))
    lead = F.slice(F.coalesce("lead", F.slice("own", 1, 0)), 1, h)
    whole = convs.join(heads, first == F.col("base"), "left").select("conv_id", F.concat(lead, left).alias("all"))
    return whole.select("conv_id", F.flatten(F.transform("all", lambda t: F.array(t["h1"], t["h2"]))).alias("seq"),
                        F.transform("all", lambda t: t["words"]).alias("words"))


def _lists(column) -> list[np.ndarray]:
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


def _round(rows: DataFrame, names: list[str], limit: int, last: bool) -> DataFrame:
    """Shards of sorted rows; with ``last`` all rows are one shard."""
    def run(batches):
        part, no, held, turns = TaskContext.get().partitionId(), 0, [], 0

        def give(done):
            cols = dict(zip(names, zip(*done)))
            local = {k: cols[k] for k in ("n", "low", "kids", "leaves", "saved")} if "n" in cols else None
            return shard_rows(part, no, list(cols["seq"]), list(cols["words"]), local, list(cols["conv_id"]) if local is None else None, last)

        for batch in batches:
            lists = [batch.column(i).to_pylist() if n == "conv_id" else _lists(batch.column(i)) for i, n in enumerate(names)]
            for row in zip(*lists):
                held.append(row)
                turns += len(row[names.index("words")])
                if turns >= limit and len(held) >= LEAST and not last:
                    yield from give(held)
                    no, held, turns = no + 1, [], 0
        if held:
            yield from give(held)

    return materialize(rows.select(*names).mapInArrow(run, SHARD), "trie-shards")


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): the parts of each list of ids, in order, through one running hash."""
    parts = ends.select("key", "part", "no", "ids").repartition("key").sortWithinPartitions("key", "part", "no")

    def run(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["key", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends"])

    return parts.select("key", "ids").mapInArrow(run, "key binary, ends string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, head: int = HEAD, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per node.

    ``conversations`` has conv_id, turn, role and text. Turns are ordered by ``turn``, null first, and ties by
    the hash of role and text; null roles and texts are empty. Conversation ``c`` takes its first
    ``crc32(c) % head`` turns from ``c - c % group`` (the remainder has the sign of ``c``), as many as that
    has, and then its own after as many. A conversation without turns left ends at the root. Rows with a
    null id belong to no conversation. Repeated rows are turns like others; very long texts cost no more than
    short ones once counted; other columns are ignored; an empty table has no root and gives no rows. Turns
    are compared by 128-bit hashes.
    """
    rows = sequences(conversations, group, head).repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    levels = [_round(rows, ["conv_id", "seq", "words"], shard_turns, False)]
    names = ["seq", "words", "n", "low", "kids", "leaves", "saved"]
    while True:
        open_rows = levels[-1].filter(F.col("kind") == OPEN)
        total, count = open_rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)), F.count("*")).first()
        if not count:
            break
        if total <= shard_turns or count <= LEAST:  # one task takes a bounded rest
            levels.append(_round(open_rows.repartition(1).sortWithinPartitions("part", "no"), names, shard_turns, True))
            break
        levels.append(_round(open_rows.repartitionByRange("part", "no").sortWithinPartitions("part", "no"), names, shard_turns, False))
    kept = [c.split()[0] for c in NODE.split(", ")]
    nodes = [x.filter(F.col("kind") == FINAL).select(*kept, "key", "parent_key") for x in levels]
    first = nodes[0]
    if len(levels) == 1:
        return first.select(*kept)
    upper = nodes[1]
    for more in nodes[2:]:
        upper = upper.unionByName(more)
    ends = _end_hashes(levels[0].filter(F.col("kind") == ENDS))
    upper = materialize(upper.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS)))
                        .select(*kept, "key", "parent_key"), "trie-spines")
    over = broadcast_if_small(upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")), ROWS)
    waiting: Column = F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id")
    return first.unionByName(upper).join(over, "parent_key", "left").select(*[waiting if c == "parent_conv_id" else c for c in kept])
