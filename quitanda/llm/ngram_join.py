"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word n-grams; two documents link when the Jaccard similarity
of their sets reaches a threshold. The n-grams have one global order, rare ones first. The order is
cut into fragments, every set falls into one segment per fragment, the overlap of a pair is counted
in each fragment on its own and the partial counts are summed per pair.

How pairs are found without listing a whole group of copies:

1. Equal sets are one class (``node``), identified by a 64-bit hash of the set.
2. A first pass keeps only nodes that can have a partner at all. In hash order, partners must share
   ``j`` of their ``n - ceil(s n) + j`` smallest n-grams; only those n-grams are shuffled, in packed
   blocks, and a common n-gram leaves a block once however many documents hold it.
3. For the nodes left, document frequencies are counted exactly. The global order is (frequency,
   hash). An n-gram with frequency one cannot be shared, so a node needs ``ceil(s n)`` others.
4. Partners share an n-gram of their prefixes in the global order, at positions that leave room
   for the required overlap. First every node is checked only against the hub of each of its
   prefix n-grams, the node whose n-grams are most common. Links found there are contracted.
5. Of the pairs left, those within one component change nothing. All others that pass the same
   prefix, length and position bounds are checked, so no link between components is lost.

Hashes are 64 bits wide; a collision inside one pair of sets is the only way to a wrong count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quitanda.llm.common import broadcast_if_small, distinct, list_column, window_hashes, word_hashes
from quitanda.llm.components import components
from quitanda.session import materialize

BROADCAST_ROWS = 2_000_000
EXTRA = 10


def _needed(n: np.ndarray | int, percent: int):
    """Smallest overlap any partner of a set of ``n`` has with it."""
    return -(-percent * n // 100)


def _extra(n: int, percent: int) -> int:
    """Extra prefix n-grams ``j`` of the first pass: a tenth of the set, at least one."""
    return max(1, n // EXTRA)


def _sets(column: pa.Array, k: int):
    """The n-gram set of each text, as sorted hashes."""
    return (distinct(window_hashes(words, k)) for words in word_hashes(column, lower=True))


def _node(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def describe(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(doc_id, sum, n, node, prefix): text hash, set size, class and the smallest n-gram hashes of each text."""
    def run(batches):
        for batch in batches:
            n, nodes, prefixes = [], [], []
            for grams in _sets(batch.column(1), k):
                size = len(grams)
                n.append(size)
                nodes.append(_node(grams))
                keep = min(size, size - _needed(size, percent) + _extra(size, percent)) if size else 0
                prefixes.append(grams[:keep].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()),
                 list_column(prefixes, pa.int64())], ["doc_id", "sum", "n", "node", "prefix"])

    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("sum"))
    return picked.mapInArrow(run, "doc_id long, sum long, n long, node long, prefix array<long>")


def shared_counts(described: DataFrame, buckets: int) -> DataFrame:
    """(node, hits): how many prefix n-grams of each node occur in another node; never too few."""
    mask = buckets - 1

    def pack(batches):
        for batch in batches:
            lists, nodes = batch.column(1), batch.column(0).to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            grams = lists.flatten().to_numpy()
            owner = np.repeat(nodes, sizes)
            if not len(grams):
                continue
            order = np.lexsort((owner, grams))
            grams, owner = grams[order], owner[order]
            new = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]
            grams, owner = grams[new], owner[new]
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            times = np.diff(np.r_[first, len(grams)])
            many = np.repeat(times > 1, times)
            rows = []
            if many.any():  # shared inside the block: counted here, and only one marker goes on
                who, hits = np.unique(owner[many], return_counts=True)
                rows.append((-1 - int(who[0] & mask), None, None, who.tobytes(), hits.astype(np.int64).tobytes()))
            g, o, m = grams[first], owner[first], times > 1
            at = g & mask
            order = np.argsort(at, kind="stable")
            g, o, m, at = g[order], o[order], m[order], at[order]
            cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            for a, b in zip(cut, np.r_[cut[1:], len(at)]):
                rows.append((int(at[a]), g[a:b].tobytes(), np.packbits(m[a:b]).tobytes(), o[a:b].tobytes(), None))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                ["bucket", "grams", "many", "owner", "hits"])

    def count(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:
            who = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("owner").to_pylist()])
            hits = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("hits").to_pylist()])
            return pa.table({"node": who, "hits": hits})
        g = [np.frombuffer(x, np.int64) for x in group.column("grams").to_pylist()]
        o = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("owner").to_pylist()])
        m = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)).astype(bool)
                            for x, y in zip(group.column("many").to_pylist(), g)])
        g = np.concatenate(g)
        order = np.argsort(g, kind="stable")
        g, o, m = g[order], o[order], m[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        times = np.diff(np.r_[first, len(g)])
        differ = (np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)) | np.logical_or.reduceat(m, first)
        hit = np.repeat(differ, times) & ~m
        who, hits = np.unique(o[hit], return_counts=True)
        return pa.table({"node": who, "hits": hits.astype(np.int64)})

    packed = described.select("node", "prefix").mapInArrow(
        pack, "bucket long, grams binary, many binary, owner binary, hits binary")
    return (packed.groupBy("bucket").applyInArrow(count, "node long, hits long")
            .groupBy("node").agg(F.sum("hits").alias("hits")))


def _exploded(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, k: int) -> DataFrame:
    """(node, n, grams) for the texts ``nodes(node, rep, rep_sum)`` names by id and text hash."""
    def run(batches):
        for batch in batches:
            node, n, sets = [], [], []
            for grams in _sets(batch.column(0), k):
                node.append(_node(grams))
                n.append(len(grams))
                sets.append(grams.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(n, pa.int64()), list_column(sets, pa.int64())],
                ["node", "n", "grams"])

    reps = broadcast_if_small(nodes.select("rep", "rep_sum"), BROADCAST_ROWS)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("text"), F.xxhash64(text).alias("_sum")).join(
        reps, F.col("_id").eqNullSafe(F.col("rep")) & (F.col("_sum") == F.col("rep_sum")), "left_semi")
    return texts.select("text").mapInArrow(run, "node long, n long, grams array<long>")


def _overlap(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps counted per fragment, then summed per pair."""
    left = segments.select(F.col("node").alias("a"), "frag", F.col("seg").alias("sa"), F.col("n").alias("na"))
    right = segments.select(F.col("node").alias("b"), "frag", F.col("seg").alias("sb"), F.col("n").alias("nb"))
    partial = (pairs.join(left, "a").join(right, ["b", "frag"])
               .select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("part")))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return summed.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _possible(x: str, y: str, percent: int):
    """Bounds every link obeys, from sizes, shareable n-grams and positions of a common n-gram."""
    c = lambda side, name: F.col(f"{side}.{name}")
    need = percent * (c(x, "n") + c(y, "n"))  # overlap * (100 + percent) must reach this
    room = F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos"))
    return ((100 * c(x, "n") >= percent * c(y, "n")) & (100 * c(y, "n") >= percent * c(x, "n"))
            & ((100 + percent) * F.least(c(x, "usable"), c(y, "usable")) >= need)
            & ((100 + percent) * room >= need))


def _ordered(first: str, second: str):
    return F.least(first, second).alias("a"), F.greatest(first, second).alias("b")


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
                  fragments: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own included. Words are
    maximal runs without ASCII white space, A-Z lower-cased; fewer than ``k`` words are one n-gram.
    Null, empty and wordless texts have no n-grams, size 0, and are linked with nothing. A row with
    a null id gets the smallest non-null id of its component, or null. Repeated rows are copies and
    fall into one component; two texts under one id are two rows. Other columns are ignored, an
    empty table gives an empty result. Very long texts are one set like any other.
    """
    seen, placed = _linked(docs, id_col, text_col, k, percent, fragments)
    smallest = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_node = placed.join(smallest, "comp").select("node", "component_id")
    return (seen.select("doc_id", "n", "node").join(of_node, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
                    .alias("component_id")))


def _prepared(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, fragments: int):
    """(``describe``'s rows, classes, prefixes, segments): what the search for pairs starts from."""
    seen = materialize(describe(docs, id_col, text_col, k, percent), "ngram-sets")
    classes = materialize(seen.filter("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.coalesce(F.min_by("sum", "doc_id"), F.min("sum")).alias("rep_sum"),
        F.first("n").alias("n")), "ngram-classes")
    grams = seen.agg(F.sum(F.size("prefix"))).first()[0] or 0
    buckets = 1 << max(6, int(grams // 250_000).bit_length())
    extra = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / EXTRA))
    nodes = materialize(shared_counts(seen, buckets).join(classes, "node").filter(F.col("hits") >= extra)
                        .select("node", "rep", "rep_sum", "n"), "ngram-nodes")

    sets = _exploded(docs, id_col, text_col, nodes, k)
    if not seen.groupBy("doc_id", "sum").count().filter("count > 1").isEmpty():  # a repeated row counts once
        sets = sets.dropDuplicates(["node"])
    rows = sets.select("node", "n", F.explode("grams").alias("gram"))
    freq = rows.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    active = (rows.join(freq, "gram")
              .groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
              .withColumn("usable", F.size("grams").cast("long"))
              .filter(100 * F.col("usable") >= percent * F.col("n")))
    lead = F.col("n") - F.col("usable")
    mass = F.aggregate("grams", F.lit(0).cast("long"), lambda s, g: s + g["df"])
    # Written with the value: on top of an explode it would be computed once per n-gram.
    active = materialize(active.withColumn("central", (mass + lead) / F.col("n")), "ngram-active")

    keep = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - lead).cast("int")
    prefix = materialize(
        active.select("node", "n", "usable", "central", F.posexplode(F.slice("grams", 1, keep)).alias("i", "g"))
        .select("node", "n", "usable", (lead + F.col("i")).alias("pos"), "central", F.col("g.gram").alias("gram")),
        "ngram-prefix")

    share = [i / fragments for i in range(1, fragments)]
    df_cuts, = active.select(F.explode("grams.df").alias("df")).agg(
        F.percentile_approx("df", F.array(*map(F.lit, share)), 1000)).first()
    # Fragments are runs of the global order. Its first key is the frequency; inside equal frequencies
    # the hash decides, so a cut is a (frequency, hash) pair spread evenly over the hash range.
    cuts = _pivots(df_cuts or [], fragments)
    bounds = [None, *cuts, None]

    def segment(lo, hi):
        def inside(g):
            test = F.lit(True)
            if lo is not None:
                test = test & ((g["df"] > lo[0]) | ((g["df"] == lo[0]) & (g["gram"] >= F.lit(lo[1]))))
            if hi is not None:
                test = test & ((g["df"] < hi[0]) | ((g["df"] == hi[0]) & (g["gram"] < F.lit(hi[1]))))
            return test
        return F.transform(F.filter("grams", inside), lambda g: g["gram"])

    segments = active.select("node", "n", F.posexplode(
        F.array(*(segment(a, b) for a, b in zip(bounds, bounds[1:])))).alias("frag", "seg")).filter(F.size("seg") > 0)

    return seen, classes, prefix, segments


def _linked(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, fragments: int) -> tuple[DataFrame, DataFrame]:
    """``describe``'s rows, and (node, rep, comp) with the smallest id and the component of every class."""
    seen, classes, prefix, segments = _prepared(docs, id_col, text_col, k, percent, fragments)
    # Written, so that the joins with it stand alone in their stages and a hot n-gram can be split.
    hub = materialize(prefix.groupBy("gram").agg(
        F.max(F.struct("central", "node", "n", "usable", "pos")).alias("h"), F.count("*").alias("c")).filter("c > 1").select(
        "gram", "h.*"), "ngram-hubs").alias("h")
    tried = materialize(
        prefix.alias("p").join(hub, F.col("p.gram") == F.col("h.gram"))
        .filter((F.col("p.node") != F.col("h.node")) & _possible("p", "h", percent))
        .select(*_ordered("p.node", "h.node")).distinct(), "ngram-star")
    links = materialize(_overlap(tried, segments, percent), "ngram-links")
    labels = components(links)

    placed = prefix.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = materialize(placed, "ngram-placed")
    main = materialize(placed.groupBy("gram", "comp").agg(F.count("*").alias("c"))
                       .groupBy("gram").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps"))
                       .filter("comps > 1").select("gram", F.col("m.comp").alias("main")), "ngram-main")
    few = placed.join(main, "gram").filter("comp <> main").alias("x")
    rest = (few.join(placed.alias("y"), F.col("x.gram") == F.col("y.gram"))
            .filter((F.col("x.comp") != F.col("y.comp"))
                    & ((F.col("y.comp") == F.col("x.main")) | (F.col("x.node") < F.col("y.node")))
                    & _possible("x", "y", percent))
            .select(*_ordered("x.node", "y.node")).distinct()
            .join(tried, ["a", "b"], "left_anti"))
    more = materialize(_overlap(rest, segments, percent), "ngram-links")
    labels = components(links.union(more)) if not more.isEmpty() else labels

    return seen, classes.join(labels, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
          fragments: int = 8, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): all links between different n-gram sets, and who belongs to each set.

    ``members`` has (doc_id, node, n), a row per row of ``docs`` with words; equal sets are one ``node``.
    ``pairs`` has (a, b), two nodes that link, a < b, each pair once; copies are not expanded. Texts and
    edge cases are those of ``ngram_jaccard``. A group of near copies that all link has as many pairs as
    that; for a common n-gram they are searched in blocks of about ``block`` by all, spread over tasks.
    """
    seen, _, prefix, segments = _prepared(docs, id_col, text_col, k, percent, fragments)
    often = materialize(prefix.groupBy("gram").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("c"))
                        .filter("c > 1").drop("c"), "ngram-often")
    placed = prefix.join(often, "gram")
    left = placed.withColumn("part", F.pmod(F.xxhash64("node"), "blocks").cast("int")).alias("x")
    right = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    tried = (left.join(right, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.part") == F.col("y.part")))
             .filter((F.col("x.node") < F.col("y.node")) & _possible("x", "y", percent))
             .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    pairs = materialize(_overlap(materialize(tried, "ngram-pairs"), segments, percent), "ngram-links")
    return pairs, seen.filter("n > 0").select("doc_id", "node", "n")


def _pivots(df_cuts: list[int], fragments: int) -> list[tuple[int, int]]:
    """(frequency, hash) cuts from frequency quantiles; equal quantiles share their hash range."""
    cuts = []
    for df in sorted(set(df_cuts)):
        times = df_cuts.count(df)
        for i in range(times):
            cuts.append((int(df), int(-(1 << 63) + (i + 1) * ((1 << 64) // (times + 1)))))
    return cuts


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
             fragments: int = 8) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, null ids last, ties by the hash of the text.

    Decided per row by id and text, so of two texts under one id only the one that is a copy goes, and of
    repeated rows one stays, whether they have an id or not. Texts without words are in no component: all
    of them stay. Columns are kept; very long texts are one set like any other; an empty table stays empty.
    """
    seen, placed = _linked(docs, id_col, text_col, k, percent, fragments)
    worded = seen.filter("n > 0").select("doc_id", "sum", "node")
    rows = materialize(worded.join(placed.select("node", "comp"), "node").select("doc_id", "sum", "comp"), "ngram-rows")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "sum")).alias("f"))
    stays = first.select(F.col("f.doc_id").alias("_id"), F.col("f.sum").alias("_sum"))
    # Found by id and text, not by component: a component may hold much of the table, an id may not.
    gone = (rows.join(stays, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sum") == F.col("_sum")), "left_anti")
            .select(F.col("doc_id").alias("_gone_id"), F.col("sum").alias("_gone_sum")).distinct())

    same = (F.col(id_col).cast("long").eqNullSafe(F.col("_gone_id"))
            & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_gone_sum")))
    out = docs.join(gone, same, "left_anti")
    twice = rows.groupBy(F.col("doc_id").alias("_gone_id"), F.col("sum").alias("_gone_sum")).count().filter("count > 1").drop("count")
    if twice.isEmpty():
        return out
    again = (out.join(twice, same, "left_semi").withColumn("_gone_sum", F.xxhash64(F.col(text_col).cast("string")))
             .dropDuplicates([id_col, "_gone_sum"]).drop("_gone_sum"))
    return out.join(twice, same, "left_anti").unionByName(again)
