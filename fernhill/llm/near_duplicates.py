"""N-gram Jaccard self-join with signature trees, to components of near-duplicate documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernhill.llm import _exchange as ex
from fernhill.llm._components import components
from fernhill.llm._shared import documents, materialise
from fernhill.llm._words import Block, U, blocks, heads, join, mix, order_of, windows, with_doc

#: Bits of a set's signature, and children of a tree node.
SIGNATURE, FAN = 4096, 8
#: Sets of a block, and bytes of their shingles, about; a task joins one block or two.
MEMBERS, MEMBER_BYTES = 1024, 8_000_000
#: Bytes of text in a chunk; its shingles take some thirty times as much memory.
CHUNK = 2_500_000
#: Keys are chosen among shingles that fewer chunks than this hold first, then among the next class.
LEVELS = (4, 32)

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of the distinct shingles of each text, in document order; short texts have one."""
    b = Block(texts, _LOWER)
    words, bounds = b.words(), b.first_word()
    first, keys = windows(words, b.doc, size)
    doc = b.doc[first]
    count = np.diff(bounds)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = words[bounds[short]]
        for k in range(1, size - 1):
            more = np.flatnonzero(count[short] > k)
            whole[more] = join(whole[more], words[bounds[short[more]] + k])
        doc, keys = np.concatenate((doc, short)), np.concatenate((keys, mix(whole + count[short].astype(np.uint64))))
    own = with_doc(keys, doc)
    order = order_of(own)
    keep = np.sort(order[heads(own[order])])
    keep = keep[np.argsort(doc[keep], kind="stable")]
    return doc[keep], keys[keep]


def _add_up(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.uint64)
    np.add.at(out, index, values)
    return out


def set_prints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, p1, p2): equal sets have equal prints of 128 bits."""

    def run(batches):
        for part, texts in blocks(batches):
            doc, keys = shingle_sets(texts, size)
            n = np.bincount(doc, minlength=len(texts))
            prints = [_add_up(doc, mix(keys + U(k)), len(texts)).view(np.int64) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), *map(pa.array, prints)], ["doc_id", "text_key", "n_shingles", "p1", "p2"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, n_shingles long, p1 long, p2 long")


def rare_prefix(n: np.ndarray, shared: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many shingles, of those that other sets hold, a set of ``n`` needs as keys to meet all it is linked with.

    Take any one order of all shingles. Sets with Jaccard of num/den or more have at least
    ceil(n num / den) in common, so that the least of these is among the first n - ceil(n num / den) + 1
    of each. In an order that begins with what no other set holds, these first ones may be no keys
    at all; ``shared`` counts the others.
    """
    return np.clip(n - -(-n * num // den) + 1 - (n - shared), 0, shared)


class _Forest:
    def __init__(self, labels: np.ndarray):
        """Members with equal labels start together."""
        self.up = np.unique(labels, return_index=True, return_inverse=True)
        self.up = self.up[1][self.up[2]].tolist()

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))])


def signature_join(sets: list[np.ndarray], labels: np.ndarray, num: int, den: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect members exactly as all their links would, given that equal labels are linked.

    A tree over the sets in order of size and least shingles holds in each node the OR of its sets'
    token bitmaps, their size range and the most bits that a set loses to collisions. Pairs of nodes
    are traversed together from the roots; a pair is pruned when its largest possible overlap is too
    small for its smallest sizes, or when its members are in one component already. What reaches the
    leaves is counted exactly. left: marks of hosts; only pairs of a host and a visitor are looked at.
    """
    n = np.array([len(s) for s in sets])
    order = np.lexsort((np.array([s[0] if len(s) else 0 for s in sets], np.uint64), n))
    forest, links = _Forest(labels), []
    side = None if left is None else left[order]

    def try_link(i: int, j: int) -> None:
        a, b = int(order[i]), int(order[j])
        ra, rb = forest.find(a), forest.find(b)
        if ra == rb or (left is not None and left[a] == left[b]):
            return
        x, y = sets[a], sets[b]
        if den * min(len(x), len(y)) < num * max(len(x), len(y)):
            return
        at = np.searchsorted(y, x)
        both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
        if den * both >= num * (len(x) + len(y) - both):
            forest.up[max(ra, rb)] = min(ra, rb)
            links.append((a, b))

    # copies lie next to each other in an order by their least shingles
    least = np.lexsort((n, np.array([s[0] if len(s) else 0 for s in sets], np.uint64)))
    back = np.empty(len(sets), np.int64)
    back[order] = np.arange(len(sets))
    for a, b in zip(least[:-1], least[1:]):
        try_link(int(back[a]), int(back[b]))

    bitmap = np.zeros((len(sets), SIGNATURE // 64), np.uint64)
    for i, k in enumerate(order):
        slot = sets[k] % U(SIGNATURE)
        np.bitwise_or.at(bitmap[i], (slot // U(64)).astype(np.int64), U(1) << (slot % U(64)))
    size = n[order]
    levels = [(bitmap, size, size, size - np.bitwise_count(bitmap).sum(1), np.arange(len(sets)), np.arange(len(sets)) + 1)]
    while len(levels[-1][0]) > 1:
        bm, low, high, lost, start, end = levels[-1]
        cut = np.arange(0, len(bm), FAN)
        levels.append((np.bitwise_or.reduceat(bm, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(lost, cut), start[cut], end[np.minimum(cut + FAN, len(bm)) - 1]))

    def visit(level: int, pairs: np.ndarray) -> None:
        bm, low, high, lost, start, end = levels[level]
        for k in range(0, len(pairs), 8192):
            p, q = pairs[k : k + 8192].T
            roots = forest.roots()[order]
            lo, hi = np.minimum.reduceat(roots, start), np.maximum.reduceat(roots, start)
            open_ = ~((lo[p] == hi[p]) & (lo[q] == hi[q]) & (lo[p] == lo[q]))
            most = np.minimum(np.bitwise_count(bm[p] & bm[q]).sum(1) + np.minimum(lost[p], lost[q]), np.minimum(high[p], high[q]))
            p, q = (x[open_ & ((num + den) * most >= num * (low[p] + low[q]))] for x in (p, q))
            if level == 0:
                for i, j in zip(p.tolist(), q.tolist()):
                    try_link(i, j)
                continue
            below = len(levels[level - 1][0])
            i, j = (np.repeat(p, FAN * FAN) * FAN + np.tile(np.repeat(np.arange(FAN), FAN), len(p)), np.repeat(q, FAN * FAN) * FAN + np.tile(np.arange(FAN), FAN * len(q)))
            keep = (i < below) & (j < below) & (i <= j) & ((i < j) | (level > 1))
            visit(level - 1, np.stack((i[keep], j[keep]), 1))

    if len(sets) > 1:
        visit(len(levels) - 1, np.array([[0, 0]]))
    return links


def _join_blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Components of the links in each task's rows (task, side, doc_id, label, shingles): (least id, member)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids = table.column("doc_id").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        side = table.column("side").to_numpy()
        links = signature_join(sets, table.column("label").to_numpy(), num, den, None if (side == side[0]).all() else side == 1)
        forest = _Forest(np.arange(len(ids)))
        for a, b in links:
            ra, rb = forest.find(a), forest.find(b)
            forest.up[max(ra, rb)] = min(ra, rb)
        roots = forest.roots()  # rows are in order of id, so that a root is its component's least
        moved = np.flatnonzero(roots != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[roots[moved]], pa.int64()), "b": pa.array(ids[moved], pa.int64())})

    return rows.select("task", "side", "doc_id", "label", "shingles").groupBy("task").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id): documents linked when Jaccard >= num / den, and all they reach.

    Words are split at ASCII white space with A-Z lowered; a text of fewer words than ``size`` is one
    shingle, one without words links with nothing. Documents with the same set are represented by the
    smallest id. An exchange tells each representative which of its shingles any other holds and in
    about how many chunks (``LEVELS``), and ``rare_prefix`` how many of these, the rarest first, it needs
    as keys to meet whatever it is linked with: none, if too much of its text is its own. A key's place
    in that order bounds the size of a set that it may be the first common shingle with (``reach``).
    Documents that share a key within these bounds form candidate groups.

    Each group is joined by ``signature_join`` in blocks of about ``MEMBERS`` sets and ``MEMBER_BYTES``
    bytes; in a group of several blocks, members with the same least key share one where they can. It is joined first within blocks
    and by its components' smallest members, again until these no longer become fewer. Of the keys that
    still join two components, documents outside a key's largest component visit the other blocks that
    hold it in sets of a size within the bounds, in parts of about ``MEMBERS`` visitors; its largest component stays where it is.

    Rows that repeat an id are one document if their sets are equal (``text_key``, xxhash64 of the text,
    tells them apart); a null id is its own component; an empty table gives none.
    Memory is bounded by block, and no step writes all pairs of a group.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialise(set_prints(rows, size), "prints")
    kinds = prints.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("p1", "p2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    kinds = materialise(kinds, "kinds")
    reps = rows.join(kinds.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    chunks = ex.chunk_table(reps, size_of=CHUNK)
    n_buckets = ex.buckets_for(chunks, CHUNK // 6)

    def asked(ids, texts):
        doc, shingles = shingle_sets(texts, size)
        return shingles, doc, None

    def candidates(batches):
        for batch in batches:
            for data, answers in zip(batch.column(0), batch.column(1)):
                ids, texts = ex.open_chunk(data.as_py())
                doc, shingles = shingle_sets(texts, size)
                distinct, answer = ex.Distinct(shingles, n_buckets), answers.as_py()
                shared, *more = (ex.bits_of(distinct, answer, k, 1 + len(LEVELS)) for k in range(1 + len(LEVELS)))
                level = np.sum(more, axis=0)
                n = np.bincount(doc, minlength=len(texts))
                others = np.bincount(doc[shared], minlength=len(texts))
                first = rare_prefix(n, others, num, den)
                found, cuts = np.flatnonzero(first), np.concatenate(([0], np.cumsum(n)))
                own = [slice(cuts[i], cuts[i + 1]) for i in found]
                rarest = [np.lexsort((shingles[x], level[x], ~shared[x]))[: first[i]] for i, x in zip(found, own)]
                keys = [shingles[x][k].view(np.int64) for x, k in zip(own, rarest)]
                # sets with this key as their first common shingle have at most the shared ones from it on in common
                reach = [(others[i] - np.arange(first[i])) * (num + den) // num - n[i] for i in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[found], pa.int64()), pa.array(n[found], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, reach)), pa.array(8 * n[found], pa.int64()), pa.array([np.sort(shingles[x]).tobytes() for x in own], pa.binary())],
                    ["doc_id", "n", "keys", "reach", "size", "shingles"],
                )

    answered = ex.answered(chunks, ex.found_elsewhere(ex.send(chunks, asked, n_buckets, False), False, LEVELS))
    near = materialise(answered.select("data", "answers").mapInArrow(candidates, "doc_id long, n long, keys array<long>, reach array<long>, size long, shingles binary"), "near")
    keyed = near.select("doc_id", "n", F.inline(F.arrays_zip("keys", "reach"))).withColumnRenamed("keys", "key")

    def fits(low, high, reach):
        """Whether a set may link, by a key, with one of ``low`` to ``high`` shingles and a reach up to ``reach``."""
        return (F.col("reach") >= low) & (reach >= F.col("n")) & (high * den >= F.col("n") * num) & (low * num <= F.col("n") * den)

    hubs = keyed.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("held"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("farthest"), F.sum("n").alias("all_n"), F.sum("reach").alias("all_reach"))
    other_n, other_reach = F.col("all_n") - F.col("n"), F.col("all_reach") - F.col("reach")
    meets = F.when(F.col("held") == 2, fits(other_n, other_n, other_reach)).otherwise(fits(F.col("low"), F.col("high"), F.col("farthest")))
    keyed = materialise(keyed.join(hubs.where("held > 1"), "key").where(meets).select("key", "doc_id", "n", "reach", "hub"), "held-keys")
    groups = components(keyed.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).where("a <> b"))
    groups = groups.select(F.col("label").alias("grp"), F.col("node").alias("doc_id")).join(keyed.groupBy("doc_id").agg(F.min("key").alias("least")), "doc_id")

    def blocked(found: DataFrame) -> DataFrame:
        """With ``own``: the block of each member of (grp, doc_id, least, size), and whether its group has more.

        Members with the same least key, which those with most in common have, share a block; where
        they are too many they have several, and where they are few they share it with others.
        """
        blocks_in = lambda n, size: F.ceil(F.greatest(n / MEMBERS, size / MEMBER_BYTES))
        kin = found.groupBy("grp", "least").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumn("n_blocks", blocks_in(F.col("n"), F.col("bytes")))
        few = F.col("n_blocks") == 1
        whole = kin.groupBy("grp").agg((blocks_in(F.sum("n"), F.sum("bytes")) > 1).alias("several"), blocks_in(F.sum(F.when(few, F.col("n"))), F.sum(F.when(few, F.col("bytes")))).alias("n_mixed"))
        own = F.when(~F.col("several"), F.lit(0).cast("long")).when(few, F.pmod(F.xxhash64("least"), F.col("n_mixed"))).otherwise(F.xxhash64("least", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks"))))
        return found.join(kin.select("grp", "least", "n_blocks"), ["grp", "least"]).join(whole, "grp").select("grp", "doc_id", "least", "several", own.alias("own"))

    placed = materialise(blocked(groups.join(near.select("doc_id", "size"), "doc_id")), "blocks")
    members = near.select("doc_id", "size", "shingles").join(placed, "doc_id")

    def in_blocks(found: DataFrame) -> DataFrame:
        return _join_blocks(found.select(F.concat_ws(":", "grp", "own").alias("task"), F.lit(0).alias("side"), "doc_id", "label", "shingles"), num, den)

    links = materialise(in_blocks(members.withColumn("label", F.col("doc_id"))), "links")
    several = materialise(members.where("several"), "several")
    count = several.count()
    while True:
        labels = components(links).withColumnsRenamed({"node": "doc_id"})
        state = several.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        first_of = state.where("doc_id = label").drop("own", "several")
        before, count = count, first_of.count()
        if 2 * count >= before:
            break
        links = materialise(links.union(in_blocks(first_of.join(blocked(first_of.drop("shingles", "label")).drop("least"), ["grp", "doc_id"]))), "links")

    held = keyed.drop("hub").join(state.select("doc_id", "grp", "label", "own"), "doc_id")
    sides = held.groupBy("key", "label").agg(F.count("*").alias("n"), F.collect_set("own").alias("blocks"))
    keys = sides.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("n"), F.max_by("blocks", F.struct("n", "label")).alias("most_blocks")).where("n > 1")
    sizes = held.groupBy("key", "own").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("farthest"))
    sizes = sizes.groupBy("key").agg(F.collect_list(F.struct("own", "low", "high", "farthest")).alias("blocks")).where("size(blocks) > 1")
    # written, so that a hot key's rows in the join below can be dealt to several tasks
    keys = materialise(keys.join(sizes, "key").select("key", "most", "blocks", "most_blocks"), "open-keys")
    opened = held.join(keys, "key")
    # of two documents outside the largest component, the one in the lesser block visits the other
    goes = F.filter("blocks", lambda b: ((b["own"] > F.col("own")) | (b["own"] != F.col("own")) & F.array_contains("most_blocks", b["own"])) & fits(b["low"], b["high"], b["farthest"]))
    visitors = opened.where("label <> most").select("doc_id", "grp", F.explode(F.transform(goes, lambda b: b["own"])).alias("block")).distinct()
    visitors = materialise(visitors, "visitors")
    tables = visitors.groupBy("grp", "block").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    guests = visitors.join(tables, ["grp", "block"]).select("doc_id", "grp", "block", part.alias("part"), F.lit(1).alias("side"))
    hosts = opened.select("doc_id", "grp", F.col("own").alias("block")).distinct().join(tables, ["grp", "block"])
    hosts = hosts.select("doc_id", "grp", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"))
    met = hosts.union(guests).select("doc_id", F.concat_ws(":", "grp", "block", "part").alias("task"), "side")
    links = materialise(links.union(_join_blocks(met.join(state.select("doc_id", "label", "shingles"), "doc_id"), num, den)), "links")
    joined = components(links).select(F.col("node").alias("rep"), "label")
    kinds = kinds.join(joined, "rep", "left").select("p1", "p2", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    found = prints.join(kinds, ["p1", "p2", "n_shingles"], "left")
    return found.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def op7_jaccard_join(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), size=4, num=85, den=100).drop("text_key")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS pos FROM w),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[pos : pos + 3], ' ')) AS shingle FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * both_have >= 85 * (nx.n + ny.n - both_have)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, other) AS (SELECT x, x FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(other) FROM r WHERE r.doc_id = w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""
