"""N-gram Jaccard join: candidates by prefix filters under several global token orders.

A document is the set of its distinct word shingles, as 64-bit hashes. If two sets reach the
similarity, their prefixes share tokens under every global order of tokens. Two unrelated
orders are used: documents whose prefix shares too little under the first are out; what is
left is filtered under the second, whose shared tokens are then taken rarest first; a pair
that meets there must share enough 32-bit halves of its hashes, then enough of the first
order's prefix, before it is verified. Whole hashes are sent only for what is left.

Equal sets are one class from the start. A bucket's most central set is compared with all
others of the bucket. Pairs that are then in different components are compared in blocks,
inside tasks, and only links that join components leave them: a large group of near copies
costs a few rows per member, and no link that matters to a component is lost.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import stage
from .common import LOWER, Bloom

_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xC2B2AE3D27D4EB4F)
#: Odd factor that turns the first order (by hash) into the second.
_SECOND = np.uint64(0xD6E8FEB86659FD93)
CHUNK = 512


@dataclass(frozen=True)
class Settings:
    """Sets link when 100 * intersection >= percent * union. Prefixes are longer than they must
    be by one in `slack` tokens, so that many shared tokens can be asked for."""

    shingle: int = 5
    percent: int = 80
    slack: int = 20
    token_log_bits: int = 26
    doc_log_bits: int = 24

    def least(self, n):
        """Smallest intersection of a set of size n with any partner."""
        return -(-self.percent * n // 100)

    def prefix(self, n):
        return n - self.least(n) + 1 + n // self.slack

    def shared(self, n):
        """Prefix tokens shared with any partner, at least (the partner may be smaller)."""
        return 1 + self.least(n) // self.slack


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_WORDS = _Words()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x * _END
    x ^= x >> np.uint64(32)
    x *= _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text (A-Z lower-cased); a text of fewer words
    is one shingle, one without words has none."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    n = len(h) - k + 1
    x = h[:n] + np.uint64(k)
    for i in range(1, k):
        x = _scramble(x) + h[i : i + n]
    return np.unique(_scramble(x))


def second_order(tokens: np.ndarray) -> np.ndarray:
    """Tokens in the second order."""
    key = tokens * _SECOND
    key ^= key >> np.uint64(33)
    return tokens[np.argsort(key * _MIX, kind="stable")]


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def summaries(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n, digest of the set, and its prefix in the first order."""

    def rows(batches):
        for batch in batches:
            n, digest, prefix = [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text, s.shingle)
                n.append(len(own))
                digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                prefix.append(own[: s.prefix(len(own))].copy())  # a view would hold the whole set
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _longs(prefix)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "digest", "prefix"])

    own = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(rows, "doc_id long, n long, digest binary, prefix array<long>")


def _each(parts: list, then=lambda batch: batch) -> DataFrame:
    """(node, n, tokens): `then` after each part's own function, batch by batch in one Python worker."""

    def rows(own):
        return lambda batches: (then(own(batch)) for batch in batches)

    made = [df.mapInArrow(rows(own), "node long, n long, tokens array<long>") for df, own in parts]
    return reduce(DataFrame.unionByName, made)


def _only_known(parts: list, bloom: Bloom) -> DataFrame:
    """(node, n, tokens) of `parts` with the tokens that may be in the filter."""
    sent = parts[0][0].sparkSession.sparkContext.broadcast(bloom)

    def keep(batch):
        lists = batch.column(2)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.r_[0, lists.value_lengths().to_numpy(zero_copy_only=False)]).astype(np.int64)
        known = sent.value.has(values)
        left = np.r_[0, np.cumsum(known)][ends].astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(left), pa.array(values[known]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], ["node", "n", "tokens"])

    return _each(parts, keep)


def _needed(s: Settings):
    """Columns for the least shared prefix tokens of a set of size n."""
    least = F.floor((F.col("n") * s.percent + 99) / 100)
    return 1 + F.floor(least / s.slack)


def shared_tokens(parts: list, s: Settings) -> DataFrame:
    """(node, n, token, df, s) for tokens in the prefixes of two or more sets, for the nodes that
    have as many of them, s, as any partner asks for.

    `parts` are pairs of a table (node, n, tokens) and a function that makes prefixes of its batches.

    Tokens are counted with a map-side combine; the few that are shared go into a Bloom filter
    of fixed size, so that hardly any others reach the exact join.
    """
    counts = _each(parts).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    counts = stage(counts.where("df > 1"), "shared")
    known = _only_known(parts, Bloom.of(counts.select("token"), s.token_log_bits))
    hits = known.select("node", "n", F.explode("tokens").alias("token")).join(counts, "token")
    own = Window.partitionBy("node", "n")  # no more rows than a prefix has
    return hits.withColumn("s", F.count(F.lit(1)).over(own)).where(F.col("s") >= _needed(s)).select("node", "n", "token", "df", "s")


def full_sets(docs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """(node, n, all tokens in the first order) of documents in `nodes`.

    Texts are read again and looked up in a Bloom filter, so they are not shuffled; documents
    that pass it by chance only add work.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Bloom.of(nodes.select("node"), s.doc_log_bits))

    def rows(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            picked = np.flatnonzero(sent.value.has(ids) & batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            sets = [shingles(batch.column(1)[i].as_py(), s.shingle) for i in picked]
            some = [(i, x) for i, x in zip(picked, sets) if len(x)]
            cols = [pa.array([int(ids[i]) for i, _ in some], pa.int64()), pa.array([len(x) for _, x in some], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, _longs([x for _, x in some])], ["node", "n", "tokens"])

    own = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(rows, "node long, n long, tokens array<long>")


def second_prefixes(s: Settings):
    """Function that turns batches of (node, n, tokens) into those with the prefix in the second order."""

    def prefixes(batch):
        lists = batch.column(2)
        values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum(np.r_[0, lists.value_lengths().to_numpy(zero_copy_only=False)])
        second = [second_order(values[i:j])[: s.prefix(j - i)] for i, j in zip(ends, ends[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _longs(second)], ["node", "n", "tokens"])

    return prefixes


def sets_of(nodes: DataFrame, sets: DataFrame, s: Settings, halves: bool = False) -> DataFrame:
    """The `sets` whose node is in `nodes`, and a few others: what no join needs is not shuffled.

    `halves` gives the leading 32 bits of each token only.
    """
    sent = sets.sparkSession.sparkContext.broadcast(Bloom.of(nodes.select("node"), s.doc_log_bits))

    def keep(batches):
        for batch in batches:
            batch = batch.filter(pa.array(sent.value.has(batch.column(0).to_numpy(zero_copy_only=False))))
            if halves:
                lists = batch.column(1)
                ends = np.cumsum(np.r_[0, lists.value_lengths().to_numpy(zero_copy_only=False)]).astype(np.int32)
                lead = (lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(lead.view(np.int32)))
                batch = pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "tokens"])
            yield batch

    return sets.select("node", "tokens").mapInArrow(keep, f"node long, tokens array<{'int' if halves else 'long'}>")


def verify(pairs: DataFrame, sets: DataFrame, s: Settings, halves: bool = False) -> DataFrame:
    """The pairs (a, b) whose sets link or, from `halves` of their tokens only, may link.

    Rows of a popular `a` are cut into chunks; a chunk's task reads the set of `a` once and
    then streams those of its partners.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("salt"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    own = sets_of(nodes, sets, s, halves)
    test, kind = (may_link, np.uint32) if halves else (linked, np.uint64)
    firsts = many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("salt"))
    firsts = firsts.join(own, firsts.a == own.node).select("a", "salt", F.lit(None).cast("long").alias("b"), "tokens")
    others = salted.join(own, salted.b == own.node).select("a", "salt", "b", "tokens")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = firsts.unionByName(others).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def check(batches):
        key, held = None, []
        for batch in batches:
            found = []
            lists = batch.column(3)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(kind)
            ends = np.cumsum(np.r_[0, lists.value_lengths().to_numpy(zero_copy_only=False)])
            for i, (a, salt, b) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)))):
                own = values[ends[i] : ends[i + 1]]
                if b is None:
                    held = [*held, own.copy()] if key == (a, salt) else [own.copy()]
                    key = (a, salt)
                elif any(test(x, own, s) for x in held):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"]
            )

    return rows.mapInArrow(check, "a long, b long").distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def linked(x: np.ndarray, y: np.ndarray, s: Settings) -> bool:
    """Exact test on sorted sets, after the filters of sizes and of the first order's prefixes."""
    nx, ny = len(x), len(y)
    if min(nx, ny) * 100 < s.percent * max(nx, ny):
        return False
    if _common(x[: s.prefix(nx)], y[: s.prefix(ny)]) < min(1 + nx // s.slack, 1 + ny // s.slack):
        return False
    both = _common(x, y)
    return 100 * both >= s.percent * (nx + ny - both)


def may_link(x: np.ndarray, y: np.ndarray, s: Settings) -> bool:
    """Necessary for a link, from sorted halves of tokens: equal tokens have equal halves."""
    nx, ny = len(x), len(y)
    if min(nx, ny) * 100 < s.percent * max(nx, ny):
        return False
    at = np.searchsorted(y, x)
    at[at == ny] = 0
    most = int(np.count_nonzero(y[at] == x))
    return 100 * most >= s.percent * (nx + ny - most)


def components(links: DataFrame) -> DataFrame:
    """(node, comp): smallest node that each linked node reaches over `links` (a, b).

    Every round hooks each component to its smallest neighbour, jumps once and contracts; the
    components with links left at least halve.
    """
    both = links.select("a", "b").where("a <> b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = stage(both, "edges")
    labels = stage(edges.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    while not edges.isEmpty():
        hook = edges.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("comp"), F.least("a", "to").alias("to"))
        hook = stage(hook, "hooks")
        jump = hook.select(F.col("comp").alias("to"), F.col("to").alias("next"))
        hook = stage(hook.join(jump, "to").select("comp", F.col("next").alias("to")), "jumps")
        labels = labels.join(hook, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        labels = stage(labels, "labels")
        ends = [hook.select(F.col("comp").alias(c), F.col("to").alias(f"{c}2")) for c in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        edges = stage(moved.where("a <> b").distinct(), "edges")
    return labels


def one_a_class(named: DataFrame, copies: DataFrame, s: Settings) -> list:
    """Parts for `shared_tokens`: each digest of `named` (doc_id, n, digest, prefix) once.

    Only documents in a Bloom filter of those with equal sets are grouped; the prefixes of
    all others, which are alone in their class, stay where they are.
    """
    same = named.select("doc_id", "digest").join(copies.select("digest"), "digest", "left_semi")
    sent = named.sparkSession.sparkContext.broadcast(Bloom.of(same.select("doc_id"), s.doc_log_bits))

    def marked(batch):
        return pa.array(sent.value.has(batch.column(0).to_numpy(zero_copy_only=False)))

    def pick(batches):
        for batch in batches:
            yield batch.filter(marked(batch))

    def alone(batch):
        return batch.filter(pc.invert(marked(batch)))

    kind = "doc_id long, n long, digest binary, prefix array<long>"
    grouped = named.select("doc_id", "n", "digest", "prefix").mapInArrow(pick, kind).groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("tokens")
    )
    grouped = stage(grouped.select("node", "n", "tokens"), "classes")
    single = named.select(F.col("doc_id").alias("node"), "n", F.col("prefix").alias("tokens"))
    return [(single, alone), (grouped, lambda batch: batch)]


def near_links(docs: DataFrame, classes: list, s: Settings) -> DataFrame:
    """Links (a, b) between classes, given as parts, that make them the components they form."""
    first = shared_tokens(classes, s)
    first = stage(first.select("node").distinct(), "first")
    sets = stage(full_sets(docs, first, s), "sets")
    second = shared_tokens([(sets, second_prefixes(s))], s)
    # rarest first, as many as the filter asks for; an average df tells how central a set is
    own = Window.partitionBy("node", "n")
    ranked = second.withColumns({"r": F.row_number().over(own.orderBy("df", "token")), "c": F.sum("df").over(own) / F.col("n")})
    rows = stage(ranked.where(F.col("r") <= F.col("s") - _needed(s) + 1).select("node", "n", "token", "c"), "buckets")
    leaders = rows.groupBy("token").agg(F.max(F.struct("c", F.negative("node").alias("k"))).alias("x"))
    met = rows.join(leaders.select("token", F.negative("x.k").alias("leader")), "token").where("node <> leader")
    met = stage(met.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "met")
    links = stage(verify(stage(verify(met, sets, s, halves=True), "near"), sets, s), "links")
    return links.unionByName(settle(met, components(links), sets, s))


def settle(met: DataFrame, comp: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links between members of a leader's group that are still in different components.

    Two texts that share a bucket were both met (a, b) by its leader a, so they are members of
    one group; groups whose leaders are linked are one. A group is cut into chunks by hash, and
    each pair of chunks is a block that a task compares in memory. Only links that join
    components go out, fewer than a block has members.
    """
    by_b = comp.select(F.col("node").alias("b"), F.col("comp").alias("own"))
    by_a = comp.select(F.col("node").alias("a"), F.col("comp").alias("led"))
    members = met.join(by_b, "b", "left").join(by_a, "a", "left")
    members = members.select(F.coalesce("led", "a").alias("key"), "b", F.coalesce("own", "b").alias("own")).distinct()
    members = stage(members, "members")
    stats = members.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.ceil(F.count(F.lit(1)) / CHUNK).alias("k"))
    live = members.join(stats.where("lo < hi").select("key", "k"), "key")
    live = live.withColumn("i", F.pmod(F.xxhash64("b"), F.col("k")))
    live = stage(live, "live")
    blocks = live.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    blocks = blocks.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "b", "own")
    own = sets_of(live.select(F.col("b").alias("node")), sets, s)
    rows = blocks.join(own.select(F.col("node").alias("b"), "tokens"), "b").select("key", "lo", "hi", "i", "b", "own", "tokens")
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(batches):
        key, block = None, []
        for batch in batches:
            found = []
            tokens = batch.column(6)
            values = tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(np.r_[0, tokens.value_lengths().to_numpy(zero_copy_only=False)])
            for r, (k, lo, hi, i, b, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)))):
                if key != (k, lo, hi):
                    found += block_links(block, key, s)
                    key, block = (k, lo, hi), []
                block.append((i, b, own, values[ends[r] : ends[r + 1]].copy()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
        found = block_links(block, key, s)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def block_links(block: list[tuple[int, int, int, np.ndarray]], key, s: Settings) -> list[tuple[int, int]]:
    """Links that join components among the (chunk, node, component, set) rows of a block.

    Intersections are counted through the block's inverted lists, one set against all at once.
    """
    if len({own for _, _, own, _ in block}) < 2:
        return []
    chunk, node, own = (np.array([r[c] for r in block], np.int64) for c in range(3))
    sizes = np.array([len(r[3]) for r in block], np.int64)
    tokens = np.concatenate([r[3] for r in block])
    holder = np.repeat(np.arange(len(block)), sizes)
    order = np.argsort(tokens, kind="stable")
    _, code, count = np.unique(tokens, return_inverse=True, return_counts=True)
    lists = holder[order]
    starts = np.r_[0, np.cumsum(count)]
    ends = np.r_[0, np.cumsum(sizes)]
    across = key[1] != key[2]
    parent = {int(c): int(c) for c in np.unique(own)}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    found = []
    for r in range(len(block)):
        if across and chunk[r] != key[1]:
            continue  # rows of one chunk against all of the other
        codes = code[ends[r] : ends[r + 1]]
        n = count[codes]
        at = np.repeat(starts[codes] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
        both = np.bincount(lists[at], minlength=len(block))
        hit = (100 * both >= s.percent * (sizes[r] + sizes - both)) & (own != own[r])
        for q in np.flatnonzero(hit).tolist():
            x, y = root(int(own[r])), root(int(own[q]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((int(node[r]), int(node[q])))
    return found


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id reachable by links, itself included. A null or blank
    text has an empty set and no links. A doc_id on several rows is one document: rows keep
    their own n_shingles, links of either text count for both. A null doc_id links with
    nothing and has a null component. Other columns are not read; an empty table gives an
    empty result; texts are whole. Sets are compared by 64-bit hashes of their shingles.
    """
    s = settings or Settings()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = stage(summaries(docs, s), "summaries")
    named = seen.where("doc_id is not null and n > 0")
    copies = named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("k"))
    copies = stage(copies.where("k > 1").select("digest", "node"), "copies")
    rows = stage(seen.select("doc_id", "n", "digest").join(copies, "digest", "left"), "rows")
    rows = rows.select("doc_id", "n", "digest", F.coalesce("node", "doc_id").alias("node"))
    # a doc_id of several texts holds their classes together
    twice = rows.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    twice = rows.join(twice.where("lo < hi").select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = near_links(docs, one_a_class(named, copies, s), s).unionByName(twice)
    comp = components(links)
    # a class that is not linked keeps its node; n = 0 rows have their own doc_id as node
    return rows.join(comp, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("component_id")
    )
