"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

1. Each document becomes its set of five-word shingles, a MinHash signature and
   a 128-bit key of the set.  Documents with equal sets are one class of copies
   and go on as one representative, which has a number of its own (its node).
2. Every tree of the forest labels a representative by ``DEPTH`` of its minima;
   sorted labels are a prefix trie.  ``measured_depth`` starts from whole labels and
   shortens the matched prefix until sampled sets of the corpus meet partners at
   exactly the threshold with the target recall.  Trie nodes at that depth are the
   groups; inside one, deeper prefixes are matched first and the walk stops as
   soon as the node is one cluster.  Pairs whose signatures agree far too little
   are not joined (``SLACK`` standard errors; the measured recall counts that loss).
   A node of more than ``BLOCK`` members is not compared pair by pair: its members go
   to ``MORE`` further trees, each of ``DEPTH`` minima picked from all of the signature,
   which near copies meet in as often as the recall asks and others hardly ever.  A
   node of these that is still too large is dealt in blocks, each with the node's least
   member, so that the candidates of m near copies take time in proportion to m.
3. What the forest loses (pairs that meet in no tree, and those that its blocks or
   signatures part) comes back exactly: two sets of at least the threshold share one of
   the first few shingles of each, in whatever order all sets are sorted (``prefixes``).
   Sets of different components that share so many of these that, with all that may
   follow, the threshold can be reached, are compared as sets (``missed``), and the links found join
   their components.  The order puts shingles that a sample holds often last, which
   only saves work.
4. Connected candidates are gathered, and *all* pairs among them verified by
   exact shingle sets, in blocks.  Counts and a spanning forest leave a block,
   never its pairs.
5. Verified links form the classes.

A group of candidates of any size is dealt in blocks of bounded size, by members and by
shingles: it becomes the pairs of its blocks, spread over tasks, so the work on m *different*
near copies of one text grows with their pairs, whose links must be counted, while
what is shuffled are shingle hashes, once for each block that a member meets.
Equal sets count once.  Hot keys (a trie node, a class, a set with many copies)
are joined by ``graph.attach``, which shuffles none of their rows.  No row is
dropped or capped.  Nothing that grows with the documents is collected or
broadcast.

Defined cases: ids are integers.  Texts without words (null, empty) have equal,
empty sets and are copies of each other.  A text of one to four words has one
shingle.  Rows with one id and equal sets are one document; rows with one id and
different sets are documents of their own, each with its own links.  A null id
has no links and a null class.  Very long texts are single members of a block.
Other columns are ignored, whatever their names; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import graph, vec

TREES, DEPTH, RECALL, SLACK = 12, 8, 0.995, 4.0
#: Further trees for members of large nodes: 1 - (1 - 0.8 ** 8) ** 32 = 0.997 of pairs at 0.8 meet in them.
MORE = 32
#: Members of a block in the forest; members and shingles of a block in the verification.
BLOCK, EXACT_BLOCK, EXACT_SHINGLES = 4096, 1024, 1 << 19
#: Documents of the sample that recall is measured on (expected number), and partners of each.
SAMPLE, PARTNERS = 1000, 8
#: Documents of the sample that common shingles are taken from (expected number), and how many of them hold a common one.
COMMON_SAMPLE, COMMON = 20_000, 3
#: First shingles of a batch that leaves Python.
PIECE = 1 << 16

_K = TREES * DEPTH
_RNG = np.random.default_rng(5150)
_A = _RNG.integers(1, 2**62, _K, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**62, _K, dtype=np.int64).astype(np.uint64)
#: The minima of each tree: runs of the signature, then picks from all of it.
_COLUMNS = [np.arange(t * DEPTH, (t + 1) * DEPTH) for t in range(TREES)] + [np.sort(_RNG.permutation(_K)[:DEPTH]) for _ in range(MORE)]


def least_agreement(threshold: float) -> float:
    """Share of equal minima below which a pair is not joined."""
    return threshold - SLACK * (threshold * (1 - threshold) / _K) ** 0.5


def met_depths(values: np.ndarray, threshold: float, seed: int) -> list[int]:
    """Longest prefix on which a set and partners of similarity ``threshold`` meet in some tree.

    A partner shares all but as many values as the threshold allows.  A pair whose
    signatures agree too little to be joined meets at 0.  Sets too small to differ
    at this similarity have no partners.
    """
    n = len(values)
    changed = int(n * (1 - threshold) / (1 + threshold) + 1e-9)
    if not changed:
        return []
    rng, sets = np.random.default_rng(seed), [values]
    for _ in range(PARTNERS):
        keep = rng.permutation(n)[changed:]
        sets.append(np.concatenate([values[keep], rng.integers(0, 2**63, changed, dtype=np.int64).astype(np.uint64)]))
    sig = signatures(np.concatenate(sets), np.arange(len(sets) + 1) * n)
    same = sig[1:] == sig[0]
    depth = np.cumprod(same.reshape(PARTNERS, TREES, DEPTH), axis=2).sum(2).max(1)
    return np.where(same.mean(1) >= least_agreement(threshold), depth, 0).tolist()


def measured_depth(df: DataFrame, threshold: float, *, id_col: str = "id", text_col: str = "text", recall: float = RECALL, sample: int = SAMPLE) -> int:
    """Longest prefix on which at least this share of sampled pairs at the threshold meet.

    About ``sample`` documents are picked by a hash of the id; tasks return counts by
    depth, so the driver gets DEPTH + 1 rows.  Without a pair the prefix is 1.
    """
    total = df.select(id_col).count()
    bound = min(1 << 30, int(sample / max(total, 1) * (1 << 30)) + 1)
    picked = df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(23)), F.lit(1 << 30)) < bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(DEPTH + 1, np.int64)
        for batch in batches:
            data, offs = vec.text_buffers(batch.column(0))
            for i, j in vec.spans(offs, 1_000_000):
                values, at = vec.shingles(vec.tokenise(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    np.add.at(met, met_depths(values[a:b], threshold, int(values[a] % np.uint64(1 << 32)) if b > a else 0), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(DEPTH + 1), pa.int64()), pa.array(met)], ["depth", "n"])

    met = np.zeros(DEPTH + 1)
    for depth, n in picked.select(text_col).mapInArrow(vec.lean(run), "depth long, n long").groupBy("depth").agg(F.sum("n")).collect():
        met[depth] = n
    reached = met[::-1].cumsum()[::-1]  # pairs that meet at this depth or deeper
    depth = DEPTH
    while depth > 1 and reached[depth] < recall * reached[0] or depth > 1 and not reached[0]:
        depth -= 1
    return depth


def signatures(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """MinHash signatures, a row for each document; empty sets have the largest values."""
    out = np.full((len(offs) - 1, _K), np.iinfo(np.uint32).max, np.uint32)
    some = np.flatnonzero(np.diff(offs) > 0)
    if len(some):
        at = offs[some]
        for k in range(_K):
            x = values * _A[k]
            x += _B[k]
            x >>= np.uint64(32)
            out[some, k] = np.minimum.reduceat(x, at)
    return out


def labels(sig: np.ndarray, trees: range, depth: int) -> np.ndarray:
    """The node at a depth of each of these trees, a row for each signature."""
    out = np.zeros((len(sig), len(trees)), np.int64)
    for k, t in enumerate(trees):
        h = np.full(len(sig), t + 1, np.uint64)
        for c in _COLUMNS[t][:depth]:
            h = vec.mix(h ^ sig[:, c])
        out[:, k] = h.view(np.int64)
    return out


def more_labels(df: DataFrame) -> DataFrame:
    """(node, tree, g) of rows (node, sig): their nodes in the further trees."""
    trees = range(TREES, TREES + MORE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, _K)
            nodes = labels(sig, trees, DEPTH)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), MORE)), pa.array(np.tile(np.array(trees, np.int32), len(sig))), pa.array(nodes.ravel())], ["node", "tree", "g"])

    return df.select("node", "sig").mapInArrow(vec.lean(run), "node long, tree int, g long")


def common_shingles(df: DataFrame, sample: int = COMMON_SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that ``COMMON`` sampled rows (id, text) or more hold, and their numbers."""
    total = df.select("id").count()
    bound = min(1 << 30, int(sample / max(total, 1) * (1 << 30)) + 1)
    picked = df.where(F.pmod(F.xxhash64(F.col("id"), F.lit(29)), F.lit(1 << 30)) < bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = vec.text_buffers(batch.column(0))
            for i, j in vec.spans(offs, 1_000_000):
                values, _ = vec.shingles(vec.tokenise(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], ["token"])

    found = picked.select("text").mapInArrow(vec.lean(run), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).toArrow()
    tokens, n = (found.column(c).to_numpy() for c in ("token", "n"))
    order = np.argsort(tokens.view(np.uint64))
    return tokens.view(np.uint64)[order], n[order]


def prefix(values: np.ndarray, threshold: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of a set of which any set of at least this similarity shares one of its own.

    Sorted rare ones first, then by hash; as many as the partner can't all lack.
    """
    tokens, counts = common
    often = np.zeros(len(values), np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, values), len(tokens) - 1)
        often = np.where(tokens[at] == values, counts[at], 0)
    kept = len(values) - int(np.ceil(threshold * len(values) - 1e-6)) + 1
    return values[np.lexsort((values, often))[:kept]]


def features(df: DataFrame, depth: int, threshold: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, h, key, n, sig, buckets, prefix) of rows (id, h, text): set key, shingle count, signature, trie nodes, first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = vec.text_buffers(batch.column(2))
            for i, j in vec.spans(offs, 1_000_000):
                values, at = vec.shingles(vec.tokenise(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                sig = signatures(values, at)
                keys = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                nodes = labels(sig, range(TREES), depth)
                listed = pa.ListArray.from_arrays(np.arange(0, TREES * (j - i) + 1, TREES, dtype=np.int32), pa.array(nodes.ravel()))
                first = [prefix(values[a:b], threshold, common).tobytes() if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                own = [batch.column(c).slice(i, j - i) for c in (0, 1)]
                made = [pa.array(keys, pa.binary()), pa.array(np.diff(at), pa.int64()), pa.array([s.tobytes() for s in sig], pa.binary()), listed, pa.array(first, pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *made], ["id", "h", "key", "n", "sig", "buckets", "prefix"])

    return df.select("id", "h", "text").mapInArrow(vec.lean(run), "id long, h long, key binary, n long, sig binary, buckets array<long>, prefix binary")


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, n, root, prefix) as one for each first shingle, in batches of at most about ``PIECE``.

    A batch of documents has a hundred times as many shingles, which neither side of the
    pipe to Python need hold at once.
    """
    for batch in batches:
        size = pc.divide(pc.binary_length(batch.column(3)), 8).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
            part = batch.slice(i, j - i)
            own = [np.repeat(part.column(c).to_numpy(), size[i:j]) for c in range(3)]
            tokens = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int64)
            for a in range(0, len(tokens), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + PIECE]) for x in (tokens, *own)], ["token", "node", "n", "root"])
            i = j


def prefixes(df: DataFrame) -> DataFrame:
    """(token, node, n, root) for each first shingle of rows (node, n, root, prefix)."""
    return df.select("node", "n", "root", "prefix").mapInArrow(vec.lean(spread), "token long, node long, n long, root long")


def missed(uniq: DataFrame, found: DataFrame, docs: DataFrame, threshold: float, scratch: graph.Scratch) -> DataFrame | None:
    """Links (a, b) of at least the threshold between sets of different components; None if there are none.

    ``found`` has the components (node, root); a set without one is its own.  Shingles
    whose sets are all of one component go first, counted before they are shuffled, so
    near copies cost a row for each of theirs.  Of what is left, pairs of one component
    are not made: one of a pair is outside of the shingle's largest.
    """
    since = len(scratch.paths)
    rooted = uniq.where("n > 0").join(found, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), "prefix")
    rooted = scratch.save(rooted)
    roots = prefixes(rooted).groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"))
    mixed = scratch.save(roots.where("lo < hi").select("token", "size"))
    if not mixed.limit(1).count():
        return None
    shared = scratch.save(graph.attach(graph.sift(prefixes(rooted), mixed, ["token"]), mixed, "token", "size"))
    scratch.clear(since)
    large = shared.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("token").agg(F.max_by("root", F.struct("m", "root")).alias("large"))
    b = shared.join(large, "token").where("root <> large").select("token", *(F.col(c).alias(f"b_{c}") for c in ("node", "n", "root")), "large")
    once = (F.col("root") == F.col("large")) | (F.col("node") < F.col("b_node"))
    sizes = F.least("n", "b_n") >= threshold * F.greatest("n", "b_n") - 1e-6
    met = shared.join(b, "token").where((F.col("root") != F.col("b_root")) & once & sizes).groupBy(F.least("node", "b_node").alias("a"), F.greatest("node", "b_node").alias("b"))
    met = met.agg(F.count(F.lit(1)).alias("both"), F.max(F.col("n") + F.col("b_n")).alias("sum"), F.max(F.greatest("n", "b_n")).alias("most"))
    rest = F.ceil(threshold * F.col("most") - 1e-6) - 1  # of the set whose first shingles end earlier, what is not among them
    pairs = scratch.save(met.where(F.col("both") + rest >= threshold / (1 + threshold) * F.col("sum") - 1e-6).select("a", "b"))
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = scratch.save(ends.join(uniq.select("node", "id", "h"), "node"))
    whole = graph.sift(docs.where("id is not null"), wanted, ["id", "h"]).groupBy("id", "h").agg(F.first("text").alias("text"))
    zero = [F.lit(0).cast("long").alias("g"), F.lit(0).alias("nb"), F.lit(0).cast("long").alias("copies")]
    values = scratch.save(sets(wanted.join(whole, ["id", "h"]).select("node", *zero, "text")).select("node", "values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and both >= threshold * (len(x) + len(y) - both) - 1e-6)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sides = pairs.join(values.select(F.col("node").alias("a"), F.col("values").alias("x")), "a").join(values.select(F.col("node").alias("b"), F.col("values").alias("y")), "b")
    links = scratch.save(sides.select("a", "b", "x", "y").mapInArrow(vec.lean(run), "a long, b long"))
    return links if links.limit(1).count() else None


def sets(df: DataFrame) -> DataFrame:
    """Rows (node, g, nb, copies, text) with the text as its shingle hashes (``values``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = vec.text_buffers(batch.column(4))
            for i, j in vec.spans(offs, 1_000_000):
                values, at = vec.shingles(vec.tokenise(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                made = [values[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(4)), pa.array(made, pa.binary())], ["node", "g", "nb", "copies", "values"])

    return df.select("node", "g", "nb", "copies", "text").mapInArrow(vec.lean(run), "node long, g long, nb int, copies long, values binary")


def _blocks(df: DataFrame) -> DataFrame:
    """Deal the members of each group (g, node, nb blocks) to the pairs (i, j) of its blocks."""
    df = df.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("nb")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = df.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("nb", "other")
    return dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "node")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _with_least(df: DataFrame) -> DataFrame:
    """Deal the members of each node (g, node, tree, nb blocks, hub) to its blocks; the hub, its least member, goes to all."""
    own = F.array(F.pmod(F.xxhash64("node", "g"), F.col("nb")).cast("int"))
    all_ = F.sequence(F.lit(0), F.col("nb") - 1)
    dealt = df.withColumn("i", F.explode(F.when(F.col("node") == F.col("hub"), all_).otherwise(own)))
    return dealt.repartition("g", "i").sortWithinPartitions("g", "i", "node")


def _walk(sig: np.ndarray, tree: int, depth: int, least: float) -> np.ndarray:
    """Cluster of each member of a trie node: deeper prefixes first.

    At each depth the members of a node that are not yet one cluster are compared
    by whole signatures, each member with those that no cluster of the node has
    reached; the walk ends when the whole node is one cluster.
    """
    m = len(sig)
    cluster = np.arange(m)
    label = sig[:, _COLUMNS[tree]]
    order = np.lexsort(label.T[::-1])
    sorted_label = label[order]
    for d in range(DEPTH, depth - 1, -1):
        change = np.any(sorted_label[1:, :d] != sorted_label[:-1, :d], axis=1)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), m]
        for a, b in zip(cuts[:-1], cuts[1:]):
            node = order[a:b]
            if len(node) < 2 or (cluster[node] == cluster[node[0]]).all():
                continue
            rest = node
            while len(rest):
                c = cluster[rest[0]]
                mine = cluster[rest] == c
                queue, rest = rest[mine].tolist(), rest[~mine]
                while queue and len(rest):
                    u = queue.pop()
                    near = (sig[rest] == sig[u]).mean(axis=1) >= least
                    if near.any():
                        got = np.unique(cluster[rest[near]])
                        joined = np.isin(cluster[rest], got)
                        queue += rest[joined].tolist()
                        rest = rest[~joined]
                        cluster[np.isin(cluster, got)] = c
        if (cluster == cluster[0]).all():
            break
    return cluster


def candidates(threshold: float, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (a, b) between members of a trie node that are one cluster, each to the least."""
    least = least_agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for g in _groups(batches, ["g", "i"]):
            ids = g.column("node").to_numpy()
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint32).reshape(len(ids), _K)
            tree = g.column("tree")[0].as_py()
            cluster = _walk(sig, tree, depth if tree < TREES else DEPTH, least)
            order = np.lexsort((ids, cluster))
            c, x = cluster[order], ids[order]
            head = np.ones(len(c), bool)
            head[1:] = c[1:] != c[:-1]
            hub = x[np.flatnonzero(head)[np.cumsum(head) - 1]]
            a.append(x[~head])
            b.append(hub[~head])
            if sum(map(len, a)) > 50_000 or len(a) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def overlaps(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Numbers of shared values between all pairs of sets."""
    m = len(offs) - 1
    doc = np.repeat(np.arange(m), np.diff(offs))
    order = np.argsort(values, kind="stable")
    v, doc = values[order], doc[order]
    same = np.zeros(len(v) + 1, bool)
    same[1:-1] = v[1:] == v[:-1]
    keep = same[1:] | same[:-1]
    v, doc = v[keep], doc[keep]
    out = np.zeros((m, m), np.float32)
    if len(v):
        column = np.zeros(len(v), np.int64)
        column[1:] = np.cumsum(v[1:] != v[:-1])
        width = max(64, min(8192, 8_000_000 // m))
        for c in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [c, c + width])
            x = np.zeros((m, width), np.float32)
            x[doc[a:b], column[a:b] - c] = 1
            out += x @ x.T
    return out


def verify(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exact links of each block pair: (node, hub, links, texts) for each member.

    ``hub`` is the least member of its cluster of links in this block pair, and
    the counts are of links that belong to this block pair alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in _groups(batches, ["g", "i", "j"]):
            ids, own, weight = (g.column(c).to_numpy() for c in ("node", "own", "copies"))
            raw = g.column("values").to_pylist()
            at = np.cumsum([0, *(len(x) // 8 for x in raw)])
            size = np.diff(at)
            both = overlaps(np.frombuffer(b"".join(raw), np.uint64), at)
            link = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
            link &= both > 0
            np.fill_diagonal(link, False)
            if (own != own[0]).any():  # pairs inside a block belong to that block
                link &= own[:, None] != own[None, :]
            elif g.column("i")[0].as_py() != g.column("j")[0].as_py():
                link[:] = False
            hub = np.arange(len(ids))
            seen = np.zeros(len(ids), bool)
            for s in np.argsort(ids, kind="stable").tolist():
                if not seen[s]:
                    seen[s], queue = True, [s]
                    while queue:
                        new = np.flatnonzero(link[queue.pop()] & ~seen)
                        seen[new], hub[new] = True, s
                        queue += new.tolist()
            out.append((ids, ids[hub], link @ weight, link.sum(1)))
            if len(out) > 2000 or len(ids) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["node", "hub", "links", "texts"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["node", "hub", "links", "texts"])

    return run


def join(df: DataFrame, *, threshold: float = 0.8, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: (id, class_id, n_links, n_copies, n_linked_texts, text_hash, class_hash).

    ``class_id`` is the least id of the rows joined by links of at least this
    Jaccard similarity, and ``class_hash`` the least hash of a text with that id in the
    class: together they name the class and its first document, also where rows with
    one id have different texts.  ``n_links`` counts the other documents that this one links
    with (copies too), ``n_copies`` those with an equal shingle set, and
    ``n_linked_texts`` the different sets among its links.
    """
    spark = df.sparkSession
    scratch = graph.Scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    depth = measured_depth(docs, threshold, recall=recall)
    feats = scratch.save(features(docs, depth, threshold, common_shingles(docs)))
    some = feats.where("id is not null")
    copies = some.select("key", "id").distinct().groupBy("key").agg(F.count("id").alias("copies"))
    first = some.groupBy("key").agg(F.min(F.struct("id", "h")).alias("first"), F.count("id").alias("size"), *(F.first(c).alias(c) for c in ("n", "sig", "buckets", "prefix")))
    uniq = scratch.save(first.join(copies, "key").select(F.monotonically_increasing_id().alias("node"), "key", "first.*", "size", "copies", "n", "sig", "buckets", "prefix"))

    nodes = scratch.save(uniq.where("n > 0").select("node", F.posexplode("buckets").alias("tree", "g")))
    sizes = scratch.save(nodes.groupBy("g").agg(F.count("node").alias("size")).where("size > 1"))
    if sizes.where(F.col("size") > BLOCK).limit(1).count():
        nodes = scratch.save(graph.attach(nodes, sizes, "g", "size"))
        many = nodes.where(F.col("size") > BLOCK).select("node").distinct().join(uniq.select("node", "sig"), "node")
        nodes = scratch.save(nodes.where(F.col("size") <= BLOCK).select("node", "tree", "g").unionByName(more_labels(many)))
    sizes = nodes.groupBy("g").agg(F.count("node").alias("size"), F.min("node").alias("hub")).where("size > 1")
    sizes = scratch.save(sizes.withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int")))
    members = graph.attach(nodes, sizes, "g", "size").select("node", "tree", "g", "nb", "hub").join(uniq.select("node", "sig"), "node")
    near = _with_least(members).select("g", "i", "node", "tree", "sig").mapInArrow(vec.lean(candidates(threshold, depth)), "a long, b long")
    found = graph.components(near, scratch)
    more = missed(uniq, found, docs, threshold, scratch)
    if more is not None:
        found = graph.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more), scratch)

    members = scratch.save(found.join(uniq.select("node", "id", "h", "n", "copies"), "node").withColumnRenamed("root", "g"))
    sizes = members.groupBy("g").agg(F.count("node").alias("size"), F.sum("n").alias("shingles"))
    sizes = scratch.save(sizes.select("g", "size", F.ceil(F.greatest(F.col("size") / EXACT_BLOCK, F.col("shingles") / EXACT_SHINGLES)).cast("int").alias("nb")))
    members = graph.attach(members, sizes, "g", "size").select("node", "g", "nb", "copies", "id", "h")
    members = scratch.save(members)
    whole = graph.sift(docs.where("id is not null"), members, ["id", "h"]).groupBy("id", "h").agg(F.first("text").alias("text"))  # others and repeated rows go before the shuffle
    dealt = _blocks(sets(members.join(whole, ["id", "h"])))
    links = scratch.save(dealt.select("g", "i", "j", "node", "own", "copies", "values").mapInArrow(vec.lean(verify(threshold)), "node long, hub long, links long, texts long"))
    classes = graph.components(links.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")), scratch)

    linked = scratch.save(classes.join(uniq.select("node", "id", "h"), "node"))
    least = scratch.save(linked.groupBy("root").agg(F.min(F.struct("id", "h")).alias("first"), F.count("node").alias("members")))
    linked = graph.attach(linked.select("node", "root"), least, "root", "members").select("node", "first")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    known = uniq.select("node", "key", "id", "h", "size", "copies").join(counts, "node", "left").join(linked, "node", "left")
    known = scratch.save(
        known.select("key", "size", F.coalesce("first.id", "id").alias("class_id"), F.coalesce("first.h", "h").alias("class_hash"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies"), F.coalesce("texts", F.lit(0)).alias("n_linked_texts"))
    )
    kept = graph.attach(some.select("id", F.col("h").alias("text_hash"), "key"), known, "key", "size").drop("key", "size")
    none = feats.where("id is null").select("id", F.col("h").alias("text_hash"), *(F.lit(None).cast("long").alias(c) for c in ("class_id", "class_hash")), *(F.lit(0).cast("long").alias(c) for c in ("n_links", "n_copies", "n_linked_texts")))
    out = scratch.save(kept.unionByName(none).withColumnRenamed("id", id_col))
    scratch.clear()
    return out


def keep(df: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document of each class of ``join``, by id and then by the text's hash, once; and all rows without an id.

    Rows with one id and different texts are documents of their own.
    """
    found = join(df, threshold=threshold, id_col=id_col, text_col=text_col)
    first = found.where((F.col(id_col) == F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))).select(F.col(id_col), F.col("text_hash").alias("__h")).distinct()
    rows = df.withColumn("__h", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    kept = rows.join(first, [id_col, "__h"], "left_semi").dropDuplicates([id_col, "__h"])
    return kept.select(*rows.columns).unionByName(rows.where(F.col(id_col).isNull())).drop("__h")
