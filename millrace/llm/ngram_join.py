"""Exact n-gram Jaccard self-join of documents by adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.sieve import sifted
from millrace.llm.staging import discard, few_tasks, settled, staged, staged_so_far

_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8: its powers differ in low bits
_CHUNK = 1 << 20
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


@dataclass(frozen=True)
class Settings:
    """words: of a shingle. percent: of the union that the intersection must reach. bucket: documents that may share a
    prefix token before it counts as frequent. levels: tokens that two prefixes must share, round by round. broadcast:
    frequent tokens that are known everywhere at most; those beyond are still counted exactly."""

    words: int = 5
    percent: int = 80
    bucket: int = 16
    levels: tuple[int, ...] = (16, 64, 256)
    broadcast: int = 65_536


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts, by array operations on their UTF-8 bytes."""

    def __init__(self, words: int) -> None:
        self.words = words
        rng = np.random.Generator(np.random.PCG64(20240229))
        self.table = rng.integers(0, 1 << 63, 256, np.uint64, endpoint=True) * np.uint64(2) + np.uint64(1)
        self.table[65:91] = self.table[97:123]
        self.space = np.zeros(256, bool)
        self.space[list(_SPACES)] = True
        self._powers(2 * _CHUNK)

    def _powers(self, n: int) -> None:
        self.up, self.down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
        self.up[1:], self.down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        np.multiply.accumulate(self.up, out=self.up)
        np.multiply.accumulate(self.down, out=self.down)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _words(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words in at most some MB of bytes."""
        if len(buf) >= len(self.up):
            self._powers(len(buf))
        gap = np.ones(len(buf) + 2, np.int8)
        gap[1:-1] = self.space[buf]
        edge = np.diff(gap)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.up[: len(buf)], out=total[1:])
        return starts, self._mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """One array for each text, in order. Many short texts are hashed at once, a long one piece by piece."""
        held: list[bytes] = []
        size = 0
        for t in texts:
            if len(t) > _CHUNK:
                yield from self._together(held)
                held, size = [], 0
                yield self._shingles(self._long(t))
                continue
            if size + len(t) > _CHUNK:
                yield from self._together(held)
                held, size = [], 0
            held.append(t)
            size += len(t) + 1
        yield from self._together(held)

    def _long(self, text: bytes) -> np.ndarray:
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + _CHUNK)
            while end < len(text) and text[end] not in _SPACES:
                end += 1
            out.append(self._words(np.frombuffer(text, np.uint8)[at:end])[1])
            at = end
        return np.concatenate(out)

    def _together(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if not texts:
            return
        starts, hashes = self._words(np.frombuffer(b" ".join(texts), np.uint8))
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        cut = np.searchsorted(starts, bounds)
        n = self.words
        if len(hashes) >= n:
            runs = hashes[: len(hashes) - n + 1].copy()
            for k in range(1, n):
                runs = self._mix(runs * np.uint64(0xFF51AFD7ED558CCD) + hashes[k : len(hashes) - n + 1 + k])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield np.unique(runs[a : b - n + 1]) if b - a >= n else self._shingles(hashes[a:b])

    def _shingles(self, hashes: np.ndarray) -> np.ndarray:
        """Distinct shingles of one text's word hashes; one of all words if they are fewer than a shingle has."""
        if not len(hashes):
            return hashes
        n = min(self.words, len(hashes))
        runs = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            runs = self._mix(runs * np.uint64(0xFF51AFD7ED558CCD) + hashes[k : len(hashes) - n + 1 + k])
        return np.unique(self._mix(runs + np.uint64(n))) if n < self.words else np.unique(runs)


def _node(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _need(n, percent: int):
    """The least intersection of a set of n with any set that it links to."""
    return -(-n * percent // 100)


def sign(docs: DataFrame, settings: Settings, key: str, text: str) -> DataFrame:
    """(key, node, n, prefix, heavy, times): each document's set size, the node that all documents of the same set share,
    and the first tokens of its set in the order of hashes, as many as level one needs. A row without a node is an empty
    document's, or (key null, heavy set) a task's tokens that it met often."""
    level = settings.levels[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, often = Shingler(settings.words), {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sizes, nodes, prefixes = [], [], []
                for s in shingler.sets([(t.as_py() or "").encode() for t in part.column(1)]):
                    n = len(s)
                    sizes.append(n)
                    nodes.append(_node(s) if n else None)
                    prefixes.append(s[: n - _need(n, settings.percent) + min(level, _need(n, settings.percent))].view(np.int64))
                if sum(map(len, prefixes)):
                    tokens, times = np.unique(np.concatenate(prefixes), return_counts=True)
                    for t, c in zip(tokens[times > 2].tolist(), times[times > 2].tolist()):
                        often[t] = often.get(t, 0) + c
                    if len(often) > 4 * settings.broadcast:
                        often = dict(sorted(often.items(), key=lambda x: (-x[1], x[0]))[: settings.broadcast])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.nulls(len(sizes), pa.list_(pa.int64())), pa.nulls(len(sizes), pa.list_(pa.int64()))], ["key", "node", "n", "prefix", "heavy", "times"])
        if often:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([0], pa.int32()), pa.nulls(1, pa.list_(pa.int64())), pa.array([list(often)], pa.list_(pa.int64())), pa.array([list(often.values())], pa.list_(pa.int64()))], ["key", "node", "n", "prefix", "heavy", "times"])

    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string"))
    return source.mapInArrow(run, "key long, node long, n int, prefix array<long>, heavy array<long>, times array<long>")


def _sets(docs: DataFrame, settings: Settings) -> DataFrame:
    """(node, lacking, n, tokens) of docs (node, lacking, text): the whole sets. Another text of an equal key doesn't give the node's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings.words)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sets = [s.view(np.int64) for s in shingler.sets([(t.as_py() or "").encode() for t in part.column(2)])]
                own = [(k, x, s) for k, x, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sets) if _node(s) == k]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in own], pa.int64()), pa.array([x for _, x, _ in own], pa.bool_()), pa.array([len(s) for _, _, s in own], pa.int32()), pa.array([s for _, _, s in own], pa.list_(pa.int64()))], ["node", "lacking", "n", "tokens"])

    return docs.select("node", "lacking", "text").mapInArrow(run, "node long, lacking boolean, n int, tokens array<long>")


def _least(n: Column, s: Settings) -> Column:
    """_need() as a column."""
    return F.ceil(n * s.percent / F.lit(100)).cast("int")


def _pair_least(a: Column, b: Column, s: Settings) -> Column:
    """The least intersection of two sets of these sizes that link."""
    return F.ceil((a + b) * s.percent / F.lit(100 + s.percent)).cast("int")


def _alike_sizes(a: Column, b: Column, s: Settings) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * s.percent)


def _match(rows: DataFrame, sizes: DataFrame, frequent: DataFrame, level: int, s: Settings, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One round: (pairs, unsatisfied nodes) of rows (token, node), the prefixes of this level, and sizes (node, n). tasks: that write the shared tokens at most.

    frequent is a bounded list of tokens that are skipped at once; other tokens in more than s.bucket nodes are skipped
    after their count. Two linked documents share at least level tokens in these prefixes, so a document that has fewer
    skipped ones has met all its partners in the buckets left; the others go to the next round.
    """
    known = F.broadcast(frequent.select("token"))
    here = rows.join(known, "token", "left_anti").repartition("token").groupBy("token", "node").agg(F.lit(1).alias("one"))
    count = here.groupBy("token").agg(F.count("*").alias("df"))
    shared = staged(here.join(count.filter("df > 1"), "token").select("token", "node", "df"), "ngram-shared", tasks)
    tasks = few_tasks(shared)
    skipped = rows.join(known, "token", "left_semi").distinct().select("node").unionByName(shared.filter(F.col("df") > s.bucket).select("node"))
    missing = staged(skipped.groupBy("node").agg(F.count("*").alias("skipped")).join(sizes, "node"), "ngram-missing", tasks)
    lacking = missing.filter(F.col("skipped") >= F.least(F.lit(level), _least(F.col("n"), s)))
    few = shared.filter(F.col("df") <= s.bucket).select("token", "node")
    a, b = few.alias("a"), few.alias("b")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")))
    pairs = met.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(F.count("*").alias("shared"))
    for k in ("a", "b"):
        own = sizes.join(missing.select("node", "skipped"), "node", "left").select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.coalesce("skipped", F.lit(0)).alias(f"skipped_{k}"))
        pairs = pairs.join(own, k)
    # A linked pair shares so many tokens; what lies beyond one of the prefixes, or was skipped by both, isn't seen here.
    beyond = lambda n: _least(n, s) - F.least(F.lit(level), _least(n, s))
    least = _pair_least(F.col("na"), F.col("nb"), s) - F.greatest(beyond(F.col("na")), beyond(F.col("nb"))) - F.least("skipped_a", "skipped_b")
    pairs = staged(pairs.filter((F.col("shared") >= least) & _alike_sizes(F.col("na"), F.col("nb"), s)).select("a", "b"), "ngram-pairs", tasks)
    discard(shared)
    return pairs, lacking


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose whole sets are similar enough. sets: staged, with other
    columns or not; only those of these pairs are shuffled."""
    tasks = few_tasks(sets)
    pairs = staged(pairs, "ngram-candidates", tasks)
    sets = sifted(sets.select("node", "n", "tokens"), "node", _ends(pairs))
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    alike = both.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * s.percent)
    return staged(alike.select("a", "b"), "ngram-links", tasks)


def _frequent(rows: DataFrame, s: Settings) -> DataFrame:
    """The tokens of the most nodes, at most s.broadcast of them."""
    often = rows.groupBy("token").agg(F.count("*").alias("times")).filter(F.col("times") > 4 * s.bucket)
    return staged(often.orderBy(F.desc("times"), "token").limit(s.broadcast), "ngram-frequent")


def _remainder(lacking: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Verified pairs that connect what links exist among nodes whose sets are mostly frequent tokens (large groups of
    near copies). Their prefixes go by exact frequency, rare tokens first. For every token a leader is compared with all
    others, round after round, which joins a group in as many comparisons as it has nodes; then every two nodes that still
    lie in different components and share a prefix token are compared, so no link between components is missed."""
    own = staged(sets.join(lacking.select("node", "skipped"), "node"), "ngram-sets")
    sets = own
    rows = own.select("node", F.explode("tokens").alias("token"))
    df = rows.groupBy("token").agg(F.count("*").alias("df"))
    ranked = rows.join(df.filter("df > 1"), "token").groupBy("node").agg(F.collect_list(F.struct("df", "token")).alias("t"))
    width = F.col("n") - _least(F.col("n"), s) + 1
    alone = F.col("n") - F.size("t")  # tokens of this node only come first and meet nothing
    prefix = own.select("node", "n", (F.col("skipped") / F.col("n")).alias("weight")).join(ranked, "node").filter(width > alone)
    first = F.slice(F.sort_array("t"), 1, (width - alone).cast("int"))
    prefix = staged(prefix.select("node", "n", "weight", alone.alias("alone"), F.posexplode(first).alias("k", "t")).select("t.token", "node", "n", "weight", (F.col("alone") + F.col("k") + 1).alias("rank")), "ngram-ranked", few_tasks(own))
    tasks = few_tasks(prefix)
    # At the first token that two sets share, what is left of each bounds their intersection.
    within = lambda n, rank, other: n - rank + 1 >= _pair_least(n, other, s)
    found, comps = None, prefix.select("node").distinct().withColumn("component", F.col("node"))
    while True:
        now = prefix.join(comps, "node")
        sizes = now.groupBy("token", "component").agg(F.count("*").alias("c"), F.max(F.struct("weight", "node", "n")).alias("top"))
        spread = sizes.groupBy("token").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("same"), F.max(F.struct("c", "top", "component")).alias("lead"), F.count("*").alias("k")).filter("k > 1")
        spread = staged(spread.select("token", F.col("lead.component").alias("lead_component"), F.col("lead.top.node").alias("leader"), F.col("lead.top.n").alias("leader_n"), "all", "same"), "ngram-spread", tasks)
        open_pairs, open_rows = spread.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2), F.lit(0.0)), F.coalesce(F.sum("all"), F.lit(0))).first()
        if open_pairs == 0:
            break
        mixed = now.join(spread, "token")
        if open_pairs <= 8 * open_rows or found is not None and merged == 0:  # noqa: F821
            a, b = mixed.alias("a"), mixed.alias("b")
            pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & _alike_sizes(F.col("a.n"), F.col("b.n"), s) & within(F.col("a.n"), F.col("a.rank"), F.col("b.n")) & within(F.col("b.n"), F.col("b.rank"), F.col("a.n"))).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
            last = _verified(pairs, sets, s)
            found = last if found is None else found.unionByName(last)
            break
        star = mixed.filter((F.col("component") != F.col("lead_component")) & _alike_sizes(F.col("n"), F.col("leader_n"), s) & within(F.col("n"), F.col("rank"), F.col("leader_n"))).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
        links = _verified(star, sets, s)
        merged = links.count()
        found = links if found is None else found.unionByName(links)
        if merged:
            new = components(found, tasks)
            comps = staged(prefix.select("node").distinct().join(new, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "ngram-components", tasks)
    return found if found is not None else lacking.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)


def cluster(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable over links, the row's own included) of every row.

    Two documents link if 100 * intersection >= percent * union of their sets of distinct word shingles (A-Z lower-cased;
    with fewer words than a shingle, all words as one). Equal sets are one node from the start, so a group of copies costs
    one document. Prefixes, in the order of hashes, are lengthened round by round only for documents whose tokens are
    frequent, and then more shared tokens are asked for; candidates are verified on whole sets; links that components
    already imply aren't looked for, so a large group of near copies never gives all its pairs.

    Null, empty and blank texts have no shingles, link with nothing and are their own component, as are rows with a null
    key, whose component is null unless a copy has a key. Rows with equal keys count each by their own text. An empty table gives no rows; other columns are ignored. Nothing that grows with the documents is collected or
    broadcast: only scalars and settings.broadcast tokens.
    """
    s, since = settings, staged_so_far()
    signed = staged(sign(docs, s, key, text), "ngram-signed")
    members = staged(signed.filter("heavy is null").select("key", "node", "n"), "ngram-members")
    tasks = few_tasks(members)
    sizes = members.filter("node is not null").select("node", "n").distinct()
    rows = signed.filter("node is not null").select(F.explode("prefix").alias("token"), "node")
    heavy = signed.filter("heavy is not null").select(F.explode(F.arrays_zip("heavy", "times")).alias("h")).groupBy(F.col("h.heavy").alias("token")).agg(F.sum("h.times").alias("times"))
    frequent = staged(heavy.filter(F.col("times") > 4 * s.bucket).orderBy(F.desc("times"), "token").limit(s.broadcast), "ngram-frequent")
    pairs, lacking = _match(rows, sizes, frequent, s.levels[0], s)
    discard(signed)
    needed = _ends(pairs).withColumn("lacking", F.lit(False)).unionByName(lacking.select("node", F.lit(True).alias("lacking"))).groupBy("node").agg(F.max("lacking").alias("lacking"))
    one = staged(members.filter("node is not null").groupBy("node").agg(F.min("key").alias("key")).join(needed, "node").select("key", "node", "lacking"), "ngram-needed", tasks)
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    own = sifted(texts, "key", one).join(one.hint("merge"), "key")  # one way at every size: what is needed grows with the documents
    if not members.groupBy("key").count().filter("count > 1").isEmpty():  # repeated rows
        own = own.dropDuplicates(["node", "text"])
    sets = staged(_sets(own, s), "ngram-sets")
    here = sets.filter("lacking").drop("lacking")  # of the documents that are still to be matched, fewer each round
    for level in s.levels[1:]:
        if lacking.isEmpty():
            break
        width = F.col("n") - _least(F.col("n"), s) + F.least(F.lit(level), _least(F.col("n"), s))
        if level != s.levels[1]:
            left = lacking.select("node")
            here = staged(sifted(here, "node", left).join(left.hint("merge"), "node"), "ngram-sets", few_tasks(sets))
        rows = staged(here.select(F.explode(F.slice("tokens", 1, width.cast("int"))).alias("token"), "node"), "ngram-prefix")
        more, lacking = _match(rows, here.select("node", "n"), _frequent(rows, s), level, s, few_tasks(rows))
        discard(rows)
        pairs = pairs.unionByName(more)
    links = _verified(pairs.distinct(), sets, s)
    if not lacking.isEmpty():
        links = links.unionByName(_remainder(lacking, here, s))
    label = components(links, tasks)
    by_node = members.filter("node is not null").groupBy("node").agg(F.min("key").alias("least"))
    named = by_node.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Written, so that the join deals out its nodes itself and a large component can be split; behind the sums it couldn't.
    smallest = staged(named.groupBy("component").agg(F.min("least").alias("component_id")), "ngram-smallest", tasks)
    of_node = named.join(smallest, "component").select("node", "component_id")
    out = members.join(of_node, "node", "left")
    named = out.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id"))
    return settled(named, "ngram-clusters", since, tasks)
