"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their shingle sets is at least ``percent``; each
document gets the least key of its component of links.

1. A pass over whole texts gives set sizes, a set id (equal sets share it, so copies are one vertex)
   and a count sketch of how often each shingle occurs in the corpus.
2. Shingles are ordered alike in all documents: rare ones by hash, frequent ones last by estimated
   count. If two sets overlap enough, they share at least ``l`` shingles among their first
   ``n - ceil(0.8 n) + l``. A document whose prefix would meet many others by the sketch's estimate
   gets a longer prefix (larger ``l``), and a pair needs ``min`` of both ``l`` in common.
3. Prefix shingles are dealt by hash and streamed in order. In each bucket of two or more documents
   those with the ``hubs`` least ids (hashes, so at random) are hubs. Documents are first verified
   against hubs, which joins a group of n near copies by a multiple of n edges instead of n^2.
4. What is left are pairs of different components in one bucket. A bucket's largest component is only
   met with the rest, never with itself. Pairs pass bounds on the symmetric difference by parities and
   histograms of hashes (exact: they never reject a link), then need enough shared prefix shingles,
   then are verified on whole sets.

Nothing is capped: every pair above the threshold has both ends in one component, which follows from
the prefix lemma and exact verification. Shingles and set ids are 64-bit hashes; two of 10^9 different
sets share an id with a chance of 3 in 100.

Defined results: null, empty and wordless texts have no shingles and their own key as component;
repeated rows give repeated results; equal keys of different texts act as separate vertices; null keys
join links, but are never the name of a component, except where no member has a key (then null); an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shingles import shingle_set, texts
from tessella.operators.components import connected_components
from tessella.runtime import FEW, SOME, lean, materialize


@dataclass(frozen=True)
class JoinConfig:
    percent: int = 80
    words: int = 5
    #: count sketch: rows, and bits of the width
    sketch_rows: int = 3
    sketch_bits: int = 17
    #: shingles estimated above this, and above so many deviations of the sketch, go last; a rare one
    #: that is taken for frequent only changes the order, which stays the same for all documents
    frequent: int = 8
    deviations: float = 1.5
    #: most shared prefix shingles that are asked for
    max_matches: int = 16
    #: words of 64 parities that go with prefix rows, and least of a set's print, which has one or two
    #: parities for every shingle (a power of two); bins of the histogram that goes with prefix rows
    coarse_words: int = 4
    medium_bins: int = 128
    #: members of a bucket that all its others are verified against first
    hubs: int = 12
    #: rows of keys that may be broadcast; beyond it texts are joined by a shuffle
    broadcast_keys: int = 1_000_000


_ROW_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _cells(tokens: np.ndarray, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketch column and sign of each token in one row of the sketch."""
    h = tokens * _ROW_ODD[row]
    return (h >> np.uint64(64 - bits)).astype(np.int64), 1 - 2 * ((h >> np.uint64(8)) & np.uint64(1)).astype(np.int64)


def _histogram(tokens: np.ndarray, bins: int) -> np.ndarray:
    return np.minimum(np.bincount((tokens & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 127).astype(np.int8)


def _print(tokens: np.ndarray, least: int) -> bytes:
    """Parities of how many tokens fall into each of a power of two of bins, a bit each.

    A token that only one of two sets has turns one bit over, so that two prints never differ in more
    bits than the sets do in tokens."""
    bins = max(least, 1 << max(len(tokens) - 1, 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The print in ``size`` bytes: that of fewer bins."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _apart(a: bytes, b: bytes) -> int:
    """Least symmetric difference of two sets by their prints; the finer one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())


def _set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _coarse(config: JoinConfig) -> list[str]:
    return [f"c{k}" for k in range(config.coarse_words)]


def _summary_schema(config: JoinConfig, key: str) -> str:
    coarse = "".join(f"{c} long, " for c in _coarse(config))
    return f"key {key}, text_hash long, n long, set_id long, print binary, {coarse}medium array<tinyint>, slot int, v long"


def _summarize(config: JoinConfig):
    width, counts, words = 1 << config.sketch_bits, pa.list_(pa.int8()), config.coarse_words
    names = ["key", "text_hash", "n", "set_id", "print", *_coarse(config), "medium", "slot", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(config.sketch_rows * width, np.int64)
        held: list[np.ndarray] = []

        def pour() -> None:
            tokens = np.concatenate(held)
            held.clear()
            for r in range(config.sketch_rows):
                at, sign = _cells(tokens, r, config.sketch_bits)
                sketch[r * width : (r + 1) * width] += np.bincount(at, sign, width).astype(np.int64)

        key_type, waiting = pa.null(), 0
        for batch in batches:
            key_type, n, ids, prints, coarse, medium = batch.schema.types[0], [], [], [], [], []
            for data in texts(batch.column(1)):
                tokens = shingle_set(data, config.words)
                n.append(len(tokens))
                ids.append(_set_id(tokens) if len(tokens) else None)
                prints.append(_print(tokens, 64 * words) if len(tokens) else None)
                coarse.append(_folded(np.frombuffer(prints[-1], np.uint8), 8 * words).view("<i8") if len(tokens) else np.zeros(words, np.int64))
                medium.append(_histogram(tokens, config.medium_bins) if len(tokens) else None)
                held.append(tokens)
                waiting += len(tokens)
                if waiting > 1 << 18:
                    pour()
                    waiting = 0
            rows = np.array(coarse, np.int64).reshape(len(n), words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(prints, pa.binary()),
                    *(pa.array(rows[:, k]) for k in range(words)), pa.array(medium, counts), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64()),
                ],
                names=names,
            )
        if held:
            pour()
        at = np.flatnonzero(sketch)
        if len(at):
            none = lambda kind: pa.nulls(len(at), kind)
            yield pa.RecordBatch.from_arrays(
                [none(key_type), *(none(pa.int64()) for _ in range(3)), none(pa.binary()), *(none(pa.int64()) for _ in range(words)), none(counts), pa.array(at.astype(np.int32)), pa.array(sketch[at])],
                names=names,
            )

    return run


def estimates(tokens: np.ndarray, sketch: np.ndarray, config: JoinConfig) -> np.ndarray:
    """Estimated number of sets that hold each token: the median over the sketch's rows."""
    rows = []
    for r in range(config.sketch_rows):
        at, sign = _cells(tokens, r, config.sketch_bits)
        rows.append(sketch[r][at] * sign)
    rows = np.sort(np.array(rows), axis=0) if len(rows) != 3 else rows
    middle = np.maximum(np.minimum(rows[0], rows[1]), np.minimum(np.maximum(rows[0], rows[1]), rows[2])) if len(rows) == 3 else rows[len(rows) // 2]
    return np.maximum(middle, 1)


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with any set it links with, at least."""
    return -(-percent * n // 100)


def prefix(tokens: np.ndarray, sketch: np.ndarray, noise: float, config: JoinConfig) -> tuple[np.ndarray, int]:
    """The prefix of a sorted token set, and how many matches it asks for."""
    n = len(tokens)
    need = least_overlap(n, config.percent)
    est = estimates(tokens, sketch, config)
    often = np.flatnonzero(est > noise)
    order = np.arange(n)  # tokens are sorted; those that aren't frequent stay in that order
    if len(often):
        order = np.append(np.delete(order, often), often[np.argsort(est[often], kind="stable")])
    first = order[: n - need + 1]
    # estimated candidates for each shingle of the shortest prefix; each fourfold asks for one match more
    cost = np.where(est > noise, est, 0)[first].sum() / len(first)
    matches = int(np.clip(1 + np.floor(np.log2(1 + cost) / 2), 1, min(config.max_matches, need)))
    return tokens[order[: n - need + matches]], matches


def _prefixes(sketch: np.ndarray, noise: float, config: JoinConfig):
    def run(batches):
        done: set[int] = set()  # sets this task has emitted: copies add nothing
        for batch in batches:
            out, rows = [], []
            for data in texts(batch.column(0)):
                tokens = shingle_set(data, config.words)
                if not len(tokens) or (own := _set_id(tokens)) in done:
                    continue
                done.add(own)
                p, matches = prefix(tokens, sketch, noise, config)
                out.append(p)
                rows.append((own, len(tokens), matches, len(p)))
            if not rows:
                continue
            ids, n, m, k = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(ids, k)), pa.array(np.repeat(n, k).astype(np.int32)), pa.array(np.repeat(m, k).astype(np.int8))],
                names=["token", "set_id", "n", "m"],
            )

    return run


def _buckets(n_hubs: int, percent: int):
    """Rows of tokens that two or more sets have, each with those hubs of its bucket that come before
    it and may link by size. Hubs are the bucket's first members.

    Input is sorted by (token, set_id). The last row of each batch waits for the next batch, together
    with its bucket's hubs; nothing else is carried, however long a run of equal tokens is."""
    lists = pa.list_(pa.int64())

    def emit(at, cols, hubs):
        own = [np.unique(h[ok]) for h, ok in zip(*(x[at] for x in hubs), strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in cols), pa.array(own, lists)], names=["token", "set_id", "n", "m", "hubs"])

    def run(batches):
        waiting, known, earlier = None, np.empty((0, 2), np.int64), 0  # a row; its bucket's (hub, size) so far; how many rows came before
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if waiting is not None:
                cols = [np.append(np.array([x], c.dtype), c) for x, c in zip(waiting, cols, strict=True)]
            fresh = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            token, ids, n, _ = cols = [c[fresh] for c in cols]  # the same set from another task counts once
            starts = np.append(True, token[1:] != token[:-1])
            head = np.flatnonzero(starts)[np.cumsum(starts) - 1]
            before = np.arange(len(token)) - head + np.where(head == 0, earlier, 0)  # members before this row
            hub, ok = np.zeros((len(token), n_hubs), np.int64), np.zeros((len(token), n_hubs), bool)
            for k in range(n_hubs):
                # the k-th member of the bucket is in this batch, or among the known ones of the first bucket
                at = np.minimum(head + k - np.where(head == 0, earlier, 0), len(token) - 1)
                old = (head == 0) & (k < len(known))
                h = np.where(old, known[k, 0] if k < len(known) else 0, ids[np.maximum(at, 0)])
                size = np.where(old, known[k, 1] if k < len(known) else 0, n[np.maximum(at, 0)])
                hub[:, k], ok[:, k] = h, (k < before) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n))
            more = np.append(token[1:] == token[:-1], False)
            rows = np.flatnonzero((before > 0) | more)
            rows = rows[rows < len(token) - 1]
            final = len(token) - 1
            first = head[final]
            mine = known if first == 0 else known[:0]
            members = np.stack([ids[first : final], n[first : final].astype(np.int64)], axis=1)
            known, earlier = np.concatenate([mine, members])[:n_hubs], int(before[final])
            waiting = [c[final] for c in cols]
            last = ([c[final:] for c in cols], (hub[final:], ok[final:]))
            if len(rows):
                yield emit(rows, cols, (hub, ok))
        if waiting is not None and earlier:
            yield emit(np.array([0]), *last)

    return run


def _within(apart: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether sets that differ in ``apart`` elements or more may link.

    Sets with overlap o differ in n_a + n_b - 2 o elements, and o >= percent * union / 100."""
    return (100 + percent) * apart <= (100 - percent) * (n_a + n_b)


def _may_link(a: str, b: str, config: JoinConfig) -> Column:
    """False only for pairs that cannot link: sizes too different, or parities or histograms too far
    apart. The parities come first: they are compiled, and decide small sets."""
    n_a, n_b = F.col(f"{a}_n"), F.col(f"{b}_n")
    sizes = 100 * F.least(n_a, n_b) >= config.percent * F.greatest(n_a, n_b)
    turned = [F.bit_count(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}"))) for c in _coarse(config)]
    counts = F.zip_with(f"{a}_medium", f"{b}_medium", lambda x, y: F.abs(x.cast("int") - y.cast("int")))
    apart = F.aggregate(counts, F.lit(0), lambda s, x: s + x)
    return sizes & _within(sum(turned[1:], turned[0]), n_a, n_b, config.percent) & _within(apart, n_a, n_b, config.percent)


def _passing(pairs: DataFrame, sets: DataFrame, config: JoinConfig) -> DataFrame:
    """Pairs (a, b) that sizes and prints don't rule out."""
    side = lambda x: sets.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("print").alias(f"h_{x}"))

    def keep(batches):
        for batch in batches:
            a, b, n_a, n_b = (batch.column(k).to_numpy() for k in range(4))
            near = 100 * np.minimum(n_a, n_b) >= config.percent * np.maximum(n_a, n_b)
            for k in np.flatnonzero(near):
                apart = _apart(batch.column(4)[k].as_py(), batch.column(5)[k].as_py())
                near[k] = (100 + config.percent) * apart <= (100 - config.percent) * (n_a[k] + n_b[k])
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], names=["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "h_a", "h_b")
    return both.mapInArrow(keep, "a long, b long")


def _set_arrays(config: JoinConfig):
    def run(batches):
        for batch in batches:
            found = {}
            for data in texts(batch.column(0)):
                tokens = shingle_set(data, config.words)
                if len(tokens):
                    found[_set_id(tokens)] = tokens.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["set_id", "tokens"]
            )

    return run


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, config: JoinConfig) -> DataFrame:
    """The pairs (a, b) of set ids that link, by whole sets; reads only the texts it needs."""
    pairs = materialize(pairs.select("a", "b"), "pairs", FEW)
    need = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    keys = materialize(need.join(sets, "set_id").select(F.col("first_key").alias("key")), "keys", FEW)
    few = keys.count() <= config.broadcast_keys
    found = docs.join(F.broadcast(keys) if few else keys, docs["key"].eqNullSafe(keys["key"]), "left_semi").select("text")
    arrays = materialize(
        found.mapInArrow(_set_arrays(config), "set_id long, tokens array<long>").join(need, "set_id", "left_semi").dropDuplicates(["set_id"]), "sets", SOME
    )
    side = lambda name: arrays.select(F.col("set_id").alias(name), F.col("tokens").alias(f"t_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    o, total = F.size(F.array_intersect("t_a", "t_b")).cast("long"), (F.size("t_a") + F.size("t_b")).cast("long")
    return both.filter(100 * o >= config.percent * (total - o)).select("a", "b")


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def _components(docs: DataFrame, config: JoinConfig, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, text_hash, n, set_id), and vertices (set_id, first_key, first, component); ``first``
    is the least (no_key, key, text_hash) of a set's rows, those without a key last."""
    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), text_hash(text).alias("text_hash"))
    kind = docs.schema[key].dataType.simpleString()
    summary = materialize(lean(plain).mapInArrow(_summarize(config), _summary_schema(config, kind)), "summary")
    rows = summary.filter(F.col("slot").isNull()).select("key", "text_hash", "n", "set_id")
    width = 1 << config.sketch_bits
    cells = summary.filter(F.col("slot").isNotNull()).groupBy("slot").agg(F.sum("v").alias("v")).toArrow()
    sketch = np.zeros(config.sketch_rows * width, np.int64)
    sketch[cells["slot"].to_numpy()] = cells["v"].to_numpy()
    sketch = sketch.reshape(config.sketch_rows, width)
    noise = max(float(config.frequent), config.deviations * float(np.sqrt(np.median((sketch.astype(float) ** 2).mean(axis=1)))))
    same = ["n", "print", *_coarse(config), "medium"]  # rows of one set have the same
    least = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "text_hash")).alias("first")
    sets = materialize(
        summary.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("key").alias("first_key"), least, *(F.first(c).alias(c) for c in same)), "vertices", SOME
    )

    prefixes = plain.select("text").mapInArrow(_prefixes(sketch, noise, config), "token long, set_id long, n int, m tinyint")
    dealt = prefixes.repartition("token").sortWithinPartitions("token", "set_id")
    buckets = materialize(
        dealt.mapInArrow(_buckets(config.hubs, config.percent), "token long, set_id long, n int, m tinyint, hubs array<long>"), "buckets", SOME
    )
    hubs = buckets.select("set_id", F.explode("hubs").alias("hub")).distinct().select(F.col("set_id").alias("a"), F.col("hub").alias("b"))
    near_hub = _passing(hubs, sets, config)
    starred = materialize(_verified(near_hub, plain, sets, config), "links", FEW)
    grouped = materialize(connected_components(starred).withColumnRenamed("node", "set_id"), "groups", FEW)

    named = buckets.select("token", "set_id", "n", "m").join(grouped, "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id")
    )
    prints = [F.bit_xor(F.xxhash64("set_id", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    sizes = named.groupBy("token", "component").agg(F.count("*").alias("c"), *prints)
    mixed = sizes.groupBy("token").agg(
        F.count("*").alias("kinds"), F.sum("c").alias("c"), F.max(F.struct("c", "component"))["component"].alias("main"),
        F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"),
    ).filter("kinds > 1")
    # the shingles of a shared passage have the same members: one of them stands for all
    chosen = mixed.groupBy("x0", "x1", "c", "main").agg(F.min("token").alias("token"), F.count("*").alias("weight"))
    far = [*_coarse(config), "medium"]
    open_rows = materialize(named.join(chosen.select("token", "main", "weight"), "token").join(sets.select("set_id", *far), "set_id"), "open", SOME)
    x = open_rows.filter("component != main").select(*(F.col(c).alias(f"x_{c}") for c in ("token", "set_id", "n", "m", "component", "weight", *far)))
    y = open_rows.select(*(F.col(c).alias(f"y_{c}") for c in ("token", "set_id", "n", "m", "component", "main", *far)))
    met = x.join(
        y,
        (F.col("x_token") == F.col("y_token")) & (F.col("x_component") != F.col("y_component"))
        & ((F.col("y_component") == F.col("y_main")) | (F.col("x_set_id") < F.col("y_set_id"))) & _may_link("x", "y", config),
    )
    rest = (
        met.groupBy(F.least("x_set_id", "y_set_id").alias("a"), F.greatest("x_set_id", "y_set_id").alias("b"))
        .agg(F.sum("x_weight").alias("shared"), F.first(F.least("x_m", "y_m")).alias("asked")).filter("shared >= asked")
    )
    crossing = materialize(_verified(_passing(rest, sets, config), plain, sets, config), "links", FEW)
    final = connected_components(starred.unionByName(crossing)).withColumnRenamed("node", "set_id")
    vertex = sets.select("set_id", "first_key", "first").join(final, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    return rows, materialize(vertex, "vertices", FEW)


def jaccard_components(docs: DataFrame, config: JoinConfig = JoinConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs``."""
    rows, vertex = _components(docs, config, key, text)
    least = vertex.groupBy("component").agg(F.min("first_key").alias("component_id"))
    by_set = vertex.join(least, "component").select("set_id", "component_id")
    named = rows.join(by_set, "set_id").select("key", "n", "component_id")
    # wordless rows have no set: they aren't joined, as they would all meet in one task
    alone = rows.filter("set_id IS NULL").select("key", "n", F.col("key").alias("component_id"))
    return named.unionByName(alone).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def surplus(docs: DataFrame, config: JoinConfig = JoinConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, goes, wordless) of the pairs of key and text that are not the one their component
    keeps (``goes``), and of pairs that are kept but have several rows. The kept pair is the least by
    key, then by ``text_hash``, those without a key last; wordless texts are all kept."""
    rows, vertex = _components(docs, config, key, text)
    kept = vertex.groupBy("component").agg(F.min("first").alias("kept"))
    by_set = vertex.join(kept, "component").select("set_id", "kept")
    pairs = rows.groupBy("key", "text_hash", "set_id").agg(F.count("*").alias("times"))
    own = F.col("key").eqNullSafe(F.col("kept.key")) & (F.col("text_hash") == F.col("kept.text_hash"))
    marked = pairs.join(by_set, "set_id").select("key", "text_hash", "times", (~own).alias("goes"), F.lit(False).alias("wordless"))
    bare = pairs.filter("set_id IS NULL").select("key", "text_hash", "times", F.lit(False).alias("goes"), F.lit(True).alias("wordless"))
    return marked.unionByName(bare).filter("goes OR times > 1").select(F.col("key").alias(key), "text_hash", "goes", "wordless")
