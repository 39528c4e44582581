"""Operator 9: removal of repeated passages by prefix-partitioned suffix trees.

A window is `window` consecutive words of one text. Each word covered by a window whose words also start anywhere else is
removed. Windows are judged on the input.

1. Seeds. Every window has one seed, the leftmost of its `prefix`-word sequences with the smallest hash. Equal windows have
   equal seeds at equal places, so a window whose seed occurs once in the corpus is no repeat. Each text gives its distinct
   seeds and how often it has each; they are counted with partial sums.
2. Partition by prefix. The seed is the short prefix that splits the suffixes: windows of a seed that occurs at least
   twice, as runs of neighbouring windows, go to one group. `group` bounds the runs of a group, however many of them are in
   one text. A seed with more occurrences needs a longer prefix: equal runs are made one, and those left are split by the
   longest prefix, the whole window, below which a subtree is one node, so that its leaves need only be counted.
3. Subtrees. The suffixes of a group, cut at the window, are sorted: the order of the leaves of its suffix tree. The longest
   common prefixes of neighbours are the depths of its internal nodes: leaves below a node of at least `window` words are
   repeats.
4. Texts with an exact copy have no other windows to find: all of their words go if they have a window.

Seeds and subtrees stay with the hash of the text (128 bits), so that exact copies are handled once. The texts are shuffled
once; the plan's three uses of them read the same shuffle files.

Defined cases: a null, empty or blank text has no words; a text shorter than a window keeps all; windows may overlap
themselves; repeated rows and rows with one doc_id are texts of their own, null ids included; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

_STEP = 1 << 20
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def sequence_hashes(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of every `size` neighbouring words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    by, out = np.uint64(_MULTIPLIERS[which]), np.zeros(n, np.uint64)
    for i in range(size):
        out *= by
        out += h[i : i + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def seed_places(g: np.ndarray, across: int) -> np.ndarray:
    """For each window the place of its seed: of `across` neighbouring hashes the smallest, the leftmost if equal."""
    parts = []
    low = np.uint64(_STEP * 2 - 1)
    for at in range(0, max(len(g) - across + 1, 0), _STEP):
        x = g[at : at + _STEP + across - 1]
        m = (x & ~low) | np.arange(len(x), dtype=np.uint64)
        span = 1
        while span * 2 <= across:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < across:
            m = np.minimum(m[: len(m) - (across - span)], m[across - span :])
        parts.append((m & low).astype(np.int64) + at)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Windows:
    """The windows of a text by seed: window i has the seed at places[i]."""

    def __init__(self, raw: bytes | None, window: int, prefix: int) -> None:
        self.words = (raw or b"").split()
        self.hashes = word_hashes(self.words) if len(self.words) >= window else np.zeros(0, np.uint64)
        self.g = sequence_hashes(self.hashes, prefix)
        places = seed_places(self.g, window - prefix + 1)
        self.begin = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]) if len(places) else np.zeros(0, np.int64)
        self.end = np.r_[self.begin[1:], len(places)] if len(places) else self.begin
        self.seeds = self.g[places[self.begin]].view(np.int64)


def _scan(window: int, prefix: int):
    """Per text: its number of words, the digest of all of them, its distinct seeds and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, digest, seeds, times = [], [], [], []
            for raw in b.column("raw"):
                w = Windows(raw.as_py(), window, prefix)
                n_words.append(len(w.words))
                digest.append(hashlib.sha256(b" ".join(w.words)).hexdigest())
                s, n = np.unique(w.seeds, return_counts=True)
                seeds.append(s)
                times.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("c1"), b.column("c2"), pa.array(n_words, pa.int64()), pa.array(digest), pa.array(seeds, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                names=["doc_id", "c1", "c2", "n_words", "sha", "seeds", "times"],
            )

    return run


def _suffixes(window: int, prefix: int):
    """Runs of neighbouring windows of the wanted seeds, with the words that they span. Equal runs of a text are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for raw, c1, c2, wanted in zip(b.column("raw"), b.column("c1"), b.column("c2"), b.column("wanted"), strict=True):
                w = Windows(raw.as_py(), window, prefix)
                runs: dict[tuple[int, bytes], list[int]] = defaultdict(list)
                for k in np.flatnonzero(np.isin(w.seeds, wanted.values.to_numpy())).tolist():
                    a, e = int(w.begin[k]), int(w.end[k])
                    runs[int(w.seeds[k]), b" ".join(w.words[a : e + window - 1])].append(a)
                for (seed, span), starts in runs.items():
                    for col, x in zip(cols, (seed, c1.as_py(), c2.as_py(), starts, span), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()), strict=True)], names=["seed", "c1", "c2", "starts", "span"])

    return run


def _subtrees(window: int, at_once: int):
    """Places of repeated windows: rows come sorted by seed, and groups of a seed are whole."""

    def repeats(seeds: np.ndarray, spans: list[bytes], many: np.ndarray) -> list[np.ndarray]:
        codes: dict[bytes, int] = {}
        ids, lengths = [], np.zeros(len(spans), np.int64)
        for k, span in enumerate(spans):
            w = [codes.setdefault(x, len(codes)) for x in span.split(b" ")]
            ids += w
            lengths[k] = len(w)
        flat = np.array(ids, ">u4")
        count = lengths - window + 1
        owner = np.repeat(np.arange(len(spans)), count)
        first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        base = np.repeat(np.cumsum(lengths) - lengths, count)
        leaf = np.empty((len(owner), window + 1), ">u4")
        leaf[:, 0] = np.unique(seeds, return_inverse=True)[1][owner]
        leaf[:, 1:] = np.lib.stride_tricks.sliding_window_view(flat, window)[base + first]
        order = np.argsort(leaf.view(f"S{4 * (window + 1)}").ravel())
        differs = leaf[order[1:]] != leaf[order[:-1]]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), window + 1) - 1  # words that neighbours share; -1: another seed
        deep = common >= window
        found = np.zeros(len(owner), bool)
        found[order[1:]] |= deep
        found[order[:-1]] |= deep
        found |= many[owner]
        return np.split(found, np.cumsum(count)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            starts = t.column("starts").to_pylist()
            c1, c2, lo, hi = [], [], [], []
            found = repeats(t.column("seed").to_numpy(), t.column("span").to_pylist(), np.array([len(s) > 1 for s in starts]))
            ones, twos = t.column("c1").to_pylist(), t.column("c2").to_pylist()
            for k, f in enumerate(found):
                if f.any():
                    edge = np.flatnonzero(np.diff(np.r_[0, f.view(np.int8), 0])).reshape(-1, 2).tolist()
                    for s in starts[k]:
                        for a, e in edge:
                            c1.append(ones[k])
                            c2.append(twos[k])
                            lo.append(s + a)
                            hi.append(s + e - 1 + window)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((c1, pa.int64()), (c2, pa.int64()), (lo, pa.int32()), (hi, pa.int32()))], names=["c1", "c2", "lo", "hi"])

        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = pa.concat_tables([held, t]) if held is not None else t
            if len(held) >= at_once:
                seeds = held.column("seed").to_numpy()
                cut = int(np.searchsorted(seeds, seeds[-1]))
                if cut:
                    yield done(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and len(held):
            yield done(held)

    return run


def _whole(window: int):
    """The hash (128 bits) and the place of each window of a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for span, s1, s2, times in zip(b.column("span"), b.column("s1"), b.column("s2"), b.column("times"), strict=True):
                h = word_hashes(span.as_py().split(b" "))
                n = len(h) - window + 1
                row = (*(sequence_hashes(h, window, i).view(np.int64) for i in (0, 1)), *(np.full(n, x.as_py()) for x in (s1, s2, times)), np.arange(n))
                for col, x in zip(out, row, strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names=["w1", "w2", "s1", "s2", "times", "k"])

    return run


def _kept(window: int, with_text: bool):
    """What is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, digest, left = [], [], []
            for raw, spans in zip(b.column("raw"), b.column("spans").to_pylist(), strict=True):
                words = (raw.as_py() or b"").split()
                edge = np.zeros(len(words) + 1, np.int32)
                for s in spans:
                    edge[s["lo"]] += 1
                    edge[s["hi"]] -= 1
                keep = np.cumsum(edge[:-1]) <= 0
                text = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
                removed.append(int(len(words) - keep.sum()))
                digest.append(hashlib.sha256(text).hexdigest())
                left.append(text.decode("utf-8") if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column("c1"), b.column("c2"), pa.array(removed, pa.int64()), pa.array(digest), pa.array(left, pa.string())], names=["c1", "c2", "removed", "left_sha", "left_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = 35, prefix: int = 10, group: int = 4096, at_once: int = 8192, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) per row of docs; kept_text is null where nothing is removed, and
    without with_text.

    prefix: words of the short prefixes; group: occurrences of a seed above which its windows are split by whole windows;
    at_once: runs of windows whose subtrees are built together in a task."""
    text = F.col("text").cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    texts = docs.select(F.col("doc_id").cast("long"), raw.alias("raw"), F.xxhash64(raw).alias("c1"), F.xxhash64(F.lit(1), raw).alias("c2"))
    scanned = stored(texts.mapInArrow(_scan(window, prefix), "doc_id long, c1 long, c2 long, n_words long, sha string, seeds array<long>, times array<int>"), "seeds")
    contents = scanned.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("copies"))

    seeds = scanned.select("c1", "c2", F.explode(F.arrays_zip("seeds", "times")).alias("s")).select("c1", "c2", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times"))
    counted = seeds.groupBy("seed").agg(F.sum("times").alias("n")).filter("n > 1")
    wanted = seeds.join(counted, "seed").groupBy("c1", "c2").agg(
        F.collect_set(F.when(F.col("n") <= group, F.col("seed"))).alias("rare"), F.collect_set(F.when(F.col("n") > group, F.col("seed"))).alias("hot")
    )
    wanted = stored(wanted, "wanted")

    # One exchange of the texts serves the three joins below.
    by_text = texts.select("c1", "c2", "raw")
    small = wanted.filter(F.size("rare") > 0).select("c1", "c2", F.col("rare").alias("wanted"))
    large = wanted.filter(F.size("hot") > 0).select("c1", "c2", F.col("hot").alias("wanted"))

    joined = by_text.join(small.hint("shuffle_hash"), ["c1", "c2"]).select("raw", "c1", "c2", "wanted")
    runs = joined.mapInArrow(_suffixes(window, prefix), "seed long, c1 long, c2 long, starts array<int>, span binary")
    spans = runs.repartition("seed").sortWithinPartitions("seed").mapInArrow(_subtrees(window, at_once), "c1 long, c2 long, lo int, hi int")
    spans = spans.groupBy("c1", "c2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    # Runs of frequent seeds: equal ones are one, and only distinct ones are split into windows.
    joined = by_text.join(large.hint("shuffle_hash"), ["c1", "c2"]).select("raw", "c1", "c2", "wanted")
    runs = joined.mapInArrow(_suffixes(window, prefix), "seed long, c1 long, c2 long, starts array<int>, span binary")
    distinct = runs.groupBy("span").agg(F.least(F.sum(F.size("starts")), F.lit(2)).alias("times"))
    marks = [F.xxhash64("span").alias("s1"), F.xxhash64(F.lit(1), "span").alias("s2")]
    whole = distinct.select("span", *marks, "times").mapInArrow(_whole(window), "w1 long, w2 long, s1 long, s2 long, times long, k long")
    nodes = whole.groupBy("w1", "w2").agg(F.sum("times").alias("n")).filter("n > 1").select("w1", "w2")
    deep = whole.join(nodes, ["w1", "w2"]).groupBy("s1", "s2").agg(F.collect_set(F.col("k").cast("int")).alias("ks"))
    lists = F.flatten(F.transform("starts", lambda s: F.transform("ks", lambda k: F.struct((s + k).alias("lo"), (s + k + window).alias("hi")))))
    often = runs.select("c1", "c2", "starts", *marks).join(deep, ["s1", "s2"]).select("c1", "c2", lists.alias("spans"))

    single = contents.filter("copies = 1").select("c1", "c2")
    found = spans.unionByName(often).groupBy("c1", "c2").agg(F.flatten(F.collect_list("spans")).alias("spans")).join(single, ["c1", "c2"])
    kept = by_text.join(found.hint("shuffle_hash"), ["c1", "c2"]).select("raw", "c1", "c2", "spans")
    kept = kept.mapInArrow(_kept(window, with_text), "c1 long, c2 long, removed long, left_sha string, left_text string")

    out = scanned.select("doc_id", "c1", "c2", "n_words", "sha").join(contents, ["c1", "c2"]).join(kept, ["c1", "c2"], "left")
    none = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return out.select(
        "doc_id",
        "n_words",
        F.when(none, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(none, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
        F.when(none, F.lit("")).otherwise(F.col("left_text")).alias("kept_text"),
    )


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


OP9_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM s),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM c WHERE n > 1),
x AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM w),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY k) AS t FROM x ANTI JOIN gone USING (r, k) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""
