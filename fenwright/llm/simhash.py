"""Operator 4: SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its word shingles' 64-bit hashes have it set. Fingerprints within
`radius` differing bits are linked. Every bit position is assigned a non-zero vector of radius + 1 bits; each of the
2^(radius+1) - 1 non-zero vectors v gives a mask of the positions whose vector is not orthogonal to v. At most `radius`
differing positions span less than the whole space, so some v is orthogonal to them all and its mask leaves them out: every
linked pair has equal masked fingerprints in some table, with certainty.

Only distinct fingerprints are linked, so exact copies cost one row. A bucket of a table with few fingerprints gives the
edges of a spanning forest. A larger one is not gathered: its fingerprints are dealt to all centres within half the radius,
where fingerprints of one centre are linked by the triangle inequality and linked fingerprints share a centre. Components
are found by label propagation with pointer jumping, one written table a round.

Defined cases: a null, empty or blank text has fingerprint 0 and is linked like any other; fewer words than a shingle are
one shingle; a null doc_id never names a component unless all of its documents are without an id; repeated rows are
returned each; other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_back, set_aside, stored, table, text_key

BITS = 64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes | None, shingle_words: int = 3) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    import xxhash

    w = (text or b"").translate(_LOWER).split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = memoryview(b" ".join(w))
    if len(w) <= shingle_words:
        return digest(joined, 42)
    lengths = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(w) - shingle_words + 1].tolist()
    n = len(starts)
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle_words - 1 :] - 1).tolist(), strict=True)), np.dtype("<u8"), n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def masks(radius: int) -> list[int]:
    """The covering masks, as unsigned 64-bit integers."""
    most = (1 << (radius + 1)) - 1
    vector = [i % most + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() & 1) for v in range(1, most + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [signed(fingerprint(t.as_py(), shingle_words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _spanning(radius: int):
    """Edges of a spanning forest of each bucket: its fingerprints are visited from those already reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_out: list[int] = []
            b_out: list[int] = []
            for members in b.column(0):
                x = np.sort(np.array(members.as_py(), np.int64))
                left = np.ones(len(x), bool)
                for root in range(len(x)):
                    if not left[root]:
                        continue
                    left[root] = False
                    todo = [root]
                    while todo:
                        i = todo.pop()
                        near = np.flatnonzero(left & (np.bitwise_count((x ^ x[i]).view(np.uint64)) <= radius))
                        left[near] = False
                        todo += near.tolist()
                        a_out += x[near].tolist()
                        b_out += [int(x[i])] * len(near)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return run


def _centres(fp: Column, radius: int) -> Column:
    """For an even radius, all values within half of it. For an odd one, each bit in turn is left out first, and keys hold
    which one."""
    half = radius // 2
    flips = [signed(sum(1 << i for i in c)) for k in range(half + 1) for c in combinations(range(BITS), k)]
    near = lambda x: F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: x.bitwiseXOR(f))
    if radius % 2 == 0:
        return F.transform(near(fp), lambda z: F.struct(F.lit(-1).alias("out"), z.alias("z")))
    outs = F.array(*[F.struct(F.lit(i).alias("out"), F.lit(signed(((1 << 64) - 1) ^ (1 << i))).alias("m")) for i in range(BITS)])
    return F.flatten(F.transform(outs, lambda o: F.transform(near(fp.bitwiseAND(o["m"])), lambda z: F.struct(o["out"].alias("out"), z.bitwiseAND(o["m"]).alias("z")))))


def links(fps: DataFrame, radius: int = 2, bucket: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, a > b or a < b once, whose components are those of all pairs within
    `radius` differing bits. fps: distinct values in column fp."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(signed(m)).alias("m")) for i, m in enumerate(masks(radius))])
    keyed = fps.select("fp", F.explode(tables).alias("x")).select("fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(keyed.join(sizes, ["t", "key"]), "buckets")
    small = shared.filter(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("members")).select("members").mapInArrow(_spanning(radius), "a long, b long")
    hot = shared.filter(F.col("n") > bucket).select("fp").distinct()
    dealt = hot.select("fp", F.explode(_centres(F.col("fp"), radius)).alias("c")).select("fp", "c.*")
    first = dealt.groupBy("out", "z").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).filter("b < most").drop("most")
    near = dealt.join(first, ["out", "z"]).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return small.unionByName(near).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex that each vertex of the edges (a, b) reaches."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        of = labels.select(F.col("v").alias("b"), F.col("label").alias("lb"))
        lowest = both.join(of, "b").groupBy(F.col("a").alias("v")).agg(F.min("lb").alias("near"))
        hooked = labels.join(lowest, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = hooked.join(labels.select(F.col("v").alias("label"), F.col("label").alias("next")), "label")
        step = stored(step.select("v", "old", F.least("label", "next").alias("label")), "labels")
        labels = step.select("v", "label")
        if step.filter("label <> old").isEmpty():
            return labels


def classes(fps: DataFrame, radius: int, bucket: int) -> DataFrame:
    """(fp, least, n, label) per fingerprint of fps: the smallest doc_id that has it, how many have it, and a name for its component."""
    found = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    labels = components(links(found.select("fp"), radius, bucket))
    return found.join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def shingle_set(text: bytes | None, shingle_words: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle."""
    import xxhash

    w = (text or b"").translate(_LOWER).split()
    ids = np.fromiter(map(xxhash.xxh64_intdigest, w), np.dtype("<u8"), len(w))
    h = np.full(max(len(w) - shingle_words + 1, 1), min(len(w), shingle_words), np.uint64)
    for j in range(min(len(w), shingle_words)):
        h = (h ^ ids[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band of `rows` MinHash values of a set of hashes."""
    by = np.random.default_rng(42).integers(1 << 62, 1 << 64, bands * rows, np.uint64, endpoint=False) | np.uint64(1)
    x, low = h.view(np.uint64), np.full(bands * rows, (1 << 64) - 1, np.uint64)
    for at in range(0, len(x), 2048):
        np.minimum(low, (x[at : at + 2048, None] * by).min(axis=0), out=low)
    key = np.arange(bands, dtype=np.uint64)
    for part in low.reshape(bands, rows).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _described(shingle_words: int, bands: int, rows: int):
    """(s_id, s_text, fp, size, keys): the fingerprint, the number of different shingles, and the band keys of their MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, size, keys = [], [], []
            for t in b.column("text"):
                h = shingle_set(t.as_py(), shingle_words)
                fp.append(signed(fingerprint(t.as_py(), shingle_words)))
                size.append(len(h))
                keys.append(band_keys(h, bands, rows))
            yield pa.RecordBatch.from_arrays([b.column("s_id"), b.column("s_text"), pa.array(fp, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["s_id", "s_text", "fp", "size", "keys"])

    return run


def described(docs: DataFrame, shingle_words: int = 5, bands: int = 26, rows: int = 4) -> DataFrame:
    """docs: s_id, s_text (the text's key) and text."""
    raw = docs.select("s_id", "s_text", F.col("text").cast("string").cast("binary").alias("text"))
    return stored(raw.mapInArrow(_described(shingle_words, bands, rows), "s_id long, s_text decimal(38,0), fp long, size long, keys array<long>"), "fingerprints")


def _jaccard(shingle_words: int, per_mille: int):
    """The pairs (a, b) of the texts ta and tb whose sets of shingles are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, np.zeros(0, np.int64)
        for batch in batches:
            ok = []
            for ta, tb in zip(batch.column("ta"), batch.column("tb"), strict=True):
                if (raw := tb.as_py()) != last:  # rows come sorted by b
                    last, right = raw, shingle_set(raw, shingle_words)
                left = shingle_set(ta.as_py(), shingle_words)
                both = len(np.intersect1d(left, right, assume_unique=True))
                ok.append(both * 1000 >= per_mille * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _blocks(shingle_words: int, per_mille: int):
    """A spanning forest (a, b) of the similar texts of each group. Rows come sorted by (key, i, j), and groups are whole."""

    def forest(names: list, labels: list, texts: list[bytes]) -> list[tuple]:
        sets = [shingle_set(t, shingle_words) for t in texts]
        n = np.array([len(x) for x in sets], np.float32)
        owner = np.repeat(np.arange(len(sets)), n.astype(np.int64))
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        of = np.cumsum(times > 1) - 1  # columns of shingles that two texts have
        owner, column = owner[times[column] > 1], of[column[times[column] > 1]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = int(of[-1]) + 1 if len(of) else 0
        for at in range(0, width, 4096):
            lo, hi = np.searchsorted(column, [at, at + 4096])
            m = np.zeros((len(sets), min(4096, width - at)), np.float32)
            m[owner[lo:hi], column[lo:hi] - at] = 1
            both += m @ m.T
        near = both * 1000 >= per_mille * (n[:, None] + n[None, :] - both)
        known = np.unique(np.array(labels, object), return_inverse=True)[1]
        near |= known[:, None] == known[None, :]
        out, left = [], np.ones(len(sets), bool)
        for root in range(len(sets)):
            todo = [root] if left[root] else []
            left[root] = False
            while todo:
                i = todo.pop()
                reached = np.flatnonzero(left & near[i])
                left[reached] = False
                todo += reached.tolist()
                out += [(names[k], names[i]) for k in reached.tolist() if known[k] != known[i]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[dict]) -> pa.RecordBatch:
            edges = forest([r["s_text"] for r in rows], [r["label"] for r in rows], [r["text"] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.decimal128(38, 0)) for i in (0, 1)], names=["a", "b"])

        group: tuple | None = None
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if (g := (row["key"], row["i"], row["j"])) != group:
                    if len(held) > 1:
                        yield done(held)
                    group, held = g, []
                held.append(row)
        if len(held) > 1:
            yield done(held)

    return run


def similar(docs: DataFrame, about: DataFrame, shingle_words: int = 5, similarity: float = 0.8, edges: DataFrame | None = None, small: int = 16, block: int = 256, stars: int = 2, broadcast_rows: int = 500_000) -> DataFrame:
    """Edges (a, b) of a graph of texts whose components are those of `edges` and of all pairs with similar sets of shingles (Jaccard).

    Candidates are texts with an equal band of four MinHash values in one of 26 bands: a pair with a similarity of 0.8 has none with a
    probability of one in a million, a more similar one less. Every candidate counts by its whole texts only.
    1. The pairs of bands with at most `small` texts are tested one by one.
    2. The texts of a larger band are held against one of them, `stars` times, so long as they are in several components. Of a group of
       copies hardly any text is left out then.
    3. In what is still in several components, the texts outside the largest one are dealt to blocks of about `block`, and so are those in it.
       Two blocks of the former, and one of either kind, meet in one place, where all their pairs are tested at once and only the
       edges of a spanning forest come out. So no pair of different components is passed over, none is a row of its own, and a place holds
       two blocks.

    docs: s_text and text; about: what described() says of them."""
    per_mille = round(similarity * 1000)
    raw = docs.select("s_text", F.col("text").cast("string").cast("binary").alias("text"))
    texts = about.groupBy("s_text").agg(F.first("size").alias("size"), F.first("keys").alias("keys"))
    keyed = stored(texts.select("s_text", "size", F.explode("keys").alias("key")), "bands")
    sizes = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    shared = stored(join_back(keyed, sizes, ["key"], "n", keyed.count(), ["s_text"], inner=True), "buckets")
    none = shared.select(F.col("s_text").alias("a"), F.col("s_text").alias("b")).limit(0)
    edges = none if edges is None else edges
    fits = F.least("na", "size") * 1000 >= per_mille * F.greatest("na", "size")

    def wanted(ids: DataFrame) -> DataFrame:
        """(s_text, text) of the texts with an id, each once."""
        ids = stored(ids.distinct(), "involved")
        ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
        return raw.join(ids, "s_text", "left_semi").groupBy("s_text").agg(F.first("text").alias("text"))

    def verified(pairs: DataFrame) -> DataFrame:
        one = wanted(pairs.select(F.col("a").alias("s_text")).union(pairs.select("b")))
        side = lambda name: one.select(F.col("s_text").alias(name), F.col("text").alias(f"t{name}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
        return stored(both.mapInArrow(_jaccard(shingle_words, per_mille), "a decimal(38,0), b decimal(38,0)"), "similar")

    def labelled(rows: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rows with the label of their text's component, and a star of edges for each component."""
        labels = components(edges)
        star = labels.filter("v <> label").select(F.col("v").alias("a"), F.col("label").alias("b"))
        return rows.join(labels.withColumnRenamed("v", "s_text"), "s_text", "left").withColumn("label", F.coalesce("label", "s_text")), star

    def several(rows: DataFrame, turn: int) -> DataFrame:
        """Rows of bands that are still in several components, with one text of the band."""
        ends = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("least"), F.max("label").alias("last"), F.min(F.struct(F.xxhash64("s_text", F.lit(turn)), "s_text", "label", "size")).alias("one"))
        ends = stored(ends.filter("least < last").select("key", "m", F.col("one.s_text").alias("a"), F.col("one.label").alias("la"), F.col("one.size").alias("na")), "open")
        return stored(join_back(rows, ends, ["key"], "m", max(1, ends.agg(F.sum("m")).first()[0] or 0), ["s_text"], inner=True), "unlinked")

    ordered = lambda d: d.select(F.least("a", "s_text").alias("a"), F.greatest("a", "s_text").alias("b")).distinct()
    named, edges = labelled(shared, edges)
    few = stored(named.filter(F.col("n") <= small), "few")
    left = few.select("key", F.col("s_text").alias("a"), F.col("label").alias("la"), F.col("size").alias("na"))
    pairs = few.join(left, (few["key"] == left["key"]) & (F.col("a") < F.col("s_text")) & (F.col("la") != F.col("label")) & fits)
    edges = edges.unionByName(verified(stored(ordered(pairs), "candidates")))
    rest = shared.filter(F.col("n") > small).drop("n")
    for turn in range(stars):
        named, edges = labelled(rest, edges)
        found = several(named, turn)
        if found.isEmpty():
            return edges
        edges = edges.unionByName(verified(stored(ordered(found.filter((F.col("la") != F.col("label")) & fits)), "candidates")))
        rest = found.select("s_text", "size", "key")
    named, edges = labelled(rest, edges)
    found = several(named, stars)
    if found.isEmpty():
        return edges
    # The largest component of a band, by its texts there.
    parts = found.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"))
    parts = stored(parts.groupBy("key").agg(F.max(F.struct("k", "label")).alias("x"), F.sum("k").alias("m")).select("key", "m", F.col("x.label").alias("main"), F.col("x.k").alias("k")), "parts")
    d = join_back(found.select("s_text", "label", "key"), parts, ["key"], "m", max(1, found.count()), ["s_text"], inner=True)
    inner, outer = F.ceil(F.col("k") / block), F.ceil((F.col("m") - F.col("k")) / block)
    mine = F.pmod(F.xxhash64("s_text"), F.when(F.col("label") == F.col("main"), inner).otherwise(outer))
    at = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    upto = lambda n, make: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), make)
    d = d.withColumn("mine", mine).withColumns({"inner": inner, "outer": outer})
    # Places: (i, j) of two blocks outside the component, (i, -1 - j) of one outside and one inside.
    inside = upto(F.col("outer"), lambda i: at(i, -1 - F.col("mine")))
    outside = F.concat(upto(F.col("inner"), lambda j: at(F.col("mine"), -1 - j)), upto(F.col("outer"), lambda i: at(F.least(i, F.col("mine")), F.greatest(i, F.col("mine")))))
    d = d.withColumn("places", F.when(F.col("label") == F.col("main"), inside).otherwise(outside))
    d = stored(d.select("s_text", "label", "key", "places"), "placed")
    rows = d.join(wanted(d.select("s_text")), "s_text").select("s_text", "label", "key", "text", F.explode("places").alias("p")).select("s_text", "label", "key", "p.*", "text")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "s_text")
    return edges.unionByName(stored(rows.mapInArrow(_blocks(shingle_words, per_mille), "a decimal(38,0), b decimal(38,0)"), "forests"))


def keep_one(docs: DataFrame, shingle_words: int = 5, radius: int = 2, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group, the first by doc_id (null last), then by the text's key. Texts are linked if their shingle fingerprints
    are within `radius`, or if they are similar."""
    names = docs.columns
    docs, back = set_aside(docs, ["s_id", "s_text"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = {"s_id": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "s_text": text_key(text)}
    keyed = docs.select(*[v.alias(k) for k, v in keys.items()], text.alias("text"))
    about = described(keyed, shingle_words)
    first_text = stored(about.groupBy("fp").agg(F.min("s_text").alias("text"), F.count(F.lit(1)).alias("n")), "firsts")
    by_fp = about.select("fp", "s_text").distinct().join(first_text, "fp").filter("s_text <> text").select(F.col("text").alias("a"), F.col("s_text").alias("b"))
    close = links(first_text.select("fp"), radius)
    of = lambda name: first_text.select(F.col("fp").alias(name), F.col("text").alias(f"t{name}"))
    close = close.join(of("a"), "a").join(of("b"), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
    edges = similar(keyed, about, shingle_words, similarity, by_fp.unionByName(close))
    labels = components(edges).withColumnRenamed("v", "s_text")
    ids = about.groupBy("s_text").agg(F.min("s_id").alias("s_id"))
    named = ids.join(labels, "s_text", "left").withColumn("label", F.coalesce("label", "s_text"))
    first = named.groupBy("label").agg(F.min(F.struct("s_id", "s_text")).alias("k")).select("k.*")
    return docs.withColumns(keys).join(first, ["s_id", "s_text"], "left_semi").dropDuplicates(["s_id", "s_text"]).drop("s_id", "s_text").withColumnsRenamed(back).select(*names)


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 2, bucket: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) per document: component_id is the smallest doc_id that can be reached over links."""
    fps = stored(fingerprints(docs, shingle_words), "fingerprints")
    named = classes(fps, radius, bucket)
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    facts = stored(named.join(ids, "label").select("fp", "n", "component_id"), "components")
    return join_back(fps, facts, ["fp"], "n", fps.count(), ["doc_id"]).drop("n")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
