"""N-gram Jaccard join with token-combination prefixes, and its components.

Tokens are a document's distinct word shingles (64-bit hashes). One global order puts rare tokens first, by class of
document frequency. Two sets that share at least t tokens, with t = ceil(threshold * size) of either, must
share an element of their signatures:

* the prefix of a set is its first n - t + 1 tokens, and one token more for each class of frequent tokens that it meets;
* a rare token of the prefix is a signature by itself;
* frequent tokens are dealt by hash into classes, and each pair of prefix tokens of a class is a signature. Two sets
  that share no pair share at most one token of a class, which the extension makes up for.

The number of classes follows the sizes of the two sets (LEVELS), so the pairs of a document stay about as many as
its tokens; a document whose partners may be of the next level has the signatures of both.

Frequencies are counted over all documents. A map task packs its texts in blocks; a block sends each of its distinct tokens
once to a bucket of hash space, with the number of its documents that have it, so that a token of all documents
comes as often as there are blocks. The bucket adds up and answers each block with the classes of the tokens that at
least two documents share. Only they can be part of an overlap, so they also are all that verification needs. Which document
has which tokens stays with the block. Equal sets count as one from then on.

Groups of documents with a common signature are searched in rounds, never all pairs of a group at once. In the first round a
group's pivot (the member with the fewest tokens of its own) is compared with all members. It then bounds the others:
two members share at most what both share with the pivot and what both have besides. In each later round a few
leaders from outside the largest connected part are compared with those members outside their own part that sizes, numbers of
shared tokens and the pivot leave; a leader is then done with in that group. A group leaves when its members are connected
(components are exact after every round), or when all outside its largest part have led. The rounds end when no
group is left; then every pair with a common signature was compared, was shown to be too far apart, or was connected already.
The rounds grow with the largest group, so a round's plans don't grow with the rounds before it: what was compared is one
table, and only a round that found links works on components, those that the links join.

Defined cases: null text and text without words give an empty set, linked with nothing; rows are told apart by an id
of their own, so repeated rows are linked like any others and a doc_id may come with several texts; a row with a null
doc_id takes part in links, and a component has its least doc_id that isn't null (none: null); empty tables give no
rows; other columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import shared_dir, stored, text_bytes
from quire.llm.word_hashes import finish, shingle_sets

#: Tokens that one bucket is meant to hold.
BUCKET_TOKENS = 1_500_000
#: Buckets of small inputs.
LEAST_BUCKETS = 32
#: Bytes of text whose tokens a map task packs at once.
BLOCK_BYTES = 3_000_000
#: Tokens of a higher frequency class (in more than about 260 documents) are frequent.
RARE = 111
#: (least size, number of classes of frequent tokens); the classes stay below the least overlap of such sizes.
LEVELS = ((0, 2), (16, 4), (256, 24), (2048, 192))
#: Below this threshold (in percent) the classes of small sets would no longer stay below their overlap.
LEAST_PERCENT = 80
#: About how many leaders a group has in the second, third and later rounds; one in the first.
LEADERS = (8, 64, 512)
#: Marks a step of 65,535 places that is not the last of a distance.
FAR = 0xFFFF

DOCS = "ids binary, doc_ids binary, known binary, sizes binary, digests binary, steps binary"
PACKED = f"bucket int, block long, keys binary, counts binary, {DOCS}"
COUNTED = f"block long, bucket int, n int, shared binary, tokens binary, classes binary, skipped array<long>, {DOCS}"
INFOS = "block long, id long, doc_id long, n long, digest binary"
LISTS = "id long, n long, tokens array<long>, signatures array<long>"


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def six_bytes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def to_steps(places: np.ndarray) -> bytes:
    """Ascending places as 16-bit distances."""
    gaps = np.diff(places, prepend=0)
    many = gaps // FAR
    out = np.full(len(gaps) + int(many.sum()), FAR, np.uint16)
    out[np.cumsum(many + 1) - 1] = gaps % FAR
    return out.tobytes()


def from_steps(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != FAR]


def _batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _pack(n_buckets: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each block of documents a row for each bucket with the block's distinct tokens, and a row with its documents.

    A token's bucket goes by its upper bits and its place there by its lower 48, so tokens in order are buckets in order.
    """

    def block(ids: list[int], doc_ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
        sets = shingle_sets(texts, width)
        sizes = np.array([len(s) for s in sets], np.int64)
        tokens, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        bucket = (tokens >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
        edges = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(edges))
        rows = []
        for b, start, stop in zip(full.tolist(), edges[full].tolist(), edges[full + 1].tolist(), strict=True):
            several = np.flatnonzero(counts[start:stop] > 1)
            pairs = np.stack([several, counts[start:stop][several]]).astype(np.uint32)
            rows.append({"bucket": b, "block": ids[0], "keys": six_bytes(tokens[start:stop]), "counts": pairs.tobytes()})
        owned = np.repeat(np.arange(len(sets), dtype=np.int64), sizes) * len(tokens) + place.ravel()
        known = np.array([d is not None for d in doc_ids], np.uint8)
        rows.append({"bucket": ids[0] % n_buckets, "block": ids[0], "ids": np.array(ids, np.int64).tobytes(), "doc_ids": np.array([d or 0 for d in doc_ids], np.int64).tobytes(), "known": known.tobytes(),
                     "sizes": sizes.tobytes(), "digests": b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "steps": to_steps(owned)})
        return _batch(PACKED, rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, doc_ids, texts, size = [], [], [], 0
        for batch in batches:
            for row, doc_id, text in zip(batch.column("id").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(row)
                doc_ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield block(ids, doc_ids, texts)
                    ids, doc_ids, texts, size = [], [], [], 0
        if ids:
            yield block(ids, doc_ids, texts)

    return pack


def frequency_class(df: np.ndarray) -> np.ndarray:
    """1 to 255, rising with the document frequency: exact up to 100, then 8 to the octave."""
    return np.where(df <= 100, df, np.minimum(255, 100 + 8 * np.log2(np.maximum(df, 1) / 100))).astype(np.uint8)


def _count(key: tuple, packed: pa.Table) -> pa.Table:
    """Of one bucket: for each block which of its tokens are shared, and their classes; rows with documents are passed on."""
    bucket = key[0].as_py()
    passed = packed.filter(pc.is_valid(packed["ids"]))
    docs = [name.split()[0] for name in DOCS.split(", ")]
    out = [{"block": r["block"], **{c: r[c] for c in docs}} for r in passed.select(["block", *docs]).to_pylist()]
    rows = packed.filter(pc.is_valid(packed["keys"]))
    if len(rows):
        keys = [from_six_bytes(r.as_py()) for r in rows["keys"]]
        n = []
        for k, raw in zip(keys, rows["counts"], strict=True):
            at, counts = np.frombuffer(raw.as_py(), np.uint32).reshape(2, -1)
            n.append(np.ones(len(k), np.int64))
            n[-1][at] = counts
        ends = np.cumsum([len(k) for k in keys])
        keys, n = np.concatenate(keys), np.concatenate(n)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        df = np.add.reduceat(n[order], first)
        classes = np.empty(len(keys), np.uint8)
        classes[order] = np.repeat(frequency_class(df), np.diff(np.append(first, len(ranked))))
        tokens = keys ^ finish(np.array([bucket + 1], np.uint64)) if bucket >= 1 << 16 else keys | np.uint64(bucket << 48)
        for block, start, stop in zip(rows["block"].to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            shared = classes[start:stop] > 1
            out.append({"block": block, "bucket": bucket, "n": stop - start, "shared": np.packbits(shared).tobytes(), "tokens": tokens[start:stop][shared].tobytes(), "classes": classes[start:stop][shared].tobytes()})
    return pa.Table.from_batches([_batch(COUNTED, out)])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document of the blocks' own rows."""
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            digests = pa.Array.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(r["digests"])]).cast(pa.binary())
            doc_ids = pa.array(np.frombuffer(r["doc_ids"], np.int64), mask=np.frombuffer(r["known"], np.uint8) == 0)
            yield pa.record_batch([pa.array(np.full(len(ids), r["block"])), pa.array(ids), doc_ids, pa.array(np.frombuffer(r["sizes"], np.int64)), digests], names=["block", "id", "doc_id", "n", "digest"])


def _lists(percent: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def lists(key: tuple, rows: pa.Table) -> pa.Table:
        """Of one block: the shared tokens and the signatures of each document that may have a partner."""
        own = rows.filter(pc.is_valid(rows["ids"])).to_pylist()[0]
        skipped = [s for r in rows["skipped"].to_pylist() if r is not None for s in r]
        told = rows.filter(pc.is_valid(rows["n"])).sort_by("bucket").to_pylist()
        ids, sizes = np.frombuffer(own["ids"], np.int64), np.frombuffer(own["sizes"], np.int64)
        if not told:
            return pa.Table.from_batches([_batch(LISTS, [])])
        shared = np.concatenate([np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=r["n"]) for r in told]).astype(bool)
        rank = np.cumsum(shared) - 1
        tokens, classes = (np.concatenate([np.frombuffer(r[c], kind) for r in told]) for c, kind in (("tokens", np.uint64), ("classes", np.uint8)))
        places = from_steps(own["steps"])
        doc, place = np.divmod(places, len(shared))
        kept = shared[place]
        doc, place = doc[kept], rank[place[kept]]
        t, c = tokens[place], classes[place]
        order = np.lexsort((t, c, doc))
        t, c = t[order], c[order]
        ends = np.cumsum(np.bincount(doc, minlength=len(ids)))
        open_ = ~np.isin(ids, skipped)
        out = []
        for k, (start, stop) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            n = int(sizes[k])
            # without as many shared tokens as the least overlap, a set has no partner
            if open_[k] and stop > start and stop - start >= least_overlap(n, percent):
                marks = signatures(n, t[start:stop], c[start:stop], percent)
                if len(marks):
                    out.append({"id": int(ids[k]), "n": n, "tokens": np.sort(t[start:stop]).view(np.int64), "signatures": marks})
        return pa.Table.from_batches([_batch(LISTS, out)])

    return lists


def signatures(n: int, tokens: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """Of a set of n tokens, of which these are shared (in the global order, after the others, which no set shares)."""
    out: list[np.ndarray] = []
    need = n - least_overlap(n, percent) + 1
    alone = n - len(tokens)
    largest = 100 * n // percent  # of a partner
    frequent = classes > RARE
    single = 0
    for level, (least, n_classes) in enumerate(LEVELS):
        below = LEVELS[level + 1][0] if level + 1 < len(LEVELS) else largest + 1
        if not (least <= largest and n < below):
            continue
        group = (tokens >> np.uint64(24)) % np.uint64(n_classes)
        new_class = np.zeros(len(tokens), bool)
        at = np.flatnonzero(frequent)
        new_class[at[np.unique(group[at], return_index=True)[1]]] = True
        # the prefix ends at the first place that reaches what is needed with the classes met so far
        reached = np.flatnonzero(alone + np.arange(1, len(tokens) + 1) >= need + np.cumsum(new_class))
        length = int(reached[0]) + 1 if len(reached) else len(tokens)
        if alone >= need:
            length = 0
        single = max(single, length)
        places = np.flatnonzero(frequent[:length])
        order = places[np.lexsort((tokens[places], group[places]))]
        t, g = tokens[order], group[order]
        for gap in range(1, len(order)):  # pairs of one class, by their distance in it
            same = g[gap:] == g[:-gap]
            if not same.any():
                break
            a, b = t[:-gap][same], t[gap:][same]
            out.append(finish((a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level)) ^ finish(b)))
    rare = tokens[:single]
    return np.unique(np.concatenate([rare[~frequent[:single]], *out])).view(np.int64)


def counted_blocks(docs: DataFrame, width: int) -> DataFrame:
    """Rows with the documents of each block, and rows with what each bucket answers it. `docs`: id, doc_id, text (bytes)."""
    total = docs.select(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n_buckets = max(LEAST_BUCKETS, -(-total // (6 * BUCKET_TOKENS)))
    return stored(docs.select("id", "doc_id", "text").mapInArrow(_pack(n_buckets, width), PACKED).groupBy("bucket").applyInArrow(_count, COUNTED))


def judged(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), how many tokens they share, and whether they link."""
    side = lambda c: lists.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}"))
    told = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("t_a", "t_b")).alias("both"))
    return told.select("a", "b", "both", (100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("links"))


def components(links: DataFrame) -> DataFrame:
    """id and component (least id) of each end of a link, exactly.

    In each pass labels move twice along links (which settles a star, whatever its centre) and then jump to their label's label.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())

    def moved(labels: DataFrame) -> DataFrame:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        return labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "near").alias("component"))

    labels, was = edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), None
    while True:
        via = moved(labels)
        if was is not None:
            via = moved(via)
        jump = via.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = stored(via.join(jump, "component", "left").select("id", F.least("component", "far").alias("component")))
        sum_of = new.agg(F.sum(F.col("component").cast("decimal(38, 0)"))).first()[0]  # labels only fall
        if sum_of == was:
            return new
        labels, was = new, sum_of


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (id and component) after more links: only the components that these join are looked at, each as one."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(ends)
    alone = joined.join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))
    new = joined.select(F.col("id").alias("component"), F.col("component").alias("new"))
    return stored(labels.select("id", "component").union(alone).join(new, "component", "left").select("id", F.coalesce("new", "component").alias("component")))


def link_components(lists: DataFrame, percent: int) -> DataFrame:
    """id and component of each document of `lists` that links with another."""
    members = lists.select(F.explode("signatures").alias("signature"), "id", "n", F.size("tokens").alias("shared"))
    # the pivot of each group: the member with the fewest tokens that no other document has
    pivots = members.groupBy("signature").agg(F.count("*").alias("size"), F.min(F.struct(F.col("n") - F.col("shared"), "id", "n", "shared"))["id"].alias("pivot")).where("size > 1")
    members = stored(members.join(pivots.drop("size"), "signature"))
    of_pivot = lists.select(F.col("id").alias("pivot"), F.col("n").alias("m"), F.size("tokens").alias("s"))
    sides = lambda other: (F.least("id", other).alias("a"), F.greatest("id", other).alias("b"))
    fits = lambda most: 100 * most >= percent * (F.col("n") + F.col("m") - most)
    tried = members.where("id <> pivot").select("id", "n", "shared", "pivot").distinct().join(of_pivot, "pivot").where(fits(F.least("shared", "s")))
    folder = shared_dir(lists.sparkSession)  # of all pairs compared, round by round
    compared = stored(judged(tried.select(*sides("pivot")), lists, percent), f"{folder}/pivots")
    with_pivot = F.when(F.col("id") == F.col("pivot"), F.col("shared")).otherwise(F.col("both")).alias("with_pivot")
    placed = members.select("*", *sides("pivot")).join(compared.drop("links"), ["a", "b"], "left").select("signature", "id", "n", "shared", with_pivot, (F.col("id") == F.col("pivot")).alias("led"))
    labels = components(compared.where("links"))
    for turn in range(1 << 30):
        placed = placed.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        size = F.struct("size", -F.col("component"))
        parts = placed.groupBy("signature", "component").agg(F.count("*").alias("size"), F.count_if(~F.col("led")).alias("free"))
        groups = parts.groupBy("signature").agg(F.count("*").alias("parts"), F.max_by("component", size).alias("main"), (F.sum("free") - F.max_by("free", size)).alias("waiting"))
        # a group leaves when its members are connected, or all outside its largest part have led
        placed = placed.join(groups.where("parts > 1 and waiting > 0").drop("parts"), "signature")
        # a fixed order of all documents in each turn, so that those which lead do so in most of their groups
        order = F.shiftrightunsigned(F.xxhash64("id", F.lit(turn)), 11) / F.lit(float(1 << 53))
        leads = ~F.col("led") & (F.col("component") != F.col("main")) & (order * F.col("waiting") < LEADERS[min(turn, len(LEADERS) - 1)])
        placed = stored(placed.select("signature", "id", "n", "shared", "with_pivot", "led", "component", leads.alias("leads")))
        if not placed.limit(1).count():
            return labels
        marks = placed.groupBy("id").agg(F.collect_list("signature").alias("open"), F.collect_list(F.when(F.col("leads"), F.col("signature"))).alias("leading"))
        marked = placed.join(marks.withColumnRenamed("id", "whose"), F.col("id") == F.col("whose"))
        leaders = marked.where("leads").select("signature", F.col("id").alias("leader"), F.col("component").alias("own"), F.col("n").alias("m"), F.col("shared").alias("s"), F.col("with_pivot").alias("p"), F.col("leading").alias("theirs"))
        by_pivot = F.least("with_pivot", "p") + F.least(F.col("shared") - F.col("with_pivot"), F.col("s") - F.col("p"))
        most = F.least("shared", "s", F.coalesce(by_pivot, F.col("shared")))  # of an overlap
        # of all groups in which the two meet, only the first gives the pair
        first = F.array_min(F.array_intersect("open", "theirs")) == F.col("signature")
        met = marked.select("signature", "id", "n", "shared", "with_pivot", "component", "open").join(leaders, "signature")
        pairs = met.where((F.col("component") != F.col("own")) & fits(most) & first).select(*sides("leader")).distinct()
        before = lists.sparkSession.read.schema("a long, b long").option("recursiveFileLookup", "true").parquet(folder)
        links = stored(judged(pairs.join(before, ["a", "b"], "left_anti"), lists, percent), f"{folder}/{turn}").where("links")
        if links.limit(1).count():
            labels = merged(labels, links)
        placed = placed.select("signature", "id", "n", "shared", "with_pivot", (F.col("led") | F.col("leads")).alias("led"))


def link_groups(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """id, doc_id, n (size of the set), class_id (least id with the same set) and component (least id that links reach).

    `rows`: id (unique), doc_id and text; the ids are taken as they come in this one pass over the rows.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be {LEAST_PERCENT} to 100")
    blocks = counted_blocks(rows.select(F.col("id").cast("long"), F.col("doc_id").cast("long"), text_bytes().alias("text")), width)
    infos = blocks.where("ids is not null").select("block", *(f.split()[0] for f in DOCS.split(", ")[:5])).mapInArrow(_documents, INFOS)
    classes = infos.where("n > 0").groupBy("digest").agg(F.min("id").alias("class_id"), F.count("*").alias("size")).where("size > 1").drop("size")
    infos = stored(infos.join(classes, "digest", "left").select("block", "id", "doc_id", "n", F.coalesce("class_id", "id").alias("class_id")))
    skipped = infos.where("id <> class_id").groupBy("block").agg(F.collect_list("id").alias("skipped"))  # at most a block's documents
    lists = stored(blocks.unionByName(skipped, allowMissingColumns=True).groupBy("block").applyInArrow(_lists(percent), LISTS))
    labels = link_components(lists, percent).withColumnRenamed("id", "class_id")
    return infos.join(labels, "class_id", "left").select("id", "doc_id", "n", "class_id", F.coalesce("component", "class_id").alias("component"))


def join_documents(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    rows = docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text")
    linked = stored(link_groups(rows, width, percent))
    least = linked.groupBy("component").agg(F.count("*").alias("size"), F.min("doc_id").alias("least")).where("size > 1").drop("size")
    told = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return linked.join(least.withColumnRenamed("component", "c"), F.col("component") == F.col("c"), "left").select("doc_id", F.col("n").alias("n_shingles"), told.alias("component_id"))
