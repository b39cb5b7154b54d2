"""Near copies: ProbMinHash signatures, bands, verification, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import documents, mix, powers, prefix_hash, rolling_hash, sliced, span_hash, stored, words

WORDS, SIMILARITY = 5, 0.8
#: 24 bands of 6 components: a pair at 0.8 meets in a band of the signatures of sets with a chance above 0.999.
BANDS, DEPTH = 24, 6
SIZE = BANDS * DEPTH
#: Members of a bucket, and bytes of their shingles, that one task compares with as many others.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Text that one vectorised step takes up at most, beyond a single longer document.
_STEP = 1 << 20


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hash, count) of the distinct shingles of each text, sorted by index and hash.

    A shingle is ``WORDS`` consecutive words; a text of fewer words, but one at least, is one shingle.
    """
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    start, end = words(data)
    owner = np.searchsorted(ends, start, "right")
    hashed = span_hash(prefix_hash(data), start, end)
    prefix = prefix_hash(hashed, None)
    rolled = rolling_hash(prefix, WORDS)
    whole = owner[: len(rolled)] == owner[WORDS - 1 :]
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < WORDS))
    own = np.concatenate([owner[: len(rolled)][whole], short])
    value = np.concatenate([rolled[whole], span_hash(prefix, first[short], first[short] + count[short])])
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return own[at], value[at], np.diff(np.append(at, len(own)))


def signatures(own: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, size: int = SIZE) -> np.ndarray:
    """ProbMinHash: a row of ``size`` shingle hashes for each text; zeros where a text has no shingle.

    Each shingle is a Poisson process whose rate is its weight; an arrival falls on one component, and a
    component keeps the shingle that arrives first. Two texts agree in a component with the probability
    Jaccard similarity of their weighted shingles. A shingle stops once its time is past the latest
    component of its text, so most stop after one or two arrivals.
    """
    first = np.full(texts * size, np.inf)
    out = np.zeros(texts * size, np.uint64)
    time, latest, k = np.zeros(len(own)), np.full(texts, np.inf), 0
    while len(own):
        k += 1
        random = mix(value + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log1p(-(random >> np.uint64(11)).astype(float) * 2.0**-53) / weight
        slot = own * size + (mix(random ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        out[slot[won]] = value[won]
        latest = first.reshape(texts, size).max(1)
        on = time < latest[own]
        own, value, weight, time = own[on], value[on], weight[on], time[on]
    return out.reshape(texts, size)


def _band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each text and band."""
    parts = signature.reshape(len(signature), BANDS, DEPTH) * powers(DEPTH)[1:]
    return mix(parts.sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def _both_signatures(own: np.ndarray, value: np.ndarray, count: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures with weights of 1, which agree with the Jaccard similarity of sets, and with weights of 1 + ln(count).

    Texts without a repeated shingle have the same for both.
    """
    sets = signatures(own, value, np.ones(len(own)), texts)
    more = np.bincount(own[count > 1], minlength=texts) > 0
    weighted, use = sets.copy(), more[own]
    weighted[more] = signatures((np.cumsum(more) - 1)[own[use]], value[use], 1 + np.log(count[use]), int(more.sum()))
    return sets, weighted


def _steps(items: list[tuple], size) -> Iterator[list[tuple]]:
    step, total = [], 0
    for item in items:
        if step and total + size(item) > _STEP:
            yield step
            step, total = [], 0
        step.append(item)
        total += size(item)
    if step:
        yield step


def sketched(docs: DataFrame) -> DataFrame:
    """(node, doc_id, keys, brief, n_bytes) of each distinct text with a word: its digest, a document that has it, band keys, 16 bits of each component, and the bytes of its shingles.

    Keys and components are those of the set; where the weighted signature differs they follow, with null for an equal key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # copies in this task; forgotten now and then, as the shuffle below drops the rest
        for b in sliced(batches, "text"):
            fresh = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if t is not None and t.strip() and (d := hashlib.md5(t.encode())).digest() not in seen:
                    seen.add(d.digest())
                    fresh.append((d.hexdigest(), i, t.lower().encode()))
            if len(seen) > 500_000:
                seen.clear()
            for step in _steps(fresh, lambda x: len(x[2])):
                own, value, count = shingles([x[2] for x in step])
                sets, weighted = _both_signatures(own, value, count, len(step))
                held = np.bincount(own, minlength=len(step))
                has = held > 0
                sets, weighted = sets[has], weighted[has]
                keys, more = _band_keys(sets), _band_keys(weighted)
                differs = (keys != more).any(1)
                take = np.concatenate([np.ones(keys.shape, bool), np.repeat(differs[:, None], BANDS, 1)], 1)
                null = np.concatenate([np.zeros(keys.shape, bool), keys == more], 1)[take]
                keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(take.sum(1))).astype(np.int32)), pa.array(np.concatenate([keys, more], 1)[take], mask=null))
                brief = [(np.concatenate([x, y]) if d else x).astype("<u2").tobytes() for x, y, d in zip(sets & np.uint64(0xFFFF), weighted & np.uint64(0xFFFF), differs, strict=True)]
                at = np.flatnonzero(has)
                yield pa.RecordBatch.from_arrays([pa.array([step[i][0] for i in at], pa.string()), pa.array([step[i][1] for i in at], pa.int64()), keys, pa.array(brief, pa.binary()), pa.array(held[has] * 8, pa.int64())], names=["node", "doc_id", "keys", "brief", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "node string, doc_id long, keys array<long>, brief binary, n_bytes long").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The ``pairs`` (a, b of nodes) whose distinct shingles have a Jaccard similarity of ``similarity`` or more.

    Both texts come by joins on the node; b may be the leader of a great many, whose rows adaptive
    execution deals out. Rows come sorted by b, so its shingles are made once for a run.
    """
    a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    rows = pairs.select("a", "b").join(a, "a").join(b, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, have = None, np.zeros(0, np.uint64)
        for batch in sliced(sliced(batches, "ta"), "tb"):
            ids, keep = batch.column("b").to_pylist(), []
            texts_a = batch.column("ta")
            for i, node in enumerate(ids):
                if node != last:
                    last, have = node, shingles([batch.column("tb")[i].as_py().lower().encode()])[1]
                keep.append(_alike(shingles([texts_a[i].as_py().lower().encode()])[1], have, similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a string, b string")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles): the sorted hashes of each text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            raw = [t.lower().encode() for t in b.column("text").to_pylist()]
            own, value, _ = shingles(raw)
            cut = np.searchsorted(own, np.arange(len(raw) + 1))
            out = [value[s:e].tobytes() for s, e in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(out, pa.binary())], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node string, shingles binary")


def _alike(own: np.ndarray, have: np.ndarray, similarity: float) -> bool:
    """Do two sets of shingles have a Jaccard similarity of ``similarity`` or more?"""
    if not len(own) or min(len(own), len(have)) < similarity * max(len(own), len(have)):
        return False
    both = len(np.intersect1d(own, have, assume_unique=True))
    return both >= similarity * (len(own) + len(have) - both) - 1e-9


def _passing(table: pa.Table, similarity: float) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray]]]:
    """(labels as numbers, pairs): each member of a pair of blocks with those of other labels that its signature does not rule out.

    A pair counts in the first band in which it meets, by either signature. The signatures of sets, which agree with the
    similarity that is verified, rule out a pair six standard errors below it: a pair at ``similarity`` with a chance below 1e-9.
    """
    least = int(SIZE * (similarity - 6 * (similarity * (1 - similarity) / SIZE) ** 0.5))
    _, label = np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)
    brief = table.column("brief").to_pylist()
    sig, weighted = (np.frombuffer(b"".join(part), "<u2").reshape(len(label), SIZE) for part in ([x[: 2 * SIZE] for x in brief], [x[-2 * SIZE :] for x in brief]))
    own, (i, j, band) = np.array(table.column("own").to_pylist()), (table.column(c)[0].as_py() for c in ("i", "j", "band"))
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)

    def pairs() -> Iterator[tuple[int, np.ndarray]]:
        for x in left:
            to = right[label[right] != label[x]]
            to = to[to > x] if i == j else to
            to = to[(sig[to] == sig[x]).sum(1) >= least]
            meets = np.zeros((len(to), BANDS), bool)
            for mine in (sig, weighted):
                for other in (sig, weighted):
                    meets |= (other[to] == mine[x]).reshape(-1, BANDS, DEPTH).all(2)
            yield x, to[meets.argmax(1) == band]

    return label, pairs()


def _needed(members: DataFrame, similarity: float) -> DataFrame:
    """Members of a bucket (key, band, node, label, brief, n_bytes) that have a passing pair, by pair of blocks.

    A bucket is dealt into blocks of bounded members and bytes of shingles, and each pair of blocks is a group.
    """
    n = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    placed = members.join(n.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "node", "label", "brief")

    def run(table: pa.Table) -> pa.Table:
        label, pairs = _passing(table, similarity)
        use = np.zeros(len(label), bool)
        for x, to in pairs:
            use[to] = True
            use[x] |= len(to) > 0
        return table.filter(pa.array(use))

    return spread.groupBy("key", "i", "j").applyInArrow(run, spread.schema)


def _linked(needed: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among passing pairs of each pair of blocks, by their shingles.

    A link makes two labels one, so a group returns fewer links than it has members, however many pairs are alike.
    """

    def run(table: pa.Table) -> pa.Table:
        label, pairs = _passing(table, similarity)
        node, sets = table.column("node").to_pylist(), [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        root, a, b = np.arange(label.max(initial=0) + 1), [], []
        for x, to in pairs:
            for y in to:
                if root[label[x]] != root[label[y]] and _alike(sets[x], sets[y], similarity):
                    a.append(node[x])
                    b.append(node[y])
                    root[root == root[label[y]]] = root[label[x]]
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return needed.groupBy("key", "i", "j").applyInArrow(run, "a string, b string")


def links(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): verified links between distinct texts (digests), enough to connect all that are connected in the buckets.

    First every member of a bucket is verified against one leader: the member that meets the most others
    over all bands, so the original of many near copies. Members that stay in different components then
    meet each other in blocks. No bucket is capped.
    """
    sketches = stored(sketched(docs))
    # a key is that of a band's components, whichever signature they are from
    at = sketches.select("node", F.posexplode("keys").alias("band", "key")).where("key IS NOT NULL").withColumn("band", F.col("band") % BANDS)
    shared = at.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(at.join(shared, "key"))
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    leaders = members.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node")).getField("node").alias("b"))
    pairs = stored(members.select("key", F.col("node").alias("a")).join(leaders, "key").where("a <> b").select("a", "b").distinct())
    # whole texts of what met in a bucket, once each
    met = sketches.join(members.select("node").distinct(), "node").select("node", F.col("doc_id").alias("_id"))
    own = docs.select("doc_id", "text").where("text IS NOT NULL")
    texts = stored(own.join(met, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.md5("text") == F.col("node"))).select("node", "text").dropDuplicates(["node"]))
    found = stored(verified(pairs, texts, similarity))
    labels = components(found, "a", "b")
    named = members.select("key", "band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    rest = named.join(mixed, "key").join(sketches.select("node", "brief", "n_bytes"), "node")
    needed = stored(_needed(rest, similarity))
    sets = shingle_sets(texts.join(needed.select("node").distinct(), "node"))
    more = stored(_linked(needed.join(sets, "node"), similarity))
    return found.union(more)


def labelled(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, low, label) of each distinct text: its digest, the least doc_id of its rows (null if none has one) and its class.

    The label is the least digest of the class, so classes stay apart whatever their doc_ids are.
    """
    labels = components(links(docs, similarity), "a", "b")
    nodes = docs.select("doc_id", F.md5("text").alias("node")).where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"))
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Add class_id, the least doc_id of the row's class, to ``docs`` (doc_id, text); columns named class_id are replaced.

    Rows with equal texts are one class, and classes whose texts are linked are one: linked are texts whose
    sets of five-word shingles (lower case, split at white space) have a Jaccard similarity of ``similarity``
    or more. A row with a null text is a class of its own. Null doc_ids count only where a class has no other.
    Texts meet by signatures of their sets, and by others that weigh a shingle by 1 + ln(count). Copies are grouped before anything else is done with them.
    """
    docs = docs.drop("class_id")
    nodes = labelled(docs, similarity)
    # a component of many nodes is summed before its shuffle; a row for each component comes back
    least = nodes.groupBy("label").agg(F.min("low").alias("class_id"))
    classes = stored(nodes.join(least, "label").select(F.col("node").alias("_node"), "class_id"))
    keyed = docs.withColumn("_node", F.md5("text"))
    return keyed.join(classes, "_node", "left").withColumn("class_id", F.coalesce("class_id", "doc_id")).drop("_node")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the least doc_id of their class; see ``near_duplicates``."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id")
