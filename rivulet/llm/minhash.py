"""Near-duplicate texts by consistent weighted sampling of TF-IDF shingles.

1. The document frequency of five-word shingles, hashed to a fixed number of
   slots, is counted over all documents. A shingle weighs its occurrences in the
   text times its inverse document frequency.
2. Improved consistent weighted sampling draws BANDS x ROWS samples of each
   text; two texts share a sample with the probability of their weighted
   Jaccard similarity. Equal samples in a band put texts in a bucket. Copies of a
   text are folded to one before.
3. Texts of a bucket whose share of equal samples reaches the similarity less
   MARGIN, and all texts of a bucket of more than BLOCK, are loosely tied. Ties need
   no text; what they join is a neighbourhood, and every link lies within one.
4. The texts of a neighbourhood meet in one task, once each, and every pair
   that reaches the share is verified there on the whole texts by weighted
   Jaccard, unless verified links have joined its two texts already.
5. A neighbourhood too large for a task is cut into chunks. Each chunk is worked
   on like a small neighbourhood; then its texts are compared with the best
   connected texts (hubs) of all chunks, which joins the many variants of one text;
   then the buckets name the texts of every pair that reaches the share and still lies
   between two classes and two chunks, and those of two chunks meet in one task, which
   verifies all these pairs. Pairs never become rows. Nothing is capped.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import ARROW_ROWS, lookup, map_batches, materialise, only_ids
from rivulet.llm.components import components
from rivulet.llm.words import MIX as _MIX, mixed, ngrams, texts_of, word_hashes

BANDS, ROWS, SHINGLE = 15, 4, 5
#: Slots of shingles; how much more the rarest shingle weighs than one of every document.
IDF_BITS, IDF_RANGE = 20, 0.5
#: What tasks counted is added up in so many lanes first.
LANES = 64
#: Slots travel in rows of so many.
_ROW = 1 << 10
#: Texts compared in one task, and their bytes; hubs of a neighbourhood.
BLOCK, BLOCK_BYTES, HUBS = 512, 4_000_000, 64
#: A pair is verified if its share of equal samples is at most so far below the similarity (four standard deviations).
MARGIN = 0.2
#: Texts that one is verified against at once, at first and at most.
FIRST, MOST = 8, 256
_SLOT = np.uint64(64 - IDF_BITS)
#: Shingles sampled at once.
_AT_ONCE = 1024


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """A hash of every shingle of a text, in order. Fewer than five words are one shingle."""
    return ngrams(hashes, min(SHINGLE, len(hashes))) if len(hashes) else np.empty(0, dtype=np.uint64)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold a shingle of each slot, and all documents; 2 ** IDF_BITS numbers, whatever the corpus."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << IDF_BITS, dtype=np.int32), 0
        for batch in batches:
            for t in texts_of(batch.column(0)):
                slots = np.sort((shingle_hashes(word_hashes(t)) >> _SLOT).astype(np.int32))
                total[slots[np.diff(slots, prepend=-1) > 0]] += 1
                n += 1
        rows = total.reshape(-1, _ROW)
        at = np.flatnonzero(rows.any(axis=1))
        counts = [r.tobytes() for r in rows[at]]
        task = TaskContext.get().partitionId() % LANES
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array([task] * (len(at) + 1), pa.int32()), pa.array([*counts, np.array([n], dtype=np.int32).tobytes()], pa.binary())], names=["at", "lane", "counts"])

    def adder(kind: str):
        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums by row of slots of what comes to this task, as it comes."""
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for at, counts in zip(batch.column("at").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    totals[at] = totals.get(at, 0) + np.frombuffer(counts, dtype=kind).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["at", "counts"])

        return added

    partial = map_batches(docs.select("text"), counted, "at long, lane int, counts binary")
    # in two steps, so that what all tasks counted of a slot is not added up by one
    lanes = map_batches(partial.repartition("at", "lane"), adder("i4"), "at long, counts binary", ARROW_ROWS)
    rows = map_batches(lanes.repartition("at"), adder("i8"), "at long, counts binary", ARROW_ROWS).collect()  # bounded by the slots
    df, n = np.zeros((1 << IDF_BITS) // _ROW * _ROW, dtype=np.int64).reshape(-1, _ROW), 0
    for r in rows:
        counts = np.frombuffer(r["counts"], dtype=np.int64)
        if r["at"] < 0:
            n = int(counts[0])
        else:
            df[r["at"]] = counts
    return df.ravel(), n


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    """1 for a shingle of every document to 1 + IDF_RANGE for one of none.

    The range is fixed, so that it does not depend on the corpus' size, and
    narrow: what a large group of near copies shares is frequent because of the group,
    and at full weight the few shingles that tell its members apart would
    count for more than all they share.
    """
    return (1.0 + IDF_RANGE * np.log((n + 1.0) / (df + 1.0)) / np.log(n + 2.0)).astype(np.float32)


def weighted_shingles(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their weights."""
    shingles, counts = np.unique(shingle_hashes(hashes), return_counts=True)
    return shingles, counts * idf[(shingles >> _SLOT).astype(np.int64)].astype(np.float64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


class Sampler:
    """Consistent weighted samples; equal shingles of equal weight give equal samples anywhere."""

    def __init__(self, k: int = BANDS * ROWS, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.r = draw.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
        self.log_c = np.log(draw.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
        self.beta = draw.random(1 << 16).astype(np.float32)
        self.keys = draw.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)
        # what is drawn at once is kept in the same memory from call to call
        self.wide = np.empty(k * _AT_ONCE, dtype=np.uint64), np.empty(k * _AT_ONCE, dtype=np.int64)
        self.narrow = tuple(np.empty(k * _AT_ONCE, dtype=np.float32) for _ in range(4))

    def sample(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit sample for each key."""
        log_w, keys = np.log(weights).astype(np.float32), self.keys[:, None]
        columns, best, out = np.arange(len(keys)), None, None
        for at in range(0, len(shingles), _AT_ONCE):
            part = shingles[at : at + _AT_ONCE]
            shape, n = (len(keys), len(part)), len(keys) * len(part)
            x, slot = (buffer[:n].reshape(shape) for buffer in self.wide)
            r, beta, value, t = (buffer[:n].reshape(shape) for buffer in self.narrow)
            bits = slot.view(np.uint64)
            # mixed(part * keys), in place
            np.multiply(part, keys, out=x)
            np.bitwise_xor(x, np.right_shift(x, np.uint64(32), out=bits), out=x)
            np.multiply(x, _MIX, out=x)
            np.bitwise_xor(x, np.right_shift(x, np.uint64(29), out=bits), out=x)
            for table, shift, drawn in ((self.r, 0, r), (self.beta, 16, beta), (self.log_c, 32, value)):
                np.bitwise_and(np.right_shift(x, np.uint64(shift), out=bits), np.uint64(0xFFFF), out=bits)
                table.take(slot, out=drawn, mode="clip")  # a table has a row for each slot; clip only spares a copy
            np.divide(log_w[at : at + _AT_ONCE], r, out=t)
            t += beta
            np.floor(t, out=t)
            np.subtract(t, beta, out=beta)
            beta += np.float32(1)
            beta *= r
            value -= beta
            where = value.argmin(axis=1)
            least = value[columns, where]
            drawn = mixed(part[where] + t[columns, where].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            if best is None:
                best, out = least, drawn
            else:
                better = least < best
                best, out = np.where(better, least, best), np.where(better, drawn, out)
        return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key a band for each row of samples."""
    keys = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    bands = samples.astype(np.uint64).reshape(-1, BANDS, ROWS)
    for j in range(ROWS):
        keys = mixed(keys * np.uint64(0xC2B2AE3D27D4EB4F) + bands[:, :, j])
    return keys.astype(np.int64)


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, copy, sig, bytes) of texts with words; ``copy`` is the md5 of the text, ``bytes`` its length."""
    sent = docs.sparkSession.sparkContext.broadcast(idf)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.md5("text").alias("copy"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, known = Sampler(), OrderedDict()
        for batch in batches:
            sigs, texts = [], texts_of(batch.column(1))
            for t, copy in zip(texts, batch.column(2).to_pylist(), strict=True):
                if copy not in known:
                    shingles, weights = weighted_shingles(word_hashes(t), sent.value)
                    known[copy] = sampler.sample(shingles, weights).astype("<u4").tobytes() if len(shingles) else None
                    if len(known) > 2000:
                        known.popitem(last=False)
                sigs.append(known[copy])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sigs, pa.binary()), pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "copy", "sig", "bytes"])

    return map_batches(rows, signed, "doc_id long, copy string, sig binary, bytes long").where("sig IS NOT NULL")


def _equal_share(sigs: np.ndarray, others: np.ndarray | None = None) -> np.ndarray:
    others = sigs if others is None else others
    total = np.zeros((len(sigs), len(others)), dtype=np.uint8)
    for k in range(sigs.shape[1]):
        total += sigs[:, k][:, None] == others[:, k][None, :]
    return total / np.float32(sigs.shape[1])


def _sigs(entries: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(entries), dtype="<u4").reshape(len(entries), -1)


class _Sets:
    """A few hundred nodes and the sets they are joined to."""

    def __init__(self, ids: np.ndarray):
        _, self.root = np.unique(ids, return_inverse=True)  # equal ids are one node

    def join(self, i: int, j: int) -> None:
        self.root[self.root == self.root[j]] = self.root[i]


# buckets to neighbourhoods


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = band_keys(_sigs(batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(keys.ravel())], names=["rep", "key"])


def buckets(reps: DataFrame) -> DataFrame:
    """(rep, key, size, least) for each text and each of its buckets that holds others too."""
    placed = materialise(map_batches(reps.select("rep", "sig"), _banded, "rep long, key long", 2048), "bands")
    sizes = materialise(placed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1").withColumn("size", F.col("n")), "bucket-sizes")
    return materialise(lookup(placed, sizes, "key", BANDS * reps.count()), "buckets")


def _tied(low: float):
    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A forest over the texts of each bucket that ties all pairs with a share of ``low``."""
        for batch in batches:
            for at in range(batch.num_rows):
                members = batch.slice(at, 1).to_pylist()[0]["members"]
                ids = np.array([e["rep"] for e in members], dtype=np.int64)
                near, sets, a, b = _equal_share(_sigs([e["sig"] for e in members])) >= low, _Sets(ids), [], []
                for i in range(len(ids)):
                    for j in np.flatnonzero(near[i]):
                        if sets.root[i] != sets.root[j]:
                            sets.join(i, j)
                            a.append(ids[i])
                            b.append(ids[j])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return tied


def neighbourhoods(placed: DataFrame, reps: DataFrame, low: float) -> DataFrame:
    """(id, component) of texts loosely tied to others."""
    small = placed.where(F.col("size") <= BLOCK).select("rep", "key")
    signed = small.join(reps.select("rep", "sig"), "rep").groupBy("key").agg(F.collect_list(F.struct("rep", "sig")).alias("members"))  # at most BLOCK
    # written, so that a task never needs a second Python worker for what components() does next
    ties = materialise(map_batches(signed.select("members"), _tied(low), "a long, b long", 64), "ties")
    stars = placed.where((F.col("size") > BLOCK) & (F.col("rep") != F.col("least"))).select(F.col("rep").alias("a"), F.col("least").alias("b"))
    return components(ties.unionByName(stars))


# verification within a task


class _Verifier:
    def __init__(self, idf: np.ndarray, similarity: float):
        self.idf, self.similarity = idf, similarity

    def links(self, ids: np.ndarray, sigs: np.ndarray, texts: list[bytes], hubs: np.ndarray, classes: np.ndarray | None = None, sides: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Verified links that join what all links of these texts join, and each text's number of near ones.

        Rows marked as ``hubs`` are compared with all; if there are any, others
        are not compared with each other. Best connected texts come first, which
        joins most of a group at once; pairs already joined, here or by ``classes``, are not
        verified, nor are pairs of one of the ``sides``.
        """
        share = _equal_share(sigs)
        degree = (share >= self.similarity - 0.05).sum(axis=1)
        near, sets, found = share >= self.similarity - MARGIN, _Sets(ids if classes is None else classes), []
        if hubs.any():
            near &= hubs[:, None] | hubs
        if sides is not None:
            near &= sides[:, None] != sides
        involved = np.flatnonzero((near & (sets.root[:, None] != sets.root)).any(axis=1))
        if not len(involved):
            return found, degree
        shingles, weights = {}, {}
        for i in involved.tolist():
            shingles[i], weights[i] = weighted_shingles(word_hashes(texts[i]), self.idf)
        known = np.unique(np.concatenate(list(shingles.values())))
        shingles = {i: np.searchsorted(known, s).astype(np.int32) for i, s in shingles.items()}
        total = np.zeros(len(ids))
        total[involved] = [weights[i].sum() for i in involved.tolist()]
        own = np.zeros(len(known))
        order = involved[np.argsort(-degree[involved], kind="stable")]
        for i in (order[hubs[order]] if hubs.any() else order).tolist():
            own[shingles[i]] = weights[i]
            todo = np.flatnonzero(near[i] & (sets.root != sets.root[i]))
            near[:, i] = False
            todo, at_once = todo[np.argsort(-share[i, todo], kind="stable")], FIRST
            while len(todo):
                part, todo = todo[:at_once], todo[at_once:]
                held = [shingles[j] for j in part.tolist()]
                starts = np.cumsum([0, *map(len, held[:-1])])
                shared = np.add.reduceat(np.minimum(own[np.concatenate(held)], np.concatenate([weights[j] for j in part.tolist()])), starts)
                hits = part[shared >= self.similarity * (total[i] + total[part] - shared)]
                for j in hits.tolist():
                    if sets.root[j] != sets.root[i]:
                        sets.join(i, j)
                        found.append((int(ids[i]), int(ids[j])))
                if len(hits):
                    todo = todo[sets.root[todo] != sets.root[i]]
                at_once = min(4 * at_once, MOST)
            own[shingles[i]] = 0.0
        return found, degree


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows that are equal in the first two columns."""
    held, key = [], None
    for batch in batches:
        first, second = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((first[1:] != first[:-1]) | (second[1:] != second[:-1])) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            here = (int(first[start]), int(second[start]))
            if held and here != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = here
            held.append(batch.slice(start, end - start))
    if held:
        yield key, pa.Table.from_batches(held)


def block_links(members: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """(a, b, degree) from ``members`` (component, chunk, rep, sig, text, hub), each chunk in one task.

    Rows with a null degree are links. The others name, for each chunk, its
    four best connected texts: a is the component, b the text.
    """
    sent = members.sparkSession.sparkContext.broadcast(idf)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verifier = _Verifier(sent.value, similarity)
        for (component, _), group in _groups(batches):
            ids, hubs = group.column("rep").to_numpy(), group.column("hub").to_numpy()
            texts = texts_of(group.column("text").combine_chunks())
            pairs, degree = verifier.links(ids, _sigs(group.column("sig").to_pylist()), texts, hubs)
            top = np.argsort(-degree, kind="stable")[:4]
            a = [*(x for x, _ in pairs), *[component] * len(top)]
            b = [*(y for _, y in pairs), *ids[top].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*[None] * len(pairs), *degree[top].tolist()], pa.int64())], names=["a", "b", "degree"])

    rows = members.select("component", "chunk", "rep", "sig", "text", "hub")
    rows = rows.repartition("component", "chunk").sortWithinPartitions("component", "chunk", "rep")
    return map_batches(rows, linked, "a long, b long, degree long", 512)


def neighbour_links(near: DataFrame, reps: DataFrame, docs: DataFrame, idf: np.ndarray, similarity: float, repeats: bool) -> tuple[DataFrame, DataFrame | None]:
    """Verified (a, b) within neighbourhoods ``near`` (id, component), and the texts (component, chunk, rep, sig, text) of those cut into chunks, if any are."""
    placed = near.select(F.col("id").alias("rep"), "component").join(reps, "rep")
    placed = materialise(placed, "neighbours")
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    sizes = materialise(sizes.withColumn("chunks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES)).cast("bigint")), "neighbourhood-sizes")
    placed = lookup(placed, sizes.select("component", "n", "chunks"), "component", placed.count()).withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks"))
    texts = only_ids(docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), placed.select("rep"), "rep")
    if repeats:  # each of several texts with one doc_id once, with its own samples
        texts = texts.withColumn("copy", F.md5("text")).dropDuplicates(["rep", "copy"])
        members = placed.join(texts, ["rep", "copy"])
    else:
        members = placed.join(texts, "rep")
    large = not sizes.where("chunks > 1").isEmpty()
    if large:  # their texts are read again
        members = materialise(members, "members")
    found = materialise(block_links(members.withColumn("hub", F.lit(False)), idf, similarity), "links")
    links = found.where("degree IS NULL").select("a", "b")
    cut = None
    if large:
        best = Window.partitionBy("component").orderBy(F.desc("degree"), "rep")
        hubs = found.where("degree > 1").select(F.col("a").alias("component"), F.col("b").alias("rep"), "degree").distinct()
        hubs = hubs.join(sizes.where("chunks > 1").select("component"), "component", "left_semi").withColumn("k", F.row_number().over(best)).where(F.col("k") <= HUBS).select("rep")
        hubs = materialise(hubs, "hubs")
        cut = members.where("chunks > 1").select("component", "chunk", "chunks", "rep", "sig", "text")
        everywhere = cut.join(hubs, "rep", "left_semi").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        both = cut.join(hubs, "rep", "left_anti").withColumn("hub", F.lit(False)).unionByName(everywhere.withColumn("hub", F.lit(True)))
        more = materialise(block_links(both, idf, similarity).where("degree IS NULL").select("a", "b"), "hub-links")
        links = links.unionByName(more)
    return links, cut


# what large neighbourhoods leave


def _apart(hit: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, chunk) for each row of ``hit`` and each chunk of its columns in which it is true anywhere."""
    order = np.argsort(chunks, kind="stable")
    found, starts = np.unique(chunks[order], return_index=True)
    rows, at = np.nonzero(np.logical_or.reduceat(hit[:, order], starts, axis=1))
    return rows, found[at]


def _unjoined(low: float):
    def unjoined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of all pairs of a text of ``few`` and one of another class and chunk that reach the share, once for each two chunks."""
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                few, many = ([e for e in row["members"] if e["few"] == side] for side in (True, False))
                if not few or not many:
                    continue
                one, other = ({name: np.array([e[name] for e in part], dtype=np.int64) for name in ("component", "chunk", "rep", "class")} for part in (few, many))
                share = _equal_share(_sigs([e["sig"] for e in few]), _sigs([e["sig"] for e in many]))
                hit = (share >= low) & (one["class"][:, None] != other["class"]) & (one["chunk"][:, None] != other["chunk"])
                for part, reached, chunks in ((one, hit, other["chunk"]), (other, hit.T, one["chunk"])):
                    i, chunk = _apart(reached, chunks)
                    cells = np.minimum(part["chunk"][i], chunk) << 31 | np.maximum(part["chunk"][i], chunk)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part["component"][i], cells, part["rep"][i], part["class"][i])], names=["component", "cell", "rep", "class"])

    return unjoined


def unjoined_texts(placed: DataFrame, cut: DataFrame, classes: DataFrame, low: float) -> DataFrame:
    """(component, cell, rep, class) of texts of ``cut`` that share a bucket and a share of ``low`` with one of another class and chunk.

    A cell is two chunks; whatever was in one chunk has been compared. The texts outside
    a bucket's largest class are dealt to blocks, and each block is compared with
    each block of the whole bucket.
    """
    rows = placed.select("rep", "key").join(cut.select("component", "chunk", "rep", "sig"), "rep").join(classes.select(F.col("id").alias("rep"), F.col("component").alias("c")), "rep", "left")
    rows = rows.select("key", "component", "chunk", "rep", "sig", F.coalesce("c", "rep").alias("class"))
    rows = materialise(rows, "unjoined-buckets")
    by_class = rows.groupBy("key", "class").agg(F.count("*").alias("n"))
    sizes = by_class.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("top"), F.count("*").alias("k")).where("k > 1")
    sizes = sizes.select("key", "n", F.col("top.class").alias("largest"), F.ceil((F.col("n") - F.col("top.n")) / (2 * BLOCK)).cast("bigint").alias("fews"), F.ceil(F.col("n") / (8 * BLOCK)).cast("bigint").alias("manys"))
    rows = lookup(rows, materialise(sizes, "unjoined-sizes"), "key", rows.count())
    many = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("fews") - 1)).alias("i"), F.pmod(F.xxhash64("rep"), "manys").alias("j"), F.lit(False).alias("few"))
    few = rows.where(F.col("class") != F.col("largest")).select("*", F.pmod(F.xxhash64("rep", F.lit(1)), "fews").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("manys") - 1)).alias("j"), F.lit(True).alias("few"))
    blocks = few.unionByName(many).groupBy("key", "i", "j").agg(F.collect_list(F.struct("component", "chunk", "rep", "sig", "class", "few")).alias("members"))
    return map_batches(blocks.select("members"), _unjoined(low), "component long, cell long, rep long, class long", 1).distinct()


def cell_links(texts: DataFrame, cut: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Verified (a, b) of different classes and chunks among ``texts`` (component, cell, rep, class), each cell in one task."""
    sent = texts.sparkSession.sparkContext.broadcast(idf)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verifier = _Verifier(sent.value, similarity)
        for _, group in _groups(batches):
            ids, classes, sides = (group.column(name).to_numpy() for name in ("rep", "class", "chunk"))
            held = texts_of(group.column("text").combine_chunks())
            pairs, _ = verifier.links(ids, _sigs(group.column("sig").to_pylist()), held, np.zeros(len(ids), dtype=bool), classes, sides)
            yield pa.RecordBatch.from_arrays([pa.array([x[end] for x in pairs], pa.int64()) for end in (0, 1)], names=["a", "b"])

    rows = texts.join(cut.select("rep", "chunk", "sig", "text"), "rep").select("component", "cell", "rep", "class", "chunk", "sig", "text")
    rows = rows.repartition("component", "cell").sortWithinPartitions("component", "cell", "rep")
    return map_batches(rows, linked, "a long, b long", 512)


def near_duplicate_classes(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs`` (doc_id, text).

    class_id is the smallest doc_id that verified links reach. Texts without
    words (null, empty, blank) link with nothing, nor do rows without a doc_id.
    Texts of fewer than five words are one shingle, so only equal word sequences
    link. Copies are in one class. Very long texts count whole, like any other.
    Rows with the same doc_id and different texts are rows of one document.
    Ties (equal shares) are settled by the smaller doc_id and change no class.
    Other columns are left aside, whatever their names; an empty table gives an
    empty result.
    """
    docs, low = docs.select("doc_id", "text"), similarity - MARGIN
    df, n = document_frequency(docs)
    idf = idf_table(df, n)
    signed = materialise(signatures(docs, idf).where("doc_id IS NOT NULL"), "signatures")
    folded = materialise(signed.groupBy("copy").agg(F.min(F.struct("doc_id", "sig", "bytes")).alias("x"), F.count("*").alias("n")), "texts")
    reps = folded.select("copy", F.col("x.doc_id").alias("rep"), "x.sig", "x.bytes")
    again = folded.where("n > 1").select("copy", F.col("x.doc_id").alias("rep"), "n")
    again = materialise(again, "repeated")
    copies = lookup(signed.select("doc_id", "copy"), again, "copy", signed.count()).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    copies = materialise(copies, "copies")
    repeats = not signed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    placed = buckets(reps)
    near = neighbourhoods(placed, reps, low)
    links, cut = neighbour_links(near, reps, docs, idf, similarity, repeats)
    joined = components(links.unionByName(copies))
    if cut is not None:
        left = materialise(unjoined_texts(placed, cut, joined, low), "unjoined")
        more = materialise(cell_links(left, cut, idf, similarity), "cell-links")
        joined = components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return rows.join(joined, rows["doc_id"] == joined["id"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
