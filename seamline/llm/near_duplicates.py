"""Near-duplicate records: minhash signatures, bands, verification, classes.

Everything works on the distinct sets of word shingles: records with the same set are one text, known by a 64-bit
digest of the set, and are expanded only in the result. So exact copies never meet in a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.components import components
from seamline.llm.words import blocks, mix, shingle_sets
from seamline.session import written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 4
#: A bucket larger than this is compared in blocks of this size, in tasks of their own.
BUCKET_BLOCK = 2048
#: In a bucket larger than this, signatures are compared before pairs are handed on.
SIGNED_ABOVE = 64
#: Rows of whole buckets that a task compares at a time.
HELD_ROWS = 200_000
#: Cells of the table that tells where such buckets may be: its size is fixed, whatever the data.
HOT_CELLS = 1 << 16
#: Bits of the filter that keeps only texts in candidate pairs: its size is fixed; a full filter costs time only.
FILTER_BITS = 1 << 23
#: Standard deviations below the threshold at which the estimate from signatures drops a candidate.
MARGIN = 4.0


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def _sign(width: int, bands: int, rows: int):
    """Per record: digest of its shingle set, one 64-bit key per band, one byte per minimum."""
    n = bands * rows
    schema = pa.schema([("id", pa.int64()), ("digest", pa.int64()), ("bands", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(n)
        for part, texts in blocks(batches, 1, 600_000):
            bounds, shingles = shingle_sets(texts, width)
            size = np.diff(bounds)
            kept = np.flatnonzero(size)
            if not len(kept):
                continue
            at = bounds[:-1][kept]
            digest = mix(np.add.reduceat(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), at) + size[kept].astype(np.uint64))
            x = (shingles >> np.uint64(32)).astype(np.uint32)
            minima = np.empty((len(kept), n), np.uint32)
            for p in range(n):
                minima[:, p] = np.minimum.reduceat(x * a[p] + b[p], at)
            grouped = minima.reshape(len(kept), bands, rows).astype(np.uint64)
            keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(kept), bands)).copy()
            for r in range(rows):
                keys = mix(keys + grouped[:, :, r] + np.uint64(0x632BE59BD9B4E019))
            low = mix(minima.astype(np.uint64)).astype(np.uint8)
            ids = part.column(0).to_numpy(zero_copy_only=False)[kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(digest.view(np.int64)), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([s.tobytes() for s in low], pa.binary())], schema=schema
            )

    return run


def signatures(records: DataFrame, width: int, bands: int, rows: int, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, digest, bands, signature) in the shared folder; records with null id or text or too few words are left out."""
    chosen = records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("content"))
    return written(chosen.mapInArrow(_sign(width, bands, rows), "id bigint, digest bigint, bands binary, signature binary"))


def _unique_keys(batch: pa.RecordBatch, seen: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    digest = batch.column(0).to_numpy(zero_copy_only=False)
    fresh = [i for i, d in enumerate(digest.tolist()) if d not in seen and not seen.add(d)]
    keys = np.array([np.frombuffer(k, np.int64) for k in batch.column(1).take(pa.array(fresh, pa.int64())).to_pylist()])
    return digest[fresh], keys, np.array(fresh, np.int64)


def _repeated_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands that a task holds more than once. A bucket that escapes this has at most one text in each task."""
    seen: set[int] = set()
    gathered = []
    for batch in batches:
        _, keys, _ = _unique_keys(batch, seen)
        gathered.append(keys.ravel())
    if gathered and sum(map(len, gathered)):
        band, n = np.unique(np.concatenate(gathered), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(band[n > 1]), pa.array(n[n > 1].astype(np.int64))], names=["band", "n"])


_BAND_ROWS = "bucket bigint, digest bigint, side tinyint, component bigint, signature binary"


def _emit_bands(cells: np.ndarray | None, large: bool):
    """(bucket, digest, side, component, signature) rows, one for each band of every text: of the bands in cells of large
    buckets with the signature, or of all others without it."""
    schema = pa.schema([("bucket", pa.int64()), ("digest", pa.int64()), ("side", pa.int8()), ("component", pa.int64()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            digest, keys, fresh = _unique_keys(batch, seen)
            if not len(digest):
                continue
            n, bands = keys.shape
            flat, owner = keys.ravel(), np.repeat(np.arange(n), bands)
            if cells is not None:
                chosen = cells[(mix(flat.view(np.uint64)) % np.uint64(HOT_CELLS)).astype(np.int64)] == large
                flat, owner = flat[chosen], owner[chosen]
            component = batch.column(3).take(pa.array(fresh))  # null: a component of its own
            signature = batch.column(2).take(pa.array(fresh))
            for at in range(0, len(flat), 50_000):
                own = owner[at : at + 50_000]
                signed = signature.take(pa.array(own)) if large else pa.nulls(len(own), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(flat[at : at + 50_000]), pa.array(digest[own]), pa.array(np.zeros(len(own), np.int8)), component.take(pa.array(own)), signed], schema=schema)

    return run


def _least_equal(similarity: float, n: int) -> float:
    """Equal bytes in two signatures of n below which a pair cannot reach the similarity but by chance of MARGIN deviations."""
    expected = similarity + (1 - similarity) / 256
    return n * expected - MARGIN * (n * expected * (1 - expected)) ** 0.5


def _bucket_pairs(similarity: float):
    """Pairs (a, b), a < b, of different texts in one bucket that are not known to be joined already; where the rows hold
    signatures only those that agree. Rows come sorted by bucket."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def batch_of(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> pa.RecordBatch:
        differ = (x != y) & (cx != cy)
        x, y = x[differ], y[differ]
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1) if len(x) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(bucket, bucket[-1], "left"))
            if cut and sum(b.num_rows for b in held) > HELD_ROWS:
                yield from compare([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from compare(held)

    def compare(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        bucket, digest, side = (table.column(i).to_numpy() for i in range(3))
        component = pa.compute.coalesce(table.column(3), table.column(1)).to_numpy()
        order = np.lexsort((digest, bucket))
        bucket, digest, side, component = bucket[order], digest[order], side[order], component[order]
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (digest[1:] != digest[:-1])
        bucket, digest, side, component, order = bucket[new], digest[new], side[new], component[new], order[new]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(edge, len(bucket)))
        for m in np.unique(sizes[(sizes > 1) & (sizes <= 64)]).tolist():  # all small buckets of one size at once
            at_all = edge[sizes == m][:, None] + np.arange(m)
            groups, joined = digest[at_all], component[at_all]
            i, j = np.triu_indices(m, 1)
            step = max(1, 500_000 // len(i))
            for at in range(0, len(groups), step):
                cut = slice(at, at + step)
                yield batch_of(groups[cut, i].ravel(), groups[cut, j].ravel(), joined[cut, i].ravel(), joined[cut, j].ravel())
        for at, m in zip(edge[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
            d, s, c = digest[at : at + m], side[at : at + m], component[at : at + m]
            if (c == c[0]).all():
                continue
            left, right = (np.flatnonzero(s != 2), np.flatnonzero(s != 1)) if s.any() else (np.arange(m), np.arange(m))
            packed = table.column(4).take(pa.array(order[at : at + m])).to_pylist()
            signed = np.frombuffer(b"".join(packed), np.uint8).reshape(m, -1) if packed[0] is not None else None
            for lo in range(0, len(left), 64):
                rows = left[lo : lo + 64]
                if signed is None:
                    i, j = np.nonzero(c[rows][:, None] != c[right][None, :])
                else:
                    agree = np.zeros((len(rows), len(right)), np.int16)
                    for p in range(signed.shape[1]):
                        agree += signed[rows, p][:, None] == signed[right, p][None, :]
                    i, j = np.nonzero((agree >= _least_equal(similarity, signed.shape[1])) & (c[rows][:, None] != c[right][None, :]))
                if not s.any():
                    once = d[rows[i]] < d[right[j]]
                    i, j = i[once], j[once]
                yield batch_of(d[rows[i]], d[right[j]], c[rows[i]], c[right[j]])

    return run


def _agreeing(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (4, 5))
            good = pa.array((x == y).sum(1) >= _least_equal(similarity, x.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(good) for i in range(4)], names=["a", "b", "rep_a", "rep_b"])

    return run


def _sets_of(width: int, bits: np.ndarray):
    """(id, shingles) of the records whose id may be wanted."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)
            wanted = pa.array((bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool))
            for part, texts in blocks(iter([batch.filter(wanted)]), 1):
                bounds, hashes = shingle_sets(texts, width)
                sets = [hashes[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], schema=schema)

    return run


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells: dict[int, int] = {}
    for batch in batches:
        for column in batch.columns:
            h = np.unique(mix(column.to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(FILTER_BITS))
            for x in h.tolist():
                cells[x >> 6] = cells.get(x >> 6, 0) | 1 << (x & 63)
    signed = [v - (1 << 64) if v >> 63 else v for v in cells.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int64()), pa.array(signed, pa.int64())], names=["cell", "bits"])


def _exact(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                score[i] = both / (len(x) + len(y) - both) if both else 0.0
            good = pa.array(score >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(score).filter(good)], names=["a", "b", "similarity"])

    return run


class Texts:
    """The different texts of some records with their signatures, and the ways to compare them."""

    def __init__(self, records: DataFrame, similarity: float, width: int, bands: int = BANDS, rows: int = ROWS, id_col: str = "id", text_col: str = "content") -> None:
        self.similarity, self.width = similarity, width
        self.records = records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("content"))
        self.signed = signatures(records, width, bands, rows, id_col, text_col)
        texts = self.signed.groupBy("digest").agg(F.min("id").alias("rep"))
        self.members = self.signed.select("id", "digest").distinct().join(texts, "digest").select("id", "digest", "rep")
        self._cells: np.ndarray | None = None

    def cells(self) -> np.ndarray:
        """The cells with a bucket above SIGNED_ABOVE."""
        if self._cells is None:
            many = self.signed.select("digest", "bands").mapInArrow(_repeated_bands, "band bigint, n bigint").groupBy("band").agg(F.sum("n").alias("n")).where(F.col("n") > SIGNED_ABOVE)

            def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    at = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(HOT_CELLS)
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(at.astype(np.int64)))], names=["cell"])

            self._cells = np.zeros(HOT_CELLS, bool)
            for row in many.select("band").mapInArrow(cell, "cell bigint").distinct().collect():  # at most HOT_CELLS rows
                self._cells[row.cell] = True
        return self._cells

    def _banded(self, keyed: DataFrame, large: bool | None) -> DataFrame:
        """Band rows of (digest, bands, signature, component): of large buckets, of the others, or of all."""
        shared = self.signed.sparkSession.sparkContext.broadcast(None if large is None else self.cells())
        return keyed.select("digest", "bands", "signature", "component").mapInArrow(lambda it: _emit_bands(shared.value, bool(large))(it), _BAND_ROWS)

    def _alone(self) -> DataFrame:
        return self.signed.select("digest", "bands", "signature", F.lit(None).cast("bigint").alias("component"))

    def candidates(self, joined: DataFrame | None = None) -> DataFrame:
        """Pairs (a, b) with a common band; with joined (node, component) only those of different components.

        The exact size of a large bucket is counted before its rows are dealt to blocks; one whose texts are joined
        already, or that turns out to hold a single text, is dropped before.
        """
        keyed = self._alone()
        if joined is not None:
            known = joined.select(F.col("node").alias("digest"), F.col("component").alias("found"))
            keyed = self.signed.select("digest", "bands", "signature").join(known, "digest", "left").select("digest", "bands", "signature", F.col("found").alias("component"))
        rows = self._banded(keyed, False)
        if self.cells().any():
            large = written(self._banded(keyed, True).dropDuplicates(["bucket", "digest"]))
            part = F.coalesce("component", "digest")
            sizes = large.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_BLOCK).cast("int").alias("blocks"), F.min(part).alias("low"), F.max(part).alias("high")).where("low < high")
            dealt = large.join(sizes, "bucket").withColumn("mine", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            low, high = F.least("mine", "other"), F.greatest("mine", "other")
            side = F.when(low == high, 0).when(F.col("mine") == low, 1).otherwise(2).cast("tinyint")
            rows = rows.unionByName(dealt.select(F.xxhash64("bucket", low, high).alias("bucket"), "digest", side.alias("side"), "component", "signature"))
        return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_pairs(self.similarity), "a bigint, b bigint").distinct()

    def stars(self) -> DataFrame:
        """Pairs (a, b) of the smallest digest of a bucket with each other one: as many as rows, however large a bucket."""
        rows = self._banded(self._alone(), None).select("bucket", "digest")
        least = rows.groupBy("bucket").agg(F.min("digest").alias("a"), F.max("digest").alias("most")).where("a < most").select("bucket", "a")
        return rows.join(least, "bucket").where("digest != a").select("a", F.col("digest").alias("b")).distinct()

    def candidates_with(self, chosen: DataFrame) -> DataFrame:
        """Pairs (a, b) with a common band of which at least one is among the chosen (digest): linear in the other texts."""
        rows = self._banded(self._alone(), None).select("bucket", "digest")
        mine = rows.join(chosen, "digest", "left_semi").distinct()
        met = rows.join(mine.withColumnRenamed("digest", "chosen"), "bucket").where("digest != chosen")
        return met.select(F.least("digest", "chosen").alias("a"), F.greatest("digest", "chosen").alias("b")).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of the pairs that hold: by signature first, then on the exact shingle sets."""
        by_digest = self.signed.groupBy("digest").agg(F.min("id").alias("rep"), F.first("signature").alias("signature"))
        left = by_digest.select(F.col("digest").alias("a"), F.col("rep").alias("rep_a"), F.col("signature").alias("sig_a"))
        right = by_digest.select(F.col("digest").alias("b"), F.col("rep").alias("rep_b"), F.col("signature").alias("sig_b"))
        agreed = pairs.join(left, "a").join(right, "b").select("a", "b", "rep_a", "rep_b", "sig_a", "sig_b").mapInArrow(_agreeing(self.similarity), "a bigint, b bigint, rep_a bigint, rep_b bigint")
        agreed = written(agreed)
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        per_task = agreed.select("rep_a", "rep_b").mapInArrow(_bits_of, "cell bigint, bits bigint")
        for row in per_task.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toLocalIterator():  # at most FILTER_BITS / 64 rows
            bits[row.cell] = row.bits & 0xFFFFFFFFFFFFFFFF
        filters = self.signed.sparkSession.sparkContext.broadcast(bits.view(np.uint8))
        width = self.width
        sets = self.records.mapInArrow(lambda it: _sets_of(width, filters.value)(it), "id bigint, shingles binary").dropDuplicates(["id"])
        checked = agreed.join(sets.select(F.col("id").alias("rep_a"), F.col("shingles").alias("set_a")), "rep_a").join(sets.select(F.col("id").alias("rep_b"), F.col("shingles").alias("set_b")), "rep_b")
        return written(checked.select("a", "b", "set_a", "set_b").mapInArrow(_exact(self.similarity), "a bigint, b bigint, similarity double"))


def similar_texts(records: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, id_col: str = "id", text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, digest, rep), one row per record with its text; links (a, b, similarity)
    between the digests of different texts.

    rep is the smallest id with the text. Every link is checked on the exact shingle sets; what can be missed is
    what no band brings together: (1 - similarity ** rows) ** bands of the pairs just at the threshold. Records
    with fewer words than a shingle have no row; null ids and texts neither; an empty table gives two empty ones.
    """
    texts = Texts(records, similarity, width, bands, rows, id_col, text_col)
    return texts.members, texts.verified(texts.candidates())


def near_pairs(records: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE_WORDS, **options: object) -> DataFrame:
    """(a, b), a < b: all pairs of ids whose texts are similar, copies expanded. Its size is that of the answer."""
    members, links = similar_texts(records, similarity, width, **options)
    ids = members.select("id", "digest")
    across = links.join(ids.select(F.col("id").alias("x"), F.col("digest").alias("a")), "a").join(ids.select(F.col("id").alias("y"), F.col("digest").alias("b")), "b").select("x", "y")
    several = ids.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    copies = ids.join(several.select("digest"), "digest")
    within = copies.select("digest", F.col("id").alias("x")).join(copies.select("digest", F.col("id").alias("y")), "digest").where("x < y").select("x", "y")
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def representative_pairs(records: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE_WORDS, **options: object) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): membership (id, rep), one row per record with the smallest id of its copies, and the similar
    pairs (a, b, similarity), a < b, of these representatives. Copies are not expanded, so both grow with the records and
    the different texts only."""
    members, links = similar_texts(records, similarity, width, **options)
    reps = members.groupBy("digest").agg(F.min("rep").alias("rep"))
    named = links.join(reps.select(F.col("digest").alias("a"), F.col("rep").alias("x")), "a").join(reps.select(F.col("digest").alias("b"), F.col("rep").alias("y")), "b")
    return members.select("id", "rep"), named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def near_groups(records: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, group_id): one row per record with words enough for a shingle.

    group_id is the smallest id among all records joined to it by similar texts. Copies share a group and are never
    expanded into pairs. Buckets are first joined by stars, as many pairs as rows; all other pairs of a bucket are
    compared only where the stars left them apart, so a large group of small edits costs no pairs of its members, and no
    link between groups is lost.
    """
    texts = Texts(records, similarity, width, bands, rows, id_col, text_col)
    first = texts.verified(texts.stars())
    links = first.unionByName(texts.verified(texts.candidates(components(first, "a", "b"))))
    joined = components(links, "a", "b")
    placed = texts.members.join(joined.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    least = placed.groupBy("component").agg(F.min("rep").alias("group_id"))
    return placed.join(least, "component").select("id", "group_id")
