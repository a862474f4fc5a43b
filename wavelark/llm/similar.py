"""Near copies by shingles of five words: one document of each group of texts whose shingle sets are 0.8 alike or more.

Candidates come from two sources first. Whole-text SimHash fingerprints that differ in at most 3 bits are found by the anchors
of ``simhash``. Texts that are 0.8 alike differ in about ten bits, beyond the reach of any covering of 64 bits, so each
text also has ``BANDS`` sampled fingerprints: the ``ROWS`` shingles that come first in ROWS random orders, the same for
two texts with probability similarity^ROWS each; at 0.8, one of 16 is with probability 0.9998. Texts that share a sampled
fingerprint are led: in random order, each is offered to the leader whose sketch (64 minima) is most like its own, or,
where none is near, leads itself. Only leaders are held, so a group of any size needs the memory of its leaders alone, and
no group gives more rows than members; a large group is dealt to many tasks, whose leaders then meet, and the followers
of one leader are dealt to many tasks for the check, too.

Both sources can miss a pair: a sampled fingerprint by chance, a leader where two of its followers are like each other but
not like it. So a third one completes them. With all shingles in one order, two texts that are 0.8 alike share one of the
first fifth (and one) of each; every text goes to these, its rare shingles, and all pairs that meet there with different
groups so far are candidates but those whose sizes, places in the order or parities of shingle counts (1024 bits) prove
them less alike. Large meetings are dealt to tasks by pairs of parts. Any order gives the same links; shingles that a
bounded sample of texts has often come last, so that common passages bring few texts together. No link is lost.

Every candidate pair is checked by the exact likeness of its shingle sets (as 64-bit hashes), so nothing less alike is ever
joined.

Texts with equal words (A-Z lower-cased) are one text, whatever their white space; texts of fewer than five words have one
shingle, all of them; null text counts as empty, and texts without a word are one text. Of a group the document of least
id stays, null ids last; of rows with that very id, the one whose text has the least hash; of equal rows, one. Columns
pass through unchanged, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from . import common, simhash

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Of 64 minima the share that two texts of likeness 0.8 have in common is 0.8 with a deviation of 0.05.
NEAR = 0.65
#: About so many members of a group are led in one task, or meet another so many.
SPLIT = 16_384
#: Texts whose shingles are counted for the order of rare shingles, about, and shingles that are held to be common, at most.
SAMPLE, COMMON = 20_000, 500_000
#: Parities of shingle counts.
BITS = 1024
#: So many texts, at most, meet with all pairs made at once.
FEW = 64
#: Bytes of text whose words are told apart together.
BLOCK = 4 << 20
_ODD = np.random.Generator(np.random.PCG64(9)).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on all bits of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def plain(text: str | None) -> bytes:
    """The words of a text, A-Z lower-cased, with single spaces."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def _chained(own: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbours."""
    n = len(own) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = _mixed(h * np.uint64(3) + own[i : i + n])
    return h


def shingles(texts: list[bytes], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text of plain() a hash of each shingle, repeats included. Texts are taken together up to BLOCK bytes."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        some, at = texts[at:end], end
        names, codes = common.distinct_words(b" ".join(some))
        own = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))[codes] if names else np.zeros(0, np.uint64)
        chained = _chained(own, shingle) if len(own) >= shingle else own[:0]
        begin = 0
        for n in (t.count(b" ") + 1 if t else 0 for t in some):
            yield chained[begin : begin + n - shingle + 1] if n >= shingle else _chained(own[begin : begin + n], n) if n else own[:0]
            begin += n


def majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint: a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 255):  # so few that a byte can hold the sum
        bits = np.unpackbits(hashes[a : a + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def minima(hashes: np.ndarray) -> np.ndarray:
    """For each random order the least hash."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[a : a + 2048, None] * _ODD).min(axis=0), out=least)
    return least


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of shingles, given as hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def rare(distinct: np.ndarray, often: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Of a sorted set of shingles so many that come first as any set that is alike shares one: common shingles come last.
    often: common shingles, sorted, and how common each is."""
    n = len(distinct)
    first = n - int(np.ceil(similarity * n - 1e-9)) + 1
    known, counts = often
    if not len(known):
        return distinct[:first]
    at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
    return distinct[np.argsort(np.where(known[at] == distinct, counts[at], 0), kind="stable")[:first]]


def parities(distinct: np.ndarray) -> bytes:
    """Whether each of BITS parts of all hashes has an odd number of a set; sets differ in as many elements at least."""
    return np.packbits((np.bincount((distinct % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def _counted(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes in shingles([plain(x.as_py()) for x in batch.column("text")], shingle):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes).view(np.int64))], names=["shingle"])

    return run


def _often(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three texts or more of a sample have, sorted, and how many."""
    apart = max(1, docs.count() // SAMPLE)
    sample = docs.select(F.col("text").cast("string").alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(apart)) == 0).distinct()
    counts = sample.mapInArrow(_counted(shingle), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 2")
    found = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    known = found.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(known)
    return known[order], found.column("n").to_numpy()[order]


def _described(names: list[str], shingle: int, similarity: float, often):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, bands, sketches, sizes, rares, bits = [], [], [], [], [], [], []
            texts = [plain(x.as_py()) for x in batch.column("text")]
            for words, hashes in zip(texts, shingles(texts, shingle), strict=True):
                least = minima(hashes)
                samples = least.reshape(BANDS, ROWS)
                band = np.arange(BANDS, dtype=np.uint64)
                for i in range(ROWS):
                    band = _mixed(band * np.uint64(3) + samples[:, i])
                keys.append(hashlib.md5(words).digest())
                prints.append(majority(hashes))
                bands.append(band.view(np.int64))
                sketches.append((least & np.uint64(0xFFFF)).astype("<u2").tobytes())
                distinct = np.unique(hashes)
                sizes.append(len(distinct))
                rares.append(rare(distinct, often.value, similarity).view(np.int64))
                bits.append(parities(distinct))
            found = [pa.array(keys, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            found += [pa.array(sizes, pa.int64()), pa.array(rares, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], names=[*names, "key", "print", "bands", "sketch", "size", "rare", "bits"])

    return run


class Leaders:
    """The leaders of a group so far."""

    def __init__(self) -> None:
        self.rows, self.sketches = np.zeros(0, np.int64), np.zeros((0, BANDS * ROWS), np.uint16)

    def follow(self, rows: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(follower, leader) of the rows that are near a leader, the most alike; others become leaders in turn."""
        need = int(np.ceil(NEAR * sketches.shape[1]))
        best, lead = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)

        def offer(row: int, sketch: np.ndarray, to: np.ndarray) -> None:
            for a in range(0, len(to), 1 << 16):
                some = to[a : a + (1 << 16)]
                same = (sketches[some] == sketch).sum(axis=1)
                better = some[same > best[some]]
                best[better], lead[better] = same[same > best[some]], row

        everyone = np.arange(len(rows))
        for row, sketch in zip(self.rows.tolist(), self.sketches, strict=True):
            offer(row, sketch, everyone)
        fresh = []
        waiting = np.flatnonzero(best < need)
        while len(waiting):
            first, waiting = int(waiting[0]), waiting[1:]
            fresh.append(first)
            offer(int(rows[first]), sketches[first], waiting)
            waiting = waiting[best[waiting] < need]
        led = np.ones(len(rows), bool)
        led[fresh] = False
        self.rows, self.sketches = np.concatenate([self.rows, rows[fresh]]), np.concatenate([self.sketches, sketches[fresh]])
        return rows[led], lead[led]


_LED = "bucket long, a long, b long, sketch binary"


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket and part: each follower with its leader, and the leaders of buckets in more parts than one."""
    now, leaders, several = None, Leaders(), False

    def settled() -> Iterator[pa.RecordBatch]:
        if several:
            n = len(leaders.rows)
            yield pa.RecordBatch.from_arrays([pa.array([now[0]] * n, pa.int64()), pa.array(leaders.rows), pa.nulls(n, pa.int64()), pa.array([s.tobytes() for s in leaders.sketches], pa.binary())], names=["bucket", "a", "b", "sketch"])

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, part, parts, rows = (batch.column(c).to_numpy() for c in ("bucket", "part", "parts", "row"))
        sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u2").reshape(len(rows), -1)
        starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
        a, b = [], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
            at = (int(bucket[s]), int(part[s]))
            if at != now:
                yield from settled()
                now, leaders, several = at, Leaders(), bool(parts[s] > 1)
            follower, leader = leaders.follow(rows[s:e], sketches[s:e])
            a.append(follower)
            b.append(leader)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary())], names=["bucket", "a", "b", "sketch"])
    yield from settled()


def _sampled(texts: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of rows that share a sampled fingerprint."""
    n = common.parts(texts.sparkSession)
    cells = texts.select(F.explode("bands").alias("bucket"), "row")
    shared = cells.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = shared.select("bucket", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))
    members = cells.join(shared, "bucket").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    members = members.join(texts.select("row", "sketch"), "row").select("bucket", "part", "parts", "row", "sketch")
    order = ("bucket", "part", F.xxhash64("bucket", "row"))
    found = common.written(members.repartition(n, "bucket", "part").sortWithinPartitions(*order).mapInArrow(_led, _LED), "led")
    met = found.filter("bucket IS NOT NULL").select("bucket", F.lit(0).alias("part"), F.lit(1).alias("parts"), F.col("a").alias("row"), "sketch")
    met = met.repartition(n, "bucket").sortWithinPartitions(*order).mapInArrow(_led, _LED)
    return found.filter("bucket IS NULL").unionByName(met).select("a", "b")


def _covered(texts: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of rows whose whole-text fingerprints differ in at most 3 bits."""
    prints = common.written(texts.groupBy("print").agg(F.min("row").alias("owner")), "prints")
    links = simhash.linked(prints.select(F.col("print").alias("__fingerprint")))
    links = links.join(prints.toDF("a", "left"), "a").join(prints.toDF("b", "right"), "b").select("left", "right")
    equal = texts.select("row", "print").join(prints, "print").filter("row <> owner").select("row", "owner")
    return links.toDF("a", "b").unionByName(equal.toDF("a", "b"))


class Meeting:
    """Rows sorted by meeting (bucket, low, high) and size."""

    def __init__(self, table: pa.Table, similarity: float) -> None:
        self.row, self.label, self.size, self.place, self.part, self.low, self.high, self.bucket = (
            table.column(c).to_numpy() for c in ("row", "label", "size", "place", "part", "low", "high", "bucket")
        )
        self.bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        self.similarity = similarity

    def possible(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of places those that can be alike, and that this is the first meeting of."""
        some = (self.label[i] != self.label[j]) & ((self.low[i] == self.high[i]) | (self.part[i] != self.part[j]))
        i, j = i[some], j[some]
        need = np.ceil(self.similarity / (1 + self.similarity) * (self.size[i] + self.size[j]) - 1e-9)
        # with no shingle in common before, no more than this and what comes after it in both
        some = np.minimum(self.size[i] - self.place[i], self.size[j] - self.place[j]) >= need
        i, j, need = i[some], j[some], need[some]
        some = np.zeros(len(i), bool)
        for a in range(0, len(i), 1 << 16):
            b = slice(a, a + (1 << 16))
            differ = np.bitwise_count(self.bits[i[b]] ^ self.bits[j[b]]).sum(axis=1, dtype=np.int64)
            some[b] = self.size[i[b]] + self.size[j[b]] - differ >= 2 * need[b]
        return self.row[i[some]], self.row[j[some]]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys = (self.bucket, self.low, self.high)
        starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        ends = np.r_[starts[1:], len(self.row)]
        few = ends - starts <= FEW
        place = np.flatnonzero(np.repeat(few, ends - starts))
        end = np.repeat(ends, ends - starts)[place]
        for step in range(1, FEW):
            some = place + step < end
            place, end = place[some], end[some]
            if not len(place):
                break
            yield self.possible(place, place + step)
        for s, e in zip(starts[~few].tolist(), ends[~few].tolist(), strict=True):
            yield from self._many(s, e)

    def _many(self, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of a large meeting: rows outside its largest group with all whose sizes are near."""
        groups, own, counts = np.unique(self.label[start:end], return_inverse=True, return_counts=True)
        asks = own != counts.argmax()
        size = self.size[start:end]
        asking = np.flatnonzero(asks)
        for a in range(0, len(asking), 32):
            some = asking[a : a + 32]
            low = np.searchsorted(size, self.similarity * size[some[0]] - 1e-6)
            high = np.searchsorted(size, size[some[-1]] / self.similarity + 1e-6, side="right")
            i, j = np.repeat(some, high - low), np.tile(np.arange(low, high), len(some))
            once = ~asks[j] | (i < j)
            yield self.possible(start + i[once], start + j[once])


def _met(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for a, b in Meeting(table, similarity).pairs():
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        def last(batch: pa.RecordBatch) -> int:
            """Where the last meeting of a batch begins."""
            keys = [batch.column(c).to_numpy() for c in ("bucket", "low", "high")]
            other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
            return int(other[-1]) + 1 if len(other) else 0

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = last(batch)
            ends = held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("bucket", "low", "high"))
            if at or ends:
                yield from compare(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = []
            held.append(batch.slice(at))
        if held:
            yield from compare(pa.Table.from_batches(held))

    return run


def _rest(told: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of rows of different labels: all that can be alike, by their rare shingles."""
    n = common.parts(told.sparkSession)
    cells = told.select("row", "label", "size", F.posexplode("rare").alias("place", "bucket"))
    mixed = cells.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most"))
    mixed = mixed.filter("least <> most").select("bucket", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))
    members = cells.join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select("row", "label", "size", "place", "bucket", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    members = members.join(told.select("row", "bits"), "row")
    order = ("bucket", "low", "high")
    return members.repartition(n, *order).sortWithinPartitions(*order, "size", "row").mapInArrow(_met(similarity), "a long, b long").distinct()


def _checked(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (shingles([plain(x.as_py()) for x in batch.column(c)], shingle) for c in ("text_a", "text_b"))
            near = [likeness(x, y) >= similarity for x, y in zip(one, other, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def described(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """A table of the rows with a number each, and what is compared of their texts."""
    text = F.col("text").cast("string")
    rows = docs.select(F.struct("*").alias("whole"), "doc_id", text.alias("text"))
    schema = StructType([*rows.schema.fields]).add("key", BinaryType()).add("print", LongType()).add("bands", ArrayType(LongType())).add("sketch", BinaryType())
    schema = schema.add("size", LongType()).add("rare", ArrayType(LongType())).add("bits", BinaryType())
    often = docs.sparkSession.sparkContext.broadcast(_often(docs, shingle))
    return common.written(rows.mapInArrow(_described(rows.columns, shingle, similarity, often), schema).withColumn("row", F.monotonically_increasing_id()), "described")


def links(rows: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of rows of texts that are near copies; chains of them join all that either source has found."""
    pairs = _sampled(texts).unionByName(_covered(texts))
    return _near(rows, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), shingle, similarity)


def _near(rows: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of rows that are near copies."""
    pairs = common.written(pairs, "candidates")
    asked = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    found = common.written(rows.select("row", "text").join(asked, "row"), "asked")
    # a text that leads many goes to as many tasks as its followers are dealt to
    dealt = pairs.groupBy("b").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"))
    sides = pairs.join(dealt, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("side"))
    leads = dealt.join(found.toDF("b", "text_b"), "b").select("b", "text_b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("side"))
    both = sides.join(found.toDF("a", "text_a"), "a").join(leads, ["b", "side"])
    return both.mapInArrow(_checked(shingle, similarity), "a long, b long")


def groups(rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(row, root, first) of a row of each distinct text: the group's number and, of the text's rows, the one that goes
    before the others (last, doc_id, tie, row)."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("tie"), "row")
    found = ("print", "bands", "sketch", "size", "rare", "bits")
    texts = rows.groupBy("key").agg(F.min(order).alias("first"), *(F.any_value(c).alias(c) for c in found))
    texts = common.written(texts.select(F.col("first.row").alias("row"), "first", *found), "texts")
    labels = simhash.components(links(rows, texts, shingle, similarity)).toDF("row", "root")
    told = texts.join(labels, "row", "left").select("row", F.coalesce("root", "row").alias("label"), "first", "size", "rare", "bits")
    told = common.written(told, "told")
    # what the first two sources have missed joins whole groups
    names = told.select("row", "label")
    missed = _near(rows, _rest(told, similarity), shingle, similarity)
    missed = missed.join(names.toDF("a", "left"), "a").join(names.toDF("b", "right"), "b").select("left", "right").distinct()
    joined = simhash.components(missed.toDF("a", "b")).toDF("label", "root")
    return told.join(joined, "label", "left").select("row", F.coalesce("root", "label").alias("root"), "first")


def keep(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The first document of each group of near copies, its columns unchanged."""
    rows = described(docs, shingle, similarity)
    first = groups(rows, shingle, similarity).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return rows.select("whole", "row").join(first, "row", "left_semi").select("whole.*")
