"""Language-model scoring by context-tree weighting.

A document is the byte string of its words (A-Z lower-cased) joined by single spaces and closed by one end byte (0x0A,
which no word holds). Each byte is eight binary decisions; each decision has a tree of contexts, the suffixes of 0 to
``DEPTH`` preceding bytes. Every node holds a Krichevsky-Trofimov estimate of the training counts, and the weighted
probability of a node is half its own estimate and half the product over its children. The weights are frozen after
training; a path that leaves the tree ends at its last known node.

The corpus meets in two shuffles of blobs. Each block of documents (``BLOCK`` bytes of text) sends its distinct byte
grams and distinct words, with their training counts, to the part that owns them; the part adds counts of all blocks,
builds its trees (a part owns whole subtrees below the last two bytes) and answers each block with one number per gram
or word. Only the two top levels, at most 256 * 255 nodes, pass through the driver. Nothing is sampled or capped.

Null text counts as empty; null doc_id counts as the empty id text; repeated rows are scored each on their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zlib
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of context; a gram of DEPTH + 1 bytes fills 48 bits, which leaves 16 for a position in a chunk.
DEPTH = 5
#: Bytes of text whose distinct grams are gathered together.
BLOCK = 12 << 20
CHUNK = 1 << 16
END = b"\n"
#: Stands for END where words are split; no UTF-8 text has this byte.
_STOP = b" \xff "
_MASK = (1 << 8 * (DEPTH + 1)) - 1
_LEVELS = "key int, n0 double, n1 double, weighted double"
_BLOB = "kind string, part int, block string, keys binary, counts binary"


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=1 << 31), kind)


def encode(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()) + END


def _grams(stream: np.ndarray) -> np.ndarray:
    """The gram that ends at each byte from DEPTH on, oldest byte highest."""
    n = len(stream) - DEPTH
    keys = np.zeros(n, np.uint64)
    for i in range(DEPTH + 1):
        keys <<= np.uint64(8)
        keys |= stream[i : n + i]
    return keys


def _slices(docs: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(document, first byte, grams, bytes) of runs of CHUNK bytes at most; the context reaches over the run's start."""
    pad = END * DEPTH
    for i, doc in enumerate(docs):
        for a in range(0, len(doc), CHUNK):
            b = min(a + CHUNK, len(doc))
            head = doc[a - DEPTH : a] if a >= DEPTH else (pad + doc[:a])[-DEPTH:]
            yield i, a, np.frombuffer(head + doc[a:b], np.uint8), b - a


def _chunks(docs: list[bytes]) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """Grams of whole documents and runs, CHUNK positions at most at a time: (documents, lengths, grams)."""
    who, sizes, grams, total = [], [], [], 0
    for i, _, stream, n in _slices(docs):
        if total and total + n > CHUNK:
            yield who, sizes, np.concatenate(grams)
            who, sizes, grams, total = [], [], [], 0
        who.append(i)
        sizes.append(n)
        grams.append(stream)
        total += n
    if who:
        yield who, sizes, np.concatenate(grams)


def _keys(who: list[int], sizes: list[int], streams: np.ndarray) -> np.ndarray:
    """Grams of the joined streams without those that would end in a stream's leading context."""
    keys = _grams(streams)
    if len(who) == 1:
        return keys
    ends = np.cumsum(np.asarray(sizes) + DEPTH)
    keep = np.ones(len(keys), bool)
    for at in ends[:-1]:
        keep[at - DEPTH : at] = False
    return keys[keep]


def _merge(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.uint64)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([c for _, c in found])[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _distinct(docs: list[bytes], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of all documents, and their counts in those not held out."""
    found = []
    for learn in (True, False):
        for who, sizes, streams in _chunks([d for d, h in zip(docs, held, strict=True) if h != learn]):
            keys = _keys(who, sizes, streams)
            keys.sort()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            counts = np.diff(np.r_[first, len(keys)]) if learn else np.zeros(len(first), np.int64)
            found.append((keys[first], counts))
            if len(found) >= 64:
                found = [_merge(found)]
    return _merge(found)


def _gram_part(keys: np.ndarray, n: int) -> np.ndarray:
    """By the last two bytes of context, so that a part owns whole subtrees below them."""
    near = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return (((near * np.uint64(2654435761)) >> np.uint64(12)) % np.uint64(n)).astype(np.int64)


def _by_part(part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n + 1))


def _coded_words(docs: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The sorted distinct tokens, the place of each token among them, and where each document's tokens begin."""
    names, codes = common.distinct_words(b"".join([doc[:-1] + _STOP for doc in docs]))
    names[names.index(_STOP.strip())] = END
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    codes = place[codes]
    ends = np.flatnonzero(codes == place[names.index(END)])
    return [names[i] for i in order], codes, np.concatenate([[0], ends[:-1] + 1])


def _distinct_words(docs: list[bytes], held: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The sorted distinct tokens of all documents, and their counts in those not held out."""
    names, codes, starts = _coded_words(docs)
    learned = np.repeat(~held, np.diff(np.append(starts, len(codes))))
    return names, np.bincount(codes[learned], minlength=len(names))


def _word_part(vocabulary: list[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, vocabulary), np.int64, len(vocabulary)) % n


def _table(docs: list[bytes], ids: pa.Array, held: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"id": ids, "held": pa.array(held), "doc": pa.array(docs, pa.large_binary())})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _blocks(n: int):
    def block(name: str, docs: list[bytes], ids: list[pa.Array], held: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = [("text", -1, name, _table(docs, pa.concat_arrays(ids), held), b"")]
        keys, counts = _distinct(docs, held)
        order, cuts = _by_part(_gram_part(keys, n), n)
        keys, counts = keys[order], counts[order]
        for p in range(n):
            if (a := cuts[p]) < (b := cuts[p + 1]):
                rows.append(("gram", p, name, _pack(np.diff(keys[a:b], prepend=np.uint64(0))), _pack(counts[a:b].astype(np.uint32))))
        vocabulary, counts = _distinct_words(docs, held)
        order, cuts = _by_part(_word_part(vocabulary, n), n)
        for p in range(n):
            if (a := cuts[p]) < (b := cuts[p + 1]):
                rows.append(("word", p, name, zstandard.compress(b" ".join([vocabulary[i] for i in order[a:b]]), 1), _pack(counts[order[a:b]].astype(np.uint32))))
        columns = list(zip(*rows, strict=True))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "part", "block", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, ids, held, total, done = [], [], [], 0, 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for i, (text, h) in enumerate(zip(batch.column("text"), batch.column("held_out").to_pylist(), strict=True)):
                docs.append(encode(text.as_py()))
                ids.append(batch.column("doc_id").slice(i, 1))
                held.append(h)
                total += len(docs[-1])
                if total >= BLOCK:
                    yield from block(f"{task}-{done}", docs, ids, np.array(held, bool))
                    docs, ids, held, total, done = [], [], [], 0, done + 1
        if docs:
            yield from block(f"{task}-{done}", docs, ids, np.array(held, bool))

    return run


_HALF_LOG_PI = 0.5 * np.log(np.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5 by Stirling's series after eight steps of the recurrence."""
    shift, y = np.zeros_like(x), x.copy()
    small = y < 12
    for _ in range(12):
        step = small & (y < 12)
        shift[step] += np.log(y[step])
        y[step] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1) - 2 * _HALF_LOG_PI


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, the place of each given key among them, and the sums of the values."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, place, [np.bincount(place, v, len(distinct)) for v in values]


def _weighted(log_kt: np.ndarray, log_children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the weighted probability, and the posterior weight of the node's own estimate."""
    log_w = np.logaddexp(log_kt, log_children) - np.log(2)
    return log_w, np.exp(log_kt - np.log(2) - log_w)


class _Subtrees:
    """The trees of a part, from DEPTH down to two bytes of context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        context, symbol = keys >> np.uint64(8), (keys & np.uint64(255)).astype(np.int64)
        nodes, ones, zeros = [], [], []
        for k in range(8):
            nodes.append((context << np.uint64(8)) | ((1 << k) | (symbol >> (8 - k))).astype(np.uint64))
            bit = (symbol >> (7 - k)) & 1
            ones.append(counts * bit)
            zeros.append(counts * (1 - bit))
        level, self.leaf, (n0, n1) = _sums(np.concatenate(nodes), np.concatenate(zeros).astype(float), np.concatenate(ones).astype(float))
        log_w = _log_kt(n0, n1)
        self.levels = {DEPTH: [level, n0, n1, np.ones(len(level)), None]}
        for d in range(DEPTH - 1, 1, -1):
            up = level & np.uint64((1 << 8 * (d + 1)) - 1)
            level, place, (n0, n1, below) = _sums(up, n0, n1, log_w)
            self.levels[d + 1][4] = place
            log_w, own = _weighted(_log_kt(n0, n1), below)
            self.levels[d] = [level, n0, n1, own, None]
        self.log_w = log_w

    def top(self) -> pd.DataFrame:
        """What the part adds to the nodes with one byte of context."""
        level, n0, n1, _, _ = self.levels[2]
        keys, _, (n0, n1, below) = _sums(level & np.uint64(0xFFFF), n0, n1, self.log_w)
        return pd.DataFrame({"key": keys.astype(np.int32), "n0": n0, "n1": n1, "weighted": below})

    def predict(self, top: "_Top") -> dict[int, np.ndarray]:
        """For each level, the probability of a one where the path ends in that node."""
        ended = {}
        for d in range(2, DEPTH + 1):
            level, n0, n1, own, _ = self.levels[d]
            if d == 2:
                gathered, rest = top.gathered[(level & np.uint64(0xFFFF)).astype(np.int64)], top.rest[(level & np.uint64(0xFFFF)).astype(np.int64)]
            else:
                gathered, rest = (gathered + rest * held * kt)[self.levels[d][4]], (rest * (1 - held))[self.levels[d][4]]
            kt, held = (n1 + 0.5) / (n0 + n1 + 1), own
            ended[d] = gathered + rest * kt
        return ended


class _Top:
    """Nodes with no or one byte of context: what their estimates give, and the weight left for longer contexts."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        a0, a1, a2 = np.zeros(1 << 16), np.zeros(1 << 16), np.zeros(1 << 16)
        np.add.at(a0, key, n0), np.add.at(a1, key, n1), np.add.at(a2, key, below)
        log_w, own1 = _weighted(_log_kt(a0, a1), a2)
        node = np.arange(1 << 16) & 255
        r0, r1, r2 = (np.bincount(node, x, 256) for x in (a0, a1, np.where(a0 + a1 > 0, log_w, 0)))
        _, own0 = _weighted(_log_kt(r0, r1), r2)
        kt0, kt1 = ((r1 + 0.5) / (r0 + r1 + 1))[node], (a1 + 0.5) / (a0 + a1 + 1)
        own0 = own0[node]
        self.ended = np.where(a0 + a1 > 0, own0 * kt0 + (1 - own0) * kt1, kt0)
        self.gathered = own0 * kt0 + (1 - own0) * own1 * kt1
        self.rest = (1 - own0) * (1 - own1)


def _log10(keys: np.ndarray, trees: _Subtrees | None, known: np.ndarray, top: _Top) -> np.ndarray:
    """log10 probability of the last byte of each gram; known: its place among the trees' grams, or -1."""
    out = np.zeros(len(keys))
    ended = trees.predict(top) if trees else {}
    seen = np.flatnonzero(known >= 0)
    context, symbol = keys >> np.uint64(8), (keys & np.uint64(255)).astype(np.int64)
    new = np.flatnonzero(known < 0)
    n = len(trees.leaf) // 8 if trees else 0
    for k in range(8):
        bit = (symbol >> (7 - k)) & 1
        if len(seen):
            p = ended[DEPTH][trees.leaf[k * n + known[seen]]]
            out[seen] += np.log10(np.where(bit[seen] == 1, p, 1 - p))
        if len(new):
            node = (context[new] << np.uint64(8)) | ((1 << k) | (symbol[new] >> (8 - k))).astype(np.uint64)
            p = top.ended[(node & np.uint64(0xFFFF)).astype(np.int64)]
            for d in range(2, DEPTH + 1) if trees else ():
                level, want = trees.levels[d][0], node & np.uint64((1 << 8 * (d + 1)) - 1)
                at = np.minimum(np.searchsorted(level, want), len(level) - 1)
                p = np.where(level[at] == want, ended[d][at], p)
            out[new] += np.log10(np.where(bit[new] == 1, p, 1 - p))
    return out


def _gram_rows(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    each = [np.cumsum(_unpack(b, np.uint64), dtype=np.uint64) for b in pdf["keys"]]
    keys, counts = _merge([(k, _unpack(c, np.uint32).astype(np.int64)) for k, c in zip(each, pdf["counts"], strict=True)])
    return each, keys, counts


def _word_rows(pdf: pd.DataFrame) -> tuple[list[list[bytes]], dict[bytes, int]]:
    each, total = [zstandard.decompress(b).split(b" ") for b in pdf["keys"]], {}
    for names, b in zip(each, pdf["counts"], strict=True):
        for name, c in zip(names, _unpack(b, np.uint32).tolist(), strict=True):
            total[name] = total.get(name, 0) + c
    return each, total


def _gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A part's share in the top levels; key -1: training tokens and distinct training tokens."""
    if key[0] == "word":
        counts = np.fromiter(_word_rows(pdf)[1].values(), np.int64)
        return pd.DataFrame({"key": [-1], "n0": [float(counts.sum())], "n1": [float((counts > 0).sum())], "weighted": [0.0]})
    _, keys, counts = _gram_rows(pdf)
    keys, counts = keys[counts > 0], counts[counts > 0]
    return _Subtrees(keys, counts).top() if len(keys) else pd.DataFrame({"key": [], "n0": [], "n1": [], "weighted": []})


def _answer(top: _Top):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] == "word":
            each, total = _word_rows(pdf)
            replies = [_pack(np.fromiter(map(total.__getitem__, names), np.int64, len(names))) for names in each]
        else:
            each, keys, counts = _gram_rows(pdf)
            seen = counts > 0
            trees = _Subtrees(keys[seen], counts[seen]) if seen.any() else None
            scores = _log10(keys, trees, np.where(seen, np.cumsum(seen) - 1, -1), top)
            replies = [_pack(scores[np.searchsorted(keys, k)]) for k in each]
        return pd.DataFrame({"kind": pdf["kind"], "part": pdf["part"], "block": pdf["block"], "keys": replies, "counts": [b""] * len(pdf)})

    return run


def _score(n: int, tokens: int, distinct: int, names: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        table = pa.ipc.open_stream(pdf.loc[pdf["kind"] == "text", "keys"].iloc[0]).read_all()
        docs, held = table.column("doc").to_pylist(), np.array(table.column("held").to_pylist(), bool)
        keys, _ = _distinct(docs, held)
        order, _ = _by_part(_gram_part(keys, n), n)
        log = np.empty(len(keys))
        log[order] = np.concatenate([_unpack(b, np.float64) for b in pdf.loc[pdf["kind"] == "gram", "keys"]])
        score = np.zeros(len(docs))
        for who, sizes, streams in _chunks(docs):
            packed = (_keys(who, sizes, streams) << np.uint64(16)) | np.arange(sum(sizes), dtype=np.uint64)
            packed.sort()
            gram = packed >> np.uint64(16)
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            values = np.empty(len(gram))
            values[(packed & np.uint64(0xFFFF)).astype(np.int64)] = np.repeat(log[np.searchsorted(keys, gram[first])], np.diff(np.r_[first, len(gram)]))
            np.add.at(score, who, np.add.reduceat(values, np.cumsum([0, *sizes[:-1]])))
        vocabulary, codes, starts = _coded_words(docs)
        order, _ = _by_part(_word_part(vocabulary, n), n)
        counts = np.empty(len(vocabulary), np.int64)
        counts[order] = np.concatenate([_unpack(b, np.int64) for b in pdf.loc[pdf["kind"] == "word", "keys"]])
        unigram = np.log10((counts + 0.1) / (tokens + 0.1 * (distinct + 1)))
        base, known = np.add.reduceat(unigram[codes], starts), np.add.reduceat((counts > 0).astype(np.int64)[codes], starts)
        length = np.diff(np.append(starts, len(codes)))
        out = pd.DataFrame({"doc_id": table.column("id").to_pandas(integer_object_nulls=True), "held_out": held, "n_tokens": length, "n_known": known, "train_tokens": tokens, "base_score": base, "score": score, "n_bytes": [len(d) for d in docs], "bits_per_byte": -score / np.log10(2) / [len(d) for d in docs]})
        return out[names]

    return run


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Score every document; those whose crc32(doc_id) mod folds is 0 are held out of training.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram), score (log10 probability by the
    context trees), n_bytes and bits_per_byte (code length per byte)."""
    spark = docs.sparkSession
    n = common.parts(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (F.crc32(common.id_text()) % folds == 0).alias("held_out"))
    blocks = common.written(rows.mapInArrow(_blocks(n), _BLOB), "ctw")
    asked = blocks.filter("kind <> 'text'")
    sums = asked.groupBy("kind", "part").applyInPandas(_gather, _LEVELS).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "weighted"))).collect()
    tokens, distinct = next(((int(r.n0), int(r.n1)) for r in sums if r.key == -1), (0, 0))
    own = sorted(r for r in sums if r.key >= 0)
    top = _Top(*(np.array([r[i] for r in own], t) for i, t in enumerate((np.int64, float, float, float))))
    answers = asked.groupBy("kind", "part").applyInPandas(_answer(top), _BLOB)
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    names = [x.split()[0] for x in schema.split(", ")]
    return blocks.filter("kind = 'text'").unionByName(answers).groupBy("block").applyInPandas(_score(n, tokens, distinct, names), schema)
