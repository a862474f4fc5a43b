"""Byte-level BPE by recursive DuckDB queries in each partition.

The matches of the split pattern are found in every text (in pieces of it, where the caller knows that no match reaches
across blanks: see ``Encoder``); of each block of distinct matches, DuckDB holds rows (word,
position, token), joins neighbours with the table of merges and contracts, in every round of a recursive query, each
word's leftmost pair of minimum rank, until no pair of any word is left. Another query puts the bytes of every word's
tokens together again in order. Documents are then read off the words they consist of; nothing is shuffled.

A pair may merge if the bytes of both together are a token; its rank is that token's. A match that is a token itself is
taken whole. A match of more than ``LONG`` bytes is contracted by a heap instead, with the same result, as rounds would
take the square of its length. Null text counts as empty and has no ids; repeated rows are each encoded; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 128
#: Distinct words contracted by one query, and the sum of the squares of their bytes, which the rounds' rows grow with;
#: both keep the query within its memory, as it may not spill to a folder of the machine.
BLOCK = 20_000
SQUARES = 20_000_000
#: Bytes of text taken together, and distinct pieces remembered.
BATCH = 4 << 20
VOCABULARY = 600_000

_CONTRACT = """
WITH RECURSIVE state(round, w, ts) AS (
    SELECT 0, w, list(t ORDER BY p) FROM tokens GROUP BY w
    UNION ALL
    SELECT round + 1, w, list_concat(ts[:i - 1], [(best // 4096)::INTEGER], ts[i + 2:])
    FROM (
        SELECT any_value(round) AS round, w, any_value(ts) AS ts, min(m.rank::BIGINT * 4096 + x.p) AS best, best % 4096 AS i
        FROM (SELECT round, w, ts, unnest(ts[:-2]) AS t, unnest(ts[2:]) AS u, generate_subscripts(ts[:-2], 1) AS p FROM state) x
        JOIN merges m ON m.l = x.t AND m.r = x.u
        GROUP BY w
    )
),
last AS (SELECT w, arg_max(ts, round) AS ts FROM state GROUP BY w)
SELECT w, unnest(ts) AS t, generate_subscripts(ts, 1) AS p FROM last ORDER BY w, p
"""
_DECODE = "SELECT p // 65536 AS run, string_agg(hex(b), '' ORDER BY p) AS b FROM result JOIN vocabulary USING (t) GROUP BY run ORDER BY run"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Contract the leftmost pair of minimum rank until none is left, in n log n steps."""
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, middle, last = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or end[i] != middle or j >= n or end[j] != last:
            continue
        alive[j], end[i], after[i] = False, last, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Ragged:
    """Rows of different lengths, end to end in one array."""

    def __init__(self, kind):
        self.flat, self.sizes = np.zeros(0, kind), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.sizes = np.concatenate([self.flat, flat.astype(self.flat.dtype, copy=False)]), np.concatenate([self.sizes, sizes])

    def take(self, rows: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows end to end, and where each run of rows, told by ends, comes to its end."""
        sizes = self.sizes[rows]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        starts = np.cumsum(self.sizes) - self.sizes
        return self.flat[np.repeat(starts[rows] - upto[:-1], sizes) + np.arange(upto[-1])], upto[ends]


class Encoder:
    """cut: a text may be cut before each blank or line end that follows something else than white space, since no match of
    the pattern reaches across; true of patterns in which white space stands only at the head of a match, or alone."""

    def __init__(self, path: str, pattern: str, cut: bool = False):
        import duckdb
        import regex

        self.cut = cut
        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.pieces = regex.compile(r"\s*\S+|\s+").findall
        self.bytes = {t: b for b, t in self.ranks.items()}
        self.lengths = np.zeros(max(self.bytes) + 1, np.int64)
        self.lengths[list(self.bytes)] = list(map(len, self.bytes.values()))
        self.single = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = [(self.ranks[b[:k]], self.ranks[b[k:]], t) for b, t in self.ranks.items() for k in range(1, len(b)) if b[:k] in self.ranks and b[k:] in self.ranks]
        l, r, rank = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True))
        self._table("merges", pa.table({"l": l, "r": r, "rank": rank}))
        self._table("vocabulary", pa.table({"t": pa.array(self.bytes.keys(), pa.int32()), "b": pa.array(self.bytes.values(), pa.binary())}))
        self._forget()

    def _table(self, name: str, table: pa.Table) -> None:
        self.duck.register("given", table)
        self.duck.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.duck.unregister("given")

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.ids, self.plain = Ragged(np.uint32), Ragged(np.uint8)
        self.place: dict[str, int] = {}
        self.parts = Ragged(np.int64)
        self.open = np.zeros(0, bool)

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many of them each word has."""
        own: dict[int, list[int]] = {}
        pending = []
        for i, w in enumerate(words):
            if (t := self.ranks.get(w)) is not None:
                own[i] = [t]
            elif len(w) > LONG:
                own[i] = heap_merge(w, self.ranks)
            else:
                pending.append(i)
        places, found = [np.repeat(list(own), list(map(len, own.values())))], [np.array([t for ids in own.values() for t in ids], np.uint32)]
        squares = np.cumsum([len(words[i]) ** 2 for i in pending]) // SQUARES
        places_of = np.arange(len(pending)) // BLOCK
        edges = np.flatnonzero((np.diff(squares) != 0) | (np.diff(places_of) != 0)) + 1 if pending else []
        for some in np.split(np.array(pending, np.int64), edges) if pending else ():
            joined = np.frombuffer(b"".join([words[i] for i in some.tolist()]), np.uint8)
            sizes = np.array([len(words[i]) for i in some.tolist()])
            w = np.repeat(np.arange(len(some), dtype=np.int32), sizes)
            p = (np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            self._table("tokens", pa.table({"w": w, "p": p, "t": self.single[joined]}))
            rows = self.duck.execute(_CONTRACT).fetchnumpy()
            places.append(some[rows["w"]])
            found.append(rows["t"].astype(np.uint32))
        place, ids = np.concatenate(places).astype(np.int64), np.concatenate(found)
        return ids[np.argsort(place, kind="stable")], np.bincount(place, minlength=len(words))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, as one array."""
        out = []
        for a in range(0, len(ids), 1 << 20):
            some = ids[a : a + (1 << 20)]
            self._table("result", pa.table({"p": np.arange(len(some)), "t": some.astype(np.int32)}))
            out += map(bytes.fromhex, self.duck.execute(_DECODE).fetchnumpy()["b"].tolist())
        return np.frombuffer(b"".join(out), np.uint8)

    def _learn(self, pieces: list[str]) -> None:
        """Remember new pieces, and the ids and bytes of the words in them."""
        parts = list(map(self.split, pieces))
        new = list({w for x in parts for w in x}.difference(self.words))
        if new:
            ids, sizes = self.contract([w.encode("utf-8", "surrogatepass") for w in new])
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
            self.ids.add(ids, sizes)
            ends = np.cumsum(np.r_[0, self.lengths[ids]])[np.r_[0, np.cumsum(sizes)]]
            self.plain.add(self.decode(ids), np.diff(ends))
        self.place.update(zip(pieces, range(len(self.place), len(self.place) + len(pieces)), strict=True))
        codes = np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int64)
        self.parts.add(codes, np.fromiter(map(len, parts), np.int64, len(parts)))
        self.open = np.concatenate([self.open, np.fromiter((x[-1:].isspace() for x in pieces), bool, len(pieces))])

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and the bytes that they decode to."""
        if len(self.place) > VOCABULARY or not self.cut and len(self.words) > VOCABULARY:
            self._forget()
        if not self.cut:
            self.place, self.parts, self.open = {}, Ragged(np.int64), np.zeros(0, bool)
            whole = [t or "" for t in texts]
            self._learn(list(set(whole)))
            return self._read([[t] for t in whole])
        cut = [(t or "").replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01") if "\x01" not in (t or "") else self.pieces(t) for t in texts]
        self._learn(list(set().union(*cut).difference(self.place)))
        # a text that was cut after white space is cut anew
        codes, ends = self._codes(cut)
        wrong = self.open[codes]
        wrong[ends[ends > 0] - 1] = False
        again = np.unique(np.searchsorted(ends, np.flatnonzero(wrong), "right")).tolist()
        if again:
            for k in again:
                cut[k] = self.pieces(texts[k])
            self._learn(list(set().union(*(cut[k] for k in again)).difference(self.place)))
        return self._read(cut)

    def _read(self, cut: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words, ends = self.parts.take(*self._codes(cut))
        ids, id_ends = self.ids.take(words, ends)
        plain, plain_ends = self.plain.take(words, ends)
        return zip(np.split(ids, id_ends[:-1]), np.split(plain, plain_ends[:-1]), strict=True) if len(cut) else iter(())

    def _codes(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        return np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64), ends


@functools.cache
def encoder(path: str, pattern: str, cut: bool = False) -> Encoder:
    """The worker's own encoder, kept from task to task."""
    return Encoder(path, pattern, cut)


def _runner(path: str, pattern: str, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, cut)
        for batch in batches:
            sizes = np.cumsum(batch.column("size").to_numpy()) // BATCH
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                some = batch.slice(a, b - a)
                rows = [(len(ids), hashlib.sha256(ids.astype("<u4", copy=False)).hexdigest(), hashlib.sha256(plain).hexdigest()) for ids, plain in own.encode(some.column("text").to_pylist())]
                n, ids, plain = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str, pattern: str, cut: bool = False) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the text decoded from them, of every document. cut: see Encoder."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("bigint").alias("size"))
    return rows.mapInArrow(_runner(path, pattern, cut), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
