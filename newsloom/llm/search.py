"""Exact top-k search: BM25 over an inverted index with block-max bounds, per shard, merged exactly.

Scores use global statistics: number of documents (null and empty texts count), mean length and document
frequencies of the query terms over all documents, so a document's score does not depend on its shard.

Every text is cut into words once: what a document holds of the queries' vocabulary is written to the shared
folder, and frequencies and searches read that.  A lower bound of each query's k-th best score comes from a
search of one document in ``SEED`` squared and then in ``SEED``; whatever the choice of those, it never leaves out a result, as a best list
of fewer documents is not better.  Each scan task is a shard: it indexes its documents in pieces of similar ones,
in blocks of ``BLOCK`` documents that use the same common words.  Terms of a sixteenth of a piece's documents or more
are scored for many queries at once, as a matrix product in single precision.  With a query's other terms' largest
impacts this bounds the piece: the query skips the piece, or blocks of it, or adds all postings of these terms, where
blocks are not expected to be skipped.  What may be among the k best, rounding allowed for, is scored again in double
precision.  Skipping never changes a result.

Terms are the words as written in lower case (A-Z only); a term counts as often as the query repeats it.  Ties
go to the smaller document id, documents without an id last.  Queries without words find nothing, and
documents that share no term with a query are not found by it.  Queries are taken in blocks of bounded size.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.simhash import LOWER
from newsloom.session import ship_package, stage

K1, B = 1.2, 0.75
BLOCK = 64
HELD_DOCS, HELD_POSTINGS = 8192, 3_000_000  # sorted together
PIECE_DOCS, PIECE_POSTINGS = 2048, 1_000_000
GROUP = 128  # queries scored together on the frequent terms
FREQUENT = 24  # a term is frequent if this part of a piece's documents has it
PRODUCT = 300  # a matrix product takes as long for this many pairs as one posting
SEED, SEEDING = 12, 6
ADDED = 1 << 16  # postings added up at a time, so that they stay in the processor's cache
SKIPPING, WORTH = 0.25, 1 << 16  # blocks are looked at one by one if less than this part of them is left, of so many postings
BATCH_BYTES = 8 << 20
ROUNDING = 2.0 ** -22  # more than twice the relative error of an operation in single precision
TINY = float(np.finfo(np.float32).tiny)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()  # at \x20 and \x09-\x0D only


def cut(text: pa.Array) -> pa.ListArray:
    """The texts' words; a text's blanks at its ends leave empty words."""
    return pc.ascii_split_whitespace(pc.ascii_lower(text.cast(pa.string()).fill_null("")))


def distinct(words: pa.Array) -> pa.Array:
    """The words in order, each once, without empty ones."""
    words = pc.unique(words).cast(pa.binary())
    words = words.filter(pc.greater(pc.binary_length(words), 0))
    return words.take(pc.array_sort_indices(words))


class Queries:
    """Queries, named by id and hash of the text: their vocabulary, and per query its terms and their counts.

    ``words``: a vocabulary that has all their words, if it is known.
    """

    def __init__(self, ids: list[tuple[int, int]], texts: list[str | None] | pa.Array, words: pa.Array | None = None) -> None:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        self.ids = np.array(ids, np.int64).reshape(-1, 2)
        self.words = distinct(cut(texts).flatten()) if words is None else words
        found, self.term, self.times = [], [], []
        for at in range(0, len(texts), 512):
            (numbers, _, _), = self.numbers(iter([pa.record_batch({"text": texts[at:at + 512]})]))
            query, term, times = counted(numbers, len(self.words))
            found.append(np.bincount(query, minlength=len(numbers)))
            self.term.append(term.astype(np.int32)), self.times.append(times.astype(np.int32))
        self.length, self.term, self.times = (np.concatenate(a) if a else np.zeros(0, np.int32) for a in (found, self.term, self.times))  # length in distinct terms

    @property
    def vocabulary(self) -> list[bytes]:
        return self.words.to_pylist()

    def numbers(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[int], pa.Array | None]]:
        """Per batch: each text's words as vocabulary numbers, the texts' lengths in words, and their ids if there are any."""
        for batch in whole(batches):
            lists = cut(batch["text"])
            found = lists.flatten().dictionary_encode()
            words, place = found.dictionary.cast(pa.binary()), found.indices.to_numpy(zero_copy_only=False)
            number = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[place]
            doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            full = pc.binary_length(words).to_numpy(zero_copy_only=False)[place] > 0
            lengths = np.bincount(doc[full], minlength=len(lists))
            ends = np.cumsum(np.bincount(doc[number >= 0], minlength=len(lists)))
            yield np.split(number[number >= 0], ends[:-1]), lengths.tolist(), batch["id"] if "id" in batch.schema.names else None


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``BATCH_BYTES`` or a little more, as looking words up has a cost per batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= BATCH_BYTES:
            yield pa.concat_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def counted(numbers: list[np.ndarray], n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, how often), by document and term."""
    doc = np.repeat(np.arange(len(numbers)), [len(a) for a in numbers])
    if not len(doc):
        return (np.zeros(0, np.int64),) * 3
    key, times = np.unique(doc * n_terms + np.concatenate(numbers), return_counts=True)
    return key // n_terms, key % n_terms, times


def forward(batches: Iterator[pa.RecordBatch], words: pa.Array) -> Iterator[pa.RecordBatch]:
    """(id, length, terms, times): per document its number of words, and as 4-byte integers its terms in order and how often it has each."""
    for numbers, lengths, ids in Queries([], [], words).numbers(batches):
        doc, term, times = counted(numbers, len(words))
        ends = pa.py_buffer(np.r_[0, 4 * np.cumsum(np.bincount(doc, minlength=len(lengths)))].astype(np.int32))
        packed = [pa.Array.from_buffers(pa.binary(), len(lengths), [None, ends, pa.py_buffer(a.astype(np.int32))]) for a in (term, times)]
        yield pa.record_batch({"id": ids, "length": pa.array(lengths, pa.int64()), "terms": packed[0], "times": packed[1]})


def unpacked(column: pa.Array) -> np.ndarray:
    """All numbers of a column of packed integers."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.int32)[ends[0] // 4:ends[-1] // 4]


def frequencies(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[pa.RecordBatch]:
    """(term, n): document frequencies; -1 the number of documents, -2 of words."""
    docs, length, df = 0, 0, np.zeros(n_terms, np.int64)
    for batch in batches:
        if batch.num_rows:
            df += np.bincount(unpacked(batch["terms"]), minlength=n_terms)
            docs, length = docs + batch.num_rows, length + pc.sum(batch["length"]).as_py()
    held = np.flatnonzero(df)
    yield pa.record_batch({"term": np.r_[held, -1, -2], "n": np.r_[df[held], docs, length]})


class Documents:
    """Some documents, as a shard reads them: ids (0 where missing), lengths, and by document its terms and their counts."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        ids = pa.concat_arrays([b["id"] for b in batches])
        self.missing = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.lengths = np.concatenate([b["length"].to_numpy(zero_copy_only=False) for b in batches])
        self.count = np.concatenate([pc.binary_length(b["terms"]).to_numpy(zero_copy_only=False) // 4 for b in batches]).astype(np.int64)
        self.term, self.times = (np.concatenate([unpacked(b[c]) for b in batches]) for c in ("terms", "times"))

    def pieces(self, mean: float, n_terms: int) -> Iterator[tuple[Piece, np.ndarray, np.ndarray]]:
        """Pieces of documents with the same most common word and of similar length, and their ids."""
        start = np.cumsum(self.count) - self.count
        order = np.lexsort((self.lengths, commonest(self.count, self.term, self.times)))
        taken, at = np.cumsum(self.count[order]), 0
        while at < len(order):
            full = np.searchsorted(taken, (taken[at - 1] if at else 0) + PIECE_POSTINGS, "right")
            chosen = order[at:min(at + PIECE_DOCS, max(int(full), at + 1))]
            at += len(chosen)
            posting, which = ranges(start[chosen], self.count[chosen])
            yield Piece.of(which, self.term[posting], self.times[posting], self.lengths[chosen], mean, n_terms), self.ids[chosen], self.missing[chosen]


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Documents]:
    held: list[pa.RecordBatch] = []
    docs = postings = 0
    for batch in batches:
        for at in range(0, batch.num_rows, HELD_DOCS // 8):
            held.append(batch.slice(at, HELD_DOCS // 8))
            docs, postings = docs + held[-1].num_rows, postings + len(unpacked(held[-1]["terms"]))
            if docs >= HELD_DOCS or postings >= HELD_POSTINGS:
                yield Documents(held)
                held, docs, postings = [], 0, 0
    if held:
        yield Documents(held)


def ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of ranges, and which range each is of."""
    which = np.repeat(np.arange(len(count)), count)
    return np.arange(len(which)) + (first - np.cumsum(count) + count)[which], which


def commonest(count: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Per document its most common term, of equally common ones the first; -1 without terms."""
    held = np.flatnonzero(count)
    common = np.full(len(count), -1, np.int64)
    if len(held):
        start = (np.cumsum(count) - count)[held]
        most = np.repeat(np.maximum.reduceat(times, start), count[held])
        at = np.flatnonzero(times == most)[::-1]  # of equally common words the first is written last
        common[np.repeat(held, count[held])[at]] = term[at]
    return common


class Piece:
    """Inverted index of some documents: postings by term, and the largest impact of each term in each block."""

    def __init__(self, ids: list[int | None], numbers: list[np.ndarray], lengths: list[int], mean: float, n_terms: int) -> None:
        doc, term, times = counted(numbers, n_terms)
        count = np.bincount(doc, minlength=len(ids))
        order = np.lexsort((np.array(lengths, np.int64), commonest(count, term, times)))
        posting, which = ranges((np.cumsum(count) - count)[order], count[order])
        self.fill(which, term[posting], times[posting], np.array(lengths, np.int64)[order], mean, n_terms)

    @classmethod
    def of(cls, doc: np.ndarray, term: np.ndarray, times: np.ndarray, lengths: np.ndarray, mean: float, n_terms: int) -> Piece:
        """From the terms of documents that are in order already."""
        piece = cls.__new__(cls)
        piece.fill(doc, term, times, lengths, mean, n_terms)
        return piece

    def fill(self, doc: np.ndarray, term: np.ndarray, times: np.ndarray, lengths: np.ndarray, mean: float, n_terms: int) -> None:
        self.size, self.blocks = len(lengths), -(-len(lengths) // BLOCK)
        norm = K1 * (1 - B + B * lengths / max(mean, 1e-9))
        self.doc_start = np.searchsorted(doc, np.arange(self.size + 1))
        self.doc_impact = times * (K1 + 1) / (times + norm[doc])
        by_term, every = np.argsort(term.astype(np.int64) * max(self.size, 1) + doc), term
        term, self.doc, self.impact = term[by_term], doc[by_term].astype(np.int64), self.doc_impact[by_term]
        self.light = self.impact.astype(np.float32)
        new = np.r_[True, term[1:] != term[:-1]] if len(term) else np.zeros(0, bool)
        self.start = np.r_[np.flatnonzero(new), len(term)]  # by the piece's own numbers of its terms
        self.number = np.full(n_terms, -1, np.int32)
        self.number[term[new]] = np.arange(len(self.start) - 1)
        self.doc_own, self.weights = self.number[every], np.zeros(len(self.start) - 1)
        block = self.doc // BLOCK
        head = np.flatnonzero(new | np.r_[True, block[1:] != block[:-1]]) if len(term) else np.zeros(0, np.int64)
        self.run = np.r_[head, len(term)]  # where the postings of a term in a block start
        self.top = np.maximum.reduceat(self.impact, head) if len(term) else np.zeros(0)
        self.top_block, self.top_start = block[head], np.searchsorted(head, self.start)
        self.peak = np.maximum.reduceat(self.top, self.top_start[:-1]) if len(term) else np.zeros(0)
        count = np.diff(self.start)
        frequent = np.flatnonzero(count * FREQUENT >= self.size)
        self.column = np.full(len(count), -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), self.blocks * BLOCK), np.float32)
        self.having = count[frequent]
        posting, which = ranges(self.start[frequent], self.having)
        self.rows[which, self.doc[posting]] = self.impact[posting]
        # of terms in a quarter of the blocks or more: largest impacts by block, and the postings before each block
        runs = np.diff(self.top_start)
        middle = np.flatnonzero(runs * 4 >= self.blocks)
        self.middle = np.full(len(runs), -1, np.int32)
        self.middle[middle] = np.arange(len(middle))
        run, which = ranges(self.top_start[middle], runs[middle])
        self.tops = np.zeros((len(middle), self.blocks), np.float32)
        self.tops[which, self.top_block[run]] = self.top[run]
        before = np.zeros((len(middle), self.blocks + 1), np.int64)
        before[which, self.top_block[run] + 1] = self.run[run + 1] - self.run[run]
        self.before = self.start[middle][:, None] + np.cumsum(before, axis=1)

    @staticmethod
    def gather(start: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all entries of the chosen terms, and which term each is of."""
        return ranges(start[chosen], start[chosen + 1] - start[chosen])

    def search(self, base: np.ndarray, chosen: np.ndarray, weights: np.ndarray, k: int, floor: float, slack: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places) with a positive score that may be among the k best, and their scores.

        ``base``: the scores so far, from terms that are not among ``chosen``.  A block's bound is its best base
        score and the largest impacts of the other terms; a document's base is a bound from below.  ``slack``: how
        much, in proportion, a score may be below the k-th best found here and yet be as good, for rounding.
        """
        own = self.number[chosen]
        own, weights = own[own >= 0], weights[own >= 0]
        at, which = self.gather(self.top_start, own)
        block, weight = self.top_block[at], weights[which]
        bound = np.maximum.reduceat(base, np.arange(0, self.size, BLOCK)) + np.bincount(block, weight * self.top[at], self.blocks)
        bound = bound * (1 + 1e-9)
        if self.size >= k:
            floor = max(floor, float(np.partition(base, -k)[-k]))
        scores, done = base.astype(float), np.zeros(self.blocks, bool)
        for share in (max(2, self.blocks // 16), self.blocks):  # the most promising blocks first, then what is left of the others
            alive = (bound >= floor * (1 - slack)) & (bound > 0) & ~done
            todo = np.argsort(-bound)[:share]
            live = np.zeros(self.blocks, bool)
            live[todo] = alive[todo]
            if live.any() and len(own):
                inside = np.flatnonzero(live[block])
                posting, run = self.gather(self.run, at[inside])  # of these blocks only
                scores += np.bincount(self.doc[posting], weight[inside][run] * self.impact[posting], self.size)
            done |= live
            if self.size >= k:
                floor = max(floor, float(np.partition(scores, -k)[-k]))
        found = np.flatnonzero(np.repeat(done, BLOCK)[:self.size] & (scores > 0) & (scores >= floor * (1 - slack)))
        return found, np.round(scores[found], 9)

    def candidates(self, query: np.ndarray, words: np.ndarray, term: np.ndarray, weight: np.ndarray, floor: np.ndarray, slack: np.ndarray, k: int, room: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(query, places) of the documents that may be among their query's k best.

        The terms come by query, as places in ``words``; ``floor``: scores that the k best reach, 0 where none is known; ``room`` for the scores.
        """
        n, own = len(floor), self.number[words][term]
        here = np.flatnonzero(own >= 0)
        query, term, own, weight = query[here], term[here], own[here], weight[here]
        low = floor * (1 - slack)
        column, width = self.column[own], self.blocks * BLOCK
        asking = np.bincount(column + 1, minlength=len(self.rows) + 1)[1:]
        used = np.flatnonzero(asking * self.having * PRODUCT >= n * width)
        place = np.full(len(self.rows) + 1, -1)  # the last is for terms without a row
        place[used] = np.arange(len(used))
        column = place[column]
        dense, rest = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
        factors = np.zeros((n, len(used)), np.float32)
        factors[query[dense], column[dense]] = weight[dense]
        scores = np.matmul(factors, self.rows[used], out=room[:n * width].reshape(n, width))
        query, term, own, weight = query[rest], term[rest], own[rest], weight[rest]
        most = scores.max(1) + np.bincount(query, weight * self.peak[own], n)
        live = (most >= low * (1 - slack)) & (most > 0)  # the others skip the piece
        middle = self.middle[own]
        few = np.flatnonzero((middle < 0) & live[query])
        self.add(scores, query[few], self.start[own[few]], self.start[own[few] + 1], weight[few])
        rest = np.flatnonzero((middle >= 0) & live[query])
        query, term, middle, weight = query[rest], term[rest], middle[rest], weight[rest]
        used = np.flatnonzero(np.bincount(middle, minlength=len(self.tops)))
        place = np.zeros(len(self.tops), np.int64)
        place[used] = np.arange(len(used))
        factors = np.zeros((n, len(used)), np.float32)
        factors[query, place[middle]] = weight
        bound = scores.reshape(n, self.blocks, BLOCK).max(2) + factors @ self.tops[used]
        alive = (bound >= (low * (1 - slack))[:, None]) & live[:, None]
        # a query's blocks from the first to the last that is not to be skipped
        start, stop = self.before[middle, alive.argmax(1)[query]], self.before[middle, (self.blocks - alive[:, ::-1].argmax(1))[query]]
        live = alive.any(1)
        by_block = live & (alive.mean(1) < SKIPPING) & (np.bincount(query, stop - start, n) >= WORTH)
        ends = np.searchsorted(query, np.arange(n + 1))
        for q in np.flatnonzero(by_block):
            its = slice(ends[q], ends[q + 1])
            found, _ = self.search(scores[q, :self.size], words[term[its]], weight[its], k, float(low[q]), float(slack[q]))
            if len(found):
                yield q, found
        rest = np.flatnonzero((live & ~by_block)[query])
        self.add(scores, query[rest], start[rest], stop[rest], weight[rest])
        if self.size >= k:
            for q in np.flatnonzero(live & ~by_block & (low <= 0)):
                low[q] = np.partition(scores[q, :self.size], -k)[-k] * (1 - slack[q])
        low[~live | by_block] = np.inf
        hit_query, hit = np.divmod(np.flatnonzero(scores >= np.maximum(low, TINY).astype(np.float32)[:, None]), width)
        for some in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(hit_query)) + 1):
            if len(some):
                yield hit_query[some[0]], hit[some]

    def add(self, scores: np.ndarray, query: np.ndarray, start: np.ndarray, stop: np.ndarray, weight: np.ndarray) -> None:
        """Add the weighted impacts of the postings from ``start`` to ``stop`` to the queries' scores."""
        flat, count, weight = scores.reshape(-1), stop - start, weight.astype(np.float32)
        total = np.cumsum(count)
        row, first = query.astype(np.int64) * scores.shape[1], start - total + count
        cuts = [*np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, ADDED), "right"), len(total)]
        for a, b in itertools.pairwise(cuts):
            many = count[a:b]
            posting = np.repeat(first[a:b], many)
            posting += np.arange(total[a] - count[a], total[a] - count[a] + len(posting))
            place, value = np.repeat(row[a:b], many), np.repeat(weight[a:b], many)
            place += self.doc.take(posting, mode="clip")
            value *= self.light.take(posting, mode="clip")
            np.add.at(flat, place, value)

    def exact(self, places: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of documents in double precision, by all terms of a query; the order of sums is that of the document's terms."""
        own = self.number[term]
        self.weights[own[own >= 0]] = weight[own >= 0]
        posting, which = self.gather(self.doc_start, places)
        scores = np.bincount(which, self.weights[self.doc_own[posting]] * self.doc_impact[posting], len(places))
        self.weights[own[own >= 0]] = 0
        return np.round(scores, 9)


def ranked(query: np.ndarray, ids: np.ndarray, missing: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of every query's k best (by score, then id, missing ids last), by query and rank, and their ranks from 0."""
    order = np.lexsort((ids, missing, -scores, query))
    query = query[order]
    rank = np.arange(len(order)) - np.searchsorted(query, query)
    return order[rank < k], rank[rank < k]


class Block:
    """A block of queries for the shards: names, terms and their weights by query, scores the k best reach.

    Queries with the same most common word and of similar length are neighbours.  ``groups``: first and last query,
    terms of any of them, and for each query's terms their places among these.
    """

    def __init__(self, queries: Queries, idf: np.ndarray) -> None:
        order = np.lexsort((queries.length, commonest(queries.length, queries.term, queries.times)))
        entry, query = ranges((np.cumsum(queries.length) - queries.length)[order], queries.length[order])
        self.ids, self.term = queries.ids[order], queries.term[entry]
        self.weight = idf[self.term] * queries.times[entry]
        self.ends = np.searchsorted(query, np.arange(len(order) + 1))
        self.n_terms, self.floor, self.slack = len(idf), np.zeros(len(order)), ROUNDING * (queries.length[order] + 8)
        self.groups = []
        for at in range(0, len(order), GROUP):
            end = min(at + GROUP, len(order))
            words, place = np.unique(self.term[self.ends[at]:self.ends[end]], return_inverse=True)
            self.groups.append((at, end, words, place.astype(np.int32)))

    def query(self, at: int, end: int) -> np.ndarray:
        """Of which query each term is, counted from the first."""
        return np.repeat(np.arange(end - at), np.diff(self.ends[at:end + 1]))


def shard(batches: Iterator[pa.RecordBatch], block: Block, mean: float, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of this task's documents for every query, if they reach its floor: (query, content, place, id, score)."""
    n, floor = len(block.ids), block.floor.copy()
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0))
    best, new = none, [none]
    room = np.empty(GROUP * (PIECE_DOCS + BLOCK), np.float32)

    def settle() -> None:
        nonlocal best, new
        held = [np.concatenate(column) for column in zip(best, *new, strict=True)]
        keep, rank = ranked(*held, k)
        best, new = tuple(column[keep] for column in held), []
        last = rank == k - 1
        floor[best[0][last]] = np.maximum(floor[best[0][last]], best[3][last])

    for documents in read(batches):
        for piece, ids, missing in documents.pieces(mean, block.n_terms):
            for at, end, words, place in block.groups:
                low, weight = np.maximum(floor[at:end] - 1e-9, 0), block.weight[block.ends[at]:block.ends[end]]
                for q, places in piece.candidates(block.query(at, end), words, place, weight, low, block.slack[at:end], k, room):
                    own = slice(block.ends[at + q], block.ends[at + q + 1])
                    new.append((np.full(len(places), at + q), ids[places], missing[places], piece.exact(places, block.term[own], block.weight[own])))
            if len(new) > n // 4:
                settle()
    settle()
    if len(best[0]):
        query, content = block.ids[best[0]].T
        yield pa.record_batch({"query": query, "content": content, "place": best[0], "id": pa.array(best[1], pa.int64(), mask=best[2]), "score": best[3]})


def top_k(queries: DataFrame, docs: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, doc_id, rank, score): the k best documents of each query row that has an id.

    Rows equal in id and text are one query; several texts under one id are each ranked by themselves.
    """
    spark = docs.sparkSession
    ship_package(spark)
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null").distinct()
    asked = stage(asked.withColumn("content", F.xxhash64("text")), "queries")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // block_bytes))
    words = whole_column(asked.select("text").mapInArrow(vocabulary, "word binary").distinct().toArrow()["word"]).cast(pa.binary())
    words = words.take(pc.array_sort_indices(words))
    given = spark.sparkContext.broadcast(words)
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    index = stage(every.mapInArrow(lambda b: forward(b, given.value), "id long, length long, terms binary, times binary"), "index")
    n_terms = len(words)
    counts = index.select("length", "terms").mapInArrow(lambda b: frequencies(b, n_terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = np.array([counts["term"].to_numpy(), counts["n"].to_numpy()])  # at most the vocabulary
    n, length = (int(counts[1][counts[0] == which].sum()) for which in (-1, -2))
    df = np.zeros(n_terms)
    df[counts[0][counts[0] >= 0]] = counts[1][counts[0] >= 0]
    idf, mean = np.log1p((n - df + 0.5) / (df + 0.5)), length / max(n, 1)
    seeds = stage(index.withColumn("seed", F.xxhash64("id", "length", "terms")).filter(F.pmod("seed", F.lit(SEED)) == 0), "seeds")
    fewer = seeds.filter(F.pmod("seed", F.lit(SEED * SEED)) == 0).coalesce(SEEDING)
    given.destroy()

    def searched(block: Block, shards: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)
        best = stage(shards.mapInArrow(lambda b: shard(b, sent.value, mean, k), "query long, content long, place long, id long, score double"), "shard-best")
        sent.destroy()
        return best

    found = None
    for part in range(parts):  # a block of queries holds about block_bytes of text
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).orderBy("id", "content").toArrow()
        names = list(zip(rows["id"].to_pylist(), rows["content"].to_pylist(), strict=True))
        block = Block(Queries(names, whole_column(rows["text"]), words), idf)
        order = Window.partitionBy("place").orderBy(F.col("score").desc())
        for some in (fewer, seeds):
            last = searched(block, some).select("place", "score", F.row_number().over(order).alias("rank")).filter(F.col("rank") == k).toArrow()
            block.floor[last["place"].to_numpy()] = last["score"].to_numpy()
        best = searched(block, index)
        found = best if found is None else found.union(best)
    order = Window.partitionBy("query", "content").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), F.col("id").alias("doc_id"), "rank", "score")


def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of the texts, each once in a batch."""
    for batch in whole(batches):
        yield pa.record_batch({"word": distinct(cut(batch["text"]).flatten())})


def whole_column(chunks: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(chunks.chunks) if chunks.num_chunks else pa.array([], chunks.type)


def bm25(query: str, texts: list[str | None]) -> list[float]:
    """Scores by the formula, one text after the other; the definition the index has to meet."""
    bags = [Counter(terms(t)) for t in texts]
    lengths = [sum(b.values()) for b in bags]
    mean = sum(lengths) / max(len(texts), 1)
    scores = []
    for bag, length in zip(bags, lengths, strict=True):
        score = 0.0
        for w, times in Counter(terms(query)).items():
            df, tf = sum(w in b for b in bags), bag[w]
            score += times * math.log1p((len(texts) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-9)))
        scores.append(score)
    return scores
