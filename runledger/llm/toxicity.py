"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words and their first 4, 5 and 6 bytes (stems of inflected words), hashed into SLOTS slots. All terms of a text
are in its vector. One pass over all documents gives the inverse document frequencies. Up to EXAMPLES labelled rows per
class (those with the smallest hash of their doc_id) are the examples; a term weighs more the more significantly its share
among toxic examples is the higher one, and never less than its frequency says. A block-max inverted index over blocks of
examples that are alike finds the nearest ones: blocks whose bound stays below the cosines found are not opened. Those that
may be among the nearest are summed once more in double precision, in an order that does not depend on other texts. Votes of the nearest weigh by closeness and by how many labelled rows each example stands for; leave-one-out votes
of the examples calibrate them. The nearest examples are kept as evidence.

A text without any word, also a null or empty one, gets the share of toxic rows among examples without words.
Without labels of both kinds every score is 0. A doc_id with several labels is toxic if one says so; labels that are null
are not used, nor are those without doc_id. A null doc_id is not held out. Repeated rows score alike and count once; of
different texts with one labelled doc_id the one that sorts first is the example.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm import arrays
from runledger.llm.storage import plain_documents, stored

#: Labelled rows per class that the classifier is fitted on, and examples whose leave-one-out votes calibrate it, at most.
EXAMPLES, CALIBRATION = 4000, 1000
STEMS = (4, 5, 6)
BITS = 22
SLOTS = 1 << BITS
NEIGHBOURS, CLOSENESS, PRIOR_WEIGHT = 16, 0.05, 0.5
#: Terms of most examples that are multiplied densely, queries handled together, and more than single precision errs by.
DENSE, QUERIES, ROUNDING = 2048, 128, 1e-4
#: Examples in a block, dimensions in which they are grouped, and blocks that a query opens before it has a bound to reach.
BLOCK, SKETCH, FIRST = 64, 128, 1
#: Queries of a batch for which blocks are bounded in any case, and the share of opened blocks from which on the others take all.
PROBES, WORTH = 4, 0.25
#: Terms of fewer examples are bounded by the maxima of their runs.
POSTED = 8
#: Examples whose weights are worked out together.
UNITED = 500
THRESHOLD = 0.3

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every term occurrence."""
    lowered = arrays.LOWER[data]
    start, end, text_of = arrays.word_bounds(lowered, offsets, _SEPARATOR)
    sums = arrays.polynomial(arrays._BYTE_CODES[lowered], arrays._BASE)
    hashes, of = [], []
    for stem in (0, *STEMS):
        long_enough = end - start > stem
        begin = start[long_enough]
        stop = begin + stem if stem else end[long_enough]
        hashes.append(arrays.mix(arrays.span_hash(sums, arrays._BASE, begin, stop) + np.uint64(stem)))
        of.append(text_of[long_enough])
    return np.concatenate(hashes), np.concatenate(of)


def _counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, slot and count of the terms of each text, sorted by text and slot."""
    hashes, of = _terms(data, offsets)
    pair, counts = np.unique(of.astype(np.int64) << BITS | (hashes >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    return pair >> BITS, pair & (SLOTS - 1), counts


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts have a term of each slot; slot -1 counts the texts. Each text counts n times."""
    totals, n_texts = np.zeros(SLOTS, np.int64), 0
    for part, data, offsets in arrays.slices(batches):
        times = part.column("n").to_numpy(zero_copy_only=False)
        text, slots, _ = _counts(data, offsets)
        slots, of = np.unique(slots, return_inverse=True)
        totals[slots] += np.bincount(of, weights=times[text], minlength=len(slots)).astype(np.int64)
        n_texts += int(times.sum())
    at = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(totals[at], n_texts))], ["slot", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots and counts of each example."""
    for part, data, offsets in arrays.slices(batches):
        text, slots, counts = _counts(data, offsets)
        at = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (slots, counts)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *lists], ["doc_id", "toxic", "terms", "counts"])


@dataclass
class Hits:
    """The nearest examples of a query, nearest first."""

    example: np.ndarray
    cosine: np.ndarray


@dataclass
class Tables:
    """What queries read: examples in the order of the blocks, the place of each term (-1: no example has it), weights of the
    first places by member, and for the others runs of postings, each of one term and block. Their maxima follow: for terms of
    at least POSTED examples by block in steps, and for all by run."""

    order: np.ndarray
    place: np.ndarray
    dense: np.ndarray
    runs: np.ndarray
    run_begin: np.ndarray
    member: np.ndarray
    posted: np.ndarray

    def __post_init__(self) -> None:
        self.term_begin = self.run_begin[self.runs]
        begin = self.run_begin[:-1]
        self.run_block = (self.member[begin] // BLOCK).astype(np.int16)
        self.run_most = np.maximum.reduceat(self.posted, begin) if len(begin) else self.posted
        n_runs = np.diff(self.runs)
        few = np.flatnonzero(np.diff(self.run_begin[self.runs]) < POSTED)
        n_bounded = int(few[0]) if len(few) else len(n_runs)
        some = slice(0, self.runs[n_bounded])
        of = np.repeat(np.arange(n_bounded), n_runs[:n_bounded])
        self.step = np.zeros(n_bounded, np.float32)
        if n_bounded:
            self.step = np.maximum.reduceat(self.run_most[some], self.runs[:n_bounded]) * np.float32(1.0001 / 255)  # up, so that the bound stays one
        self.levels = np.zeros((n_bounded, -(-len(self.order) // BLOCK)), np.uint8)
        self.levels[of, self.run_block[some]] = np.minimum(np.ceil(self.run_most[some] / self.step[of]), 255)


def _each(begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places begin[i] … begin[i] + sizes[i] - 1 of all i one after the other, and the i of each. No size is 0."""
    ends = np.cumsum(sizes)
    of = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    of[ends[:-1]] = 1
    np.cumsum(of, out=of)
    places = (begin - ends + sizes)[of]
    places += np.arange(len(of))
    return places, of


def _alike(sketch: np.ndarray) -> np.ndarray:
    """An order of the rows in which every BLOCK of them are alike."""
    parts, done = [np.arange(len(sketch))], []
    while parts:
        rows = parts.pop()
        if len(rows) <= BLOCK:
            done.append(rows)
            continue
        centred = sketch[rows] - sketch[rows].mean(axis=0)
        along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
        rows = rows[np.argsort(along, kind="stable")]
        half = -(-len(rows) // BLOCK) // 2 * BLOCK
        parts += [rows[half:], rows[:half]]  # the first half is cut first, so only the last part of all may be short
    return np.concatenate([np.zeros(0, np.int64), *done])


def _leaning(having: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """1 and the standard errors by which the share of examples that have a term is higher among toxic (1) than clean (0) ones."""
    n_clean, n_toxic = np.maximum(taken, 1)
    share = having.sum(axis=0) / (n_clean + n_toxic)
    return 1 + np.maximum((having[1] / n_toxic - having[0] / n_clean) / np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean) + 1e-12), 0)


class Index:
    """Unit vectors of examples as a block-max inverted index.

    Examples lie in blocks of BLOCK that are alike: halves are taken along the direction in which the vectors, sketched in
    SKETCH dimensions, differ most. Terms that many examples have are multiplied densely. For all others the index keeps
    postings, a run for each term and block, and the greatest weight in each run. The largest dense product in a block and the
    query's product with these maxima bound its cosine with every member. The blocks with the best bounds are opened first,
    and of the others those whose bound reaches the k-th best cosine found so far. Where the first queries of a batch open so
    many blocks that bounds cost more than they save, the rest of the batch opens all; the neighbours are the same.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> None:
        at = np.cumsum([0, *(len(t) for t, _ in vectors)])
        self._hold(at, np.concatenate([np.zeros(0, np.int32), *(t.astype(np.int32) for t, _ in vectors)]), np.concatenate([np.zeros(0), *(w for _, w in vectors)]), n_terms)

    @classmethod
    def of(cls, at: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int) -> Index:
        """Of vectors at[i] … at[i + 1] of the terms."""
        made = cls.__new__(cls)
        made._hold(at, term, weight, n_terms)
        return made

    def _hold(self, at: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int) -> None:
        self.n, self.n_terms = len(at) - 1, n_terms
        self.at, self.term, self.weight = at, term, weight.astype(np.float32)
        self.order, self.grouped = range(self.n), _alike(self._sketch())  # as hits number the examples, and by blocks
        #: Blocks that queries met and opened since the index was made.
        self.met = self.opened = 0

    def _sketch(self) -> np.ndarray:
        """The vectors with signed sums of their weights per hash of the term."""
        made = np.zeros((self.n, SKETCH), np.float32)
        for first in range(0, self.n, BLOCK):
            last = min(first + BLOCK, self.n)
            own = slice(self.at[first], self.at[last])
            mixed = arrays.mix(self.term[own].astype(np.uint64))
            cell = np.repeat(np.arange(last - first), np.diff(self.at[first : last + 1])) * SKETCH + (mixed >> np.uint64(32)).astype(np.int64) % SKETCH
            signed = np.where(mixed & np.uint64(1), self.weight[own], -self.weight[own])
            made[first:last] = np.bincount(cell, weights=signed, minlength=(last - first) * SKETCH).reshape(-1, SKETCH)
        return made

    def __getstate__(self) -> dict:
        """What queries need, without the zeros and what follows from the rest."""
        tables = self._tables
        row, column = (x.astype(np.min_scalar_type(max(tables.dense.shape))) for x in np.nonzero(tables.dense))
        known = np.flatnonzero(tables.place >= 0).astype(np.int32)
        parts = (tables.order, known, tables.place[known], tables.runs, tables.run_begin, tables.member, tables.posted)
        return {"n": self.n, "n_terms": self.n_terms, "often": (tables.dense.shape, row, column, tables.dense[row, column]), "parts": parts}

    def __setstate__(self, state: dict) -> None:
        self.n, self.n_terms, self.order, self.met, self.opened = state["n"], state["n_terms"], range(state["n"]), 0, 0
        shape, row, column, weight = state["often"]
        order, known, places, runs, run_begin, member, posted = state["parts"]
        dense, place = np.zeros(shape, np.float32), np.full(self.n_terms, -1, np.int32)
        dense[row, column] = weight
        place[known] = places
        self._tables = Tables(order, place, dense, runs, run_begin, member, posted)

    def release(self) -> None:
        """Forgets the vectors, which queries do not need."""
        self._tables  # noqa: B018 (made from them)
        self.at = self.term = self.weight = None

    @functools.cached_property
    def _tables(self) -> Tables:
        known, held = np.unique(self.term, return_counts=True)
        known = known[np.argsort(-held, kind="stable")]
        place = np.full(self.n_terms, -1, np.int32)
        place[known] = np.arange(len(known), dtype=np.int32)
        dense = np.zeros((min(DENSE, len(known)), self.n), np.float32)
        terms, members, weights = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        for first in range(0, self.n, BLOCK):  # a block at a time, as the driver has little memory
            rows = self.grouped[first : first + BLOCK]
            sizes = self.at[rows + 1] - self.at[rows]
            posts = arrays.ranges(self.at[rows], sizes)
            mine, slot, weight = place[self.term[posts]], np.repeat(np.arange(first, first + len(rows), dtype=np.int32), sizes), self.weight[posts]
            often = mine < len(dense)
            dense[mine[often], slot[often]] = weight[often]
            for kept, values in ((terms, mine), (members, slot), (weights, weight)):
                kept.append(values[~often])
        term = np.concatenate(terms)
        del terms
        by_term = np.argsort(term, kind="stable")
        term = term[by_term]
        member = np.concatenate(members)[by_term].astype(np.min_scalar_type(self.n))
        del members
        posted = np.concatenate(weights)[by_term]
        del weights, by_term
        block = member // BLOCK
        begins = np.ones(len(term), bool)
        begins[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        begins = np.flatnonzero(begins).astype(np.int32)
        runs = np.searchsorted(term[begins], np.arange(len(dense), len(known) + 1))
        return Tables(self.grouped, place, dense, runs, np.append(begins, np.int32(len(term))), member, posted)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> Hits:
        """The k nearest examples with a cosine above 0; ties go to the earlier example. without: an example to leave out."""
        return next(self.nearest_of(np.array([0, len(terms)]), terms, weights, k, np.array([without])))

    def nearest_of(self, at: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray | None = None) -> Iterator[Hits]:
        """The same for each query at[i] … at[i + 1] of the terms."""
        tables = self._tables
        for first in range(0, len(at) - 1, QUERIES):
            last = min(first + QUERIES, len(at) - 1)
            left_out = np.full(last - first, -1) if without is None else without[first:last]
            yield from self._nearest([Query(tables, terms[at[q] : at[q + 1]], weights[at[q] : at[q + 1]]) for q in range(first, last)], k, left_out)

    def _nearest(self, queries: list[Query], k: int, without: np.ndarray) -> Iterator[Hits]:
        tables, n_blocks = self._tables, -(-self.n // BLOCK)
        often = np.zeros((len(queries), len(tables.dense)), np.float32)
        for q, query in enumerate(queries):
            often[q, query.dense] = query.dense_weight
        dense, met, opened = often @ tables.dense, self.met, self.opened
        for q, (query, about, left_out) in enumerate(zip(queries, dense, without, strict=True)):
            hidden = np.flatnonzero(tables.order == left_out) if left_out >= 0 else np.zeros(0, np.int64)
            rest, posts = np.zeros(self.n), Posts(tables, query)
            if q < PROBES or self.opened - opened <= WORTH * (self.met - met):
                bounds = np.maximum.reduceat(about, np.arange(0, self.n, BLOCK)) if self.n else np.zeros(0, np.float32)
                self._open_best(about, rest, bounds + query.bounds(tables, n_blocks), posts, k, hidden)
            else:
                self._open(about, rest, np.ones(n_blocks, bool), posts, hidden)
            least = np.partition(about, -k)[-k] - ROUNDING if self.n > k else 0
            near = np.flatnonzero((about > 0) & (about >= least))
            # The sums of the dense terms once more in double precision, one term after the other, whatever the batch holds.
            cosines = rest[near] + np.add.reduce(tables.dense[query.dense[:, None], near] * query.dense_weight[:, None], axis=0)
            best = np.lexsort((tables.order[near], -np.round(cosines, 9)))[:k]
            yield Hits(tables.order[near[best]], np.minimum(cosines[best], 1.0))

    def _open_best(self, about: np.ndarray, rest: np.ndarray, bounds: np.ndarray, posts: Posts, k: int, hidden: np.ndarray) -> None:
        """Opens the blocks with the best bounds, and of the others those that may hold one of the k nearest."""
        about[hidden] = 0
        first = np.zeros(len(bounds), bool)
        first[np.argsort(-bounds, kind="stable")[:FIRST]] = True
        first &= bounds > 0
        self._open(about, rest, first, posts, hidden)
        if self.n > k:
            self._open(about, rest, (bounds > 0) & (bounds + ROUNDING >= np.partition(about, -k)[-k] - ROUNDING) & ~first, posts, hidden)
            self.met -= len(bounds)

    def _open(self, about: np.ndarray, rest: np.ndarray, opened: np.ndarray, posts: Posts, hidden: np.ndarray) -> None:
        """Adds what the terms that are not dense add for members of opened blocks."""
        self.met += len(opened)
        self.opened += int(opened.sum())
        found = posts.sums(self._tables, opened)
        rest += found
        about += found
        about[hidden] = 0


class Query:
    """Terms of a query by how the index holds them."""

    def __init__(self, tables: Tables, terms: np.ndarray, weights: np.ndarray) -> None:
        where = tables.place[terms]
        n_dense = len(tables.dense)
        dense, rare = np.flatnonzero((where >= 0) & (where < n_dense)), np.flatnonzero(where >= n_dense)
        self.dense, self.dense_weight = where[dense], weights[dense]
        self.rare, self.rare_weight = where[rare] - n_dense, weights[rare]

    def bounds(self, tables: Tables, n_blocks: int) -> np.ndarray:
        """What the terms that are not dense add to the cosine with any member of each block, at most."""
        leveled = self.rare < len(tables.levels)
        of = self.rare[leveled]
        most = (self.rare_weight[leveled] * tables.step[of]).astype(np.float32) @ tables.levels[of].astype(np.float32)
        begin = tables.runs[self.rare[~leveled]]
        sizes = tables.runs[self.rare[~leveled] + 1] - begin
        run, of = _each(begin, sizes)
        return most + np.bincount(tables.run_block[run], weights=tables.run_most[run] * self.rare_weight[~leveled][of], minlength=n_blocks)


class Posts:
    """Postings of the terms of a query that are not dense, those of a term one after the other as the index holds them: runs
    are short, so postings of closed blocks are passed over one by one and no run is looked up."""

    def __init__(self, tables: Tables, query: Query) -> None:
        begin = tables.term_begin[query.rare]
        sizes = tables.term_begin[query.rare + 1] - begin
        self.place = np.repeat(begin - np.cumsum(sizes, dtype=np.int32) + sizes, sizes)
        self.place += np.arange(len(self.place), dtype=np.int32)
        self.member, self.weight = tables.member[self.place], np.repeat(query.rare_weight, sizes)

    def sums(self, tables: Tables, opened: np.ndarray) -> np.ndarray:
        """What they add to the cosine with each member of the opened blocks."""
        place, member, weight = self.place, self.member, self.weight
        if not opened.all():
            mine = np.flatnonzero(opened[member // BLOCK])
            place, member, weight = place[mine], member[mine], weight[mine]
        return np.bincount(member, weights=tables.posted[place] * weight, minlength=len(tables.order))


class Model:
    """Weights of the slots, index, labels, and the map from votes to calibrated scores."""

    def __init__(self, idf: np.ndarray, doc_id: list[int], labels: np.ndarray, at: np.ndarray, terms: np.ndarray, counts: np.ndarray, totals: tuple[int, int]) -> None:
        """at, terms, counts: slots and counts at[i] … at[i + 1] of each example; totals: labelled rows of label 0 and 1 that
        the examples stand for."""
        taken = np.bincount(labels, minlength=2)
        stand_for = np.array([t / max(n, 1) for t, n in zip(totals, taken, strict=True)])
        empty = np.diff(at) == 0
        without = np.array([(empty & (labels == label)).sum() * stand_for[label] for label in (0, 1)])
        self.empty_score = float((without[1] + 0.01) / (without.sum() + 1)) if len(labels) else 0.0
        self.prior = float(totals[1] / max(sum(totals), 1))
        known = np.unique(terms)
        place = np.searchsorted(known, terms).astype(np.int32)
        toxic = np.repeat(labels == 1, np.diff(at))
        having = np.array([np.bincount(place[of], minlength=len(known)) for of in (~toxic, toxic)])
        self.weight = idf.copy()
        self.weight[known] *= _leaning(having, taken)
        at = np.append(at[:-1][~empty], at[-1])
        edges = [*range(0, len(at) - 1, UNITED), len(at) - 1]
        parts = [(slice(at[a], at[b]), at[a : b + 1] - at[a]) for a, b in zip(edges, edges[1:], strict=False)]
        weights = [self.unit(own, terms[part], counts[part]).astype(np.float32) for part, own in parts]
        self.index = Index.of(at, terms, np.concatenate([np.zeros(0, np.float32), *weights]), len(idf))
        self.doc_id = [i for i, none in zip(doc_id, empty, strict=True) if not none]
        self.label = labels[~empty]
        self.stands = stand_for[self.label] if len(self.label) else np.zeros(0)
        self.steps, self.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self._calibrate(idf, place, having, taken)
        self.index.release()

    def unit(self, at: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of the unit vectors of texts at[i] … at[i + 1] of the terms."""
        weight = (1 + np.log(counts)) * self.weight[terms].astype(np.float64)
        of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        return weight / np.sqrt(np.bincount(of, weights=weight**2, minlength=len(at) - 1))[of]

    def vote(self, hits: Hits) -> float:
        weight = self.stands[hits.example] / (1 - hits.cosine + CLOSENESS) * CLOSENESS
        return float((weight @ self.label[hits.example] + PRIOR_WEIGHT * self.prior) / (weight.sum() + PRIOR_WEIGHT))

    def _calibrate(self, idf: np.ndarray, place: np.ndarray, having: np.ndarray, taken: np.ndarray) -> None:
        """Isotonic regression of the labels on leave-one-out votes, by pooling neighbours out of order. The example that is
        left out does not tell how its terms lean either."""
        if not len(self.label):
            return
        some = np.arange(0, self.index.n, -(-self.index.n // CALIBRATION))
        votes = np.zeros(len(some))
        for i, slot in enumerate(some):
            own = slice(self.index.at[slot], self.index.at[slot + 1])
            terms, mine = self.index.term[own], np.array([[1 - self.label[slot]], [self.label[slot]]])
            ratio = idf[terms] * _leaning(having[:, place[own]] - mine, taken - mine[:, 0]) / self.weight[terms]
            weight = self.index.weight[own] * ratio
            votes[i] = self.vote(self.index.nearest(terms, weight / np.sqrt((weight**2).sum()) * ratio, NEIGHBOURS, without=slot))
        pools: list[list[float]] = []  # first vote, last vote, weight, weight of label 1
        for i in np.argsort(votes, kind="stable"):
            weight = self.stands[some[i]]
            pools.append([votes[i], votes[i], weight, weight * self.label[some[i]]])
            while len(pools) > 1 and (pools[-2][3] / pools[-2][2] >= pools[-1][3] / pools[-1][2] or pools[-2][1] == pools[-1][0]):
                last = pools.pop()
                pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
        self.steps = np.array([x for p in pools for x in (p[0], p[1])])
        self.levels = np.repeat([(p[3] + 0.1 * self.prior) / (p[2] + 0.1) for p in pools], 2)

    def score(self, at: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> Iterator[tuple[float, str]]:
        """The score of each text and its nearest examples as doc_id:cosine."""
        for empty, hits in zip(at[:-1] == at[1:], self.index.nearest_of(at, terms, self.unit(at, terms, counts), NEIGHBOURS), strict=True):
            if empty:
                yield self.empty_score, ""
            else:
                score = float(np.clip(np.interp(self.vote(hits), self.steps, self.levels), 0, 1))
                yield score, ",".join(f"{self.doc_id[e]}:{c:.3f}" for e, c in zip(hits.example[:3], hits.cosine[:3], strict=True))


_SCORED = "doc_id long, score double, evidence string"


def score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document; held-out labels are never read."""
    docs = plain_documents(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        nothing = docs.select("doc_id", F.lit(0.0).alias("score"), F.lit("").alias("evidence"))
        return _result(nothing)
    taken = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for label in (0, 1)]
    sample = stored(taken[0].unionByName(taken[1]))
    idf = _idf(docs)
    chosen = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # bounded by the number of examples
    rows = stored(chosen.select("doc_id", "toxic", "text").mapInArrow(_vectors, "doc_id long, toxic int, terms array<int>, counts array<int>")).orderBy("doc_id").toArrow().combine_chunks()
    lists = rows.column("terms")
    at = np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
    terms, counts = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("terms", "counts"))
    model = Model(idf, rows.column("doc_id").to_pylist(), rows.column("toxic").to_numpy().astype(np.int64), at, terms, counts, (totals[0], totals[1]))
    del rows, lists, at, terms, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.slices(batches):
            text, terms, counts = _counts(data, offsets)
            found = list(model.score(np.searchsorted(text, np.arange(part.num_rows + 1)), terms, counts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.string())], ["doc_id", "score", "evidence"])

    return _result(docs.mapInArrow(run, _SCORED))


def _idf(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each slot; the driver gets one row per slot. Repeated rows count once."""
    digest = F.xxhash64("text").alias("digest")
    repeated = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id", digest).agg(F.count("*").alias("copies")).where("copies > 1"))
    counted = docs.select("text", F.lit(1).cast("long").alias("n"))
    if repeated.limit(1).count():
        again = docs.select("doc_id", "text", digest).join(repeated, ["doc_id", "digest"]).groupBy("doc_id", "digest").agg(F.first("text").alias("text"), F.first("copies").alias("copies"))
        counted = counted.unionByName(again.select("text", (1 - F.col("copies")).alias("n")))
    rows = counted.mapInArrow(_frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slots, n = (rows.column(c).to_numpy() for c in ("slot", "n"))
    idf = np.zeros(SLOTS, np.float32)
    idf[slots[slots >= 0]] = n[slots >= 0]
    return np.log(np.float32(1 + n[slots < 0].sum()) / (1 + idf)) + np.float32(1)


def _result(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
