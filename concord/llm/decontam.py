"""Benchmark decontamination by latent semantic retrieval, then longest common subsequence and answer checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

#: Words of a block; a passage is two blocks, so passages overlap by half.
BLOCK = 24
PASSAGE = 2 * BLOCK
#: Leading directions of the passages that the latent space has beside the items' own (a space without these would blur
#: the items of rare words together, the more the larger the corpus is); items handled in one pass, about.
RANK, ITEMS = 64, 400
#: Words that a larger part of the documents has say nothing and are left out of the vectors.
COMMON = 0.2
#: Least cosine of a candidate, and least part of an item's latent length that the passage must cover.
COSINE, COVER = 0.3, 0.4
#: Words in common order, as a part of the item: enough alone, and enough with the item's answer.
LCS, LCS_ANSWER, ANSWER_WORDS, LEAST_WORDS = 0.8, 0.6, 4, 5
#: Bytes of text, words and blocks handled at once in a task, so that what is looked up stays near the processor.
TEXT_BYTES, WORDS, BLOCKS = 1 << 20, 1 << 16, 1 << 12
SIGNS = ".,;:!?\"'()[]{}…«»“”‘’*_-"


def words(text: str | None) -> list[str]:
    """Lower-cased words without signs at their ends; words of signs alone are left out."""
    return [w for w in (x.strip(SIGNS) for x in (text or "").lower().split()) if w]


def parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to `most` at most; a larger row is alone."""
    ends, o = np.cumsum(sizes), 0
    while o < len(sizes):
        stop = max(o + 1, int(np.searchsorted(ends, most + (ends[o - 1] if o else 0), "right")))
        yield o, stop
        o = stop


class Ids:
    """Word numbers of texts, many at once: -1 is not in the vocabulary; tokens of signs alone are left out."""

    def __init__(self, vocabulary: dict[str, int]):
        self.words = pa.array(sorted(vocabulary, key=vocabulary.__getitem__), pa.string())

    def of(self, text: str | None) -> np.ndarray:
        return self.of_all(pa.array([text], pa.string()))[0]

    def of_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts, where each text begins and the last one ends)."""
        out, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for x, y in parts(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), TEXT_BYTES):
            lower = pa.array([(t or "").lower() for t in texts.slice(x, y - x).to_pylist()], pa.string())
            tokens = pc.utf8_split_whitespace(lower)  # the same white space as str.split, but with empty strings at the ends
            own = pc.utf8_trim(tokens.values, characters=SIGNS)
            there = pc.binary_length(own).to_numpy() > 0
            out.append(pc.fill_null(pc.index_in(own, value_set=self.words), -1).to_numpy()[there])
            ends.append(ends[-1][-1] + np.append(0, np.cumsum(there))[tokens.offsets.to_numpy()[1:]])
        return np.concatenate(out), np.concatenate(ends)


def lcs_words(masks: dict[int, int], n: int, region: list[int]) -> int:
    """Length of the longest common subsequence of an item of n words and a region, 64 and more cells at a time."""
    full = (1 << n) - 1
    s = full
    for w in region:
        if m := masks.get(w):
            u = s & m
            s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


def span(n: int) -> int:
    """Words of a document that an item of n words is looked for in."""
    return max(n + n // 4, n + 2)


@dataclass
class Item:
    item_id: int
    ids: list[int]
    answer: list[int]

    def __post_init__(self):
        self.masks: dict[int, int] = {}
        for k, w in enumerate(self.ids):
            self.masks[w] = self.masks.get(w, 0) | 1 << k

    def check(self, ids: np.ndarray, low: int, high: int) -> tuple[float, bool]:
        """(best part of the item in common order, whether its answer is there) between two places of a document."""
        n = len(self.ids)
        near = ids[max(0, low) : high].tolist()
        at = [k for k, w in enumerate(near) if w in self.masks]  # of a region only these words count
        own = [near[k] for k in at]
        if len(own) < LCS_ANSWER * n or lcs_words(self.masks, n, own) < LCS_ANSWER * n:  # no part of a region has more in common
            return 0.0, False
        # Every region that begins at one of the item's words.
        size, best, end = span(n), 0, 0
        for o, first in enumerate(at):
            while end < len(at) and at[end] < first + size:
                end += 1
            if end - o > best:
                best = max(best, lcs_words(self.masks, n, own[o:end]))
                if best == n:
                    break
        m = len(self.answer)
        there = m >= ANSWER_WORDS and any(near[k : k + m] == self.answer for k in range(len(near) - m + 1))
        return best / n, there


def _blocks(at: np.ndarray, ends: np.ndarray, size: int = BLOCK, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(block of each of these places, first block of each document and the end), `gap` empty blocks after each document.
    A document has one block at least."""
    sizes = np.diff(ends)
    first = np.append(0, np.cumsum(np.maximum(1, -(-sizes // size)) + gap))
    row = np.repeat(np.arange(len(sizes)), sizes)[at]
    return first[row] + (at - ends[row]) // size, first


def _each_of(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The `many` numbers from `first` on, of each in turn."""
    ends = np.cumsum(many)
    return np.repeat(first - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)


def _order(keys: np.ndarray, n: int) -> np.ndarray:
    """Places of keys below n in order of the keys, equal ones as they stand."""
    return np.argsort(keys.astype(np.uint16) if n <= 1 << 16 else keys, kind="stable")


def _sums(rows: np.ndarray, index: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(groups, sums of rows[index] of each); `group` is in order. A group is added in runs of 32, the k-th of all runs at once."""
    if not len(group):
        return group, np.zeros((0, rows.shape[1]), rows.dtype)
    start = np.flatnonzero(np.diff(group, prepend=-1))
    place = np.arange(len(group)) - np.repeat(start, np.diff(start, append=len(group)))
    start = np.flatnonzero(place % 32 == 0)
    sizes = np.diff(start, append=len(group))
    order = np.argsort(-sizes, kind="stable")
    start, sizes = start[order], sizes[order]
    out = rows.take(index[start], 0)
    for k in range(1, int(sizes[0])):
        n = int(np.searchsorted(-sizes, -k))  # runs longer than k come first
        out[:n] += rows.take(index[start[:n] + k], 0)
    own, back = group[start], np.argsort(order)
    own = own[back]
    return _sums(out, back, own) if place.max() >= 32 else (own, out[back])


@dataclass
class Retrieval:
    """What tasks need: the vocabulary, the words' latent vectors and the items'. Bounded by ITEMS."""

    ids: Ids
    latent: np.ndarray
    items: list[Item]
    queries: np.ndarray
    lengths: np.ndarray

    def __post_init__(self):
        k = len(self.items)
        self.weighty = np.abs(self.latent).sum(1) > 0
        sizes = np.array([len(i.ids) for i in self.items]) if len(self.lengths) else np.zeros(0)
        self.cover = np.maximum(COVER * np.minimum(1.0, PASSAGE / np.maximum(sizes, 1)) * self.lengths**2, 1e-9)
        # What a word adds to an item's dot product. All that a passage leaves out is 5 % of the least that counts.
        dots = self.latent @ self.queries.T if k else np.zeros((len(self.latent), 0))
        dots[np.abs(dots) <= 1e-3 * self.cover] = 0
        gate = self._gate()
        # Pairs of a word and an item, a word's together.
        word, self.item = np.nonzero((dots != 0) | gate)
        self.dot, self.gate = dots[word, self.item], gate[word, self.item]
        self.many = np.bincount(word, minlength=len(self.latent))
        self.first = np.cumsum(self.many) - self.many
        self.stretch = BLOCK * max(20, -(-int(self.span.max(initial=0)) // BLOCK))

    def _gate(self) -> np.ndarray:
        """Words (rows) that tell where an item (column) can be. Of n words a text with LCS of them lacks n - LCS * n at most,
        so it has all but so many of any choice of them: of those that are not common, or of all where that leaves fewer than two."""
        self.need, self.span = (np.zeros(len(self.items), np.int64) for _ in range(2))
        gate = np.zeros((len(self.latent), len(self.items)), bool)
        anchors: list[tuple[int, int, int]] = []
        uses = np.zeros(len(self.latent), np.int64)
        for item in self.items:
            uses[item.ids] += 1
        for k, item in enumerate(self.items):
            n = len(item.ids)
            lacks = n - math.ceil(LCS * n - 1e-9)
            own = [w for w in item.ids if self.weighty[w]]
            if len(own) - lacks < 2:
                own = item.ids
            self.need[k], self.span[k] = len(own) - lacks, span(n)
            gate[own, k] = True
            if len(item.answer) >= ANSWER_WORDS:
                rarest = min(range(len(item.answer)), key=lambda j: (not self.weighty[item.answer[j]], uses[item.answer[j]]))
                anchors.append((item.answer[rarest], k, rarest))
        # The rarest word of each answer, the items by word.
        word, self.anchor_item, self.anchor_place = np.array(sorted(anchors), np.int64).reshape(-1, 3).T
        self.anchors = np.bincount(word, minlength=len(self.latent))
        self.anchor_first = np.cumsum(self.anchors) - self.anchors
        return gate

    def hits(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place, pair) of the words that an item has, in order of item and place, where two stretches of a document
        side by side have enough of the item. Passages and places are shorter than a stretch."""
        k = len(self.items)
        at = np.flatnonzero(ids >= 0)
        at = at[self.many[ids[at]] > 0]
        many = self.many[ids[at]]
        pair = _each_of(self.first[ids[at]], many)
        item = self.item[pair]
        stretch, first = _blocks(at, ends, self.stretch)
        key = np.repeat(stretch * k, many) + item

        def most(weights: np.ndarray) -> np.ndarray:
            own = np.bincount(key, weights[pair], first[-1] * k).reshape(-1, k)
            two = np.zeros((len(own) + 1, k))
            two[:-1] += own
            two[1:] += own
            return np.maximum(two[:-1], two[1:])

        enough = (most(self.gate) >= self.need) | (most(np.maximum(self.dot, 0)) >= self.cover * (1 - 1e-9))
        kept = np.flatnonzero(enough.ravel()[key])
        kept = kept[_order(item[kept], k)]
        return item[kept], np.repeat(at, many)[kept], pair[kept]

    def near(self, ids: np.ndarray, ends: np.ndarray, hits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(document, block, item) of the passages whose cosine with an item is COSINE or more and that cover enough of it.
        A passage begins at each block but a document's last; a short document is one."""
        item, place, pair = hits
        if not len(item):
            return
        block, first = _blocks(place, ends)
        start = np.flatnonzero((np.diff(item, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        sums, item, block = np.add.reduceat(self.dot[pair], start), item[start], block[start]
        begins, alone = np.zeros(first[-1] + 1, bool), np.zeros(first[-1], bool)
        begins[first] = True
        alone[begins[:-1] & begins[1:]] = True
        after = (item[1:] == item[:-1]) & (block[1:] == block[:-1] + 1) & ~begins[block[1:]]  # the next block has the item too
        both = sums + np.append(np.where(after, sums[1:], 0), 0)
        own = ~begins[block + 1] | alone[block]
        before = ~begins[block] & ~np.append(False, after)  # the passage that ends with this block has nothing before it
        length: dict[int, float] = {}
        for b, i, dot in ((block[own], item[own], both[own]), (block[before] - 1, item[before], sums[before])):
            much = dot >= self.cover[i]
            rows = np.searchsorted(first, b[much], "right") - 1
            for p, k, x, row in zip(b[much].tolist(), i[much].tolist(), dot[much].tolist(), rows.tolist(), strict=True):
                o = p - int(first[row])
                if p not in length:
                    passage = ids[ends[row] : ends[row + 1]][o * BLOCK : o * BLOCK + PASSAGE]
                    length[p] = float(np.linalg.norm(self.latent[passage[passage >= 0]].sum(0)))
                if x >= COSINE * self.lengths[k] * length[p]:
                    yield row, o, k

    def places(self, ids: np.ndarray, ends: np.ndarray, hits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> set[tuple[int, int, int, int]]:
        """(document, item, low, high): no part of a document outside these has LCS of an item, or LCS_ANSWER beside its answer."""
        out: set[tuple[int, int, int, int]] = set()
        gate = self.gate[hits[2]]
        item, place = hits[0][gate], hits[1][gate]
        total = len(item)
        if total:
            apart = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[place] * int(self.span.max())  # hits of two documents are far apart
            last = np.arange(total) + self.need[item] - 1  # the hit that completes the number needed
            done = np.minimum(last, total - 1)
            full = (last < total) & (item[done] == item) & (place[done] + apart[done] - place - apart < self.span[item])
            row = np.searchsorted(ends, place[full], "right") - 1
            for r, k, block in set(zip(row.tolist(), item[full].tolist(), ((place[full] - ends[row]) // BLOCK).tolist(), strict=True)):
                size, masks = int(self.span[k]), self.items[k].masks
                low, high = block * BLOCK - size, (block + 1) * BLOCK + size
                # a word that is not there is at least one of those that may be lacking
                lacking = len(masks) - len(masks.keys() & set(ids[ends[r] : ends[r + 1]][max(0, low) : high].tolist()))
                if lacking <= len(self.items[k].ids) - math.ceil(LCS * len(self.items[k].ids) - 1e-9):
                    out.add((r, k, low, high))
        at = np.flatnonzero(ids >= 0)
        at = at[self.anchors[ids[at]] > 0]
        many = self.anchors[ids[at]]
        anchor = _each_of(self.anchor_first[ids[at]], many)
        begin, item = np.repeat(at, many) - self.anchor_place[anchor], self.anchor_item[anchor]
        # the answer's first and last word before all of it
        sizes = np.array([len(i.answer) for i in self.items])[item]
        inside = (begin >= 0) & (begin + sizes <= len(ids))
        begin, item, sizes = begin[inside], item[inside], sizes[inside]
        ends_of = np.array([(i.answer[0], i.answer[-1]) if i.answer else (-1, -1) for i in self.items]).reshape(-1, 2)[item]
        there = (ids[begin] == ends_of[:, 0]) & (ids[begin + sizes - 1] == ends_of[:, 1])
        for o, k in zip(begin[there].tolist(), item[there].tolist(), strict=True):
            answer, size = self.items[k].answer, PASSAGE + 2 * len(self.items[k].ids)
            r = int(np.searchsorted(ends, o, "right")) - 1
            if ids[o : min(o + len(answer), int(ends[r + 1]))].tolist() == answer:
                o -= int(ends[r])
                out.add((r, k, o + len(answer) - size, o + size))
        return out

    def leaks(self, text: str | None) -> list[tuple[int, float, bool]]:
        return [x[1:] for x in self.leaking(*self.ids.of_all(pa.array([text], pa.string())))]

    def leaking(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, float, bool]]:
        """(document, item_id, similarity, answer) of the items that documents hold: candidates by cosine, and the places
        that the words' numbers leave, where a paraphrase without an item's rarest words has too small a cosine or cover."""
        best: dict[tuple[int, int], tuple[float, bool]] = {}
        for x, y in parts(np.diff(ends) + BLOCK, WORDS) if self.items else ():
            own, own_ends = ids[ends[x] : ends[y]], ends[x : y + 1] - ends[x]
            hits = self.hits(own, own_ends)
            places = self.places(own, own_ends, hits)
            for r, p, k in self.near(own, own_ends, hits):
                n = len(self.items[k].ids)
                places.add((r, k, p * BLOCK - n, p * BLOCK + PASSAGE + n))
            for r, k, low, high in places:
                text, old = own[own_ends[r] : own_ends[r + 1]], best.get((x + r, k), (0.0, False))
                if len(text) >= LEAST_WORDS and old < (1.0, len(self.items[k].answer) >= ANSWER_WORDS):  # else nothing can add to it
                    have, there = self.items[k].check(text, low, high)
                    best[x + r, k] = max(old[0], have), old[1] or (there and have >= LCS_ANSWER)
        return [(r, self.items[k].item_id, x, y) for (r, k), (x, y) in best.items() if x >= LCS or (x >= LCS_ANSWER and y)]


def _tokens(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, ids): each document as word numbers, written once for all passes over it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(vocabulary)
        for b in batches:
            flat, ends = ids.of_all(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["doc_id", "ids"])

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, ids array<int>"))


def _ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of a batch's documents, where each begins and the last one ends)."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and ends of some documents at a time; ids are the batches' first column."""
    for b in batches:
        ids, ends = _ids_of(b.column(0))
        for x, y in parts(np.diff(ends) + BLOCK, WORDS):  # short documents take room too
            yield ids[ends[x] : ends[y]], ends[x : y + 1] - ends[x]


def _document_frequencies(tokens: DataFrame, size: int) -> np.ndarray:
    """How many documents have each word of the vocabulary, over all documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for ids, ends in _parts_of(batches):
            at = np.flatnonzero(ids >= 0)
            own, row = ids[at], np.repeat(np.arange(len(ends) - 1), np.diff(ends))[at]
            order = _order(own, size)  # a word's documents stay in order
            own, row = own[order], row[order]
            first = (np.diff(own, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0)
            counts += np.bincount(own[first], minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["word", "n"])

    out = np.zeros(size)
    for r in tokens.select("ids").mapInArrow(each, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out


def _latent(tokens: DataFrame, items: list[Item], idf: np.ndarray, rank: int) -> np.ndarray:
    """Word vectors: idf times right singular vectors of the TF-IDF passages of all documents, the `rank` leading ones by a
    randomised decomposition with one power step, and the items' own directions. A task sends the rows (word, sum over
    its passages); they are added by word, so the driver receives one vocabulary-by-rank matrix."""
    size = len(idf)
    rank = min(rank, size)
    weight, schema = idf.astype(np.float32), "word int, m binary"
    own = np.zeros((len(items), size), np.float32)
    for row, item in zip(own, items, strict=True):
        np.add.at(row, item.ids, weight[item.ids])

    def rows_of(words: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array([x.tobytes() for x in m], pa.binary())], ["word", "m"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for w, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(m, np.float32)
                total[w] = total[w] + x if w in total else x.astype(np.float64)
        if total:
            yield rows_of(np.array(list(total)), np.array(list(total.values()), np.float32))

    q = np.random.default_rng(11).standard_normal((size, rank), np.float32)
    for _ in range(2):

        def each(batches: Iterator[pa.RecordBatch], q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            total, weighted = np.zeros((size, q.shape[1]), np.float32), weight[:, None] * q
            for ids, ends in _parts_of(batches):
                at = np.flatnonzero(ids >= 0)
                at = at[weight[ids[at]] > 0]
                blocks, first = _blocks(at, ends, gap=1)
                own = ids[at]
                for o in range(0, first[-1], BLOCKS):  # and the blocks beside these, whose words are another range's
                    n = min(BLOCKS, first[-1] - o)
                    near = slice(*np.searchsorted(blocks, [o - 1, o + n + 1]))
                    mine = slice(*np.searchsorted(blocks, [o, o + n]))
                    each_block = np.zeros((n + 2, q.shape[1]), np.float32)
                    which, sums = _sums(weighted, own[near], blocks[near])
                    each_block[which - o + 1] = sums
                    passages = each_block[1:] + each_block[:-1]  # and the document's ends
                    order = _order(own[mine], size)
                    which, sums = _sums(passages[1:] + passages[:-1], (blocks[mine] - o)[order], own[mine][order])
                    total[which] += weight[which, None] * sums
            met = np.flatnonzero(np.abs(total).sum(1))
            yield rows_of(met, total[met])

        y = np.zeros((size, rank), np.float32)
        parts = tokens.select("ids").mapInArrow(each, schema).repartition(shuffle_partitions(tokens.sparkSession), "word")
        for r in parts.mapInArrow(added, schema).collect():
            y[r.word] = np.frombuffer(r.m, np.float32)
        q, _ = np.linalg.qr(y)
    q, r = np.linalg.qr(np.hstack([own.T, q]))
    q = q[:, np.abs(np.diag(r)) > 1e-4 * np.abs(np.diag(r)).max()]  # directions that others have already are noise
    return weight[:, None] * q


def _answer(text: str) -> list[str]:
    """The words of an item's last sentence."""
    parts = [w for w in (words(p) for p in text.replace("\n", ". ").replace("? ", ". ").split(". ")) if w]
    return parts[-1] if len(parts) > 1 else []


def _models(docs: DataFrame, benchmark: DataFrame, rank: int) -> Iterator[tuple[Retrieval, DataFrame]]:
    """What finds the items of each slice of the benchmark, fitted on all docs, and the docs as its word numbers."""
    n_docs, n_items = docs.count(), benchmark.count()
    slices = max(1, math.ceil(n_items / (ITEMS * 0.8))) if n_items > ITEMS else 1
    for k in range(slices):
        rows = benchmark.where("text is not null and item_id is not null").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).select("item_id", "text").collect()
        texts = [(int(r.item_id), words(r.text), _answer(r.text)) for r in rows]
        texts = [x for x in texts if len(x[1]) >= LEAST_WORDS]
        if not texts or not n_docs:
            continue
        vocabulary: dict[str, int] = {}
        for _, own, _ in texts:
            for w in own:
                vocabulary.setdefault(w, len(vocabulary))
        items = [Item(i, [vocabulary[w] for w in own], [vocabulary[w] for w in answer]) for i, own, answer in texts]
        tokens = _tokens(docs, vocabulary)
        df = _document_frequencies(tokens, len(vocabulary))
        idf = np.where(df > COMMON * n_docs, 0.0, np.log((n_docs + 1) / (df + 1)) + 1)
        for item in items:  # an item of common words alone keeps them
            if not idf[item.ids].any():
                idf[item.ids] = 1.0
        latent = _latent(tokens, items, idf, rank)
        queries = np.array([latent[item.ids].sum(0) for item in items])
        yield Retrieval(Ids(vocabulary), latent, items, queries, np.sqrt((queries**2).sum(1))), tokens


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, similarity, answer): the documents that hold an item of the benchmark, or nearly so.

    similarity: the longest common subsequence of words, as a part of the item's words, LCS or more; or LCS_ANSWER or more
    with the item's answer (its last sentence, if that has four words) beside it. Items of fewer than five
    words, null items and null texts hold nothing. Documents with a null doc_id are judged like others; rows that
    share a doc_id or item_id are one. The benchmark is handled in slices of about ITEMS items at most, each held by every task.
    """
    schema = "doc_id long, item_id long, similarity double, answer boolean"
    names, kinds = ["doc_id", "item_id", "similarity", "answer"], [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
    found = docs.sparkSession.createDataFrame([], schema)
    for model, tokens in _models(docs, benchmark, rank):

        def each(batches: Iterator[pa.RecordBatch], model: Retrieval = model) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(b.column(0)[r].as_py(), *x) for r, *x in model.leaking(*_ids_of(b.column(1)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, kinds, strict=True)], names)

        found = found.union(tokens.mapInArrow(each, schema))
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max("answer").alias("answer"))


def clean(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """docs without the rows that hold an item. Each row is judged by its own text, whatever its doc_id."""
    left = docs
    for model, _ in _models(docs, benchmark, rank):

        def each(batches: Iterator[pa.RecordBatch], model: Retrieval = model) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = {r for r, *_ in model.leaking(*model.ids.of_all(b.column("text")))}
                yield b.filter(pa.array([r not in found for r in range(b.num_rows)], pa.bool_()))

        left = left.withColumn("text", F.col("text").cast("string")).mapInArrow(each, docs.schema)
    return left
