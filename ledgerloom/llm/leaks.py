"""Evaluation texts leaking into training text.

Both sides are reduced to words (``plain_words``). A leak lacks few words of its
passage, so that of the passage's rarest pairs of neighbouring words a known
number must stand within a bounded stretch of the document, the words of a pair
a few words apart at most.

The rarer word of each such pair is a test string. All of them are searched at
once with the shift table and the suffix buckets of Wu and Manber
(``WuManber``), on the bytes of the texts. Where a test string occurs, the words
around it are compared directly with the rest of its pairs. A stretch that has
pairs enough is a candidate; no leak is without one. Candidates are aligned
exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.plainwords import plain_words
from ledgerloom.llm.wumanber import WuManber
from ledgerloom.session import ship_package
from ledgerloom.sources.durable import durable

#: How many of the pairs kept of a passage a leak must have at least; more make fewer candidates and more hits.
SURE = 6


@dataclass(frozen=True)
class Rule:
    """A leak: ``least`` of ``stretch`` consecutive words in order, at most ``between`` words
    apart. A run of ``phrase`` words that ``common`` items have is a standard phrase."""

    stretch: int = 30
    least: int = 26
    between: int = 6
    phrase: int = 12
    common: int = 3


@dataclass
class Searcher:
    """Patterns of a bounded block of evaluation texts."""

    ids: list  # evaluation ids
    texts: list[np.ndarray]  # their words' numbers, standard phrases left out
    skipped: list[np.ndarray]  # how many words were left out before each word
    vocabulary: dict[str, int]
    rule: Rule
    needed: list[np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        self.size = len(self.vocabulary) + 1
        self._pairs()

    def _pairs(self) -> None:
        """Keep the rarest pairs of neighbouring words of each passage, and how many of them a leak must have.

        A word that a leak lacks costs two pairs, so that all but twice as many as it may lack are there.
        Pairs with words left out between are not kept.
        """
        rule, lost = self.rule, 2 * (self.rule.stretch - self.rule.least)
        code = [np.where(g[1:] > 0, -1, t[:-1] * self.size + t[1:]) for t, g in zip(self.texts, self.skipped, strict=True)]
        every, turn, count = np.unique(np.concatenate([*code, np.full(1, -1)]), return_inverse=True, return_counts=True)
        often = count[turn]
        self.needed, self.reach, self.open, self.origin = [], 2 * rule.stretch + rule.stretch * rule.between, [], []
        codes, places, begin, base = [], [], 0, 0
        for k, c in enumerate(code):
            self.origin.append(base)
            windows = len(self.texts[k]) - rule.stretch + 1
            rare = np.where(c < 0, np.iinfo(np.int64).max, often[begin : begin + len(c)])
            begin += len(c)
            keep = np.zeros(len(c), dtype=bool)
            for s in range(windows):
                keep[s + np.argsort(rare[s : s + rule.stretch - 1], kind="stable")[: lost + SURE]] = True
                self.reach = max(self.reach, int(self.skipped[k][s : s + rule.stretch].sum()) + rule.stretch * (rule.between + 2))
            keep &= c >= 0
            many = np.concatenate(([0], np.cumsum(keep)))
            need = np.array([many[s + rule.stretch - 1] - many[s] - lost for s in range(windows)], dtype=np.int64)
            if windows > 0 and need.min() < 1:
                self.open.append(k)
            self.needed.append(need)
            if windows > 0:
                codes.append(c[keep])
                places.append(base + np.flatnonzero(keep))
            base += len(self.texts[k]) + rule.stretch  # no passage spans two texts
        self.places = base + 1
        code, place = np.concatenate([*codes, np.zeros(0, np.int64)]), np.concatenate([*places, np.zeros(0, np.int64)])
        self._test_strings(code, place)
        self.origin = np.array(self.origin, dtype=np.int64)
        self.least = np.array([n.min() if len(n) else 1 for n in self.needed], dtype=np.int64)

    def _test_strings(self, code: np.ndarray, place: np.ndarray) -> None:
        """Pairs by their rarer word, which is searched for, of equally rare ones the longer; the other follows it or goes before."""
        word = [""] * self.size
        for w, k in self.vocabulary.items():
            word[k] = w
        long = np.array([len(w) for w in word], dtype=np.int64)
        often = np.bincount(np.concatenate([*self.texts, np.zeros(0, np.int64)]), minlength=self.size)
        weight = often * 1000 - np.minimum(long, 999) + (long < 4) * (1 << 40)  # short strings only where both are
        a, b = code // self.size, code % self.size
        ahead = weight[a] <= weight[b]
        self.ahead, self.behind = (_Places(code[x], place[x]) for x in (ahead, ~ahead))
        strings = np.unique(np.where(ahead, a, b))
        self.found_first, self.found_last = np.isin(strings, a[ahead]), np.isin(strings, b[~ahead])
        self.search = WuManber([f" {word[k]} ".encode() for k in strings.tolist()])

    def passages(self, words: np.ndarray, begin: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(document, text, position in the document, starts of the text's passages): wherever a leak may begin, within two
        ``reach`` from the position. ``text``: the documents' words as bytes, a blank before and after each; each blank is
        a place in ``words``, that after a document's last word the place that parts it from the next."""
        keys, shift = [], int(self.reach - 1).bit_length()
        first_block = np.concatenate(([0], np.cumsum((np.diff(begin) >> shift) + 2)))
        position, string = self.search.search(text)
        found = np.cumsum(text == ord(" "), dtype=np.int32)[position].astype(np.int64) - 1
        owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        for places, at in ((self.ahead, found[self.found_first[string]]), (self.behind, found[self.found_last[string]])):
            here = words[at]
            for gap in range(1, self.rule.between + 2):
                first, last = (at, np.minimum(at + gap, len(words) - 1)) if places is self.ahead else (np.maximum(at - gap, 0), at)
                hit, place = places.of(here * self.size + words[last] if places is self.ahead else words[first] * self.size + here)
                same = owner[first[hit]] == owner[last[hit]]
                first, place = first[hit][same], place[same]
                own = owner[first]
                block = first_block[own] + ((first - begin[own]) >> shift) + 1
                keys.append(block * self.places + place)
        key = _distinct(np.concatenate(keys))
        key = _distinct(np.concatenate((key, key - self.places)))  # a block and the one after it
        text = np.searchsorted(self.origin, key % self.places, side="right") - 1
        far = np.arange(len(key)) + np.maximum(self.least[text], 1) - 1
        dense = far < len(key)
        dense[dense] = key[far[dense]] - key[dense] <= self.rule.stretch - 2
        group = key // self.places * len(self.texts) + text
        likely = _distinct(group[dense])
        document = np.searchsorted(first_block, likely // len(self.texts), side="right") - 1
        for g, d, a, b in zip(likely.tolist(), document.tolist(), np.searchsorted(group, likely).tolist(), np.searchsorted(group, likely + 1).tolist(), strict=True):
            block, k = divmod(g, len(self.texts))
            there = np.zeros(len(self.texts[k]) + 1, dtype=np.int64)
            there[key[a:b] % self.places - self.origin[k] + 1] = 1
            many = np.cumsum(there)
            starts = np.flatnonzero(many[self.rule.stretch - 1 : self.rule.stretch - 1 + len(self.needed[k])] - many[: len(self.needed[k])] >= self.needed[k])
            if len(starts):
                yield d, k, max(int(block - first_block[d]) - 1, 0) << shift, starts
        for k in self.open:  # too few pairs to tell: everywhere
            for d in range(len(begin) - 1):
                for at in range(0, int(begin[d + 1] - begin[d]), 1 << shift):
                    yield d, k, at, np.arange(len(self.needed[k]))


class _Places:
    """Where each pair stands among all texts' words."""

    def __init__(self, code: np.ndarray, place: np.ndarray):
        order = np.argsort(code, kind="stable")
        self.code, first = np.unique(code[order], return_index=True)
        self.first, self.place = np.concatenate((first, [len(code)])), place[order]
        self.there = np.zeros(1 << 21, dtype=bool)
        self.there[self._slot(self.code)] = True

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return code * 2_654_435_761 >> 13 & (len(self.there) - 1)

    def of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in ``code``, place): all places of all pairs asked for."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.code) or not len(code):
            return none, none
        likely = np.flatnonzero(self.there[self._slot(code)])
        at = np.minimum(np.searchsorted(self.code, code[likely]), len(self.code) - 1)
        same = self.code[at] == code[likely]
        at, known = at[same], likely[same]
        if not len(known):
            return none, none
        many = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
        return np.repeat(known, many), self.place[entry]


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted values without repeats; ``np.unique`` hashes, which takes many times as long here."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def aligned(text: np.ndarray, skipped: np.ndarray, document: np.ndarray, starts: Iterable[int], rule: Rule) -> bool:
    """Whether a passage of ``text`` whose first word found is at one of ``starts`` stands in ``document``; exact.

    Ends of all alignments are followed at once, as bits of a number with a bit for each word of the document:
    ``rows[i][e]`` has those that end with word i of the text and lack e of the words from the start to it. The
    passage is there if ``least`` words are found and no more are lacking than the stretch allows.
    """
    n, slack = len(text), rule.stretch - rule.least
    if n < rule.stretch:
        return False
    starts = list(starts)
    where: dict[int, int] = dict.fromkeys(text[min(starts, default=0) : max(starts, default=0) + rule.stretch].tolist(), 0)
    sought = np.zeros(int(max(text.max(), document.max(initial=0))) + 1, dtype=bool)
    sought[list(where)] = True
    shared = np.flatnonzero(sought[document])
    for j, w in zip(shared.tolist(), document[shared].tolist(), strict=True):
        where[w] |= 1 << j
    bits = [where.get(w, 0) for w in text.tolist()]
    left_out = np.cumsum(skipped).tolist()

    def spread(ends: int, width: int) -> int:
        done = 1
        while done < width:
            step = min(done, width - done)
            ends |= ends << step
            done += step
        return ends << 1

    for s in starts:
        rows = [[bits[s]] + [0] * slack]
        ahead = [[spread(x, rule.between + 1) if x else 0 for x in rows[0]]]
        alive = s if bits[s] else -n
        for i in range(s + 1, min(s + rule.stretch, n)):
            if i - alive > slack + 1:
                break
            row = [0] * (slack + 1)
            if bits[i]:
                for d in range(min(slack, i - s - 1) + 1):
                    gone = left_out[i] - left_out[i - 1 - d]
                    for e in range(d, slack + 1):
                        if rows[-1 - d][e - d]:
                            row[e] |= spread(rows[-1 - d][e - d], rule.between + 1 + gone) if gone else ahead[-1 - d][e - d]
                row = [x & bits[i] for x in row]
            rows.append(row)
            ahead.append([spread(x, rule.between + 1) if x else 0 for x in row])
            for e, x in enumerate(row):
                if x:
                    alive = i
                    if i - s + 1 - e >= rule.least:
                        return True
    return False


def leaked(searcher: Searcher, documents: list[np.ndarray], rule: Rule, lines: list[str] | None = None) -> list[tuple[int, int]]:
    """(document number, text number) of all leaks.

    ``documents``: their words' numbers, 0 for words that no text has; ``lines``: the words themselves, a blank between
    them. Without ``lines`` they are written from the numbers.
    """
    if lines is None:
        word = {k: w for w, k in searcher.vocabulary.items()}
        lines = [" ".join(word.get(k, "_") for k in x.tolist()) for x in documents]
    sizes = np.array([len(x) for x in documents], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))  # a word without number parts the documents
    words = np.zeros(int(begin[-1]), dtype=np.int64)
    for b, x in zip(begin, documents, strict=False):
        words[b : b + len(x)] = x
    out = set()
    text = np.frombuffer("\0".join(f" {x} " if x else " " for x in lines).encode(), dtype=np.uint8)
    for d, k, at, starts in searcher.passages(words, begin, text):
        if (d, k) in out:
            continue
        if starts[-1] == len(searcher.texts[k]) - rule.stretch:  # the last passage may lack its first words
            starts = [*starts.tolist(), *range(int(starts[-1]) + 1, len(searcher.texts[k]) - rule.least + 1)]
        if aligned(searcher.texts[k], searcher.skipped[k], documents[d][at : at + 4 * searcher.reach], starts, rule):
            out.add((d, k))
    return sorted(out)


def searchers(items: DataFrame, key: str, text: str, rule: Rule, block: int) -> Iterator[Searcher]:
    """Searchers over blocks of ``block`` evaluation texts; the driver holds one block at a time."""
    spark = items.sparkSession

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([plain_words(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["key", "words"])

    kind = items.schema[key].dataType.simpleString()
    told = items.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(words, f"key {kind}, words array<string>")
    told = told.groupBy("key").agg(F.max("words").alias("words"))  # a repeated id has one text
    runs = told.where(F.size("words") >= rule.phrase).select("key", "words", F.explode(F.sequence(F.lit(1), F.size("words") - rule.phrase + 1)).alias("at"))
    runs = runs.select("key", "at", F.xxhash64(F.slice("words", F.col("at"), rule.phrase)).alias("run"))
    common = runs.groupBy("run").agg(F.countDistinct("key").alias("items")).where(F.col("items") >= rule.common).select("run")
    phrases = runs.join(common, "run", "left_semi").groupBy("key").agg(F.collect_list("at").alias("phrases"))
    numbered = told.join(phrases, "key", "left").repartitionByRange(F.col("key")).sortWithinPartitions("key")
    held: list = []
    for row in numbered.toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield _searcher(held, rule)
            held = []
    if held:
        yield _searcher(held, rule)


def _searcher(rows: list, rule: Rule) -> Searcher:
    vocabulary: dict[str, int] = defaultdict(lambda: len(vocabulary) + 1)
    ids, texts, skipped = [], [], []
    for row in rows:
        standard = np.zeros(len(row["words"]) + 1, dtype=bool)
        for at in row["phrases"] or []:
            standard[at - 1 : at - 1 + rule.phrase] = True
        kept, gaps, gap = [], [], 0
        for w, left_out in zip(row["words"], standard, strict=False):
            if left_out:
                gap += 1
                continue
            kept.append(vocabulary[w])
            gaps.append(gap)
            gap = 0
        ids.append(row["key"])
        texts.append(np.array(kept, dtype=np.int64))
        skipped.append(np.array(gaps, dtype=np.int64))
    return Searcher(ids, texts, skipped, dict(vocabulary), rule)


def find_leaks(documents: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, rule: Rule | None = None, block: int = 4000) -> DataFrame:
    """(doc_key, item_key): every document that has a passage of an evaluation text, each pair once.

    Any amount of text in a document may surround the passage. NULL and empty
    texts on either side leak nothing; a document id that occurs twice counts
    for all its texts; rows with a NULL id are left out. Evaluation texts are taken
    in blocks of ``block``, whose patterns are broadcast, each block against all
    documents: the broadcast is bounded by the block, not by the data.
    """
    rule = rule or Rule()
    spark = documents.sparkSession
    ship_package(spark)
    rows = documents.where(F.col(doc_key).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_key).alias("doc"), F.col(text).alias("text"))
    schema = f"doc {documents.schema[doc_key].dataType.simpleString()}, item {items.schema[item_key].dataType.simpleString()}"
    blocks = searchers(items, item_key, item_text, rule, block)
    searcher, following, reduced, parts = next(blocks, None), next(blocks, None), False, []
    if following:  # texts are reduced to words once, however many blocks there are
        rows, reduced = durable(rows.mapInArrow(_reduce(rule), rows.schema), "words"), True
    while searcher:
        shared = spark.sparkContext.broadcast(searcher)
        found = rows.mapInArrow(_search(shared, rule, reduced), schema)
        parts.append(durable(found, "leaks") if reduced else found)
        if reduced:
            shared.unpersist()
        searcher, following = following, next(blocks, None)
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return found.distinct().select(F.col("doc").alias(doc_key), F.col("item").alias(item_key))


def _reduce(rule: Rule):
    def reduce_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = (plain_words(t) for t in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(w) for w in words], pa.string())], names=["doc", "text"])

    return reduce_texts


#: Words searched at once.
AT_ONCE = 400_000


def _search(shared, rule: Rule, reduced: bool):
    """``reduced``: the texts are words with blanks between them already."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = shared.value
        number = searcher.vocabulary.get
        ids = pa.array(searcher.ids)
        for batch in batches:
            column, held, lines, which, size = batch.column(1), [], [], [], 0
            for i in range(len(column)):
                text = column[i].as_py()
                words = text.split(" ") if reduced else plain_words(text)
                if len(words) >= rule.least:
                    held.append(np.fromiter((number(w, 0) for w in words), dtype=np.int64, count=len(words)))
                    lines.append(" ".join(words))
                    which.append(i)
                    size += len(words)
                if size >= AT_ONCE or i + 1 == len(column):
                    pairs = leaked(searcher, held, rule, lines) if held else []
                    if pairs:
                        docs = batch.column(0).take(pa.array([which[d] for d, _ in pairs], pa.int64()))
                        yield pa.RecordBatch.from_arrays([docs, ids.take(pa.array([t for _, t in pairs], pa.int64()))], names=["doc", "item"])
                    held, lines, which, size = [], [], [], 0

    return search
