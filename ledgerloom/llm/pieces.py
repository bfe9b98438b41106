"""Cutting oversized texts at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tokens import TOKEN, token_count
from ledgerloom.session import ship_package

_NATURAL = re.compile(r"\n|(?<=[.!?])\s")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")

#: Cut penalties: at a blank line, a line feed, a sentence's end, between any two tokens.
PARAGRAPH, LINE, SENTENCE, ANYWHERE = 0.0, 0.05, 0.1, 4.0
_NAMES = {PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", ANYWHERE: "token"}


def boundaries(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers before which there is a natural boundary (ascending, without 0 and the end), and their penalties."""
    found: dict[int, float] = {}
    at = [m.start() for m in _NATURAL.finditer(text)]
    for pos, token in zip(at, np.searchsorted(starts, at).tolist(), strict=True):
        kind = LINE if text[pos] == "\n" else SENTENCE
        found[token] = min(kind, found.get(token, kind))
    breaks = [m.end() for m in _PARAGRAPH.finditer(text)]
    for token in np.searchsorted(starts, breaks).tolist():
        found[token] = PARAGRAPH
    cuts = sorted(t for t in found if 0 < t < len(starts))
    return np.array(cuts, dtype=np.int64), np.array([found[t] for t in cuts])


def best_cuts(n: int, natural: np.ndarray, penalty: np.ndarray, limit: int, overlap: int) -> tuple[list[int], list[float]]:
    """Token numbers at which to cut ``n`` tokens, and the penalty of each.

    The piece up to a cut has the tokens since the previous cut and ``overlap``
    ones before it, ``limit`` at most. Over all such sequences of cuts the sum of
    cut penalties and squared deviations from even pieces is least: dynamic
    programming over the natural boundaries, and over every token where two
    neighbours are too far apart for one piece.
    """
    reach = limit - overlap
    edges = np.concatenate(([0], natural, [n]))
    wide = np.flatnonzero(np.diff(edges) > reach)
    points, cost = natural, penalty
    if len(wide):
        extra = np.concatenate([np.arange(edges[i] + 1, edges[i + 1]) for i in wide])
        points, cost = np.concatenate((natural, extra)), np.concatenate((penalty, np.full(len(extra), ANYWHERE)))
        order = np.argsort(points, kind="stable")
        points, cost = points[order], cost[order]
    usable = points >= overlap  # the second piece must find its overlap in the first
    points = np.concatenate(([0], points[usable], [n]))
    cost = np.concatenate(([0.0], cost[usable], [0.0]))
    pieces = max(1, -(-(n - overlap) // reach))
    even = (n - overlap) / pieces
    total = np.full(len(points), np.inf)
    total[0], back = 0.0, np.zeros(len(points), dtype=np.int64)
    low = np.maximum(np.searchsorted(points, points - reach), 1)
    for j in range(1, len(points)):
        a = low[j]
        if j > a:
            uneven = (points[j] - points[a:j] - even) / reach
            sums = total[a:j] + uneven * uneven
            k = int(sums.argmin())
            total[j], back[j] = sums[k] + cost[j], a + k
        if points[j] <= limit:
            uneven = (points[j] - overlap - even) / reach
            if (first := uneven * uneven + cost[j]) < total[j]:
                total[j], back[j] = first, 0
    cuts, j = [], int(back[-1])
    while j:
        cuts.append(j)
        j = int(back[j])
    cuts.reverse()
    return points[cuts].tolist(), cost[cuts].tolist()


def cut_text(text: str, limit: int, overlap: int) -> tuple[list[tuple], int]:
    """Pieces (from, own, until, tokens, cut) of a text in characters, and its longest stretch of tokens without a natural boundary.

    A piece is text[from:until], text[own:until] is what it adds: those parts
    joined are the text. ``cut`` says what kind of boundary it ends at.
    """
    starts = np.fromiter((m.start() for m in TOKEN.finditer(text)), dtype=np.int64)
    n = len(starts)
    natural, penalty = boundaries(text, starts)
    longest = int(np.diff(np.concatenate(([0], natural, [n]))).max()) if n else 0
    if n <= limit:
        return [(0, 0, len(text), n, "end")], longest
    cuts, kinds = best_cuts(n, natural, penalty, limit, overlap)
    out, before = [], 0
    for cut, kind in zip([*cuts, n], [*kinds, None], strict=True):
        first = before - overlap if before else 0
        out.append((int(starts[first]) if first else 0, int(starts[before]) if before else 0, int(starts[cut]) if cut < n else len(text), cut - first, _NAMES[kind] if kind is not None else "end"))
        before = cut
    return out, longest


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 400, overlap: int = 40, small: bool = True, with_text: bool = True) -> DataFrame:
    """Pieces of at most ``limit`` tokens, consecutive ones with ``overlap`` tokens in common.

    Columns: ``key``, piece (from 0), pieces, start, own, stop (code points:
    the piece is text[start:stop], of which text[own:stop] is new), tokens, cut
    (``paragraph``, ``line``, ``sentence``, ``token`` or ``end``), longest_stretch
    (tokens between neighbouring natural boundaries of the whole text), and, with
    ``with_text``, text. The new parts of a text's pieces joined are the text. A
    text within the limit is one piece, left out without ``small``; NULL counts
    as empty. Equal keys are cut each by themselves. Other columns are dropped.

    Tokens are counted by the JVM; Python sees oversized texts only. Each text is
    cut by itself, so nothing is shuffled.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of limit")
    ship_package(df.sparkSession)
    fields = [("piece", pa.int32()), ("pieces", pa.int32()), ("start", pa.int64()), ("own", pa.int64()), ("stop", pa.int64()), ("tokens", pa.int64()), ("cut", pa.string()), ("longest_stretch", pa.int64())]
    names = [n for n, _ in fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, columns, parts = [], [[] for _ in fields], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                t = t or ""
                pieces, longest = cut_text(t, limit, overlap)
                for k, (start, own, stop, tokens, kind) in enumerate(pieces):
                    keys.append(i)
                    for c, v in zip(columns, (k, len(pieces), start, own, stop, tokens, kind, longest), strict=True):
                        c.append(v)
                    if with_text:
                        parts.append(t[start:stop])
            arrays = [batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(parts, pa.string())] if with_text else []), names=["key", *names] + ["text"] * with_text)

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if not small:
        rows = rows.where(token_count(F.col("text")) > limit)
    schema = f"key {df.schema[key].dataType.simpleString()}, piece int, pieces int, start bigint, own bigint, stop bigint, tokens bigint, cut string, longest_stretch bigint" + ", text string" * with_text
    return rows.mapInArrow(cut, schema).withColumnRenamed("key", key)
