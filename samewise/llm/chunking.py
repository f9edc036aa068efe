"""Cutting oversized texts into pieces at natural boundaries, with an overlap between neighbours.

Sizes are in tokens of a public tokenizer. A document is first cut into its atomic segments: subtitle
cues (blocks between blank lines); where a block is itself too large its lines, then their sentences, words
and, at last, single tokens. Neighbouring segments are then merged agglomeratively: a heap holds all
adjacent pairs, the weakest boundary with the smallest combined size first, and a pair is merged while its
size plus the largest overlap fits the limit.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.bpe import MEMO, VOCABULARY, PrefixBPE, load, split

#: Boundary strengths, the weakest first.
TOKEN, WORD, SENTENCE, LINE, CUE, CUE_END = range(6)
_BLANK = re.compile(r"(?:\r\n|\r|\n)[ \t\f\v]*(?:\r\n|\r|\n)\s*")
_LINE = re.compile(r"\r\n|\r|\n")
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*(?=\s)|[。！？]")
_WORD = re.compile(r"\S(?=\s)")
_ENDS = re.compile(r"[.!?…。！？♪][\"'”’»)\]>]*\s*\Z")


class _Pieces:
    """The split pieces of a text with their places and token counts."""

    def __init__(self, bpe: PrefixBPE, text: str, parts: list[str], counts: list[int]) -> None:
        self.bpe, self.text = bpe, text
        self.at = [0, *accumulate(map(len, parts))]
        self.tokens = [0, *accumulate(counts)]

    def size(self, a: int, b: int) -> int:
        return self.tokens[b] - self.tokens[a]

    def cut(self, char: int) -> int:
        """The first split place at or after ``char``, so no token is torn."""
        return bisect_left(self.at, char)


def _segments(p: _Pieces, start: int, end: int, room: int, level: int = CUE) -> list[tuple[int, int]]:
    """``(end, strength)`` of the atomic segments of pieces ``start..end``; strength is of the boundary behind."""
    text, lo, hi = p.text, p.at[start], p.at[end]
    if level == CUE:
        cuts = [m.end() for m in _BLANK.finditer(text, lo, hi)]
    elif level == LINE:
        cuts = [m.end() for m in _LINE.finditer(text, lo, hi)]
    elif level == SENTENCE:
        cuts = [m.end() for m in _SENTENCE.finditer(text, lo, hi)]
    elif level == WORD:
        cuts = [m.end() for m in _WORD.finditer(text, lo, hi)]
    else:
        return [(k, TOKEN) for k in range(start + 1, end + 1)]
    out, before = [], start
    for k in sorted({p.cut(c) for c in cuts} | {end}):
        if before < k <= end:
            if p.size(before, k) > room and k - before > 1:
                out += _segments(p, before, k, room, level - 1)
                out.pop()
            strength = CUE_END if level == CUE and _ENDS.search(text, max(0, p.at[k] - 12), p.at[k]) else level
            out.append((k, strength))
            before = k
    return out


def merge(sizes: list[int], strengths: list[int], room: int) -> list[int]:
    """Ends of the merged groups of segments; ``strengths[i]`` is of the boundary behind segment ``i``.

    Pairs whose combined size is over ``room`` stay apart for good, as groups only grow.
    """
    n = len(sizes)
    size, after, before, alive = list(sizes), [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
    last = list(range(n))
    heap = [(strengths[i], sizes[i] + sizes[i + 1], i, i + 1) for i in range(n - 1) if sizes[i] + sizes[i + 1] <= room]
    heapq.heapify(heap)
    while heap:
        _, both, i, j = heapq.heappop(heap)
        if not alive[i] or after[i] != j or size[i] + size[j] != both:
            continue
        alive[j], size[i], last[i], after[i] = False, both, last[j], after[j]
        k = after[i]
        if k < n:
            before[k] = i
            if both + size[k] <= room:
                heapq.heappush(heap, (strengths[last[i]], both + size[k], i, k))
        h = before[i]
        if h >= 0 and size[h] + both <= room:
            heapq.heappush(heap, (strengths[last[h]], size[h] + both, h, i))
    return [last[i] + 1 for i in range(n) if alive[i]]


def _overlap(p: _Pieces, start: int, at: int, least: int, most: int) -> int:
    """Where the repeated tail of pieces ``start..at`` begins: ``least`` tokens or a little more, at a natural place."""
    lo = max(start, bisect_left(p.tokens, p.tokens[at] - most))
    hi = bisect_right(p.tokens, p.tokens[at] - least) - 1
    if hi < lo:  # one piece is longer than the largest overlap allows
        return at if lo >= at else lo
    text, span = p.text, (p.at[lo], p.at[hi])
    for pattern in (_BLANK, _LINE, _SENTENCE):
        found = [k for m in pattern.finditer(text, *span) if lo <= (k := p.cut(m.end())) <= hi]
        if found:
            return found[-1]
    return next((k for k in range(hi, lo - 1, -1) if text[p.at[k] : p.at[k] + 1].isspace()), hi)


def cut_text(bpe: PrefixBPE, text: str, limit: int = 1000, overlap: int = 50, most: int = 100, parts: list[str] | None = None, counts: list[int] | None = None) -> list[tuple[int, int, int, int]]:
    """``(start, end, fresh, tokens)`` of each piece: places in ``text``, where its new part begins, its size.

    A text within the limit is one piece. The pieces' new parts follow each other and are the whole text.
    """
    parts = split(text) if parts is None else parts
    counts = bpe.counts(parts) if counts is None else counts
    if sum(counts) <= limit:
        return [(0, len(text), 0, sum(counts))]
    long = [k for k, c in enumerate(counts) if c > limit - most]
    if long:  # a piece of the split is itself too large: it is cut between its tokens
        fine: list[str] = []
        for k, part in enumerate(parts):
            fine += _between_tokens(bpe, part, limit - most) if counts[k] > limit - most else [part]
        parts, counts = fine, bpe.counts(fine)
    p = _Pieces(bpe, text, parts, counts)
    segments = _segments(p, 0, len(parts), limit - most)
    ends = [0, *(e for e, _ in segments)]
    groups = merge([p.size(a, b) for a, b in zip(ends, ends[1:])], [s for _, s in segments], limit - most)
    out, start = [], 0
    for g in groups:
        end = ends[g]
        begin = _overlap(p, start, start, overlap, most) if not out else _overlap(p, out[-1][4], start, overlap, most)
        out.append((p.at[begin], p.at[end], p.at[start], p.size(begin, end), start))
        start = end
    return [x[:4] for x in out]


def _between_tokens(bpe: PrefixBPE, part: str, most: int) -> list[str]:
    """``part`` in slices that have at most ``most`` tokens each, however encoded, cut between characters."""
    out, step = [], max(1, most // 4)  # a character has at most four bytes, a byte at most one token
    for k in range(0, len(part), step):
        out.append(part[k : k + step])
    return out


SCHEMA = "piece int, start int, fresh int, end int, tokens int, text string"


def cut_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1000, overlap: int = 50, most: int = 100, vocabulary: str = VOCABULARY, only_cut: bool = False, with_text: bool = True) -> DataFrame:
    """``key, piece, start, fresh, end, tokens, text``: the pieces of every row's text, counted from 0.

    ``start``/``end`` are places (code points) in the text, ``fresh`` where the part begins that the piece
    before does not have. A text within ``limit`` is one piece; NULL and empty texts have none. With
    ``only_cut`` texts within the limit are left out. Repeated keys are cut row by row. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            if len(bpe.table) > MEMO:
                bpe.table.renew()
            rows: list[tuple] = []
            texts, parts, ends = batch.column(1).to_pylist(), [], [0]
            for value in texts:  # a token has at least one byte
                if value and not (only_cut and len(value) <= limit and len(value.encode("utf-8", "replace")) <= limit):
                    parts += split(value)
                ends.append(len(parts))
            counts = bpe.table.counts(bpe.table.rows(parts))
            for k, value, a, b in zip(batch.column(0).to_pylist(), texts, ends, ends[1:]):
                if a == b or (only_cut and counts[a:b].sum() <= limit):
                    continue
                for n, (x, y, fresh, tokens) in enumerate(cut_text(bpe, value, limit, overlap, most, parts[a:b], counts[a:b].tolist())):
                    rows.append((k, n, x, fresh, y, tokens, value[x:y] if with_text else None))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [batch.schema.field(0).type, *[pa.int32()] * 5, pa.string()]
            values = [pa.array(list(c), t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(values, names=[key, *(x.split(" ")[0] for x in SCHEMA.split(", "))])

    kind = df.select(F.col(f"`{key}`").alias(key)).schema[0].dataType.simpleString()
    source = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("__text"))
    return source.mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
