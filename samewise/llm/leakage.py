"""Evaluation passages that leaked into a training corpus.

The test items are kept in a BM25 inverted index over runs of four words. Every passage of every
document (windows that overlap by half, so each stretch of half an item lies in one whole) is a query;
all items whose score is at least a fixed share of the item's own are retrieved. As in block-max WAND the
postings lie in blocks with their largest impacts, and only where these bounds add up to the threshold
is a block opened and scored; the bounds of all passages of a batch are added up at once, as arrays,
instead of moving one cursor after another. Each pair found is then verified word by word: the item's longest
stretch that the document holds unbroken.

Words are compared in a form that markup, case, punctuation, line ends, encodings and common recognition
errors leave alone; the remaining single-letter errors are bridged by the verification.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items per index; larger tables of items are searched index by index, each one of bounded size.
SHARD = 20_000
#: Share of an item's own score from which a passage is verified: that of half an item with half its runs spoilt is about 0.2.
THRESHOLD = 0.15
#: Words of an index term.
RUN = 4
#: Words of a query passage, and how far the next one begins.
PASSAGE, STRIDE = 72, 36
BLOCK = 16

#: Lines that are a time mark, perhaps followed by text on the same line.
_TIME = re.compile(r"[\[({<]?\d{1,2}:\d\d(?::\d\d)?(?:[.,:;]\d{1,3})?[\])}>]?")
#: Markup, sound descriptions and music by the character they begin with.
_SPANS = [(c, re.compile(p)) for c, p in (("<", r"<[^<>\n]{0,80}>"), ("{", r"\{[^{}\n]{0,80}\}"), ("[", r"\[[^\[\]]{0,80}\]"), ("(", r"\([^()]{0,80}\)"), ("♪", r"♪[^♪\n]*♪?"), ("♫", r"♫[^♫\n]*♫?"), ("â™ª", r"â™ª[^\nâ]*(?:â™ª)?"), ("*", r"\*[ \t][^*\n]{1,60}[ \t]\*"), ("&", r"&(?:[a-z]{2,8}|#\d{1,6});"))]
_LABEL = re.compile(r"[ \t]*(?:-[ \t]*|>>[ \t]*)?[^\W\d_a-z][^\n:a-z]{1,24}:[ \t]+")
#: Shapes that recognition takes for one another (fixed values), and lower case.
_LOOKS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ1l|05cbq8\n\t\r\f\v", b"ahedefghijkimnopgrstuvwxyziiiosehgh     ")
_DROPPED = bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c) in "| \n\t\r\f\v"))


def words(text: str) -> list[bytes]:
    """The comparable words of a text. Letters outside a-z are dropped, as no wrong encoding keeps them."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = []
    for line in text.split("\n"):
        if "-->" in line or line.isdigit():
            continue
        if ":" in line:
            line = _TIME.sub(" ", line)
            found = _LABEL.match(line)
            if found:
                line = line[found.end() :]
        lines.append(line)
    text = "\n".join(lines)
    for mark, pattern in _SPANS:
        if mark in text:
            text = pattern.sub(" ", text)
    raw = text.encode("ascii", "ignore").translate(_LOOKS, _DROPPED)
    return raw.replace(b"rn", b"m").replace(b"vv", b"w").split()


def _near(a: bytes, b: bytes) -> bool:
    """Whether two words differ by no more than one error, by two from eight letters on."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    most = 1 if max(la, lb) < 8 else 2
    if abs(la - lb) > most or min(la, lb) == 0 or max(la, lb) == 1:
        return False
    if la == lb and sum(x != y for x, y in zip(a, b)) <= most:
        return True
    if la == lb and any(a[:i] == b[:i] and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :] for i in range(la - 1)):
        return True
    row = list(range(lb + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[lb] <= most


def _extend(item: list[bytes], doc: list[bytes], i: int, j: int, step: int) -> int:
    """How far the item goes on matching from ``item[i]``/``doc[j]`` in one direction; words matched."""
    n, m, done = len(item), len(doc), 0
    inside = lambda p, q: 0 <= p < n and 0 <= q < m
    glue = (lambda x, y: x + y) if step > 0 else (lambda x, y: y + x)
    while inside(i, j):
        if _near(item[i], doc[j]):
            i, j, done = i + step, j + step, done + 1
        elif inside(i + step, j) and len(doc[j]) > 3 and _near(glue(item[i], item[i + step]), doc[j]):
            i, j, done = i + 2 * step, j + step, done + 2  # two words run together
        elif inside(i, j + step) and len(item[i]) > 3 and _near(item[i], glue(doc[j], doc[j + step])):
            i, j, done = i + step, j + 2 * step, done + 1  # one word torn apart
        elif inside(i, j + step) and doc[j].isdigit() and _near(item[i], doc[j + step]):
            j += step  # a cue number within a line
        else:
            break
    return done


class ItemIndex:
    """BM25 impacts of the items' runs of words, in blocks of items with the blocks' maxima."""

    def __init__(self, items: list[tuple[int, str]], k1: float = 1.2, b: float = 0.75) -> None:
        self.items = [(i, w) for i, w in sorted((i, words(t)) for i, t in items if i is not None and t) if w]
        self.run = max(1, min([RUN, *(len(w) for _, w in self.items)]))
        self.vocab = {w: k for k, w in enumerate(sorted({x for _, w in self.items for x in w}), 1)}
        n = len(self.items)
        grams = [Counter(self._codes(np.array([self.vocab[x] for x in w], np.uint64))[0].tolist()) for _, w in self.items]
        mean = sum(c.total() for c in grams) / max(1, n)
        df = Counter(g for c in grams for g in c)
        self.codes = np.array(sorted(df), np.uint64)
        term = {g: t for t, g in enumerate(sorted(df))}
        rows = []
        for k, c in enumerate(grams):
            weight = {g: math.log(1 + (n - df[g] + 0.5) / (df[g] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * c.total() / mean)) for g, f in c.items()}
            own = sum(weight.values())
            rows += [(term[g], k, v / own) for g, v in weight.items()]
        rows.sort()
        self.first = np.searchsorted([r[0] for r in rows], np.arange(len(df) + 1))
        self.docs, self.impacts = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
        blocks: dict[tuple[int, int], float] = {}
        for t, k, v in rows:
            blocks[t, k // BLOCK] = max(v, blocks.get((t, k // BLOCK), 0.0))
        self.block_first = np.searchsorted([t for t, _ in blocks], np.arange(len(df) + 1))
        self.block_ids, self.block_most = np.array([x for _, x in blocks], np.int64), np.array([*blocks.values()])
        self.places = [defaultdict(list) for _ in self.items]
        for at, (_, w) in zip(self.places, self.items):
            for i in range(len(w) - 1):
                at[w[i], w[i + 1]].append(i)

    def _codes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A code for each run of word ids, and whether all its words are known."""
        m = max(0, len(ids) - self.run + 1)
        code, known = np.zeros(m, np.uint64), np.ones(m, bool)
        for x in range(self.run):
            part = ids[x : x + m]
            code = code * np.uint64(0x9E3779B97F4A7C15) + part  # wraps; equal codes of other runs cost a verification only
            known &= part > 0
        return code, known

    @staticmethod
    def _expand(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each term its rows in a list of lists: positions of the terms, and of the rows."""
        sizes = first[terms + 1] - first[terms]
        owner = np.repeat(np.arange(len(terms)), sizes)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[terms][owner]

    def search(self, passages: np.ndarray, terms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """``(passage, item)`` of all scores that reach the threshold, from distinct (passage, term) pairs."""
        n, nb = len(self.items), len(self.items) // BLOCK + 1
        owner, at = self._expand(self.block_first, terms)
        key, where = np.unique(passages[owner] * nb + self.block_ids[at], return_inverse=True)
        bound = np.bincount(where, self.block_most[at], len(key))
        opened = key[bound >= threshold - 1e-9]
        if not len(opened):
            return opened, opened
        some = np.isin(passages, np.unique(opened // nb))
        passages, terms = passages[some], terms[some]
        owner, at = self._expand(self.first, terms)
        inside = np.isin(passages[owner] * nb + self.docs[at] // BLOCK, opened)
        owner, at = owner[inside], at[inside]
        key, where = np.unique(passages[owner] * n + self.docs[at], return_inverse=True)
        found = key[np.bincount(where, self.impacts[at], len(key)) >= threshold - 1e-9]
        return found // n, found % n

    def stretch(self, k: int, doc: list[bytes], lo: int, hi: int) -> int:
        """Words of the item's longest stretch that ``doc`` holds unbroken, begun from a pair in ``lo..hi``."""
        item, places, best, seen = self.items[k][1], self.places[k], 0, set()
        if len(item) == 1:
            return int(item[0] in doc[lo:hi])
        for j in range(lo, min(hi, len(doc) - 1)):
            for i in places.get((doc[j], doc[j + 1]), ()):
                if (i, j) not in seen:
                    left = _extend(item, doc, i - 1, j - 1, -1)
                    right = _extend(item, doc, i, j, 1)
                    seen.update((i + x, j + x) for x in range(right))
                    best = max(best, left + right)
        return best

    def leaks(self, texts: list[str | None], threshold: float = THRESHOLD, share: float = 0.5) -> list[tuple[int, int]]:
        """``(text's place, item id)`` of the items that a text holds wholly or by ``share`` of their words in one stretch."""
        docs = [words(t) if t else [] for t in texts]
        sizes = np.array([len(d) + self.run for d in docs], np.int64)  # a gap keeps runs within their text
        get, gap = self.vocab.get, [b""] * self.run
        ids = np.fromiter((get(w, 0) for d in docs for w in (*d, *gap)), np.uint64, int(sizes.sum()))
        code, known = self._codes(ids)
        if not self.items or not len(code):
            return []
        term = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = np.flatnonzero(known & (self.codes[term] == code))
        starts = np.cumsum(sizes) - sizes
        doc = np.searchsorted(starts, hit, "right") - 1
        first = (hit - starts[doc]) // STRIDE
        most = int(sizes.max()) // STRIDE + 2
        # each run lies in the passage that begins at or before it, and in the one before that
        key = np.concatenate((doc * most + first, (doc * most + first - 1)[first > 0]))
        pairs = np.unique(key * len(self.codes) + np.concatenate((term[hit], term[hit][first > 0])))
        out = set()
        for at, k in zip(*(x.tolist() for x in self.search(pairs // len(self.codes), pairs % len(self.codes), threshold))):
            d, lo = at // most, at % most * STRIDE
            if (d, self.items[k][0]) not in out and self.stretch(k, docs[d], lo, lo + PASSAGE) >= share * len(self.items[k][1]):
                out.add((d, self.items[k][0]))
        return sorted(out)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", share: float = 0.5, threshold: float = THRESHOLD) -> DataFrame:
    """``key, item`` of every document that holds an item's passage, or ``share`` of its words unbroken.

    Items are read in shards of at most about ``SHARD`` rows, so the index that goes to the executors has a
    bound; documents are never moved. NULL, empty and blank texts and passages are in no pair. Repeated rows
    give one pair. Items without a single word are found nowhere.
    """
    source = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("__text"))
    kinds = source.select(key).schema[0].dataType.simpleString(), items.select(item).schema[0].dataType.simpleString()
    shards = max(1, math.ceil(items.count() / SHARD))
    out = None
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64(item), F.lit(shards)) == shard) if shards > 1 else items
        rows = [(r[0], r[1]) for r in part.where(F.col(passage).isNotNull()).select(item, passage).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in batches:
                index = index or ItemIndex(shared.value)
                ids, texts, keys, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []
                for lo in range(0, len(texts), 1000):
                    for k, i in index.leaks(texts[lo : lo + 1000], threshold, share):
                        keys.append(ids[lo + k])
                        found.append(i)
                kind = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(found, kind)], names=[key, item])

        some = source.mapInArrow(run, f"`{key}` {kinds[0]}, `{item}` {kinds[1]}")
        out = some if out is None else out.unionByName(some)
    return out.distinct()
