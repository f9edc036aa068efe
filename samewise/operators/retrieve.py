"""The best records of an index for each query, exactly, by inverted lists that are read from stored blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.session import cut, shared_path

#: Digits to which similarities are rounded before they are compared, so that the order of sums is no tie rule.
DIGITS = 6
#: Records of a block of the index, and queries that are held at once; both bound a task's memory.
BLOCK, AT_ONCE = 1 << 17, 1 << 16
#: Tasks for each core; those of one part follow each other.
TASKS = 4
#: What a sum may change by when it is rounded, and more.
SLACK = 2e-6
#: Width of the groups of records whose maxima bound the k-th best score from below.
GROUP = 64
#: Scores that are held at once, and products that are added up at once; few enough to stay in a processor's cache.
SCORES, ITEMS = 1 << 18, 1 << 18
#: Shares of a block's records: a list is long if it has more than that, whichever suits a query.
LEVELS = (0.003, 0.02, 0.04, 0.06)
#: Guess of the k-th best score before any is known, and the share of it that long lists may usually add if they are to be looked up only.
USUAL, SHARE = 0.4, 0.3
#: What giving a record its whole score costs, in items of lists; sums are sorted by record where they are fewer than 1 / ``FEW`` of the records.
DEAR, FEW = 15, 16
#: Queries that are searched at once.
QUERIES = 128
#: Records of a block from which on it is graded.
GRADED = 1 << 14


class Block:
    """Postings of some records by term. Records are in the order of their ids."""

    def __init__(self, owner: np.ndarray, code: np.ndarray, w: np.ndarray, n: int, terms: int) -> None:
        self.n = n
        order = np.argsort(code, kind="stable")
        self.ids, self.weights = owner[order].astype(np.intp), w[order]
        self.lists = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=terms))])


def search(block: Block, owner: np.ndarray, code: np.ndarray, w: np.ndarray, k: int, threshold: float, floor: np.ndarray, unit: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, record, score)`` of the ``k`` best records of the block for each query, with scores above ``threshold``.

    ``owner`` ascends. ``floor`` has what a query's k-th best score is at least, and is raised. Some queries at a time have a row of scores each:
    the lists of their terms are added up in one pass, and the k-th largest of the maxima of groups of records says which scores are looked at.
    Scores of vectors of length 1 (``unit``) are rounded, others are whole numbers. Of equal scores the smaller record goes first.
    """
    there = block.lists[code + 1] > block.lists[code]
    owner, code, w = owner[there], code[there], w[there]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]) if len(owner) else np.zeros(1, int)
    queries = owner[edge[:-1]]
    edge, begin, end, single = edge.tolist(), block.lists[code].tolist(), block.lists[code + 1].tolist(), w.tolist()
    ids, weights, width = block.ids, block.weights, -(-block.n // GROUP) * GROUP
    many, room = max(1, SCORES // max(1, width)), max(ITEMS, block.n)
    at, product = np.empty(room, np.intp), np.empty(room)
    out_q, out_s, out_v = [], [], []
    for lo in range(0, len(queries), many):
        own = queries[lo : lo + many]
        acc, used = None, 0
        for r in range(len(own)):
            for j in range(edge[lo + r], edge[lo + r + 1]):
                x, y = begin[j], end[j]
                to = used + y - x
                if to > room:
                    acc = _added(acc, at[:used], product[:used], len(own) * width)
                    used, to = 0, y - x
                np.add(ids[x:y], r * width, out=at[used:to])
                np.multiply(weights[x:y], single[j], out=product[used:to])
                used = to
        acc = _added(acc, at[:used], product[:used], len(own) * width).reshape(len(own), width)
        tops, need = acc.reshape(len(own), GROUP, -1).max(axis=1), floor[own]
        if (n := tops.shape[1]) >= k:
            need = np.maximum(need, np.partition(tops, n - k, axis=1)[:, n - k])
        hit = np.flatnonzero(acc > np.maximum(need - SLACK, 0)[:, None])
        score = np.round(acc.reshape(-1)[hit], DIGITS) if unit else acc.reshape(-1)[hit]
        hit, score = hit[score > threshold], score[score > threshold]
        cuts = np.searchsorted(hit, np.arange(len(own) + 1) * width).tolist()
        for r, q in enumerate(own.tolist()):
            rows, v = hit[cuts[r] : cuts[r + 1]] - r * width, score[cuts[r] : cuts[r + 1]]
            if len(v) > k:
                kth = np.partition(v, len(v) - k)[len(v) - k]
                over, same = np.flatnonzero(v > kth), np.flatnonzero(v == kth)
                best = np.concatenate([over, same[: k - len(over)]])
                rows, v = rows[best], v[best]
            if len(v) == k:
                floor[q] = max(floor[q], v.min())
            out_q.append(np.full(len(v), q))
            out_s.append(rows)
            out_v.append(v)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(out_q, np.intp), cat(out_s, np.intp), cat(out_v, float)


def _added(acc: np.ndarray | None, at: np.ndarray, product: np.ndarray, size: int) -> np.ndarray:
    """``acc`` and the products at their places."""
    sums = np.bincount(at, product, size)
    return sums if acc is None else acc + sums


class Graded(Block):
    """A block with the postings of its long lists by record, for vectors of length 1. ``owner`` ascends.

    ``rest`` has, for each of ``LEVELS``, the length of each record's vector when only terms with longer lists than that are left in it:
    what such terms can add to a score is at most that times the same length of the query.
    """

    def __init__(self, owner: np.ndarray, code: np.ndarray, w: np.ndarray, n: int, terms: int) -> None:
        super().__init__(owner, code, w, n, terms)
        self.most = (np.array(LEVELS) * n).astype(int)
        sizes, square = np.diff(self.lists), w * w
        size = sizes[code]
        self.rest = np.array([np.sqrt(np.bincount(owner, np.where(size > m, square, 0.0), n)) for m in self.most])
        self.usual = [float(np.median(r)) if n else 0.0 for r in self.rest]
        self.order = [np.argsort(-r, kind="stable") for r in self.rest]
        self.falling = [-r[o] for r, o in zip(self.rest, self.order)]
        long = sizes > self.most[0]
        self.column, self.columns = np.cumsum(long) - 1, int(long.sum())
        self.tops: dict[tuple[int, int], np.ndarray] = {}
        keep = np.flatnonzero(long[code])
        keep = keep[np.lexsort((-size[keep], owner[keep]))]  # a record's longest lists first
        self.of_record = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=n))])
        self.longer = np.array([np.bincount(owner[size > m], minlength=n) for m in self.most])
        self.long_column, self.long_weight = self.column[code[keep]], w[keep]

    def top(self, term: int, k: int) -> np.ndarray:
        """Records among which the ``k`` best by one list alone are, however their scores are rounded; of equal weights the first ``k`` do."""
        if (term, k) not in self.tops:
            ids, w = (x[self.lists[term] : self.lists[term + 1]] for x in (self.ids, self.weights))
            if len(w) > k:
                high = w >= np.partition(w, len(w) - k)[len(w) - k] - 1000 * SLACK
                ids, w = ids[high], w[high]
            by = np.lexsort((ids, -w))
            self.tops[term, k] = ids[by][_ranks(w[by]) < k]
        return self.tops[term, k]


def search_graded(block: Graded, owner: np.ndarray, code: np.ndarray, w: np.ndarray, k: int, threshold: float, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as :func:`search` of vectors of length 1, for blocks of many records.

    The short lists of a query are added up; the k-th largest sum bounds the k-th best score from below, and only records that can
    reach it with what the long lists add at most are given their whole score. Where that would be dearer, all lists are added up.
    """
    size = block.lists[code + 1] - block.lists[code]
    there = size > 0
    owner, code, w, size = owner[there], code[there], w[there], size[there]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]) if len(owner) else np.zeros(1, int)
    queries, usual, out = owner[edge[:-1]], USUAL, []
    for at in range(0, len(queries), QUERIES):
        own, cut = queries[at : at + QUERIES], slice(edge[at], edge[min(at + QUERIES, len(queries))])
        q, row, v = _some(block, np.searchsorted(own, owner[cut]), code[cut], w[cut], size[cut], k, floor[own], usual)
        v = np.round(v, DIGITS)
        q, row, v = (x[v > threshold] for x in (q, row, v))
        by = np.lexsort((row, -v, q))
        q, row, v = q[by], row[by], v[by]
        rank = _ranks(q)
        last = rank == k - 1
        floor[own[q[last]]] = np.maximum(floor[own[q[last]]], v[last])
        usual = float(np.median(v[last])) if last.any() else usual
        out.append((own[q[rank < k]], row[rank < k], v[rank < k]))
    cat = lambda i, t: np.concatenate([x[i] for x in out]) if out else np.zeros(0, t)
    return cat(0, np.intp), cat(1, np.intp), cat(2, float)


def _ranks(q: np.ndarray) -> np.ndarray:
    """The place of each item within its run of equal values."""
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    return np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))


def _runs(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owners and positions of the items of runs that begin at ``first`` and have ``size`` items."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) + np.repeat(first - (np.cumsum(size) - size), size)


def _summed(key: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each."""
    if not len(key):
        return key, v
    by = np.argsort(key)
    key = key[by]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[start], np.add.reduceat(v[by], start)


def _some(block: Graded, owner: np.ndarray, code: np.ndarray, w: np.ndarray, size: np.ndarray, k: int, floor: np.ndarray, usual: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, record, score)`` of some queries, among which the ``k`` best of each are; see :func:`search_graded`."""
    n, many = block.n, len(floor)
    whole, level, left = np.bincount(owner, size, many), np.full(many, -1), np.zeros(many)
    for i in range(len(block.most))[::-1]:  # the level that leaves the most, if few records will be looked at then
        long = size > block.most[i]
        some, dear = np.sqrt(np.bincount(owner, np.where(long, w * w, 0.0), many)), np.bincount(owner, np.where(long, size, 0), many)
        use = (some > 0) & (some * block.usual[i] < SHARE * np.maximum(usual, floor)) & (dear * 4 > whole)
        level, left = np.where(use, i, level), np.where(use, some, left)
    short = size <= np.append(block.most, n)[level][owner]
    items = np.bincount(owner, np.where(short, size, 0), many)
    few = items * FEW < n
    lone = np.full(many, -1)  # the term of the only long list, if it is one that can tell scores apart
    lists_left = np.bincount(owner, ~short, many) == 1
    only = ~short & lists_left[owner] & (w * 1000 > 1)
    lone[owner[only]] = code[only]
    found = [_by_few(block, *(x[few[owner] & short] for x in (owner, code, w, size)), k, floor, np.where(few, level, -1), left, lone)]
    again = found[0][3].tolist()
    edge = np.searchsorted(owner, np.arange(many + 1)).tolist()
    sums = Sums(block)
    for q in np.flatnonzero(~few).tolist() + again:
        mine = slice(edge[q], edge[q + 1])
        use = short[mine] if q not in again else np.ones(edge[q + 1] - edge[q], bool)
        v = sums.add(code[mine][use], w[mine][use])
        need = max(float(floor[q]), sums.kth(v, k)) - SLACK
        near = None
        if level[q] >= 0 and q not in again:
            near = sums.near(v, need, float(left[q]), int(level[q]))
            if len(near) * DEAR > whole[q] - items[q]:
                v, near, level[q] = v + sums.add(code[mine][~use], w[mine][~use]), None, -1
                need = max(float(floor[q]), sums.kth(v, k)) - SLACK
        elif q in again:
            level[q] = -1
        near = np.flatnonzero(v > max(need, 0.0)) if near is None else near
        found.append((np.full(len(near), q), near, v[near]))
    q, row, v = (np.concatenate([f[i] for f in found]) for i in range(3))
    lack = np.flatnonzero(level[q] >= 0)
    if len(lack):
        asked = np.zeros((many, block.columns))
        long = ~short & (level >= 0)[owner]
        asked[owner[long], block.column[code[long]]] = w[long]
        first, size = block.of_record[row[lack]], block.longer[level[q[lack]], row[lack]]
        ends = np.append(np.arange(0, len(lack), 1 << 15), len(lack)).tolist()
        for lo, hi in zip(ends, ends[1:]):
            pair, item = _runs(first[lo:hi], size[lo:hi])
            v[lack[lo:hi]] += np.bincount(pair, block.long_weight[item] * asked[q[lack[lo:hi]][pair], block.long_column[item]], hi - lo)
    return q, row, v


def _by_few(block: Graded, owner: np.ndarray, code: np.ndarray, w: np.ndarray, size: np.ndarray, k: int, floor: np.ndarray, level: np.ndarray, left: np.ndarray, lone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Records that can be among the best, with their sums of short lists, of queries that have few items in these; and the queries that are not settled so."""
    item_of, item = _runs(block.lists[code], size)
    key, v = _summed(owner[item_of] * block.n + block.ids[item], block.weights[item] * w[item_of])
    q, row = np.divmod(key, max(1, block.n))
    many, need = np.bincount(q, minlength=len(floor)), floor.copy()
    last = (np.cumsum(many) - many)[many >= k] + k - 1  # a sum is at most 1, so one number holds query and sum
    full = np.flatnonzero(many >= k)
    need[full] = np.maximum(need[full], 4.0 * full - np.sort(4.0 * q - v)[last])
    need -= SLACK
    again, more = [], []
    for x in np.flatnonzero(level >= 0).tolist():  # records that can be by their long lists alone
        alone = block.n if need[x] <= 0 else int(np.searchsorted(block.falling[level[x]], -need[x] / left[x], "right"))
        if alone > len(at := block.top(int(lone[x]), k) if lone[x] >= 0 else block.order[level[x]]):
            more.append(x * block.n + at)
        elif alone > block.n // 64 + 64:
            again.append(x)
        elif alone:
            more.append(x * block.n + block.order[level[x]][:alone])
    settled = np.ones(len(floor), bool)
    settled[again] = False
    reach = v + np.where(level[q] >= 0, block.rest[level[q], row] * left[q], 0.0)
    keep = (reach >= need[q]) & settled[q]
    key, v = key[keep], v[keep]
    if more:
        key, v = _summed(np.concatenate([key, *more]), np.concatenate([v, np.zeros(sum(map(len, more)))]))
    q, row = np.divmod(key, max(1, block.n))
    return q, row, v, np.array(again, int)


class Sums:
    """Adds up lists of a block with a place for each record."""

    def __init__(self, block: Graded) -> None:
        self.block, self.reach = block, np.empty(block.n)

    def add(self, code: np.ndarray, w: np.ndarray) -> np.ndarray:
        begin, end = self.block.lists[code].tolist(), self.block.lists[code + 1].tolist()
        if not begin:
            return np.zeros(self.block.n)
        at = np.concatenate([self.block.ids[x:y] for x, y in zip(begin, end)])
        product = np.concatenate([self.block.weights[x:y] for x, y in zip(begin, end)])
        product *= np.repeat(w, np.subtract(end, begin))
        return np.bincount(at, product, self.block.n)

    def kth(self, v: np.ndarray, k: int) -> float:
        """What the k-th largest value is at least: the largest values of groups are those of different records."""
        if len(v) >= 64 * k:
            v = v[: len(v) // 64 * 64].reshape(64, -1).max(axis=0)
        return float(np.partition(v, len(v) - k)[len(v) - k]) if len(v) >= k else 0.0

    def near(self, v: np.ndarray, need: float, left: float, level: int) -> np.ndarray:
        """Records that can reach ``need``."""
        np.multiply(self.block.rest[level], left, out=self.reach)
        self.reach += v
        return np.flatnonzero(self.reach >= need)


def _counts(lists: pa.ListArray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``owner, code, tf`` of lists of hashed terms. Terms that are not among the sorted ``terms`` are dropped. The owner ascends."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    owner, term = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(zero_copy_only=False)
    if not len(terms) or not len(term):
        return np.zeros(0, np.intp), np.zeros(0, np.intp), np.zeros(0, np.intp)
    code = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
    known = terms[code] == term
    key, tf = np.unique(owner[known] * len(terms) + code[known], return_counts=True)
    owner, code = np.divmod(key, len(terms))
    return owner, code, tf


def _weights(owner: np.ndarray, code: np.ndarray, tf: np.ndarray, idf: np.ndarray | None) -> np.ndarray:
    """``(1 + ln tf) * idf`` over the vector's length, or ``tf`` if there is no ``idf``."""
    if idf is None:
        return tf.astype(float)
    w = (1.0 + np.log(tf)) * idf[code]
    return w / np.sqrt(np.bincount(owner, w * w))[owner] if len(owner) else w


class Equals:
    """Vectors that are equal are one; the distinct ones are in the order of their first. They are known by 128 bits of hash."""

    def __init__(self, owner: np.ndarray, code: np.ndarray, tf: np.ndarray, n: int) -> None:
        x = (code.astype(np.uint64) << np.uint64(20)) ^ tf.astype(np.uint64)
        at = np.searchsorted(owner, np.arange(n + 1))
        marks = []
        for a, b in ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB)):
            h = (x + np.uint64(a)) * np.uint64(b)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(a)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h ^ (h >> np.uint64(32)))])
            marks.append(total[at[1:]] - total[at[:-1]])
        by = np.lexsort(marks)
        new = np.ones(n, bool)
        new[1:] = (marks[0][by][1:] != marks[0][by][:-1]) | (marks[1][by][1:] != marks[1][by][:-1])
        start = np.flatnonzero(new)
        rank = np.argsort(np.argsort(by[start]))
        of = np.empty(n, np.intp)
        of[by] = np.repeat(rank, np.diff(np.append(start, n)))
        self.count, self.same = len(start), np.argsort(of, kind="stable")
        self.first = np.searchsorted(of[self.same], np.arange(self.count + 1))
        kept = np.isin(owner, by[start])
        self.owner, self.code, self.tf = of[owner[kept]], code[kept], tf[kept]

    def members(self, which: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``which`` and the vectors that are equal to the one there, the first ``most`` of each in their order."""
        size = self.first[which + 1] - self.first[which]
        at, item = _runs(self.first[which], size if most is None else np.minimum(size, most))
        return at, self.same[item]


def _read_terms(root: str, home: str) -> dict[str, tuple[np.ndarray, np.ndarray | None]]:
    """Sorted terms of each part of a home, and their idf if there is one."""
    if _kept.get("terms", ("", None))[0] != f"{root}/{home}":
        words = _reader(root)(f"home={home}")
        out = {}
        for part, table in (_by_part(words) if words is not None and len(words) else {}).items():
            order = np.argsort(term := table["term"].to_numpy())
            out[part] = term[order], table["idf"].to_numpy()[order] if "idf" in table.column_names else None
        _kept["terms"] = f"{root}/{home}", out
    return _kept["terms"][1]


def _read_block(root: str, home: str, i: int, known: dict[str, tuple[np.ndarray, np.ndarray | None]]) -> dict[str, tuple[pa.Array, Equals, Block]]:
    """The ids, equal vectors and postings of each part of a stored block. A worker keeps the last one for its next task."""
    if _kept.get("block", ("", None))[0] != f"{root}/{home}/{i}":
        _kept.pop("block", None)
        table, out = _reader(root)(f"home={home}/block={i}"), {}
        for part, side in (_by_part(table) if table is not None else {}).items():
            if part in known:
                terms, idf = known[part]
                side = side.take(pc.sort_indices(side["id"]))
                one = Equals(*_counts(_lists(side), terms), len(side))
                graded = idf is not None and one.count >= GRADED
                out[part] = side["id"].combine_chunks(), one, (Graded if graded else Block)(one.owner, one.code, _weights(one.owner, one.code, one.tf, idf), one.count, len(terms))
        _kept["block"] = f"{root}/{home}/{i}", out
    return _kept["block"][1]


#: The terms and the block that a worker used last, by where they are stored.
_kept: dict[str, tuple[str, dict]] = {}


def _reader(root: str) -> Callable[[str], pa.Table | None]:
    """Reads a folder below ``root``; None if there is none."""
    fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)

    def read(folder: str) -> pa.Table | None:
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}", allow_not_found=True)) if f.path.endswith(".parquet")]
        tables = [pq.ParquetFile(fs.open_input_file(f)).read() for f in sorted(files)]
        return pa.concat_tables(tables) if tables else None

    return read


def _by_part(table: pa.Table) -> dict[str, pa.Table]:
    names = pc.unique(table["part"]).to_pylist()
    return {names[0]: table} if len(names) == 1 else {p: table.filter(pc.equal(table["part"], p)) for p in names}


def _lists(table: pa.Table) -> pa.ListArray:
    return table["tokens"].combine_chunks() if table["tokens"].num_chunks != 1 else table["tokens"].chunk(0)


def best(index: DataFrame, queries: DataFrame, text: str | list[str], tokens: Callable[..., Column], k: int, threshold: float, vocabulary: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """``part, q, s, sim`` of the ``k`` best index records of each query within its part, with a score above ``threshold``.

    ``tokens`` makes the array of terms from the columns ``text``. With a ``vocabulary`` (of ``part, id, term`` and ``part, n``, it gives
    ``part, term, idf``) the score is the cosine of TF-IDF vectors, else the number of shared terms. Only texts are shuffled. The hashed terms of
    the index are stored once in the shared folder, in blocks; a task holds one block and some queries at a time and meets each
    block of its queries' parts, so its results are final and its memory has a bound. Records of one id are one record.

    Queries of the same known terms go to the same task and are searched once, and equal records of a block are one
    until the end: among the ``k`` best records there are only such that equal one of the ``k`` best distinct ones, by score
    and first id. Tasks are dealt out to the parts by their work, so few parts' blocks are built in a task.
    """
    spark = index.sparkSession
    cores = spark.sparkContext.defaultParallelism
    many = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = [text] if isinstance(text, str) else text
    both = index.select("part", F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(queries.select("part", F.lit(0).alias("n"), F.lit(1).alias("m")))
    sizes = cut(both.groupBy("part").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n > 0"), "sizes")
    work = F.col("m") * (F.col("n") + 1000)
    total, asked, whole = sizes.agg(F.sum("n"), F.sum("m"), F.sum(work.cast("double"))).first()
    total, tasks_n = total or 0, max(TASKS * cores, -(-(asked or 0) // AT_ONCE))
    # A large part has blocks of its own, small ones share blocks, so there are not many files however many parts there are.
    few = F.lit(int(total // BLOCK + 1))
    width = F.ceil(work * tasks_n / float(whole or 1)).cast("int")
    placed = sizes.select("part", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.when(F.col("n") > BLOCK // 4, F.xxhash64("part")).otherwise(F.pmod(F.xxhash64("part"), few)).alias("home"), width.alias("width"), (F.sum(width).over(Window.orderBy("part")) - width).alias("start"))
    placed = cut(placed, "placed")

    def terms(d: DataFrame) -> DataFrame:
        """One row for each id; its texts are one record."""
        one = d.select("part", F.col("entity_id").alias("id"), F.struct(*columns).alias("text")).repartition(many, "part", "id").groupBy("part", "id").agg(F.collect_list("text").alias("texts"))
        hashed = F.flatten(F.transform("texts", lambda t: F.transform(tokens(*[t[c] for c in columns]), lambda x: F.xxhash64(x))))
        return one.join(placed, "part").select("part", "id", "home", "blocks", "start", "width", hashed.alias("tokens"))

    stored = terms(index).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks", "start", "width")
    kept = shared_path(spark, "postings")
    stored.repartition("home", "block").write.option("compression", "zstd").partitionBy("home", "block").parquet(kept)
    vocab = None
    if total:
        posted = spark.read.schema(stored.schema).parquet(kept).select("part", "id", F.explode(F.array_distinct("tokens")).alias("term"))
        found = vocabulary(posted, sizes.drop("m")) if vocabulary else posted.select("part", "term").distinct()
        vocab = shared_path(spark, "terms")
        found.join(placed.select("part", "home"), "part").repartition("home").write.option("compression", "zstd").partitionBy("home").parquet(vocab)
    schema = pa.schema([("part", pa.string()), ("q", pa.string()), ("s", pa.string()), ("sim", pa.float64())])
    cosine = vocabulary is not None

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The known terms of each query as sorted numbers; a query without any has no result."""
        for rows in map(pa.Table.from_batches, ([b] for b in batches)):
            for home in pc.unique(rows["home"]).to_pylist():
                known = _read_terms(vocab, home)
                for part, table in _by_part(rows.filter(pc.equal(rows["home"], home))).items():
                    if part not in known:
                        continue
                    owner, code, tf = _counts(_lists(table), known[part][0])
                    ends = np.cumsum(np.bincount(owner, tf, len(table))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.array(np.repeat(code, tf).astype(np.int32)))
                    out = pa.table([table["part"], table["id"], table["home"], table["blocks"], table["start"], table["width"], lists], names=["part", "id", "home", "blocks", "start", "width", "codes"])
                    yield from out.filter(pc.greater(pc.list_value_length(out["codes"]), 0)).to_batches()

    def matched(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for home in pc.unique(rows["home"]).to_pylist():
            mine, known, found = _by_part(rows.filter(pc.equal(rows["home"], home))), _read_terms(vocab, home), {}
            for part, table in mine.items():
                terms, idf = known[part]
                one = Equals(*_counts(table["codes"].combine_chunks(), np.arange(len(terms))), len(table))
                own = one.owner, one.code, _weights(one.owner, one.code, one.tf, idf)
                found[part] = table, one, own, np.full(one.count, float(threshold)), []
            for i in range(max(t["blocks"][0].as_py() for t in mine.values())):
                block = _read_block(kept, home, i, known)
                for part in found.keys() & block.keys():
                    (_, _, own, floor, out), (ids, same, posted) = found[part], block[part]
                    if isinstance(posted, Graded):
                        q, s, v = search_graded(posted, *own, k, threshold, floor)
                    else:
                        q, s, v = search(posted, *own, k, threshold, floor, cosine)
                    at, s = same.members(s, k)
                    by = np.lexsort((s, -v[at], q[at]))
                    by = by[_ranks(q[at][by]) < k]
                    out.append(pa.table({"n": q[at][by], "s": ids.take(pa.array(s[by], pa.int64())), "sim": v[at][by]}))
            for part, (table, one, _, _, out) in found.items():
                if not out or not len(both := pa.concat_tables(out)):
                    continue
                if len(out) > 1:
                    both = both.take(pc.sort_indices(both, [("n", "ascending"), ("sim", "descending"), ("s", "ascending")]))
                    both = both.filter(pa.array(_ranks(both["n"].to_numpy()) < k))
                first = np.searchsorted(both["n"].to_numpy(), np.arange(one.count + 1))
                for lo in range(0, len(one.same), 1 << 14):
                    q = one.same[lo : lo + (1 << 14)]
                    of = np.searchsorted(one.first, np.arange(lo, lo + len(q)), "right") - 1
                    at, row = _runs(first[of], first[of + 1] - first[of])
                    done = pa.table([pa.array([part] * len(row), pa.string()), table["id"].take(pa.array(q[at])), both["s"].take(pa.array(row)), both["sim"].take(pa.array(row))], schema=schema)
                    yield from done.to_batches(max_chunksize=50_000)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= AT_ONCE:
                yield from matched(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from matched(pa.Table.from_batches(held))

    asking = terms(queries)
    if not vocab:
        return asking.select("part", F.col("id").alias("q"), F.col("id").alias("s"), F.lit(0.0).alias("sim")).limit(0)
    known = asking.mapInArrow(coded, "part string, id string, home bigint, blocks int, start bigint, width int, codes array<int>")
    task = F.pmod(F.col("start") + F.pmod(F.xxhash64("part", "codes"), F.col("width")), F.lit(tasks_n)).cast("int")
    return known.repartitionById(tasks_n, task).mapInArrow(tasks, "part string, q string, s string, sim double")
