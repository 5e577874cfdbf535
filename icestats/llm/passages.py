"""Substring deduplication with compact windows.

Under a random hash of its tokens (shingles of five words), all subsequences of a text that
have the same least token form a compact window: the Cartesian tree over the hashes gives
the window of each token. Windows wide enough for a passage are grouped by their least
token; members of a group may hold the same passage around it. Members with equal tokens
around it are told by a hash of these: the first stands for all, the others repeat it.
Only the different surroundings of a group are fetched; their token intervals are joined
and verified: a passage counts as repeated if an earlier document holds one of at least
that length with Jaccard similarity 0.8 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icestats.llm.base import query
from icestats.llm.common import SHINGLE, grouped, mix64, shingles, slices, store, table, words_of

WORDS = 50
SIMILAR = 0.8
HASHES = 4
#: Members of a group compared at once; larger groups go in pairs of blocks.
LEAF = 32_768
#: Text whose windows are made at once.
WINDOW_BYTES = 1_000_000


def wide_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Places that are least (leftmost at a tie) in some `width` consecutive values."""
    at, least, size = np.arange(len(values)), values, 1

    def lesser(shift: int) -> tuple[np.ndarray, np.ndarray]:
        end = len(at) - shift
        return np.where(least[:end] <= least[shift:], at[:end], at[shift:]), np.minimum(least[:end], least[shift:])

    while size * 2 <= width:
        (at, least), size = lesser(size), size * 2
    if width > size:
        at, least = lesser(width - size)
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, place, right) of the windows of at least `width` tokens.

    A token with so wide a window has only such tokens as its next smaller neighbours, so the
    Cartesian tree needs to be built over these alone.
    """
    n = len(values)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    at = wide_minima(values, width)
    key, places = values[at].tolist(), at.tolist()
    left, right, stack = [0] * len(places), [n - 1] * len(places), []
    for k, value in enumerate(key):
        while stack and key[stack[-1]] > value:
            right[stack.pop()] = places[k] - 1
        left[k] = places[stack[-1]] + 1 if stack else 0
        stack.append(k)
    return np.array(left), at, np.array(right)


_BASE = 0x9FB21C651E98DF25
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


class _Stretches:
    """Hashes of any stretch of a text's tokens, from sums of tokens times powers of an odd base."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
            self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BACK)]))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * up[:n])])

    def hash(self, first: np.ndarray, end: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Of the tokens [first, end), with the numbers `shape`."""
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[first]) * self.back[first] + mix64(shape.astype(np.uint64), 90), 91)


def _pack(place: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int) -> np.ndarray:
    """Place and the window's reach to both sides, as far as a passage can."""
    return (place << 20) | (np.minimum(place - left, reach) << 10) | np.minimum(right - place, reach)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 20, packed >> 10 & 1023, packed & 1023


MET = ("h", "around", "id", "key", "place", "exact", "source", "source_key")


def _first_of_class(ids: np.ndarray, *parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, place in it of each row's class' first): rows by class, then id rank."""
    order = np.lexsort((ids, *reversed(parts)))
    change = np.zeros(len(order), dtype=bool)
    change[:1] = True
    for p in parts:
        change[1:] |= p[order][1:] != p[order][:-1]
    return order, np.maximum.accumulate(np.where(change, np.arange(len(order)), 0))


def windows(docs: DataFrame, words: int = WORDS, width: int = SHINGLE, hashes: int = HASHES) -> DataFrame:
    """All compact windows of docs (id, key, text) that can hold a passage.

    `h` is the least token, `around` a hash of the tokens around it, `exact` marks the first hash
    function, which finds every exact passage. Within a slice of texts the first document
    stands for all with equal surroundings; the others leave with it as their `source`.
    """
    tokens = words - width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=WINDOW_BYTES):
                keys = part.column(1).to_numpy()
                lists = shingles([words_of(t) for t in part.column(2).to_pylist()], width)
                long = [k for k, own in enumerate(lists) if len(own) >= tokens]
                if not long:
                    continue
                # all texts in a row, each behind a mark below every token, which no window crosses
                mark = np.zeros(1, np.uint64)
                whole = np.concatenate([x for k in long for x in (mark, lists[k])] + [mark])
                starts = np.cumsum([0, *(len(lists[k]) + 1 for k in long)])
                stretch = _Stretches(whole)
                h, around, who, place, exact = [], [], [], [], []
                for f in range(hashes):
                    values = np.maximum(mix64(whole, 50 + f), np.uint64(1))
                    values[starts] = 0
                    left, at, right = compact_windows(values, tokens)
                    left, at, right = (x[values[at] > 0] for x in (left, at, right))
                    text = np.searchsorted(starts, at, side="right") - 1
                    packed = _pack(at - starts[text] - 1, left - starts[text] - 1, right - starts[text] - 1, tokens - 1)
                    a, b = packed >> 10 & 1023, packed & 1023
                    h.append(values[at])
                    around.append(stretch.hash(at - a, at + b + 1, packed & 0xFFFFF))
                    place.append(packed)
                    who.append(np.array(long)[text])
                    exact.append(np.full(len(at), f == 0))
                h, around, who, place, exact = (np.concatenate(x) for x in (h, around, who, place, exact))
                order, first = _first_of_class(_rank(part.column(0))[who], h, around)
                h, around, who, place, exact = (x[order] for x in (h, around, who, place, exact))
                key = keys[who]
                copy = key != key[first]
                keep = ~copy | exact
                # a decided row goes anywhere: its group is its own
                spread = np.where(copy, mix64(key.astype(np.uint64) ^ place.astype(np.uint64), 93), h)
                source = np.where(copy, who[first], -1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(spread[keep].view(np.int64)), pa.array(around[keep].view(np.int64)), part.column(0).take(pa.array(who[keep])), pa.array(key[keep]),
                    pa.array(place[keep]), pa.array(exact[keep]), part.column(0).take(pa.array(source[keep], mask=source[keep] < 0)), pa.array(key[first][keep], mask=~copy[keep]),
                ], list(MET))

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "key", "text").mapInArrow(run, f"h long, around long, id {kind}, key long, place long, exact boolean, source {kind}, source_key long")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by (h, around, id): copies of a surrounding repeat its first document; the
    first ones of a group that two documents share go on. A window that no other document
    has ends here. What is held between batches is one document's rows, or one row.
    """
    carry, written, shared = None, False, False
    for batch in batches:
        decided = batch.column("source_key").is_valid()
        if decided.true_count:
            yield batch.filter(decided)
            batch = batch.filter(pa.compute.invert(decided))
        if not batch.num_rows:
            continue
        if carry is not None:
            batch = pa.concat_batches([carry, batch])
        h, around, key, place = (batch.column(c).to_numpy() for c in ("h", "around", "key", "place"))
        exact = batch.column("exact").to_numpy(zero_copy_only=False)
        n = len(h)
        rows = np.arange(n)
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_class = new_h | np.concatenate([[True], around[1:] != around[:-1]])
        starts = np.flatnonzero(new_h)
        group = np.cumsum(new_h) - 1
        other = key != key[starts][group]
        two = np.logical_or.reduceat(other, starts)
        classes = np.add.reduceat(new_class.astype(np.int64), starts)
        two[0] |= carry is not None and shared
        classes[-1] = 2  # more may come
        if carry is not None and shared:
            classes[0] = 2
        first = np.maximum.accumulate(np.where(new_class, rows, 0))
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (place[1:] == place[:-1]) & ~new_class[1:]])
        same = key == key[first]
        go_on = two[group] & same & ~again & (classes[group] > 1)
        copies = two[group] & ~same & exact & ~again
        if written:
            go_on[0] = False
        for take, source in ((go_on, None), (copies, first)):
            at = np.flatnonzero(take)
            if len(at):
                out = batch.take(pa.array(at))
                if source is not None:
                    whose = pa.array(source[at])
                    out = pa.RecordBatch.from_arrays([*out.columns[:6], batch.column("id").take(whose), batch.column("key").take(whose)], list(MET))
                yield out
        shared = bool(two[-1])
        written = shared
        carry = batch.slice(int(first[-1]), 1) if shared else batch.slice(int(starts[-1]))


def _regions(width: int, tokens: int):
    """Tokens around each wanted place of a document, aligned at the place (0: beyond its window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = np.arange(1 - tokens, tokens)
        for batch in batches:
            for part in slices(batch):
                lists = shingles([words_of(t) for t in part.column("text").to_pylist()], width)
                sizes = np.array([len(own) for own in lists])
                starts = np.cumsum(sizes) - sizes
                short = np.maximum((np.concatenate(lists) >> np.uint64(32)).astype(np.uint32), 1)
                wanted = part.column("wanted")
                h, n, place = (wanted.flatten().field(c).to_numpy() for c in ("h", "n", "place"))
                k = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(wanted).to_numpy())
                fits = (place >> 20) + (place & 1023) < sizes[k]  # others are places of another document whose key is equal
                h, n, k, place = h[fits], n[fits], k[fits], place[fits]
                for rows in (slice(start, start + 20000) for start in range(0, len(k), 20000)):
                    at, a, b = (x[:, None] for x in _unpack(place[rows]))
                    within = (around >= -a) & (around <= b)
                    region = short[np.where(within, starts[k[rows]][:, None] + at + around, 0)]
                    region[~within] = 0
                    ends = np.arange(len(region) + 1, dtype=np.int32) * region[:1].nbytes
                    raw = pa.Array.from_buffers(pa.binary(), len(region), [None, pa.py_buffer(ends), pa.py_buffer(region)])
                    who = pa.array(k[rows])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[rows]), pa.array(n[rows]), part.column("id").take(who), part.column("key").take(who), pa.array(at[:, 0]), raw],
                        ["h", "n", "id", "key", "place", "region"],
                    )

    return run


def middle_runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) hit of the stretch without a gap around each row's middle; last < first if there is none."""
    mid = hit.shape[1] // 2

    def reach(side: np.ndarray) -> np.ndarray:
        return np.where(side.all(axis=1), side.shape[1], side.argmin(axis=1))

    return mid - reach(hit[:, mid::-1]) + 1, mid + reach(hit[:, mid:]) - 1


def best_segments(hit: np.ndarray, inside: np.ndarray, tokens: int, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of each row's longest stretch around the middle whose share of hits allows the
    similarity, hits at both ends; last < first if there is none."""
    share = 2 * similar / (1 + similar)  # of equal tokens in two texts of one length
    score = np.where(inside, np.where(hit, 1.0 - share, -share), -1e9)
    mid = tokens - 1
    none = np.zeros((len(hit), 1))
    left = np.concatenate([none, np.cumsum(score[:, mid - 1 :: -1], axis=1)], axis=1) if mid else none
    right = np.cumsum(score[:, mid:], axis=1)
    ends = np.concatenate([none == 0, hit[:, mid - 1 :: -1]], axis=1) if mid else none == 0
    # how far left each right end can go: the last place from which the score still suffices
    reach = np.maximum.accumulate(np.where(ends, left, -np.inf)[:, ::-1], axis=1)[:, ::-1]
    first, last = np.zeros(len(hit), np.int64), np.full(len(hit), -1)
    # the few rows in which some right end can go far enough left for the least length
    rows = np.flatnonzero((hit[:, mid:] & (reach[:, ::-1] >= -1e-9 - right)).any(axis=1))
    u = (reach[rows][:, None, :] >= -1e-9 - right[rows][:, :, None]).sum(axis=2) - 1
    length = np.where(hit[rows, mid:] & (u >= 0), u + np.arange(1, right.shape[1] + 1), -1)
    v = length.shape[1] - 1 - length[:, ::-1].argmax(axis=1)  # the rightmost of equal lengths
    first[rows], last[rows] = mid - u[np.arange(len(rows)), v], mid + v
    return first, last


def distinct(codes: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Different codes of each row where `use` holds."""
    held = np.sort(np.where(use, codes, -1), axis=1)
    return (held[:, :1] >= 0).sum(axis=1) + ((held[:, 1:] != held[:, :-1]) & (held[:, 1:] >= 0)).sum(axis=1)


def _rank(ids: pa.Array) -> np.ndarray:
    """Places of the ids in their order, nulls last; equal ids share one."""
    known = sorted(set(ids.drop_null().to_pylist())) if not pa.types.is_integer(ids.type) else None
    if known is None:
        top = np.iinfo(np.int64).max
        return pa.compute.fill_null(ids.cast(pa.int64()), top).to_numpy(zero_copy_only=False)
    at = {v: k for k, v in enumerate(known)}
    return np.array([len(at) if v is None else at[v] for v in ids.to_pylist()], dtype=np.int64)


def _verify(tokens: int, width: int, similar: float):
    """Repeated stretches among the windows of one group, each against earlier documents."""

    need = int(np.ceil(tokens * 2 * similar / (1 + similar) - 1e-9))
    mid = tokens - 1

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows.column("id").combine_chunks()
        key, place = rows.column("key").to_numpy(), rows.column("place").to_numpy()
        raw = rows.column("region").to_pylist()
        _, group = np.unique(np.stack([rows.column(c).to_numpy() for c in ("h", "i", "j")], axis=1), axis=0, return_inverse=True)
        order = np.lexsort((place, key, _rank(ids), group.ravel()))
        group, key, place, ids = group.ravel()[order], key[order], place[order], ids.take(pa.array(order))
        region = np.frombuffer(b"".join(raw), dtype=np.uint32).reshape(len(raw), -1)[order]
        inside = region > 0
        out: list[tuple[np.ndarray, ...]] = []

        def found(k: np.ndarray, a: np.ndarray, b: np.ndarray, of: np.ndarray) -> None:
            first = place[k] + a - mid
            out.append((k, first, first + b - a + width, of))

        # equal surroundings in a group: the first stands for all
        code = pd.factorize(np.array(raw, dtype=object)[order])[0].astype(np.int64)
        _, first, back = np.unique(group * (code.max() + 1) + code, return_index=True, return_inverse=True)
        rep = first[back.ravel()]
        copy = rep != np.arange(len(rep))
        other = np.flatnonzero(copy & (key[rep] != key) & (inside.sum(axis=1) >= tokens))
        found(other, inside[other].argmax(axis=1), inside.shape[1] - 1 - inside[other][:, ::-1].argmax(axis=1), rep[other])
        again: dict[int, list[int]] = {}  # more places of one document with its surroundings
        for j in np.flatnonzero(copy & (key[rep] == key)).tolist():
            again.setdefault(int(rep[j]), []).append(j)
        # tokens that stand at one place only are part of no repeated passage
        alone = np.flatnonzero(~copy)
        token = (group[alone].astype(np.uint64)[:, None] << np.uint64(32)) | region[alone]
        codes = pd.factorize(token.ravel())[0].astype(np.int32).reshape(token.shape)
        n = np.bincount(codes.ravel())
        enough = ((n[codes] > 1) & inside[alone]).sum(axis=1) >= need
        alone, codes = alone[enough], codes[enough]
        if len(alone):
            for who, a, b, lead in _compare(alone, codes, inside[alone], group[alone], key):
                found(who, a, b, lead)
                more = [(j, x, y, z) for k, x, y, z in zip(who.tolist(), a.tolist(), b.tolist(), lead.tolist()) for j in again.get(k, ())]
                if more:
                    found(*(np.array(c, dtype=np.int64) for c in zip(*more)))
        k, a, b, of = (np.concatenate(x) for x in zip(*out))
        if len(k):
            k, of = k.astype(np.int64), of.astype(np.int64)
            owner, k = ids.take(pa.array(k)), key[k]
            yield pa.RecordBatch.from_arrays([pa.array(k), owner, pa.array(a), pa.array(b), ids.take(pa.array(of)), pa.array(key[of])], ["key", "id", "first", "end", "source", "source_key"])

    def _compare(who: np.ndarray, codes: np.ndarray, inside: np.ndarray, group: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Passages (row, first, last, lead) of all groups: each different surrounding in turn leads, all groups side by side.

        A surrounding wants those of its tokens that others have and no passage found in it
        covers. A lead is held against the later rows that want one of its tokens; a group ends
        when no two of its rows are left that could share a passage.
        """
        free, key, n, span = inside.copy(), keys[who], int(codes.max()) + 1, codes.shape[1]
        codes = np.where(inside, codes, np.int32(n))  # a code of its own, which is never marked
        mark, alive, hits = np.zeros(n + 1, dtype=bool), np.ones(len(who), dtype=bool), np.zeros(codes.shape, dtype=bool)
        count = np.bincount(codes[inside], minlength=n + 1)
        shared = (count > 1)[codes]
        shared[~inside] = False
        # (code, row, its places there) of each code that more than one place has, by code
        places = np.flatnonzero(shared)
        code = codes.ravel()[places]
        order = np.argsort(code, kind="stable")
        code, row_of = code[order], places[order] // span
        start = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row_of[1:] != row_of[:-1])])) if len(code) else np.zeros(0, np.int64)
        code, row_of, times = code[start], row_of[start], np.diff(np.append(start, len(code)))
        ends = np.cumsum(np.bincount(code, minlength=n + 1))

        def once(some: np.ndarray) -> np.ndarray:
            """The different ones of some codes."""
            if len(some) <= n // 8:
                return np.unique(some)
            mark[some] = True
            some = np.flatnonzero(mark)
            mark[some] = False
            return some

        def rows_of(some: np.ndarray) -> np.ndarray:
            """Where the rows of these different codes are in `row_of`."""
            end = ends[some]
            size = end - np.where(some > 0, ends[some - 1], 0)
            return np.repeat(end - np.cumsum(size), size) + np.arange(size.sum())

        def per_row(index: np.ndarray | slice) -> np.ndarray:
            """Places of each row in these entries of `row_of`."""
            return np.bincount(row_of[index], times[index], len(who)).astype(np.int64)

        def left_over(held: np.ndarray, gone: np.ndarray, rest: int) -> np.ndarray:
            """Codes of which `gone` leaves so many in `held`."""
            np.subtract.at(held, gone, 1)
            some = once(gone)
            return some[held[some] == rest]

        def unwant(places: np.ndarray) -> None:
            """These places are wanted no more."""
            live.ravel()[places] = False
            lost = left_over(wants, codes.ravel()[places], 0)
            if len(lost):
                n_wanted[:] -= per_row(rows_of(lost))

        def within(rows: np.ndarray, which: np.ndarray) -> np.ndarray:
            """Places marked by `which` in these rows."""
            k, at = np.nonzero(which)
            return rows[k] * span + at

        n_shared = per_row(slice(None))
        # rows that share enough tokens with others still here, and want one of these or have one that is wanted
        keep = n_shared >= need
        live = shared & keep[:, None]
        wants = np.bincount(codes[live], minlength=n + 1)
        n_wanted = per_row(wants[code] > 0)
        # a turn goes to the places of the codes it is about, and counts only what it takes away
        while True:
            at = np.flatnonzero(keep & (n_wanted > 0))
            if len(at):  # rows of one document alone hold nothing against each other
                edge = np.flatnonzero(np.concatenate([[True], group[at][1:] != group[at][:-1]]))
                several = np.maximum.reduceat(key[at], edge) != np.minimum.reduceat(key[at], edge)
                at = at[np.repeat(several, np.diff(np.append(edge, len(at))))]
            if not len(at):
                return
            first = np.concatenate([[True], group[at][1:] != group[at][:-1]])
            lead = np.zeros(len(who), dtype=np.int64)
            lead[at] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            leads = at[first]
            own = once(codes[leads][shared[leads]])
            fresh = at[~first & (per_row(rows_of(own))[at] >= need) & (key[at] != key[lead[at]])]
            mark[own] = True
            hit = mark[codes[fresh]]
            mark[own] = False
            enough = (hit & free[fresh]).any(axis=1)
            fresh = fresh[enough]
            hits[fresh] = hit[enough]
            for part in (fresh[i : i + 2000] for i in range(0, len(fresh), 2000)):
                for k, a, b in _passages_of(part, lead, hits, codes, inside, free):
                    yield who[k], a, b, who[lead[k]]
            unwant(within(fresh, live[fresh] & ~free[fresh]))
            stay = np.zeros(len(who), dtype=bool)
            stay[at[~first]] = True
            gone = np.flatnonzero(alive & ~stay)
            alive = stay
            single = left_over(count, codes[gone][shared[gone]], 1)
            if len(single):
                lost = rows_of(single)
                n_shared -= per_row(lost)
                lost = lost[alive[row_of[lost]]]
                lost = within(row_of[lost], shared[row_of[lost]] & (codes[row_of[lost]] == code[lost][:, None]))
                shared.ravel()[lost] = False
                unwant(lost[live.ravel()[lost]])
            out = np.flatnonzero(keep & ~(alive & (n_shared >= need)))
            keep[out] = False
            unwant(within(out, live[out]))
            if 4 * alive.sum() < 3 * len(alive):
                stay = alive[row_of]
                code, row_of, times = code[stay], (np.cumsum(alive) - 1)[row_of[stay]], times[stay]
                ends = np.cumsum(np.bincount(code, minlength=n + 1))
                who, codes, inside, free, group, key, keep, shared, n_shared, n_wanted, live, hits = (
                    x[alive] for x in (who, codes, inside, free, group, key, keep, shared, n_shared, n_wanted, live, hits)
                )
                alive = np.ones(len(who), dtype=bool)

    def _passages_of(part: np.ndarray, lead: np.ndarray, hits: np.ndarray, codes: np.ndarray, inside: np.ndarray, free: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        span = np.arange(codes.shape[1])[None, :]

        def new(k: np.ndarray, a: np.ndarray, b: np.ndarray, enough: np.ndarray) -> tuple[np.ndarray, ...]:
            """Of the stretches [a, b], those that cover a free token; they cover it from now on."""
            k, a, b = k[enough], a[enough], b[enough]
            within = (span >= a[:, None]) & (span <= b[:, None])
            use = (free[k] & within).any(axis=1)
            free[k[use]] &= ~within[use]
            return k[use], a[use], b[use]

        a, b = middle_runs(hits[part])
        yield new(part, a, b, b - a + 1 >= tokens)
        left = part[(hits[part] & free[part]).any(axis=1)]
        for k in (left[i : i + 500] for i in range(0, len(left), 500)):
            a, b = best_segments(hits[k], inside[k], tokens, similar)
            k, a, b = (x[b >= a] for x in (k, a, b))
            hit, own, other, there_in = hits[k], codes[k], codes[lead[k]], inside[lead[k]]
            within = (span >= a[:, None]) & (span <= b[:, None]) & inside[k]
            # where the lead has the stretch's equal tokens
            mine = np.where(hit & within, own, -1)
            there = (other[:, :, None] == mine[:, None, :]).any(axis=2) & there_in
            start, end = there.argmax(axis=1), there.shape[1] - 1 - there[:, ::-1].argmax(axis=1)
            both = distinct(own, hit & within)
            sizes = distinct(own, within) + distinct(other, (span >= start[:, None]) & (span <= end[:, None]) & there_in)
            good = there.any(axis=1) & (end - start + 1 >= tokens * similar) & (both >= similar * (sizes - both) - 1e-9)
            yield new(k, a, b, good)

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): the key is a hash of id and text, so rows that repeat are one document."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.select("id", F.xxhash64("id", "text").alias("key"), "text")


def repeated_spans(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, width: int = SHINGLE, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(key, id, spans) of documents that hold repeated passages; spans (first, end, source) in words.

    Spans do not overlap and are in order; `source` is an earlier document (by id, null ids
    last) that holds the passage.
    """
    tokens = words - width + 1
    rows = keyed(docs, id_col, text_col)
    order = [F.col("h"), F.col("around"), F.col("id").asc_nulls_last(), F.col("key"), F.col("place")]
    found = windows(rows, words, width, hashes)
    met = store(found.repartition("h").sortWithinPartitions(*order).mapInArrow(_meet, found.schema), "met")
    open_ = met.where("source_key is null").select("h", "id", "key", "place")
    sizes = open_.groupBy("h").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most")
    wanted = open_.join(sizes.select("h", "n"), "h").groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("h", "n", "place")).alias("wanted"))
    texts = rows.join(wanted, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")))
    kind = rows.schema["id"].dataType.simpleString()
    regions = texts.select("id", "key", "text", "wanted").mapInArrow(_regions(width, tokens), f"h long, n long, id {kind}, key long, place long, region binary")
    blocks = F.ceil(F.col("n") / F.lit(max(1, leaf // 2))).cast("int")
    small = F.col("n") <= leaf
    part = F.when(small, F.lit(0)).otherwise(F.pmod(F.xxhash64("key", F.lit(3)), blocks).cast("int"))
    other = F.when(small, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))
    spread = regions.withColumn("part", part).withColumn("o", F.explode(other))
    spread = spread.select("h", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "id", "key", "place", "region")
    spans = grouped(spread, ["h", "i", "j"], _verify(tokens, width, similar), f"key long, id {kind}, first long, end long, source {kind}, source_key long", rows=20_000)
    at, left, right = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(F.lit(1023)), F.col("place").bitwiseAND(F.lit(1023))
    copied = met.where("source_key is not null").select("key", "id", (at - left).alias("first"), (at + right + width).alias("end"), "source", "source_key")
    spans = spans.unionByName(copied)
    per = spans.groupBy("key", "id").agg(F.sort_array(F.collect_set(F.struct("first", "end", "source"))).alias("s"))
    grow = (
        "aggregate(s, cast(array() as array<struct<first:bigint,end:bigint,source:{k}>>), (acc, x) -> "
        "if(size(acc) > 0 and x.first <= element_at(acc, -1).end, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'end', greatest(element_at(acc, -1).end, x.end), 'source', element_at(acc, -1).source))), "
        "concat(acc, array(x))))"
    ).format(k=kind)
    return per.select("key", "id", F.expr(grow).alias("spans"))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, spans, n_repeated) of every document: word ranges that repeat an earlier document.

    The first document (least id) that holds a passage keeps it. Rows with equal id and text
    count as one document; null and short texts have no spans; texts of any length are
    taken whole; an empty table gives an empty result. Other columns are not read.
    """
    spans = store(repeated_spans(docs, id_col=id_col, text_col=text_col, **options), "spans").select(F.col("key").alias("_key"), F.col("id").alias("_id"), "spans")
    out = keyed(docs, id_col, text_col).select("id", "key").join(spans, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    kind = docs.schema[id_col].dataType.simpleString()
    none = F.expr(f"cast(array() as array<struct<first:bigint,end:bigint,source:{kind}>>)")
    out = out.select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))
    return out.withColumn("n_repeated", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"]))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of `spans` and the blanks after them."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    starts = np.append(starts, len(raw))
    keep = np.ones(len(raw), dtype=bool)
    for a, b in spans:
        keep[starts[a] : starts[min(b, len(starts) - 1)]] = False
    return raw[keep].tobytes().decode("utf-8", "surrogatepass")


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", **options) -> DataFrame:
    """`docs` with repeated passages cut out of the text; documents that lose all words go.

    All columns stay; `size_col`, if there, gets the new number of code points of a cut text.
    """
    spans = store(repeated_spans(docs, id_col=id_col, text_col=text_col, **options), "spans").select(F.col("key").alias("_key"), F.col("id").alias("_id"), "spans")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key"), row)
    met = rows.join(spans, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    untouched = met.where("spans is null").select("row.*")
    kind, names = docs.schema, docs.columns
    last = "_" + max(names, key=len)  # a name that no column has
    cut = met.where("spans is not null").select("row.*", F.col("spans").alias(last))
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                spans_of = part.column(part.num_columns - 1).to_pylist()
                texts = [without(t, [(s["first"], s["end"]) for s in p]) for t, p in zip(part.column(at).to_pylist(), spans_of)]
                columns = [part.column(k) for k in range(len(names))]
                columns[at] = pa.array(texts, pa.string())
                if size_col in names:
                    k = names.index(size_col)
                    columns[k] = pa.array([len(t) for t in texts], columns[k].type)
                left = pa.array([bool(t.split()) for t in texts])
                yield pa.RecordBatch.from_arrays(columns, names).filter(left)

    return untouched.unionByName(cut.mapInArrow(run, kind))


@query("op3_compact_windows")
def op3(spark, sf_dir):
    return passages(table(spark, sf_dir, "documents"))
