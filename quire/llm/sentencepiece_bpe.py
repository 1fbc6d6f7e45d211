"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The pieces and scores of a SentencePiece BPE model drive an agenda: candidate merges leave it best score
first, leftmost first, and each is skipped when a hash of (key, piece, place in the unit) falls below `dropout`.
With dropout 0 the pieces are those of the library. No piece of the model spans the start of a white-space
run or a line break, so a text is cut there into units that are segmented by themselves. Each unit of a
document has a key of its own, a hash of (seed, doc_id, place in the document), so every occurrence draws
anew and a rerun agrees. (With `variants`, the corpus has only that many keys.)

Workers keep a tree of what they have segmented: a node is a unit and the merges that were skipped so far,
and holds the merges that follow if none of them is skipped. An occurrence goes from its unit's node to the
child of the first merge that its key skips, and so on; where the tree isn't kept, its agenda is run. A node is made
when it is wanted for the second time, as most units and skips of a corpus come once.

Characters without a piece become byte pieces; so does U+2581, which stands for a space inside pieces.
Defined cases: null text has null ids, empty text none; a null doc_id is hashed as a key of its own; repeated
rows get equal ids, unless they are told to be copies; empty tables give no rows. Whole texts are encoded.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DROPOUT = 0.1
VARIANTS = None
SEED = 7
SPACE = "▁"
#: Nodes that a worker keeps.
KEPT_UNITS = 450_000
#: Skips up to which nodes are kept.
DEPTH = 2
#: Longest unit that is segmented side by side with others.
ALIKE = 40
#: Units that go through the tree at once.
WALK = 1 << 18
#: Bytes of texts that are encoded at once.
AT_ONCE = 1 << 20
#: Marks of units that were seen, by hash; a unit that shares its mark is only kept earlier.
MARKS = 1 << 22
#: Ranks of pieces are below.
NONE = np.int32(2**31 - 1)
MASK = (1 << 64) - 1


def mix(x: int) -> int:
    """A 64-bit finaliser."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def mix_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Flat:
    """A numpy array that grows at its end."""

    def __init__(self, dtype: object, *width: int):
        self.all, self.n = np.empty((1024, *width), dtype), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.all):
            grown = np.empty((max(end, 2 * len(self.all)), *self.all.shape[1:]), self.all.dtype)
            grown[: self.n] = self.all[: self.n]
            self.all = grown
        self.all[self.n : end], self.n = values, end


class Nodes:
    """The tree: ids and merges of node k end where those of k + 1 start. child: its node, -1 not wanted so far, -2 wanted once."""

    def __init__(self) -> None:
        self.root: dict[str, int] = {}
        self.seen = np.zeros(MARKS, np.bool_)
        self.unit: list[str] = []
        self.ids, self.ids_end = Flat(np.int32), Flat(np.int64)
        self.codes, self.child, self.codes_end = Flat(np.uint64), Flat(np.int32), Flat(np.int64)
        self.skips, self.depth, self.base = Flat(np.uint64, DEPTH), Flat(np.int8), Flat(np.int32)
        self.ids_end.extend(np.zeros(1, np.int64))
        self.codes_end.extend(np.zeros(1, np.int64))

    def add(self, units: list[str], ids: np.ndarray, n_ids: np.ndarray, codes: np.ndarray, n_codes: np.ndarray, skips: np.ndarray, depth: np.ndarray, base: np.ndarray) -> np.ndarray:
        first = len(self.unit)
        self.unit += units
        self.ids_end.extend(self.ids.n + np.cumsum(n_ids))
        self.codes_end.extend(self.codes.n + np.cumsum(n_codes))
        self.ids.extend(ids)
        self.codes.extend(codes)
        self.child.extend(np.full(len(codes), -1, np.int32))
        self.skips.extend(skips)
        self.depth.extend(depth)
        self.base.extend(base)
        return np.arange(first, first + len(units))


NO_SKIP = np.uint64(MASK)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... of each k, counts[k] of them."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Pairs:
    """Merged piece and its rank (0: best score; equal scores share one) of pairs of ids, by open addressing."""

    EMPTY, BITS = np.int64(-(2**63)), 19

    def __init__(self, pairs: list[tuple[int, int, int]], scores: np.ndarray):
        self.bits = max(self.BITS, len(pairs).bit_length() + 2)
        n = 1 << self.bits
        self.keys, self.ids, self.ranks = np.full(n, self.EMPTY), np.full(n, -1, np.int32), np.full(n, NONE)
        _, ranks = np.unique(-scores, return_inverse=True)
        keys = np.array([a << 32 | b for a, b, _ in pairs], np.int64)
        for key, slot, (_, _, i) in zip(keys.tolist(), self._slots(keys).tolist(), pairs, strict=True):
            while self.keys[slot] != self.EMPTY:
                slot = slot + 1 & n - 1
            self.keys[slot], self.ids[slot], self.ranks[slot] = key, i, ranks[i]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id of the merged piece or -1, its rank or NONE); negative ids have none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        slots = self._slots(keys)
        there = self.keys.take(slots)
        ask = np.flatnonzero((there != keys) & (there != self.EMPTY))
        while len(ask):
            slots[ask] = moved = slots[ask] + 1 & len(self.keys) - 1
            there[ask] = now = self.keys.take(moved)
            ask = ask[(now != keys[ask]) & (now != self.EMPTY)]
        return self.ids.take(slots), self.ranks.take(slots)


class DropoutEncoder:
    """Segments texts with the pieces of one model."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED, variants: int | None = VARIANTS):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.scores = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.limit, self.seed, self.variants = int(dropout * 2**64), seed, variants
        self.least = np.uint64(min(self.limit, MASK))
        self.kind = "H" if m.get_piece_size() <= 1 << 16 else "i"  # of the ids that are kept
        self.nodes = Nodes()
        self.of_char = np.full(0x110000, -1, np.int64)
        for p in self.ids:
            if len(p) == 1:
                self.of_char[0x20 if p == SPACE else ord(p)] = self.ids[p]
        self.pairs = Pairs([(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids], np.array([m.get_score(i) for i in range(m.get_piece_size())]))
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the model has pieces across the places at which texts are cut")

    UNIT = re.compile("\n|\0| *[^ \n\0]+| +")

    def units(self, text: str) -> list[str]:
        """Unit strings, with plain spaces (they stay compact); a literal U+2581 or NUL is a unit of its own, marked by a NUL before it."""
        if not text:
            return []
        if SPACE not in text and "\0" not in text:
            return self.UNIT.findall(" " + text)
        out: list[str] = []
        for k, part in enumerate(re.split(f"([{SPACE}\0])", text)):
            if k % 2:
                out += [" "] * (not out) + ["\0" + part]
            elif part:
                out += self.UNIT.findall(("" if out else " ") + part)
        return out

    def segment(self, unit: str, key: int) -> list[int]:
        """Ids of one unit: the plain agenda of candidate merges with keyed skips."""
        if unit[0] == "\0":
            return [self.bytes[b] for b in unit[1:].encode()]
        scores, pieces = self.scores, list(unit.replace(" ", SPACE))
        n = len(pieces)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ids, limit = self.ids, self.limit
        agenda = [(-s, k, k + 1, both) for k in range(n - 1) if (s := scores.get(both := pieces[k] + pieces[k + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            # out of date if either side was merged since
            if right >= n or after[left] != right or pieces[left] + pieces[right] != both:
                continue
            if limit and mix(key ^ ids[both] << 32 ^ left) < limit:
                continue
            pieces[left], pieces[right] = both, ""
            after[left] = end = after[right]
            after[right] = -1
            if end < n:
                before[end] = left
                if (s := scores.get(more := both + pieces[end])) is not None:
                    heapq.heappush(agenda, (-s, left, end, more))
            start = before[left]
            if start >= 0 and (s := scores.get(more := pieces[start] + both)) is not None:
                heapq.heappush(agenda, (-s, start, left, more))
        out = []
        for p in pieces:
            if p:
                known = ids.get(p)
                out += [known] if known is not None else [self.bytes[b] for b in p.encode()]
        return out

    def segment_all(self, units: list[tuple[str, int]]) -> list[bytes]:
        """segment() of many (unit, key), as bytes of ids."""
        ids, counts, _, _ = self._run([u for u, _ in units], keys=np.array([k for _, k in units], np.uint64))
        ends = np.cumsum(counts).tolist()
        ids = ids.astype(self.kind)
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _run(self, units: list[str], keys: np.ndarray | None = None, skips: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Flat ids and their counts, flat codes of merges and their counts (none if keys draw); units of like length go through the agenda side by side."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        special = lengths > ALIKE
        special[[k for k in np.flatnonzero(lengths == 2).tolist() if units[k][0] == "\0"]] = True
        pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places, counts, flat ids
        merges: list[tuple[np.ndarray, np.ndarray]] = []  # places, codes
        for k in np.flatnonzero(special).tolist():
            ids = self.segment(units[k], int(keys[k]) if keys is not None else 0)
            pieces.append((np.array([k]), np.array([len(ids)]), np.array(ids, np.int64)))
        for low, high in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14), (14, 18), (18, ALIKE)):
            places_all = np.flatnonzero((lengths > low) & (lengths <= high) & ~special)
            for at in range(0, len(places_all), 8192):
                places = places_all[at : at + 8192]
                n = lengths[places]
                chars = np.frombuffer("".join([units[k] for k in places.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
                ids = np.full((len(places), high), -1, np.int32)
                known = self.of_char[chars]
                ids[np.arange(high) < n[:, None]] = np.where(known >= 0, known, -2 - chars)
                merged, rows, codes = self._agenda(ids, None if keys is None else keys[places], None if skips is None else skips[places])
                if keys is None:
                    merges.append((places[rows], codes))
                kept = merged != -1
                counts, flat = kept.sum(axis=1), merged[kept]
                if (flat < 0).any():
                    raw = [[x] if x >= 0 else [self.bytes[b] for b in chr(-2 - x).encode()] for x in flat.tolist()]
                    counts = np.add.reduceat(np.fromiter(map(len, raw), np.int64, len(raw)), np.cumsum(counts) - counts)
                    flat = np.array([x for part in raw for x in part], np.int64)
                pieces.append((places, counts, flat))
        out, n_ids = np.empty(sum(len(flat) for _, _, flat in pieces), np.int32), np.zeros(len(units), np.int64)
        for places, counts, _ in pieces:
            n_ids[places] = counts
        starts = np.cumsum(n_ids) - n_ids
        for places, counts, flat in pieces:
            out[spread(starts[places], counts)] = flat
        owner = np.concatenate([np.empty(0, np.int64), *(p for p, _ in merges)])
        codes = np.concatenate([np.empty(0, np.uint64), *(c for _, c in merges)])
        return out, n_ids, codes[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(units))

    def _agenda(self, ids: np.ndarray, keys: np.ndarray | None, skips: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The agenda of each row of ids at once: in each turn every row takes its best candidate; -1 where a piece was merged away.

        Also rows and codes of the merges. Skipped are those that keys draw, or those listed in skips. Places are those in the
        flat array; a row's pieces have places before and after, and rank and both are of the merge with the piece after.
        """
        n, length = ids.shape
        result = ids.ravel()
        after = np.tile(np.arange(1, length + 1, dtype=np.int32), n)
        before = np.tile(np.arange(-1, length - 1, dtype=np.int32), n)
        both, rank = np.full(n * length, -1, np.int32), np.full(n * length, NONE)
        there = np.flatnonzero((result[:-1] != -1) & (result[1:] != -1) & (after[:-1] < length))
        both[there], rank[there] = self.pairs.find(result[there], result[there + 1])
        ranks = rank.reshape(n, length)
        rows = np.arange(n)
        taken = [(rows[:0], np.empty(0, np.uint64))]
        while len(rows):
            left = (ranks if len(rows) == n else ranks.take(rows, axis=0)).argmin(axis=1)
            at = rows * length + left
            live = np.flatnonzero(rank.take(at) != NONE)
            if len(live) < len(rows):
                rows, left, at = rows.take(live), left.take(live), at.take(live)
            piece = both.take(at)
            rank[at] = NONE
            code = (piece.astype(np.uint64) << np.uint64(32)) ^ left.astype(np.uint64)
            if keys is not None:
                go = mix_all(keys.take(rows) ^ code) >= self.least
            elif skips is not None:
                go = (skips.take(rows, axis=0) != code[:, None]).all(axis=1)
            else:
                go = None
            r, k, base = rows, left, at - left
            if go is not None and not go.all():
                go = np.flatnonzero(go)
                r, k, base, at, piece, code = r.take(go), k.take(go), base.take(go), at.take(go), piece.take(go), code.take(go)
            taken.append((r, code))
            right = base + after.take(at)
            end = after.take(right)
            result[at], result[right], after[at] = piece, -1, end
            rank[right] = NONE
            more = np.flatnonzero(end < length)
            here = at.take(more)
            follows = base.take(more) + end.take(more)
            before[follows] = k.take(more)
            start = before.take(at)
            prior = np.flatnonzero(start >= 0)
            ahead = base.take(prior) + start.take(prior)
            places = np.concatenate([here, ahead])
            both[places], rank[places] = self.pairs.find(
                np.concatenate([piece.take(more), result.take(ahead)]), np.concatenate([result.take(follows), piece.take(prior)])
            )
        return ids, np.concatenate([r for r, _ in taken]), np.concatenate([c for _, c in taken])

    def _keys(self, doc_id: int | None, n: int, copy: int = 0) -> np.ndarray:
        """The keys of a document's first n units; each further copy has its own."""
        key = mix(mix(self.seed) + (0x5EED if doc_id is None else doc_id * 2 + 1) & MASK)
        key = mix(key + copy & MASK) if copy else key
        keys = mix_all(np.arange(n, dtype=np.uint64) + np.uint64(key))
        return keys if self.variants is None else mix_all(keys % np.uint64(self.variants) + np.uint64(mix(self.seed)))

    def _roots(self, units: list[str], often: np.ndarray) -> np.ndarray:
        """The node of each of the distinct units; -1 of a long one, and of one that comes for the first time and isn't there often."""
        t = self.nodes
        at = np.fromiter(map(t.root.get, units, repeat(-1)), np.int64, len(units))
        lacking = [k for k in np.flatnonzero(at < 0).tolist() if len(units[k]) <= ALIKE]
        marks = np.fromiter((hash(units[k]) for k in lacking), np.int64, len(lacking)) & MARKS - 1
        wanted = often[lacking] | t.seen[marks]
        t.seen[marks] = True
        places = np.array(lacking, np.int64)[wanted]
        if len(places):
            new = [units[k] for k in places.tolist()]
            n = len(new)
            at[places] = t.add(new, *self._run(new), np.full((n, DEPTH), NO_SKIP), np.zeros(n, np.int8), np.zeros(n, np.int32))
            t.root.update(zip(new, at[places].tolist(), strict=True))
        return at

    def _grow(self, parents: np.ndarray, slots: np.ndarray) -> None:
        """Adds the children of parents in which the merges at slots are skipped."""
        t = self.nodes
        units = [t.unit[k] for k in parents.tolist()]
        depth, skips = t.depth.all[parents], t.skips.all[parents]
        skips[np.arange(len(parents)), depth] = t.codes.all[slots]
        base = t.base.all[parents] + (slots - t.codes_end.all[parents]).astype(np.int32)
        ids, n_ids, codes, n_codes = self._run(units, skips=skips)
        # up to the skip, the merges are those that led here
        codes = codes[spread(np.cumsum(n_codes) - n_codes + base, n_codes - base)]
        t.child.all[slots] = t.add(units, ids, n_ids, codes, n_codes - base, skips, depth + np.int8(1), base)

    def _walk(self, units: list[str], which: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of occurrences, units[which[k]] under keys[k], and their counts."""
        t, at = self.nodes, self._roots(units, np.bincount(which, minlength=len(units)) > 1)[which]
        walking = np.flatnonzero(at >= 0)
        while self.limit and len(walking):
            node = at[walking]
            starts = t.codes_end.all[node]
            counts = t.codes_end.all[node + 1] - starts
            slots, who = spread(starts, counts), np.repeat(np.arange(len(node)), counts)
            hit = np.flatnonzero(mix_all(keys[walking][who] ^ t.codes.all[slots]) < self.least)
            who, slots = who[hit], slots[hit]
            first = np.ones(len(who), np.bool_)
            first[1:] = who[1:] != who[:-1]
            who, slots = who[first], slots[first]
            walking, node = walking[who], node[who]
            shallow = t.depth.all[node] < DEPTH
            at[walking[~shallow]] = -1
            walking, node, slots = walking[shallow], node[shallow], slots[shallow]
            lacking = np.flatnonzero(t.child.all[slots] < 0)
            if len(lacking):
                new, one, times = np.unique(slots[lacking], return_index=True, return_counts=True)
                wanted = (times > 1) | (t.child.all[new] == -2)
                t.child.all[new[~wanted]] = -2
                if wanted.any():
                    self._grow(node[lacking[one[wanted]]], new[wanted])
            at[walking] = t.child.all[slots]
            walking = walking[at[walking] >= 0]
        run, kept = np.flatnonzero(at < 0), np.flatnonzero(at >= 0)
        own, n_own, _, _ = self._run([units[k] for k in which[run].tolist()], keys=keys[run])
        counts = np.empty(len(which), np.int64)
        starts = t.ids_end.all[at[kept]]
        counts[run], counts[kept] = n_own, t.ids_end.all[at[kept] + 1] - starts
        out, places = np.empty(counts.sum(), np.int32), np.cumsum(counts) - counts
        out[spread(places[run], n_own)] = own
        out[spread(places[kept], counts[kept])] = t.ids.all[spread(starts, counts[kept])]
        return out, counts

    def _split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """units() of many texts, and how many each has; plain texts are cut by their bytes."""
        parts: list[pa.Array] = []
        counts = np.zeros(len(texts), np.int64)
        plain = np.array([SPACE not in t and "\0" not in t for t in texts], np.bool_)
        for block in np.split(np.arange(len(texts)), np.flatnonzero(plain[1:] != plain[:-1]) + 1) if texts else []:
            if not plain[block[0]]:
                for k in block.tolist():
                    own = self.units(texts[k])
                    counts[k] = len(own)
                    parts.append(pa.array(own, pa.large_string()))
                continue
            raws = [(" " + texts[k]).encode() if texts[k] else b"" for k in block.tolist()]
            joined = b"".join(raws)
            if not joined:
                continue
            raw, sizes = np.frombuffer(joined, np.uint8), np.fromiter(map(len, raws), np.int64, len(raws))
            line, space = raw == 0x0A, raw == 0x20
            new = line | space
            # a unit starts at a line break, behind one, and at the first of a run of spaces
            new[1:] &= line[1:] | ~space[:-1]
            new[1:] |= line[:-1]
            new[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
            starts = np.flatnonzero(new)
            ends = np.searchsorted(starts, np.cumsum(sizes))
            counts[block] = np.diff(ends, prepend=0)
            parts.append(pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(joined)))
        return pa.concat_arrays([pa.array([], pa.large_string()), *parts]), counts

    def encode_all(self, doc_ids: list[int | None], texts: list[str], copies: list[int] | None = None) -> list[np.ndarray]:
        units, n_units = self._split(texts)
        keys = np.concatenate([np.empty(0, np.uint64), *(self._keys(d, n, c) for d, n, c in zip(doc_ids, n_units.tolist(), copies or repeat(0), strict=copies is not None))])
        parts = []
        for k in range(0, len(units), WALK):
            if len(self.nodes.unit) > KEPT_UNITS:
                self.nodes = Nodes()
            coded = units.slice(k, WALK).dictionary_encode()
            parts.append(self._walk(coded.dictionary.to_pylist(), coded.indices.to_numpy(), keys[k : k + WALK]))
        ids = np.concatenate([np.empty(0, np.int32), *(i for i, _ in parts)])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *(n for _, n in parts)]))])[np.cumsum([0, *n_units.tolist()])]
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, doc_id: int | None, text: str) -> np.ndarray:
        return self.encode_all([doc_id], [text])[0]


@lru_cache(1)
def encoder_of(path: str, dropout: float, seed: int, variants: int | None) -> DropoutEncoder:
    """The worker's encoder, which keeps what it has segmented from task to task."""
    return DropoutEncoder(path, dropout, seed, variants)


def _copies(doc_ids: list[int | None], texts: list[str | None], before: tuple) -> tuple[list[int], tuple]:
    """How many rows with the same doc_id and text stand right before each row; before: doc_id, text and number of the last row."""
    out = []
    for doc_id, text in zip(doc_ids, texts, strict=True):
        before = (doc_id, text, before[2] + 1 if before[:2] == (doc_id, text) else 0)
        out.append(before[2])
    return out, before


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of AT_ONCE bytes of text, or one row that has more."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _encoder(path: str, dropout: float, seed: int, variants: int | None, copies_follow: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before, copies = None, (None, None, -1), None
        for batch in batches:
            coder = coder or encoder_of(path, dropout, seed, variants)
            for part in _parts(batch):
                texts = part.column("text").to_pylist()
                doc_ids = part.column("doc_id").to_pylist()
                if copies_follow:
                    copies, before = _copies(doc_ids, texts, before)
                coded = coder.encode_all(doc_ids, [t or "" for t in texts], copies)
                ends = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int32)
                null = pa.array([t is None for t in texts])
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded)), mask=null)
                yield pa.record_batch([*part.columns, ids], names=[*part.schema.names, "ids"])

    return encode


def encode(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, variants: int | None = VARIANTS, copies_follow: bool = False) -> DataFrame:
    """All columns of the documents and ids (array of int); a column named ids is replaced.

    copies_follow: a row that follows one with its doc_id and text is a further copy, and draws skips of its own (but for one
    that is the first of a task).
    """
    rows = docs.drop("ids").withColumns({"doc_id": docs["doc_id"].cast("long"), "text": docs["text"].cast("string")})
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_encoder(path, dropout, seed, variants, copies_follow), schema)


def _decoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = part.column("ids")
                values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
                texts = [model.decode(values[a:b].tolist()) if known else None for a, b, known in zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False)]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return decode


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns and decoded (the text of ids); a column named decoded is replaced."""
    rows = encoded.drop("decoded")
    return rows.mapInArrow(_decoder(path), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
