"""Segmentations of whole texts into pieces, sampled without replacement by a perturbed A-star search over the lattice.

Method. A text's lattice has a node before each character and an edge for each piece (bytes stand in for
characters that the vocabulary lacks). No piece holds a space mark behind another character, so the lattice is a chain of
word lattices, built together and kept for a while: a backward pass turns their edges into the chances of going on with them.
Every complete segmentation has a Gumbel perturbation around its log probability; the search goes from the root, where the best
perturbed value of all is known, to the child that inherits it, drawn by the edges' chances, while what is left at the node
gets the truncated Gumbel of its mass and waits. Popping the best of what waits gives the next distinct segmentation. After k of
them the best value still waiting is the threshold of the inclusion scores (Gumbel top-k). All texts of a batch advance together; chance comes from a
hash of the row's key, the place and the sample, so that results don't depend on batches or retries. As what follows the word in which a path leaves
another depends on neither, each sample's draws for all words are made at once.
"""

from __future__ import annotations

import bisect
import functools
import math
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shingles import mix

MARK = "▁"
#: Nodes of the lattices a worker keeps, characters of the texts that advance together, and steps of a path looked at together: first, and then.
KEPT_NODES, TOGETHER, NEAR, STEPS = 1_500_000, 500_000, 64, 256
#: A chance this close to 1 is taken from the others' sum.
SHARP = 1e-9
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ALL = 0xFFFFFFFFFFFFFFFF


#: No value drawn by _unit can lift a Gumbel this far above its location.
_LIFT = 38.0


def _scramble(x: np.ndarray) -> np.ndarray:
    """As mix, in place."""
    y = x >> np.uint64(30)
    x ^= y
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=y)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=y)
    return x


def _fraction(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from whole numbers, which are scrambled in place."""
    _scramble(x)
    x >>= np.uint64(11)
    u = x.astype(np.float64)
    u += 0.5
    u *= 1 / float(1 << 53)
    return u


def _odd(i: int) -> int:
    return 0x2545F4914F6CDD1D * (4 * i + 1) & _ALL


def _unit(seed: np.ndarray, part: int) -> np.ndarray:
    """Numbers strictly between 0 and 1, the seed well mixed already."""
    return _fraction(seed + np.uint64((part + 1) * _odd(0) & _ALL))


def _unit_of(seed: int, *parts: int) -> float:
    """As _unit, of one seed and several numbers."""
    x = (seed + sum((p + i + 1) * _odd(i) for i, p in enumerate(parts))) & _ALL
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return (((x ^ x >> 31) >> 11) + 0.5) / float(1 << 53)


def _unit_at(seed: np.ndarray, at: np.ndarray, which: int) -> np.ndarray:
    """As _unit, for the places of a row's path."""
    return _fraction(at.astype(np.uint64) * _BASE + (seed + np.uint64((which + 1) * 0xD1342543DE82EF95 & _ALL)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The whole numbers from each start, so many as its size."""
    total = int(size.sum())
    kind = np.int32 if start.dtype == np.int32 and total < 1 << 31 else np.int64
    lead = np.cumsum(size, dtype=kind)
    lead -= size.astype(kind, copy=False)
    out = np.repeat(np.subtract(start, lead, out=lead), size)
    out += np.arange(total, dtype=kind)
    return out


class PieceModel:
    """Pieces of a SentencePiece file with a weight for each: its score where the file has log probabilities, else Zipf's law of its rank."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        score = np.array([sp.get_score(i) for i in range(n)])
        plain = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)])
        ranked = bool((score[plain] == np.round(score[plain])).all())
        rank = np.where(plain, -score, n)
        self.weight = alpha * (-np.log(rank + 10) - np.log(np.log((n + 10) / 10)) if ranked else np.where(plain, score, score[plain].min() - 10))
        self.byte_id = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_weight = float(self.weight[next(iter(self.byte_id.values()))]) if self.byte_id else float(self.weight[sp.unk_id()])
        self.unk = sp.unk_id()
        self.of_byte = np.array([self.byte_id.get(b, self.unk) for b in range(256)], np.int32)
        self.surface = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.shown = np.frombuffer(b"".join(self.surface), np.uint8)
        self.shown_size = np.array([len(x) for x in self.surface], np.int32)
        self.shown_at = np.cumsum(self.shown_size, dtype=np.int32) - self.shown_size
        # a tree of the pieces' characters: the first by a table, further ones by a hash table of (node, character)
        ways: dict[int, int] = {}
        pieces = [-1]
        for i in np.flatnonzero(plain):
            if MARK in names[i].lstrip(MARK):
                raise ValueError("a piece holds a space mark behind another character")
            state = 0
            for c in map(ord, names[i]):
                key = state << 21 | c
                if key not in ways:
                    ways[key] = len(pieces)
                    pieces.append(-1)
                state = ways[key]
            pieces[state] = int(i)
        self.state_piece = np.array(pieces, np.int32)
        keys = np.fromiter(ways, np.int64, len(ways)).astype(np.uint64)
        states = np.fromiter(ways.values(), np.int32, len(ways))
        #: A character that no piece holds, and what ends a word.
        self.end = max(map(ord, "".join(names))) + 1
        self.first = np.full(self.end + 1, -1, np.int32)
        begin = keys < np.uint64(1 << 21)
        self.first[keys[begin].astype(np.int64)] = states[begin]
        keys, states = keys[~begin], states[~begin]
        self.inner = np.zeros(len(pieces), bool)
        self.inner[(keys >> np.uint64(21)).astype(np.int64)] = True
        bits = max(10, int(len(keys) * 6).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.way, self.way_to = np.full(1 << bits, _ALL, np.uint64), np.full(1 << bits, -1, np.int32)
        self.probes = 0
        slot = (keys * _BASE) >> self.shift
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.way[slot] == np.uint64(_ALL))
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.way[slot[put]], self.way_to[slot[put]] = keys[put], states[put]
            keys, states, slot = (np.delete(x, put) for x in (keys, states, slot))
            slot = (slot + np.uint64(1)) & self.slots
        self.places = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
        self.chance = None
        self.reset()

    def reset(self) -> None:
        self.n_words = self.n_chars = self.n_nodes = self.n_edges = 0
        self.keys, self.key_word = np.empty(0, np.uint64), np.empty(0, np.int32)  # hashes of words in order, and the words
        if self.chance is not None and len(self.chance) <= 4 * KEPT_NODES:
            return  # the room stays
        self.root = np.zeros(1024, np.int32)  # of each word, its first node
        self.size, self.char0 = np.zeros(1024, np.int32), np.zeros(1024, np.int32)  # of each word, its characters among chars
        self.chars = np.zeros(8192, np.uint32)
        self.edge0 = np.zeros(8192, np.int32)  # of each node, its first edge; one more at the end
        self.chance = np.zeros(32768)  # of edges; none is 0, so that each can be drawn
        self.node = np.zeros(32768, np.int32)  # of each edge
        self.piece, self.to = np.zeros(32768, np.int32), np.zeros(32768, np.int32)  # the piece, or a character less than 0; the next node, or -1 at a word's end

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        old = getattr(self, name)
        if at + len(values) > len(old):
            new = np.zeros(max(at + len(values), len(old) * 5 // 4), old.dtype)
            new[:at] = old[:at]
            setattr(self, name, new)
            old = new
        old[at : at + len(values)] = values

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The pieces' tree's nodes behind these, or -1."""
        key = state.astype(np.uint64)
        key <<= np.uint64(21)
        key |= char
        slot = (key * _BASE) >> self.shift
        met = self.way[slot]
        out = np.where(met == key, self.way_to[slot], np.int32(-1))
        wrong = np.flatnonzero((met != key) & (met != np.uint64(_ALL)))
        for _ in range(1, self.probes):
            if not len(wrong):
                break
            slot = (slot[wrong] if len(slot) != len(wrong) else slot) + np.uint64(1) & self.slots
            met = self.way[slot]
            hit = met == key[wrong]
            out[wrong[hit]] = self.way_to[slot[hit]]
            on = ~hit & (met != np.uint64(_ALL))
            wrong, slot = wrong[on], slot[on]
        return out

    def add(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Builds the lattices of words together, given by their places among the characters; the words' numbers."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        n, total = len(size), int(size.sum())
        # characters word by word, the longest word first, each with an end behind it
        wide = size + 1
        first = np.cumsum(wide) - wide
        char = np.full(total + n, self.end, np.uint32)
        inside = np.ones(total + n, bool)
        inside[first + size] = False
        own = codes[_ranges(start, size)]
        char[inside] = np.minimum(own, np.uint32(self.end))
        # nodes go by their distance from the word's end, so that those at equal distance lie together
        most = int(size[0]) if n else 0
        many = n - np.searchsorted(size[::-1], np.arange(1, most + 1))  # words of so many characters at least
        level = np.concatenate(([0], np.cumsum(many)))  # the first node of each distance, less one
        left = np.repeat(first + size, wide) - np.arange(total + n)
        new = (level[left - 1] + np.repeat(np.arange(n), wide)).astype(np.int32)
        new[~inside] = -1
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        degree = np.zeros(total, np.int32)
        state = self.first[char]
        at = np.flatnonzero(state >= 0).astype(np.int32)
        state = state[at]
        lone = inside
        k = 1
        while len(at):
            piece = self.state_piece[state]
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                where = at[hit]
                node = new[where]
                degree[node] += 1
                found.append((node, piece[hit], new[where + k]))
                if k == 1:
                    lone[where] = False
            on = np.flatnonzero(self.inner[state])
            at, state = at[on], state[on]
            state = self._step(state, char[at + k])
            on = np.flatnonzero(state >= 0)
            at, state = at[on], state[on]
            k += 1
        lone = np.flatnonzero(lone)
        spot = new[lone]
        degree[spot] += 1
        edge0 = np.zeros(total + 1, np.int32)
        np.cumsum(degree, out=edge0[1:])
        edges = int(edge0[-1])
        piece, to, of = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges, np.int32)
        free = edge0[:-1].copy()
        for node, p, then in reversed(found):  # a node's longest piece first, as it is mostly the likeliest
            e = free[node]
            free[node] = e + 1
            piece[e], to[e], of[e] = p, then, node
        del found
        e = free[spot]
        code = own[(lone - np.searchsorted(first, lone, side="right") + 1)].astype(np.int64)
        piece[e] = np.where(code < 128, self.of_byte[np.minimum(code, 127)], -code)
        to[e], of[e] = new[lone + 1], spot
        log = self.weights(piece)
        # backward: the log mass of all ways to the word's end, for nodes at equal distance from it at once
        mass = np.zeros(total + 1)
        chance = np.empty(edges)
        bounds = level.tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            lo, hi = int(edge0[a]), int(edge0[b])
            x = log[lo:hi]
            x += mass[to[lo:hi]]
            starts = edge0[a:b] - lo
            top = np.maximum.reduceat(x, starts)
            x -= np.repeat(top, degree[a:b])
            part = np.exp(x)
            whole = np.add.reduceat(part, starts)
            mass[a:b] = top + np.log(whole)
            np.divide(part, np.repeat(whole, degree[a:b]), out=chance[lo:hi])
        np.maximum(chance, 1e-300, out=chance)
        base, before = self.n_nodes, self.n_edges
        root = new[first]
        self._put("root", self.n_words, root + base)
        self._put("size", self.n_words, size)
        self._put("char0", self.n_words, first - np.arange(n) + self.n_chars)
        self._put("chars", self.n_chars, own)
        self._put("edge0", base, edge0 + before)
        self._put("chance", before, chance)
        self._put("node", before, of + base)
        self._put("piece", before, piece)
        self._put("to", before, np.where(to >= 0, to + base, -1))
        number = np.empty(n, np.int32)
        number[order] = np.arange(self.n_words, self.n_words + n, dtype=np.int32)
        self.n_words += n
        self.n_chars += total
        self.n_nodes += total
        self.n_edges += edges
        return number

    def _hash(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of words: sums over their characters, each times a number that stands for its place."""
        if len(self.places) < size.max():
            self.places = mix(np.arange(1, 2 * int(size.max()) + 1, dtype=np.uint64)) | np.uint64(1)
        x = self.places[_ranges(np.zeros(len(size), np.int32), size)]
        x *= codes
        return mix(np.add.reduceat(x, start) + size.astype(np.uint64) * _BASE)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words of the texts, and how many words each text has. Words known by their hash are compared by their characters."""
        if self.n_nodes > KEPT_NODES:
            self.reset()
        codes = np.frombuffer("".join([MARK + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        if not len(codes):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        codes[codes == 32] = ord(MARK)
        length = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        ends = np.cumsum(length)
        mark = codes == ord(MARK)
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        begins[(ends - length)[length > 0]] = True
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(codes)))
        if len(codes) < 1 << 31:
            start, size = start.astype(np.int32), size.astype(np.int32)
        words = np.diff(np.searchsorted(start, np.append(0, ends)))
        keys, one, which = np.unique(self._hash(codes, start, size), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        word = np.empty(len(keys), np.int32)
        word[known] = self.key_word[at[known]]
        if not known.all():
            fresh = np.flatnonzero(~known)
            word[fresh] = self.add(codes, start[one[fresh]], size[one[fresh]])
            merged = np.concatenate((self.keys, keys[fresh]))
            order = np.argsort(merged, kind="stable")
            self.keys, self.key_word = merged[order], np.concatenate((self.key_word, word[fresh]))[order]
        word = word[which]
        other = self.size[word] != size
        same = np.flatnonzero(~other)
        own = codes if len(same) == len(word) else codes[_ranges(start[same], size[same])]
        differs = self.chars[_ranges(self.char0[word[same]], size[same])] != own
        if differs.any():
            other[same] = np.logical_or.reduceat(differs, np.cumsum(size[same]) - size[same])
        if other.any():  # another word's hash: a lattice for this place alone
            word[other] = self.add(codes, start[other], size[other])
        return word, words

    def walk(self, node: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws edges from each node (none from -1) to its word's end: the edges of all walkers in order, and where each one's start (and the last one's end)."""
        alive, steps = np.flatnonzero(node >= 0).astype(np.int32), []
        at, base = node[alive], base[alive]
        size = np.zeros(len(node), np.int32)
        step = 0
        while len(alive):
            u = _unit(base, step)
            e = self.edge0[at]
            u -= self.chance[e]
            more = np.flatnonzero(u > 0)
            e_more, u_more, last = e[more], u[more], self.edge0[at[more] + 1] - 1
            on = np.flatnonzero(e_more < last)
            while len(on):
                more, e_more, u_more, last = more[on], e_more[on], u_more[on], last[on]
                e_more += 1
                u_more -= self.chance[e_more]
                e[more] = e_more
                on = np.flatnonzero((u_more > 0) & (e_more < last))
            steps.append((alive, e))
            step += 1
            nxt = self.to[e]
            go = np.flatnonzero(nxt >= 0)
            if len(go) < len(nxt):
                stay = np.flatnonzero(nxt < 0)
                size[alive[stay]] = step
                alive, at, base = alive[go], nxt[go], base[go]
            else:
                at = nxt
        start = np.zeros(len(node) + 1, np.int64)
        np.cumsum(size, out=start[1:])
        out = np.empty(int(start[-1]), np.int32)
        for i, (who, e) in enumerate(steps):
            out[start[who] + i] = e
        return out, start

    def edges_beside(self, edge: int) -> range:
        """All edges of the edge's node."""
        j = self.node[edge]
        return range(self.edge0[j], self.edge0[j + 1])

    def beside(self, edges: np.ndarray) -> np.ndarray:
        """For each edge the log chance of its node's other edges together, however small; none for a lone edge."""
        rest = 1 - self.chance[edges]
        out = np.full(len(edges), -np.inf)
        plain = rest >= SHARP
        out[plain] = np.log(rest[plain])
        sharp = np.flatnonzero(~plain)
        node = self.node[edges[sharp]]
        first = self.edge0[node]
        many = self.edge0[node + 1] - first
        several = np.flatnonzero(many > 1)
        if len(several):  # the others' own sum, as little is left of one less the chance
            sharp, first, many = sharp[several], first[several].astype(np.int64), many[several]
            own, total = edges[sharp], np.zeros(len(sharp))
            for i in range(int(many.max())):
                at = np.flatnonzero(many > i)
                e = first[at] + i
                total[at] += np.where(e != own[at], self.chance[e], 0.0)
            out[sharp] = np.log(total)
        return out

    def weights(self, pieces: np.ndarray) -> np.ndarray:
        """Of pieces, and of characters less than 0, which weigh as their bytes do."""
        out = self.weight[np.maximum(pieces, 0)]
        odd = np.flatnonzero(pieces < 0)
        out[odd] = self.byte_weight * _bytes_of(-pieces[odd])
        return out

    def ids(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids of pieces and of characters less than 0; and, if those have several, how many each has."""
        odd = np.flatnonzero(pieces < 0)
        if not len(odd):
            return pieces, None
        if not self.byte_id:
            out = pieces.copy()
            out[odd] = self.unk
            return out, None
        size = np.ones(len(pieces), np.int64)
        code = -pieces[odd]
        size[odd] = wide = _bytes_of(code)
        out = np.repeat(pieces, size)
        start = np.cumsum(size)[odd] - wide
        for i in range(4):
            has = np.flatnonzero(wide > i)
            six = code[has] >> 6 * (wide[has] - 1 - i)
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide[has]]
            out[start[has] + i] = self.of_byte[six | lead if i == 0 else six & 0x3F | 0x80]
        return out, size

    def decode(self, ids) -> str:
        ids = np.asarray(ids).tolist()
        parts = operator.itemgetter(*ids)(self.surface) if len(ids) > 1 else map(self.surface.__getitem__, ids)
        text = b"".join(parts).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def gives_back(self, ids: np.ndarray, start: np.ndarray, texts: list[str], of: np.ndarray) -> list[bool]:
        """Whether decoding the ids from each start to the next gives the text of that number (with spaces for space marks)."""
        size = self.shown_size[ids]
        long = np.zeros(len(start) - 1, np.int64)
        some = np.flatnonzero(np.diff(start))
        if len(some):
            long[some] = np.add.reduceat(size, start[some], dtype=np.int64)
        shown = self.shown[_ranges(self.shown_at[ids], size)].tobytes()
        plain = [t.replace(MARK, " ").encode("utf-8", "surrogatepass") for t in texts]
        out, a = [], 0
        for i, n in zip(of.tolist(), long.tolist(), strict=True):
            skip = n > 0 and shown[a] == 32
            out.append(n - skip == len(plain[i]) and shown.startswith(plain[i], a + skip))
            a += n
        return out


def _bytes_of(code: np.ndarray) -> np.ndarray:
    """How many bytes of UTF-8 characters have."""
    return 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)


@functools.lru_cache(maxsize=2)
def piece_model(path: str, alpha: float) -> PieceModel:
    return PieceModel(path, alpha)


class _Path:
    """A sampled path: all its edges; up to a step they are another path's, then come some of one word's, then sample ``n``'s draws from a walker on."""

    __slots__ = ("edges", "parent", "step", "word", "own", "walker", "n", "g", "shut")

    def __init__(self, edges, parent, step, word, own, walker, n, g, shut):
        self.edges, self.parent, self.step, self.word, self.own, self.walker, self.n, self.g, self.shut = edges, parent, step, word, own, walker, n, g, shut


def sample_paths(model: PieceModel, texts: list[str], seeds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text up to k distinct segmentations, best perturbed value first: (text, ids of all, where each one's start, log probability, perturbed value, log inclusion)."""
    word, words = model.of(texts)
    n_docs = len(texts)
    roots = model.root[word]
    last_word = np.cumsum(words)
    first_word = last_word - words
    doc = np.repeat(np.arange(n_docs), words)
    place = np.arange(len(roots)) - np.repeat(first_word, words)
    at_place = seeds[doc] + (place.astype(np.uint64) + np.uint64(1)) * _BASE
    later = np.where(place > 0, roots, -1)  # no other path than the first begins with a whole first word
    drawn = [model.walk(later if n else roots, _scramble(at_place + np.uint64(n))) for n in range(k)]
    top = -np.log(-np.log(_unit(seeds, 1 << 40)))
    seed_of, word_0, word_1, top_of = seeds.tolist(), first_word.tolist(), last_word.tolist(), top.tolist()
    edges, starts = drawn[0]
    cut = starts[np.append(first_word, len(roots))].tolist()
    paths = [[_Path(edges[cut[d] : cut[d + 1]], None, 0, 0, 0, word_0[d], 0, top_of[d], frozenset())] for d in range(n_docs)]
    #: Of each text, the best k + 1 values that wait, with the path and the step they leave.
    wait_g, wait_path, wait_step = np.full((n_docs, k + 1), -np.inf), np.zeros((n_docs, k + 1), np.int32), np.zeros((n_docs, k + 1), np.int64)

    def keep(docs: np.ndarray, g: np.ndarray, which: int, step: np.ndarray) -> None:
        g = np.concatenate((wait_g[docs], g), 1)
        path = np.concatenate((wait_path[docs], np.full(step.shape, which, np.int32)), 1)
        step = np.concatenate((wait_step[docs], step), 1)
        best = np.argpartition(g, g.shape[1] - k - 1, axis=1)[:, g.shape[1] - k - 1 :]
        wait_g[docs], wait_path[docs], wait_step[docs] = (np.take_along_axis(x, best, 1) for x in (g, path, step))

    def free(path: _Path) -> float:
        """The log chance of what isn't shut where the path leaves another."""
        own = int(path.edges[path.step])
        beside = model.edges_beside(own)
        rest = sum(c for e, c in zip(beside, model.chance[beside.start : beside.stop].tolist(), strict=True) if e != own and e not in path.shut)
        return math.log(rest) if rest else -math.inf

    def values(of: np.ndarray, g: np.ndarray, phi: np.ndarray, at: np.ndarray, which: int) -> np.ndarray:
        """Of nodes on paths whose values are g, what they leave aside gets, given its log mass and place: truncated Gumbels."""
        return phi - np.log(np.exp(np.minimum(phi - g, 700)) - np.log(_unit_at(seeds[of], at, which)))

    near = max(NEAR, k + 1)

    def open_up(docs: list[int], which: int) -> None:
        """Lets what the texts' paths leave aside wait: at each of their new steps the best of the other edges' values.

        Steps go in parts, until not even the luckiest draw of a later one could be among a text's k + 1 best. After the first part, only steps
        are looked at whose draw suffices if the other edges had all the mass that the path had left."""
        at = [paths[d][which] for d in docs]
        of, top_g = np.array(docs), np.array([p.g for p in at])
        begin, end = np.array([p.step for p in at]), np.array([len(p.edges) for p in at])
        before = np.zeros(len(at))
        if which:
            before[:] = [float(np.log(model.chance[p.edges[: p.step]]).sum()) for p in at]
        part = near
        while len(at):
            size = np.minimum(end - begin, part)
            flat = np.concatenate([p.edges[i : i + part] for p, i in zip(at, begin.tolist(), strict=True)])
            last = np.cumsum(size)
            here = np.repeat(np.arange(len(at)), size)
            log = model.chance[flat]
            np.log(log, out=log)
            sums = np.cumsum(log)
            left = sums - log  # the log mass that the path still has before the step
            left += (before - left[last - size])[here]
            place = np.arange(len(flat)) + (begin - last + size)[here]
            if part == near:
                rest = model.beside(flat)
                if which:
                    rest[last - size] = [free(p) for p in at]
                some = np.flatnonzero(rest > -np.inf)
                rest = rest[some]
            else:
                short = left - least[here]
                some = np.flatnonzero(short >= -_LIFT)
                lucky = 1 - _unit_at(seeds[of][here[some]], place[some], which) <= np.exp(np.minimum(short[some] + 0.01, 1))
                some = some[lucky]
                rest = model.beside(flat[some])
                some, rest = some[rest > -np.inf], rest[rest > -np.inf]
            if len(some):
                row = here[some]
                g = values(of[row], top_g[row], left[some] + rest, place[some], which)
                first = np.searchsorted(row, np.arange(len(at) + 1))
                column = np.arange(len(row)) - first[row]
                wide = np.full((len(at), int(column.max()) + 1), -np.inf)
                step = np.zeros(wide.shape, np.int64)
                wide[row, column], step[row, column] = g, place[some]
                keep(of, wide, which, step)
            before = left[last - 1] + log[last - 1]
            begin = begin + size
            least = wait_g[of].min(1)
            on = np.flatnonzero((begin < end) & (before + _LIFT >= least))
            at, of, top_g, begin, end, before, least = [at[i] for i in on.tolist()], of[on], top_g[on], begin[on], end[on], before[on], least[on]
            part = STEPS

    def word_at(d: int, which: int, step: int) -> int:
        """The word (among all) that a step of a path lies in."""
        p = paths[d][which]
        while step < p.step:
            p = p.parent
        if step < p.step + p.own:
            return p.word
        begin = drawn[p.n][1][p.walker : word_1[d] + 1]
        return p.walker + int(np.searchsorted(begin, step - p.step - p.own + begin[0], side="right")) - 1

    going = [d for d in range(n_docs) if cut[d + 1] > cut[d]]
    for n in range(1, k + 1):
        if going:
            open_up(going, n - 1)
        if n == k:
            break
        best = wait_g.argmax(1)
        rows = np.arange(n_docs)
        value, left, step_of = (x[rows, best].tolist() for x in (wait_g, wait_path, wait_step))
        wait_g[rows, best] = np.where(np.isin(rows, going), -np.inf, wait_g[rows, best])
        new = []
        for d in going:
            if value[d] == -math.inf:
                continue
            step, p = step_of[d], paths[d][left[d]]
            own = int(p.edges[step])
            shut = (p.shut if step == p.step else frozenset()) | {own}
            beside = model.edges_beside(own)
            others, mass, total = [], [], 0.0
            for e, c in zip(beside, model.chance[beside.start : beside.stop].tolist(), strict=True):
                if e not in shut:
                    total += c
                    others.append(e)
                    mass.append(total)
            if not others:
                continue
            e = others[min(len(others) - 1, bisect.bisect_left(mass, _unit_of(seed_of[d], step, n, 1 << 42) * total))]
            new.append((d, p, step, e, word_at(d, left[d], step), shut))
        # the rest of the words in which they leave
        here = model.to[np.array([x[3] for x in new], np.int64)]
        inner = np.flatnonzero(here >= 0)
        spot = np.array([x[4] for x in new], np.int64)[inner]
        rest, rest_at = model.walk(here[inner], _scramble(at_place[spot] + np.uint64(n)))
        tail = [rest[:0]] * len(new)
        for i, a, b in zip(inner.tolist(), rest_at[:-1].tolist(), rest_at[1:].tolist(), strict=True):
            tail[i] = rest[a:b]
        edges, starts = drawn[n]
        for (d, p, step, e, at, shut), some in zip(new, tail, strict=True):
            joined = np.concatenate((p.edges[:step], np.array([e], np.int32), some, edges[starts[at + 1] : starts[word_1[d]]]))
            paths[d].append(_Path(joined, p, step, at, 1 + len(some), at + 1, n, value[d], shut))
        going = [x[0] for x in new]

    limit = wait_g.max(1)
    every = [p for own in paths for p in sorted(own, key=lambda p: -p.g)]
    doc = np.repeat(np.arange(n_docs), [len(own) for own in paths])
    start = np.concatenate(([0], np.cumsum([len(p.edges) for p in every])))
    edges = np.concatenate([p.edges for p in every]) if every else np.empty(0, np.int32)
    value = np.array([p.g for p in every])
    del paths, drawn, every
    some = np.diff(start) > 0
    logp = np.zeros(len(doc))
    if some.any():
        log = model.chance[edges]
        logp[some] = np.add.reduceat(np.log(log, out=log), start[:-1][some])
    x = logp - limit[doc]
    with np.errstate(over="ignore", divide="ignore"):
        log_in = np.where(x > 30, 0.0, np.where(x > -30, np.log(-np.expm1(-np.exp(np.minimum(x, 31)))), x))
    ids, size = model.ids(model.piece[edges])
    if size is not None:
        start = np.concatenate(([0], np.cumsum(size)))[start]
    return doc, ids, start, logp, value, log_in


def sample_texts(model: PieceModel, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations, best perturbed value first: (ids, log probability, perturbed value, log inclusion)."""
    doc, ids, start, *values = sample_paths(model, texts, seeds, k)
    out: list[list[tuple[np.ndarray, float, float, float]]] = [[] for _ in texts]
    for i, (d, *row) in enumerate(zip(doc.tolist(), *(x.tolist() for x in values), strict=True)):
        out[d].append((ids[start[i] : start[i + 1]].astype(np.uint32), *row))
    return out


def sample_segmentations(docs: DataFrame, model_path: str, k: int = 2, alpha: float = 1.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(doc_id, sample, n_ids, ids_crc32, log_prob, perturbed, log_inclusion, round_trip[, ids])``, up to k rows for each row of ``docs``.

    Samples of a row are distinct and go by perturbed value, from 0; a text with fewer segmentations has fewer. Log probabilities are those of the
    segmentation among all of its text. ``log_inclusion`` is the logarithm of the chance to be among the k, given the threshold.
    ``round_trip`` tells whether decoding gives the text (with spaces for space marks).

    Null and empty texts have one sample without ids. Rows that repeat id and text get the same samples; a null id seeds as 0 does and stays
    null. An empty table gives no rows. Other columns are ignored.
    """
    schema = "doc_id long, sample int, n_ids int, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path, alpha)

        def emit(keys: list[int | None], texts: list[str]) -> pa.RecordBatch:
            seeds = np.array([xxhash.xxh3_64_intdigest(f"{d or 0}", seed=seed) for d in keys], np.uint64)
            doc, ids, start, logp, g, log_in = sample_paths(model, texts, seeds, k)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
            sample = np.arange(len(doc)) - np.searchsorted(doc, doc)
            columns = [pa.array(keys, pa.int64()).take(pa.array(doc)), sample.astype(np.int32), np.diff(start).astype(np.int32), pa.array(crc, pa.int64()), logp, g, log_in]
            columns.append(pa.array(model.gives_back(ids, start, texts, doc), pa.bool_()))
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(ids)))
            return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=names)

        for batch in batches:
            keys, texts, size = [], [], 0
            for d, text in zip(*batch.columns, strict=True):
                keys.append(d.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > TOGETHER:
                    yield emit(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield emit(keys, texts)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode_segmentations(rows: DataFrame, model_path: str, ids_col: str = "ids", column: str = "decoded") -> DataFrame:
    """``rows`` with the text of each row's ids; null ids give a null text."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        model = piece_model(model_path, 1.0)
        return pd.Series([None if x is None else model.decode(x) for x in ids], dtype="object")

    return rows.withColumn(column, decode(F.col(ids_col)))
