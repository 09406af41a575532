"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

A text's segmentations form a lattice: nodes are character positions, edges are vocabulary pieces (bytes where a character
is no piece).  An edge weighs -alpha * log(rank of the piece), and backward sums turn weights into a local distribution at each
node, so a segmentation's log probability is the sum over its edges.  Perturbed A* draws the k segmentations with the largest
Gumbel-perturbed log probabilities, which is a sample of k without replacement: the search holds, for every node of the
paths found, the perturbed value of the best segmentation that leaves the path there (the maximum of the edges not yet
taken, a Gumbel truncated at the path's own value) and expands the largest.  A sample's inclusion score
is log(1 - exp(-exp(log_prob - threshold))), the log probability of exceeding the next value in the queue.

Pieces never cross a space or a line break, so the lattice splits into chunks; a task adds the new chunks of some whole texts
at once (numpy) to a lattice of distinct chunks and samples all their occurrences together; a lattice that grew too large
is begun anew.  Random numbers hash the row key, sample, chunk and step, so results do not depend on batches.

Defined cases: null text has no samples; the empty text has one, the empty segmentation, with inclusion score 0; a text with
fewer than k segmentations gives all of them; rows with equal keys and texts give equal samples; an empty table gives an empty
result; other columns are ignored.  The vocabulary is read on each executor from ``model``, a path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewire.llm.common import text_key

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K = 2
ALPHA = 1.0
SEED = 11
SPACE = "▁"
CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
CUT = "\x01"
TASK_CHARS = 400_000  # whole texts handled together; a longer text is handled alone
PART_ROWS = 1000      # rows whose results a task holds
NODES = 300_000       # a task's lattice is begun anew beyond them
NEAR = 192            # places of a path looked at first
NONE = -2
LOW = 2.0 ** -300       # sums below it are scaled up
ONE = 1 << 30           # a node's probabilities, in integers
GAMMA = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
SAMPLE = "sample:int,n_pieces:bigint,log_prob:double,perturbed:double,log_inclusion:double,"
FULL_TYPE = f"array<struct<{SAMPLE}ids:array<int>>>"
PACKED_TYPE = f"array<struct<{SAMPLE}ids:binary>>"
DIGEST_TYPE = f"array<struct<{SAMPLE}ids:binary,round_trip:boolean>>"


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _draw(key: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from 64-bit keys."""
    return ((_mix(key) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


class Vocabulary:
    """Pieces, their weights, and a hash table from substrings (polynomial hash of code points) to pieces and to prefixes of
    pieces (-1)."""

    def __init__(self, model: str, alpha: float):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.byte_of, texts = {}, {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_of[int(p[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                texts[i] = p
        self.weight = np.full(n, -alpha * np.log(n + 1.0))
        for rank, i in enumerate(sorted(texts, key=lambda i: (-sp.get_score(i), i)), 1):
            self.weight[i] = -alpha * np.log(rank + 1.0)
        self.byte_weight = -alpha * np.log(n + 1.0)
        self.prob = np.exp(self.weight)
        self.raw = np.empty(n, dtype=object)
        self.raw[:] = b""
        for b, i in self.byte_of.items():
            self.raw[i] = bytes([b])
        for i, p in texts.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        self.longest = max(map(len, texts.values()))
        self.bits = 18
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, NONE, np.int32)
        entries: dict[int, tuple[str, int]] = {}
        for i, p in texts.items():
            h = 0
            for at, c in enumerate(p, 1):
                h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                known, piece = entries.setdefault(h, (p[:at], -1))
                assert known == p[:at], "two strings with one hash"
                if at == len(p):
                    entries[h] = (p, i)
        assert len(entries) < 1 << (self.bits - 1), "too many pieces for the hash table"
        for h, (_, i) in entries.items():
            slot = (h * int(GAMMA) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while self.ids[slot] != NONE:
                slot = (slot + 1) % (1 << self.bits)
            self.keys[slot], self.ids[slot] = h, i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 if only a prefix of pieces has it, NONE if nothing has."""
        slot = (h * GAMMA >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.ids[slot]
        live = np.flatnonzero((self.keys[slot] != h) & (out != NONE))
        out[live] = NONE
        slot = slot[live]
        while len(live):
            slot = (slot + 1) % (1 << self.bits)
            got = self.ids[slot]
            same = (got != NONE) & (self.keys[slot] == h[live])
            out[live[same]] = got[same]
            go = (got != NONE) & ~same
            live, slot = live[go], slot[go]
        return out


@lru_cache(maxsize=2)
def vocabulary(model: str, alpha: float) -> Vocabulary:
    return Vocabulary(model, alpha)


class Lattice:
    """Lattice of distinct chunks: a node per character and one at each chunk's end; edges by node, the longest piece first.
    The arrays have room at their ends."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.start_of, self.end_of, self.first, self.src, self.dst, self.piece, self.cdf = (
            np.zeros(0, np.int32) for _ in range(7))
        self.codes, self.options = np.zeros(0, np.uint32), np.zeros(0, np.int16)
        self.share, self.log_share = np.zeros(0), np.zeros(0)

    def _put(self, at: int, **parts: np.ndarray) -> None:
        for name, x in parts.items():
            old = getattr(self, name)
            if at + len(x) > len(old):
                new = np.empty(at + len(x) + at // 4, old.dtype)
                new[:at] = old[:at]
                setattr(self, name, new)
            getattr(self, name)[at:at + len(x)] = x

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """Numbers of chunks, new ones added."""
        out = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        miss = np.flatnonzero(out < 0)
        if len(miss):
            words = [chunks[i] for i in miss.tolist()]
            new = list(dict.fromkeys(words))
            self.number.update(zip(new, count(len(self.number))))
            self._add(new)
            out[miss] = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return out

    def _add(self, chunks: list[str]) -> None:
        vocab = self.vocab
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        end = np.cumsum(size + 1) - 1
        n = int(size.sum()) + len(chunks)
        left = np.repeat(end, size + 1) - np.arange(n)  # characters to the chunk's end
        at = np.flatnonzero(left > 0)
        codes = np.zeros(n, np.uint32)
        codes[at] = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        found, h = [], np.zeros(len(at), np.uint64)
        options = np.zeros(n, np.int16)
        for length in range(1, vocab.longest + 1):
            if length > 1:
                fit = left[at] >= length
                at, h = at[fit], h[fit]
            if not len(at):
                break
            h = h * BASE + codes[at + length - 1] + np.uint64(1)
            got = vocab.find(h)
            yes = np.flatnonzero(got >= 0)
            found.append((at[yes], length, got[yes], vocab.prob[got[yes]]))
            if length == 1 and len(yes) < len(at):  # bytes: the id of an ASCII character's byte, else -1
                no = at[got < 0]
                c = codes[no].astype(np.int64)
                n_bytes = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                ids = np.array([vocab.byte_of[x] if x < 0x80 else -1 for x in c.tolist()], np.int32)
                found.append((no, 1, ids, np.exp(n_bytes * vocab.byte_weight)))
            more = np.flatnonzero(got != NONE)
            at, h = at[more], h[more]
        for places, _, _, _ in found:
            options[places] += 1
        first = np.cumsum(options, dtype=np.int64) - options
        src = np.repeat(np.arange(n), options)
        dst, piece, prob = np.empty_like(src), np.empty(len(src), np.int32), np.empty(len(src))
        free = first.copy()
        for places, length, got, p in reversed(found):
            slot = free[places]
            dst[slot], piece[slot], prob[slot] = places + length, got, p
            free[places] += 1
        # Backward sums, one level of equal distance to the end after another: sum = mass * 2**-scale.
        mass, scale = np.ones(n), np.zeros(n, np.int64)
        far = left[src]
        by = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 65536 else far, kind="stable")
        cuts = np.searchsorted(far[by], np.arange(1, int(left.max(initial=0)) + 2))
        s_by, d_by, w_by = src[by], dst[by], prob[by]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, d = s_by[lo:hi], d_by[lo:hi]
            head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            node, v = s[head], w_by[lo:hi] * mass[d]
            up = scale[node + 1]
            if up.any():
                v = np.ldexp(v, scale[s + 1] - scale[d])
            total = np.add.reduceat(v, head)
            low = total < LOW
            if low.any():
                total, up = np.where(low, total / LOW, total), up + 300 * low
            mass[node], scale[node] = total, up
        share = prob * mass[dst] / mass[src]
        if scale.any():
            share = np.ldexp(share, scale[src] - scale[dst])
        # Distributions at each node; drawn from in integers, so a draw does not depend on what else is in the lattice.
        run = np.cumsum(np.rint(share * ONE).astype(np.int64))
        cdf = run - np.concatenate(([0], run))[first[src]]
        cdf[(first + options - 1)[options > 0]] = ONE
        self._put(len(self.number) - len(chunks), start_of=end - size + self.nodes, end_of=end + self.nodes)
        self._put(self.nodes, codes=codes, options=options, first=first + self.edges)
        self._put(self.edges, src=src + self.nodes, dst=dst + self.nodes, piece=piece, share=share,
                  log_share=np.minimum(np.log(share), 0.0), cdf=np.minimum(cdf, ONE))
        self.nodes, self.edges = self.nodes + n, self.edges + len(src)

    def edges_of(self, node: int) -> range:
        return range(int(self.first[node]), int(self.first[node] + self.options[node]))

    def walk(self, node: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled edges from each node to its chunk's end: (edges in walk order, edges per walk)."""
        live, step = np.flatnonzero(node < end), 0
        at, parts, count = node[live], [], np.zeros(len(node), np.int64)
        while len(live):
            with np.errstate(over="ignore"):
                u = (_draw(key[live] + np.uint64(step + 1) * GAMMA) * ONE).astype(np.int32)
            e = self.first[at]
            more = np.flatnonzero(self.cdf[e] <= u)
            while len(more):
                e[more] += 1
                more = more[self.cdf[e[more]] <= u[more]]
            parts.append((live, e))
            count[live] += 1
            at = self.dst[e]
            go = at < end[live]
            live, at, step = live[go], at[go], step + 1
        out, offset = np.empty(int(count.sum()), np.int64), np.cumsum(count) - count
        for step, (who, e) in enumerate(parts):
            out[offset[who] + step] = e
        return out, count


class _Path:
    """One sampled segmentation of a text and the queue of the places where others may leave it."""

    def __init__(self, edges, chunk, log_prob, value, branch=-1, taken=()):
        self.edges, self.chunk, self.log_prob, self.value = edges, chunk, log_prob, value
        self.queue, self.branch, self.taken = np.zeros(0), branch, taken

    def alternatives(self, at: int) -> list[int]:
        """Edges already taken at place ``at`` by this path and those it left."""
        return self.taken if at == self.branch else [int(self.edges[at])]


def _truncated(loc: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels at ``loc`` given that they are below ``top``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        v = loc - np.log(np.exp(np.minimum(loc - top, 700.0)) - np.log(u))
    return np.where(np.isneginf(loc), -np.inf, np.minimum(v, top))


def _fill_queues(lat: Lattice, paths: list[_Path], keys: np.ndarray, sample: int, k: int) -> None:
    """A path's queue holds its places up to where no later one can be among the k + 1 largest values: a place's value is
    at most the log probability of the way to it plus 38 (the largest Gumbel that 53 random bits make).  The paths go
    together, the same number of places of each; those that need more go again with four times as many."""
    todo, stop = np.arange(len(paths)), NEAR
    lengths = np.array([len(p.edges) for p in paths])
    while len(todo):
        own = [paths[i] for i in todo.tolist()]
        size = np.minimum(lengths[todo], stop)
        width = int(size.max())
        place = np.arange(width)
        real = place < size[:, None]
        edges = np.zeros(real.shape, np.int64)
        edges[real] = np.concatenate([p.edges[:stop] for p in own])
        logp = np.where(real, lat.log_share[edges], 0.0)
        total = np.cumsum(logp, axis=1)
        before = total - logp
        with np.errstate(divide="ignore", over="ignore"):
            loc = before + np.log(-np.expm1(logp))
            loc[~real | (lat.options[lat.src[edges]] == 1)] = -np.inf
            for row, p in enumerate(own):
                if p.branch >= 0:
                    loc[row, :p.branch] = -np.inf
                    if p.branch < size[row]:
                        rest = 1.0 - float(lat.share[p.taken].sum())
                        more = lat.options[lat.src[p.edges[p.branch]]] > len(p.taken) and rest > 1e-12
                        loc[row, p.branch] = before[row, p.branch] + np.log(rest) if more else -np.inf
            u = _draw(keys[todo][:, None] + place.astype(np.uint64) * GAMMA + np.uint64(sample + 1) * BASE)
        queue = _truncated(loc, np.array([p.value for p in own])[:, None], u)
        enough = size == lengths[todo]
        if width > k:
            enough |= np.partition(queue, -k - 1, axis=1)[:, -k - 1] > total[:, -1] + 38
        for row in np.flatnonzero(enough).tolist():
            own[row].queue = queue[row, :size[row]].copy()
        todo, stop = todo[~enough], stop * 4


def _path(lat: Lattice, edges, chunk, value: float, branch: int = -1, taken: list[int] = ()) -> _Path:
    return _Path(edges, chunk, float(np.cumsum(lat.log_share[edges])[-1]), value, branch, taken)


def _inclusion(log_prob: float, threshold: float) -> float:
    gap = log_prob - threshold
    return gap if gap < -30 else float(np.log(-np.expm1(-np.exp(min(gap, 30.0)))))


def _numbered(lat: Lattice, texts: list[str]) -> list[np.ndarray]:
    """Chunk numbers of each text, as CHUNK finds them.  Most texts have single spaces and no mark of their own; there each
    space and line break begins a chunk, so they are cut and their chunks are looked up all together."""
    out: list = [None] * len(texts)
    plain = [i for i, t in enumerate(texts) if t[0] != " " and "  " not in t and SPACE not in t and CUT not in t]
    if plain:
        cut = pc.split_pattern(pa.array([(SPACE + texts[i].replace(" ", CUT + SPACE)).replace("\n", f"{CUT}\n{CUT}")
                                         for i in plain], pa.large_string()), CUT)
        coded = cut.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes, bounds = coded.indices.to_numpy(), cut.offsets.to_numpy()
        if "" in words:  # beside line breaks
            full = codes != words.index("")
            codes, bounds = codes[full], np.concatenate(([0], np.cumsum(full)))[bounds]
        known = lat.numbers([w for w in words if w])
        if len(known) < len(words):
            known = np.insert(known, words.index(""), -1)
        chunks = known[codes]
        for i, lo, hi in zip(plain, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = chunks[lo:hi]
    for i, t in enumerate(texts):
        if out[i] is None:
            out[i] = lat.numbers(CHUNK.findall(SPACE + t.replace(" ", SPACE)))
    return out


def sample_texts(lat: Lattice, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[_Path, float]]]:
    """For each non-empty text its samples in falling perturbed value, each with its inclusion score."""
    docs = _numbered(lat, texts)
    keys = _mix(keys.astype(np.uint64) + GAMMA)

    def sampled(jobs):
        """jobs: (key, sample, chunks, first chunk's place, node to start at or None) -> edges and chunk places of each."""
        sizes = np.array([len(j[2]) for j in jobs])
        job, cut = np.repeat(np.arange(len(jobs)), sizes), np.cumsum(sizes)
        chunks = np.concatenate([j[2] for j in jobs])
        place = np.arange(len(chunks)) + np.array([j[3] for j in jobs])[job] - (cut - sizes)[job]
        with np.errstate(over="ignore"):
            key = _mix(np.array([j[0] for j in jobs], np.uint64)[job] + place.astype(np.uint64) * GAMMA
                       + np.array([j[1] for j in jobs], np.uint64)[job] * BASE)
        node = lat.start_of[chunks]
        for at, j in zip((cut - sizes).tolist(), jobs, strict=True):
            if j[4] is not None:
                node[at] = j[4]
        edges, count = lat.walk(node, lat.end_of[chunks], key)
        places, stop = np.repeat(place, count), np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], cut))].tolist()
        for lo, hi in zip(stop[:-1], stop[1:], strict=True):
            yield edges[lo:hi], places[lo:hi]

    with np.errstate(over="ignore"):
        top = -np.log(-np.log(_draw(keys + np.uint64(3))))
    jobs = [(keys[i], 0, docs[i], 0, None) for i in range(len(docs))]
    paths = [[_path(lat, e, c, float(top[i]))] for i, (e, c) in enumerate(sampled(jobs))]
    _fill_queues(lat, [p for p, in paths], keys, 0, k)
    for s in range(1, k):
        jobs, heads = [], []
        for i, own in enumerate(paths):
            at = [int(p.queue.argmax()) if len(p.queue) else -1 for p in own]
            j = max(range(len(own)), key=lambda j: own[j].queue[at[j]] if at[j] >= 0 else -np.inf)
            if len(own) < s or at[j] < 0 or np.isneginf(own[j].queue[at[j]]):
                continue
            p, place = own[j], at[j]
            taken, node = p.alternatives(place), int(lat.src[p.edges[place]])
            options = [e for e in lat.edges_of(node) if e not in taken]
            weight = lat.share[options]
            with np.errstate(over="ignore"):
                u = float(_draw(np.array([keys[i] + np.uint64(place) * BASE + np.uint64(s) * GAMMA]))[0])
            edge = options[int(min(np.searchsorted(np.cumsum(weight), u * weight.sum(), "right"), len(options) - 1))]
            value, p.queue[place] = float(p.queue[place]), -np.inf
            chunk = int(p.chunk[place])
            jobs.append((keys[i], s, docs[i][chunk:], chunk, int(lat.dst[edge])))
            heads.append((i, np.append(p.edges[:place], edge), p.chunk[:place + 1], value, place, [*taken, edge]))
        if not jobs:
            break
        for (i, head, places, value, place, taken), (e, c) in zip(heads, sampled(jobs), strict=True):
            paths[i].append(_path(lat, np.concatenate((head, e)), np.concatenate((places, c)), value, place, taken))
        _fill_queues(lat, [paths[h[0]][-1] for h in heads], keys[[h[0] for h in heads]], s, k)
    out = []
    for own in paths:
        threshold = max((float(p.queue.max()) if len(p.queue) else -np.inf for p in own), default=-np.inf)
        out.append([(p, _inclusion(p.log_prob, threshold) if np.isfinite(threshold) else 0.0) for p in own])
    return out


def piece_ids(vocab: Vocabulary, lat: Lattice, edges: np.ndarray) -> np.ndarray:
    """Ids of a path; a character without a piece becomes the ids of its bytes."""
    ids = lat.piece[edges]
    if (ids >= 0).all():
        return ids.astype(np.int32)
    out: list[int] = []
    for e, i in zip(edges.tolist(), ids.tolist(), strict=True):
        out.extend([i] if i >= 0 else [vocab.byte_of[b] for b in chr(int(lat.codes[lat.src[e]])).encode("utf-8", "surrogatepass")])
    return np.array(out, np.int32)


def decode_ids(vocab: Vocabulary, ids) -> str:
    """Text of a sequence of ids: pieces joined, the leading space of the encoding cut, broken bytes replaced."""
    raw = b"".join(vocab.raw[np.asarray(ids, np.int64)].tolist()).decode("utf-8", "replace")
    return raw[1:] if raw.startswith(" ") else raw


def _rows(texts: list[str | None], keys: np.ndarray, lat: Lattice, k: int, form: str) -> list:
    vocab = lat.vocab
    out: list = [None if t is None else [] for t in texts]
    full = [i for i, t in enumerate(texts) if t]
    for i, t in enumerate(texts):
        if t == "":
            out[i] = [(1, 0, 0.0, 0.0, 0.0, *{"digest": (b"", True), "packed": (b"",), "list": ([],)}[form])]
    at = 0
    while at < len(full):
        to, chars = at, 0
        while to < len(full) and (to == at or chars + len(texts[full[to]]) <= TASK_CHARS):
            chars, to = chars + len(texts[full[to]]), to + 1
        part = full[at:to]
        found = sample_texts(lat, [texts[i] for i in part], keys[part], k)
        for i, samples in zip(part, found, strict=True):
            for s, (p, score) in enumerate(samples, 1):
                ids = piece_ids(vocab, lat, p.edges)
                if form == "digest":
                    last = ids.astype("<i4").tobytes(), decode_ids(vocab, ids) == texts[i].replace(SPACE, " ")
                else:
                    last = (ids.astype("<i4").tobytes() if form == "packed" else ids.tolist(),)
                out[i].append((s, len(ids), p.log_prob, p.value, score, *last))
        if lat.nodes > NODES:
            lat.clear()
        at = to
    return out


def _udf(model: str, k: int, alpha: float, form: str):
    names = [f.split(":")[0] for f in SAMPLE.strip(",").split(",")] + ["ids"] + ["round_trip"] * (form == "digest")

    @F.pandas_udf({"digest": DIGEST_TYPE, "packed": PACKED_TYPE, "list": FULL_TYPE}[form])
    def sample(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        lat = Lattice(vocabulary(model, alpha))
        for text, key in batches:
            texts, keys = text.tolist(), key.to_numpy(np.int64).view(np.uint64)
            for at in range(0, max(len(texts), 1), PART_ROWS):  # a batch's results leave in parts: all at once they take the most memory
                rows = _rows(texts[at:at + PART_ROWS], keys[at:at + PART_ROWS], lat, k, form)
                yield pd.Series([None if r is None else [dict(zip(names, x, strict=True)) for x in r] for r in rows], dtype=object)
    return sample


def sample_segmentations(docs: DataFrame, k: int = K, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED,
                         id_col: str = "doc_id", text_col: str = "text", form: str = "list", copy_col: str | None = None) -> DataFrame:
    """doc_id, samples: array of (sample, n_pieces, log_prob, perturbed, log_inclusion, ids), the largest perturbed value
    first.  ``form``: ids as a "list", "packed" as little-endian 32-bit integers, or "digest" (packed, and ``round_trip``:
    whether they decode to the text).  ``copy_col`` numbers rows of one id from 1: later copies draw samples of their own."""
    key = F.xxhash64(F.col(id_col), F.lit(seed))
    if copy_col:
        key = F.when(F.col(copy_col) == 1, key).otherwise(F.xxhash64(F.col(id_col), F.lit(seed), F.col(copy_col)))
    return docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias("copy") for c in [copy_col] if c], _udf(model, k, alpha, form)(
        F.col(text_col).cast("string"), key).alias("samples"))


def sample_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document, copy and sample: doc_id, copy, sample, n_pieces, log_prob, perturbed, log_inclusion, ids (packed).
    Rows equal in id and text are copies, numbered from 1, each with samples of its own."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("tkey"))
    d = d.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "tkey").orderBy("tkey")))
    d = sample_segmentations(d, form="packed", copy_col="copy", **options)
    # An outer generator: a plain one makes the optimiser filter on size(samples), which samples every text twice.
    return d.select("doc_id", "copy", F.explode_outer("samples").alias("s")).where(F.col("s").isNotNull()).select("doc_id", "copy", "s.*")


def unpacked(ids: str = "ids") -> Column:
    """Packed ids as an array of integers."""
    digits = F.hex(F.col(ids))
    at = F.sequence(F.lit(0), F.floor(F.length(ids) / 4).cast("int") - 1)
    made = F.transform(at, lambda i: F.conv(F.concat(*[F.substring(digits, i * 8 + b, F.lit(2)) for b in (7, 5, 3, 1)]), 16, 10).cast("int"))
    return F.when(F.length(ids) > 0, made).when(F.col(ids).isNotNull(), F.array().cast("array<int>"))


def sample_digests(docs: DataFrame, **options) -> DataFrame:
    """One row per document and sample: doc_id, sample, n_pieces, log_prob, perturbed, log_inclusion, ids_crc32, round_trip, ids
    (packed; the CRC-32 is theirs)."""
    d = sample_segmentations(docs, form="digest", **options)
    # An outer generator: a plain one makes the optimiser filter on size(samples), which samples every text twice.
    return d.select("doc_id", F.explode_outer("samples").alias("s")).where(F.col("s").isNotNull()).select(
        "doc_id", *[f"s.{c}" for c in ("sample", "n_pieces", "log_prob", "perturbed", "log_inclusion")],
        F.crc32("s.ids").alias("ids_crc32"), "s.round_trip", "s.ids")


def decode(rows: DataFrame, ids_col: str = "ids", model: str = MODEL, alpha: float = ALPHA, out: str = "text") -> DataFrame:
    """Adds the text of an array of ids; null ids give null."""
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(model, alpha)
        for b in batches:
            yield pd.Series([None if x is None else decode_ids(vocab, x) for x in b], dtype=object)
    return rows.withColumn(out, text(F.col(ids_col)))
