"""SentencePiece encoding and decoding with the N best segmentations.

A unit of text spans a lattice whose arcs are vocabulary pieces. Forward Viterbi gives every position the least cost from
the start; read backwards, that is the exact remaining cost, so an A* search from the end with it as heuristic completes
segmentations in order of cost and expands nothing that is not on one of them. Every unit is segmented by that search. No
piece holds a space (U+2581) or a line break past its first sign, so a text's lattice is a chain of its units' lattices:
the text's N best are the N least sums of its units' alternatives, found exactly from the N - 1 units that lose least, and
all N are returned, ids and scores, the best one first.

A unigram model's costs are its negated scores. A BPE model has ranks instead of scores; there a piece of rank r costs
ln(r + 2) + ln(sum of 1 / (s + 2) over all ranks s), its log-probability under Zipf's law, and PIECE_COST on top, which prefers
fewer pieces as merging does. Longer pieces that a model marks as
unusable by a score of -1e8 or less take no part. Costs are integers (2^-20), so sums are exact and ties certain; they go
to the longer last piece, then the longer one before it, and so on. A sign without a piece of its own falls back to its UTF-8 bytes. A literal U+2581 in a text is
always encoded by bytes, so decoding returns the text exactly.

Defined results: a null text has null ids and others, an empty text no ids and no others; both decode to themselves; control pieces never come from
text, whatever it says; texts of any length go in linear time; repeated rows and other columns pass through unharmed.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import math
import os
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F, types as T

from .util import own, shared_dir, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = 1 << 20
_FAR = 1 << 60
#: Bytes of text that are encoded before a batch leaves.
BATCH_TEXT = 1 << 20
_UNITS = re.compile(" ?[^ \n▁]+|[ \n▁]")
#: Units whose segmentations a worker keeps, in each of two generations.
KEPT = 300_000
#: What a piece of a model with ranks costs besides its rank; words then come closest to that model's own pieces.
PIECE_COST = 5.0


class Kept:
    """Segmented units, in flat arrays: a unit costs its text, a place, and its ids."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.ends, self.costs, self.gaps = array("i"), array("q", [0]), array("q"), array("q")

    def keep(self, unit: str, ids: tuple[int, ...] | list[int], cost: int, gap: int) -> int:
        self.at[unit] = place = len(self.costs)
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        self.costs.append(cost)
        self.gaps.append(gap)
        return place

    def take(self, place: int) -> tuple[list[int], int, int]:
        return self.ids[self.ends[place] : self.ends[place + 1]].tolist(), self.costs[place], self.gaps[place]

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after another, where each begins and the last ends, cost and gap of each) of units by place."""
        ends = np.frombuffer(self.ends, np.int64)
        start = ends[places]
        size = ends[places + 1] - start
        to = np.r_[0, np.cumsum(size)]
        at = np.repeat(start - to[:-1], size) + np.arange(to[-1])
        return np.frombuffer(self.ids, np.int32)[at], to, np.frombuffer(self.costs, np.int64)[places], np.frombuffer(self.gaps, np.int64)[places]


class Lattice:
    """The pieces of a model, with the segmentations of the units met so far."""

    def __init__(self, data: bytes, nbest: int) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = SentencePieceProcessor(model_proto=data)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        size = model.get_piece_size()
        bpe = proto.trainer_spec.model_type == 2
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and (model.get_score(i) > -1e8 or len(model.id_to_piece(i)) == 1)]
        order = sorted(normal, key=lambda i: (-model.get_score(i), i))
        norm = math.log(sum(1 / (r + 2) for r in range(len(order)))) if order else 0.0
        cost = {i: math.log(r + 2) + norm + PIECE_COST for r, i in enumerate(order)} if bpe else {i: -model.get_score(i) for i in normal}
        self.nbest = nbest
        self.arcs = {model.id_to_piece(i): (round(c * UNIT), i) for i, c in cost.items()}
        self.single = {p for p in self.arcs if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, (c, i) in self.arcs.items():
            self.automaton.add_word(p, (len(p), c, (i,)))
        if self.arcs:
            self.automaton.make_automaton()
        self.chained = not any(SPACE in p[1:] or "\n" in p[1:] for p in self.arcs)
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.byte_cost = round((max(cost.values(), default=0) + 1) * UNIT)
        self.text = [b""] * size
        for p, (_, i) in self.arcs.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        self.text[self.unknown] = " ⁇ ".encode()
        self.new, self.old = Kept(), Kept()

    def fallback(self, sign: str) -> tuple[int, tuple[int, ...]]:
        raw = sign.encode("utf-8", "surrogatepass")
        ids = tuple(self.bytes[b] for b in raw) if len(self.bytes) == 256 else (self.unknown,)
        return self.byte_cost * len(ids), ids

    def lattice(self, unit: str) -> tuple[list[tuple], list[int]]:
        """(arcs, least cost from the start to each position); an arc is (from, to, cost, ids), sorted by end, then start."""
        if unit == SPACE:
            cost, ids = self.fallback(unit)
            return [(0, 1, cost, ids)], [0, cost]
        u = unit.replace(" ", SPACE) if " " in unit else unit
        best = [0] + [_FAR] * len(u)
        if self.single.issuperset(u):
            arcs = [(end + 1 - size, end + 1, cost, ids) for end, (size, cost, ids) in self.automaton.iter(u)]
        else:
            arcs = [(end + 1 - size, end + 1, cost, ids) for end, (size, cost, ids) in self.automaton.iter(u)] if len(self.automaton) else []
            arcs += [(k, k + 1, *self.fallback(x)) for k, x in enumerate(u) if x not in self.single]
            arcs.sort(key=lambda a: (a[1], a[0]))
        for i, j, cost, _ in arcs:
            cost += best[i]
            if cost < best[j]:
                best[j] = cost
        return arcs, best

    def segment(self, unit: str, nbest: int) -> list[tuple[int, tuple[int, ...]]]:
        """(cost, ids) of the N best segmentations of a unit, by A* from the end under the exact forward costs."""
        arcs, best = self.lattice(unit)
        if len(arcs) == 1:
            return [(arcs[0][2], arcs[0][3])]
        n = len(best) - 1
        ends: list[list] = [[] for _ in range(n + 1)]
        for arc in reversed(arcs):
            ends[arc[1]].append(arc)
        out, pops, count = [], [0] * (n + 1), 0
        heap = [(best[n], 0, n, 0, None)]
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            _, _, pos, g, path = pop(heap)
            if pos == 0:
                ids = []
                while path is not None:
                    x, path = path
                    ids += x
                out.append((g, tuple(ids)))
                if len(out) == nbest:
                    break
                continue
            if pops[pos] >= nbest:  # no more than N of the N best pass one position with different ends
                continue
            pops[pos] += 1
            for start, _, c, ids in ends[pos]:  # the longest last: of equal ones the newest goes on first
                count -= 1
                push(heap, (g + c + best[start], count, start, g + c, (ids, path)))
        return out

    def solve(self, unit: str) -> tuple[tuple[int, ...], int, int]:
        """(ids, cost, what the second best segmentation loses) of a unit: the same search for the best one.

        Under exact costs the search goes on from its newest entry until that is complete, and the least of all other
        entries then is the cost of the second best, so of those only the least is kept.
        """
        arcs, best = self.lattice(unit)
        if len(arcs) == 1:
            return arcs[0][3], arcs[0][2], _FAR
        pos, at, g, second, total, path = len(best) - 1, len(arcs) - 1, 0, _FAR, best[-1], []
        while pos:
            while arcs[at][1] > pos:
                at -= 1
            while at >= 0 and arcs[at][1] == pos:
                start, _, c, ids = arcs[at]
                f = g + c + best[start]
                if f == total:  # the longest comes last
                    if len(path) and path[-1][0] == pos:
                        second = total
                        path.pop()
                    path.append((pos, start, c, ids))
                elif f < second:
                    second = f
                at -= 1
            _, pos, c, _ = path[-1]
            g += c
        return tuple(i for *_, ids in reversed(path) for i in ids), total, second - total if second < _FAR else _FAR

    def place(self, unit: str) -> int:
        """Where a unit is kept, in arrays; it is solved if it is new, or taken over from the generation before."""
        at = self.old.at.get(unit)
        ids, cost, gap = self.solve(unit) if at is None else self.old.take(at)
        return self.new.keep(unit, ids, cost, gap)

    def encode(self, text: str) -> list[tuple[float, np.ndarray]]:
        """(score, ids) of the N best segmentations of a text, the best first; fewer where there are no more."""
        if not text:
            return [(0.0, np.zeros(0, np.int32))]
        if len(self.new.at) >= KEPT:
            self.old, self.new = self.new, Kept()
        units = _UNITS.findall(" " + text) if self.chained else [" " + text]
        where = list(map(self.new.at.get, units))
        if None in where:
            get = self.new.at.get
            for i, w in enumerate(where):
                if w is None:
                    w = get(units[i])
                    where[i] = self.place(units[i]) if w is None else w
        ids, ends, costs, loss = self.new.gather(np.array(where, np.int64))
        total = int(costs.sum())
        sums: list[tuple[int, tuple]] = [(0, ())]  # what is lost, and by which segmentations of which units
        for _ in range(min(self.nbest - 1, len(loss))):
            at = int(loss.argmin())
            if loss[at] >= _FAR:
                break
            loss[at] = _FAR
            more = self.segment(units[at], self.nbest)
            sums = heapq.nsmallest(self.nbest, [(lost + c - more[0][0], (*how, (at, x)) if x is not more[0][1] else how) for lost, how in sums for c, x in more], key=lambda s: s[0])
        out = []
        for lost, how in sums:
            parts, done = [], 0
            for at, x in sorted(how):
                parts += [ids[done : ends[at]], np.array(x, np.int32)]
                done = ends[at + 1]
            out.append((-(total + lost) / UNIT, np.concatenate([*parts, ids[done:]])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that encoding puts before it."""
        return b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


_loaded: dict[tuple[str, int], Lattice] = {}


def _lattice(name: str, nbest: int) -> Lattice:
    if (name, nbest) not in _loaded:
        _loaded.clear()
        with open(SparkFiles.get(name), "rb") as f:
            _loaded[name, nbest] = Lattice(f.read(), nbest)
    return _loaded[name, nbest]


def encode(docs: DataFrame, model: str = MODEL, nbest: int = 3, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, score and ids of each text's best segmentation, and (score, ids) of the next best ones in `others`, best first.

    With `digest` SHA-256 of ids (little-endian 32-bit) take the ids' places, and there is that of the text they decode to.
    """
    shared_dir(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(model)
    name = os.path.basename(model)
    some = "others array<struct<score:double,ids_sha256:string>>, ids_sha256 string, decoded_sha256 string, exact boolean" if digest else "others array<struct<score:double,ids:array<int>>>, ids array<int>"
    ddl = f"doc_id long, n_tokens int, score double, {some}"
    names = [f.name for f in T.StructType.fromDDL(ddl)]
    sha = lambda ids: hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()

    def lists(values: list, kind: pa.DataType) -> pa.ListArray:
        """A list array of int arrays, of which None are null."""
        ends = np.cumsum([0, *(0 if v is None else len(v) for v in values)])
        flat = [v for v in values if v is not None]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), kind), mask=pa.array([v is None for v in values], pa.bool_()))

    def spans(texts: pa.Array) -> Iterator[tuple[int, int]]:
        """(first, rows) of parts of at most 200 texts and about BATCH_TEXT bytes, so what leaves at once stays small."""
        ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
        at = 0
        while at < len(ends):
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_TEXT))
            n = max(1, min(200, full - at))
            yield at, n
            at += n

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(name, nbest)
        paused = gc.isenabled()
        gc.disable()  # no cycles here, and the kept units are many small objects
        try:
            for b in it:
                texts = b.column(1)
                for at, n in spans(texts):
                    part = texts.slice(at, n).to_pylist()
                    got = [None if t is None else lattice.encode(t) for t in part]
                    flat = [x for g in got if g is not None for x in g[1:]]
                    scores = pa.array([x for x, _ in flat], pa.float64())
                    ids = pa.array([sha(x) for _, x in flat], pa.string()) if digest else lists([x for _, x in flat], pa.int32())
                    each = pa.StructArray.from_arrays([scores, ids], ["score", "ids_sha256" if digest else "ids"])
                    ends = np.cumsum([0, *(0 if g is None else len(g) - 1 for g in got)])
                    every = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each, mask=pa.array([g is None for g in got], pa.bool_()))
                    cols = [b.column(0).slice(at, n), pa.array([None if g is None else len(g[0][1]) for g in got], pa.int32()), pa.array([None if g is None else g[0][0] for g in got], pa.float64()), every]
                    if digest:
                        back = [None if g is None else lattice.decode(g[0][1]) for g in got]
                        cols.append(pa.array([None if g is None else sha(g[0][1]) for g in got], pa.string()))
                        cols.append(pa.array([None if x is None else hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()))
                        cols.append(pa.array([x == t for x, t in zip(back, part, strict=True)], pa.bool_()))
                    else:
                        cols.append(lists([None if g is None else g[0][1] for g in got], pa.int32()))
                    yield pa.RecordBatch.from_arrays(cols, names)
        finally:
            lattice.new, lattice.old = Kept(), Kept()  # most of what a task met is its own
            trim()
            if paused:
                gc.enable()

    return own(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    shared_dir(encoded.sparkSession)
    encoded.sparkSession.sparkContext.addFile(model)
    name = os.path.basename(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(name, 1)
        for b in it:
            texts = [None if x is None else lattice.decode(np.array(x, np.int32)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return own(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")
