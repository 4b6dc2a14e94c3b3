"""Exact BPE encoding and decoding for SentencePiece models (operator 9).

The encoder finds the merge result without merging: an Aho-Corasick automaton
gives the pieces that match at each position, the longest one is taken first,
two neighbours are accepted only if re-merging them would leave the boundary
between them in place, and a bit field remembers positions from which no
accepted sequence reaches the end, so that no position is tried twice.

Pieces in which white space marks stand only at the front (checked when the
model is loaded) let a text be cut before each run of marks; the results of
short runs are kept in a bounded table per worker.

Rare pieces whose score is above that of a piece they are merged from (runs of
marks in public models) break the argument behind the neighbour check.  Runs
that contain such a piece are merged step by step by score instead.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

MARK = "▁"
RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Runs kept in each of a worker's two tables (newer and older), and the longest run that is kept.
KEPT_RUNS, KEPT_CHARS = 150_000, 48
#: Results of the neighbour check kept per worker.
KEPT_PAIRS = 200_000
#: Characters of text whose results a worker holds before it gives them out.
HELD_CHARS = 2_000_000
NEVER = float("-inf")


class Runs(dict):
    """Ids of runs as text: looked up, taken over from an older table, or made."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, run: str) -> str:
        got = self.older.get(run)
        if got is None:
            got = self.make(run)
        if len(run) <= KEPT_CHARS:
            if len(self) >= KEPT_RUNS:
                self.older.clear()  # before the copy, so that no third table is held
                self.older.update(self)
                self.clear()
            self[run] = got
        return got


class PieceModel:
    """Pieces and scores of a BPE model file, with its encoder and decoder."""

    def __init__(self, data: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.unknown = sp.unk_id()
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.chars = {c for p in self.ids for c in p}
        self.cuts = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.longest = max(map(len, self.ids))
        # odd: characters that are no piece, and pieces on whose way scores rise
        odd = {c for c in self.chars if c not in self.ids}
        self.faithful = not odd
        self.parts: dict[str, tuple[str, str]] = {}  # the last merge of each piece
        for p in self.ids:
            parts, steps = self._merge(p)
            if steps and len(parts) == 1:
                self.parts[p] = steps[-1]
            tops = [self.score[a + b] for a, b in steps]
            if len(parts) != 1 or any(x < y for x, y in zip(tops, tops[1:])):
                odd.add(p)
        seen: dict[float, str] = {}
        for p, s in self.score.items():
            if len(p) > 1 and s in seen:
                odd |= {p, seen[s]}
            seen[s] = p
        self.odd = re.compile("|".join(map(re.escape, sorted(odd, key=len)))) if odd else None
        self.sizes = [len(p) for p in self.pieces]
        self.aho = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.aho.add_word(p, i)
        self.aho.make_automaton()
        self.surface = [p.replace(MARK, " ") for p in self.pieces]
        self.surface[self.unknown] = " ⁇ "
        self.digits = [str(i) for i in range(n)]
        # the longest shorter piece that a piece begins with, or -1
        self.shorter = [-1] * n
        for p, i in self.ids.items():
            self.shorter[i] = next((j for k in range(len(p) - 1, 0, -1) if (j := self.ids.get(p[:k], -1)) >= 0), -1)
        self.ends: dict[int, list[tuple[str, float]]] = {}
        self.fronts: dict[int, list[tuple[str, float]]] = {}
        self.pairs: dict[int, bool] = {}
        self.runs = Runs(self._run)  # of runs with their marks
        self.words = Runs(lambda word: self._run(MARK + word))  # of runs with one mark in front, which is left out
        self.changed: dict[str, str] = {}  # runs that decode to another text

    def _merge(self, text: str) -> tuple[list[str], list[tuple[str, str]]]:
        """Step-by-step merging by highest score, leftmost first."""
        part: list[str | None] = list(text)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []
        steps = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, j, part[i] + part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if part[i] is None or part[j] is None or after[i] != j or part[i] + part[j] != both:
                continue
            steps.append((part[i], part[j]))
            part[i], part[j] = both, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in part if p is not None], steps

    def _edges(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at one end of a piece while it is merged, from a character
        up to the piece, each with the score of the merge that takes it up."""
        if piece not in self.parts:
            return [(piece, NEVER)]
        inner = self._edges(self.parts[piece][side], side)
        return [*inner[:-1], (inner[-1][0], self.score[piece]), (piece, NEVER)]

    def _holds(self, left: int, right: int) -> bool:
        """Whether re-merging two neighbours leaves the boundary between them.

        What stands on both sides of the boundary is followed through the merges
        of the two pieces, highest score first.  The boundary goes if a merge
        over it comes before the next merge on either side; of equal scores the
        leftmost comes first.
        """
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        ends, fronts = self.ends.get(left), self.fronts.get(right)
        if ends is None:
            ends = self.ends[left] = self._edges(self.pieces[left], 1)
        if fronts is None:
            fronts = self.fronts[right] = self._edges(self.pieces[right], 0)
        score, i, j = self.score, 0, 0
        while True:
            (x, up), (y, down) = ends[i], fronts[j]
            over = score.get(x + y)
            if over is not None and over > up and over >= down:
                known = False
                break
            if up == down == NEVER:
                known = True
                break
            if up >= down:
                i += 1
            else:
                j += 1
        self.pairs[left << 32 | right] = known
        return known

    def _merged(self, text: str) -> list[int]:
        return [i for p in self._merge(text)[0] for i in self._id(p)]

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a run whose characters all occur in pieces.

        The automaton gives the longest piece at a position; its shorter ones are
        a chain.  A place of ``failed`` stands for a position from which no pieces
        that hold lead to the end.
        """
        if self.odd and self.odd.search(text):
            return self._merged(text)
        pairs, sizes, shorter, longest, reach = self.pairs, self.sizes, self.shorter, self.aho.iter_long, self.longest
        ahead = [i for _, i in longest(text)]
        ahead.reverse()  # longest pieces from here on, as long as none was refused
        out: list[int] = []
        n, at, last = len(text), 0, -1
        failed = bytearray(n + 1)
        while at < n:
            # the automaton copies what it is given, so it gets no more than a piece can hold
            i = ahead.pop() if ahead else next(longest(text[at : at + reach]))[1]
            while True:
                while i >= 0:
                    if not failed[at + sizes[i]]:
                        if last < 0:
                            break
                        known = pairs.get(last << 32 | i)
                        if known or (known is None and self._holds(last, i)):
                            break
                    i = shorter[i]
                    ahead.clear()
                if i >= 0:
                    break
                if not out:
                    return self._merged(text)
                failed[at] = 1
                i = out.pop()
                at -= sizes[i]
                i = shorter[i]
                last = out[-1] if out else -1
            out.append(i)
            at += sizes[i]
            last = i
        return out

    def _run(self, run: str) -> str:
        """The ids of a run as text; keeps what they decode to if it isn't the run."""
        if self.chars.issuperset(run):
            ids = self._backtrack(run)
        else:
            ids = []
            for known, part in groupby(run, self.chars.__contains__):
                part = "".join(part)
                ids += self._backtrack(part) if known else [i for c in part for i in self._id(c)]
        surface = self._surface(ids)
        if surface != run.replace(MARK, " "):
            self.changed[run] = surface
        digits = self.digits
        return ",".join([digits[i] for i in ids])

    def _id(self, piece: str) -> list[int]:
        if (i := self.ids.get(piece)) is not None:
            return [i]
        if len(self.bytes) == 256:
            return [self.bytes[b] for b in piece.encode()]
        return [self.unknown]

    def _surface(self, ids: list[int]) -> str:
        """Pieces as text; byte pieces in a row are read as UTF-8."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.surface[i] for i in ids])
        out: list[str] = []
        held = bytearray()
        for i in [*ids, -1]:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i >= 0:
                out.append(self.surface[i])
        return "".join(out)

    def coded(self, text: str) -> tuple[str, str]:
        """The ids of a text, joined by commas, and what they decode to."""
        if not text:
            return "", ""
        if len(self.changed) > KEPT_RUNS:
            self.changed, self.runs, self.words = {}, Runs(self._run), Runs(self.words.make)
        if self.cuts and "  " not in text and MARK not in text and text[0] != " " != text[-1]:
            words = text.split(" ")
            ids = ",".join(map(self.words.__getitem__, words))
            if not self.changed:
                return ids, text
            parts = [MARK + w for w in words]
        else:
            marked = MARK + text.replace(" ", MARK)
            parts = RUN.findall(marked) if self.cuts else [marked]
            ids = ",".join(map(self.runs.__getitem__, parts))
        if self.changed.keys().isdisjoint(parts):
            surface = "".join(parts).replace(MARK, " ")
        else:
            surface = "".join([self.changed.get(p, p).replace(MARK, " ") for p in parts])
        return ids, surface.removeprefix(" ")

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.coded(text)[0].split(",")] if text else []

    def decode(self, ids: list[int]) -> str:
        """As the library decodes: the mark that encoding puts in front goes."""
        out = self._surface(ids)
        return out[1:] if ids and out.startswith(" ") else out


_models: dict[bytes, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    key = hashlib.sha256(data).digest()
    if key not in _models:
        _models[key] = PieceModel(data)
    return _models[key]


def _coded_frames(model: PieceModel, texts: pd.Series, names: list[str]) -> Iterator[pd.DataFrame]:
    """Results of the texts in order, given out after every ``HELD_CHARS`` characters."""
    rows, held = [], 0
    for t in texts:
        joined, surface = model.coded(t)
        n = joined.count(",") + 1 if joined else 0
        row = [n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(surface.encode()).hexdigest()]
        if len(names) > len(row):
            row.append(np.array(joined.split(",") if joined else [], dtype=np.int32))
        rows.append(row)
        held += len(t or "")
        if held >= HELD_CHARS:
            yield pd.DataFrame(rows, columns=names)
            rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names)


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every text, decode the ids again, and add what came out.

    Adds ``n_tokens`` (long), ``ids_sha256``, ``decoded_sha256``, and with
    ``with_ids`` also ``token_ids`` (array<int>).  All
    columns of ``docs`` stay; of the same names, the new ones replace the old.
    A null text counts as empty: no ids, and the digests of nothing.  The model
    file (under 1 MB) is read once by the driver and travels with the function;
    each worker builds the automaton once.  Rows are independent: no shuffle.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    new = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"]
    if with_ids:
        new += ["token_ids array<int>"]
    names = [x.split()[0] for x in new]

    @F.pandas_udf(", ".join(new))
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(data)
        for batch in batches:
            yield from _coded_frames(model, batch, names)

    own = unused(docs, "coded")
    out = docs.withColumn(own, coded(F.col(text)))
    return out.select(*[c for c in docs.columns if c not in names], *[F.col(own)[c].alias(c) for c in names])
