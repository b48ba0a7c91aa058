"""SentencePiece encoding and decoding with exact N-best segmentations.

A text is a lattice: nodes between characters, an arc for every piece that fits.  A forward Viterbi pass
gives the best score from the start to each node.  The N best paths come from a backward A-star search from
the end, for which those scores are exact estimates of what is left, so that paths are completed best first
and nothing is searched in vain.

The lattice falls apart wherever no piece can cross, which is at every word, so both passes run once for a
word and are remembered.  The Viterbi pass also tells a word's gap: what its second-best path loses.  The N
best paths of a text differ from the best one in the N - 1 words of smallest gap only; the search runs for
these, and a best-first merge of their paths gives those of the text.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import give_back, slices, small_batches, table
from tablewright.llm.pieces import MODEL_PATH, SPACE, Vocabulary, fields, parse_model, read_model

N_BEST = 4
#: Words that a worker remembers: beyond, the half that was asked for least often goes.
REMEMBERED = 150_000
#: Bytes from which a word is searched by itself, and cells of the arrays in which shorter ones advance together.
LONG_UNIT, BATCH_CELLS = 48, 200_000
#: Characters that are cut into words together: short texts side by side, a longer one in parts.
STEP_CHARS = 1 << 20
#: Ids that become Python numbers at once.
STEP_IDS = 1 << 16
#: Stands for the space mark itself where it occurs in a text; no decoded text can hold it.
LITERAL_MARK = "\udfff"
#: Fixed values of the format: the field of the trainer's settings, in it that of the kind, and the unigram kind.
TRAINER, KIND, UNIGRAM = 2, 3, 1

ENCODED = "ids array<int>, scores array<double>, changes array<array<int>>"


class _Codes(dict):
    """Numbers of words, in the order of their first look-up; the new ones are listed."""

    def __init__(self, words=()):
        super().__init__((w, k) for k, w in enumerate(words))
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.fresh.append(word)
        return code


class _Column:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        while self.size + len(more) > len(self.data):
            self.data = np.concatenate((self.data, np.zeros_like(self.data)))
        self.data[self.size : self.size + len(more)] = more
        self.size += len(more)

    def __getitem__(self, at):
        return self.data[at]


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of runs, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _is_unigram(model: bytes) -> bool:
    for number, _, value in fields(model):
        if number == TRAINER:
            return dict((n, v) for n, _, v in fields(value)).get(KIND, UNIGRAM) == UNIGRAM
    return True


class Segmenter:
    """Pieces with their scores.  A unigram model's scores are log-probabilities and are used as they are; a
    merge model scores a piece by its rank only, which Zipf's law turns into one: -ln(rank + 2)."""

    def __init__(self, model: bytes):
        v: Vocabulary = parse_model(model)
        unigram = _is_unigram(model)
        score = (lambda s: s) if unigram else (lambda s: -math.log(2 - s))
        self.scores = [score(s) for s in v.scores]
        self.known: dict[str, int] = {}
        for piece, i in v.ids.items():
            for end in range(1, len(piece)):
                self.known.setdefault(piece[:end], -1)  # a beginning of a piece
        self.known.update(v.ids)
        self.byte_ids, self.byte_score = v.byte_ids, min(self.scores)
        text_of = {i: bytes([b]) for b, i in v.byte_ids.items()}
        self.bytes_of = [text_of.get(i, p.replace(SPACE, " ").encode()) for i, p in enumerate(v.pieces)]
        crossed = {c for p in v.ids for c in p}
        cuts = "".join(c for c in "\n\r\t" if c not in crossed)
        inner = any(SPACE in p.lstrip(SPACE) for p in v.ids)
        self.units = re.compile(f"[^{cuts}]+|[{cuts}]" if inner and cuts else r"(?s:.+)" if inner else f"{SPACE}+[^{SPACE}{cuts}]*|[^{SPACE}{cuts}]+" + (f"|[{cuts}]" if cuts else ""))
        self.part_end = None if inner else re.compile(f"[^{SPACE}](?={SPACE})")
        self._forget()
        self.paths: dict[tuple[str, int], list] = {}
        self.next = self.piece_at = self.score_at = None

    def lattice(self, unit: str) -> tuple[list, list[float]]:
        """Arcs (start, end, ids, score) in order of start, and the best score from the start to each node."""
        n, known, scores = len(unit), self.known.get, self.scores
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        arcs = []
        for s in range(n):
            reached = best[s]
            for e in range(s + 1, n + 1):
                i = known(unit[s:e])
                if i is None:
                    break
                if i >= 0:
                    arcs.append((s, e, i, scores[i]))
                    if reached + scores[i] > best[e]:
                        best[e] = reached + scores[i]
            if known(unit[s], -1) < 0:  # a character without a piece: its bytes
                own = tuple(self.byte_ids[b] for b in (SPACE if unit[s] == LITERAL_MARK else unit[s]).encode("utf-8", "replace"))
                arcs.append((s, s + 1, own, self.byte_score * len(own)))
                best[s + 1] = max(best[s + 1], reached + arcs[-1][3])
        return arcs, best

    def viterbi(self, unit: str) -> tuple[bytes, float, float]:
        """Ids (four bytes each) and score of the best path, and the gap to the second best (infinite if there is none)."""
        arcs, best = self.lattice(unit)
        n = len(unit)
        rest = [-math.inf] * n + [0.0]
        for s, e, _, score in reversed(arcs):
            if score + rest[e] > rest[s]:
                rest[s] = score + rest[e]
        path, node, on_path = [], n, set()
        for k in range(len(arcs) - 1, -1, -1):
            s, e, i, score = arcs[k]
            if e == node and best[s] + score == best[e]:
                path.append(i)
                on_path.add(k)
                node = s
        total = best[n]
        gap = min((total - best[s] - score - rest[e] for k, (s, e, _, score) in enumerate(arcs) if k not in on_path), default=math.inf)
        return self._packed(self._flat(reversed(path))), total, max(gap, 0.0)

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths of a unit, best first, by backward A-star search."""
        arcs, best = self.lattice(unit)
        into: dict[int, list] = {}
        for arc in arcs:
            into.setdefault(arc[1], []).append(arc)
        order = count()
        heap = [(-best[len(unit)], next(order), len(unit), 0.0, None)]
        found = []
        while heap and len(found) < n:
            _, _, node, behind, path = heapq.heappop(heap)
            if node == 0:
                ids = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                found.append((behind, self._flat(ids)))
                continue
            for s, _, i, score in into.get(node, ()):
                heapq.heappush(heap, (-(best[s] + score + behind), next(order), s, score + behind, (i, path)))
        return found

    @staticmethod
    def _flat(ids) -> tuple[int, ...]:
        return tuple(x for i in ids for x in (i if isinstance(i, tuple) else (i,)))

    def _table(self) -> None:
        """The pieces as a trie over bytes: next node by node and byte, and each node's piece and score."""
        children: list[dict[int, int]] = [{}]
        at: dict[int, int] = {}
        for piece, i in self.known.items():
            if i >= 0:
                node = 0
                for b in piece.encode():
                    node = children[node].setdefault(b, len(children))
                    if node == len(children):
                        children.append({})
                at[node] = i
        small = len(children) < 1 << 16
        self.next = np.full((len(children) + 1, 256), len(children), np.uint16 if small else np.int32)  # the last node is the dead end
        for node, own in enumerate(children):
            for b, to in own.items():
                self.next[node, b] = to
        self.piece_at = np.full(len(children) + 1, -1, np.int32)
        self.score_at = np.full(len(children) + 1, -np.inf)
        for node, i in at.items():
            self.piece_at[node], self.score_at[node] = i, self.scores[i]

    def viterbi_batch(self, units: list[str]) -> dict[str, tuple]:
        """`viterbi` for many units at once."""
        ids, lengths, scores, gaps = self._solve(units)
        ends = np.cumsum(lengths).tolist()
        return {u: (ids[e - n : e].tobytes(), s, g) for u, e, n, s, g in zip(units, ends, lengths.tolist(), scores.tolist(), gaps.tolist())}

    def _solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the best paths one after another, their lengths, scores and gaps: units of one length advance
        together, an array operation a step."""
        if self.next is None:
            self._table()
        data = [u.encode("utf-8", "surrogatepass") for u in units]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        order = np.argsort(sizes, kind="stable")
        ids: list = [None] * len(units)
        lengths, scores, gaps = np.zeros(len(units), np.int64), np.zeros(len(units)), np.zeros(len(units))
        lo = 0
        while lo < len(order):
            n = int(sizes[order[lo]])
            if n > LONG_UNIT:
                alone = order[lo:]
                lo = len(order)
            else:
                hi = min(int(np.searchsorted(sizes[order], n, "right")), lo + max(1, BATCH_CELLS // n))
                rows = order[lo:hi]
                taken, counts, scores[rows], gaps[rows], bare = self._same_length(b"".join([data[k] for k in rows]), n)
                lengths[rows] = counts
                for k, own, c in zip(rows.tolist(), taken, counts.tolist()):
                    ids[k] = own[n - c :]
                alone, lo = rows[bare], hi
            for k in alone.tolist():
                packed, scores[k], gaps[k] = self.viterbi(units[k])
                ids[k] = np.frombuffer(packed, np.int32)
                lengths[k] = len(ids[k])
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), lengths, scores, gaps

    def _same_length(self, joined: bytes, n: int) -> tuple[np.ndarray, ...]:
        """Of units of n bytes: pieces of the best paths (right-aligned), their number, scores, gaps, and which need byte pieces."""
        m = len(joined) // n
        data = np.ascontiguousarray(np.frombuffer(joined, np.uint8).reshape(m, n).T)  # a row a place
        node, arcs, pieces = np.zeros((n, m), self.next.dtype), [None], [None]
        for size in range(1, n + 1):
            node = self.next[node[: n - size + 1], data[size - 1 :]]
            arcs.append(self.score_at[node])
            pieces.append(self.piece_at[node])
            if size >= 4 and (node == len(self.next) - 1).all():
                break
        width = np.select([data < 0x80, data < 0xC0, data < 0xE0, data < 0xF0], [1, 0, 2, 3], 4)
        for size in range(1, min(4, len(arcs) - 1) + 1):  # characters without a piece
            bare = (width[: n - size + 1] == size) & (arcs[size] == -np.inf)
            arcs[size][bare] = self.byte_score * size
        best, rest = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        last = np.zeros((n + 1, m), np.int32)
        best[0] = rest[n] = 0
        for e in range(1, n + 1):
            for size in range(1, min(e, len(arcs) - 1) + 1):
                reached = best[e - size] + arcs[size][e - size]
                np.copyto(last[e], size, where=reached > best[e])
                np.maximum(best[e], reached, out=best[e])
        for s in range(n - 1, -1, -1):
            for size in range(1, min(n - s, len(arcs) - 1) + 1):
                np.maximum(rest[s], arcs[size][s] + rest[s + size], out=rest[s])
        total = best[n].copy()
        at = np.full(m, n)
        taken, counts = np.zeros((m, n), np.int32), np.zeros(m, np.int64)
        others = [None] + [total - best[: n - size + 1] - arcs[size] - rest[size:] for size in range(1, len(arcs))]
        while True:
            live = np.flatnonzero(at > 0)
            if not len(live):
                break
            sizes = last[at[live], live]
            for size in np.unique(sizes):
                own = live[sizes == size]
                s = at[own] - size
                others[size][s, own] = np.inf
                taken[own, n - 1 - counts[own]] = pieces[size][s, own]
                counts[own] += 1
                at[own] = s
        gap = np.full(m, np.inf)
        for size in range(1, len(arcs)):
            gap = np.minimum(gap, others[size].min(0))
        return taken, counts, total, np.maximum(gap, 0), (taken < 0).any(1)

    def _forget(self) -> None:
        """Start over, but for the half of the words that was asked for most often."""
        kept = np.zeros(0, np.int64)
        if hasattr(self, "young"):
            kept = np.sort(np.argsort(-self.uses[: len(self.young)], kind="stable")[: REMEMBERED // 2])
        words = list(self.young) if len(kept) else []
        fresh = {name: _Column(kind) for name, kind in (("ids", np.int32), ("start", np.int64), ("length", np.int64), ("score", float), ("gap", float), ("uses", np.int64))}
        if len(kept):
            own = self.memory
            fresh["ids"].extend(own["ids"][_spread(own["start"][kept], own["length"][kept])])
            fresh["start"].extend(np.cumsum(own["length"][kept]) - own["length"][kept])
            for name in ("length", "score", "gap"):
                fresh[name].extend(own[name][kept])
            fresh["uses"].extend(np.zeros(len(kept), np.int64))
        self.memory = fresh
        self.young = _Codes([words[k] for k in kept.tolist()])

    @property
    def uses(self) -> np.ndarray:
        return self.memory["uses"].data

    def entries(self, rows: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the units of each row, by which `memory` has ids, score and gap; new ones are found together."""
        if len(self.young) > REMEMBERED:
            self._forget()
        number, found = self.young.__getitem__, []
        for own in rows:
            found.append(np.fromiter(map(number, own), np.int64, len(own)))
        if self.young.fresh:
            ids, lengths, scores, gaps = self._solve(self.young.fresh)
            memory, self.young.fresh = self.memory, []
            memory["start"].extend(memory["ids"].size + np.cumsum(lengths) - lengths)
            for name, more in (("ids", ids), ("length", lengths), ("score", scores), ("gap", gaps), ("uses", np.zeros(len(lengths), np.int64))):
                memory[name].extend(more)
        if found:
            seen = np.bincount(np.concatenate(found), minlength=len(self.young))
            self.uses[: len(seen)] += seen
        return found

    @staticmethod
    def _packed(ids) -> bytes:
        return np.array(ids, np.int32).tobytes()

    @staticmethod
    def unpacked(ids: bytes) -> tuple[int, ...]:
        return tuple(np.frombuffer(ids, np.int32).tolist())

    def _n_best(self, unit: str, code: int, n: int) -> list[tuple[float, tuple[int, ...]]]:
        if (unit, n) not in self.paths:
            if len(self.paths) >= 20_000:
                self.paths.clear()
            start, length = int(self.memory["start"][code]), int(self.memory["length"][code])
            score, first = float(self.memory["score"][code]), tuple(self.memory["ids"][start : start + length].tolist())
            others = [path for path in self.n_best(unit, n) if path[1] != first]  # of equal paths the best one is first
            self.paths[unit, n] = [(score, first), *others][:n]
        return self.paths[unit, n]

    def encode(self, text: str | None, n: int) -> tuple[list[int], list[float], list[list[int]]]:
        """The best path as ids; the scores of the n best; for each further one the changes against the
        best: first piece, pieces replaced, pieces put there, and their ids, one change after another."""
        ids, scores, changes = self.encode_parts(((units, self.entries([units])[0]) for units in self.parts(text)), n)
        return ids.tolist(), scores, changes

    def cut(self, text: str | None) -> list[str]:
        """The units of a text, the encoder's own space in front."""
        return [u for part in self.parts(text) for u in part]

    def parts(self, text: str | None) -> Iterator[list[str]]:
        """The units of a text, those of about STEP_CHARS characters at a time: a part ends before a space after a word."""
        if not text:
            return
        if SPACE in text:
            text = text.replace(SPACE, LITERAL_MARK)
        text = SPACE + text.replace(" ", SPACE)
        at = 0
        while len(text) - at > STEP_CHARS:
            end = self.part_end.search(text, at + STEP_CHARS) if self.part_end else None
            if end is None:
                break
            yield self.units.findall(text, at, end.end())
            at = end.end()
        yield self.units.findall(text, at)

    def encode_parts(self, parts, n: int) -> tuple[np.ndarray, list[float], list[list[int]]]:
        """As `encode`, of parts (units, their numbers), each taken while `memory` holds its numbers."""
        best, sums, slots, done = [], [], [], 0
        for units, codes in parts:
            memory = self.memory
            lengths = memory["length"][codes]
            best.append(memory["ids"][_spread(memory["start"][codes], lengths)])
            sums.append(math.fsum(memory["score"][codes].tolist()))
            if n > 1:
                gaps = memory["gap"][codes]
                least = np.argpartition(gaps, n - 1)[: n - 1] if len(gaps) > n else np.argsort(gaps)[: n - 1]
                begins = np.cumsum(lengths) - lengths
                for k in sorted(int(k) for k in least if gaps[k] < math.inf):
                    slots.append((float(gaps[k]), done + int(begins[k]), int(lengths[k]), self._n_best(units[k], int(codes[k]), n)))
            done += len(best[-1])
        if not best:
            return np.zeros(0, np.int32), [0.0], []
        ids, total = best[0] if len(best) == 1 else np.concatenate(best), math.fsum(sums)
        if n < 2:
            return ids, [total], []
        slots = sorted(sorted(slots)[: n - 1], key=lambda s: s[1])
        options = [s[3] for s in slots]
        start = (0,) * len(slots)
        heap, seen, scores, changes = [(0.0, start)], {start}, [], []
        while heap and len(scores) < n:
            loss, choice = heapq.heappop(heap)
            scores.append(total - loss)
            if scores[1:]:
                changes.append([x for (_, begin, length, own), c in zip(slots, choice) if c for x in (begin, length, len(own[c][1]), *own[c][1])])
            for j, own in enumerate(options):
                if choice[j] + 1 < len(own):
                    after = (*choice[:j], choice[j] + 1, *choice[j + 1 :])
                    if after not in seen:
                        seen.add(after)
                        heapq.heappush(heap, (sum(o[0][0] - o[c][0] for o, c in zip(options, after)), after))
        return ids, scores, changes

    def encode_rows(self, texts: list[str | None], n: int) -> Iterator[tuple[np.ndarray, list[float], list[list[int]]]]:
        """`encode` of many texts, short ones side by side; ids as an array."""
        for a, b in slices(np.array([len(t or "") for t in texts]), STEP_CHARS):
            if b - a == 1 and len(texts[a] or "") > STEP_CHARS:
                yield self.encode_parts(((units, self.entries([units])[0]) for units in self.parts(texts[a])), n)
                continue
            cut = list(map(self.cut, texts[a:b]))
            for units, codes in zip(cut, self.entries(cut)):
                yield self.encode_parts([(units, codes)] if units else [], n)

    def decode(self, ids) -> str:
        """The text of a path.  Bytes that are no UTF-8 become U+FFFD; one leading space is the encoder's own."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)) if len(ids) <= STEP_IDS else b"".join(
            b"".join(map(self.bytes_of.__getitem__, ids[a : a + STEP_IDS].tolist() if isinstance(ids, np.ndarray) else ids[a : a + STEP_IDS]))
            for a in range(0, len(ids), STEP_IDS))
        text = text.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_SEGMENTERS: dict[int, Segmenter] = {}


def segmenter(model: bytes) -> Segmenter:
    key = hash(model)
    if key not in _SEGMENTERS:
        _SEGMENTERS.clear()
        _SEGMENTERS[key] = Segmenter(model)
    return _SEGMENTERS[key]


def let_go() -> None:
    """Drop the tables that this process keeps of its model."""
    _SEGMENTERS.clear()
    give_back()


def apply_changes(ids: list[int], changes: list[int]) -> list[int]:
    """A further path, from the best one and its changes."""
    out, at, k = [], 0, 0
    while k < len(changes):
        start, gone, new = changes[k : k + 3]
        out += ids[at:start] + changes[k + 3 : k + 3 + new]
        at, k = start + gone, k + 3 + new
    return out + ids[at:]


def encode_pieces(text: Column, model: bytes, n: int = N_BEST, check: bool = False) -> Column:
    """Struct of ids (best path), scores (of the n best paths, falling) and changes (of the others, see `encode`).

    Null and empty texts have no ids and the score 0.  A text with fewer than n paths has fewer scores.  Of paths
    with equal scores any may come first, the same for equal texts.  Very long texts are cut into words a part at
    a time.  Characters outside the vocabulary become their UTF-8 bytes, so nothing is lost: with `check` the
    struct also has round_trip, whether decoding gives the text back.
    """

    def encoded(own: Segmenter, texts: pa.Array) -> pa.Array:
        ids, scores, changes, same = [], [], [], []
        rows = texts.to_pylist()
        for t, (path, s, c) in zip(rows, own.encode_rows(rows, n)):
            ids.append(path)
            scores.append(s)
            changes.append(c)
            if check:
                same.append(own.decode(path) == (t or ""))
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in ids]))).astype(np.int32)
        columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))),
                   pa.array(scores, pa.list_(pa.float64())), pa.array(changes, pa.list_(pa.list_(pa.int32())))]
        return pa.StructArray.from_arrays([*columns, pa.array(same, pa.bool_())][: 3 + check], ["ids", "scores", "changes", "round_trip"][: 3 + check])

    @F.arrow_udf(ENCODED + (", round_trip boolean" if check else ""))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = segmenter(model)
        try:
            for texts in batches:
                yield encoded(own, texts)
        finally:  # a worker outlives its task; the tables are made anew in a fraction of a second
            own = None
            let_go()

    return run(text)


def decode_pieces(ids: Column, model: bytes) -> Column:
    """The text of piece ids; empty for none, null for null."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        own = segmenter(model)
        values, offsets = rows.flatten().to_numpy(zero_copy_only=False).tolist(), rows.offsets.to_numpy() - rows.offsets[0].as_py()
        return pa.array([None if rows[k].as_py() is None and not rows[k].is_valid else own.decode(values[a:b]) for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:]))], pa.string())

    return run(ids)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, the scores of the N best paths, their differences, and whether decoding gives the text back."""
    small_batches(spark)
    model = read_model(MODEL_PATH)
    coded = table(spark, sf_dir, "documents").select("doc_id", encode_pieces(F.col("text"), model, check=True).alias("p"))
    return coded.select("doc_id", F.size("p.ids").alias("n_pieces"), "p.ids", "p.scores", "p.changes", "p.round_trip")


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
SQL: dict[str, str] = {}
