"""SentencePiece encoding and decoding with the N best segmentations.

All pieces that match at a place of the normalised text form a lattice.  A forward
Viterbi pass gives the best score of reaching every place; used as the heuristic of
a backward A* search it is exact, so complete paths come out best first.  No piece
reaches over the start of a run of spaces, so the lattice is a chain of word
lattices: each is searched alone, and the chain combines them.  The forward pass
runs over all new words of a batch of texts at once, in arrays (very long words alone), and
is remembered; only words that an alternative of a text departs in are searched.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count, islice, pairwise
from math import prod
from struct import pack

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BEST = 4
SPACE = "▁"
#: Characters of texts taken together (one text at least), the longest word that a batch works on in arrays (a step
#: of theirs costs as much as ten words or so), and words remembered per task before all are forgotten.
_BATCH_CHARS, _ARRAY_CHARS, _CACHE = 1 << 20, 48, 250_000
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")

_NEVER = float("-inf")
_NOTHING = ()  # no piece begins so
_END = 0x1FFFFF  # after the last character of a word; no character has this number

#: Score (0 at best) and piece ids of a segmentation, and whether they decode to the text.
Path = tuple[float, np.ndarray, bool]


class Trie:
    """Beginnings of pieces as numbered nodes, 0 the empty one; steps are looked up for many nodes at once, in a hash table."""

    def __init__(self, matches: dict[str, tuple[int, float] | None]) -> None:
        number = {p: k for k, p in enumerate(matches, 1)}
        parents = np.array([number.get(p[:-1], 0) for p in matches], np.int64)
        found = [m or (-1, 0.0) for m in matches.values()]
        self.piece = np.array([-1] + [i for i, _ in found], np.int32)  # -1: only the beginning of pieces
        self.score = np.array([0.0] + [s for _, s in found])
        self.goes_on = np.zeros(len(found) + 1, bool)
        self.goes_on[parents] = True
        steps = parents << 21 | np.array([ord(p[-1]) for p in matches], np.int64)
        bits = int(4 * len(steps)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.steps, self.nodes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        todo, slots = np.arange(len(steps)), self.slot(steps)
        while todo.size:
            free = self.steps[slots] < 0
            self.steps[slots[free]] = steps[todo[free]]  # of several, the last one stays
            left = self.steps[slots] != steps[todo]
            self.nodes[slots[~left]] = todo[~left] + 1
            todo, slots = todo[left], slots[left] + 1 & self.mask

    def slot(self, steps: np.ndarray) -> np.ndarray:
        return (steps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes one character on; -1 where no piece begins so."""
        steps = nodes.astype(np.int64) << 21 | codes
        slots = self.slot(steps)
        held = self.steps[slots]
        out = self.nodes[slots]
        at = np.flatnonzero((held != steps) & (held >= 0))  # taken by another step: try the next
        out[held != steps] = -1
        while at.size:
            slots[at] = slots[at] + 1 & self.mask
            held = self.steps[slots[at]]
            same = held == steps[at]
            out[at[same]] = self.nodes[slots[at[same]]]
            at = at[~same & (held >= 0)]
        return out


class Pieces:
    """The pieces of a model file; characters outside it are spelt in byte pieces, at a penalty."""

    def __init__(self, path: str = MODEL) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = range(model.vocab_size())
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in kinds if model.is_byte(i)}
        plain = [i for i in kinds if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
        self.longest = max(map(len, self.ids))
        self.unknown = min(s for _, s in self.ids.values() if s > -1e8) - 10
        # Beginnings of pieces that are no pieces themselves: a longer match may follow.
        self.matches = {p[:n]: None for p in self.ids for n in range(1, len(p))} | self.ids
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece reaches over the start of a word")
        self.spelling = [b""] * model.vocab_size()  # what a piece stands for; nothing for control pieces
        for piece, (i, _) in self.ids.items():
            self.spelling[i] = piece.encode()
        for value, i in self.byte_ids.items():
            self.spelling[i] = bytes([value])
        self.letters = np.fromiter(map(len, self.spelling), np.int64, len(self.spelling))
        self.trie = Trie(self.matches)

    def spelt(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode("utf-8", "replace"))

    def arcs(self, word: str, start: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
        """The lattice at a place: (end, pieces, score) of what matches there."""
        for end in range(start + 1, min(len(word), start + self.longest) + 1):
            found = self.matches.get(word[start:end], _NOTHING)
            if found:
                yield end, (found[0],), found[1]
            elif end == start + 1:
                yield end, self.spelt(word[start]), self.unknown
            if found is _NOTHING:
                return

    def leader(self, word: str) -> tuple[float, float, bytes, bool]:
        """Score of the best segmentation, what the second best loses, the best ids (32-bit), and whether they spell the word.

        Read backwards, the second best follows the best down to some place and
        leaves it there by another arc, so it loses what the best such arc loses.
        """
        n, get, longest, nothing = len(word), self.matches.get, self.longest, _NOTHING
        reach, second = [0.0] + [_NEVER] * n, [_NEVER] * (n + 1)
        back: list = [None] * (n + 1)
        for i in range(n):
            here = reach[i]
            for j in range(i + 1, min(n, i + longest) + 1):
                found = get(word[i:j], nothing)
                if found:
                    score = here + found[1]
                elif j == i + 1:
                    score = here + self.unknown
                elif found is None:
                    continue
                else:
                    break
                if score > reach[j]:
                    second[j], reach[j], back[j] = reach[j], score, (i, found)
                elif score > second[j]:
                    second[j] = score
                if found is nothing:
                    break
        place, loss, ids = n, np.inf, []
        while place:
            lost = reach[place] - second[place]
            if lost < loss:
                loss = lost
            start, found = back[place]
            if found:
                ids.append(found[0])
            else:
                ids += reversed(self.spelt(word[start]))
            place = start
        ids.reverse()
        spelt = b"".join(map(self.spelling.__getitem__, ids)) == word.encode("utf-8", "replace")
        return reach[n], loss, pack(f"<{len(ids)}I", *ids), spelt

    def leaders(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """What ``leader`` gives for each of many different words, short ones in arrays."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        scores, losses, ids, sound = np.zeros(len(words)), np.zeros(len(words)), [b""] * len(words), np.zeros(len(words), bool)
        for k in np.flatnonzero(sizes > _ARRAY_CHARS).tolist():
            scores[k], losses[k], ids[k], sound[k] = self.leader(words[k])
        short = np.flatnonzero(sizes <= _ARRAY_CHARS)
        if short.size:
            short = short[np.argsort(-sizes[short], kind="stable")]
            chosen = [words[k] for k in short.tolist()]
            scores[short], losses[short], found, sound[short] = self._in_arrays(chosen, sizes[short])
            for k, word_ids in zip(short.tolist(), found, strict=True):
                ids[k] = word_ids
        return scores, losses, ids, sound

    def _in_arrays(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bool]]:
        """``leaders`` of words with the longest first.

        Places (a word of n characters has n + 1) lie in the order of their number in
        the word, so the words that have a place are the first ones and keep their order:
        the next place of a word is as far on as its place has words.
        """
        having = np.searchsorted(-sizes, -np.arange(sizes[0] + 2), side="right")  # words that have a place
        first = np.concatenate([[0], np.cumsum(having)])  # where a place begins
        level = np.repeat(np.arange(len(having)), having)
        width = having[level]
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.cumsum(sizes)
        inside = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
        place = first[inside] + np.repeat(np.arange(len(words)), sizes)  # of each character
        char = np.full(first[-1], _END)
        char[place] = codes

        # The lattice: for each length the places where a piece of it begins, in order.
        arcs = []
        start = np.flatnonzero(char != _END)
        at, node = start, np.zeros(len(start), np.int32)
        for length in range(1, self.longest + 1):
            node = self.trie.step(node, char[at])
            if length == 1:
                piece = np.where(node < 0, -1, self.trie.piece[node])
                arcs.append((start, piece, np.where(piece < 0, self.unknown, self.trie.score[node])))
            else:
                hit = np.flatnonzero((node >= 0) & (self.trie.piece[node] >= 0))
                arcs.append((start[hit], self.trie.piece[node[hit]], self.trie.score[node[hit]]))
            on = np.flatnonzero((node >= 0) & self.trie.goes_on[node])
            start, at, node = start[on], at[on], node[on]
            at = at + width[at]

        # Forward, place by place; of equal scores the first, so the longest piece, stays.
        reach, second = np.full(first[-1], _NEVER), np.full(first[-1], _NEVER)
        reach[: having[0]] = 0.0
        back, via = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int32)
        bounds = [np.searchsorted(begin, first).tolist() for begin, _, _ in arcs]
        for i in range(int(sizes[0])):
            for length, (begin, piece, score) in enumerate(arcs, 1):
                a, b = bounds[length - 1][i : i + 2]
                if a == b:
                    continue
                start = begin[a:b]
                to = start + (first[i + length] - first[i])
                value, old = reach[start] + score[a:b], reach[to]
                better = value > old
                second[to] = np.where(better, old, np.maximum(second[to], value))
                reach[to] = np.maximum(old, value)
                to = to[better]
                back[to], via[to] = length, piece[a:b][better]

        # Backward along the best path of every word at once.
        last = first[sizes] + np.arange(len(words))
        losses, used = np.full(len(words), np.inf), np.zeros(first[-1], bool)
        which = np.flatnonzero(sizes)
        at = last[which]
        while at.size:
            used[at] = True
            losses[which] = np.minimum(losses[which], reach[at] - second[at])
            begins = level[at] - back[at]
            at = first[begins] + which
            which, at = which[begins > 0], at[begins > 0]

        after = place + width[place]  # the place behind each character, word by word again
        taken = np.flatnonzero(used[after])
        ids, n_ids = via[after[taken]], np.ones(len(taken), np.int64)
        strange = np.flatnonzero(ids < 0)
        if strange.size:
            unknown = codes[taken[strange]].tolist()
            spellings = {c: self.spelt(chr(c)) for c in set(unknown)}
            spelt = [spellings[c] for c in unknown]
            n_ids[strange] = list(map(len, spelt))
            by_bytes = np.repeat(ids < 0, n_ids)
            ids = np.repeat(ids, n_ids)
            ids[by_bytes] = list(chain.from_iterable(spelt))
        until = np.concatenate([[0], np.cumsum(n_ids)])[np.searchsorted(taken, np.concatenate([[0], ends]))]
        raw, text = ids.astype("<u4").tobytes(), self.spell(ids)
        letters = np.concatenate([[0], np.cumsum(self.letters[ids])])[until].tolist()
        sound = [text[a:b] == w.encode("utf-8", "replace") for w, (a, b) in zip(words, pairwise(letters), strict=True)]
        return reach[last], losses, [raw[4 * a : 4 * b] for a, b in pairwise(until.tolist())], sound

    def search(self, word: str, best: int = BEST) -> list[tuple[float, bytes]]:
        """Scores and ids of the best segmentations of one word (or any string), best first.

        Backward A*: the forward score of a place is exactly what the rest of a path
        adds at best, so complete paths leave the agenda in order.
        """
        reach = [0.0] + [_NEVER] * len(word)
        into: list[list[tuple]] = [[] for _ in reach]
        for start in range(len(word)):
            for end, pieces, score in self.arcs(word, start):
                into[end].append((start, pieces, score))
                reach[end] = max(reach[end], reach[start] + score)
        # (minus what the whole path scores at best, place, order), the score so far and the tail
        agenda: list = [(-reach[-1], len(word), 0, 0.0, None)]
        order, paths = 0, []
        while agenda and len(paths) < best:
            worth, place, _, score, tail = heapq.heappop(agenda)
            if not place:
                ids: list[int] = []
                while tail:
                    ids.extend(tail[0])
                    tail = tail[1]
                paths.append((-worth, np.array(ids, "<u4").tobytes()))
                continue
            for start, pieces, s in into[place]:
                order -= 1
                heapq.heappush(agenda, (-(reach[start] + s + score), start, order, s + score, (pieces, tail)))
        return paths

    def spell(self, ids: np.ndarray) -> bytes:
        """What the pieces stand for, spaces still marked."""
        return b"".join(map(self.spelling.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids; spaces are restored and the leading one that encoding added is dropped."""
        text = self.spell(ids).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def normalised(text: str) -> str:
    """Spaces as visible marks, one before the text; nothing else changes."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Words:
    """What ``Pieces.leaders`` gives for the words met so far; words are known by numbers."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.scores, self.losses, self.ids, self.sound = np.zeros(0), np.zeros(0), [], np.zeros(0, bool)

    def learn(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the words of each text; they hold until the next call."""
        if len(self.number) > _CACHE:
            self.forget()
        known = len(self.number)
        numbers = [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)) for words in texts]
        new = list(islice(reversed(self.number), len(self.number) - known))[::-1]
        if new:
            scores, losses, ids, sound = self.pieces.leaders(new)
            self.scores, self.losses = np.concatenate([self.scores, scores]), np.concatenate([self.losses, losses])
            self.sound = np.concatenate([self.sound, sound])
            self.ids.extend(ids)
        return numbers


def batch_segmenter(pieces: Pieces, best: int = BEST) -> Callable[[list[str | None]], Iterator[list[Path]]]:
    """Kernel: the ``best`` segmentations of each of many texts, best first; a null or empty text has one, of no pieces."""
    words = Words(pieces)
    remembered: dict[str, tuple[list[tuple[float, bytes]], bool]] = {}
    # A choice of paths is no better than those with earlier paths of the same words, so it is among the best
    # only if these are fewer.
    few: list[list[tuple[int, ...]]] = [[()]]
    while len(few) < best:
        few.append([(*cs, c) for cs in few[-1] for c in range(best // prod(c + 1 for c in cs))])

    def searched(word: str) -> tuple[list[tuple[float, bytes]], bool]:
        found = remembered.get(word)
        if not found:
            paths = pieces.search(word, best)
            exact = word.encode("utf-8", "replace")
            found = paths, all(pieces.spell(np.frombuffer(ids, "<u4")) == exact for _, ids in paths)
            if len(word) <= _ARRAY_CHARS and len(remembered) < _CACHE // best:
                remembered[word] = found
        return found

    def segment(text: str | None, spelt: list[str], at: np.ndarray) -> list[Path]:
        losses, total = words.losses[at], float(words.scores[at].sum())
        ids = list(map(words.ids.__getitem__, at.tolist()))
        # Words that spell themselves spell the text, but for a mark of its own, which decoding takes for a space.
        whole_text = bool(words.sound[at].all()) and SPACE not in (text or "")
        # Of combinations that lose least, every word that departs from its best is among the
        # best - 1 words whose second path loses least: as many single departures lose no more.
        near = np.arange(len(losses) if best > 1 else 0)
        if len(near) >= best:
            near = np.flatnonzero(losses <= np.partition(losses, best - 2)[best - 2])
        near = near[np.argsort(losses[near], kind="stable")][: best - 1].tolist()
        places = sorted(k for k in near if losses[k] < np.inf)
        paths, exact = zip(*(searched(spelt[k]) for k in places), strict=True) if places else ((), ())
        lost = [[p[0][0] - score for score, _ in p] for p in paths]
        choices = (cs for cs in few[len(places)] if all(c < len(p) for c, p in zip(cs, paths, strict=True)))
        ranked = sorted((sum(x[c] for x, c in zip(lost, cs, strict=True)), cs) for cs in choices)
        between = [b"".join(ids[a + 1 : b]) for a, b in pairwise([-1, *places, len(ids)])]
        found: list[Path] = []
        for loss, cs in ranked[:best]:
            parts = (p[c][1] + rest for p, c, rest in zip(paths, cs, between[1:], strict=True))
            # Other paths differ from the first in the searched words alone.
            same = found[0][2] and all(exact) if found else whole_text
            found.append((total - loss, np.frombuffer(b"".join([between[0], *parts]), "<u4"), same))
        return found

    def batch(texts: list[str | None]) -> Iterator[list[Path]]:
        spelt = [_WORD.findall(normalised(t or "")) for t in texts]
        yield from map(segment, texts, spelt, words.learn(spelt))

    def segment_all(texts: list[str | None]) -> Iterator[list[Path]]:
        begin = chars = 0
        for k, text in enumerate(texts):
            if k > begin and chars + len(text or "") > _BATCH_CHARS:
                yield from batch(texts[begin:k])
                begin, chars = k, 0
            chars += len(text or "")
        yield from batch(texts[begin:])

    return segment_all


def segmenter(pieces: Pieces, best: int = BEST) -> Callable[[str | None], list[Path]]:
    """Kernel: the ``best`` segmentations of one whole text."""
    segment_all = batch_segmenter(pieces, best)
    return lambda text: next(segment_all([text]))


def segment_documents(docs: DataFrame, text: str = "text", path: str = MODEL, best: int = BEST) -> DataFrame:
    """Digest of the best segmentations of every row.

    ``n_pieces`` and ``ids_crc32`` (little-endian unsigned 32-bit ids) are of the
    best one, ``scores`` and ``crcs`` of all, best first, comma-joined;
    ``round_trip`` tells whether all decode to the text.  Equal scores are ordered
    by the place of the departing word.
    """

    def make():
        pieces = Pieces(path)
        segment_all = batch_segmenter(pieces, best)

        def kernel(doc_ids: list, texts: list) -> Iterator[tuple]:
            for i, paths in zip(doc_ids, segment_all(texts), strict=True):
                crcs = [zlib.crc32(ids) for _, ids, _ in paths]
                scores = ",".join(f"{s:.0f}" for s, _, _ in paths)
                same = all(p[2] for p in paths)
                yield i, len(paths[0][1]), crcs[0], paths[0][0], scores, ",".join(map(str, crcs)), same

        return kernel

    plain = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("t"))
    schema = "doc_id long, n_pieces long, ids_crc32 long, best_score double, scores string, crcs string, round_trip boolean"
    return arrow_map(plain, make, schema)


def segmentation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best segmentations of every document."""
    return segment_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
