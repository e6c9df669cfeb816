"""Byte-pair encoding with a pair occurrence index.

All distinct words of a block are laid out as one array of symbols.  An index
maps every mergeable pair, by its rank, to all its positions in the block; the
active ranks are taken in ascending order, each merge is applied to all its
positions at once, and only the lists of the pairs that a merge touches change.

Text is cut at ASCII white space first, which no token reaches across; a piece
between is encoded once and looked up while the task's memory holds it.
"""

from __future__ import annotations

import functools
import gc
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices, trimmed

#: Pieces in one generation of a task's memory, the same for one that the worker keeps, and letters of the longest that either holds.
GENERATION, KEPT, LONGEST = 150_000, 500_000, 64
#: Bytes of text in a block (eight times as many for a kept memory), and letters of new pieces that are encoded together (four times as many for a kept memory).
BLOCK, LEARNT = 4 << 20, 1 << 19

# Marks that Unicode got after version 9, as ranges.  The library's
# tables of canonical order do not know them, so nothing is moved or composed
# across one of them.
LATE_MARKS = (
    (0x07FD, 0x07FD), (0x0898, 0x089F), (0x08CA, 0x08D3), (0x09FE, 0x09FE), (0x0C3C, 0x0C3C), (0x0D3B, 0x0D3C), (0x0EBA, 0x0EBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27),
    (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943),
    (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136),
    (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
# Letters and numbers that Unicode got after version 16, as ranges.  The library's splitter takes them for signs.
LATE_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x16FF4, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
# Capital letters that Unicode got after version 15, as ranges, and the small letter of the first of each.
LATE_CAPITALS = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))

_LATE_MARK, _LATE_LETTER = (re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "])") for ranges in (LATE_MARKS, LATE_LETTERS))
_LATE = np.zeros(0x110000, bool)
for _first, _last, *_ in (*LATE_MARKS, *LATE_LETTERS, *LATE_CAPITALS):
    _LATE[_first : _last + 1] = True
_LATE_SMALL = {a + k: chr(small + k) for a, b, small in LATE_CAPITALS for k in range(b - a + 1)}


#: Signs that stand alone behind letters, as most words with a sign have it.
_SIGNS = frozenset('.,;:!?")')


def _holds_late(text: str) -> bool:
    """Whether Unicode got any of these characters late."""
    return not text.isascii() and bool(_LATE[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(shifted)) for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary file (``tokenizers`` JSON) with ends of words marked.

    Raises ValueError for a file whose normalizer, splitter or model differs from
    what is built here, instead of encoding something else.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError(f"{path}: not a lower-casing word BPE without a decoder")
        self.end = model["end_of_word_suffix"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special)))
        vocabulary = model["vocab"]
        self.tokens = {i: t for t, i in (vocabulary | self.special).items()}
        self.names = pa.array([self.tokens.get(i, "") for i in range(max(self.tokens) + 1)], pa.string())
        symbols = _byte_symbols()
        self.byte_ids = np.array([vocabulary[s] for s in symbols], np.int64)
        self.end_ids = np.array([vocabulary[s + self.end] for s in symbols], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = max(vocabulary.values()) + 1
        left, right = (np.array([vocabulary[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.left, self.right, self.made = left, right, made
        codes = left * self.width + right
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]
        # the rank of each two bytes in a row, and then of those that end a word
        pairs = np.arange(1 << 16)
        self.byte_ranks = np.concatenate([self.ranks(self.byte_ids[pairs >> 8], ids[pairs & 255]) for ids in (self.byte_ids, self.end_ids)]).astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for those that never merge."""
        codes = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.order[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of non-empty words in a row and where each word's begin and the last one's end, by merging over the block's pair occurrence index."""
        return self._merged(np.frombuffer(b"".join(words), np.uint8), np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))

    def _merged(self, raw: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the bytes of all words and where each word ends."""
        if not len(stops):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        begins = np.concatenate(([0], stops[:-1]))
        n = len(raw)
        # one sentinel at either end; symbol -1 joins no pair
        symbol = np.full(n + 2, -1, np.int32)
        symbol[1:-1] = self.byte_ids[raw]
        symbol[stops] = self.end_ids[raw[stops - 1]]
        following = np.arange(1, n + 3, dtype=np.int32)
        before = np.arange(-1, n + 1, dtype=np.int32)
        following[stops] = n + 1
        before[begins + 1] = 0
        following[n + 1] = n + 1
        alive = np.ones(n + 2, bool)

        # numbers of 16 bits are sorted by counting
        narrow = np.uint16 if len(self.codes) <= 1 << 16 else np.int64
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(positions: np.ndarray) -> None:
            """Enter the pairs that begin at these positions into the index."""
            after = following[positions]
            inside = after <= n
            positions, after = positions[inside], after[inside]
            enter(self.ranks(symbol[positions], symbol[after]), positions)

        def enter(rank: np.ndarray, positions: np.ndarray) -> None:
            found = rank >= 0
            if not found.any():
                return
            rank, positions = rank[found].astype(narrow), positions[found]
            by = np.argsort(rank, kind="stable")
            rank, positions = rank[by], positions[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            firsts = [0, *cuts.tolist()]
            for r, start, stop in zip(rank[firsts].tolist(), firsts, [*firsts[1:], len(rank)]):
                at = positions[start:stop]
                if (held := index.get(r)) is None:
                    index[r] = [at]
                    heapq.heappush(active, r)
                else:
                    held.append(at)

        # all pairs are of bytes at first; the last byte of a word begins none
        pair = raw[:-1].astype(np.int32) << 8 | raw[1:]
        pair[stops[stops < n] - 1] = -1
        pair[(stops - 2)[stops - begins > 1]] += 1 << 16
        positions = np.flatnonzero(pair >= 0).astype(np.int32)
        enter(self.byte_ranks[pair[positions]], positions + 1)
        del pair, positions
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = np.sort(lists[0] if len(lists) == 1 else np.concatenate(lists))
            repeated = at[1:] == at[:-1]
            if repeated.any():
                at = at[np.concatenate(([True], ~repeated))]
            a, b = self.left[rank], self.right[rank]
            after = following[at]
            at = at[alive[at] & (symbol[at] == a) & (symbol[after] == b)]
            if not len(at):
                continue
            if a == b and len(at) > 1:
                # in a run of overlapping pairs every other one merges, from the left
                chained = np.concatenate(([False], at[1:] == following[at[:-1]]))
                runs = np.flatnonzero(~chained)
                place = np.arange(len(at)) - np.repeat(runs, np.diff(np.append(runs, len(at))))
                at = at[place % 2 == 0]
            after = following[at]
            beyond = following[after]
            symbol[at] = self.made[rank]
            alive[after] = False
            following[at] = beyond
            before[beyond] = at  # the last sentinel's value is never read
            previous = before[at]
            add(np.concatenate((previous[previous > 0], at)))
        kept = np.flatnonzero(alive[1:-1])
        ids = symbol[1:-1][kept]
        return ids, np.concatenate((np.searchsorted(kept, begins), [len(ids)]))

    def _words(self, text: str) -> list[str]:
        """What the splitter finds in normalised text; letters and numbers that the library's tables do not have count as signs."""
        return [text[m.start() : m.end()] for m in self.pattern.finditer(_LATE_LETTER.sub("\ue000", text))]

    def _parts(self, piece: str) -> list[int | bytes]:
        """A piece that may hold special tokens, as their ids and the words between."""
        parts: list[int | bytes] = []
        start = 0
        for found in [*self.special_pattern.finditer(piece), None]:
            if plain := piece[start : found.start() if found else None]:
                parts += [w.encode() for w in self._words(_normal(plain))]
            if found:
                parts.append(self.special[found[0]])
                start = found.end()
        return parts

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Each piece between white space as little-endian ids."""
        plain, joined = pieces, "\n".join(pieces)
        if special := "<|" in joined:
            plain = [p for p in pieces if "<|" not in p]
            joined = "\n".join(plain)
        late = _holds_late(joined)
        find = self._words if late else self.pattern.findall
        # no form of normalisation reaches across a line end, and pieces hold none
        lows = _normal(joined, late).split("\n") if plain else []
        del joined
        parts = [(low,) if low.isalpha() else (low[:-1], low[-1]) if low[-1:] in _SIGNS and low[:-1].isalpha() else find(low) for low in lows]
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
        # neither do words
        lines = np.frombuffer("".join([f"{w}\n" for words in parts for w in words]).encode(), np.uint8)
        del lows, parts
        inner = lines != 10
        stops = np.flatnonzero(~inner)
        flat, starts = self._merged(lines[inner], stops - np.arange(len(stops)))
        raw = flat.astype("<u4").tobytes()
        at = (4 * starts[bounds]).tolist()
        found = [raw[a:b] for a, b in zip(at, at[1:])]
        if not special:
            return found
        rest = iter(found)
        return [next(rest) if "<|" not in p else self._special(p) for p in pieces]

    def _special(self, piece: str) -> bytes:
        parts = self._parts(piece)
        plain, starts = self.merge([x for x in parts if isinstance(x, bytes)])
        each = iter(np.split(plain, starts[1:-1]))
        return np.concatenate([np.zeros(0, np.int64), *(next(each) if isinstance(x, bytes) else [x] for x in parts)]).astype("<u4").tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens in a row, as a vocabulary without a decoder prints them; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The same for every list of known ids."""
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.names.take(lists.values)), " ")


def _normal(text: str, late: bool = True) -> str:
    """Composed and in lower case, letter by letter: no context, so a final sigma stays plain; ``late`` if it may hold what Unicode got late."""
    if text.isascii():
        return text.lower()
    if not late:
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
    composed = "".join(unicodedata.normalize("NFC", part) for part in _LATE_MARK.split(text))
    return composed.translate(_LATE_SMALL).replace("\u03a3", "\u03c3").lower()


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    """The vocabulary at ``path``, loaded once per worker."""
    return WordBpe(path)


class Remembered:
    """Pieces to little-endian ids, for one task, in two generations.

    Once a generation is full it becomes the older one, from which pieces come
    back when they are met again; what was not met by then is forgotten.  Only
    pieces of at most :data:`LONGEST` letters are held, so its size is bounded in bytes.
    """

    def __init__(self, bpe: WordBpe, generation: int | None = None):
        self.bpe, self.generation = bpe, generation or GENERATION
        self.learnt = LEARNT * (4 if generation else 1)
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def coded(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        found = list(map(self.ids.get, pieces))
        lacking = [k for k, ids in enumerate(found) if ids is None]
        if self.older:
            for k in lacking:
                found[k] = self.older.get(pieces[k])
        new = [k for k in lacking if found[k] is None]
        if new:
            before = np.cumsum([len(pieces[k]) for k in new]) // self.learnt
            cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(new)]
            for start, stop in zip(cuts, cuts[1:]):
                for k, ids in zip(new[start:stop], self.bpe.encode_pieces([pieces[k] for k in new[start:stop]])):
                    found[k] = ids
        held = [(pieces[k], found[k]) for k in lacking if len(pieces[k]) <= LONGEST]
        for start in range(0, len(held), self.generation):
            some = held[start : start + self.generation]
            if len(self.ids) + len(some) > self.generation:
                self.older, self.ids = self.ids, {}
            self.ids.update(some)
        return found


@functools.lru_cache(maxsize=1)
def _kept(path: str) -> Remembered:
    return Remembered(vocabulary(path), KEPT)


def encode_batches(path: str, batches: Iterable[pa.RecordBatch], decode: bool, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Add ids (list of int) and, if asked, decoded text to batches whose last column is the text; the text goes.

    What a task remembers ends with it, so that a worker that other operators use
    holds the vocabulary alone; with ``keep`` the next task of the worker goes on from it.
    """
    memory = _kept(path) if keep else Remembered(vocabulary(path))
    collected = gc.isenabled()
    gc.disable()  # many small live objects and no cycles
    try:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for start, stop in slices(column, BLOCK * (8 if keep else 1)):
                lists = _coded_block(memory, column[start:stop])
                columns = [*(c[start:stop] for c in batch.columns[:-1]), lists]
                if decode:
                    columns.append(memory.bpe.decode_lists(lists))
                yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])
    finally:
        del memory
        if collected:
            gc.enable()
        if not keep:
            trimmed()


def _coded_block(memory: Remembered, texts: pa.Array) -> pa.ListArray:
    """The ids of each text."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = split.flatten().dictionary_encode()
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    del split
    # every occurrence takes its piece's ids from where they stand once
    blobs = memory.coded(_listed(coded.dictionary))
    ends = np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4)
    once = np.frombuffer(b"".join(blobs), "<u4").view(np.int32)
    del blobs
    # a block's ids are far fewer than 2**31
    taken = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(once)).take(coded.indices)
    return pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[bounds]), taken.values)


def _listed(pieces: pa.StringArray) -> list[str]:
    """Pieces between white space as a list; far faster than one by one."""
    if not len(pieces):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), "\n")[0].as_py().split("\n")


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", decode: bool = False, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Encode every whole text; ``keep`` columns pass through.

    Returns ``keep`` + ``ids`` array<int> [+ ``decoded`` string].  A null or
    empty text, or one of white space only, has no ids and decodes to "".  Rows
    are independent: repeated rows and repeated ids each give a row, an empty
    table gives an empty table, other columns of the input are ignored.
    """
    picked = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").cast("string"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    schema = ", ".join([*fields, f"`{ids}` array<int>", *[f"`{decoded}` string"] * decode])
    names = [*keep, ids, *[decoded] * decode]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in encode_batches(path, batches, decode):
            yield out.rename_columns(names)

    return picked.mapInArrow(run, schema)


def decode(frame: DataFrame, path: str, keep: list[str], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Decode a column of ids; null ids decode to "", unknown ids are left out."""
    picked = frame.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{ids}`").cast("array<int>"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = pa.array([bpe.decode(x or ()) for x in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*keep, decoded])

    return picked.mapInArrow(run, ", ".join([*fields, f"`{decoded}` string"]))
