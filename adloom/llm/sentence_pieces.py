"""Operator 13: SentencePiece encoding and decoding of merge-type vocabularies.

A normalised text starts as its characters.  All adjacent pairs that are a piece stand on
an agenda, ordered by score, then by place; the best one is merged, the new symbol's two
pairs join the agenda, and entries whose symbols have meanwhile changed are skipped.  What
is no piece in the end falls back to the bytes of its characters.  New words of up to 32
characters are merged many at a time, the agenda of each a row of an array (an entry for
each place); longer ones one by one, the agenda a heap.

Merges only make pieces, so a text falls apart wherever two characters stand side by side
in no piece.  If no piece holds a mark for a space after another character (checked on the
vocabulary), words with the marks before them are merged on their own, equal words of an
Arrow slice once.  Long words are cut once more at character pairs
that no piece holds.  Otherwise the whole text is one word.

Vocabulary, scores and the text normalisation come from the model through the sentencepiece
library.  Each Arrow slice is then checked against the library: the ids of all its different
words (texts of many words, put together so that no piece can reach across), and every
text's decoded form.  Should a word differ, or the vocabulary not allow words, whole texts are
encoded by the library too; where they differ, its result is returned and ``agreed`` is false.

Defined results: null and empty texts have no ids and decode to an empty text; a text of any
length is encoded whole (a worker holds some 100 bytes for each byte of the longest text);
rows are independent, so ties, repeated rows and empty tables need no care.  Carried
columns keep their names; one that clashes with an output column raises ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.llm.common import bounded_texts

#: Fixed value: the mark that stands for a space in pieces.
SPACE = "▁"
NO_ENTRY = 1 << 62
LONGEST = 32


class PairTable:
    """The symbol that two neighbouring symbols make, and the place of symbols by score.

    Symbols are the pieces (numbered by ``pieces``) and, after them, characters that are in
    pieces without being one."""

    def __init__(self, scores: dict[str, float], pieces: dict[str, int], n_ids: int):
        number = dict(pieces)
        for c in sorted({c for p in pieces for c in p} - set(pieces)):
            number[c] = n_ids + len(number) - len(pieces)
        pairs = {(number[p[:i]] << 32) | number[p[i:]]: n for p, n in pieces.items() for i in range(1, len(p))
                 if p[:i] in number and p[i:] in number}
        self.mask = (1 << max(4, (4 * len(pairs)).bit_length())) - 1   # a sparse table with open addressing
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.made = np.full(self.mask + 1, -1, np.int64)
        todo, made = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        at = self._slot(todo)
        while len(todo):
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)             # of those that want a free slot, one gets it
            won = free[one]
            self.keys[at[won]], self.made[at[won]] = todo[won], made[won]
            rest = np.setdiff1d(np.arange(len(todo)), won)
            todo, made, at = todo[rest], made[rest], (at[rest] + 1) & self.mask
        places = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.place = np.full(n_ids + 1, NO_ENTRY >> 6, np.int64)       # the last one stands for no symbol
        for p, n in pieces.items():
            self.place[n] = places[scores[p]]
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, n in number.items():
            if len(c) == 1:
                self.of_char[ord(c)] = n

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)).view(np.int64) & self.mask

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol made, or -1; a negative symbol stands for none."""
        key = (left << 32) | right
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.made[at], -1)
        open_ = np.flatnonzero((held != key) & (held >= 0) & (key >= 0))
        at, flat = at.ravel()[open_], out.ravel()
        while len(open_):                                               # the next slots, for the few not settled
            at = (at + 1) & self.mask
            held, wanted = self.keys[at], key.ravel()[open_]
            hit = held == wanted
            flat[open_[hit]] = self.made[at[hit]]
            stay = ~hit & (held >= 0)
            open_, at = open_[stay], at[stay]
        return out


class PieceModel:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        lib = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.surface: list[bytes] = []                  # what an id decodes to, before the first space goes
        byte_ids: dict[int, int] = {}
        for i in range(lib.vocab_size()):
            piece = lib.id_to_piece(i)
            if lib.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            if lib.is_control(i):
                self.surface.append(b"")
            elif lib.is_unknown(i):
                self.surface.append(lib.decode([i]).encode())
            elif lib.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                self.surface.append(bytes([int(piece[1:-1], 16)]))
            else:
                self.ids[piece], self.scores[piece] = i, lib.get_score(i)
                self.surface.append(piece.replace(SPACE, " ").encode())
        self.unknown = lib.unk_id()
        self.byte_ids = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None
        self.names = [str(i) for i in range(lib.vocab_size())]
        self.pairs = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        lone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.pairs))
        self.by_word = not any(p[1] == SPACE != p[0] for p in self.pairs)
        self.has_lone = re.compile(f"[{lone}]").search if lone else None
        self.parts = re.compile(f"[{lone}]|[^{lone}]+").findall if lone else None
        self.strip = lib.normalize("x").startswith(SPACE)   # a mark is put before the text, and taken off again
        self.table = PairTable(self.scores, self.ids, lib.vocab_size())

    def merge(self, word: str) -> list[str]:
        """Symbols left when the agenda is empty."""
        scores, symbols, n = self.scores, list(word), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []

        def add(left: int, right: int) -> None:
            made = symbols[left] + symbols[right]
            score = scores.get(made)
            if score is not None:
                heapq.heappush(agenda, (-score, left, right, len(made)))

        for i in range(n - 1):
            add(i, i + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue                                    # one of the two has changed since
            symbols[left], symbols[right] = a + b, ""
            after[left] = end = after[right]
            if end < n:
                before[end] = left
                add(left, end)
            if before[left] >= 0:
                add(before[left], left)
        return [s for s in symbols if s]

    def _ids_of(self, word: str) -> bytes:
        """Ids of one word, little-endian 32-bit integers."""
        parts = [word]
        if len(word) > LONGEST:                             # cut where no piece reaches across
            cuts = [0, *[i for i in range(1, len(word)) if word[i - 1:i + 1] not in self.pairs], len(word)]
            parts = [word[a:b] for a, b in zip(cuts, cuts[1:])]
        out: list[int] = []
        for part in parts:
            for symbol in self.merge(part):
                i = self.ids.get(symbol)
                if i is not None:
                    out.append(i)
                elif self.byte_ids is not None:
                    out += map(self.byte_ids.__getitem__, symbol.encode())
                else:
                    out.append(self.unknown)
        return array("i", out).tobytes()

    def merge_many(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of many words (rows padded with -1) and their number for each word.

        Every round takes the best entry of each agenda that has one."""
        n, width = symbols.shape
        table, bits = self.table, width.bit_length() - 1
        symbol = np.full((n, width + 1), -1, np.int64)
        symbol[:, :width] = symbols
        after = np.minimum(np.arange(1, width + 2)[None, :], sizes[:, None])
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        made = table.join(symbol[:, :width], symbol[:, 1:])
        agenda = np.where(made >= 0, (table.place[made] << bits) | np.arange(width), NO_ENTRY)
        symbol_of, after_of, before_of, made_of, entry_of = (x.ravel() for x in (symbol, after, before, made, agenda))
        best = agenda.min(axis=1)
        rows = np.flatnonzero(best < NO_ENTRY)
        best = best[rows]
        while len(rows):
            i = best & (width - 1)
            at, line = rows * (width + 1), rows * width
            j = after_of[at + i]                            # the symbol at j joins the one at i
            k = after_of[at + j]
            h = before_of[at + i]
            new = made_of[line + i]
            symbol_of[at + i] = new
            symbol_of[at + j] = -1
            after_of[at + i] = k
            before_of[at + k] = i                           # k is at most the spare place
            entry_of[line + j] = NO_ENTRY
            right = table.join(new, np.where(k < sizes[rows], symbol_of[at + k], -1))
            made_of[line + i] = right
            entry_of[line + i] = np.where(right >= 0, (table.place[right] << bits) | i, NO_ENTRY)
            on = np.flatnonzero(h >= 0)
            left, h = table.join(symbol_of[(at + h)[on]], new[on]), h[on]
            made_of[line[on] + h] = left
            entry_of[line[on] + h] = np.where(left >= 0, (table.place[left] << bits) | h, NO_ENTRY)
            best = agenda[rows].min(axis=1)
            rows, best = rows[best < NO_ENTRY], best[best < NO_ENTRY]
        live = symbol[:, :width] >= 0
        return symbol[:, :width][live], live.sum(axis=1)

    def _ids_of_many(self, words: list[str]) -> list[bytes]:
        """Ids of new words: short ones of known characters together, by size."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        low = 2
        for i in np.flatnonzero((lengths < 2) | (lengths > LONGEST)).tolist():
            out[i] = self._ids_of(words[i])
        for width in (8, 16, LONGEST):
            of = np.flatnonzero((lengths >= low) & (lengths <= width))
            low = width + 1
            for start in range(0, len(of), 8192):
                part = of[start:start + 8192]
                sizes, here = lengths[part], [words[i] for i in part.tolist()]
                chars = self.table.of_char[np.frombuffer("".join(here).encode("utf-32-le"), np.uint32)]
                symbols = np.full((len(part), width), -1, np.int64)
                symbols[np.arange(width)[None, :] < sizes[:, None]] = chars
                strange = np.zeros(len(part), bool)         # a character of no piece: bytes, one by one
                strange[np.repeat(np.arange(len(part)), sizes)[chars < 0]] = True
                left, counts = self.merge_many(symbols, sizes)
                strange |= np.bincount(np.repeat(np.arange(len(part)), counts)[left >= len(self.names)], minlength=len(part)) > 0
                packed, ends = left.astype("<i4").tobytes(), np.cumsum(counts) * 4
                for i, a, b in zip(part.tolist(), (ends - 4 * counts).tolist(), ends.tolist()):
                    out[i] = packed[a:b]
                for k in np.flatnonzero(strange).tolist():
                    out[part[k]] = self._ids_of(here[k])
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of different words; one with line breaks or tabs part by part."""
        if not self.has_lone or not self.has_lone("".join(words)):
            return self._ids_of_many(words)
        parts = {i: self.parts(w) for i, w in enumerate(words) if self.has_lone(w)}
        pieces = sorted(set().union(*parts.values()))
        ids = self._ids_of_many(["" if i in parts else w for i, w in enumerate(words)] + pieces)
        found = dict(zip(pieces, ids[len(words):]))
        del ids[len(words):]
        for i, those in parts.items():
            ids[i] = b"".join(map(found.__getitem__, those))
        return ids

    def _units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different words of normalised texts, the word at each place, and the places where texts begin.

        A text is split at the marks; a run of marks belongs to the word behind it."""
        if not self.by_word:
            return texts, np.arange(len(texts)), np.arange(len(texts) + 1)
        lists = pc.split_pattern(pa.array(texts, pa.string()), SPACE)
        tokens = lists.flatten().dictionary_encode()
        words = pc.binary_join_element_wise(SPACE, tokens.dictionary, "").to_numpy(zero_copy_only=False).tolist()
        unit, begins = tokens.indices.to_numpy().astype(np.int64), np.asarray(lists.offsets).astype(np.int64)
        number: dict[str, int] = {"": len(words)}
        blank = unit == (words.index(SPACE) if SPACE in words else -1)
        words.append("")
        unit[blank] = number[""]

        def put(at: int, word: str) -> None:
            unit[at] = number.setdefault(word, len(words))
            if number[word] == len(words):
                words.append(word)

        first = begins[:-1]
        for at in first[~blank[first]].tolist():             # no mark before the first word
            put(at, words[unit[at]][1:])
        blank[first] = False
        edges = np.flatnonzero(np.diff(np.concatenate(([False], blank, [False])).astype(np.int8)))
        ends = set(begins[1:].tolist())
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b in ends:                                    # marks at the end of a text
                put(b - 1, SPACE * (b - a))
            else:
                put(b, SPACE * (b - a) + words[unit[b]])
        return words, unit, begins

    def confirmed(self, words: list[str], ids: list[bytes], together: int = 1000) -> bool:
        """Does the library give the same ids for all words?  False as well if words can't be told apart."""
        if not self.by_word:
            return False

        def same(text: str, expected: bytes) -> bool:
            given = text[1:] if self.strip else text         # the library puts the first mark there itself
            return self.library.normalize(given) == text and array("i", self.library.encode(given)).tobytes() == expected

        whole, runs = [], []
        for i, w in enumerate(words):
            if w:
                (whole if w[0] == SPACE and w[-1] != SPACE else runs).append(i)
        if not all(same("".join([words[i] for i in whole[a:a + together]]), b"".join([ids[i] for i in whole[a:a + together]]))
                   for a in range(0, len(whole), together)):
            return False
        lead = SPACE + "a"                                   # marks at the end of a text, behind another word
        return all(same(lead + words[i], self._ids_of(lead) + ids[i]) if words[i][0] == SPACE else same(words[i], ids[i]) for i in runs)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        return self.encode_checked(texts, check=False)[0]

    def encode_checked(self, texts: list[str], check: bool = True) -> tuple[list[np.ndarray], bool]:
        """Ids of each text, and whether the library agrees on all their words."""
        words, unit, begins = self._units(self.library.normalize(texts) if texts else [])
        ids = self._known(words)
        sure = check and self.confirmed(words, ids)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<i4"), np.cumsum(sizes) - sizes
        sizes = sizes[unit]
        after = np.concatenate(([0], np.cumsum(sizes)))
        all_ids = flat[np.repeat(starts[unit] - after[:-1], sizes) + np.arange(after[-1])]
        out = [all_ids[a:b] for a, b in zip(after[begins[:-1]].tolist(), after[begins[1:]].tolist())]
        if self.byte_ids is None:                           # a run of unknown symbols is one id
            out = [x[(x != self.unknown) | (np.concatenate(([-1], x[:-1])) != self.unknown)] for x in out]
        return out, sure

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.strip and text.startswith(" ") else text


@lru_cache(maxsize=4)
def shared_model(path: str) -> PieceModel:
    """One model per Python worker and file."""
    return PieceModel(path)


def checked(model: PieceModel, texts: list[str]):
    """Ids, decoded text and agreement of each text, held against the library's; where they differ the library's count."""
    lib = model.library
    encoded, sure = model.encode_checked(texts)
    for text, own in zip(texts, encoded):
        ids = own.tolist()
        wanted = ids if sure else lib.encode(text)
        decoded, there = model.decode(ids), lib.decode(wanted)
        agreed = ids == wanted and decoded == there
        yield (ids, decoded, True) if agreed else (wanted, there, False)


def piece_round_trip(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """The ``carry`` columns, n_tokens, ids_sha256, decoded_sha256, agreed and, if asked, the ids and the decoded text."""
    own = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
           T.StructField("decoded_sha256", T.StringType()), T.StructField("agreed", T.BooleanType()),
           *([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if with_ids else [])]
    clash = sorted({f.name for f in own} & set(carry))
    if clash:
        raise ValueError(f"carried columns {clash} clash with columns of the result")
    schema = T.StructType([*[docs.schema[c] for c in carry], *own])

    def run(batches):
        model = shared_model(path)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.string()]
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for b in bounded_texts(batches, 4 << 20, "__text"):
            texts = [t or "" for t in b.column(len(carry)).to_pylist()]
            rows = [(len(ids), sha(",".join(map(model.names.__getitem__, ids))), sha(decoded), agreed, *((ids, decoded) if with_ids else ()))
                    for ids, decoded, agreed in checked(model, texts)]
            columns = [b.column(i) for i in range(len(carry))]
            columns += [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(run, schema)

