"""Token numbers of whole texts through the tokenizer libraries, piece by piece.

A tokenizer that joins no token across certain boundaries gives the same ids for a text as for its pieces between them.
Pieces are found and hashed on the UTF-8 buffer; the ids of each distinct piece are looked up in a table of bounded size
that a Python worker keeps from one batch to the next, and the library encodes each unknown piece.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from facetledger.llm.text import hash_runs

ENTRIES = 600_000
SPACES = b" \n\t\r"


class Table:
    """Lists of numbers by 64-bit hash, as sorted arrays. Beyond ``entries`` it begins anew with the pieces in hand."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], entries: int = ENTRIES) -> None:
        self.encode, self.entries = encode, entries
        self.keys, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def look_up(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece where its numbers begin in ``flat`` and how many they are."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.entries:
            self.__init__(self.encode, self.entries)
        at = np.searchsorted(self.keys, distinct)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
        else:
            known = np.zeros(len(distinct), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            found = self.encode([raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            begins = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.concatenate([self.flat, *found])
            self.keys, self.begin, self.size = (np.insert(x, at[new], y) for x, y in ((self.keys, distinct[new]), (self.begin, begins), (self.size, sizes)))
            at = np.searchsorted(self.keys, distinct)
        at = at[inverse.ravel()]
        return self.begin[at], self.size[at]


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all pieces, one after the other."""
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]


class PieceCounts:
    """Token counts by a sentencepiece BPE model. A piece is a run of spaces with the word behind it, or a line end. The
    model writes a space as ▁, and puts one in front of a text.

    It needs a model that joins no token across the start of a run of spaces or a line end, and that changes no
    character; any other model is refused.
    """

    def __init__(self, path: str, every: bool = False) -> None:
        import sentencepiece

        self.model, self.every = sentencepiece.SentencePieceProcessor(model_file=path), every
        tokens = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in t.lstrip("▁") or "\n" in t for t in tokens) or self.model.encode("a  b ", out_type=str)[0] != "▁a" or len(self.model.encode("\n")) != 2:
            raise ValueError(f"{path}: tokens of this model span words; count whole texts instead")
        self.table = Table(self._encode, ENTRIES // 20 if every else ENTRIES)

    def _encode(self, pieces: list[str]) -> list[np.ndarray]:
        """Behind a line end a piece gets no other mark in front; the mark and the line end are two tokens. One number a
        piece, or one for each of its beginnings."""
        if self.every:
            return [np.array([len(x) - 2 for x in self.model.encode([f"\n{p[: k + 1]}" for k in range(len(p))], num_threads=1)], np.uint32) for p in pieces]
        counts = np.array([len(x) - 2 for x in self.model.encode([f"\n{p}" for p in pieces], num_threads=1)], np.uint32)
        return np.split(counts, len(counts))[: len(counts)] if len(counts) > 1 else [counts]

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The buffer with a space in front of each text that is not empty and ▁ as a space, starts and ends of its pieces,
        and the first piece of each text."""
        full = np.flatnonzero(np.diff(offsets) > 0)
        raw = np.insert(data, offsets[full], 32).tobytes()
        moved = offsets + np.searchsorted(full, np.arange(len(offsets)))
        if "▁".encode() in raw:
            parts = [raw[a:b].replace("▁".encode(), b" ") for a, b in zip(moved[:-1].tolist(), moved[1:].tolist(), strict=True)]
            raw, moved = b"".join(parts), np.cumsum([0, *map(len, parts)])
        data = np.frombuffer(raw, np.uint8)
        space, line = data == 32, data == 10
        begins = np.zeros(len(data) + 1, bool)
        begins[moved] = True
        begins[1:-1] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        starts = np.flatnonzero(begins[:-1])
        return raw, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, moved)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each piece, bytes of each piece (of the buffer with its added spaces), first piece of each text."""
        raw, starts, ends, first = self.pieces(data, offsets)
        begin, _ = self.table.look_up(raw, starts, ends, hash_runs(np.frombuffer(raw, np.uint8), starts, ends - starts))
        return self.table.flat[begin].astype(np.int64) if len(begin) else np.zeros(0, np.int64), ends - starts, first


class PieceIds:
    """Ids by a tokenizer that drops white space. A piece lies between white spaces; if the tokenizer splits letters, digits
    and other characters from one another, it ends where ASCII or Latin-1 letters, digits and marks meet, too. Other
    characters and the apostrophe never end a piece. Texts that may hold a special token are encoded whole.
    """

    MANY = 2000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the library would only wait for it
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        ids = lambda *x: np.concatenate(self._ids(list(x))).tolist()
        if ids("ab \n cd\t\r e") != ids("ab", "cd", "e") or ids(" ab ") != ids("ab"):
            raise ValueError(f"{path}: tokens of this tokenizer depend on white space; encode whole texts instead")
        self.lowers = ids("AbZ Éz") == ids("abz Éz")
        self.splits = all(ids(a + b + a) == ids(a, b, a) for a, b in (("ab", ".,"), ("é", "!"), ("ab", "12"), ("7", "-"), ("ß", "(")))
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        classes = np.zeros(256, np.uint8)  # 0: never ends a piece
        for group, chars in enumerate((SPACES, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(set(range(33, 127)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123)) - {39})), 1):
            classes[list(chars)] = group if self.splits or group == 1 else 0
        self.classes = classes.tobytes()
        self.table = Table(self._encode)

    def _ids(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.model.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> list[np.ndarray]:
        """Words that the tokenizer takes as one are encoded many in one text and told apart again; the rest one by one."""
        out: list = [None] * len(pieces)
        words = [i for i, p in enumerate(pieces) if self.splits and p.isalpha()]
        parts = [words[k : k + self.MANY] for k in range(0, len(words), self.MANY)]
        for part, found in zip(parts, self.model.encode_batch([" ".join([pieces[i] for i in p]) for p in parts], add_special_tokens=False), strict=True):
            ids, word = np.array(found.ids, np.uint32), np.array(found.word_ids)
            cuts = np.flatnonzero(word[1:] != word[:-1]) + 1
            if len(cuts) + 1 == len(part):
                for i, x in zip(part, np.split(ids, cuts), strict=True):
                    out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._ids([pieces[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        raw = data.tobytes()
        whole: dict[int, np.ndarray] = {}
        if any(s in raw for s in self.special):
            for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if any(s in raw[a:b] for s in self.special):
                    whole[t] = self._ids([raw[a:b].decode()])[0]
        lowered = raw.lower() if self.lowers else raw  # of bytes: A-Z only; may make a special token, so pieces are checked
        if self.lowers and any(s in lowered for s in self.special):
            lowered = raw
        data = np.frombuffer(lowered, np.uint8)
        kind = np.frombuffer(bytearray(lowered.translate(self.classes)), np.uint8)
        if self.splits:
            lead = np.flatnonzero(data == 0xC3)  # À to ÿ but for × and ÷
            lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
            kind[lead] = kind[lead + 1] = 2
        space = kind == 1
        cut = np.ones(len(data) + 1, bool)
        if len(data):
            cut[1:-1] = (kind[1:] != kind[:-1]) & ((kind[1:] > 0) & (kind[:-1] > 0) | space[1:] | space[:-1])
            cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        word = ~space[starts]
        starts, ends = starts[word], ends[word]
        begin, size = self.table.look_up(lowered, starts, ends, hash_runs(data, starts, ends - starts))
        first = np.searchsorted(starts, offsets)
        flat = gather(self.table.flat, begin, size)
        total = np.concatenate(([0], np.cumsum(size)))[first]
        if whole:
            parts = [whole.get(t, flat[total[t] : total[t + 1]]) for t in range(len(offsets) - 1)]
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return flat, np.diff(total)


@lru_cache(maxsize=4)
def piece_counts(path: str, every: bool = False) -> PieceCounts:
    return PieceCounts(path, every)


@lru_cache(maxsize=4)
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)
