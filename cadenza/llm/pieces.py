"""Exact piece counts and ids of public BPE tokenizers, one encoding per distinct pre-token.

Byte-pair merges never cross a pre-token, so a text's ids are those of its pre-tokens in order.
Texts whose code points all lie below ``SIMPLE`` are cut into pre-tokens with NumPy; the character
classes and case mapping are read off the tokenizer itself when it is loaded. Any other text, and
any text that may hold a special token, goes through the library whole. Both paths give the
library's own result.
"""

from __future__ import annotations

import os

import numpy as np

from cadenza.llm.textkit import spans_hash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SIMPLE = 0x250
SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)
_MEMO_PIECES = 500_000
_ENCODE = 4000


def load_tokenizer(name_or_path: str):
    """A tokenizer by file path, or by the name of one of the public vocabulary files."""
    from tokenizers import Tokenizer

    if not os.path.isabs(name_or_path):
        import public_tokenizers

        name_or_path = public_tokenizers.path(name_or_path)
    return Tokenizer.from_file(str(name_or_path))


class PieceTable:
    """Pre-token segmentation of simple texts and a memo from pre-token to its ids.

    ``kind`` "byte": pre-tokens keep a leading space, every character counts. ``kind`` "word":
    lower case, white space dropped, each digit alone.
    """

    def __init__(self, name_or_path: str) -> None:
        self.tok = load_tokenizer(name_or_path)
        self.kind = "word" if self.tok.normalizer is not None else "byte"
        self.cls, self.low = self._probe()
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _probe(self) -> tuple[np.ndarray, np.ndarray]:
        cls, low = np.full(SIMPLE, BREAK, np.uint8), np.arange(SIMPLE, dtype=np.uint16)
        cut = lambda s: [e - b for _, (b, e) in self.tok.pre_tokenizer.pre_tokenize_str(s)]
        for cp in range(SIMPLE):
            c = chr(cp)
            if self.kind == "word":
                c = self.tok.normalizer.normalize_str(c)
                if len(c) != 1 or ord(c) >= SIMPLE:
                    continue  # stays BREAK: such texts are left to the library
                low[cp] = ord(c)
                cls[cp] = LETTER if cut("a" + c) == [2] else SPACE if cut("a" + c) == [1] else NUMBER if cut(c + c) == [1, 1] else OTHER
            else:
                cls[cp] = LETTER if cut("a" + c) == [2] else NUMBER if cut("1" + c) == [2] else OTHER if cut("!" + c) == [2] else SPACE
        return cls, low

    def simple(self, text: str) -> bool:
        """Whether the NumPy path is exact for this text."""
        if "<|" in text:
            return False
        if text.isascii():
            return True
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return bool(cps.max() < SIMPLE) and not (self.cls[cps] == BREAK).any()

    def segment(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
        """Pre-tokens of simple texts: units (lower-cased), starts, ends, first pre-token of each text, and the joined text."""
        joined = "\x00".join([*texts, "\x00\x00\x00"])
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])[: len(texts)] if len(texts) else np.zeros(0, np.int64)
        units, c = self.low[cps], self.cls[cps]
        c[begin + lengths] = BREAK
        c[-3:] = BREAK
        before = np.concatenate([[BREAK], c[:-1]]).astype(np.uint8)
        solid = (c == LETTER) | (c == NUMBER) | (c == OTHER)
        start = solid & (c != before)
        if self.kind == "word":
            start |= c == NUMBER
        else:
            after = np.concatenate([c[1:], [BREAK]]).astype(np.uint8)
            followed = (after == LETTER) | (after == NUMBER) | (after == OTHER)
            blank = c == SPACE
            start |= blank & (before != SPACE)  # a run of white space
            last = blank & followed  # its last character, before a solid one
            start |= last
            lead = last & (cps == 0x20)  # goes with what follows
            start[1:] &= ~lead[:-1]
        # 's 't 'm 'd 're 've 'll, where an apostrophe may begin a pre-token
        apo = np.flatnonzero(units == 0x27)
        if len(apo):
            free = before[apo] != OTHER
            if self.kind == "byte":
                free &= ~((before[apo] == SPACE) & (np.concatenate([[0], cps])[apo] == 0x20))
            apo = apo[free]
            x, y = units[apo + 1], units[apo + 2]
            one = np.isin(x, [ord(k) for k in "stmd"])
            two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
            hit = one | two
            i, n = apo[hit], np.where(one[hit], 2, 3)
            start[i + 1] = False
            start[i + n] |= c[i + n] == LETTER
        stop = start | (c == BREAK)
        if self.kind == "word":
            stop |= c == SPACE
        stops = np.flatnonzero(stop)
        starts = np.flatnonzero(start)
        ends = stops[np.searchsorted(stops, starts, "right")]
        return units, starts, ends, np.searchsorted(starts, np.concatenate([begin, [len(cps)]])), joined

    def key(self, pieces: list[str]) -> np.ndarray:
        """The hashes by which pre-tokens are looked up."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        units = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.uint16)
        ends = np.cumsum(lengths)
        return spans_hash(units, ends - lengths, ends)

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pre-tokens of simple texts, first id and count of each pre-token, first pre-token of each text)."""
        units, starts, ends, first, joined = self.segment(texts)
        h = spans_hash(units, starts, ends)
        distinct, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > _MEMO_PIECES:
            self.keys, self.at, self.ids = self.keys[:0], self.at[:0], self.ids[:0]
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if len(new):
            ids = self.ids_of([joined[starts[i] : ends[i]] for i in index[new].tolist()])
            counts = np.array([len(x) for x in ids], np.int64)
            tail = len(self.ids) + np.cumsum(counts) - counts
            self.ids = np.concatenate([self.ids, np.fromiter((k for x in ids for k in x), np.uint32, int(counts.sum()))])
            keys, at = np.concatenate([self.keys, distinct[new]]), np.concatenate([self.at, tail << 24 | counts])
            order = np.argsort(keys, kind="stable")
            self.keys, self.at = keys[order], at[order]
            place = np.searchsorted(self.keys, distinct)
        packed = self.at[place][inverse.ravel()]
        return self.ids, packed >> 24, packed & 0xFFFFFF, first

    def ids_of(self, pieces: list[str]) -> list[list[int]]:
        """The library's ids of each piece, a few thousand pieces at a time: its result objects are large."""
        return [e.ids for k in range(0, len(pieces), _ENCODE) for e in self.tok.encode_batch(pieces[k : k + _ENCODE], add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them without added special tokens."""
        out: list[np.ndarray | None] = [None] * len(texts)
        fast = [i for i, t in enumerate(texts) if self.simple(t)]
        chosen = set(fast)
        slow = [i for i in range(len(texts)) if i not in chosen]
        if slow:
            for i, e in zip(slow, self.tok.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint32)
        if fast:
            pool, at, n, first = self.lookup([texts[i] for i in fast])
            ends = np.cumsum(n)
            flat = pool[np.repeat(at - (ends - n), n) + np.arange(int(n.sum()))] if len(n) else np.zeros(0, np.uint32)
            bounds = np.concatenate([[0], ends])[first]
            for k, i in enumerate(fast):
                out[i] = flat[bounds[k] : bounds[k + 1]]
        return out  # type: ignore[return-value]

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text that is not simple, with special tokens as pieces of their own."""
        names = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        parts, rest = [], text
        while rest:
            hits = [(rest.find(n), -len(n), n) for n in names if n in rest]
            if not hits:
                parts.append((rest, False))
                break
            at, _, name = min(hits)
            if at:
                parts.append((rest[:at], False))
            parts.append((name, True))
            rest = rest[at + len(name) :]
        out: list[str] = []
        for part, special in parts:
            if special:
                out.append(part)
            else:
                if self.tok.normalizer is not None:
                    part = self.tok.normalizer.normalize_str(part)
                out += [part[b:e] for _, (b, e) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return out
