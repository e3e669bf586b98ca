"""Fast token ids of a word-level BPE file, equal to those of the tokenizers library.

The file's normaliser (NFC, white space, lower case) and its split pattern are
applied in numpy for texts of code points below U+0180, whose NFC form and lower
case are known; the distinct words of a group of texts are looked up in a bounded
cache, and the missing ones are encoded by the library, many in one call.  Any
other text, any that holds a special token's string, and every text where the file says
something else, goes through the library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from lexiduct.llm import words as W

U = np.uint64
LIMIT = 0x180
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Suffixes that the file's split pattern takes as one piece after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# What a file must say for the fast way to equal the library.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


NORMALISE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRETOKENISE = [
    {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
END_OF_WORD = "</w>"


def fits(spec: dict) -> bool:
    """Whether a tokenizer file is of the one kind that the fast way knows."""
    steps = lambda part, key: (spec.get(part) or {}).get(key)
    return steps("normalizer", "normalizers") == NORMALISE and steps("pre_tokenizer", "pretokenizers") == PRETOKENISE and steps("model", "type") == "BPE" and steps("model", "end_of_word_suffix") == END_OF_WORD and not steps("model", "dropout")


def _kind(c: str) -> int:
    if c.isspace() and not 0x1C <= ord(c) <= 0x1F:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)


_KIND = np.array([_kind(chr(i)) for i in range(LIMIT)], np.uint8)
#: One-to-one lower case; a code point whose lower case is longer or outside isn't fast.
_LOW = np.array([ord(x) if len(x := chr(i).lower()) == 1 and ord(x) < LIMIT else LIMIT for i in range(LIMIT)], np.uint32)
_FAST = (_LOW < LIMIT) & (np.arange(LIMIT) > 0)
_CP = W.mix(np.arange(1, LIMIT + 1, dtype=U) * U(0xA0761D6478BD642F))


class WordBpe:
    """ids(texts) -> (all ids, row offsets).  cache_words bounds the cache."""

    def __init__(self, path: str, cache_words: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.fits = fits(json.load(f))
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 2, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(END_OF_WORD)]] = True
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.most = cache_words
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, U)  # ascending
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def whole(self, text: str) -> np.ndarray:
        """The library's ids of a whole text."""
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.int32)

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        fast: list[int] = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.int32)
            elif not self.fits or any(s in t for s in self.special):
                out[i] = self.whole(t)
            else:
                fast.append(i)
        lo = 0
        while lo < len(fast):
            hi, size = lo, 0
            while hi < len(fast) and (hi == lo or size + len(texts[fast[hi]]) <= W.GROUP_BYTES):
                size += len(texts[fast[hi]])
                hi += 1
            part = fast[lo:hi]
            for i, ids in zip(part, self._group([texts[i] for i in part])):
                out[i] = ids
            lo = hi
        off = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), off

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        bad = np.flatnonzero(~_FAST[np.minimum(cps, LIMIT - 1)] | (cps >= LIMIT))
        slow = set(np.searchsorted(off, bad, "right") - 1)
        if slow:
            keep = [i for i in range(len(texts)) if i not in slow]
            rest = iter(self._fast([texts[i] for i in keep]))
            return [self.whole(t) if i in slow else next(rest) for i, t in enumerate(texts)]
        return self._fast(texts, cps, off)

    def _fast(self, texts: list[str], cps: np.ndarray | None = None, off: np.ndarray | None = None) -> list[np.ndarray]:
        if not texts:
            return []
        if cps is None:
            cps = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        low = _LOW[cps]
        kind = _KIND[low]
        n = len(low)
        new = np.ones(n, bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        new[off[:-1]] = True
        self._contract(low, kind, new, off)
        new_word = np.flatnonzero(new & (kind != SPACE))
        ends = np.append(np.flatnonzero(new), n)
        ends = ends[np.searchsorted(ends, new_word, "right")]
        h = self._hash(low, new_word, ends)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at, length = self._lookup(uniq, first, low, new_word, ends)
        wlen = length[inverse]
        woff = np.concatenate([[0], np.cumsum(wlen)])
        src = np.repeat(at[inverse] - woff[:-1], wlen) + np.arange(woff[-1])
        ids = self.pool[src]
        row = woff[np.searchsorted(new_word, off)]
        return [ids[a:b] for a, b in zip(row[:-1], row[1:])]

    @staticmethod
    def _contract(low, kind, new, off) -> None:
        """Marks 's, 't, 're ... as pieces where an apostrophe begins one."""
        for p in np.flatnonzero((low == 39) & new):
            end = int(off[np.searchsorted(off, p, "right")])
            if p + 1 < end and kind[p + 1] == LETTER:
                nxt = "".join(map(chr, low[p + 1 : min(end, p + 3)]))
                hit = next((c for c in CONTRACTIONS if nxt.startswith(c)), None)
                if hit:
                    new[p + 1] = False
                    if (q := p + 1 + len(hit)) < end:
                        new[q] = True

    @staticmethod
    def _hash(low, starts, ends) -> np.ndarray:
        out = np.empty(len(starts), U)
        lo = 0
        while lo < len(starts):
            base = starts[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, base + W.HASH_BYTES, "right")))
            part = _CP[low[base : ends[hi - 1]]]
            part *= W.powers(W._P, len(part))
            total = np.zeros(len(part) + 1, U)
            np.cumsum(part, out=total[1:])
            s, e = starts[lo:hi] - base, ends[lo:hi] - base
            out[lo:hi] = W.mix((total[e] - total[s]) * W.powers(W._P_INV, len(part) + 1)[s] + (e - s).astype(U))
            lo = hi
        return out

    def _lookup(self, uniq, first, low, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) + len(uniq) > self.most:
            self._clear()
        where = np.searchsorted(self.keys, uniq)
        found = np.zeros(len(uniq), bool)
        inside = where < len(self.keys)
        found[inside] = self.keys[where[inside]] == uniq[inside]
        miss = np.flatnonzero(~found)
        if len(miss):
            f = first[miss]
            new = ["".join(map(chr, low[a:b])) if b - a < 8 else low[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts[f], ends[f])]
            ids, length = self._encode(new)
            at = len(self.pool) + np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
            self.pool = np.concatenate([self.pool, ids])
            keys, ats, lens = np.concatenate([self.keys, uniq[miss]]), np.concatenate([self.at, at]), np.concatenate([self.len, length])
            order = np.argsort(keys, kind="stable")
            self.keys, self.at, self.len = keys[order], ats[order], lens[order]
            where = np.searchsorted(self.keys, uniq)
        return self.at[where], self.len[where]

    def _encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single words, in one call: the words of a line are parted by spaces,
        and a token's end-of-word mark shows where each ends."""
        lines = [" ".join(new[i : i + 64]) for i in range(0, len(new), 64)]
        parts = [e.ids for e in self.lib.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.fromiter((x for p in parts for x in p), np.int32)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) == len(new) and (not len(ids) or stop[-1] == len(ids)):
            return ids, np.diff(np.concatenate([[0], stop]))
        one = [self.whole(w) for w in new]
        return np.concatenate(one), np.array([len(x) for x in one], np.int64)


_encoders: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """This process's encoder of a file; its cache lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = WordBpe(path, cache_words=600_000)
    return _encoders[path]
