"""Encoding with the tokenizers library, memoised over units that it treats independently.

A byte-level BPE without normaliser or prefix space merges only within the units of its
splitting rule. Units that end at such boundaries therefore encode alike alone and in place,
and each distinct one needs the library once.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: White space beyond ASCII by the splitting rule (Unicode White_Space); texts with any are encoded whole.
_RARE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")
_SPACE, _LETTER, _PUNCT = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(9, 14), 32]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _PUNCT
#: Entries of the memo, about 40 bytes each; beyond it the memo starts anew. It has no effect on results.
MEMO = 600_000
#: Bytes of its units, likewise.
MEMO_BYTES = 1 << 26
#: Bytes worked on at a time.
BLOCK = 2_000_000

_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, BLOCK + 1000)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, x, np.uint64)]), dtype=np.uint64) for x in (_ODD, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span, from one prefix sum over the buffer."""
    up, down = _pow(len(buf))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[buf] * up, dtype=np.uint64)])
        h = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _units(buf: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Starts of units; docs: where each document starts. A line end stands between documents."""
    kind = _CLASS[buf]
    space = kind == _SPACE
    start = np.zeros(len(buf), bool)
    before, here = space[:-1], space[1:]
    start[1:] = here & ~before  # a run of white space begins
    start[:-1] |= before & ~here  # its last place begins the next unit, or is one by itself
    start[1:] |= ~here & before & (buf[:-1] != 32)
    letter = kind == _LETTER
    two = np.zeros(len(buf), bool)  # Latin letters of two bytes end here
    lead, last = buf[:-1], buf[1:]
    two[1:] = ((lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)) | ((lead >= 0xC4) & (lead <= 0xC8))
    start[1:] |= (kind[1:] == _PUNCT) & (letter[:-1] | two[:-1])
    start[docs] = True
    start[docs[1:] - 1] = True
    start[len(buf) - 1] = True
    return np.flatnonzero(start)


def spread(offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    """offset[0], offset[0] + 1, ... count[0] of them, then offset[1], ..."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (not total or offset.max() < 1 << 30) else np.int64
    return np.repeat((offset - (ends - count)).astype(kind), count) + np.arange(total, dtype=kind)


class _Memo:
    """Distinct units and their ids in flat arrays, found by hash and compared byte by byte."""

    def __init__(self, dtype: np.dtype):
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty((4, 0), np.int32)  # ids' offset and count, bytes' offset and count
        self.ids, self.raw = np.empty(1 << 16, dtype), np.empty(1 << 16, np.uint8)
        self.n_ids = self.n_raw = 0

    @staticmethod
    def _append(pool: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
        if used + len(new) > len(pool):
            pool = np.concatenate([pool[:used], np.empty(used + 2 * len(new), pool.dtype)])
        pool[used : used + len(new)] = new
        return pool

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> None:
        """keys ascending and unseen."""
        at = np.array([self.n_ids + np.cumsum(counts) - counts, counts, self.n_raw + np.cumsum(sizes) - sizes, sizes], np.int32)
        self.ids, self.n_ids = self._append(self.ids, self.n_ids, ids), self.n_ids + len(ids)
        self.raw, self.n_raw = self._append(self.raw, self.n_raw, raw), self.n_raw + len(raw)
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")  # merges two sorted runs
        self.keys, self.at = keys[order], np.concatenate([self.at, at], axis=1)[:, order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        pos = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return pos, self.keys[pos] == keys


class Encoder:
    """UTF-8 texts to ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Other kinds of tokenizers, texts that spell an added token, and texts with rare white
    space are encoded whole by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.line = line[0]
        self.by_unit = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout") and len(line) == 1
        added = [re.escape(t["content"].encode()) for t in spec.get("added_tokens", [])]
        self.added = re.compile(b"|".join(added)) if added else None
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.memo = _Memo(self.dtype)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit_ids(self, buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each unit. The units, which have no line end, are joined by
        line ends, which are units of their own, to save calls."""
        flat, counts = [], []
        line = np.array([self.line], self.dtype)
        for i in range(0, len(at), 5000):
            n = size[i : i + 5000] + 1
            raw = buf[spread(at[i : i + 5000], n)]
            ends = np.cumsum(n)
            raw[ends - 1] = 10
            text = raw.tobytes()
            stops = [0, *ends[99:-1:100].tolist(), len(text)]  # short texts stay in the library's cache lines
            parts = self.tok.encode_batch_fast([text[a : b - 1].decode() for a, b in zip(stops, stops[1:])], add_special_tokens=False)
            ids = np.concatenate([x for p in parts for x in (np.array(p.ids, self.dtype), line)])
            between = ids == self.line
            at_line = np.flatnonzero(between)
            if len(at_line) != len(n):
                some = self._whole(text.decode().split("\n")[:-1])
                flat += some
                counts += [len(x) for x in some]
            else:
                flat.append(ids[~between])
                counts += (np.diff(np.concatenate([[-1], at_line])) - 1).tolist()
        return np.concatenate(flat), np.array(counts, np.int64)

    def _learn(self, raw: bytes, buf: np.ndarray, keys: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
        if len(self.memo.keys) > MEMO or self.memo.n_raw > MEMO_BYTES:
            self.memo = _Memo(self.dtype)
        space = _CLASS[buf[to - 1]] == _SPACE
        for some, is_space in ((space, True), (~space, False)):
            if some.any():
                a, b = at[some], to[some]
                if is_space:
                    lists = self._whole([raw[x:y].decode() for x, y in zip(a.tolist(), b.tolist())])
                    ids, counts = np.concatenate(lists), np.array([len(x) for x in lists], np.int64)
                else:
                    ids, counts = self._unit_ids(buf, a, b - a)
                self.memo.add(keys[some], ids, counts, buf[spread(a, b - a)], b - a)

    def _block(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        docs = np.concatenate([[0], ends[:-1]])
        at = _units(buf, docs)
        to = np.append(at[1:], len(buf))
        between = np.zeros(len(buf), bool)  # the line ends between documents
        between[ends - 1] = True
        own = ~between[at]
        at, to = at[own], to[own]
        if not len(at):
            return [np.empty(0, self.dtype)] * len(texts)
        h = span_hashes(buf, at, to)
        order = np.argsort(h)
        keys = h[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        keys, first = keys[new], order[new]
        a, b = at[first], to[first]
        _, known = self.memo.find(keys)
        if not known.all():
            self._learn(raw, buf, keys[~known], a[~known], b[~known])
            pos, known = self.memo.find(keys)
            if not known.all():  # the memo started anew
                self._learn(raw, buf, keys[~known], a[~known], b[~known])
        pos, _ = self.memo.find(keys)
        id_at, id_n, raw_at, raw_n = self.memo.at[:, pos]
        size = to - at
        same = np.array_equal(raw_n[which], size) and np.array_equal(self.memo.raw[spread(raw_at[which], size)], buf[~between])
        if not same:  # two units share a hash
            return self._whole([t.decode() for t in texts])
        n = id_n[which]
        flat = self.memo.ids[spread(id_at[which], n)]
        upto = np.concatenate([[0], np.cumsum(n)])
        cut = upto[np.searchsorted(at, docs)]
        return [flat[a:b] for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(flat)])]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        block: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if not self.by_unit or (self.added is not None and self.added.search(t)) or _RARE_SPACE.search(t):
                out[i] = self._whole([t.decode()])[0]
                continue
            block.append(i)
            size += len(t) + 1
            if size >= BLOCK or i == len(texts) - 1:
                self._fill(out, texts, block)
                block, size = [], 0
        self._fill(out, texts, block)
        return out

    def _fill(self, out: list, texts: list[bytes], block: list[int]) -> None:
        if block:
            for i, ids in zip(block, self._block([texts[i] for i in block])):
                out[i] = ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, so its memo serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
