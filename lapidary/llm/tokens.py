"""Token ids of whole texts by a byte-level BPE vocabulary file, fast enough for a whole corpus.

The ids are those of ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False)``. Byte-level BPE
first cuts a text into pieces and merges within each; a white-space byte after a non-space byte always begins a new piece,
so the text falls apart there into units that can be encoded alone. Units repeat as words do: each is encoded once per
worker, found again by its 64-bit hash, and its ids are gathered by numpy. New units are encoded by ``tiktoken`` with the
ranks of the same file, which gives the same ids several times faster; a file whose ranks are not its merge order, texts
with characters that only Unicode calls white space, and texts that hold an added token's string go to ``tokenizers``.

Memory: at most ``MAX_UNITS`` units a worker, about 30 bytes each; then the store starts afresh.
"""

from __future__ import annotations

import json
import re

import numpy as np

from lapidary.llm.text import SPACE, Chunk

MAX_UNITS = 3_000_000
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space in Unicode that is not among the six ASCII characters.
_WIDE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_JOIN = 4096


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self._odd = re.compile("|".join([*added, *map(chr, _WIDE)]).encode())
        self.fast = self._ranked(spec)
        self.reset()

    @staticmethod
    def _ranked(spec: dict):
        """A tiktoken encoding of the same vocabulary, or None where the file's form doesn't allow it."""
        import tiktoken

        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocab, pairs = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        ranks = {bytes(shown[c] for c in word): i for word, i in vocab.items() if all(c in shown for c in word) and i < 256 + len(pairs)}
        return tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def reset(self) -> None:
        self._keys = np.zeros(0, np.uint64)  # sorted hashes of known units
        self._slots = np.zeros(0, np.int64)  # their places in _starts
        self._starts = np.zeros(1, np.int64)  # unit u has ids _ids[_starts[u]:_starts[u + 1]]
        self._ids = np.zeros(0, np.uint32)

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units, end to end, how many each has, and the order in which the units stand there."""
        if self.fast is None:
            out = [np.asarray(e.ids, np.uint32) for e in self.exact.encode_batch([u.decode() for u in units], add_special_tokens=False)]
            return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out)), np.arange(len(units))
        # a unit of one space and no other white space can be told from its neighbours after a joint encoding
        simple = [u[:1] == b" " and len(u) > 1 and not SPACE[u[1]] for u in units]
        order = np.argsort(~np.array(simple), kind="stable")
        n, ids, counts = sum(simple), [], []
        for at in range(0, n, _JOIN):
            some = np.asarray(self.fast.encode_ordinary(b"".join(units[i] for i in order[at : min(at + _JOIN, n)]).decode()), np.uint32)
            ids.append(some)
            counts.append(np.diff(np.append(np.flatnonzero(self._led[some]), len(some))))
        for i in order[n:]:
            ids.append(np.asarray(self.fast.encode_ordinary(units[i].decode()), np.uint32))
            counts.append([len(ids[-1])])
        return np.concatenate(ids), np.concatenate(counts).astype(np.int64), order

    @property
    def _led(self) -> np.ndarray:
        """Which ids begin with a space byte."""
        if not hasattr(self, "_led_table"):
            table = np.zeros(self.fast.n_vocab + 1, bool)
            for i in range(self.fast.n_vocab):
                try:
                    table[i] = self.fast.decode_single_token_bytes(i)[:1] == b" "
                except KeyError:
                    pass
            self._led_table = table
        return self._led_table

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the chunk, end to end, and the bounds of each text's."""
        buf, texts = chunk.buf, len(chunk)
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
        space = SPACE[buf]
        cut = np.zeros(len(buf), bool)
        cut[1:] = space[1:] & ~space[:-1]
        cut[chunk.bounds[:-1][np.diff(chunk.bounds) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(buf))
        unit_doc = chunk.owner(start)
        key, back = np.unique(chunk.hashes(start, end), return_inverse=True)
        place = np.searchsorted(self._keys, key)
        known = np.zeros(len(key), bool)
        inside = place < len(self._keys)
        known[inside] = self._keys[place[inside]] == key[inside]
        if not known.all():
            if len(self._keys) > MAX_UNITS:
                self.reset()
                known[:] = False
            sample = np.empty(len(key), np.int64)
            sample[back] = np.arange(len(start))
            new = np.flatnonzero(~known)
            raw = buf.tobytes()
            ids, counts, order = self._encode_units([raw[a:b] for a, b in zip(start[sample[new]].tolist(), end[sample[new]].tolist())])
            first = len(self._starts) - 1
            self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(counts)])
            self._ids = np.concatenate([self._ids, ids])
            at = np.searchsorted(self._keys, key[new])
            self._keys = np.insert(self._keys, at, key[new])
            slots = np.empty(len(new), np.int64)
            slots[order] = first + np.arange(len(new))
            self._slots = np.insert(self._slots, at, slots)
            place = np.searchsorted(self._keys, key)
        slot = self._slots[place][back]
        size = self._starts[slot + 1] - self._starts[slot]
        # gather every unit's ids
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self._starts[slot] - total[:-1], size) + np.arange(total[-1])
        ids = self._ids[at]
        per = np.bincount(unit_doc, size, minlength=texts).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(per)])
        odd = {int(chunk.owner(np.array([m.start()]))[0]) for m in self._odd.finditer(memoryview(buf))}
        if odd:
            pieces = [ids[bounds[i] : bounds[i + 1]] for i in range(texts)]
            for i in odd:
                text = buf[chunk.bounds[i] : chunk.bounds[i + 1]].tobytes().decode()
                pieces[i] = np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(pieces)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return ids, bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
