"""Byte-level BPE ids through the ``tokenizers`` library, with a bounded cache of text pieces.

A byte-level BPE splits a text into pretokens before any merge, so the ids of a text are the ids of
its parts whenever a part starts where a pretoken must start.  A space before a non-space always
starts one.  Texts are cut there, known pretokens come from the cache, and the rest go through the
library's own BPE model, several at a time with a byte between them that merges with nothing.  The strings of the vocabulary's added tokens are cut out before all that, as
the library does: each is one id, and what stands between them is encoded by itself.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the pretoken pattern of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_PARTS = 120_000
CACHE_PART_BYTES = 64


def byte_alphabet() -> dict[int, int]:
    """The printable character that stands for each byte in a byte-level vocabulary (latin-1 order)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = 256 + n
    return table


class _Memo(dict):
    """A dictionary that computes what it lacks and keeps it while there is room."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, part):
        ids = self.make(part)
        self.keep(part, ids)
        return ids

    def keep(self, part, ids):
        if len(self) < CACHE_PARTS and len(part) <= CACHE_PART_BYTES:
            self[part] = ids


#: A space before a non-space starts a pretoken for sure.
SAFE_SPLIT = re.compile(r" (?=\S)").split
#: Texts are encoded together up to this many characters; longer ones alone.
BLOCK_CHARS = 12_000_000
#: Pretokens that one call of the library's model merges.
GROUP = 64
#: Bytes that no UTF-8 text has.
NO_TEXT = (0xC0, 0xC1, *range(0xF5, 0x100))
#: Parts that are a pretoken of letters, and one of ``STOPS`` after it or none.
WORD, STOPS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?$", [".", ","]
#: What makes a model's ids of a string depend on where the string begins and ends.
BY_ENDS = ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix")
id_of = attrgetter("id")


def separator(model: dict, alphabet: dict[int, int]) -> str | None:
    """A character of the vocabulary that stands in no text and in no merge; none if strings can't be merged together."""
    if any(model.get(k) for k in BY_ENDS):
        return None
    merged = set().union(*(set("".join(m)) for m in model["merges"]))
    return next((c for c in (chr(alphabet[b]) for b in NO_TEXT) if c in model["vocab"] and c not in merged), None)


class Encoder:
    """The ids of ``Tokenizer.encode(text, add_special_tokens=False)`` as uint32; one per Python worker.

    The string of an added token in a text becomes that token's id, as in the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level vocabulary without prefix space or normalizer is needed")
        added = spec.get("added_tokens") or []
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in added):
            raise ValueError("added tokens must match as they are written")
        self.tokenizer = Tokenizer.from_file(path)
        self.added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cut_added = re.compile(f"({'|'.join(longest_first)})").split if added else None
        self.merge = self.tokenizer.model.tokenize
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 0xFFFF else "I"
        self.dtype = np.dtype("<u2" if self.kind == "H" else "<u4")
        self.alphabet = byte_alphabet()
        self.space = chr(self.alphabet[0x20])
        self.between = separator(spec["model"], self.alphabet)
        self.split = regex.compile(PRETOKEN).findall
        self.pretokens = _Memo(self._bpe)
        self.parts = _Memo(self._part)

    def _shown(self, pretoken: str) -> str:
        """A pretoken's bytes as the vocabulary writes them."""
        if pretoken.isascii() and pretoken.isprintable():
            return pretoken.replace(" ", self.space)
        return pretoken.encode("utf-8").decode("latin-1").translate(self.alphabet)

    def _bpe(self, pretoken: str) -> bytes:
        return array(self.kind, map(id_of, self.merge(self._shown(pretoken)))).tobytes()

    def _bpe_all(self, pretokens: list[str]) -> list[bytes]:
        """Ids of each pretoken; the model gets ``GROUP`` of them a call."""
        if self.between is None:
            return list(map(self._bpe, pretokens))
        flat, stop = array(self.kind), self.tokenizer.token_to_id(self.between)
        for k in range(0, len(pretokens), GROUP):
            group = pretokens[k : k + GROUP]
            whole = "".join(group)
            if whole.isascii() and whole.isprintable():
                shown = self.between.join(group).replace(" ", self.space)
            else:
                shown = self.between.join(map(self._shown, group))
            flat.extend(map(id_of, self.merge(shown)))
            flat.append(stop)
        raw, size = flat.tobytes(), self.dtype.itemsize
        ends = (np.flatnonzero(np.frombuffer(raw, self.dtype) == stop) * size).tolist()
        return [raw[a:b] for a, b in zip([0, *(e + size for e in ends[:-1])], ends, strict=True)] if ends else []

    def _part(self, part: str) -> bytes:
        """Ids of a part and the space before it."""
        if part.isalpha():
            return self.pretokens[" " + part]
        if part[-1] in ".," and part[:-1].isalpha():
            return self.pretokens[" " + part[:-1]] + self.pretokens[part[-1]]
        return self._pieces(" " + part)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, self.split(text)))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one whole text; null counts as empty."""
        if not text:
            return np.empty(0, np.uint32)
        spans = self.cut_added(text) if any(map(text.__contains__, self.added)) else [text]
        blob = b"".join(self._added(s) if k % 2 else self._span(s) for k, s in enumerate(spans))
        return np.frombuffer(blob, self.dtype).astype(np.uint32)

    def _added(self, content: str) -> bytes:
        return array(self.kind, [self.added[content]]).tobytes()

    def _span(self, text: str) -> bytes:
        """Ids of what stands between added tokens."""
        first, *rest = SAFE_SPLIT(text)
        return self._pieces(first) + b"".join(map(self.parts.__getitem__, rest))

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts: the first one's index, all their ids in one array, and how many each has."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + BLOCK_CHARS, "right")))
            yield at, *self._block(texts.slice(at, end - at))
            at = end

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        begin = split.offsets.to_numpy().astype(np.int64)
        begin, flat = begin[:-1] - begin[0], split.flatten().dictionary_encode()
        codes, known = flat.indices.to_numpy(), flat.dictionary
        pool, size = self._pool(known)
        known = known.to_numpy(zero_copy_only=False)
        odd = size == 0
        alone = np.logical_or.reduceat(odd[codes], begin)  # texts that can't be cut at every space
        for content in self.added:
            alone |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False).astype(bool)
        nothing, blobs = len(known) + len(texts), []
        for i, (k, whole) in enumerate(zip(codes[begin].tolist(), alone.tolist(), strict=True)):
            blobs.append(self.encode(texts[i].as_py()).astype(self.dtype).tobytes() if whole else self._pieces(known[k]))
        blobs.append(b"")
        parts = np.diff(np.append(begin, len(codes)))
        if alone.any():
            codes = np.where(np.repeat(alone, parts), nothing, codes)
        else:
            codes = codes.copy()
        codes[begin] = len(known) + np.arange(len(texts))
        pool = np.concatenate([pool, np.frombuffer(b"".join(blobs), self.dtype)])
        size = np.append(size, self._sizes(blobs))
        return _gather(pool, size, codes).astype(np.uint32), np.add.reduceat(size[codes], begin)

    def _pool(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different parts with the space before each, in one array, and how many each has.

        Parts that are empty or start with white space have none, as they can't be cut off.
        """
        plain = pc.match_substring_regex(parts, WORD)
        words = parts.filter(plain)
        stop, comma = (pc.ends_with(words, c).to_numpy(zero_copy_only=False) for c in STOPS)
        words = pc.ascii_rtrim(words, "".join(STOPS)).dictionary_encode()
        pre, many = [" " + w for w in words.dictionary.to_numpy(zero_copy_only=False)], []
        number = {p: k for k, p in enumerate(STOPS, len(pre))}
        pre += STOPS
        odd: list[int] = []
        for part in parts.filter(pc.invert(plain)).to_numpy(zero_copy_only=False):
            found = [] if not part or part[0].isspace() else self.split(" " + part)
            many.append(len(found))
            for p in found:
                if (k := number.setdefault(p, len(pre))) == len(pre):
                    pre.append(p)
                odd.append(k)
        # the pretokens of each part: a word and what may follow it, or those that were split
        plain = plain.to_numpy(zero_copy_only=False)
        size, ends = np.empty(len(parts), np.int64), stop | comma
        size[plain], size[~plain] = 1 + ends, many
        place = np.cumsum(size) - size
        codes = np.empty(int(size.sum()), np.int64)
        codes[place[plain]] = words.indices.to_numpy()
        codes[place[plain][ends] + 1] = np.where(stop, *(number[p] for p in STOPS))[ends]
        codes[np.repeat(~plain, size)] = odd
        blobs = list(map(self.pretokens.get, pre))
        lacking = [k for k, b in enumerate(blobs) if b is None]
        for k, ids in zip(lacking, self._bpe_all([pre[k] for k in lacking]), strict=True):
            blobs[k] = ids
            self.pretokens.keep(pre[k], ids)
        n = self._sizes(blobs)
        total = np.append(0, np.cumsum(n[codes]))
        return _gather(np.frombuffer(b"".join(blobs), self.dtype), n, codes), total[place + size] - total[place]

    def _sizes(self, blobs: list[bytes]) -> np.ndarray:
        return np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.dtype.itemsize


def _gather(pool: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that ``codes`` name, one after another; run k is ``size[k]`` long."""
    start = (np.cumsum(size) - size)[codes]
    size = size[codes]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    at = np.repeat((start - ends + size).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return pool[at]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)
