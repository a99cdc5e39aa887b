"""Token ids of whole texts by a public tokenizer file, inside tasks.

``encoder(path)`` gives the worker's encoder. Texts are encoded by the tokenizers library. For byte-level vocabularies a text is
cut where its pre-tokenizer begins a new piece whatever stands before: at white space in front of a word and at punctuation behind
one. Equal parts are encoded once per slice, whatever punctuation follows them, and kept in a bounded memory of the worker process.
Other vocabularies encode texts whole. Both ways give the same ids, which the tests check against plain encoding.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text encoded at once, and parts a worker remembers.
SLICE_BYTES = 4 << 20
CACHE_PARTS = 300_000
JOINED_PARTS = 20_000

#: Bytes by kind: white space, letters and digits, and first bytes of two-byte letters (Latin beyond ASCII, Cyrillic).
WHITE, ALNUM, LETTER2 = (np.isin(np.arange(256), np.frombuffer(b, np.uint8)) for b in (b"\t\n\v\f\r ", bytes(c for c in range(128) if chr(c).isalnum()), b"\xc3\xc4\xc5\xc6\xc7\xc8\xc9\xd0\xd1"))
#: First bytes of characters of which some are white space.
UNSURE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


def _maybe_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters at these places, all with a first byte in UNSURE, may be white space."""
    a, b, c = data[at], data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    general = (b == 0x80) & ((c <= 0x8B) | (c >= 0xA8) & (c <= 0xAF)) | (b == 0x81) & (c == 0x9F)
    return (
        (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        | (a == 0xE1) & ((b == 0x9A) | (b == 0xA0))
        | (a == 0xE2) & general
        | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    )


class Encoder:
    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_parts = (
            spec.get("normalizer") is None
            and spec.get("truncation") is None
            and spec.get("padding") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not spec["model"].get("dropout")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"])) for t in spec.get("added_tokens", []))
        )
        # In a byte-level vocabulary every character of a token stands for one byte of text.
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        for t in spec.get("added_tokens", []):
            self.width[t["id"]] = len(t["content"].encode())
        # No cut may fall into an added token, nor leave white space apart from that in front of one.
        added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.opens, self.breaks = np.zeros(256, bool), np.zeros(256, bool)
        self.opens[[t[0] for t in added if t]] = True
        self.breaks[0x21:0x7F] = ~ALNUM[0x21:0x7F]
        self.breaks[[b for t in added for a, b in zip(t, t[1:]) if ALNUM[a] or a >= 0x80]] = False
        self.most_parts = CACHE_PARTS
        # Parts that are remembered, by number; the ids of part i are pool[first[i] : first[i] + count[i]].
        self.known: dict[str, int] = {}
        self.first, self.count, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def whole(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in done]

    def _each(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of parts that are encoded one by one, and the number of ids of each."""
        done = self.whole(parts) if parts else []
        return np.frombuffer(b"".join(done), "<u4"), np.array([len(b) // 4 for b in done], np.int64)

    def _joined(self, parts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts that begin with white space and a word: encoded as one text and told apart by their bytes."""
        out = [self._each([])]
        for i in range(0, len(parts), JOINED_PARTS):
            some = parts[i : i + JOINED_PARTS]
            ids = np.frombuffer(self.whole(["".join(some)])[0], "<u4")
            ends, want = np.cumsum(self.width[ids]), np.cumsum(sizes[i : i + JOINED_PARTS])
            at = np.searchsorted(ends, want)
            if len(ends) and at[-1] == len(ends) - 1 and (ends[at] == want).all():
                out.append((ids, np.diff(at, prepend=-1)))
            else:
                out.append(self._each(some))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def _cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the parts of the texts that begin at ``starts`` begin; a part is encoded alone as it is in its text.

        White space right before a word begins a piece, and the white space left of it is a piece of its own with or without the rest.
        Letters and digits end before punctuation. What follows a cut never depends on what stands before it.
        """
        begins = np.zeros(len(data), bool)
        at = np.flatnonzero(WHITE[data[:-1]])
        follows = data[at + 1]
        at, follows = at[follows > 0x20], follows[follows > 0x20]
        before = data[at - 1]
        sure = ~self.opens[follows] | (before > 0x20) & (before < 0x80)
        look = np.flatnonzero(UNSURE[follows])
        sure[look] &= ~_maybe_white(data, at[look] + 1)
        begins[at[sure]] = True
        begins[starts[starts > 0] - 1] = False  # what follows is another text
        at = np.flatnonzero(self.breaks[data])
        before, lead = data[at - 1], data[at - 2]
        letter = LETTER2[lead] & (before >= 0x80) & ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7)))
        begins[at[ALNUM[before] | letter]] = True
        begins[starts] = True
        return np.flatnonzero(begins)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of texts without nulls, and the number of ids of each text."""
        if not self.by_parts:
            return self._each(texts.to_pylist())
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        low, high = int(bounds[0]), int(bounds[-1])
        if low == high:
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        begins = self._cuts(np.frombuffer(texts.buffers()[2], np.uint8)[low:high], bounds[:-1][bounds[:-1] < bounds[1:]] - low)
        ends = pa.py_buffer(np.append(begins + low, high).astype(np.int32))
        coded = pa.Array.from_buffers(pa.string(), len(begins), [None, ends, texts.buffers()[2]]).dictionary_encode()
        index, first, count, pool = coded.indices.to_numpy(), *self._learn(coded.dictionary)
        each = count[index]
        stops = np.cumsum(each)
        # Offsets of one slice fit 32 bits.
        places = np.repeat((first[index] - (stops - each)).astype(np.int32), each)
        places += np.arange(len(places), dtype=np.int32)
        of_text = np.append(0, stops)[np.searchsorted(begins, bounds - low)]
        return pool[places], np.diff(of_text)

    def _learn(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place and number of the ids of each of these parts, and the ids; new parts are remembered while there is room."""
        parts = distinct.to_numpy(zero_copy_only=False).tolist()
        slot = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(slot < 0)
        if not len(new):
            return self.first[slot], self.count[slot], self.pool
        ends, data = np.frombuffer(distinct.buffers()[1], np.int32)[: len(parts) + 1], np.frombuffer(distinct.buffers()[2], np.uint8)
        left, right = ends[new], ends[new + 1]
        joins = WHITE[data[left]] & (right - left > 1) & (data[np.minimum(left + 1, len(data) - 1)] > 0x20) & ~WHITE[data[right - 1]]
        joined, alone = new[joins], new[~joins]
        made = self._joined([parts[i] for i in joined.tolist()], np.diff(ends)[joined]), self._each([parts[i] for i in alone.tolist()])
        new = np.concatenate([joined, alone])
        pool, count = np.concatenate([self.pool, *[m[0] for m in made]]), np.concatenate([self.count, *[m[1] for m in made]])
        first = np.cumsum(count) - count
        old = len(self.known)
        slot[new] = np.arange(old, old + len(new))
        keep = min(len(new), max(0, self.most_parts - old))
        if keep:
            self.known.update(zip([parts[i] for i in new[:keep].tolist()], range(old, old + keep)))
            self.first, self.count = first[: old + keep].copy(), count[: old + keep].copy()
            self.pool = pool[: self.count.sum()].copy()
        return first[slot], count[slot], pool


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; workers outlive tasks, the globals of a shipped function do not."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(start, stop) of consecutive rows with about ``most`` bytes; a longer text stands alone."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64) + 16)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def encoded(texts: pa.Array, path: str, end_id: int | None, most: int = SLICE_BYTES, parts: int = CACHE_PARTS):
    """(start row, ids, lengths) per slice of rows; null is the empty text; ``end_id`` follows every text.

    ``most`` is the size of a slice in bytes and ``parts`` what the worker remembers: longer slices and more parts cost memory and save time.
    """
    e = encoder(path)
    e.most_parts = parts
    texts = pc.fill_null(texts.cast(pa.string()), "")
    for start, stop in slices(texts, most):
        ids, n = e.encode(texts.slice(start, stop - start))
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(n), end_id)
            n = n + 1
        yield start, ids.astype("<u4", copy=False), n


def id_rows(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive runs of ids as a binary array of little-endian unsigned 32-bit integers."""
    offsets = np.concatenate([[0], np.cumsum(lengths * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(ids))])
