"""Batch tokenization with a bounded cache of pieces.

A text is cut before every space or line feed that follows a character other than white space, and before a mark
(. , ; : ! ?) that follows an ASCII letter. No pre-token of the two JSON vocabularies crosses such a place (only the space
itself can begin one), and no special string holds one, so the ids of a text are the ids of its pieces, one after another.
Pieces repeat far more often than texts, so each is encoded once per cache filling, in batches through the tokenizers library.
The cache is an open-addressing table over arrays, and every hit is compared byte by byte: pieces that share a
hash with another are encoded apart.
"""

from __future__ import annotations

import os

import numpy as np

from .common import RunHashes, gather_runs, ragged

#: Last bytes of white space beyond ASCII. Behind a lead byte C3 they are letters.
_WIDE_SPACE = np.zeros(256, dtype=bool)
_WIDE_SPACE[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*range(0x09, 0x0E), 0x20, *range(0x1C, 0x20)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Pieces held by one worker, some 40 bytes each. When there are more, those met only once since the last sweep go.
CACHE_PIECES = 700_000
#: Plain words encoded in one call, and bytes of text that are worked on at once.
JOINED = 256
BLOCK = 2 << 20


def tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    out = Tokenizer.from_file(public_tokenizers.path(name))
    out.no_truncation()
    out.no_padding()
    return out


def safe_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at every text, at spaces and line feeds that follow no white space, at marks behind letters."""
    cut = (data == 0x20) | (data == 0x0A)
    before, second = np.zeros_like(data), np.zeros_like(data)
    before[1:], second[2:] = data[:-1], data[:-2]
    cut &= ~_SPACE[before] & ~(_WIDE_SPACE[before] & (second != 0xC3))
    cut |= _MARK[data] & _LETTER[before]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def split_long(raw: bytes, limit: int) -> list[bytes]:
    """Parts of about `limit` bytes, cut at safe boundaries only; a part without one stays whole."""
    if len(raw) <= limit:
        return [raw]
    parts, a = [], 0
    while len(raw) - a > limit:
        b = a + limit
        while True:  # look for the last boundary before b, then further on
            cuts = safe_cuts(np.frombuffer(raw, dtype=np.uint8, count=b - a, offset=a), np.array([0, b - a]))
            if cuts[-1] > 0 or b == len(raw):
                break
            b = min(b + limit, len(raw))
        if cuts[-1] == 0:
            break
        parts.append(raw[a : a + int(cuts[-1])])
        a += int(cuts[-1])
    return [*parts, raw[a:]]


def balanced(texts: list[bytes], batch_bytes: int):
    """Groups of (text number, part) pairs of about batch_bytes each."""
    group: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for part in split_long(text, batch_bytes):
            group.append((i, part))
            size += len(part)
            if size >= batch_bytes:
                yield group
                group, size = [], 0
    if group:
        yield group


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; the last eight places have none."""
    return np.ndarray(max(0, len(data) - 7), np.uint64, data.data, strides=(1,))


def differing(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether runs x[a : a + n] and y[b : b + n] differ. Both arrays are padded by eight bytes."""
    out = np.zeros(len(a), dtype=bool)
    xs, ys, todo, shift = _words_at(x), _words_at(y), np.arange(len(a)), 0
    while len(todo := todo[n[todo] > shift]):
        if shift >= 4096:  # a few very long ones
            for i in todo.tolist():
                out[i] |= x[a[i] : a[i] + n[i]].tobytes() != y[b[i] : b[i] + n[i]].tobytes()
            break
        keep = _MASKS[np.minimum(n[todo] - shift, 8)]
        out[todo] |= ((xs[a[todo] + shift] ^ ys[b[todo] + shift]) & keep) != 0
        shift += 8
    return out


class HashTable:
    """Open addressing with linear probing from 64-bit hashes to numbers, for arrays of keys."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1
        self.key = np.zeros(1 << bits, dtype=np.uint64)
        self.value = np.full(1 << bits, -1, dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys; -1 for those not held."""
        out = np.full(len(keys), -1, dtype=np.int64)
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            own = self.value[slot[todo]]
            hit = (own >= 0) & (self.key[slot[todo]] == keys[todo])
            out[todo[hit]] = own[hit]
            todo = todo[(own >= 0) & ~hit]
            slot[todo] = (slot[todo] + 1) & self.mask
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are not held, each once."""
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.value[at] < 0
            self.value[at[free]], self.key[at[free]] = values[todo[free]], keys[todo[free]]
            todo = todo[self.value[at] != values[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask


_KEPT: dict[tuple[str, bool], PieceEncoder] = {}


def worker_encoder(name: str, ids: bool = True) -> PieceEncoder:
    """The encoder of this Python worker, which Spark uses for one task after another: its cache stays warm."""
    if (name, ids) not in _KEPT:
        _KEPT.clear()  # one cache a worker
        _KEPT[name, ids] = PieceEncoder(name, ids)
    return _KEPT[name, ids]


def _room(x: np.ndarray, used: int, more: int) -> np.ndarray:
    """x with room for `more` entries behind those used; the last eight stay free."""
    if used + more + 8 <= len(x):
        return x
    out = np.zeros(max(used + more + 8, len(x) * 3 // 2), dtype=x.dtype)
    out[:used] = x[:used]
    return out


class PieceEncoder:
    """Ids of whole texts, piece by piece. With ids=False only their numbers are kept."""

    def __init__(self, name: str, ids: bool = True, cache_pieces: int = CACHE_PIECES):
        self.tokenizer, self.keep_ids, self.cache_pieces = tokenizer(name), ids, cache_pieces
        self._empty()

    def _empty(self) -> None:
        self.n = self.n_ids = self.n_text = 0
        self.table = HashTable(10)
        self.hash = np.zeros(1 << 12, dtype=np.uint64)
        # of each piece: its ids (place and number), its bytes (place and number), and how often it was met
        self.at, self.count, self.text_at, self.text_n, self.met = (np.zeros(1 << 12, dtype=np.int32) for _ in range(5))
        self.ids, self.text = np.zeros(1 << 14, dtype=np.uint16), np.zeros(1 << 15, dtype=np.uint8)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and the number of ids of each. Words behind a space go by many in one
        call, split by the word that each id belongs to."""
        texts = [p.decode("utf-8", "surrogatepass") for p in pieces]
        plain = [i for i, t in enumerate(texts) if t[0] == " " and t[1:].isalpha()]
        found: list = [None] * len(texts)
        groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        for group, got in zip(groups, self.tokenizer.encode_batch(["".join([texts[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            lengths = np.bincount(np.array(got.word_ids, dtype=np.int64))
            if len(lengths) == len(group):
                own, a = got.ids, 0
                for i, n in zip(group, lengths.tolist(), strict=True):
                    found[i] = own[a : a + n]
                    a += n
        rest = [i for i, x in enumerate(found) if x is None]
        for i, got in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = got.ids
        lengths = np.array([len(x) for x in found], dtype=np.int64)
        return np.fromiter((i for x in found for i in x), dtype=np.uint16, count=int(lengths.sum())), lengths

    def _add(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        ids, lengths = self._encode(pieces)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        n, k = self.n, len(pieces)
        ids = ids if self.keep_ids else ids[:0]
        self.ids, self.text = _room(self.ids, self.n_ids, len(ids)), _room(self.text, self.n_text, int(sizes.sum()))
        self.hash, self.at, self.count, self.text_at, self.text_n, self.met = (_room(x, n, k) for x in (self.hash, self.at, self.count, self.text_at, self.text_n, self.met))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.text[self.n_text : self.n_text + int(sizes.sum())] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        own = slice(n, n + k)
        self.hash[own], self.count[own], self.text_n[own], self.met[own] = hashes, lengths, sizes, 0
        self.at[own] = self.n_ids + (ragged(lengths)[:-1] if self.keep_ids else 0)
        self.text_at[own] = self.n_text + ragged(sizes)[:-1]
        self._index(n, n + k)
        self.n, self.n_ids, self.n_text = n + k, self.n_ids + len(ids), self.n_text + int(sizes.sum())

    def _sweep(self) -> None:
        """Keep the pieces that were met more than once since the last sweep, if they are few enough."""
        keep = np.flatnonzero(self.met[: self.n] > 1)
        keep = keep if len(keep) < 0.6 * self.cache_pieces else keep[:0]
        old = self.hash[keep], self.at[keep], self.count[keep], self.text_at[keep], self.text_n[keep], self.ids, self.text
        self._empty()
        k = self.n = len(keep)
        self.hash, self.at, self.count, self.text_at, self.text_n, self.met = (_room(x, 0, k) for x in (self.hash, self.at, self.count, self.text_at, self.text_n, self.met))
        hashes, at, count, text_at, text_n, ids, text = old
        self.hash[:k], self.count[:k], self.text_n[:k] = hashes, count, text_n
        own = count if self.keep_ids else count * 0
        self.n_ids, self.n_text = int(own.sum()), int(text_n.sum())
        self.ids, self.text = _room(self.ids, 0, self.n_ids), _room(self.text, 0, self.n_text)
        self.ids[: self.n_ids] = ids[gather_runs(at, own)]
        self.text[: self.n_text] = text[gather_runs(text_at, text_n)]
        self.at[:k], self.text_at[:k] = ragged(own)[:-1], ragged(text_n)[:-1]
        self._index(0, k)

    def _index(self, a: int, b: int) -> None:
        """Put pieces a to b into the table, which is kept half empty."""
        if 2 * b > self.table.mask:
            self.table, a = HashTable((4 * b).bit_length()), 0
        self.table.put(self.hash[a:b], np.arange(a, b, dtype=np.int32))

    def _look(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """The cache's number of every piece, the pieces of each text as offsets, and the ids of pieces (by their place)
        that share a hash with another."""
        if self.n > self.cache_pieces or self.n_ids > 10 * self.cache_pieces or self.n_text > 60 * self.cache_pieces:
            self._sweep()
        offsets = ragged([len(x) for x in texts])
        raw = b"".join([*texts, bytes(8)])
        data = np.frombuffer(raw, dtype=np.uint8)
        size = len(raw) - 8
        starts = safe_cuts(data[:size], offsets)
        ends = np.append(starts[1:], size)
        hashes = RunHashes(data[:size]).of(starts, ends)
        place = self.table.find(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            own, first, of = np.unique(hashes[new], return_index=True, return_inverse=True)
            first = new[first]
            place[new] = self.n + of
            self._add(own, [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        n = ends - starts
        other = self.text_n[place] != n
        other |= differing(data, starts, self.text, self.text_at[place].astype(np.int64), np.where(other, 0, n))
        apart = {}
        for i in np.flatnonzero(other).tolist():
            apart[i] = self._encode([raw[starts[i] : ends[i]]])[0]
        self.met[: self.n] += np.bincount(place, minlength=self.n).astype(np.int32)
        return place, np.searchsorted(starts, offsets), apart

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint16) of a batch of texts, and the number of ids of each text."""
        texts = [x if isinstance(x, bytes) else (x or "").encode("utf-8", "surrogatepass") for x in (texts.to_pylist() if hasattr(texts, "to_pylist") else texts)]
        parts, lengths = [np.zeros(0, dtype=np.uint16)], np.zeros(len(texts), dtype=np.int64)
        for group in balanced(texts, BLOCK):
            place, ends, apart = self._look([x for _, x in group])
            own = self.count[place].astype(np.int64)
            for i, ids in apart.items():
                own[i] = len(ids)
            to = ragged(own)
            at = self.at[place].astype(np.int64)
            for i in apart:
                at[i] = 0
            out = self.ids[np.minimum(gather_runs(at, own), len(self.ids) - 1)]
            for i, ids in apart.items():
                out[to[i] : to[i + 1]] = ids
            np.add.at(lengths, [i for i, _ in group], np.diff(to[ends]))
            parts.append(out)
        return np.concatenate(parts), lengths

    def count_ids(self, texts: list[bytes]) -> np.ndarray:
        """The number of ids of each text."""
        place, ends, apart = self._look(texts)
        own = self.count[place].astype(np.int64)
        for i, ids in apart.items():
            own[i] = len(ids)
        return np.diff(ragged(own)[ends])
