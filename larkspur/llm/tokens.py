"""Token ids of whole texts, by the tokenizers library.

A byte-level BPE never merges over the borders of its pre-tokens, so a text falls into units at some of those borders, the
library encodes each distinct unit once, and the ids of a text are those of its units in turn. Borders are found, and units
looked up, for a block of bytes at a time with numpy: a unit of up to WIDE bytes is two numbers, which name it exactly.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The longest unit that is remembered, in bytes.
WIDE = 16
#: Units that a worker remembers, about 70 bytes each. As many bytes of text are looked at together, so that their units always find room.
UNITS = 1 << 20
#: Units that the library gets in one call.
TOGETHER = 1000
_SPACED, _LETTER, _DIGIT, _MARK, _QUOTE, _FAR = 1, 2, 3, 4, 5, 6


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)  # 0: other white space and control characters, at which nothing is parted
    kind[33:127], kind[128:] = _MARK, _FAR
    kind[list(b" \n")], kind[ord("'")] = _SPACED, _QUOTE
    kind[48:58] = _DIGIT
    kind[65:91] = kind[97:123] = _LETTER
    return kind


def _borders() -> np.ndarray:
    """Whether a unit may begin at a byte of a kind (second) after one of another kind (first), by 8 * first + second.

    White space after anything else begins a pre-token; so does what follows a run of letters, digits or marks of another kind. An
    apostrophe and what follows it stay together, as do bytes of characters beyond ASCII with what is before them.
    """
    table = np.zeros(64, bool)
    for a in (_LETTER, _DIGIT, _MARK, _QUOTE, _FAR):
        table[8 * a + _SPACED] = True
    for a, b in ((_LETTER, _DIGIT), (_DIGIT, _LETTER), (_LETTER, _MARK), (_DIGIT, _MARK), (_LETTER, _QUOTE), (_DIGIT, _QUOTE), (_MARK, _LETTER), (_MARK, _DIGIT)):
        table[8 * a + b] = True
    return table


KIND, BORDER = _kinds(), _borders()
#: White space beyond ASCII.
FAR_SPACE = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_FAR_SPACE = tuple(x.encode() for x in FAR_SPACE)
#: Whether a byte is the last, or the last but one, of white space beyond ASCII.
_LAST, _BEFORE = np.zeros(256, bool), np.zeros(256, bool)
_LAST[[x[-1] for x in _FAR_SPACE]] = _BEFORE[[x[-2] for x in _FAR_SPACE]] = True
_MASK = (np.uint64(1) << (np.arange(9, dtype=np.uint64) * np.uint64(8) % np.uint64(64))) - np.uint64(1)
_MASK[8] = ~np.uint64(0)


#: First bytes of UTF-8 whose characters are all letters, and the two second bytes after the first of them that aren't (multiplication and division signs).
_LEADS, _SIGNS = (0xC3, 0xC4, 0xC5, 0xD0, 0xD1), (0x97, 0xB7)


def starts_of(data: np.ndarray, raw: bytes, begin: int, stop: int, cuts: np.ndarray) -> np.ndarray:
    """Where units begin within data[begin:stop], its first byte and cuts included."""
    kind = KIND[data[begin:stop]]
    code = kind[:-1] * np.uint8(8)
    code += kind[1:]
    there = np.concatenate([[True], BORDER[code]])
    far = np.flatnonzero(_LAST[data[begin : stop - 1]] & (kind[1:] == _SPACED))
    for k in far[_BEFORE[data[begin + far - 1]]].tolist():
        if raw.endswith(_FAR_SPACE, 0, begin + k + 1):
            there[k + 1] = False
    there[cuts - begin] = True
    return np.flatnonzero(there) + begin


def of_letters(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether units are letters of the Latin or Cyrillic alphabets alone, but for a space before them. Units are in the order of their places."""
    if not len(begin):
        return np.zeros(0, bool)
    first, last = int(begin[0]), int(end[-1])
    part = data[first : last + 1]
    lead = np.isin(part, _LEADS)
    lead[:-1] &= ~((part[:-1] == _LEADS[0]) & np.isin(part[1:], _SIGNS))
    fine = (KIND[part] == _LETTER) | lead
    fine[1:] |= lead[:-1]
    bad = np.concatenate([[0], np.cumsum(~fine, dtype=np.int32)])
    head = (begin + (data[begin] == 32)) - first
    return (head < end - first) & (bad[end - first] == bad[head])


class Table:
    """Units of at most WIDE bytes, by the two numbers that hold their bytes, and the ids of each, all in arrays."""

    def __init__(self, units: int = UNITS):
        self.units, self.slots = units, 4 * units
        self.clear()

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.slot = np.full(self.slots, -1, np.int32)
        self.keys = np.empty((self.units, 2), np.uint64)
        self.begin, self.size = np.empty(self.units, np.int32), np.empty(self.units, np.int32)
        self.pool = np.empty(4 * self.units, np.uint32)

    def make_room(self, units: int, ids: int) -> bool:
        """Whether units had to be forgotten for so many new ones, with so many ids, at most: the quarter met first stays, among them the common ones."""
        if self.n + units <= self.units and self.used + ids <= len(self.pool):
            return False
        n = min(self.n, self.units // 4)
        while n and int((self.begin[:n] + self.size[:n]).max()) > 2 * self.units:
            n //= 2
        keys, begin, size, pool = self.keys[:n].copy(), self.begin[:n].copy(), self.size[:n].copy(), self.pool
        self.clear()
        order = self.find(keys, True)
        self.begin[order], self.size[order] = begin, size
        self.used = int((begin + size).max()) if n else 0
        self.pool[: self.used] = pool[: self.used]
        return True

    def find(self, keys: np.ndarray, add: bool) -> np.ndarray:
        """The entry of each key, or -1. With add, keys that lack get the next entries, in no order; there must be room."""
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) + keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        at = (h >> np.uint64(64 - (self.slots - 1).bit_length())).astype(np.intp)
        out = np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            here = at[open_]
            entry = self.slot[here]
            empty = entry < 0
            if add and empty.any():
                want, rows = here[empty], open_[empty]
                self.slot[want] = rows  # of rows that want one slot, one gets it
                won = self.slot[want] == rows
                first, rows = want[won], rows[won]
                fresh = np.arange(self.n, self.n + len(rows), dtype=np.int32)
                self.slot[first] = fresh
                self.keys[fresh] = keys[rows]
                self.n += len(rows)
                entry, empty = self.slot[here], np.zeros(len(here), bool)
            mine, theirs = keys.take(open_, axis=0), self.keys.take(np.maximum(entry, 0), axis=0)
            same = (mine[:, 0] == theirs[:, 0]) & (mine[:, 1] == theirs[:, 1]) & ~empty
            out[open_[same]] = entry[same]
            open_ = open_[~(same | empty)]
            at[open_] = (at[open_] + 1) & (self.slots - 1)
        return out


class Encoder:
    """Ids as unsigned 32-bit integers. Texts with the string of a special token, or a null character, go to the library whole."""

    def __init__(self, path: str, units: int = UNITS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        (self.feed,) = self.library.encode("\n", add_special_tokens=False).ids
        self.words = Tokenizer.from_file(path)  # for units that are one pre-token each: no need to look for more
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words.model._resize_cache(0)  # the table serves for it
        self.table = Table(units)

    def _whole(self, units: list[bytes]) -> list[np.ndarray]:
        """The ids of each unit, from the library."""
        texts = [u.decode("utf-8", "replace") for u in units]
        return [np.asarray(x.ids, np.uint32) for i in range(0, len(texts), TOGETHER) for x in self.library.encode_batch_fast(texts[i : i + TOGETHER], add_special_tokens=False)]

    def _lettered(self, units: list[bytes]) -> list[np.ndarray]:
        """The ids of TOGETHER units of letters after the other, and then how many each has. The library gets a line feed between units, whose id then parts them."""
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i in range(0, len(units), TOGETHER):
            text = b"\n".join(units[i : i + TOGETHER]).decode() + "\n"
            found = np.asarray(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(found == self.feed)
            ids.append(np.delete(found, ends))
            sizes.append(np.diff(ends, prepend=-1) - 1)
        return [np.concatenate(ids), np.concatenate(sizes)]

    def _learn(self, keys: np.ndarray, raw: bytes, begin: np.ndarray, size: np.ndarray, lettered: np.ndarray) -> np.ndarray:
        """Entries of units that the table lacked, which it now has."""
        table = self.table
        before = table.n
        entry = table.find(keys, True)
        if table.n > before:
            row = np.empty(table.n - before, np.intp)
            row[entry - before] = np.arange(len(entry))
            order = np.argsort(~lettered[row], kind="stable")
            row, split = row[order], int(lettered[row].sum())
            units = [raw[b:e] for b, e in zip(begin[row].tolist(), (begin[row] + size[row]).tolist(), strict=True)]
            ids, sizes = self._lettered(units[:split])
            rest = self._whole(units[split:])
            ids, sizes = np.concatenate([ids, *rest]), np.concatenate([sizes, np.fromiter(map(len, rest), np.int64, len(rest))])
            table.begin[before + order], table.size[before + order] = table.used + np.cumsum(sizes) - sizes, sizes
            table.pool[table.used : table.used + len(ids)] = ids
            table.used += len(ids)
        return entry

    def _block(self, raw: bytes, data: np.ndarray, padded: np.ndarray, begin: np.ndarray, end: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, and how many each has. data and padded: raw, as bytes and as numbers of eight bytes from each place on; odd: units that are whole texts for the library."""
        table, size = self.table, end - begin
        wide = np.flatnonzero((size > WIDE) | odd)
        short = np.flatnonzero((size <= WIDE) & ~odd)
        b, n = begin[short], size[short]
        keys = np.zeros((len(short), 2), np.uint64)
        keys[:, 0] = padded[b] & _MASK[np.minimum(n, 8)]
        long = np.flatnonzero(n > 8)
        keys[long, 1] = padded[b[long] + 8] & _MASK[n[long] - 8]
        entry = table.find(keys, False)
        lacking = np.flatnonzero(entry < 0)
        if len(lacking) and table.make_room(len(lacking), int(n[lacking].sum())):
            entry = table.find(keys, False)
            lacking = np.flatnonzero(entry < 0)
        entry[lacking] = self._learn(keys[lacking], raw, b[lacking], n[lacking], of_letters(data, b[lacking], b[lacking] + n[lacking]))
        count, source = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        count[short], source[short] = table.size[entry], table.begin[entry]
        units = [raw[x:y] for x, y in zip(begin[wide].tolist(), end[wide].tolist(), strict=True)]
        kinds = list(dict.fromkeys(units))
        ids = dict(zip(kinds, self._whole(kinds), strict=True))
        count[wide] = [len(ids[u]) for u in units]
        first = np.cumsum(count) - count
        place = np.repeat(source - first, count)
        place += np.arange(len(place))
        if len(wide):
            place[np.repeat((size > WIDE) | odd, count)] = 0
        out = table.pool[place]
        for k, u in zip(wide.tolist(), units, strict=True):
            out[first[k] : first[k] + count[k]] = ids[u]
        return out, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each ends. A null text counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring(texts, "\0")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        total = int(offsets[-1] - offsets[0]) if len(texts) else 0
        raw = (texts.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes() if total else b"") + bytes(WIDE + 8)
        offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
        data, padded = np.frombuffer(raw, np.uint8), np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        inside, block = [(int(offsets[k]), int(offsets[k + 1])) for k in whole.tolist()], self.table.units
        found, sizes, begins, at, step = [], [], [], 0, block
        while at < total:
            stop = min(at + step, total)
            cuts = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, stop, "left")]
            begin = starts_of(data, raw, at, stop, cuts)
            for a, b in inside:
                if a < stop and b > at:
                    begin = begin[(begin <= a) | (begin >= b)]
            if stop < total:
                if len(begin) < 2:
                    step *= 2  # a unit longer than a block
                    continue
                begin, stop = (begin[:-1], int(begin[-1])) if step == block else (begin[:1], int(begin[1]))
            odd = np.isin(begin, [a for a, _ in inside]) if inside else np.zeros(len(begin), bool)
            ids, count = self._block(raw, data, padded, begin, np.append(begin[1:], stop), odd)
            found.append(ids)
            sizes.append(count)
            begins.append(begin)
            at, step = stop, block
        if not found:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        ends = np.cumsum(np.concatenate(sizes))
        last = np.searchsorted(np.concatenate(begins), offsets[1:], "left") - 1
        return np.concatenate(found), np.where(last >= 0, ends[last], 0)

    def ended(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with the id end after each text."""
        ids, ends = self.encode(texts)
        return np.insert(ids, ends, np.uint32(end)), ends + np.arange(1, len(ends) + 1)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a worker, which stays from task to task. Its memory is bounded: see UNITS."""
    return Encoder(path)
