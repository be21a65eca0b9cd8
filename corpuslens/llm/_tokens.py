"""Token ids of whole Arrow batches under a byte-level BPE tokenizer.

Texts are cut into words by arithmetic on arrays of character classes; every distinct word
is merged once by the tokenizer itself, and the ids of all words are gathered from there.
Words are known by 64-bit hashes.  Texts with a special token's string, or with characters
beyond the table of classes, are encoded whole by the tokenizer.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from ._bytes import Roller, mix, text_blocks

LETTER, NUMBER, OTHER, BLANK, SPACE, ODD = 1, 2, 3, 4, 5, 6
#: White space by code point, and the endings cut off after an apostrophe.
WHITE = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
#: Distinct words that a worker remembers (some 40 bytes each), and slots of its table of them.
REMEMBERED, SLOT_BITS = 1_000_000, 18
#: New words that are merged as one text.
MERGED = 2_000


def _classes() -> np.ndarray:
    """Class of every character of the basic plane; one more entry for all others."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], ODD if unicodedata.category(chr(c)) in ("Cn", "Co", "Cs") else OTHER) for c in range(0x10000)] + [ODD], dtype=np.uint8)
    table[0x1C:0x20] = ODD  # separators that regular expressions class differently
    table[WHITE] = SPACE
    table[0x20] = BLANK
    return table


class Ids:
    """Ids of texts; remembers the words it has met."""

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: bytes that stand for themselves; others come after 255
        self.chars = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.classes, self.roller = _classes(), Roller()
        self._forget()

    def _forget(self) -> None:
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # known words by hash
        self.first, self.count, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.slot_key, self.slot_word = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int64)

    def starts(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin, and the class of every character."""
        cls = self.classes[np.minimum(points, 0x10000)]
        kind = np.minimum(cls, BLANK) if not (cls >= SPACE).any() else np.where(cls == SPACE, BLANK, cls)
        n = len(points)
        mark = np.ones(n, dtype=bool)
        mark[1:] = kind[1:] != kind[:-1]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        mark |= edge[:n]
        # The last white space before a word goes alone, or with the word if it is a blank.
        i = np.flatnonzero(mark & (kind != BLANK) & ~edge[:n])
        i = i[kind[i - 1] == BLANK]
        mark[i - 1] = True
        mark[i[cls[i - 1] == BLANK]] = False
        quote = np.flatnonzero(mark & (points == ord("'")))
        for end in ENDINGS:
            at = quote[quote + len(end) < n]
            for j, c in enumerate(end, 1):
                at = at[(points[at + j] == ord(c)) & ~edge[at + j]]
            mark[at + 1] = False
            after = at + 1 + len(end)
            after = after[after < n]
            mark[after[(kind[after] == LETTER) & ~edge[after]]] = True
        return np.flatnonzero(mark), cls

    def _words(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of every word."""
        h = self.roller.stretch(self.roller.prefix(mix(points.astype(np.uint64) + np.uint64(1))), start, end)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        word = self.slot_word[slot]
        miss = np.flatnonzero(self.slot_key[slot] != h)
        if not len(miss):
            return word
        keys, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        at = np.minimum(place, max(len(self.keys) - 1, 0))
        numbers = self.number[at].astype(np.int64) if len(self.keys) else np.zeros(len(keys), np.int64)
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            i = miss[where[new]]
            numbers[new] = len(self.first) + np.arange(len(new))
            first, sizes, ids = self._merged(points, start[i], end[i])
            self.first = np.concatenate([self.first, (len(self.flat) + first).astype(np.int32)])
            self.count = np.concatenate([self.count, sizes.astype(np.int32)])
            self.flat = np.concatenate([self.flat, ids])
            self.keys = np.insert(self.keys, place[new], keys[new])
            self.number = np.insert(self.number, place[new], numbers[new])
        word[miss] = numbers[back]
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slot_key[slot], self.slot_word[slot] = keys, numbers
        return word

    def _merged(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each of these words begin and how many there are, and all ids.

        Words of a blank and letters keep apart when they are written one after the other, so they
        are merged as one text; others one by one.
        """
        cls = self.classes[np.minimum(points, 0x10000)]
        letters = np.concatenate([[0], np.cumsum(cls == LETTER)])
        plain = (cls[start] == BLANK) & (end - start > 1) & (letters[end] - letters[start] == end - start - 1)
        first, sizes, parts, held = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), [np.zeros(0, np.uint32)], 0
        every = np.flatnonzero(plain)
        for some in np.split(every, range(MERGED, len(every), MERGED)) if len(every) else ():
            n = end[some] - start[some]
            chars = points[np.repeat(start[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            found = self.whole.encode(chars.astype("<u4").tobytes().decode("utf-32-le"), add_special_tokens=False)
            ids, words = np.array(found.ids, dtype=np.uint32), np.array(found.word_ids, dtype=np.int64)
            edges = np.append(np.flatnonzero(np.append(True, words[1:] != words[:-1])), len(ids))
            if len(edges) == len(some) + 1:
                first[some], sizes[some], held = held + edges[:-1], np.diff(edges), held + len(ids)
                parts.append(ids)
        for k in np.flatnonzero(sizes == 0).tolist():
            raw = points[start[k] : end[k]].astype("<u4").tobytes().decode("utf-32-le").encode()
            ids = np.array([t.id for t in self.whole.model.tokenize(raw.decode("latin-1").translate(self.chars))], dtype=np.uint32)
            first[k], sizes[k], held = held, len(ids), held + len(ids)
            parts.append(ids)
        return first, sizes, np.concatenate(parts)

    def block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of consecutive texts, where each text's begin, and which texts must be encoded whole."""
        if len(self.keys) > REMEMBERED:
            self._forget()
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64), np.zeros(len(offsets) - 1, dtype=bool)
        if raw.max() < 128:
            points = raw.astype(np.uint32)
        else:
            points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
            offsets = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
        start, cls = self.starts(points, offsets)
        word = self._words(points, start, np.append(start[1:], len(points)))
        count = self.count[word].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.first[word] - total[:-1], count) + np.arange(total[-1])]
        odd = np.zeros(len(offsets) - 1, dtype=bool)
        odd[np.searchsorted(offsets, np.flatnonzero(cls == ODD), "right") - 1] = True
        return ids, total[np.searchsorted(start, offsets)], odd

    def batch(self, column: pa.Array):
        """The ids of every text in turn; null texts have none."""
        import pyarrow.compute as pc

        column = column.cast(pa.large_string()).fill_null("")
        special = np.zeros(len(column), dtype=bool)
        for s in self.special:
            special |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        for lo, hi, raw, offsets in text_blocks(column, 1 << 19):
            ids, at, odd = self.block(raw, offsets)
            for r in range(hi - lo):
                if odd[r] or special[lo + r]:
                    yield np.array(self.whole.encode(column[lo + r].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
                else:
                    yield ids[at[r] : at[r + 1]]


def worker_ids(tokenizer_path: str) -> Ids:
    """This worker's ids under a tokenizer: they outlive the task, and so do the words they know."""
    import sys
    import types

    state = sys.modules.setdefault("corpuslens_worker_state", types.ModuleType("corpuslens_worker_state"))
    known = vars(state).setdefault("ids", {})
    if tokenizer_path not in known:
        known[tokenizer_path] = Ids(tokenizer_path)
    return known[tokenizer_path]
