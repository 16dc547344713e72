"""Token ids of whole columns by the tokenizers library, which encodes a task's different words once each.

A text's ids are those of its words, one after the other, where a word begins at every single space or line's end
between visible characters: byte-level pre-tokenisation begins a token at each of these, an added token
holds neither, and merges stay within a token.  The different words of a batch are looked up in a hash table on
arrays; those not met before are encoded together, each with its space or line's end, and told apart by the ids that
begin with one.  Files whose tokens could cross a space are encoded in whole texts.

Defined results: a null text is the empty one and has no ids; ids are those of
`Tokenizer.encode(text, add_special_tokens=False)`, added tokens in the text included.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import span_hashes

#: Words whose ids a task remembers, and as many that it met before these (some 100 MB in all); the longest ones.
REMEMBERED, LONGEST = 1 << 19, 48
#: A space or a line's end between two visible characters: the splitting pattern always begins a token there.
GAP = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
#: Texts with other white space, or with a space or a line's end beside another or at an end (for RE2).
ODD = r"[ \n][ \n]|^[ \n]|[ \n]$|[" + "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]"
#: Words of Latin letters and ASCII marks after them: pre-tokenisation makes these two tokens ("'" is another
#: matter), and a line's end before them one more (for RE2).
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
LATIN = rf"^\n?[{LETTERS}]+[{MARKS}]*$"


def byte_letters() -> list[str]:
    """How byte-level vocabularies write the 256 bytes: the visible Latin-1 characters as they are, the others
    from U+0100 on in their order."""
    shown = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    return [chr(b if shown[b] else 256 + b - sum(shown[:b])) for b in range(256)]


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i]:starts[i] + sizes[i]] of all i, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class WordTable:
    """Ids of words, by open addressing on 64-bit hashes; a hit counts only where the words themselves are equal."""

    def __init__(self) -> None:
        self.words, self.n = pa.array([], pa.large_string()), 0
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.n_ids = np.zeros(1 << 14, "<u4"), 0
        self.slots = np.full(1 << 14, -1, np.int32)

    def find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Each word's place, -1 where it is absent and -2 where another word of its hash is present."""
        out, todo = np.full(len(hashes), -1), np.arange(len(hashes))
        mask = np.uint64(len(self.slots) - 1)
        at = (hashes & mask).astype(np.int64)
        while len(todo):
            held = self.slots[at]
            hit = (held >= 0) & (self.hashes[held] == hashes[todo])
            out[todo[hit]] = held[hit]
            on = (held >= 0) & ~hit
            todo, at = todo[on], (at[on] + 1) & int(mask)
        met = np.flatnonzero(out >= 0)
        same = np.asarray(pc.equal(self.words.take(pa.array(out[met])), words.take(pa.array(met))))
        out[met[~same]] = -2
        return out

    def add(self, words: pa.Array, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Adds absent words of different hashes."""
        n, n_ids = self.n + len(hashes), self.n_ids + len(ids)
        for name, size in (("hashes", n), ("starts", n), ("sizes", n), ("ids", n_ids)):
            have = getattr(self, name)
            if len(have) < size:
                setattr(self, name, np.concatenate((have, np.zeros(2 * size - len(have), have.dtype))))
        new = np.arange(self.n, n)
        self.hashes[new], self.sizes[new], self.ids[self.n_ids : n_ids] = hashes, sizes, ids
        self.starts[new] = self.n_ids + np.cumsum(sizes) - sizes
        self.words = pa.concat_arrays([self.words, words.cast(pa.large_string())])
        self.n, self.n_ids = n, n_ids
        if 2 * n > len(self.slots):
            self.slots = np.full(1 << int(4 * n).bit_length(), -1, np.int32)
            new = np.arange(n)
        mask = len(self.slots) - 1
        at = (self.hashes[new] & np.uint64(mask)).astype(np.int64)
        while len(new):
            free = self.slots[at] < 0
            self.slots[at[free]] = new[free]
            on = self.slots[at] != new
            new, at = new[on], (at[on] + 1) & mask

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places, one after the other, and how many each has."""
        return ragged(self.ids, self.starts[places], self.sizes[places]), self.sizes[places]


def word_hashes(words: pa.Array) -> np.ndarray:
    _, where, data = words.buffers()
    offsets = np.frombuffer(where, np.int64)[words.offset : words.offset + len(words) + 1]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(words) else np.zeros(0, np.uint8)
    return span_hashes(buf, offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tuple[Callable[[pa.Array], list[np.ndarray]], Callable[[], None]]:
    """A function from texts to the arrays of their ids without special tokens, and one that forgets the words that the
    first has met: a worker outlives its task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer, pre_tokenizers

    coder = Tokenizer.from_file(path)

    def whole(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in coder.encode_batch_fast(texts, add_special_tokens=False)]

    def plainly(texts: pa.Array) -> list[np.ndarray]:
        return whole([t or "" for t in texts.to_pylist()])

    added, split = coder.get_added_tokens_decoder().values(), coder.pre_tokenizer
    plain = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space and coder.normalizer is None
    if not plain or coder.post_processor is not None or any({*" \n"} & {*t.content} or t.lstrip or t.rstrip or t.single_word for t in added):
        return plainly, lambda: None
    letters = byte_letters()
    vocabulary = coder.get_vocab()
    begins = np.zeros(max(vocabulary.values()) + 1, bool)
    begins[[i for word, i in vocabulary.items() if word.startswith(letters[0x20]) or word == letters[0x0A]]] = True
    # the same merges for words that are written in byte letters already
    latin = Tokenizer(coder.model)
    latin.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    rewritten = [(chr(b), letters[b]) for b in range(0x80, 0x100) if chr(b) != letters[b]] + [("\1", letters[0x20]), ("\2", letters[0x0A])]
    tables = [WordTable(), WordTable()]  # words met lately, and before these

    def together(coder, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        return ids, np.diff(np.append(np.flatnonzero(begins[ids]), len(ids)))

    def encoded(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each with its space or line's end, one after the other, and how many each has."""
        easy = np.asarray(pc.match_substring_regex(words, LATIN))
        plain = words.filter(pa.array(easy))
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        if len(plain):
            spaced = pc.replace_substring(pc.replace_substring_regex(plain, r"^([^\n])", "\1\\1"), "\n", "\2 ")
            cut = pc.replace_substring_regex(spaced, rf"([{LETTERS}])([{MARKS}])", r"\1 \2", max_replacements=1)
            joined = " ".join(cut.to_pylist()).encode().decode("latin-1")
            for byte, letter in rewritten:
                joined = joined.replace(byte, letter)
            made = together(latin, joined)
            ids.append(made[0])
            sizes.append(made[1])
        texts = [w if w[:1] == "\n" else " " + w for w in words.filter(pa.array(~easy)).to_pylist()]
        inner = np.array([" " in t[1:] or "\n" in t[1:] for t in texts], bool)
        if len(texts):
            made = together(coder, "".join(t for t, x in zip(texts, inner, strict=True) if not x))
            others = whole([t for t, x in zip(texts, inner, strict=True) if x])
            ids += [made[0], *others]
            sizes += [made[1], np.array([len(x) for x in others], np.int64)]
        hard = np.flatnonzero(~easy)
        order = np.argsort(np.concatenate((np.flatnonzero(easy), hard[~inner], hard[inner])))
        n, flat = np.concatenate(sizes), np.concatenate(ids)
        return ragged(flat, (np.cumsum(n) - n)[order], n[order]), n[order]

    def values(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encoded(), for different words."""
        lately, before = tables
        hashes = word_hashes(words)
        at = lately.find(words, hashes)
        gaps = np.flatnonzero(at < 0)
        if before.n and len(gaps):
            rest = words.take(pa.array(gaps))
            old = before.find(rest, hashes[gaps])
            known, fresh = np.flatnonzero(old >= 0), np.flatnonzero(old < 0)
            order = np.argsort(np.concatenate((known, fresh)))
            parts = [before.take(old[known]), encoded(rest.take(pa.array(fresh)))]
            n, flat = np.concatenate([p[1] for p in parts]), np.concatenate([p[0] for p in parts])
            ids, sizes = ragged(flat, (np.cumsum(n) - n)[order], n[order]), n[order]
        else:
            ids, sizes = encoded(words.take(pa.array(gaps)))
        if not len(gaps):
            return lately.take(at)
        held, held_n = lately.take(at[at >= 0])
        n, flat = np.concatenate((held_n, sizes)), np.concatenate((held, ids))
        order = np.argsort(np.concatenate((np.flatnonzero(at >= 0), gaps)))
        # words of a hash that is taken, in the table or among these, are encoded each time
        _, once = np.unique(hashes[gaps], return_index=True)
        kept = np.zeros(len(gaps), bool)
        kept[once] = True
        kept &= (at[gaps] == -1) & (np.asarray(pc.binary_length(words.take(pa.array(gaps)))) <= LONGEST)
        keep = np.flatnonzero(kept)
        lately.add(words.take(pa.array(gaps[keep])), hashes[gaps[keep]], ragged(ids, (np.cumsum(sizes) - sizes)[keep], sizes[keep]), sizes[keep])
        if lately.n > REMEMBERED:
            tables[:] = [WordTable(), lately]
        return ragged(flat, (np.cumsum(n) - n)[order], n[order]), n[order]

    def encode(texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, ODD))
        lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ").cast(pa.large_list(pa.large_string()))
        apart = pa.array([GAP.split(t) for t in texts.filter(pa.array(odd)).to_pylist()], lists.type)
        lists = pa.concat_arrays([lists, apart])
        row = np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))
        cut = np.asarray(lists.offsets)
        words, first = lists.values, cut[:-1]
        rest = np.ones(len(words), bool)
        rest[first] = False
        coded = words.filter(pa.array(rest)).dictionary_encode()
        ids, size = values(coded.dictionary)
        begin = np.cumsum(size) - size
        place = np.asarray(coded.indices)
        flat = ragged(ids, begin[place], size[place])
        ended = np.concatenate(([0], np.cumsum(size[place])))
        bounds = ended[cut - np.arange(len(cut))]
        out: list[np.ndarray] = [flat] * len(texts)
        for k, head in enumerate(whole(words.take(pa.array(first)).to_pylist())):
            out[row[k]] = np.concatenate((head, flat[bounds[k] : bounds[k + 1]]))
        return out

    def forget() -> None:
        tables[:] = [WordTable(), WordTable()]

    return encode, forget
