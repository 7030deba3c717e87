"""Token ids of whole texts by a public tokenizer, with the ids of every word computed once per worker and period.

The tokenizer drops white space and never joins words over it, so a text's ids are the ids of its words in a row
(``tests/llm`` compares both ways). Words of plain Latin letters with trailing signs are split once more, because their two parts
are separate units of the tokenizer: this makes far fewer distinct units. Words, units and ids lie in Arrow and numpy arrays; only words
that are not plain pass through Python one by one.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cohortloom.llm.texts import segment_sums

WORDS_KEPT = 400_000
BYTES_KEPT = 16 << 20  # of words, and of units
# Letters up to U+017F whose lower case is one letter (U+0130 is not), then ASCII signs.
PLAIN = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-įı-ſ]+)(?P<signs>[!-/:-@\\[-`{-~]*)$"
JOINED = 20_000


class Lists:
    """Lists of ids by number, in one array."""

    def __init__(self):
        self.begin, self.length, self.flat = (np.zeros(0, t) for t in (np.int64, np.int32, np.int32))

    def add(self, length: np.ndarray, flat: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(length, dtype=np.int64) - length])
        self.length = np.concatenate([self.length, length.astype(np.int32)])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def take(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids in a row) of the lists with these numbers."""
        length = self.length[number]
        ends = np.cumsum(length, dtype=np.int64)
        place = np.repeat(self.begin[number] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        return length, self.flat[place]


class Known:
    """Distinct strings, numbered in the order in which they come, with their ids."""

    def __init__(self):
        self.keys, self.ids, self.seen = pa.array([], pa.string()), Lists(), np.zeros(0, np.int64)

    def number(self, keys: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
        """Numbers of distinct strings, and the new ones among them, whose ids have to be added next."""
        at = pc.index_in(keys, value_set=self.keys)
        new = keys.filter(at.is_null())
        number = at.fill_null(-1).to_numpy().astype(np.int64)
        number[number < 0] = len(self.keys) + np.arange(len(new))
        self.keys = pa.concat_arrays([self.keys, new])
        return number, new

    def full(self, most: int) -> bool:
        return len(self.keys) > most or self.keys.nbytes > BYTES_KEPT

    def without_rare(self, most: int) -> Known:
        """What was seen more than once since the last time; nothing, if that is more than half."""
        keep = np.flatnonzero(self.seen > 1)
        out = Known()
        keys = self.keys.take(pa.array(keep))
        if len(keys) <= most // 2 and keys.nbytes <= BYTES_KEPT // 2:
            out.keys, out.seen = keys, np.zeros(len(keep), np.int64)
            out.ids.add(*self.ids.take(keep))
        return out


class WordTokens:
    """Growing store of ids by word. When it is full, words seen once since the last time leave; units all leave."""

    def __init__(self, path: str, most: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        self.words, self.units, self.most = Known(), Known(), most

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn_units(self, units: pa.StringArray) -> None:
        """Most units are runs of letters, or of signs: each gives one piece with a single end mark, so many can go in one text."""
        for i in range(0, len(units), JOINED):
            part = units.slice(i, JOINED)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")[0].as_py()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part) and (not len(cut) or cut[-1] == len(ids)):
                self.units.ids.add(np.diff(cut, prepend=0), ids)
            else:
                own = [self.encode(unit) for unit in part.to_pylist()]
                self.units.ids.add(np.fromiter(map(len, own), np.int64, len(own)), np.fromiter(chain.from_iterable(own), np.int64))

    def numbered_units(self, parts: pa.StringArray) -> np.ndarray:
        coded = parts.dictionary_encode()
        number, new = self.units.number(coded.dictionary)
        self.learn_units(new)
        return number[coded.indices.to_numpy()]

    def learn(self, words: pa.StringArray) -> None:
        found = pc.extract_regex(words, PLAIN)
        plain = found.is_valid()
        own = [self.encode(w.decode("utf-8", "replace")) for w in words.filter(pc.invert(plain)).view(pa.binary()).to_pylist()]
        plain = plain.to_numpy(zero_copy_only=False)
        letters, signs = (found.field(i).filter(pa.array(plain)) for i in (0, 1))
        letters, signed = self.numbered_units(pc.utf8_lower(letters)), pc.not_equal(signs, "")
        behind = self.numbered_units(signs.filter(signed))
        # Both parts of a plain word in a row; words without signs have one part.
        signed = signed.to_numpy(zero_copy_only=False)
        many = 1 + signed
        part = np.empty(many.sum(), np.int64)
        at = np.cumsum(many) - many
        part[at], part[at[signed] + 1] = letters, behind
        of_part, flat = self.units.ids.take(part)
        length = np.empty(len(words), np.int64)
        length[plain], length[~plain] = segment_sums(of_part.astype(np.int64), many), [len(o) for o in own]
        if own:
            mine = np.repeat(plain, length)
            both = np.empty(len(mine), np.int64)
            both[mine], both[~mine] = flat, list(chain.from_iterable(own))
            flat = both
        self.words.ids.add(length, flat)
        if self.units.full(self.most):
            self.units = Known()

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and their number per text."""
        if self.words.full(self.most):
            self.words = self.words.without_rare(self.most)
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        real = pc.not_equal(lists.flatten(), "")  # white space at either end of a text gives empty words
        counts = segment_sums(real.to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
        coded = lists.flatten().filter(real).dictionary_encode()
        number, new = self.words.number(coded.dictionary)
        if len(new):
            self.learn(new)
        place = coded.indices.to_numpy()
        used = np.zeros(len(self.words.keys), np.int64)
        used[:len(self.words.seen)] = self.words.seen
        used[number] += np.bincount(place, minlength=len(number))
        self.words.seen = used
        length, flat = self.words.ids.take(number[place])
        return flat, segment_sums(length.astype(np.int64), counts)


_by_path: dict[tuple[str, int], WordTokens] = {}


def word_tokens(path: str, most: int = WORDS_KEPT) -> WordTokens:
    """One store of about ``most`` words per worker and file: words repeat from task to task."""
    if (path, most) not in _by_path:
        _by_path.clear()
        _by_path[path, most] = WordTokens(path, most)
    return _by_path[path, most]
