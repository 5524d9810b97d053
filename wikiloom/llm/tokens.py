"""Token ids of whole texts by the ``tokenizers`` library, each distinct word encoded once.

The tokenizers used here cut at white space before they merge, and no special token holds any, so
the ids of a text are the ids of its words one after the other. Texts are cut at ASCII white space
and their words numbered by Arrow; a word of plain letters with punctuation behind it is cut once
more, where the tokenizer cuts too, and folded to lower case. What is left is looked up in a
dictionary that a worker keeps, of bounded size; only what is not there goes to the library, many
words in one text: the vocabulary marks the last token of a word, and the answer is cut there. The
ids of the texts are then gathered by number.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker keeps; when there are more it begins anew.
KEPT_WORDS = 400_000
#: Letters whose case folds one to one and which no normal form changes, and ASCII punctuation.
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
STOPS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[!-/:-@\[-`{-~]*$"
_JOINED = 400


def gather(flat: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``flat`` by number, one after the other, and their sizes."""
    begins = np.cumsum(sizes) - sizes
    size = sizes[wanted]
    ends = np.cumsum(size)
    at = np.repeat(begins[wanted] - (ends - size), size)
    at += np.arange(len(at))
    return flat[at], size


class WordTokenizer:
    """``ids`` gives what ``encode(text, add_special_tokens=False).ids`` gives for each text.

    ``separable`` tells that words may be encoded alone: the file normalises word by word and its
    pre-tokenizer drops white space. Other files are encoded text by text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model, first = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        suffix = model.get("end_of_word_suffix")
        self.separable = bool(suffix) and first.get("behavior") == "Removed" and first.get("invert") is True
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _encode_joined(self, words: list[str]) -> list[bytes]:
        """The ids of lower-case words of plain letters: each is one piece that ends with an end token."""
        texts = [" ".join(words[i : i + _JOINED]) for i in range(0, len(words), _JOINED)]
        out: list[bytes] = []
        for ids in self._encode(texts):
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        if len(out) != len(words):
            raise ValueError("the vocabulary does not mark the end of every word")
        return out

    def _look_up(self, words: list[str], plain: bool) -> list[bytes]:
        known = self.known
        found = list(map(known.get, words))
        new = [w for w, x in zip(words, found, strict=True) if x is None]
        if not new:
            return found
        made = self._encode_joined(new) if plain else [x.tobytes() for x in self._encode(new)]
        if len(known) + len(new) > KEPT_WORDS:
            self.known = known = {}
        fresh = dict(zip(new, made, strict=True))
        known.update(fresh)
        return [fresh[w] if x is None else x for w, x in zip(words, found, strict=True)]

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and how many each has."""
        is_plain = pc.match_substring_regex(words, _PLAIN)
        plain, other = words.filter(is_plain), words.filter(pc.invert(is_plain))
        cores = pc.utf8_lower(pc.utf8_rtrim(plain, characters=STOPS)).dictionary_encode()
        stops = pc.utf8_ltrim(plain, characters=LETTERS).dictionary_encode()
        pieces = self._look_up(cores.dictionary.to_pylist(), True)
        tails = self._look_up(stops.dictionary.to_pylist(), False)
        rest = self._look_up(other.to_pylist(), False)
        every = [*pieces, *tails, *rest, b""]
        flat = np.frombuffer(b"".join(every), "<u4")
        sizes = np.fromiter(map(len, every), np.int64, len(every)) // 4
        mask = is_plain.to_numpy(zero_copy_only=False)
        two = np.full((len(words), 2), len(every) - 1)
        two[mask, 0] = cores.indices.to_numpy()
        two[mask, 1] = stops.indices.to_numpy() + len(pieces)
        two[~mask, 0] = np.arange(len(rest)) + len(pieces) + len(tails)
        flat, size = gather(flat, sizes, two.ravel())
        return flat, size.reshape(-1, 2).sum(axis=1)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one after the other, and how many each has."""
        texts = pc.fill_null(texts, "")
        if not self.separable:
            found = self._encode(texts.to_pylist())
            return np.concatenate([*found, np.zeros(0, "<u4")]), np.array([len(x) for x in found], np.int64)
        cut = pc.ascii_split_whitespace(texts)
        bounds = cut.offsets.to_numpy()
        words = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        ids, size = gather(*self._word_ids(words.dictionary), words.indices.to_numpy())
        before = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(before[bounds - bounds[0]])


_OPEN: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file; it and the words it knows outlive a task, see ``close_tokenizers``."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]


def close_tokenizers() -> None:
    """Forget the worker's tokenizers and the words they know."""
    _OPEN.clear()


def ended_ids(words: WordTokenizer, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``words.ids`` with ``end_id`` after the ids of each text."""
    ids, counts = words.ids(texts)
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype("<u4"), counts + 1


def id_bytes(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive stretches of ``ids`` as binary values, without a copy of each."""
    ends = np.concatenate([[0], np.cumsum(counts * 4)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))])


def slices(batches: Iterable[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts of the batches with about ``most`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
            yield batch.slice(a, b - a)
            a = b
