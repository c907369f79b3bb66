"""Public tokenizers inside Python workers."""

from __future__ import annotations

import base64
import os
from itertools import compress

import numpy as np
import pyarrow as pa

from fieldmark.llm.base import worker_state

# Tokens whose ids a worker keeps, other ones and plain ones, in two generations each: what was not met
# again while the newer one filled is forgotten (results do not depend on it).
CACHED_WORDS, CACHED_RUNS = 60_000, 300_000

# Bytes of text that are cut into tokens at once; a window ends at white space or with its text.
WINDOW_BYTES = 4_000_000

# What single bytes are: the letters are those of ASCII, and Latin-1's by their two bytes.
_OTHER, _SPACE, _LETTER, _MARK = range(4)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[list(b" \t\n\v\f\r")] = _SPACE
_KINDS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = _LETTER
_KINDS[list(b".,!?;:*#$%&")] = _MARK
_LEAD, _TIMES, _DIVIDED, _SMALL = 0xC3, 0x97, 0xB7, 0x9F     # of two bytes: the first of \xc0 to \xff, the second of \xd7, \xf7 and \xdf


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokens_of(text: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Tokens of the UTF-8 bytes of texts that begin at `starts`: the tokens, where each begins, which are plain.

    Texts are cut at ASCII white space and between a Latin-1 letter and a mark. A plain token consists of
    such letters, in lower case, or of marks; any other one is as it was.
    """
    kind, after = _KINDS[text], np.flatnonzero(text[:-1] == _LEAD) + 1
    after = after[(text[after] != _TIMES) & (text[after] != _DIVIDED)]
    kind[after] = kind[after - 1] = _LETTER
    before = np.empty_like(kind)
    before[:1], before[1:] = _SPACE, kind[:-1]
    before[starts] = _SPACE
    begins = (before == _SPACE) & (kind != _SPACE) | (before == _LETTER) & (kind == _MARK) | (before == _MARK) & (kind == _LETTER)
    # Capitals: Latin-1's lie below the sharp s, at the same distance from their small letters as ASCII's.
    capital = (text >= ord("A")) & (text <= ord("Z"))
    capital[after] = text[after] < _SMALL
    kept = kind != _SPACE
    at, text, other, capital = np.flatnonzero(begins), text[kept], kind[kept] == _OTHER, capital[kept]
    bounds = np.append(np.flatnonzero(begins[kept]), len(text))
    plain = ~np.logical_or.reduceat(other, bounds[:-1]) if len(at) else np.zeros(0, bool)
    text += 32 * (capital & np.repeat(plain, np.diff(bounds))).view(np.uint8)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(text)), at, plain


class Recent:
    """A dictionary of what was met lately: at most `limit` entries in the newer and in the older generation."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, keys: set[str]) -> set[str]:
        """The keys that are not known; known ones of the older generation move to the newer one."""
        absent = keys.difference(self.new)
        again = absent.intersection(self.old) if self.old else ()
        if again:
            self.new.update((k, self.old[k]) for k in again)
            absent.difference_update(again)
        return absent

    def turn(self) -> None:
        """Start a new generation if the newer one is full; between uses, as `new` must hold what is asked for."""
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new


class WordEncoder:
    """Ids of whole texts for a tokenizer that drops white space and splits at it.

    Such a tokenizer gives a text the ids of its words one after the other, so words
    are encoded once and looked up afterwards. Words are split between letters and
    marks, as the tokenizer itself does, and their letters lower-cased first, as it
    does too; any other token goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        # Ids whose piece is the end of a word, where the model marks those.
        mark = getattr(self.model.model, "end_of_word_suffix", None) or "\0"
        pieces = self.model.get_vocab()
        self.ends = np.zeros(max(pieces.values()) + 1, bool)
        self.ends[[i for piece, i in pieces.items() if piece.endswith(mark)]] = True
        self.words, self.runs = Recent(CACHED_WORDS // 2), Recent(CACHED_RUNS // 2)

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _ids_of_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs that are one word each, from one encoding of them all: ids that end a word part them."""
        ids = np.array(self.model.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(runs) or ends[-1] != len(ids):
            return self._ids(runs)
        data, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]

    def _known(self, tokens: list[str], plain: np.ndarray) -> list[bytes]:
        """Ids of different tokens; those that are not known are learnt."""
        fresh = list(self.runs.missing(set(compress(tokens, plain))))
        for start in range(0, len(fresh), 4_000):
            some = fresh[start:start + 4_000]
            self.runs.new.update(zip(some, self._ids_of_runs(some)))
        others = list(compress(tokens, ~plain))
        odd = list(self.words.missing(set(others)))
        self.words.new.update(zip(odd, self._ids(odd)))
        ids = list(map(self.runs.new.get, tokens))
        for i, token in zip(np.flatnonzero(~plain).tolist(), others):
            ids[i] = self.words.new[token]
        self.runs.turn()
        self.words.turn()
        return ids

    def _ids_of_window(self, text: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Ids of the texts between the bounds."""
        tokens, at, plain = tokens_of(text, bounds[:-1][bounds[:-1] < len(text)])
        coded = tokens.dictionary_encode()
        codes = coded.indices.to_numpy()
        plain_codes = np.zeros(len(coded.dictionary), bool)
        plain_codes[codes] = plain
        known = pa.array(self._known(coded.dictionary.to_pylist(), plain_codes), pa.large_binary())
        found = known.take(coded.indices)
        if not len(found):
            return [b""] * (len(bounds) - 1)
        _, ends, data = found.buffers()
        ends = np.frombuffer(ends, np.int64)[np.searchsorted(at, bounds)].tolist()
        return [data[a:b].to_pybytes() for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32 bit numbers; NULL is an empty text."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).fill_null("").cast(pa.large_string())
        _, bounds, data = texts.buffers()
        bounds = np.frombuffer(bounds, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        text = np.frombuffer(data or b"", np.uint8)
        out: list[list[bytes]] = [[] for _ in range(len(texts))]
        start, last = int(bounds[0]), int(bounds[-1])
        while start < last:
            end = start + WINDOW_BYTES
            if end < last:
                upto = int(bounds[np.searchsorted(bounds, end)])     # where the text ends that holds it
                end = next((at + i for at in range(end, upto, 4_096) if (i := _first_space(text[at:min(at + 4_096, upto)])) >= 0), upto)
            end = min(end, last)
            first, beyond = int(np.searchsorted(bounds, start, side="right")) - 1, int(np.searchsorted(bounds, end))
            inside = np.clip(bounds[first:beyond + 1], start, end) - start
            for i, ids in enumerate(self._ids_of_window(text[start:end], inside), first):
                out[i].append(ids)
            start = end
        return [b"".join(parts) for parts in out]


def _first_space(text: np.ndarray) -> int:
    """Position of the first white space, -1 without."""
    found = _KINDS[text] == _SPACE
    return int(found.argmax()) if found.any() else -1


def word_encoder(path: str) -> WordEncoder:
    return worker_state(f"words:{path}", lambda: WordEncoder(path))


def byte_encoder(path: str):
    """A byte-level encoding and the number of bytes of each of its ids."""
    def make():
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={}), sizes
    return worker_state(f"bytes:{path}", make)
