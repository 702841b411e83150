"""Token ids by the ``tokenizers`` library, with the ids of pieces of text kept between texts.

Merges never cross the cuts of a tokenizer's own first splitting step, so a text may be encoded in
pieces that end at such cuts. The distinct pieces of some 2 million characters are looked up once.
Frequent pieces are encoded once per Python worker: a cache keeps up to
``CACHE_PIECES`` pieces and, when half of that has been added, forgets those not met since the last
time. Results do not depend on it.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import keep_only, release

#: About 120 MB in each Python worker.
CACHE_PIECES = 600_000

#: A single full stop or comma behind a letter, at the end of a piece, is a word of its own.
_STOP = r"\p{L}[.,]$"

#: Words of letters up to this one are taken to the merges directly.
LAST_LATIN = "\u024f"
#: Byte-level vocabularies write each byte as a letter: printable Latin-1 ones as themselves, the rest from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_BLANK = chr(_BYTE_LETTERS[ord(" ")])

#: White space other than single blanks and line ends: such texts are encoded as a whole.
_UNEVEN = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c")
_UNEVEN_UNICODE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers.

    ``blanks`` says what the tokenizer does with white space: "dropped" where words are cut at white
    space and it is lost, "leading" where a blank belongs to the word behind it.
    """

    def __init__(self, path: str, blanks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.blanks = blanks
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.line_end, *stops = self._encode(["\n", ".", ","])
        self.stops = dict(zip(b".,", stops))
        words = ["the", "naïve", "Übermaß", "čaj", "thertiontheing"]
        lead = "" if blanks == "dropped" else " "
        self.by_model = [self._word(w) for w in words] == self._encode([lead + w for w in words])

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def _word(self, word: str, lead: str | None = None) -> bytes | None:
        """Ids of a word of Latin letters only, which no tokenizer here cuts before merging: straight from the
        merges, in a third of the time. None for other pieces."""
        if self.blanks == "dropped":
            word, lead = word.lower(), ""
        if not word.isalpha() or max(word) > LAST_LATIN:
            return None
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        if lead is None:
            letters = _BLANK + letters
        ids = [t.id for t in self.merge(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_keys(self, keys: list[bytes]) -> list[bytes]:
        """Ids of pieces: words by their merges, others as texts of their own."""
        lead = "" if self.blanks == "dropped" else " "
        found, rest = [], []
        for i, key in enumerate(keys):
            text = key.decode()
            if not self.by_model:
                ids = None
            elif key[:1] == b"\n":
                ids = self._word(text[1:], "")
                ids = ids and self.line_end + ids
            else:
                ids = self._word(text)
            found.append(ids)
            if ids is None:
                rest.append((i, text if key[:1] == b"\n" else lead + text))
        for (i, _), ids in zip(rest, self._encode([t for _, t in rest])):
            found[i] = ids
        return found

    def _by_piece(self, keys: list[bytes]) -> list[bytes]:
        """Ids of pieces, from the cache where they are known."""
        found = list(map(self.cache.get, keys))
        absent = [i for i, ids in enumerate(found) if ids is None]
        if len(self.cache) + len(absent) > CACHE_PIECES // 2:
            self.cache, self.older, absent = {}, self.cache, range(len(keys))
        unknown: dict[bytes, list[int]] = {}
        for i in absent:
            key = keys[i]
            found[i] = self.older.get(key)
            if found[i] is None:
                unknown.setdefault(key, []).append(i)
        for places, ids in zip(unknown.values(), self._encode_keys(list(unknown))):
            for i in places:
                found[i] = ids
        self.cache.update((keys[i], found[i]) for i in absent)
        return found

    def _even(self, text: str) -> bool:
        """Whether a text may be cut at blanks and line ends."""
        if self.blanks == "dropped":
            return True
        raw = text.encode()
        if not raw or raw[:1].isspace() or raw[-1:].isspace() or any(x in raw for x in _UNEVEN):
            return False
        return raw.isascii() or not any(x in raw for x in _UNEVEN_UNICODE)

    def _pieces(self, texts: list[str]) -> pa.ListArray:
        """With leading blanks a piece stands for blank and piece, unless it starts with a line end; the
        first piece of a text gets a line end too and ``ids`` takes that away again."""
        if self.blanks == "dropped":  # these also ignore case; special tokens are written with "<|"
            whole = pa.array(texts, pa.large_string())
            return pc.ascii_split_whitespace(pc.if_else(pc.match_substring(whole, "<|"), whole, pc.ascii_lower(whole)))
        return pc.split_pattern(pa.array([("\n" + t).replace("\n", " \n")[1:] for t in texts], pa.large_string()), " ")

    def _of_pieces(self, pieces: pa.Array) -> list[bytes]:
        """Ids of distinct pieces; a stop behind a word is looked up alone."""
        keys = _raw(pieces)
        stop = pc.and_not(pc.match_substring_regex(pieces, _STOP), pc.match_substring(pieces, "<|")).to_numpy(zero_copy_only=False)
        found = self._by_piece([k[:-1] if s else k for k, s in zip(keys, stop.tolist())])
        for i in np.flatnonzero(stop).tolist():
            found[i] += self.stops[keys[i][-1]]
        return found

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be cut: each distinct piece is looked up once for all of them."""
        pieces = self._pieces(texts)
        coded = pieces.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        found = self._of_pieces(coded.dictionary)
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        begin = np.cumsum(size) - size
        n = size[which]
        end = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(found), dtype="<u4")[np.repeat(begin[which] - end[:-1], n) + np.arange(end[-1])].tobytes()
        bounds = (4 * end[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]).tolist()
        skip = 0 if self.blanks == "dropped" else 4
        return [ids[a + skip:b] for a, b in zip(bounds, bounds[1:])]

    def ids(self, texts: list[str]) -> list[bytes]:
        even = [self._even(t) for t in texts]
        cut = iter(self._cut([t for t, e in zip(texts, even) if e]))
        whole = iter(self._encode([t for t, e in zip(texts, even) if not e]))
        return [next(cut if e else whole) for e in even]


def _raw(texts: pa.Array) -> list[bytes]:
    """The texts of an array without nulls as bytes, cut from its buffer."""
    _, offsets, data = texts.cast(pa.large_binary()).buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset:][:len(texts) + 1].tolist() if len(texts) else []
    whole = data.to_pybytes() if data else b""
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, blanks: str) -> Encoder:
    """One per Python worker and vocabulary file."""
    keep_only(f"tokens {path}", _ENCODERS.clear)
    if (path, blanks) not in _ENCODERS:
        _ENCODERS[path, blanks] = Encoder(path, blanks)
        release()  # reading the file takes as much again
    return _ENCODERS[path, blanks]


def grouped(texts: list[str], chars: int = 2_000_000):
    """Index ranges of about ``chars`` characters, so that cut texts stay small in memory."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_all(coder: Encoder, texts: list[str]):
    for a, b in grouped(texts):
        yield from coder.ids(texts[a:b])
