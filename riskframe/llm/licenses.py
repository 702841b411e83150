"""License texts in documents: MinHash bands over overlapping windows retrieve templates, exact shingle
containment verifies them.

Words are runs of ASCII letters, digits and characters beyond ASCII, lower-cased; shingles are five
words. Templates of ``n`` words are sought with windows of ``n + step - 1`` words that begin at every
multiple of ``step = max(1, n // 4)``, so some window holds a whole occurrence. Such a window then has a
Jaccard similarity of at least ``LEAST_JACCARD`` to the template if it contains ``CONTAINMENT`` of it;
``BANDS`` bands of ``ROWS`` rows share a band with probability above 0.999 there (``collision``). An
occurrence with words put in may contain that much only between two multiples, so around a window that
shares a band every start is verified.

A window that shares no shingle with a template cannot share a band with it, so only windows around
shingles of templates get signatures.

Names and versions are a word or two among dozens, so a window must also hold the phrases ``REQUIRED`` of
a template. Where several templates match one place, the most contained one stays (equal ones all): a
match goes if more than half of its shingles lie in more contained matches.

One row per document and template found: the highest containment and the first window that has it.
Null or empty text matches nothing. Templates of fewer than five words are refused. Repeated rows
give repeated rows. Empty tables give none.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Batches, keyed_texts

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 32, 2
LEAST_JACCARD = 0.45

#: Notices as their licenses publish them, and the short forms in common use.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-short": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-short": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-2.1-short": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0-short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "MPL-1.1-short": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Phrases with the name and version of a template, of at most ``SHINGLE`` words: a window with all
#: shingles of the template has them.
REQUIRED = {
    "MIT-short": ("mit license",),
    "Apache-2.0": ("apache license version 2 0",), "Apache-2.0-short": ("apache license version 2 0",),
    "GPL-3.0": ("gnu general public license", "version 3 of the license"), "GPL-3.0-short": ("gnu general public license", "public license version 3"),
    "GPL-2.0": ("gnu general public license", "version 2 of the license"), "GPL-2.0-short": ("gnu general public license", "public license version 2"),
    "LGPL-3.0": ("gnu lesser general public license", "version 3 of the license"),
    "LGPL-3.0-short": ("gnu lesser general public license", "public license version 3"),
    "LGPL-2.1": ("gnu lesser general public license", "version 2 1 of the"),
    "LGPL-2.1-short": ("gnu lesser general public license", "public license version 2 1"),
    "CC-BY-NC-4.0-short": ("cc by nc 4 0",), "CC-BY-4.0": ("creative commons attribution 4 0",),
    "MPL-2.0": ("mozilla public license", "license v 2 0"),
    "MPL-1.1": ("mozilla public license", "license version 1 1"), "MPL-1.1-short": ("mozilla public license", "license v 1 1"),
}

_LETTERS = b"abcdefghijklmnopqrstuvwxyz0123456789"
#: Lower case for letters, blanks for other ASCII characters, all else unchanged.
_FOLD = bytes(c if c in _LETTERS or c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(numbers: np.ndarray) -> np.ndarray:
    """Hash of each five consecutive word numbers."""
    n = len(numbers) - SHINGLE + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(SHINGLE if n > 0 else 0):
        out = mixed(out * _PRIME + numbers[i:i + n])
    return out


def word_numbers(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) | len(w) << 32 for w in words), np.uint64, len(words))


_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _PRIME)


def signature(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes[None, :] ^ _SEEDS[:, None]).min(axis=1)


def collision(jaccard: float) -> float:
    """Probability that two sets of this similarity share a band."""
    return 1 - (1 - jaccard ** ROWS) ** BANDS


@dataclass
class Template:
    name: str
    size: int
    shingles: frozenset[int]
    required: tuple[bytes, ...] = ()

    @property
    def step(self) -> int:
        return max(1, self.size // 4)

    @property
    def window(self) -> int:
        return self.size + self.step - 1


class Scanner:
    def __init__(self, templates: dict[str, str], required: dict[str, tuple[str, ...]] = REQUIRED):
        self.vocabulary: dict[bytes, int] = {}
        self.templates: list[Template] = []
        self.bands: dict[tuple, list[Template]] = {}
        known = set()
        for name, text in templates.items():
            words = words_of(text)
            if len(words) < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            hashes = shingle_hashes(word_numbers(words))
            t = Template(name, len(words), frozenset(hashes.tolist()), tuple(
                phrase for p in required.get(name, ()) if (phrase := b" %b " % p.encode()) in b" %b " % b" ".join(words)))
            self.templates.append(t)
            known |= t.shingles
            for band, key in enumerate(self.keys(hashes)):
                self.bands.setdefault((t.window, t.step, band, key), []).append(t)
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.known = np.array(sorted(known), dtype=np.uint64)
        self.shapes = sorted({(t.window, t.step) for t in self.templates})

    @staticmethod
    def keys(hashes: np.ndarray) -> list[tuple]:
        return [tuple(rows) for rows in signature(hashes).reshape(BANDS, ROWS).tolist()]

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, containment, first word, words of the window)."""
        words = words_of(text)
        # five template words in a row are needed before anything is hashed
        inside = np.fromiter((w in self.vocabulary for w in words), bool, len(words))
        if len(words) < SHINGLE or not np.convolve(inside, np.ones(SHINGLE, dtype=int), "valid").max() == SHINGLE:
            return []
        hashes = shingle_hashes(word_numbers(words))
        hits = np.flatnonzero(np.isin(hashes, self.known))
        matches: list[tuple[Template, float, int, int, np.ndarray]] = []
        for window, step in self.shapes if len(hits) else ():
            # windows (from, from + window) that hold a hit; the last one may reach past the text
            lowest, highest = np.maximum(0, hits - window + SHINGLE), hits
            starts = sorted({s for a, b in zip(lowest.tolist(), highest.tolist()) for s in range(-(-a // step) * step, b + 1, step)})
            tried: set[tuple[str, int]] = set()
            found: list[tuple[int, Template]] = []
            for start in starts:
                part = hashes[start:start + window - SHINGLE + 1]
                near = {id(t): t for band, key in enumerate(self.keys(part)) for t in self.bands.get((window, step, band, key), ())}
                for t in near.values():
                    for s in range(max(0, start - step + 1), min(len(hashes), start + step)):
                        if (t.name, s) not in tried:
                            tried.add((t.name, s))
                            found.append((s, t))
            for start, t in sorted(found, key=lambda f: f[0]):
                part = hashes[start:start + window - SHINGLE + 1].tolist()
                share = len(t.shingles & set(part)) / len(t.shingles)
                if share >= CONTAINMENT:
                    held = b" %b " % b" ".join(words[start:start + window])
                    if all(phrase in held for phrase in t.required):
                        at = start + np.flatnonzero([h in t.shingles for h in part])
                        matches.append((t, share, start, min(window, len(words) - start), at))
        top = np.zeros(len(hashes))
        for _, share, _, _, at in matches:
            top[at] = np.maximum(top[at], share)
        best: dict[str, tuple[float, int, int]] = {}
        for t, share, start, n, at in matches:
            if share > best.get(t.name, (0.0,))[0] and 2 * np.count_nonzero(top[at] > share) <= len(at):
                best[t.name] = (share, start, n)
        return [(t.name, *best[t.name]) for t in self.templates if t.name in best]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment, start_word, n_words."""
    def run(batches: Batches) -> Batches:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(key, *found) for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                    for found in scanner.scan(text)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             names=["doc_id", "license", "containment", "start_word", "n_words"])
    return keyed_texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, license string, containment double, start_word long, n_words long")
