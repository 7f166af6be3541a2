"""Exact whole-text encoding with remembered chunks.

Byte-pair vocabularies are applied to each pre-token separately, and no
pre-token of the vocabularies used here crosses certain places next to white
space.  A text is therefore cut there, and the ids of a chunk that occurs again
are taken from memory instead of being merged anew.  Ids are little-endian
unsigned 32-bit integers in a ``bytes``.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from .common import held

#: Chunks that a worker remembers, and the longest that it does.
CACHE_CHUNKS = 1_200_000
CACHE_CHARS = 64
#: Characters of texts that are cut and looked up together, and new chunks in one call of the library.
BATCH_CHARS = 1 << 22
NEW_CHUNKS = 20_000
_SPACE_THEN_WORD = re.compile(r" (?=\S)")
_SPACE_THEN_SPACE = re.compile(r" (?:\s|$)")


def cut_at_white_space(text: str) -> list[str]:
    """Chunks for vocabularies that drop white space: cut at it."""
    for c in "\n\t\r":
        if c in text:
            text = text.replace(c, " ")
    return text.split(" ")


def cut_before_words(text: str) -> list[str]:
    """Chunks for byte-level vocabularies, where a space joins the word after it.

    A pre-token begins at every space that a visible character follows, whatever
    stands before; other white space may join its neighbours and isn't cut at.
    The space itself is left out: it leads every chunk but the first.
    """
    return _SPACE_THEN_WORD.split(text) if _SPACE_THEN_SPACE.search(text) else text.split(" ")


class ChunkEncoder:
    """Encodes texts chunk by chunk; ``encode_many`` gives the ids of new chunks.

    ``lead`` stands before every chunk but a text's first.
    """

    def __init__(self, cut: Callable, encode_many: Callable, lead: str = "", whole: tuple[str, ...] = ()):
        """``whole``: strings that make a text be encoded in one piece."""
        self._cut, self._encode_many, self._lead, self._whole = cut, encode_many, lead, whole
        self._known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self._whole):
            return self._encode_many([text])[0]
        chunks = self._cut(text)
        first = chunks[0]
        if self._lead:  # remembered under a name that no chunk has, as it has no lead
            chunks[0] = self._lead + first
        got = list(map(self._known.get, chunks))
        if None in got:
            missing = list({c for c, g in zip(chunks, got) if g is None})
            texts = [self._lead + c for c in missing]
            if self._lead and got[0] is None:
                texts[missing.index(chunks[0])] = first
            new = dict(zip(missing, self._encode_many(texts)))
            got = [new[c] if g is None else g for c, g in zip(chunks, got)]
            if len(self._known) < CACHE_CHUNKS:
                self._known.update((c, i) for c, i in new.items() if len(c) <= CACHE_CHARS)
        return b"".join(got)

    def encode_all(self, texts: Iterable[str], most: int) -> Iterator[bytes]:
        """``encode`` of each text, in order; the chunks that are new in many texts,
        of about ``most`` characters, are encoded in one call."""
        waiting, new, size = [], {}, 0
        for text in texts:
            waiting.append(text)
            if any(s in text for s in self._whole):
                continue
            for c in self._named(text):
                if c not in self._known and c not in new:
                    new[c] = b""
                    size += len(c)
            if size >= most:
                yield from self._ready(waiting, new)
                waiting, new, size = [], {}, 0
        yield from self._ready(waiting, new)

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """``encode`` of each text, in order; chunks are looked up once for many texts.

        Texts are taken together up to ``BATCH_CHARS`` characters, a longer one alone.
        """
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= BATCH_CHARS:
                size += len(texts[end])
                end += 1
            yield from self._together(texts[at:end])
            at = end

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        whole = [any(s in t for s in self._whole) for t in texts]
        parts = [[] if w else self._named(t) for t, w in zip(texts, whole)]
        named = pa.array(itertools.chain.from_iterable(parts), pa.large_string()).dictionary_encode()
        names = named.dictionary.to_pylist()
        ids = list(map(self._known.get, names))
        unknown = [i for i, known in enumerate(ids) if known is None]
        lead = self._lead
        for lo in range(0, len(unknown), NEW_CHUNKS):
            mine = unknown[lo:lo + NEW_CHUNKS]
            content = [(c[len(lead):] if c.startswith(lead) else lead + c) if lead else c for c in map(names.__getitem__, mine)]
            for i, got in zip(mine, self._encode_many(content)):
                ids[i] = got
                if len(names[i]) <= CACHE_CHARS and len(self._known) < CACHE_CHUNKS:
                    self._known[names[i]] = got
        # The ids of all texts in a row: each chunk's stretch of the names' ids.
        content = np.frombuffer(b"".join(ids), "<u4")
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place = named.indices.to_numpy()
        each, first = length[place], (np.cumsum(length) - length)[place]
        ends = np.concatenate([[0], np.cumsum(each)])
        out = content[np.repeat(first - ends[:-1], each) + np.arange(ends[-1])]
        chunk = 0
        for text, alone, part in zip(texts, whole, parts):
            lo, chunk = chunk, chunk + len(part)
            yield self.encode(text) if alone else out[ends[lo]:ends[chunk]].tobytes()

    def _named(self, text: str) -> list[str]:
        """A text's chunks under the names by which they are remembered."""
        chunks = self._cut(text)
        chunks[0] = self._lead + chunks[0]
        return chunks

    def _ready(self, waiting: list[str], new: dict[str, bytes]) -> Iterator[bytes]:
        lead = self._lead
        content = [(c[len(lead):] if c.startswith(lead) else lead + c) if lead else c for c in new]
        new.update(zip(new, self._encode_many(content)))
        known = self._known
        for text in waiting:
            if any(s in text for s in self._whole):
                yield self.encode(text)
            else:
                yield b"".join([known[c] if c in known else new[c] for c in self._named(text)])
        if len(known) < CACHE_CHUNKS:
            known.update((c, i) for c, i in new.items() if len(c) <= CACHE_CHARS)


def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def json_encoder(path: str) -> ChunkEncoder:
    """The tokenizers library's ids for a vocabulary file, without added special tokens.

    A worker keeps the encoder of the file it used last.
    """
    return held(f"encoder {path}", lambda: _json_encoder(path))


def _json_encoder(path: str) -> ChunkEncoder:
    """A vocabulary with a byte-level pattern is
    cut before words, one that drops white space at it; any other not at all.
    """
    import json

    library = _library(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    plain = spec["added_tokens"] and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    special = tuple(t["content"] for t in spec["added_tokens"])

    def encode_whole(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_many(texts: list[str]) -> list[bytes]:
        """Many texts without special strings in one call, with one between each:
        the library encodes what stands between them separately."""
        if len(texts) < 2:
            return encode_whole(texts)
        joined = library.encode_batch_fast([special[0].join(texts)], add_special_tokens=False)[0]
        ids = np.array(joined.ids, "<u4")
        ends = [*np.flatnonzero(ids == library.token_to_id(special[0])).tolist(), len(ids)]
        content = ids.tobytes()
        return [content[4 * a:4 * b] for a, b in zip([0, *(e + 1 for e in ends)], ends)]

    if plain and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer"):
        return ChunkEncoder(cut_before_words, encode_many, " ", special)
    if plain and drops_white_space(spec):
        return ChunkEncoder(cut_at_white_space, encode_many, "", special)
    return ChunkEncoder(lambda text: [text], encode_whole)


def drops_white_space(spec: dict) -> bool:
    """Whether a vocabulary file removes white space before it looks for words."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return first.get("type") == "Split" and first.get("invert") is True and first.get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in pattern


@functools.lru_cache(maxsize=8)
def file_digest(path: str) -> str:
    """Digest of a vocabulary file: its version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
