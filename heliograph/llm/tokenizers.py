"""Exact token ids from tokenizer files, with repeated chunks of text encoded once per worker.

Both known pre-tokenizers split text at places that a blank decides, so the ids of a text
are the concatenated ids of its blank-separated chunks. Chunks are found and de-duplicated
by Arrow kernels; only chunks that a worker has not met are encoded by the library. Texts
with characters outside a plain Latin repertoire, with special-token strings, or (for the
byte-level form) with runs of blanks go to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters outside the plain repertoire, for which the library gets the whole text.
UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e¡-ÿĀ-įı-ſ–—‘’“”…€]")

#: Chunks that one worker remembers before it starts over.
CACHE_ENTRIES = 600_000


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine; a path is returned as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Token ids of whole texts for one ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        pre, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        special = [t for t in spec.get("added_tokens", []) if t["special"] and t["content"].startswith("<|") and not t["normalized"]]
        self.kind = "other"
        if special and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normalizer:
            self.kind = "byte"
        elif special and pre.get("type") == "Sequence" and spec["model"].get("end_of_word_suffix") == "</w>" and normalizer:
            self.kind = "word"
        if self.kind != "other":  # chunks come normalised, with a border between them that no pattern joins to its neighbours
            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))
            self.border = "\n" if self.kind == "byte" else " ¤ "
            self.border_ids = self._ids(self.border.strip(" "))
            self.border_id = self.border_ids[0]
        self.chunks: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _odd(self, text: str) -> bool:
        return self.kind == "other" or UNUSUAL.search(text) is not None or "<|" in text or (self.kind == "byte" and "  " in text)

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.bare.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, chunks: list[str]) -> None:
        if self.kind == "byte":
            apart = [c for c in chunks if len(c) < 2 or not c.startswith(" ") or any(x in c[1:] for x in " \t\n\r")]
        else:
            apart = [c for c in chunks if "¤" in c or not c]
        self.chunks.update((c, self._ids(c).tobytes()) for c in apart)
        alone = set(apart)
        rest, width = [c for c in chunks if c not in alone], len(self.border_ids)
        for at in range(0, len(rest), 2000):
            part = rest[at : at + 2000]
            ids = self._ids(self.border.join(part))
            cuts = np.flatnonzero(ids == self.border_id).tolist() + [len(ids)]
            if len(cuts) != len(part):
                self.chunks.update((c, self._ids(c).tobytes()) for c in part)
                continue
            raw, start = ids.tobytes(), 0
            for chunk, cut in zip(part, cuts):
                self.chunks[chunk] = raw[4 * start : 4 * cut]
                start = cut + width

    def _of_chunks(self, chunks: list[str]) -> list[bytes]:
        got = self.chunks
        if missing := [c for c in chunks if c not in got]:
            if len(got) > CACHE_ENTRIES:
                self.chunks = got = {c: got[c] for c in chunks if c in got}
            self._learn(missing)
        return [got[c] for c in chunks]

    def encode_column(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of each text); a null is an empty text."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        texts = column.to_pylist()
        odd = [i for i, t in enumerate(texts) if self._odd(t)]
        if odd:
            mask = np.ones(len(texts), dtype=bool)
            mask[odd] = False
            column = pc.if_else(pa.array(mask), column, pa.scalar("", pa.large_string()))
        ids, offsets = self._plain(column)
        if not odd:
            return ids, offsets
        own = {i: self.whole(texts[i]) for i in odd}
        parts = [own[i] if i in own else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(column)
        split = pc.ascii_split_whitespace(pc.utf8_lower(column)) if self.kind == "word" else pc.split_pattern(column, pattern=" ")
        bounds = np.asarray(split.offsets.to_numpy(), dtype=np.int64)
        bounds = bounds - bounds[0] if n else np.zeros(1, dtype=np.int64)
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        unique = coded.dictionary.to_pylist()
        if self.kind == "byte":  # a chunk after a blank begins with it; a text's first does not
            first = bounds[:-1][bounds[1:] > bounds[:-1]]
            heads = [unique[i] for i in index[first].tolist()]
            index = index.copy()
            index[first] = np.arange(len(first)) + len(unique)
            unique = [" " + c for c in unique] + heads
        got = self._of_chunks(unique)
        pool = np.frombuffer(b"".join(got), dtype="<u4")
        lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4
        starts = np.cumsum(lengths) - lengths
        each = lengths[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(starts[index] - ends[:-1], each) + np.arange(ends[-1])]
        return ids, ends[bounds]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(name: str) -> ChunkEncoder:
    """This worker's encoder of a vocabulary file, kept between tasks."""
    path = tokenizer_path(name)
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
