"""Encoding with public tokenizer files; the ids of short pieces are kept, up to a bound of bytes."""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A single space between two characters that aren't white space: byte-level pre-tokenizers always start a new
#: token at such a space and special strings hold no space, so the pieces on both sides encode on their own.
_SPACE = re.compile(r" (?=\S)(?<=\S )")
#: Likewise a single line end between two such characters is a token of its own.
_LINE = re.compile(r"\n(?=\S)(?<=\S\n)")
#: Pieces of up to so many characters are kept, up to about so many bytes in each of two generations; longer ones are encoded each time.
KEPT_CHARS, KEPT_BYTES = 64, 96 << 20
#: Texts are encoded in batches of up to so many, and of one or about so many bytes.
BATCH_TEXTS, BATCH_BYTES = 512, 4 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def in_batches(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of rows with a text, as many as are encoded at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    s = 0
    while s < whole.num_rows:
        full = int(np.searchsorted(ends, (ends[s - 1] if s else 0) + BATCH_BYTES, side="right"))
        e = min(s + BATCH_TEXTS, max(s + 1, full))
        yield whole.slice(s, e - s)
        s = e


def _pieces(line: str) -> list[str]:
    """The line cut at single spaces between characters that aren't white space."""
    at_spaces = line.split(" ")
    return at_spaces if at_spaces == line.split() else _SPACE.split(line)


class Encoder:
    """ids(text) of a tokenizer file; .json through tokenizers, .model through sentencepiece."""

    def __init__(self, path: str):
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.kept = self.kept_heads = 0
        self.by_piece = False
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: sp.encode(texts, num_threads=1)
        else:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            import json

            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self.encode = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                j = json.load(f)
            self.after_space = np.zeros(t.get_vocab_size(), bool)
            self.after_space[[i for token, i in t.get_vocab().items() if token.startswith("\u0120")]] = True
            pre = j.get("pre_tokenizer") or {}
            self.by_piece = (
                pre.get("type") == "ByteLevel"
                and pre.get("use_regex", True)
                and not pre.get("add_prefix_space")
                and not j.get("normalizer")
                and not (j.get("model") or {}).get("dropout")
                and not any(re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] or a.get("single_word") for a in j.get("added_tokens", []))
            )

    def _after_spaces(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces that follow a space, many in one text: a piece without a space inside starts at each id
        whose token begins with the byte of a space."""
        plain, out = [p for p in new if " " not in p], {}
        if plain:
            ids = np.array(self.encode([" " + " ".join(plain)])[0], "<u4")
            cut = (np.flatnonzero(self.after_space[ids]) * 4).tolist()
            if len(cut) == len(plain):
                raw = ids.tobytes()
                out = dict(zip(plain, map(raw.__getitem__, map(slice, cut, [*cut[1:], len(raw)])), strict=True))
        if rest := [p for p in new if p not in out]:
            out.update(zip(rest, (np.array(i, "<u4").tobytes() for i in self.encode([" " + p for p in rest])), strict=True))
        return out

    @staticmethod
    def _keep(known: dict[str, bytes], new: dict[str, bytes]) -> int:
        """Store what is short in known; about the bytes that this takes."""
        short = {p: ids for p, ids in new.items() if len(p) <= KEPT_CHARS}
        known.update(short)
        return 4 * sum(map(len, short)) + sum(map(len, short.values())) + 200 * len(short)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_piece:
            return [np.array(i, "<u4").tobytes() for i in self.encode(texts)]
        # many lists of pieces and no cycles: the collector would go through them again and again
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._packed(texts)
        finally:
            if collects:
                gc.enable()

    def _packed(self, texts: list[str]) -> list[bytes]:
        cut = [[_pieces(line) for line in _LINE.split(t)] for t in texts]
        if self.kept > KEPT_BYTES:
            self.old, self.pieces, self.kept = self.pieces, {}, 0
        known, old = self.pieces, self.old
        starts = [[c.pop(0) for c in lines] for lines in cut]  # the first piece of a line has no space before it
        words: set[str] = set()
        for lines in cut:
            words.update(*lines)
        missing = words.difference(known)
        now = {p: old[p] for p in missing if p in old}
        if new := [p for p in missing if p not in now]:
            now.update(self._after_spaces(new))
        self.kept += self._keep(known, now)
        passing = {p: ids for p, ids in now.items() if len(p) > KEPT_CHARS}
        known.update(passing)
        if self.kept_heads > KEPT_BYTES:
            self.heads, self.kept_heads = {}, 0
        first = {h for line_starts in starts for h in line_starts} | {"\n"}
        heads = {h: self.heads[h] for h in first if h in self.heads}
        if new := [h for h in first if h not in heads]:
            fresh = dict(zip(new, (np.array(i, "<u4").tobytes() for i in self.encode(new)), strict=True))
            self.kept_heads += self._keep(self.heads, fresh)
            heads.update(fresh)
        line_end, ids_of = heads["\n"], known.__getitem__
        out = [line_end.join([heads[h] + b"".join(map(ids_of, c)) for h, c in zip(line_starts, lines, strict=True)]) for line_starts, lines in zip(starts, cut, strict=True)]
        for p in passing:
            del known[p]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
