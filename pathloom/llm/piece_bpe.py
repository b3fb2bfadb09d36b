"""Exact merge-type (BPE) encoding of SentencePiece models by backtracking, and decoding.

A sequence of pieces is the merge result exactly when every two neighbours, put together and
merged again, split back into the same two.  So a text is covered from the left with longest
vocabulary matches (Aho-Corasick); where a piece isn't compatible with its left neighbour the
next shorter prefix is tried, and where none is left the previous piece is shortened.  A
bitfield of positions from which a try has failed keeps the work linear.

No piece holds the space mark after another character, so a text is cut before each run of
space marks, and between characters that no piece holds side by side; equal cuts are encoded
once a task.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import mapped

MARK = "▁"
#: Distinct cuts kept by a task before its memory is cleared, the longest that is kept, and pairs of pieces kept.
KEPT_CUTS, KEPT_CHARS, KEPT_PAIRS = 300_000, 64, 1 << 17


class PieceBPE:
    def __init__(self, model_file: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: lib.get_score(i) for i in plain}
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in range(size) if lib.is_byte(i)}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.hidden = {i for i in range(size) if lib.is_control(i)}
        self.cut = self._cutter()
        if any(MARK in p.lstrip(MARK) for p in self.ids) or len(self.byte_ids) != 256:
            raise ValueError("pieces with inner spaces, or without byte fallback, aren't supported")
        if any(lib.normalize(t) != w for t, w in (("  á Ａ ", MARK * 3 + "á" + MARK + "Ａ" + MARK),)):
            raise ValueError("only the identity normaliser with a dummy prefix is supported")
        # pieces that merging never leaves whole can't be results
        self.whole = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.whole:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.compatible = lru_cache(KEPT_PAIRS)(self._compatible)
        self.shorter = lru_cache(1 << 16)(self._shorter)
        self.cuts: dict[str, bytes] = {}
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        for i in self.hidden:
            self.shown[i] = ""
        parts = [bytes([self.bytes[i]]) if i in self.bytes else s.encode() for i, s in enumerate(self.shown)]
        self.widths = np.array([len(x) for x in parts], dtype=np.int64)
        self.starts = np.cumsum(self.widths) - self.widths
        self.flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.special = np.array([i in self.hidden or i == self.unk for i in range(size)])

    def _cutter(self) -> re.Pattern:
        """Cuts before space marks, and between words and other characters.

        Two characters that stand side by side in no piece always part two pieces.  "Word"
        characters are the letters and whatever some piece puts next to one of them.
        """
        beside = {(a, b) for p in self.ids for a, b in zip(p, p[1:]) if a != MARK}
        word = {c for p in self.ids for c in p if c.isalpha()}
        while more := {c for a, b in beside if (a in word) != (b in word) for c in (a, b)} - word:
            word |= more
        inside = "".join(map(re.escape, sorted(word)))
        return re.compile(f"{MARK}*(?:[{inside}]+|[^{inside}{MARK}]+)|{MARK}+")

    def merged(self, text: str) -> list[str]:
        """Merging by definition: the best-scored, leftmost neighbours join first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [left, right]

    def _shorter(self, piece: str) -> str | None:
        """The longest shorter piece that begins like ``piece``; a single character always stands."""
        for n in range(len(piece) - 1, 0, -1):
            if n == 1 or piece[:n] in self.whole:
                return piece[:n]
        return None

    def split(self, text: str) -> list[str]:
        """The merge result of ``text`` by backtracking."""
        n = len(text)
        longest = [1] * n
        for end, size in self.automaton.iter(text):
            start = end - size + 1
            if size > longest[start]:
                longest[start] = size
        failed, compatible = bytearray(n // 8 + 1), self.compatible
        out: list[str] = []
        at, piece = 0, text[: longest[0]] if n else None
        while at < n:
            left = out[-1] if out else None
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (left is None or compatible(left, piece)):
                    break
                piece = self.shorter(piece)
            if piece is not None:
                out.append(piece)
                at = end
                piece = text[at : at + longest[at]] if at < n else None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                piece = self.shorter(last)
        return out

    def _cut_ids(self, cut: str) -> bytes:
        ids: list[int] = []
        for piece in self.split(cut):
            i = self.ids.get(piece)
            ids.extend([i] if i is not None else map(self.byte_ids.__getitem__, piece.encode()))
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(cut) <= KEPT_CHARS:
            if len(self.cuts) >= KEPT_CUTS:
                self.cuts.clear()
            self.cuts[cut] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        edge = [np.array([i], dtype="<u4").tobytes() for i in (self.bos, self.eos)]
        if not text:
            return b"".join(edge)
        known, make = self.cuts.get, self._cut_ids
        cuts = self.cut.findall((MARK + text).replace(" ", MARK))
        return edge[0] + b"".join([known(c) or make(c) for c in cuts]) + edge[1]

    def forget(self) -> None:
        """Clears what is kept of texts; the model stays."""
        self.cuts.clear()
        self.compatible.cache_clear()
        self.shorter.cache_clear()

    def decode(self, ids: bytes) -> str:
        """The text of ids, as the library gives it: runs of byte pieces as UTF-8, one leading space of the prefix dropped."""
        values = np.frombuffer(ids, dtype="<u4").tolist()
        out: list[str] = []
        run = bytearray()
        first = True
        for i in values:
            if i in self.bytes:
                run.append(self.bytes[i])
                first = False
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i in self.hidden:
                continue
            piece = " ⁇ " if i == self.unk else self.shown[i]
            if first and piece:
                piece = piece[1:] if piece[0] == " " else piece
                first = False
            out.append(piece)
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def decoded_bytes(self, ids: bytes) -> bytes:
        """UTF-8 of ``decode(ids)``: the pieces' bytes are gathered at once where they are valid and end marks are at the ends."""
        values = np.frombuffer(ids, dtype="<u4")[1:-1].astype(np.int64)
        if not len(values):
            return b""
        sizes = self.widths[values]
        ends = np.cumsum(sizes)
        out = self.flat[np.repeat(self.starts[values] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()
        if self.special[values].any() or (values[0] in self.bytes and out[:1] == b" "):
            return self.decode(ids).encode()
        try:
            out.decode()
        except UnicodeDecodeError:
            return self.decode(ids).encode()
        return out[1:] if out[:1] == b" " else out


def _utf8(run: bytes) -> str:
    """Each byte that begins no valid sequence becomes one replacement character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@cache
def encoder(model_file: str) -> PieceBPE:
    """One encoder a worker process."""
    return PieceBPE(model_file)


def encoded(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Each row's ids (binary, little-endian u32) and the text decoded from them, with their digests.

    Output: the ``keep`` columns (default: the id), ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` and on demand ``ids`` and ``decoded``.  A null text is encoded as an
    empty one; repeated rows give repeated results; very long texts are encoded whole, in
    linear time; an empty table gives an empty result.  Rows stay in their partition: no shuffle.
    """
    keep = [id_col] if keep is None else keep
    table = docs.select(*keep, docs[text_col].alias("__text"))
    extra = ", ids binary" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model_file)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start in range(0, batch.num_rows, 256):  # a slice's results are in memory, not a batch's
                part = texts.slice(start, 256).to_pylist()
                ids = [bpe.encode(t or "") for t in part]
                decoded = [bpe.decoded_bytes(i) for i in ids]
                columns = [c.slice(start, 256) for c in batch.columns[:-1]]
                columns += [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(d).hexdigest() for d in decoded])]
                columns += [pa.array(ids, pa.binary())] * with_ids + [pa.array([d.decode() for d in decoded] if with_text else [], pa.string())] * with_text
                names = [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        bpe.forget()  # the worker lives on beside other stages' work

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields[:-1])
    return mapped(table, run, f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
