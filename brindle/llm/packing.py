"""Packing: documents into sequences of several lengths, without loss and almost without padding.

A document is cut into windows of the longest tier; what is left goes to the shortest tier
that holds it. Tiers are packed from the longest: each rest opens a window, and its gap is
filled from shorter tiers (whole rests first, then a cut one). Shortest rests fill windows
of their own tier. All of it happens in the task that tokenizes, batch by batch; a task's
last open windows are joined, cut, and end in sequences of powers of two, which need
no padding. Step groups hold sequences of one task that add up to the same number of tokens.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from brindle.llm.common import map_frames, ship, vocabulary_path

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Texts of other characters than these (Latin letters, usual punctuation) take the tokenizer's own way.
_USUAL = re.compile("[\\t\\n\\r\\x20-\\x7e\u00a1-\u024f\u2010-\u2015\u2018-\u201f\u2022\u2026\u20ac]*")
_SPECIAL = "<|"
#: Words and marks whose ids a worker remembers, and the longest of them.
_REMEMBERED, _WORD_CHARS = 1_000_000, 64

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    The vocabulary's tokenizer lower-cases, splits into words and marks by a pattern and
    encodes each alone, so a text's ids are those of its parts in turn; parts that came before
    are looked up, others go through the tokenizer's model. The pattern is read from the
    file; a file of another make is used as it is, without looking up.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.parts = None
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        splits = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["invert"] and not splits[1]["add_prefix_space"]:
            self.parts = regex.compile(splits[0]["pattern"]["Regex"]).findall
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}

    def _slow(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        word = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between two spaces; a part of it is a chunk of that one part."""
        known = self.known
        if chunk in known:
            return known[chunk]
        parts = self.parts(chunk)
        ids = self._part(chunk) if parts == [chunk] else b"".join([self._chunk(p) for p in parts])
        if len(chunk) <= _WORD_CHARS:
            known[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.parts is None or _SPECIAL in text or not _USUAL.fullmatch(text) or not unicodedata.is_normalized("NFC", text):
            return self._slow(text)
        known = self.known
        if len(known) > _REMEMBERED:
            known.clear()
        chunks = text.lower().split()
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            return b"".join(map(self._chunk, chunks))


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Packs pieces (document, start, length) into sequences; emits (sequence length, pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers are powers of two")
        self.top = self.tiers[-1]
        self.waiting: dict[int, deque] = {t: deque() for t in self.tiers}
        self.done: list[tuple[int, list[tuple]]] = []

    def add(self, doc, length: int) -> None:
        """Cut a document of ``length`` tokens and put its rest in line."""
        full = length - length % self.top
        for start in range(0, full, self.top):
            self.done.append((self.top, [(doc, start, self.top)]))
        if rest := length - full:
            self.waiting[next(t for t in self.tiers if t >= rest)].append((doc, full, rest))

    def _take(self, below: int, room: int) -> tuple | None:
        """A piece for a gap: a whole rest of the longest shorter tier that has one to fit, else a cut one."""
        shorter = [t for t in self.tiers if t < below and self.waiting[t]]
        for t in reversed(shorter):
            if self.waiting[t][0][2] <= room:
                return self.waiting[t].popleft()
        if not shorter:
            return None
        line = self.waiting[shorter[0]]
        doc, start, length = line.popleft()
        line.appendleft((doc, start + room, length - room))
        return doc, start, room

    def pack(self) -> None:
        """Pack what is in line, as far as full windows go; the rest stays in line."""
        for t in reversed(self.tiers[1:]):
            line = self.waiting[t]
            while line:
                window, room = [line[0]], t - line[0][2]
                while room and (piece := self._take(t, room)):
                    window.append(piece)
                    room -= piece[2]
                if room:  # nothing shorter is left: the pieces wait for the next batch
                    for doc, start, length in reversed(window[1:]):
                        self.waiting[next(x for x in self.tiers if x >= length)].appendleft((doc, start, length))
                    break
                line.popleft()
                self.done.append((t, window))
        t = self.tiers[0]
        line = self.waiting[t]
        held = sum(p[2] for p in line)
        while held >= t:
            self.done.append((t, self._fill(line, t)))
            held -= t

    @staticmethod
    def _fill(line: deque, size: int) -> list[tuple]:
        window, room = [], size
        while room:
            doc, start, length = line.popleft()
            part = min(length, room)
            window.append((doc, start, part))
            room -= part
            if part < length:
                line.appendleft((doc, start + part, length - part))
        return window

    def bound(self, most: int) -> None:
        """If over ``most`` pieces wait, join them to full windows of the longest tier."""
        if sum(map(len, self.waiting.values())) > most:
            self._join()

    def _join(self) -> tuple[deque, int]:
        line = deque(p for t in reversed(self.tiers) for p in self.waiting[t])
        for x in self.waiting.values():
            x.clear()
        held = sum(p[2] for p in line)
        while held >= self.top:
            self.done.append((self.top, self._fill(line, self.top)))
            held -= self.top
        for doc, start, length in line:
            self.waiting[next(t for t in self.tiers if t >= length)].append((doc, start, length))
        return line, held

    def close(self) -> None:
        """The last pieces: full windows, then sequences of powers of two."""
        line, held = self._join()
        for x in self.waiting.values():
            x.clear()
        size = self.top
        while held:
            size >>= 1
            if held >= size:
                self.done.append((size, self._fill(line, size)))
                held -= size


SCHEMA = "doc_id {id}, start long, length long, doc_tokens long, sequence_id long, `offset` long, tier int, step_group long, token_ids binary"


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_column: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 16, batch: int = 256, most_waiting: int = 20_000) -> DataFrame:
    """A row per piece: where it is in its document and in its sequence, and its ids.

    ``token_ids`` are unsigned 32-bit integers, little-endian. Every document ends in END_ID;
    a null text is an empty one and has that id alone. ``tier`` is its sequence's length, so
    nothing is padded. ``step_group`` numbers groups of sequences of one task with
    ``step_tokens`` tokens each (a task's last one has what is left). Rows with equal ids are
    documents of their own. A document's pieces stay in the task that read it, so sequences
    and groups depend on how the input is partitioned; a task that runs again gives the same.
    ``most_waiting`` bounds a task's memory: where more rests than that wait for gaps (a run of
    documents that are all of one length, say), they are cut and joined to windows of the longest
    tier at once. No token is lost or repeated by that; only the choice of windows changes.
    Very long texts are held whole by their task; columns beside id and text aren't looked at.
    """
    ship(docs.sparkSession)
    where = vocabulary_path(vocabulary) if "/" not in vocabulary else vocabulary
    end = array("I", [END_ID]).tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at, sequence, spent = TaskContext.get().partitionId() << 40, 0, 0
        encode, packer = encoder(where).encode, Packer(tiers)
        texts: dict[int, tuple] = {}  # row number -> id, token ids, tokens that aren't packed yet
        rows = 0

        def emit() -> pd.DataFrame:
            nonlocal sequence, spent
            out = []
            # Longest first within what is ready: groups fill evenly.
            for size, window in sorted(packer.done, key=lambda x: -x[0]):
                offset = 0
                for row, start, length in window:
                    doc, ids, left = texts[row]
                    out.append((doc, start, length, len(ids) // 4, at + sequence, offset, size, at + spent // step_tokens, ids[4 * start : 4 * (start + length)]))
                    offset += length
                    if left == length:
                        del texts[row]
                    else:
                        texts[row] = (doc, ids, left - length)
                sequence += 1
                spent += size
            packer.done.clear()
            # Ids stay what they are, with or without nulls among them.
            return pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "token_ids"]).assign(doc_id=pd.Series([x[0] for x in out], dtype=object))

        for frame in frames:
            frame.columns = ["id", "text"]
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                for doc, content in zip(part["id"], part["text"], strict=True):
                    ids = encode(content or "") + end
                    texts[rows] = (None if pd.isna(doc) else doc, ids, len(ids) // 4)
                    packer.add(rows, len(ids) // 4)
                    rows += 1
                packer.pack()
                packer.bound(most_waiting)
                if packer.done:
                    yield emit()
        packer.close()
        if packer.done:
            yield emit()

    kind = docs.schema[id_column].dataType.simpleString()
    return map_frames(docs.select(id_column, text), run, SCHEMA.format(id=kind))
