"""SentencePiece encoding and decoding by a streaming Viterbi.

Encoding finds the pieces of the model whose scores add up to the most. Only the
scores of the last ``longest`` positions are kept, ``longest`` being the length of
the longest piece, since no piece reaches further back. Whenever the back pointers
of all surviving positions meet on one boundary, the ids before it are final: they
are given out and forgotten. A text of any length so needs memory for its last open
stretch only. No piece of a model that splits by white space holds a space after
another character, so all paths meet before every run of spaces; and a character
that stands in no longer piece closes paths on both sides. Stretches between such
certain boundaries repeat, so their ids are remembered by each worker.

A character that is no piece costs the least score less ten and gives its UTF-8
bytes' pieces. Of equal scores the piece that starts first wins. A space before a
text that isn't empty is added, and taken off again by decoding. Texts that hold
U+2581 decode to a space there; all others come back as they were.

The scores of the file used here are minus the merge ranks of a byte-pair model, so
the ids maximise this sum and are not the merges' own output.

Cases: null and empty texts have no ids and decode to an empty text. Other columns
are ignored; rows come back as often as they stand, null doc_ids included.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrelens.llm.worker import remembered

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
LIMIT = 300_000


class Pieces(dict):
    """A model's pieces; as a dict, it maps a stretch of text to its ids as bytes."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = [b""] * n
        byte_ids = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = (i, sp.get_score(i))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.byte_ids = [byte_ids.get(b, sp.unk_id()) for b in range(256)]
        self.unknown = min(s for _, s in self.ids.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        self.starts = {p[:i] for p in self.ids for i in range(1, len(p) + 1)}
        self.before: dict[str, bytes] = {}
        joined = [p for p in self.ids if len(p) > 1]
        inner = {c for p in joined for c in p}
        breaks = "".join(re.escape(c) for c in "\n\t\r" if c not in inner)
        if any(SPACE in p.lstrip(SPACE) for p in joined):  # pieces across words: no certain boundary but breaks
            self.split = re.compile(f"[^{breaks}]+|[{breaks}]" if breaks else r"(?s).+").findall
        else:
            self.split = re.compile(f" +[^ {breaks}]*|[^ {breaks}]+|[{breaks}]" if breaks else " +[^ ]*|[^ ]+").findall
        # Marks that no piece holds right after a letter: a boundary stands there, too.
        after_letter = {y for p in joined for x, y in zip(p, p[1:]) if x.isalnum() and not x.isdecimal()}
        marks = "".join(re.escape(c) for c in sorted(inner) if not c.isalnum() and c != SPACE and c not in after_letter)
        self.cut = re.compile(rf"(?<=[^\W\d_])(?=[{marks}])").split if marks else lambda stretch: [stretch]

    def __missing__(self, stretch: str) -> bytes:
        ids = self.before.get(stretch)
        if ids is None:
            parts = self.cut(stretch)
            if len(parts) > 1:
                ids = b"".join(map(self.__getitem__, parts))
            else:
                ids = array("I", self.viterbi(stretch.replace(" ", SPACE))).tobytes()
        if len(stretch) <= 64:
            if len(self) >= LIMIT:
                self.before = dict(self)
                self.clear()
            self[stretch] = ids
        return ids

    def viterbi(self, text: str) -> Iterator[int]:
        """The ids of a stretch, given out as soon as they are final."""
        longest, ids, starts = self.longest, self.ids, self.starts
        n = len(text)
        best, back = {0: 0.0}, {0: 0}  # of open positions: score, and where the last piece starts
        done = 0
        for start in range(n):
            here = best[start]
            for end in range(start + 1, min(n, start + longest) + 1):
                part = text[start:end]
                if part not in starts:
                    break
                found = ids.get(part)
                if found is not None:
                    score = here + found[1]
                    if end not in best or score > best[end]:
                        best[end], back[end] = score, start
            if text[start] not in ids and (start + 1 not in best or here + self.unknown > best[start + 1]):
                best[start + 1], back[start + 1] = here + self.unknown, start
            if start - done >= 2 * longest and start % longest == 0:
                common = self._meet(back, done, [p for p in range(start + 1, start + longest + 1) if p in back])
                if common > done:
                    yield from self._path(text, back, done, common)
                    for p in range(done, common):
                        best.pop(p, None)
                        back.pop(p, None)
                    done = common
        yield from self._path(text, back, done, n)

    @staticmethod
    def _meet(back: dict[int, int], done: int, open_ends: list[int]) -> int:
        """The last boundary on the paths to all open ends."""
        heads = set(open_ends)
        while len(heads) > 1:
            last = max(heads)
            heads.discard(last)
            heads.add(back[last] if last > done else done)
        return heads.pop()

    def _path(self, text: str, back: dict[int, int], start: int, end: int) -> list[int]:
        cuts = [end]
        while cuts[-1] > start:
            cuts.append(back[cuts[-1]])
        out: list[int] = []
        for b, a in zip(reversed(cuts[:-1]), reversed(cuts[1:])):
            found = self.ids.get(text[a:b])
            out += [found[0]] if found else [self.byte_ids[x] for x in text[a:b].encode()]
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(" " + text))) if text else b""

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return text[1:].decode("utf-8", "replace") if text[:1] == b" " else text.decode("utf-8", "replace")


def pieces(path: str) -> Pieces:
    """The model of this worker process for a file."""
    return remembered(("pieces", path), lambda: Pieces(path))


def _mapped(df: DataFrame, column: str, out: str, kind: str, convert) -> DataFrame:
    id_type = df.schema["doc_id"].dataType.simpleString()
    arrow = pa.binary() if kind == "binary" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = pa.array([convert(x) for x in part.column(1).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([part.column(0), values], ["doc_id", out])

    return df.select("doc_id", column).mapInArrow(run, f"doc_id {id_type}, {out} {kind}")


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (binary, little-endian uint32) for every row."""
    return _mapped(docs, "text", "ids", "binary", lambda text: pieces(model).encode(text or ""))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text for every row of (doc_id, ids)."""
    return _mapped(encoded, "ids", "text", "string", lambda ids: pieces(model).decode(ids or b""))


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, text (decoded from the ids) for every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = pieces(model)
                ids = [own.encode(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids binary, text string")


def digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, text_sha256 (of the decoded text) for every row."""
    return encode_and_decode(docs, model).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )
