"""SentencePiece encoding and decoding with merge-type (BPE) vocabularies.

``encode_decode`` segments texts by a score-ordered agenda of adjacent symbol pairs: of all
adjacent pairs whose concatenation is a piece, the one with the best score (then the leftmost) is
merged, until none is left.  No piece of a supported vocabulary holds a word mark after another
character, so a text falls into chunks (a run of word marks and what follows up to the next) that
are segmented apart; short chunks of an Arrow batch are worked on in lock step, one agenda a row,
long ones with a heap.  The ids of each chunk are compared with the sentencepiece library's when it is
first met in a task.  The two differ for no text of a model that ``PieceCodec`` accepts; should they, the job ends
with an error, as ids of a doubtful segmentation are of no use.

Defined results: null text counts as empty; an empty text has only the begin and end ids; repeated
rows give repeated rows; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
SCHEMA = "doc_id long, ids binary, decoded string"
#: Chunks of up to so many characters are merged in lock step.
SHORT = 48
#: Segmented chunks that a task remembers.
REMEMBERED = 500_000
_FAR = np.int64(1) << 32
_NONE = np.int64(1) << 62


class PieceCodec:
    """The vocabulary of one model file as symbol numbers, pair ranks and byte strings."""

    def __init__(self, model_path: str, check: bool = True) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(model_path, "rb") as f:
            raw = f.read()
        model = proto.ModelProto()
        model.ParseFromString(raw)
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or norm.precompiled_charsmap or not norm.escape_whitespaces:
            raise ValueError("a BPE model with a dummy prefix, identity normalisation and kept white space is needed")
        if any(MARK in p.piece.lstrip(MARK) for p in model.pieces):
            raise ValueError("a piece holds a word mark after another character")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw) if check else None
        self.check = check
        self.bos, self.eos = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.unk = model.trainer_spec.unk_id
        ids, self.bytes_of, scores = {}, [], []
        self.byte_id = {}
        for i, p in enumerate(model.pieces):
            if p.type == 1:
                ids[p.piece] = i
                self.bytes_of.append(p.piece.replace(MARK, " ").encode())
            elif p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == 2:
                self.bytes_of.append(model.trainer_spec.unk_surface.encode())
            elif p.type == 3:
                self.bytes_of.append(b"")
            else:
                raise ValueError("user-defined and unused pieces are not supported")
            scores.append(p.score)
        self.n = len(scores)
        if len(self.byte_id) != 256:
            raise ValueError("a vocabulary with byte fallback is needed")
        self.char_id = {c: i for c, i in ids.items() if len(c) == 1}
        for p in ids:
            for c in p:
                self.char_id.setdefault(c, self.n + ord(c))  # a character that is no piece by itself
        order = {s: k for k, s in enumerate(sorted({*scores}, reverse=True))}
        self.merge = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                a, b = ids.get(a, self.char_id.get(a)), ids.get(b, self.char_id.get(b))
                if a is not None and b is not None:
                    self.merge[a, b] = (order[scores[i]], i)
        keys = np.array([a * _FAR + b for a, b in self.merge], np.int64)
        sort = np.argsort(keys)
        self.keys = keys[sort]
        self.offer = np.array([r * _FAR + i for r, i in self.merge.values()], np.int64)[sort]
        self.by_code = np.arange(0x110000, dtype=np.int64) + self.n
        self.by_code[:128] = [self.byte_id[i] for i in range(128)]  # no piece begins or ends with a byte's symbol
        for c, i in self.char_id.items():
            self.by_code[ord(c)] = i
        self.seen: dict[str, bytes] = {}

    def _spell(self, symbols: list[int]) -> bytes:
        out = []
        for s in symbols:
            if s < self.n:
                out.append(s)
            else:
                out += [self.byte_id[b] for b in chr(s - self.n).encode()]
        return np.array(out, "<u4").tobytes()

    def agenda(self, chunk: str) -> list[int]:
        """Symbols of one chunk, by a heap of adjacent pairs."""
        sym = self.by_code[list(map(ord, chunk))].tolist()
        left, right = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (m := self.merge.get((sym[i], sym[j]))):
                heapq.heappush(heap, (m[0], i, sym[i], sym[j], m[1]))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, into = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j] = into, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s in sym if s >= 0]

    def _offers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair and the piece it becomes in one number; _NONE where no piece fits."""
        key = a * _FAR + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.offer[at], _NONE)

    def lock_step(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks of similar length: one row each, the best pair of every row merged at a time."""
        width = max(map(len, chunks))
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(c.ljust(width, "\0") for c in chunks).encode("utf-32-le"), "<u4").reshape(len(chunks), width)
        sym = self.by_code[codes]
        sym[np.arange(width) >= sizes[:, None]] = -1
        done = np.full((len(chunks), width), -1, np.int64)
        row = np.arange(len(chunks))
        rank = np.full((len(chunks), width), _NONE)
        if width > 1:
            rank[:, :-1] = self._offers(sym[:, :-1], sym[:, 1:])
        cols = np.arange(width)
        while len(row):
            best = rank.argmin(1)
            r = np.arange(len(row))
            offer = rank[r, best]
            live = offer < _NONE
            if not live.all():
                done[row[~live]] = sym[~live]
                sym, rank, row, best, offer = sym[live], rank[live], row[live], best[live], offer[live]
                r = np.arange(len(row))
                if not len(row):
                    break
            take = np.minimum(cols + (cols > best[:, None]), width - 1) + (r * width)[:, None]
            sym, rank = sym.ravel()[take], rank.ravel()[take]
            sym[:, -1] = -1
            rank[:, -1] = _NONE
            into = offer % _FAR
            sym[r, best] = into
            p = np.flatnonzero(best > 0)
            q = best[p] - 1
            found = self._offers(np.concatenate((into, sym[p, q])), np.concatenate((sym[r, np.minimum(best + 1, width - 1)], into[p])))
            rank[r, best] = np.where(best + 1 < width, found[: len(r)], _NONE)
            rank[p, q] = found[len(r) :]
        filled = done >= 0
        flat, ends = done[filled].astype("<u4").tobytes(), np.cumsum(filled.sum(1)) * 4
        out = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for i in np.flatnonzero((done >= self.n).any(1)).tolist():
            out[i] = self._spell(done[i][filled[i]].tolist())
        return out

    def learn(self, chunks: list[str]) -> None:
        """Segment chunks (without their first word mark, later marks as spaces) and check them."""
        if len(self.seen) + len(chunks) > REMEMBERED:
            self.seen.clear()
        spelt = sorted(((MARK + c.replace(" ", MARK), c) for c in chunks), key=lambda x: len(x[0]))
        at = 0
        while at < len(spelt):
            n = len(spelt[at][0])
            if n > SHORT:
                for chunk, key in spelt[at:]:
                    self.seen[key] = self._spell(self.agenda(chunk))
                break
            end = at
            while end < len(spelt) and end - at < 20_000 and len(spelt[end][0]) <= n + 2:
                end += 1
            for (_, key), ids in zip(spelt[at:end], self.lock_step([c for c, _ in spelt[at:end]])):
                self.seen[key] = ids
            at = end
        chunks = [c for c in chunks if c]  # the library adds no mark to an empty text
        if self.check and chunks:
            theirs = self.library.encode(chunks, num_threads=1)
            if np.fromiter(chain.from_iterable(theirs), "<u4").tobytes() != b"".join(map(self.seen.__getitem__, chunks)) or any(4 * len(ids) != len(self.seen[key]) for key, ids in zip(chunks, theirs)):
                raise ValueError("the library segments a chunk differently")

    def chunks(self, text: str) -> list[str]:
        if MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        return [c[1:].replace(MARK, " ") for c in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, with begin and end ids."""
        split = [self.chunks(t) if t else [] for t in texts]
        begin, end = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes()
        out, at = [], 0
        while at < len(split):  # no more chunks at a time than are remembered
            stop, n = at, 0
            while stop < len(split) and (stop == at or n + len(split[stop]) <= REMEMBERED // 2):
                n += len(split[stop])
                stop += 1
            new = {c for s in split[at:stop] for c in s if c not in self.seen}
            if len(self.seen) + len(new) > REMEMBERED:
                self.seen.clear()
                new = {c for s in split[at:stop] for c in s}
            if new:
                self.learn(list(new))
            get = self.seen.__getitem__
            out += [b"".join((begin, *map(get, s), end)) for s in split[at:stop]]
            at = stop
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: without its first space; a byte that is no part of a character gives U+FFFD."""
        piece = self.bytes_of
        raw = b"".join([piece[i] for i in np.frombuffer(ids, "<u4").tolist()])
        raw = raw[1:] if raw[:1] == b" " else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_broken(raw)

    @staticmethod
    def _decode_broken(raw: bytes) -> str:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def encode_decode(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit ids with begin and end) and ``decoded``.

    Of ``docs`` doc_id and text are taken, other columns are left out.  The model file is read on the executors
    from ``model_path``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model_path, check)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = codec.encode(texts)
                decoded = [codec.decode(i) for i in ids]
                if check and decoded != [t.replace(MARK, " ") for t in texts]:
                    # such a text holds what the library itself decodes to something else
                    decoded = [d if d == t.replace(MARK, " ") else codec.library.decode(np.frombuffer(i, "<u4").tolist()) for d, t, i in zip(decoded, texts, ids)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``encode_decode`` returns."""
    return encoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
