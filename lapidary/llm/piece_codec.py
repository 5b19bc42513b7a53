"""SentencePiece encoding and decoding: the library's own ids of a merge-type (BPE) model, found by backtracking.

A sequence of pieces is what the merges give just when each piece merges back to itself and each two neighbours, merged again from their
characters, come apart at the same place. So a text is read from left to right: the longest piece that starts at a place (an Aho-Corasick
automaton reports every piece of the text) is taken if it is compatible with the piece before it; if not, the next shorter one; if none is,
the place is marked as failed in a bitfield and the piece before it is shortened. No place is tried twice, so the work is linear in the text.

Texts fall into segments, a run of space marks with the characters after it, wherever no piece of the vocabulary spans the cut; characters
without a piece are segments of their own and become bytes. Both are exact, as no merge crosses such a cut. Segments' ids are kept in a
table of bounded size for each worker, which is emptied when full.

Models: merge type, identity normalisation, byte fallback, space marks in front (what the given vocabulary has); others raise ValueError, as
do models in which different pieces share a score (but for runs of one character, where the longest from the left wins).

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows and ids are encoded one by one; an empty
table gives an empty result; other columns are not read. A space mark (U+2581) in a text is decoded as a space, as the library does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, slices

MODEL, MARK, KEPT_SEGMENTS, KEPT_PAIRS, SLICE_BYTES = "piece_bpe_32k.model", "▁", 200_000, 300_000, 1 << 20
NORMAL, BYTE, USER_DEFINED, UNUSED = 1, 6, 4, 5  # kinds of pieces in a model file
NEVER = float("-inf")


class Merges:
    """The vocabulary as merges: any two neighbours whose joint text is a piece may merge, best score first, leftmost first among equals."""

    def __init__(self, scores: dict[str, float]) -> None:
        import ahocorasick

        self.scores = scores
        by_score: dict[float, str] = {}
        for p, s in scores.items():
            if by_score.setdefault(s, p) != p and len({*by_score[s], *p}) > 1:
                raise ValueError(f"pieces {by_score[s]!r} and {p!r} share a score")
        #: of each piece that comes out of its merges: every merge's score, and what then stands at its left and right edge
        self.steps: dict[str, list[tuple[float, str, str]]] = {}
        for p in scores:
            steps = self.merged(p)
            if len(p) == 1 or len(steps) > 1 and steps[-2][1] == p:
                self.steps[p] = steps
        self.automaton = ahocorasick.Automaton()
        for p in self.steps:
            if len(p) > 1:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: the next shorter piece that begins a piece; characters have none
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.steps), None) for p in self.steps}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[tuple[float, str, str]]:
        """The merges of a text of a piece's length, in order: score, first part, last part. A last entry that no merge can follow."""
        parts, steps = list(text), []
        while True:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1], NEVER)
                if s > best:
                    best, at = s, i
            if at < 0:
                return [*steps, (NEVER, "", "")]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))

    def compatible(self, first: str, second: str) -> bool:
        """Whether no merge crosses the cut between two pieces when both are merged again from their characters: each time the best of the
        next merge within either and the merge of the parts at the cut is made, the leftmost of equals."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        left, right, scores = iter(self.steps[first]), iter(self.steps[second]), self.scores
        (a, _, next_x), (b, next_y, _) = next(left), next(right)
        x, y = first[-1], second[0]
        while True:
            cross = scores.get(x + y, NEVER)
            if cross > a and cross >= b:
                fits = False
                break
            if a == b == NEVER:
                fits = True
                break
            if a >= b:
                x = next_x
                a, _, next_x = next(left)
            else:
                y = next_y
                b, next_y, _ = next(right)
        self.pairs[first, second] = fits
        return fits

    def encode(self, text: str) -> list[str]:
        """The pieces of a text of characters that all have pieces."""
        longest = list(text)
        for end, piece in self.automaton.iter(text) if len(self.automaton) else ():  # by ascending end: the longest of each start is the last
            longest[end + 1 - len(piece)] = piece
        out: list[str] = []
        at, stop, failed = 0, len(text), None
        piece, before, pairs = longest[0], None, self.pairs
        while True:
            end = at + len(piece)
            if failed and failed[end >> 3] >> (end & 7) & 1:
                fits = False
            elif before is None:
                fits = True
            else:
                fits = pairs.get((before, piece))
                if fits is None:
                    fits = self.compatible(before, piece)
            if fits:
                out.append(piece)
                if end == stop:
                    return out
                at, before, piece = end, piece, longest[end]
                continue
            piece = self.shorter[piece]
            while piece is None:  # no way leads on from here; one way alone leads here, so its last piece is shortened
                if failed is None:
                    failed = bytearray(stop // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                piece, before = self.shorter[last], out[-1] if out else None


class Codec(dict):
    """Ids of segments, found when first asked for; encode() and decode() of whole texts."""

    def __init__(self, path: str, most: int = KEPT_SEGMENTS) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        super().__init__()
        self.most, self.library = most, sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        rule, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        known = model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix
        known = known and rule.name == "identity" and rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces
        if not known or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("a merge-type model with identity normalisation, byte fallback and no own symbols is needed")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.merges = Merges({p.piece: p.score for p in model.pieces if p.type == NORMAL})
        chars = re.escape("".join(sorted({c for p in self.ids for c in p if c in self.ids} - {MARK})))
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece has a character that is no piece")
        if any(MARK in p.lstrip(MARK) for p in self.ids):  # pieces span words: cut at characters without a piece only
            self.segment = re.compile(f"[{MARK}{chars}]+|[^{MARK}{chars}]+")
        else:
            self.segment = re.compile(f"{MARK}+[{chars}]*|[{chars}]+|[^{MARK}{chars}]+")

    def __missing__(self, segment: str) -> tuple[int, ...]:
        if segment[0] in self.ids:
            found = tuple(self.ids[p] for p in self.merges.encode(segment))
        else:
            found = tuple(self.bytes[b] for b in segment.encode())
        if len(self) >= self.most:
            self.clear()
        self[segment] = found
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.__getitem__, self.segment.findall(MARK + text.replace(" ", MARK)))))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


def codec(path: str) -> Codec:
    """The codec of a Python worker, for its tasks one after another."""
    return held(path, lambda: Codec(path))


def _path(model: str | None) -> str:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    return str(model)


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """id_col and ids, the ids of each whole text."""
    path, kind = _path(model), dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for b in slices(batch, text_col, SLICE_BYTES):
                ids = [own.encode(t or "") for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decoded(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """id_col and text, the text of each list of ids (null or empty: the empty text)."""
    path, kind = _path(model), dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: digests of both directions, so that ids need not leave the worker."""
    path, kind = _path(model), dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for b in slices(batch, text_col, SLICE_BYTES):
                count, ids_sha, text_sha = [], [], []
                for t in b.column(1).to_pylist():
                    ids = own.encode(t or "")
                    count.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    found = df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("id", id_col)


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the codec and back."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
