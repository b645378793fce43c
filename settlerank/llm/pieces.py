"""SentencePiece encoding and decoding with a shared-prefix Viterbi.

A text is marked as the library marks it (a leading blank, blanks as U+2581) and cut into marked words, across which no
piece of the model reaches. Each batch's distinct new words are sorted, which is the depth-first order of their trie, and
traversed with one stack of forward states: a word takes over the states of the prefix it shares with the word before
and adds those of its own letters. Then the texts are put together from the words' ids.

The forward state of a prefix depends on the model:

* unigram: the best sum of scores, and the piece that ends it;
* BPE: of the pieces that may end the prefix the one that is compatible with the state it follows, that is, merging
  the two pieces' letters by rank gives these two pieces again. There is exactly one such path, and it is what
  merging gives. (Adding up the scores of a BPE model, which are ranks, would give other ids than the library's.)

Ids equal those of the sentencepiece library. Characters that no piece covers become byte pieces, or the unknown id once
for each run where the model has no bytes. Decoding gives the text back, but for U+2581 itself, which returns as a blank.

A null text counts as empty: no ids, and ids that are null decode to an empty text. Repeated rows each get a row; other
columns are kept by ``encode_pieces`` (an ``ids`` column of the input is replaced). Very long texts are one list.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from settlerank.llm.arrays import parts, plain

MARK = "▁"
UNIGRAM, BPE = 1, 2
KEPT_WORDS, KEPT_PAIRS, KEPT_CHARS = 500_000, 1_000_000, 64
_WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")
#: Fixed values of the model format: kinds of pieces, and the score of an unknown letter below the lowest one.
_NORMAL, _UNKNOWN, _BYTE, _UNKNOWN_PENALTY = 1, 2, 6, 10.0


class PieceModel:
    """Pieces, scores and kind of a model file; forward states along a trie of words."""

    def __init__(self, path: str | None = None, data: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        if data is None:
            with open(path, "rb") as file:
                data = file.read()
        model.ParseFromString(data)
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces \
                or not rules.add_dummy_prefix or model.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without normalisation are supported")
        self.kind = model.trainer_spec.model_type
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        self.silent = {i for i, p in enumerate(model.pieces) if p.type not in (_NORMAL, _BYTE, _UNKNOWN)}
        self.lowest = min(self.scores.values()) - _UNKNOWN_PENALTY
        #: whether marked words can be encoded on their own
        self.parts = not any("\n" in p and len(p) > 1 or MARK in p.lstrip(MARK) for p in self.ids)
        #: lengths of the pieces that end with two letters, longest first
        lengths: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                lengths.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK) if text else ""
        return _WORDS.findall(marked) if self.parts else [marked] if marked else []

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by merging neighbours: the best score first, of equal ones the leftmost."""
        now = list(text)
        while len(now) > 1:
            best, at = None, -1
            for i in range(len(now) - 1):
                score = self.scores.get(now[i] + now[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            now[at:at + 2] = [now[at] + now[at + 1]]
        return now

    def follows(self, before: str, piece: str) -> bool:
        pair = (before, piece)
        found = self.fits.get(pair)
        if found is None:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            found = self.fits[pair] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return found

    def learn(self, words: list[str]) -> None:
        """Encode distinct words, sorted into the depth-first order of their trie."""
        ids, lengths, scores, fits = self.ids, self.lengths, self.scores, self.fits
        last, value, before = [""], [0.0], ""           # state of each prefix of the word before
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1:]
            if self.kind == UNIGRAM:
                del value[shared + 1:]
                for end in range(shared + 1, len(word) + 1):
                    best, piece = -np.inf, ""
                    for size in (*lengths.get(word[end - 2:end], ()), 1):
                        some = word[end - size:end]
                        score = scores.get(some) if size <= end else None
                        if score is None:
                            if size > 1:
                                continue
                            score = self.lowest
                        if value[end - size] + score > best:
                            best, piece = value[end - size] + score, some
                    value.append(best)
                    last.append(piece)
            else:
                for end in range(shared + 1, len(word) + 1):
                    for size in lengths.get(word[end - 2:end], ()) if end > 1 else ():
                        if size <= end:
                            some = word[end - size:end]
                            if some in ids:
                                fit = fits.get((last[end - size], some))
                                if fit or fit is None and self.follows(last[end - size], some):
                                    last.append(some)
                                    break
                    else:
                        last.append(word[end - 1])
            before = word
            found, end = [], len(word)
            while end:
                piece = last[end]
                found.append(piece)
                end -= len(piece)
            self.known[word] = self._numbers(found[::-1])

    def _numbers(self, pieces: list[str]) -> bytes:
        try:
            return struct.pack(f"<{len(pieces)}i", *[self.ids[p] for p in pieces])
        except KeyError:
            pass
        out: list[int] = []
        for piece in pieces:
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        cut = [self.words(t) for t in texts]
        missing = set().union(*cut).difference(known)
        self.learn(list(missing))
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4") for words in cut]
        for word in missing:
            if len(word) > KEPT_CHARS:
                del known[word]
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        out, loose = [], bytearray()
        for i in ids.tolist() if isinstance(ids, np.ndarray) else ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                loose.append(byte)
                continue
            if loose:
                out.append(loose.decode(errors="replace"))
                loose.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.pieces[i])
        out.append(loose.decode(errors="replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_MODELS: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    """One per Python worker, kept between tasks."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """The rows with a column ``ids``. One pass, no shuffle; the words of each batch are its own."""
    kept = docs.drop("ids")
    names, at = kept.columns, kept.columns.index(text_col)

    def encode(batches):
        model = model_at(model_path)
        for batch in parts(batches, 500):
            ids = _lists(model.encode(plain(batch.column(at)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*names, "ids"])

    from pyspark.sql.types import ArrayType, IntegerType, StructType
    schema = StructType([*kept.schema.fields]).add("ids", ArrayType(IntegerType()))
    return kept.mapInArrow(encode, schema)


def decode_pieces(coded: DataFrame, model_path: str, id_col: str = "doc_id", keep: list[str] = ()) -> DataFrame:
    """id, columns to keep, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded text."""
    names = [id_col, *keep]

    def decode(batches):
        model = model_at(model_path)
        for batch in parts(batches, 500):
            column = batch.column(len(names))
            found = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32) for x in column]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array([len(x) for x in found], pa.int64()),
                 pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                 pa.array([model.decode(x) for x in found], pa.string())], [*names, "n_tokens", "ids_crc32", "text"])

    rows = coded.select(*names, "ids")
    kinds = "".join(f"`{c}` {kind}, " for c, kind in rows.dtypes[:-1])
    return rows.mapInArrow(decode, kinds + "n_tokens long, ids_crc32 long, text string")
