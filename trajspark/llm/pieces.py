"""SentencePiece BPE ids by a table of last tokens over prefixes, and text from ids."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import small_batches

#: What a blank is in pieces.
SPACE = "▁"
#: Units (a word with the blanks before it) longer than this are encoded anew each time.
LONG = 64
#: Units and pairs of pieces that a worker remembers; when there are more it starts afresh.
UNITS, PAIRS = 1 << 19, 1 << 20
#: The last token of a prefix that ends in a character no piece has.
UNKNOWN = -1
_models: dict[str, Coder] = {}


class Pieces:
    """The vocabulary of a sentencepiece BPE model with byte fallback, a dummy blank in front and no other normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or norm.precompiled_charsmap
                or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or any(p.type in (kinds.UNUSED, kinds.USER_DEFINED) for p in model.pieces)):
            raise ValueError(f"{path}: only BPE models with byte fallback, a dummy prefix and no other normalisation are supported")
        self.piece = [p.piece for p in model.pieces]
        self.size = len(self.piece)
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte = [0] * 256
        self.of_byte: dict[int, int] = {}
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
                self.of_byte[i] = int(p.piece[1:-1], 16)
        self.normal = set(self.id.values())
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        #: No piece has a blank after another character, so nothing is merged across such a place; nor across a line feed where no piece has one.
        self.by_line = False
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            self.units = re.compile(r"(?s).+")
        elif any("\n" in p for p in self.id):
            self.units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        else:
            self.units, self.by_line = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n"), True
        self.pairs = {p[i:i + 2] for p in self.id for i in range(len(p) - 1)}
        self._halves: dict[str, tuple[str, str] | None] = {}
        self._spines: dict[tuple[int, bool], list[tuple[str, float]]] = {}
        self._pairs: dict[int, bool] = {}

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two symbols whose merge makes a piece out of its characters; None if merging its characters ends elsewhere."""
        if piece in self._halves:
            return self._halves[piece]
        symbols, made = list(piece), None
        while len(symbols) > 1:
            ranks = [(self.rank[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.rank]
            if not ranks:
                break
            k = min(ranks)[1]
            made = symbols[k], symbols[k + 1]
            symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
        self._halves[piece] = made if len(symbols) == 1 else None
        return self._halves[piece]

    def whole(self, token: int) -> bool:
        """Whether the characters of a token merge into it."""
        return len(self.piece[token]) == 1 or self.halves(self.piece[token]) is not None

    def spine(self, token: int, right: bool) -> list[tuple[str, float]]:
        """What stands at the right (or left) end of a token while it is merged, with the rank of the merge that ends each state."""
        got = self._spines.get((token, right))
        if got is None:
            at, until, got = self.piece[token], float("inf"), []
            while True:
                got.append((at, until))
                if len(at) == 1:
                    break
                until, at = self.rank[at], self.halves(at)[right]
            got.reverse()
            self._spines[token, right] = got
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether the characters of two tokens, side by side, merge into just these two.

        Until a merge goes across the border, both sides merge as they do alone, lower ranks first and equal ranks from the left. So it is
        enough to replay what stands at the border and to ask whether its merge would come before the next one on either side.
        """
        key = a * self.size + b
        known = self._pairs.get(key)
        if known is None:
            left, right = self.spine(a, True), self.spine(b, False)
            i = j = 0
            known = True
            while known:
                (x, until_x), (y, until_y) = left[i], right[j]
                across = self.rank.get(x + y)
                if across is not None and across < until_x and across <= until_y:
                    known = False
                elif i + 1 < len(left) and until_x <= until_y:
                    i += 1
                elif j + 1 < len(right):
                    j += 1
                else:
                    break
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def unit_ids(self, text: str) -> list[int]:
        """Ids of escaped text.

        Every prefix has one last token: of the tokens that end there (all matches of the automaton) the one that is compatible with the last
        token of the prefix before it. The table of last tokens is filled from left to right and read from right to left.
        """
        last = [UNKNOWN] * len(text)
        done = -1
        for end, (token, size) in self.automaton.iter(text):
            if end == done:
                continue
            before = last[end - size] if end >= size else UNKNOWN
            if self.whole(token) and (before == UNKNOWN or self.compatible(before, token)):
                last[end], done = token, end
        ids, at = [], len(text) - 1
        while at >= 0:
            token = last[at]
            if token == UNKNOWN:
                ids.extend(self.byte[x] for x in reversed(text[at].encode()))
                at -= 1
            else:
                ids.append(token)
                at -= len(self.piece[token])
        ids.reverse()
        return ids

    def escaped(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return [i for unit in self.units.findall(self.escaped(text)) for i in self.unit_ids(unit)]

    def raw(self, ids: list[int]) -> str:
        """Text of ids as it stands within a longer text: blanks in place, byte ids put together, a byte that fits no character as U+FFFD."""
        out, held = [], bytearray()

        def flush() -> None:
            while held:
                try:
                    out.append(held.decode())
                    held.clear()
                except UnicodeDecodeError as e:
                    out.append(held[:e.start].decode() + "�")
                    del held[:e.start + 1]

        for i in ids:
            if i in self.of_byte:
                held.append(self.of_byte[i])
            else:
                flush()
                if i in self.normal:
                    out.append(self.piece[i].replace(SPACE, " "))
                elif i not in self.silent:
                    out.append(" ⁇ ")
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the blank that encoding puts in front goes."""
        text = self.raw(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first in self.normal and self.piece[first].startswith(SPACE) else text


class _Units(dict):
    """Ids of units as little-endian 32-bit numbers. ``word``: keys are words that follow a blank, or a line feed and the word after it, else escaped text."""

    def __init__(self, pieces: Pieces, word: bool):
        super().__init__()
        self.pieces, self.word = pieces, word

    def __missing__(self, unit: str) -> bytes:
        text = SPACE + unit if self.word and unit[0] != "\n" else unit
        k, least = len(unit), max(1, len(unit) - 4)
        while k > least and unit[k - 2:k] not in self.pieces.pairs:  # no piece has the last two characters side by side: marks behind a word
            k -= 1
        out = self.get(unit[:k]) if k < len(unit) else None
        cut = len(text) - len(unit) + k
        if out is None:
            out = np.array(self.pieces.unit_ids(text[:cut]), "<u4").tobytes()
            self.keep(unit[:k], out)
        if k < len(unit):
            out += np.array(self.pieces.unit_ids(text[cut:]), "<u4").tobytes()
            self.keep(unit, out)
        return out

    def keep(self, unit: str, ids: bytes) -> None:
        if len(unit) <= LONG:
            if len(self) >= UNITS:
                self.clear()
            self[unit] = ids


class _Strings:
    """A byte string for every id, to put together those of many ids at once."""

    def __init__(self, of_id: list[bytes]):
        self.data = np.frombuffer(b"".join(of_id), np.uint8)
        self.size = np.array([len(x) for x in of_id])
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1]))

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        to = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - to + size, size) + np.arange(to[-1] if len(to) else 0)]


class Coder:
    """A model with what a worker remembers of it."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.words, self.units = _Units(self.pieces, True), _Units(self.pieces, False)
        self.decimal = _Strings([b"%d," % i for i in range(self.pieces.size)])
        self.plain = _Strings([bytes([self.pieces.of_byte[i]]) if i in self.pieces.of_byte else p.replace(SPACE, " ").encode() if i in self.pieces.normal else b"" for i, p in enumerate(self.pieces.piece)])

    def parts(self, text: str) -> tuple[list[str], _Units]:
        """Units of a text and what knows their ids. Where single blanks part words, cutting at blanks does what the pattern does."""
        if self.pieces.by_line and SPACE not in text and "  " not in text and " \n" not in text and text[:1] not in ("", " ", "\n") and text[-1] != " ":
            return text.replace("\n", " \n").split(" "), self.words
        return self.pieces.units.findall(self.pieces.escaped(text)), self.units

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the text decoded from them."""
        parts, known = self.parts(text)
        count, listed, decoded = 0, sha256(), sha256()
        for k in range(0, len(parts), 1 << 14):
            ids = np.frombuffer(b"".join(map(known.__getitem__, parts[k:k + (1 << 14)])), "<u4")
            if k:
                listed.update(b",")
            listed.update(self.decimal.joined(ids)[:-1])
            decoded.update(self.plain.joined(ids)[not k:])  # the first piece begins with the blank that encoding put there
            count += len(ids)
        return count, listed.hexdigest(), decoded.hexdigest()


def coder(vocabulary: str) -> Coder:
    """The model of a file of ``public_tokenizers``, once per worker."""
    if vocabulary not in _models:
        import public_tokenizers
        _models[vocabulary] = Coder(public_tokenizers.path(vocabulary))
    return _models[vocabulary]


def _digested(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = pc.fill_null(b.column("text").cast(pa.string()), "")
            rows = [coder(vocabulary).digests(t.as_py()) for t in column]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                                  ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _encoded(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = coder(vocabulary).pieces
        for b in batches:
            ids = [pieces.encode(t.as_py() or "") for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return run


def _decoded(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = coder(vocabulary).pieces
        for b in batches:
            text = [pieces.decode(i.as_py() or []) for i in b.column("ids")]
            yield pa.record_batch([b.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])
    return run


def encode(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text): the ids of the whole text, as the sentencepiece library gives them.

    Null and empty texts have no ids. Repeated rows are encoded alike; doc_id may be null; extra columns are ignored; an empty table gives
    an empty result. Rows are independent: nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_encoded(vocabulary), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, text) of every row of ``encoded`` (doc_id, ids).

    Control ids are silent, ids of no piece give the library's mark for unknowns, bytes that make no character U+FFFD. Null or empty ids give
    an empty text; ids must lie within the vocabulary.
    """
    small_batches(encoded.sparkSession)
    plain = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return plain.mapInArrow(_decoded(vocabulary), "doc_id long, text string")


def piece_digests(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256 and decoded_sha256 of the whole text, encoded and decoded again.

    Null texts count as empty: no ids, both digests of an empty string. Repeated rows are digested alike; doc_id may be null; extra columns
    are ignored; an empty table gives an empty result. A text is held by one worker as a list of units; units that recur are encoded once.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_digested(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
