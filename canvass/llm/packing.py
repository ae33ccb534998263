"""Best-fit packing of tokenised documents into sequences.

Tokens are counted in one map over all whole texts.  A document longer than a
sequence is cut into full pieces and a rest; nothing else is cut.  The pieces, a
small stored table, are then packed as they come by bounded-space online best-fit:
each task holds ``OPEN_BINS`` open bins at most, a bitset keyed by free space finds
the tightest one in a few word operations, and the fullest closes first when
another is needed.  A task sees about ``GROUP_PIECES`` pieces or more, as many as its
part of the table has, and keeps only its open bins: nothing is shuffled, no key
makes a group, and rows repeated with one id are spread as they lie.  Each task
leaves at most its open bins part-filled.

Defined results: a null or empty text is its end token alone; repeated rows are
packed as often as they occur; an empty table packs into nothing; further
columns do not reach the packer.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.storage import documents, stored

MAX_TOKENS, END_ID = 4096, 1
GROUP_PIECES, OPEN_BINS = 65_536, 64
CACHED_WORDS, BATCH_TEXTS = 500_000, 64
#: Texts of these characters alone are in composed form already, fold to lower case letter by letter, and hold no
#: special token: white space parts them for the tokenizer, so each word can be looked up on its own.
_PLAIN = re.compile("[\\t\\n\\r\\x20-;=-~\\xa1-\\xac\\xae-\u012f\u0131-\u017f]*")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _class(major: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x21, 0x180) if unicodedata.category(chr(c))[0] == major)


#: How the tokenizer's file parts a lower-case word of plain characters.
_PARTS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_class('L')}{_class('N')}]+"
)
#: Byte-level vocabularies write each byte as a printable character: itself, or else the next free one from 256 on.
_PRINTED = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_PRINTED |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_BYTE_LEVEL = {c: "".join(_PRINTED[b] for b in chr(c).encode()) for c in range(0x7F, 0x180)}


class WordTokens:
    """Ids of texts as little-endian unsigned 32-bit bytes; the ids of words already met are kept."""

    def __init__(self, path: str | None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}

    def _of_part(self, part: str) -> bytes:
        found = self.known.get(part)
        if found is None:
            ids = [t.id for t in self.tokenize(part if part.isascii() else part.translate(_BYTE_LEVEL))]
            found = array("I", ids).tobytes()
        return found

    def _learn(self, words: Iterable[str]) -> None:
        for word in words:
            if word.isalpha():
                self.known[word] = self._of_part(word)
            else:
                self.known[word] = b"".join(map(self._of_part, _PARTS.findall(word)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        plain = [text.lower().split() if text and _PLAIN.fullmatch(text) else None for text in texts]
        known = self.known
        new = {w for words in plain if words for w in words if w not in known}
        if len(known) + len(new) > CACHED_WORDS:  # emptied first, so that all words of these texts are there
            known.clear()
            new = {w for words in plain if words for w in words}
        if new:
            self._learn(new)
        return [
            b"".join(map(known.__getitem__, words))
            if words is not None
            else np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
            for text, words in zip(texts, plain, strict=True)
        ]


def _cutter(path: str | None, max_tokens: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            texts = batch.column("text").to_pylist()
            encoded = (x for a in range(0, len(texts), BATCH_TEXTS) for x in tokens.encode(texts[a : a + BATCH_TEXTS]))
            for i, ids in enumerate(encoded):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, type=pa.int64())),
                    pa.array(piece, type=pa.int32()),
                    *(pa.array(x, type=pa.int64()) for x in (start, length, crc)),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def token_pieces(
    docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID
) -> DataFrame:
    """One row for each piece of at most max_tokens of each document's ids and end token."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _cutter(path, max_tokens, end_id),
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


class BestFit:
    """Online best-fit of lengths into bins, at most open_bins of them open at a time."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins
        self.bits = self.n_open = self.n_bins = 0  # bit f: some open bin has f free

    def _take(self, free: int) -> int:
        b = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.n_open -= 1
        return b

    def place(self, size: int) -> tuple[int, int]:
        """Bin and offset of the next length: the open bin that it fits most tightly, or a new one."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.n_open >= self.open_bins:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            b, free = self.n_bins, self.capacity
            self.n_bins += 1
        if free > size:
            self.by_free[free - size].append(b)
            self.bits |= 1 << (free - size)
            self.n_open += 1
        return b, self.capacity - free


def _packer(capacity: int, open_bins: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins)
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            placed = np.array([bins.place(n) for n in batch.column("length").to_pylist()], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(placed[:, 0] + first), pa.array(placed[:, 1])], names=[*batch.schema.names, "sequence_id", "offset"]
            )

    return pack


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, group_pieces: int = GROUP_PIECES, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add ``sequence_id`` and ``offset``; read twice, so give it a stored table.

    Lengths are 1 to max_tokens; sequences are numbered by the task that fills them and their order in it.
    """
    tasks = max(1, pieces.count() // group_pieces)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return pieces.coalesce(tasks).mapInArrow(_packer(max_tokens, open_bins), schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(stored(token_pieces(docs), "pieces"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
