"""Token files: a concatenated id array per file, with Elias-Fano coded document boundaries.

A file holds one block of documents in ascending doc_id order (little-endian):

    magic "GSEF0001" | part, block, n_docs, n_nulls, n_ids, width, before : 7 x int64
    | first doc_id : int64 | Elias-Fano of doc_id - first | Elias-Fano of the document ends | ids, ``width`` bytes each | "\\n"

``part`` and ``block`` order the files, ``before`` counts the ids of earlier blocks of the part. The last byte is the
record separator of Spark's text writer, which puts the files on any file system that Spark can write, with its commit
protocol. An Elias-Fano list of n values below u takes 2 + log2(u / n) bits a value: low bits are packed, high parts are
a unary bit string with a one for each value, and ``select`` finds the i-th one through a sample per 512 ones.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .hashing import word_hashes
from .workers import lean

MAGIC = b"GSEF0001"
END_ID = 1
#: Ids of a block; a file ends with the document that reaches it.
BLOCK_IDS = 4 << 20
#: Words whose ids a worker remembers, about 30 bytes each.
CACHE_WORDS = 2_000_000
#: Characters that are encoded together.
PORTION = 2 << 20
#: Bytes of words that are compared together.
COMPARED = 1 << 18
SAMPLE = 512
TOKENIZER = "word_bpe_49k.json"


class EliasFano:
    """A non-decreasing list of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v, n = values.astype(np.uint64), len(values)
        top = int(v[-1]) + 1 if n else 1
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        high_at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(high_at[-1]) if n else 0) + 1, np.uint8)
        bits[high_at] = 1
        low = np.empty(0, np.uint8)
        if low_bits:
            each = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(each.ravel(), bitorder="little")
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), high_at[::SAMPLE].astype("<u4" if len(bits) < 1 << 32 else "<u8"))

    def to_bytes(self) -> bytes:
        wide = self.samples.dtype.itemsize
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.samples), wide], "<i8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, n_low, n_high, n_samples, wide = np.frombuffer(data, "<i8", 6, at).tolist()
        at += 48
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, f"<u{wide}", n_samples, at + n_low + n_high)
        return cls(n, low_bits, low, high, samples), at + n_low + n_high + n_samples * wide

    def _low(self, i: int) -> int:
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        part = int.from_bytes(self.low[a // 8 : (b + 7) // 8].tobytes(), "little")
        return part >> (a % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it and the bits in between."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        rest, byte = i % SAMPLE, at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (k := word.bit_count()) <= rest:
            rest -= k
            byte += 1
            word = int(self.high[byte])
        for _ in range(rest):
            word &= word - 1
        return (byte * 8 + (word & -word).bit_length() - 1 - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """Every value at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out


def write_block(part: int, block: int, before: int, doc_ids: list[int | None], ids: bytes, ends: np.ndarray, width: int) -> bytes:
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    head = np.array([part, block, len(doc_ids), len(doc_ids) - len(known), len(ids) // width, width, before, first], "<i8")
    gaps = (known.view(np.uint64) - np.uint64(first % (1 << 64))) if len(known) else np.empty(0, np.uint64)
    return b"".join([MAGIC, head.tobytes(), EliasFano.encode(gaps).to_bytes(), EliasFano.encode(ends).to_bytes(), ids])


class Block:
    """A file's content: ``doc_id(i)``, ``span(i)`` and ``ids(i)`` by select, ``doc_ids()`` and ``bounds()`` for all."""

    def __init__(self, data: bytes) -> None:
        view = memoryview(data)
        if view[:8] != MAGIC:
            raise ValueError("not a token file")
        self.part, self.block, self.n_docs, self.n_nulls, self.n_ids, self.width, self.before, self.first = np.frombuffer(view, "<i8", 8, 8).tolist()
        self._docs, at = EliasFano.from_bytes(view, 72)
        self._ends, at = EliasFano.from_bytes(view, at)
        self._ids = np.frombuffer(view, f"<u{self.width}", self.n_ids, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_nulls else self._docs.select(i - self.n_nulls) + self.first

    def span(self, i: int) -> tuple[int, int]:
        return (self._ends.select(i - 1) if i else 0), self._ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        return self._ids[slice(*self.span(i))]

    def doc_ids(self) -> list[int | None]:
        gaps = self._docs.all()
        return [None] * self.n_nulls + (gaps + np.uint64(self.first % (1 << 64))).view(np.int64).tolist()

    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], self._ends.all().astype(np.int64)])


class Vocabulary:
    """A tokenizer and the ids of the words that it has met, in flat arrays sorted by the words' hashes.

    White space never lies inside a token of this tokenizer and is dropped by it, so a text is the sequence of its
    words, and a word is encoded once for all its occurrences. Words end at the space and the line feed only; other
    white space stays in the word that the tokenizer gets. A full stop or comma that ends a word after a-z is a token
    sequence of its own. Words are told apart by 64 bits of hash, among CACHE_WORDS at a time.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core, and threads keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.clear()
        got = self.encode(list(PROBES))[0].tolist()
        if got != [i for x in PROBES for i in self.tokenizer.encode(x, add_special_tokens=False).ids]:
            raise ValueError(f"{path} does not split texts into words as this writer does")

    def clear(self) -> None:
        self.spelt, self.spelt_at, self.spelt_size = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
        self.hashes = np.empty(0, np.uint64)
        self.starts = np.empty(0, np.int32)
        self.sizes = np.empty(0, np.int32)
        self.flat = np.empty(0, f"<u{self.width}")

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids, sizes = [], []
        for i in range(0, len(words), 20_000):
            for e in self.tokenizer.encode_batch_fast(words[i : i + 20_000], add_special_tokens=False):
                x = e.ids
                ids += x
                sizes.append(len(x))
        size = np.array(sizes, np.int64)
        start = len(self.flat) + np.cumsum(size) - size
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        start, size = start.astype(np.int32), size.astype(np.int32)
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.starts = np.insert(self.starts, at, start[order])
        self.sizes = np.insert(self.sizes, at, size[order])
        self.flat = np.concatenate([self.flat, np.array(ids, self.flat.dtype)])
        data = [x.encode() for x in words]
        size = np.array([len(x) for x in data], np.int64)
        self.spelt_at = np.insert(self.spelt_at, at, (len(self.spelt) + np.cumsum(size) - size)[order])
        self.spelt_size = np.insert(self.spelt_size, at, size[order])
        self.spelt = np.concatenate([self.spelt, np.frombuffer(b"".join(data), np.uint8)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text ends in them."""
        if len(texts) == 1 and len(texts[0]) > 2 * PORTION:
            found = [self.encode([x])[0] for x in _pieces(texts[0])]
            return np.concatenate(found), np.array([sum(map(len, found))])
        if len(self.hashes) > CACHE_WORDS:
            self.clear()
        data = [(x if _FOREIGN.search(x) else x.lower()).encode() for x in texts]
        raw = b"\n".join(data)
        starts, ends, h = word_hashes(raw, b" \n", _split_marks)
        coded = pa.array(h).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        at = np.searchsorted(self.hashes, distinct)
        new = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != distinct) if len(self.hashes) else np.arange(len(distinct))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        bytes_, length = np.frombuffer(raw, np.uint8), ends - starts
        if len(new):
            words = [raw[a:z].decode() for a, z in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            self._learn(distinct[new], words)
            at = np.searchsorted(self.hashes, distinct)
        known = _spelt_alike(bytes_, starts[first], length[first], self.spelt, self.spelt_at[at], self.spelt_size[at])
        if not (known and _spelt_alike(bytes_, starts, length, bytes_, starts[first[codes]], length[first[codes]])):  # two words of one hash
            found = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
            return np.array([i for x in found for i in x], self.flat.dtype), np.cumsum([len(x) for x in found])
        size = self.sizes[at][codes].astype(np.int64)
        upto = np.cumsum(size)
        ids = self.flat[np.repeat(self.starts[at][codes] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
        last = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in data]))  # words that begin before each text's end
        return ids, np.concatenate([[0], upto])[last]


#: This tokenizer lower-cases after composing; below U+0300 nothing composes, so texts can be lower-cased beforehand, but
#: for those that may hold a special token, whose case counts.
_FOREIGN = re.compile(r"[^\x00-\u02ff]|<\|")


#: Texts that a tokenizer of another normaliser or word rule would encode otherwise than word by word.
PROBES = ("Don't stop, U.S.A. 3,5 e-mail.", " two  spaces\n\nand\tTAB ", "Caf\u00c9 na\u00efve 12:30 (x) <b> a/b c_d", "end.", "")


def _spelt_alike(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> bool:
    """Whether every word of the bytes ``a`` is that of ``b``, byte by byte."""
    if not np.array_equal(a_size, b_size):
        return False
    upto = np.cumsum(a_size)
    cuts = np.searchsorted(upto, np.arange(COMPARED, upto[-1] if len(upto) else 0, COMPARED)).tolist()
    for i, k in itertools.pairwise([0, *cuts, len(upto)]):
        size = a_size[i:k]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        if not np.array_equal(a[np.repeat(a_at[i:k], size) + inside], b[np.repeat(b_at[i:k], size) + inside]):
            return False
    return True


def _split_marks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before, last = raw[ends - 2], raw[ends - 1]
    mark = (ends - starts > 1) & ((last == 46) | (last == 44)) & (before >= 97) & (before <= 122)
    twice = 1 + mark
    second = np.cumsum(twice)[mark] - 1
    a, z = np.repeat(starts, twice), np.repeat(ends, twice)
    a[second] = ends[mark] - 1
    z[second - 1] = ends[mark] - 1
    return a, z


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces of about PORTION characters, cut at white space."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PORTION)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


_GAP = re.compile("[ \n]")


@lru_cache(1)
def _vocabulary(path: str) -> Vocabulary:
    """A worker's own, kept from task to task."""
    return Vocabulary(path)


def _writer(path: str, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, before = TaskContext.get().partitionId(), 0, 0
        vocabulary = _vocabulary(path)
        docs: list[int | None] = []
        ids: list[bytes] = []
        ends: list[int] = []
        n, end_id = 0, END_ID.to_bytes(vocabulary.width, "little")

        def flush() -> pa.RecordBatch:
            data = write_block(part, block, before, docs, b"".join(ids), np.array(ends, np.int64), vocabulary.width)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

        for b in batches:
            for names, texts in _portions(b):
                flat, bounds = vocabulary.encode(texts)
                for doc_id, a, z in zip(names, [0, *bounds.tolist()], bounds.tolist(), strict=False):
                    docs.append(doc_id)
                    ids += [flat[a:z].tobytes(), end_id]
                    n += z - a + 1
                    ends.append(n)
                    if n >= block_ids:
                        yield flush()
                        block, before, n = block + 1, before + n, 0
                        docs, ids, ends = [], [], []
        if docs:
            yield flush()

    return write


def _portions(b: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """A batch in runs of rows of about PORTION characters, a longer text alone."""
    names, texts, size = [], [], 0
    for doc_id, text in zip(b.column(0), b.column(1), strict=True):
        names.append(doc_id.as_py())
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= PORTION:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts


def vocabulary_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_token_files(docs: DataFrame, where: str, tokenizer: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs(doc_id, text, ...)`` into files under ``where``, in ascending doc_id order.

    Null doc_ids come first; rows that share a doc_id follow one another by the hash of their text. Null text has
    only the end id. Every file is one block; ids take two bytes if the vocabulary allows. An empty table writes no
    block. The one shuffle deals rows out by range, so a task sees a run of ids in order and holds one block.
    """
    path = tokenizer or vocabulary_path()
    rows, parts = docs.select("doc_id", "text", F.xxhash64("text").alias("t")), scratch.tasks(docs)
    rows = rows.repartitionByRange(parts, "doc_id", "t").sortWithinPartitions("doc_id", "t").select("doc_id", "text")
    data = rows.mapInArrow(lean(_writer(path, block_ids)), "data binary")
    data.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(where)


def _long_at(at: int) -> F.Column:
    """The int64 at byte ``at`` (from 0) of a file's content."""
    digits = F.concat(*[F.hex(F.substring("content", at + 8 - i, 1)) for i in range(8)])
    return F.conv(digits, 16, 10).cast("long")


def _reader(starts: dict[int, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                block = Block(data.as_buffer())
                bounds = block.bounds()
                base = starts[block.part] + block.before
                crcs = [zlib.crc32(block._ids[a:z].astype("<u4").tobytes()) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                cols = [pa.array(block.doc_ids(), pa.int64()), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_token_files(spark: SparkSession, where: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document of the files, read back from their bytes.

    The ids before each part come from the files' headers: one row per part, and parts are as many as the writing
    job's tasks, goes to the driver.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(where).filter("length > 0")
    sizes = files.select(_long_at(8).alias("part"), (_long_at(40) + _long_at(56)).alias("ids")).groupBy("part").agg(F.max("ids")).collect()
    starts, total = {}, 0
    for part, n in sorted(map(tuple, sizes)):
        starts[part], total = total, total + n
    return files.select("content").mapInArrow(lean(_reader(starts)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and return what they hold, one row per row of ``docs``."""
    spark = docs.sparkSession
    where = scratch.new_path(spark, "tokens")
    write_token_files(docs, where, tokenizer)
    return read_token_files(spark, where)
