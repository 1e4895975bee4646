"""Token-ID files whose document boundaries are Elias-Fano coded.

A shard holds a run of documents in identifier order:

    magic b"TOKEF01\\n", then little-endian 64-bit: documents, ids, bytes per id,
    length of the coded boundaries, length of the coded identifiers, null identifiers
    boundaries: Elias-Fano of the end position of every document
    identifiers: Elias-Fano of the document identifiers above the smallest, which stands before it
    the ids of all documents, one after the other

Elias-Fano keeps the low bits of each value as they are and the high bits in unary,
about 2 + log2(ids / documents) bits for a document. The one-bits of the unary part
are counted for each 4096 bits, so the k-th value is found from a count, one word
run and its low bits: there is no table of 64-bit offsets.
"""

from __future__ import annotations

import codecs
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tallyweave.llm.common import batches_by_bytes, filesystem, id_order, partitions, path_of
from tallyweave.session import cut

MAGIC = b"TOKEF01\n"
END_ID = 0
#: Runs with known ids that a worker remembers.
MEMORY = 600_000
#: Text bytes that a worker encodes at once, about.
PART_BYTES = 4 << 20
#: Ids that a reader holds at once, about.
READ_IDS = 4 << 20
_STEP = 4096


class EliasFano:
    """Non-decreasing numbers in near-minimal space, with select."""

    def __init__(self, count: int, width: int, low: np.ndarray, high: np.ndarray):
        self.count, self.width, self.low, self.high = count, width, low, high
        ones = np.unpackbits(high, bitorder="little")
        self.samples = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), _STEP), dtype=np.int64))]) if len(ones) else np.zeros(1, np.int64)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        bits = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).reshape(-1)
        high = values >> width
        unary = np.zeros(int(high[-1]) + n, np.uint8)
        unary[high + np.arange(n)] = 1
        return cls(n, width, np.packbits(bits, bitorder="little"), np.packbits(unary, bitorder="little"))

    def select(self, k: int) -> int:
        """The k-th value, k from 0."""
        block = int(np.searchsorted(self.samples, k, "right")) - 1
        part = np.unpackbits(self.high[block * _STEP // 8:(block + 1) * _STEP // 8], bitorder="little")
        at = block * _STEP + int(np.flatnonzero(part)[k - int(self.samples[block])])
        value = (at - k) << self.width
        for i in range(self.width):
            b = k * self.width + i
            value |= ((int(self.low[b >> 3]) >> (b & 7)) & 1) << i
        return value

    def values(self, first: int, last: int) -> np.ndarray:
        """Values ``first`` to before ``last``."""
        if first >= last:
            return np.zeros(0, np.int64)
        block = int(np.searchsorted(self.samples, first, "right")) - 1
        stop = int(np.searchsorted(self.samples, last, "left"))
        part = np.unpackbits(self.high[block * _STEP // 8:stop * _STEP // 8], bitorder="little")
        skip = first - int(self.samples[block])
        at = block * _STEP + np.flatnonzero(part)[skip:skip + last - first]
        k = np.arange(first, last)
        out = (at - k) << self.width
        if self.width:
            begin, end = first * self.width, last * self.width
            bits = np.unpackbits(self.low[begin >> 3:(end + 7) >> 3], bitorder="little")[begin & 7:(begin & 7) + end - begin]
            out |= (bits.reshape(-1, self.width).astype(np.int64) << np.arange(self.width)).sum(axis=1)
        return out

    def tobytes(self) -> bytes:
        return struct.pack("<QQQQ", self.count, self.width, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> EliasFano:
        count, width, low, high = struct.unpack_from("<QQQQ", data)
        return cls(count, width, np.frombuffer(data, np.uint8, low, 32), np.frombuffer(data, np.uint8, high, 32 + low))


class Shard:
    """Random access to one shard through an open seekable file."""

    def __init__(self, file):
        self.file = file
        if file.read_at(8, 0) != MAGIC:
            raise ValueError("not a token shard")
        self.documents, self.n_ids, self.kind, ends, names, self.nulls = struct.unpack("<6Q", file.read_at(48, 8))
        self.ends = EliasFano.frombytes(file.read_at(ends, 56))
        coded = file.read_at(names, 56 + ends)
        self.least = struct.unpack_from("<q", coded)[0]
        self.names = EliasFano.frombytes(coded[8:])
        self.base = 56 + ends + names

    def boundaries(self, first: int, last: int) -> np.ndarray:
        """Start of ``first``, then the ends of documents ``first`` to before ``last``."""
        before = self.ends.select(first - 1) if first else 0
        return np.concatenate([[before], self.ends.values(first, last)]).astype(np.int64)

    def identifiers(self, first: int, last: int) -> list[int | None]:
        named = self.documents - self.nulls
        return [*(self.names.values(first, min(last, named)) + self.least).tolist(), *[None] * (max(0, last - max(first, named)))]

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.kind, self.base + start * self.kind), f"<u{self.kind}")


class Encoder:
    """Ids of texts by a file of the tokenizers library.

    A byte-level BPE merges only inside runs of letters, numbers, symbols or white space,
    so a text's ids are those of its runs. Many texts are split at once (``run_starts``),
    Arrow finds the distinct runs, the library's model encodes those that are new, and Arrow
    lays the ids of all runs side by side. Texts with characters that libraries might class
    differently go to the library whole. With ``added``, as in token files, so do texts that
    hold an added token such as ``<|endoftext|>``, which has its own id then, as the library's
    plain call gives it; without, such a token is encoded like other text.
    """

    def __init__(self, path: str, end_id: int = END_ID, added: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        # Those that aren't special are found by the library under both settings.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if added or not t.special]
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        self.stored = {i: i.to_bytes(self.kind.itemsize, "little") for i in self.tokenizer.get_vocab().values()}
        self.end = np.array([end_id], self.kind).tobytes()
        # Ids of the runs met lately, and of those met before them. Every call meets the stop.
        self.recent: dict[bytes, bytes] = {_STOP.encode(): self.end}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, new: list[bytes]) -> list[bytes]:
        if not new:
            return []
        stored, tokenize = self.stored, self.model.tokenize
        shown = codecs.charmap_decode(b"\x1f".join(new), "strict", _BYTE_CHARS)[0].split(_BYTE_CHARS[0x1f])
        return [b"".join([stored[t.id] for t in tokenize(run)]) for run in shown]

    def _ids(self, runs: list[bytes]) -> list[bytes]:
        """Ids of distinct runs."""
        known = list(map(self.recent.get, runs))
        got = {r: self.older.pop(r, None) for r, ids in zip(runs, known, strict=True) if ids is None}
        new = [r for r, ids in got.items() if ids is None]
        got.update(zip(new, self._learn(new), strict=True))
        ids = [got[r] if k is None else k for r, k in zip(runs, known, strict=True)]
        if len(self.recent) + len(got) > MEMORY // 2:
            self.older, self.recent = self.recent, dict(zip(runs, ids, strict=True))
        else:
            self.recent.update(got)
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes() + self.end

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text and the end id."""
        if not texts:
            return []
        whole = {i: self._whole(t) for i, t in enumerate(texts) if t and (_FAR.search(t) or any(a in t for a in self.added))}
        data = "".join([("" if not t or i in whole else t) + _STOP for i, t in enumerate(texts)]).encode()
        starts = run_starts(np.frombuffer(data, np.uint8))
        runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self._ids(runs.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(runs.indices)
        _, after, held = ids.buffers()
        stops = np.flatnonzero(np.frombuffer(data, np.uint8)[starts] == ord(_STOP))
        ends = [0, *np.frombuffer(after, np.int64)[stops + 1].tolist()]
        held = memoryview(held)
        return [whole.get(i) or bytes(held[a:b]) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]

    def encode(self, text: str | None) -> bytes:
        """Ids of a text and the end id."""
        return self.encode_all([text])[0]


#: Characters that libraries might class differently: beyond U+024F, and some controls, superscripts and fractions up to there.
_FAR = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
#: Ends each text where several are split at once: one of ``_FAR``, so none of them holds it.
_STOP = "\x1e"
_LETTER, _DIGIT, _SYMBOL, _SPACE, _END = range(5)


def _kinds() -> np.ndarray:
    """The kind of each character up to U+024F: without those of ``_FAR``, these classes are the tokenizer's own."""
    shown = map(chr, range(0x250))
    kinds = np.array([_LETTER if c.isalpha() else _DIGIT if c.isdecimal() else _SPACE if c.isspace() else _SYMBOL for c in shown], np.uint8)
    kinds[ord(_STOP)] = _END
    return kinds


_KINDS = _kinds()


def run_starts(data: np.ndarray) -> np.ndarray:
    """Where the runs begin that a byte-level BPE of this kind merges inside.

    ``data`` is UTF-8 of texts without ``_FAR``, each with ``_STOP`` after it. The runs are
    those of ``'(?:[sdmt]|ll|ve|re)| ?[letters]+| ?[digits]+| ?[symbols]+|\\s+(?!\\S)|\\s+``
    in each text, and each stop alone.
    """
    kinds = _KINDS[data]
    lead = np.flatnonzero(data >= 0xC0)  # of two bytes, as all characters from U+0080 on are here
    kinds[lead] = kinds[lead + 1] = _KINDS[(data[lead].astype(np.int16) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    start = np.ones(len(data), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    start |= kinds == _END
    # The last white space before something else stands alone, or with what follows if it is a blank.
    last = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] < _SPACE))
    start[last - (data[last] >= 0x80)] = True
    start[last + 1] = data[last] != ord(" ")
    mark = np.flatnonzero((data == ord("'")) & start)
    one, two = data[mark + 1], data[np.minimum(mark + 2, len(data) - 1)]
    short = np.isin(one, list(b"sdmt"))
    long = (one == ord("l")) & (two == ord("l")) | np.isin(one, list(b"vr")) & (two == ord("e"))
    start[mark[short | long] + 1] = False
    start[mark[short] + 2] = start[mark[long] + 3] = True
    return np.flatnonzero(start)


def _byte_chars() -> str:
    """The printable character that stands for each byte: itself where it has one, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(more)) for b in range(256))


_BYTE_CHARS = _byte_chars()

_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """One for each worker process."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id, added=True)
    return _ENCODERS[path, end_id]


def bounds(docs: DataFrame, id_col: str) -> list[int]:
    """Identifiers that part ``docs`` into as many runs as there are shuffle partitions."""
    n = partitions(docs.sparkSession)
    if n < 2:
        return []
    key = id_order(id_col)
    got = docs.select(key.alias("k")).agg(F.approx_percentile("k", [i / n for i in range(1, n)], 10_000)).first()[0]
    return sorted(set(got or []))


def write_shards(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` and write them in shards; returns the list of shards: ``shard, path, documents, ids``.

    Every attempt of a task writes a file of its own name and the list names those of
    the attempts that counted, so a lost or repeated task leaves no false shard.
    """
    spark: SparkSession = docs.sparkSession
    edges = bounds(docs, id_col)
    kind = Encoder(tokenizer, end_id).kind.itemsize

    def encode(batches):
        """Ids of each text and its shard, in one pass: a pass after it would keep a second worker beside each encoding one."""
        e, starts = encoder(tokenizer, end_id), np.array(edges, np.int64)
        for batch in batches:
            for part in batches_by_bytes(batch, 1, PART_BYTES):
                data = e.encode_all(part.column(1).to_pylist())
                key = part.column(0).fill_null((1 << 63) - 1).to_numpy()
                shard = np.searchsorted(starts, key, "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary()), pa.array(shard)], names=["id", "ids", "part"])

    def write(batches):
        import uuid

        from pyspark import TaskContext

        _ENCODERS.clear()  # all texts are encoded: what the worker remembers is not needed any more
        part = TaskContext.get().partitionId()
        names: list[int | None] = []
        sizes: list[int] = []
        data = []
        for batch in batches:
            names.extend(batch.column("id").to_pylist())
            for ids in batch.column("ids"):
                data.append(ids.as_buffer())
                sizes.append(ids.as_buffer().size // kind)
        if names:
            fs, root = filesystem(folder)
            path = f"{root}/shard-{part:06d}-{uuid.uuid4().hex}.tok"
            real = [n for n in names if n is not None]
            least = real[0] if real else 0
            ends = EliasFano.of(np.cumsum(sizes)).tobytes()
            coded = struct.pack("<q", least) + EliasFano.of(np.array(real, np.int64) - least).tobytes()
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(MAGIC + struct.pack("<6Q", len(names), sum(sizes), kind, len(ends), len(coded), len(names) - len(real)))
                out.write(ends)
                out.write(coded)
                for ids in data:
                    out.write(ids)
            yield pa.RecordBatch.from_pydict({"shard": [part], "file": [path.rsplit("/", 1)[1]], "documents": [len(names)], "ids": [sum(sizes)]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    coded = rows.mapInArrow(encode, "id long, ids binary, part int")
    dealt = coded.repartitionById(len(edges) + 1, F.col("part")).sortWithinPartitions(F.col("id").asc_nulls_last(), F.crc32("ids"))
    return cut(dealt.select("id", "ids").mapInArrow(write, "shard long, file string, documents long, ids long"), "shards")


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """One row for each stored document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    before = F.coalesce(F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    listed = shards.select("file", before.cast("long").alias("base")).repartition(partitions(shards.sparkSession), "file")

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, root = filesystem(folder)
                with fs.open_input_file(f"{root}/{name}") as file:
                    shard = Shard(file)
                    step = max(1, int(READ_IDS // max(1, shard.n_ids // max(1, shard.documents))))
                    for first in range(0, shard.documents, step):
                        last = min(first + step, shard.documents)
                        cuts = shard.boundaries(first, last)
                        ids = shard.ids(int(cuts[0]), int(cuts[-1])).astype("<u4")
                        at = cuts - cuts[0]
                        sums = [zlib.crc32(ids[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(shard.identifiers(first, last), pa.int64()), pa.array(cuts[:-1] + base, pa.int64()),
                            pa.array(np.diff(cuts), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as token shards in identifier order under ``folder`` and read them back.

    One row for each input row. Null and empty texts are the end id alone; null
    identifiers come last; rows with equal identifiers lie side by side, ordered by
    their ids. Without rows there are no shards and no rows.
    """
    folder = folder or path_of(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, tokenizer, folder, id_col, text_col, end_id), folder)
