"""Token files: frequency-ranked ids, byte-aligned variable length, control bytes apart.

A file holds the ids of consecutive documents. Ids are replaced by their rank of frequency in the
file, so common ids are small numbers of one byte. Four numbers share a control byte with two bits
each (their lengths less one); all control bytes stand together, then all data bytes. Reading is a
numpy table lookup from control bytes to lengths and a few masked gathers.

Layout, little-endian: ``FRQ1``, documents u32, ids u64, ranks u32; ids by rank u32; document ids i64
and a null flag u8 each; ids per document u32; control bytes; data bytes.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quitanda.llm.common import arrow_bytes, broadcast_if_small, filesystem
from quitanda.llm.units import UNITS, Store, UnitEncoder
from quitanda.operators.ranking import running_sum
from quitanda.session import materialize

MAGIC = b"FRQ1"
FILE_TOKENS = 2_000_000
ROWS = 300  # encoded together
FILES = 1_000_000  # whose running totals are broadcast
END_ID = 2

_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    n = len(numbers)
    v = numbers.astype("<u4")
    size = 1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-n // 4) * 4, np.uint8)
    code[:n] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    raw = v.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    end = np.cumsum(size, dtype=np.int64)
    start = end - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[start].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for b in range(1, 4):
        more = np.flatnonzero(size > b)
        if not len(more):
            break
        out[more] |= raw[start[more] + b].astype(np.uint32) << np.uint32(8 * b)
    return out


def encode_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    times = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(times)
    by_rank = used[np.lexsort((used, -times[used]))].astype("<u4")
    rank = np.zeros(len(times), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    control, data = pack(rank[ids] if len(ids) else np.zeros(0, np.uint32))
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([MAGIC, struct.pack("<IQI", len(doc_ids), len(ids), len(by_rank)), by_rank.tobytes(),
                     known.tobytes(), null.tobytes(), counts.astype("<u4").tobytes(), control, data])


def decode_file(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids)."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, n, ranks = struct.unpack_from("<IQI", blob, 4)
    at = 20

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    by_rank, known, null, counts = take("<u4", ranks), take("<i8", docs), take("u1", docs), take("<u4", docs)
    control = take("u1", -(-n // 4))
    numbers = unpack(control.tobytes(), blob[at:], n)
    return [None if z else int(d) for d, z in zip(known, null)], counts, by_rank[numbers] if n else by_rank[:0]


# --- encoding text --------------------------------------------------------------------------------

_SPECIAL = re.compile(rb"<\|")
_GAP = re.compile(rb"[ \n]")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of the parts of texts that are tokenised each on its own.

    They lie between blanks and line ends; a single stop or comma after a letter and before a gap is a
    part too, for it is a run of its own for the tokenizer.
    """
    n = len(data)
    gap = (data == 32) | (data == 10)
    opens, closes = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # a text begins, or ends before, here
    opens[bounds], closes[bounds] = True, True
    opens[1:] |= np.r_[gap]
    closes[:-1] |= gap
    stop = ((data == 46) | (data == 44)) & closes[1:] & ~opens[:-1]
    stop[1:] &= _LETTER[data[:-1]]
    if n:
        stop[0] = False
    first = ~gap & (opens[:-1] | stop)
    last = ~gap & (closes[1:] | np.r_[stop[1:], False])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class WordEncoder(UnitEncoder):
    """Encodes texts word by word, each distinct word once.

    The tokenizer drops white space and none of its pieces crosses it, so the ids of a text are those
    of its words between blanks and line ends, in order. A-Z are lower-cased as the tokenizer does. A
    text with the start of a special token is encoded whole.
    """

    def __init__(self, tokenizer, limit: int = UNITS):
        self.tokenizer = tokenizer
        super().__init__(Store(self._learn, limit), word_spans, lambda t: tokenizer.encode(t, add_special_tokens=False).ids,
                         _SPECIAL, _GAP, lower=True)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        done = [self._ids_of([w.decode() for w in words[at:at + 100]]) for at in range(0, len(words), 100)]
        return np.concatenate([ids for ids, _ in done]), np.concatenate([counts for _, counts in done])

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per word) of words encoded in one call, told apart by where each id begins.

        Words that the tokenizer would compose are encoded alone.
        """
        text = " ".join(words)
        if not is_normalized("NFC", text):
            got = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            return np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got])
        whole = self.tokenizer.encode(text, add_special_tokens=False)
        begins = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        word = np.searchsorted(begins, [a for a, _ in whole.offsets], "right") - 1
        return np.array(whole.ids, np.uint32), np.bincount(word, minlength=len(words))


_loaded: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The encoder of this Python worker; what it has learnt outlives one task."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = WordEncoder(Tokenizer.from_file(path))
    return _loaded[path]


def write_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts in order of document id; returns (file, part, seq, documents, tokens).

    Files are written under hidden names and renamed; a name depends on partition and position only.
    """
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
               .repartitionByRange(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")))

    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        encoder = encoder_of(tokenizer)
        part, seq, out = TaskContext.get().partitionId(), 0, []
        names, counts, ids, held = [], [], [], 0

        def flush():
            nonlocal seq, names, counts, ids, held
            name = f"tokens-{part:06d}-{seq:06d}.frq"
            hidden = f"{root}/_{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(hidden) as sink:
                sink.write(encode_file(names, np.concatenate(counts), np.concatenate(ids)))
            fs.move(hidden, f"{root}/{name}")
            out.append((name, part, seq, len(names), held))
            seq, names, counts, ids, held = seq + 1, [], [], [], 0

        def put(keys, texts):
            nonlocal held
            size, got = encoder.encode(texts)
            whole = np.full(len(got) + len(texts), end_id, np.uint32)  # the end id closes every document
            ends = np.cumsum(size + 1) - 1
            rest = np.ones(len(whole), bool)
            rest[ends] = False
            whole[rest] = got
            names.extend(keys)
            counts.append(size + 1)
            ids.append(whole)
            held += len(whole)
            if held >= FILE_TOKENS:
                flush()

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):  # a batch is worked off in small parts
                part_of = batch.slice(lo, ROWS)
                put(part_of.column(0).to_pylist(), arrow_bytes(part_of.column(1)))
        if names:
            flush()
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                                         ["file", "part", "seq", "documents", "tokens"])

    return ordered.mapInArrow(run, "file string, part long, seq long, documents long, tokens long")


def read_files(spark: SparkSession, folder: str, written: DataFrame, packed: bool = False) -> DataFrame:
    """(doc_id, start, ids) per document, from the files and the list of what was written.

    With ``packed`` the ids are bytes, unsigned 32-bit integers, little-endian.
    ``start`` counts the ids before the document, by a running total over one row per file.
    """
    totals = running_sum(written.select("file", "part", "seq", "tokens"), [F.col("part"), F.col("seq")], "tokens", "upto", "total", "position")
    bases = broadcast_if_small(totals.select("file", (F.col("upto") - F.col("tokens")).alias("base")), FILES)
    blobs = (spark.read.format("binaryFile").load(f"{folder}/*.frq")
             .select(F.substring_index("path", "/", -1).alias("file"), "content"))

    def run(batches):
        for batch in batches:
            for base, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, counts, ids = decode_file(blob.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                for lo in range(0, len(names), 1000):
                    hi = min(lo + 1000, len(names))
                    first = int(ends[lo] - counts[lo])
                    offsets, some = (np.r_[first, ends[lo:hi]] - first).astype(np.int32), np.ascontiguousarray(ids[first:ends[hi - 1]], "<u4")
                    if packed:
                        held = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets * 4), pa.py_buffer(some)])
                    else:
                        held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(some.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[lo:hi], pa.int64()), pa.array(base + ends[lo:hi] - counts[lo:hi], pa.int64()), held],
                        ["doc_id", "start", "ids"])

    return blobs.join(bases, "file").select("base", "content").mapInArrow(
        run, "doc_id long, start long, ids " + ("binary" if packed else "array<int>"))


def digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of packed ``read_files`` rows."""
    return tokens.select("doc_id", "start", F.floor(F.length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                packed: bool = False) -> DataFrame:
    """Write ``docs`` as token files under ``folder`` and read them back: (doc_id, start, ids).

    Documents follow in ascending id, nulls last, rows with one id by the hash of their text. Null
    texts count as empty: the end id alone. Long texts are encoded whole. Repeated rows are written
    each; other columns are ignored; an empty table writes no file and gives no rows.
    """
    spark = docs.sparkSession
    written = materialize(write_files(docs, folder, tokenizer, id_col, text_col), "token-files")
    if written.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, ids " + ("binary" if packed else "array<int>"))
    return read_files(spark, folder, written, packed)
