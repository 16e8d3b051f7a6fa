"""Token ids of whole texts in files of fixed-width packed numbers.

Every id takes the fewest bits that hold the largest id of the vocabulary. A file is::

    16 bytes   magic "RLIDS1", version of the layout, bits of an id, ids of a block (u32), 4 zeros
    40 bytes   partition, ids before the file in its partition, documents, ids, blocks (u64 each)
    documents  their ids (i64), a byte each that is 1 for a null id, ids before each in the file (u64, one more)
    blocks     offset of each block from the start of the file (u64, one more), then the blocks

All numbers are little-endian; the first id of a block starts in its lowest bit. Blocks begin at whole
bytes, so any range of ids is read from its own blocks alone, and numpy unpacks a range at once.

Documents lie in ascending order of their id over the files in order of (partition, ids before). Spark
ranges them by id, and by a digest of the text and a number of the row among equal ids, so that an id that many rows
share is dealt over many tasks; every task encodes its range and writes files of ``FILE_IDS`` ids
or one larger document. What comes before a partition is a sum over one row for each partition.

Null texts are empty and hold the end id alone. A null doc_id comes first and reads back as null.
Rows that repeat are written each. A text is held whole by one task. Other columns of the table are
ignored, whatever their names. An empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from relaylens.llm.common import written
from relaylens.session import scratch_path

MAGIC, LAYOUT = b"RLIDS1", 1
HEAD, COUNTS = "<6sBBII", "<5Q"
HEAD_BYTES, COUNTS_BYTES = struct.calcsize(HEAD), struct.calcsize(COUNTS)
BLOCK_IDS = 4096
FILE_IDS = 1 << 21
TASK_BYTES, LEAST_BYTES = 128 << 20, 4 << 20  # text of a task on large and on small tables
KEPT_CHUNKS = 400_000  # entries of each of the two tables of chunks that a worker keeps
JOINED = 200  # words encoded in one call
PLACES = "part long, doc_id long, start long, n_tokens long, ids_crc32 long"


def bits_for(size: int) -> int:
    """The fewest bits that hold every id below ``size``."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, ``bits`` each, from the lowest bit of the first byte on."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    single = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(single[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, lo: int, hi: int) -> np.ndarray:
    """The ids from ``lo`` to before ``hi`` of packed bytes."""
    if bits in (8, 16, 32):
        width = bits // 8
        return np.frombuffer(data, f"<u{width}", hi - lo, lo * width).astype("<u4")
    at = np.arange(lo, hi, dtype=np.int64) * bits
    padded = np.frombuffer(bytes(data) + bytes(8), np.uint8)
    window = np.zeros(hi - lo, np.uint64)
    for k in range((bits + 14) // 8):  # the bytes that an id can touch
        window |= padded[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((window >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


def packed_file(part: int, before: int, doc_ids: list[int | None], lengths: list[int],
                ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    """The bytes of a file of documents with these ids one after the other."""
    blocks = [pack(ids[k:k + block], bits) for k in range(0, len(ids), block)]
    table = b"".join([
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        bytes(d is None for d in doc_ids),
        np.cumsum([0, *lengths], dtype="<u8").tobytes()])
    first = HEAD_BYTES + COUNTS_BYTES + len(table) + 8 * (len(blocks) + 1)
    offsets = first + np.cumsum([0, *map(len, blocks)], dtype="<u8")
    return b"".join([struct.pack(HEAD, MAGIC, LAYOUT, bits, block, 0),
                     struct.pack(COUNTS, part, before, len(doc_ids), len(ids), len(blocks)),
                     table, offsets.astype("<u8").tobytes(), *blocks])


class PackedFile:
    """A file that was read: its documents, and any range of its ids."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, layout, self.bits, self.block, _ = struct.unpack_from(HEAD, data, 0)
        if magic != MAGIC or layout != LAYOUT:
            raise ValueError("not a file of packed ids")
        self.part, self.before, docs, self.n_ids, blocks = struct.unpack_from(
            COUNTS, data, HEAD_BYTES)
        at = HEAD_BYTES + COUNTS_BYTES
        values = np.frombuffer(data, "<i8", docs, at)
        nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if none else int(d) for d, none in zip(values, nulls)]
        self.starts = np.frombuffer(data, "<u8", docs + 1, at + 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at + 17 * docs + 8).astype(np.int64)
        if len(data) < self.offsets[-1]:
            raise ValueError("a file of packed ids is cut off")

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """The ids from ``lo`` to before ``hi`` of the file; only their blocks are touched."""
        parts = []
        for k in range(lo // self.block, -(-hi // self.block) if hi > lo else 0):
            first = k * self.block
            block = self.data[self.offsets[k]:self.offsets[k + 1]]
            parts.append(unpack(block, self.bits, max(lo - first, 0),
                                min(hi - first, self.block)))
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class Encoder:
    """The library's ids of whole texts, a chunk between blanks or line feeds at a time.

    The library drops white space and cuts there before it merges, so chunks can be encoded one by
    one and remembered. Where a chunk is letters with signs behind them it is cut in two: the library
    ends a run of letters there, and a run of signs begins. The chunks of a batch are found by
    Arrow, each once. Words of letters are encoded many at a time, each up to its token
    with the end mark; if these do not come out one a word, each word is encoded alone.
    """

    #: Letters with signs behind, at the end of a chunk; none of these signs begins a contraction
    #: or ends a special token that letters can begin.
    TAIL = r"(\p{L})([.,!?;:&#$%*]+)( |$)"

    def __init__(self, serialized: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = tokenizers.Tokenizer.from_str(serialized)
        self.size = self.library.get_vocab_size()
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = np.array([bool(suffix) and (self.library.id_to_token(i) or "").endswith(suffix)
                              for i in range(self.size)])
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def many(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(
            texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters."""
        groups = [words[k:k + JOINED] for k in range(0, len(words), JOINED)]
        out: list[bytes] = []
        for group, joined in zip(groups, self.many([" ".join(g) for g in groups])):
            cuts = (4 * np.flatnonzero(self.ends[np.frombuffer(joined, "<u4")]) + 4).tolist()
            if len(cuts) == len(group) and cuts[-1] == len(joined):
                out += [joined[lo:hi] for lo, hi in zip([0, *cuts], cuts)]
            else:
                out += self.many(group)
        return out

    def known(self, chunks: list[str]) -> list[bytes]:
        """The ids of different chunks; those used of late are kept."""
        if len(self.chunks) > KEPT_CHUNKS:
            self.older, self.chunks = self.chunks, {}
        found = list(map(self.chunks.get, chunks))
        new = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(new, list(map(self.older.get, [chunks[k] for k in new]))):
            found[k] = ids
        new = [k for k in new if found[k] is None]
        letters = [k for k in new if chunks[k].isalpha()]
        others = [k for k in new if not chunks[k].isalpha()]
        for places, ids_of_all in ((letters, self.words), (others, self.many)):
            for k, ids in zip(places, ids_of_all([chunks[k] for k in places])):
                found[k] = ids
        self.chunks.update(zip(chunks, found))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        cut = pc.split_pattern(pc.replace_substring_regex(texts, self.TAIL, r"\1 \2\3"), " ")
        chunks = cut.flatten().dictionary_encode()
        found = self.known(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = chunks.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, own = np.frombuffer(b"".join(found), "<u4"), sizes[which]
        ends = np.concatenate([[0], np.cumsum(own)])
        begin = (np.cumsum(sizes) - sizes)[which] - ends[:-1]
        ids = flat[np.repeat(begin, own) + np.arange(ends[-1])]
        return ids, np.diff(ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()])


class _Shared:
    """A vocabulary's text that becomes an encoder where it is used, once a worker."""

    def __init__(self, serialized: str):
        self.serialized = serialized

    def encoder(self) -> Encoder:
        made = self.__dict__.get("_encoder")
        if made is None:
            made = self.__dict__["_encoder"] = Encoder(self.serialized)
        return made

    def __getstate__(self):
        return {"serialized": self.serialized}


def tasks_for(docs: DataFrame) -> int:
    """Tasks by the bytes of all texts: large ones, but enough for the cores of a small table."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return 1 + max(total // TASK_BYTES, min(total // LEAST_BYTES, 3 * cores))


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Writes the ids of (doc_id, text), each document with ``end_id`` behind, to files below
    a path in ascending order of doc_id."""
    with open(vocabulary, encoding="utf-8") as file:
        shared = _Shared(file.read())
    bits = bits_for(max(shared.encoder().size, end_id + 1))
    model = docs.sparkSession.sparkContext.broadcast(shared)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        F.xxhash64("text").alias("mark"),
                        F.monotonically_increasing_id().alias("row"))
    ranged = keyed.repartitionByRange(tasks_for(docs), "doc_id", "mark", "row").sortWithinPartitions(
        "doc_id", "mark", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = model.value.encoder(), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        lengths: list[int] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, sizes = encoder.encode(batch.column(1).slice(at, 1000))
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                sizes, done = sizes + 1, 0
                doc_ids += batch.column(0).slice(at, 1000).to_pylist()
                for size in sizes.tolist():
                    lengths.append(size)
                    held += size
                    if held >= FILE_IDS:  # the documents up to here become a file
                        upto = done + held - sum(map(len, parts))
                        parts.append(ids[done:upto])
                        yield file(part, before, doc_ids[:len(lengths)], lengths, parts)
                        before += held
                        doc_ids, lengths, parts = doc_ids[len(lengths):], [], []
                        held, done = 0, upto
                parts.append(ids[done:])
        if doc_ids:
            yield file(part, before, doc_ids, lengths, parts)

    def file(part: int, before: int, doc_ids: list, lengths: list, parts: list) -> pa.RecordBatch:
        data = packed_file(part, before, doc_ids, lengths, np.concatenate(parts), bits)
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

    # A row is a file; the writer's line feed behind it is not part of the layout.
    ranged.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option(
        "lineSep", "\n").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.txt").load(path).filter("length > 0").select("content")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Of each document in the files below a path: doc_id, the number of ids before it over all files,
    the number of its ids and their CRC-32 as 32-bit numbers."""
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PLACES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = PackedFile(content.as_py())
                n = len(file.doc_ids)
                ids = memoryview(file.ids(0, file.n_ids)).cast("B")
                sums = [zlib.crc32(ids[4 * lo:4 * hi]) for lo, hi in
                        zip(file.starts[:-1].tolist(), file.starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (
                        np.full(n, file.part), file.doc_ids, file.before + file.starts[:-1],
                        np.diff(file.starts), sums)], schema=schema)

    local = written(_files(spark, path).mapInArrow(run, PLACES), "id-places")
    sums = local.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n"))
    before, rows = 0, []
    for part, n in sorted(map(tuple, sums.collect())):  # a row for each task that wrote
        rows.append((part, before))
        before += n
    starts = spark.createDataFrame(rows, "part long, before long")
    return local.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def ids_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents whose doc_id is in ``wanted``: the tables of the files say
    where each lies, and only its own blocks are unpacked."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
    places = pa.schema([("path", pa.string()), ("k", pa.int64()), ("doc_id", pa.int64())])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.txt").load(path).filter("length > 0").select("path", "content")

    def tables(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                own = PackedFile(content.as_py()).doc_ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(own)), pa.array(range(len(own)), pa.int64()),
                     pa.array(own, pa.int64())], schema=places)

    def chosen(batches):
        for batch in batches:
            for content, ks in zip(batch.column(0), batch.column(1).to_pylist()):
                file = PackedFile(content.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.doc_ids[k] for k in ks], pa.int64()),
                     pa.array([file.document(k).tolist() for k in ks], pa.list_(pa.int64()))],
                    schema=schema)

    found = files.mapInArrow(tables, "path string, k long, doc_id long").join(
        wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    places_of_file = found.groupBy("path").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    return files.join(places_of_file, "path").select("content", "ks").mapInArrow(
        chosen, "doc_id long, ids array<long>")


def through_files(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Ids of (doc_id, text) written to files in the shared folder and read back, a row each."""
    spark = docs.sparkSession
    path = scratch_path(spark, "llm-ids")
    write_ids(docs, path, vocabulary, end_id)
    return read_places(spark, path)
