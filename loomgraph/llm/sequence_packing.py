"""Token ids packed into fixed-length sequences by best-fit decreasing.

Texts are encoded with a public byte-level BPE vocabulary (a parameter), an
end-of-text id is appended, and what is longer than a sequence is split into
pieces, so no token is lost. Pieces are packed within blocks of about
``BLOCK`` tokens: longest first, each into the fullest open sequence that still
has room. The open sequences are counted by free space in a segment tree, in
which the least sufficient space is found in log2(length) steps.

Packing runs inside the input splits, so ids are never shuffled; a block holds
thousands of sequences, which leaves little room unused (a split smaller than
a block ends with a few part-filled sequences of its own).

``write_packed`` stores sequences as matrices of ids and of positions, each a
plain binary file of fixed-length rows, with an Arrow file of what else a
trainer needs of each row; ``read_packed`` reads them back, and ``rows_of``
maps one file's matrices into memory.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.scratch import fresh_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH, END_ID, BLOCK, CACHE = 2048, 50256, 1 << 22, 1 << 19
PACKED = "pack_id bigint, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<bigint>, pieces array<int>"


def read_vocabulary(path: str) -> bytes:
    """The file's bytes: read once by the driver and sent to the tasks, which need no copy of the file."""
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Exact encoding of Arrow text, word by word through a bounded cache.

    The pattern never joins characters across a space that follows a
    non-space, so a text without double spaces is encoded as its words (each
    with the space before it); other texts are encoded directly.
    """

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ids = set(ranks.values())
        self.wide = max(self.ids) >= 1 << 16
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """The ids of a word, as int32: one small object a word, and parts join without a loop."""
        ids = self.known.get(word)
        if ids is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            ids = self.known[word] = np.array(self.encoding.encode_ordinary(word), np.int32).tobytes()
        return ids

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, each row's first id and the end); null rows have none."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        n = len(column)
        direct = pc.match_substring(column, "  ").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(direct), "", column), " ")
        words = split.flatten().dictionary_encode()
        codes = words.indices.to_numpy()
        begin = split.offsets.to_numpy().astype(np.int64)
        begin, codes = begin - begin[0], codes
        uniques = words.dictionary.to_pylist()
        tokens = [self._word(" " + w) for w in uniques]
        head = codes[begin[:-1]]  # a row's first word has no space before it
        heads, head_of = np.unique(head, return_inverse=True)
        tokens += [np.array(self.encoding.encode_ordinary(uniques[h]), np.int32).tobytes() for h in heads]
        codes = codes.copy()
        codes[begin[:-1]] = len(uniques) + head_of
        size = np.array([len(t) for t in tokens], np.int64) // 4
        first = np.concatenate(([0], np.cumsum(size)))
        flat = np.frombuffer(b"".join(tokens), np.int32)
        per_word = size[codes]
        ends = np.cumsum(per_word)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[codes] - (ends - per_word), per_word)]
        bounds = np.concatenate(([0], ends))[begin]
        if not direct.any():
            return ids, bounds
        parts = [np.array(self.encoding.encode_ordinary(column[i].as_py()), np.int32) if direct[i] else ids[bounds[i] : bounds[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


class FreeSpace:
    """How many open sequences have each free space, as a segment tree over 0..length."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, space: int, n: int) -> None:
        i = self.leaves + space
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, need: int) -> int:
        """The least free space of an open sequence that is at least ``need``, or -1."""
        count, i = self.count, self.leaves + need
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:  # the right sibling holds larger spaces only
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> list[list[int]]:
    """Indices of the pieces in each sequence; every size is 1..length.

    Pieces of a size are taken in the order given, and of sequences with equal
    room the one that got it last is filled, so the result is determined.
    """
    tree, open_by_space, bins = FreeSpace(length), {}, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        space = tree.least(size) if size < length else -1
        if space < 0:
            bins.append([i])
            b, left = len(bins) - 1, length - size
        else:
            b = open_by_space[space].pop()
            tree.add(space, -1)
            bins[b].append(i)
            left = space - size
        if left:
            open_by_space.setdefault(left, []).append(b)
            tree.add(left, 1)
    return bins


KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
NAMES = [c.strip().split(" ")[0] for c in PACKED.split(", ")]
Batches = Iterator[pa.RecordBatch]


def rows_as_binary(matrix: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    raw = np.ascontiguousarray(matrix)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1] * raw.itemsize), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary())


def sequences(bins: list[list[int]], ids: list[np.ndarray], of: list[tuple[int | None, int]], number: int, length: int, end_id: int, kind: np.dtype) -> pa.RecordBatch:
    """The rows of some sequences, given as indices of pieces; ``number`` is the first one's name."""
    members = [i for row in bins for i in row]
    sizes = np.array([len(ids[i]) for i in members], np.int64)
    n_pieces = np.array([len(row) for row in bins], np.int64)
    last = np.cumsum(n_pieces)
    ends = np.cumsum(sizes)
    totals = np.diff(np.concatenate(([0], ends[last - 1])))
    used = np.arange(length) < totals[:, None]
    matrix = np.full((len(bins), length), end_id, kind)
    matrix[used] = np.concatenate([ids[i] for i in members])
    position = np.zeros((len(bins), length), np.dtype("<i4"))
    position[used] = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    row_start = np.repeat(ends[last - 1] - totals, n_pieces)
    bounds = np.insert(ends - row_start, last - n_pieces, 0)  # a 0 before each row's first end
    offsets = np.concatenate(([0], last))

    def lists(values: pa.Array, at: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)

    cols = [
        pa.array(np.arange(number, number + len(bins))),
        pa.array(totals, pa.int32()),
        rows_as_binary(matrix),
        rows_as_binary(position),
        lists(pa.array(bounds, pa.int32()), offsets + np.arange(len(bins) + 1)),
        lists(pa.array([of[i][0] for i in members], pa.int64()), offsets),
        lists(pa.array([of[i][1] for i in members], pa.int32()), offsets),
    ]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, KINDS)], names=NAMES)


def packer(vocabulary: str, length: int, end_id: int, block: int) -> Callable[[Batches], Batches]:
    """What packs the (doc_id, text) batches of one task."""
    if length < 1 or length > 1 << 20:
        raise ValueError("length must be from 1 to 2**20")
    raw = read_vocabulary(vocabulary)
    if end_id < 0 or any(int(line.split()[1]) == end_id for line in raw.splitlines() if line):
        raise ValueError(f"id {end_id} stands for text in this vocabulary: it can't end documents")

    def run(batches: Batches) -> Batches:
        encoder = Encoder(raw)
        kind = np.dtype("<i4") if encoder.wide or end_id >= 1 << 16 else np.dtype("<u2")
        number = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []  # pieces of the block
        of: list[tuple[int | None, int]] = []
        held = 0
        rows = max(1, (1 << 20) // length)  # of a batch that leaves

        def flush() -> Batches:
            nonlocal held, number
            bins = best_fit_decreasing(np.array([len(p) for p in ids], np.int64), length)
            for at in range(0, len(bins), rows):
                some = bins[at : at + rows]
                yield sequences(some, ids, of, number, length, end_id, kind)
                number += len(some)
            ids.clear()
            of.clear()
            held = 0

        for batch in batches:
            step = 1000
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                names = part.column(0).to_pylist()
                flat, bounds = encoder.encode(part.column(1))
                for i, name in enumerate(names):
                    if bounds[i] == bounds[i + 1]:
                        continue
                    whole = np.append(flat[bounds[i] : bounds[i + 1]], end_id).astype(kind)
                    for nth, at in enumerate(range(0, len(whole), length)):
                        ids.append(whole[at : at + length])
                        of.append((name, nth))
                    held += len(whole)
                    if held >= block:
                        yield from flush()
        if ids:
            yield from flush()

    return run


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Packed sequences, one row each.

    ``input_ids``: ``length`` little-endian ids (uint16; int32 if an id needs
    it), padded with ``end_id`` behind ``n_tokens``. ``position_ids``: int32,
    0 at each piece's start and in the padding. ``cu_seqlens``: piece bounds,
    from 0 to ``n_tokens``. ``doc_ids``, ``pieces``: of each piece its document
    and its number there, from 0. ``pack_id``: split * 2**32 + number in it.

    Null and empty texts have no pieces; any other row does, also one without
    an id or one that repeats another. An empty table gives no rows. Other
    columns are not read.
    """
    return id_and_text(docs).mapInArrow(packer(vocabulary, length, end_id, block), PACKED)


DTYPE = {2: "<u2", 4: "<i4"}
INDEX = pa.schema([("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32()))])


PART = "part string, n bigint, width int"


def writer(folder: str, length: int) -> Callable[[Batches], Batches]:
    """What writes one task's sequences as a part, and reports it."""
    positions = "<u2" if length <= 1 << 16 else "<i4"

    def run(batches: Batches) -> Batches:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        name, rows, width, files = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, 0, []
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if not files:
                    files = [fs.open_output_stream(f"{root}/{name}.{kind}", compression=None) for kind in ("ids.bin", "pos.bin", "arrow")]
                    index = pa.ipc.new_file(files[2], INDEX)
                for value in batch.column("input_ids"):
                    files[0].write(value.as_buffer())
                for value in batch.column("position_ids"):
                    files[1].write(np.frombuffer(value.as_buffer(), "<i4").astype(positions).tobytes())
                width = len(batch.column("input_ids")[0].as_buffer()) // length
                index.write_batch(pa.RecordBatch.from_arrays([batch.column(c).cast(INDEX.field(c).type) for c in INDEX.names], schema=INDEX))
                rows += batch.num_rows
            if files:
                index.close()
        finally:
            for f in files:
                f.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64()), pa.array([width], pa.int32())], names=["part", "n", "width"])

    return run


def list_parts(written: DataFrame, folder: str, length: int) -> list[str]:
    """Run the writing tasks and write the manifest of the parts that they report."""
    parts = sorted((r["part"], r["n"], r["width"]) for r in written.collect())  # one row a task
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    position_bytes = 2 if length <= 1 << 16 else 4
    with fs.open_output_stream(f"{root}/manifest.json", compression=None) as f:
        f.write(json.dumps({"length": length, "parts": [{"name": p, "rows": n, "id_bytes": w, "position_bytes": position_bytes} for p, n, w in parts]}).encode())
    return [p[0] for p in parts]


def write_packed(packed: DataFrame, folder: str, length: int = LENGTH) -> list[str]:
    """Write sequences to a shared folder; the names of the parts that belong to the data set.

    A part is three files: ``.ids.bin`` and ``.pos.bin``, rows of ``length``
    little-endian numbers without any header (positions are uint16 up to a
    length of 65,536, int32 beyond), and ``.arrow``, an Arrow file
    whose row i (pack_id, n_tokens, cu_seqlens, doc_ids, pieces) describes
    their row i. A task writes under a name of its own attempt and reports it
    when its files are whole, and the driver lists the reported parts in
    ``manifest.json``; what a lost attempt left is in no list. An empty table
    has a manifest without parts.
    """
    return list_parts(packed.select("input_ids", "position_ids", *INDEX.names).mapInArrow(writer(folder, length), PART), folder, length)


def pack_to_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, length: int = LENGTH, end_id: int = END_ID, block: int = BLOCK) -> list[str]:
    """``write_packed`` of ``pack``, in one pass of one Python worker a task: sequences go from the packer to the files."""
    packing, writing = packer(vocabulary, length, end_id, block), writer(folder, length)
    return list_parts(id_and_text(docs).mapInArrow(lambda batches: writing(packing(batches)), PART), folder, length)


def manifest(folder: str) -> dict:
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/manifest.json", compression=None) as f:
        return json.loads(f.read())


def rows_of(folder: str, part: dict, length: int) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """(ids, positions, index) of one part of a manifest: matrices of a row a sequence."""
    fs, root = pafs.FileSystem.from_uri(folder)
    found = []
    for kind, size, dtype in (("ids", part["id_bytes"], DTYPE[part["id_bytes"]]), ("pos", part["position_bytes"], DTYPE[part["position_bytes"]])):
        with fs.open_input_file(f"{root}/{part['name']}.{kind}.bin") as f:
            raw = f.read()
        if len(raw) != part["rows"] * length * size:
            raise ValueError(f"{part['name']}.{kind}.bin has {len(raw)} bytes")
        found.append(np.frombuffer(raw, dtype).reshape(-1, length))
    with fs.open_input_file(f"{root}/{part['name']}.arrow") as f:
        return *found, pa.ipc.open_file(f).read_all()


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The sequences of a data set, as ``pack`` returned them; parts are read by the tasks, some rows at a time."""
    found = manifest(folder)
    length = found["length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in map(json.loads, batch.column(0).to_pylist()):
                with fs.open_input_file(f"{root}/{part['name']}.ids.bin") as ids, fs.open_input_file(f"{root}/{part['name']}.pos.bin") as pos, fs.open_input_file(f"{root}/{part['name']}.arrow") as f:
                    index = pa.ipc.open_file(f)
                    for i in range(index.num_record_batches):
                        rows = index.get_batch(i)
                        matrices = []
                        for source, size in ((ids, part["id_bytes"] * length), (pos, part["position_bytes"] * length)):
                            raw = source.read(size * rows.num_rows)
                            if len(raw) < size * rows.num_rows:
                                raise ValueError(f"{part['name']} is cut short")
                            if source is pos:
                                raw, size = np.frombuffer(raw, DTYPE[part["position_bytes"]]).astype("<i4").tobytes(), 4 * length
                            matrices.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), rows.num_rows, [None, pa.py_buffer(raw)]).cast(pa.binary()))
                        cols = {"input_ids": matrices[0], "position_ids": matrices[1], **{c: rows.column(c) for c in INDEX.names}}
                        yield pa.RecordBatch.from_arrays([cols[n] for n in NAMES], names=NAMES)

    parts = spark.createDataFrame([(json.dumps(p),) for p in found["parts"]], "part string")
    return parts.repartition(max(1, len(found["parts"]))).mapInArrow(run, PACKED)


def op8_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed, written as binary matrices to the shared folder and read back."""
    folder = fresh_path(spark, "packed")
    pack_to_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_packed(spark, folder)
