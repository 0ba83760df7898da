"""Token ids in files of canonical, length-limited Huffman codes.

Texts are encoded once, into a table in the shared folder. Counts of ids over the whole corpus are summed by Spark; a count
an id of the vocabulary reaches the driver, where package-merge makes code lengths of at most `max_bits` bits, and codes
follow from lengths alone. Documents are dealt by ranges of doc_id and sorted, and each task writes files of its own name:

    header    MAGIC, alphabet, max_bits, length of the next part; code lengths a byte an id, by zlib
    blocks    number of ids, of checkpoints and of bytes; bit offset of every EVERY-th id; the codes' bits, first bit highest
    documents null flags, doc_ids, first ids (from the file's start), one array each
    index     each block's place and first id, one array each
    footer    places of documents and index, numbers of documents, blocks and ids, CRC-32 of documents and index, MAGIC

A block holds BLOCK ids (the last fewer) and needs nothing but the lengths to be read. The decoder looks max_bits bits up in
a table and goes from all checkpoints of several blocks at once, a numpy step an id of each. A file's place in the sequence
is the sum of ids before it, from the manifest, which names only files of finished tasks: a task that is run again leaves
no second copy. A reader takes a run of blocks and owns the documents that begin in it, so large files are read by many tasks.

Defined results: a null or empty text has the end id alone; documents are in ascending order of doc_id, null first, equal ids by
a hash of their ids; repeated rows are written each; an alphabet of one id has codes of one bit; an empty table has no file;
very long texts are taken whole, in chunks as others are; control strings in a text are what the tokenizer makes of them by default (one
id), or ordinary text with `specials_as_text`; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .util import own, shared_dir, stored, trim
from .warc import _file_system

MAGIC = b"TIDHUF1\n"
HEADER, BLOCK_HEAD, FOOTER = struct.Struct("<8sIII"), struct.Struct("<III"), struct.Struct("<QQQQQI8s")
#: Ids of a block, and between two checkpoints of it.
BLOCK, EVERY = 1 << 17, 512
#: Ids and documents after which a task begins its next file.
FILE_IDS, FILE_DOCS = 64 << 20, 1 << 20
#: Blocks that a reader takes at once, and that one task reads.
AT_ONCE, RUN = 16, 64
#: Signs of text that a task encodes at once, and chunks whose ids a worker keeps.
SIGNS, KEPT = 1 << 19, 800_000
_SEAM = re.compile(r"(?<=\S)(?=[ \n])|(?<=[^\W_])(?=[,.])")
_LATE = re.compile(r"(?<![^\W_])[,.]")


def chunks_of(text: str) -> list[str]:
    """The text cut before each space or line break after a sign that isn't white space, and before a comma or dot after a letter or digit.

    No rule of byte-level tokenizers goes on over such a place, and what white space becomes depends on itself and the sign
    after it, which are in one chunk, so the ids of the chunks are together those of the text. A chunk " word" is written
    "word", one that begins with a line break, comma or dot as it is, and any other with a space before it.
    """
    single = text[0] == "\n" and "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text and text.replace("\n", "").isprintable()
    if single and not text[-1].isspace() and not _LATE.search(text):  # no white space but spaces and line breaks, each alone
        return text.replace("\n", " \n").replace(",", " ,").replace(".", " .").split(" ")[1:]
    return [c if c[0] in "\n,." else c[1:] if c[0] == " " and c[1:2].strip(" \n,.") else " " + c for c in _SEAM.split(text)]


def _text_of(chunk: str) -> str:
    return chunk if chunk[0] in "\n,." else chunk[1:] if chunk[0] == " " else " " + chunk


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by the tokenizers library, which is asked once for each chunk that the worker doesn't know yet.

    Words go to the library's model, other chunks through all of its steps. A tokenizer that isn't byte-level BPE alone gets whole texts.
    """

    def __init__(self, tokenizer: str, specials_as_text: bool):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer)
        self.tok.encode_special_tokens, self.model = specials_as_text, self.tok.model
        steps = json.loads(self.tok.to_str())
        before = steps["pre_tokenizer"] or {}
        self.whole = bool(steps["normalizer"] or steps["post_processor"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or steps["model"].get("dropout"))
        self.signs = _byte_signs()
        self.line, self.space = self.ids("\n"), self.signs[32]
        self.whole |= len(self.line) != 1
        self.forget()

    def forget(self) -> None:
        """Begin anew; chunks of the last round are still known, so those that come often stay."""
        self.last = getattr(self, "known", {}), getattr(self, "flat", array("I")), getattr(self, "ends", array("q", [0]))
        self.known: dict[str, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def learn(self, chunk: str) -> int:
        word, flat = chunk[1:] if chunk[0] == "\n" else chunk, self.flat
        known, last, ends = self.last
        if (k := known.get(chunk)) is not None:
            flat.extend(last[ends[k] : ends[k + 1]])
        # letters of these scripts are letters to every version of Unicode
        elif word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            signs = word if word.isascii() else word.encode().decode("latin-1").translate(self.signs)
            if word is chunk:
                signs = self.space + signs
            else:
                flat.append(self.line[0])
            flat.extend([t.id for t in self.model.tokenize(signs)])
        else:
            flat.extend(self.ids(_text_of(chunk)))
        self.known[chunk] = place = len(self.ends) - 1
        self.ends.append(len(flat))
        return place

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.whole:
            return [np.array(self.ids(t), np.uint32) for t in texts]
        if len(self.known) > KEPT:
            self.forget()
        # a line break before a text that begins with a sign makes its first chunk like others; its one id is left out again
        led = [bool(t) and not t[0].isspace() for t in texts]
        every, sizes = [], [0]
        for t, by in zip(texts, led, strict=True):
            if t:
                every += chunks_of("\n" + t if by else t)
            sizes.append(len(every))
        at = list(map(self.known.get, every))
        for i in [i for i, k in enumerate(at) if k is None]:
            k = self.known.get(every[i])
            at[i] = self.learn(every[i]) if k is None else k
        flat, ends = np.array(self.flat, np.uint32, copy=True) if not self.flat else np.frombuffer(self.flat, np.uint32), np.frombuffer(self.ends, np.int64)
        at = np.array(at, np.int64)
        starts = ends[at]
        lengths = ends[at + 1] - starts
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(starts - upto[:-1], lengths) + np.arange(upto[-1])]
        del flat, ends  # else the arrays couldn't grow
        bounds = upto[sizes]
        return [ids[a + by : b] for a, b, by in zip(bounds[:-1], bounds[1:], led, strict=True)]


@lru_cache(maxsize=1)
def encoder(tokenizer: str, specials_as_text: bool) -> Encoder:
    """One a worker: reading the vocabulary takes longer than a short task, and chunks stay known."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(tokenizer, specials_as_text)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 0, specials_as_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, ids, tie) of every document, and (id, n) of every task; ids are a document's ids and the end id, packed and by zstd.

    Both are written to the shared folder by one pass; a task's counts are a row of their own.
    """
    shared_dir(docs.sparkSession)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, zstd, end, far = encoder(tokenizer, specials_as_text), pa.Codec("zstd", 1), np.array([end_id], np.uint32), np.zeros(1, np.int64)

        def rows_of(doc_ids: list, n: list, ids: list, ties: list, counts: bytes | None = None) -> pa.RecordBatch:
            cols = [pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(ties, pa.int64()), pa.array([counts] * len(n), pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "ids", "tie", "counts"])

        def made(doc_ids: list, texts: list[str]) -> pa.RecordBatch:
            nonlocal far
            rows = [np.concatenate([x, end]) for x in known.encode(texts)]
            here = np.bincount(np.concatenate(rows), minlength=len(far))
            here[: len(far)] += far
            far = here
            raw = [_packed_ids(x) for x in rows]
            return rows_of(doc_ids, [len(x) for x in rows], [_stored_ids(x, zstd) for x in raw], [zlib.crc32(x) for x in raw])

        for b in it:
            doc_ids, texts, signs = [], [], 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids.append(d)
                texts.append(t.as_py() or "")
                signs += len(texts[-1])
                if signs >= SIGNS:
                    yield made(doc_ids, texts)
                    doc_ids, texts, signs = [], [], 0
            if texts:
                yield made(doc_ids, texts)
        (at,) = far.nonzero()
        if len(at):
            yield rows_of([None], [len(at)], [None], [None], np.concatenate([at, far[at]]).astype("<i8").tobytes())
        trim()

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for data in b.column(0):
                pairs = np.frombuffer(data.as_buffer(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["id", "n"])

    rows = own(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    every = stored(rows.mapInArrow(encode, "doc_id long, n long, ids binary, tie long, counts binary"), "ids", "uncompressed")
    return every.where("counts is null").drop("counts"), every.where("counts is not null").select("counts").mapInArrow(counted, "id long, n long")


def _packed_ids(ids: np.ndarray) -> bytes:
    """The width of a number in bytes, 2 or 4, and the ids."""
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def _stored_ids(raw: bytes, zstd: pa.Codec) -> bytes:
    """The width by itself, and the rest compressed."""
    return raw[:1] + zstd.compress(raw[1:], asbytes=True)


def _unpacked_ids(data: pa.Buffer, n: int) -> np.ndarray:
    width = data[0]
    return np.frombuffer(pa.Codec("zstd").decompress(data.slice(1), width * n), f"<u{width}")


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Bits of each id's code, 0 for ids that don't occur: the cheapest prefix code of at most max_bits bits, by package-merge."""
    (used,) = counts.nonzero()
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids have no code of {max_bits} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    packages, chosen = np.zeros(0, np.int64), []
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        chosen.append(order < len(weights))
        merged = merged[order]
        pairs = len(merged) // 2
        packages = merged[: 2 * pairs : 2] + merged[1 : 2 * pairs : 2]
    take, far = 2 * len(used) - 2, np.zeros(len(used), np.uint8)
    for leaf in reversed(chosen):  # of what is taken here, each id's coin is one bit more, and each package is two coins of the level below
        ids = int(leaf[:take].sum())
        far[:ids] += 1
        take = 2 * (take - ids)
    lengths[used] = far
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each id, and the ids in the order of their codes: by length, then by id."""
    (used,) = lengths.nonzero()
    used = used[np.argsort(lengths[used], kind="stable")]
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    by_length = np.bincount(lengths[used], minlength=1)
    at = 0
    for bits in range(1, len(by_length)):
        code <<= bits - last
        last, n = bits, int(by_length[bits])
        codes[used[at : at + n]] = np.arange(code, code + n, dtype=np.uint64)
        code, at = code + n, at + n
    return codes, used


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes' bits one after the other, and the bit at which every EVERY-th id begins."""
    bits = lengths[ids].astype(np.int64)
    end = np.cumsum(bits)
    at = end - bits
    word, left = at >> 6, 64 - (at & 63) - bits  # bits that stay free in a code's word; if negative, so many go to the next word
    (over,) = (left < 0).nonzero()
    value = codes[ids]
    out = np.zeros(int(end[-1] + 63 >> 6) + 1, np.uint64)
    out[word[over] + 1] = value[over] << (64 + left[over]).astype(np.uint64)  # one code at most ends in a word that it doesn't begin
    value[over] >>= (-left[over]).astype(np.uint64)
    value <<= np.maximum(left, 0).astype(np.uint64)
    first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
    out[word[first]] += np.add.reduceat(value, first)  # the bits of different codes never overlap
    return out.astype(">u8").tobytes()[: int(end[-1] + 7 >> 3)], at[::EVERY].astype("<u4")


class Decoder:
    """Table-driven: the next max_bits bits name an id and the length of its code."""

    def __init__(self, lengths: np.ndarray, max_bits: int):
        self.bits = max_bits
        _, order = canonical(lengths)
        spans = (np.int64(1) << (max_bits - lengths[order].astype(np.int64))).astype(np.int64)
        unused = (1 << max_bits) - int(spans.sum())
        # an id and its code's length are one entry, so that a step looks once
        self.entry = np.concatenate([np.repeat(order << 6 | lengths[order], spans), np.ones(unused, np.int64)]).astype(np.uint32 if len(lengths) <= 1 << 26 else np.uint64)

    def blocks(self, blocks: list[tuple[int, np.ndarray, bytes]]) -> list[np.ndarray]:
        """The ids of (n, checkpoints, bits) each: all checkpoints of all blocks go on together, an id a step."""
        starts, parts, far = [], [], 0
        for _, marks, data in blocks:
            starts.append(marks.astype(np.int64) + 8 * far)
            parts += [data, b"\0" * (-len(data) % 4)]
            far += len(data) + -len(data) % 4
        words = np.frombuffer(b"".join([*parts, bytes(4 * (EVERY * self.bits // 32 + 4))]), ">u4").astype(np.uint64)
        pairs = words[:-1] << np.uint64(32) | words[1:]
        at, mask = np.concatenate(starts), np.uint64((1 << self.bits) - 1)
        steps = min(EVERY, max(n for n, _, _ in blocks))
        found, free = np.empty((steps, len(at)), self.entry.dtype), 64 - self.bits
        for i in range(steps):
            seen = pairs[at >> 5] >> (free - (at & 31)).view(np.uint64) & mask
            found[i] = self.entry[seen.view(np.int64)]
            at += found[i] & 63
        found >>= 6
        found, out, col = found.astype(np.uint32, copy=False), [], 0
        for n, marks, _ in blocks:
            out.append(found[:, col : col + len(marks)].T.reshape(-1)[:n])
            col += len(marks)
        return out


class FileWriter:
    """One file of the format; documents are added in order."""

    def __init__(self, out, lengths: np.ndarray, max_bits: int):
        self.out, self.lengths, self.at = out, lengths, 0
        self.codes, _ = canonical(lengths)
        self.held, self.n_held, self.n = [], 0, 0
        self.doc_ids, self.firsts, self.places = [], [], []
        table = zlib.compress(lengths.tobytes())
        self.put(HEADER.pack(MAGIC, len(lengths), max_bits, len(table)) + table)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.firsts.append(self.n)
        self.held.append(ids)
        self.n += len(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self.flush(False)

    def flush(self, all_: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        at = 0
        while len(ids) - at >= (1 if all_ else BLOCK):
            block = ids[at : at + BLOCK]
            data, marks = pack(block, self.codes, self.lengths)
            self.places.append((self.at, self.n - len(ids) + at))
            self.put(BLOCK_HEAD.pack(len(block), len(marks), len(data)) + marks.tobytes() + data)
            at += len(block)
        self.held, self.n_held = [ids[at:].copy()], len(ids) - at

    def close(self) -> tuple[int, int, int]:
        """The numbers of documents, blocks and ids."""
        self.flush(True)
        docs = np.array([d is None for d in self.doc_ids], np.uint8).tobytes() + np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + np.array(self.firsts, "<u8").tobytes()
        index = np.array(self.places, "<u8").reshape(-1, 2).T.tobytes()
        places = self.at, self.at + len(docs)
        self.put(docs + index)
        self.put(FOOTER.pack(*places, len(self.doc_ids), len(self.places), self.n, zlib.crc32(docs + index), MAGIC))
        self.out.close()
        return len(self.doc_ids), len(self.places), self.n


class FileReader:
    """A file of the format; any block can be read alone."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        if size < HEADER.size + FOOTER.size:
            raise ValueError("not a file of token ids: too short")
        docs_at, index_at, n_docs, n_blocks, self.n, crc, magic = FOOTER.unpack(self.part(size - FOOTER.size, FOOTER.size))
        first, alphabet, bits, table = HEADER.unpack(self.part(0, HEADER.size))
        if magic != MAGIC or first != MAGIC:
            raise ValueError("not a file of token ids")
        docs, index = self.part(docs_at, 17 * n_docs), self.part(index_at, 16 * n_blocks)
        if zlib.crc32(docs + index) != crc:
            raise ValueError("the tables of a file of token ids are damaged")
        self.null = np.frombuffer(docs, np.uint8, n_docs)
        self.doc_ids = np.frombuffer(docs, "<i8", n_docs, n_docs)
        self.firsts = np.frombuffer(docs, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.places = np.frombuffer(index, "<u8", n_blocks).astype(np.int64)
        self.block_first = np.frombuffer(index, "<u8", n_blocks, 8 * n_blocks).astype(np.int64)
        self.ends = np.concatenate([self.places[1:], [docs_at]]).astype(np.int64)
        self.lengths = np.frombuffer(zlib.decompress(self.part(HEADER.size, table)), np.uint8)
        self.decoder = Decoder(self.lengths, bits)
        if self.lengths.size != alphabet:
            raise ValueError("a file of token ids has other lengths than its alphabet needs")

    def part(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def block(self, k: int) -> tuple[int, np.ndarray, bytes]:
        raw = self.part(int(self.places[k]), int(self.ends[k] - self.places[k]))
        n, marks, size = BLOCK_HEAD.unpack_from(raw)
        at = BLOCK_HEAD.size + 4 * marks
        return n, np.frombuffer(raw, "<u4", marks, BLOCK_HEAD.size), raw[at : at + size]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the start-th on; only the blocks that hold them are read."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.block_first, start, "right")) - 1
        last = int(np.searchsorted(self.block_first, start + n, "left"))
        found = np.concatenate(self.decoder.blocks([self.block(k) for k in range(first, last)]))
        return found[start - int(self.block_first[first]) :][:n]

    def documents(self, first: int, blocks: int) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, first id, number of ids, CRC-32 of them) of the documents that begin in these blocks."""
        stop = min(first + blocks, len(self.places))
        begin = int(self.block_first[first])
        end = int(self.block_first[stop]) if stop < len(self.places) else self.n
        docs = range(int(np.searchsorted(self.firsts, begin)), int(np.searchsorted(self.firsts, end)))
        if not docs:
            return
        starts = self.firsts[docs.start : docs.stop + 1].tolist()
        if len(starts) == len(docs):
            starts.append(self.n)
        d, crc, at, block = 0, 0, starts[0], first
        while d < len(docs):
            # beyond its own blocks only the rest of one document is read
            taken = [self.block(k) for k in range(block, min(block + AT_ONCE, stop) if block < stop else block + 1)]
            ids, low = np.concatenate(self.decoder.blocks(taken)).astype("<u4"), int(self.block_first[block])
            block += len(taken)
            view, high = memoryview(ids).cast("B"), low + len(ids)
            while d < len(docs) and at < high:
                upto = min(high, starts[d + 1])
                crc = zlib.crc32(view[4 * (at - low) : 4 * (upto - low)], crc)
                at = upto
                if at == starts[d + 1]:
                    k = docs.start + d
                    yield None if self.null[k] else int(self.doc_ids[k]), starts[d], starts[d + 1] - starts[d], crc
                    d, crc = d + 1, 0


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 0, max_bits: int = 18, specials_as_text: bool = False, folder: str | None = None, per_task: int = FILE_IDS) -> DataFrame:
    """Write all documents' ids; returns the manifest (file, base, docs, blocks, ids), a row a file, base counting the ids before it."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)
    ids, counted = tokenized(docs, tokenizer, end_id, specials_as_text)
    told = counted.groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row an id that occurs: no more than the vocabulary has
    counts = np.zeros(int(told["id"].max()) + 1 if len(told) else 1, np.int64)
    counts[told["id"].to_numpy(np.int64)] = told["n"].to_numpy(np.int64)
    lengths, total = code_lengths(counts, max_bits), int(counts.sum())
    tasks = max(1, -(-total // per_task), min(-(-total // (1 << 20)), 4 * spark.sparkContext.defaultParallelism))
    dealt = ids.repartitionByRange(tasks, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "n", "ids")

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        part, number, out, path, made = TaskContext.get().partitionId(), 0, None, "", []

        def end() -> None:
            made.append((part, number, path, *out.close()))

        for b in it:
            for doc_id, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if out is not None and (out.n >= FILE_IDS or len(out.doc_ids) >= FILE_DOCS):
                    end()
                    out, number = None, number + 1
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.ids"
                    out = FileWriter(fs.open_output_stream(path, compression=None), lengths, max_bits)
                out.add(doc_id, _unpacked_ids(data.as_buffer(), n))
        if out is not None:
            end()
        names = ["part", "number", "file", "docs", "blocks", "ids"]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.string() if i == 2 else pa.int64()) for i in range(6)], names)
        trim()

    files = stored(dealt.mapInArrow(write, "part long, number long, file string, docs long, blocks long, ids long"), "manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return files.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("file", "base", "docs", "blocks", "ids")


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the manifest's files; start counts all ids before it."""
    folder = shared_dir(manifest.sparkSession)
    runs = manifest.where("blocks > 0").select("file", "base", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1, F.lit(RUN))).alias("first"))
    tasks = manifest.agg(F.sum(F.ceil(F.col("blocks") / RUN))).first()[0] or 1
    dealt = runs.repartition(min(tasks, 100_000))  # a number, as these few short rows stand for much work

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(folder)
        path, reader = None, None
        for b in it:
            for file, base, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != path:
                    path, reader = file, FileReader(fs.open_input_file(file))
                rows = [(d, base + start, n, crc) for d, start, n, crc in reader.documents(first, RUN)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])
        trim()

    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
