"""Token files: documents as ids of a public tokenizer, packed by Simple-8b into 64-bit words.

The top four bits of a word are its selector: how many ids it holds and how many bits each has.
An id of more than 60 bits is escaped: selector 15, then the id as a word of its own. Ids are
packed in blocks of ``BLOCK_IDS``; a chunk lists the word at which each block begins, so blocks
are decoded apart, all at once, with one vector operation for each selector.

A file is a run of chunks, each ended by ``END``. A chunk: magic, number of documents, ids, blocks
and words; for each document its id, a flag (1: the id is null, 2: the document goes on in the
next chunk) and its number of ids here; the block offsets; the words. All is little-endian.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ravine.llm import spans as S
from ravine.llm.common import materialize, n_bytes, partitions, read_files, scratch, write_frames

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Ids in a word for each selector; each has 60 // count bits.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = 60 // COUNTS
ESCAPE = 15
BLOCK_IDS = 1024
#: Ids in a chunk at most.
CHUNK_IDS = 1 << 19
MAGIC, END = b"RVS8", "RVS8-END"
_HEAD = struct.Struct("<4sIQIQ")
#: Entries of a worker's table of encoded pieces, after which it starts anew.
PIECES = 1_000_000
#: Bytes of texts that are encoded together.
TOGETHER = 1 << 20

# Where the tokenizer's own pre-tokenizer has a boundary in any case: between a character that isn't
# white space and a space or line feed, and between a letter and a punctuation mark. Of characters
# beyond ASCII only those that UTF-8 begins with C3 (accented letters) are taken for no white space.
_LETTER, _INK, _GAP, _MARK = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] |= _INK
_KIND[[*range(65, 91), *range(97, 123)]] |= _LETTER
_KIND[[32, 10]] |= _GAP
_KIND[list(b".,!|*#$%&")] |= _MARK


def boundaries(data: np.ndarray) -> np.ndarray:
    """The bytes before which a text is cut."""
    kind = _KIND[data]
    ink = (kind & _INK) > 0
    ink[1:] |= (data[1:] >= 0x80) & (data[:-1] == 0xC3)
    cut = np.zeros(len(data), bool)
    cut[1:] = ((kind[1:] & _GAP) > 0) & ink[:-1] | ((kind[1:] & _MARK) > 0) & ((kind[:-1] & _LETTER) > 0)
    return cut


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _next_width(widths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each place the first selector whose ids, from there on, all fit."""
    best = np.full(len(widths), ESCAPE, np.uint8)
    top = {1: widths}  # the widest of the next 2 ** i ids
    span = 1
    while span < 64:
        wide, shifted = top[span], np.zeros_like(widths)
        shifted[:-span] = wide[span:]
        top[span * 2] = np.maximum(wide, shifted)
        span *= 2
    for s in range(len(counts) - 1, -1, -1):
        k = int(counts[s])
        span = 1 << (k.bit_length() - 1)
        wide = top[span]
        if span != k:
            shifted = np.zeros_like(widths)
            shifted[: -(k - span)] = wide[k - span :]
            wide = np.maximum(wide, shifted)
        best[wide <= BITS[s]] = s
    return best


_SMALL = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """The bits of each id."""
    if not len(ids) or int(ids.max()) < len(_SMALL):
        return _SMALL[ids.astype(np.uint16)]
    widths = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    large = np.flatnonzero(widths > 53)  # rounded, perhaps up to the next power of two
    widths[large] = [int(v).bit_length() for v in ids[large]]
    return widths


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``ids`` (unsigned), and the word at which each block begins, plus their number."""
    ids = np.asarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK_IDS)
    if not blocks:
        return np.empty(0, np.uint64), np.zeros(1, np.uint32)
    stride = BLOCK_IDS + 64  # zeros between blocks: no word reaches into the next
    grid = np.zeros((blocks, stride), np.uint64)
    full = np.zeros(blocks * BLOCK_IDS, np.uint64)
    full[: len(ids)] = ids
    grid[:, :BLOCK_IDS] = full.reshape(blocks, BLOCK_IDS)
    flat = grid.ravel()
    widths = _widths(flat)
    best = _next_width(widths, COUNTS)
    step = np.concatenate([COUNTS, [1, 1]])[np.minimum(best, 15)]
    starts = np.arange(blocks) * stride
    ends = starts + np.minimum(BLOCK_IDS, len(ids) - np.arange(blocks) * BLOCK_IDS)
    at, live, found = starts.copy(), np.arange(blocks), []
    while len(live):
        found.append(at[live])
        at[live] += step[at[live]]
        live = live[at[live] < ends[live]]
    places = np.sort(np.concatenate(found))
    chosen = best[places]
    length = 1 + (chosen == ESCAPE)
    target = np.cumsum(length) - length
    words = np.zeros(int(length.sum()), np.uint64)
    for s in np.unique(chosen):
        of = chosen == s
        if s == ESCAPE:
            words[target[of]] = np.uint64(ESCAPE) << np.uint64(60)
            words[target[of] + 1] = flat[places[of]]
            continue
        k, bits = int(COUNTS[s]), int(BITS[s])
        values = flat[places[of][:, None] + np.arange(k)] << (np.arange(k, dtype=np.uint64) * np.uint64(bits))
        words[target[of]] = np.bitwise_or.reduce(values, axis=1) | (np.uint64(s) << np.uint64(60))
    first = np.searchsorted(places, starts)
    return words, np.append(target[first], len(words)).astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids of ``pack``: all blocks at once, one step for each selector."""
    ids = np.zeros(n, np.uint64)
    if not n:
        return ids
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    escaped = np.flatnonzero(chosen == ESCAPE)
    raw = np.zeros(len(words), bool)
    if len(escaped):  # a raw word may look like an escape
        keep, last = [], -2
        for e in escaped.tolist():
            if e != last + 1 or not raw[e]:
                if not raw[e]:
                    raw[e + 1] = True
                    keep.append(e)
            last = e
        escaped = np.array(keep)
    held = np.concatenate([COUNTS, [0, 1]])[chosen]
    held[raw] = 0
    before = np.cumsum(held) - held
    block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    place = before - before[offsets[block]] + block * BLOCK_IDS
    end = np.minimum((block + 1) * BLOCK_IDS, n)
    if len(escaped):
        ids[place[escaped]] = words[escaped + 1]
    for s in np.unique(chosen[~raw]):
        if s == ESCAPE:
            continue
        of = np.flatnonzero((chosen == s) & ~raw)
        k, bits = int(COUNTS[s]), int(BITS[s])
        values = (words[of][:, None] >> (np.arange(k, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
        to = place[of][:, None] + np.arange(k)
        fits = to < end[of][:, None]
        ids[to[fits]] = values[fits]
    return ids


def chunk(docs: list[tuple[int | None, int, bool]], ids: np.ndarray) -> bytes:
    """A chunk of a file. docs: (doc_id, ids here, goes on)."""
    words, offsets = pack(ids)
    table = b"".join(struct.pack("<qBI", d or 0, (d is None) | 2 * more, n) for d, n, more in docs)
    return _HEAD.pack(MAGIC, len(docs), len(ids), len(offsets) - 1, len(words)) + table + offsets.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def chunks(data: bytes) -> Iterator[tuple[list[tuple[int | None, int, bool]], np.ndarray]]:
    """The chunks of a file: documents and ids."""
    at = 0
    while at < len(data):
        magic, n_docs, n_ids, n_blocks, n_words = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no chunk at {at}")
        at += _HEAD.size
        docs = [(None if flag & 1 else d, n, bool(flag & 2)) for d, flag, n in struct.iter_unpack("<qBI", data[at : at + 13 * n_docs])]
        at += 13 * n_docs
        offsets = np.frombuffer(data, "<u4", n_blocks + 1, at)
        at += 4 * (n_blocks + 1)
        words = np.frombuffer(data, "<u8", n_words, at)
        at += 8 * n_words
        if data[at : at + len(END)] != END.encode():
            raise ValueError(f"chunk without an end at {at}")
        at += len(END)
        yield docs, unpack(words, offsets, n_ids)


class Encoder:
    """Encodes texts piece by piece; pieces seen before come from a table.

    The library encodes every piece. Pieces end where its own pre-tokenizer has a boundary in any
    case, so the ids are those of the whole text. A piece is looked for by a 64-bit hash and is
    one of the table's only if all its bytes are. With ``added``, the strings of the vocabulary's added tokens are these tokens,
    as by the library's default; else they are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # texts are cut at added tokens before
        tokens = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()} if added else {}
        self.added = {t.encode(): i for t, i in tokens.items()}
        self.cut = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if tokens else None
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each id: a character of a byte-level token stands for one byte.
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        #: Hashes in order, each with the number of its piece; the pieces' bytes, and their ids, one after another.
        self.keys, self.piece = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.lead, self.length = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.at, self.bytes = np.zeros(1, np.int64), np.empty(0, np.uint8)
        self.begin, self.ids = np.zeros(1, np.int32), np.empty(0, np.uint16 if len(self.sizes) <= 1 << 16 else np.uint32)

    def _alone(self, pieces: list[bytes]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(pieces), 20_000):
            part = [p.decode() for p in pieces[at : at + 20_000]]
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids one after another and how many each has. The library has a cost for each
        call, so most are encoded as one text: pieces that begin with a space or line feed and end
        otherwise have boundaries between them, and the ids' bytes tell which ids are whose."""
        counts, parts = np.zeros(len(pieces), np.int64), []
        follows = np.array([p[0] in b" \n" and not p[-1:].isspace() and p[-1] < 0x80 for p in pieces], bool)
        many, order = np.flatnonzero(follows).tolist(), []
        for at in range(0, len(many), 16_384):
            of = many[at : at + 16_384]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join([pieces[i] for i in of]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum([len(pieces[i]) for i in of])
            last = np.minimum(np.searchsorted(ends, wanted), len(ids) - 1)
            if not len(ids) or ends[-1] != wanted[-1] or (ends[last] != wanted).any():  # not a byte-level vocabulary
                follows[of] = False
                continue
            counts[of] = np.diff(last, prepend=-1)
            parts.append(ids)
            order += of
        rest = np.flatnonzero(~follows).tolist()
        single = self._alone([pieces[i] for i in rest])
        counts[rest] = [len(x) for x in single]
        flat = np.concatenate([*parts, *single]) if parts or single else np.empty(0, np.uint32)
        order = np.array(order + rest, np.int64)
        held = np.cumsum(counts[order]) - counts[order]
        begin = np.empty(len(pieces), np.int64)
        begin[order] = held
        return flat[np.repeat(begin, counts) + _ranges(counts)], counts

    def _learn(self, keys: np.ndarray, lead: np.ndarray, pieces: list[bytes]) -> None:
        ids, counts = self.encode(pieces)
        at = np.searchsorted(self.keys, keys)
        self.piece = np.insert(self.piece, at, np.arange(len(self.lead), len(self.lead) + len(keys), dtype=np.int32))
        self.keys = np.insert(self.keys, at, keys)
        self.lead = np.concatenate([self.lead, lead])
        self.length = np.concatenate([self.length, [len(p) for p in pieces]])
        self.at = np.append(0, np.cumsum(self.length))
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(pieces), np.uint8)])
        self.begin = np.concatenate([self.begin, (self.begin[-1] + np.cumsum(counts)).astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])

    def __call__(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of each text (UTF-8 bytes)."""
        out, at = [], 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to]) <= TOGETHER):
                held += len(texts[to])
                to += 1
            out += self._together(texts[at:to])
            at = to
        return out

    def _together(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        data, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
        raw, ends = data.tobytes(), np.cumsum(sizes)
        cut = boundaries(data)
        cut[(ends - sizes)[sizes > 0]] = True
        special = [(m.start(), m.end()) for m in self.cut.finditer(raw)] if self.cut else []
        # a match across two texts is none
        special = [(x, y) for x, y in special if np.searchsorted(ends, x, side="right") == np.searchsorted(ends, y - 1, side="right")]
        for x, y in special:
            cut[x:y], cut[x] = False, True
            if y < len(cut):
                cut[y] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(data))
        ids, counts = self._pieces(data, raw, starts, stops, {int(np.searchsorted(starts, x)): self.added[raw[x:y]] for x, y in special})
        total = np.concatenate([[0], np.cumsum(counts)])
        edge = total[np.searchsorted(starts, np.append(0, ends))]
        return [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]

    def _pieces(self, data, raw, starts, stops, special: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids and how many each has; ``special``: pieces that are an added token."""
        if not len(starts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        hashes = np.empty(len(starts), np.uint64)
        for at in range(0, len(starts), 1 << 17):  # sums over a part at a time
            x, y = starts[at : at + (1 << 17)], stops[at : at + (1 << 17)]
            hashes[at : at + (1 << 17)] = S.Sums(S.BYTE_CODES[data[x[0] : y[-1]]])(x - x[0], y - x[0])
        lead = np.zeros(len(data) + 8, np.uint8)
        lead[: len(data)] = data
        length = (stops - starts).astype(np.uint64)
        lead = np.lib.stride_tricks.sliding_window_view(lead, 8)[starts].copy().view(np.uint64)[:, 0]
        lead &= ~np.uint64(0) >> (np.uint64(8) * (np.uint64(8) - np.minimum(length, np.uint64(8))))
        keys, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > PIECES:
            self._clear()
        near = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = near < len(self.keys)
        new[inside] = self.keys[near[inside]] != keys[inside]
        if new.any():
            self._learn(keys[new], lead[first[new]], [raw[x:y] for x, y in zip(starts[first[new]].tolist(), stops[first[new]].tolist())])
            near = np.searchsorted(self.keys, keys)
        piece = self.piece[near][of]
        other = (self.length[piece] != length.astype(np.int64)) | (self.lead[piece] != lead)  # another piece of the same hash
        long = np.flatnonzero((length > 8) & ~other)
        for part in np.split(long, range(1 << 17, len(long), 1 << 17)) if len(long) else []:
            n = self.length[piece[part]] - 8
            places = _ranges(n)
            same = data[np.repeat(starts[part] + 8, n) + places] == self.bytes[np.repeat(self.at[piece[part]] + 8, n) + places]
            other[part] = ~np.logical_and.reduceat(same, np.cumsum(n) - n)
        begin = self.begin[piece].astype(np.int64)
        counts = self.begin[piece + 1] - begin
        if other.any() or special:
            odd = dict.fromkeys(np.flatnonzero(other).tolist()) | special
            parts = dict(zip(odd, self._alone([raw[starts[i] : stops[i]] for i in odd])))
            parts |= {i: np.array([t], np.uint32) for i, t in special.items()}
            flat = np.concatenate([self.ids.astype(np.uint32), *(parts[i] for i in odd)])
            sizes = np.array([len(parts[i]) for i in odd])
            counts[list(odd)], begin[list(odd)] = sizes, len(self.ids) + np.cumsum(sizes) - sizes
        else:
            flat = self.ids
        return flat[np.repeat(begin, counts) + _ranges(counts)].astype(np.uint32), counts


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n of counts, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


@functools.cache
def encoder(path: str, added: bool = False) -> Encoder:
    """The worker's encoder; its table outlives a task."""
    return Encoder(path, added)


def _writer(path: str, added: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = encoder(path, added), np.array([END_ID], np.uint32)
        docs: list[tuple[int | None, int, bool]] = []
        held, n = [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([chunk(docs, np.concatenate(held))], pa.binary())], names=["chunk"])

        for b in batches:
            keys, texts = b.column(0).to_pylist(), S.texts(b.column(1))
            for at in range(0, len(texts), 512):
                for doc, encoded in zip(keys[at : at + 512], encode(texts[at : at + 512])):
                    ids = np.concatenate([encoded, end])
                    while n + len(ids) > CHUNK_IDS:
                        here = CHUNK_IDS - n
                        docs.append((doc, here, True))
                        held.append(ids[:here])
                        yield done()
                        docs, held, n, ids = [], [], 0, ids[here:]
                    docs.append((doc, len(ids), False))
                    held.append(ids)
                    n += len(ids)
        if docs:
            yield done()

    return write


def write_tokens(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", added: bool = False) -> None:
    """Write the ids of ``text`` (null: empty), each document ended by id 0, in ascending key order.

    ``added``: see ``Encoder``. Null keys come first; rows with equal keys follow each other, ordered by their texts' hash.
    Files are in order by name. A very long text goes on from chunk to chunk; an empty table gives
    no file; columns other than the key and ``text`` are ignored, whatever their names.
    """
    spark = df.sparkSession
    parts = partitions(spark, n_bytes(df, "text"), 24 << 20)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), "text").repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    write_frames(rows.mapInArrow(_writer(tokenizer, added), "chunk binary"), path, END)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "doc_id", "begins", "n_tokens", "ids_crc32"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            rows, place, crc, n = [], 0, 0, 0
            for docs, ids in chunks(content.as_py()):
                data, at = ids.astype("<u4").tobytes(), 0
                for doc, here, more in docs:
                    crc = zlib.crc32(data[4 * at : 4 * (at + here)], crc)
                    at, n = at + here, n + here
                    if not more:
                        rows.append((path.as_py(), doc, place, n, crc))
                        place, crc, n = place + n, 0, 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files below ``path``."""
    docs = materialize(read_files(spark, path).mapInArrow(_reader, "file string, doc_id bigint, begins bigint, n_tokens bigint, ids_crc32 bigint"), "token-documents")
    files = docs.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return docs.join(files, "file").select("doc_id", (F.col("before") + F.col("begins")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_documents(documents: DataFrame, added: bool = False) -> DataFrame:
    """Write the token files of ``documents`` in the shared folder and return what they hold."""
    spark = documents.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(documents, path, tokenizer_path(), added=added)
    return read_tokens(spark, path)
