"""Token ids in sorted-string-table shards.

Documents are encoded with the tokenizers library, sorted by id over range
partitions, and each task writes its rows to shard files in the shared folder:

    block*  index  bloom  footer

* A block holds about 64 KiB of entries, compressed with zstd. An entry is
  varint(shared key prefix), varint(rest of key), varint(value length), key rest, value.
  Every 16th entry restarts the prefix; the restart offsets end the block.
* The index has one entry for each block: last key, offset, length.
* The Bloom filter has 10 bits a key and 7 probes.
* The footer is fixed: offsets and lengths of index and filter, entries, tokens, width, magic.

A key is the id as 8 bytes, sign bit flipped, big end first, so bytes sort as
ids do; the empty key stands for a null id and comes first. A value is the ids with
the end id, two bytes each (four if the vocabulary needs it), little end first.
A lookup asks the filter, halves the index, reads one block, halves its restarts.

Nulls, ties and empty input: a null text is the empty text (the end id alone); rows that
repeat an id are all kept, next to each other in the order of their values; an empty
table has no shards and an empty result.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import partitions, scratch, stage, table
from .units import gather, split

MAGIC = b"WEFTSST1"
FOOTER = struct.Struct("<QQQQQQQQ8s")
BLOCK, RESTART, SHARD, PROBES, BITS = 1 << 16, 16, 64 << 20, 7, 10
#: Bytes of text that are encoded at a time, and units that are remembered.
SLICE, CACHE = 8 << 20, 2_400_000
#: A unit runs from white space to the next white space. Byte-level pre-tokenization always cuts before white space that follows other characters.
UNIT = re.compile(r"\s*\S+|\s+")
#: Punctuation that byte-level pre-tokenization cuts from a letter before it.
TAIL = ".,;:!?$&%*#"


class Encoder:
    """Whole texts to id bytes; units that came before are not encoded again. The cache has a fixed bound; what was not used of late goes."""

    def __init__(self, path: str, end_id: int, most: int = CACHE):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        n = self.tok.get_vocab_size()
        self.type = np.dtype("<u2" if max(n, end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.type).tobytes()
        self.length = np.zeros(n, np.int64)  # bytes of text under each id; byte-level pieces have one character a byte
        for piece, i in self.tok.get_vocab().items():
            self.length[i] = len(piece)
        self.whole = {x.content for x in self.tok.get_added_tokens_decoder().values()}
        self.most, self.cache, self.old, self.tails = most, {}, {}, {}

    def _alone(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]

    def _joined(self, units: list[str], space: str) -> list[bytes]:
        """Units that start with white space, of which `space` is not written out in them, are encoded as one text and cut apart by the
        bytes that each id covers."""
        text = space + space.join(units)
        raw = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
        n = np.fromiter(map(len, units) if text.isascii() else map(len, map(str.encode, units)), np.int64, len(units))
        cuts = ((np.searchsorted(np.cumsum(self.length[raw]), np.cumsum(n + len(space))) + 1) * self.type.itemsize).tolist()
        raw = raw.tobytes()
        return [raw[lo:hi] for lo, hi in pairwise([0, *cuts])]

    @staticmethod
    def cut(text: str) -> list[str]:
        """Units of a text that is not plain, as cache keys: runs of white space and what follows; a first unit without white space has \x02 before it."""
        if not text:
            return []
        units = UNIT.findall(text)
        if not units[0][0].isspace():
            units[0] = "\x02" + units[0]
        return units

    @staticmethod
    def unit(key: str) -> str:
        return key[1:] if key[0] == "\x02" else key if key[0].isspace() else " " + key

    def learn(self, new: set[str]) -> None:
        """Put units into the cache. A unit that ends in a letter and then punctuation is the ids of its word and those of the punctuation, as
        pre-tokenization cuts there; so words are encoded once for all that may follow them."""
        cache, old = self.cache, self.old
        if old:
            again = new.intersection(old)
            cache.update(zip(again, map(old.__getitem__, again), strict=True))
            new.difference_update(again)
        ended, spaced, lined, alone, tails = {}, set(), set(), set(), set()
        for u in new:
            word = u.rstrip(TAIL)
            if word != u and word and word[-1].isalpha() and word[-1] < "\u0250":
                ended[u] = word
                tails.add(u[len(word) :])
                if word in cache or word in old:
                    cache.setdefault(word, old.get(word))
                    continue
                u = word
            if not u[0].isspace() and u[0] != "\x02":
                spaced.add(u)
            elif u[0] == "\x02" or u[-1].isspace():
                alone.add(u)
            else:
                lined.add(u)
        for w in self.whole:  # whole ids end what is joined
            for part in (spaced, lined):
                odd = {u for u in part if w in u}
                part -= odd
                alone |= odd
        for part, f in ((spaced, lambda us: self._joined(us, " ")), (lined, lambda us: self._joined(us, "")), (alone, lambda us: self._alone(list(map(self.unit, us))))):
            part = list(part)
            for i in range(0, len(part), 8192):
                cache.update(zip(part[i : i + 8192], f(part[i : i + 8192]), strict=True))
        tails = list(tails.difference(self.tails))
        self.tails.update(zip(tails, self._alone(tails), strict=True))
        for u, word in ended.items():
            cache[u] = cache[word] + self.tails[u[len(word) :]]
        if len(self.tails) > 10_000:
            self.tails.clear()

    def known(self, units: list[str]) -> list[bytes]:
        got = list(map(self.cache.get, units))
        gaps = [i for i, v in enumerate(got) if v is None]
        if gaps:
            self.learn({units[i] for i in gaps})
            cache = self.cache
            for i in gaps:
                got[i] = cache[units[i]]
        return got

    def encode(self, texts: pa.Array) -> list[bytes]:
        gc.disable()  # the search for cycles would walk millions of units, which have none
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> list[bytes]:
        if len(self.cache) > self.most // 2:  # what the last half did not use goes
            self.old, self.cache = self.cache, {}
        plain, units, places, offsets = split(texts, tuple(self.whole))
        data, at = gather(self.known(units), places, offsets)
        data, at = memoryview(data), at.tolist()
        out = [b"".join((data[lo:hi], self.end)) for lo, hi in pairwise(at)]
        if plain.all():
            return out
        cut = list(map(self.cut, texts.filter(pa.array(~plain)).to_pylist()))
        got = iter(self.known(list(chain.from_iterable(cut))))
        rest, out = iter([b"".join(islice(got, len(us))) + self.end for us in cut]), iter(out)
        return [next(out) if p else next(rest) for p in plain.tolist()]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """One shard; keys must come in order. Only a block, the index and the keys' hashes are in memory."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at, self.index, self.keys, self.tokens = out, width, 0, [], [], 0
        self.zip = zstandard.ZstdCompressor(level=1)
        self._new()

    def _new(self) -> None:
        self.block, self.restarts, self.n, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1
        self.keys.append(key)
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.n:
            raw = self.zip.compress(bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts)))
            self.out.write(raw)
            self.index.append((self.last, self.at, len(raw)))
            self.at += len(raw)
            self._new()

    def close(self) -> None:
        self.flush()
        index = b"".join(varint(len(k)) + k + varint(a) + varint(n) for k, a, n in self.index)
        bits = max(64, BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        for k in set(self.keys):
            bloom[probes(k, bits)] = True
        packed = np.packbits(bloom).tobytes()
        self.out.write(index + packed + FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), bits, len(self.keys), self.tokens, self.width, MAGIC))
        self.out.close()


class Reader:
    """A shard behind a file object that can seek."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        ia, il, ba, bl, self.bits, self.n, self.tokens, self.width, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, at, self.index = self._at(ia, il), 0, []
        while at < len(raw):
            k, at = read_varint(raw, at)
            key, at = raw[at : at + k], at + k
            off, at = read_varint(raw, at)
            n, at = read_varint(raw, at)
            self.index.append((key, off, n))
        self.bloom = self._at(ba, bl)
        self.unzip = zstandard.ZstdDecompressor()

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            n, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + n]
            at += n

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        raw = self.unzip.decompress(self._at(*self.index[i][1:]))
        n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        return raw, list(struct.unpack_from(f"<{n}I", raw, len(raw) - 4 - 4 * n)), len(raw) - 4 - 4 * n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            raw, _, end = self._block(i)
            yield from self._entries(raw, 0, end)

    def get(self, key: bytes) -> list[bytes]:
        """All values under a key."""
        if not all(self.bloom[p >> 3] >> (7 - p % 8) & 1 for p in probes(key, self.bits)):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        out = []
        for i in range(lo, len(self.index)):
            raw, restarts, end = self._block(i)
            a, b = 0, len(restarts)
            while a < b:
                mid = (a + b) // 2
                first = next(self._entries(raw, restarts[mid], end))[0]
                a, b = (mid + 1, b) if first < key else (a, mid)
            for k, v in self._entries(raw, restarts[max(0, a - 1)] if restarts else 0, end):
                if k > key:
                    return out
                if k == key:
                    out.append(v)
        return out


def opened(path: str):
    fs, where = pafs.FileSystem.from_uri(path)
    return fs, where


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, shard_bytes: int = SHARD) -> DataFrame:
    """Write docs(doc_id, text) and return the written manifest: (shard, path, first, n_docs, n_tokens), shards numbered in key order.

    A file gets its name only when it is whole, and a task that runs again writes files of
    other names; the manifest alone says which ones count.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _encoder
        if globals().get("_encoder", (None,))[0] != (tokenizer, end_id):
            _encoder = ((tokenizer, end_id), Encoder(tokenizer, end_id))
        enc = _encoder[1]
        fs, where = opened(folder)
        fs.create_dir(where, recursive=True)
        made, now, path = [], None, ""

        def close() -> None:
            now.close()
            fs.move(f"{where}/.{path}", f"{where}/{path}")
            made.append((f"{folder}/{path}", id_of(now.keys[0]), len(now.keys), now.tokens))

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
            hi = 0
            while hi < len(ids):
                lo, before = hi, sizes[hi - 1] if hi else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, before + SLICE, "right")))
                for i, v in zip(ids[lo:hi], enc.encode(texts.slice(lo, hi - lo)), strict=True):
                    if now is not None and now.at + len(now.block) >= shard_bytes:
                        close()
                        now = None
                    if now is None:
                        path = f"shard-{uuid.uuid4().hex}.sst"
                        now = Writer(fs.open_output_stream(f"{where}/.{path}"), enc.type.itemsize)
                    now.add(key_of(i), v)
        if now is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": [m[0] for m in made], "part": list(range(len(made))), "first": [m[1] for m in made], "n_docs": [m[2] for m in made], "n_tokens": [m[3] for m in made]}, schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select("doc_id", "text").repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    out = rows.mapInArrow(write, "path string, part int, first long, n_docs long, n_tokens long")
    manifest = stage(out.withColumn("task", F.spark_partition_id()), "manifest")
    # one row a shard: small beside the documents
    order = W.orderBy("task", "part")
    return stage(manifest.select((F.row_number().over(order) - 1).alias("shard"), "path", "first", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start")), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the shards, ids as little-endian 32-bit values."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                fs, where = opened(row["path"])
                shard, start = Reader(fs.open_input_file(where)), row["start"]
                rows, size = [], 0
                for key, value in shard:
                    ids = np.frombuffer(value, f"<u{shard.width}").astype("<u4").tobytes()
                    rows.append((id_of(key), start, len(ids) // 4, ids))
                    start, size = start + len(ids) // 4, size + len(ids)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    return manifest.repartition(partitions(manifest.sparkSession), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) for wanted(doc_id): each id goes to the shards whose range can hold it, and is looked up there by binary search."""
    order = W.orderBy("shard")
    # shard ranges tile the ids, so over buckets of their mean width they take at most two rows a shard in sum
    low, high, n = manifest.agg(F.min("first"), F.max("first"), F.count("*")).first()
    if low is None:
        low = high = 0
    width = max(1, (high - low) // max(1, n))
    ranges = manifest.select("path", F.coalesce("first", F.lit(low)).alias("first"), F.coalesce(F.lead("first").over(order), F.lit(None)).alias("next"))
    last = (high - low) // width
    ranges = ranges.select("*", F.explode(F.sequence(F.floor((F.col("first") - low) / width), F.coalesce(F.floor((F.col("next") - low) / width), F.lit(last)))).alias("b"))
    ids = wanted.select("doc_id").distinct().where(F.col("doc_id") >= low).withColumn("b", F.least(F.floor((F.col("doc_id") - low) / width), F.lit(last)))
    hit = ids.join(ranges, "b").where((F.col("doc_id") >= F.col("first")) & (F.col("next").isNull() | (F.col("doc_id") <= F.col("next"))))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Reader] = {}
        for batch in batches:
            ids, values = [], []
            for row in batch.to_pylist():
                if row["path"] not in shards:
                    fs, where = opened(row["path"])
                    shards = {row["path"]: Reader(fs.open_input_file(where))}
                r = shards[row["path"]]
                for v in r.get(key_of(row["doc_id"])):
                    ids.append(row["doc_id"])
                    values.append(np.frombuffer(v, f"<u{r.width}").astype("<i4").tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return hit.repartition("path").sortWithinPartitions("path", "doc_id").select("doc_id", "path").mapInArrow(find, "doc_id long, ids array<int>")


def crc32_of(ids: str = "ids"):
    return F.crc32(F.col(ids)).cast("long")


def op1_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, scratch(spark, "sstable"))
    return read_shards(manifest).select("doc_id", "start", "n_tokens", crc32_of().alias("ids_crc32"))
