"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is marked: white space U+0020 becomes U+2581, one more goes in front. A marked word is a run of marks with
what follows up to the next mark; it is cut further around characters that occur in no longer piece (as line ends).
No piece crosses such a cut, so the best sequence of a text is that of its words, one after the other.

The distinct words of a batch are sorted, which makes them a trie walked depth-first: a word keeps the forward
scores of the prefix it shares with the word before it, and only the rest is searched. Ties go to the longer
last piece. Characters without a piece become their UTF-8 byte pieces (or the unknown piece, if the model has none).

Scores are the model's own if it is a unigram model. A BPE model has merge ranks r instead; they become
-ln((r + 1) ln N) by Zipf's law over N pieces, so the result is the likeliest sequence under that estimate, and not
the merge order's. Decoding gives back exactly the text, whatever it holds.

Nulls and empty input: a null text is the empty text, which has no pieces and decodes to the empty text; an
empty table gives an empty result; rows that repeat an id are encoded each for itself. A batch's distinct words bound the memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import table
from .units import FIRST, gather, split

MARK = "▁"
#: Stands for a mark that a text itself holds, inside a search; as a lone surrogate it is in no text.
REAL_MARK = "\ud800"
BYTE, UNKNOWN = -10.0, -100.0


class Pieces:
    """A piece table and its searches; `most` bounds the words that are kept."""

    def __init__(self, path: str, most: int = 300_000):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        raw = {i: m.get_score(i) for i in plain}
        if plain and all(s == int(s) for s in raw.values()) and min(raw.values()) < -1000:
            size = np.log(len(plain))
            raw = {i: float(-np.log((1 - s) * size)) for i, s in raw.items()}
        self.piece = {names[i]: (raw[i], np.array([i], "<i4").tobytes()) for i in plain}
        self.longest = max(map(len, self.piece), default=1)
        self.bytes = {int(names[i][3:-1], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.text_of = {i: names[i].replace(MARK, " ").encode() for i in plain} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.floor = min([s for s, _ in self.piece.values()], default=0.0)
        # every ending of a piece, with (score, id) if it is a piece itself: a search backwards stops where no piece can go on
        self.ending = {p[i:]: None for p in self.piece for i in range(len(p))} | self.piece
        size = np.array([len(self.text_of.get(i, b"")) for i in range(n)], np.int64)
        self.size, self.start = size, np.cumsum(size) - size
        self.blob = np.frombuffer(b"".join(self.text_of.get(i, b"") for i in range(n)), np.uint8)
        within = {c for p in self.piece if len(p) > 1 for c in p}
        # characters that stand alone in every piece: cuts around them are free
        lone = [c for c in map(chr, range(128)) if c not in within and c != MARK]
        self.cut = re.compile(f"[{re.escape(''.join(lone))}]|{MARK}*[^{MARK}{re.escape(''.join(lone))}]+|{MARK}+")
        if any(MARK in p.lstrip(MARK) for p in self.piece):
            raise ValueError("pieces across words: no word is a unit of this model")
        self.most, self.known = most, {}

    def words(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(MARK, REAL_MARK).replace(" ", MARK)) if text else []

    def search(self, words: Iterable[str]) -> dict[str, bytes]:
        """The best ids of each word as 32-bit numbers, over the words in sorted order."""
        ending, longest, out = self.ending, self.longest, {}
        best, back = [0.0], [(0, b"")]  # by prefix length: score, and (start of the last piece, its ids)
        last, stop = "", 0
        low = -1e300
        for w in sorted(words):
            n = min(len(w), len(last))
            k = 0
            while k < n and w[k] == last[k]:
                k += 1
            del best[k + 1 :], back[k + 1 :]
            for e in range(k + 1, len(w) + 1):
                top, where = low, None
                for a in range(e - 1, max(-1, e - longest - 1), -1):
                    got = ending.get(w[a:e], stop)
                    if got is stop:
                        break
                    if got is not None:
                        s = best[a] + got[0]
                        if s >= top:
                            top, where = s, (a, got[1])
                if where is None or w[e - 1] not in ending or ending[w[e - 1]] is None:
                    c = "▁" if w[e - 1] == REAL_MARK else w[e - 1]
                    ids = [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
                    s = best[e - 1] + self.floor + (BYTE * len(ids) if self.bytes else UNKNOWN)
                    if s > top:
                        top, where = s, (e - 1, np.array(ids, "<i4").tobytes())
                best.append(top)
                back.append(where)
            parts, e = [], len(w)
            while e > 0:
                e, part = back[e]
                parts.append(part)
            out[w] = b"".join(reversed(parts))
            last = w
        return out

    def learn(self, words: Iterable[str]) -> None:
        if len(self.known) > self.most:
            self.known = {}
        self.known |= self.search(set(words).difference(self.known))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and end."""
        texts = pc.fill_null(texts, "")
        plain, units, places, offsets = split(texts, (MARK,))
        words = [u if u[0] == "\n" else MARK + u.removeprefix(FIRST) for u in units]
        self.learn(words)
        data, ends = gather(list(map(self.known.__getitem__, words)), places, offsets)
        ids, at = np.frombuffer(data, "<i4"), ends.astype(np.int64) // 4
        if plain.all():
            return ids, at
        done = iter([ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        others = iter([self.words(t) for t in texts.filter(pa.array(~plain)).to_pylist()])
        out = []
        for is_plain in plain.tolist():
            if is_plain:
                out.append(next(done))
            else:
                ws = next(others)
                self.learn(ws)
                out.append(np.frombuffer(b"".join(map(self.known.__getitem__, ws)), "<i4"))
        return np.concatenate(out), np.append(0, np.cumsum([len(x) for x in out]))

    def decode(self, ids: np.ndarray) -> str:
        n = self.size[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.blob[at].tobytes().decode().removeprefix(" ")


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces.clear()
        _pieces[path] = Pieces(path)
    return _pieces[path]


def encode(docs: DataFrame, model: str, text: str = "text", names: tuple[str, str] = ("piece_ids", "decoded")) -> DataFrame:
    """docs with the piece ids and the text that they give back, under `names`; columns of docs that bear these are replaced. The model
    file is looked up where a task runs."""
    where = docs.columns.index(text)
    kept = [f for f in docs.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, at = p.encode(part.column(where))
                decoded = [p.decode(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                cols = [c for n, c in zip(part.schema.names, part.columns, strict=True) if n not in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids)), pa.array(decoded, pa.string())], names=[*[f.name for f in kept], *names])

    return docs.mapInArrow(run, StructType([*[StructField(f.name, f.dataType) for f in kept], StructField(names[0], ArrayType(IntegerType())), StructField(names[1], StringType())]))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
