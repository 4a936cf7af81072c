"""BPE encoding and decoding of whole texts, equal to the tokenizer file's own library.

Texts up to ``block`` characters are encoded where they lie. Longer ones are cut and their blocks encoded in parallel: at
places where a piece surely ends (a blank after a visible character), else at the ends of the pre-tokenizer's pieces. A
single piece longer than ``block`` (long unsplit text) is cut into parts, which are joined as a tree: the parts' halves are
encoded on their own, then a window around each join is encoded again and doubled until its outer tokens agree with the
kept tokens on both sides. Two tokens agree when encoding their joined bytes gives the two back; a sequence in which all
neighbours agree is the encoding of its text, so the result is exact.

Defined results: null and empty texts have no tokens and decode to ''; texts that hold a special token's string get its id;
repeated rows are encoded each; bytes that are no valid UTF-8 after decoding become U+FFFD.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ship import ship

# Fixed value: how the byte-level pre-tokenizer splits a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE = regex.compile(r"(?<=[^\s\x00-\x20])[ \n]")
_PIECE = regex.compile(PIECES)
_WHOLE, _PART, _SPECIAL = 0, 1, 2
#: Bytes of text or ids in one batch that goes back to Spark.
_BATCH = 1 << 22


class Codec:
    """Vocabulary of a byte-level BPE file: merges by rank, ids to bytes, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        added = spec["added_tokens"]
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: only plain byte-level BPE is read")
        # The file spells bytes as printable characters: printable ones stand for themselves, the rest follow from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in added}
        self.ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        merged = [self.ranks[b"".join(bytes(byte_of[c] for c in half) for half in (m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        self.special = special
        self.bytes_of = {i: b for b, i in self.ranks.items()} | {i: s.encode() for s, i in special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.plain = tiktoken.Encoding("plain", pat_str=PIECES, mergeable_ranks=self.ranks, special_tokens={})

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part:
                yield part, self.special.get(part)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.segments(text):
            out += self.plain.encode_ordinary(part) if special is None else [special]
        return out

    def merge(self, piece: bytes) -> list[int]:
        """BPE of one piece, whatever its length: the lowest rank first, the leftmost of equals."""
        n = len(piece)
        if piece in self.ranks:
            return [self.ranks[piece]]
        end = list(range(1, n + 1))  # where the token that starts here ends; 0 once it is swallowed
        before = list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and end[at] < n:
                stop = end[end[at]]
                if (rank := self.ranks.get(piece[at:stop])) is not None:
                    heapq.heappush(heap, (rank, at, stop))

        for at in range(n - 1):
            offer(at)
        while heap:
            _, at, stop = heapq.heappop(heap)
            middle = end[at]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[at], end[middle] = stop, 0
            if stop < n:
                before[stop] = at
            offer(before[at])
            offer(at)
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def text_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def agree(self, left: int, right: int) -> bool:
        return self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two parts of one piece from the parts' encodings."""
        width = 4
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            middle = self.merge(self.text_bytes(left[i:]) + self.text_bytes(right[:j]))
            if (i == 0 or self.agree(left[i - 1], middle[0])) and (j == len(right) or self.agree(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            width *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(*pair) if len(pair) == 2 else pair[0] for pair in (parts[k : k + 2] for k in range(0, len(parts), 2))]
        return parts[0]

    def cut(self, text: str, block: int) -> Iterator[tuple[int, bytes]]:
        """Blocks of a long text with their kind: T and text, P and bytes of (a part of) one piece, or a special token's id."""
        for segment, special in self.segments(text):
            if special is not None:
                yield _SPECIAL, special.to_bytes(4, "little")
                continue
            at = 0
            while len(segment) - at > block:
                if safe := _SAFE.search(segment, at + block // 2, at + block):
                    yield _WHOLE, b"T" + segment[at : safe.start()].encode()
                    at = safe.start()
                    continue
                first = _PIECE.match(segment, at).end()
                if first - at > block:
                    piece = segment[at:first].encode()
                    for k in range(0, len(piece), block):
                        yield (_PART if k else _WHOLE), b"P" + piece[k : k + block]
                    at = first
                    continue
                # Blanks at a block's end would be split otherwise than before the next character.
                end = at if segment[first - 1].isspace() else first
                for m in _PIECE.finditer(segment, first):
                    if m.end() - at > block:
                        break
                    end = end if m[0][-1].isspace() else m.end()
                yield _WHOLE, (b"T" + segment[at:end].encode() if end > at else b"P" + segment[at:first].encode())
                at = max(end, first)
            if at < len(segment):
                yield _WHOLE, b"T" + segment[at:].encode()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def encode_texts(docs: DataFrame, tokenizer: str, text_col: str = "text", block: int = 1 << 15) -> DataFrame:
    """``docs`` (all columns) with ``n_tokens``, ``ids`` (unsigned 32-bit, little-endian, one after another) and ``decoded``.

    ``tokenizer`` is a path that every executor can open. Columns with those names are replaced.
    """
    ship(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_tokens", "ids", "decoded")])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out_schema = pa.schema([("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            start = 0
            while start < batch.num_rows:
                counts, ids, decoded, size = [], [], [], 0
                while start + len(ids) < batch.num_rows and size < _BATCH:
                    found = own.encode(texts[start + len(ids)].as_py())
                    counts.append(len(found))
                    ids.append(_packed(found))
                    decoded.append(own.text_bytes(found).decode("utf-8", "replace"))
                    size += 4 * len(found)
                part = batch.slice(start, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    schema=pa.schema([*list(batch.schema)[:-1], *out_schema]),
                )
                start += len(ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        schema = pa.schema([("__row", pa.int64()), ("__seq", pa.int32()), ("__kind", pa.int32()), ("__data", pa.binary())])
        for batch in batches:
            for row, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for seq, (kind, data) in enumerate(own.cut(body.as_py(), block)):
                    rows.append({"__row": row, "__seq": seq, "__kind": kind, "__data": data})
                    size += len(data)
                    if size > _BATCH:
                        yield _rows(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows, schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            found = []
            for kind, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if kind == _SPECIAL:
                    found.append(data)
                elif data[:1] == b"P":
                    found.append(_packed(own.merge(data[1:])))
                else:
                    found.append(_packed(own.plain.encode_ordinary(data[1:].decode())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], schema=batch.schema)

    def gather(table: pa.Table) -> pa.Table:
        own = codec(tokenizer)
        table = table.sort_by("__seq")
        ids: list[int] = []
        parts: list[list[int]] = []
        for kind, data in zip(table.column("__kind").to_pylist(), table.column("__data").to_pylist(), strict=True):
            if kind != _PART and parts:
                ids += own.tree(parts)
                parts = []
            parts.append(np.frombuffer(data, "<u4").tolist())
        ids += own.tree(parts) if parts else []
        return pa.table({
            "__row": pa.array([table.column("__row")[0].as_py()], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()),
            "ids": pa.array([_packed(ids)], pa.binary()), "decoded": pa.array([own.text_bytes(ids).decode("utf-8", "replace")], pa.string()),
        })

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    plain_schema = T.StructType(kept.schema.fields + added)
    short = kept.where(F.length(text) <= block).withColumn("__text", text).mapInArrow(here, plain_schema)

    long = kept.where(F.length(text) > block).withColumn("__row", F.monotonically_increasing_id())
    blocks = long.select("__row", text.alias("__text")).mapInArrow(cut, "__row long, __seq int, __kind int, __data binary")
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    encoded = blocks.repartition(parts, "__row", "__seq").mapInArrow(encode, "__row long, __seq int, __kind int, __data binary")
    whole = encoded.groupBy("__row").applyInArrow(gather, "__row long, n_tokens long, ids binary, decoded string")
    return short.unionByName(long.drop(text_col).join(whole, "__row").drop("__row").select(
        *[(F.col("decoded").alias(c) if c == text_col else F.col(f"`{c}`")) for c in kept.columns], "n_tokens", "ids", "decoded"
    ))
